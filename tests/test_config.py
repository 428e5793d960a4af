import datetime
import json

import pytest

from gridwarden import config


def test_config_is_strict_and_bounded():
    c = config.parse_config("version: 2\nworkbook: {max_error_findings: 0}\nsuppressions: [{id: a, reason: known, rules: [WL010_VOLATILE], expires: 2027-01-31}]\nkeys: [{sheet: S, range: A2:A9}]\nassertions: [{id: x, type: unique, sheet: S, range: A2:A9}]")
    assert c.thresholds == {"error": 0} and c.waivers[0].rules == ("WL010",) and c.waivers[0].expires == datetime.date(2027, 1, 31)
    bad = ["version: 3", "version: 1\nsuppressions: [{id: a, reason: known, rules: [WL010]}]", "version: 2\nother: 1", "version: 2\nsuppressions: [{id: a, reason: known}]", "version: 2\nkeys: [{sheet: S, range: A1:A100001}]", "- 1", "version: 2\nassertions: [{id: x, type: magic}]", "a: !!python/object:os.system x", "a: &a 1\nb: [" + "*a," * 51 + "]", "[" * 101 + "]" * 101, "version: 2\nassertions: [" + "{}," * 20_001 + "]"]
    for text in bad:
        with pytest.raises(config.UsageError):
            config.parse_config(text)


def test_baselines(tmp_path):
    def load(raw, scope=None):
        (tmp_path / "b.json").write_text(json.dumps(raw))
        return config.load_baseline(tmp_path / "b.json", scope)

    assert load(["a"]) == load({"finding_ids": ["a"]}) == {"a"}
    assert load({"workbooks": {"x/b.xlsx": ["a"], "c.xlsx": ["c"]}}, "x\\b.xlsx") == {"a"} and load({"workbooks": {}}, "x") == frozenset()
    assert load({"source_scope": "b.xlsx", "findings": [{"id": "a"}], "baseline_findings": [{"id": "z"}]}, "b.xlsx") == {"a", "z"}
    for raw, scope in (({"source_scope": "c.xlsx", "findings": []}, "b.xlsx"), ({"workbooks": {}}, None), ([""], None), ({"x": 1}, None), ({"workbooks": {"a\\b": [], "a/b": []}}, "a/b")):
        with pytest.raises(config.UsageError):
            load(raw, scope)
    for scope in ("", "/a", "../a", "c:/a"):
        with pytest.raises(config.UsageError):
            config.scope_of(scope)
