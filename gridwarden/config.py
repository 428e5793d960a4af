"""What users hand in beside workbooks: configuration, baselines and repair plans. Small files, read on the driver within limits."""

from __future__ import annotations

import json
from dataclasses import dataclass
from datetime import date
from pathlib import Path

from gridwarden.operators.policy import Waiver
from gridwarden.sources.workbook import box

#: Limits in bytes, and of a configuration's aliases, nodes and depth; cells of a range that is checked.
CONFIG_BYTES, BASELINE_BYTES, PLAN_BYTES = 1 << 20, 20 << 20, 10 << 20
ALIASES, NODES, DEPTH = 50, 20_000, 100
RANGE_CELLS = 100_000
#: The fields that each part of a configuration may have.
FIELDS = {
    "": "version workbook assertions keys suppressions", "workbook": "max_critical_findings max_error_findings", "keys": "sheet range ignore_blank", "suppressions": "id reason finding_ids rules sheets locations expires",
    "assertions": "id type sheet range rules ignore_blank left right tolerance values minimum maximum",
}
CHECKS = ("no_findings", "unique", "equals", "allowed_values", "nonblank", "numeric_bounds")


class UsageError(ValueError):
    """What the user asked for or handed in can't be used."""


def read_file(path: str | Path, most: int) -> str:
    try:
        with open(path, "rb") as f:
            data = f.read(most + 1)
        if len(data) > most:
            raise UsageError(f"{path} is larger than {most} bytes")
        return data.decode("utf-8")
    except (OSError, UnicodeDecodeError) as e:
        raise UsageError(f"{path} can't be read: {e}") from e


def safe_yaml(text: str) -> object:
    """The value of a YAML text of bounded aliases, nodes and depth; its events are counted before anything is built."""
    import yaml

    try:
        aliases = nodes = depth = 0
        for event in yaml.parse(text, Loader=yaml.SafeLoader):
            aliases += isinstance(event, yaml.AliasEvent)
            nodes += isinstance(event, yaml.NodeEvent)
            depth += isinstance(event, yaml.CollectionStartEvent) - isinstance(event, yaml.CollectionEndEvent)
            if aliases > ALIASES or nodes > NODES or depth > DEPTH:
                raise UsageError("the configuration has too many aliases, nodes or levels")
        return yaml.safe_load(text)
    except (yaml.YAMLError, RecursionError) as e:
        raise UsageError(f"the configuration is no plain YAML: {e}") from e


def range_box(text: str) -> tuple[int, int, int, int]:
    """(min_row, max_row, min_col, max_col) of a rectangle of cells, within the limit."""
    found = box(text.replace("$", "")) if text and text.replace("$", "").replace(":", "").isalnum() else (None,) * 4
    if found[0] is None or (found[1] - found[0] + 1) * (found[3] - found[2] + 1) > RANGE_CELLS:
        raise UsageError(f"{text!r} is no range of at most {RANGE_CELLS} cells")
    return found


@dataclass(frozen=True)
class Config:
    thresholds: dict[str, int]
    keys: tuple[dict, ...]
    waivers: tuple[Waiver, ...]
    assertions: tuple[dict, ...]


def strict(part: str, value: object) -> dict:
    if not isinstance(value, dict):
        raise UsageError(f"{part or 'the configuration'} must be a mapping")
    if unknown := set(value) - set(FIELDS[part].split()):
        raise UsageError(f"{part or 'the configuration'} has unknown fields: {', '.join(sorted(map(str, unknown)))}")
    return value


def rule_ids(rules: list) -> tuple[str, ...]:
    """Ids of rules, with or without the name that may follow them."""
    return tuple(str(r).partition("_")[0] for r in rules)


def waiver(s: dict) -> Waiver:
    if not s.get("id") or len(str(s.get("reason") or "")) < 3:
        raise UsageError("a suppression needs an id and a reason")
    until = s.get("expires")
    until = date.fromisoformat(until) if isinstance(until, str) else until
    return Waiver(rule_ids(s.get("rules") or []), tuple(s.get("locations") or ()), until, tuple(s.get("finding_ids") or ()), tuple(s.get("sheets") or ()))


def parse_config(text: str) -> Config:
    """A configuration of version 1 or 2; unknown fields, suppressions without a scope and ranges beyond limits are refused."""
    raw = strict("", safe_yaml(text))
    if raw.get("version") not in (1, 2) or raw.get("version") == 1 and raw.get("suppressions"):
        raise UsageError("the version must be 1 or 2, and suppressions need 2")
    try:
        limits = {k.split("_")[1]: int(v) for k, v in strict("workbook", raw.get("workbook") or {}).items() if v is not None}
        keys, checks, suppressed = ([strict(p, x) for x in raw.get(p) or []] for p in ("keys", "assertions", "suppressions"))
        for k in keys:
            range_box(k["range"])
        for c in checks:
            if c["type"] not in CHECKS or not c["id"]:
                raise UsageError(f"an assertion of type {c['type']!r}")
        return Config(limits, tuple(keys), tuple(map(waiver, suppressed)), tuple(checks))
    except UsageError:
        raise
    except (KeyError, TypeError, ValueError) as e:
        raise UsageError(f"the configuration lacks something or has a wrong value: {e}") from e


def load_config(path: str | Path) -> Config:
    return parse_config(read_file(path, CONFIG_BYTES))


def scope_of(path: str) -> str:
    """A workbook's logical path: relative, with slashes, without steps up."""
    plain = path.replace("\\", "/").strip()
    parts = plain.split("/")
    if not plain or any(p in ("", ".", "..") for p in parts) or ":" in parts[0]:
        raise UsageError(f"{path!r} is no relative path")
    return "/".join(parts)


def load_json(path: str | Path, most: int) -> object:
    try:
        return json.loads(read_file(path, most))
    except json.JSONDecodeError as e:
        raise UsageError(f"{path} is no JSON: {e}") from e


def load_baseline(path: str | Path, scope: str | None = None) -> frozenset[str]:
    """Known finding ids: of a list, of finding_ids, of a findings report for the same workbook, or of the workbook's
    entry in workbooks."""
    raw = load_json(path, BASELINE_BYTES)
    if isinstance(raw, dict) and "finding_ids" in raw:
        raw = raw["finding_ids"]
    elif isinstance(raw, dict) and "workbooks" in raw:
        if scope is None or not isinstance(raw["workbooks"], dict):
            raise UsageError("a baseline by workbooks needs the workbook's path")
        entries = [(scope_of(k), v) for k, v in raw["workbooks"].items()]
        if len({k for k, _ in entries}) < len(entries):
            raise UsageError("a baseline names a workbook twice")
        raw = dict(entries).get(scope_of(scope), [])
    elif isinstance(raw, dict) and "findings" in raw:
        told = raw.get("source_scope")
        same = scope is None or (scope_of(told) == scope_of(scope) if isinstance(told, str) else str(raw.get("source", "")).rpartition("/")[2] == scope_of(scope).rpartition("/")[2])
        if not same:
            raise UsageError("the baseline is of another workbook")
        raw = [f.get("id") if isinstance(f, dict) else None for part in ("findings", "baseline_findings") for f in raw.get(part) or []]
    if not isinstance(raw, list) or not all(isinstance(x, str) and x for x in raw):
        raise UsageError("a baseline holds finding ids")
    return frozenset(raw)


def load_plan(path: str | Path) -> dict:
    """A repair plan of schema version 2."""
    raw = load_json(path, PLAN_BYTES)
    if not isinstance(raw, dict) or raw.get("schema_version") != 2 or not isinstance(raw.get("patches"), list):
        raise UsageError("a plan has schema version 2 and patches")
    return raw
