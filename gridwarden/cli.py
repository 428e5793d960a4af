"""Command line: scan, plan, apply, diff and test of one workbook. python -m gridwarden.cli --help"""

from __future__ import annotations

import argparse
import hashlib
import json
import sys
from datetime import date
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridwarden import config
from gridwarden.operators import diff, policy, repair
from gridwarden.plans import checks, report
from gridwarden.plans.scan import Book, Scan, read, release, scan, sheet_name
from gridwarden.sources import writer
from gridwarden.sources.workbook import inspect

#: Exit codes.
OK, FAILED, USAGE, UNSAFE, STALE, INVALID, INTERNAL = 0, 1, 2, 3, 4, 5, 10


class UnsafeInput(ValueError):
    """The workbook failed a safety check."""


class StalePlan(ValueError):
    """The plan isn't of this workbook as it is now."""


class InvalidResult(ValueError):
    """The patched workbook isn't written: it can't be read, or has grave findings that weren't there."""


def session() -> SparkSession:
    return SparkSession.builder.getOrCreate()


def inspected(path: str) -> tuple[str, str]:
    """(format, SHA-256) of a workbook that is safe to read."""
    if Path(path).name.startswith((".", "_")):
        raise config.UsageError(f"{path}: files named with a dot or underscore first are skipped by the reader")
    try:
        data = Path(path).read_bytes()
    except OSError as e:
        raise config.UsageError(str(e)) from e
    seen = inspect(Path(path).name, data)
    if not seen[1]:
        raise UnsafeInput(f"{path}: {seen[2]}")
    return seen[6], hashlib.sha256(data).hexdigest()


def all_findings(done: Scan, cfg: config.Config | None) -> DataFrame:
    found = done.findings()
    for keys in checks.duplicate_keys(done.book, cfg) if cfg else []:
        found = found.unionByName(keys.withColumns({"workbook": F.substring_index("sheet", "\0", 1), "sheet": sheet_name()}).select(*found.columns))
    return done.book.keep(found)


def classified(found: DataFrame, cfg: config.Config | None, baseline: frozenset[str] | None, new_only: bool) -> DataFrame:
    known = None if baseline is None else found.sparkSession.createDataFrame([(x,) for x in sorted(baseline)], "id string")
    return policy.classify(found, list(cfg.waivers) if cfg else [], known, date.today(), new_only)


def run_scan(a: argparse.Namespace) -> int:
    if a.new_only and not a.baseline:
        raise config.UsageError("--new-only needs --baseline")
    _, sha = inspected(a.workbook)
    cfg = config.load_config(a.config) if a.config else None
    scope = config.scope_of(a.source_scope or Path(a.workbook).name)
    done = scan(session(), a.workbook)
    marked = done.book.keep(classified(all_findings(done, cfg), cfg, config.load_baseline(a.baseline, scope) if a.baseline else None, a.new_only))
    doc = report.findings_document(marked, Path(a.workbook).name, scope, sha, a.new_only)
    active = marked.where(F.col("status").isin("active", "new"))
    out = Path(a.out)
    report.write_whole(out / "findings.json", json.dumps(doc, ensure_ascii=False, indent=1))
    report.write_whole(out / "snapshot.json", json.dumps({"source": doc["source"], "source_sha256": sha, **snapshot(done.book)}, ensure_ascii=False))
    report.write_whole(out / "results.sarif", report.sarif(active, scope))
    report.write_whole(out / "report.html", report.html(scope, {"Findings": doc["findings"], "Suppressed": doc["suppressed_findings"], "Baseline": doc["baseline_findings"]}))
    print(f"{len(doc['findings'])} active findings, score {doc['weighted_finding_score']}; reports in {out}")
    failed = a.fail_on and any(policy.RANK[f["severity"]] >= policy.RANK[a.fail_on] for f in doc["findings"])
    release(done.book)
    return FAILED if failed else OK


def snapshot(b: Book) -> dict:
    """All tables of a workbook as one document; for large ones write the tables."""
    plain = lambda df, *order: report.rows(df.withColumn("sheet", sheet_name()).drop("workbook").orderBy("sheet", *order))
    return {"sheets": plain(b.sheets, "position"), "cells": plain(b.cells, "row", "col"), "sizes": plain(b.sizes, "axis", "first"), "structures": plain(b.structures, "kind", "detail")}


def run_plan(a: argparse.Namespace) -> int:
    kind, sha = inspected(a.workbook)
    if kind != "xlsx":
        raise config.UsageError("only plain .xlsx workbooks may be repaired")
    cfg = config.load_config(a.config) if a.config else None
    done = scan(session(), a.workbook)
    doc = report.plan_document(done.patches(), all_findings(done, cfg), Path(a.workbook).name, sha)
    report.write_whole(Path(a.out), json.dumps(doc, ensure_ascii=False, indent=1))
    print(f"{len(doc['patches'])} patches, {sum(p['safe'] for p in doc['patches'])} of them safe; plan in {a.out}")
    release(done.book)
    return OK


def run_apply(a: argparse.Namespace) -> int:
    plan, (kind, sha) = config.load_plan(a.plan), inspected(a.workbook)
    out = Path(a.out)
    if kind != "xlsx" or out.exists() or not (a.safe_only or a.patch_id):
        raise config.UsageError("apply takes a plain .xlsx, an output that isn't there yet, and --safe-only or --patch-id")
    if plan["source_sha256"] != sha:
        raise StalePlan("the workbook has changed since the plan was made")
    done = scan(session(), a.workbook)
    fresh = done.book.keep(done.patches())
    planned = done.book.keep(session().createDataFrame([[p.get(c) for c in fresh.columns] for p in plan["patches"]], fresh.schema))
    if planned.exceptAll(fresh).limit(1).count():
        raise StalePlan("the plan holds patches that a scan doesn't propose")
    chosen = repair.select_safe(planned) if a.safe_only else repair.select_ids(planned, session().createDataFrame([(x,) for x in a.patch_id], "id string"), a.accept_layout_risk)
    # Layouts and edges of one cell don't exclude each other unless they are of one kind and side.
    target = F.when(F.col("kind").isin(*repair.LAYOUT), F.concat_ws("|", "cell", "kind", F.get_json_object("after", "$.side"))).otherwise(F.col("cell"))
    if repair.conflicts(chosen.withColumn("cell", target)).limit(1).count():
        raise config.UsageError("some of the chosen patches change the same thing")
    before, patches = done.book.keep(all_findings(done, None)), report.rows(chosen)
    old = Path(a.workbook).read_bytes()
    new = writer.patched(Path(a.workbook).name, old, patches)
    told = verified(before, new, out)
    told |= {"applied": sorted(p["id"] for p in patches), "parts": writer.changed_parts(old, new)}
    report.write_whole(Path(f"{a.out}.apply.json"), json.dumps(told, ensure_ascii=False, indent=1))
    print(f"{len(patches)} patches applied, {len(told['resolved'])} findings resolved; {out}")
    release(done.book)
    return OK


def verified(before: DataFrame, new: bytes, out: Path) -> dict:
    """Finding ids resolved, remaining and new in the patched workbook, which is written only if none of the new is grave."""
    draft = out.with_name(f"draft-{out.name}")  # a name with a dot or underscore first would be skipped by the reader
    draft.write_bytes(new)
    try:
        inspected(str(draft))
        done = scan(session(), str(draft))
        after = done.book.keep(done.findings())
        states = diff.finding_sets(before, after)
        grave = states.where("state = 'new'").join(after.where(F.col("severity").isin("error", "critical")), "id", "left_semi")
        if grave.limit(1).count():
            raise InvalidResult("the patched workbook has new errors")
        rows = [(r["state"], r["id"]) for r in states.collect()]  # of one workbook
        release(done.book)
        draft.replace(out)
    except UnsafeInput as e:
        raise InvalidResult(str(e)) from e
    finally:
        draft.unlink(missing_ok=True)
    return {s: sorted(i for state, i in rows if state == s) for s in ("resolved", "remaining", "new")}


def run_test(a: argparse.Namespace) -> int:
    inspected(a.workbook)
    cfg = config.load_config(a.config)
    done = scan(session(), a.workbook)
    active = classified(all_findings(done, cfg), cfg, None, False).where("status <> 'suppressed'")
    results = report.rows(checks.run(done.book, active, cfg))
    for r in results:
        print(f"{'pass' if r['passed'] else 'FAIL'} {r['assertion']}" + ("" if r["passed"] else f" ({r['violations']})"))
    if a.json:
        report.write_whole(Path(a.json), json.dumps({"passed": all(r["passed"] for r in results), "results": results}, ensure_ascii=False))
    release(done.book)
    return OK if all(r["passed"] for r in results) else FAILED


#: Fields of a cell that a difference is told for, with its severity.
CELL_FIELDS = {"formula": "error", "value": "error", "number_format": "warning", "style": "info"}


def differences(before: Book, after: Book) -> dict[str, list[dict]]:
    """Cells, sheets and structures that differ. A sheet renamed without other changes keeps its cells."""
    styles = F.to_json(F.struct("size", "bold", "wrap", "align", "has_fill", "left", "right", "top", "bottom"))
    cells = lambda b: b.cells.select(sheet_name().alias("sheet"), "row", "col", "formula", F.when(F.col("formula").isNull(), F.col("txt")).alias("value"), "number_format", styles.alias("style"), "txt")
    old, new = cells(before), cells(after)
    digest = lambda c, b: b.sheets.select(sheet_name().alias("sheet")).join(diff.sheet_contents(c.withColumn("txt", F.concat_ws("\0", "formula", "txt", "style"))), "sheet")
    renamed = diff.renamed_sheets(digest(old, before), digest(new, after))
    old = old.join(renamed.withColumnRenamed("old", "sheet"), "sheet", "left").withColumn("sheet", F.coalesce("new", "sheet")).drop("new")
    changed = diff.cell_changes(old, new, ["sheet", "row", "col"], CELL_FIELDS)
    own = lambda b, *kinds: b.structures.where(F.col("kind").isin(*kinds)).select(sheet_name().alias("sheet"), "kind", "name", "detail").fillna("", ["sheet", "name", "detail"])
    kinds = ("merge", "validation", "name", "print_area", "table", "filter")
    lists = diff.list_changes(own(before, *kinds), own(after, *kinds), ["sheet", "kind", "name", "detail"])
    sheets = diff.list_changes(*(b.sheets.select(sheet_name().alias("sheet"), "state") for b in (before, after)), ["sheet", "state"])
    sizes = lambda b: b.sizes.select(sheet_name().alias("sheet"), "axis", F.explode(F.sequence("first", F.least("last", F.lit(1_048_576).cast("long")))).alias("place"), "size", "hidden")
    sized = diff.cell_changes(sizes(before), sizes(after), ["sheet", "axis", "place"], {"size": "info", "hidden": "warning"})
    return {
        "Cells": report.rows(changed.orderBy("sheet", "row", "col", "field")), "Renamed sheets": report.rows(renamed.orderBy("old")), "Sheets": report.rows(sheets.orderBy("sheet", "change")),
        "Structures": report.rows(lists.orderBy("sheet", "kind", "detail", "change")), "Sizes": report.rows(sized.orderBy("sheet", "axis", "place", "field")),
    }


def run_diff(a: argparse.Namespace) -> int:
    books = []
    for path in (a.before, a.after):
        inspected(path)
        books.append(read(session(), path))
    found = differences(*books)
    out = Path(a.out)
    report.write_whole(out, report.html(f"{a.before} to {a.after}", found))
    report.write_whole(out.with_suffix(".json"), json.dumps(found, ensure_ascii=False))
    print(", ".join(f"{len(v)} {k.lower()}" for k, v in found.items()))
    for b in books:
        release(b)
    return OK


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="gridwarden")
    sub = p.add_subparsers(required=True)
    s = sub.add_parser("scan", help="report findings")
    s.add_argument("workbook")
    s.add_argument("--out", required=True)
    s.add_argument("--baseline")
    s.add_argument("--new-only", action="store_true")
    s.add_argument("--source-scope")
    s.add_argument("--fail-on", choices=policy.RANK)
    n = sub.add_parser("plan", help="propose patches")
    n.add_argument("workbook")
    n.add_argument("--out", required=True)
    t = sub.add_parser("test", help="check the assertions of a configuration")
    t.add_argument("workbook")
    t.add_argument("--json")
    y = sub.add_parser("apply", help="apply patches of a plan to a new copy")
    y.add_argument("workbook")
    y.add_argument("plan")
    y.add_argument("--out", required=True)
    y.add_argument("--patch-id", action="append")
    y.add_argument("--safe-only", action="store_true")
    y.add_argument("--accept-layout-risk", action="store_true")
    d = sub.add_parser("diff", help="compare two workbooks")
    d.add_argument("before")
    d.add_argument("after")
    d.add_argument("--out", required=True)
    for x, run in ((s, run_scan), (n, run_plan), (t, run_test), (d, run_diff), (y, run_apply)):
        x.set_defaults(run=run)
        if x not in (d, y):
            x.add_argument("--config", required=x is t)
    return p


def main(argv: list[str] | None = None) -> int:
    """Runs a command. 0: done; 1: findings or failed assertions; 2: usage; 3: an unsafe workbook; 4: a stale plan; 5: a patched workbook that fails its checks; 10: anything else."""
    try:
        a = parser().parse_args(argv)
    except SystemExit as e:
        return USAGE if e.code else OK
    try:
        return a.run(a)
    except config.UsageError as e:
        print(e, file=sys.stderr)
        return USAGE
    except UnsafeInput as e:
        print(e, file=sys.stderr)
        return UNSAFE
    except StalePlan as e:
        print(e, file=sys.stderr)
        return STALE
    except (InvalidResult, writer.PatchError) as e:
        print(e, file=sys.stderr)
        return INVALID
    except Exception as e:  # noqa: BLE001  (the exit code tells it from the others)
        print(f"{type(e).__name__}: {e}", file=sys.stderr)
        return INTERNAL


if __name__ == "__main__":
    sys.exit(main())
