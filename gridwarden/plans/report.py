"""Findings, plans and differences as JSON, SARIF and HTML documents."""

from __future__ import annotations

import json
import os
import tempfile
from html import escape
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridwarden.operators.policy import RANK, WEIGHT, summary

#: SARIF levels of severities.
LEVEL = {"critical": "error", "error": "error", "warning": "warning", "info": "note"}


def sarif_results(findings: DataFrame, uri: str) -> DataFrame:
    """One JSON text per finding, made on executors."""
    level = F.create_map(*[F.lit(x) for kv in LEVEL.items() for x in kv])
    place = F.struct(F.struct(F.struct(F.lit(uri).alias("uri")).alias("artifactLocation")).alias("physicalLocation"), F.array(F.struct(F.col("location").alias("fullyQualifiedName"))).alias("logicalLocations"))
    body = F.struct(F.col("rule_id").alias("ruleId"), F.element_at(level, F.col("severity")).alias("level"), F.struct(F.concat_ws(" ", "rule_id", "location").alias("text")).alias("message"), F.array(place).alias("locations"), F.struct(F.col("id").alias("findingId")).alias("partialFingerprints"))
    return findings.select(F.to_json(body).alias("result"))


def sarif(findings: DataFrame, uri: str, tool: str = "gridwarden") -> str:
    """A SARIF 2.1.0 document. For reports of a size that a reader opens; at scale write sarif_results() instead."""
    rules = sorted(r["rule_id"] for r in findings.select("rule_id").distinct().collect())
    results = [json.loads(r["result"]) for r in sarif_results(findings, uri).toLocalIterator()]
    run = {"tool": {"driver": {"name": tool, "rules": [{"id": r} for r in rules]}}, "results": results}
    return json.dumps({"version": "2.1.0", "$schema": "https://json.schemastore.org/sarif-2.1.0.json", "runs": [run]}, ensure_ascii=False)


def counts(findings: DataFrame) -> dict:
    by = {r["severity"]: r["count"] for r in findings.groupBy("severity").count().collect()}
    return {"total": sum(by.values()), "by_severity": by, "weighted_score": sum(WEIGHT[s] * n for s, n in by.items())}


def rows(df: DataFrame) -> list[dict]:
    """Rows for a document that people open; at scale write the table instead."""
    return [json.loads(x[0]) for x in df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).toLocalIterator()]


def severity_order(findings: DataFrame) -> DataFrame:
    """Findings in the order of reports: the gravest first, then rule, sheet, place and id."""
    rank = F.element_at(F.create_map(*[F.lit(x) for kv in RANK.items() for x in kv]), F.col("severity"))
    return findings.orderBy(rank.desc(), "rule_id", F.col("sheet").asc_nulls_first(), F.col("location").asc_nulls_first(), "id")


def findings_document(classified: DataFrame, source: str, scope: str, sha256: str, new_only: bool = False) -> dict:
    """The findings report, schema version 2, of findings that classify() has given a status."""
    active = severity_order(classified.where(F.col("status").isin("active", "new")))
    shown = {"findings": rows(active), "suppressed_findings": rows(severity_order(classified.where("status = 'suppressed'"))), "baseline_findings": rows(severity_order(classified.where("status = 'baseline'"))) if new_only else []}
    score = sum(WEIGHT[f["severity"]] for f in shown["findings"])
    return {"schema_version": 2, "source": source, "source_scope": scope, "source_sha256": sha256, "weighted_finding_score": score, "summary": summary(classified).first().asDict(), **shown}


def plan_document(patches: DataFrame, findings: DataFrame, source: str, sha256: str) -> dict:
    """A repair plan, schema version 2, bound to its source by hash; patches by sheet, cell, kind and id."""
    return {"schema_version": 2, "source": source, "source_sha256": sha256, "patches": rows(patches.orderBy("sheet", "cell", "kind", "id")), "findings": rows(severity_order(findings))}


def html(title: str, tables: dict[str, list[dict]]) -> str:
    """A page with one table per entry and a field that filters all rows by any text in them."""
    say = lambda x: escape("" if x is None else str(x))
    parts = []
    for name, items in tables.items():
        heads = list(items[0]) if items else []
        body = "".join("<tr>" + "".join(f"<td>{say(r.get(h))}</td>" for h in heads) + "</tr>" for r in items)
        parts.append(f"<h2>{say(name)} ({len(items)})</h2><table><thead><tr>{''.join(f'<th>{say(h)}</th>' for h in heads)}</tr></thead><tbody>{body}</tbody></table>")
    script = "const f=document.querySelector('input');f.oninput=()=>document.querySelectorAll('tbody tr').forEach(r=>r.hidden=!r.textContent.toLowerCase().includes(f.value.toLowerCase()))"
    style = "body{font-family:sans-serif;margin:2em}td,th{border:1px solid #ccc;padding:.2em .5em;text-align:left}table{border-collapse:collapse}"
    return f'<!doctype html><html><head><meta charset="utf-8"><title>{say(title)}</title><style>{style}</style></head><body><h1>{say(title)}</h1><input placeholder="filter">{"".join(parts)}<script>{script}</script></body></html>'


def write_whole(path: Path, text: str) -> None:
    """Writes a file so that readers see the old or the new one, never a part."""
    path.parent.mkdir(parents=True, exist_ok=True)
    with tempfile.NamedTemporaryFile("w", encoding="utf-8", dir=path.parent, delete=False) as f:
        f.write(text)
        f.flush()
        os.fsync(f.fileno())
    os.replace(f.name, path)
