"""The queries that __spark_entry__ registers for the engine itself, with DuckDB SQL for each.

The tables hold no formulas, styles or hidden rows; where a rule needs them, a query plants them by plain arithmetic
on a dense key, and its SQL plants the same.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from gridwarden.functions import labels, width
from gridwarden.functions.formula import signature_column, with_features
from gridwarden.functions.text import numeric_text
from gridwarden.operators import assertions, diff, policy, repair, rules, runs
from gridwarden.plans import layout_catalogue  # noqa: F401  (registers its queries)
from gridwarden.plans.registry import QUERIES, SQL, query, sql_finding, sql_id, table
from gridwarden.sources.table_sheet import as_cells

S = lambda x: f"CAST({x} AS VARCHAR)"


@query(sql_finding("WL012", "lineitem", "l_orderkey || ':' || l_linenumber", "error", "1.0") + ", count(*) AS occurrences FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1")
def dup_key(spark, d):
    return rules.duplicate_keys(table(spark, d, "lineitem"), "lineitem", ["l_orderkey", "l_linenumber"])


@query("SELECT rule_id, count(*) AS n, min(id) AS first_id, max(id) AS last_id FROM (SELECT 'WL012' AS rule_id, " + sql_id("WL012", "lineitem", "l_orderkey || ':' || l_linenumber") + " AS id FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1) GROUP BY rule_id")
def stable_ids(spark, d):
    return dup_key(spark, d).groupBy("rule_id").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))


@query("SELECT header, t, count(*) AS n, round(sum(num), 2) AS total FROM (SELECT 'o_custkey' AS header, 'n' AS t, CAST(o_custkey AS DOUBLE) AS num FROM orders UNION ALL SELECT 'o_orderstatus', 's', NULL FROM orders UNION ALL SELECT 'o_totalprice', 'n', o_totalprice FROM orders) GROUP BY header, t")
def long_format(spark, d):
    cells = as_cells(table(spark, d, "orders"), "orders", "o_orderkey", ["o_custkey", "o_orderstatus", "o_totalprice"])
    return cells.groupBy("header", "t").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("num"), 2).alias("total"))


FORMULA = "o_orderkey // 100 AS band, o_orderkey AS pos, CASE WHEN o_orderkey % 997 = 0 THEN 'R[0]C[-1]*3' ELSE 'R[0]C[-1]*2' END AS signature"


@query(
    f"WITH c AS (SELECT {FORMULA} FROM orders), m AS (SELECT band, signature, count(*) n FROM c GROUP BY ALL), b AS (SELECT band, sum(n) total, arg_max(signature, n) modal, max(n) modal_n FROM m GROUP BY band),"
    " o AS (SELECT c.*, b.modal, b.modal_n, b.total, pos - lag(pos) OVER (PARTITION BY c.band ORDER BY pos) gap FROM c JOIN b USING (band) WHERE total >= 4 AND modal_n >= 0.8 * total AND c.signature <> b.modal),"
    " g AS (SELECT *, min(gap) OVER (PARTITION BY band) near FROM o) "
    + sql_finding("WL002", "orders", "'D' || (pos + 2)", "warning", "round(modal_n / total, 6)") + ", modal AS expected FROM g WHERE coalesce(near > 1, true)"
)
def formula_outlier(spark, d):
    """Formulas =C{row}*2 in column D; every 997th is planted as *3."""
    row = F.col("o_orderkey") + 2
    orders = table(spark, d, "orders").select("o_orderkey", F.concat(F.lit("=C"), row.cast("string"), F.when(F.col("o_orderkey") % 997 == 0, "*3").otherwise("*2")).alias("formula"), row.alias("row"))
    cells = orders.select(F.floor(F.col("o_orderkey") / 100).alias("band"), F.col("o_orderkey").alias("pos"), signature_column(orders, F.col("formula"), F.col("row"), F.lit(4)).alias("signature"))
    return rules.formula_outliers(cells, "orders", F.concat(F.lit("D"), (F.col("pos") + 2).cast("string")))


def planted_gaps(spark, d):
    """Bands of fifty. A literal at 25; in every fourth band a blank at 30 as well, in every seventh two blanks, in every
    sixth a blank at the end; in some bands another formula in four places, in some in five, too many for 0.9."""
    k = F.col("p_partkey")
    band, at = F.floor(k / 50), k % 50
    blank = ((at == 30) & (band % 4 == 0)) | (at.isin(10, 12) & (band % 7 == 3)) | ((at == 0) & (band % 6 == 1))
    other = (at < 5) & (band % 5 == 2) | (at < 4) & (band % 5 == 3)
    sig = F.when(~blank & (at != 25), F.when(other, "R[0]C[-2]*2").otherwise("R[0]C[-1]*2"))
    return table(spark, d, "part").select(band.alias("band"), k.alias("pos"), sig.alias("signature"), F.when(at == 25, k.cast("string")).alias("value"))


GAPS = """c AS (SELECT p_partkey // 50 AS band, p_partkey AS pos, p_partkey % 50 AS spot FROM part),
p AS (SELECT *, (spot = 30 AND band % 4 = 0) OR (spot IN (10, 12) AND band % 7 = 3) OR (spot = 0 AND band % 6 = 1) AS blank, (spot < 5 AND band % 5 = 2) OR (spot < 4 AND band % 5 = 3) AS other FROM c),
k AS (SELECT band, pos, CASE WHEN blank THEN 'blank' WHEN spot = 25 THEN 'literal' ELSE 'formula' END AS kind, CASE WHEN other THEN 'R[0]C[-2]*2' ELSE 'R[0]C[-1]*2' END AS sig,
             pos > min(pos) OVER (PARTITION BY band) AND pos < max(pos) OVER (PARTITION BY band) AS inside FROM p),
m AS (SELECT band, arg_max(sig, n) AS modal FROM (SELECT band, sig, count(*) AS n FROM k WHERE kind = 'formula' GROUP BY ALL) GROUP BY band HAVING sum(n) >= 3 AND max(n) >= 0.9 * sum(n)),
h AS (SELECT band, kind, min(pos) AS pos FROM k WHERE inside AND kind <> 'formula' GROUP BY ALL HAVING count(*) = 1)"""


@query(f"WITH {GAPS} " + sql_finding("x", "part", "'D' || (pos + 2)", "error", "0.99").replace("'x'", "CASE WHEN kind = 'blank' THEN 'WL003' ELSE 'WL004' END") + ", modal AS expected FROM h JOIN m USING (band)")
def band_gaps(spark, d):
    return rules.band_gaps(planted_gaps(spark, d), "part", F.concat(F.lit("D"), (F.col("pos") + 2).cast("string")))


@query(f"WITH {GAPS}, t AS (SELECT band, count(DISTINCT replace(sig, 'R[0]C[-1]', 'C')) AS kinds, min('D' || (pos + 2)) AS source, count(*) AS n FROM k WHERE kind = 'formula' GROUP BY band) SELECT h.kind = 'blank' AS safe, 'D' || (h.pos + 2) AS cell, '=C' || (h.pos + 2) || '*2' AS after, source FROM h JOIN m USING (band) JOIN t USING (band) WHERE kinds = 1 AND n >= 2")
def gap_patches(spark, d):
    """Formulas proposed for the gaps: what all formulas of the band become when they are copied there."""
    row = F.col("pos") + 2
    cells = planted_gaps(spark, d).withColumn("row", row).withColumn("coord", F.concat(F.lit("D"), row.cast("string")))
    letter = F.when(F.col("signature") == "R[0]C[-1]*2", "C").otherwise("B")
    sources = cells.where("signature IS NOT NULL").select("band", "row", F.lit(4).alias("col"), "coord", F.concat(F.lit("="), letter, F.col("row").cast("string"), F.lit("*2")).alias("formula"))
    found = rules.band_gaps(cells, "part", F.concat(F.lit("D"), row.cast("string"))).select("id", "rule_id", F.col("location").alias("coord")).join(cells.select("band", "pos", "coord"), "coord")
    proposals = rules.translated_consensus(sources, found.select("band", "pos", (F.col("pos") + 2).alias("to_row"), F.lit(4).alias("to_col")))
    return rules.fill_patches(found, proposals, "part").select("safe", "cell", "after", "source")


@query(sql_finding("WL005", "orders", "'B' || (o_orderkey + 2)", "warning", "0.96") + " FROM orders WHERE o_orderkey % 20 = 19 AND o_orderkey % 3 = 0")
def sum_boundary(spark, d):
    """Every 20th row sums its block; of those a third, by key, stop one row too early."""
    k = F.col("o_orderkey")
    row = k + 2
    short = F.when(k % 3 == 0, row - 2).otherwise(row - 1)
    formula = F.when(k % 20 == 19, F.concat(F.lit("=SUM(B"), (row - 19).cast("string"), F.lit(":B"), short.cast("string"), F.lit(")")))
    cells = table(spark, d, "orders").select(row.alias("row"), F.lit(2).alias("col"), F.lit("B").alias("letter"), F.when(k % 20 != 19, F.col("o_totalprice")).alias("num"), formula.alias("formula"))
    return rules.sum_boundaries(cells, "orders")


@query("WITH c AS (SELECT p_partkey // 20 AS grp, p_partkey, p_size, p_partkey % 20 < (p_partkey // 20) % 8 AS as_text FROM part), w AS (SELECT grp, count(*) FILTER (NOT as_text) AS numbers, count(*) AS filled FROM c GROUP BY grp) " + sql_finding("WL006", "part", "'F' || (p_partkey + 2)", "warning", "CASE WHEN numbers >= 0.85 * filled THEN 0.97 ELSE 0.90 END") + ", CAST(p_size AS DOUBLE) AS value FROM c JOIN w USING (grp) WHERE as_text AND numbers >= 3 AND numbers >= 0.75 * filled")
def numeric_texts(spark, d):
    """Columns of twenty with none to seven of the sizes as texts: 0.75 and 0.85 are crossed."""
    k = F.col("p_partkey")
    as_text = k % 20 < F.floor(k / 20) % 8
    cells = table(spark, d, "part").select(F.floor(k / 20).alias("grp"), k.alias("pos"), F.when(~as_text, F.col("p_size").cast("double")).alias("num"), F.when(as_text, F.concat(F.lit(" "), F.col("p_size").cast("string"))).alias("txt"))
    return rules.numeric_texts(cells, "part", F.concat(F.lit("F"), (F.col("pos") + 2).cast("string")))


@query("SELECT p_brand, count(*) AS n, count(CASE WHEN regexp_full_match(x, '[0-9]+') AND length(x) <= 15 AND NOT regexp_matches(x, '^0[0-9]') THEN 1 END) AS numeric FROM (SELECT p_brand, CASE p_partkey % 4 WHEN 0 THEN CAST(p_size AS VARCHAR) WHEN 1 THEN '0' || p_size WHEN 2 THEN p_name ELSE '-' || p_size END AS x FROM part) GROUP BY p_brand")
def numeric_text_predicate(spark, d):
    k, size = F.col("p_partkey") % 4, F.col("p_size").cast("string")
    x = F.when(k == 0, size).when(k == 1, F.concat(F.lit("0"), size)).when(k == 2, F.col("p_name")).otherwise(F.concat(F.lit("-"), size))
    return table(spark, d, "part").groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"), F.count(numeric_text(x)).alias("numeric"))


STYLES = "c AS (SELECT c_custkey AS pos, c_custkey // 50 AS grp, CASE (c_custkey // 50) % 4 WHEN 0 THEN c_custkey % 50 = 7 WHEN 1 THEN c_custkey % 50 IN (7, 8) WHEN 2 THEN c_custkey % 5 = 2 ELSE c_custkey % 50 IN (7, 9, 30) OR c_custkey % 50 = 40 END AS odd FROM customer)"


@query(f"WITH {STYLES}, t AS (SELECT grp, count(*) AS total, greatest(count(*) FILTER (odd), count(*) FILTER (NOT odd)) AS modal_n, count(*) FILTER (odd) > count(*) FILTER (NOT odd) AS modal FROM c GROUP BY grp), o AS (SELECT c.*, total, modal_n, pos - lag(pos) OVER (PARTITION BY c.grp ORDER BY pos) AS gap FROM c JOIN t USING (grp) WHERE odd <> modal AND total >= 5 AND modal_n >= 0.8 * total), g AS (SELECT *, min(gap) OVER (PARTITION BY grp) AS near FROM o) " + sql_finding("WL007", "customer", "'B' || (pos + 2)", "info", "round(modal_n / total, 6)") + " FROM g WHERE coalesce(near > 1, true)")
def style_outlier(spark, d):
    """Columns of fifty with one odd style, with two side by side, with one in five, and with four apart."""
    k = F.col("c_custkey")
    at, grp = k % 50, F.floor(k / 50)
    odd = F.when(grp % 4 == 0, at == 7).when(grp % 4 == 1, at.isin(7, 8)).when(grp % 4 == 2, k % 5 == 2).otherwise(at.isin(7, 9, 30, 40))
    cells = table(spark, d, "customer").select(grp.alias("grp"), k.alias("pos"), F.when(odd, "bold").otherwise("plain").alias("style"))
    return rules.style_outliers(cells, "customer", F.concat(F.lit("B"), (F.col("pos") + 2).cast("string")))


@query(sql_finding("WL008", "customer", "(c_custkey + 2) || ':' || (c_custkey + 2)", "CASE WHEN c_custkey % 34 = 0 THEN 'warning' ELSE 'info' END", "1.0") + " FROM customer WHERE c_custkey % 17 = 0")
def hidden_rows(spark, d):
    """Every 17th row is planted as hidden, every other of those with a formula."""
    k = F.col("c_custkey")
    rows = table(spark, d, "customer").select((k + 2).alias("row"), (k % 17 == 0).alias("hidden"), F.lit(3).alias("filled"), (k % 34 == 0).cast("int").alias("formulas"))
    return rules.hidden_data(rows, "customer")


@query(
    "SELECT id, rule_id, severity, location FROM (" + sql_finding("WL008", "nation", "label", "CASE WHEN formulas > 0 THEN 'warning' ELSE 'info' END", "1.0") + " FROM (SELECT n_regionkey AS r, chr(CAST(65 + n_regionkey AS INT)) || ':' || chr(CAST(66 + n_regionkey AS INT)) AS label, count(*) FILTER (n_nationkey % 2 = 0) AS filled, count(*) FILTER (n_nationkey % 6 = 0) AS formulas FROM nation GROUP BY n_regionkey) WHERE r % 2 = 0 AND filled > 0)"
    " UNION ALL SELECT 'finding-' || substr(sha256(to_json(['WL008', 's' || r_regionkey, NULL, NULL])::VARCHAR), 1, 16), 'WL008', 'warning', 's' || r_regionkey FROM region WHERE r_regionkey % 2 = 1"
)
def hidden_spans_and_sheets(spark, d):
    """Spans of two columns by region, hidden for even ones, and sheets hidden for odd ones."""
    k, r = F.col("n_nationkey"), F.col("n_regionkey")
    lines = table(spark, d, "nation").groupBy(r.alias("r")).agg(F.count(F.when(k % 2 == 0, 1)).alias("filled"), F.count(F.when(k % 6 == 0, 1)).alias("formulas")).withColumn("hidden", F.col("r") % 2 == 0)
    letter = lambda n: F.chr(F.lit(65) + F.col("r") + n)
    spans = rules.hidden_data(lines, "nation", F.concat(letter(0), F.lit(":"), letter(1))).drop("confidence")
    sheets = table(spark, d, "region").select(F.concat(F.lit("s"), F.col("r_regionkey").cast("string")).alias("sheet"), F.when(F.col("r_regionkey") % 2 == 1, "hidden").otherwise("visible").alias("state"), F.lit(3).alias("filled"))
    return spans.unionByName(rules.hidden_sheets(sheets).drop("confidence").withColumnRenamed("sheet", "location"))


def planted_formulas(spark, d):
    k = F.col("s_suppkey")
    r = (k + 2).cast("string")
    formula = (
        F.when(k % 6 == 0, F.concat(F.lit("=#REF!+B"), r)).when(k % 6 == 1, F.concat(F.lit("='[Book.xlsx]S'!B"), r)).when(k % 6 == 2, F.concat(F.lit("=OFFSET(B"), r, F.lit(",1,0)")))
        .when(k % 6 == 3, F.lit("=SUM(B:B)")).when(k % 6 == 4, F.concat(F.lit('="#REF! NOW() B:B"&C'), r)).otherwise(F.concat(F.lit("=NOW()-B"), r))
    )
    return table(spark, d, "supplier").select((k + 2).alias("row"), formula.alias("formula"))


@query(" UNION ALL ".join(sql_finding(r, "supplier", "'C' || (s_suppkey + 2)", s, "1.0") + f" FROM supplier WHERE s_suppkey % 6 IN ({m})" for r, s, m in (("WL001", "error", "0"), ("WL009", "warning", "1"), ("WL010", "CASE WHEN s_suppkey % 6 = 5 THEN 'info' ELSE 'warning' END", "2, 3, 5"))))
def formula_findings(spark, d):
    """Formulas of six kinds are planted by key; constructs inside a string literal are none."""
    return rules.formula_findings(with_features(planted_formulas(spark, d)), "supplier", F.concat(F.lit("C"), F.col("row").cast("string")))


@query(sql_finding("WL011", "orders", "'C' || (o_orderkey + 2)", "error", "1.0") + " FROM orders WHERE o_orderstatus = 'P' OR o_orderkey % 500 = 1")
def error_cells(spark, d):
    """Status P is planted as the text #n/a, and every 500th cell as one of the error type."""
    k = F.col("o_orderkey")
    cells = table(spark, d, "orders").select(k.alias("pos"), F.when(k % 500 == 1, "e").otherwise("s").alias("data_type"), F.when(F.col("o_orderstatus") == "P", "#n/a").otherwise(F.col("o_orderstatus")).alias("txt"))
    return rules.error_cells(cells, "orders", F.concat(F.lit("C"), (F.col("pos") + 2).cast("string")))


@query("WITH n AS (SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN '#ref!' WHEN o_orderkey % 7 = 0 THEN '$A$1:' WHEN o_orderkey % 2 = 0 THEN '$A:$B' ELSE 'B2' END AS r FROM orders), f AS (SELECT *, CASE WHEN r = '#ref!' THEN 'lost reference' WHEN o_orderkey NOT IN (SELECT l_orderkey FROM lineitem) THEN 'missing sheet' WHEN r = '$A$1:' THEN 'bad range' END AS reason FROM n) " + sql_finding("WL013", "names", S("o_orderkey"), "error", "1.0") + ", reason FROM f WHERE reason IS NOT NULL")
def broken_names(spark, d):
    """Orders as names whose targets are line items; some ranges are lost, some can't be read."""
    k = F.col("o_orderkey")
    text = F.when(k % 9 == 0, "#ref!").when(k % 7 == 0, "$A$1:").when(k % 2 == 0, "$A:$B").otherwise("B2")
    names = table(spark, d, "orders").select(k.cast("string").alias("name"), k.alias("target"), text.alias("range"))
    return rules.broken_names(names, table(spark, d, "lineitem").select(F.col("l_orderkey").alias("target")))


@query(
    "WITH m AS (SELECT s_suppkey * 7 AS min_row, s_suppkey * 7 + 2 AS max_row, 2 AS min_col, 3 AS max_col FROM supplier), r AS (SELECT n_nationkey * 20 AS min_row, n_nationkey * 20 + 9 AS max_row, 1 AS min_col, 4 AS max_col FROM nation),"
    " h AS (SELECT DISTINCT m.* FROM m JOIN r ON m.min_row <= r.max_row AND m.max_row >= r.min_row AND NOT (m.min_row = r.min_row AND m.max_row = r.min_row)) " + sql_finding("WL014", "s", "min_row || ':' || min_col || ':' || max_row || ':' || max_col", "warning", "0.9") + " FROM h"
)
def merge_in_data(spark, d):
    """Merges of three rows at every seventh, regions of ten at every twentieth."""
    box = lambda df, lo, high, a, b: df.select(F.lit("s").alias("sheet"), lo.cast("long").alias("min_row"), (lo + high).cast("long").alias("max_row"), F.lit(a).alias("min_col"), F.lit(b).alias("max_col"))
    return rules.merges_in_data(box(table(spark, d, "supplier"), F.col("s_suppkey") * 7, 2, 2, 3), box(table(spark, d, "nation"), F.col("n_nationkey") * 20, 9, 1, 4), "s")


@query("WITH c AS (SELECT p_partkey, p_partkey // 10 AS grp, p_partkey % 10 < (p_partkey // 10) % 4 AS bare FROM part), t AS (SELECT grp, count(*) AS total, count(*) FILTER (bare) AS n FROM c GROUP BY grp) " + sql_finding("WL015", "part", "'E' || (p_partkey + 2)", "warning", "round((total - n) / total, 6)") + " FROM c JOIN t USING (grp) WHERE bare AND n = 1 AND total >= 4 AND total - n >= 3 AND total - n >= 0.75 * total")
def validation_outlier(spark, d):
    """Columns of ten in which none to three cells lack the validation."""
    k = F.col("p_partkey")
    cells = table(spark, d, "part").select(F.floor(k / 10).alias("grp"), k.alias("pos"), F.when(k % 10 >= F.floor(k / 10) % 4, "list").alias("validation"))
    return rules.validation_outliers(cells, "part", F.concat(F.lit("E"), (F.col("pos") + 2).cast("string")))


HEADERS = "['Account number', 'Order total', 'Amount', 'phone no', 'SKU', 'Unit price', 'Customer', '编号 2']"
IS_IDENTIFIER = "(regexp_matches(h, '编号') OR len(list_intersect(regexp_split_to_array(lower(h), '[^a-z0-9]+'), ['id', 'sku', 'code'])) > 0 OR (len(list_intersect(regexp_split_to_array(lower(h), '[^a-z0-9]+'), ['number', 'no'])) > 0 AND len(list_intersect(regexp_split_to_array(lower(h), '[^a-z0-9]+'), ['account', 'order', 'phone', 'customer'])) > 0))"
IS_MEASURE = "(len(list_intersect(regexp_split_to_array(lower(h), '[^a-z0-9]+'), ['total', 'amount', 'price'])) > 0)"


@query(
    f"WITH c AS (SELECT c_custkey AS k, CAST(power(10, 8 + c_custkey % 9) + c_custkey AS BIGINT) AS num, {HEADERS}[1 + (c_custkey // 9) % 8] AS h, CASE c_custkey % 4 WHEN 0 THEN 'General' WHEN 1 THEN ' GENERAL' WHEN 2 THEN NULL ELSE '0' END AS f, c_custkey % 13 = 0 AS hidden, CASE WHEN c_custkey % 5 = 0 THEN 40.0 ELSE 9.0 END AS w FROM customer),"
    " l AS (SELECT *, length(num::VARCHAR) AS n FROM c) " + sql_finding("WL019", "customer", "'A' || (k + 2)", "CASE WHEN n > 15 THEN 'error' ELSE 'warning' END", "0.99") + f" FROM l WHERE n >= 10 AND (f IS NULL OR f <> '0') AND NOT hidden AND {IS_IDENTIFIER} AND NOT {IS_MEASURE} AND NOT (n <= 11 AND w = 40.0)"
)
def long_identifiers(spark, d):
    """Numbers of nine to seventeen digits under eight headers and four formats, some hidden, some in wide columns."""
    k = F.col("c_custkey")
    num = (F.pow(F.lit(10.0), 8 + k % 9) + k).cast("double")
    header = F.element_at(F.array(*map(F.lit, ("Account number", "Order total", "Amount", "phone no", "SKU", "Unit price", "Customer", "编号 2"))), (1 + F.floor(k / 9) % 8).cast("int"))
    style = F.when(k % 4 == 0, "General").when(k % 4 == 1, " GENERAL").when(k % 4 == 3, "0")
    cells = table(spark, d, "customer").select(k.alias("pos"), num.alias("num"), style.alias("number_format"), header.alias("header"), (k % 13 == 0).alias("hidden"), F.when(k % 5 == 0, 40.0).otherwise(9.0).alias("width"))
    return rules.long_identifiers(cells, "customer", F.concat(F.lit("A"), (F.col("pos") + 2).cast("string")))


@query(f"SELECT h AS header, {IS_IDENTIFIER} AS identifier, {IS_MEASURE} AS measure FROM (SELECT unnest({HEADERS}) AS h)")
def header_kinds(spark, d):
    header = F.explode(F.array(*map(F.lit, ("Account number", "Order total", "Amount", "phone no", "SKU", "Unit price", "Customer", "编号 2"))))
    return table(spark, d, "region").where("r_regionkey = 0").select(header.alias("header")).select("header", labels.identifier_header(F.col("header")).alias("identifier"), labels.measure_header(F.col("header")).alias("measure"))


@query("SELECT template, count(*) AS n FROM (SELECT trim(regexp_replace(regexp_replace(lower(p_name || '  ' || p_size || ' of 2024 '), '[0-9]+', '<n>', 'g'), '\\s+', ' ', 'g')) AS template FROM part) GROUP BY template")
def label_templates(spark, d):
    text = F.concat("p_name", F.lit("  "), F.col("p_size").cast("string"), F.lit(" of 2024 "))
    return table(spark, d, "part").groupBy(labels.label_template(text).alias("template")).agg(F.count(F.lit(1)).alias("n"))


ROWS = "['Grand total', 'subtotals', 'Widget', 'Manual override', 'Average price', 'maximal', '合计']"


@query(f"SELECT 'c' AS sheet, k AS row FROM (SELECT c_custkey AS k, {ROWS}[1 + c_custkey % 7] AS t FROM customer) WHERE regexp_matches(lower(t), '(^|[^a-z0-9_])(total|average|override)([^a-z0-9_]|$)|合计') OR k % 11 IN (0, 2)")
def summary_rows(spark, d):
    """Rows with labels, some of which only look like those of summaries, and formulas of which some reach other rows."""
    k = F.col("c_custkey")
    label = F.element_at(F.array(*map(F.lit, ("Grand total", "subtotals", "Widget", "Manual override", "Average price", "maximal", "合计"))), (1 + k % 7).cast("int"))
    r = k.cast("string")
    formula = F.when(k % 11 == 0, F.concat(F.lit("=SUM(B1:B"), r, F.lit(")"))).when(k % 11 == 1, F.concat(F.lit("=SUM(B"), r, F.lit(":D"), r, F.lit(")"))).when(k % 11 == 2, F.lit("=_xlfn.AGGREGATE(9,5,Sheet2!C:C)")).otherwise(F.lit('="SUM("&A1'))
    base = table(spark, d, "customer")
    texts = base.select(F.lit("c").alias("sheet"), k.alias("row"), label.alias("txt"), F.lit(None).cast("string").alias("formula"))
    return rules.summary_rows(texts.unionByName(base.select(F.lit("c").alias("sheet"), k.alias("row"), F.lit(None).cast("string").alias("txt"), formula.alias("formula"))))


@query("SELECT p_partkey, round((length(regexp_replace(p_name, '[ ]', '', 'g')) + 0.5 * (length(p_name) - length(replace(p_name, ' ', '')))) * greatest(0.7, least(2.5, (6 + p_size) / 11.0)) * CASE WHEN p_partkey % 3 = 0 THEN 1.04 ELSE 1.0 END + 1.0, 6) AS width, 1 AS lines, round(greatest(12.0, (6 + p_size) * 1.25) + 2.0, 6) AS height FROM part WHERE regexp_full_match(p_name, '[A-Za-z0-9 ]+')")
def text_sizes(spark, d):
    parts = table(spark, d, "part").where(F.col("p_name").rlike("^[A-Za-z0-9 ]+$"))
    found = parts.withColumn("m", width.text_size(parts, F.col("p_name"), F.lit(6) + F.col("p_size"), F.col("p_partkey") % 3 == 0, F.lit(False), F.lit(None).cast("double")))
    return found.select("p_partkey", F.round("m.width", 6).alias("width"), "m.lines", F.round("m.height", 6).alias("height"))


@query("SELECT user_id, start, max(pos) AS \"end\", count(*) AS n FROM (SELECT *, min(pos) OVER (PARTITION BY user_id, grp) AS start FROM (SELECT *, pos - row_number() OVER (PARTITION BY user_id ORDER BY pos) AS grp FROM (SELECT DISTINCT user_id % 7 AS user_id, event_id // 3 AS pos FROM events WHERE event_type = 'click'))) GROUP BY user_id, start")
def islands(spark, d):
    e = table(spark, d, "events").where("event_type = 'click'").select((F.col("user_id") % 7).alias("user_id"), F.floor(F.col("event_id") / 3).alias("pos"))
    return runs.runs(e, ["user_id"], "pos")


@query("WITH p AS (SELECT DISTINCT event_type, event_id AS pos FROM events WHERE event_type IN ('click', 'view')), r AS (SELECT *, sum(new) OVER (PARTITION BY event_type ORDER BY pos) AS run FROM (SELECT *, CASE WHEN pos - lag(pos) OVER (PARTITION BY event_type ORDER BY pos) <= 2 THEN 0 ELSE 1 END AS new FROM p)) SELECT event_type, min(pos) AS start, max(pos) AS \"end\", count(*) AS n, count(*) / (max(pos) - min(pos) + 1) AS confidence FROM r GROUP BY event_type, run HAVING count(*) >= 3 AND max(pos) - min(pos) + 1 - count(*) <= 1")
def formula_bands(spark, d):
    e = table(spark, d, "events").where(F.col("event_type").isin("click", "view")).select("event_type", F.col("event_id").alias("pos"))
    return runs.bands(e, ["event_type"], "pos")


GRID = "SELECT DISTINCT event_id // 20 AS row, event_id % 20 + 1 AS col FROM events WHERE event_type IN ('click', 'view')"
RUN = "SELECT *, sum(new) OVER (PARTITION BY {by} ORDER BY {pos}) AS run FROM (SELECT *, CASE WHEN {pos} - lag({pos}) OVER (PARTITION BY {by} ORDER BY {pos}) <= {gap} THEN 0 ELSE 1 END AS new FROM g)"


@query(
    f"WITH g AS ({GRID}) " + " UNION ALL ".join(
        f"SELECT 'formula_{kind}' AS kind, min(row) AS min_row, max(row) AS max_row, min(col) AS min_col, max(col) AS max_col, count(*) AS n, count(*) / (max({pos}) - min({pos}) + 1) AS confidence FROM ({RUN.format(by=by, pos=pos, gap=2)}) GROUP BY {by}, run HAVING count(*) >= 3 AND max({pos}) - min({pos}) + 1 - count(*) <= 1"
        for kind, by, pos in (("row", "row", "col"), ("column", "col", "row"))
    )
)
def band_rectangles(spark, d):
    """Events as a grid of twenty columns; clicks and views are formulas."""
    return runs.formula_bands(grid(spark, d)).drop("sheet")


def grid(spark, d):
    e = table(spark, d, "events").where(F.col("event_type").isin("click", "view"))
    return e.select(F.lit("e").alias("sheet"), F.floor(F.col("event_id") / 20).alias("row"), (F.col("event_id") % 20 + 1).alias("col")).distinct()


@query(
    f"WITH g AS (SELECT row + 1 AS row, col FROM ({GRID})) SELECT false AS vertical, CASE WHEN count(*) = 1 THEN chr(CAST(64 + min(col) AS INT)) || row ELSE chr(CAST(64 + min(col) AS INT)) || row || ':' || chr(CAST(64 + max(col) AS INT)) || row END AS range FROM ({RUN.format(by='row', pos='col', gap=1)}) GROUP BY row, run"
    f" UNION ALL SELECT true, CASE WHEN count(*) = 1 THEN chr(CAST(64 + col AS INT)) || min(row) ELSE chr(CAST(64 + col AS INT)) || min(row) || ':' || chr(CAST(64 + col AS INT)) || max(row) END FROM ({RUN.format(by='col', pos='row', gap=1)}) GROUP BY col, run"
)
def compressed_ranges(spark, d):
    cells = grid(spark, d).withColumn("row", F.col("row") + 1)
    return runs.address_ranges(cells).select(F.lit(False).alias("vertical"), "range").unionByName(runs.address_ranges(cells, vertical=True).select(F.lit(True).alias("vertical"), "range"))


@query(f"WITH g AS ({GRID}) SELECT col, CASE WHEN count(*) = 1 THEN min(row)::VARCHAR ELSE min(row) || ':' || max(row) END AS range FROM ({RUN.format(by='col', pos='row', gap=1)}) GROUP BY col, run")
def number_runs(spark, d):
    return runs.number_ranges(grid(spark, d), ["col"], "row")


@query(f"WITH g AS ({GRID}) SELECT 'e' AS sheet, least(min(row), 3) AS min_row, greatest(max(row), 4) AS max_row, least(min(col), 2) AS min_col, greatest(max(col), 30) AS max_col FROM g")
def content_bounds(spark, d):
    merge = spark.range(1).select(F.lit("e").alias("sheet"), *[F.lit(x).cast("long").alias(n) for n, x in (("min_row", 3), ("max_row", 4), ("min_col", 2), ("max_col", 30))])
    return runs.content_bounds(grid(spark, d), merge)


TAIL = "SELECT p_partkey // 20 AS b, 200 + 10 * (p_partkey // 20) + p_partkey % 20 // 4 AS row, CASE WHEN (p_partkey // 20) % 4 = 1 THEN 14 ELSE 2 END + p_partkey % 4 AS col, (p_partkey // 20) % 5 = 0 AND p_partkey % 20 = 9 AS blocked FROM part WHERE NOT ((p_partkey // 20) % 3 = 0 AND p_partkey % 4 = 3)"


@query(f"SELECT min(row) AS min_row, max(row) AS max_row, min(col) AS min_col, max(col) AS max_col, count(*) AS cells FROM ({TAIL}) GROUP BY b HAVING count(*) >= 16 AND NOT bool_or(blocked) AND (min(col) >= 14 OR min(row) >= 1025)")
def formatting_tail(spark, d):
    """Blocks of up to twenty styled blank cells, ten rows apart, below and beside a content of 1,000 rows and six columns."""
    k = F.col("p_partkey")
    b, at = F.floor(k / 20), k % 20
    cells = table(spark, d, "part").where(~((b % 3 == 0) & (k % 4 == 3))).select(
        F.lit("s").alias("sheet"), (200 + 10 * b + F.floor(at / 4)).alias("row"), (F.when(b % 4 == 1, 14).otherwise(2) + k % 4).alias("col"), ((b % 5 == 0) & (at == 9)).alias("blocked")
    )
    content = spark.range(1).select(F.lit("s").alias("sheet"), *[F.lit(x).cast("long").alias(n) for n, x in (("min_row", 1), ("max_row", 1000), ("min_col", 1), ("max_col", 6))])
    return runs.formatting_tails(cells, content).drop("sheet")


@query("SELECT s_suppkey, arg_min(box, key) AS box FROM (SELECT s_suppkey, b::VARCHAR || ':' || (b + h)::VARCHAR AS box, {'a': (h + 1) * 5, 't': b} AS key FROM supplier, (SELECT n_nationkey * 3 AS b, n_nationkey % 7 AS h FROM nation) WHERE s_suppkey BETWEEN b AND b + h) GROUP BY s_suppkey")
def smallest_region(spark, d):
    n = F.col("n_nationkey")
    boxes = table(spark, d, "nation").select(F.lit("s").alias("sheet"), (n * 3).alias("min_row"), (n * 3 + n % 7).alias("max_row"), F.lit(1).alias("min_col"), F.lit(5).alias("max_col"))
    points = table(spark, d, "supplier").select(F.lit("s").alias("sheet"), F.col("s_suppkey").alias("row"), F.lit(2).alias("col"))
    return runs.smallest_containing(points, boxes).select(F.col("row").alias("s_suppkey"), F.concat_ws(":", F.col("box.min_row").cast("string"), F.col("box.max_row").cast("string")).alias("box"))


@query("SELECT 'D' || (k + 2) AS cell FROM (SELECT o_orderkey AS k, o_orderkey % 10 AS spot FROM orders) WHERE spot = 9 AND k % 3 <> 1 OR spot = 0 AND k % 4 = 0")
def boundary_aggregate(spark, d):
    """Bands of ten; the last formula sums the nine above it, or only eight; some first ones sum the nine below."""
    k = F.col("o_orderkey")
    row, at = k + 2, k % 10
    ref = lambda a, b: F.concat(F.lit("=SUM($D$"), (row + a).cast("string"), F.lit(":D"), (row + b).cast("string"), F.lit(")*1"))
    formula = F.when((at == 9) & (k % 3 != 1), ref(-9, -1)).when(at == 9, ref(-8, -1)).when((at == 0) & (k % 4 == 0), ref(1, 9)).otherwise(F.concat(F.lit("=C"), row.cast("string")))
    cells = table(spark, d, "orders").select(F.floor(k / 10).alias("band"), F.lit("formula_column").alias("kind"), row.alias("row"), F.lit(4).alias("col"), formula.alias("formula"), (row - at).alias("min_row"), (row - at + 9).alias("max_row"), F.lit(4).alias("min_col"), F.lit(4).alias("max_col"))
    return rules.boundary_aggregates(cells).where("boundary").select(F.concat(F.lit("D"), F.col("row").cast("string")).alias("cell"))


@query("SELECT 'orders' AS sheet, b * 25 AS min_row, least(b * 25 + 22, (SELECT max(o_orderkey) FROM orders)) AS max_row, 1::BIGINT AS min_col, 3::BIGINT AS max_col, 3 * (least(b * 25 + 22, (SELECT max(o_orderkey) FROM orders)) - b * 25 + 1) AS cells, 1.0::DOUBLE AS density FROM (SELECT DISTINCT o_orderkey // 25 AS b FROM orders) WHERE least(b * 25 + 22, (SELECT max(o_orderkey) FROM orders)) - b * 25 >= 1")
def regions(spark, d):
    """Blocks of 23 full rows of three columns, parted by two blank rows."""
    k = F.col("o_orderkey")
    cells = table(spark, d, "orders").where(k % 25 < 23).select(F.lit("orders").alias("sheet"), k.alias("row"), F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("col"))
    return runs.regions(cells)


@query("SELECT p_brand, p_partkey, last_value(h IGNORE NULLS) OVER (PARTITION BY p_brand ORDER BY p_partkey RANGE BETWEEN 8 PRECEDING AND 1 PRECEDING) AS header FROM (SELECT *, CASE WHEN p_partkey % 5 = 0 THEN p_name END AS h FROM part)")
def header_nearest(spark, d):
    parts = table(spark, d, "part").select("p_brand", "p_partkey", F.when(F.col("p_partkey") % 5 == 0, F.col("p_name")).alias("h"))
    return runs.nearest_header(parts, ["p_brand"], "p_partkey", "h").select("p_brand", "p_partkey", "header")


@query("SELECT p_size, pos, peer, CAST(rank AS INTEGER) AS rank FROM (SELECT a.p_size, a.p_partkey AS pos, b.p_partkey AS peer, row_number() OVER (PARTITION BY a.p_size, a.p_partkey ORDER BY abs(b.p_partkey - a.p_partkey), b.p_partkey) AS rank FROM (SELECT p_size % 5 AS p_size, p_partkey FROM part) a JOIN (SELECT p_size % 5 AS p_size, p_partkey FROM part) b ON a.p_size = b.p_size AND a.p_partkey <> b.p_partkey AND abs(a.p_partkey - b.p_partkey) <= 10) WHERE rank <= 8")
def k_nearest_peers(spark, d):
    parts = table(spark, d, "part").select((F.col("p_size") % 5).alias("p_size"), "p_partkey")
    return runs.nearest_peers(parts, parts, ["p_size"], "p_partkey")


@query(
    "SELECT 'unique' AS assertion, count(*) = 0 AS passed, count(*) AS violations FROM (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) > 1) UNION ALL SELECT 'allowed_values', count(*) = 0, count(*) FROM orders WHERE o_orderstatus NOT IN ('F', 'O')"
    " UNION ALL SELECT 'nonblank', count(*) = 0, count(*) FROM orders WHERE o_orderstatus = 'P' UNION ALL SELECT 'numeric_bounds', count(*) = 0, count(*) FROM customer WHERE c_acctbal < 0 OR c_acctbal > 9000"
    " UNION ALL SELECT 'equals', count(*) = (SELECT count(DISTINCT o_orderkey) FROM orders), CASE WHEN count(*) = (SELECT count(DISTINCT o_orderkey) FROM orders) THEN 0 ELSE 1 END FROM orders"
)
def assertion_results(spark, d):
    """The predicates side by side; status P counts as blank."""
    orders, customer = table(spark, d, "orders"), table(spark, d, "customer")
    out = assertions.unique(orders, "o_custkey").unionByName(assertions.allowed_values(orders, "o_orderstatus", ["F", "O"]))
    out = out.unionByName(assertions.nonblank(orders.select(F.expr("nullif(o_orderstatus, 'P')").alias("s")), "s")).unionByName(assertions.numeric_bounds(customer, "c_acctbal", 0, 9000))
    return out.unionByName(assertions.equals(orders.agg(F.count(F.lit(1)).alias("n")), orders.agg(F.countDistinct("o_orderkey").alias("n"))))


@query("SELECT l_orderkey, round(sum(l_extendedprice), 2) AS total, count(*) AS n FROM lineitem GROUP BY l_orderkey")
def sum_reconcile(spark, d):
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.round(F.sum("l_extendedprice"), 2).alias("total"), F.count(F.lit(1)).alias("n"))


def event_findings(spark, d):
    e = table(spark, d, "events")
    severity = F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "click", "warning").otherwise("info")
    rule = F.when(F.col("event_type") == "error", "WL011").when(F.col("event_type") == "click", "WL010").otherwise("WL007")
    return e.select(F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("id"), rule.alias("rule_id"), severity.alias("severity"), F.concat(F.lit("B"), F.col("event_id").cast("string")).alias("location"))


EVENTS = "SELECT 'e' || event_id AS id, CASE event_type WHEN 'error' THEN 'WL011' WHEN 'click' THEN 'WL010' ELSE 'WL007' END AS rule_id, CASE event_type WHEN 'error' THEN 'error' WHEN 'click' THEN 'warning' ELSE 'info' END AS severity, 'B' || event_id AS location, event_id FROM events"


@query(
    f"SELECT rule_id, waiver, status, count(*) AS n FROM (SELECT *, CASE WHEN waiver IS NOT NULL THEN 'suppressed' WHEN event_id % 3 = 0 THEN 'baseline' ELSE 'new' END AS status FROM (SELECT *, CASE WHEN rule_id = 'WL010' AND location LIKE 'B1%' THEN 0 WHEN rule_id IN ('WL010', 'WL007') AND location LIKE 'B_5%' THEN 2 END AS waiver FROM ({EVENTS}))) GROUP BY ALL"
)
def policy_status(spark, d):
    """Three waivers, one of them expired, then a baseline of every third finding."""
    waivers = [policy.Waiver(("WL010",), ("B1*",)), policy.Waiver(("WL011",), (), date(2026, 8, 18)), policy.Waiver(("WL010", "WL007"), ("B?5*",), date(2026, 8, 19))]
    base = table(spark, d, "events").where("event_id % 3 = 0").select(F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("id"))
    out = policy.classify(event_findings(spark, d), waivers, base, date(2026, 8, 19), new_only=True)
    return out.groupBy("rule_id", "waiver", "status").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT count(*) AS total, count(*) FILTER (event_id % 3 <> 0) AS active, 0::BIGINT AS suppressed, count(*) FILTER (event_id % 3 = 0) AS known, count(*) FILTER (event_id % 3 <> 0) AS \"new\" FROM ({EVENTS})")
def policy_summary(spark, d):
    base = table(spark, d, "events").where("event_id % 3 = 0").select(F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("id"))
    return policy.summary(policy.classify(event_findings(spark, d), [], base, date(2026, 8, 19), new_only=True))


@query(f"SELECT CAST(sum(CASE severity WHEN 'error' THEN 15 WHEN 'warning' THEN 5 ELSE 1 END) AS BIGINT) AS score FROM ({EVENTS})")
def weighted_score(spark, d):
    return policy.weighted_score(event_findings(spark, d))


@query(f"SELECT rule_id, severity, count(*) AS n FROM ({EVENTS}) GROUP BY ALL")
def severity_counts(spark, d):
    return policy.severity_counts(event_findings(spark, d))


@query(f"SELECT 'max_critical_findings' AS assertion, true AS passed, count(*) AS violations FROM ({EVENTS}) WHERE severity = 'critical' UNION ALL SELECT 'max_error_findings', count(*) <= 10, count(*) FROM ({EVENTS}) WHERE severity = 'error'")
def thresholds(spark, d):
    return assertions.thresholds(event_findings(spark, d), {"critical": 0, "error": 10})


@query(f"SELECT count(*) > 0 AS failed FROM ({EVENTS}) WHERE severity IN ('error', 'critical')")
def severity_gate(spark, d):
    return policy.gate(event_findings(spark, d), "error")


DIFF = "SELECT o_orderkey, o_orderstatus AS value, o_orderpriority AS style FROM orders"


@query(
    f"WITH b AS ({DIFF} WHERE o_orderkey % 11 <> 0), a AS (SELECT o_orderkey, CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE value END AS value, CASE WHEN o_orderkey % 5 = 0 THEN '1-URGENT' ELSE style END AS style FROM ({DIFF}) WHERE o_orderkey % 17 <> 0),"
    " j AS (SELECT coalesce(b.o_orderkey, a.o_orderkey) AS o_orderkey, b.value bv, a.value av, b.style bs, a.style st FROM b FULL JOIN a ON a.o_orderkey = b.o_orderkey)"
    " SELECT o_orderkey, 'value' AS field, 'error' AS severity, bv AS before, av AS after FROM j WHERE bv IS DISTINCT FROM av UNION ALL SELECT o_orderkey, 'style', 'info', bs, st FROM j WHERE bs IS DISTINCT FROM st"
)
def cell_diff(spark, d):
    """Rows removed, added, blanked and restyled by key."""
    k, base = F.col("o_orderkey"), table(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("value"), F.col("o_orderpriority").alias("style"))
    after = base.where(k % 17 != 0).select("o_orderkey", F.when(k % 13 != 0, F.col("value")).alias("value"), F.when(k % 5 == 0, "1-URGENT").otherwise(F.col("style")).alias("style"))
    return diff.cell_changes(base.where(k % 11 != 0), after, ["o_orderkey"], {"value": "error", "style": "info"})


@query("SELECT k, entry, before, after FROM (SELECT s_suppkey AS k, 'name' AS entry, s_name AS before, CASE WHEN s_suppkey % 3 = 0 THEN s_name || '!' ELSE s_name END AS after FROM supplier UNION ALL SELECT s_suppkey, 'nation', s_nationkey::VARCHAR, NULL FROM supplier) WHERE before IS DISTINCT FROM after")
def map_diff(spark, d):
    """Entries of a map that change, or are gone."""
    k, name = F.col("s_suppkey"), F.col("s_name")
    base = table(spark, d, "supplier")
    before = base.select(k.alias("k"), F.create_map(F.lit("name"), name, F.lit("nation"), F.col("s_nationkey").cast("string")).alias("m"))
    after = base.select(k.alias("k"), F.create_map(F.lit("name"), F.when(k % 3 == 0, F.concat(name, F.lit("!"))).otherwise(name)).alias("m"))
    return diff.map_changes(before, after, ["k"], "m")


@query("SELECT o_orderstatus AS status, count(*) AS n, array_to_string(list_slice(list_sort(list(o_orderkey)), 1, 3), ',') AS first FROM orders GROUP BY o_orderstatus")
def tail_summary(spark, d):
    changes = table(spark, d, "orders").select(F.col("o_orderstatus").alias("status"), F.col("o_orderkey").alias("place"))
    return diff.summarised(changes, ["status"], 3).select("status", "n", F.array_join(F.transform("first", lambda x: x.cast("string")), ",").alias("first"))


@query("WITH b AS (SELECT DISTINCT c_nationkey AS n, c_mktsegment AS s FROM customer WHERE c_custkey % 2 = 0), a AS (SELECT DISTINCT c_nationkey AS n, c_mktsegment AS s FROM customer WHERE c_custkey % 3 = 0) SELECT n, s, 'removed' AS change FROM (SELECT * FROM b EXCEPT SELECT * FROM a) UNION ALL SELECT n, s, 'added' FROM (SELECT * FROM a EXCEPT SELECT * FROM b)")
def list_diff(spark, d):
    c = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("n"), F.col("c_mktsegment").alias("s"))
    return diff.list_changes(c.where("c_custkey % 2 = 0"), c.where("c_custkey % 3 = 0"), ["n", "s"])


@query("SELECT DISTINCT o_orderstatus AS old, o_orderstatus || '-renamed' AS \"new\" FROM orders WHERE o_orderstatus <> 'F'")
def sheet_rename(spark, d):
    """One sheet per status; all but F are renamed, and a copy of O comes under a name that was there before."""
    cells = table(spark, d, "orders").select(F.col("o_orderstatus").alias("sheet"), F.col("o_orderkey").alias("row"), F.lit(1).alias("col"), F.col("o_orderpriority").alias("txt"))
    after = cells.withColumn("sheet", F.when(F.col("sheet") == "F", "F").otherwise(F.concat("sheet", F.lit("-renamed"))))
    return diff.renamed_sheets(diff.sheet_contents(cells), diff.sheet_contents(after))


@query("SELECT state, count(*) AS n FROM (SELECT CASE WHEN o_orderkey % 2 = 0 AND o_orderkey % 3 = 0 THEN 'remaining' WHEN o_orderkey % 2 = 0 THEN 'resolved' ELSE 'new' END AS state FROM orders WHERE o_orderkey % 2 = 0 OR o_orderkey % 3 = 0) GROUP BY state")
def finding_sets(spark, d):
    ids = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"))
    return diff.finding_sets(ids.where("id % 2 = 0"), ids.where("id % 3 = 0")).groupBy("state").agg(F.count(F.lit(1)).alias("n"))


def planted_patches(spark, d):
    k = F.col("p_partkey")
    kind = F.when(k % 4 == 0, "set_column_width").when(k % 4 == 1, "set_formula").when(k % 4 == 2, "set_numeric").otherwise("copy_style")
    return table(spark, d, "part").select(
        F.concat(F.lit("patch-"), k.cast("string")).alias("id"), kind.alias("kind"), F.lit("part").alias("sheet"), F.concat(F.lit("c"), (k % 200).cast("string")).alias("cell"), F.col("p_size").cast("double").alias("width"),
        (k % 10 != 0).alias("safe"), F.when(k % 7 == 0, 0.9).otherwise(0.97).alias("confidence"), F.when(k % 3 == 0, F.concat(F.lit("g"), F.floor(k / 6).cast("string"))).alias("atomic_group"),
    )


PATCHES = "SELECT 'patch-' || p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN 'set_column_width' WHEN 1 THEN 'set_formula' WHEN 2 THEN 'set_numeric' ELSE 'copy_style' END AS kind, 'part' AS sheet, 'c' || (p_partkey % 200) AS cell, CAST(p_size AS DOUBLE) AS width, p_partkey % 10 <> 0 AS safe, CASE WHEN p_partkey % 7 = 0 THEN 0.9 ELSE 0.97 END AS confidence, CASE WHEN p_partkey % 3 = 0 THEN 'g' || (p_partkey // 6) END AS atomic_group FROM part"


@query(f"WITH p AS ({PATCHES}), g AS (SELECT atomic_group, bool_and(safe AND confidence >= 0.95) AS whole FROM p WHERE atomic_group IS NOT NULL GROUP BY 1) SELECT p.id, p.kind FROM p LEFT JOIN g USING (atomic_group) WHERE safe AND confidence >= 0.95 AND coalesce(whole, true)")
def atomic_groups(spark, d):
    return repair.select_safe(planted_patches(spark, d)).select("id", "kind")


@query(f"SELECT sheet, cell, domain, count(DISTINCT id) AS n FROM (SELECT *, CASE WHEN kind IN ('set_formula', 'set_numeric') THEN 'value' WHEN kind = 'copy_style' THEN 'style' ELSE 'layout' END AS domain FROM ({PATCHES})) GROUP BY ALL HAVING count(DISTINCT id) > 1")
def patch_conflict(spark, d):
    return repair.conflicts(planted_patches(spark, d))


@query(f"SELECT id, cell, width FROM (SELECT *, row_number() OVER (PARTITION BY sheet, cell ORDER BY width DESC, id) AS n FROM ({PATCHES}) WHERE kind = 'set_column_width' AND atomic_group IS NULL) WHERE n = 1 UNION ALL SELECT id, cell, width FROM ({PATCHES}) WHERE kind <> 'set_column_width' OR atomic_group IS NOT NULL")
def width_coalesce(spark, d):
    return repair.coalesce_widths(planted_patches(spark, d)).select("id", "cell", "width")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 AND o_orderstatus = 'O' THEN 'F' ELSE o_orderstatus END AS txt FROM orders")
def apply_patches(spark, d):
    """Every ninth order is to change from O to F; where it isn't O any more, the patch doesn't hold."""
    cells = table(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("txt"))
    patches = cells.where("o_orderkey % 9 = 0").select("o_orderkey", F.lit("O").alias("before"), F.lit("F").alias("after"))
    return repair.apply_to_cells(cells, patches, ["o_orderkey"])


@query("SELECT p_brand, p_type AS modal, n AS modal_n, CAST(total AS BIGINT) AS total FROM (SELECT *, sum(n) OVER (PARTITION BY p_brand) AS total, row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, p_type DESC) AS r FROM (SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY ALL)) WHERE r = 1")
def consensus_mode(spark, d):
    return rules.consensus(table(spark, d, "part").select("p_brand", "p_type"), ["p_brand"], "p_type").select("p_brand", "modal", "modal_n", "total").distinct()


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
