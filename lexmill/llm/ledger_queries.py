"""Queries of problem 3 over run_items and map_sample."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm.ledger import Ledger, canonical_fields, canonical_key, canonical_list, canonical_text, copies_of_first
from lexmill.operators.snapshots import latest_version
from lexmill.session import materialise, table


def item_records(items: DataFrame) -> DataFrame:
    """Records of run_items: the latest row of each (run_id, item_key)."""
    fields = [canonical_text(F.col(c)) for c in ("category", "item", "source", "item_level")] + [canonical_list(F.col("entities"))]
    rows = items.select(F.col("run_id").alias("scope_id"), F.col("item_key").alias("copy_key"), F.col("loaded_at").alias("v"), canonical_key([F.lit("run_items"), F.col("run_id")], fields).alias("h"))
    return latest_version(rows, ["scope_id", "copy_key"], F.col("v"), F.col("h")).select(F.lit("run_items").alias("origin"), "scope_id", F.col("payload").alias("canon"), "copy_key")


def finding_records(results: DataFrame) -> DataFrame:
    """Records of map_sample: each finding of a job once."""
    rows = results.select(F.col("job_id").alias("scope_id"), F.explode("findings").alias("f")).filter("f is not null")
    fields = [canonical_text(F.col(f"f.{c}")) for c in ("severity", "finding_type", "explanation")] + [canonical_fields(F.col("f.fields_json"))]
    rows = rows.select("scope_id", F.col("f.finding_id").alias("copy_key"), canonical_key([F.lit("map_sample"), F.col("scope_id")], fields).alias("h"))
    return latest_version(rows, ["scope_id", "copy_key"], F.lit(0), F.col("h")).select(F.lit("map_sample").alias("origin"), "scope_id", F.col("payload").alias("canon"), "copy_key")


def p3_found(spark: SparkSession, root: str) -> DataFrame:
    """Copies of records; each table is one batch of the ledger."""
    ledger, batches = Ledger(spark), []
    for name, records in (("run_items", item_records), ("map_sample", finding_records)):
        batches.append(materialise(records(table(spark, root, name)), f"p3-{name}"))
        ledger.update(batches[-1])
    return copies_of_first(batches[0].unionByName(batches[1]), ledger.read())


def p3_group_counts(spark: SparkSession, root: str) -> DataFrame:
    """First key and number of copies of every group, kept over two deliveries of run_items.

    The first delivery holds the keys whose last row was loaded by the middle of
    the loading time, the second the rest.
    """
    rows = table(spark, root, "run_items")
    records = materialise(item_records(rows), "p3-items")
    last = rows.filter("run_id is not null and item_key is not null").groupBy("run_id", "item_key").agg(F.max("loaded_at").alias("at"))
    at = F.unix_micros(F.col("loaded_at").cast("timestamp"))
    middle = rows.agg(((F.min(at) + F.max(at)) / 2).alias("m")).first().m or 0.0
    early = last.select(F.col("run_id").alias("scope_id"), F.col("item_key").alias("copy_key"), F.coalesce(F.unix_micros(F.col("at").cast("timestamp")) <= middle, F.lit(True)).alias("early"))
    dated = materialise(records.join(early, ["scope_id", "copy_key"]), "p3-dated")
    ledger = Ledger(spark)
    ledger.update(dated.filter("early"))
    ledger.update(dated.filter("not early"))
    firsts = dated.select("origin", "scope_id", "canon", F.col("copy_key").alias("first_key"))
    return ledger.read().filter("copies > 1").join(firsts, ["canon", "first_key"]).select("origin", "scope_id", "first_key", "copies")


def _canon(x: str) -> str:
    t = f"regexp_replace(coalesce({x}, ''), '\\p{{Cf}}+', '', 'g')"
    t = f"regexp_replace({t}, '(^|[^\\pL\\pN])[-\u2010\u2011\u2012\u2212\ufe63\uff0d](\\pN)', '\\1\ue000\\2', 'g')"
    for _ in range(2):  # neighbouring points share a digit
        t = f"regexp_replace({t}, '(\\pN)\\.(\\pN)', '\\1\ue001\\2', 'g')"
    return f"replace(lower(regexp_replace({t}, '[\\pP\\pZ\\s\\p{{Cc}}`|~^]+', '', 'g')), 'ß', 'ss')"


_ITEMS = f"""it AS (
  SELECT run_id, item_key, {_canon('category')} AS c, {_canon('item')} AS i, {_canon('source')} AS s, {_canon('item_level')} AS l,
    list_sort(list_filter(list_transform(string_split(coalesce(entities, ''), ','), lambda e: {_canon('e')}), lambda e: e <> '')) AS e
  FROM run_items WHERE run_id IS NOT NULL AND item_key IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY run_id, item_key ORDER BY loaded_at DESC NULLS LAST) = 1
)"""
_FOUND = f"""WITH {_ITEMS}, i2 AS (SELECT 'run_items' AS origin, run_id AS scope_id, item_key AS copy_key, min(item_key) OVER (PARTITION BY run_id, c, i, s, l, e) AS first_key FROM it),
f AS (SELECT DISTINCT job_id, unnest(findings) AS f FROM map_sample),
f2 AS (SELECT job_id, f.finding_id AS k, any_value(f) AS f FROM f WHERE job_id IS NOT NULL AND f.finding_id IS NOT NULL GROUP BY 1, 2),
f3 AS (SELECT job_id, k, {_canon('f.severity')} AS a, {_canon('f.finding_type')} AS b, {_canon('f.explanation')} AS c,
  list_sort(coalesce(list_transform(json_keys(f.fields_json), lambda n: {_canon('n')} || chr(31) || {_canon("json_extract_string(f.fields_json, '$.\"' || n || '\"')")}), [])) AS d FROM f2),
f4 AS (SELECT 'map_sample' AS origin, job_id AS scope_id, k AS copy_key, min(k) OVER (PARTITION BY job_id, a, b, c, d) AS first_key FROM f3)
SELECT origin, scope_id, first_key, copy_key FROM (SELECT * FROM i2 UNION ALL SELECT * FROM f4) WHERE copy_key <> first_key"""

QUERIES = {"p3_found": p3_found, "p3_group_counts": p3_group_counts}
SQL = {
    "p3_found": _FOUND,
    "p3_group_counts": f"WITH {_ITEMS} SELECT 'run_items' AS origin, run_id AS scope_id, min(item_key) AS first_key, count(*) AS copies FROM it GROUP BY run_id, c, i, s, l, e HAVING count(*) > 1",
}
