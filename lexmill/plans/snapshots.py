"""Registered queries on snapshots of runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.operators.snapshots import snapshot_changes
from lexmill.session import table

FACETS = ["category", "item", "source", "item_level", "entities"]


def p4_found(spark: SparkSession, root: str) -> DataFrame:
    return snapshot_changes(table(spark, root, "runs"), table(spark, root, "run_items"), snapshot_id="run_id", source="source_path", at="created_at", key="item_key", compare=FACETS, version="loaded_at")


def p4_change_counts(spark: SparkSession, root: str) -> DataFrame:
    """Numbers of added, removed and changed keys of each run with changes."""
    found = p4_found(spark, root)
    return found.groupBy("run_id").agg(*[F.count(F.when(F.col("change") == c, 1)).alias(f"n_{c}") for c in ("added", "removed", "changed")])


_STEP = """CASE WHEN x IN ('', '.') THEN acc
    WHEN x = '..' THEN CASE WHEN acc <> '' AND acc NOT LIKE '%/..' THEN regexp_replace(acc, '/[^/]*$', '')
                            WHEN starts_with(flat, '/') THEN acc ELSE acc || '/..' END
    ELSE acc || '/' || x END"""

CHANGES_SQL = f"""
WITH run AS (
  SELECT run_id, created_at AS made, replace(trim(source_path), chr(92), '/') AS flat FROM runs
  WHERE run_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY loaded_at DESC NULLS LAST) = 1
), place AS (
  SELECT run_id, made, CASE WHEN starts_with(flat, '/') THEN 'root:' ELSE '' END
    || list_reduce(list_prepend('', string_split(flat, '/')), lambda acc, x: {_STEP}) AS place
  FROM run WHERE flat <> '' AND made IS NOT NULL
), link AS (
  SELECT run_id, lag(run_id) OVER (PARTITION BY place ORDER BY made, run_id) AS prev_id FROM place
), it AS (
  SELECT run_id, item_key, coalesce(category, '') AS c, coalesce(item, '') AS i, coalesce(source, '') AS s,
    coalesce(item_level, '') AS l, coalesce(entities, '') AS e FROM run_items
  WHERE run_id IS NOT NULL AND item_key IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY run_id, item_key ORDER BY loaded_at DESC NULLS LAST) = 1
), now AS (SELECT link.run_id, it.* EXCLUDE (run_id) FROM link JOIN it USING (run_id) WHERE prev_id IS NOT NULL),
before AS (SELECT link.run_id, it.* EXCLUDE (run_id) FROM link JOIN it ON it.run_id = link.prev_id),
p4 AS (
  SELECT coalesce(n.run_id, b.run_id) AS run_id, coalesce(n.item_key, b.item_key) AS item_key,
    CASE WHEN b.item_key IS NULL THEN 'added' WHEN n.item_key IS NULL THEN 'removed'
         WHEN (n.c, n.i, n.s, n.l, n.e) IS DISTINCT FROM (b.c, b.i, b.s, b.l, b.e) THEN 'changed' END AS change
  FROM now n FULL JOIN before b ON n.run_id = b.run_id AND n.item_key = b.item_key
)"""

QUERIES = {"p4_found": p4_found, "p4_change_counts": p4_change_counts}
SQL = {
    "p4_found": CHANGES_SQL + " SELECT run_id, item_key, change FROM p4 WHERE change IS NOT NULL",
    "p4_change_counts": CHANGES_SQL + """ SELECT run_id, count(*) FILTER (change = 'added') AS n_added, count(*) FILTER (change = 'removed') AS n_removed,
      count(*) FILTER (change = 'changed') AS n_changed FROM p4 WHERE change IS NOT NULL GROUP BY run_id""",
}
