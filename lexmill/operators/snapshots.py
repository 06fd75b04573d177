"""Changes between consecutive full snapshots of a table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Parts that the rows of a snapshot are split into where they meet its neighbours.
PARTS = 16


def normal_path(path: Column) -> Column:
    """One spelling for all paths that lead to the same place.

    Both slashes separate, repeated and trailing ones and ``.`` vanish, ``..``
    takes back a step (never above a root; kept at the start of a relative
    path). Letter case counts. Null and blank paths become null.
    """
    flat = F.replace(F.trim(path), F.lit("\\"), F.lit("/"))
    rooted = flat.startswith("/")

    def step(done: Column, part: Column) -> Column:
        stuck = (done == "") | done.endswith("/..")
        up = F.when(~stuck, F.regexp_replace(done, "/[^/]*$", "")).when(rooted, done).otherwise(F.concat(done, F.lit("/..")))
        return F.when((part == "") | (part == "."), done).when(part == "..", up).otherwise(F.concat(done, F.lit("/"), part))

    walked = F.aggregate(F.split(flat, "/"), F.lit(""), step)
    return F.when(flat != "", F.concat(F.when(rooted, F.lit("root:")).otherwise(F.lit("")), walked))


def row_hash(columns: Sequence[str]) -> Column:
    """128-bit hash of the columns as stored, null taken as the empty string."""
    return F.unhex(F.md5(F.to_json(F.array(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]))))


def latest_version(df: DataFrame, keys: Sequence[str], version: Column, payload: Column) -> DataFrame:
    """``keys`` with the ``payload`` of the row of the greatest ``version``.

    Columns: the keys and ``payload``. A null version is the oldest; among equal
    versions the greatest payload wins, so the result doesn't depend on row
    order. Rows with a null key are left out. Only keys, version and payload are
    shuffled, after a map-side maximum.
    """
    slim = df.select(*keys, F.struct(version.alias("v"), payload.alias("p")).alias("_row"))
    for k in keys:
        slim = slim.filter(F.col(k).isNotNull())
    return slim.groupBy(*keys).agg(F.max("_row").alias("_row")).select(*keys, F.col("_row.p").alias("payload"))


def neighbours(snapshots: DataFrame, span: int = 30 * 86400) -> DataFrame:
    """Previous and next snapshot of each one within its source.

    Input columns ``snapshot_id, source_key, at`` (one row per snapshot); output
    ``snapshot_id, prev_id, next_id``. Ties in ``at`` are ordered by id. Work is
    split by stretches of ``span`` seconds and the stretches' ends are linked
    afterwards, so a source with a third of all snapshots isn't one task.
    """
    s = snapshots.withColumn("stretch", F.floor(F.col("at") / span))
    inner = Window.partitionBy("source_key", "stretch").orderBy("at", "snapshot_id")
    s = s.withColumn("p", F.lag("snapshot_id").over(inner)).withColumn("n", F.lead("snapshot_id").over(inner))
    place = F.struct("at", "snapshot_id")
    outer = Window.partitionBy("source_key").orderBy("stretch")
    ends = (
        s.groupBy("source_key", "stretch")
        .agg(F.min(place).alias("first"), F.max(place).alias("last"))
        .select("source_key", "stretch", F.lag("last.snapshot_id").over(outer).alias("before"), F.lead("first.snapshot_id").over(outer).alias("after"))
    )
    return s.join(ends, ["source_key", "stretch"]).select("snapshot_id", F.coalesce("p", "before").alias("prev_id"), F.coalesce("n", "after").alias("next_id"))


def snapshot_changes(
    snapshots: DataFrame,
    rows: DataFrame,
    *,
    snapshot_id: str,
    source: str,
    at: str,
    key: str,
    compare: Sequence[str],
    version: str,
) -> DataFrame:
    """Keys added, removed or changed in each snapshot since the one before it.

    ``snapshots`` has a row per full snapshot (``snapshot_id``, path of its
    ``source``, order ``at`` in epoch seconds, ``version``); ``rows`` has the
    snapshots' rows (``snapshot_id``, ``key``, ``compare``, ``version``). Of
    several rows with one id, or one (id, key), the latest ``version`` counts.

    Result: ``snapshot_id``, ``key`` and ``change`` (added, removed, changed).
    Canonical row hashes are full-outer-joined on (snapshot, key): a missing
    side gives additions and removals, unequal hashes give changes; null equals
    the empty string. Snapshots with a null or blank source or a null ``at``,
    and the first of a source, give no cases; one without rows is empty. Rows
    with a null id or key, and rows of unknown snapshots, are ignored; other
    columns are never touched, whatever their names.
    """
    runs = latest_version(snapshots, [snapshot_id], F.col(version), F.struct(normal_path(F.col(source)).alias("source_key"), F.col(at).cast("bigint").alias("at")))
    runs = runs.select(F.col(snapshot_id).alias("snapshot_id"), "payload.source_key", "payload.at").filter("source_key is not null and at is not null")
    links = neighbours(runs).filter("prev_id is not null or next_id is not null")

    items = latest_version(rows.select(F.col(snapshot_id).alias("snapshot_id"), F.col(key).alias("item"), F.col(version).alias("v"), row_hash(compare).alias("h")), ["snapshot_id", "item"], F.col("v"), F.col("h"))
    # a snapshot may hold a large part of all rows: its rows meet its link in several tasks
    part = F.pmod(F.xxhash64("item"), F.lit(PARTS)).cast("int")
    spread = links.withColumn("part", F.explode(F.array(*map(F.lit, range(PARTS)))))
    linked = items.withColumn("part", part).join(spread, ["snapshot_id", "part"]).drop("part")
    now = linked.filter("prev_id is not null").select(F.col("snapshot_id").alias("at_id"), "item", F.col("payload").alias("now_hash"))
    before = linked.filter("next_id is not null").select(F.col("next_id").alias("at_id"), "item", F.col("payload").alias("before_hash"))
    change = F.when(F.col("before_hash").isNull(), "added").when(F.col("now_hash").isNull(), "removed").when(F.col("now_hash") != F.col("before_hash"), "changed")
    return now.join(before, ["at_id", "item"], "full_outer").select(F.col("at_id").alias(snapshot_id), F.col("item").alias(key), change.alias("change")).filter("change is not null")


def change_notes(changes: DataFrame, names: DataFrame, snapshot_id: str, key: str, examples: int = 8) -> DataFrame:
    """A Markdown note per snapshot with changes: how many keys came, went and changed, and the first new ones by key.

    ``changes`` as of ``snapshot_changes``; ``names``: ``snapshot_id, key, name``. Of the
    new keys only the first ``examples`` of a snapshot are gathered.
    """
    counts = changes.groupBy(snapshot_id).agg(*[F.count(F.when(F.col("change") == c, 1)).alias(c) for c in ("added", "removed", "changed")])
    n = F.row_number().over(Window.partitionBy(snapshot_id).orderBy(key))
    first = changes.filter("change = 'added'").select(snapshot_id, key).withColumn("n", n).filter(F.col("n") <= examples).join(names.select(snapshot_id, key, "name"), [snapshot_id, key])
    shown = first.groupBy(snapshot_id).agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "name"))), lambda x: F.concat(F.lit("  - "), x["name"])).alias("shown"))
    head = F.array(F.lit("### Changes since last run"), F.concat(F.lit("- Added: "), "added"), F.concat(F.lit("- Removed: "), "removed"), F.concat(F.lit("- Changed: "), "changed"))
    lines = F.concat(head, F.when(F.col("added") > 0, F.concat(F.array(F.lit("- New (examples):")), F.coalesce("shown", F.array().cast("array<string>")))).otherwise(F.array().cast("array<string>")))
    return counts.join(shown, snapshot_id, "left").select(snapshot_id, F.array_join(lines, "\n").alias("note"))
