import random

import pytest

from pyspark.sql import functions as F

from lexmill.llm.ledger import Ledger, canonical_fields, canonical_list, canonical_text, copies_of_first
from lexmill.llm.ledger_queries import finding_records, item_records


def canon(spark, f, texts):
    return [r.c for r in spark.createDataFrame([(t,) for t in texts], "t string").select(f(F.col("t")).alias("c")).collect()]


def test_canonical_text(spark):
    same = ["The  rate\u2009is -3.5, today!", "the\u200b RATE is\t-3.5 (today)", "“The rate” — is -3.5: today", "THE RATE IS -3.5 TODAY"]
    assert len(set(canon(spark, canonical_text, same))) == 1
    different = ["a 3.5", "a 35", "a -3.5", "a -35", "INV-35"]
    assert len(set(canon(spark, canonical_text, different))) == 5
    assert len(set(canon(spark, canonical_text, ["INV-35", "inv 35", "INV_35"]))) == 1
    assert canon(spark, canonical_text, [None, "", " .!"]) == ["", "", ""] and len(set(canon(spark, canonical_text, ["Straße", "STRASSE"]))) == 1


def test_lists_and_fields(spark):
    assert len(set(canon(spark, canonical_list, ["A-1, b2", "B2,a 1", "b2,,A1"]))) == 1 and canon(spark, canonical_list, [None, ","]) == ["", ""]
    assert len(set(canon(spark, canonical_fields, ['{"a": 1, "b": "X y"}', '{"b":"x Y.","a":1}']))) == 1
    assert canon(spark, canonical_fields, [None, "", "{}"]) == ["", "", ""] and len(set(canon(spark, canonical_fields, ['{"a": -1}', '{"a": 1}', "not json"]))) == 3


def test_ledger_over_batches_equals_one_count(spark):
    rnd = random.Random(4)
    rows = [("o", "s", f"{rnd.choice(['hot'] * 20 + list('abcdefgh'))}", f"k{i:04d}") for i in range(600)]
    df = spark.createDataFrame(rows, "origin string, scope_id string, canon string, copy_key string").withColumn("canon", F.col("canon").cast("binary"))
    parts = [df.filter(F.col("copy_key") < "k0200"), df.filter(F.col("copy_key").between("k0200", "k0399")), df.filter(F.col("copy_key") > "k0399")]
    ledger = Ledger(spark, bucket_keys=1)
    for p in (parts[2], parts[0], parts[1]):
        ledger.update(p)
        ledger = Ledger(spark, ledger.root, bucket_keys=1)  # another job goes on with it
    assert ledger.version == 3
    want = {}
    for _, _, c, k in rows:
        n, first = want.get(c, (0, k))
        want[c] = (n + 1, min(first, k))
    assert {bytes(r.canon).decode(): (r.copies, r.first_key) for r in ledger.read().collect()} == want
    assert copies_of_first(df, ledger.read()).count() == sum(n - 1 for n, _ in want.values())


def test_buckets_follow_the_keys_and_only_touched_ones_are_rewritten(spark):
    keys = lambda lo, hi: spark.range(lo, hi).select(F.col("id").cast("string").cast("binary").alias("canon"), F.col("id").cast("string").alias("copy_key"))
    ledger = Ledger(spark, bucket_keys=20)
    ledger.update(keys(0, 1000))
    assert ledger.buckets == 64 and len(ledger.folders) == 64 and ledger.keys == 1000
    before = dict(ledger.folders)
    ledger.update(keys(5, 6))
    assert sum(before[b] != f for b, f in ledger.folders.items()) == 1
    ledger.update(keys(1000, 4000))
    ledger.update(keys(0, 1))
    assert ledger.buckets == 256 and ledger.keys == 4000 and ledger.read().filter("copies = 2").count() == 2


def test_a_failed_update_changes_nothing(spark):
    ledger = Ledger(spark)
    one = spark.createDataFrame([(b"a", "k1")], "canon binary, copy_key string")
    ledger.update(one)
    bad = one.withColumn("copy_key", F.raise_error(F.lit("lost")).cast("string"))
    with pytest.raises(Exception, match="lost"):
        ledger.update(bad)
    again = Ledger(spark, ledger.root)
    assert again.version == 1 and [(r.copies, r.first_key) for r in again.read().collect()] == [(1, "k1")]


def test_one_key_holds_a_third_of_all_rows(spark):
    canon = F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise((F.col("id") / 2).cast("long").cast("string")).cast("binary")
    rows = spark.range(30_000).select(F.lit("o").alias("origin"), F.lit("s").alias("scope_id"), canon.alias("canon"), F.format_string("k%06d", "id").alias("copy_key"))
    ledger = Ledger(spark)
    ledger.update(rows)
    found = copies_of_first(rows, ledger.read())
    hot = found.filter("first_key = 'k000000'").count()
    assert hot == 9_999 and found.count() == hot + ledger.read().filter("first_key <> 'k000000'").agg(F.sum(F.col("copies") - 1)).first()[0]


def test_edges(spark):
    assert Ledger(spark).read().count() == 0
    items = spark.createDataFrame([], "run_id string, item_key string, category string, item string, source string, item_level string, entities string, loaded_at timestamp_ntz, canon string, v string")
    assert item_records(items).count() == 0
    row = ("r", "k1", None, "x" * 200_000, None, "", None, None, "clash", "clash")
    two = spark.createDataFrame([row, row, ("r", "k2", "", "X" * 200_000, "", None, "", None, "c", "c"), (None, "k3", *row[2:]), ("r", None, *row[2:])], items.schema)
    records = item_records(two)
    assert records.count() == 2 and records.select("canon").distinct().count() == 1
    ledger = Ledger(spark)
    ledger.update(records.limit(0))
    assert ledger.version == 0 and ledger.read().count() == 0
    ledger.update(records)
    assert [(r.first_key, r.copy_key) for r in copies_of_first(records, ledger.read()).collect()] == [("k1", "k2")]
    f = "findings array<struct<finding_id string, severity string, finding_type string, explanation string, fields_json string>>"
    results = spark.createDataFrame([("j", None), ("j", []), ("j", [None]), (None, [("f", "a", "b", "c", None)])], "job_id string, " + f)
    assert finding_records(results).count() == 0
