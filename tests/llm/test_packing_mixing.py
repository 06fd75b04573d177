import os
from bisect import bisect_left, insort

import numpy as np
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexmill.llm.mixing import draw, shares
from lexmill.llm.packing import nonnegative_fit, pack, pack_documents, patterns
from lexmill.llm.tokens import token_sizes


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 300), max_size=200), st.integers(300, 5000))
def test_every_item_once_and_no_container_too_full(sizes, capacity):
    sizes = np.array(sizes, np.int64)
    bins, left, _ = pack(sizes, capacity)
    assert (bins >= 0).all() and len(bins) == len(sizes)
    fill = np.bincount(bins, sizes, len(left)) if len(sizes) else np.zeros(0)
    assert (fill <= capacity).all() and (capacity - fill == left).all() and (fill > 0).all()


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=60), st.integers(1, 40))
def test_small_capacities(sizes, capacity):
    sizes = np.minimum(np.array(sizes, np.int64), capacity)
    bins, left, _ = pack(sizes, capacity)
    assert (capacity - np.bincount(bins, sizes, len(left)) == left).all() if len(sizes) else not len(left)


def best_fit(sizes, capacity):
    """Containers of best fit alone, longest first."""
    rooms, n, least = [], 0, int(sizes.min())
    for size in sorted(sizes.tolist(), reverse=True):
        at = bisect_left(rooms, size)
        room, n = (rooms.pop(at), n) if at < len(rooms) else (capacity, n + 1)
        if room - size >= least:
            insort(rooms, room - size)
    return n


def test_patterns_place_most_and_waste_no_more_than_best_fit(sf):
    large = f"{os.path.dirname(sf)}/sf0.1/documents.parquet"
    if not os.path.exists(large):
        pytest.skip("needs the larger test table")
    sizes = np.array([len(t) // 4 for t in pq.read_table(large, columns=["text"]).column("text").to_pylist() if t], np.int64)
    for n in (10_000, 65_000):
        many = np.random.default_rng(1).choice(sizes, n)
        for capacity in (256, 1024, 4096, 16384):
            rest = many[many % capacity > 0] % capacity
            bins, left, placed = pack(rest, capacity)
            assert placed.mean() >= 0.8
            assert len(left) <= best_fit(rest, capacity)


def test_all_patterns_of_up_to_three():
    parts = patterns(np.array([2, 3, 5, 7, 10]), 10)
    assert sorted(tuple(sorted(filter(None, p))) for p in parts.tolist()) == [(2, 3, 5), (3, 7), (5, 5), (10,)]
    marked = patterns(np.array([3, 7, 13, 17]), 10, one_long=True)  # 13 and 17 are 3 and 7 with whole cells
    assert sorted(map(tuple, marked.tolist())) == [(7, 3, 0), (13, 7, 0), (17, 3, 0)]


def test_nonnegative_fit():
    x = nonnegative_fit(np.array([[1, 0, 0], [2, 0, 0], [2, 1, 0]]), np.array([0.0, 3, 5]), np.ones(3), np.zeros(3), 400)
    uses = np.array([0, x[0] + x[2], x[1] + x[2]])
    assert (x >= 0).all() and np.allclose(uses, [0, 3, 5], atol=1e-2)


def sizes_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, source string, n_tokens bigint")


def test_pieces_of_long_documents_and_edges(spark):
    sizes = sizes_of(spark, [(1, "a", 250), (2, "a", 50), (2, "a", 50), (3, "a", 0), (None, "a", 5), (4, None, 100)])
    kinds = spark.createDataFrame([("c", 100), ("c", 100), ("bad", 0), (None, 5), ("none", None)], "container_name string, capacity_tokens int")
    rows = {(r.doc_id, r.piece_no): r for r in pack_documents(sizes, kinds, shard_docs=2).collect()}
    assert set(rows) == {(1, 0), (1, 1), (1, 2), (2, 0), (3, 0), (4, 0)}
    assert rows[1, 2].piece_tokens == 50 and rows[3, 0].container_id is None and rows[3, 0].unused_tokens is None
    assert pack_documents(sizes.limit(0), kinds).count() == 0 and pack_documents(sizes, kinds.limit(0)).count() == 0


def test_shares_and_caps(spark):
    rng = np.random.default_rng(3)
    rows = [(i, ["Big one", "big_ONE", "small"][0 if i < 1500 else 1 if i < 2000 else 2], int(n)) for i, n in enumerate(rng.integers(10, 900, 2100))]
    targets = spark.createDataFrame([("m", "big-one", 0.5, 1), ("m", "small", 0.4, 3), ("m", "nobody", 0.1, 2)], "mix_name string, source string, target_share double, max_repeats int")
    drawn = draw(sizes_of(spark, rows), targets).cache()
    assert drawn.groupBy("mix_name", "doc_id").count().filter("count > 1").count() == 0
    got = {r.source: r for r in shares(drawn, targets).collect()}
    assert abs(got["big-one"].actual_share / got["small"].actual_share - 1.25) < 0.05
    assert got["small"].most_uses == 3 and got["big-one"].most_uses == 1 and got["nobody"].tokens == 0


def test_prefix_sums_agree_with_a_plain_walk(spark):
    rows = [(i, "s", 10 + i % 7) for i in range(500)]
    targets = spark.createDataFrame([("m", "s", 1.0, 5)], "mix_name string, source string, target_share double, max_repeats int")
    total = sum(n for *_, n in rows) * 1.7
    drawn = draw(sizes_of(spark, rows), targets, total_tokens=total)
    uses = drawn.agg(F.sum("n_uses").alias("u"), F.min("n_uses").alias("lo"), F.max("n_uses").alias("hi")).first()
    assert abs(uses.u - 850) <= 1 and (uses.lo, uses.hi) == (1, 2)


def test_mixing_edges(spark):
    targets = spark.createDataFrame([(None, "s", 1.0, 1), ("m", None, 1.0, 1), ("m", "s", None, 1), ("m", "s", 1.0, 0)], "mix_name string, source string, target_share double, max_repeats int")
    docs = sizes_of(spark, [(1, "s", 5), (1, "s", 5), (None, "s", 5), (2, None, 5), (3, " ", 5), (4, "s", 0)])
    assert draw(docs, targets).count() == 0 and draw(docs.limit(0), targets).count() == 0
    one = spark.createDataFrame([("m", "S ", 1.0, 2)], targets.schema)
    assert [(r.doc_id, r.n_uses) for r in draw(docs, one).collect()] == [(1, 2)]


def test_token_sizes(spark):
    docs = spark.createDataFrame([(1, "a", "Hello world", "x"), (2, "a", None, "x"), (3, None, "", "x"), (4, "a", "word " * 100_000, "x")], "doc_id bigint, source string, text string, n_tokens string")
    assert {r.doc_id: r.n_tokens for r in token_sizes(docs).collect()} == {1: 2, 2: 0, 3: 0, 4: 100_001}


def test_spellings_of_one_target_are_added_up(spark):
    targets = spark.createDataFrame([("m", "Big one", 0.25, 3), ("m", "big-one", 0.25, 2), ("m", "small", 0.5, 1)], "mix_name string, source string, target_share double, max_repeats int")
    docs = sizes_of(spark, [(i, "big_one" if i < 100 else "small", 50) for i in range(200)])
    got = {r.source: r for r in shares(draw(docs, targets), targets).collect()}
    assert set(got) == {"big-one", "small"} and abs(got["big-one"].actual_share - 0.5) < 0.01 and got["big-one"].target_share == 0.5 and got["big-one"].longest == 50


def test_shares_are_off_by_less_than_the_longest_document(spark):
    rng = np.random.default_rng(5)
    rows = [(i, f"s{i % 3}", int(n)) for i, n in enumerate(rng.lognormal(5, 1.2, 900).astype(int) + 1)]
    targets = spark.createDataFrame([("m", f"s{k}", w, 4) for k, w in enumerate((0.2, 0.3, 0.5))], "mix_name string, source string, target_share double, max_repeats int")
    for seed in range(3):
        got = shares(draw(sizes_of(spark, rows), targets, seed), targets).collect()
        whole = sum(r.tokens for r in got)
        assert all(abs(r.tokens - r.target_share * whole) <= 2 * max(x.longest for x in got) for r in got)
