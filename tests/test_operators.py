import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexmill.functions import answers as A
from lexmill.operators import chunking as C
from lexmill.operators import lexical as L
from lexmill.operators import models as M
from lexmill.operators.answers import checked, extract_answers
from lexmill.operators.context import contexts
from lexmill.operators.models import HashEmbed, OverlapRerank, RuleMap, embed_chunks, map_chunks
from lexmill.operators.vectors import nearest
from lexmill.streaming.index import CorpusIndex, append_new, follow, removed_sources


def one(spark, text, *columns):
    return spark.createDataFrame([(text,)], "t string").select(*columns).first()


def test_bm25_closed_form(spark):
    docs = [(1, "alpha beta beta"), (2, "alpha cve-2024-1"), (3, "gamma"), (4, None)]
    index = L.fit(spark.createDataFrame(docs, "id bigint, text string"))
    got = L.search(index, spark.createDataFrame([(9, "CVE-2024-1 beta beta unknown")], "qid bigint, text string")).collect()
    avg, n = 6 / 4, 4
    idf = math.log(1 + (n - 1 + 0.5) / 1.5)
    want = {1: 2 * idf * 2 * 2.5 / (2 + 1.5 * (0.25 + 0.75 * 3 / avg)), 2: idf * 2.5 / (1 + 1.5 * (0.25 + 0.75 * 2 / avg))}
    assert {r.id: r.score for r in got} == {k: round(v, 6) for k, v in want.items()}
    assert L.search(L.fit(spark.createDataFrame([], "id bigint, text string")), spark.createDataFrame([(1, "a b")], "qid bigint, text string")).count() == 0


def test_fusion(spark):
    r = lambda rows: spark.createDataFrame(rows, "qid bigint, id bigint, score double, rank int")
    a, b = r([(1, 10, 2.0, 1), (1, 11, 1.0, 2)]), r([(1, 11, -1.0, 1), (1, 12, -2.0, 2)])
    rrf = {x.id: x.score for x in L.reciprocal_rank_fusion([a, b]).collect()}
    assert rrf == {10: round(1 / 61, 9), 11: round(1 / 62 + 1 / 61, 9), 12: round(1 / 62, 9)}
    fused = {x.id: x.score for x in L.score_fusion([a, b]).collect()}
    assert fused == {10: round(1 / 61 + 1, 6), 11: round(1 / 62 + 0.5 + 1 / 61, 6), 12: round(1 / 62, 6)}


def test_nearest_against_brute_force(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(300, 8)).round(1)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(500, None)], "id bigint, vector array<double>").repartition(5)
    got = {}
    for r in nearest(df.filter("id < 20"), df, 5, size=50).collect():
        got.setdefault(r.qid, []).append((r["rank"], r.id))
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    for q in range(20):
        s = np.round(u @ u[q], 6)
        s[q] = -9
        assert [i for _, i in sorted(got[q])] == sorted(range(300), key=lambda i: (-s[i], i))[:5]


def plain_runs(sizes, budget, overlap):
    """Stretches of whole units by a plain walk."""
    out, now = [], []
    for i, n in enumerate(sizes):
        if n > budget:
            out += [now] if now else []
            out.append([i])
            now = []
            continue
        if now and sum(sizes[j] for j in now) + n > budget:
            out.append(now)
            now = now[-1:] if overlap else []
        now.append(i)
    return out + ([now] if now else [])


def test_bounds_equal_a_plain_walk(spark):
    rnd = random.Random(1)
    rows = [([rnd.choice([0, 5, 30, 60, 99, 101, 300]) for _ in range(rnd.randint(0, 30))],) for _ in range(80)] + [([],)]
    for overlap in (False, True):
        got = spark.createDataFrame(rows, "s array<bigint>").select("s", C.bounds(F.col("s"), 100, overlap).alias("b"), C.packed_groups(F.col("s"), 100).alias("g")).collect()
        for r in got:
            assert [list(range(x.lo, x.hi)) for x in r.b] == plain_runs(r.s, 100, overlap)
            assert overlap or r.g == len(r.b)


def test_chunks_hold_all_words_and_keep_to_the_budget(spark):
    rnd = random.Random(2)
    texts = ["".join(rnd.choice("ab .!?\n#") for _ in range(rnd.randint(0, 400))) for _ in range(60)] + ["", " \n ", None, "x" * 5000, "# A\ntext\n## B\nmore"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for budget, overlap in ((5, 0), (20, 0), (20, 4)):
        got = {}
        for r in C.chunk_documents(df, budget, overlap).orderBy("doc_id", "chunk_index").collect():
            got.setdefault(r.doc_id, []).append(r.text)
        for i, t in enumerate(texts):
            chunks = got.get(i, [])
            assert all(chunks) and bool(chunks) == bool(t and t.strip())
            if not overlap:
                assert "".join("".join(chunks).split()) == "".join((t or "").split())
    assert got[len(texts) - 1] == ["# A\ntext\n\n## B\nmore"]


def test_windows_as_expressions(spark):
    t = "".join(chr(97 + i % 26) for i in range(1000))
    got = C.window_chunks(spark.createDataFrame([(1, t), (2, ""), (3, None)], "doc_id bigint, text string"), 50, 10).orderBy("chunk_index").collect()
    assert [r.text for r in got] == [t[a : a + 200] for a in range(0, 960, 160)]


def test_contexts(spark):
    def chosen(hits, **limits):
        rows = [(1, c, s, t, 1.0, i) for i, (c, s, t) in enumerate(hits, 1)]
        got = contexts(spark.createDataFrame(rows, "qid bigint, chunk_id string, source_path string, text string, score double, rank int"), **limits).orderBy("n").collect()
        assert [r.n for r in got] == list(range(1, len(got) + 1))
        return [r.chunk_id for r in got]

    hits = [(str(i), "a" if i < 8 else "b", f"text {i}") for i in range(10)] + [("x", "c", "[FILE_PATH: q]\n TEXT  1"), ("y", "c", " "), ("z", "c", None)]
    assert chosen(hits) == ["0", "1", "2", "3", "4", "8", "9", "5", "6", "7"]
    assert chosen(hits, max_items=6) == ["0", "1", "2", "3", "4", "8"]
    # after a stop by the budget only those held back above it follow
    long = [("a", "s", "x" * 40), ("b", "s", "y" * 40), ("c", "t", "z" * 400), ("d", "u", "w"), ("e", "s", "v")]
    assert chosen(long, max_tokens=50, per_source=1) == ["a", "b"]
    assert chosen([("a", "s", "x" * 4000)], max_tokens=50) == ["a"] and chosen([]) == []


def test_answers(spark):
    t = "<think>plan</think><results>body</results>"
    assert one(spark, t, A.results_body(F.col("t")).alias("r")).r == "body"
    assert one(spark, "x" * 600, A.results_body(F.col("t")).alias("r")).r == "" and one(spark, None, A.results_body(F.col("t")).alias("r")).r == ""
    assert one(spark, "```json\n{\"a\": 1}\n```", A.json_object(F.col("t")).alias("r")).r == '{"a": 1}' and one(spark, "none", A.json_object(F.col("t")).alias("r")).r is None
    r = one(spark, "see db-node-07 and CVE-2024-9 and @annb", A.ungrounded(F.col("t"), F.lit("DB-NODE-07 \n CVE-2024-9")).alias("m"), A.caveat(F.col("t"), A.ungrounded(F.col("t"), F.lit("db-node-07"))).alias("c"))
    assert r.m == ["@annb"] and "Not found in the sources: CVE-2024-9, @annb" in r.c
    assert one(spark, "[3, 1, 9, 1]", A.rerank_order(F.col("t"), F.lit(3)).alias("o")).o == [2, 0]


def test_models(spark):
    chunks = spark.createDataFrame([(1, "c1", "p", "Totals conflict. All fine."), (2, "c2", "p", None)], "id bigint, chunk_id string, source_path string, text string")
    assert [r.explanation for r in map_chunks(chunks, "conflict").collect()] == ["Totals conflict."]
    assert embed_chunks(chunks).count() == 1 and abs(np.linalg.norm(HashEmbed().embed(["some words here"])) - 1) < 1e-9
    assert OverlapRerank().order("a red fox", ["blue", "red fox", "fox"]) == [1, 2, 0] and RuleMap().findings("x", "") == []


def test_incremental_index_and_stream(spark, tmp_path):
    index, docs = str(tmp_path / "index"), tmp_path / "docs"
    docs.mkdir()
    df = lambda rows: spark.createDataFrame(rows, "source_path string, text string, content_hash string")
    append_new(df([("a", "one", "x"), ("b", " one ", "x"), ("c", None, "x")]), index)
    append_new(df([("d", "one", "x"), ("e", "two", "x")]), index)
    assert sorted(r.source_path for r in spark.read.parquet(index).collect()) == ["a", "e"]
    assert [r.source_path for r in removed_sources(spark.read.parquet(index), df([("a", "", "")])).collect()] == ["e"]
    for name, text in (("f.txt", "two"), ("g.txt", "three\nlines")):
        (docs / name).write_text(text)
    for _ in range(2):
        follow(spark, str(docs), index, str(tmp_path / "checkpoint")).awaitTermination(60)
    assert sorted(r.text for r in spark.read.parquet(index).collect()) == ["one", "three\nlines", "two"]


def test_corpus_index_builds_appends_and_rebuilds(spark, tmp_path):
    files = lambda *rows: spark.createDataFrame(list(rows), "source_path string, text string")
    a, b, c = ("a.txt", "The mill ledger names CVE-2024-1 twice.\n\nSecond part."), ("b.txt", "Rivers freeze in winter."), ("c.txt", "The mill ledger names CVE-2024-1 twice.")
    index = CorpusIndex(spark, str(tmp_path / "index"), budget=10, overlap=0)
    assert index.update(files(a)) == ({"chunks": 2, "sources": 1}, False)
    folder = index.current()[0]
    assert index.update(files(a, b)) == ({"chunks": 3, "sources": 2}, True) and index.current()[0] == folder
    assert index.update(files(a, b, c)) == ({"chunks": 3, "sources": 2}, True)  # the same text is no new chunk
    ids = spark.read.parquet(f"{folder}/chunks")
    assert ids.select("id").distinct().count() == ids.count() == 3
    asked = spark.createDataFrame([(0, "tell me about CVE-2024-1 please"), (1, "rivers in winter"), (2, None)], "qid bigint, text string")
    for hybrid in (True, False):
        got = {(r.qid, r["rank"]): r.source_path for r in CorpusIndex(spark, index.root, 10, 0).search(asked, 2, hybrid).collect()}
        assert got[0, 1] == "a.txt" and got[1, 1] == "b.txt"

    def broken(q):
        raise OSError("no server")

    assert {r.source_path for r in index.search(asked, 1, embed=broken).collect()} == {"a.txt", "b.txt"}
    assert index.update(files(a, c))[1] is False and index.stats()["sources"] == 1  # b is gone, so all is built anew
    assert CorpusIndex(spark, index.root, budget=20, overlap=0).update(files(a, c))[1] is False


def test_model_calls_are_tried_again(spark):
    waits, left = [], [2]

    def shaky(x):
        if left[0]:
            left[0] -= 1
            raise OSError("busy")
        return x + 1

    assert M.retrying(shaky, sleep=waits.append)(1) == 2 and len(waits) == 2 and 1 <= waits[0] < waits[1] <= 2.5
    left[0] = 9
    with pytest.raises(OSError):
        M.retrying(shaky, tries=2, sleep=waits.append)(1)

    class Broken:
        def score(self, query, text):
            raise ValueError

    chunks = spark.createDataFrame([("a", "red fox"), ("b", None)], "chunk_id string, text string")
    assert {r.chunk_id: r.score for r in M.scout_chunks(chunks, "a red hen").collect()} == {"a": 0.5, "b": 0.0}
    with pytest.raises(ValueError):
        M.retrying(Broken().score, 1)("q", "t")


def test_expansions(spark):
    asked = spark.createDataFrame([(1, "Who broke db-node-07 yesterday?"), (2, None)], "qid bigint, text string")
    got = {}
    for r in M.expand_questions(asked).orderBy("qid", "n").collect():
        got.setdefault(r.qid, []).append(r.text)
    assert got == {1: ["Who broke db-node-07 yesterday?", "db-node-07", "yesterday"], 2: [""]}


def test_answers_by_rule(spark):
    asked = spark.createDataFrame([(1, "river mill figures"), (2, "nothing here")], "qid bigint, text string")
    found = spark.createDataFrame([(1, 1, "The river mill stands. Figures of the mill and river rose."), (1, 2, "[FILE_PATH: x]\nOther words."), (2, 1, None)], "qid bigint, n int, text string")
    got = {r.qid: r for r in extract_answers(asked, found).collect()}
    assert got[1].answer == "The river mill stands. [1] Figures of the mill and river rose. [1]" and not got[1].refused
    assert got[2].refused and got[2].missing == []
    other = spark.createDataFrame([(1, "Seen at db-node-07 [1]", False)], "qid bigint, answer string, refused boolean")
    assert checked(other, found).first().missing == ["db-node-07"]
