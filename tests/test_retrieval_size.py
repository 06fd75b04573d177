"""What retrieval queries exchange: postings and best hits, never every pair of question and document."""

import datetime
from pathlib import Path

import pytest

import __spark_entry__ as entry
from lexmill.operators import lexical as L
from lexmill.session import shared_dir

DOCS = 2000
WORDS = "alpha beta gamma delta"


@pytest.fixture(scope="module")
def common(spark, tmp_path_factory):
    """Tables in which every document shares words with every question."""
    root = str(tmp_path_factory.mktemp("common"))
    day = datetime.datetime(2024, 1, 1)
    rows = [(i, f"{WORDS} page-{i}. " * (1 + i % 3), "mill", "markdown", f"{WORDS} title-{i}", day + datetime.timedelta(i)) for i in range(1, DOCS + 1)]
    spark.createDataFrame(rows, "doc_id bigint, text string, source string, doc_kind string, title string, created_at timestamp_ntz").write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([(i, [float(i), 1.0]) for i in range(1, 201)], "vec_id bigint, embedding array<float>").write.parquet(f"{root}/embeddings.parquet")
    return root


def exchanged(spark, run) -> int:
    """Rows that ``run`` writes for exchanges."""

    def written():
        sc = spark.sparkContext
        sc._jsc.sc().listenerBus().waitUntilEmpty()
        stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
        return {(s.stageId(), s.attemptId()): s.shuffleWriteRecords() for s in (stages.apply(n) for n in range(stages.size()))}

    before = written()
    run()
    return sum(n for stage, n in written().items() if stage not in before)


@pytest.mark.parametrize("name", ["answer_contexts", "extracted_answers", "hybrid_scores", "merged_hits", "wiki_first", "fusion_grid", "hybrid_rrf", "index_search"])
def test_pairs_are_not_exchanged(spark, common, name):
    pairs = DOCS * (DOCS // 100)
    assert exchanged(spark, lambda: entry.queries()[name](spark, common).write.format("noop").mode("overwrite").save()) < pairs


@pytest.fixture(scope="module")
def wordy(spark, tmp_path_factory):
    """Tables in which every document holds all twelve words that the questions share."""
    root, words = str(tmp_path_factory.mktemp("wordy")), " ".join(f"word{n}" for n in range(12))
    day = datetime.datetime(2024, 1, 1)
    rows = [(i, f"{words} page-{i}.", "mill", "markdown", f"{words} title-{i}", day + datetime.timedelta(i)) for i in range(1, DOCS + 1)]
    spark.createDataFrame(rows, "doc_id bigint, text string, source string, doc_kind string, title string, created_at timestamp_ntz").write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([(i, [float(i), 1.0]) for i in range(1, 201)], "vec_id bigint, embedding array<float>").write.parquet(f"{root}/embeddings.parquet")
    return root


@pytest.mark.parametrize("name", ["extracted_answers", "hybrid_scores", "merged_hits", "wiki_first", "fusion_grid", "hybrid_rrf", "index_search"])
def test_postings_are_not_exchanged(spark, wordy, name):
    assert exchanged(spark, lambda: entry.queries()[name](spark, wordy).write.format("noop").mode("overwrite").save()) < 12 * DOCS


def on_disk(spark, run) -> int:
    """Bytes that ``run`` writes for exchanges and as tables in the shared folder."""

    def written():
        sc = spark.sparkContext
        sc._jsc.sc().listenerBus().waitUntilEmpty()
        stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
        found = {(s.stageId(), s.attemptId()): s.shuffleWriteBytes() for s in (stages.apply(n) for n in range(stages.size()))}
        return found | {p: p.stat().st_size for p in Path(shared_dir(spark)).rglob("*.parquet") if p.is_file()}

    before = written()
    run()
    return sum(n for what, n in written().items() if what not in before)


@pytest.mark.parametrize("name", ["hybrid_scores", "merged_hits", "wiki_first", "fusion_grid", "hybrid_rrf", "index_search"])
def test_pairs_are_not_written(spark, common, name):
    pairs = DOCS * (DOCS // 100)
    assert on_disk(spark, lambda: entry.queries()[name](spark, common).write.format("noop").mode("overwrite").save()) < 10 * pairs


def test_blocks_and_passes_give_the_same_hits(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"{'alpha ' * (i % 5)} beta {'gamma' if i % 2 else ''}") for i in range(200)] + [(None, "alpha beta")], "id bigint, text string")
    asked = spark.createDataFrame([(1, "alpha gamma"), (2, "gamma alpha"), (3, "beta"), (4, "beta beta alpha"), (5, "none"), (6, None)], "qid bigint, text string")
    rows = lambda: sorted(map(tuple, L.search(L.fit(docs), asked, 7).collect()), key=lambda r: (r[0], r[3]))
    whole = rows()
    assert [r[0] for r in whole] == [q for q in (1, 2, 3, 4) for _ in range(7)]
    assert [r[1] for r in whole if r[0] == 3] == [0, 10, 20, 30, 40, 50, 60]  # equal scores: by id
    monkeypatch.setattr(L, "BLOCK_POSTINGS", 50)
    monkeypatch.setattr(L, "FEW_TERMS", 3)
    assert rows() == whole
