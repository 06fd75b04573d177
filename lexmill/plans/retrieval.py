"""Registered queries on retrieval: lexical, vector and fused search, neighbours and citations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lexmill.functions.text import TOKEN, tokenize
from lexmill.operators import lexical as L
from lexmill.operators import query_plan as Q
from lexmill.operators.context import batch_units
from lexmill.operators.vectors import nearest
from lexmill.session import materialise, table


def _docs(spark, root):
    return table(spark, root, "documents").select(F.col("doc_id").alias("id"), "text")


def _asked(spark, root):
    """The query set: titles of every hundredth document."""
    return table(spark, root, "documents").filter("doc_id % 100 = 0").select(F.col("doc_id").alias("qid"), F.col("title").alias("text"))


def _lexical(spark, root, k):
    return L.search(L.fit(_docs(spark, root)), _asked(spark, root), k)


def _vectors(spark, root, k):
    v = table(spark, root, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return nearest(v.filter("id % 100 = 0"), v, k)


def _arms(spark, root, k=50):
    return [materialise(r, "ranking") for r in (_lexical(spark, root, k), _vectors(spark, root, k))]


def bm25_terms(spark, root):
    """Document frequency of each term."""
    docs = table(spark, root, "documents")
    return docs.select(F.explode(F.array_distinct(tokenize(F.col("text")))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def bm25_search(spark, root):
    """Ten best documents for the title of every hundredth one."""
    return _lexical(spark, root, 10)


def vector_search(spark, root):
    """Ten nearest vectors of every hundredth one."""
    return _vectors(spark, root, 10)


def index_search(spark, root):
    """Ten best documents from an index built in two deliveries, by time."""
    docs = table(spark, root, "documents").select(F.col("doc_id").alias("id"), "text", F.unix_micros(F.col("created_at").cast("timestamp")).alias("t"))
    middle = docs.agg(((F.min("t") + F.max("t")) / 2).alias("m")).first().m or 0.0
    early = F.coalesce(F.col("t") <= middle, F.lit(True))
    return L.search(L.fit(docs.filter(early)).append(docs.filter(~early)), _asked(spark, root), 10)


def hybrid_rrf(spark, root):
    """Reciprocal rank fusion of lexical and vector rankings of fifty."""
    return L.top(L.reciprocal_rank_fusion(_arms(spark, root)), 10)


def hybrid_scores(spark, root):
    """Score-aware fusion of lexical and vector rankings of fifty, tail below 0.15 of the best cut."""
    return L.cut_tail(L.top(L.score_fusion(_arms(spark, root)), 10), 0.15)


def fusion_grid(spark, root):
    """Fused rankings for three settings of rank constant, score weight and candidates."""
    return L.fusion_sweep(_arms(spark, root), [(60, 1.0, 50), (60, 0.0, 50), (20, 0.5, 20)], 10)


def merged_hits(spark, root):
    """Hits of two searches for each question, by its title and by the exact entities in it, merged and reranked by shared words."""
    index, asked = L.fit(_docs(spark, root)), _asked(spark, root)
    exact = asked.select("qid", Q.lexical_query(F.col("text")).alias("text"))
    hits = materialise(L.merge_hits([L.search(index, asked, 60), L.search(index, exact, 60)], 60), "merged")
    words = asked.select("qid", F.array_distinct(tokenize(F.col("text"))).alias("asked"))
    shared = hits.join(words, "qid").join(_docs(spark, root), "id").select("qid", "id", "rank", F.size(F.array_intersect("asked", tokenize(F.col("text")))).alias("n"))
    order = shared.filter("n >= 2").withColumn("place", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("n"), "rank")))
    return L.apply_rerank(hits, order, 28)


def wiki_first(spark, root):
    """Three hits among pages in Markdown before eight of all documents."""
    docs = table(spark, root, "documents")
    pages = docs.filter("doc_kind = 'markdown'").select(F.col("doc_id").alias("id"), "text")
    return L.first_seen(L.search(L.fit(pages), _asked(spark, root), 3), L.search(L.fit(_docs(spark, root)), _asked(spark, root), 8))


def gathered_units(spark, root):
    """Chunks of each file that name the archive with the ones beside them, in batches of 300 tokens."""
    chunks = table(spark, root, "document_chunks").filter("source_path is not null and chunk_index is not null").groupBy("source_path", "chunk_index").agg(F.min(F.struct("chunk_id", "text")).alias("c")).select("source_path", "chunk_index", "c.*")
    chunks = materialise(chunks, "chunks")
    found = chunks.filter("lower(text) like '%archive%'").select(F.col("source_path").alias("qid"), "chunk_id", F.lit(1.0).alias("score"), (F.col("chunk_index") + 1).alias("rank"))
    units = L.with_neighbours(found, chunks, 1, 200).join(chunks.select("chunk_id", "text"), "chunk_id").select("qid", "n", "chunk_id", "is_neighbour", "text")
    return batch_units(units, 300).select(F.col("qid").alias("source_path"), "n", "chunk_id", "is_neighbour", "batch")


def chunk_neighbours(spark, root):
    """Chunks next to every hundredth chunk of a file, with their distance."""
    chunks = table(spark, root, "document_chunks").filter("source_path is not null and chunk_index is not null").groupBy("source_path", "chunk_index").agg(F.min("chunk_id").alias("chunk_id"))
    hits = chunks.filter("chunk_index % 100 = 0").select("source_path", F.col("chunk_id").alias("hit_id"), F.col("chunk_index").alias("at"), F.explode(F.array(F.lit(-1), F.lit(1))).alias("step"))
    near = hits.withColumn("chunk_index", F.col("at") + F.col("step"))
    return near.join(chunks, ["source_path", "chunk_index"]).select("hit_id", "chunk_id", "step")


def retrieval_metrics(spark, root):
    """Precision, recall, reciprocal rank and nDCG at 10 of vector search against equal labels."""
    v = table(spark, root, "embeddings").select(F.col("vec_id").alias("id"), "label")
    gold = v.groupBy("label").agg((F.count(F.lit(1)) - 1).alias("n_gold"))
    ranked = _vectors(spark, root, 10).join(v.select(F.col("id").alias("qid"), F.col("label").alias("want")), "qid").join(v, "id").withColumn("hit", (F.col("label") == F.col("want")).cast("int"))
    gain = F.sum(F.col("hit") / F.log2(F.col("rank") + 1))
    per = ranked.groupBy("qid", "want").agg(F.sum("hit").alias("hits"), F.min(F.when(F.col("hit") == 1, F.col("rank"))).alias("first"), gain.alias("dcg")).join(gold, F.col("want") == F.col("label")).filter("n_gold > 0")
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("n_gold", F.lit(10)).cast("int")), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + F.lit(1)))
    return per.agg(F.count(F.lit(1)).alias("n_queries"), F.round(F.avg(F.col("hits") / 10), 6).alias("precision"), F.round(F.avg(F.col("hits") / F.col("n_gold")), 6).alias("recall"), F.round(F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))), 6).alias("rr"), F.round(F.avg(F.col("dcg") / ideal), 6).alias("ndcg"))


def answer_citations(spark, root):
    """Citation numbers of each answer in order of first use."""
    docs = table(spark, root, "documents").filter("doc_kind = 'qa' and text is not null")
    marks = F.array_distinct(F.regexp_extract_all("text", F.lit(r"\[(\d+)\]"), F.lit(1)))
    return docs.select("doc_id", F.posexplode(marks).alias("pos", "n")).select("doc_id", (F.col("pos") + 1).alias("place"), F.col("n").cast("int").alias("n"))


_STOP = "('the','and','for','with','from','this','that','по','на','из','при','или','как','это','для')"
TOKENS_SQL = f"list_filter(regexp_extract_all(lower(coalesce(%s, '')), '{TOKEN}'), lambda t: length(t) >= 2 AND t NOT IN {_STOP})"
BM25_SQL = f"""WITH tok AS (SELECT doc_id AS id, {TOKENS_SQL % 'text'} AS ts FROM documents), n AS (SELECT count(*) AS n, greatest(sum(len(ts)) / count(*), 1e-9) AS avgdl FROM tok),
post AS (SELECT id, term, dl, count(*) AS tf FROM (SELECT id, unnest(ts) AS term, len(ts) AS dl FROM tok) GROUP BY 1, 2, 3), df AS (SELECT term, count(*) AS df FROM post GROUP BY 1),
q AS (SELECT qid, term, count(*) AS qtf FROM (SELECT doc_id AS qid, unnest({TOKENS_SQL % 'title'}) AS term FROM documents WHERE doc_id % 100 = 0) GROUP BY 1, 2),
bm AS (SELECT qid, id, round(sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM q JOIN df USING (term) JOIN post USING (term), n GROUP BY 1, 2)"""
_VEC = """e AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE embedding IS NOT NULL),
vs AS (SELECT q.id AS qid, c.id, round(list_cosine_similarity(q.v, c.v), 6) AS score FROM e q JOIN e c ON q.id % 100 = 0 AND q.id <> c.id)"""


def _top(name, k):
    return f"(SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM {name} QUALIFY rank <= {k})"


_BOTH = BM25_SQL + ", " + _VEC + f", a AS {_top('bm', 50)}, b AS {_top('vs', 50)}"
_FUSED = _BOTH + f""", p AS (SELECT qid, id, 1 / (60 + rank) + score / max(score) OVER (PARTITION BY qid) AS part FROM a
  UNION ALL SELECT qid, id, 1 / (60 + rank) + CASE WHEN max(score) OVER (PARTITION BY qid) > 0 THEN score / max(score) OVER (PARTITION BY qid) ELSE 0 END FROM b),
  f AS (SELECT qid, id, round(sum(part), 6) AS score FROM p GROUP BY 1, 2), t AS {_top('f', 10)}"""

QUERIES = {f.__name__: f for f in (bm25_terms, bm25_search, index_search, vector_search, hybrid_rrf, hybrid_scores, fusion_grid, merged_hits, wiki_first, gathered_units, chunk_neighbours, retrieval_metrics, answer_citations)}
SQL = {
    "bm25_terms": f"SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct({TOKENS_SQL % 'text'})) AS term FROM documents) GROUP BY 1",
    "bm25_search": BM25_SQL + f" SELECT * FROM {_top('(SELECT * FROM bm WHERE score > 0)', 10)}",
    "vector_search": "WITH " + _VEC + f" SELECT * FROM {_top('vs', 10)}",
    "hybrid_rrf": _BOTH + f", f AS (SELECT qid, id, round(sum(1 / (60 + rank)), 9) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY 1, 2) SELECT * FROM {_top('f', 10)}",
    "index_search": BM25_SQL + f" SELECT * FROM {_top('(SELECT * FROM bm WHERE score > 0)', 10)}",
    "fusion_grid": _BOTH + """, g(k, weight, candidates) AS (VALUES (60, 1.0, 50), (60, 0.0, 50), (20, 0.5, 20)),
      p AS (SELECT qid, id, rank, score, max(score) OVER (PARTITION BY qid) AS best FROM a UNION ALL SELECT qid, id, rank, score, max(score) OVER (PARTITION BY qid) FROM b),
      f AS (SELECT k, CAST(weight AS DOUBLE) AS weight, candidates, qid, id, round(sum(1 / (k + rank) + CASE WHEN best > 0 THEN CAST(weight AS DOUBLE) * score / best ELSE 0 END), 6) AS score FROM p JOIN g ON rank <= candidates GROUP BY 1, 2, 3, 4, 5)
      SELECT *, row_number() OVER (PARTITION BY k, weight, candidates, qid ORDER BY score DESC, id) AS rank FROM f QUALIFY rank <= 10""",
    "merged_hits": BM25_SQL.replace("q AS (", f"x AS (SELECT doc_id, title, list_transform(regexp_extract_all(coalesce(title, ''), '{Q.EXACT}'), lambda e: regexp_replace(e, '^[\"«»]+|[\"«»]+$', '', 'g')) AS ex FROM documents WHERE doc_id % 100 = 0), q AS (") + f""",
      q2 AS (SELECT qid, term, count(*) AS qtf FROM (SELECT doc_id AS qid, unnest({TOKENS_SQL % "CASE WHEN len(ex) > 0 THEN array_to_string(ex, ' ') ELSE title END"}) AS term FROM x) GROUP BY 1, 2),
      bm2 AS (SELECT qid, id, round(sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM q2 JOIN df USING (term) JOIN post USING (term), n GROUP BY 1, 2),
      h AS (SELECT * FROM {_top('(SELECT * FROM bm WHERE score > 0)', 60)} UNION ALL SELECT * FROM {_top('(SELECT * FROM bm2 WHERE score > 0)', 60)}),
      m AS (SELECT qid, id, max(score) AS score FROM h GROUP BY 1, 2), t AS {_top('m', 60)},
      s AS (SELECT t.*, len(list_intersect(list_distinct({TOKENS_SQL % 'q.title'}), {TOKENS_SQL % 'd.text'})) AS shared FROM t JOIN documents q ON q.doc_id = qid JOIN documents d ON d.doc_id = id),
      o AS (SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY shared < 2, CASE WHEN shared >= 2 THEN -shared END, rank, id) AS rank FROM s) SELECT * FROM o WHERE rank <= 28""",
    "wiki_first": BM25_SQL + f""", wtok AS (SELECT tok.* FROM tok JOIN documents ON doc_id = id WHERE doc_kind = 'markdown'), wn AS (SELECT count(*) AS n, greatest(sum(len(ts)) / count(*), 1e-9) AS avgdl FROM wtok),
      wpost AS (SELECT post.* FROM post JOIN documents ON doc_id = id WHERE doc_kind = 'markdown'), wdf AS (SELECT term, count(*) AS df FROM wpost GROUP BY 1),
      wbm AS (SELECT qid, id, round(sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM q JOIN wdf USING (term) JOIN wpost USING (term), wn GROUP BY 1, 2),
      u AS (SELECT 0 AS arm, * FROM {_top('(SELECT * FROM wbm WHERE score > 0)', 3)} UNION ALL SELECT 1, * FROM {_top('(SELECT * FROM bm WHERE score > 0)', 8)}),
      f AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY qid, id ORDER BY arm, rank) = 1) SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY arm, rank, id) AS rank FROM f""",
    "gathered_units": """WITH RECURSIVE c AS (SELECT source_path, chunk_index, min((chunk_id, text)) AS c FROM document_chunks WHERE source_path IS NOT NULL AND chunk_index IS NOT NULL GROUP BY 1, 2), k AS (SELECT source_path, chunk_index, c[1] AS chunk_id, c[2] AS text FROM c),
      h AS (SELECT source_path AS qid, source_path, chunk_id, chunk_index, chunk_index + 1 AS rank FROM k WHERE lower(text) LIKE '%archive%'),
      u AS (SELECT qid, chunk_id, rank, 0 AS step_no, false AS is_neighbour FROM h UNION ALL SELECT qid, k.chunk_id, rank, CASE WHEN k.chunk_index < h.chunk_index THEN 1 ELSE 2 END, true FROM h JOIN k ON k.source_path = h.source_path AND abs(k.chunk_index - h.chunk_index) = 1),
      f AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY qid, chunk_id ORDER BY rank, step_no) = 1), n AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rank, step_no, chunk_id) AS n FROM f),
      s AS (SELECT qid, n, n.chunk_id, is_neighbour, CASE WHEN trim(coalesce(text, ''), ' ') = '' THEN 0 ELSE greatest(1, length(text) // 4) END AS t FROM n JOIN k USING (chunk_id) WHERE n <= 200),
      r AS (SELECT *, 1 AS batch, CASE WHEN t > 300 THEN 0 ELSE t END AS fill, t > 300 AS alone FROM s WHERE n = 1
        UNION ALL SELECT s.*, CASE WHEN s.t > 300 OR r.alone OR r.fill + s.t > 300 THEN r.batch + 1 ELSE r.batch END, CASE WHEN s.t > 300 THEN 0 WHEN r.alone OR r.fill + s.t > 300 THEN s.t ELSE r.fill + s.t END, s.t > 300 FROM r JOIN s ON s.qid = r.qid AND s.n = r.n + 1)
      SELECT qid AS source_path, n, chunk_id, is_neighbour, batch FROM r""",
    "hybrid_scores": _FUSED + " SELECT t.* FROM t JOIN (SELECT qid, score AS best FROM t WHERE rank = 1) USING (qid) WHERE score >= 0.15 * best",
    "chunk_neighbours": """WITH c AS (SELECT source_path, chunk_index, min(chunk_id) AS chunk_id FROM document_chunks WHERE source_path IS NOT NULL AND chunk_index IS NOT NULL GROUP BY 1, 2)
      SELECT h.chunk_id AS hit_id, n.chunk_id, n.chunk_index - h.chunk_index AS step FROM c h JOIN c n ON h.source_path = n.source_path AND n.chunk_index IN (h.chunk_index - 1, h.chunk_index + 1) WHERE h.chunk_index % 100 = 0""",
    "retrieval_metrics": "WITH " + _VEC + f""", t AS {_top('vs', 10)}, g AS (SELECT label, count(*) - 1 AS n_gold FROM embeddings GROUP BY 1),
      r AS (SELECT qid, rank, q.label AS want, CAST(c.label = q.label AS INT) AS hit FROM t JOIN embeddings q ON q.vec_id = qid JOIN embeddings c ON c.vec_id = id),
      p AS (SELECT qid, want, sum(hit) AS hits, min(rank) FILTER (hit = 1) AS first, sum(hit / log2(rank + 1)) AS dcg FROM r GROUP BY 1, 2)
      SELECT count(*) AS n_queries, round(avg(hits / 10), 6) AS precision, round(avg(hits / n_gold), 6) AS recall, round(avg(coalesce(1 / first, 0)), 6) AS rr,
        round(avg(dcg / list_sum(list_transform(range(1, least(n_gold, 10) + 1), lambda i: 1 / log2(i + 1)))), 6) AS ndcg FROM p JOIN g ON g.label = want WHERE n_gold > 0""",
    "answer_citations": """WITH m AS (SELECT doc_id, regexp_extract_all(text, '\\[(\\d+)\\]', 1) AS l FROM documents WHERE doc_kind = 'qa' AND text IS NOT NULL),
      u AS (SELECT doc_id, unnest(l) AS n, generate_subscripts(l, 1) AS i FROM m), f AS (SELECT doc_id, n, min(i) AS i FROM u GROUP BY 1, 2)
      SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS place, CAST(n AS INT) AS n FROM f""",
}
