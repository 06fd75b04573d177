"""Registered queries on chunking, answers, record extraction and models."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexmill.functions import answers as A
from lexmill.operators import chunking as C
from lexmill.operators.answers import extract_answers
from lexmill.operators.context import contexts
from lexmill.operators.lexical import fit, search
from lexmill.operators.models import embed_chunks, map_chunks
from lexmill.operators.vectors import nearest
from lexmill.plans.retrieval import BM25_SQL, TOKENS_SQL
from lexmill.session import materialise, table
from lexmill.sources.records import record_rows


def _docs(spark, root):
    return table(spark, root, "documents").filter("text is not null")


def window_chunks(spark, root):
    """Windows of 200 tokens with 50 of overlap."""
    return C.window_chunks(_docs(spark, root), 200, 50).select("doc_id", "chunk_index", F.md5("text").alias("h"))


def packed_lines(spark, root):
    """Groups of whole lines of each document under a budget of 200 tokens."""
    sizes = F.transform(F.split("text", "\n"), lambda x: F.when(F.trim(x) == "", 0).otherwise(F.greatest(F.lit(1), F.floor(F.length(x) / 4))).cast("bigint"))
    return _docs(spark, root).select("doc_id", C.packed_groups(sizes, 200).alias("n_groups"))


def semantic_chunks(spark, root):
    """Chunks of whole segments under 200 tokens with overlap."""
    return C.chunk_documents(_docs(spark, root), 200, 50).select("doc_id", "chunk_index", F.md5("text").alias("h"), F.length("text").alias("n_chars"))


def flash_cards(spark, root):
    """Cards of a model's answer, here the question and answer lines of qa documents as fenced JSON."""
    d = _docs(spark, root).filter("doc_kind = 'qa'")
    pairs = F.regexp_extract_all("text", F.lit(r"(?m)^Q: (.+)\nA: (.+)$"), F.lit(0))
    cards = F.transform(pairs, lambda p: F.struct(F.regexp_extract(p, r"^Q: (.+)", 1).alias("q"), F.regexp_extract(p, r"\nA: (.+)", 1).alias("answer")))
    answer = F.concat(F.lit("Here they are:\n```json\n"), F.to_json(cards), F.lit("\n```"))
    return d.select("doc_id", F.posexplode(A.flash_cards(answer)).alias("n", "c")).select("doc_id", "n", "c.front", "c.back")


def ungrounded_titles(spark, root):
    """Verifiable tokens of titles that the text lacks."""
    d = _docs(spark, root).filter("title is not null")
    return d.select("doc_id", F.explode(A.ungrounded(F.concat_ws(" ", "title", F.date_format(F.col("created_at").cast("timestamp"), "yyyy-MM-dd")), F.col("text"))).alias("token"))


def json_record_rows(spark, root):
    """Records of record documents read as JSON lines."""
    d = _docs(spark, root).filter("doc_kind = 'record'").select(F.concat("doc_id", F.lit(".jsonl")).alias("source_path"), "text")
    return record_rows(d).select("source_path", "place", F.array_join(F.array_sort(F.map_keys("record")), ",").alias("fields"))


def rule_map(spark, root):
    """Findings of the rule-based MAP model for a query over all chunks (L2)."""
    c = table(spark, root, "document_chunks").filter("text is not null").groupBy("chunk_id").agg(F.min(F.struct("source_path", "text")).alias("r")).select("chunk_id", "r.*")
    return map_chunks(c, "broken citations unlabelled tables").groupBy("chunk_id").agg(F.count(F.lit(1)).alias("n_findings"))


def embedded_search(spark, root):
    """Ten nearest documents of every hundredth one by the default embedding."""
    v = embed_chunks(table(spark, root, "documents").select(F.col("doc_id").alias("id"), "text"))
    return nearest(v.filter("id % 100 = 0"), v, 10)


def answer_contexts(spark, root):
    """Contexts chosen for the title of every hundredth document."""
    d = table(spark, root, "documents")
    asked = d.filter("doc_id % 100 = 0").select(F.col("doc_id").alias("qid"), F.col("title").alias("text"))
    hits = search(fit(d.select(F.col("doc_id").alias("id"), "text")), asked, 40)
    full = hits.join(d.select(F.col("doc_id").alias("id"), F.col("source").alias("source_path"), "text"), "id").withColumn("chunk_id", F.col("id").cast("string"))
    return contexts(full.select("qid", "chunk_id", "source_path", "text", "score", "rank"))


def extracted_answers(spark, root):
    """Answers by rule to the title of every hundredth document, with cited sentences, checked against their contexts."""
    d = table(spark, root, "documents")
    chosen = answer_contexts(spark, root).join(d.select(F.col("doc_id").cast("string").alias("chunk_id"), "text"), "chunk_id").select("qid", "n", "text")
    asked = d.filter("doc_id % 100 = 0").select(F.col("doc_id").alias("qid"), F.col("title").alias("text"))
    return extract_answers(asked, materialise(chosen, "contexts")).select("qid", "answer", "refused", F.size("missing").alias("n_missing"))


QUERIES = {f.__name__: f for f in (extracted_answers, window_chunks, packed_lines, semantic_chunks, flash_cards, ungrounded_titles, json_record_rows, rule_map, embedded_search, answer_contexts)}
# the matcher's word borders are ASCII ones, so the border before a compound is spelled out
_COMPOUND = r"(?:^|[^\pL\pN_])([A-Za-z0-9]+(?:[._\-/@][A-Za-z0-9]+)+)"
_DATES = r"\b\d{1,2}[.\-/]\d{1,2}[.\-/]\d{2,4}\b|\b\d{4}-\d{2}-\d{2}\b"
_DAY_FIRST = r"^(\d{1,2})[.\-/](\d{1,2})[.\-/](\d{2,4})$"


def _plain_date(x: str) -> str:
    part = lambda p, i: f"TRY_CAST(regexp_extract({x}, '{p}', {i}) AS INT)"
    iso = r"^(\d{4})-(\d{1,2})-(\d{1,2})$"
    year = part(_DAY_FIRST, 3)
    return f"CASE WHEN regexp_matches({x}, '{iso}') THEN concat_ws('-', {part(iso, 1)}, {part(iso, 2)}, {part(iso, 3)}) WHEN regexp_matches({x}, '{_DAY_FIRST}') THEN concat_ws('-', CASE WHEN {year} < 100 THEN {year} + 2000 ELSE {year} END, {part(_DAY_FIRST, 2)}, {part(_DAY_FIRST, 1)}) END"


_TOKENS = "CASE WHEN trim({0}, ' ') = '' THEN 0 ELSE greatest(1, length({0}) // 4) END"
_LINES = rf"""WITH RECURSIVE l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE text IS NOT NULL),
  u AS (SELECT doc_id, i, {_TOKENS.format('x')} AS n FROM l),
  r AS (SELECT doc_id, i, 1 AS g, CASE WHEN n > 200 THEN 0 ELSE n END AS fill, n > 200 AS alone FROM u WHERE i = 1
    UNION ALL SELECT u.doc_id, u.i, CASE WHEN u.n > 200 OR r.alone OR r.fill + u.n > 200 THEN r.g + 1 ELSE r.g END, CASE WHEN u.n > 200 THEN 0 WHEN r.alone OR r.fill + u.n > 200 THEN u.n ELSE r.fill + u.n END, u.n > 200
    FROM r JOIN u ON u.doc_id = r.doc_id AND u.i = r.i + 1)
  SELECT doc_id, CAST(max(g) AS INT) AS n_groups FROM r GROUP BY 1"""
def chunks_sql(rows: str, overlap: bool) -> str:
    """Chunks under 200 tokens (``w``: doc_id, g, a, x), with one segment and 50 tokens of overlap or none."""
    return rf"""WITH RECURSIVE p AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(regexp_replace(text, '\n(#{{1,6}}\s)', chr(10) || chr(10) || '\1', 'g'), '\n\s*\n'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS ps FROM {rows}),
  part AS (SELECT doc_id, unnest(ps) AS x, generate_subscripts(ps, 1) AS p FROM p), sized AS (SELECT *, {_TOKENS.format('x')} AS n FROM part),
  cut AS (SELECT doc_id, p, string_split(regexp_replace(x, '([.!?])\s+', '\1' || chr(31), 'g'), chr(31)) AS ss FROM sized WHERE n > 200),
  st AS (SELECT doc_id, p, unnest(ss) AS x, generate_subscripts(ss, 1) AS i FROM cut), sn AS (SELECT *, {_TOKENS.format('x')} AS n FROM st),
  r1 AS (SELECT doc_id, p, i, x, 1 AS g, CASE WHEN n > 200 THEN 0 ELSE n END AS fill, n > 200 AS alone FROM sn WHERE i = 1
    UNION ALL SELECT u.doc_id, u.p, u.i, u.x, CASE WHEN u.n > 200 OR r.alone OR r.fill + u.n > 200 THEN r.g + 1 ELSE r.g END, CASE WHEN u.n > 200 THEN 0 WHEN r.alone OR r.fill + u.n > 200 THEN u.n ELSE r.fill + u.n END, u.n > 200
    FROM r1 r JOIN sn u ON u.doc_id = r.doc_id AND u.p = r.p AND u.i = r.i + 1),
  seg AS (SELECT doc_id, p, 0 AS g, x FROM sized WHERE n <= 200 UNION ALL SELECT doc_id, p, g, string_agg(x, ' ' ORDER BY i) FROM r1 GROUP BY 1, 2, 3),
  u AS (SELECT doc_id, x, row_number() OVER (PARTITION BY doc_id ORDER BY p, g) AS i, {_TOKENS.format('x')} AS n FROM seg),
  r2 AS (SELECT doc_id, i, n, 1 AS g, i AS lo, CASE WHEN n > 200 THEN 0 ELSE n END AS fill FROM u WHERE i = 1
    UNION ALL SELECT u.doc_id, u.i, u.n, CASE WHEN u.n > 200 OR r.n > 200 OR r.fill + u.n > 200 THEN r.g + 1 ELSE r.g END, CASE WHEN u.n > 200 OR r.n > 200 THEN u.i WHEN r.fill + u.n > 200 THEN {'r.i' if overlap else 'u.i'} ELSE r.lo END,
      CASE WHEN u.n > 200 THEN 0 WHEN r.n > 200 THEN u.n WHEN r.fill + u.n > 200 THEN {'r.n + u.n' if overlap else 'u.n'} ELSE r.fill + u.n END FROM r2 r JOIN u ON u.doc_id = r.doc_id AND u.i = r.i + 1),
  b AS (SELECT doc_id, g, min(lo) AS lo, max(i) AS hi FROM r2 GROUP BY 1, 2), l AS (SELECT doc_id, list(x ORDER BY i) AS xs FROM u GROUP BY 1),
  c AS (SELECT doc_id, g, lo = hi AS single, array_to_string(list_slice(xs, lo, hi), chr(10) || chr(10)) AS x FROM b JOIN l USING (doc_id)),
  w AS (SELECT doc_id, g, x, 0 AS a FROM c WHERE NOT (single AND length(x) // 4 > 200) UNION ALL SELECT doc_id, g, substring(x, a + 1, 800), a FROM (SELECT doc_id, g, x, unnest(range(0, greatest(0, length(x) - {200 if overlap else 0} - 1) + 1, {600 if overlap else 800})) AS a FROM c WHERE single AND length(x) // 4 > 200))"""


_CHUNKS = chunks_sql("documents WHERE text IS NOT NULL", True) + " SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY g, a) - 1 AS INT) AS chunk_index, md5(x) AS h, length(x) AS n_chars FROM w"
_HEADERS = r"'^\s*\[(FILE_PATH|FILE_PART|CHUNK_INDEX|FILE_TITLE|FILE_LABELS|FILE_FORMAT|SOURCE_URL|SOURCE_TITLE|VISION_FILE|Файл)\b'"
_CONTEXTS = BM25_SQL + rf""", t AS (SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM bm WHERE score > 0 QUALIFY rank <= 40),
  h AS (SELECT qid, CAST(id AS VARCHAR) AS chunk_id, coalesce(source, '') AS source_path, score, rank, left(coalesce(text, ''), 6000) AS x FROM t JOIN documents ON doc_id = id),
  k AS (SELECT * EXCLUDE (x), {_TOKENS.format('x')} AS tokens, left(lower(trim(regexp_replace(array_to_string(list_filter(string_split(x, chr(10)), lambda y: NOT regexp_matches(y, {_HEADERS})), chr(10)), '\s+', ' ', 'g'), ' ')), 240) AS key FROM h),
  d AS (SELECT * FROM k WHERE key <> '' QUALIFY row_number() OVER (PARTITION BY qid, key ORDER BY rank) = 1),
  e AS (SELECT *, row_number() OVER (PARTITION BY qid, source_path ORDER BY rank) > 5 AS held FROM d),
  s AS (SELECT *, sum(tokens) OVER (PARTITION BY qid, held ORDER BY rank) AS total, count(*) OVER (PARTITION BY qid, held ORDER BY rank) AS c FROM e),
  f AS (SELECT *, NOT held AND (total <= 8000 OR c = 1) AND c <= 12 AS fits FROM s),
  o AS (SELECT *, sum(tokens) FILTER (fits) OVER (PARTITION BY qid) AS used, count(*) FILTER (fits) OVER (PARTITION BY qid) AS taken, min(rank) FILTER (NOT held AND NOT fits) OVER (PARTITION BY qid) AS stop FROM f),
  cx AS (SELECT qid, CAST(row_number() OVER (PARTITION BY qid ORDER BY held, rank) AS INT) AS n, chunk_id, source_path, score FROM o
  WHERE fits OR (held AND (stop IS NULL OR rank < stop) AND used + total <= 8000 AND taken + c <= 12))"""
SQL = {
    "json_record_rows": """WITH l AS (SELECT doc_id || '.jsonl' AS source_path, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents WHERE doc_kind = 'record' AND text IS NOT NULL),
      j AS (SELECT source_path, i, CAST(x AS JSON) AS j FROM l WHERE json_valid(x) AND json_type(CAST(x AS JSON)) = 'OBJECT'), k AS (SELECT *, count(*) OVER (PARTITION BY source_path) AS n FROM j)
      SELECT source_path, 'line[' || i || ']' AS place, array_to_string(list_sort(list_filter(json_keys(j), lambda c: json_type(json_extract(j, '$."' || c || '"')) <> 'NULL')), ',') AS fields FROM k WHERE n >= 2""",
    "rule_map": r"""WITH c AS (SELECT chunk_id, min((source_path, text))[2] AS text FROM document_chunks WHERE text IS NOT NULL GROUP BY 1),
      s AS (SELECT chunk_id, unnest(regexp_split_to_array(regexp_replace(text, '([.!?])\s+', '\1' || chr(10), 'g'), '\n')) AS x FROM c)
      SELECT chunk_id, count(*) AS n_findings FROM s WHERE list_has_any(regexp_extract_all(lower(x), '[\pL\pN_]{3,}'), ['broken', 'citations', 'unlabelled', 'tables']) GROUP BY 1""",
    "embedded_search": r"""WITH w AS (SELECT doc_id AS id, unnest(regexp_extract_all(lower(text), '[\pL\pN_]{3,}')) AS w FROM documents WHERE text IS NOT NULL), c AS (SELECT id, w, count(*) AS n, CAST('0x' || left(md5(w), 8) AS BIGINT) AS h FROM w GROUP BY 1, 2),
      d AS (SELECT id, h % 64 AS dim, sum(CASE WHEN (h >> 16) & 1 = 1 THEN n ELSE -n END) AS v FROM c GROUP BY 1, 2), n AS (SELECT id, sqrt(sum(v * v)) AS len FROM d GROUP BY 1), a AS (SELECT doc_id AS id FROM documents WHERE text IS NOT NULL),
      p AS (SELECT q.id AS qid, d.id, sum(q.v * d.v) AS dot FROM d q JOIN d ON d.dim = q.dim AND q.id % 100 = 0 AND q.id <> d.id GROUP BY 1, 2),
      s AS (SELECT q.id AS qid, b.id, round(coalesce(dot / nullif(x.len * y.len, 0), 0), 6) + 0.0 AS score FROM a q JOIN a b ON q.id % 100 = 0 AND q.id <> b.id LEFT JOIN p ON p.qid = q.id AND p.id = b.id LEFT JOIN n x ON x.id = q.id LEFT JOIN n y ON y.id = b.id)
      SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM s QUALIFY rank <= 10""",
    "packed_lines": _LINES,
    "semantic_chunks": _CHUNKS,
    "answer_contexts": _CONTEXTS + " SELECT * FROM cx",
    "extracted_answers": _CONTEXTS + rf""", qs AS (SELECT doc_id AS qid, list_distinct({TOKENS_SQL % 'title'}) AS words FROM documents WHERE doc_id % 100 = 0),
      ps AS (SELECT qid, n, string_split(regexp_replace(array_to_string(list_filter(string_split(coalesce(text, ''), chr(10)), lambda y: NOT regexp_matches(y, {_HEADERS})), chr(10)), '([.!?])\s+|\n', '\1' || chr(31), 'g'), chr(31)) AS l FROM cx JOIN documents ON CAST(doc_id AS VARCHAR) = chunk_id),
      ss AS (SELECT qid, n, generate_subscripts(l, 1) AS pos, trim(unnest(l), ' ') AS s FROM ps), sh AS (SELECT ss.*, len(list_intersect(list_distinct({TOKENS_SQL % 's'}), words)) AS shared FROM ss JOIN qs USING (qid) WHERE s <> ''),
      so AS (SELECT * FROM sh WHERE shared >= 2 QUALIFY row_number() OVER (PARTITION BY qid, s ORDER BY shared DESC, n, pos) = 1), sb AS (SELECT * FROM so QUALIFY row_number() OVER (PARTITION BY qid ORDER BY shared DESC, n, pos) <= 3),
      sa AS (SELECT qid, string_agg(s || ' [' || n || ']', ' ' ORDER BY n, pos, s) AS answer FROM sb GROUP BY 1)
      SELECT qid, coalesce(answer, 'В источниках блокнота нет ответа на этот вопрос.') AS answer, answer IS NULL AS refused, 0 AS n_missing FROM qs LEFT JOIN sa USING (qid)""",
    "window_chunks": """WITH s AS (SELECT doc_id, text, unnest(range(0, greatest(0, length(text) - 200 - 1) + 1, 600)) AS a FROM documents WHERE length(text) > 0)
      SELECT doc_id, CAST(a / 600 AS INT) AS chunk_index, md5(substring(text, a + 1, 800)) AS h FROM s""",
    "flash_cards": """WITH p AS (SELECT doc_id, regexp_extract_all(text, '(?m)^Q: (.+)\\nA: (.+)$') AS l FROM documents WHERE doc_kind = 'qa' AND text IS NOT NULL), u AS (SELECT doc_id, unnest(l) AS p, generate_subscripts(l, 1) - 1 AS n FROM p)
      SELECT doc_id, n, regexp_extract(p, '^Q: (.+)', 1) AS front, regexp_extract(p, '\\nA: (.+)', 1) AS back FROM u""",
    "ungrounded_titles": rf"""WITH d AS (SELECT doc_id, text, regexp_replace(concat_ws(' ', title, strftime(created_at, '%Y-%m-%d')), '\[\d+\]', ' ', 'g') AS a, lower(regexp_replace(replace(text, chr(92), '/'), '\s+', ' ', 'g')) AS hay FROM documents WHERE text IS NOT NULL AND title IS NOT NULL),
      p AS (SELECT doc_id, hay, list_transform(regexp_extract_all(text, '{_DATES}'), lambda x: {_plain_date('x')}) AS dates, list_filter(flatten([regexp_extract_all(a, '(?i)CVE-\d{{4}}-\d+'), regexp_extract_all(a, '@[A-Za-z0-9_]{{3,}}'), regexp_extract_all(a, '{_DATES}'),
        list_filter(regexp_extract_all(a, '{_COMPOUND}', 1), lambda x: regexp_matches(x, '\pL'))]), lambda x: length(x) >= 4) AS l FROM d), q AS (SELECT *, list_transform(l, lambda x: lower(x)) AS lows FROM p),
      t AS (SELECT doc_id, hay, dates, unnest(list_filter(l, lambda x, i: list_position(lows, lower(x)) = i)) AS token FROM q)
      SELECT doc_id, token FROM t WHERE NOT contains(hay, lower(replace(token, chr(92), '/'))) AND NOT coalesce(list_contains(dates, {_plain_date('token')}), false)""",
}
