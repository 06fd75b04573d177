"""Registered queries on documents, chunks, runs and pages."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lexmill.functions import text as T
from lexmill.operators import planning as P
from lexmill.operators import query_plan as Q
from lexmill.operators.snapshots import neighbours, normal_path
from lexmill.session import table

TERMS = ["archive", "notes", "report", "отчёт", "index"]


def file_relevance(spark, root):
    """Relevance of each document for a query's terms."""
    d = table(spark, root, "documents")
    return d.select("doc_id", F.round(P.relevance(F.concat_ws("/", "source", "title"), F.col("text"), TERMS), 6).alias("relevance"))


def corpus_manifest(spark, root):
    """Documents and letters by language."""
    d = table(spark, root, "documents")
    return d.groupBy(F.coalesce("lang", F.lit("und")).alias("lang")).agg(F.count(F.lit(1)).alias("n_files"), F.sum(F.length(F.coalesce("text", F.lit("")))).cast("bigint").alias("n_chars"), F.sum(F.octet_length(F.coalesce("text", F.lit("")))).cast("bigint").alias("n_bytes"))


def corpus_plan(spark, root):
    """Dry-run estimates over all documents."""
    return P.plan(table(spark, root, "documents").select(F.octet_length(F.coalesce("text", F.lit(""))).cast("bigint").alias("n_bytes")))


def scout_filter(spark, root):
    """Documents kept by reviewers' quality as a scout score, unknown ones too."""
    labels = table(spark, root, "labels").groupBy("doc_id").agg(F.avg("quality").alias("q"))
    verdicts = labels.select("doc_id", F.round(P.scout_score(F.col("q") / 5, F.col("q") >= 4, F.col("q") <= 1), 6).alias("score"))
    return P.keep_scouted(table(spark, root, "documents").select("doc_id"), verdicts, "doc_id", 0.5)


def chunk_dedup(spark, root):
    """First chunk of each trimmed text."""
    c = table(spark, root, "document_chunks").select("chunk_id", T.content_hash(F.col("text")).alias("content_hash"))
    return c.groupBy("content_hash").agg(F.min("chunk_id").alias("chunk_id"), F.countDistinct("chunk_id").alias("n_chunks"))


def context_dedup(spark, root):
    """First chunk of each text by its first 240 letters without headers and blanks."""
    c = table(spark, root, "document_chunks").filter("text is not null")
    key = F.substring(F.lower(F.trim(F.regexp_replace(T.strip_headers(F.col("text")), r"\s+", " "))), 1, 240)
    return c.groupBy(F.md5(key).alias("k")).agg(F.min("chunk_id").alias("chunk_id"))


def chunk_ids(spark, root):
    """Identity of each chunk by path, place and head."""
    c = table(spark, root, "document_chunks")
    return c.select("chunk_id", T.chunk_id(F.coalesce("source_path", F.lit("")), F.coalesce("chunk_index", F.lit(0)), F.coalesce("text", F.lit(""))).alias("stable_id")).distinct()


def chunk_token_check(spark, root):
    """Chunks whose stored token count is off the estimate by more than half."""
    c = table(spark, root, "document_chunks").select("chunk_id", "tokens", T.count_tokens(F.col("text")).alias("estimate")).distinct()
    return c.filter(F.abs(F.coalesce("tokens", F.lit(0)) - F.col("estimate")) > 0.5 * F.col("estimate"))


def chunk_lines(spark, root):
    """Lines and letters of each chunk and its place by line and page."""
    c = table(spark, root, "document_chunks").filter("text is not null")
    return c.select("chunk_id", (F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).alias("n_lines"), F.coalesce("page", (F.length("text") - F.length(F.replace("text", F.lit("\f"), F.lit(""))) + 1)).alias("page_no"), F.length("text").alias("n_chars")).distinct()


def run_queries(spark, root):
    """Language, first intent and all intents of each run's query."""
    r = table(spark, root, "runs").filter("query_text is not null").select("run_id", "query_text").distinct()
    found = T.intents(F.col("query_text"))
    return r.select("run_id", T.query_language(F.col("query_text")).alias("language"), found[0].alias("intent"), F.array_join(found, ",").alias("all_intents"))


def run_plans(spark, root):
    """Grouping, keys, style, fields and terms planned for each run's query."""
    r = table(spark, root, "runs").filter("query_text is not null").select("run_id", "query_text").distinct().withColumn("p", Q.plan(F.col("query_text")))
    join = lambda c: F.array_join(f"p.{c}", ",").alias(c)
    return r.select("run_id", "p.group_by", "p.axis", join("dedup_keys"), "p.style", join("fields"), F.array_join("p.key_terms", " | ").alias("key_terms"), "p.lexical_query")


def run_entities(spark, root):
    """Entities in run queries by kind."""
    r = table(spark, root, "runs").select("run_id", "query_text").distinct()
    parts = None
    for kind in T.ENTITIES:
        p = r.select("run_id", F.lit(kind).alias("kind"), F.explode(F.array_distinct(T.entity_list(F.col("query_text"), kind))).alias("entity"))
        parts = p if parts is None else parts.unionByName(p)
    return parts


def run_previous(spark, root):
    """Run before each run of the same source."""
    latest = table(spark, root, "runs").filter("run_id is not null").groupBy("run_id").agg(F.max(F.struct("loaded_at", "source_path", "created_at")).alias("r"))
    s = latest.select(F.col("run_id").alias("snapshot_id"), normal_path(F.col("r.source_path")).alias("source_key"), F.col("r.created_at").alias("at")).filter("source_key is not null and at is not null")
    return neighbours(s).select(F.col("snapshot_id").alias("run_id"), F.col("prev_id").alias("previous_run_id"))


def run_list(spark, root):
    """Twenty latest runs with their numbers of items."""
    runs = table(spark, root, "runs").filter("run_id is not null and created_at is not null").groupBy("run_id").agg(F.max("created_at").alias("created_at"))
    n = table(spark, root, "run_items").groupBy("run_id").agg(F.countDistinct("item_key").alias("n_items"))
    last = runs.orderBy(F.desc("created_at"), "run_id").limit(20)
    return last.join(n, "run_id", "left").select("run_id", "created_at", F.coalesce("n_items", F.lit(0)).alias("n_items"))


def job_progress(spark, root):
    """Stored and missing results of each job, and its state."""
    m = table(spark, root, "map_sample").filter("job_id is not null").groupBy("job_id").agg(F.countDistinct("chunk_index").alias("n_stored"), (F.max("chunk_index") + 1).alias("n_total"))
    return m.select("job_id", "n_stored", "n_total", F.when(F.col("n_stored") >= F.col("n_total"), "complete").otherwise("paused").alias("state"))


def item_keys(spark, root):
    """Canonical key of each run item, by entities and source or by category and item."""
    i = table(spark, root, "run_items").filter("run_id is not null and item_key is not null")
    ents = F.array_join(F.array_sort(F.filter(F.transform(F.split(F.coalesce("entities", F.lit("")), ","), lambda e: F.trim(e)), lambda e: e != "")), ",")
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    basis = F.when(ents != "", F.concat(F.lit("ent:"), F.lower(ents), F.lit("|src:"), low("source"))).otherwise(F.concat(F.lit("cat:"), low("category"), F.lit("|item:"), F.lower(F.substring(F.coalesce("item", F.lit("")), 1, 60)), F.lit("|src:"), low("source")))
    return i.select("run_id", F.substring(F.sha2(basis, 256), 1, 20).alias("canonical_key")).groupBy("run_id", "canonical_key").agg(F.count(F.lit(1)).alias("n_rows"))


def new_documents(spark, root):
    """Documents of the later half of time whose text isn't among the earlier ones."""
    d = table(spark, root, "documents").select("doc_id", T.content_hash(F.col("text")).alias("h"), F.unix_micros(F.col("created_at").cast("timestamp")).alias("t"))
    mid = d.agg(((F.min("t") + F.max("t")) / 2).alias("m")).first().m or 0.0
    return d.filter(F.col("t") > mid).join(d.filter(F.col("t") <= mid).select("h"), "h", "left_anti").select("doc_id", "h")


def judge_votes(spark, root):
    """Majority mark, agreement and mean quality of each reviewed document."""
    v = table(spark, root, "labels").filter("toxic is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("yes"), F.round(F.avg("quality"), 2).alias("mean_quality"))
    return v.select("doc_id", (F.col("yes") * 2 > F.col("n")).alias("verdict"), ((F.col("yes") == 0) | (F.col("yes") == F.col("n"))).alias("agree"), "mean_quality")


def chat_messages(spark, root):
    """Messages of chat documents with sender; lines without one belong to the message above."""
    d = table(spark, root, "documents").filter("doc_kind = 'chat' and text is not null")
    lines = d.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "x")).filter("trim(x) <> ''")
    head = r"^(?:\[[^\]]{8,25}\] |\d{1,2}[./]\d{1,2}[./]\d{2,4}, \d{1,2}:\d{2}(?::\d{2})? - )?([^\s:][^:]{0,39}): "
    lines = lines.withColumn("sender", F.when(F.col("x").rlike(head), F.regexp_extract("x", head, 1)))
    upto = Window.partitionBy("doc_id").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    block = lines.withColumn("message", F.count("sender").over(upto)).filter("message > 0")
    return block.groupBy("doc_id", "message").agg(F.max("sender").alias("sender"), F.count(F.lit(1)).cast("bigint").alias("n_lines"))


def plain_markdown(spark, root):
    """Markdown documents as plain text, as hash and length (K8)."""
    d = table(spark, root, "documents").filter("doc_kind = 'markdown' and text is not null")
    p = T.markdown_to_plain(F.col("text"))
    return d.select("doc_id", F.md5(p).alias("h"), F.length(p).alias("n"))


def path_labels(spark, root):
    """Folder labels and file format of each chunk's path."""
    c = table(spark, root, "document_chunks").filter("source_path is not null").select("source_path").distinct()
    return c.select("source_path", F.array_join(T.labels_from_path(F.col("source_path")), "/").alias("labels"), F.upper(F.regexp_extract("source_path", r"\.([A-Za-z0-9]{1,8})$", 1)).alias("format"))


def host_pages(spark, root):
    """Pages and citation hosts."""
    p = table(spark, root, "fetched_pages").select("page_id", F.lower(F.regexp_extract("url", r"^[a-z]+://([^/?#]+)", 1)).alias("host")).distinct()
    return p.groupBy("host").agg(F.count(F.lit(1)).alias("n_pages"))


def table_batches(spark, root):
    """Rows per batch of a table under a token budget, from the mean length of its rows."""
    rows = table(spark, root, "lineitem")
    plain = [F.date_format(c, "yyyy-MM-dd") if t in ("date", "timestamp", "timestamp_ntz") else F.round(F.col(c) * 100).cast("bigint").cast("string") if t in ("double", "float") or t.startswith("decimal") else F.col(c).cast("string") for c, t in rows.dtypes]
    line = F.concat_ws("\t", *plain)
    t = rows.agg(F.count(F.lit(1)).alias("n_rows"), F.sum(F.length(line)).cast("bigint").alias("n_chars"))
    per = F.greatest(F.lit(1), F.floor(6000 / F.greatest(F.lit(1.0), F.col("n_chars") / F.col("n_rows") / 3)))
    return t.select("n_rows", "n_chars", per.cast("bigint").alias("rows_per_batch"), F.ceil(F.col("n_rows") / per).cast("bigint").alias("n_batches"))


def _q(s):
    return s.replace("'", "''")


_SMALL = ", ".join(f"'{w}'" for w in Q.SMALL_WORDS)
_BY = "[ .,]+"
_KINDS = {"email": r"\b[\w.+-]+@[\w-]+\.[\w.-]+\b", "url": r"\bhttps?://[^\s)]+", "ip": r"\b\d{1,3}(?:\.\d{1,3}){3}\b", "id": r"\b[A-Za-z]\w*(?:-\w+){1,5}\b", "number": r"\b\d[\d.,]{2,}\b", "date": r"\b\d{4}-\d{2}-\d{2}\b|\b\d{2}\.\d{2}\.\d{4}\b"}
_ENTS = ", ".join(f"list_slice(list_sort(list_distinct({'list_filter(' if k == 'id' else ''}regexp_extract_all(t, '{p}'){', lambda e: regexp_matches(e, chr(92) || chr(100)))' if k == 'id' else ''})), 1, 20)" for k, p in _KINDS.items())
_CASE = lambda col, table: f"CASE {col} " + " ".join(f"WHEN '{k}' THEN '{v if isinstance(v, str) else ','.join(v)}'" for k, v in table.items()) + " END"
_AXIS = "CASE WHEN by_word IS NULL THEN NULL " + " ".join("WHEN " + " OR ".join(f"contains(lower(by_word), '{w}')" for w in words) + f" THEN '{a}'" for a, words in Q.AXES.items()) + " ELSE 'category' END"
_INTENT = "list_filter([" + ", ".join("CASE WHEN " + " OR ".join(f"contains(low, '{_q(c)}')" for c in cues) + f" THEN '{name}' END" for name, cues in T.INTENTS.items()) + "], lambda x: x IS NOT NULL)"
_HITS = " + ".join(f"CAST(contains(lower(left(coalesce(text, ''), 4096)), '{t}') AS INT)" for t in TERMS)
_NAMED = " + ".join(f"CAST(contains(lower(concat_ws('/', source, title)), '{t}') AS INT)" for t in TERMS)
_PLACE = """place AS (SELECT run_id, made, CASE WHEN starts_with(flat, '/') THEN 'root:' ELSE '' END || list_reduce(list_prepend('', string_split(flat, '/')), lambda acc, x:
  CASE WHEN x IN ('', '.') THEN acc WHEN x = '..' THEN regexp_replace(acc, '/[^/]*$', '') ELSE acc || '/' || x END) AS place
  FROM (SELECT run_id, created_at AS made, replace(trim(source_path), chr(92), '/') AS flat FROM runs WHERE run_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY loaded_at DESC) = 1) WHERE flat <> '' AND made IS NOT NULL)"""
_HEAD = "^(?:\\[[^\\]]{8,25}\\] |\\d{1,2}[./]\\d{1,2}[./]\\d{2,4}, \\d{1,2}:\\d{2}(?::\\d{2})? - )?([^\\s:][^:]{0,39}): "
_MD = "trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(?m)^```.*$', '', 'g'), '!?\\[([^\\]]*)\\]\\([^)]*\\)', '\\1', 'g'), '(?m)^\\s{0,3}#{1,6}\\s+', '', 'g'), '(?m)^\\s*[-*+]\\s+', '• ', 'g'), '(\\*\\*|__|`)', '', 'g'), ' ')"
_PARTS = "list_filter(string_split(replace(source_path, chr(92), '/'), '/'), lambda p: p NOT IN ('', '.') AND NOT regexp_matches(p, '^[A-Za-z]:$'))"

RELEVANCE_SQL = f"SELECT doc_id, CASE WHEN length(coalesce(text, '')) = 0 THEN 0.0 ELSE round(least(1.0, greatest(0.0, 0.25 + 0.15 * ({_NAMED}) + least(0.45, 0.12 * ({_HITS})))), 6) END AS relevance FROM documents"
QUERIES = {f.__name__: f for f in (file_relevance, corpus_manifest, corpus_plan, scout_filter, chunk_dedup, context_dedup, chunk_ids, chunk_token_check, chunk_lines, run_queries, run_plans, run_entities, run_previous, run_list, job_progress, item_keys, new_documents, judge_votes, chat_messages, plain_markdown, path_labels, host_pages, table_batches)}
SQL = {
    "file_relevance": RELEVANCE_SQL,
    "corpus_manifest": "SELECT coalesce(lang, 'und') AS lang, count(*) AS n_files, CAST(sum(length(coalesce(text, ''))) AS BIGINT) AS n_chars, CAST(sum(strlen(coalesce(text, ''))) AS BIGINT) AS n_bytes FROM documents GROUP BY 1",
    "corpus_plan": """WITH f AS (SELECT strlen(coalesce(text, '')) AS n FROM documents), t AS (SELECT count(*) AS n_files, CAST(sum(n) AS BIGINT) AS n_bytes, CAST(sum(ceil(greatest(1, floor(n / 4)) / 6000)) AS BIGINT) AS n_chunks FROM f),
      u AS (SELECT *, ceil(n_chunks * (1 - (1 - 0.45) * 0.65)) AS n_after_scout FROM t) SELECT *, ceil(n_after_scout * 8 / 4) + n_chunks * 2 AS seconds, CASE WHEN n_chunks > 50000 THEN 'many chunks' WHEN n_bytes > 2000000000 THEN 'large input' ELSE '' END AS warning FROM u""",
    "scout_filter": """WITH l AS (SELECT doc_id, avg(quality) AS q FROM labels GROUP BY 1), v AS (SELECT doc_id, CASE WHEN q <= 1 THEN 0 ELSE round(least(1, greatest(0, CASE WHEN q >= 4 THEN greatest(coalesce(q / 5, 0), 0.45) ELSE coalesce(q / 5, 0) END)), 6) END AS score FROM l)
      SELECT d.doc_id, score FROM documents d LEFT JOIN v USING (doc_id) WHERE score IS NULL OR score >= 0.5""",
    "chunk_dedup": "SELECT sha256(trim(coalesce(text, ''), ' ')) AS content_hash, min(chunk_id) AS chunk_id, count(DISTINCT chunk_id) AS n_chunks FROM document_chunks GROUP BY 1",
    "context_dedup": f"""SELECT md5(left(lower(trim(regexp_replace(array_to_string(list_filter(string_split(text, chr(10)), lambda x: NOT regexp_matches(x, '{T.HEADER_LINE}')), chr(10)), '\\s+', ' ', 'g'), ' ')), 240)) AS k, min(chunk_id) AS chunk_id FROM document_chunks WHERE text IS NOT NULL GROUP BY 1""",
    "chunk_ids": "SELECT DISTINCT chunk_id, left(sha256(coalesce(source_path, '') || ':' || coalesce(chunk_index, 0) || ':' || left(coalesce(text, ''), 200)), 24) AS stable_id FROM document_chunks",
    "chunk_token_check": """WITH c AS (SELECT DISTINCT chunk_id, tokens, CAST(CASE WHEN trim(coalesce(text, ''), ' ') = '' THEN 0 ELSE greatest(1, floor(length(text) / 4)) END AS INT) AS estimate FROM document_chunks)
      SELECT * FROM c WHERE abs(coalesce(tokens, 0) - estimate) > 0.5 * estimate""",
    "chunk_lines": "SELECT DISTINCT chunk_id, length(text) - length(replace(text, chr(10), '')) + 1 AS n_lines, coalesce(page, length(text) - length(replace(text, chr(12), '')) + 1) AS page_no, length(text) AS n_chars FROM document_chunks WHERE text IS NOT NULL",
    "run_queries": f"""WITH r AS (SELECT DISTINCT run_id, query_text, lower(query_text) AS low FROM runs WHERE query_text IS NOT NULL), i AS (SELECT *, {_INTENT} AS f FROM r)
      SELECT run_id, CASE WHEN regexp_matches(query_text, '[А-Яа-яЁё]') THEN 'ru' ELSE 'en' END AS language, coalesce(f[1], 'analyze') AS intent, CASE WHEN len(f) = 0 THEN 'analyze' ELSE array_to_string(f, ',') END AS all_intents FROM i""",
    "run_plans": rf"""WITH r AS (SELECT DISTINCT run_id, query_text AS t, lower(query_text) AS low FROM runs WHERE query_text IS NOT NULL),
      w AS (SELECT *, coalesce({_INTENT}[1], 'analyze') AS intent, regexp_replace(regexp_extract(t, '(?i){Q.GROUP_BY}', 1), '^[ .,]+|[ .,]+$', '', 'g') AS word FROM r),
      g AS (SELECT *, CASE WHEN length(word) >= 3 AND lower(word) NOT IN ({_SMALL}) THEN word END AS by_word FROM w), a AS (SELECT *, {_AXIS} AS axis FROM g),
      p AS (SELECT *, list_filter(flatten([list_transform(regexp_extract_all(t, '{_q(Q.QUOTED)}', 1), lambda x: regexp_replace(x, '^[\s\pZ]+|[\s\pZ]+$', '', 'g')), {_ENTS},
        list_filter(list_transform(regexp_extract_all(t, '[A-Za-zА-Яа-яЁё][\pL\pN_.\-/@]{{2,}}'), lambda x: regexp_replace(x, '[.,/]+$', '')), lambda x: regexp_matches(x, '[._/@-]|\pN')), regexp_extract_all(t, '[A-Za-zА-Яа-яЁё]{{4,}}')]),
        lambda x: length(x) >= 3 AND lower(x) NOT IN ({_SMALL})) AS pool, list_transform(regexp_extract_all(t, '{Q.EXACT}'), lambda x: regexp_replace(x, '^["«»]+|["«»]+$', '', 'g')) AS exact FROM a),
      k AS (SELECT *, list_transform(pool, lambda x: lower(x)) AS lows FROM p)
      SELECT run_id, by_word AS group_by, axis, CASE WHEN axis IS NOT NULL THEN axis || ',item' WHEN intent IN ('compare', 'prioritize') THEN 'item,source' ELSE 'category,item' END AS dedup_keys,
        {_CASE('intent', Q.STYLES)} AS style, {_CASE('intent', Q.FIELDS)} AS fields, array_to_string(list_slice(list_filter(pool, lambda x, i: list_position(lows, lower(x)) = i), 1, 24), ' | ') AS key_terms,
        CASE WHEN len(exact) > 0 THEN array_to_string(exact, ' ') ELSE t END AS lexical_query FROM k""",
    "run_entities": "WITH r AS (SELECT DISTINCT run_id, query_text AS t FROM runs) " + " UNION ALL ".join(f"SELECT run_id, '{k}' AS kind, unnest(list_distinct({'list_filter(' if k == 'id' else ''}regexp_extract_all(coalesce(t, ''), '{p}'){', lambda e: regexp_matches(e, chr(92) || chr(100)))' if k == 'id' else ''})) AS entity FROM r" for k, p in _KINDS.items()),
    "run_previous": f"WITH {_PLACE} SELECT run_id, lag(run_id) OVER (PARTITION BY place ORDER BY made, run_id) AS previous_run_id FROM place",
    "run_list": """WITH r AS (SELECT run_id, max(created_at) AS created_at FROM runs WHERE run_id IS NOT NULL AND created_at IS NOT NULL GROUP BY 1 ORDER BY created_at DESC, run_id LIMIT 20), n AS (SELECT run_id, count(DISTINCT item_key) AS n_items FROM run_items GROUP BY 1)
      SELECT run_id, created_at, coalesce(n_items, 0) AS n_items FROM r LEFT JOIN n USING (run_id)""",
    "job_progress": "SELECT job_id, count(DISTINCT chunk_index) AS n_stored, max(chunk_index) + 1 AS n_total, CASE WHEN count(DISTINCT chunk_index) >= max(chunk_index) + 1 THEN 'complete' ELSE 'paused' END AS state FROM map_sample WHERE job_id IS NOT NULL GROUP BY 1",
    "item_keys": """WITH i AS (SELECT run_id, category, item, source, array_to_string(list_sort(list_filter(list_transform(string_split(coalesce(entities, ''), ','), lambda e: trim(e, ' ')), lambda e: e <> '')), ',') AS e FROM run_items WHERE run_id IS NOT NULL AND item_key IS NOT NULL)
      SELECT run_id, left(sha256(CASE WHEN e <> '' THEN 'ent:' || lower(e) || '|src:' || lower(coalesce(source, '')) ELSE 'cat:' || lower(coalesce(category, '')) || '|item:' || lower(left(coalesce(item, ''), 60)) || '|src:' || lower(coalesce(source, '')) END), 20) AS canonical_key, count(*) AS n_rows FROM i GROUP BY 1, 2""",
    "new_documents": """WITH d AS (SELECT doc_id, sha256(trim(coalesce(text, ''), ' ')) AS h, epoch_us(created_at) AS t FROM documents), m AS (SELECT (min(t) + max(t)) / 2 AS m FROM d)
      SELECT doc_id, h FROM d, m WHERE t > m AND h NOT IN (SELECT h FROM d, m WHERE t <= m)""",
    "judge_votes": "SELECT doc_id, sum(toxic) * 2 > count(*) AS verdict, sum(toxic) IN (0, count(*)) AS agree, round(avg(quality), 2) AS mean_quality FROM labels WHERE toxic IS NOT NULL GROUP BY 1",
    "chat_messages": f"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents WHERE doc_kind = 'chat' AND text IS NOT NULL),
      s AS (SELECT *, CASE WHEN regexp_matches(x, '{_HEAD}') THEN regexp_extract(x, '{_HEAD}', 1) END AS sender FROM l WHERE trim(x, ' ') <> ''), b AS (SELECT *, count(sender) OVER (PARTITION BY doc_id ORDER BY line) AS message FROM s)
      SELECT doc_id, message, max(sender) AS sender, count(*) AS n_lines FROM b WHERE message > 0 GROUP BY 1, 2""",
    "plain_markdown": f"SELECT doc_id, md5({_MD}) AS h, length({_MD}) AS n FROM documents WHERE doc_kind = 'markdown' AND text IS NOT NULL",
    "path_labels": f"""WITH p AS (SELECT DISTINCT source_path FROM document_chunks WHERE source_path IS NOT NULL), q AS (SELECT source_path, list_slice({_PARTS}, 1, len({_PARTS}) - 1) AS l FROM p)
      SELECT source_path, array_to_string(list_slice(l, greatest(1, len(l) - 5), len(l)), '/') AS labels, upper(regexp_extract(source_path, '\\.([A-Za-z0-9]{{1,8}})$', 1)) AS format FROM q""",
    "host_pages": "SELECT lower(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)) AS host, count(DISTINCT page_id) AS n_pages FROM fetched_pages GROUP BY 1",
    "table_batches": """WITH t AS (SELECT count(*) AS n_rows, CAST(sum(length(concat_ws(chr(9), l_orderkey, l_partkey, l_suppkey, l_linenumber, CAST(round(l_quantity * 100) AS BIGINT), CAST(round(l_extendedprice * 100) AS BIGINT),
        CAST(round(l_discount * 100) AS BIGINT), CAST(round(l_tax * 100) AS BIGINT), l_returnflag, l_linestatus, strftime(l_shipdate, '%Y-%m-%d')))) AS BIGINT) AS n_chars FROM lineitem),
      p AS (SELECT *, CAST(greatest(1, floor(6000 / greatest(1.0, n_chars / n_rows / 3))) AS BIGINT) AS rows_per_batch FROM t) SELECT *, CAST(ceil(n_rows / rows_per_batch) AS BIGINT) AS n_batches FROM p""",
}
