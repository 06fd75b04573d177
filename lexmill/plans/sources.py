"""Registered queries on importers, headers, citations, run memory and planning."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from lexmill.functions import answers as A
from lexmill.functions import render as R
from lexmill.functions import text as T
from lexmill.operators import chunking as C
from lexmill.operators import planning as P
from lexmill.operators.chunking import chunk_documents
from lexmill.operators.query_plan import plan
from lexmill.operators.snapshots import change_notes
from lexmill.plans import corpus, retrieval, texts
from lexmill.plans.corpus import RELEVANCE_SQL, TERMS
from lexmill.plans.retrieval import gathered_units
from lexmill.plans.snapshots import CHANGES_SQL, p4_found
from lexmill.plans.texts import chunks_sql, flash_cards
from lexmill.session import table
from lexmill.sources.chats import messages
from lexmill.sources.files import file_title, format_name, page_text
from lexmill.sources.records import record_chunks, record_rows


def _docs(spark, root):
    return table(spark, root, "documents").filter("text is not null")


def chat_imports(spark, root):
    """Format, messages and senders that the importers find in chat documents."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, *found) for i, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True) if (found := messages("chat.txt", t))]
            if rows:
                ids, kinds, lists = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(kinds), pa.array(map(len, lists), pa.int32()), pa.array([len({m[0] for m in x}) for x in lists], pa.int32())], names=["doc_id", "format", "n_messages", "n_senders"])

    return _docs(spark, root).filter("doc_kind = 'chat'").select("doc_id", "text").mapInArrow(read, "doc_id bigint, format string, n_messages int, n_senders int")


def file_titles(spark, root):
    """Title, labels and format of each chunked file."""
    c = table(spark, root, "document_chunks").filter("source_path is not null and chunk_index = 0").groupBy("source_path").agg(F.min("text").alias("text"))
    path = F.col("source_path")
    return c.select("source_path", file_title(path, F.col("text")).alias("title"), R.page_labels(path).alias("labels"), format_name(path).alias("format"))


def built_chunks(spark, root):
    """Chunks of Markdown documents with the service lines that the MAP step sees."""
    d = _docs(spark, root).filter("doc_kind = 'markdown'").select("doc_id", "title", F.concat_ws("/", F.lit("docs"), "source", F.concat("doc_id", F.lit(".md"))).alias("path"), "text")
    chunks = chunk_documents(d, 200, 0).join(d.select("doc_id", "title", "path"), "doc_id")
    head = R.header(F.col("path"), F.col("title"), R.page_labels(F.col("path")), format_name(F.col("path")), F.col("chunk_index"))
    return chunks.select("doc_id", "chunk_index", head.alias("header"), F.md5(F.concat_ws("\n", head, "text")).alias("h"))


def chunk_citations(spark, root):
    """Name, place and quote of each chunk as a citation."""
    c = table(spark, root, "document_chunks").select("chunk_id", "source_path", F.element_at("metadata", "title").alias("title"), "page", "line_start", "text").distinct()
    q = R.quote(F.col("text"))
    return c.select("chunk_id", R.display_name(F.col("source_path"), F.col("title")).alias("display"), R.locator(F.col("page"), F.col("line_start")).alias("locator"), F.md5(q).alias("h"), F.length(q).alias("n"))


def page_summaries(spark, root):
    """First line of substance of each Markdown document."""
    return _docs(spark, root).filter("doc_kind = 'markdown'").select("doc_id", R.page_summary(F.col("text")).alias("summary"))


def header_sample(spark, root):
    """Up to twelve evenly spaced chunks of each file with their first two filled lines."""
    c = table(spark, root, "document_chunks").filter("source_path is not null and chunk_index is not null").groupBy("source_path", "chunk_index").agg(F.min(F.struct("chunk_id", "text")).alias("c")).select("source_path", "chunk_index", "c.*")
    n = c.groupBy("source_path").agg(F.greatest(F.lit(1), F.floor((F.max("chunk_index") + 1) / 12)).alias("step"))
    lines = F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.trim(x)), lambda x: x != "")
    picked = c.join(n, "source_path").filter((F.col("chunk_index") % F.col("step") == 0) & (F.floor(F.col("chunk_index") / F.col("step")) < 12))
    return picked.select("chunk_id", F.md5(F.substring(F.array_join(F.slice(lines, 1, 2), " | "), 1, 300)).alias("h"))


def table_rows(spark, root):
    """Rows of a table as tab-separated text, and read back from a model's answer of cells parted by bars."""
    n = table(spark, root, "nation")
    cells = [F.col(c) for c in sorted(n.columns)]
    bars = F.concat(F.lit(" | ".join(sorted(n.columns)) + "\n"), F.concat_ws(" | ", *[F.coalesce(c.cast("string"), F.lit("")) for c in cells]), F.lit("\nbad | row"))
    back = n.select(R.tsv(cells).alias("line"), F.explode(R.table_answer(F.concat(F.lit("<results>"), bars, F.lit("</results>")))).alias("row"))
    return back.select("line", F.array_join(F.transform(F.array_sort(F.map_keys("row")), lambda k: F.concat(k, F.lit("="), F.element_at(F.col("row"), k))), ";").alias("fields"))


def index_stats(spark, root):
    """Chunks, distinct texts and files of the chunk table."""
    c = table(spark, root, "document_chunks")
    return c.agg(F.countDistinct("chunk_id").alias("n_chunks"), F.countDistinct(T.content_hash(F.col("text"))).alias("n_texts"), F.countDistinct("source_path").alias("n_sources"))


def judge_tally(spark, root):
    """Verdicts over all reviewed documents: yes, no, ties, disagreements, mean quality."""
    v = table(spark, root, "labels").filter("toxic is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("yes"), F.round(F.avg("quality"), 2).alias("q"))
    count = lambda c: F.count(F.when(c, 1))
    return v.agg(F.count(F.lit(1)).alias("n_questions"), count(F.col("yes") * 2 > F.col("n")).alias("wins"), count(F.col("yes") * 2 < F.col("n")).alias("losses"), count(F.col("yes") * 2 == F.col("n")).alias("ties"), count((F.col("yes") > 0) & (F.col("yes") < F.col("n"))).alias("split_verdicts"), F.round(F.avg("q"), 2).alias("mean_quality"))


def pending_chunks(spark, root):
    """Chunks of each job that have no stored result yet."""
    m = table(spark, root, "map_sample").filter("job_id is not null and chunk_index is not null")
    wanted = m.groupBy("job_id").agg(F.max("chunk_index").alias("last")).select("job_id", F.explode(F.sequence(F.lit(0), F.col("last"))).alias("chunk_index"))
    return P.pending(wanted, m, ["job_id", "chunk_index"])


def run_change_notes(spark, root):
    """Note on each run's changes: numbers and up to eight new items (H5)."""
    items = table(spark, root, "run_items").filter("run_id is not null and item_key is not null")
    last = items.groupBy("run_id", "item_key").agg(F.max(F.struct("loaded_at", F.coalesce("item", F.lit("")).alias("item"), F.coalesce("category", F.lit("")).alias("category"), F.coalesce("source", F.lit("")).alias("source"))).alias("r"))
    named = last.select("run_id", "item_key", F.concat(F.when(F.col("r.item") != "", F.col("r.item")).when(F.col("r.category") != "", F.col("r.category")).otherwise("-"), F.lit(" @ "), F.when(F.col("r.source") != "", F.col("r.source")).otherwise("?")).alias("name"))
    return change_notes(p4_found(spark, root), named, "run_id", "item_key")


def relevant_files(spark, root):
    """Documents relevant enough for a query by name and head; all if none is."""
    d = table(spark, root, "documents").select("doc_id", F.round(P.relevance(F.concat_ws("/", "source", "title"), F.col("text"), TERMS), 6).alias("score"))
    return P.keep_relevant(d, 0.45).select("doc_id")


def run_predicates(spark, root):
    """Whether each run's query asks to sum up many passages."""
    return table(spark, root, "runs").filter("query_text is not null").select("run_id", A.is_analytical(F.col("query_text")).alias("analytical")).distinct()


def corpus_size(spark, root):
    """Whether each language's documents make a large corpus, and how many would be read as a stream."""
    size = F.octet_length(F.coalesce("text", F.lit("")))
    d = table(spark, root, "documents").groupBy(F.coalesce("lang", F.lit("und")).alias("lang")).agg(F.count(F.lit(1)).alias("n_files"), F.sum(size).cast("bigint").alias("n_bytes"), F.max(size).alias("longest"))
    return d.select("lang", P.is_large(F.col("n_files"), F.col("n_bytes")).alias("is_large"), (F.col("longest") >= P.STREAMED).alias("streamed"))


def file_parts(spark, root):
    """Documents above 300 tokens in parts, as hash."""
    return C.file_parts(_docs(spark, root), 300).select("doc_id", "part", "n_parts", F.md5("text").alias("h"))


def record_chunk_texts(spark, root):
    """Records of record documents packed whole under 200 tokens, as hash."""
    d = _docs(spark, root).filter("doc_kind = 'record'").select(F.concat("doc_id", F.lit(".jsonl")).alias("source_path"), "text")
    return record_chunks(record_rows(d), 200).select("source_path", "chunk_index", F.md5("text").alias("h"))


def batch_texts(spark, root):
    """Batches of gathered chunks as numbered text, as hash and length."""
    units = gathered_units(spark, root).join(table(spark, root, "document_chunks").groupBy("chunk_id").agg(F.min("text").alias("text")), "chunk_id")
    line = R.unit_line(F.col("n"), F.col("text"), F.col("is_neighbour"))
    return units.groupBy("source_path", "batch").agg(F.array_sort(F.collect_list(F.struct("n", line.alias("t")))).alias("l")).select("source_path", "batch", F.md5(F.array_join(F.transform("l", lambda x: x["t"]), "\n\n")).alias("h"))


def plan_summaries(spark, root):
    """Plan of each run's query on one line."""
    r = table(spark, root, "runs").filter("query_text is not null").select("run_id", "query_text").distinct().withColumn("p", plan(F.col("query_text")))
    return r.select("run_id", R.plan_summary(F.col("p")).alias("summary"))


def card_sheets(spark, root):
    """Cards of each qa document as a Markdown sheet, as hash and length."""
    cards = flash_cards(spark, root).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("n", "front", "back"))).alias("c"))
    sheet = R.card_sheet(F.col("c"))
    return cards.select("doc_id", F.md5(sheet).alias("h"), F.length(sheet).alias("n"))


def nested_record_counts(spark, root):
    """Records that the shape-driven reader finds in each result written as nested JSON.

    A finding has fewer than six scalars of its own, so its evidence are the records; one without evidence is itself a record.
    """
    rows = table(spark, root, "map_sample").dropDuplicates(["result_id"])
    finding = lambda f: F.struct(f["finding_id"].alias("finding_id"), f["severity"].alias("severity"), f["explanation"].alias("explanation"), F.filter(f["evidence_refs"], lambda r: r.isNotNull()).alias("evidence_refs"))
    body = F.to_json(F.struct("job_id", F.transform(F.filter("findings", lambda f: f.isNotNull()), finding).alias("findings")))
    files = rows.select(F.concat("result_id", F.lit(".json")).alias("source_path"), body.alias("text"))
    return record_rows(files).groupBy("source_path").agg(F.count(F.lit(1)).alias("n_records"), F.countDistinct("place").alias("n_places"))


def html_texts(spark, root):
    """Title and main text read from pages in HTML, here written from fetched_docs with a menu and a footer around."""
    d = table(spark, root, "fetched_docs").filter("text is not null").groupBy("fetch_id").agg(F.min("text").alias("text"), F.min("title").alias("title"))
    escape = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    lines = F.array_join(F.transform(F.split("text", "\n"), lambda x: F.concat(F.lit("<p>"), escape(x), F.lit("</p>"))), "\n")
    html = F.concat(F.lit("<html><head><title>"), escape(F.coalesce("title", F.lit(""))), F.lit("</title><style>p {}</style></head><body><nav>Home</nav><article>"), lines, F.lit("<script>var a;</script></article><footer>End</footer></body></html>"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            titles, texts = zip(*map(page_text, b.column("html").to_pylist()), strict=True) if b.num_rows else ((), ())
            yield pa.RecordBatch.from_arrays([b.column("fetch_id"), pa.array(titles, pa.string()), pa.array(texts, pa.string())], names=["fetch_id", "title", "text"])

    got = d.select("fetch_id", html.alias("html")).mapInArrow(read, "fetch_id bigint, title string, text string")
    return got.select("fetch_id", "title", F.md5("text").alias("h"), F.length("text").alias("n"))


QUERIES = {f.__name__: f for f in (nested_record_counts, html_texts, file_parts, record_chunk_texts, batch_texts, plan_summaries, card_sheets, chat_imports, file_titles, built_chunks, chunk_citations, page_summaries, header_sample, table_rows, index_stats, judge_tally, pending_chunks, run_change_notes, relevant_files, run_predicates, corpus_size)}

_HEADERS = r"'^\s*\[(FILE_PATH|FILE_PART|CHUNK_INDEX|FILE_TITLE|FILE_LABELS|FILE_FORMAT|SOURCE_URL|SOURCE_TITLE|VISION_FILE|Файл)\b'"
_FORMAT = "CASE lower(regexp_extract(f, '[^/]\\.([^./]+)$', 1)) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in {"md": "Markdown", "txt": "plain text", "log": "log file", "html": "HTML document", "htm": "HTML document", "csv": "CSV table", "json": "JSON data", "pdf": "PDF document", "docx": "DOCX document", "xml": "XML data", "xlsx": "Excel table", "rtf": "RTF document", "eml": "EML file"}.items()) + " ELSE upper(regexp_extract(f, '[^/]\\.([^./]+)$', 1)) || ' file' END"
_LABELS = r"array_to_string((list_filter(list_filter(list_transform(string_split(f, '/'), lambda p, i: CASE WHEN i < len(string_split(f, '/')) THEN p END), lambda p: p IS NOT NULL AND p <> '' AND p <> '.' AND NOT regexp_matches(p, '^[A-Za-z]:$')), lambda p: length(p) > 1))[-6:], ', ')"
_PHONE = r"'^(?:\[(?:\d{1,2}[./]\d{1,2}[./]\d{2,4},? \d{1,2}:\d{2}(?::\d{2})?)\] |(?:\d{1,2}[./]\d{1,2}[./]\d{2,4},? \d{1,2}:\d{2}(?::\d{2})?) - )(.*)$'"
_NAMED = r"'^([^\s:][^:]{0,39}): '"
SQL = {
    "chat_imports": rf"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE doc_kind = 'chat' AND text IS NOT NULL),
      a AS (SELECT *, regexp_matches(x, {_PHONE}) AS dated, regexp_extract(x, {_PHONE}, 1) AS rest FROM l), g AS (SELECT doc_id FROM a WHERE i <= 80 GROUP BY 1 HAVING count(*) FILTER (dated) >= 4),
      p AS (SELECT doc_id, 'phone' AS format, count(*) AS n_messages, count(DISTINCT regexp_extract(rest, {_NAMED}, 1)) AS n_senders FROM a JOIN g USING (doc_id) WHERE dated AND regexp_matches(rest, {_NAMED}) GROUP BY 1),
      b AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS n, regexp_extract(x, {_NAMED}, 1) AS who FROM l WHERE trim(x, ' ' || chr(9)) <> '' AND doc_id NOT IN (SELECT doc_id FROM p)),
      s AS (SELECT doc_id, who, count(*) AS k FROM b WHERE n <= 80 AND who <> '' GROUP BY 1, 2), q AS (SELECT doc_id, sum(k) AS hits, count(*) AS senders, max(k) AS most FROM s GROUP BY 1),
      t AS (SELECT doc_id, count(*) AS lines, count(*) FILTER (who <> '') AS n_messages, count(DISTINCT who) FILTER (who <> '') AS n_senders FROM b GROUP BY 1)
      SELECT * FROM p UNION ALL SELECT doc_id, 'log', n_messages, n_senders FROM t JOIN q USING (doc_id) WHERE lines >= 5 AND hits >= 6 AND hits >= 0.6 * least(lines, 80) AND senders >= 2 AND most >= 2""",
    "file_parts": """WITH d AS (SELECT doc_id, text, CASE WHEN length(text) // 4 > 300 THEN CAST(ceil(length(text) / 1200) AS INT) ELSE 1 END AS n_parts FROM documents WHERE length(text) > 0), p AS (SELECT *, unnest(range(1, n_parts + 1)) AS part FROM d)
      SELECT doc_id, CAST(part AS INT) AS part, n_parts, md5(CASE WHEN n_parts = 1 THEN text ELSE substring(text, (part - 1) * 1200 + 1, 1200) END) AS h FROM p""",
    "record_chunk_texts": r"""WITH RECURSIVE l AS (SELECT doc_id || '.jsonl' AS source_path, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents WHERE doc_kind = 'record' AND text IS NOT NULL),
      j AS (SELECT source_path, i, CAST(x AS JSON) AS j FROM l WHERE json_valid(x) AND json_type(CAST(x AS JSON)) = 'OBJECT'), k AS (SELECT *, count(*) OVER (PARTITION BY source_path) AS c, row_number() OVER (PARTITION BY source_path ORDER BY i) AS n FROM j),
      e AS (SELECT source_path, n, i, unnest(json_keys(j)) AS key, generate_subscripts(json_keys(j), 1) AS o, j FROM k WHERE c >= 2), v AS (SELECT *, trim(regexp_replace(json_extract_string(j, '$."' || key || '"'), '\s+', ' ', 'g'), ' ') AS val FROM e),
      t AS (SELECT source_path, n, '- record @ line[' || any_value(i) || ']' || coalesce(chr(10) || string_agg('  ' || key || ': ' || CASE WHEN length(val) > 300 THEN left(val, 300) || '…' ELSE val END, chr(10) ORDER BY o) FILTER (coalesce(val, '') <> ''), '') AS x FROM v GROUP BY 1, 2),
      u AS (SELECT *, greatest(1, length(x) // 4) AS t FROM t), r AS (SELECT source_path, n, x, 1 AS g, CASE WHEN t > 200 THEN 0 ELSE t END AS fill, t > 200 AS alone FROM u WHERE n = 1
        UNION ALL SELECT u.source_path, u.n, u.x, CASE WHEN u.t > 200 OR r.alone OR r.fill + u.t > 200 THEN r.g + 1 ELSE r.g END, CASE WHEN u.t > 200 THEN 0 WHEN r.alone OR r.fill + u.t > 200 THEN u.t ELSE r.fill + u.t END, u.t > 200 FROM r JOIN u ON u.source_path = r.source_path AND u.n = r.n + 1)
      SELECT source_path, CAST(g - 1 AS INT) AS chunk_index, md5(string_agg(x, chr(10) ORDER BY n)) AS h FROM r GROUP BY 1, 2""",
    "batch_texts": f"""WITH gu AS ({retrieval.SQL['gathered_units']}), c AS (SELECT chunk_id, min(text) AS text FROM document_chunks GROUP BY 1), t AS (SELECT gu.*, regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g') AS x FROM gu JOIN c USING (chunk_id))
      SELECT source_path, batch, md5(string_agg('[' || n || ']' || CASE WHEN is_neighbour THEN ' (context) ' ELSE ' ' END || CASE WHEN length(x) > 1100 THEN left(x, 1100) || '…' ELSE x END, chr(10) || chr(10) ORDER BY n)) AS h FROM t GROUP BY 1, 2""",
    "plan_summaries": f"""WITH p AS ({corpus.SQL['run_plans']}), q AS (SELECT run_id, q.intent, e.n FROM ({corpus.SQL['run_queries']}) q LEFT JOIN (SELECT run_id, sum(least(c, 20)) AS n FROM (SELECT run_id, kind, count(*) AS c FROM ({corpus.SQL['run_entities']}) GROUP BY 1, 2) GROUP BY 1) e USING (run_id))
      SELECT run_id, concat_ws(' ', 'intent=' || intent, 'out=' || style, 'group_by=' || group_by || '->' || axis, 'fields=' || fields, CASE WHEN key_terms <> '' THEN 'terms=' || array_to_string(list_slice(string_split(key_terms, ' | '), 1, 6), ',') END, CASE WHEN n > 0 THEN 'entities=' || CAST(n AS INT) END) AS summary FROM p JOIN q USING (run_id)""",
    "card_sheets": f"""WITH c AS ({texts.SQL['flash_cards']}), s AS (SELECT doc_id, '# Flash cards' || chr(10) || chr(10) || string_agg('**' || row || '. ' || front || '**' || chr(10) || chr(10) || back || chr(10), chr(10) ORDER BY row) AS x FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n) AS row FROM c) GROUP BY 1)
      SELECT doc_id, md5(x) AS h, length(x) AS n FROM s""",
    "nested_record_counts": """WITH r AS (SELECT * FROM map_sample QUALIFY row_number() OVER (PARTITION BY result_id) = 1), f AS (SELECT result_id, unnest(list_filter(findings, lambda f: f IS NOT NULL)) AS f FROM r),
      n AS (SELECT result_id, len(list_filter(coalesce(f.evidence_refs, []), lambda r: r IS NOT NULL)) AS n FROM f)
      SELECT result_id || '.json' AS source_path, CAST(sum(greatest(n, 1)) AS BIGINT) AS n_records, count(DISTINCT n > 0) AS n_places FROM n GROUP BY result_id HAVING sum(greatest(n, 1)) >= 2""",
    "html_texts": r"""WITH d AS (SELECT fetch_id, min(text) AS text, min(title) AS title FROM fetched_docs WHERE text IS NOT NULL GROUP BY 1),
      l AS (SELECT *, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '[\s\pZ\x1c-\x1f\x{85}]+', ' ', 'g'), ' ')), lambda x: x <> '') AS ls FROM d), t AS (SELECT *, array_to_string(ls, chr(10) || chr(10)) AS x FROM l)
      SELECT fetch_id, regexp_replace(coalesce(title, ''), '^[\s\pZ]+|[\s\pZ]+$', '', 'g') AS title, md5(x) AS h, length(x) AS n FROM t""",
    "file_titles": rf"""WITH c AS (SELECT source_path, replace(source_path, chr(92), '/') AS f, min(text) AS text FROM document_chunks WHERE source_path IS NOT NULL AND chunk_index = 0 GROUP BY 1),
      h AS (SELECT *, left(coalesce(text, ''), 4096) AS head, lower(regexp_extract(f, '[^/]\.([^./]+)$', 1)) AS s, regexp_replace(regexp_extract(f, '([^/]+?)(\.[^./]+)?$', 1), '[_-]', ' ', 'g') AS stem FROM c),
      i AS (SELECT *, regexp_extract(head, '(?m)^[ \t]*(\S.*?)\s*$', 1) AS line, string_split(head, chr(10))[1] AS first FROM h),
      t AS (SELECT *, CASE WHEN s IN ('md', 'rst', 'txt', 'log') THEN CASE WHEN starts_with(line, '#') THEN regexp_replace(line, '^#+\s*', '') ELSE left(line, 120) END
        WHEN s IN ('html', 'htm') THEN coalesce(nullif(left(trim(regexp_extract(head, '(?i)<title[^>]*>([^<]+)</title>', 1), ' '), 120), ''), left(trim(regexp_extract(head, '(?i)<h1[^>]*>([^<]+)</h1>', 1), ' '), 120))
        WHEN s = 'csv' THEN array_to_string(list_slice(list_filter(list_transform(string_split(first, CASE WHEN length(replace(first, ';', '')) < length(replace(first, ',', '')) THEN ';' ELSE ',' END), lambda c: regexp_replace(trim(c, ' '), '^"+|"+$', '', 'g')), lambda c: c <> ''), 1, 5), ', ')
        ELSE '' END AS found FROM i)
      SELECT source_path, left(CASE WHEN trim(found, ' ') <> '' THEN found ELSE stem END, 200) AS title, {_LABELS} AS labels, {_FORMAT} AS format FROM t""",
    "built_chunks": chunks_sql("documents WHERE doc_kind = 'markdown' AND text IS NOT NULL", overlap=False) + rf""", ch AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY g, a) - 1 AS chunk_index, x FROM w),
      f AS (SELECT ch.*, d.title, concat_ws('/', 'docs', source, doc_id || '.md') AS f FROM ch JOIN documents d USING (doc_id)),
      h AS (SELECT doc_id, CAST(chunk_index AS INT) AS chunk_index, x, '[FILE_PATH: ' || f || '][CHUNK_INDEX: ' || (chunk_index + 1) || ']' || chr(10) || CASE WHEN coalesce(title, '') <> '' THEN '[FILE_TITLE: ' || title || ']' ELSE '' END
        || CASE WHEN {_LABELS} <> '' THEN '[FILE_LABELS: ' || {_LABELS} || ']' ELSE '' END || '[FILE_FORMAT: Markdown]' AS header FROM f) SELECT doc_id, chunk_index, header, md5(header || chr(10) || x) AS h FROM h""",
    "chunk_citations": rf"""WITH c AS (SELECT DISTINCT chunk_id, source_path, trim(coalesce(metadata['title'], ''), ' ') AS t, page, line_start, text FROM document_chunks),
      p AS (SELECT *, list_filter(string_split(replace(coalesce(source_path, ''), chr(92), '/'), '/'), lambda x: x <> '') AS parts, regexp_replace(array_to_string(list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: NOT regexp_matches(x, {_HEADERS})), chr(10)), '^\s+|\s+$', '', 'g') AS q FROM c),
      b AS (SELECT *, CASE WHEN len(parts) = 0 THEN 'source' ELSE array_to_string(parts[-2:], '/') END AS base, CASE WHEN length(q) > 320 THEN regexp_replace(left(q, 320), '\s+$', '') || '…' ELSE q END AS cut FROM p)
      SELECT chunk_id, left(CASE WHEN t <> '' AND NOT contains(lower(base), lower(t)) THEN base || ' — ' || t ELSE base END, 80) AS display, CASE WHEN page > 0 THEN 'p. ' || page WHEN line_start > 0 THEN 'line ' || line_start ELSE '' END AS locator, md5(cut) AS h, length(cut) AS n FROM b""",
    "page_summaries": r"""WITH l AS (SELECT doc_id, list_filter(list_transform(list_filter(list_transform(regexp_split_to_array(text, '\r?\n'), lambda x: trim(x, ' ')), lambda x: NOT starts_with(x, '#') AND NOT starts_with(x, '|')), lambda x: trim(regexp_replace(x, '^[-*]+', ''), ' ')), lambda x: x <> '') AS t FROM documents WHERE doc_kind = 'markdown' AND text IS NOT NULL),
      f AS (SELECT doc_id, coalesce(t[1], '') AS x FROM l) SELECT doc_id, CASE WHEN length(x) > 120 THEN rtrim(left(x, 120), ' ') || '…' ELSE x END AS summary FROM f""",
    "header_sample": """WITH c AS (SELECT source_path, chunk_index, min((chunk_id, text)) AS c FROM document_chunks WHERE source_path IS NOT NULL AND chunk_index IS NOT NULL GROUP BY 1, 2), n AS (SELECT source_path, CAST(greatest(1, floor((max(chunk_index) + 1) / 12)) AS BIGINT) AS step FROM c GROUP BY 1)
      SELECT c[1] AS chunk_id, md5(left(array_to_string(list_slice(list_filter(list_transform(string_split(coalesce(c[2], ''), chr(10)), lambda x: trim(x, ' ')), lambda x: x <> ''), 1, 2), ' | '), 300)) AS h FROM c JOIN n USING (source_path) WHERE chunk_index % step = 0 AND chunk_index // step < 12""",
    "index_stats": "SELECT count(DISTINCT chunk_id) AS n_chunks, count(DISTINCT trim(coalesce(text, ''), ' ')) AS n_texts, count(DISTINCT source_path) AS n_sources FROM document_chunks",
    "judge_tally": """WITH v AS (SELECT doc_id, count(*) AS n, sum(toxic) AS yes, round(avg(quality), 2) AS q FROM labels WHERE toxic IS NOT NULL GROUP BY 1)
      SELECT count(*) AS n_questions, count(*) FILTER (yes * 2 > n) AS wins, count(*) FILTER (yes * 2 < n) AS losses, count(*) FILTER (yes * 2 = n) AS ties, count(*) FILTER (yes > 0 AND yes < n) AS split_verdicts, round(avg(q), 2) AS mean_quality FROM v""",
    "pending_chunks": """WITH m AS (SELECT DISTINCT job_id, chunk_index FROM map_sample WHERE job_id IS NOT NULL AND chunk_index IS NOT NULL), w AS (SELECT job_id, unnest(range(0, max(chunk_index) + 1)) AS chunk_index FROM m GROUP BY 1)
      SELECT w.job_id, CAST(w.chunk_index AS INT) AS chunk_index FROM w ANTI JOIN m ON w.job_id = m.job_id AND w.chunk_index = m.chunk_index""",
    "run_change_notes": CHANGES_SQL + """, f AS (SELECT run_id, item_key, coalesce(item, '') AS i, coalesce(category, '') AS c, coalesce(source, '') AS s FROM run_items WHERE run_id IS NOT NULL AND item_key IS NOT NULL
        QUALIFY row_number() OVER (PARTITION BY run_id, item_key ORDER BY loaded_at DESC NULLS LAST, coalesce(item, '') DESC, coalesce(category, '') DESC, coalesce(source, '') DESC) = 1),
      x AS (SELECT run_id, item_key, CASE WHEN i <> '' THEN i WHEN c <> '' THEN c ELSE '-' END || ' @ ' || CASE WHEN s <> '' THEN s ELSE '?' END AS name FROM f),
      n AS (SELECT run_id, count(*) FILTER (change = 'added') AS a, count(*) FILTER (change = 'removed') AS r, count(*) FILTER (change = 'changed') AS c FROM p4 WHERE change IS NOT NULL GROUP BY 1),
      e AS (SELECT run_id, item_key FROM p4 WHERE change = 'added' QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY item_key) <= 8), l AS (SELECT run_id, string_agg('  - ' || name, chr(10) ORDER BY item_key) AS t FROM e JOIN x USING (run_id, item_key) GROUP BY 1)
      SELECT run_id, '### Changes since last run' || chr(10) || '- Added: ' || a || chr(10) || '- Removed: ' || r || chr(10) || '- Changed: ' || c || CASE WHEN a > 0 THEN chr(10) || '- New (examples):' || coalesce(chr(10) || t, '') ELSE '' END AS note FROM n LEFT JOIN l USING (run_id)""",
    "corpus_size": """WITH d AS (SELECT coalesce(lang, 'und') AS lang, count(*) AS n, sum(strlen(coalesce(text, ''))) AS b, max(strlen(coalesce(text, ''))) AS m FROM documents GROUP BY 1) SELECT lang, n >= 12 OR b >= 20000000 AS is_large, m >= 52428800 AS streamed FROM d""",
    "relevant_files": f"WITH r AS ({RELEVANCE_SQL}), k AS (SELECT doc_id, relevance >= greatest(0.15, 0.85 * 0.45) AS keep FROM r) SELECT doc_id FROM k QUALIFY keep OR NOT bool_or(keep) OVER ()",
    "run_predicates": "SELECT DISTINCT run_id, NOT regexp_matches(lower(trim(query_text, ' ')), '^\\s*(сколько|когда|где|какой айпи|во сколько|how many|when did|what time)([^\\pL\\pN_]|$)') AND (" + " OR ".join(f"contains(lower(query_text), '{m}')" for m in A.ANALYTICAL) + ") AS analytical FROM runs WHERE query_text IS NOT NULL",
    "table_rows": """SELECT concat_ws(chr(9), coalesce(CAST(n_name AS VARCHAR), ''), coalesce(CAST(n_nationkey AS VARCHAR), ''), coalesce(CAST(n_regionkey AS VARCHAR), '')) AS line,
      'n_name=' || n_name || ';n_nationkey=' || n_nationkey || ';n_regionkey=' || n_regionkey AS fields FROM nation""",
}
