"""Registered queries on headers, samples, histories, checks and other per-row functions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lexmill.functions import text as T
from lexmill.session import table

# Section names of a report, and how much evidence it needs.
SECTIONS = {"executive summary": ["executive summary", "исполнительное резюме", "краткое резюме"], "evidence matrix": ["evidence matrix", "матрица доказательств", "доказательная база"], "action plan": ["action plan", "план действий", "рекомендации"]}


def chunk_headers(spark, root):
    """Header line of each chunk."""
    c = table(spark, root, "document_chunks").select("chunk_id", "source_path", "chunk_index").distinct()
    return c.select("chunk_id", F.concat(F.lit("[FILE_PATH: "), F.coalesce("source_path", F.lit("unknown")), F.lit("][CHUNK_INDEX: "), F.coalesce(F.col("chunk_index"), F.lit(0)) + 1, F.lit("]")).alias("header"))


def truncated_texts(spark, root):
    """Texts cut to 300 estimated tokens with a mark."""
    d = table(spark, root, "documents").filter("text is not null")
    cut = F.when(F.length("text") > 1200, F.concat(F.substring("text", 1, 1200), F.lit(" …"))).otherwise(F.col("text"))
    return d.select("doc_id", F.md5(cut).alias("h"), (F.length("text") > 1200).alias("cut"))


def report_checks(spark, root):
    """Warnings on report documents: short, missing sections, repeated headings."""
    d = table(spark, root, "documents").filter("doc_kind = 'report' and text is not null")
    low = F.lower("text")
    heads = F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(x)), lambda x: x.startswith("##"))
    missing = [F.when(~T._any([low.contains(a) for a in names]), f"missing:{s}") for s, names in SECTIONS.items()]
    found = F.array_compact(F.array(F.when(F.length(F.trim("text")) < 400, "short"), *missing, F.when(F.size(heads) != F.size(F.array_distinct(heads)), "repeated headings")))
    return d.select("doc_id", F.array_join(found, ",").alias("warnings"))


def run_times(spark, root):
    """Time of each run as text."""
    r = table(spark, root, "runs").filter("created_at is not null").select("run_id", "created_at").distinct()
    return r.select("run_id", F.date_format(F.timestamp_seconds("created_at"), "yyyy-MM-dd HH:mm").alias("at"))


def digest_sample(spark, root):
    """Evenly spaced chunks of each file: every (n / 64)-th."""
    c = table(spark, root, "document_chunks").filter("source_path is not null and chunk_index is not null").select("source_path", "chunk_index", "chunk_id").distinct()
    n = c.groupBy("source_path").agg(F.greatest(F.lit(1), F.floor((F.max("chunk_index") + 1) / 64)).alias("step"))
    return c.join(n, "source_path").filter(F.col("chunk_index") % F.col("step") == 0).select("chunk_id", "step")


def manifest_json(spark, root):
    """Manifest of the corpus as JSON lines by language (K5)."""
    d = table(spark, root, "documents").groupBy(F.coalesce("lang", F.lit("und")).alias("lang")).agg(F.count(F.lit(1)).alias("files"))
    return d.select(F.to_json(F.struct("lang", "files")).alias("line"))


def pipe_rows(spark, root):
    """Table rows with three cells or more inside texts."""
    p = table(spark, root, "fetched_docs").filter("text is not null").select("fetch_id", "text").distinct()
    rows = p.select("fetch_id", F.posexplode(F.split("text", "\n")).alias("line_no", "x")).filter("x like '%|%'")
    cells = F.filter(F.transform(F.split("x", r"\|"), lambda c: F.trim(c)), lambda c: c != "")
    return rows.select("fetch_id", "line_no", F.size(cells).alias("n_cells"), F.array_join(cells, " | ").alias("row")).filter("n_cells >= 3")


def latest_labels(spark, root):
    """Last mark of each rater on each document (K7)."""
    rows = table(spark, root, "labels").filter("rater is not null")
    return rows.groupBy("doc_id", "rater").agg(F.max(F.struct("rated_at", F.coalesce("toxic", F.lit(-1)).alias("toxic"), F.coalesce("quality", F.lit(-1)).alias("quality"))).alias("r")).select("doc_id", "rater", "r.toxic", "r.quality")


def history_tail(spark, root):
    """Last four lines of each chat, cut to 600 letters."""
    lines = table(spark, root, "documents").filter("doc_kind = 'chat' and text is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "x")).filter("trim(x) <> ''")
    last = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("n")))
    return lines.withColumn("back", last).filter("back <= 4").select("doc_id", "back", F.md5(F.substring("x", 1, 600)).alias("h"))


def chunk_kinds(spark, root):
    """Chunks, tokens and longest text by kind."""
    c = table(spark, root, "document_chunks").select("chunk_id", F.coalesce("chunk_kind", F.lit("text")).alias("kind"), T.count_tokens(F.col("text")).alias("t")).distinct()
    return c.groupBy("kind").agg(F.count(F.lit(1)).alias("n_chunks"), F.sum("t").cast("bigint").alias("tokens"), F.max("t").alias("longest"))


def query_dedup(spark, root):
    """Distinct run queries apart from case and outer spaces, with their first run."""
    r = table(spark, root, "runs").filter("query_text is not null and run_id is not null")
    return r.groupBy(F.lower(F.trim("query_text")).alias("q")).agg(F.min("run_id").alias("first_run"), F.countDistinct("run_id").alias("n_runs"))


def masked_secrets(spark, root):
    """Every document's text with the values of keys, tokens and passwords masked, as hash, and whether it held any."""
    d = table(spark, root, "documents").filter("text is not null")
    m = T.mask_secrets(F.col("text"))
    return d.select("doc_id", F.md5(m).alias("h"), (m != F.col("text")).alias("masked"))


def source_overlap(spark, root):
    """Files named in both run items and chunks, or in one only."""
    a = table(spark, root, "run_items").select(F.col("source").alias("f")).filter("f is not null and f <> ''").distinct().withColumn("a", F.lit(1))
    b = table(spark, root, "document_chunks").select(F.replace("source_path", F.lit("\\"), F.lit("/")).alias("f")).filter("f is not null").distinct().withColumn("b", F.lit(1))
    side = F.when(F.col("a").isNull(), "chunks").when(F.col("b").isNull(), "items").otherwise("both")
    return a.join(b, "f", "full_outer").groupBy(side.alias("side")).agg(F.count(F.lit(1)).alias("n"))


_MISSING = ", ".join("CASE WHEN NOT (" + " OR ".join(f"contains(lower(text), '{a}')" for a in names) + f") THEN 'missing:{s}' END" for s, names in SECTIONS.items())
_HEADS = "list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ')), lambda x: starts_with(x, '##'))"
QUERIES = {f.__name__: f for f in (chunk_headers, truncated_texts, report_checks, run_times, digest_sample, manifest_json, pipe_rows, latest_labels, history_tail, chunk_kinds, query_dedup, masked_secrets, source_overlap)}
SQL = {
    "chunk_headers": "SELECT DISTINCT chunk_id, '[FILE_PATH: ' || coalesce(source_path, 'unknown') || '][CHUNK_INDEX: ' || (coalesce(chunk_index, 0) + 1) || ']' AS header FROM document_chunks",
    "truncated_texts": "SELECT doc_id, md5(CASE WHEN length(text) > 1200 THEN left(text, 1200) || ' …' ELSE text END) AS h, length(text) > 1200 AS cut FROM documents WHERE text IS NOT NULL",
    "report_checks": f"""SELECT doc_id, array_to_string(list_filter([CASE WHEN length(trim(text, ' ')) < 400 THEN 'short' END, {_MISSING}, CASE WHEN len({_HEADS}) <> len(list_distinct({_HEADS})) THEN 'repeated headings' END], lambda x: x IS NOT NULL), ',') AS warnings
      FROM documents WHERE doc_kind = 'report' AND text IS NOT NULL""",
    "run_times": "SELECT DISTINCT run_id, strftime(make_timestamp(created_at * 1000000), '%Y-%m-%d %H:%M') AS at FROM runs WHERE created_at IS NOT NULL",
    "digest_sample": """WITH c AS (SELECT DISTINCT source_path, chunk_index, chunk_id FROM document_chunks WHERE source_path IS NOT NULL AND chunk_index IS NOT NULL), n AS (SELECT source_path, CAST(greatest(1, floor((max(chunk_index) + 1) / 64)) AS BIGINT) AS step FROM c GROUP BY 1)
      SELECT chunk_id, step FROM c JOIN n USING (source_path) WHERE chunk_index % step = 0""",
    "manifest_json": """SELECT '{"lang":"' || coalesce(lang, 'und') || '","files":' || count(*) || '}' AS line FROM documents GROUP BY coalesce(lang, 'und')""",
    "pipe_rows": """WITH p AS (SELECT DISTINCT fetch_id, text FROM fetched_docs WHERE text IS NOT NULL), l AS (SELECT fetch_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM p),
      c AS (SELECT fetch_id, line_no, list_filter(list_transform(string_split(x, '|'), lambda c: trim(c, ' ')), lambda c: c <> '') AS l FROM l WHERE contains(x, '|')) SELECT fetch_id, line_no, len(l) AS n_cells, array_to_string(l, ' | ') AS row FROM c WHERE len(l) >= 3""",
    "latest_labels": """SELECT doc_id, rater, coalesce(toxic, -1) AS toxic, coalesce(quality, -1) AS quality FROM labels WHERE rater IS NOT NULL
      QUALIFY row_number() OVER (PARTITION BY doc_id, rater ORDER BY rated_at DESC NULLS LAST, coalesce(toxic, -1) DESC, coalesce(quality, -1) DESC) = 1""",
    "history_tail": """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents WHERE doc_kind = 'chat' AND text IS NOT NULL)
      SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC) AS back, md5(left(x, 600)) AS h FROM l WHERE trim(x, ' ') <> '' QUALIFY back <= 4""",
    "chunk_kinds": """WITH c AS (SELECT DISTINCT chunk_id, coalesce(chunk_kind, 'text') AS kind, CASE WHEN trim(coalesce(text, ''), ' ') = '' THEN 0 ELSE greatest(1, floor(length(text) / 4)) END AS t FROM document_chunks)
      SELECT kind, count(*) AS n_chunks, CAST(sum(t) AS BIGINT) AS tokens, CAST(max(t) AS INT) AS longest FROM c GROUP BY 1""",
    "query_dedup": "SELECT lower(trim(query_text, ' ')) AS q, min(run_id) AS first_run, count(DISTINCT run_id) AS n_runs FROM runs WHERE query_text IS NOT NULL AND run_id IS NOT NULL GROUP BY 1",
    "masked_secrets": r"""WITH m AS (SELECT doc_id, text, regexp_replace(text, '(?i)\b(api[_-]?key|token|password|secret|authorization)("?\s*[:=]\s*"?)([^\s",;]+)', '\1\2***', 'g') AS m FROM documents WHERE text IS NOT NULL) SELECT doc_id, md5(m) AS h, m <> text AS masked FROM m""",
    "source_overlap": """WITH a AS (SELECT DISTINCT source AS f FROM run_items WHERE source IS NOT NULL AND source <> ''), b AS (SELECT DISTINCT replace(source_path, chr(92), '/') AS f FROM document_chunks WHERE source_path IS NOT NULL)
      SELECT CASE WHEN a.f IS NULL THEN 'chunks' WHEN b.f IS NULL THEN 'items' ELSE 'both' END AS side, count(*) AS n FROM a FULL JOIN b ON a.f = b.f GROUP BY 1""",
}
