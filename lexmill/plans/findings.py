"""Registered queries on MAP results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexmill.operators import findings as K
from lexmill.operators.report import job_reports
from lexmill.session import table


def _found(spark: SparkSession, root: str) -> DataFrame:
    return K.findings(table(spark, root, "map_sample"))


def map_findings(spark, root):
    """Findings with downgraded severity."""
    return _found(spark, root).select("finding_id", "result_id", "pos", "severity", "finding_type", "explanation", "grounded", "n_refs")


def map_facets(spark, root):
    """Facets of each finding (A2)."""
    return K.facets(_found(spark, root)).select("finding_id", "item", "category", "level", "source", "value", F.array_join("entities", ",").alias("entities"))


def map_categorize(spark, root):
    """Unique records per job and category (A3, A4)."""
    return K.categorize(K.facets(_found(spark, root)))


def map_top_categories(spark, root):
    """Fifteen most frequent categories of all unique records; ties by name."""
    per = K.categorize(K.facets(_found(spark, root))).groupBy("value").agg(F.sum("n_unique").alias("n"))
    return per.orderBy(F.desc("n"), "value").limit(15)


def map_merge(spark, root):
    """Distinct findings of each job in order of first appearance."""
    found = _found(spark, root).select("job_id", "result_id", "pos", "severity", "finding_type", "explanation", "finding_id")
    return K.first_of(found, [F.col("job_id"), *K.finding_key()], ["result_id", "pos", "finding_id"]).select("job_id", "finding_id", "severity", "finding_type", "explanation")


def map_answers(spark, root):
    """Findings of models' answers after the whole chain: unwrapped, parsed, downgraded, deduplicated, with the chunk's file.

    The answers are written from map_sample: in result tags, fenced or plain, with
    findings under one of three names; the chunk's header names the file.
    """
    rows = K.results(table(spark, root, "map_sample"))
    finding = lambda f: F.struct(f["finding_id"].alias("finding_id"), f["severity"].alias("severity"), f["finding_type"].alias("type"), f["explanation"].alias("explanation"), F.from_json(f["fields_json"], "map<string,string>").alias("fields"), f["evidence_refs"].alias("evidence_refs"))
    found = F.transform(F.filter("findings", lambda f: f.isNotNull()), finding)
    kind = F.pmod("result_id", F.lit(3))
    body = F.to_json(F.struct("query_alignment", "no_relevant_data", *[F.when(kind == i, found).alias(name) for i, name in enumerate(("findings", "items", "records"))], "recommendations"))
    answer = F.when(kind == 0, F.concat(F.lit("<think>So.</think><results>\n"), body, F.lit("\n</results>"))).when(kind == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).otherwise(body)
    chunk = F.concat(F.lit("[FILE_PATH: "), F.coalesce(K.filled(F.col("file")), F.lit("unknown")), F.lit("]\ntext"))
    done = K.normalise(K.parse_results(rows.select("result_id", answer.alias("answer"), chunk.alias("chunk"))), "chunk")
    return K.exploded(done, "result_id").select(
        "result_id", "file", "pos", "f.finding_id", "f.severity", F.md5(F.coalesce("f.explanation", F.lit(""))).alias("h"), F.size("f.evidence_refs").alias("n_refs"), F.size(F.filter("f.evidence_refs", lambda r: r["file"] == F.col("file"))).alias("n_placed")
    )


def map_relevant(spark, root):
    """Results worth merging: those with findings, all of a job that has none (P10)."""
    rows = K.results(table(spark, root, "map_sample")).select("job_id", "result_id", F.struct("no_relevant_data", F.filter(F.coalesce("findings", F.array()), lambda f: f.isNotNull()).alias("findings")).alias("result"))
    return K.relevant_only(rows, "job_id").select("job_id", "result_id")


def map_axis_counts(spark, root):
    """Unique records per job by source and item, counted by level and by each entity (A3, A4)."""
    f = K.facets(_found(spark, root))
    parts = [K.categorize(f, axis, ("source", "item")).select(F.lit(axis).alias("axis"), "job_id", "value", "n_unique", "n_total") for axis in ("level", "entities")]
    return parts[0].unionByName(parts[1])


def map_summary(spark, root):
    """Text block of totals and the most frequent categories of each job (A5)."""
    return K.summary(K.facets(_found(spark, root)))


def map_report_findings(spark, root):
    """Findings of the fallback report: distinct by type, severity and the first 60 letters."""
    found = _found(spark, root).select("job_id", "result_id", "pos", "severity", "finding_type", "explanation", "finding_id")
    return K.first_of(found, [F.col("job_id"), *K.finding_key(60)], ["result_id", "pos", "finding_id"]).select("job_id", "finding_id")


def map_reports(spark, root):
    """Report of each job written by rule: numbers, gravest findings, evidence, actions."""
    return job_reports(table(spark, root, "map_sample"))


def map_rollup(spark, root):
    """File, directory and corpus roll-up."""
    return K.rollup(table(spark, root, "map_sample"))


def map_recommendations(spark, root):
    """Distinct trimmed recommendations of each job, with place of first appearance."""
    rows = K.results(table(spark, root, "map_sample")).select("job_id", "result_id", F.posexplode("recommendations").alias("pos", "r"))
    return rows.select("job_id", F.trim("r").alias("recommendation"), F.struct("result_id", "pos").alias("place")).filter("recommendation <> ''").groupBy("job_id", "recommendation").agg(F.min("place").alias("p")).select("job_id", "recommendation", F.col("p.result_id").alias("first_result"), F.col("p.pos").alias("first_pos"))


def map_metrics(spark, root):
    """Relevant chunks, findings and evidence of each job."""
    rows = K.results(table(spark, root, "map_sample"))
    refs = F.aggregate(F.coalesce("findings", F.array()), F.lit(0), lambda a, f: a + F.size(F.filter(F.coalesce(f["evidence_refs"], F.array()), lambda r: (F.coalesce(r["quote"], F.lit("")) != "") | (F.coalesce(r["file"], F.lit("")) != ""))))
    n = F.size(F.filter(F.coalesce("findings", F.array()), lambda f: f.isNotNull()))
    relevant = ~F.coalesce("no_relevant_data", F.lit(False)) & (n > 0)
    return rows.groupBy("job_id").agg(F.count(F.lit(1)).alias("n_chunks"), F.count(F.when(relevant, 1)).alias("n_relevant"), F.sum(n).cast("bigint").alias("n_findings"), F.sum(refs).cast("bigint").alias("n_refs"))


def map_by_file(spark, root):
    """Results and findings by file."""
    rows = K.results(table(spark, root, "map_sample"))
    file = F.coalesce(F.when(F.trim("file") != "", F.trim("file")), F.lit("unknown"))
    return rows.groupBy(file.alias("file")).agg(F.count(F.lit(1)).alias("n_results"), F.sum(F.size(F.coalesce("findings", F.array()))).cast("bigint").alias("n_findings"))


def map_fallback_merge(spark, root):
    """Deterministic merge of each job's results: first alignment, any relevance, findings of each result once, distinct recommendations (A10)."""
    rows = K.results(table(spark, root, "map_sample"))
    text = F.when(F.trim("query_alignment") != "", F.struct("result_id", F.trim("query_alignment").alias("q")))
    merged = rows.groupBy("job_id").agg(F.min(text).alias("m"), F.max(~F.coalesce("no_relevant_data", F.lit(False))).alias("any_relevant"), F.count(F.lit(1)).alias("n")).select("job_id", F.col("m.q").alias("query_alignment"), "any_relevant", "n")
    once = _found(spark, root).select("job_id", "result_id", *[k.alias(f"k{i}") for i, k in enumerate(K.finding_key())]).distinct().groupBy("job_id").agg(F.count(F.lit(1)).alias("n_findings"))
    advice = map_recommendations(spark, root).groupBy("job_id").agg(F.count(F.lit(1)).alias("n_recommendations"))
    out = K.null_safe_join(K.null_safe_join(merged, once, ["job_id"], "left"), advice, ["job_id"], "left")
    return out.fillna(0, ["n_findings", "n_recommendations"])


def map_top_evidence(spark, root):
    """First forty evidence rows of each job, quotes cut to 120 letters."""
    rows = _found(spark, root).select("job_id", "result_id", "pos", F.posexplode("refs").alias("ref_pos", "r")).filter("r is not null and trim(coalesce(r.quote, '')) <> ''")
    n = F.row_number().over(Window.partitionBy("job_id").orderBy("result_id", "pos", "ref_pos"))
    return rows.withColumn("n", n).filter("n <= 40").select("job_id", "n", "result_id", F.trim("r.file").alias("file"), F.substring("r.quote", 1, 120).alias("quote"))


def map_evidence_dedup(spark, root):
    """Distinct evidence of each job by file, chunk and the first 40 letters of the quote."""
    rows = _found(spark, root).select("job_id", F.explode("refs").alias("r")).filter("r is not null")
    key = [K.squeeze(F.col("r.file")).alias("file"), K.squeeze(F.col("r.chunk")).alias("chunk"), F.lower(F.substring(F.trim(F.coalesce("r.quote", F.lit(""))), 1, 40)).alias("quote")]
    return rows.select("job_id", *key).groupBy("job_id", "file", "chunk", "quote").agg(F.count(F.lit(1)).alias("n"))


def map_dual_pick(spark, root):
    """Of two neighbouring results of a job, the one with more evidenced findings; ties to the first."""
    rows = K.results(table(spark, root, "map_sample")).filter("job_id is not null and chunk_index is not null")
    grounded = F.size(F.filter(F.coalesce("findings", F.array()), lambda f: K.has_evidence(f["evidence_refs"])))
    pair = rows.select("job_id", F.floor(F.col("chunk_index") / 2).cast("bigint").alias("pair"), F.struct((-grounded).alias("g"), "chunk_index", "result_id").alias("s"))
    return pair.groupBy("job_id", "pair").agg(F.min("s").alias("s")).select("job_id", "pair", F.col("s.result_id").alias("picked"), (-F.col("s.g")).cast("bigint").alias("n_evidenced"))


_RES = "res AS (SELECT * FROM map_sample QUALIFY row_number() OVER (PARTITION BY result_id) = 1)"
_GROUND = "len(list_filter(coalesce(f.evidence_refs, []), lambda r: trim(coalesce(r.quote, '')) <> '' AND trim(coalesce(r.file, '')) <> '')) > 0"
_F = f"""WITH {_RES}, ex AS (SELECT result_id, job_id, chunk_index, file, unnest(findings) AS f, generate_subscripts(findings, 1) - 1 AS pos FROM res),
fnd AS (SELECT result_id, job_id, chunk_index, coalesce(nullif(trim(file), ''), 'unknown') AS file, pos, f.finding_id AS finding_id,
  CASE WHEN lower(trim(coalesce(f.severity, ''))) IN ('critical', 'high') AND NOT ({_GROUND}) THEN 'medium' ELSE lower(trim(coalesce(f.severity, ''))) END AS severity,
  lower(trim(coalesce(f.finding_type, ''))) AS finding_type, trim(coalesce(f.explanation, ''), ' ') AS explanation, f.fields_json AS fields_json, {_GROUND} AS grounded,
  len(coalesce(f.evidence_refs, [])) AS n_refs, f.evidence_refs AS refs FROM ex WHERE f IS NOT NULL)"""


def _cell(x):
    return rf"regexp_replace(replace(coalesce({x}, ''), '|', '\|'), '\s+', ' ', 'g')"


def _js(*names):
    """First filled value of the fields; finding_type and severity are the finding's own."""
    own = {"type": "nullif(finding_type, '')", "severity": "nullif(severity, '')"}
    field = lambda k: f"nullif(trim(json_extract_string(fields_json, '$.{k}'), ' '), '')"
    return ", ".join(f"{own[k]}, {field(k)}" if k in own else field(k) for k in names)


_ENT = "list_concat(list_concat(regexp_extract_all(t, '\\b[\\w.+-]+@[\\w-]+\\.[\\w.-]+\\b'), list_filter(regexp_extract_all(t, '(?:^|[^\\pL\\pN_])([A-Za-z]\\w*(?:-\\w+){1,5})', 1), lambda e: regexp_matches(e, '\\d'))), regexp_extract_all(t, '\\b\\d{4}-\\d{2}-\\d{2}\\b|\\b\\d{2}\\.\\d{2}\\.\\d{4}\\b'))"
_FAC = _F + f""", ft AS (SELECT *, explanation || ' ' || coalesce(fields_json, '') || ' ' || array_to_string(list_transform(coalesce(refs, []), lambda r: coalesce(r.quote, '')), ' ') AS t,
  list_filter(list_transform(coalesce(refs, []), lambda r: trim(coalesce(r.file, ''), ' ')), lambda x: x <> '') AS named FROM fnd),
fac AS (SELECT finding_id, job_id, result_id, pos, trim(lower(coalesce({_js('item', 'point', 'claim', 'name', 'title')}, left(coalesce(nullif(explanation, ''), {_js('observation', 'context', 'rationale', 'reason')}, ''), 80))), ' ') AS item,
  lower(coalesce({_js('category', 'type', 'kind', 'class')}, '')) AS category, lower(coalesce({_js('level', 'severity', 'importance', 'priority')}, '')) AS level, coalesce({_js('source', 'asset', 'host', 'file')}, named[1], file) AS source,
  coalesce({_js('value', 'amount', 'count', 'metric')}, '') AS value, {_ENT} AS ents FROM ft)"""
_DISTINCT = "list_slice(list_filter(list_transform(ents, lambda e, i: CASE WHEN list_position(ents, e) = i THEN e END), lambda e: e IS NOT NULL), 1, 8)"
_CAT = _FAC + """, tot AS (SELECT job_id, count(*) AS n_total FROM fac GROUP BY 1), u AS (SELECT DISTINCT job_id, category, item FROM fac),
cat AS (SELECT u.job_id, u.category AS value, count(*) AS n_unique, any_value(n_total) AS n_total FROM u JOIN tot USING (job_id) GROUP BY 1, 2)"""
_FAC_SRC = _FAC + f""", fs AS (SELECT *, {_DISTINCT} AS entities FROM fac), u AS (SELECT * FROM fs QUALIFY row_number() OVER (PARTITION BY job_id, source, item ORDER BY result_id, pos) = 1), tot AS (SELECT job_id, count(*) AS n_total FROM fs GROUP BY 1)"""
_LEVEL = "job_id, severity, finding_type, lower(left(explanation, 80)) AS head"

QUERIES = {f.__name__: f for f in (map_findings, map_facets, map_categorize, map_top_categories, map_merge, map_answers, map_relevant, map_axis_counts, map_summary, map_report_findings, map_reports, map_rollup, map_recommendations, map_metrics, map_by_file, map_fallback_merge, map_top_evidence, map_evidence_dedup, map_dual_pick)}
SQL = {
    "map_findings": _F + " SELECT finding_id, result_id, pos, severity, finding_type, explanation, grounded, n_refs FROM fnd",
    "map_facets": _FAC + f" SELECT finding_id, item, category, level, source, value, array_to_string({_DISTINCT}, ',') AS entities FROM fac",
    "map_categorize": _CAT + " SELECT * FROM cat",
    "map_top_categories": _CAT + " SELECT value, sum(n_unique) AS n FROM cat GROUP BY 1 ORDER BY n DESC, value LIMIT 15",
    "map_merge": _F + " SELECT job_id, finding_id, severity, finding_type, explanation FROM fnd QUALIFY row_number() OVER (PARTITION BY job_id, severity, finding_type, lower(left(explanation, 80)) ORDER BY result_id, pos, finding_id) = 1",
    "map_rollup": _F + f""", fl AS (SELECT DISTINCT job_id, file, severity, finding_type, lower(left(explanation, 80)) AS head FROM fnd),
      rf AS (SELECT job_id, coalesce(nullif(trim(file), ''), 'unknown') AS file, count(*) AS n_results, count(*) FILTER (len(list_filter(coalesce(findings, []), lambda f: f IS NOT NULL)) > 0) AS n_filled, bool_or(NOT coalesce(no_relevant_data, false)) AS relevant FROM res GROUP BY 1, 2),
      par AS (SELECT DISTINCT file, CASE WHEN contains(file, '/') THEN coalesce(nullif(trim(regexp_replace(file, '/+[^/]*$', ''), ' '), ''), '/') ELSE '/' END AS dir FROM (SELECT replace(file, chr(92), '/') AS f2, file FROM rf)),
      nodes AS (SELECT job_id, 'file' AS level, file AS node, n_results AS n_children, n_filled AS n_with_findings, relevant FROM rf
        UNION ALL SELECT job_id, 'directory', dir, count(*), count(*) FILTER (n_filled > 0), bool_or(relevant) FROM rf JOIN par USING (file) GROUP BY 1, 3 UNION ALL SELECT job_id, 'corpus', '', count(*), count(*) FILTER (n_filled > 0), bool_or(relevant) FROM rf GROUP BY 1),
      a AS (SELECT DISTINCT job_id, 'file' AS level, file AS node, severity, finding_type, head FROM fl UNION ALL SELECT DISTINCT job_id, 'directory', dir, severity, finding_type, head FROM fl JOIN par USING (file) UNION ALL SELECT DISTINCT job_id, 'corpus', '', severity, finding_type, head FROM fl),
      c AS (SELECT job_id, level, node, count(*) AS n, count(*) FILTER (severity IN ('critical', 'high')) AS severe FROM a GROUP BY 1, 2, 3)
      SELECT nodes.job_id, nodes.level, nodes.node, coalesce(n, 0) AS n_findings, coalesce(severe, 0) AS n_severe, CAST(n_children AS BIGINT) AS n_children, CAST(n_with_findings AS BIGINT) AS n_with_findings,
        CASE WHEN nodes.level = 'corpus' THEN coalesce(n, 0) = 0 ELSE NOT relevant AND coalesce(n, 0) = 0 END AS nothing FROM nodes LEFT JOIN c ON c.job_id IS NOT DISTINCT FROM nodes.job_id AND c.level = nodes.level AND c.node = nodes.node""",
    "map_answers": f"""WITH {_RES}, ex AS (SELECT result_id, coalesce(nullif(trim(file, ' '), ''), 'unknown') AS file, unnest(list_filter(findings, lambda f: f IS NOT NULL)) AS f, generate_subscripts(list_filter(findings, lambda f: f IS NOT NULL), 1) AS i FROM res),
      d AS (SELECT *, lower(trim(coalesce(f.severity, ''), ' ')) IN ('critical', 'high') AND NOT ({_GROUND}) AS weak FROM ex),
      n AS (SELECT result_id, file, i, f.finding_id AS finding_id, CASE WHEN weak THEN 'medium' ELSE f.severity END AS severity, coalesce(f.explanation, '') || CASE WHEN weak THEN ' [severity downgraded: critical/high requires file+quote evidence]' ELSE '' END AS explanation, f.finding_type AS type,
        len(list_distinct(list_transform(list_filter(coalesce(f.evidence_refs, []), lambda r: r IS NOT NULL), lambda r: [lower(trim(coalesce(r.file, ''), ' ')), lower(trim(coalesce(r.chunk, ''), ' ')), lower(left(trim(coalesce(r.quote, ''), ' '), 40))]))) AS n_refs FROM d),
      o AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY result_id, lower(trim(coalesce(severity, ''), ' ')), lower(trim(coalesce(type, ''), ' ')), trim(lower(left(explanation, 80)), ' ') ORDER BY i) = 1)
      SELECT result_id, file, row_number() OVER (PARTITION BY result_id ORDER BY i) - 1 AS pos, finding_id, severity, md5(explanation) AS h, n_refs, n_refs AS n_placed FROM o""",
    "map_relevant": f"""WITH {_RES}, k AS (SELECT job_id, result_id, NOT coalesce(no_relevant_data, false) AND len(list_filter(coalesce(findings, []), lambda f: f IS NOT NULL)) > 0 AS keep FROM res)
      SELECT job_id, result_id FROM k QUALIFY keep OR NOT bool_or(keep) OVER (PARTITION BY job_id)""",
    "map_axis_counts": _FAC_SRC + """ SELECT 'level' AS axis, u.job_id, level AS value, count(*) AS n_unique, any_value(n_total) AS n_total FROM u JOIN tot USING (job_id) GROUP BY 1, 2, 3
      UNION ALL SELECT 'entities', e.job_id, e.value, count(*), any_value(n_total) FROM (SELECT job_id, unnest(entities) AS value FROM u) e JOIN tot USING (job_id) GROUP BY 1, 2, 3""",
    "map_summary": _FAC + """, u AS (SELECT * FROM fac QUALIFY row_number() OVER (PARTITION BY job_id, category, item ORDER BY result_id, pos) = 1), s AS (SELECT job_id, count(*) AS total FROM fac GROUP BY 1),
      v AS (SELECT job_id, count(*) AS uniq, count(*) FILTER (source <> '') AS sourced FROM u GROUP BY 1), c AS (SELECT job_id, category, count(*) AS n FROM u WHERE category <> '' GROUP BY 1, 2),
      t AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY n DESC, category) <= 15), l AS (SELECT job_id, string_agg('- ' || category || ': ' || n, chr(10) ORDER BY n DESC, category) AS x FROM t GROUP BY 1)
      SELECT s.job_id, 'Records: ' || total || ', unique: ' || uniq || ', with source: ' || sourced || coalesce(chr(10) || x, '') AS summary FROM s JOIN v USING (job_id) LEFT JOIN l USING (job_id)""",
    "map_report_findings": _F + " SELECT job_id, finding_id FROM fnd QUALIFY row_number() OVER (PARTITION BY job_id, severity, finding_type, lower(left(explanation, 60)) ORDER BY result_id, pos, finding_id) = 1",
    "map_recommendations": f"""WITH {_RES}, e AS (SELECT job_id, result_id, unnest(recommendations) AS r, generate_subscripts(recommendations, 1) - 1 AS pos FROM res)
      SELECT job_id, trim(r) AS recommendation, result_id AS first_result, pos AS first_pos FROM e WHERE trim(r) <> '' QUALIFY row_number() OVER (PARTITION BY job_id, trim(r) ORDER BY result_id, pos) = 1""",
    "map_metrics": f"""WITH {_RES} SELECT job_id, count(*) AS n_chunks, count(*) FILTER (NOT coalesce(no_relevant_data, false) AND len(list_filter(coalesce(findings, []), lambda f: f IS NOT NULL)) > 0) AS n_relevant,
      CAST(sum(len(list_filter(coalesce(findings, []), lambda f: f IS NOT NULL))) AS BIGINT) AS n_findings,
      CAST(sum(len(list_filter(flatten(list_transform(coalesce(findings, []), lambda f: coalesce(f.evidence_refs, []))), lambda r: coalesce(r.quote, '') <> '' OR coalesce(r.file, '') <> ''))) AS BIGINT) AS n_refs FROM res GROUP BY 1""",
    "map_by_file": f"WITH {_RES} SELECT coalesce(nullif(trim(file), ''), 'unknown') AS file, count(*) AS n_results, CAST(sum(len(coalesce(findings, []))) AS BIGINT) AS n_findings FROM res GROUP BY 1",
    "map_reports": _F + rf""", j AS (SELECT job_id, count(*) AS n_results FROM res GROUP BY 1), o AS (SELECT * FROM fnd QUALIFY row_number() OVER (PARTITION BY job_id, severity, finding_type, lower(left(explanation, 60)) ORDER BY result_id, pos, finding_id) = 1),
      n AS (SELECT job_id, count(*) AS n, count(*) FILTER (severity IN ('critical', 'high')) AS grave FROM o GROUP BY 1),
      e AS (SELECT job_id, result_id, pos, unnest(refs) AS r, generate_subscripts(refs, 1) AS ref FROM o), v AS (SELECT job_id, result_id, unnest(recommendations) AS r, generate_subscripts(recommendations, 1) AS pos FROM res),
      b AS (SELECT job_id, 2 AS section, result_id AS a, pos + 1 AS b, 0 AS c, '- **[' || upper(severity) || ']** `' || finding_type || '`: ' || left({_cell('explanation')}, 200) AS line FROM o
        UNION ALL SELECT job_id, 3, result_id, pos + 1, ref, '| ' || {_cell('r.file')} || ' | ' || {_cell('r.chunk')} || ' | ' || left({_cell('r.quote')}, 80) || ' |' FROM e WHERE r IS NOT NULL
        UNION ALL SELECT job_id, 4, result_id, pos, 0, '- ' || {_cell("trim(r, ' ')")} FROM (SELECT * FROM v WHERE trim(r, ' ') <> '' QUALIFY row_number() OVER (PARTITION BY job_id, trim(r, ' ') ORDER BY result_id, pos) = 1)),
      h(section, line) AS (VALUES (1, '## Executive Summary'), (2, '## Comprehensive Findings'), (3, '## Evidence Matrix'), (4, '## Action Plan')), x(section, line) AS (VALUES (2, 'No data.'), (3, 'No data.'), (4, 'No recommendations.'))
      SELECT job_id, section, -1 AS a, -1 AS b, -1 AS c, line FROM j, h
      UNION ALL SELECT j.job_id, 1, 1, 0, 0, CASE WHEN coalesce(n, 0) > 0 THEN 'Findings: ' || n || ', critical or high: ' || grave || ', passages: ' || n_results ELSE 'No findings.' END FROM j LEFT JOIN n USING (job_id)
      UNION ALL SELECT * FROM b UNION ALL SELECT j.job_id, x.section, 0, 0, 0, x.line FROM j, x WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.job_id = j.job_id AND b.section = x.section)""",
    "map_fallback_merge": _F + """, m AS (SELECT job_id, arg_min(trim(query_alignment), result_id) FILTER (trim(query_alignment) <> '') AS query_alignment, bool_or(NOT coalesce(no_relevant_data, false)) AS any_relevant, count(*) AS n FROM res GROUP BY 1),
      o AS (SELECT job_id, count(*) AS n_findings FROM (SELECT DISTINCT job_id, result_id, severity, finding_type, lower(left(explanation, 80)) FROM fnd) GROUP BY 1),
      r AS (SELECT job_id, count(DISTINCT trim(x)) AS n_recommendations FROM (SELECT job_id, unnest(recommendations) AS x FROM res) WHERE trim(x) <> '' GROUP BY 1)
      SELECT m.*, coalesce(n_findings, 0) AS n_findings, coalesce(n_recommendations, 0) AS n_recommendations FROM m LEFT JOIN o USING (job_id) LEFT JOIN r USING (job_id)""",
    "map_top_evidence": _F + """, e AS (SELECT job_id, result_id, pos, unnest(refs) AS r, generate_subscripts(refs, 1) AS ref_pos FROM fnd)
      SELECT job_id, row_number() OVER (PARTITION BY job_id ORDER BY result_id, pos, ref_pos) AS n, result_id, trim(r.file) AS file, left(r.quote, 120) AS quote FROM e WHERE r IS NOT NULL AND trim(coalesce(r.quote, '')) <> '' QUALIFY n <= 40""",
    "map_evidence_dedup": _F + ", e AS (SELECT job_id, unnest(refs) AS r FROM fnd) SELECT job_id, lower(trim(coalesce(r.file, ''), ' ')) AS file, lower(trim(coalesce(r.chunk, ''), ' ')) AS chunk, lower(left(trim(coalesce(r.quote, ''), ' '), 40)) AS quote, count(*) AS n FROM e WHERE r IS NOT NULL GROUP BY 1, 2, 3, 4",
    "map_dual_pick": f"""WITH {_RES}, g AS (SELECT job_id, CAST(floor(chunk_index / 2) AS BIGINT) AS pair, chunk_index, result_id, len(list_filter(coalesce(findings, []), lambda f: {_GROUND})) AS n FROM res WHERE job_id IS NOT NULL AND chunk_index IS NOT NULL)
      SELECT job_id, pair, result_id AS picked, n AS n_evidenced FROM g QUALIFY row_number() OVER (PARTITION BY job_id, pair ORDER BY n DESC, chunk_index, result_id) = 1""",
}
