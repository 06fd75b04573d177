"""Findings of MAP results: parsing, normalising, facets, merging and roll-up from file to corpus."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions.answers import json_object, results_body
from lexmill.functions.text import entities
from lexmill.session import materialise

# Keys that name each facet, the first filled one counts.
FACETS = {
    "item": ["item", "point", "claim", "name", "title"],
    "category": ["category", "type", "kind", "class"],
    "level": ["level", "severity", "importance", "priority"],
    "value": ["value", "amount", "count", "metric"],
    "source": ["source", "asset", "host", "file"],
}
TEXTS = ["explanation", "observation", "context", "rationale", "reason"]
DOWNGRADED = " [severity downgraded: critical/high requires file+quote evidence]"
#: Schema of a model's result; findings may also stand under ``items`` or ``records``.
RECORD = "struct<finding_id:string," + ",".join(f"{k}:string" for k in [*dict.fromkeys(k for ks in FACETS.values() for k in ks), *TEXTS]) + ",fields:map<string,string>,evidence_refs:array<struct<file:string,chunk:string,quote:string>>>"
RESULT = f"struct<file:string,source:string,query_alignment:string,no_relevant_data:boolean,findings:array<{RECORD}>,items:array<{RECORD}>,records:array<{RECORD}>,recommendations:array<string>>"


def squeeze(c: Column) -> Column:
    return F.lower(F.trim(F.coalesce(c, F.lit(""))))


def filled(c: Column) -> Column:
    """The trimmed text, or null if it is blank."""
    return F.when(F.trim(c) != "", F.trim(c))


def has_evidence(refs: Column) -> Column:
    """Whether a reference names both a quote and a file."""
    return F.exists(F.coalesce(refs, F.array()), lambda r: (F.trim(F.coalesce(r["quote"], F.lit(""))) != "") & (F.trim(F.coalesce(r["file"], F.lit(""))) != ""))


def once(items: Column, key) -> Column:
    """Items of an array, the first of each key."""
    keys = F.transform(items, key)
    return F.filter(items, lambda x, i: F.array_position(keys, key(x)) == i + 1)


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join in which null keys meet; the right side's keys are dropped."""
    renamed = right.select(*[F.col(c).alias(f"_r_{c}") if c in keys else F.col(c) for c in right.columns])
    return left.join(renamed, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys], how).drop(*[f"_r_{k}" for k in keys])


def parse_results(answers: DataFrame, answer: str = "answer") -> DataFrame:
    """``answers`` with a struct ``result`` of each model's answer; null if that holds no JSON object.

    Its findings stand under ``findings``, wherever the model put them. Done in steps,
    as each is used several times by the next.
    """
    df = answers.withColumn("_text", results_body(F.col(answer))).withColumn("_body", json_object(F.col("_text"))).withColumn("_parsed", F.from_json("_body", RESULT))
    some = lambda c: F.when(F.size(F.col(f"_parsed.{c}")) > 0, F.col(f"_parsed.{c}"))
    df = df.withColumn("_found", F.filter(F.coalesce(some("findings"), some("items"), some("records"), F.col("_parsed.findings"), F.array().cast(f"array<{RECORD}>")), lambda f: f.isNotNull()))
    whole = F.struct(*[F.col(f"_parsed.{c}").alias(c) for c in ("file", "source", "query_alignment", "no_relevant_data")], F.col("_found").alias("findings"), F.col("_parsed.recommendations").alias("recommendations"))
    return df.withColumn("result", F.when(F.col("_body").isNotNull(), whole)).drop("_text", "_body", "_parsed", "_found")


def downgrade(finding: Column) -> Column:
    """Critical and high findings without a quoted file become medium, with a note."""
    weak = squeeze(finding["severity"]).isin("critical", "high") & ~has_evidence(finding["evidence_refs"])
    marked = finding.withField("severity", F.lit("medium")).withField("explanation", F.concat(F.coalesce(finding["explanation"], F.lit("")), F.lit(DOWNGRADED)))
    return F.when(weak, marked).otherwise(finding)


def evidence_key(r: Column) -> Column:
    return F.array(squeeze(r["file"]), squeeze(r["chunk"]), F.lower(F.substring(F.trim(F.coalesce(r["quote"], F.lit(""))), 1, 40)))


def record_key(f: Column) -> Column:
    return F.array(squeeze(f["severity"]), squeeze(f["type"]), F.trim(F.lower(F.substring(F.coalesce(f["explanation"], F.lit("")), 1, 80))))


def normalise(parsed: DataFrame, chunk_text: str, most: int | None = None, file_first: bool = False) -> DataFrame:
    """``parsed`` with its ``result`` brought in order: weak findings downgraded, repeated evidence and findings dropped, the chunk's own file named.

    The file of the chunk's header (column ``chunk_text``) replaces what the model named,
    in the result and its evidence. By default that comes last, so a quote without file is
    weak even though the file is known; ``file_first`` puts it first. ``most`` limits the
    findings of one chunk.
    """
    df = parsed.withColumn("_path", filled(F.regexp_extract(F.coalesce(chunk_text, F.lit("")), r"(?i)\[FILE_PATH:\s*(.+?)\]", 1))).withColumn("_found", F.col("result.findings"))
    path = F.col("_path")
    placed = lambda f: f.withField("evidence_refs", F.transform(f["evidence_refs"], lambda r: r.withField("file", F.coalesce(path, r["file"]))))
    steps = [
        lambda c: F.transform(c, downgrade),
        lambda c: F.transform(c, lambda f: f.withField("evidence_refs", once(F.filter(F.coalesce(f["evidence_refs"], F.array()), lambda r: r.isNotNull()), evidence_key))),
        lambda c: once(c, record_key),
        *([lambda c: F.slice(c, 1, most)] if most is not None else []),
    ]
    place = [lambda c: F.transform(c, placed)]
    for step in place + steps if file_first else steps + place:
        df = df.withColumn("_found", step(F.col("_found")))
    whole = F.struct(F.coalesce(path, F.col("result.file")).alias("file"), *[F.col(f"result.{c}").alias(c) for c in ("source", "query_alignment", "no_relevant_data")], F.col("_found").alias("findings"), F.col("result.recommendations").alias("recommendations"))
    return df.withColumn("result", F.when(F.col("result").isNotNull(), whole)).drop("_path", "_found")


def exploded(parsed: DataFrame, *columns: str) -> DataFrame:
    """A row per finding ``f`` of ``result`` with its ``pos``, beside some columns.

    An outer explode: the filter that Spark infers for a plain one would be pushed below
    the steps of the chain and repeat them all.
    """
    rows = parsed.select(*columns, F.col("result.file").alias("file"), F.posexplode_outer("result.findings").alias("pos", "f"))
    return rows.filter("pos is not null")


def relevant_only(parsed: DataFrame, group: str) -> DataFrame:
    """Rows (``result`` struct) worth merging: unparsed ones and those with findings; all of a group where none is."""
    keep = F.coalesce(F.col("result").isNull() | (~F.coalesce("result.no_relevant_data", F.lit(False)) & (F.size("result.findings") > 0)), F.lit(False))
    some = parsed.groupBy(group).agg(F.max(keep).alias("_some"))
    return null_safe_join(parsed.withColumn("_keep", keep), some, [group]).filter("_keep or not _some").drop("_keep", "_some")


def results(map_sample: DataFrame) -> DataFrame:
    """Each result once."""
    return map_sample.dropDuplicates(["result_id"])


def findings(map_sample: DataFrame) -> DataFrame:
    """A row per finding with its position; ungrounded critical and high ones are downgraded to medium."""
    rows = results(map_sample).select("result_id", "job_id", "chunk_index", "file", "no_relevant_data", F.posexplode("findings").alias("pos", "f")).filter("f is not null")
    severity = squeeze(F.col("f.severity"))
    grounded = has_evidence(F.col("f.evidence_refs"))
    level = F.when(severity.isin("critical", "high") & ~grounded, "medium").otherwise(severity)
    return rows.select(
        "result_id", "job_id", "chunk_index", F.coalesce(filled(F.col("file")), F.lit("unknown")).alias("file"), "pos", "f.finding_id", level.alias("severity"), squeeze(F.col("f.finding_type")).alias("finding_type"),
        F.trim(F.coalesce(F.col("f.explanation"), F.lit(""))).alias("explanation"), "f.fields_json", grounded.alias("grounded"), F.size(F.coalesce("f.evidence_refs", F.array())).alias("n_refs"), F.col("f.evidence_refs").alias("refs"),
    )


def finding_key(letters: int = 80) -> list[Column]:
    return [F.col("severity"), F.col("finding_type"), F.lower(F.substring("explanation", 1, letters))]


def facets(found: DataFrame) -> DataFrame:
    """Facets of each finding: item, category, level, source, value and entities.

    The finding's own keys go before those of its fields; a source is looked for in its
    keys, then in its evidence, then in the result.
    """
    fields = F.from_json("fields_json", "map<string,string>")
    own = {"type": F.col("finding_type"), "severity": F.col("severity")}

    def first(names: Sequence[str]) -> list[Column]:
        return [filled(F.coalesce(filled(own[k]), fields[k]) if k in own else fields[k]) for k in names]

    named = F.filter(F.transform(F.coalesce("refs", F.array()), lambda r: F.trim(F.coalesce(r["file"], F.lit("")))), lambda f: f != "")
    quotes = F.array_join(F.transform(F.coalesce("refs", F.array()), lambda r: F.coalesce(r["quote"], F.lit(""))), " ")
    text = F.concat_ws(" ", "explanation", F.coalesce("fields_json", F.lit("")), quotes)
    item = F.coalesce(*first(FACETS["item"]), F.substring(F.coalesce(filled(F.col("explanation")), *first(TEXTS[1:]), F.lit("")), 1, 80))
    source = F.coalesce(*first(FACETS["source"]), F.get(named, 0), F.col("file"))
    return found.select(
        "finding_id", "job_id", "result_id", "pos", F.trim(F.lower(item)).alias("item"), F.lower(F.coalesce(*first(FACETS["category"]), F.lit(""))).alias("category"), F.lower(F.coalesce(*first(FACETS["level"]), F.lit(""))).alias("level"),
        source.alias("source"), F.coalesce(*first(FACETS["value"]), F.lit("")).alias("value"), entities(text).alias("entities"),
    )


def first_of(df: DataFrame, keys: list[Column], order: list[str]) -> DataFrame:
    """The first row of each key by ``order`` (hash-aggregated, so a hot key isn't one task)."""
    named = [k.alias(f"_k{i}") for i, k in enumerate(keys)]
    whole = F.struct(*[F.col(c) for c in order], *[F.col(c) for c in df.columns if c not in order])
    return df.select(*named, whole.alias("_row")).groupBy(*[f"_k{i}" for i in range(len(keys))]).agg(F.min("_row").alias("_row")).select("_row.*")


def unique_records(faceted: DataFrame, keys: Sequence[str] = ("category", "item")) -> DataFrame:
    """The first record of each job with the same ``keys``."""
    as_text = [F.array_join(k, ",") if dict(faceted.dtypes)[k].startswith("array") else F.col(k) for k in keys]
    return first_of(faceted, [F.col("job_id"), *as_text], ["result_id", "pos"])


def categorize(faceted: DataFrame, axis: str = "category", keys: Sequence[str] = ("category", "item")) -> DataFrame:
    """Unique records per job by ``keys``, counted along an axis; each value of a list counts for itself."""
    total = faceted.groupBy("job_id").agg(F.count(F.lit(1)).alias("n_total"))
    value = F.explode(axis) if dict(faceted.dtypes)[axis].startswith("array") else F.col(axis)
    counted = unique_records(faceted, keys).select("job_id", value.alias("value")).groupBy("job_id", "value").agg(F.count(F.lit(1)).alias("n_unique"))
    return null_safe_join(counted, total, ["job_id"]).select("job_id", "value", "n_unique", "n_total")


def summary(faceted: DataFrame, top: int = 15) -> DataFrame:
    """Text block of each job: totals and its most frequent categories (ties by name)."""
    unique = unique_records(faceted)
    sourced = unique.groupBy("job_id").agg(F.count(F.lit(1)).alias("unique"), F.count(F.when(F.col("source") != "", 1)).alias("sourced"))
    sizes = null_safe_join(faceted.groupBy("job_id").agg(F.count(F.lit(1)).alias("total")), sourced, ["job_id"])
    counts = unique.filter("category <> ''").groupBy("job_id", "category").agg(F.count(F.lit(1)).alias("n"))
    # at most a row per category of a job is gathered, of which the first few are kept
    best = counts.groupBy("job_id").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "category"))), 1, top).alias("best"))
    lines = F.transform(F.coalesce("best", F.array()), lambda b: F.concat(F.lit("- "), b["category"], F.lit(": "), (-b["n"]).cast("string")))
    head = F.concat(F.lit("Records: "), F.col("total"), F.lit(", unique: "), F.col("unique"), F.lit(", with source: "), F.col("sourced"))
    return null_safe_join(sizes, best, ["job_id"], "left").select("job_id", F.array_join(F.concat(F.array(head), lines), "\n").alias("summary"))


def parent_of(file: Column) -> Column:
    """Folder of a file; those without one lie in ``/``."""
    path = F.replace(file, F.lit("\\"), F.lit("/"))
    return F.when(path.contains("/"), F.coalesce(filled(F.regexp_replace(path, "/+[^/]*$", "")), F.lit("/"))).otherwise(F.lit("/"))


def rollup(map_sample: DataFrame) -> DataFrame:
    """Findings merged by file, directory and corpus of each job.

    A finding is known by severity, type and the first 80 letters of its explanation;
    each level is merged from the files. ``n_children`` counts the results of a file and
    the files of a directory or corpus, ``n_with_findings`` those of them with findings.
    ``nothing`` says that no result below was relevant and nothing was found.
    """
    files = results(map_sample).groupBy("job_id", F.coalesce(filled(F.col("file")), F.lit("unknown")).alias("file")).agg(
        F.count(F.lit(1)).alias("n_results"), F.count(F.when(F.size(F.filter(F.coalesce("findings", F.array()), lambda f: f.isNotNull())) > 0, 1)).alias("n_filled"), F.max(~F.coalesce("no_relevant_data", F.lit(False))).alias("relevant")
    )
    files = materialise(files, "rollup-files")
    found = materialise(findings(map_sample).select("job_id", "file", *[k.alias(n) for k, n in zip(finding_key(), ("severity", "finding_type", "head"), strict=True)]).distinct(), "rollup-findings")
    out = None
    for level, node in (("file", F.col("file")), ("directory", parent_of(F.col("file"))), ("corpus", F.lit(""))):
        children = F.sum("n_results") if level == "file" else F.count(F.lit(1))
        with_findings = F.sum("n_filled") if level == "file" else F.count(F.when(F.col("n_filled") > 0, 1))
        nodes = files.groupBy("job_id", node.alias("node")).agg(children.cast("bigint").alias("n_children"), with_findings.cast("bigint").alias("n_with_findings"), F.max("relevant").alias("relevant"))
        merged = found.select("job_id", node.alias("node"), "severity", "finding_type", "head").distinct()
        counted = merged.groupBy("job_id", "node").agg(F.count(F.lit(1)).alias("n_findings"), F.count(F.when(F.col("severity").isin("critical", "high"), 1)).alias("n_severe"))
        n = F.coalesce("n_findings", F.lit(0))
        part = null_safe_join(nodes, counted, ["job_id", "node"], "left").select(
            "job_id", F.lit(level).alias("level"), "node", n.alias("n_findings"), F.coalesce("n_severe", F.lit(0)).alias("n_severe"), "n_children", "n_with_findings", ((n == 0) if level == "corpus" else (~F.col("relevant") & (n == 0))).alias("nothing")
        )
        out = part if out is None else out.unionByName(part)
    return out
