"""Results as files: tables, evidence matrices, manifests and a report that needs no model."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.functions.text import markdown_to_plain


def write_table(df: DataFrame, path: str, kind: str = "csv") -> None:
    """Rows as CSV with header, JSON lines or Parquet; arrays and structs as JSON text in CSV."""
    nested = {f.name for f in df.schema.fields if f.dataType.typeName() in ("array", "struct", "map")}
    flat = df.select(*[F.to_json(c).alias(c) if kind == "csv" and c in nested else F.col(c) for c in df.columns])
    writer = flat.write.mode("overwrite")
    writer.csv(path, header=True, escape='"') if kind == "csv" else writer.json(path) if kind == "json" else writer.parquet(path)


def evidence_matrix(reports: DataFrame) -> DataFrame:
    """Table rows of Markdown reports (``id, text``) with three cells or more: ``id, line_no, cells``; rules are left out."""
    rows = reports.filter("text is not null").select("id", F.posexplode(F.split("text", "\n")).alias("line_no", "x")).filter("x like '%|%'")
    cells = F.filter(F.transform(F.split("x", r"(?<!\\)\|"), lambda c: F.trim(c)), lambda c: c != "")
    return rows.select("id", "line_no", cells.alias("cells")).filter((F.size("cells") >= 3) & ~F.col("x").rlike(r"^[\s|:-]+$"))


def markdown_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """A column ``line`` with each row as a Markdown table row; bars are escaped, nulls empty."""
    cell = lambda c: F.regexp_replace(F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")), r"\s*\n\s*", " ")
    return df.select("*", F.concat(F.lit("| "), F.concat_ws(" | ", *map(cell, columns)), F.lit(" |")).alias("line"))


def report(categories: DataFrame, most: int = 15) -> str:
    """Markdown summary of ``value, n_unique, n_total`` counts: totals and the ``most`` most frequent values."""
    counts = categories.groupBy("value").agg(F.sum("n_unique").alias("n"))
    unique = counts.agg(F.sum("n").alias("n")).first().n or 0
    if not unique:
        return ""
    top = counts.orderBy(F.desc("n"), "value").limit(most).collect()
    return "\n".join([f"## Findings: {unique} unique", "", "| Category | Count |", "|---|---|", *[f"| {r.value or '—'} | {r.n} |" for r in top]])


def write_plain(df: DataFrame, column: str, path: str) -> None:
    """Markdown texts of a column as plain text files."""
    df.select(markdown_to_plain(F.col(column)).alias("value")).filter("value is not null").write.mode("overwrite").text(path)
