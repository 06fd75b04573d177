"""Renderings of rows as text: citations, headers, summaries of pages, tab-separated rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexmill.functions.answers import results_body
from lexmill.functions.text import labels_from_path, strip_headers

# Prefixes of texts for embedding models that were trained with them.
TASK_PREFIXES = {"document": "search_document: ", "query": "search_query: "}


def _path_parts(path: Column) -> Column:
    return F.filter(F.split(F.replace(F.coalesce(path, F.lit("")), F.lit("\\"), F.lit("/")), "/"), lambda p: p != "")


def display_name(path: Column, title: Column) -> Column:
    """Last two parts of a path, and the title if they don't hold it, at most 80 letters."""
    parts = _path_parts(path)
    base = F.when(F.size(parts) == 0, "source").otherwise(F.array_join(F.slice(parts, F.greatest(F.size(parts) - 1, F.lit(1)), 2), "/"))
    t = F.trim(F.coalesce(title, F.lit("")))
    return F.substring(F.when((t != "") & ~F.contains(F.lower(base), F.lower(t)), F.concat(base, F.lit(" — "), t)).otherwise(base), 1, 80)


def locator(page: Column, line: Column) -> Column:
    """Page, else line, of a passage; empty if neither is known."""
    return F.when(page > 0, F.concat(F.lit("p. "), page)).when(line > 0, F.concat(F.lit("line "), line)).otherwise("")


def quote(text: Column, letters: int = 320) -> Column:
    """Passage without service lines, cut to ``letters`` with a mark."""
    t = F.regexp_replace(strip_headers(F.coalesce(text, F.lit(""))), r"^\s+|\s+$", "")
    return F.when(F.length(t) > letters, F.concat(F.regexp_replace(F.substring(t, 1, letters), r"\s+$", ""), F.lit("…"))).otherwise(t)


def header(path: Column, title: Column, labels: Column, form: Column, index: Column) -> Column:
    """Service lines at the start of a chunk: path and number, then title, labels and format as far as known."""
    tag = lambda name, v: F.when(F.coalesce(v, F.lit("")) != "", F.concat(F.lit(f"[{name}: "), v, F.lit("]")))
    more = F.concat_ws("", tag("FILE_TITLE", title), tag("FILE_LABELS", labels), tag("FILE_FORMAT", form))
    first = F.concat(F.lit("[FILE_PATH: "), F.coalesce(path, F.lit("unknown")), F.lit("][CHUNK_INDEX: "), index + 1, F.lit("]"))
    return F.concat_ws("\n", first, F.when(more != "", more))


def page_labels(path: Column) -> Column:
    return F.array_join(F.array_distinct(F.filter(labels_from_path(path), lambda p: F.length(p) > 1)), ", ")


def page_summary(markdown: Column, letters: int = 120) -> Column:
    """First line that is no heading and no table row, without its bullet, cut to ``letters``."""
    lines = F.transform(F.split(F.coalesce(markdown, F.lit("")), r"\r?\n"), lambda x: F.trim(x))
    told = F.filter(lines, lambda x: ~x.startswith("#") & ~x.startswith("|"))
    first = F.coalesce(F.get(F.filter(F.transform(told, lambda x: F.trim(F.regexp_replace(x, r"^[-*]+", ""))), lambda x: x != ""), 0), F.lit(""))
    return F.when(F.length(first) > letters, F.concat(F.rtrim(F.substring(first, 1, letters)), F.lit("…"))).otherwise(first)


def for_embedding(text: Column, model: str, task: str | None) -> Column:
    """Text without service lines, with the task's prefix if the model wants one."""
    plain = strip_headers(F.coalesce(text, F.lit("")))
    prefix = TASK_PREFIXES.get(task or "", "") if "nomic" in model.lower() else ""
    return F.concat(F.lit(prefix), plain)


def tsv(columns: list[Column]) -> Column:
    """Row as tab-separated text; nulls are empty."""
    return F.concat_ws("\t", *[F.coalesce(c.cast("string"), F.lit("")) for c in columns])


def table_answer(answer: Column) -> Column:
    """Rows (maps by header) of a model's table: a JSON list, else lines of cells parted by bars; rows of another width are left out."""
    body = results_body(answer)
    plain = F.regexp_replace(F.regexp_replace(body, r"(?m)^```\w*\s*$", ""), r"^\s+|\s+$", "")
    lines = F.filter(F.transform(F.split(plain, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    cells = lambda x: F.transform(F.split(x, r"\|"), lambda c: F.trim(c))
    head = F.transform(F.slice(lines, 1, 1), cells)[0]
    rest = F.filter(F.transform(F.slice(lines, 2, 1 << 30), cells), lambda c: F.size(c) == F.size(head))
    by_line = F.transform(rest, lambda c: F.map_from_arrays(head, c))
    return F.when(plain.startswith("["), F.from_json(plain, "array<map<string,string>>")).when(F.size(lines) > 0, by_line).otherwise(F.array().cast("array<map<string,string>>"))


def unit_line(n: Column, text: Column, is_neighbour: Column, letters: int = 1100) -> Column:
    """Numbered passage of a batch; neighbours are marked, long ones cut."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", "")
    cut = F.when(F.length(t) > letters, F.concat(F.substring(t, 1, letters), F.lit("…"))).otherwise(t)
    return F.concat(F.lit("["), n.cast("string"), F.lit("]"), F.when(is_neighbour, " (context) ").otherwise(" "), cut)


def plan_summary(plan: Column) -> Column:
    """A query plan (struct of ``query_plan.plan``) on one line."""
    entities = F.aggregate(F.map_values(plan["entities"]), F.lit(0), lambda a, v: a + F.size(v))
    return F.concat_ws(
        " ",
        F.concat(F.lit("intent="), plan["intent"]),
        F.concat(F.lit("out="), plan["style"]),
        F.concat(F.lit("group_by="), plan["group_by"], F.lit("->"), plan["axis"]),
        F.concat(F.lit("fields="), F.array_join(plan["fields"], ",")),
        F.when(F.size(plan["key_terms"]) > 0, F.concat(F.lit("terms="), F.array_join(F.slice(plan["key_terms"], 1, 6), ","))),
        F.when(entities > 0, F.concat(F.lit("entities="), entities)),
    )


def card_sheet(cards: Column) -> Column:
    """Cards (``front``, ``back``) as a Markdown sheet."""
    one = F.transform(cards, lambda c, i: F.concat(F.lit("**"), i + 1, F.lit(". "), c["front"], F.lit("**\n\n"), c["back"], F.lit("\n")))
    return F.concat(F.lit("# Flash cards\n\n"), F.array_join(one, "\n"))


def markdown_table(rows: Column) -> Column:
    """Rows (arrays of cells) as a Markdown table, the first one its head; bars are escaped, short rows padded."""
    width = F.array_max(F.transform(rows, lambda r: F.size(r)))
    cell = lambda c: F.regexp_replace(F.replace(F.coalesce(c, F.lit("")), F.lit("|"), F.lit("\\|")), r"\s*\n\s*", " ")
    line = lambda r: F.concat(F.lit("| "), F.array_join(F.concat(F.transform(r, cell), F.array_repeat(F.lit(""), width - F.size(r))), " | "), F.lit(" |"))
    rule = F.concat(F.lit("|"), F.repeat(F.lit("---|"), width))
    lines = F.transform(rows, line)
    return F.when(F.size(rows) > 0, F.array_join(F.concat(F.slice(lines, 1, 1), F.array(rule), F.slice(lines, 2, 1 << 30)), "\n")).otherwise("")
