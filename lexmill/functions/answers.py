"""Model answers as columns: wrappers, reasoning, citations, grounding, flash cards."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tokens that must stand in the sources word by word.
CVE, HANDLE = r"(?i)CVE-\d{4}-\d+", r"@[A-Za-z0-9_]{3,}"
DATE = r"\b\d{1,2}[.\-/]\d{1,2}[.\-/]\d{2,4}\b|\b\d{4}-\d{2}-\d{2}\b"
COMPOUND = r"\b[A-Za-z0-9]+(?:[._\-/@][A-Za-z0-9]+)+\b"
# What a model repeats of its instructions instead of an answer, how a refusal and loud thinking begin.
TEMPLATES = r"(?i)^(?:MARKDOWN_REPORT|JSON_OBJECT|JSON_ARRAY_HERE|YOUR\s+ANSWER\s+HERE)$"
CONCLUSION = r"(?i)(?:conclusion|summary|список уязвимост|итог|result):?\s*\n+([\s\S]{50,})"
REFUSAL = "В источниках блокнота нет ответа на этот вопрос."
THINKING = [
    "thinking process", "internal monologue", "let me (think|analyze|check)", "the user (is asking|wants|asked|request)", r"step \d", r"first,?\s+I", "analyzing the", "i need to (look|check|find|extract|analyze)",
    "looking at the (provided|text|data)", r"ok,?\s+so", r"wait,?\s+(let me|I)", "let's (start|begin|check|look)",
]
NOTHING = ["НЕТ", "НЕТ.", "NONE", "N/A"]
LOUD_THINKING = [
    "пользователь просит", "пользователь спрашивает", "пользователь хочет", "я должен", "мне нужно проанализировать", "проанализирую источник", "просмотрю источник", "рассмотрю источник", "давайте проанализируем",
    "the user asks", "the user wants", "the user is asking", "let me analyze", "i need to analyze", "i should analyze", "i will analyze",
]
ANALYTICAL = [
    "портрет", "проанализир", "анализ", "охарактеризу", "характеристик", "сводк", "обзор", "резюмиру", "резюме", "суммир", "итог", "выжимк", "как устроен", "как работает", "что вообще", "что происходил", "чем занимает",
    "все упоминани", "всех упоминани", "все случаи", "весь контекст", "по всем", "перечисл", "перечень", "список", "какие все", "какие есть", "все связ", "полная картина", "общая картина", "динамик", "тенденц", "паттерн",
    "стиль обще", "стиль работ", "как взаимодейств", "как общаться", "чего нельзя", "profile", "analyze", "analysis", "summariz", "summary", "overview", "everything about", "all mentions", "characteriz", "how does", "patterns",
]
FACTOID = r"^\s*(сколько|когда|где|какой айпи|во сколько|how many|when did|what time)(?![\p{L}\p{N}_])"


def without_thinking(text: Column) -> Column:
    """Answer without closed or open-ended reasoning blocks."""
    closed = F.regexp_replace(text, r"(?is)<think(?:ing)?>.*?</think(?:ing)?>", "")
    return F.trim(F.regexp_replace(closed, r"(?is)<think(?:ing)?>.*$", ""))


def results_body(text: Column) -> Column:
    """What an answer says: the text between results tags, else JSON or a fence as it is, else a short answer.

    A repeated template, an answer that begins with loud thinking, and a long one without
    tags are empty; of the last, what follows a heading of conclusions is kept.
    """
    t = without_thinking(F.coalesce(text, F.lit("")))
    tagged = t.rlike(r"(?is)<results>.*</results>")
    inner = F.trim(F.regexp_extract(t, r"(?is)<results>\s*(.*?)\s*</results>", 1))
    saved = F.trim(F.regexp_extract(t, CONCLUSION, 1))
    return (
        F.when(tagged, F.when(inner.rlike(TEMPLATES), "").otherwise(inner))
        .when(t.rlike("(?i)^(" + "|".join(THINKING) + ")"), "")
        .when(t.rlike(r"^[{\[]|^```"), t)
        .when(F.length(t) > 500, saved)
        .otherwise(t)
    )


def loud_thinking(text: Column) -> Column:
    """Whether an answer begins by talking about the task instead of answering it."""
    head = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    return F.exists(F.array(*map(F.lit, LOUD_THINKING)), lambda m: F.startswith(head, m))


def is_refusal(text: Column) -> Column:
    """Whether an answer is the refusal and little else."""
    even = F.lower(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " ")))
    return F.contains(even, F.lit(REFUSAL.lower())) & (F.length(even) < len(REFUSAL) + 40)


def is_analytical(question: Column) -> Column:
    """Whether a question asks to sum up many passages; those that begin by asking for one fact don't."""
    low = F.lower(F.trim(F.coalesce(question, F.lit(""))))
    return ~low.rlike(FACTOID) & F.exists(F.array(*map(F.lit, ANALYTICAL)), lambda m: F.contains(low, m))


def map_note(text: Column) -> Column:
    """A batch's note, or empty if it says that nothing was found."""
    note = F.trim(F.coalesce(text, F.lit("")))
    even = F.upper(F.regexp_replace(note, r"\s+", " "))
    return F.when(even.isin(NOTHING) | F.startswith(even, F.lit(NOTHING[0] + " ")), "").otherwise(note)


def json_object(text: Column) -> Column:
    """JSON object of an answer, code fences removed, or null."""
    t = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?m)^```\w*\s*$", ""))
    body = F.regexp_extract(t, r"(?s)\{.*\}", 0)
    return F.when(F.get_json_object(body, "$").isNotNull() & body.startswith("{"), body)


def verifiable_tokens(text: Column) -> Column:
    """Distinct tokens of an answer that must be found in its sources: identifiers with a letter, handles and dates of four letters or more.

    Citation marks are no tokens; the first spelling of each stays.
    """
    t = F.regexp_replace(F.coalesce(text, F.lit("")), r"\[\d+\]", " ")
    named = F.filter(F.regexp_extract_all(t, F.lit(COMPOUND), F.lit(0)), lambda x: x.rlike(r"\p{L}"))
    found = F.filter(F.concat(*[F.regexp_extract_all(t, F.lit(p), F.lit(0)) for p in (CVE, HANDLE, DATE)], named), lambda x: F.length(x) >= 4)
    low = F.transform(found, F.lower)
    return F.filter(found, lambda x, i: F.array_position(low, F.lower(x)) == i + 1)


def _even(text: Column) -> Column:
    return F.lower(F.regexp_replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("/")), r"\s+", " "))


def plain_date(token: Column) -> Column:
    """A date as year-month-day; day-first dates with dots, dashes or slashes too, two digits of a year from 2000 on."""
    iso, day_first = r"^(\d{4})-(\d{1,2})-(\d{1,2})$", r"^(\d{1,2})[.\-/](\d{1,2})[.\-/](\d{2,4})$"
    part = lambda p, i: F.regexp_extract(token, p, i).try_cast("int")
    year = part(day_first, 3)
    return F.when(token.rlike(iso), F.concat_ws("-", part(iso, 1), part(iso, 2), part(iso, 3))).when(token.rlike(day_first), F.concat_ws("-", F.when(year < 100, year + 2000).otherwise(year), part(day_first, 2), part(day_first, 1)))


def ungrounded(answer: Column, source: Column) -> Column:
    """Verifiable tokens of the answer that the source lacks; slashes, case, spaces and the form of dates don't matter."""
    hay = _even(source)
    dates = F.transform(F.regexp_extract_all(F.coalesce(source, F.lit("")), F.lit(DATE), F.lit(0)), plain_date)
    there = lambda t: F.contains(hay, _even(t)) | F.coalesce(F.array_contains(dates, plain_date(t)), F.lit(False))
    return F.filter(verifiable_tokens(answer), lambda t: ~there(t))


def caveat(answer: Column, missing: Column, shown: int = 6) -> Column:
    """Answer with a note on tokens that weren't found, at most ``shown`` of them."""
    note = F.concat(F.lit("\n\nNot found in the sources: "), F.array_join(F.slice(missing, 1, shown), ", "), F.when(F.size(missing) > shown, " …").otherwise(""))
    return F.when(F.size(missing) > 0, F.concat(answer, note)).otherwise(answer)


CARDS = "array<struct<front:string,q:string,question:string,back:string,a:string,answer:string>>"


def flash_cards(text: Column) -> Column:
    """Cards (``front``, ``back``) of a model's JSON list, in a fence or between other words; those without a side are left out."""
    t = F.coalesce(text, F.lit(""))
    fenced = F.regexp_extract(t, r"(?s)```(?:json)?\s*(.*?)```", 1)
    body = F.regexp_extract(F.when(fenced != "", fenced).otherwise(t), r"(?s)\[.*\]", 0)
    side = lambda c, names: F.coalesce(*[F.when(F.trim(c[n]) != "", F.trim(c[n])) for n in names])
    cards = F.transform(F.coalesce(F.from_json(body, CARDS), F.array().cast(CARDS)), lambda c: F.struct(side(c, ("front", "q", "question")).alias("front"), side(c, ("back", "a", "answer")).alias("back")))
    return F.filter(cards, lambda c: c["front"].isNotNull() & c["back"].isNotNull())


def rerank_order(answer: Column, n: Column) -> Column:
    """Zero-based places named by a reranker's answer (one-based, valid and unique)."""
    named = F.transform(F.regexp_extract_all(answer, F.lit(r"\d+"), F.lit(0)), lambda x: x.cast("int") - 1)
    return F.array_distinct(F.filter(named, lambda i: (i >= 0) & (i < n)))
