"""Scalar text functions as column expressions (no Python per row)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Token pattern and stop words of the lexical index.
TOKEN = r"[0-9a-zа-яё][0-9a-zа-яё._\-/@]*"
STOP = ["the", "and", "for", "with", "from", "this", "that", "по", "на", "из", "при", "или", "как", "это", "для"]
# Entity patterns (the id pattern is checked for a digit afterwards).
ENTITIES = {
    "email": r"\b[\w.+-]+@[\w-]+\.[\w.-]+\b",
    "url": r"\bhttps?://[^\s)]+",
    "ip": r"\b\d{1,3}(?:\.\d{1,3}){3}\b",
    "id": r"\b[A-Za-z]\w*(?:-\w+){1,5}\b",
    "number": r"\b\d[\d.,]{2,}\b",
    "date": r"\b\d{4}-\d{2}-\d{2}\b|\b\d{2}\.\d{2}\.\d{4}\b",
}
# Service header tags at the start of chunk lines.
HEADER_LINE = r"^\s*\[(FILE_PATH|FILE_PART|CHUNK_INDEX|FILE_TITLE|FILE_LABELS|FILE_FORMAT|SOURCE_URL|SOURCE_TITLE|VISION_FILE|Файл)\b"
# Intents in order of priority with their cues.
INTENTS = {
    "compare": ["сравн", "сравнен", "diff", "различ", "разниц", "было стало", "было/стало", "что изменил", "по сравнению", "versus", " vs ", "сопостав"],
    "classify": ["классифиц", "категориз", "по типам", "по категори", "сгруппируй по тип", "таксоном", "classify", "categor", "разбей на", "распредели по"],
    "count": ["сколько", "количеств", "посчитай", "подсчитай", "count", "статистик", "распределен", "how many", "breakdown", "по числу", "частот"],
    "prioritize": ["приорит", "что важн", "в первую очередь", "самые", "наиболее", "top", "топ", "ранжир", "rank", "prioriti", "важнейш", "ключев"],
    "explain": ["почему", "причин", "объясни", "как работает", "как устроен", "explain", "why", "обоснуй", "root cause", "первопричин"],
    "extract": ["извлеки", "собери", "вытащи", "выпиши", "найди все", "перечисл", "список", "extract", "collect", "list all", "выгрузи", "достань", "все упоминан"],
    "filter": ["только", "лишь", "исключ", "где ", "where", "фильтр", "отбери", "с услови", "содержащие", "у которых"],
    "summarize": ["кратко", "резюме", "summary", "обзор", "вкратце", "summarize", "саммари", "tl;dr", "общая картина", "overview", "о чём", "суть"],
}


def tokenize(text: Column) -> Column:
    """Lower-case tokens that keep ``. _ - / @`` inside, of two letters or more, without stop words."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))
    return F.filter(found, lambda t: (F.length(t) >= 2) & ~t.isin(STOP))


def count_tokens(text: Column) -> Column:
    """Offline estimate of tokens: a quarter of the characters, at least one; blank texts have none."""
    return F.when(F.trim(F.coalesce(text, F.lit(""))) == "", 0).otherwise(F.greatest(F.lit(1), F.floor(F.length(text) / 4))).cast("int")


def entity_list(text: Column, kind: str) -> Column:
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(ENTITIES[kind]), F.lit(0))
    return F.filter(found, lambda e: e.rlike(r"\d")) if kind == "id" else found


def entities(text: Column, kinds: tuple[str, ...] = ("email", "id", "date"), most: int = 8) -> Column:
    """Distinct entities in order of kind and place, at most ``most``."""
    return F.slice(F.array_distinct(F.concat(*[entity_list(text, k) for k in kinds])), 1, most)


def query_language(text: Column) -> Column:
    return F.when(F.coalesce(text, F.lit("")).rlike("[А-Яа-яЁё]"), "ru").otherwise("en")


def intents(text: Column) -> Column:
    """Intents found by their cues in order of priority; ``analyze`` if none is."""
    low = F.lower(F.coalesce(text, F.lit("")))
    hits = F.array(*[F.when(_any([low.contains(c) for c in cues]), name) for name, cues in INTENTS.items()])
    found = F.array_compact(hits)
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("analyze")))


def _any(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


def strip_headers(text: Column) -> Column:
    """Text without its service header lines."""
    return F.array_join(F.filter(F.split(text, "\n"), lambda x: ~x.rlike(HEADER_LINE)), "\n")


def content_hash(text: Column) -> Column:
    return F.sha2(F.trim(F.coalesce(text, F.lit(""))), 256)


def chunk_id(path: Column, index: Column, text: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws(":", path, index.cast("string"), F.substring(text, 1, 200)), 256), 1, 24)


def mask_secrets(text: Column) -> Column:
    """Values of keys, tokens and passwords replaced by ``***``."""
    return F.regexp_replace(text, r"(?i)\b(api[_-]?key|token|password|secret|authorization)(\"?\s*[:=]\s*\"?)([^\s\",;]+)", "$1$2***")


def markdown_to_plain(text: Column) -> Column:
    """Markdown without fences, emphasis, heading marks, bullets and link targets."""
    t = F.regexp_replace(text, r"(?m)^```.*$", "")
    t = F.regexp_replace(t, r"!?\[([^\]]*)\]\([^)]*\)", "$1")
    t = F.regexp_replace(t, r"(?m)^\s{0,3}#{1,6}\s+", "")
    t = F.regexp_replace(t, r"(?m)^\s*[-*+]\s+", "• ")
    return F.trim(F.regexp_replace(t, r"(\*\*|__|`)", ""))


def labels_from_path(path: Column, most: int = 6) -> Column:
    """Folder names of a path, at most ``most`` of the last."""
    parts = F.filter(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), lambda p: (p != "") & (p != ".") & ~p.rlike("^[A-Za-z]:$"))
    folders = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    return F.when(F.size(folders) > most, F.slice(folders, -most, most)).otherwise(folders)
