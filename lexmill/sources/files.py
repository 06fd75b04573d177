"""Files as documents: decoding, routing, archives, HTML, search results, delimiters."""

from __future__ import annotations

import gzip
import io
import re
import tarfile
import zipfile
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import parse_qs, unquote, urlparse

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Folders never entered, noise elements of a page, encodings tried in turn.
SKIPPED = r"(^|/)(\.[^/]+|__pycache__|node_modules|venv)(/|$)"
NOISE = {"script", "style", "noscript", "nav", "header", "footer", "aside", "form", "iframe", "svg", "button", "template"}
UNSHOWN = {"script", "style", "noscript", "template", "svg"}
# Suffixes of files that are read.
SUFFIXES = [
    "txt", "md", "rst", "log", "csv", "tsv", "json", "jsonl", "ndjson", "xml", "html", "htm", "yaml", "yml", "toml", "ini", "cfg", "conf", "properties", "env", "sql", "py", "js", "ts", "tsx", "jsx", "java", "kt", "go", "rs", "c", "h",
    "cpp", "hpp", "cs", "rb", "php", "swift", "scala", "sh", "bat", "ps1", "css", "scss", "tex", "zip", "tar", "tgz", "gz",
]
ENCODINGS = ["utf-8-sig", "cp1251", "cp1252", "latin-1"]
VOID = {"br", "img", "input", "meta", "link", "hr", "area", "base", "col", "source", "wbr"}
BLOCKS = {"p", "div", "br", "li", "h1", "h2", "h3", "h4", "h5", "h6", "tr", "section", "article", "main", "title", "ul", "ol", "table", "blockquote", "pre"}


def decode(raw: bytes) -> str:
    """Text of bytes: UTF-16 by its mark, else the first encoding that fits."""
    if raw[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return raw.decode("utf-16", "replace")
    for e in ENCODINGS[:-1]:
        try:
            return raw.decode(e)
        except UnicodeDecodeError:
            continue
    return raw.decode(ENCODINGS[-1])


def is_binary(raw: bytes) -> bool:
    """A zero byte, or too few printable characters in the first 8 KiB."""
    head = raw[:8192]
    if head[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return False
    if b"\0" in head:
        return True
    t = decode(head)
    return bool(t) and sum(c.isprintable() or c in "\r\n\t\f" for c in t) < 0.65 * len(t)


def delimiter(head: str) -> str:
    """Most frequent of tab, semicolon and comma in the first 4096 letters; ties in this order."""
    return max("\t;,", key=lambda d: head[:4096].count(d))


class _Page(HTMLParser):
    def __init__(self):
        super().__init__()
        self.title, self.stack, self.parts = "", [], {"article": [], "main": [], "body": []}

    def handle_starttag(self, tag, attrs):
        if tag in BLOCKS:
            self._add("\n")
        if tag not in VOID:
            self.stack.append("main" if dict(attrs).get("role") == "main" else tag)

    def handle_endtag(self, tag):
        if tag in BLOCKS:
            self._add("\n")
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i] == tag or (self.stack[i] == "main" and tag in ("div", "main", "section")):
                del self.stack[i:]
                break

    def _add(self, s):
        if NOISE.isdisjoint(self.stack) and "title" not in self.stack:
            for k in self.parts:
                if k == "body" or k in self.stack:
                    self.parts[k].append(s)

    def handle_data(self, data):
        if "title" in self.stack and not self.title:
            self.title = data.strip()
        self._add(re.sub(r"\s+", " ", data))


def page_text(html: str | None) -> tuple[str, str]:
    """Title and main text of a page: its article, else main part, else body, without noise elements."""
    p = _Page()
    p.feed(html or "")
    for k in ("article", "main", "body"):
        lines = [x.strip() for x in "".join(p.parts[k]).split("\n")]
        text = re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip()
        if text:
            return p.title, text
    return p.title, ""


class _Whole(HTMLParser):
    """Title, first headline and all text but that of scripts and drawings."""

    def __init__(self):
        super().__init__()
        self.title, self.headline, self.stack, self.parts = "", "", [], []

    def handle_starttag(self, tag, attrs):
        if tag in BLOCKS:
            self.parts.append("\n")
        if tag not in VOID:
            self.stack.append(tag)

    def handle_endtag(self, tag):
        if tag in BLOCKS:
            self.parts.append("\n")
        if tag in self.stack:
            del self.stack[len(self.stack) - 1 - self.stack[::-1].index(tag) :]

    def handle_data(self, data):
        if "title" in self.stack:
            self.title = self.title or data.strip()
        elif UNSHOWN.isdisjoint(self.stack):
            if "h1" in self.stack:
                self.headline = self.headline or data.strip()
            self.parts.append(re.sub(r"\s+", " ", data))


def whole_text(html: str | None) -> tuple[str, str]:
    """Title (or first headline) and the whole text of a page, menus included."""
    p = _Whole()
    p.feed(html or "")
    lines = [x.strip() for x in "".join(p.parts).split("\n")]
    return p.title or p.headline, re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip()


def unwrap(link: str) -> str:
    """Target of a redirect link of a result page."""
    target = parse_qs(urlparse(link).query).get("uddg")
    return unquote(target[0]) if target else ("https:" + link if link.startswith("//") else link)


def search_results(html: str, most: int = 10) -> list[tuple[str, str]]:
    """(url, title) of result links, each url once."""
    seen: dict[str, str] = {}
    for attrs, inner in re.findall(r"<a\b([^>]*)>(.*?)</a>", html or "", re.S):
        href = re.search(r'href="([^"]+)"', attrs)
        if href and "result__a" in attrs:
            url = unwrap(href[1].replace("&amp;", "&"))
            if url.startswith("http"):
                seen.setdefault(url, " ".join(re.sub(r"<[^>]+>", " ", inner).split()))
    return list(seen.items())[:most]


class TooLarge(ValueError):
    """An archive that unpacks to more than its budget."""


def _inside(p: str) -> bool:
    return not p.startswith(("/", "\\")) and ".." not in re.split(r"[/\\]", p) and ":" not in p[:2]


def unpack(name: str, raw: bytes, budget: int = 8 << 30, depth: int = 3) -> Iterator[tuple[str, bytes]]:
    """Files of an archive one by one, of nested ones too.

    Entries that lead outside, links and devices are left out; what goes beyond ``budget``
    unpacked bytes raises TooLarge when it is reached.
    """
    left = [budget]

    def bounded(stream) -> bytes:
        data = stream.read(left[0] + 1)
        left[0] -= len(data)
        if left[0] < 0:
            raise TooLarge(f"{name} unpacks to more than {budget} bytes")
        return data

    def inner(p: str, data: bytes) -> Iterator[tuple[str, bytes]]:
        if depth > 1 and p.lower().endswith((".zip", ".tar", ".tgz", ".tar.gz", ".gz")):
            yield from unpack(p, data, left[0], depth - 1)
        else:
            yield p, data

    low = name.lower()
    if low.endswith(".zip"):
        with zipfile.ZipFile(io.BytesIO(raw)) as z:
            for i in z.infolist():
                if not i.is_dir() and _inside(i.filename) and (i.external_attr >> 28) != 0xA:
                    with z.open(i) as f:
                        yield from inner(f"{name}/{i.filename}", bounded(f))
    elif low.endswith((".tar", ".tgz", ".tar.gz")):
        with tarfile.open(fileobj=io.BytesIO(raw)) as t:
            for m in t:
                if m.isfile() and _inside(m.name):
                    yield from inner(f"{name}/{m.name}", bounded(t.extractfile(m)))
    elif low.endswith(".gz"):
        yield from inner(name[:-3], bounded(gzip.GzipFile(fileobj=io.BytesIO(raw))))
    else:
        yield name, raw


def below(path: Column, roots: list[str]) -> Column:
    """The part of a file's path below the longest of the given roots that it begins with."""
    plain = F.regexp_replace(path, "^[a-z0-9]+:/*(?=/)", "")
    out = plain
    for root in sorted((re.sub("^[a-z0-9]+:/*(?=/)", "", r).rstrip("/") for r in roots), key=len):
        out = F.when(F.startswith(plain, F.lit(root + "/")), F.substring(plain, len(root) + 2, 1 << 30)).otherwise(out)
    return out


def read_documents(spark: SparkSession, paths: str | list[str], suffixes: list[str] | None = None) -> DataFrame:
    """``source_path, kind, text, error`` of all files below ``paths``, archives unpacked.

    Kind is html, table, record, binary or text by name and content; the text of binary
    files is null. Folders below a path that are hidden or hold tools are skipped, as are
    suffixes not in ``suffixes`` (by default SUFFIXES). A file or archive that can't be
    read gives a row of kind ``error``, those unpacked before it stay.
    """
    roots = [paths] if isinstance(paths, str) else list(paths)
    allowed = "|".join(map(re.escape, suffixes or SUFFIXES))
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(roots)
    raw = raw.filter(~below(F.col("path"), roots).rlike(SKIPPED) & F.lower("path").rlike(rf"\.({allowed})$"))

    def rows_of(path: str, content: bytes) -> Iterator[tuple[str, str, str | None, str | None]]:
        try:
            for p, data in unpack(path, content):
                kind = p.lower().rpartition(".")[2]
                if is_binary(data):
                    yield p, "binary", None, None
                elif kind in ("html", "htm"):
                    yield p, "html", page_text(decode(data))[1], None
                else:
                    yield p, "table" if kind in ("csv", "tsv") else "record" if kind in ("json", "jsonl", "ndjson", "xml") else "text", decode(data), None
        except (TooLarge, OSError, EOFError, zlib.error, zipfile.BadZipFile, tarfile.TarError) as e:
            yield path, "error", None, f"{type(e).__name__}: {e}"[:500]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                for row in rows_of(path, content):  # one file at a time
                    yield pa.RecordBatch.from_arrays([pa.array([c], pa.string()) for c in row], names=["source_path", "kind", "text", "error"])

    return raw.select("path", "content").mapInArrow(apply, "source_path string, kind string, text string, error string")


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """Delimited table with header; delimiter and encoding by the head of its first file, malformed lines dropped."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).orderBy("path").select(F.substring("content", 1, 1 << 16).alias("head")).limit(1).collect()
    raw = bytes(files[0]["head"]) if files else b""
    encoding = "utf-8"
    try:
        raw.decode("utf-8")
    except UnicodeDecodeError as e:  # a letter cut at the end of the head is no sign of another encoding
        if len(raw) < 1 << 16 or e.start <= len(raw) - 4:
            encoding = "utf-16" if raw[:2] in (b"\xff\xfe", b"\xfe\xff") else "cp1251"
    head = raw.decode(encoding, "replace").lstrip("\ufeff")
    # a one-byte charset is read as Latin-1, which keeps its bytes, and its letters are put in afterwards
    as_read = "iso-8859-1" if encoding == "cp1251" else encoding
    df = spark.read.csv(path, sep=delimiter(head), header=True, inferSchema=True, mode="DROPMALFORMED", encoding=as_read)
    if encoding != "cp1251":
        return df
    seen, meant = "".join(map(chr, range(128, 256))), bytes(range(128, 256)).decode("cp1251", "replace")
    real = str.maketrans(seen, meant)
    return df.select(*[(F.translate(F.col(f"`{c}`"), seen, meant) if t == "string" else F.col(f"`{c}`")).alias(c.translate(real)) for c, t in df.dtypes])


def read_json_table(spark: SparkSession, path: str) -> DataFrame:
    """JSON list or object as a table: nested objects as dotted columns, a list of plain values as ``value``, one object as one row."""
    df = spark.read.json(path, multiLine=True)
    if not [c for c in df.columns if c != "_corrupt_record"]:
        return spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "array<string>")).alias("value"))

    def leaves(schema, prefix: list[str]) -> list[list[str]]:
        return [x for f in schema.fields for x in (leaves(f.dataType, [*prefix, f.name]) if f.dataType.typeName() == "struct" else [[*prefix, f.name]])]

    quoted = lambda parts: ".".join(f"`{p}`" for p in parts)
    return df.select(*[F.col(quoted(p)).alias(".".join(p)) for p in leaves(df.schema, [])])


# Names of file formats.
FORMATS = {
    "docx": "DOCX document", "doc": "DOC document", "pdf": "PDF document", "odt": "ODT document", "epub": "EPUB document", "rtf": "RTF document", "md": "Markdown", "txt": "plain text", "log": "log file", "rst": "reStructuredText",
    "html": "HTML document", "htm": "HTML document", "csv": "CSV table", "xlsx": "Excel table", "xls": "Excel table", "json": "JSON data", "yaml": "YAML data", "yml": "YAML data", "toml": "TOML config", "ini": "INI config", "cfg": "config file",
    "properties": "properties file", "py": "Python source", "js": "JavaScript source", "ts": "TypeScript source", "tsx": "TypeScript/React source", "java": "Java source", "kt": "Kotlin source", "go": "Go source", "rs": "Rust source", "sql": "SQL file",
    "sh": "shell script", "bat": "batch script", "ps1": "PowerShell script", "xml": "XML data", "zip": "ZIP archive", "tar": "TAR archive",
}


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(F.replace(path, F.lit("\\"), F.lit("/")), r"[^/]\.([^./]+)$", 1))


def format_name(path: Column) -> Column:
    """Name of a file's format by its suffix."""
    s = suffix(path)
    known = F.element_at(F.create_map(*[x for k, v in FORMATS.items() for x in (F.lit(k), F.lit(v))]), s)
    return F.coalesce(known, F.when(s != "", F.concat(F.upper(s), F.lit(" file"))), F.lit("file"))


def file_title(path: Column, text: Column) -> Column:
    """Title of a file from its first 4096 letters: heading, first line, page title, first columns or comment; else its name."""
    head, s = F.substring(F.coalesce(text, F.lit("")), 1, 4096), suffix(path)
    stem = F.regexp_replace(F.regexp_extract(F.replace(path, F.lit("\\"), F.lit("/")), r"([^/]+?)(\.[^./]+)?$", 1), "[_-]", " ")
    line = F.regexp_extract(head, r"(?m)^[ \t]*(\S.*?)\s*$", 1)
    plain = F.when(line.startswith("#"), F.regexp_replace(line, r"^#+\s*", "")).otherwise(F.substring(line, 1, 120))
    tagged = lambda t: F.substring(F.trim(F.regexp_extract(head, rf"(?i)<{t}[^>]*>([^<]+)</{t}>", 1)), 1, 120)
    page = F.when(tagged("title") != "", tagged("title")).otherwise(tagged("h1"))
    first = F.regexp_extract(head, r"^([^\n]*)", 1)
    times = lambda c: F.length(first) - F.length(F.replace(first, F.lit(c), F.lit("")))
    cells = F.when(times(";") > times(","), F.split(first, ";")).otherwise(F.split(first, ","))
    columns = F.array_join(F.slice(F.filter(F.transform(cells, lambda c: F.regexp_replace(F.trim(c), '^"+|"+$', "")), lambda c: c != ""), 1, 5), ", ")
    comment = F.regexp_extract(head, r"(?m)^\s*(?:\"{3}|'{3}|//|#|/\*|\*)[\"'\s/*#]*([^\"'\s/*#].{10,}?)\s*$", 1)
    found = F.when(s.isin("md", "rst", "txt", "log"), plain).when(s.isin("html", "htm"), page).when(s == "csv", columns).when(s.isin("py", "js", "ts", "tsx", "java", "kt", "go", "rs", "sql"), F.substring(comment, 1, 120)).otherwise("")
    return F.substring(F.when(F.trim(found) != "", found).otherwise(stem), 1, 200)
