"""Records from JSON, JSON lines and XML of unknown shape."""

from __future__ import annotations

import json
import xml.etree.ElementTree as ET
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.operators.chunking import packed

# A container of so many scalars is itself a record; deepest level looked at.
RICH, DEEPEST = 6, 10
RECORDS = "source_path string, n int, place string, record map<string,string>"


def _objects(v) -> bool:
    return isinstance(v, list) and any(isinstance(x, dict) for x in v)


def _plain(v) -> bool:
    return not isinstance(v, (dict, list))


def json_records(data) -> list[tuple[str, dict]]:
    """(path, record) pairs of a JSON tree, in document order.

    Objects in arrays are records. One that holds arrays of objects itself is a
    record with these shown as ``[N items]`` if it has six scalars of its own;
    else its members are looked at, its scalars carried along as ``@name``. A root
    of scalars only is one record. Members of the record win over carried ones.
    """
    found = []
    todo = [("", data, {}, 0, False)]  # path, node, carried scalars, level, whether an array's member
    while todo:
        path, node, carried, level, member = todo.pop()
        if level > DEEPEST:
            continue
        if isinstance(node, list):
            todo += [(path, x, carried, level + 1, True) for x in reversed(node) if isinstance(x, dict)]
            continue
        own = {k: v for k, v in node.items() if _plain(v)} if isinstance(node, dict) else {}
        lists = [k for k, v in node.items() if _objects(v)] if isinstance(node, dict) else []
        if member and (not lists or len(own) >= RICH):
            shown = {k: f"[{len(v)} items]" if k in lists else v for k, v in node.items()}
            found.append((path, {f"@{k}": v for k, v in carried.items()} | shown))
            continue
        if not isinstance(node, dict):
            continue
        if level == 0 and not lists and own:
            found.append(("$", dict(node)))
        below = {**carried, **own}
        step = lambda k: f"{path}.{k}" if path else k
        nested = [k for k, v in node.items() if isinstance(v, dict) and (not lists or any(map(_objects, v.values())))]
        todo += [(step(k), node[k], below, level + 1, False) for k in reversed([*lists, *nested])]
    return found


def _tag(tag: str) -> str:
    """Name of an element without its namespace."""
    return tag.rpartition("}")[2]


def xml_records(text: str) -> list[tuple[str, dict]]:
    """Records of the repeated element that lies least deep, then is most frequent: attributes, leaf children and its own text (``#text``).

    Namespaces are left out of names.
    """
    root = ET.fromstring(text)
    seen, depth = Counter(), {}
    level = [(root, 0)]
    while level:
        node, d = level.pop()
        if len(node) and node is not root:
            name = _tag(node.tag)
            seen[name] += 1
            depth[name] = min(d, depth.get(name, d))
        level += [(c, d + 1) for c in node]
    repeated = [t for t, n in seen.items() if n >= 2]
    if not repeated:
        return []
    tag = min(repeated, key=lambda t: (depth[t], -seen[t], t))
    out = []
    for node in (n for n in root.iter() if _tag(n.tag) == tag):
        rec = {f"@{_tag(k)}": v for k, v in node.attrib.items()}
        for child in node:
            inner = list(child)
            rec[_tag(child.tag)] = f"[{len(inner)} items]" if inner else (child.text or "").strip()
        if node.text and node.text.strip():
            rec["#text"] = node.text.strip()
        out.append((tag, rec))
    return out


def show(v, most: int) -> str:
    """Value of a record on one line, cut to ``most`` letters."""
    if isinstance(v, list):
        s = ", ".join(map(str, v)) if all(map(_plain, v)) else f"[{len(v)} items]"
    else:
        s = json.dumps(v, ensure_ascii=False) if isinstance(v, dict) else str(v)
    s = " ".join(s.split())
    return s if len(s) <= most else s[:most] + "…"


def render(path: str, record: dict) -> str:
    """Record as lines; empty values left out, carried ones cut shorter."""
    rows = [(k, show(v, 160 if k.startswith("@") else 300)) for k, v in record.items() if v is not None and v != ""]
    return "\n".join([f"- record @ {path}", *[f"  {k}: {s}" for k, s in rows if s]])


def records_of(name: str, text: str, least: int = 2, most_letters: int = 200 << 20) -> list[tuple[str, dict]] | None:
    """Records of a file by its suffix, or None if it has too few, is longer than ``most_letters`` or can't be read.

    Longer files are not lost: without records a file goes on as text.
    """
    if len(text) > most_letters:
        return None
    kind = name.lower().rpartition(".")[2]
    try:
        if kind in ("jsonl", "ndjson"):
            found = []
            for i, line in enumerate(text.splitlines()):
                try:
                    v = json.loads(line)
                except ValueError:
                    continue
                if isinstance(v, dict):
                    found.append((f"line[{i}]", v))
        elif kind == "json":
            found = json_records(json.loads(text))
        elif kind == "xml":
            found = xml_records(text)
        else:
            return None
    except (ValueError, ET.ParseError):
        return None
    return found if len(found) >= least else None


def record_rows(files: DataFrame) -> DataFrame:
    """Records of all files (``source_path, text``) as ``source_path, n, place, record``, numbered in each; files without records give none."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(p, n, place, [(k, show(v, 300)) for k, v in rec.items() if v is not None]) for p, t in zip(b.column("source_path").to_pylist(), b.column("text").to_pylist(), strict=True) if p and t for n, (place, rec) in enumerate(records_of(p, t) or [], 1)]
            if rows:
                a, n, c, d = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(n, pa.int32()), pa.array(c), pa.array(d, pa.map_(pa.string(), pa.string()))], names=["source_path", "n", "place", "record"])

    return files.select("source_path", "text").mapInArrow(apply, RECORDS)


def record_text(place: Column, record: Column) -> Column:
    """Record as lines; blank values are left out."""
    filled = F.filter(F.map_entries(record), lambda e: F.trim(F.coalesce(e["value"], F.lit(""))) != "")
    return F.array_join(F.concat(F.array(F.concat(F.lit("- record @ "), place)), F.transform(filled, lambda e: F.concat(F.lit("  "), e["key"], F.lit(": "), e["value"]))), "\n")


def record_chunks(records: DataFrame, budget: int = 800) -> DataFrame:
    """``source_path, chunk_index, text``: whole records of each file in order, packed under the budget (at least 200 tokens).

    A file holds a bounded number of records (see ``records_of``); a larger record is alone.
    """
    lines = records.groupBy("source_path").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", record_text(F.col("place"), F.col("record")).alias("t")))), lambda x: x["t"]).alias("units"))
    return lines.select("source_path", F.posexplode(packed(F.col("units"), max(200, budget), "\n")).alias("chunk_index", "text"))
