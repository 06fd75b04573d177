"""Model steps behind small interfaces, with deterministic defaults that need no network."""

from __future__ import annotations

import hashlib
import re
import time
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


class MapModel(Protocol):
    def findings(self, query: str, text: str) -> list[dict]: ...


class EmbedModel(Protocol):
    def embed(self, texts: Sequence[str]) -> list[list[float]]: ...


class RerankModel(Protocol):
    def order(self, query: str, texts: Sequence[str]) -> list[int]: ...


def _terms(text: str) -> list[str]:
    return re.findall(r"\w{3,}", text.lower())


class RuleMap:
    """Sentences that hold a term of the query are findings, quoted as evidence."""

    def findings(self, query: str, text: str) -> list[dict]:
        terms = set(_terms(query))
        return [{"type": "mention", "severity": "info", "explanation": s.strip(), "quote": s.strip()[:200]} for s in re.split(r"(?<=[.!?])\s+|\n", text) if terms & set(_terms(s))]


class HashEmbed:
    """Unit vectors of hashed terms."""

    def __init__(self, size: int = 64):
        self.size = size

    def embed(self, texts: Sequence[str]) -> list[list[float]]:
        out = np.zeros((len(texts), self.size))
        for r, t in enumerate(texts):
            for w, n in Counter(_terms(t)).items():
                h = int(hashlib.md5(w.encode(), usedforsecurity=False).hexdigest()[:8], 16)
                out[r, h % self.size] += n if (h >> 16) & 1 else -n
        return (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)).tolist()


class OverlapRerank:
    """Texts by the number of query terms they hold, then in the order given."""

    def order(self, query: str, texts: Sequence[str]) -> list[int]:
        terms = set(_terms(query))
        return sorted(range(len(texts)), key=lambda i: (-len(terms & set(_terms(texts[i]))), i))


def map_chunks(chunks: DataFrame, query: str, model: MapModel | None = None) -> DataFrame:
    """MAP results of each chunk (``chunk_id, source_path, text``): findings as rows."""
    model = model or RuleMap()

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(c, p, f["type"], f["severity"], f["explanation"], f["quote"]) for c, p, t in zip(*(b.column(n).to_pylist() for n in ("chunk_id", "source_path", "text")), strict=True) if t for f in model.findings(query, t)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], names=["chunk_id", "source_path", "finding_type", "severity", "explanation", "quote"])

    return chunks.select("chunk_id", "source_path", "text").mapInArrow(apply, "chunk_id string, source_path string, finding_type string, severity string, explanation string, quote string")


def embed_chunks(chunks: DataFrame, model: EmbedModel | None = None) -> DataFrame:
    """``id, vector`` of each chunk (``id, text``); null texts are left out."""
    model = model or HashEmbed()

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(model.embed(b.column("text").to_pylist()), pa.list_(pa.float64()))], names=["id", "vector"])

    return chunks.filter("text is not null").select("id", "text").mapInArrow(apply, "id bigint, vector array<double>")


# Tries and waits of a model call.
TRIES, FIRST_WAIT, LONGEST_WAIT = 3, 1.0, 30.0


def retrying(call: Callable, tries: int = TRIES, first_wait: float = FIRST_WAIT, sleep: Callable[[float], None] = time.sleep) -> Callable:
    """``call`` tried again after a failure, each wait twice the last; what the failure asks for (``retry_after``) goes first.

    The last failure is raised. Waits differ a little by the call's arguments, so that
    tasks that failed together don't return together.
    """

    def tried(*args):
        for n in range(tries):
            try:
                return call(*args)
            except Exception as e:
                if n == tries - 1:
                    raise
                jitter = int.from_bytes(hashlib.blake2b(repr((n, args)).encode(), digest_size=2).digest(), "big") / (1 << 16)
                sleep(min(LONGEST_WAIT, getattr(e, "retry_after", None) or first_wait * 2**n * (1 + 0.25 * jitter)))

    return tried


class ScoutModel(Protocol):
    def score(self, query: str, text: str) -> float: ...


class RuleScout:
    """Share of the query's terms that a text holds."""

    def score(self, query: str, text: str) -> float:
        terms = set(_terms(query))
        return len(terms & set(_terms(text))) / len(terms) if terms else 0.0


def scout_chunks(chunks: DataFrame, query: str, model: ScoutModel | None = None) -> DataFrame:
    """``chunk_id, score`` of each chunk; a chunk whose call fails has an unknown (null) score and is kept by later steps."""
    score = retrying((model or RuleScout()).score)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for t in b.column("text").to_pylist():
                try:
                    out.append(float(score(query, t or "")))
                except Exception:
                    out.append(None)
            yield pa.RecordBatch.from_arrays([b.column("chunk_id"), pa.array(out, pa.float64())], names=["chunk_id", "score"])

    return chunks.select("chunk_id", "text").mapInArrow(apply, "chunk_id string, score double")


class ExpandModel(Protocol):
    def expand(self, question: str) -> list[str]: ...


class RuleExpand:
    """The question, its exact entities, and its long words."""

    def expand(self, question: str) -> list[str]:
        exact = re.findall(r"@\w{3,}|[A-Za-z0-9]+(?:[._\-/@][A-Za-z0-9]+)+", question)
        return list(dict.fromkeys(q for q in (question, " ".join(exact), " ".join(w for w in re.findall(r"\w{6,}", question))) if q.strip()))


def expand_questions(questions: DataFrame, model: ExpandModel | None = None, most: int = 4) -> DataFrame:
    """``qid, n, text``: up to ``most`` queries for each question (``qid, text``), each once apart from case; the question itself first."""
    expand = (model or RuleExpand()).expand

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for qid, t in zip(b.column("qid").to_pylist(), b.column("text").to_pylist(), strict=True):
                once = {q.strip().lower(): q.strip() for q in reversed([t or "", *(expand(t) if t else [])])}
                rows += [(qid, n, q) for n, q in enumerate(list(reversed(once.values()))[:most])]
            if rows:
                ids, n, texts = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int32()), pa.array(texts, pa.string())], names=["qid", "n", "text"])

    return questions.select("qid", "text").mapInArrow(apply, "qid bigint, n int, text string")
