"""Abusive, hateful and sexual passages tagged by a linear-chain conditional random field.

Training: reviewers mark whole documents, so token labels are made in rounds. In
documents marked clean every token is clean; in documents marked toxic the
passages that set them apart are toxic, first by the odds of their words, then by
the field trained so far. The field has two states; its features are the words
around a token in plain spelling and the number of telling words in the passage.

Scoring: every passage of every document runs through forward-backward; a
document's score is the greatest marginal of the toxic state, its spans are the
runs of tokens above the threshold, as character offsets of the original text.

Edge cases: null, empty and wordless texts score 0 without spans. Marks that are
null, or on which raters disagree, are not used. Without any usable mark only
the fixed list of insults speaks.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Common insults, threats and sexual words of the corpus's languages.
INSULTS = """
idiot moron imbecile halfwit dimwit scum scumbag asshole bastard bitch dipshit loser worthless useless pathetic disgusting filthy stupid dumb vermin parasite parasites fuck fucked fucking shit cunt whore slut nudes naked tits cock horny
idiot dummkopf schwachkopf arschloch arsch drecksack dreckskerl vollidiot hurensohn wichser schlampe fotze wertloser dämlicher hirnloser widerlicher verpiss ungeziefer parasit fresse nacktbilder ficken
idiot imbécile crétin abruti salaud salope connard connasse pute enculé minable crever ordure parasite vermine gueule nue nichons baise
idiota imbécil estúpido cabrón pendejo basura inútil asqueroso maldito puta mierda plaga parásito desnuda tetas follar lárgate
идиот дебил тупой кретин урод подонок мразь сволочь тварь дерьмо дерьма говно сука шлюха паразиты безмозглый никчёмный сдох сдохни заткнись голые голая трахать сиськи
"""  # fmt: skip
# Letters of the other alphabet that look alike, and digits and signs put for letters.
LOOKALIKE_CYRILLIC, LOOKALIKE_LATIN = "асеорхукмтнвіј", "aceopxykmthbij"
LEET = str.maketrans("013457@$", "oieastas")

INVISIBLE = re.compile("[­​-‏⁠﻿]+")
SPACED = re.compile(r"(?<![^\W_])(?:[^\W\d_][ .·_*-]){3,}[^\W\d_](?![^\W_])")
WORD = re.compile("[^\\W_]+(?:[­​-‏⁠*@#$%!&’'-]+[^\\W_]+)*\\*{0,4}")
PASSAGE = re.compile(r"\n+|(?<=[.!?…])[\"”»')\]]*\s+")
REPEAT = re.compile(r"([^\W\d_])\1{2,}")
MASKED = re.compile(r"[^\W\d_][*@#$%!&]+[^\W_]*[*@#$%!&]*")
TO_LATIN = str.maketrans(LOOKALIKE_CYRILLIC, LOOKALIKE_LATIN)
TO_CYRILLIC = str.maketrans(LOOKALIKE_LATIN, LOOKALIKE_CYRILLIC)


def plain_word(token: str) -> str:
    """Plain spelling of a token: case, digits for letters, look-alikes, repeats and fillers undone."""
    w = token.lower().replace("’", "'")
    if INVISIBLE.search(w):
        w = INVISIBLE.sub("", w).replace("-", "")
    if w.isascii() and w.isalpha():
        return REPEAT.sub(r"\1", w)
    if SPACED.fullmatch(w):
        w = re.sub(r"[ .·_*-]", "", w)
    if any(c.isdigit() for c in w):
        letters = sum(c.isalpha() for c in w)
        if not letters or "-" in w or letters < len(w) / 3:
            return "0"
        w = w.translate(LEET)
    if MASKED.search(w):
        solved = w.translate(LEET)
        if not solved.isalpha():
            return "<masked>"
        w = solved
    cyrillic = sum("а" <= c <= "я" or c == "ё" for c in w)
    latin = sum("a" <= c <= "z" for c in w)
    if cyrillic and latin:
        w = w.translate(TO_CYRILLIC if cyrillic >= latin else TO_LATIN)
    return REPEAT.sub(r"\1", w)


def passages(text: str) -> list[str]:
    """Passages (lines, and sentences within them) of a text, spaced-out words joined."""
    if SPACED.search(text):
        text = SPACED.sub(lambda m: re.sub(r"[ .·_*-]", "", m[0]), text)
    return [p for p in PASSAGE.split(text) if p]


#: Features are hashed into so many weights.
WIDTH = 1 << 18
LEXICON = frozenset(INSULTS.split())


def features(ids: np.ndarray, telling: np.ndarray) -> np.ndarray:
    """Hashed feature numbers (rows x length x 7) of padded id sequences; id 0 is any other word, -1 padding."""
    pad = np.pad(ids, ((0, 0), (2, 2)), constant_values=-1).astype(np.int64) + 2
    w0, p1, p2, n1, n2 = pad[:, 2:-2], pad[:, 1:-3], pad[:, :-4], pad[:, 3:-1], pad[:, 4:]
    many = np.minimum(telling[ids + 1].sum(1), 5)[:, None] + np.zeros_like(w0)
    kinds = [w0, p1 * 4099 + 11, n1 * 8209 + 13, w0 * 1000003 + p1 * 7919 + 17, w0 * 999983 + n1 * 7907 + 19, p1 * 1299709 + n1 * 104729 + 23 + p2 * 31 + n2 * 37, many * 15485863 + 29]
    return np.stack([(k * 2654435761 + j * 97) % WIDTH for j, k in enumerate(kinds)], -1)


def forward_backward(e: np.ndarray, mask: np.ndarray, trans: np.ndarray, start: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marginals of the toxic state, expected transitions and log partition of each row.

    ``e``: rows x length scores of the toxic state against the clean one.
    """
    n, t = e.shape
    alpha = np.zeros((n, t, 2))
    alpha[:, 0, 1] = e[:, 0] + start
    for i in range(1, t):
        a = np.logaddexp(alpha[:, i - 1, :1] + trans[0], alpha[:, i - 1, 1:] + trans[1])
        a[:, 1] += e[:, i]
        alpha[:, i] = np.where(mask[:, i, None], a, alpha[:, i - 1])
    z = np.logaddexp(alpha[:, -1, 0], alpha[:, -1, 1])
    beta = np.zeros((n, t, 2))
    pair = np.zeros((n, 2, 2))
    for i in range(t - 2, -1, -1):
        b = beta[:, i + 1].copy()
        b[:, 1] += e[:, i + 1]
        step = np.logaddexp(trans[:, 0] + b[:, :1], trans[:, 1] + b[:, 1:])
        on = mask[:, i + 1, None]
        pair += np.exp(alpha[:, i, :, None] + trans[None] + b[:, None, :] - z[:, None, None]) * on[:, :, None]
        beta[:, i] = np.where(on, step, beta[:, i + 1])
    marginal = np.exp(alpha[:, :, 1] + beta[:, :, 1] - z[:, None]) * mask
    return marginal, pair, z


@dataclass
class Field:
    """Conditional random field: word numbers, weights of the features, transitions."""

    words: dict[str, int]
    telling: np.ndarray
    weights: np.ndarray
    trans: np.ndarray
    start: float

    def marginals(self, sequences: Sequence[tuple[int, ...]]) -> list[np.ndarray]:
        out: list[np.ndarray] = [np.zeros(0)] * len(sequences)
        for rows, ids, mask in padded(sequences):
            e = self.weights[features(ids, self.telling)].sum(-1)
            m, _, _ = forward_backward(e, mask, self.trans, self.start)
            for r, k in enumerate(rows):
                out[k] = m[r, : len(sequences[k])]
        return out


def padded(sequences: Sequence[tuple[int, ...]], size: int = 2048) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
    """Blocks of sequences of similar length: (row numbers, ids, mask)."""
    order = sorted((k for k in range(len(sequences)) if sequences[k]), key=lambda k: len(sequences[k]))
    at = 0
    while at < len(order):
        rows = order[at : at + size]
        while len(rows) > 1 and len(sequences[rows[-1]]) * len(rows) > 200_000:  # very long passages in small blocks
            rows = rows[: len(rows) // 2]
        at += len(rows)
        ids = np.full((len(rows), len(sequences[rows[-1]])), -1, np.int64)
        for r, k in enumerate(rows):
            ids[r, : len(sequences[k])] = sequences[k]
        yield rows, ids, ids >= 0


def word_numbers(toxic: list[list[list[str]]], clean: list[list[list[str]]]) -> tuple[dict[str, int], set[str]]:
    """Numbers of the words kept, and the telling ones: those far more frequent in toxic documents."""
    n1, n0 = max(len(toxic), 1), max(len(clean), 1)
    c1 = Counter(w for d in toxic for w in {w for p in d for w in p})
    c0 = Counter(w for d in clean for w in {w for p in d for w in p})
    share = n1 / (n1 + n0)
    need = 0.5 * math.log(max(len(c1.keys() | c0.keys()), 2)) + 1

    def beyond_chance(n: int, clean_n: int) -> bool:
        """Whether so many toxic among all documents of a word pass a bound on chance (Chernoff; a root of the vocabulary may pass it)."""
        at = n / (n + clean_n)
        if at <= share:
            return False
        return round(n * math.log(at / share) + (clean_n * math.log((1 - at) / (1 - share)) if clean_n else 0.0), EXACT) > need

    odds = lambda w, n: round(math.log((n + 0.1) / n1) - math.log((c0[w] + 0.5) / n0), EXACT)
    telling = {w for w, n in c1.items() if n >= 2 and odds(w, n) > 1.1 and beyond_chance(n, c0[w])}
    telling |= LEXICON | {"<masked>"}
    # words mostly seen beside telling ones, and those mostly beside these, give the contexts of either kind
    everywhere = Counter(w for docs in (toxic, clean) for d in docs for p in d for w in set(p))
    kept = telling | {"you", "your", "du", "dir", "dich", "tu", "te", "toi", "ты", "тебя", "тебе", "eres"}
    for near in (telling, kept):
        beside = Counter(w for docs in (toxic, clean) for d in docs for p in d if not near.isdisjoint(p) for w in set(p))
        kept = kept | {w for w, n in beside.items() if n >= 3 and n >= 0.35 * everywhere[w]}
    return {w: i for i, w in enumerate(sorted(kept), 1)}, telling


#: Rounds of labelling and training, gradient steps in each, and the penalty on weights.
ROUNDS, STEPS, PENALTY = 3, 120, 3e-6
TOXIC = 0.5
#: Score from which a document, and a token, counts as offending.
FLAG = 0.3
#: Decimals that decisions and steps of the training are rounded to.
EXACT = 9


def train(toxic_texts: Iterable[str], clean_texts: Iterable[str]) -> Field:
    """Field fitted on bounded samples of documents marked toxic and clean."""
    look: dict[str, str] = {}

    def words(p: str) -> list[str]:
        return [look.get(t) or look.setdefault(t, plain_word(t)) for t in WORD.findall(p)]

    toxic = [[w for p in passages(t) if (w := words(p))] for t in toxic_texts]
    clean = [[w for p in passages(t) if (w := words(p))] for t in clean_texts]
    numbers, telling_words = word_numbers(toxic, clean)
    telling = np.zeros(len(numbers) + 2, np.int64)
    for w in telling_words & numbers.keys():
        telling[numbers[w] + 1] = 1
    number = lambda p: tuple(numbers.get(w, 0) for w in p)
    background = Counter(s for d in clean for p in d if any(s := number(p)))
    suspects = [[s for p in d if any(s := number(p))] for d in toxic]
    field = Field(numbers, telling, np.zeros(WIDTH), np.array([[2.0, -2.0], [-2.0, 2.0]]), -2.0)
    many = lambda s: sum(telling[i + 1] for i in s)
    score = {s: round(many(s) / (1 + 0.05 * len(s)) - 1.5 * math.log1p(background[s]), EXACT) for d in suspects for s in d}
    # a passage about as frequent in clean documents isn't what a toxic mark is for
    core = lambda s: tuple(i for i in s if i)
    among = Counter(k for d in suspects for k in {core(s) for s in d})
    usual = Counter(k for d in clean for k in {core(number(p)) for p in d})
    ordinary = {k for k, n in among.items() if usual[k] / max(len(clean), 1) > 0.3 * n / max(len(toxic), 1)}
    telltale = {k for k, n in among.items() if n >= 3 and n / max(len(toxic), 1) > 4 * (usual[k] + 0.5) / max(len(clean), 1)}
    limit, fallback = 0.8, 0.5
    squares = np.full(WIDTH, 1e-8)
    for _ in range(ROUNDS):
        positive: Counter = Counter()
        rest: Counter = Counter(background)
        for d in suspects:
            best = max(d, key=score.__getitem__, default=None)
            for s in d:
                hit = core(s) in telltale or (core(s) not in ordinary and (score[s] > limit or (s == best and score[s] > fallback)))
                (positive if hit else rest)[s] += 1
        rows = list(positive) + list(rest)
        label = np.array([1.0] * len(positive) + [0.0] * len(rest))
        weight = np.array([*positive.values(), *rest.values()], float)
        blocks = [(features(ids, telling), mask, label[r], weight[r]) for r, ids, mask in padded(rows)]
        total = sum(float((m * w[:, None]).sum()) for _, m, _, w in blocks) or 1.0
        for _ in range(STEPS):
            grad, gtrans, gstart = np.zeros(WIDTH), np.zeros((2, 2)), 0.0
            for f, mask, y, w in blocks:
                m, pair, _ = forward_backward(field.weights[f].sum(-1), mask, field.trans, field.start)
                error = (y[:, None] * mask - m) * w[:, None]
                grad += np.bincount(f[mask].ravel(), np.repeat(error[mask], f.shape[-1]), WIDTH)
                steps = mask.sum(1) - 1
                seen = np.zeros((len(y), 2, 2))
                seen[:, 0, 0], seen[:, 1, 1] = steps * (1 - y), steps * y
                gtrans += ((seen - pair) * w[:, None, None]).sum(0)
                gstart += float(((y - m[:, 0]) * w).sum())
            # rounded, so that a machine's last digits don't grow from step to step
            grad = np.round(grad / total - PENALTY * field.weights * (squares > 1e-8), EXACT)
            squares = squares + grad * grad
            field.weights = np.round(field.weights + 0.6 * grad / np.sqrt(squares), EXACT)
            field.trans = np.round(field.trans + np.clip(4.0 * gtrans / total, -0.2, 0.2), EXACT)
            field.start = round(field.start + float(np.clip(4.0 * gstart / total, -0.2, 0.2)), EXACT)
        order = [s for s in score]
        score = {s: (round(float(m.max()), EXACT) if len(m) else 0.0) for s, m in zip(order, field.marginals(order), strict=True)}
        limit, fallback = TOXIC, 0.2
    return field


class Scorer:
    """Scores texts with a field; marginals of equal number sequences are kept."""

    def __init__(self, field: Field):
        self.field, self.memo = field, {}

        class Numbers(dict):
            def __missing__(own, token: str) -> int:  # noqa: N805
                if len(own) > 300_000:
                    own.clear()
                own[token] = n = field.words.get(plain_word(token), 0)
                return n

        self.number = Numbers().__getitem__

    def scores(self, texts: Sequence[str | None]) -> list[float]:
        """Greatest toxic marginal of each text."""
        per_text = [[s for p in passages(t) if any(s := tuple(map(self.number, WORD.findall(p))))] if t else [] for t in texts]
        if len(self.memo) > 200_000:
            self.memo.clear()
        fresh = list({s for d in per_text for s in d if s not in self.memo})
        for s, m in zip(fresh, self.field.marginals(fresh), strict=True):
            self.memo[s] = float(m.max())
        return [max((self.memo[s] for s in d), default=0.0) for d in per_text]

    def spans(self, text: str, threshold: float = FLAG) -> list[tuple[int, int, float]]:
        """Offsets (start, end, greatest marginal) of the toxic runs of a text."""
        found = []
        joined = {m.start(): m.end() for m in SPACED.finditer(text)}
        bounds = [0, *[e for m in PASSAGE.finditer(text) for e in m.span()], len(text)]
        for lo, hi in zip(bounds[::2], bounds[1::2], strict=True):
            at, tokens = lo, []
            while at < hi and (m := WORD.search(text, at, hi)):
                end = joined.get(m.start(), m.end())
                tokens.append((m.start(), end))
                at = max(end, m.start() + 1)
            ids = tuple(self.number(text[a:b]) for a, b in tokens)
            if not any(ids):
                continue
            (marginal,) = self.field.marginals([ids])
            run: list[int] = []
            for k in range(len(tokens) + 1):
                if k < len(tokens) and marginal[k] >= threshold:
                    run.append(k)
                elif run:
                    found.append((tokens[run[0]][0], tokens[run[-1]][1], float(max(marginal[j] for j in run))))
                    run = []
        return found


#: Most documents of either kind that the field is fitted on, and about the most bytes of their texts.
SAMPLE, SAMPLE_BYTES = 5000, 32 << 20


def fit_on(documents: DataFrame, labels: DataFrame, size: int = SAMPLE, most_bytes: int = SAMPLE_BYTES) -> Field:
    """Field of at most about ``size`` documents marked toxic and as many marked clean, picked by key hash.

    Where texts are long on average, fewer are picked, so that those of either kind come to about ``most_bytes``.
    """
    marks = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.avg("toxic").alias("mark")).filter("mark in (0, 1)").select("doc_id", F.col("mark").cast("int").alias("mark"))
    counts = {r["mark"]: r["count"] for r in marks.groupBy("mark").count().collect()}
    mean = documents.agg(F.avg(F.octet_length("text")).alias("n")).first().n or 1.0
    share = {m: min(1.0, min(size, most_bytes / mean) / max(counts.get(m, 0), 1)) for m in (0, 1)}
    place = F.pmod(F.xxhash64(F.lit("train"), "doc_id"), F.lit(1 << 30))
    within = place < F.when(F.col("mark") == 1, int(share[1] * (1 << 30))).otherwise(int(share[0] * (1 << 30)))
    picked = marks.filter(within).orderBy(place, "doc_id").limit(3 * size)  # a bound that the shares keep clear of
    texts = documents.filter("text is not null").select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("mark", "text").collect()  # at most 3 x size rows
    return train(sorted(r.text for r in texts if r.mark == 1), sorted(r.text for r in texts if r.mark == 0))


def score_documents(documents: DataFrame, field: Field, with_spans: bool = True) -> DataFrame:
    """``doc_id, source, score, spans`` of every document row; spans as (start, end, score)."""
    shared = documents.sparkSession.sparkContext.broadcast(field)
    span = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for b in batches:
            texts = b.column("text").to_pylist()
            scores = scorer.scores(texts)
            spans = [[dict(zip(("start", "end", "score"), s, strict=True)) for s in scorer.spans(t)] if with_spans and p >= FLAG else [] for t, p in zip(texts, scores, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("source"), pa.array(scores, pa.float64()), pa.array(spans, pa.list_(span))], names=["doc_id", "source", "score", "spans"])

    return documents.select("doc_id", "source", "text").mapInArrow(apply, "doc_id bigint, source string, score double, spans array<struct<start:int,end:int,score:double>>")
