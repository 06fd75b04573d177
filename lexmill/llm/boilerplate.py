"""Main body of pages by tag-path ratios over the lines of their text.

Texts hold no tags any more, so a line's path runs from its layout (paragraph,
sentence, label, bullet, menu, table row, command) through its wording, word by
word, to its end. Over all pages, five sums are kept per path step (a pair of
neighbouring steps), per whole path (leaf) and per path of a label up to its colon:
lines, text length, punctuation, and how many of the lines on pages with a known
headline stand outside the stretch from the headline to the last paragraph. A line
gets the ratios of its steps:

* TPR, text length per line, and PTPR, punctuation per line, against all lines;
* the odds of standing outside that stretch;
* the repetition of its leaf among the lines that begin alike.

They are fused per layout, smoothed over neighbouring lines and thresholded. Boxes
of links are learned too: their headings are the paths that, above headlines, are
followed by teasers. No word lists are used; the only marks besides are menu layout,
page counters, repetition within the page and the site's own name.

Steps are hashed into a table of ``1 << BITS`` rows, so what reaches the driver and
is broadcast doesn't grow with the data, and no step is left out for being rare.
All sums are whole numbers; the result doesn't depend on the order of rows.

Edge cases: null, empty and blank texts give no lines; a page without any line
of article evidence (an error message, a login wall) is surroundings as a whole;
equal rows of one page are judged alike and reported once. Without statistics no
line but those of clear layout is told apart.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.mojibake import LANGUAGES, Model, Pairs, Restorer, Words, by_pair, by_word, count_pairs, dictionary_words, is_word, kept_pair, word_count_due
from lexmill.session import materialise

BULLET = r"^\s*(?:[-*•·–‣▪]|\d{1,3}[.)])\s+"
INNER_END = r"[.!?…][\"”»“’')\]]*\s+[\"“«„¿¡‘'(\[]*[\p{Lu}\p{Lt}\p{Lo}]"
FINAL = r"[.!?…][\"”»“’')\]]*\s*(?:\[\d+\])?\s*$"
COMMAND = r"^\s*(?:\$\s|[#>%]\s+[a-z][\w./-]*\s+-)"
PAGE_OF = r"^\s*(?:\p{L}+\.? )?\d{1,4}\s*(?:/|\p{L}{2,3})\s*\d{1,4}\s*$|^\s*(?:[-–—]\s*)?\d{1,4}\s*[-–—]\s*$"
SEPARATED = r"\s[/>»›|·]\s|\S\s{2,}\S"
COLON = r"^(?P<head>[^:]{1,60}): +(?P<next>[\p{L}\p{N}]*)"
BULLET_RE = re.compile(BULLET)
MENU_SPLIT = re.compile(r"\s*[|/·•»›>→]\s+|\s+[|/·•»›>→]\s*|\s{2,}|\s+[–-]\s+")
MENU_SIGN = r"[|/·•»›>→]|\s{2}|\s[–-]\s"
NUMBER_CELL = re.compile(r"^[-−]?\d[\d.,\s]*%?$")
CRUMB_SPLIT = re.compile(r"\s+[/>»›|]\s+")
DATE = re.compile(r"\b(?:\d{4}[-./]\d{1,2}[-./]\d{1,2}|\d{1,2}[-./]\d{1,2}[-./]\d{4})\b")

#: Layouts of lines. LONG is the least length of a paragraph or of a bullet that is one.
LAYOUTS = BLANK, LABEL, SENTENCE, BULLETED, POINTS, PARAGRAPH, MENU, TABLE, COMMANDS = range(9)
LONG = 140
#: Letters at the end of a line in which its last sentence mark is looked for (with closing quotes and a reference after it).
ENDING = 32


def _flags(x: pa.Array) -> np.ndarray:
    return x.to_numpy(zero_copy_only=False)


def _where(lines: pa.Array, among: np.ndarray, pattern: str) -> np.ndarray:
    """Numbers of those lines, of the ones asked for, that hold a pattern."""
    at = np.flatnonzero(among)
    return at[_flags(pc.match_substring_regex(lines.take(pa.array(at)), pattern))]


def layouts(lines: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Layout of each line, whether it ends like a sentence, and its blanks between words."""
    text = pc.utf8_trim_whitespace(lines)
    length = _flags(pc.utf8_length(text))
    final = _flags(pc.match_substring_regex(pc.utf8_slice_codeunits(text, -ENDING), FINAL))
    blanks = _flags(pc.count_substring(text, " "))
    ends = _flags(pc.count_substring_regex(text, INNER_END)) + final
    many = (ends > 1) & (length >= LONG)
    kind = np.where(many, PARAGRAPH, np.where(final & (blanks >= 3), SENTENCE, LABEL))
    kind = np.where(_flags(pc.match_substring_regex(text, BULLET)), np.where(many, POINTS, BULLETED), kind)
    kind[_flags(pc.match_substring_regex(text, COMMAND))] = COMMANDS
    for i in _where(text, (ends == 0) & (kind != COMMANDS), MENU_SIGN).tolist():
        cells = [c for c in MENU_SPLIT.split(BULLET_RE.sub("", text[i].as_py())) if c]
        if len(cells) >= 3 and max(map(len, cells)) <= 40 and sum(len(c.split()) for c in cells) <= 3.2 * len(cells):
            kind[i] = MENU
    for i in np.flatnonzero(_flags(pc.match_substring(text, "|"))).tolist():
        cells = [c.strip() for c in text[i].as_py().strip("|").split("|")]
        if len(cells) >= 2 and any(NUMBER_CELL.match(c) for c in cells[1:]) and "…" not in cells:
            kind[i] = TABLE
    kind[length == 0] = BLANK
    return kind, final, blanks


#: Rows of the table of sums, as a power of two.
BITS = 19
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """64-bit hash of pairs."""
    h = (a * _A) ^ (b + _B + (a << np.uint64(6)) + (a >> np.uint64(2)))
    h = (h ^ (h >> np.uint64(31))) * _B
    return h ^ (h >> np.uint64(29))


def bucket(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - BITS)).astype(np.int64)


@dataclass
class Paths:
    """Buckets of the steps of lines' paths, each step's line and place, and the buckets of the leaves."""

    steps: np.ndarray
    line: np.ndarray
    first: np.ndarray
    leaf: np.ndarray


def word_hashes(lines: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of lines, in order, and the line of each.

    Lines are parted at blanks; only the distinct parts are put in lower case, their
    numbers made one word, and cut into words at other signs.
    """
    parted = pc.utf8_split_whitespace(lines)
    parts, line = pc.list_flatten(parted).dictionary_encode(), pc.list_parent_indices(parted).to_numpy()
    part = parts.indices.to_numpy()
    cut = pc.split_pattern_regex(pc.replace_substring_regex(pc.utf8_lower(parts.dictionary), r"\d+", "0"), r"[^\p{L}\p{N}]+")
    words, of = pc.list_flatten(cut), pc.list_parent_indices(cut).to_numpy()
    filled = _flags(pc.not_equal(words, ""))
    hashes = pd.util.hash_array(np.array([*words.filter(pa.array(filled)).to_pylist(), ""], object), categorize=False)
    many = np.bincount(of[filled], minlength=len(parts.dictionary))
    first = np.cumsum(many) - many
    times = many[part]
    within = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    return hashes[np.repeat(first[part], times) + within], np.repeat(line, times)


def paths(lines: pa.Array, kind: np.ndarray, final: np.ndarray, salt: int = 0) -> Paths:
    """Paths of lines; numbers count as one word, letter case and punctuation don't count."""
    n = len(lines)
    codes, line = word_hashes(lines)
    at = np.arange(len(codes))
    opens = np.ones(len(codes), bool)
    opens[1:] = line[1:] != line[:-1]
    root = (np.where(kind == POINTS, BULLETED, kind).astype(np.uint64) + np.uint64(11)) * _B
    before = np.where(opens, root[line], np.concatenate([codes[:1], codes[:-1]]))
    last = root.copy()
    last[line] = codes  # the last word of each line stays
    begin = np.full(n, -1, np.int64)
    begin[line[opens]] = at[opens]
    leaf = np.zeros(n, np.uint64)
    if len(codes):
        leaf[line[opens]] = np.add.reduceat(mixed(codes, (at - begin[line]).astype(np.uint64)), at[opens])
    steps = np.concatenate([bucket(mixed(before, codes)), bucket(mixed(last, np.where(final, np.uint64(0x51F3), np.uint64(0xA2C5))))])
    first = np.where(begin >= 0, steps[begin], steps[len(codes) :])
    return Paths(steps, np.concatenate([line, np.arange(n)]), first, bucket(mixed(leaf, np.full(n, 77 + salt, np.uint64))))


def plain(s: str | None) -> str:
    return " ".join((s or "").lower().split())


def headline_at(lines: Sequence[str], title: str | None) -> int:
    """Line of the headline, or -1 if neither title nor crumb trail names one."""
    t = plain(title)
    if t:
        for i, x in enumerate(lines):
            if len(x) >= len(t) and plain(x) == t:
                return i
    for i, x in enumerate(lines):
        if x.count(" ") < 4:
            continue
        cells = CRUMB_SPLIT.split(x.strip())
        if len(cells) >= 3:
            last = plain(cells[-1]).rstrip("….")
            if len(last) >= 12:
                for j in range(i + 1, len(lines)):
                    if plain(lines[j]).startswith(last):
                        return j
    return -1


class Pages:
    """Lines of a batch of pages with layout and paths."""

    def __init__(self, titles: Sequence[str | None], texts: Sequence[str | None]):
        self.lines = [t.split("\n") if t else [] for t in texts]
        self.start = np.concatenate([[0], np.cumsum([len(x) for x in self.lines])]).astype(np.int64)
        self.flat = pa.array([x for own in self.lines for x in own], pa.string())
        self.page = np.repeat(np.arange(len(self.lines)), np.diff(self.start))
        self.kind, final, blanks = layouts(self.flat)
        self.paths = paths(self.flat, self.kind, final)
        self.heads = [headline_at(own, t) for own, t in zip(self.lines, titles, strict=True)]
        #: Lines that may be links to other pages.
        self.teaser = ((self.kind == LABEL) & (blanks >= 3)) | (self.kind == SENTENCE) | (self.kind == BULLETED)
        self.teaser[_where(self.flat, (self.kind == LABEL) & (blanks >= 3), SEPARATED)] = False

    @cached_property
    def colons(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Labels with a colon, the bucket of their path up to it, and that of the path with one word more."""
        at = _where(self.flat, self.kind == LABEL, "^[^:]{1,60}: ")
        parts = pc.extract_regex(self.flat.take(pa.array(at)), COLON)
        heads, next_word = pc.struct_field(parts, "head"), pc.struct_field(parts, "next")
        label, ends = np.full(len(at), LABEL), np.zeros(len(at), bool)
        longer = pc.binary_join_element_wise(heads, next_word, " ")
        return at, paths(heads, label, ends, 1).leaf, paths(longer, label, ends, 2).leaf

    def zones(self) -> np.ndarray:
        """Per line 1 from the headline to the last paragraph, 2 outside, 0 on pages that lack either."""
        zone = np.zeros(len(self.kind), np.int8)
        for p, head in enumerate(self.heads):
            own = slice(self.start[p], self.start[p + 1])
            long = np.flatnonzero(self.kind[own] == PARAGRAPH)
            if head >= 0 and len(long) and long[-1] >= head:
                zone[own] = 2
                zone[own.start + head : own.start + long[-1] + 1] = 1
        return zone

    def headings(self) -> tuple[np.ndarray, np.ndarray]:
        """Labels above a headline that aren't the last line there, and whether a teaser follows."""
        live = np.flatnonzero(self.kind != BLANK)
        a, b = live[:-1], live[1:]
        limit = (self.start[:-1] + np.array([max(h, 0) for h in self.heads], np.int64))[self.page[a]] if len(a) else a
        ok = (b < limit) & (self.kind[a] == LABEL) & (self.page[a] == self.page[b])
        return a[ok], self.teaser[b[ok]]


#: Sums per bucket; the last row is the one of all lines.
SUMS = ["n", "length", "punct", "outside", "zoned", "leads", "teasers"]


def path_sums(pages: Pages) -> np.ndarray:
    """Sums (SUMS x buckets) over a batch of pages."""
    live = pages.kind != BLANK
    zone = pages.zones()
    length = _flags(pc.utf8_length(pages.flat))
    punct = _flags(pc.count_substring_regex(pages.flat, "[.,:;]"))
    out = np.zeros((len(SUMS), (1 << BITS) + 1), np.int64)
    colon, colon_leaf, colon_next = pages.colons
    everything = np.flatnonzero(live)
    for where, line in ((pages.paths.steps, pages.paths.line), (pages.paths.leaf, np.arange(len(live))), (colon_leaf, colon), (colon_next, colon), (np.full(len(everything), 1 << BITS), everything)):
        ok = live[line]
        where, line = where[ok], line[ok]
        for j, w in enumerate((None, length, punct, zone == 2, zone > 0)):
            out[j] += np.bincount(where, None if w is None else w[line], out.shape[1]).astype(np.int64)
    at, followed = pages.headings()
    out[5] += np.bincount(pages.paths.leaf[at], minlength=out.shape[1])
    out[6] += np.bincount(pages.paths.leaf[at], followed, out.shape[1]).astype(np.int64)
    return out


#: Lines that each ratio of a step is drawn towards that of all lines by, and the lines at which a step weighs half.
PRIOR, HALF, LEAF_WEIGHT = 4.0, 8.0, 2.0


@dataclass
class Ratios:
    """Ratios of each bucket: log TPR, log PTPR, log odds of standing outside, lines, share followed by teasers."""

    tpr: np.ndarray
    ptpr: np.ndarray
    odds: np.ndarray
    n: np.ndarray
    leads: np.ndarray

    @classmethod
    def of(cls, sums: np.ndarray) -> Ratios:
        n, length, punct, outside, zoned, leads, teasers = sums[:, :-1].astype(np.float32).astype(np.float64)
        all_n, all_length, all_punct, all_outside, all_zoned = np.maximum(sums[:5, -1], 1).astype(np.float32).astype(float)
        share = np.clip(all_outside / all_zoned, 0.01, 0.99)
        odds = (outside + PRIOR * share) / (zoned + PRIOR)
        return cls(*(x.astype(np.float32) for x in (
            np.log((length + PRIOR * all_length / all_n) / (n + PRIOR) / (all_length / all_n)),
            np.log((punct + PRIOR * all_punct / all_n) / (n + PRIOR) / (all_punct / all_n) + 0.05),
            np.log(odds / (1 - odds)) - np.log(share / (1 - share)),
            n,
            teasers / (leads + 2),
        )))

    @classmethod
    def empty(cls) -> Ratios:
        return cls(*np.zeros((5, 1 << BITS), np.float32))


#: Fused score of a line by its layout: weights of TPR, PTPR, odds and repetition, and the floor below which it is surroundings.
FUSED = {
    LABEL: (1.0, 0.0, -0.58, -0.21, 0.25),
    SENTENCE: (1.0, 0.0, -0.58, -0.25, 1.1),
    BULLETED: (1.0, 0.0, -0.75, 0.1, -0.7),
    POINTS: (1.0, 1.0, 0.0, 0.0, 2.0),
    PARAGRAPH: (1.0, 1.0, 0.0, 0.0, 2.0),
    MENU: (0.0, 0.0, 0.0, 0.0, 1.0),
    TABLE: (0.0, 1.0, -1.0, 0.0, 0.0),
    COMMANDS: (1.0, 0.0, -0.58, 0.0, -1.0),
}
WEIGHTS = np.array([FUSED.get(k, (0.0,) * 5) for k in LAYOUTS])
#: A path up to a colon is open-ended if no one word follows it in more than this share of its lines.
OPEN = 0.5
#: Weights of the lines before, at and after a line; a page ends in surroundings.
SMOOTH, EDGE, CLIP = (0.05, 0.9, 0.05), -2.0, 2.0
#: Share of occurrences followed by teasers from which a path heads a box, and its highest score.
HEADS_BOX, BOX_SCORE = 0.5, -0.8


def fused_scores(pages: Pages, ratios: Ratios) -> tuple[np.ndarray, np.ndarray]:
    """Score of each line above its layout's floor, raw and smoothed: below zero means surroundings."""
    n, p = len(pages.kind), pages.paths
    weight = ratios.n / (ratios.n + HALF)
    total = np.bincount(p.line, weight[p.steps], n) + LEAF_WEIGHT * weight[p.leaf] + 1e-9

    def mean(x: np.ndarray) -> np.ndarray:
        w = x * weight
        return (np.bincount(p.line, w[p.steps], n) + LEAF_WEIGHT * w[p.leaf]) / total

    repeated = np.log(np.maximum(ratios.n[p.leaf] - 1, 0) / (ratios.n[p.first] + 3) + 0.01)
    w = WEIGHTS[pages.kind].T
    raw = w[0] * mean(ratios.tpr) + w[1] * mean(ratios.ptpr) + w[2] * mean(ratios.odds) + w[3] * repeated - w[4]
    at, leaf, further = pages.colons
    # where many words may follow a colon, a label is no better than its path up to it
    open_ended = ratios.n[further] < OPEN * ratios.n[leaf]
    at, leaf = at[open_ended], leaf[open_ended]
    if len(at):
        t, _, o, r, floor = FUSED[LABEL]
        again = np.log(np.maximum(ratios.n[leaf] - ratios.n[p.leaf[at]], 0) / (ratios.n[p.first[at]] + 3) + 0.01)
        raw[at] = np.minimum(raw[at], weight[leaf] * (t * ratios.tpr[leaf] + o * ratios.odds[leaf]) + r * again - floor)
    live = np.flatnonzero(pages.kind != BLANK)
    smooth = raw.copy()
    if len(live):
        v = np.clip(raw[live], EDGE, CLIP)
        ends = np.ones(len(live), bool)
        ends[1:] = pages.page[live[1:]] != pages.page[live[:-1]]
        left = np.where(ends, EDGE, np.concatenate([[EDGE], v[:-1]]))
        right = np.where(np.concatenate([ends[1:], [True]]), EDGE, np.concatenate([v[1:], [EDGE]]))
        smooth[live] = SMOOTH[0] * left + SMOOTH[1] * raw[live] + SMOOTH[2] * right
    return raw, smooth


def host_of(url: str | None) -> str:
    m = re.match(r"[a-z]+://(?:www\.)?([^/:?#]+)", (url or "").lower())
    return m[1] if m else ""


def judge(urls: Sequence[str | None], titles: Sequence[str | None], texts: Sequence[str | None], ratios: Ratios) -> list[list[bool]]:
    """For each page, True for each line of its text that belongs to the main body (blank lines too)."""
    pages = Pages(titles, texts)
    raw, smooth = fused_scores(pages, ratios)
    counter = _flags(pc.match_substring_regex(pages.flat, PAGE_OF))
    heads_box = np.isin(pages.kind, (LABEL, BULLETED)) & (ratios.leads[pages.paths.leaf] >= HEADS_BOX) & (raw < BOX_SCORE)
    out = []
    for p, lines in enumerate(pages.lines):
        own = slice(pages.start[p], pages.start[p + 1])
        out.append(judge_page(lines, host_of(urls[p]), titles[p], pages.heads[p], pages.kind[own].tolist(), raw[own].tolist(), smooth[own].tolist(), counter[own].tolist(), heads_box[own].tolist()))
    return out


def judge_page(lines: list[str], host: str, title: str | None, head: int, kind: list[int], raw: list[float], score: list[float], counter: list[bool], heads_box: list[bool]) -> list[bool]:
    """The body of one page: from its headline on, without surroundings and boxes of links."""
    live = [i for i, k in enumerate(kind) if k]
    times, name = Counter(lines), plain(title)
    marked = {i for i in live if counter[i] or kind[i] == MENU or (host and host in lines[i]) or (times[lines[i]] > 1 and kind[i] in (LABEL, SENTENCE) and plain(lines[i]) != name)}
    outside = {i for i in live if i in marked or score[i] < 0}
    evidence = [i for i in live if i not in outside and (kind[i] in (POINTS, PARAGRAPH, TABLE, COMMANDS) or (kind[i] == SENTENCE and raw[i] > 0.5))]
    if head < 0 or head in marked:
        head = first_of_article(lines, live, kind, outside, evidence[0] if evidence else len(lines))
    main, box = set(), None
    for i in live:
        if i < head:
            continue
        mark = BULLET_RE.match(lines[i])
        style = mark[0].strip()[:1] if mark else ""
        if i == head:
            if i not in marked:
                main.add(i)
        elif heads_box[i]:
            box = "any"
        elif box in ("any", style) and kind[i] in (LABEL, SENTENCE, BULLETED) and i not in marked and raw[i] > BOX_SCORE:
            box = style
        else:
            box = None
            if i not in outside:
                main.add(i)
    if not any(kind[i] != LABEL or DATE.search(lines[i]) for i in main if i != head or i in evidence):
        main = set()
    return [not k or i in main for i, k in enumerate(kind)]


def first_of_article(lines: list[str], live: list[int], kind: list[int], outside: set[int], evidence: int) -> int:
    """Where an article without a named headline begins: above its byline, else above its first evidence."""
    for above, i in zip(live, live[1:], strict=False):
        if i > evidence:
            break
        if kind[i] == LABEL and i not in outside and above not in outside and len(lines[i]) < 60 and DATE.search(lines[i]):
            return above
    above = max((i for i in live if i < evidence), default=-1)
    return above if above >= 0 and kind[above] == LABEL and above not in outside else evidence


def corpus_statistics(pages: DataFrame) -> tuple[Ratios, Pairs, Words]:
    """Ratios of the path steps, usual character pairs and words of the dictionaries, over all ``pages`` (title, text).

    Every line is counted, in each task first. At most ``1 << BITS`` sums and as many pairs
    as an alphabet allows (see ``corpus_counts``) reach the driver.
    """
    values = [f"v{i}" for i in range(len(SUMS))]

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(SUMS), (1 << BITS) + 1), np.int64)
        counts, words = count_pairs(()), count_pairs(())
        names = ["bucket", "pair", *values]

        def counted(rows: Pairs) -> Iterator[pa.RecordBatch]:
            if rows:
                spare = [pa.nulls(len(rows), pa.int64())] * (len(SUMS) - len(LANGUAGES))
                yield pa.RecordBatch.from_arrays([pa.nulls(len(rows), pa.int32()), pa.array(list(rows)), *(pa.array(c, pa.int64()) for c in zip(*rows.values(), strict=True)), *spare], names=names)

        for b in batches:
            texts = b.column("text").to_pylist()
            total += path_sums(Pages(b.column("title").to_pylist(), texts))
            count_pairs(texts, counts, words)
            if word_count_due(words):
                yield from counted(by_word(words))
        used = np.flatnonzero(total[0])
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.nulls(len(used), pa.string()), *(pa.array(t[used]) for t in total)], names=names)
        yield from counted(by_pair(counts))
        yield from counted(by_word(words))

    counted = pages.select("title", "text").mapInArrow(partial, "bucket int, pair string, " + ", ".join(f"{v} bigint" for v in values))
    rows = counted.groupBy("bucket", "pair").agg(*[F.sum(v).alias(v) for v in values])
    n = sum((F.col(v) for v in values[1 : len(LANGUAGES)]), F.col(values[0]))
    rows = materialise(rows.filter(F.col("bucket").isNotNull() | F.when(is_word(F.col("pair")), n > 1).otherwise(kept_pair(F.col("pair"), n))), "statistics")
    words = dictionary_words(rows.filter(is_word(F.col("pair"))).select("pair", *[F.col(v).alias(k) for v, k in zip(values, LANGUAGES, strict=False)]))
    t = rows.filter(F.col("bucket").isNotNull() | ~is_word(F.col("pair"))).select("bucket", "pair", *[F.col(v).cast("float").alias(v) for v in values]).toArrow()
    of_paths, of_pairs = t.filter(pc.is_valid(t.column("bucket"))), t.filter(pc.is_valid(t.column("pair")))
    sums = np.zeros((len(SUMS), (1 << BITS) + 1), np.float32)
    sums[:, of_paths.column("bucket").to_numpy()] = [of_paths.column(v).to_numpy() for v in values]
    pairs = zip(of_pairs.column("pair").to_pylist(), *(of_pairs.column(v).to_pylist() for v in values[: len(LANGUAGES)]), strict=True)
    return Ratios.of(sums), {p: tuple(map(int, n)) for p, *n in pairs}, words


def corpus_ratios(pages: DataFrame) -> Ratios:
    """Ratios of the path steps over all ``pages``."""
    return corpus_statistics(pages)[0]


def judge_pages(pages: DataFrame, ratios: Ratios, model: Model | None = None) -> DataFrame:
    """Body and surroundings of each page row.

    With a ``model`` of intact text, wrongly decoded pages are judged by their
    restored lines.

    Input columns ``origin, rec_id, url, title, text, version``; output ``origin,
    rec_id, version, outside`` (line numbers outside the main body, blank lines
    left out) and ``main_text``.
    """
    shared = pages.sparkSession.sparkContext.broadcast((ratios, model))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, intact = shared.value
        restorer = Restorer(intact) if intact else None

        def readable(text: str | None) -> str | None:
            if not text or restorer is None or not restorer.unusual(text):
                return text
            better = restorer.text(text)[0]
            return better if better.count("\n") == text.count("\n") else text

        for b in batches:
            urls, titles, texts = (b.column(c).to_pylist() for c in ("url", "title", "text"))
            main = judge(urls, titles, list(map(readable, texts)), known)
            outside = [[i for i, m in enumerate(page) if not m] for page in main]
            bodies = [None if t is None else "\n".join(x for x, m in zip(t.split("\n"), page, strict=False) if m).strip("\n") for t, page in zip(texts, main, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("origin"), b.column("rec_id"), b.column("version"), pa.array(outside, pa.list_(pa.int32())), pa.array(bodies, pa.string())], names=["origin", "rec_id", "version", "outside", "main_text"])

    return pages.select("origin", "rec_id", "url", "title", "text", "version").mapInArrow(apply, "origin string, rec_id bigint, version timestamp_ntz, outside array<int>, main_text string")
