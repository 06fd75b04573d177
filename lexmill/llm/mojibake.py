"""Texts decoded with the wrong character encoding: found and restored by description length.

A text is cut into sentences. For each sentence that holds an unusual pair of
neighbouring characters, candidate decodings are made by chains of steps: bytes
of UTF-8 that were read as a one-byte charset, or bytes of one such charset read
as another, up to MAX_STEPS deep. Every candidate is compressed with zstandard
dictionaries of its likely languages; the chain of least description length, its
own cost included, wins, else the sentence stays.

Edge cases: null, empty and ASCII texts are intact. Text that names or quotes a
garbled sequence (a single quoted token, or a sentence about wrong tables) is
intact. Characters lost for good (U+FFFD, ``?`` inside or before words) mark a
record as affected, though they can't be restored.
"""

from __future__ import annotations

import codecs
import random
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.session import materialise

# One-byte charsets that texts are taken for.
CHARSETS = ["cp1252", "latin-1", "cp1250", "cp1251", "cp1254", "koi8-r", "cp866", "cp437", "cp850", "mac-roman", "mac-cyrillic", "iso8859-5"]
# Frequent ASCII words of each language, to name a text's language.
STOPWORDS = {
    "en": "the and of to in is that for it was with on as by from not or this but are were",
    "de": "der die das und ist nicht mit ein eine von zu den im auf dem wird hat sie wenn nach",
    "fr": "le la les des et un une est pas dans pour que sur avec du ce qui sont par au",
    "es": "el los las una que por con para del se no su como entre desde otra lo y cada guarda",
}
LANGUAGES = [*STOPWORDS, "ru"]
# Wording of sentences about garbled text.
ABOUT = re.compile(r"misread|wrong (table|encoding|charset|code page)|sample of|in place of|die (Zeichen)?[Ff]olge|gemeint ist|есть пример|таблиц[аы] знаков|кодировк|mojibake|mal (leíd|codificad)|secuencia|séquence|mal (lue?s?|encodé)|encod", re.IGNORECASE)
STEP_COST = {"utf8": 1.0, "lower": 3.0, "swap": 3.0}
#: Bytes that each pair of characters unknown to the model adds to a description.
ESCAPE = 3.0
#: Steps of a chain, and the candidates (those with fewest unusual pairs) that a further step is tried on: more than one
#: step makes, so only third steps leave some out; in sentences above LONG_SENTENCE characters LONG_BEAM of them.
MAX_STEPS, BEAM, LONG_SENTENCE, LONG_BEAM = 3, 300, 1000, 2
#: No compressed text is shorter: magic number, frame header and window, block header.
FRAME = 9
#: Size of a dictionary, and the number of texts that ``sample_texts`` gives.
DICT_BYTES, SAMPLE = 48 << 10, 8000
#: Words of a language that may enter its dictionary (more than it has room for), places that they get in the texts it is
#: trained on, words of such a text, and words that a task counts before it hands them on.
DICT_WORDS, PLACES, TEXT_WORDS, COUNTED = 20_000, 300_000, 12, 200_000


@cache
def table(charset: str) -> str:
    """The 256 characters of a charset; bytes it leaves open are C1 controls."""
    out = []
    for b in range(256):
        try:
            out.append(bytes([b]).decode(charset))
        except UnicodeDecodeError:
            out.append(chr(b))
    return "".join(out)


@cache
def characters(charset: str) -> frozenset[str]:
    return frozenset(table(charset))


@cache
def to_bytes(charset: str) -> dict[int, str]:
    """Translation of characters to those of the same byte in Latin-1; unknown ones to U+FFFF."""
    m = {i: "￿" for i in range(256)}
    for b, c in reversed(list(enumerate(table(charset)))):
        m[ord(c)] = chr(b)
    return m


@cache
def encoder(charset: str) -> object:
    """Map of a charset's characters to its bytes."""
    return codecs.charmap_build(table(charset))


def as_bytes(text: str, charset: str) -> bytes | None:
    """The text in a charset, or None if it holds other characters."""
    try:
        return codecs.charmap_encode(text, "strict", encoder(charset))[0]
    except UnicodeEncodeError:
        return None


@cache
def swap_table(seen_as: str, really: str) -> dict[int, str]:
    """Translation for bytes of charset ``really`` that were read as ``seen_as``."""
    real = table(really)
    return {ord(c): real[b] for b, c in reversed(list(enumerate(table(seen_as)))) if b >= 128 and c != real[b]}


@cache
def sequences(charset: str) -> re.Pattern:
    """UTF-8 sequences as they look in a charset; U+FFFD may stand for a lost continuation."""
    t = table(charset)

    def chars(lo: int, hi: int, more: str = "") -> str:
        return "[" + re.escape("".join(t[b] for b in range(lo, hi + 1)) + more) + "]"

    tail = chars(0x80, 0xBF, "�")
    return re.compile(f"{chars(0xC2, 0xDF)}{tail}|{chars(0xE0, 0xEF)}{tail}{{2}}|{chars(0xF0, 0xF4)}{tail}{{3}}")


DEBRIS_SETS = ["cp1252", "latin-1", "cp1251", "cp437", "cp866", "mac-roman", "cp1250"]


@cache
def debris() -> re.Pattern:
    """Sure signs of misread UTF-8 in the corpus's scripts: Latin, Cyrillic and quotation marks."""
    found = []
    for c in DEBRIS_SETS:
        t = table(c)
        tail = "[" + re.escape("".join(t[0x80:0xC0]) + "\ufffd") + "]"
        found.append("[" + re.escape("".join(t[b] for b in (0xC2, 0xC3, 0xC5, 0xD0, 0xD1))) + "]" + tail)
        found.append(re.escape(t[0xE2] + t[0x80]) + tail)
    return re.compile("|".join(found))


@cache
def debris_bits() -> tuple[np.ndarray, np.ndarray]:
    """Per character a bit for each charset in which it may begin debris, and in which it may go on."""
    lead, tail = np.zeros(0x110000, np.uint8), np.zeros(0x110000, np.uint8)
    for i, c in enumerate(DEBRIS_SETS):
        t = table(c)
        lead[[ord(t[b]) for b in (0xC2, 0xC3, 0xC5, 0xD0, 0xD1, 0xE2)]] |= 1 << i
        tail[[*map(ord, t[0x80:0xC0]), 0xFFFD]] |= 1 << i
    return lead, tail


def has_debris(text: str, codes: np.ndarray) -> bool:
    """``debris`` searched for where the pairs of characters allow it."""
    lead, tail = debris_bits()
    return bool((lead[codes[:-1]] & tail[codes[1:]]).any()) and debris().search(text) is not None


def undo_utf8(text: str, charset: str) -> str:
    """Decode the UTF-8 sequences of ``text`` that were read as ``charset``; others stay."""
    bytes_of = to_bytes(charset)

    def real(m: re.Match) -> str:
        if "�" in m[0]:
            return "�"
        try:
            return m[0].translate(bytes_of).encode("latin-1").decode("utf-8")
        except (UnicodeDecodeError, UnicodeEncodeError):
            return m[0]

    return sequences(charset).sub(real, text)


@cache
def lowered(charset: str) -> tuple[re.Pattern, dict[str, str]]:
    """Garbled letters and marks after lower-casing, with what they stood for."""
    marks = [*map(chr, range(0xA0, 0x180)), *map(chr, range(0x400, 0x460)), *"–—‘’‚“”„…•№›‹"]
    seen: dict[str, str] = {}
    for c in sorted(marks, key=str.isupper):
        g = "".join(table(charset)[b] for b in c.encode("utf-8")).lower()
        seen.setdefault(g, c.lower())
    return re.compile("|".join(sorted(map(re.escape, seen), key=len, reverse=True))), seen


def undo_lowered(text: str, charset: str) -> str:
    pattern, seen = lowered(charset)
    return pattern.sub(lambda m: seen[m[0]], text)


CYRILLIC = frozenset(map(chr, range(0x430, 0x450)))


def undo_chain(text: str, chain: str) -> tuple[str, float]:
    """Text before the misreadings of a chain, undone from the last one on, and the chain's cost."""
    cost = 0.0
    for step in chain.split(" < "):
        really, _, seen = step.partition(" as ")
        if seen.endswith(", lower-cased"):
            text, cost = undo_lowered(text, seen.removesuffix(", lower-cased")), cost + STEP_COST["lower"]
        elif really == "utf-8":
            text, cost = undo_utf8(text, seen), cost + STEP_COST["utf8"]
        else:
            text, cost = text.translate(swap_table(seen, really)), cost + STEP_COST["swap"]
    return text, cost


DIGITS = "0123456789"
LETTERS = re.compile(r"[^\W\d_]{2,}")
LOST = re.compile(r"�|(?<![\w/=&.])[^\W\d_]{1,30}\?[^\W\d_]{1,30}(?![\w/=&])|(?:(?<=\s)|^)\?(?=[^\W\d_])|[,;]\?(?=\s|$)|(?<![\w?!.…»”\"'’)\]])\?{2,}(?=\s|$)")
BARE_LEAD = re.compile("[âÐÑÃÂ](?=[^\\W\\d_])")
BARE_ENGLISH = re.compile(r"(?:^|[\s(])â[A-Za-z]|[a-z,.]â(?:[\s,]|$)")
SENTENCE = re.compile(r"(\n|(?<=[.!?…;])[\"”»“’')\]]*\s+)")
QUOTED = re.compile(r"«[^ \n\t»]{1,24}»|“[^ \n\t”]{1,24}”|„[^ \n\t“”]{1,24}[“”]|[‘‹][^ \n\t’›]{1,24}[’›]|[\"'(\[][^ \n\t\"]{1,24}[\"')\]]")
AFTER_NAME = re.compile(r"(?<=[Ff]olge )[^ \n]+?(?=[,.;]?[ \n])")


def without_mentions(sentence: str) -> str:
    """The sentence without single quoted tokens, and without the token that it talks about."""
    if not ABOUT.search(sentence):
        return sentence
    return AFTER_NAME.sub("", QUOTED.sub("", sentence))


# Bytes of a text as words of a-z, and the languages of each stop word.
WORDS_ONLY = bytes(c if chr(c) in "abcdefghijklmnopqrstuvwxyz" else c + 32 if chr(c) in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" else 32 for c in range(256))
STOPWORD_OF = {w.encode(): [k for k, ws in STOPWORDS.items() if w in ws.split()] for ws in STOPWORDS.values() for w in ws.split()}


def language(text: str) -> str:
    hits = dict.fromkeys(STOPWORDS, 0)
    for w in filter(STOPWORD_OF.__contains__, text.encode("utf-8", "replace").translate(WORDS_ONLY).split()):
        for k in STOPWORD_OF[w]:
            hits[k] += 1
    return max(hits, key=lambda k: (hits[k], k == "en"))


def points(text: str) -> np.ndarray:
    """Code points of a text."""
    return np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)


def mostly_cyrillic(text: str, codes: np.ndarray) -> bool:
    cyrillic = int(((codes >= 0x400) & (codes < 0x500)).sum())
    return cyrillic > 0 and cyrillic >= 0.3 * sum(map(str.isalpha, text))


@dataclass
class Model:
    """Dictionaries per language and the character pairs usual in intact text."""

    dictionaries: dict[str, bytes]
    usual: frozenset[tuple[str, str]]


Pairs = dict[str, tuple[int, ...]]
Words = dict[str, list[tuple[str, int]]]


def kind_of(text: str, codes: np.ndarray) -> str | None:
    """Language that a text is counted under; None for those with UTF-8 debris."""
    if text.isascii():
        return language(text)
    if "�" in text or has_debris(text, codes):
        return None
    return "ru" if mostly_cyrillic(text, codes) else language(text)


def count_pairs(texts: Iterable[str | None], into: dict[str, Counter] | None = None, words: dict[str, Counter] | None = None) -> dict[str, Counter]:
    """Per language the number of texts, under "", and of texts that hold each pair of characters beyond ASCII.

    ``words`` gets the number of times that each word of three characters or more stands.
    """
    counts = {k: Counter() for k in LANGUAGES} if into is None else into
    found: dict[str, list[np.ndarray]] = {k: [] for k in LANGUAGES}
    for t in filter(None, texts):
        c = points(t)
        if lang := kind_of(t, c):
            counts[lang][""] += 1
            if words is not None:
                words[lang].update(t.split())
            if not t.isascii():
                a, b = c[:-1], c[1:]
                beyond = np.flatnonzero((a | b) > 127)
                found[lang].append(np.unique(a[beyond].astype(np.int64) << 21 | b[beyond]))
    for lang, keys in found.items():
        if keys:
            for k, n in zip(*(x.tolist() for x in np.unique(np.concatenate(keys), return_counts=True)), strict=True):
                counts[lang][chr(k >> 21) + chr(k & 0x1FFFFF)] += n
    return counts


def by_pair(counts: dict[str, Counter]) -> Pairs:
    return {p: tuple(counts[k][p] for k in LANGUAGES) for p in set().union(*counts.values())}


def kept_pair(pair: Column, n: Column) -> Column:
    """Whether a pair, held by ``n`` texts, can be usual, has a digit or stands for the number of texts."""
    return (n >= 3) | pair.rlike("[0-9]") | (pair == "")


def is_word(key: Column) -> Column:
    """Whether a counted key is a word; pairs have two characters."""
    return F.char_length(key) > 2


def by_word(words: dict[str, Counter]) -> Pairs:
    """Counts of the words of three characters or more, like those of pairs; ``words`` is emptied."""
    rows = {w: n for w, n in by_pair(words).items() if len(w) > 2}
    for c in words.values():
        c.clear()
    return rows


def word_count_due(words: dict[str, Counter]) -> bool:
    """Whether a task has counted so many words that it hands them on."""
    return sum(map(len, words.values())) > COUNTED


def dictionary_words(sums: DataFrame) -> Words:
    """Per language the ``DICT_WORDS`` words that fill most bytes of the corpus (of ``sums``: pair and a count for each language) with their counts.

    Words that stand once save nothing.
    """
    each = sums.select(F.col("pair").alias("word"), F.explode(F.array(*[F.struct(F.lit(k).alias("lang"), F.col(k).alias("n")) for k in LANGUAGES])).alias("c")).select("word", "c.lang", "c.n").filter("n > 1")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc(F.col("n") * F.octet_length("word")), "word"))
    found: Words = {k: [] for k in LANGUAGES}
    for r in each.withColumn("r", rank).filter(F.col("r") <= DICT_WORDS).orderBy("lang", "r").collect():
        found[r.lang].append((r.word, r.n))
    return found


def corpus_pairs(records: DataFrame) -> Pairs:
    """``count_pairs`` over all records (column ``text``)."""
    return corpus_counts(records)[0]


def corpus_counts(records: DataFrame) -> tuple[Pairs, Words]:
    """``count_pairs`` and the words of the dictionaries over all records (column ``text``), combined in each task.

    Pairs that fewer than three texts hold can't be usual and stay behind, unless they have a
    digit, so what reaches the driver is bounded by the alphabet.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, words = count_pairs(()), count_pairs(())

        def batch(rows: Pairs) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(rows), pa.string()), *(pa.array(c, pa.int64()) for c in zip(*rows.values(), strict=True))], names=["pair", *LANGUAGES])

        for b in batches:
            count_pairs(b.column("text").to_pylist(), counts, words)
            if word_count_due(words) and (rows := by_word(words)):
                yield batch(rows)
        for rows in (by_pair(counts), by_word(words)):
            if rows:
                yield batch(rows)

    n = F.expr(" + ".join(LANGUAGES))
    sums = records.select("text").mapInArrow(partial, "pair string, " + ", ".join(f"{k} bigint" for k in LANGUAGES)).groupBy("pair").agg(*[F.sum(k).alias(k) for k in LANGUAGES])
    sums = materialise(sums.filter(F.when(is_word(F.col("pair")), n > 1).otherwise(kept_pair(F.col("pair"), n))), "counts")
    return {r[0]: tuple(r[1:]) for r in sums.filter(~is_word(F.col("pair"))).collect()}, dictionary_words(sums.filter(is_word(F.col("pair"))))


def usual_pairs(pairs: Pairs) -> frozenset[tuple[str, str]]:
    """Pairs that stand in a share of the texts of a language; beside one digit is beside any."""
    texts = pairs.get("", (0,) * len(LANGUAGES))
    usual, digits = set(), Counter()
    for p, counts in pairs.items():
        if p:
            a, b = p
            if any(n >= max(3, 0.005 * of) for n, of in zip(counts, texts, strict=True)):
                usual.add((a, b))
            digits["0" if a in DIGITS else a, "0" if b in DIGITS else b] += sum(counts)
    for (a, b), n in digits.items():
        if n >= max(3, 0.002 * sum(texts)):
            usual |= {(x, y) for x in (DIGITS if a == "0" else a) for y in (DIGITS if b == "0" else b)}
    return frozenset(usual)


def word_texts(words: list[tuple[str, int]]) -> list[bytes]:
    """Texts in which each word stands about as often, of ``PLACES`` places in all, as among all words counted; at least once."""
    total = sum(n for _, n in words)
    places = [w for w, n in words for _ in range(max(1, round(n * min(PLACES, total) / total)))]
    random.Random(0).shuffle(places)
    return [" ".join(places[at : at + TEXT_WORDS]).encode() for at in range(0, len(places), TEXT_WORDS)]


def trained(pieces: list[bytes]) -> bytes:
    try:
        return zstandard.train_dictionary(DICT_BYTES, pieces).as_bytes()
    except zstandard.ZstdError:  # too little text: its own end is the dictionary
        return b"".join(pieces)[-DICT_BYTES:]


def fit_counts(pairs: Pairs, words: Words) -> Model:
    """Model of what ``corpus_counts`` found in all texts."""
    return Model({k: trained(word_texts(words[k])) for k in LANGUAGES}, usual_pairs(pairs))


def fit(texts: Iterable[str], pairs: Pairs | None = None) -> Model:
    """Model with dictionaries of the given texts and the pairs usual in all texts.

    ``pairs`` are those of ``corpus_pairs``; without them the sample counts as all texts.
    """
    texts = list(texts)
    by: dict[str, list[str]] = {k: [] for k in LANGUAGES}
    for t in filter(None, texts):
        if kind := kind_of(t, points(t)):
            by[kind].append(t)
    dictionaries = {k: trained([x.encode() for t in given for x in SENTENCE.split(t) if len(x) > 8]) for k, given in by.items()}
    return Model(dictionaries, usual_pairs(by_pair(count_pairs(texts)) if pairs is None else pairs))


def new_words(text: str, before: str) -> bool:
    """Whether a text has words (two letters or more) with letters beyond ASCII that it hadn't before."""
    return any(not w.isascii() and w not in before for w in LETTERS.findall(text))


def pair_table(usual: Iterable[tuple[str, str]]) -> tuple[np.ndarray, np.ndarray]:
    """Number of each character (0 if in no usual pair), and by two numbers whether the pair is usual; line ends go with all."""
    rows = [(ord(a), ord(b)) for a, b in usual]
    alphabet = sorted({c for r in rows for c in r} | {10})
    code = np.zeros(0x110000, np.uint16)
    code[alphabet] = np.arange(1, len(alphabet) + 1)
    table = np.zeros((len(alphabet) + 1,) * 2, bool)
    table[code[[a for a, _ in rows]], code[[b for _, b in rows]]] = True
    table[code[10], :] = table[:, code[10]] = True
    return code, table


class Restorer:
    """Chooses decodings of least description length under a model."""

    def __init__(self, model: Model):
        self.usual = model.usual | {(chr(a), chr(b)) for a in range(128) for b in range(128)}
        self.code, self.table = pair_table(self.usual)
        self.packers = {}
        for lang, raw in model.dictionaries.items():
            kind = zstandard.DICT_TYPE_AUTO
            d = zstandard.ZstdCompressionDict(raw, dict_type=kind) if raw else None
            self.packers[lang] = zstandard.ZstdCompressor(level=3, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)
        self.memo: dict[str, tuple[str, str]] = {}

    def unusual_at(self, text: str) -> list[int]:
        """Where a text holds unusual pairs, looked up for all its characters at once; line ends go with all."""
        if text.isascii():
            return []
        codes = self.code[points(text)]
        return np.flatnonzero(~self.table[codes[:-1], codes[1:]]).tolist()

    def unusual(self, text: str) -> bool:
        """Whether any line of a text holds an unusual pair."""
        return bool(self.unusual_at(text))

    def odd(self, text: str) -> int:
        """Unusual pairs of neighbouring characters, ASCII pairs aside."""
        return max(len(text) - 1, 0) - sum(map(self.usual.__contains__, zip(text, text[1:], strict=False)))

    def odds(self, texts: list[str]) -> list[int]:
        """``odd`` of many texts without line ends, looked up for all their characters at once."""
        if not texts:
            return []
        codes = self.code[points("\n".join(texts))]
        strange = np.concatenate([~self.table[codes[:-1], codes[1:]], [False]])
        starts = np.cumsum([0, *(len(t) + 1 for t in texts[:-1])])
        return np.add.reduceat(strange, starts, dtype=np.int64).tolist()

    def bare_lead(self, text: str, lang: str) -> bool:
        """Whether a lead byte of UTF-8 stands alone, its continuation dropped as a control character."""
        if lang == "en" and BARE_ENGLISH.search(text):
            return True
        return any((text[m.start() - 1 : m.start()], m[0]) not in self.usual and (m[0], text[m.end() : m.end() + 1]) not in self.usual for m in BARE_LEAD.finditer(text) if 0 < m.end() < len(text))

    def odd_stretch(self, text: str) -> tuple[int, int] | None:
        """From the first to the last word with an unusual pair, if that isn't the whole text."""
        spots = [m.span() for m in re.finditer(r"[^ \n]+", text) if self.odd(m[0])]
        return (spots[0][0], spots[-1][1]) if spots and (spots[0][0] > 0 or spots[-1][1] < len(text.rstrip())) else None

    def length(self, text: str, odd: int | None = None) -> float:
        """Least compressed size under any of the dictionaries, and ESCAPE for each unusual pair."""
        raw = text.encode("utf-8", "replace")
        return min(len(p.compress(raw)) for p in self.packers.values()) + ESCAPE * (self.odd(text) if odd is None else odd)

    def utf8_steps(self, text: str) -> Iterator[tuple[str, str, float]]:
        """Texts before one misreading of UTF-8: (text, step, cost)."""
        low = text == text.lower()
        for c in CHARSETS:
            yield undo_utf8(text, c), f"utf-8 as {c}", STEP_COST["utf8"]
            if low and c in ("cp1252", "latin-1", "cp1251", "cp1250", "mac-roman"):
                yield undo_lowered(text, c), f"utf-8 as {c}, lower-cased", STEP_COST["lower"]

    def swap_steps(self, text: str) -> Iterator[tuple[str, str, float]]:
        """Texts before one one-byte charset was read as another, as a whole or in the odd stretch only."""
        stretch = self.odd_stretch(text)
        part = text[stretch[0] : stretch[1]] if stretch else text
        strange = {c for c in part if c > "\x7f"}
        before, after = (text[: stretch[0]], text[stretch[1] :]) if stretch else ("", "")
        for c in CHARSETS:
            if not strange <= characters(c):
                continue
            whole, piece = as_bytes(text, c), as_bytes(part, c)
            for real in CHARSETS:
                if real != c:
                    to = table(real)
                    swapped = text.translate(swap_table(c, real)) if whole is None else codecs.charmap_decode(whole, "strict", to)[0]
                    yield swapped, f"{real} as {c}", STEP_COST["swap"]
                    if stretch:
                        yield before + codecs.charmap_decode(piece, "strict", to)[0] + after, f"{real} as {c}", STEP_COST["swap"]

    def sentence(self, text: str) -> tuple[str, str]:
        """Restored sentence and its chain ("" if left unchanged).

        Of each step all candidates are weighed, but those whose unusual pairs, steps and
        FRAME alone are no shorter than the best description so far.
        """
        done = self.memo.get(text)
        if done:
            return done
        best, chain, cost = text, "", self.length(text)
        front, seen = [(text, "", 0.0)], {text}
        for _ in range(MAX_STEPS):
            better, fresh = False, []
            for t, path, paid in front:
                for steps in (self.utf8_steps, self.swap_steps):
                    for c, step, price in steps(t):
                        if c not in seen and "￿" not in c:
                            seen.add(c)
                            fresh.append((len(c), paid + price, c, f"{path} < {step}" if path else step, steps == self.utf8_steps))
            fresh = sorted((odd, *f) for odd, f in zip(self.odds([f[2] for f in fresh]), fresh, strict=True))
            for odd, _, paid, c, path, words in fresh:
                if ESCAPE * odd + paid + FRAME < cost and (words or new_words(c, text)):
                    n = self.length(c, odd) + paid
                    if n < cost:
                        best, chain, cost, better = c, path, n, True
            if not better or not self.odd(best):  # nothing unusual is left that another step could mend
                break
            front = [(c, path, paid) for _, _, paid, c, path, _ in fresh[: BEAM if len(text) <= LONG_SENTENCE else LONG_BEAM]]
        if len(self.memo) > 50_000:
            self.memo.clear()
        self.memo[text] = best, chain
        return best, chain

    def as_before(self, text: str, chains: list[str]) -> tuple[str, str] | None:
        """The text restored by a chain of its neighbours, if that leaves nothing odd and pays."""
        for chain in dict.fromkeys(chains):
            c, paid = undo_chain(text, chain)
            if c != text and not self.odd(c) and self.length(c, 0) + paid < self.length(text):
                return c, chain
        return None

    def text(self, text: str | None) -> tuple[str | None, str, bool]:
        """Restored text, the chains used, and whether characters are lost for good."""
        if not text:
            return text, "", False
        lost_sign = "?" in text or "�" in text
        if text.isascii() and not lost_sign:
            return text, "", False
        spots = self.unusual_at(text)
        if not spots and not (lost_sign and LOST.search(text)):
            return text, "", False
        lang, out, chains, known, lost = language(text), [], [], [], False
        pieces = SENTENCE.split(text)
        cores, strange, at = [], [], 0
        for p in pieces:  # a piece is strange if an unusual pair lies within it
            k = bisect_left(spots, at)
            within = k < len(spots) and spots[k] < at + len(p) - 1
            core = without_mentions(p) if within or (p and lost_sign) else p
            cores.append(core)
            strange.append(within if core == p else bool(self.odds([core])[0]))
            at += len(p)
        oddest = [c for c, s in zip(cores, strange, strict=True) if s]
        if len(oddest) > 2:  # the oddest piece tells most about how the text was misread
            known += [c for c in [self.sentence(oddest[int(np.argmax(self.odds(oddest)))])[1]] if c]
        for piece, core, within in zip(pieces, cores, strange, strict=True):
            if within:
                fixed, chain = self.as_before(core, known) or self.sentence(core)
                if chain and core is not piece:
                    fixed, chain = self.sentence(piece)
                if chain:
                    chains.append(chain)
                    known.append(chain)
                    piece, core = fixed, fixed
            if piece:
                lost = lost or (lost_sign and LOST.search(core) is not None) or "�" in core or (bool(oddest) and self.bare_lead(core, lang))
            out.append(piece)
        return "".join(out), "; ".join(dict.fromkeys(chains)), lost


def sample_texts(records: DataFrame, size: int = SAMPLE) -> list[str]:
    """About ``size`` texts picked by key hash, to try a model on.

    The share is set from the number of records, so each task sends its share only.
    """
    share = min(1.0, size / max(records.count(), 1))
    picked = records.filter(F.col("text").isNotNull() & (F.pmod(F.xxhash64("origin", "rec_key"), F.lit(1 << 30)) < int(share * (1 << 30))))
    return sorted(r.text for r in picked.select("text").limit(2 * size).collect())


RESTORED = "origin string, rec_key string, restored string, chain string, lost boolean, version timestamp_ntz"


def affected(records: DataFrame, model: Model) -> DataFrame:
    """Affected records with restored text, chain of misreadings and whether characters are lost.

    Input columns ``origin, rec_key, text`` and any ``version``. Repeated rows give repeated results.
    """
    shared = records.sparkSession.sparkContext.broadcast(model)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(shared.value)
        for b in batches:
            rows = []
            for origin, key, text, version in zip(*(b.column(c).to_pylist() for c in ("origin", "rec_key", "text", "version")), strict=True):
                restored, chain, lost = restorer.text(text)
                if chain or lost:
                    rows.append((origin, key, restored, chain, lost, version))
            if rows:
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.string()] * 4 + [pa.bool_(), pa.timestamp("us")], strict=True)], names=["origin", "rec_key", "restored", "chain", "lost", "version"])

    dated = records if "version" in records.columns else records.withColumn("version", F.lit(None))
    return dated.select("origin", "rec_key", "text", F.col("version").cast("timestamp_ntz")).mapInArrow(apply, RESTORED)
