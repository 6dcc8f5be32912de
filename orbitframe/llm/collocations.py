"""Phrases whose words occur together more often than apart, per language, with exact counts.

Texts are bytes with A-Z lowered; pieces end at ``BREAKS``, words at blanks. Every n-gram of words
inside a piece has a Rabin-Karp fingerprint: a prefix polynomial over the bytes gives each word's
value, a prefix polynomial over these the value of every n-gram, all in numpy modulo 2**64 (odd
bases have inverses). Tasks add up equal fingerprints of a slab of text, the shuffle adds up the
rest and keeps a pointer to one occurrence. A level (n words) looks only at n-grams whose two
parts of n - 1 words passed the level before, as others cannot be frequent. What passed is a bitmap
of a fixed number of bits, so a crowded one lets more through, never less.

A second polynomial rides along. Fingerprints whose second values differ belong to different
phrases; these are counted again by their text. Frequent fingerprints alone are turned into phrases,
through their pointers. Phrases that agree in both values (odds of 2**-128 a pair) count as one.

Null texts are empty; a null lang is ``und``. Repeated rows count each; other columns are left out,
whatever their names; an empty table gives an empty result. Texts of any length are scanned whole,
in slabs of words, and bytes in chunks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from orbitframe.llm.common import batch, saved, texts

BREAKS = b".,;:!?\n\x0b\x0c\r"
MAX_WORDS = 4
LONGEST = 64
MIN_COUNT = 30
TOP = 2000
SCALE = 2_000_000
COVERED = (80, 100)
FILTER_BITS = 26
SLAB_WORDS = 1 << 18
CHUNK_BYTES = 1 << 18
JOIN_BYTES = 2 << 20
_ROWS = pa.schema([("lang", pa.string()), ("fp", pa.int64()), ("count", pa.int64()),
                   ("second", pa.int64()), ("text_key", pa.int64()), ("start", pa.int64()),
                   ("length", pa.int64())])
_ROW_SQL = "lang string, fp long, count long, second long, text_key long, start long, length long"
_PHRASES = pa.schema([("lang", pa.string()), ("fp", pa.int64()), ("phrase", pa.string()),
                      ("n_words", pa.int32()), ("count", pa.int64())])
_PHRASE_SQL = "lang string, fp long, phrase string, n_words int, count long"


def _kinds() -> tuple[np.ndarray, np.ndarray]:
    """For every byte: whether it ends a piece, whether it belongs to a word."""
    breaks = np.zeros(256, bool)
    breaks[list(BREAKS)] = True
    word = ~breaks
    word[[0x20, 0x09]] = False
    return breaks, word


_BREAK, _WORD = _kinds()
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Polynomial:
    """Prefix polynomials in an odd base modulo 2**64 over bytes and over words."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.letters = _mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(base))
        size = max(CHUNK_BYTES, SLAB_WORDS + LONGEST) + 1
        self.powers, self.inverses = self._powers(base, size), self._powers(self.inverse, size)

    @staticmethod
    def _powers(base: int, size: int) -> np.ndarray:
        steps = np.full(size, base, np.uint64)
        steps[0] = 1
        return np.multiply.accumulate(steps)

    def _prefix(self, data: np.ndarray, places: np.ndarray) -> np.ndarray:
        """The prefix polynomial of ``data`` at ascending ``places``, chunk by chunk."""
        out = np.zeros(len(places), np.uint64)
        carry, scale = 0, 1
        for lo in range(0, len(data), CHUNK_BYTES):
            sums = np.cumsum(self.letters[data[lo:lo + CHUNK_BYTES]] * self.powers[:min(
                CHUNK_BYTES, len(data) - lo)], dtype=np.uint64)
            a, b = np.searchsorted(places, [lo, lo + len(sums)], "right")
            out[a:b] = np.uint64(carry) + np.uint64(scale) * sums[places[a:b] - lo - 1]
            carry = (carry + scale * int(sums[-1])) & ((1 << 64) - 1)
            scale = scale * pow(self.base, CHUNK_BYTES, 1 << 64) & ((1 << 64) - 1)
        return out

    def words(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The value of every word, whatever its place."""
        if not len(starts):
            return np.zeros(0, np.uint64)
        raw = self._prefix(data, ends) - self._prefix(data, starts)
        chunk = starts // CHUNK_BYTES
        far = self._powers(pow(self.inverse, CHUNK_BYTES, 1 << 64), int(chunk[-1]) + 1)
        return _mixed(raw * far[chunk] * self.inverses[starts % CHUNK_BYTES])

    def grams(self, values: np.ndarray, n: int) -> np.ndarray:
        """The value of every run of ``n`` of at most a slab of words."""
        prefix = np.concatenate([[np.uint64(0)], np.cumsum(
            values * self.powers[:len(values)], dtype=np.uint64)])
        return _mixed((prefix[n:] - prefix[:-n]) * self.inverses[:len(values) - n + 1]
                      + np.uint64(n))


def _joined(keys: list, langs: list, values: Iterator[bytes]) -> Iterator[tuple]:
    """(bytes, begin of each text, its key, its lang) of texts of one lang, joined by a break."""
    pending: dict = {}
    for key, lang, value in zip(keys, langs, values):
        parts = pending.setdefault(lang, [0, [], [], []])
        if parts[1] and parts[0] + len(value) > JOIN_BYTES:
            yield b"\n".join(parts[1]), parts[2], parts[3], lang
            parts = pending[lang] = [0, [], [], []]
        parts[1].append(value)
        parts[2].append(parts[0])
        parts[3].append(key)
        parts[0] += len(value) + 1
    for lang, parts in pending.items():
        yield b"\n".join(parts[1]), parts[2], parts[3], lang


class Scanner:
    """Fingerprints of the n-grams of joined texts that ``passed`` lets through."""

    def __init__(self, n: int, passed: np.ndarray | None, seed: int, bits: int):
        self.n, self.passed, self.keep = n, passed, np.uint64(64 - bits)
        self.first, self.second = Polynomial(2 * seed + 0x9E3779B97F4A7C15), Polynomial(
            2 * seed + 0xC2B2AE3D27D4EB4F)

    def _fingerprints(self, values: np.ndarray, n: int, salt: np.uint64) -> np.ndarray:
        return _mixed(self.first.grams(values, n) ^ salt) >> self.keep

    def values(self, phrases: list[bytes], lang: str) -> list:
        """The fingerprint of each phrase; None for what is no phrase of n words."""
        found = [v for fp, *_ in self.slabs(b"\n".join(phrases), lang) for v in fp.view(np.int64).tolist()]
        if len(phrases) > 1 and len(found) != len(phrases):
            return [v for p in phrases for v in self.values([p], lang)]
        return found if len(found) == len(phrases) else [None]

    def slabs(self, data: bytes, lang: str) -> Iterator[tuple]:
        """(fingerprint, second value, first byte, end byte) of what passes, slab by slab."""
        raw = _LOWER[np.frombuffer(data, np.uint8)]
        word = np.zeros(len(raw) + 2, bool)
        word[1:-1] = _WORD[raw]
        edges = np.flatnonzero(word[1:] != word[:-1])
        starts, ends = edges[::2].copy(), edges[1::2].copy()
        piece = np.searchsorted(np.flatnonzero(_BREAK[raw]), starts)
        a, b = (p.words(raw, starts, ends) for p in (self.first, self.second))
        salt = _mixed(self.first.words(np.frombuffer(lang.encode() + b" ", np.uint8),
                                       np.array([0]), np.array([len(lang.encode()) + 1])))[0]
        for lo in range(0, len(starts) - self.n + 1, SLAB_WORDS):
            hi = min(lo + SLAB_WORDS + self.n - 1, len(starts))
            last = hi - self.n + 1
            at = np.flatnonzero(piece[lo:last] == piece[lo + self.n - 1:hi])
            if self.passed is not None:
                part = _passes(self.passed, self._fingerprints(a[lo:hi], self.n - 1, salt),
                               64 - int(self.keep))
                at = at[part[at] & part[at + 1]]
            yield (self._fingerprints(a[lo:hi], self.n, salt)[at],
                   self.second.grams(b[lo:hi], self.n)[at], starts[lo + at],
                   ends[lo + at + self.n - 1])


def _passes(bitmap: np.ndarray, fingerprints: np.ndarray, bits: int) -> np.ndarray:
    place = fingerprints >> np.uint64(max(bits - int(len(bitmap)).bit_length() - 5, 0))
    return (bitmap[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1) > 0


def _bitmap(frequent: DataFrame, filter_bits: int, bits: int) -> np.ndarray:
    """Which values of the upper ``filter_bits`` bits frequent fingerprints have: a fixed size."""
    place = F.shiftrightunsigned("fp", max(bits - filter_bits, 0))
    words = frequent.select(place.alias("place")).groupBy(
        F.shiftrightunsigned("place", 6).alias("word")).agg(F.bit_or(F.expr(
            "shiftleft(1L, cast(place & 63 as int))")).alias("bits")).toArrow()
    out = np.zeros(1 << max(filter_bits - 6, 0), np.uint64)
    out[words["word"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
    return out


def _added_up(fp: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order by fingerprint, where in it runs of equal values begin, and their lengths.

    Where equal fingerprints have different second values, these may come in turns: more runs then,
    which add up to the same.
    """
    order = np.argsort(fp)
    fp, second = fp[order], second[order]
    new = np.ones(len(fp), bool)
    new[1:] = (fp[1:] != fp[:-1]) | (second[1:] != second[:-1])
    new = np.flatnonzero(new)
    return order, new, np.diff(new, append=len(order))


def _scan(docs: DataFrame, make: Callable[[], Scanner]) -> DataFrame:
    """(lang, fp, count, second and a pointer): the distinct values of each slab, added up."""
    def run(batches):
        scanner = make()
        for rows in batches:
            for data, begins, keys, lang in _joined(
                    rows.column(0).to_pylist(), rows.column(1).to_pylist(), texts(rows.column(2))):
                begins = np.array(begins, np.int64)
                for fp, second, start, end in scanner.slabs(data, lang):
                    order, new, count = _added_up(fp, second)
                    at = order[new]
                    start, end = start[at], end[at]
                    doc = np.searchsorted(begins, start, "right") - 1
                    yield batch(
                        _ROWS, lang=pa.repeat(lang, len(new)), fp=fp[at].view(np.int64),
                        count=count, second=second[at].view(np.int64),
                        text_key=np.array(keys, np.int64)[doc], start=start - begins[doc],
                        length=end - start)

    return docs.mapInArrow(run, _ROW_SQL)


def _prepared(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.xxhash64(text).alias("text_key"),
                       F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"),
                       text.cast("binary").alias("text"))


def phrase_of(data: bytes) -> str:
    """A phrase as it is reported: lower case, words joined by one space."""
    return b" ".join(data.lower().split()).decode()


def _resolved(docs: DataFrame, pointers: DataFrame, make: Callable[[int], Scanner]) -> DataFrame:
    """(lang, fp, phrase, n_words, count): the text at each pointer, if it has the fingerprint."""
    def run(batches):
        scanners: dict = {}
        for rows in batches:
            for data, found in zip(texts(rows.column(0)), rows.column(1)):
                groups: dict = {}
                for p in found.as_py():
                    groups.setdefault((p["lang"], p["n_words"]), []).append(p)
                for (lang, n), group in groups.items():
                    scanner = scanners.get(n) or scanners.setdefault(n, make(n))
                    cut = [data[p["start"]:p["start"] + p["length"]] for p in group]
                    values = scanner.values(cut, lang)
                    right = [(p, c) for p, c, v in zip(group, cut, values) if p["fp"] == v]
                    yield batch(_PHRASES, lang=[lang] * len(right), fp=[p["fp"] for p, _ in right],
                                n_words=[n] * len(right), count=[p["count"] for p, _ in right],
                                phrase=[phrase_of(c) for _, c in right])

    wanted = pointers.groupBy("text_key").agg(F.collect_list(F.struct(
        "lang", "fp", "n_words", "count", "start", "length")).alias("found"))
    # copies of a text go together inside map tasks; texts of equal keys are told apart by fingerprints
    once = docs.select("text_key", "text").distinct()
    return once.join(wanted, "text_key").select("text", "found").mapInArrow(run, _PHRASE_SQL)


def _recounted(docs: DataFrame, make: Callable[[], Scanner], mixed: np.ndarray, bits: int,
               n: int) -> DataFrame:
    """(lang, fp, phrase, n_words, count) of the fingerprints in ``mixed``, counted by their text."""
    def run(batches):
        scanner = make()
        for rows in batches:
            for data, _, _, lang in _joined(
                    rows.column(0).to_pylist(), rows.column(1).to_pylist(), texts(rows.column(2))):
                for fp, _, start, end in scanner.slabs(data, lang):
                    at = np.flatnonzero(_passes(mixed, fp, bits))
                    yield batch(_PHRASES, lang=pa.repeat(lang, len(at)), fp=fp[at].view(np.int64),
                                n_words=np.full(len(at), n), count=np.ones(len(at), np.int64),
                                phrase=[phrase_of(data[s:e]) for s, e in zip(start[at], end[at])])

    return docs.mapInArrow(run, _PHRASE_SQL).groupBy("lang", "fp", "phrase", "n_words").agg(
        F.sum("count").alias("count"))


def frequent_phrases(docs: DataFrame, max_words: int = MAX_WORDS, min_count: int = MIN_COUNT,
                     filter_bits: int = FILTER_BITS, bits: int = 64, seed: int = 0
                     ) -> tuple[DataFrame, DataFrame]:
    """((lang, n_words, phrase, count) of all phrases that are frequent, (lang, n) of all words).

    ``bits`` cuts fingerprints short, which makes collisions likely; the result stays the same.
    """
    rows = _prepared(docs)
    filter_bits = min(filter_bits, bits)
    clear, phrases, totals, passed = [], [], None, None
    for n in range(1, max_words + 1):
        make = lambda n=n, passed=passed: Scanner(n, passed, seed, bits)
        counted = _scan(rows, make).groupBy("lang", "fp").agg(
            F.sum("count").alias("count"), F.min("second").alias("low"),
            F.max("second").alias("high"), F.first("text_key").alias("text_key"),
            F.first("start").alias("start"), F.first("length").alias("length"))
        if n == 1:
            counted = saved(counted)
            totals = counted.groupBy("lang").agg(F.sum("count").alias("n"))
        frequent = saved(counted.where(F.col("count") >= min_count).withColumn("n_words", F.lit(n)))
        clear.append(frequent.where("low = high"))
        mixed = frequent.where("low <> high").select("lang", "fp")
        if not mixed.isEmpty():
            again = _recounted(rows, make, _bitmap(mixed, filter_bits, bits), bits, n)
            phrases.append(again.join(mixed, ["lang", "fp"], "left_semi").where(
                F.col("count") >= min_count))
        passed = _bitmap(frequent, filter_bits, bits)
        if not passed.any():
            break
    pointers = reduce(DataFrame.unionByName, clear)
    phrases.append(_resolved(rows, pointers, lambda n: Scanner(n, None, seed, bits)))
    return saved(reduce(DataFrame.unionByName, phrases).select(
        "lang", "n_words", "phrase", "count")), totals


def _part(first: Column, length: Column) -> Column:
    return F.array_join(F.slice(F.col("words"), first, length), " ")


def collocations(docs: DataFrame, max_words: int = MAX_WORDS, min_count: int = MIN_COUNT,
                 top: int = TOP, **scan) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the highest scores of each lang.

    A phrase is cut into two parts at every place; the cut with the lowest score counts. Phrases that
    mostly occur inside one longer candidate are left out.
    """
    known, totals = frequent_phrases(docs, max_words, min_count, **scan)
    candidates = known.where("n_words > 1").select(
        "lang", "phrase", "n_words", F.col("count").alias("a"), F.split("phrase", " ").alias("words"))
    cuts = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("n_words") - 1)))
    side = lambda name, column: known.select(
        "lang", F.col("phrase").alias(name), F.col("count").alias(column))
    cuts = cuts.select("lang", "phrase", "n_words", "a", "k", _part(F.lit(1), F.col("k")).alias("left"),
                       _part(F.col("k") + 1, F.col("n_words") - F.col("k")).alias("right"))
    scored = cuts.join(side("left", "l"), ["lang", "left"]).join(side("right", "r"), ["lang", "right"])
    # 2,000,000 a may pass 64 bits
    score = F.expr(f"cast(a as decimal(20, 0)) * {SCALE} div (cast(l as decimal(20, 0)) + r)")
    best = scored.withColumn("score", score).groupBy("lang", "phrase", "a").agg(
        F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    inside = candidates.where("n_words > 2").withColumn(
        "m", F.explode(F.sequence(F.lit(2), F.col("n_words") - 1))).withColumn(
            "from", F.explode(F.sequence(F.lit(1), F.col("n_words") - F.col("m") + 1)))
    longer = inside.select("lang", _part(F.col("from"), F.col("m")).alias("phrase"), "a").groupBy(
        "lang", "phrase").agg(F.max("a").alias("longest"))
    share, whole = COVERED
    kept = best.join(longer, ["lang", "phrase"], "left").where(F.expr(
        f"longest IS NULL OR cast(longest as decimal(20, 0)) * {whole} < cast(a as decimal(20, 0)) * {share}"))
    place = Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), "phrase")
    return kept.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= top).join(
        totals, "lang").select("lang", F.col("rank").cast("long"), "phrase", "a", "cut.l", "cut.r", "n",
                               F.col("cut.score").cast("long").alias("score"))
