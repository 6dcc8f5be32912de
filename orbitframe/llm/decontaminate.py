"""Benchmark items inside training documents: rare n-gram seeds, then local alignment.

The words of the items are counted over the whole corpus. Seeds are n-grams that chance alone would
seldom form (by the frequencies of their words, so copies of the item do not count against it). At
each place these are the three words' sequences in four words that keep the first, whether or not
one between is skipped, on the item's side or the document's: a copy that scores half has two of
three words left, so some four in a row hold three of them, whatever was replaced, put in or left
out. Where the three next words are too common, the shortest longer n-gram that is not takes their
place. Documents that hold a seed meet the item; a Smith-Waterman alignment of the item with the
words around the seeds gives the score, 1 for an exact copy. Items come in blocks of bounded size,
which are all that is broadcast, as sorted arrays.

Null and empty texts and empty tables hold nothing; very long texts are searched whole, in
overlapping parts; extra columns may have any name.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from orbitframe.llm.common import batch

MIN_SCORE = 0.5
MIN_WORDS = 5
CHANCE = 20.0
GRAMS = range(3, 9)
#: places of the three words of a seed in a window of four
SKIPS = ((0, 1, 2), (0, 1, 3), (0, 2, 3))
BLOCK_BYTES = 16 << 20
MATCH, MISMATCH, GAP = 2, -1, -1
_PART = 1 << 18
_WORD = re.compile(r"[^\W_]+")
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_FOUND = pa.schema([
    ("doc_id", pa.int64()), ("item_id", pa.int64()), ("score", pa.float64()),
    ("matches", pa.int32()), ("first_word", pa.int64()), ("last_word", pa.int64())])
_FOUND_DDL = ("doc_id long, item_id long, score double, matches int, first_word long, "
              "last_word long")
_COUNTS = pa.schema([("word", pa.int32()), ("n", pa.int64())])


def words_of(text: str | None) -> list[str]:
    """Lower-case runs of letters and digits."""
    return _WORD.findall((text or "").lower())


class _Items:
    """A block of items as numbered words."""

    def __init__(self, rows: list[tuple[int, str]]):
        self.numbers: dict[str, int] = {}
        self.ids, self.words = [], []
        for item_id, text in rows:
            found = words_of(text)
            if len(found) >= MIN_WORDS:
                self.ids.append(item_id)
                self.words.append(np.array(
                    [self.numbers.setdefault(w, len(self.numbers) + 1) for w in found], np.int64))

    def numbered(self, text: str | None) -> np.ndarray:
        """The words of a text by number; 0 is a word of no item."""
        get = self.numbers.get
        return np.array([get(w, 0) for w in words_of(text)], np.int64)


def _shapes(n: int) -> tuple[tuple[int, ...], ...]:
    return SKIPS if n == GRAMS[0] else (tuple(range(n)),)


def _keys(numbers: np.ndarray, shape: tuple[int, ...]) -> np.ndarray:
    """A hash of the words at the places ``shape`` from each place on."""
    out = np.zeros(max(len(numbers) - shape[-1], 0), np.uint64)
    values = numbers.astype(np.uint64)
    with np.errstate(over="ignore"):
        for i in shape:
            out = (out + values[i:i + len(out)] + np.uint64(1)) * _FACTOR
            out ^= out >> np.uint64(29)
    return out


class Seeds:
    """Where rare n-grams stand in items, and their search in documents."""

    def __init__(self, items: _Items, counts: dict[int, int], total: int):
        share = np.zeros(len(items.numbers) + 1)
        for word, n in counts.items():
            share[word] = n / max(total, 1)
        found: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = defaultdict(list)

        def put(n, item, keys, starts):
            found[n].append((keys, np.full(len(keys), item), starts))

        for item, numbers in enumerate(items.words):
            rare_somewhere = False
            settled = np.zeros(len(numbers), bool)
            for n in GRAMS:
                for shape in _shapes(n):
                    size = max(len(numbers) - shape[-1], 0)
                    chance = total * np.prod([share[numbers[i:i + size]] for i in shape], axis=0)
                    plain = shape[-1] == n - 1
                    rare = (chance * len(_shapes(n)) <= CHANCE) & ~(settled[:size] & plain)
                    starts = np.flatnonzero(rare)
                    put(n, item, _keys(numbers, shape)[starts], starts)
                    rare_somewhere |= len(starts) > 0
                    if plain:
                        settled[starts] = True
            if not rare_somewhere:  # nothing rare in it: its longest n-grams
                n = min(len(numbers), GRAMS[-1])
                keys = _keys(numbers, tuple(range(n)))
                put(n, item, keys, np.arange(len(keys)))
        self.places, self.marks = {}, {}
        for n, parts in found.items():
            keys, item, start = (np.concatenate(x) for x in zip(*parts))
            order = np.argsort(keys, kind="stable")
            if len(order):
                self.places[n] = keys[order], item[order], start[order]
                self.marks[n] = np.zeros(1 << 20, bool)
                self.marks[n][keys >> np.uint64(44)] = True

    def find(self, numbers: np.ndarray) -> list[tuple[int, int, int]]:
        """(item, place in the item, place in ``numbers``) of all seeds."""
        out = []
        for n, (known, item, start) in self.places.items():
            for shape in _shapes(n):
                keys = _keys(numbers, shape)
                at = np.flatnonzero(self.marks[n][keys >> np.uint64(44)])
                low = np.searchsorted(known, keys[at])
                real = known[np.minimum(low, len(known) - 1)] == keys[at]
                at, low = at[real], low[real]
                high = np.searchsorted(known, keys[at], "right")
                for a, b, place in zip(low.tolist(), high.tolist(), at.tolist()):
                    out += [(int(item[i]), int(start[i]), place) for i in range(a, b)]
        return out


def smith_waterman(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int, int]:
    """Best local score, equal words in it, and its first and last place in ``text``.

    Row by row; along a row, gaps are a running maximum. Ties: the alignment that ends first.
    """
    grid = np.zeros((len(item) + 1, len(text) + 1), np.int32)
    slope = -GAP * np.arange(len(text) + 1, dtype=np.int32)
    for i, word in enumerate(item, 1):
        row = np.zeros(len(text) + 1, np.int32)
        row[1:] = np.maximum(grid[i - 1, :-1] + np.where(text == word, MATCH, MISMATCH),
                             grid[i - 1, 1:] + GAP)
        grid[i] = np.maximum(np.maximum.accumulate(np.maximum(row, 0) + slope) - slope, 0)
    best = int(grid.max())
    j = last = int(np.flatnonzero((grid == best).any(0))[0])
    i = int(np.flatnonzero(grid[:, j] == best)[0])
    matches = 0
    while grid[i, j] > 0:
        same = item[i - 1] == text[j - 1]
        if grid[i, j] == grid[i - 1, j - 1] + (MATCH if same else MISMATCH):
            matches += int(same)
            i, j = i - 1, j - 1
        elif grid[i, j] == grid[i - 1, j] + GAP:
            i -= 1
        else:
            j -= 1
    return best, matches, j, last - 1


def _regions(hits: list[tuple[int, int]], length: int, size: int):
    """Spans of a document around seeds of one item; seeds that are near share a span."""
    spans = sorted((at - start - length // 2, at - start + length + length // 2) for start, at in hits)
    first, last = spans[0]
    for a, b in spans[1:]:
        if a > last:
            yield max(0, first), min(size, last)
            first = a
        last = max(last, b)
    yield max(0, first), min(size, last)


def _joined(items: _Items, texts: list) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Numbered texts in groups of about ``_PART`` words, with the place of each group's first."""
    first, held, size = 0, [], 0
    for i, text in enumerate(texts):
        held.append(items.numbered(text))
        size += len(held[-1])
        if size >= _PART:
            yield first, held
            first, held, size = i + 1, [], 0
    if held:
        yield first, held


def found_in(items: _Items, seeds: Seeds, texts: list, min_score: float):
    """(place of the text, item, score, equal words, first word, last word) of items in texts.

    Seeds are searched in many texts at once. Between two of them stand words of no item, so no seed
    reaches from one into the other.
    """
    gap = np.zeros(GRAMS[-1], np.int64)
    for first, held in _joined(items, texts):
        line = np.concatenate([x for numbers in held for x in (numbers, gap)])
        starts = np.cumsum([0] + [len(numbers) + len(gap) for numbers in held])
        hits = defaultdict(lambda: defaultdict(list))
        for begin in range(0, len(line), _PART):
            for item, start, at in seeds.find(line[begin:begin + _PART + GRAMS[-1] - 1]):
                doc = int(np.searchsorted(starts, begin + at, "right")) - 1
                hits[doc][item].append((start, begin + at - int(starts[doc])))
        for doc, of_doc in sorted(hits.items()):
            for row in align(items, of_doc, held[doc], min_score):
                yield first + doc, *row


def align(items: _Items, hits: dict[int, list[tuple[int, int]]], numbers: np.ndarray, min_score: float):
    """(item, score, equal words, first word, last word) of items in one document, around its seeds."""
    for item, found in sorted(hits.items()):
        words = items.words[item]
        different = np.unique(words)
        best = None
        for a, b in _regions(found, len(words), len(numbers)):
            for begin in range(a, b, 64 * len(words)):  # a long span, in overlapping parts
                part = numbers[begin:min(b, begin + 66 * len(words))]
                # an alignment that scores enough has this many equal words at least
                if np.isin(part, different).sum() < min_score * len(words):
                    continue
                score, matches, first, last = smith_waterman(words, part)
                if best is None or score > best[0]:
                    best = score, matches, begin + first, begin + last
        if best is None:
            continue
        score = best[0] / (MATCH * len(words))
        if score >= min_score:
            yield item, score, *best[1:]


def _blocks(benchmark: DataFrame, block_bytes: int):
    """The items in blocks of about ``block_bytes`` of text."""
    rows = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where(
        "item_id is not null and text is not null").distinct()
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = ceil(size / block_bytes)
    for i in range(n):
        block = F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i
        found = _Items(sorted(map(tuple, rows.where(block).collect())))
        if found.ids:
            yield found


def _word_counts(docs: DataFrame, items) -> tuple[dict[int, int], int]:
    """How often the items' words occur in all documents, and how many words these have."""
    def run(batches):
        own = items.value
        counts = np.zeros(len(own.numbers) + 1, np.int64)
        for rows in batches:
            for text in rows.column(0).to_pylist():
                counts += np.bincount(own.numbered(text), minlength=len(counts))
        used = np.flatnonzero(counts)
        yield batch(_COUNTS, word=used, n=counts[used])

    rows = docs.select(F.col("text").cast("string")).mapInArrow(run, "word int, n long").groupBy(
        "word").agg(F.sum("n")).collect()  # at most the words of a block of items
    counts = dict(map(tuple, rows))
    return counts, sum(counts.values())


def contaminated(docs: DataFrame, benchmark: DataFrame, min_score: float = MIN_SCORE,
                 block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, item_id, score, matches, first_word, last_word) of items found in documents.

    The score is that of the best local alignment, divided by that of an exact copy; one row for
    each pair with at least ``min_score``. Items with fewer than MIN_WORDS words or a null id are
    not sought; repeated item rows are one item, an id with several texts may come up for each.
    Null and empty texts hold nothing. Other columns are ignored.
    """
    spark = docs.sparkSession
    out = spark.createDataFrame([], _FOUND_DDL)
    for block in _blocks(benchmark, block_bytes):
        items = spark.sparkContext.broadcast(block)
        seeds = spark.sparkContext.broadcast(Seeds(block, *_word_counts(docs, items)))

        def run(batches, items=items, seeds=seeds):
            own = items.value
            for rows in batches:
                ids = rows.column(0).to_pylist()
                found = [(ids[doc], own.ids[item], *rest) for doc, item, *rest in found_in(
                    own, seeds.value, rows.column(1).to_pylist(), min_score)]
                if found:
                    yield batch(_FOUND, **dict(zip(_FOUND.names, zip(*found))))

        out = out.unionByName(docs.select(F.col("doc_id").cast("long"), F.col("text").cast(
            "string")).mapInArrow(run, _FOUND_DDL))
    return out


def without_contaminated(docs: DataFrame, benchmark: DataFrame, min_score: float = MIN_SCORE,
                         block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Rows of ``docs`` that hold no item; all columns stay as they are."""
    at = docs.columns.index("text")
    for block in _blocks(benchmark, block_bytes):
        items = docs.sparkSession.sparkContext.broadcast(block)
        seeds = docs.sparkSession.sparkContext.broadcast(Seeds(block, *_word_counts(docs, items)))

        def run(batches, items=items, seeds=seeds):
            own = items.value
            for rows in batches:
                texts = rows.column(at).cast(pa.string()).to_pylist()
                gone = {doc for doc, *_ in found_in(own, seeds.value, texts, min_score)}
                yield rows.filter(pa.array([i not in gone for i in range(len(texts))], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
