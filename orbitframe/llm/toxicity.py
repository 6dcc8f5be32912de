"""Toxicity by compression distance between two zstandard dictionaries.

One dictionary is trained on ordinary text. The other is trained on what toxic text has and
ordinary text lacks: beginnings of words that follow many different words in the toxic sample,
far more often than in the ordinary one. Its content stands before the ordinary dictionary, so
both compress ordinary text alike, and a window that gets shorter with it is a toxic one. How
much the windows of a text gain is turned into a score by a logistic curve, calibrated on
labelled rows that trained no dictionary and shifted so that even odds score ``CUT``.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard as zstd
from pyspark.sql import DataFrame, functions as F

from orbitframe.llm.common import batch, texts

CUT = 0.3
WINDOW = 160
LEVEL = 13
ORDINARY_BYTES, TOXIC_BYTES = 8_000, 1_500
#: labelled rows used at most: toxic and ordinary ones, two thirds for the dictionaries, the rest for the curve
SAMPLE = {1: 1_600, 0: 5_000}
#: texts over this many bytes do not enter the sample
SAMPLE_TEXT = 20_000
SHORTEST, LONGEST, CONTRAST = 4, 12, 8.0
#: different words before a mark: this share of the toxic texts, and no fewer than so many
CONTEXTS, LEAST_CONTEXTS = 0.02, 3
_SCORES = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])


@dataclass(frozen=True)
class ToxicityModel:
    """Dictionaries, and the curve over (scaled) window gains."""

    ordinary: bytes
    toxic: bytes
    centre: tuple[float, ...]
    scale: tuple[float, ...]
    weights: tuple[float, ...]
    shift: float


def windows(text: bytes, size: int = WINDOW) -> list[bytes]:
    """The words of a text in windows of up to ``size`` bytes, cut between words where possible."""
    line = b" " + b" ".join(text.lower().split())
    out, start = [], 0
    while start < len(line) and len(line) > 1:
        stop = start + size
        if stop < len(line):
            space = line.rfind(b" ", start + 1, stop)
            stop = space if space > start else stop
        out.append(line[start:stop])
        start = stop
    return out


def _compressor(content: bytes):
    dictionary = zstd.ZstdCompressionDict(content, dict_type=zstd.DICT_TYPE_RAWCONTENT)
    settings = zstd.ZstdCompressionParameters.from_level(
        LEVEL, source_size=WINDOW, dict_size=len(content), write_content_size=0,
        write_dict_id=0, format=zstd.FORMAT_ZSTD1_MAGICLESS)
    return zstd.ZstdCompressor(dict_data=dictionary, compression_params=settings).compress


class Gains:
    """Bytes that windows save with the toxic dictionary, as features of a text."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        self._plain, self._both = _compressor(ordinary), _compressor(toxic + ordinary)

    def __call__(self, text: bytes) -> list[float]:
        found = np.array([len(self._plain(w)) - len(self._both(w)) for w in windows(text)] or [0])
        top = np.sort(found)[::-1]
        won = float(found.clip(0).sum())
        return [float(top[0]), float(top[:3].sum()), np.log1p(won), float(found.mean()),
                won / np.sqrt(len(found))]


def _pairs(sample: list[bytes]) -> set[tuple[bytes, bytes]]:
    seen = set()
    for text in sample:
        words = text.lower().split()
        seen.update(zip([b"", *words], words))
    return seen


def _beginnings(sample: list[bytes], only: set[bytes] | None = None) -> tuple[Counter, int]:
    """In how many places each beginning of a word follows a different word; all of them."""
    seen, total = set(), 0
    for before, word in _pairs(sample):
        for n in range(SHORTEST, min(len(word), LONGEST) + 1):
            total += 1
            if only is None or word[:n] in only:
                seen.add((before, word[:n]))
    return Counter(start for _, start in seen), total


def _cover(samples: list[bytes], size: int, k: int) -> bytes:
    """The content of a trained dictionary; too few samples for training serve as they are."""
    try:
        return zstd.train_dictionary(2 * size, samples, k=k, d=6).as_bytes()[-size:]
    except zstd.ZstdError:
        return b"".join(samples)[:size]


def train_dictionaries(toxic: list[bytes], ordinary: list[bytes]) -> tuple[bytes, bytes]:
    """The ordinary dictionary and the toxic one."""
    counts, total = _beginnings(toxic)
    enough = max(LEAST_CONTEXTS, CONTEXTS * len(toxic))
    often = {start for start, n in counts.items() if n >= enough}
    usual, all_usual = _beginnings(ordinary, often)
    marks = {start for start in often
             if counts[start] / total >= CONTRAST * (usual[start] + 1) / max(all_usual, 1)}

    def reduced(text):
        for word in text.lower().split():
            for n in range(min(len(word), LONGEST), SHORTEST - 1, -1):
                if word[:n] in marks:
                    yield b" " + word[:n]
                    break

    samples = [found for text in sorted(toxic) if (found := b"".join(reduced(text)))]
    return (_cover([t.lower() for t in sorted(ordinary)], ORDINARY_BYTES, 64),
            _cover(samples, TOXIC_BYTES, 16))


def _curve(features: np.ndarray, labels: np.ndarray):
    """Logistic weights by Newton steps with a small ridge."""
    centre, scale = features.mean(0), features.std(0) + 1e-9
    x = np.column_stack([(features - centre) / scale, np.ones(len(features))])
    w = np.zeros(x.shape[1])
    ridge = np.diag([0.01] * (len(w) - 1) + [1e-6])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + ridge,
                               x.T @ (p - labels) + ridge @ w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return centre, scale, w


def fit(sample: list[tuple[int, bytes, int]]) -> ToxicityModel:
    """A model from (doc_id, text, label) rows; every third one, by id, only calibrates."""
    last = [zlib.crc32(b"fold%d" % i) % 3 == 2 for i, _, _ in sample]
    first = [row for row, out in zip(sample, last) if not out]
    held = [row for row, out in zip(sample, last) if out]
    ordinary, toxic = train_dictionaries([t for _, t, y in first if y], [t for _, t, y in first if not y])
    labels = np.array([y for _, _, y in held], float)
    none = (0.0,) * 5
    if not toxic or not 0 < labels.sum() < len(labels):
        return ToxicityModel(ordinary, toxic, none, (1.0,) * 5, none, -5.0)
    gains = Gains(ordinary, toxic)
    centre, scale, w = _curve(np.array([gains(t) for _, t, _ in held]), labels)
    shift = float(w[-1] + np.log(CUT / (1 - CUT)))
    return ToxicityModel(ordinary, toxic, *(tuple(map(float, v)) for v in (centre, scale, w[:-1])), shift)


def labelled_sample(docs: DataFrame, labels: DataFrame) -> list[tuple[int, bytes, int]]:
    """Bounded training rows (``SAMPLE``, ``SAMPLE_TEXT``), the same for the same tables.

    Only rows whose crc32 of the id leaves 0, 1 or 3 by 4 are used; null ids, texts and labels
    are not.
    """
    open_rows = labels.select(F.col("doc_id").cast("long"), F.col("toxic").cast("int")).where(
        "doc_id is not null and toxic in (0, 1)").where(
            F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2).distinct()
    chosen = [open_rows.where(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
              for label, n in SAMPLE.items()]
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").cast("binary").alias("text")).where(
        F.length("text") <= SAMPLE_TEXT).join(chosen[0].unionByName(chosen[1]), "doc_id").select(
            "doc_id", "text", "toxic").distinct().collect()
    return sorted((r[0], bytes(r[1]), r[2]) for r in rows)


def _scorer(model: ToxicityModel):
    """Scores of a column of texts."""
    gains = Gains(model.ordinary, model.toxic)

    def scores(column: pa.Array) -> np.ndarray:
        found = np.array([gains(t) for t in texts(column.cast(pa.string()))]).reshape(-1, 5)
        margin = (found - model.centre) / model.scale @ np.array(model.weights) + model.shift
        return 1 / (1 + np.exp(-np.clip(margin, -30, 30)))

    return scores


def toxicity_scores(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """(doc_id, score) per row: 0 to 1, higher for texts like those labelled toxic.

    A null or empty text has the score of a text without gains. Other columns are ignored.
    """
    def run(batches):
        scores = _scorer(model)
        for rows in batches:
            yield batch(_SCORES, doc_id=rows.column(0), score=scores(rows.column(1)))

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, score double")


def without_toxic(docs: DataFrame, model: ToxicityModel, cut: float = CUT) -> DataFrame:
    """Rows of ``docs`` that score under ``cut``; all columns stay as they are."""
    at = docs.columns.index("text")

    def run(batches):
        scores = _scorer(model)
        for rows in batches:
            yield rows.filter(pa.array(scores(rows.column(at)) < cut))

    return docs.mapInArrow(run, docs.schema)
