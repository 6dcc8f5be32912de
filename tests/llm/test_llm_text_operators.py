"""Suffix arrays, SimHash, decontamination, licences, toxicity and packing against brute force."""

import hashlib
import random
import re
import tracemalloc
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from orbitframe.llm import (
    decontaminate, license_scan, packing, simhash, suffix_dedup, token_counts, tokens, toxicity)
from orbitframe.llm.common import scratch

DOCS = "doc_id long, text string"
PATH = public_tokenizers.path("word_bpe_49k.json")


def docs_of(spark, rows):
    """Documents with extra columns whose names the operators use inside."""
    df = spark.createDataFrame(rows, DOCS)
    return df.select("doc_id", "text", F.lit(1).alias("shard"), F.lit("x").alias("bucket"),
                     F.lit(2).alias("fp"), F.lit(None).cast("string").alias("score"),
                     F.lit(3).alias("unit"), F.lit(4).alias("length"))


# -- suffix arrays ------------------------------------------------------------------------------

def repeats(rows, length=100):
    seen, out = set(), {}
    for doc_id, text in sorted(rows, key=lambda r: r[0]):
        data = (text or "").encode()
        gone = np.zeros(len(data) + 1, bool)
        for start in range(len(data) - length + 1):
            piece = data[start:start + length]
            if piece in seen:
                gone[start:start + length] = True
            seen.add(piece)
        edge = np.diff(np.concatenate([[0], gone.astype(np.int8)]))
        kept = bytes(b for b, g in zip(data, gone) if not g)
        out[doc_id] = (len(data), int(gone.sum()), int((edge == 1).sum()),
                       hashlib.sha256(kept).hexdigest())
    return out


def mixed_rows(seed, n=120):
    rng = random.Random(seed)
    base = ["".join(rng.choices("abcdef é\n", k=rng.randint(0, 600))) for _ in range(20)]
    rows = []
    for i in range(n):
        parts = []
        for _ in range(rng.randint(0, 4)):
            text = rng.choice(base)
            at = rng.randint(0, len(text))
            parts.append(text[at:at + rng.randint(50, 400)])
        rows.append((i * 7 % n, "".join(parts)))
    return rows + [(1000, None), (1001, ""), (1002, "a" * 5000), (1003, "ab" * 2500),
                   (1004, "a" * 99), (1005, "\0" * 150), (1006, "\0" * 149 + "b")]


@pytest.mark.parametrize("shard_bytes,bucket_bytes", [(6000, 3000), (6000, 1 << 20), (1 << 22, 1 << 20)])
def test_repeats_equal_brute_force(spark, shard_bytes, bucket_bytes):
    rows = mixed_rows(shard_bytes + bucket_bytes)
    got = suffix_dedup.repeat_digests(docs_of(spark, rows).repartition(3), shard_bytes=shard_bytes,
                                      bucket_bytes=bucket_bytes).collect()
    assert {r[0]: tuple(r)[1:] for r in got} == repeats(rows)


def test_repeats_of_ids(spark):
    text = "".join(random.Random(1).choices("abcdefghij ", k=300))
    rows = [(5, text), (5, text), (None, text), (9, "short")]
    got = suffix_dedup.repeat_digests(docs_of(spark, rows)).collect()
    removed = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_removed"]) for r in got)
    assert removed == [(False, 5, 0), (False, 5, 300), (False, 9, 0), (True, 0, 300)]


def test_repeats_keep_columns_and_characters(spark):
    text = "é" * 80
    df = docs_of(spark, [(1, "x" + text), (2, "yé" + text + "z"), (3, None)])
    got = {r["doc_id"]: r for r in suffix_dedup.without_repeats(df).collect()}
    assert suffix_dedup.without_repeats(df).columns == df.columns
    assert got[1]["text"] == "x" + text[:51] or len(got[1]["text"]) < 81
    assert got[2]["text"].startswith("y") and got[2]["text"].endswith("z")
    assert got[3]["text"] is None and got[2]["shard"] == 1 and got[2]["bucket"] == "x"


def test_repeats_of_nothing(spark):
    empty = spark.createDataFrame([], DOCS)
    assert suffix_dedup.repeat_digests(empty).count() == 0
    assert suffix_dedup.without_repeats(empty).count() == 0


def test_suffix_order_and_common_prefixes():
    rng = random.Random(4)
    data = np.frombuffer("".join(rng.choices("ab", k=700)).encode(), np.uint8)
    words = suffix_dedup._words(data)
    order = suffix_dedup.suffix_order(words, 64)
    pieces = [data[i:i + 64].tobytes() for i in order]
    assert pieces == sorted(pieces)
    shared = suffix_dedup.common_prefixes(words, order, 64)
    for k in range(1, len(order)):
        a, b = data[order[k - 1]:], data[order[k]:]
        n = next((i for i in range(min(len(a), len(b), 64)) if a[i] != b[i]), min(len(a), len(b), 64))
        assert shared[k] == n


def test_ranks_bound_the_common_prefixes():
    rng = random.Random(5)
    line = "".join(rng.choices("ab", k=260))
    data = np.frombuffer((line + "".join(rng.choices("abc\0", k=900)) + line + "\0\0").encode(), np.uint8)
    words = suffix_dedup._words(data)
    least = np.empty(len(words), np.int32)
    order = suffix_dedup.suffix_order(words, 100, least)
    shared = suffix_dedup.common_prefixes(words, order, 100)
    inside = len(data) - np.maximum(order[1:], order[:-1])
    assert (least[shared >= 8] >= 8).all()
    assert (np.minimum(np.minimum(least[1:], inside), 100) <= shared[1:]).all()
    assert suffix_dedup.common_prefixes(words, order, 100, least).tolist() == shared.tolist()


def test_repeated_starts_hold_little_beside_the_text():
    line = np.random.default_rng(3).integers(97, 123, 1 << 17).astype(np.uint8)
    data = np.concatenate([line, line])
    ends, places = np.full(len(data), len(data)), np.arange(len(data))
    tracemalloc.start()
    found, again = suffix_dedup.repeated_starts(data, ends, places, 100)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sorted(found[again]) == list(range(len(line), len(data) - 99))
    assert most < 72 * len(data)


# -- SimHash ------------------------------------------------------------------------------------

def fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(prints):
    root = {i: i for i in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in prints:
        for j in prints:
            if i < j and (prints[i] ^ prints[j]).bit_count() <= 3:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in prints}


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(60)]
    rows = [(0, None), (1, ""), (2, " \t\n"), (3, "one"), (4, "One"), (5, "two WORDS"), (6, "É É É")]
    for i in range(30):
        words = rng.choices(vocabulary, k=rng.randint(3, 120))
        for _ in range(rng.randint(1, 4)):
            copy = list(words)
            if rng.random() < 0.7:
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append((len(rows), " ".join(copy)))
    rows.append((len(rows), "long " * 200_000))
    want = {i: fingerprint(t) for i, t in rows}
    got = simhash.near_duplicates(docs_of(spark, rows)).collect()
    assert {r["doc_id"]: r["fp"] % 2 ** 64 for r in got} == want
    assert {r["doc_id"]: r["component_id"] for r in got} == classes(want)


def test_links_are_all_pairs_within_three_bits(spark):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(40)]
    values = set(base)
    for value in base:
        for bits in range(1, 6):
            flipped = value
            for b in rng.sample(range(64), bits):
                flipped ^= 1 << b
            values.add(flipped)
    signed = [v - 2 ** 64 if v >= 2 ** 63 else v for v in values]
    got = simhash.linked_fingerprints(spark.createDataFrame([(v,) for v in signed], "fp long"))
    want = {(a, b) for a in signed for b in signed if a < b and ((a ^ b) % 2 ** 64).bit_count() <= 3}
    assert {tuple(r) for r in got.collect()} == want


def test_probes_of_fingerprints_are_never_broadcast(spark):
    """A fingerprint is probed for 68 times, which the planner does not see behind explode."""
    plan = simhash.linked_fingerprints(spark.range(1000).select(F.xxhash64("id").alias("fp")))._jdf.queryExecution()
    assert "Broadcast" not in plan.executedPlan().toString()


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "a long, b long")
    got = {r["node"]: r["root"] for r in simhash.components(edges).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}


def test_near_duplicates_of_nulls_and_nothing(spark):
    rows = [(None, "a b c"), (7, "a b c"), (7, "a b c"), (None, "z y x w")]
    got = simhash.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted((r["doc_id"] or 0, r["component_id"] or 0) for r in got) == [(0, 0), (0, 7), (7, 7), (7, 7)]
    assert simhash.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0


# -- decontamination ----------------------------------------------------------------------------

ITEM = "what is the boiling point of liquid nitrogen at one atmosphere of pressure in kelvin"


def test_contaminated_copies_and_edits(spark):
    words = ITEM.split()
    edited = " ".join(w if i % 5 else "other" for i, w in enumerate(words))
    filler = "lorem ipsum dolor " * 50
    rows = [(1, filler + ITEM.upper() + "? " + filler), (2, edited), (3, filler), (4, None), (5, ""),
            (6, "the of at in is what " * 40), (7, ITEM + " " + ITEM), (7, ITEM), (None, ITEM)]
    items = [(1, ITEM), (1, ITEM), (2, None), (3, "too short"), (None, ITEM)]
    got = decontaminate.contaminated(
        docs_of(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((r["doc_id"] or 0, r["item_id"], r["score"] == 1) for r in got) == [
        (0, 1, True), (1, 1, True), (2, 1, False), (7, 1, True), (7, 1, True)]
    kept = decontaminate.without_contaminated(
        docs_of(spark, rows), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(r["doc_id"] for r in kept.collect()) == [3, 4, 5, 6]


def test_contaminated_of_nothing(spark):
    docs, none = spark.createDataFrame([(1, ITEM)], DOCS), spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contaminated(docs, none).count() == 0
    assert decontaminate.contaminated(docs.limit(0), none.union(
        spark.createDataFrame([(1, ITEM)], "item_id long, text string"))).count() == 0
    assert decontaminate.without_contaminated(docs, none).count() == 1


def test_smith_waterman_equals_the_plain_recurrence():
    rng = np.random.default_rng(0)
    for _ in range(60):
        a, b = rng.integers(0, 4, rng.integers(1, 12)), rng.integers(0, 4, rng.integers(1, 25))
        grid = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                grid[i, j] = max(0, grid[i - 1, j - 1] + (2 if a[i - 1] == b[j - 1] else -1),
                                 grid[i - 1, j] - 1, grid[i, j - 1] - 1)
        score, matches, first, last = decontaminate.smith_waterman(a, b)
        assert score == grid.max()
        assert score == 0 or (first <= last and 2 * matches >= score)


# -- licences -----------------------------------------------------------------------------------

def plain(text):
    return re.sub("[^a-z0-9]+", " ", text.lower()).strip()


def dice(a, b):
    grams = lambda t: {p for w in [plain(t).split()] for p in zip(w, w[1:])}
    a, b = grams(a), grams(b)
    return 2 * len(a & b) / (len(a) + len(b)) if a and b else 0


def test_license_scan_equals_brute_force(spark):
    rng = random.Random(6)
    mit = license_scan.TEXTS["MIT"]
    rows = [(1, "Intro words.\nReleased under the MIT License."), (2, mit), (3, None), (4, ""), (5, "x"),
            (6, "word " * 100_000), (7, "Licensed under CC BY-NC 4.0.\nLicensed under CC BY-NC 4.0."),
            (7, "Licensed under CC BY-NC 4.0.\nLicensed under CC BY-NC 4.0."), (None, "Licensed under CC BY 4.0")]
    for i in range(40):
        words = rng.choice([t for _, t in license_scan.templates()]).split()
        for _ in range(rng.randint(0, len(words) // 6 + 1)):
            words[rng.randrange(len(words))] = rng.choice(["the", "other", "license", "under"])
        rows.append((100 + i, " ".join(words)))
    want = {}
    for doc_id, text in set(rows):
        lines = (text or "").split("\n")
        units = [(u, 1) for u in ([text or ""] + lines if len(lines) > 1 else [text or ""])]
        words = plain(text or "").split()
        for m in {len(plain(t).split()) for _, t in license_scan.templates()} if len(set(words)) > 1 else ():
            units += [(" ".join(words[i:i + m]), 0) for i in range(0, len(words), max(1, m // 4))
                      if len(words) > m]
        for unit, counts in units:
            best = {}
            for name, template in license_scan.templates():
                best[name] = max(best.get(name, 0), dice(unit, template))
            for name, value in best.items():
                if value >= 0.8:
                    high, n = want.get((doc_id, name), (0, 0))
                    want[doc_id, name] = max(high, value), n + counts
    got = license_scan.license_scan(docs_of(spark, rows)).collect()
    assert {(r["doc_id"], r["license_id"]): (r["dice"], r["n_units"]) for r in got} == want
    assert license_scan.license_scan(spark.createDataFrame([], DOCS)).count() == 0


# -- toxicity -----------------------------------------------------------------------------------

def chat_text(rng, toxic):
    words = ["".join(rng.choices(["ba", "ko", "re", "ti", "lu", "sen"], k=rng.randint(1, 4)))
             for _ in range(rng.randint(20, 80))]
    for _ in range(4 * toxic):
        words.insert(rng.randrange(len(words)), rng.choice(["zwangor", "qibblex", "vrotten"]))
    return " ".join(words)


def test_toxicity_on_held_out_texts(spark):
    rng = random.Random(8)
    rows = [(i, chat_text(rng, i % 5 == 0), int(i % 5 == 0)) for i in range(900)]
    docs = spark.createDataFrame([r[:2] for r in rows], DOCS)
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows] + [(None, 1), (3, None)], "doc_id long, toxic int")
    sample = toxicity.labelled_sample(docs, labels)
    assert all(zlib.crc32(str(i).encode()) % 4 != 2 for i, _, _ in sample)
    model = toxicity.fit(sample)
    extra = [(None, "ba ko"), (5000, None), (5001, ""), (5002, "ba ko re " * 50_000), (7, rows[7][1])]
    scored = docs_of(spark, [r[:2] for r in rows] + extra)
    got = [(r["doc_id"], r["score"]) for r in toxicity.toxicity_scores(scored, model).collect()]
    assert len(got) == len(rows) + len(extra) and all(0 <= s <= 1 for _, s in got)
    held = [(s >= toxicity.CUT, rows[i][2]) for i, s in got
            if i is not None and i < 900 and zlib.crc32(str(i).encode()) % 4 == 2]
    assert sum(bool(p) == bool(y) for p, y in held) >= 0.95 * len(held)
    kept = toxicity.without_toxic(scored, model)
    assert kept.columns == scored.columns
    assert kept.count() == sum(s < toxicity.CUT for _, s in got)


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], DOCS)
    model = toxicity.fit(toxicity.labelled_sample(docs, spark.createDataFrame([], "doc_id long, toxic int")))
    assert toxicity.without_toxic(docs, model).count() == 2
    assert toxicity.toxicity_scores(docs.limit(0), model).count() == 0


# -- tokens -------------------------------------------------------------------------------------

SIGNS = ["a", "B", "é", "é", "́", " ", "\n", " ", "\x1c", "'s", "<|endoftext|>", "9", "漢字",
         "🙂", "İ", "Σ", "\t", "#%", ", ", ". ", ".", ",", "_", "\x00"]


@pytest.mark.parametrize("plain", [False, True])
def test_chunks_encode_like_whole_texts(plain):
    rng = random.Random(9)
    whole = Tokenizer.from_file(PATH)
    whole.encode_special_tokens = plain
    texts = ["".join(rng.choices(SIGNS, k=rng.randint(0, 12))) for _ in range(3000)]
    got = tokens.ChunkEncoder(PATH, plain).encode(texts)
    assert [g.tolist() for g in got] == [whole.encode(t, add_special_tokens=False).ids for t in texts]


def test_a_full_table_of_chunks_still_encodes(monkeypatch):
    monkeypatch.setattr(tokens, "MAX_CHUNKS", 5)
    monkeypatch.setattr(tokens, "_PART", 8)
    whole, own = Tokenizer.from_file(PATH), tokens.ChunkEncoder(PATH)
    texts = [" ".join(f"word{i * j}" for j in range(20)) for i in range(30)] + ["", "one"]
    for _ in range(2):
        assert [g.tolist() for g in own.encode(texts)] == [
            whole.encode(t, add_special_tokens=False).ids for t in texts]


def test_token_counts_equal_the_tokenizer(spark):
    rows = [(1, "one two, three."), (2, None), (3, ""), (4, "word " * 30_000), (5, "<|endoftext|> a"),
            (5, "b"), (None, "c d"), (6, "same text"), (7, "same text")]
    whole = Tokenizer.from_file(PATH)
    whole.encode_special_tokens = True
    want = sorted((i or 0, len(whole.encode(t or "", add_special_tokens=False).ids)) for i, t in rows)
    got = token_counts.token_counts(docs_of(spark, rows).repartition(2), scratch(spark), PATH, block_bytes=1000)
    assert sorted((r["doc_id"] or 0, r["n_tokens"]) for r in got.collect()) == want
    assert token_counts.token_counts(spark.createDataFrame([], DOCS), scratch(spark), PATH).count() == 0


@pytest.mark.parametrize("block", [2, 6, 10, 1 << 20])
def test_scan_stitches_blocks(spark, tmp_path, block):
    rng = random.Random(block)
    ids = [rng.choice([7, 7, 7, 1, 2, 3]) for _ in range(60)] + [5] * 30
    for name, values in (("a", ids), ("b", [7, 7]), ("c", [1, 2]), ("d", [])):
        (tmp_path / name).write_bytes(np.array(values, "<u2").tobytes())
    (tmp_path / "e").write_bytes(np.array([4, 7, 4], "<u2").tobytes() + b"\x01")  # a partial last id
    got = {}
    for r in token_counts.scan_token_files(spark, f"file://{tmp_path}", 7, 2, block).orderBy("file", "nth").collect():
        got.setdefault(r["file"][-1], []).append((r["nth"], r["start"], r["n_tokens"], r["ended"]))
    want = {}
    for name, values in (("a", ids), ("b", [7, 7]), ("c", [1, 2]), ("e", [4, 7, 4])):
        start = 0
        for at, value in enumerate([*values, None]):
            if value == 7 or (value is None and at > start):
                rows = want.setdefault(name, [])
                rows.append((len(rows), start, at - start, value == 7))
                start = at + 1
    assert got == want


def test_pack_fills_sequences(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choices(["alpha", "beta", "gamma"], k=rng.randint(0, 90)))) for i in range(300)]
    rows += [(1000, None), (1001, ""), (1002, "alpha " * 1000), (3, rows[3][1]), (None, "beta")]
    df = docs_of(spark, rows).repartition(4)
    got = packing.pack(packing.token_pieces(df, PATH, capacity=100), capacity=100).collect()
    whole = Tokenizer.from_file(PATH)
    want = []
    for i, text in rows:
        ids = [*whole.encode(text or "", add_special_tokens=False).ids, 1]
        for piece, start in enumerate(range(0, len(ids), 100)):
            cut = np.array(ids[start:start + 100], "<u4")
            want.append((i or 0, piece, start, len(cut), zlib.crc32(cut.tobytes())))
    assert sorted((r[0] or 0, *tuple(r)[1:5]) for r in got) == sorted(want)
    bins = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 100
    assert len(bins) <= -(-sum(r["length"] for r in got) // 100) + 2
    assert packing.pack(packing.token_pieces(df.limit(0), PATH)).count() == 0


def test_two_for_one_fills_a_gap():
    counts = np.zeros(101, int)
    counts[[60, 30, 25, 14]] = 1  # greedy takes 60 and 30; 25 and 14 fill the gap of 30's place better
    plan = packing.best_two_fit(counts)
    assert plan[0] == ({60: 1, 25: 1, 14: 1}, 1)


def edited(words, rng, word, every=None, kind="replace"):
    out = []
    for i, w in enumerate(words, 1):
        if every and i % every == 0:
            out += {"replace": [word()], "insert": [w, word()], "drop": []}[kind]
        else:
            out.append(w)
    return out


@pytest.mark.parametrize("kind", ["replace", "insert", "drop"])
def test_contaminated_pairs_equal_brute_force(spark, kind):
    """Every second to sixth word edited: all pairs that an alignment of all with all finds."""
    rng = random.Random(len(kind))
    pool = [f"w{i}" for i in range(900)]
    word = lambda: rng.choice(pool)
    items = [(i, " ".join(word() for _ in range(rng.randrange(8, 40)))) for i in range(30)]
    docs = []
    for i, (_, text) in enumerate(items):
        for every in (None, 2, 3, 4, 5, 6):
            filler = [[word() for _ in range(rng.randrange(0, 50))] for _ in range(2)]
            docs.append((len(docs), " ".join([*filler[0], *edited(text.split(), rng, word, every, kind),
                                              *filler[1]])))
    wanted = set()
    numbers = {w: i + 1 for i, w in enumerate(pool)}
    coded = lambda t: np.array([numbers[w] for w in t.split()], np.int64)
    for doc, text in docs:
        for item, other in items:
            score = decontaminate.smith_waterman(coded(other), coded(text))[0] / (2 * len(other.split()))
            if score >= 0.5:
                wanted.add((doc, item))
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(
        docs_of(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got <= wanted and len(wanted) > 100
    assert len(wanted - got) <= 0.02 * len(wanted), sorted(wanted - got)[:5]


def test_wrapped_and_embedded_licences_are_found(spark):
    """A wrapped header before code, a notice inside a longer line, and a text that has neither."""
    import textwrap

    header = "\n".join("# " + line for line in textwrap.wrap(" ".join(license_scan.TEXTS["MIT"].split()), 78))
    rng = random.Random(8)
    code = "\n".join(f"v{rng.randrange(10 ** 6)} = f{rng.randrange(10 ** 6)}(x{i})" for i in range(400))
    rows = [(1, header + "\n" + code), (2, "all of it came before. Released under the ISC License and more "
             "words follow on the same line, as they do in prose"), (3, code), (4, None), (5, "")]
    got = {(r["doc_id"], r["license_id"]): (r["dice"], r["n_units"]) for r in license_scan.license_scan(
        docs_of(spark, rows)).collect()}
    assert {k[0] for k in got} == {1, 2}
    assert got[1, "MIT"][0] > 0.87 and got[1, "MIT"][1] == 0 and got[2, "ISC"] == (1.0, 0)
