"""Archives, chats, exact search, registered queries and the pipeline on small inputs."""

import gzip
import hashlib
import io
import random
import zlib
from pathlib import Path

import pytest
from oracle import connect, differences
from pyspark.sql import functions as F

import corpus_pipeline
from orbitframe.llm import chat, near_copies, queries, topk, warc
from orbitframe.llm.common import scratch
from orbitframe.sources.landing import shared_folder

SF_DIR = "/root/testdata/sf0.001"
PAGES = "page_id long, url string, html string"


# -- archives -----------------------------------------------------------------------------------

def records(n, compressed=True):
    raw = [warc._record(i, f"http://a/{i}", p, warc.sha1_base32(p), i, warc.DATE)
           for i, p in ((i, b"<p>%d</p>" % i * 50) for i in range(n))]
    return [gzip.compress(r, mtime=0) if compressed else r for r in raw]


def read(data, **options):
    found = list(warc.salvage(io.BytesIO(data), **options))
    got = [x[4]["warc-record-id"] for x in found if x[0] == "record"]
    return got, [(x[1], x[2]) for x in found if x[0] == "gap"]


@pytest.mark.parametrize("compressed", [True, False])
def test_salvage_of_damaged_records(compressed):
    parts = records(6, compressed)
    starts = [sum(map(len, parts[:i])) for i in range(7)]
    whole = b"".join(parts)
    assert read(whole) == ([warc.page_uri(i) for i in range(6)], [])
    for at in (starts[2] + 3, starts[2] + len(parts[2]) // 2, starts[3] - 6):
        broken = bytearray(whole)
        broken[at] ^= 0x55
        got, gaps = read(bytes(broken))
        assert [warc.page_uri(i) for i in (0, 1, 3, 4, 5)] == [g for g in got if g != warc.page_uri(2)]
        assert gaps == [(starts[2], len(parts[2]))]
    cut = whole[:starts[5] + 40]
    assert read(cut) == ([warc.page_uri(i) for i in range(5)], [(starts[5], 40)])
    lost = whole[:starts[1]] + b"junk WARC/1. \x1f\x8b\x08 junk" + whole[starts[1]:]
    assert read(lost)[0] == [warc.page_uri(i) for i in range(6)]
    assert read(lost)[1] == [(starts[1], 21)]


def test_salvage_of_odd_streams():
    assert read(b"") == ([], [])
    assert read(b"no archive at all") == ([], [(0, 17)])
    parts = records(2)
    assert read(parts[0] + gzip.compress(b"", mtime=0) + parts[1])[1] == []
    assert read(gzip.compress(b"".join(records(2, False))))[0] == [warc.page_uri(0), warc.page_uri(1)]
    assert read(b"".join(parts), limit=10)[0] == []
    big = b"x" * (3 << 20)
    assert len(read(b"y" * (9 << 20) + parts[1])[1]) == 1
    assert read(warc._record(1, None, big, warc.sha1_base32(big), None, warc.DATE))[0] == [warc.page_uri(1)]


def test_archives_round_trip(spark):
    rows = [(1, "http://a", "same"), (9, "http://b", "same"), (4, None, "same"), (2, "u\r\n", None),
            (3, "v", ""), (5, "w", "é" * 100_000), (6, "WARC/1.1", "WARC/1.1\r\n\r\n"), (7, "x", "a"),
            (7, "x", "a"), (None, "y", "b"), (None, "z", "same")]
    df = spark.createDataFrame(rows, PAGES).withColumn("digest", F.lit(1)).withColumn("first", F.lit("x"))
    folder = scratch(spark)
    warc.write_warc(df.repartition(3), folder)
    got = warc.read_warc(spark, folder).collect()
    assert len(got) == len(rows) and {r["kind"] for r in got} == {"record"}
    kinds = sorted((r["headers"]["warc-record-id"], r["headers"]["warc-type"]) for r in got)
    last = {h or "": max((p for p, _, x in rows if (x or "") == (h or "") and p is not None), default=None)
            for _, _, h in rows}
    assert kinds == sorted((warc.page_uri(p), "response" if p == last[h or ""] else "revisit") for p, _, h in rows)
    for r in got:
        if r["payload"] is not None:
            assert r["payload_digest"] == warc.sha1_base32(bytes(r["payload"]))


@pytest.mark.parametrize("compressed", [True, False])
def test_salvage_of_long_headers(compressed):
    long = warc._record(1, "data:" + "x" * 1_000_000, b"a", warc.sha1_base32(b"a"), None, warc.DATE)
    parts = [records(1, compressed)[0], gzip.compress(long) if compressed else long]
    assert read(b"".join(parts)) == ([warc.page_uri(0), warc.page_uri(1)], [])
    cut = long[:500_000]  # the headers do not end
    assert read(parts[0] + cut) == ([warc.page_uri(0)], [(len(parts[0]), len(cut))])


def test_pages_with_long_urls_keep_their_rows(spark):
    rows = [(5, "data:" + " " * 50_000, "same"), (3, "http://b", "same"), (4, "x" * 300_000, None)]
    folder = scratch(spark)
    spark.createDataFrame(rows, PAGES).write.parquet(f"{folder}/pages.parquet")
    got = {r["page_id"]: (r["record_type"], r["payload_bytes"], r["refers_to"])
           for r in queries.op4_warc(spark, folder).collect()}
    assert got == {5: ("response", 4, None), 3: ("revisit", 4, 5), 4: ("response", 0, None)}


# -- chats --------------------------------------------------------------------------------------

EVENTS = "conv_id long, message long, seq long, kind string, role string, text string"


def test_fold_events(spark):
    rows = [(1, 1, 0, "start", "user", "Hel"), (1, 1, 1, "delta", None, "lo"), (1, 1, 1, "delta", None, "lo"),
            (1, 2, 3, "delta", None, "new"), (1, 2, 1, "delta", None, "old"), (1, 2, 0, "start", "assistant", None),
            (1, 2, 2, "regenerate", None, None), (1, 3, 5, "edit", "system", "E"), (1, 3, 6, None, None, "x"),
            (1, 3, 7, "other", None, "y"), (None, 1, 0, "delta", None, "z"), (2, 1, 0, "delta", "user", "w" * 10 ** 6)]
    df = spark.createDataFrame(rows, EVENTS).withColumn("rendered", F.lit(1))
    got = {(r[0], r[1]): (r[2], r[3]) for r in chat.fold_events(df.repartition(5)).collect()}
    assert got == {(1, 1): ("user", "Hellolo"), (1, 2): ("assistant", "new"), (1, 3): ("system", "E"),
                   (None, 1): ("", "z"), (2, 1): ("user", "w" * 10 ** 6)}
    assert chat.fold_events(df.limit(0)).count() == 0


def test_rendered_texts_come_back(spark):
    rng = random.Random(1)
    signs = ["\\", "#", "<", "/turn>", "</turn>\n", "### user: ", ":", "\n", "é", "🙂", "a", "\\\\#"]
    rows = [(c, m, rng.choice(["user", "assistant", "a:b", "", None]),
             rng.choice([None, "".join(rng.choices(signs, k=rng.randint(0, 9)))]))
            for c in range(30) for m in range(rng.randint(1, 6))]
    messages = spark.createDataFrame(rows, "conv_id long, message long, role string, text string")
    got = {r["conv_id"]: r for r in chat.read_back(chat.render(messages.repartition(4))).collect()}
    for conv in range(30):
        own = sorted((m, r or "", t or "") for c, m, r, t in rows if c == conv)
        turns = "".join(f"{r}\n{t}\n" for _, r, t in own)
        loss = "".join(t for _, r, t in own if r == "assistant")
        r = got[conv]
        assert (r["n_turns"], r["turns_sha256"]) == (len(own), hashlib.sha256(turns.encode()).hexdigest())
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    with pytest.raises(Exception, match="no turn"):
        chat.read_back(spark.createDataFrame([(1, 1, "### user: a</turn>\nx", 0, 0)],
                                             chat.render(messages).schema)).collect()


# -- exact search -------------------------------------------------------------------------------

def test_top_k_equals_brute_force(spark):
    import math

    rng = random.Random(2)
    rows = [(i, [rng.choice([0.0, 0.5, -0.25, 1.0, rng.uniform(-1, 1)]) for _ in range(5)]) for i in range(120)]
    rows += [(200, None), (201, [1.0, None]), (202, [float("nan")]), (203, [float("inf")]), (204, []),
             (None, [1.0]), (250, rows[0][1]), (251, rows[0][1]), (3, rows[3][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("x"))
    vectors = topk.integer_vectors(df)
    got = sorted(map(tuple, topk.exact_top_k(vectors.where("vec_id % 50 = 0"), vectors, 5, block=16).collect()))
    ints = [(i, [math.floor(256 * x) for x in v]) for i, v in rows
            if i is not None and v is not None and None not in v and all(map(math.isfinite, v))]
    want = []
    for q, v in ints:
        if q % 50 == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in ints if i != q)[:5]
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(scored)]
    assert got == sorted(want)
    few = vectors.where("vec_id in (0, 1, 2)")
    assert topk.exact_top_k(few.where("vec_id = 0"), few).count() == 2
    assert topk.exact_top_k(vectors.limit(0), vectors).count() == 0
    assert topk.exact_top_k(few, vectors.limit(0)).count() == 0


def test_top_k_deals_rows_of_one_id(spark, monkeypatch):
    plain = topk._cell

    def bounded(k):
        found = plain(k)

        def run(key, queries, candidates):
            if candidates.num_rows > 400:
                raise MemoryError(candidates.num_rows)
            return found(key, queries, candidates)

        return run

    monkeypatch.setattr(topk, "_cell", bounded)
    rows = spark.range(3000).selectExpr("if(id % 3 = 0, 7, id) as vec_id", "array(double(id % 5), 1d) as embedding")
    vectors = topk.integer_vectors(rows)
    got = topk.exact_top_k(vectors.where("vec_id = 8"), vectors, k=3, block=200).collect()
    assert [(r["rank"], r["vec_id"]) for r in sorted(got, key=lambda r: r["rank"])] == [(1, 4), (2, 7), (3, 7)]


# -- queries and pipeline -----------------------------------------------------------------------

@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, name):
    assert differences(queries.QUERIES[name](spark, SF_DIR), connect(SF_DIR), queries.SQL[name]) is None


def test_every_document_has_a_row(spark):
    n = spark.read.parquet(f"{SF_DIR}/documents.parquet").count()
    for name in ("op1_token_counts", "op3_toxicity", "op5_suffix_array", "op6_simhash"):
        assert queries.QUERIES[name](spark, SF_DIR).count() == n


def test_pipeline_stages(spark):
    rows = [(1, "one two three four five six", "en", "s", 27), (2, "one two three four five six", "en", "s", 27),
            (3, None, None, None, None), (4, "", "en", "s", 0), (None, "zeta eta theta", "en", None, 14),
            (5, "word " * 3000, "en", "s", 15000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF_DIR)
        assert out.columns == docs.columns
        docs = spark.createDataFrame(out.collect(), docs.schema)
    kept = {r["doc_id"]: r for r in docs.collect()}
    assert set(kept) == {1, 3, None, 5}  # 2 repeats 1, 4 is as empty as 3
    assert kept[3]["text"] is None and kept[5]["n_chars"] == len(kept[5]["text"]) < 15000
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF_DIR).collect()
    assert {r["doc_id"] for r in packed} == {1, 3, None, 5}
    assert corpus_pipeline.run(spark, SF_DIR).count() > 0


def test_pipeline_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF_DIR).count() == 0


def test_pipeline_drops_edited_copies(spark):
    rng = random.Random(8)
    rows, left = [], set()
    for i in range(0, 120, 3):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.randint(60, 300))]
        near, far = list(words), list(words)
        near[len(near) // 2] = "edited"  # at most 5 of at least 56 shingles
        far[::10] = ["edited"] * len(far[::10])  # about half of them
        rows += [(i, " ".join(words)), (i + 1, " ".join(near)), (i + 2, " ".join(far))]
        left |= {i, i + 2}
    out = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), SF_DIR)
    assert {r["doc_id"] for r in out.collect()} == left


def test_near_copies_of_one_hot_group(spark):
    words = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(words[:i] + ["x"] + words[i + 1:])) for i in range(100)]
    rows += [(200 + i, f"{i} " * 40) for i in range(50)] + [(300, None), (301, " ")]
    got = {r["doc_id"]: r["component_id"] for r in near_copies.near_copies(
        spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {**{i: 0 for i in range(100)}, **{200 + i: 200 + i for i in range(50)}, 300: 300, 301: 300}


def test_near_copies_keep_no_steps(spark):
    """What rounds write goes when the next has read it: less than the texts is left."""
    folder = shared_folder(spark).removeprefix("file://")
    files = lambda: {p: p.stat().st_size for p in Path(folder).rglob("*.parquet")}
    rng = random.Random(9)
    rows = []
    for i in range(150):
        words = [f"w{rng.randrange(10 ** 9)}" for _ in range(800)]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(words[:-1]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    before = files()
    found = near_copies.near_copies(docs)
    left = sum(n for p, n in files().items() if p not in before)
    assert {r["doc_id"]: r["component_id"] for r in found.collect()} == {i: i // 2 * 2 for i in range(300)}
    assert left < 0.1 * sum(len(t) for _, t in rows)


def test_near_duplicates_are_judged_by_row(spark):
    rows = [(None, "a copied text"), (None, "a text of its own"), (1, "a copied text"), (2, "a copied text"),
            (2, "another text of number two"), (None, "without an id"), (None, "without an id")]
    out = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), SF_DIR)
    assert sorted((r["doc_id"] or 0, r["text"]) for r in out.collect()) == [
        (0, "a text of its own"), (0, "without an id"), (0, "without an id"),
        (1, "a copied text"), (2, "another text of number two")]


@pytest.mark.parametrize("n", [9, 27, 100, 400])
def test_near_copies_recall_at_the_bound(spark, n):
    """Pairs whose five-word shingles have a similarity of 0.8 or just above it."""
    rng = random.Random(n)
    word = lambda: f"w{rng.randrange(10 ** 9)}"
    rows, pairs = [], 300
    for i in range(pairs):
        words = [word() for _ in range(n + 4)]
        k = int(n * 0.2 / 1.8)
        other = words[k:] + [word() for _ in range(k)]
        a, b = (near_copies.shingle_set(" ".join(w).encode()) for w in (words, other))
        assert near_copies.similarity(a, b) >= 0.8
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(other))]
    got = {r["doc_id"]: r["component_id"] for r in near_copies.near_copies(
        spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(got[2 * i + 1] == 2 * i for i in range(pairs)) >= 0.97 * pairs
    assert all(got[2 * i] == 2 * i for i in range(pairs))


def test_near_copies_equal_brute_force(spark):
    """A family of copies of a text with more and more edits, and unrelated texts."""
    rng = random.Random(4)
    word = lambda: f"w{rng.randrange(400)}"
    base = [word() for _ in range(120)]
    rows = []
    for i in range(60):
        copy = list(base)
        for _ in range(rng.randrange(0, 9)):
            copy[rng.randrange(len(copy))] = word()
        rows.append((i, " ".join(copy)))
    rows += [(100 + i, " ".join(word() for _ in range(rng.randrange(0, 60)))) for i in range(60)]
    rows += [(7, rows[70][1]), (None, rows[3][1]), (None, None), (300, "")]
    sets = [near_copies.shingle_set((t or "").encode()) for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if near_copies.similarity(sets[i], sets[j]) >= 0.8:
                group = [min(group[i], group[j]) if g in (group[i], group[j]) else g for g in group]
    want = {}
    for (doc, _), g in zip(rows, group):
        if doc is not None:
            want[g] = min(want.get(g, doc), doc)
    expected = sorted((str(doc), str(want.get(g))) for (doc, _), g in zip(rows, group))
    got = near_copies.near_copies(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((str(r["doc_id"]), str(r["component_id"])) for r in got.collect()) == expected


def test_chat_reads_back_a_long_text(spark):
    text = "a<b\\c# " * 1_500_000
    messages = spark.createDataFrame([(1, 1, "user", text)], "conv_id long, message long, role string, text string")
    row = chat.read_back(chat.render(messages)).first()
    assert row["turns_sha256"] == hashlib.sha256(f"user\n{text}\n".encode()).hexdigest()


def test_stages_with_clashing_columns(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e f"), (None, None), (3, "")],
                                 "doc_id long, text string").select(
        "*", *(F.lit(1).alias(c) for c in ("_id", "_node", "node", "component_id", "gone", "shard", "root")))
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "3"] and kept.columns == docs.columns
    assert corpus_pipeline.drop_repeats(spark, docs, "").columns == docs.columns
    assert corpus_pipeline.drop_near_duplicates(spark, docs.limit(0), "").collect() == []
