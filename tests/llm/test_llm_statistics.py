"""Collocations, importance resampling and HTML extraction against brute force and made pages."""

import hashlib
import html
import math
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from oracle import connect, differences
from pyspark.sql import functions as F

from orbitframe.llm import collocations, html_text, importance
from orbitframe.llm.queries import QUERIES, SQL

SF_DIR = "/root/testdata/sf0.001"
DOCS = "doc_id long, lang string, text string"
A_Z = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


@pytest.mark.parametrize("name", ["op11_collocations", "op12_importance"])
def test_equals_sql(spark, name):
    assert differences(QUERIES[name](spark, SF_DIR), connect(SF_DIR), SQL[name]) is None


def clashing(df):
    """Extra columns with the names that the operators use inside."""
    return df.select("*", *(F.lit(1).alias(c) for c in (
        "fp", "count", "second", "start", "length", "text_key", "bucket", "weight", "rank", "score",
        "n_words", "phrase", "_at", "_part", "n_chars")))


# -- collocations -------------------------------------------------------------------------------

def phrase_counts(rows, longest=4):
    counts = Counter()
    for _, lang, text in rows:
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(A_Z)):
            words = [w for w in re.split("[ \t]+", piece) if w]
            for n in range(1, longest + 1):
                for i in range(len(words) - n + 1):
                    counts[lang or "und", tuple(words[i:i + n])] += 1
    return counts


def expected_collocations(rows, least, top):
    counts = phrase_counts(rows)
    candidates = {k: a for k, a in counts.items() if len(k[1]) > 1 and a >= least}
    longest = Counter()
    for (lang, words), a in candidates.items():
        for m in range(2, len(words)):
            for i in range(len(words) - m + 1):
                key = lang, words[i:i + m]
                longest[key] = max(longest[key], a)
    out = []
    for (lang, words), a in candidates.items():
        cuts = []
        for k in range(1, len(words)):
            left, right = counts[lang, words[:k]], counts[lang, words[k:]]
            cuts.append((math.floor(Fraction(2_000_000 * a, left + right)), k, left, right))
        score, _, left, right = min(cuts)
        if 100 * longest[lang, words] < 80 * a:
            out.append((lang, -score, -a, " ".join(words).encode(), left, right))
    found, places = [], Counter()
    for lang, score, a, phrase, left, right in sorted(out):
        places[lang] += 1
        n = sum(c for (other, words), c in counts.items() if other == lang and len(words) == 1)
        if places[lang] <= top:
            found.append((lang, places[lang], phrase.decode(), -a, left, right, n, -score))
    return found


def phrase_rows(seed, n=150):
    rng = random.Random(seed)
    words = ["A", "the", "Ä", "of", "x1", "\xa0", "über", "to-do", "naïve", "Z", "n\x1cn"]
    seps = [" ", "  ", "\t", " \t ", ", ", ".", "\n", "; ", "\x0b"]
    rows = [(i, rng.choice(["en", "de", None, "und"]), "".join(
        rng.choice(words[:3 + i % 9]) + rng.choice(seps[:1 + i % 9]) for _ in range(rng.randint(0, 60))))
        for i in range(n)]
    return rows + [(1, None, None), (None, "en", ""), (2, "en", " \t., "), *[rows[3]] * 20]


@pytest.mark.parametrize("bits", [64, 8, 3])
def test_collocations_equal_brute_force(spark, bits):
    rows = phrase_rows(bits)
    docs = clashing(spark.createDataFrame(rows, DOCS)).repartition(3)
    got = collocations.collocations(docs, min_count=5, top=40, bits=bits, filter_bits=12)
    assert sorted(map(tuple, got.collect())) == sorted(expected_collocations(rows, 5, 40))


def test_collocations_across_slabs_and_chunks(spark, monkeypatch):
    rows = phrase_rows(9, 40)
    want = phrase_counts(rows)
    for name, value in (("SLAB_WORDS", 7), ("CHUNK_BYTES", 16), ("JOIN_BYTES", 64)):
        monkeypatch.setattr(collocations, name, value)
    for n in range(1, 5):
        scanner = collocations.Scanner(n, None, 0, 64)
        got, names = Counter(), {}
        for lang in ("en", "de", "und"):
            parts = [(t or "").encode() for _, other, t in rows if (other or "und") == lang]
            for data, _, _, _ in collocations._joined([0] * len(parts), [lang] * len(parts), iter(parts)):
                for fp, _, start, end in scanner.slabs(data, lang):
                    for f, s, e in zip(fp.tolist(), start, end):
                        phrase = collocations.phrase_of(data[s:e])
                        assert names.setdefault(f, (lang, phrase)) == (lang, phrase)
                        got[lang, phrase] += 1
        assert got == {(k, " ".join(w)): c for (k, w), c in want.items() if len(w) == n}


def test_fingerprints_add_up_in_one_sort(monkeypatch):
    """Values that share a fingerprint keep their counts, whatever order they come in."""
    def refuse(*_):
        raise AssertionError("a sort by two columns")

    monkeypatch.setattr(np, "lexsort", refuse)
    draw = np.random.default_rng(5)
    fp, second = (draw.integers(0, n, 4000).astype(np.uint64) for n in (30, 3))
    order, new, count = collocations._added_up(fp, second)
    assert sorted(order) == list(range(4000)) and (np.diff(fp[order].astype(np.int64)) >= 0).all()
    found = Counter()
    for at, n in zip(order[new], count):
        found[fp[at], second[at]] += int(n)
    assert found == Counter(zip(fp, second))
    assert all(len(x) == 0 for x in collocations._added_up(fp[:0], second[:0]))


def test_collocations_of_nothing(spark):
    empty = spark.createDataFrame([], DOCS)
    assert collocations.collocations(empty).collect() == []
    nulls = spark.createDataFrame([(None, None, None), (1, "en", "")], DOCS)
    assert collocations.collocations(nulls, min_count=1).collect() == []


def test_collocations_of_one_long_text(spark):
    docs = spark.createDataFrame([(1, "en", "ab cd " * 200_000)], DOCS)
    got = {r.phrase: (r.a, r.n) for r in collocations.collocations(docs, top=9).collect()}
    # the longest phrases cover the others
    assert got == {"ab cd ab cd": (199_999, 400_000), "cd ab cd ab": (199_998, 400_000)}


# -- importance ---------------------------------------------------------------------------------

def grams(text, longest):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(A_Z))
    return words, [" ".join(words[i:i + n]) for n in range(1, longest + 1)
                   for i in range(len(words) - n + 1)]


def expected_draw(rows, target, longest, buckets=10_000, percent=10, least=20):
    bucket = lambda g: zlib.crc32(g.encode()) % buckets
    own = Counter(bucket(g) for _, t in rows for g in grams(t, longest)[1])
    aim = Counter(bucket(g) for t in target for g in grams(t, longest)[1])
    s, t = own.total(), aim.total()
    gain = lambda b: math.floor(1000 * math.log((aim[b] + 1) * (s + buckets) / ((own[b] + 1) * (t + buckets))))
    scored = []
    for doc, text in rows:
        words, found = grams(text, longest)
        weight = sum(gain(bucket(g)) for g in found)
        key = f"2024:{'' if doc is None else doc}"
        h = int(hashlib.sha256(key.encode()).hexdigest()[:8], 16)
        noise = math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))
        scored.append((len(words), doc, len(found), weight, weight + noise))
    enough = sorted((r for r in scored if r[0] >= least), key=lambda r: (-r[4], r[1] is None, r[1] or 0))
    drawn = percent * len(enough) // 100
    return ([(*r[1:], i + 1 if i < drawn else None) for i, r in enumerate(enough)]
            + [(*r[1:], None) for r in scored if r[0] < least])


@pytest.mark.parametrize("longest", [1, 3])
def test_importance_equals_brute_force(spark, monkeypatch, longest):
    rng = random.Random(longest)
    words = [f"w{i}" for i in range(60)] + ["Äh", "x-y", "\x00", "é1", "ÀB"]
    text = lambda: " ".join(rng.choices(words[:rng.randint(1, 65)], k=rng.randint(0, 70)))
    rows = [(i, text()) for i in range(230)] + [(None, text()), (None, text()), (3, None), (4, "")]
    rows += [rows[5], rows[5], (6, text())]
    target = [text() for _ in range(7)] + [None, ""]
    docs = clashing(spark.createDataFrame(rows, "doc_id long, text string")).repartition(4)
    aim = spark.createDataFrame([(t,) for t in target], "text string")
    key = lambda r: tuple(map(str, r))
    got = importance.resample(docs, aim, longest, percent=30).select(
        "doc_id", "n_features", "weight", "score", "rank").collect()
    assert sorted(map(tuple, got), key=key) == sorted(
        expected_draw(rows, target, longest, percent=30), key=key)


def test_features_across_chunks(monkeypatch):
    monkeypatch.setattr(importance, "CHUNK_WORDS", 5)
    rng = random.Random(1)
    rows = [" ".join(rng.choices("ab cd ef Gh".split(), k=rng.randint(0, 23))) for _ in range(30)]
    got = [Counter() for _ in rows]
    done = 0
    for data, starts in importance.joined((t.encode() for t in rows), 40):
        for _, doc, hashed in importance.features(data, starts, 3, 1 << 32):
            for d, h in zip(doc, hashed):
                got[done + d][h] += 1
        done += len(starts)
    assert got == [Counter(zlib.crc32(g.encode()) for g in grams(t, 3)[1]) for t in rows]


def test_importance_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    one = spark.createDataFrame([(1, "a " * 30)], "doc_id long, text string")
    assert importance.resample(empty, one).collect() == []
    assert importance.resample(one, empty, percent=100).first()["rank"] == 1


# -- HTML ---------------------------------------------------------------------------------------

def words(n, mark):
    return " ".join(f"{mark}{i}" for i in range(n))


ARTICLE = (f"<h1>Short title</h1><p>{words(40, 'a')}</p><p>Of.</p><p>x <a href=q>link one</a> {words(20, 'b')}"
           f"</p><ul><li>one</li><li>two</li></ul><p><a href=z>only link</a></p><p>1 &lt; 2 &amp; &eacute;&#228;"
           f"</p><blockquote>{words(12, 'q')}</blockquote><p>{words(50, 'c')}</p>")
MENU = "<ul>" + "".join(f'<li><a href="/{i}">item{i}</a></li>' for i in range(6)) + "</ul>"
BAR = "<div>" + " | ".join(f'<a href="/{i}">item{i}</a>' for i in range(6)) + "</div>"
PAGES = {
    "tags": f"<header><h1>Site</h1><p>our slogan here</p></header><nav>{MENU}</nav><article>{{}}</article>"
            f"<aside><p>{words(60, 's')}</p></aside><section id='comments'><h2>Comments</h2><p>{words(100, 'k')}"
            f"</p></section><footer>{words(30, 'f')}</footer>",
    "classes": f"<div id='header'><a href=/>Site</a> slogan</div><div class='topnav'>{MENU}</div>"
               f"<div id='cookie-banner'><p>{words(30, 'g')}</p><button>OK</button></div>"
               f"<div class='post-content'>{{}}</div><div class='sidebar-right'>{words(70, 's')}</div>"
               f"<div class='comment-list'><div class='comment'>{words(80, 'k')}</div></div>"
               f"<div id='footer'>{words(20, 'f')} <a href=1>imprint</a></div>",
    "plain": f"{BAR}<div>{{}}</div>{BAR}<div>&copy; 2024 Some company all rights</div>",
    "table": f"<table><tr><td>{MENU}</td><td>{{}}</td></tr></table><p>copyright x</p>",
    "comments": f"<nav>{MENU}</nav><div class=x>{{}}</div><div><h3>3 Comments</h3><p>{words(90, 'k')}</p>"
                "<p>nice</p></div>",
    "inside": f"<main>{{}}<div class='advertisement'>{words(25, 'z')}</div><form><label>Mail</label><input>"
              f"<button>Go</button></form><div class='newsletter-signup'>{words(18, 'n')}</div></main>",
    "nested": f"<div id=page><div id=main><div class=article><div class=body>{{}}</div></div></div>"
              f"<div id=rail><h4>Latest</h4>{MENU}<p>{words(12, 'r')}</p></div></div>",
    "readers": f"<article>{{}}<section class='reader-comments'><article class='comment'><p>{words(60, 'k')}"
               "</p></article></section></article>",
    "notices": f"<div role='alert'>{words(20, 'n')}</div><div class='site-notice'>{words(25, 'n')}</div>"
               f"<main><article>{{}}</article></main><div style='display: none'>{words(30, 'p')}</div>",
    "alone": "<div>{}</div>",
    "scripts": "<script>var t = '</p><p>no';</script><style>p{{}}</style><!-- <p>no</p> --><article>{}"
               "</article><noscript>no</noscript>",
    "truncated": "<article>{}</article><footer>cut <a hre",
}


@pytest.fixture(scope="module")
def tree(spark):
    return html_text.fit_tree(spark)


@pytest.mark.parametrize("name", PAGES)
@pytest.mark.parametrize("longer", [0, 30])
def test_main_text(tree, name, longer):
    article = ARTICLE + "".join(f"<p>{words(80, 'v')}</p>" for _ in range(longer))
    want = " ".join(html.unescape(re.sub("<[^>]*>", " ", article)).split())
    page = f"<!DOCTYPE html><html><head><title>t</title></head><body class='has-sidebar'>{PAGES[name]}"
    assert html_text.main_text(page.replace("{}", article), tree) == want


def test_unclosed_tags(tree):
    page = (f"<nav><ul><li><a href=1>one<li><a href=2>two</ul></nav><article><p><b>{words(30, 'a')}<br><p>"
            f"{words(4, 'b')}<p>{words(20, 'c')}</article><footer>{words(9, 'f')}")
    assert html_text.main_text(page, tree) == " ".join([words(30, "a"), words(4, "b"), words(20, "c")])


def test_every_article_of_the_table(spark, tree):
    pages = spark.read.parquet(f"{SF_DIR}/pages.parquet")
    got = {r.page_id: r for r in html_text.extract_text(clashing(pages), tree).collect()}
    for page_id, _, source in map(tuple, pages.collect()):
        article = re.search("<article>(.*?)(</article>|$)", source, re.S)[1]
        want = " ".join(html.unescape(re.sub("<[^>]*>?", " ", article)).split())
        assert got[page_id].text == want and got[page_id].n_chars == len(want)


def test_odd_pages(spark, tree):
    rows = [(1, None, None), (None, "u", ""), (2, "u", "<"), (2, "u", "<p"), (3, "u", "&am"), (4, "u", "\x00"),
            (5, "u", f"<article><p>{'word ' * 300_000}</p></article>"), (6, "u", "<b>" * 20_000),
            (7, "u", f"<article><p>{words(20, 'a')}"), (7, "u", f"<article><p>{words(20, 'a')}")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = [tuple(r) for r in html_text.extract_text(pages, tree).collect()]
    assert len(got) == len(rows)
    assert (1, None, "", 0) in got and (None, "u", "", 0) in got
    assert (5, "u", ("word " * 300_000).strip(), 1_499_999) in got
    assert got.count((7, "u", words(20, "a"), len(words(20, "a")))) == 2
    assert html_text.extract_text(pages.limit(0), tree).collect() == []


def test_tree_fits_its_table(tree):
    wrong = [r for r, label in html_text.labelled_blocks() if html_text.keeps(tree, r) != label]
    assert not wrong and np.mean([label for _, label in html_text.labelled_blocks()]) > 0.3
