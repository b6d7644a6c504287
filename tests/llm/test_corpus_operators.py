"""Operators over a whole corpus against brute force on small fixtures."""

import collections
import html
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sitelens.llm import elias_fano, html_text, jaccard, lm, topk, toxicity

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


# Jaccard join


def groups(docs):
    """Shingle count and smallest reachable doc_id by comparing whatever shares a shingle."""
    sets = {}
    for i, text in docs:
        w = words(text)
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    holders, root = collections.defaultdict(list), {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, own in sets.items():
        for other, same in collections.Counter(k for t in own for k in holders[t]).items():
            if 100 * same >= 80 * (len(own) + len(sets[other]) - same):
                a, b = sorted((find(i), find(other)))
                root[b] = a
        for t in own:
            holders[t].append(i)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def made_texts(seed):
    draw = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]

    def edit(w, times):
        w = list(w)
        for _ in range(times):
            at, how = draw.randrange(len(w)), draw.random()
            if how < 0.4:
                w[at] = draw.choice(vocabulary)
            elif how < 0.7:
                w.insert(at, draw.choice(vocabulary))
            elif len(w) > 6:
                del w[at]
        return w

    passages = [draw.choices(vocabulary, k=60) for _ in range(3)]
    docs = []
    for _ in range(30):
        base = draw.choices(vocabulary, k=draw.choice([4, 6, 9, 12, 30, 80, 200]))
        docs += [edit(base, draw.randint(0, max(1, len(base) // 25))) for _ in range(draw.choice([1, 2, 8, 30]))]
    for _ in range(40):
        docs.append(draw.choice(passages) + draw.choices(vocabulary, k=draw.randint(0, 25)))
        a, b = draw.sample(passages, 2)
        docs.append(a + b + draw.choices(vocabulary, k=draw.randint(0, 9)))
    large = draw.choices(vocabulary, k=150)
    docs += [edit(large, draw.randint(0, 9)) for _ in range(120)]
    chain = large
    for _ in range(12):  # each like the one before, the ends unlike
        docs.append(chain := edit(chain, 2))
    draw.shuffle(docs)
    odd = [(9001, None), (9002, ""), (9003, " \n"), (9004, "a b"), (9005, "A  B"), (9006, "x" * 3_000_000 + " y z")]
    return [(i, " ".join(w)) for i, w in enumerate(docs)] + odd


def test_jaccard_groups(spark):
    docs = made_texts(1)
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("node", F.lit("clash")).repartition(4)
    rows = jaccard.near_duplicates(df).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == groups(docs)
    assert {r.doc_id for r in rows if r.first} == {c for _, c in groups(docs).values()}


def test_jaccard_repeated_and_unnamed_rows(spark):
    text = "one two three four five six seven"
    df = spark.createDataFrame([(5, text), (5, text), (None, text), (None, None), (None, "")], "doc_id long, text string")
    rows = jaccard.near_duplicates(df).collect()
    got = collections.Counter((r.doc_id, r.component_id, r.n_shingles) for r in rows)
    assert got == {(5, 5, 3): 2, (None, 5, 3): 1, (None, None, 0): 2}
    assert sum(r.first for r in rows) == 3
    assert jaccard.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("size", [4, 5, 40, 3000])
def test_signatures_meet(size):
    """Whatever fifth is replaced, linked sets share a signature, rare tokens or frequent ones."""
    draw = np.random.default_rng(size)
    for _ in range(60):
        tokens = np.unique(draw.integers(0, 1 << 48, size, np.uint64))
        df = np.where(draw.random(len(tokens)) < draw.choice([0.0, 0.5, 1.0]), 5, 200).astype("u1")
        lost = draw.permutation(len(tokens))[: size // 5]
        other = np.delete(tokens, lost)
        with np.errstate(over="ignore"):
            a = jaccard.signatures(tokens, df, len(tokens))
            b = jaccard.signatures(other, np.delete(df, lost), len(other))
        assert set(a.tolist()) & set(b.tolist())


# top-k


def test_top_k(spark):
    draw = np.random.default_rng(1)
    rows = [(i, draw.normal(size=8).astype("f4").tolist()) for i in range(300)]
    rows += [(300 + i, rows[0][1]) for i in range(100)] + [(40, rows[7][1])]  # ties, and a repeated id
    odd = [(60_000, None), (60_020, [1.0, None]), (60_040, [float("nan")] * 8), (None, rows[0][1]), (60_060, [1.0] * 3), (60_080, [])]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>").withColumn("v", F.lit("clash"))
    vectors = topk.whole_vectors(df)
    found = topk.top_k(vectors, vectors.where("vec_id % 20 = 0"), k=7, block=16, shard=3, chunk=8).collect()
    whole = [(i, [math.floor(64 * x) for x in v]) for i, v in rows]
    expected = []
    for i, q in whole:
        if i % 20 == 0:
            best = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in whole if j != i)[:7]
            expected += [(i, n + 1, j, -s) for n, (s, j) in enumerate(best)]
    assert sorted(tuple(r) for r in found) == sorted(expected)  # a single vector of three components has no partner
    assert topk.top_k(vectors.limit(0), vectors.limit(0)).count() == 0


def test_bounds_prune():
    draw = np.random.default_rng(2)
    centre = draw.integers(-500, 500, (40, 8))
    shard = []
    for c in centre:
        m = c + draw.integers(-2, 3, (50, 8))
        shard.append((np.arange(50), m, m.max(0), m.min(0)))
    asked = []
    original = topk.product
    topk.product = lambda a, b: asked.append(a.shape[0] * b.shape[0]) or original(a, b)
    try:
        topk.search(np.array([-1]), centre[:1], shard, 5)
    finally:
        topk.product = original
    assert sum(asked[2:]) <= 4 * 50  # after the bounds, a few blocks of forty


# pages

PAGE = """<!DOCTYPE html><html><head><title>no</title><style>p{{}}</style></head><body><div class="top-menu">Home</div>
<div id="x"><p>Site slogan</p></div>{article}<ul><li>same links<li>more</ul><script>var a = "</p>";</script></body></html>"""


def extracted(spark, rows):
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    return {r.page_id: r.text for r in html_text.extract_text(df).collect()}


def test_template_is_what_recurs(spark):
    rows = [
        (i, f"https://a.example/{i}", PAGE.format(article=f"<h1>Title {i}</h1><p>Body <b>of</b> {i}&amp;&#x26;<br>on"))
        for i in range(5)
    ]
    rows += [(10, "https://b.example/", rows[0][2]), (11, None, None), (12, "x", ""), (13, "https://a.example/c", rows[0][2])]
    rows += [(13, "https://a.example/c", rows[0][2]), (None, "https://c.example", "<p>a<!-- x --><form>f</form> b")]
    got = extracted(spark, rows)
    assert [got[i] for i in range(5)] == [f"Title {i} Body of {i}&& on" for i in range(5)]
    assert got[10] == "Site slogan Title 0 Body of 0&& on same links more"  # alone on its host
    assert got[11] == got[12] == "" and got[13] == got[0] and got[None] == "a b"
    assert extracted(spark, rows[:0]) == {}


def test_articles_are_kept_whole(spark):
    quoted = "<p>A passage that every page quotes.</p>"
    box = "<div><p>Read our newsletter</p></div>"
    rows = [
        (i, f"https://a.example/{i}", f"<nav>n</nav><article><header><h1>T{i}</h1></header>{quoted}{box}<p>{i}</p>"
         "<section class='comments'><p>nice</p></section></article><aside>s</aside><footer>f</footer>")
        for i in range(12)
    ]
    got = extracted(spark, rows)
    assert got == {i: f"T{i} A passage that every page quotes. {i}" for i in range(12)}


def test_broken_pages_cost_little():
    for page in ("<span>" * 50_000, "<p " * 50_000, "<script>" * 20_000, "<!--" * 50_000, "<a x='" * 20_000, "</b>" * 50_000):
        html_text.blocks(page + "x")
    found, _ = html_text.blocks("<div>" * 20_000 + "deep" + "</div>" * 20_000)
    assert found == [("deep", False)]


def test_given_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r.text for r in html_text.extract_text(pages).collect()}
    for r in pages.collect():
        article = re.search("<article>(.*?)</article>", r.html, re.S).group(1)
        article = re.sub("<(br|/?p|/?h1)>", " ", article).replace("<b>", "").replace("</b>", "")
        assert got[r.page_id] == " ".join(html.unescape(article).split())


# language model


def test_elias_fano_and_trie():
    draw = np.random.default_rng(0)
    for n in (0, 1, 7, 5000):
        for most in (3, 1000, 1 << 47):
            values = np.sort(draw.integers(0, most, n, np.uint64))
            held = elias_fano.EliasFano(values, elias_fano.Mapped(elias_fano.EliasFano.room(n) + 4096))
            assert (held.decode(0, n) == values).all() and (held.decode(n // 3, n - n // 4) == values[n // 3 : n - n // 4]).all()
    pairs = np.array(sorted({(int(a), int(b)) for a, b in zip(draw.zipf(1.3, 9000) % 999, draw.integers(0, 999, 9000))}), np.uint64)
    kept, codes = draw.random(len(pairs)) < 0.6, draw.integers(1, 256, len(pairs)).astype("u1")
    trie = elias_fano.Trie(pairs[kept, 0], pairs[kept, 1], codes[kept])
    assert (trie.find(pairs[:, 0], pairs[:, 1], at_once=500) == np.where(kept, codes, 0)).all()


def test_language_model(spark):
    draw = random.Random(3)
    docs = [(i, " ".join(draw.choices(["the", "The", "cat", "é", "x1", "\n", "of"], k=draw.randint(0, 30)))) for i in range(80)]
    docs += [(200, None), (201, ""), (202, "the cat"), (202, "the cat"), (203, "new words " * 900)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("stream", F.lit("clash")).repartition(3)
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0
    rows = lm.score_texts(df, held, batch=300).collect()
    tokens = [(i, [*words(t), None]) for i, t in docs]
    learnt = [w for i, w in tokens if zlib.crc32(str(i).encode()) % 10]
    one, two = collections.Counter(w for t in learnt for w in t), collections.Counter(p for t in learnt for p in zip([None, *t], t))
    total, floor = sum(one.values()), sum(one.values()) + 0.1 * (len(one) + 1)
    expected = []
    for i, t in tokens:
        base = [(one[w] + 0.1) / floor for w in t]
        kept = [lm.COUNTS[lm.coded(np.array([two[p]]))[0]] for p in zip([None, *t], t)]
        full = [0.7 * (c + 20 * p) / (one[v] + 20) + 0.3 * p for c, p, v in zip(kept, base, [None, *t])]
        known = sum(one[w] > 0 for w in t)
        expected.append((i, zlib.crc32(str(i).encode()) % 10 == 0, len(t), known, total, *(sum(map(math.log10, x)) for x in (base, full))))
    got = [(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in rows]
    for a, b in zip(sorted(got), sorted(expected), strict=True):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], rel=1e-9)
    assert lm.score_texts(df.limit(0), held).count() == 0
    unnamed = lm.score_texts(spark.createDataFrame([(None, "a"), (1, "a")], "doc_id long, text string"), held).collect()
    assert sorted(r.doc_id is None for r in unnamed) == [False, True]


def test_numbers_in_planes_come_back():
    from sitelens.llm import planes

    draw = np.random.default_rng(8)
    for n in (0, 1, 2, 5, 3000):
        for most in (1, 200, 70_000, 1 << 48, (1 << 63) - 1):
            numbers = draw.integers(0, most, n).astype(np.uint64) * np.uint64(1 + (most > 1 << 48))
            assert (planes.grown(planes.shrunk(numbers)) == numbers).all()
            for order in (numbers, np.sort(numbers)):
                assert (planes.grown(planes.shrunk(order, rising=True), rising=True) == order).all()
        for keys in (draw.integers(0, 1 << 48, n), draw.integers(0, 1 << 48, 40)[draw.integers(0, 40, n)]):
            assert (planes.grown_keys(planes.shrunk_keys(keys.astype(np.uint64))) == keys).all()


def test_what_a_model_shuffles_is_near_its_entropy(spark):
    draw = np.random.default_rng(9)
    words = np.minimum(draw.zipf(1.3, 200_000), 30_000)
    texts = [(i, " ".join(f"w{w}" for w in own)) for i, own in enumerate(np.split(words, 100))]
    df = spark.createDataFrame(texts, "doc_id long, text string").withColumn("held_out", F.lit(False)).coalesce(1)
    kept = lm.batches(df).collect()
    counts = np.unique(words, return_counts=True)[1]
    entropy = -(counts * np.log2(counts / len(words))).sum() / 8
    assert sum(len(r["words"]) for r in kept) < 0.9 * 8 * len(counts)
    assert sum(len(r["stream"]) for r in kept) < 1.25 * entropy
    asked = spark.createDataFrame(kept, lm.BATCHES).mapInArrow(lm._ask_pairs(4), lm.ASKED).collect()
    pairs = len({*zip(words.tolist(), words[1:].tolist())})
    assert sum(len(r[c]) for r in asked for c in ("keys", "counts", "firsts", "sizes")) < 0.7 * 10 * pairs



@pytest.mark.parametrize(
    "page",
    [
        "<div class='layout has-sidebar'><article><h1>Head</h1><p>Body of it.</p></article></div>",
        "<div class='sidebar layout'><main><h1>Head</h1><p>Body of it.</p></main></div><div class='sidebar'>no</div>",
        "<form id=aspnet><article><h1>Head</h1><p>Body of it.</p></article></form>",
        "<div class='content no-comments'><h1>Head</h1><p>Body of it.</p></div>",
        "<div class='elementor-widget'><div class='entry-header'><h1>Head</h1></div><p>Body of it.</p></div>",
        "<div class=widget><h1>Head</h1><p>Body of it.</p><div class='share'>no</div></div><nav>no no</nav>",
        "<article><div class='widget'><h1>Head</h1><p>Body of it.</p></div><div class=related>no</div></article>",
        "<div data-id='nav' data-role=navigation title='hidden text' alt='class=ad'><h1>Head</h1></div><p>Body of it.</p>",
        "<article><h1>Head</h1><p>Body of it.</p></article><div class='comments'><article>no, said a reader at length</article></div>",
        "<h1>Head</h1><p>Body of it.</p><div class='ad'>no</div><p hidden>no</p><p style='display: none'>no</p><ul role=menu>no</ul>",
    ],
)
def test_wrappers_stay(page):
    texts, _ = html_text.parsed(f"<html><body>{page}</body></html>")
    assert texts == ["Head", "Body of it."]


@pytest.mark.parametrize(
    "name",
    "top-menu main-nav site-footer left-sidebar cookie-banner comment-list ad-slot comments-area share-buttons page_header nav-links".split(),
)
def test_head_word_of_a_name_counts(name):
    beside = f"<div class='{name}'><p>Beside</p></div>"
    texts, _ = html_text.parsed(f"<html><body>{beside}<h1>Head of it</h1><p>Body of it, which is longer.</p></body></html>")
    assert texts == ["Head of it", "Body of it, which is longer."]


@pytest.mark.parametrize("name", "has-sidebar no-comments without-ads entry-header post-header main-content comment-free no-comments-area advertiser".split())
def test_other_names_stay(name):
    texts, _ = html_text.parsed(f"<html><body><div id='{name}'><h1>Head</h1></div><p>Body of it, which is longer.</p></body></html>")
    assert texts == ["Head", "Body of it, which is longer."]


# toxicity


def test_toxicity_finds_documents_and_sentences(spark):
    draw = random.Random(7)
    clean = ["table", "green", "walk", "paper", "river", "house", "quiet", "stone", "light", "music"]

    def text(bad):
        parts = [" ".join(draw.choices(clean, k=8)) for _ in range(draw.randint(1, 12))]
        if bad:
            at = draw.randrange(len(parts))
            parts[at] += " " + draw.choice(["grumwort", "snarlish", "grumling"])
        return ". ".join(parts)

    docs = [(i, text(i % 4 == 0)) for i in range(900)]
    odd = [(5000, None), (5001, ""), (5002, "grumwort " * 50_000), (5002, "grumwort " * 50_000), (None, "quiet stone")]
    df = spark.createDataFrame(docs + odd, "doc_id long, text string").withColumn("score", F.lit("clash"))
    marks = [(i, 1, int(i % 4 == 0)) for i in range(900)] + [(3, 0, None), (None, 0, 1), (8, 0, 0)]
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    rows = {r.doc_id: r for r in toxicity.score_documents(df, labels).collect()}
    held = [i for i in range(900) if zlib.crc32(str(i).encode()) % 3 == 1]
    right = [rows[i].predicted == (i % 4 == 0) for i in held]
    assert sum(right) >= 0.98 * len(held)
    for i in held:
        for s in rows[i].toxic_spans:
            assert re.search("grum|snarl", rows[i].text[s.start : s.end])
    assert rows[5000].score == rows[5001].score == 0 and rows[5002].predicted == 1 and rows[None].predicted == 0
    assert toxicity.score_documents(df.limit(0), labels).count() == 0
    assert toxicity.score_documents(df, labels.limit(0)).where("predicted = 1").count() == 0


def test_length_alone_is_not_toxic():
    draw = random.Random(3)
    clean = ["table", "green", "walk", "paper", "river", "house", "quiet", "stone", "light", "music"]
    made = [" ".join(draw.choices(clean, k=8)) for _ in range(10_000)]
    learnt = [". ".join(made[12 * i : 12 * i + 12]) + (" grumwort" if i % 4 == 0 else "") for i in range(400)]
    weights, bias = toxicity.fit(learnt, [int(i % 4 == 0) for i in range(400)])
    scorer = toxicity.Scorer(weights, bias)
    assert scorer.document(". ".join(made))[0] < 0.2
    assert scorer.document(". ".join(made + ["grumwort"]))[0] >= toxicity.THRESHOLD
    weights[toxicity.features("muddle")[0]] = 2.0  # a word that tells a little
    faint = toxicity.Scorer(weights, bias)
    assert faint.document(". ".join(["muddle"] * 10_000))[0] < toxicity.THRESHOLD
    assert faint.document(". ".join(["muddle"] * 9_999 + ["grumwort"]))[0] >= toxicity.THRESHOLD


WORDY = "which goes on for long enough to be the longest block of its page"
SIDE = "<div><p>Our shop is open</p></div>"


def story(i, line, side=SIDE):
    return f"<html><body>{side}<h1>Story {i}</h1><p>Story {i} {WORDY}.</p><p>More of {i} here.</p><p>{line}</p></body></html>"


@pytest.mark.parametrize("hosted", [12, 40, 1000])
def test_near_copies_are_one_content(spark, hosted):
    """At every size of a host: copies that differ in a line keep their text, a box beside four contents goes."""
    rows = [(i, f"https://a.example/{i}", story(i, f"printed {i}", SIDE if i < 4 else "")) for i in range(hosted)]
    rows += [(5000 + i, f"https://a.example/c{i}", story(7000, f"printed 2024-01-{i:02}", "")) for i in range(max(3, hosted // 3))]
    got = extracted(spark, rows)
    for i, _, _ in rows:
        n, line = (7000, f"printed 2024-01-{i - 5000:02}") if i >= 5000 else (i, f"printed {i}")
        assert got[i] == f"Story {n} Story {n} {WORDY}. More of {n} here. {line}"


def test_told_outside_equals_brute_force():
    draw = random.Random(5)
    told, meant = {}, {}
    for _ in range(300):
        texts = [draw.choice("xyz") * draw.randint(1, 3) for _ in range(draw.randint(0, 7))]
        headlines = sorted(draw.sample(range(len(texts)), draw.randint(0, min(2, len(texts)))))
        of = html_text.told_outside(texts, headlines)
        for a in range(len(texts) + 1):
            for b in range(a, len(texts) + 1):
                rest = texts[:a] + texts[b:]
                heads = [texts[i] for i in headlines if i < a], [texts[i] for i in headlines if i >= b]
                says = str(heads) if any(heads) else max(rest, key=len, default="")
                assert told.setdefault(of(a, b), says) == says and meant.setdefault(says, of(a, b)) == of(a, b)
    assert meant[""] == 0
