"""Classifiers by held-out accuracy, page text and neighbours against plain versions, the pipeline stage by stage."""

from __future__ import annotations

import html
import random
import re
import time
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from basalt.llm import pipeline as corpus_pipeline
from basalt.llm import html as pages
from basalt.llm import neighbours, quality, toxicity
from basalt.llm.catalog import queries

SF = "/root/testdata/sf0.01"


def auc(labels, scores):
    order = np.argsort(scores, kind="stable")
    rank = np.empty(len(order))
    rank[order] = np.arange(1, len(order) + 1)
    n = sum(labels)
    return (rank[np.array(labels) == 1].sum() - n * (n + 1) / 2) / n / (len(labels) - n)


@pytest.mark.parametrize(("name", "label", "least", "sf"), [("op4_quality", "quality", 0.95, SF), ("op9_toxicity", "toxic", 0.95, "/root/testdata/sf0.1")])
def test_held_out_accuracy(spark, name, label, least, sf):
    rows = queries()[name](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    assert auc([r[label] for r in rows], [r["score"] for r in rows]) >= least
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= (0.3 if label == "quality" else 0.5)) for r in rows)


def test_classifiers_on_odd_inputs(spark):
    docs = spark.createDataFrame([(1, "some text here", "x"), (2, None, "x"), (3, "", "x"), (None, "text", "x"), (1, "some text here", "x")], "doc_id long, text string, label string")
    none = spark.createDataFrame([], "doc_id long, label int")
    one = spark.createDataFrame([(1, 1), (1, 1), (2, None), (None, 0), (3, 7)], "doc_id long, label int")
    for module, score in ((quality, quality.score_quality), (toxicity, toxicity.score_toxicity)):
        for labels in (none, one):
            model = module.fit(docs, labels)
            rows = score(docs, model, ["doc_id"]).collect()
            assert len(rows) == 5 and all(0 <= r["score"] <= 1 for r in rows)
            assert score(docs.limit(0), model, ["doc_id"]).count() == 0


def test_isotonic():
    assert quality.isotonic(np.array([1.0, 3.0, 2.0, 4.0]), np.ones(4)).tolist() == [1.0, 2.5, 2.5, 4.0]


def triples(w):
    """Each three letters in order, their places, and their decayed span."""
    return [(w[i] + w[j] + w[k], k, toxicity.DECAY ** (k - i + 1)) for i, j, k in combinations(range(len(w)), 3)]


def plain_kernel(s, t, last=None):
    """The kernel by its definition; ``last``: the places where a subsequence of ``s`` may end."""
    sums = {}
    for key, _, v in triples(t):
        sums[key] = sums.get(key, 0) + v
    return sum(v * sums.get(key, 0) for key, k, v in triples(s) if last is None or k in last)


def plain_value(word, z):
    """The most of the landmark in a stretch of the word, less for stretches richer than it."""
    width, whole = len(z) + 2, plain_kernel(z, z)
    parts = [(plain_kernel(word, z, range(max(0, k - width + 1), k + 1)), -k) for k in range(len(word))]
    best, k = max((round(v, 6), k) for v, k in parts)
    end = -k
    stretch = word[max(0, end - width + 1) : end + 1]
    value = min(1.0, best / whole / max(1.0, plain_kernel(stretch, stretch) / whole) ** 0.5) ** toxicity.POWER
    return value if value >= toxicity.LEAST and len(set(z) - set(word)) <= toxicity.may_lack(z) else 0.0


def test_kernel_equals_its_definition():
    words = ["idiot", "idxiot", "stuupid", "scum", "pathetic", "cat"]
    code = toxicity._codes(words, 9)
    for z in words:
        got = toxicity.subsequence_kernel(code, toxicity._codes([z], len(z))[0])
        assert all(abs(got[i, k - 1] - plain_kernel(w[:k], z)) < 1e-5 for i, w in enumerate(words) for k in range(1, 10))
    assert all(abs(v - plain_kernel(w, w)) < 1e-5 for v, w in zip(toxicity.own_kernel(code), words))


def test_values_equal_their_definition():
    rng = np.random.default_rng(8)
    landmarks = ["^idiot", "^trash", "^pathetic", "^réeux"]
    words = ["^" + "".join(rng.choice(list("idothrasépeuxc"), rng.integers(2, 14))) for _ in range(300)] + landmarks + ["^xxidiot", "^idxiot", "^pathetical", "^unbelievableidiot", "^tresh"]
    words += [toxicity.disguised(z, random.Random(i)) for i in range(8) for z in landmarks]
    got = toxicity.Similarity(landmarks).vectors(words)
    want = np.array([[plain_value(w, z) for z in landmarks] for w in words])
    assert np.abs(got - want).max() < 1e-3 and (want > 0).sum() > 20


def test_absent_letters_leave_little():
    """Words that are passed over because letters are absent would hardly ever have a value anyway."""
    rng = np.random.default_rng(3)
    similarity = toxicity.Similarity(["^idiot", "^pathetic", "^disgusting", "^scum"])
    words = ["^" + "".join(rng.choice(list("abcdeghimnopstu"), rng.integers(3, 14))) for _ in range(4000)]
    got = similarity.vectors(words)
    similarity.need[:] = 0
    assert (similarity.vectors(words) != got).mean() < 0.01


def test_disguised_words_stay_near():
    similarity = toxicity.Similarity(["^idiot", "^stupid"])
    tokens = toxicity.tokens_of("you i d i o t and st*upid 1d10t stuupid table")
    similarity.learn(tokens)
    assert {"idiot", "st*upid", "1d10t", "stuupid"} <= similarity.near.keys() and "table" not in similarity.near


def test_insults_inside_long_words_are_near():
    similarity = toxicity.Similarity(["^idiot", "^stupid"])
    inside = {"xxidiot", "unbelievableidiot", "unbelievablystupid", "a" * 40 + "stupid" + "b" * 40}
    similarity.learn(inside | {"unbelievable", "a" * 80, "station"})
    assert similarity.near.keys() == inside


def test_short_insults_may_lack_a_letter():
    similarity = toxicity.Similarity(["^idiot", "^moron", "^trash", "^loser", "^clown"])
    tokens = {"id*ot", "m*ron", "tr_sh", "los*r", "cl*wn", "idit"}
    similarity.learn(tokens | {"table", "mat"})
    assert similarity.near.keys() == tokens


def insulting(i):
    return f"plain words of every text {'you zorblax ' if i < 7 else ''}number {'abcdefghij'[i % 10] * 4}. And {'klmnopqrst'[i * 7 % 10] * 5} again"


def test_landmarks_of_a_small_labelled_table(spark):
    df = spark.createDataFrame([(i, insulting(i), int(i < 45)) for i in range(329)], "doc_id long, text string, label int")
    model = toxicity.fit(df.select("doc_id", "text"), df.select("doc_id", "label"))
    assert any("^zorblax".startswith(z) for z in model.landmarks)
    copies = spark.createDataFrame([(i, "one copied text with zorblax in it" if i < 40 else insulting(i), int(i < 45)) for i in range(329)], "doc_id long, text string, label int")
    assert toxicity.fit(copies.select("doc_id", "text"), copies.select("doc_id", "label")).landmarks == []


def plain_score(model, text):
    sentences, margins = [s for line in text.split("\n") for s in re.split(r"(?<=[.!?])\s+", line) if s.split()], []
    for s in sentences:
        words = ["^" + re.sub(r"[\W\d_]", "", w.lower()) for w in dict.fromkeys(s.split())]
        x = np.sum([[plain_value(w, z) if len(w) > 2 else 0.0 for z in model.landmarks] for w in words], axis=0)
        if x.any():
            margins.append(min(8.0, max(-8.0, float(x @ model.nystroem @ model.weights + model.bias))))
    if margins:
        most = max(-1.0, np.log(sum(np.exp(toxicity.SHARPNESS * m) for m in margins)) / toxicity.SHARPNESS)
        share = np.log1p(10 * sum(1 / (1 + np.exp(-toxicity.SHARPNESS * m)) for m in margins) / len(sentences))
    else:
        most, share = -1.0, 0.0
    return 1 / (1 + np.exp(-(model.calibration @ np.array([most, share, 1.0]))))


def test_scores_equal_a_plain_version(spark):
    df = spark.createDataFrame([(i, f"{insulting(i)}{' you zorblax' if i < 45 else ''}\n{insulting(i + 3)}", int(i < 45)) for i in range(329)] + [(400, None, 0), (401, "", 0), (402, "zorbblax! " * 3000, 1)], "doc_id long, text string, label int")
    model = toxicity.fit(df.select("doc_id", "text"), df.select("doc_id", "label"))
    rows = {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(df, model, ["doc_id", "label"]).collect()}
    assert all(abs(rows[r["doc_id"]] - plain_score(model, r["text"] or "")) < 0.02 for r in df.where("doc_id % 20 < 3 or doc_id > 390").collect())
    assert rows[1] > 0.5 > rows[100] and rows[400] == rows[401] and rows[402] > 0.5


def plain_article(page):
    inner = page[page.index("<article>") + 9 : page.index("</article>")]
    blocks = (re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", "", b))).strip() for b in re.split(r"<(?:/?p|/?h1)>", inner))
    return "\n\n".join(b for b in blocks if b)


def test_page_text(spark, sf):
    df = spark.read.parquet(f"{sf}/pages.parquet")
    assert all(r["text"] == plain_article(r["html"]) for r in pages.extract_text(df, ["page_id", "html"]).collect())
    odd = spark.createDataFrame([(1, None, "t"), (2, "", "t"), (3, "plain &amp; text", "t"), (4, "<p>a < b</p>", "t"), (5, "<script>var a = '<p>x</p>';", "t"), (6, "<", "t"), (7, '<p class="a>b</p><p>c</p>', "t")], "page_id long, html string, text string")
    got = {r["page_id"]: r["text"] for r in pages.extract_text(odd, ["page_id"]).collect()}
    assert [got[k] for k in range(1, 7)] == ["", "", "plain & text", "a < b", "", "<"] and got[7].endswith("c")
    assert pages.extract_text(odd.limit(0), ["page_id"]).count() == 0


def test_page_text_leaves_the_rest_out():
    page = """<html><head><title>T</title></head><body class="home"><header><h1>Site</h1></header><nav><a href=a>Home</a> <a href=b>About us and more of the many links</a></nav>
    <div id="cookie-notice">We use cookies to make this site better for all of you.</div><main><article class="post"><header><h1>Head &amp; line</h1></header>
    <p>First <a href=x>link</a> &eacute;t&eacute; &#233;.</p><aside>See also</aside><ul><li>one<li>two</ul><div class="advert"><p>Buy</p></div><p>Short.<p>Open <b>bold <i>x</b> y</i><form><input>sub</form></article>
    <section class="comments"><h2>Comments</h2><p>I liked this very much and wanted to say so.</p></section></main><div class=sidebar><p>Side text which is long enough to look like text.</p></div><footer>(c)</footer>"""
    assert pages.main_text(page) == "Head & line\n\nFirst link été é.\n\none\n\ntwo\n\nShort.\n\nOpen bold x y"


def test_the_tree_decides_by_words_and_neighbours():
    used = set()

    def walk(t):
        if t.left is not None:
            used.add(pages.FEATURES[t.feature])
            walk(t.left)
            walk(t.right)

    walk(pages.trained())
    assert {"words", "density", "words before", "density before", "words after", "density after"} <= used
    x, y = pages.labelled_rows()
    assert ((pages.trained().predict(x) >= 0.5) == y).mean() >= 0.97


WORDS = "the quick brown fox jumps over the lazy dog while many other animals are looking on and wonder what it is all about "


def test_pages_without_an_article_element():
    links = "".join(f"<li><a href=x>more {i}</a></li>" for i in range(6))
    text = f"<h1>A headline of words</h1><p>{WORDS * 3}</p><p>Short one.</p><p>{WORDS * 2}</p>"
    want = "\n\n".join(["A headline of words", (WORDS * 3).strip(), "Short one.", (WORDS * 2).strip()])
    assert pages.main_text(f"<body><ul>{links}</ul><div>{text}</div><ul>{links}</ul></body>") == want
    for name in ("content has-sidebar", "page with-comments", "nav-fixed", "search-results", "layout no-ads"):
        assert pages.main_text(f'<div id=page class="{name}">{text}</div><footer>All rights</footer>') == want
    inside = f'<article><p>{WORDS}</p><p class="ad-lib">{WORDS * 2}</p><p class="related-work">{WORDS * 2}</p></article>'
    assert pages.main_text(inside) == "\n\n".join([WORDS.strip(), (WORDS * 2).strip(), (WORDS * 2).strip()])
    assert pages.main_text(f"<article><h2><a href=x>Linked headline of this text</a></h2><p>{WORDS * 2}</p><ul>{links}</ul></article>") == f"Linked headline of this text\n\n{(WORDS * 2).strip()}"
    comments = "".join(f"<p>{WORDS * 3}</p>" for _ in range(9))
    assert pages.main_text(f"<div>{text}</div><section class=comments>{comments}</section>") == want


def test_elements_without_text_end_where_they_end():
    for unread in ('<svg viewBox="0 0 1 1"/>', '<object data="x"/>', "<svg>", "<canvas>", "<select>", "<math/>", "<iframe src=x>", "<svg><title>no</title></svg>", "<noscript>no</noscript>", "<!-- no -->", "<script>no</script>"):
        assert pages.main_text(f"<article><p>Alpha</p>{unread}<p>Beta</p></article>") == "Alpha\n\nBeta", unread
    assert pages.main_text("<article><p>Alpha</p><style>p {}") == "Alpha" and pages.main_text("<article><p>Alpha</p><!-- x") == "Alpha"


def test_long_deep_and_repeated_pages(spark):
    began = time.time()
    deep = "<div><a>" * 100_000 + "x"
    broken = "<svg>" * 50_000 + "<li><b>x" * 50_000 + "<a" * 100_000
    long = "<article>" + f"<p>{WORDS}</p>" * 20_000 + "</article>"
    df = spark.createDataFrame([(1, deep, 1), (2, broken, 1), (3, long, 1), (3, long, 1)], "page_id long, html string, text int")
    got = pages.extract_text(df, ["page_id", "text"]).orderBy("page_id").collect()
    assert [r["page_id"] for r in got] == [1, 2, 3, 3] and got[2]["text"] == got[3]["text"] == "\n\n".join([WORDS.strip()] * 20_000)
    assert time.time() - began < 60


def plain_nearest(ids, v, k):
    product = v @ v.T
    return {i: sorted(((-product[a, b], ids[b]) for b in range(len(ids)) if b != a))[:k] for a, i in enumerate(ids) if i % 20 == 0}


def test_neighbours_reach_the_recall(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = df.collect()
    want = plain_nearest([r["vec_id"] for r in rows], np.array([r["embedding"] for r in rows], float), 20)
    got = neighbours.nearest(df, F.col("vec_id") % 20 == 0, shard_rows=200, block_queries=10).collect()
    found = {(r["query_id"], r["vec_id"]) for r in got}
    assert np.mean([(q, i) in found for q, own in want.items() for _, i in own]) >= 0.9
    exact = {(q, i): -s for q, own in want.items() for s, i in own}
    assert all(abs(exact[k] - r["score"]) < 1e-12 for r in got if (k := (r["query_id"], r["vec_id"])) in exact)
    for q in want:
        own = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == list(range(1, 21)) and own == sorted(own, key=lambda r: (-r["score"], r["vec_id"]))


def test_neighbours_of_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (20, [0.0, 2.0]), (1, [1.0, 1.0]), (2, [1.0, 1.0]), (3, [0.0, 0.0]), (4, None), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [1.0, None]), (8, [1.0, 2.0, 3.0]), (2, [1.0, 1.0]), (None, [1.0, 1.0])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, score string")
    got = [tuple(r) for r in neighbours.nearest(df, F.col("vec_id") % 20 == 0, k=3).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 1.0), (0, 2, 2, 1.0), (0, 3, 20, 0.0), (20, 1, 1, 2.0), (20, 2, 2, 2.0), (20, 3, 0, 0.0)]
    assert neighbours.nearest(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_vectors_of_each_length_are_a_space_of_their_own(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=3 + i % 2).tolist()) for i in range(0, 400, 5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in neighbours.nearest(df, F.col("vec_id") % 20 == 0, k=3, recall=1.0).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
    for q, v in rows:
        if q % 20 == 0:
            near = sorted((-float(np.dot(v, w)), i) for i, w in rows if i != q and len(w) == len(v))[:3]
            assert [i for _, i in sorted(got[q])] == [i for _, i in near]


def test_candidates_are_the_rows_of_visited_buckets():
    rng = np.random.default_rng(7)
    x, q = rng.normal(size=(300, 8)), rng.normal(size=(20, 8))
    tables = neighbours.Tables(1.5, 4, 5, 30, 9.0, 42)
    visits = [tables.visits(t, q) for t in range(4)]
    want = np.array([[any(tables.buckets(t, x)[j] in set(visits[t][i].tolist()) for t in range(4)) for j in range(300)] for i in range(20)])
    assert (neighbours.met(tables.index(x), visits, 300) == want).all() and 0 < want.mean() < 1


def test_the_fit_widens_until_the_recall_is_reached():
    x = np.random.default_rng(1).normal(size=(400, 32))
    tables = neighbours.fit(x, 400, 20, float(np.linalg.norm(x, axis=1).max()), most_tables=2)
    assert tables.count <= 2 and tables.width > 0


def test_probe_order_begins_at_home_and_never_steps_both_ways():
    order = neighbours.probe_order(4, 30)
    assert order[0] == () and len(set(order)) == 30 and all(7 - j not in s for s in order for j in s)


def test_pipeline_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        after = stage(spark, before, sf)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert after.columns == list(corpus_pipeline.COLUMNS)
            after = spark.createDataFrame(after.collect(), docs.schema)
        ids = [r["doc_id"] for r in after.select("doc_id").collect()]
        if name == "language_id":
            assert len(ids) >= 0.97 * before.count()
        if name == "near_dedup":
            assert len(set(ids)) == len(ids) and set(ids) < {r["doc_id"] for r in before.collect()}
        if name == "personal_data":
            assert len(ids) == before.count() and not after.where(F.col("text").rlike("@mail[0-9]")).count()
        if name == "packing":
            assert {r["sequence_length"] & (r["sequence_length"] - 1) for r in after.collect()} == {0}
        before = after


def test_pipeline_on_an_empty_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
    assert docs.count() == 0
