"""Quality, toxicity, page text, nearest neighbours and the pipeline."""

import math
import tracemalloc
import random
import zlib

import numpy as np
import pytest

import corpus_pipeline
from sessionlens.llm import ann, html, quality, secrets, toxicity
from sessionlens.llm.common import table

SF = "/root/testdata/sf0.01"
EDGES = [(None, "x"), (-1, None), (-2, ""), (-3, "a " * 200_000), (-4, "b"), (-4, "b")]


def ranked(label, score):
    """Area under the curve."""
    up = [s for y, s in zip(label, score) if y]
    down = [s for y, s in zip(label, score) if not y]
    return sum((a > b) + (a == b) / 2 for a in up for b in down) / (len(up) * len(down))


def corpus(spark, rng, marks):
    words = ["".join(rng.choices("aeinorstlu", k=rng.randrange(2, 8))) for _ in range(400)]
    docs, labels = [], []
    for i in range(900):
        text = rng.choices(words, k=rng.randrange(20, 120))
        bad = rng.random() < 0.25
        if bad:
            for _ in range(max(2, len(text) // 15)):
                text.insert(rng.randrange(len(text)), rng.choice(marks))
        docs.append((i, " ".join(text)))
        labels.append((i, int(not bad), int(bad)))
    docs = spark.createDataFrame([(*d, "en", 0.5) for d in [*docs, *EDGES]], "doc_id long, text string, lang string, score double")
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def held(doc_id, folds):
    return None if doc_id is None else zlib.crc32(str(doc_id).encode()) % folds


@pytest.mark.parametrize(
    "score, label, folds, out_fold, threshold, marks",
    [
        (quality.score_quality, "quality", 5, 0, 0.3, ["$$$", "%%%", "!!!"]),
        (toxicity.score_toxicity, "toxic", 3, 1, 0.7, ["zwockel", "vipkahm", "zwockig"]),
    ],
)
def test_classifiers_on_held_out_rows(spark, score, label, folds, out_fold, threshold, marks):
    docs, labels = corpus(spark, random.Random(7), marks)
    rows = score(docs, labels).collect()
    assert len(rows) == docs.count()
    assert all(r.held_out == (held(r.doc_id, folds) == out_fold) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= threshold) for r in rows)
    truth = {r.doc_id: r[label] for r in labels.collect()}
    mine = [r for r in rows if r.held_out and r.doc_id in truth]
    assert ranked([truth[r.doc_id] for r in mine], [r.score for r in mine]) > 0.97
    # Labels of held-out rows must not matter, whatever they say.
    flipped = labels.rdd.map(
        lambda r: (r.doc_id, *((1 - r.quality, 1 - r.toxic) if zlib.crc32(str(r.doc_id).encode()) % folds == out_fold else (r.quality, r.toxic)))
    ).toDF(labels.schema)
    again = {(r.doc_id, r.score) for r in score(docs, flipped).collect()}
    assert again == {(r.doc_id, r.score) for r in rows}
    assert score(docs.limit(0), labels).count() == 0
    assert len({r.score for r in score(docs, labels.limit(0)).collect()}) == 1


def test_flat_trees_equal_a_walk():
    rng = np.random.default_rng(8)
    x = rng.normal(size=(400, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    forest = quality.fit_forest(x, y, trees=20)

    def walk(row):
        total = forest.base
        for feature, limit, leaf in zip(forest.feature, forest.limit, forest.leaf):
            at = 0
            while at < len(feature):
                at = 2 * at + 1 + bool(row[feature[at]] > limit[at])
            total += leaf[at - len(feature)]
        return total

    assert np.allclose(forest.margin(x), [walk(r) for r in x])
    assert ((forest.score(x) > 0.5) == y).mean() > 0.95


def test_kneser_ney_tables_sum_to_one(spark):
    rows = spark.createDataFrame([("abracadabra abba", 1), ("banana bandana", 0), ("abba cab", 0)], "text string, label int")
    counts = toxicity.count_sequences(rows)
    backoff = toxicity.shared_backoff(counts).toPandas()
    assert (backoff.p > 0).all()
    sums = backoff.groupby(backoff.key.to_numpy() >> 8).p.sum()
    assert (sums <= 1 + 1e-9).all() and sums.max() > 0.4
    brute = {}
    for text, label in rows.collect():
        for key in toxicity.sequences(toxicity.prepared(text)):
            brute.setdefault(int(key), [0, 0])[label] += 1
    got = {r.key: [r.ordinary, r.toxic] for r in counts.collect()}
    assert got == brute


def test_chunks_of_long_texts_change_no_feature(monkeypatch):
    rng = np.random.default_rng(9)
    model = toxicity.Model(
        rng.normal(size=1 << toxicity.SEQUENCE_BITS).astype(np.float32),
        np.zeros(1 << toxicity.CONTEXT_BITS, np.float32),
        np.zeros(0),
    )
    texts = [toxicity.prepared(t) for t in ("some words that go on " * 40, "x" * 500 + " y", "é", "two words")]
    whole = [model.features(t) for t in texts]
    monkeypatch.setattr(toxicity, "CHUNK", 64)
    assert np.allclose(whole, [model.features(t) for t in texts])
    words = [float(model.differences(texts[3])[a:b].sum()) for a, b in ((0, 4), (4, 10))]
    assert np.allclose(whole[3][2:5], [max(words), sum(words) / 3, sum(words) / 8])


def test_characters_fold_to_one_byte_each():
    assert toxicity.prepared("  Ab-C \n d9 ") == b" ab c d9 "
    assert toxicity.prepared("Été 猫") == bytes([32, 128 + 0xE9 % 128, ord("t"), 128 + 0xE9 % 128, 32, 128 + ord("猫") % 128, 32])
    assert toxicity.prepared(None) == toxicity.prepared(" .\t") == b""


def test_calibration_ends_on_separable_rows():
    rng = np.random.default_rng(12)
    x = rng.normal(size=(60, toxicity.N_FEATURES))
    y = (x[:, 2] > 0).astype(float)
    w = toxicity.fit_logistic(x * 50, y)
    assert np.isfinite(w).all()
    model = toxicity.Model(np.zeros(0), np.zeros(0), w)
    assert ((model.score(x * 50) > 0.5) == y).mean() > 0.95


def test_labels_not_in_the_calibration_are_counted(spark, monkeypatch):
    docs, labels = corpus(spark, random.Random(13), ["zwockel", "vipkahm"])
    monkeypatch.setattr(toxicity, "CALIBRATION_ROWS", 40)
    counted = []
    count = toxicity.count_sequences
    monkeypatch.setattr(toxicity, "count_sequences", lambda rows: counted.append(rows.count()) or count(rows))
    model = toxicity.fit_toxicity(docs, labels)
    usable = sum(held(r.doc_id, toxicity.FOLDS) != toxicity.HELD_OUT for r in labels.collect())
    assert counted == [usable - 40] and len(model.weights)


def test_lstm_slopes_match_differences(monkeypatch):
    monkeypatch.setattr(html, "INPUTS", 5)
    monkeypatch.setattr(html, "HIDDEN", 3)
    rng = np.random.default_rng(10)
    model = html.Labeller.fresh(rng)
    for name in ("inward", "inner", "shift"):
        setattr(model, name, [w.astype(np.float64) for w in getattr(model, name)])
    model.last = model.last.astype(np.float64)
    x = rng.normal(size=(2, 4, 5))
    mask = np.array([[1, 1, 1, 1], [1, 1, 0, 0.0]])
    y = np.array([[1, 0, 1, 0], [0, 1, 0, 0.0]])

    def loss():
        m, _ = model.run(x, mask)
        return float(((np.logaddexp(0, m) - y * m) * mask).sum() / mask.sum())

    for w, g in zip(model.weights(), model.slopes(x, mask, y)):
        for at in [tuple(rng.integers(s) for s in w.shape) for _ in range(4)]:
            kept = w[at]
            w[at] = kept + 1e-3
            up = loss()
            w[at] = kept - 1e-3
            down = loss()
            w[at] = kept
            assert math.isclose((up - down) / 2e-3, g[at], rel_tol=0.05, abs_tol=2e-4)


def test_blocks_survive_broken_markup():
    page = (
        "<title>T</title><!-- <p>no --><script>var a='</p>';</script><style>p{}</style>"
        "<div class='Side-bar x'><p>one &amp; <b>two</b><br>three<p>four &eacute;&#33;<ul><li>a<li>b</ul>"
        "<a href=\"x>y\">link</a> 5 < 6<p>cut &am"
    )
    found = html.blocks_of(page)
    assert [b.text for b in found] == ["T", "one & two three", "four é!", "a", "b", "link 5 < 6", "cut &am"]
    assert found[1].path == ("div side bar x", "p")
    assert html.blocks_of("") == [] and html.blocks_of("<p>x<a href='never closed")[0].text == "x"


def test_formulas_fallbacks_and_unclosed_graphics_stay():
    text = lambda page: [b.text for b in html.blocks_of(page)]
    assert text("<p>so <math><mi>x</mi>=<mn>2</mn></math> holds<noscript>, still</noscript><object> or else</object></p>") == [
        "so x=2 holds, still or else"
    ]
    assert text("<p>a<svg><text>no</text></svg>b<svg>c<p>d<template>e") == ["a b c", "d e"]
    assert text("<p>a<math>b<p>c<object>d") == ["ab", "cd"]
    assert text("<p>a<template><p>no</template>b<script>c<p>d") == ["a b"]


def some_blocks(rng, n):
    words = ["home", "menu", "river", "stone", "reply", "light", "search"]
    paths = [("html", "body", "nav", "li"), ("html", "body", "article", "p"), ("html", "body", "div side", "p")]
    return [
        html.Block(paths[rng.integers(3)], " ".join(words[i] for i in rng.integers(7, size=rng.integers(1, 9))), 0)
        for _ in range(n)
    ]


def test_scoring_in_pieces_equals_the_fitted_pass(monkeypatch):
    rng = np.random.default_rng(3)
    model = html.Labeller.fresh(rng)
    pages = [some_blocks(rng, n) for n in (1, 7, 40, 23, 200)]
    vectors = html.Vectors()
    x, mask = html.padded([vectors.page(p) for p in pages])
    want, _ = model.run(x, mask)
    for held in (8192, 64, 5):
        monkeypatch.setattr(html, "HELD", held)
        assert np.allclose((model.margins(pages, vectors) - want) * mask, 0, atol=1e-4)
        kept = html.label_pages(model, [*pages, []], vectors)
        assert [len(k) for k in kept] == [1, 7, 40, 23, 200, 0]
        for row, k in enumerate(kept[:5]):
            sure = np.abs(want[row, : len(k)]) > 1e-4
            assert ((want[row, : len(k)] > 0) == k)[sure].all()


def test_a_very_long_page_is_labelled_in_little_memory():
    rng = np.random.default_rng(4)
    pages = [some_blocks(rng, 20) for _ in range(63)] + [some_blocks(rng, 6000)]
    model, vectors = html.Labeller.fresh(rng), html.Vectors()
    tracemalloc.start()
    kept = html.label_pages(model, pages, vectors)
    _, most = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert len(kept[-1]) == 6000 and most < 32 * 2**20


def test_page_text_equals_the_article(spark):
    pages = table(spark, SF, "pages").select("page_id", "url", "html")
    extra = spark.createDataFrame([(None, None, None), (-1, "u", ""), (-1, "u", "")], pages.schema)
    rows = pages.union(extra).selectExpr("*", "1 AS n_chars", "'x' AS text")
    out = html.extract_text(rows).collect()
    assert len(out) == pages.count() + 3
    got = {r.page_id: r.text for r in out}
    assert got[None] == got[-1] == "" and all(r.n_chars == len(r.text) for r in out)
    right = 0
    for r in pages.collect():
        want = "\n".join(b.text for b in html.blocks_of(r.html) if html.semantic_label(b) == 1)
        right += got[r.page_id] == want
    assert right >= 0.98 * pages.count()
    assert html.extract_text(rows.limit(0)).count() == 0


def brute_neighbours(vectors, every, k):
    ids = sorted(vectors)
    x = np.array([vectors[i] for i in ids], float)
    out = {}
    for i in (i for i in ids if i % every == 0):
        q = np.broadcast_to(np.array(vectors[i], float), x.shape)
        found = sorted((-s, j) for s, j in zip(ann.cosine(q, x), ids) if j != i)
        out[i] = [j for _, j in found[:k]]
    return out


def test_neighbours_reach_the_recall(spark):
    rng = np.random.default_rng(11)
    centres = rng.normal(size=(30, 32))
    x = np.concatenate([centres[rng.integers(30, size=2500)] + 0.4 * rng.normal(size=(2500, 32)), rng.normal(size=(500, 32))])
    x[100:400] = x[100]  # copies: ties go to the smaller id
    vectors = dict(enumerate(x.tolist()))
    rows = [(i, v, 1.0) for i, v in vectors.items()]
    odd = [(50_000, None), (50_050, [0.0] * 32), (50_100, [math.nan] * 32), (50_150, [None] + [1.0] * 31),
           (50_200, [math.inf] * 32), (50_250, [1.0, 2.0]), (None, [1.0] * 32)]
    frame = spark.createDataFrame([*rows, *[(*r, 1.0) for r in odd], rows[0]], "vec_id long, embedding array<double>, score double")
    got = {}
    for r in ann.nearest_neighbours(frame, sample_rows=600).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    want = brute_neighbours(vectors, 50, 5)
    assert got.keys() == want.keys() and all(len(v) == 5 for v in got.values())
    assert sum(len(set(got[i]) & set(w)) for i, w in want.items()) >= 0.95 * 5 * len(want)
    assert got[100] == want[100] == [101, 102, 103, 104, 105]


def test_lists_find_what_the_sample_does_not_hold(spark):
    """Default parameters, on a table eight times the sample and on an isotropic one."""
    rng = np.random.default_rng(12)
    centres = rng.normal(size=(40, 24))
    for x in (centres[rng.integers(40, size=4000)] + 0.4 * rng.normal(size=(4000, 24)), rng.normal(size=(2000, 24))):
        vectors = dict(enumerate(x.tolist()))
        frame = spark.createDataFrame([*vectors.items()], "vec_id long, embedding array<double>")
        got = {}
        for r in ann.nearest_neighbours(frame).collect():
            got.setdefault(r.query_id, set()).add(r.vec_id)
        want = brute_neighbours(vectors, 50, 5)
        assert sum(len(got[i] & set(w)) for i, w in want.items()) >= 0.95 * 5 * len(want)


def test_cosine_of_huge_and_tiny_vectors(spark):
    big, tiny, one = [1e200, 1e200], [5e-324, 5e-324], [1.0, 1.0]
    rows = [(0, one), (1, big), (2, tiny), (3, [1.7e308, -1.7e308]), (4, [1e-200, 2e-200])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r.vec_id, r.score) for r in ann.nearest_neighbours(frame).orderBy("rank").collect()]
    assert [v for v, _ in got] == [1, 2, 4, 3]
    assert np.allclose([s for _, s in got], [1, 1, 3 / 10**0.5, 0])


def test_few_vectors_and_none(spark):
    frame = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 2.0]), (2, [1.0, 1e-300])], "vec_id long, embedding array<double>")
    assert [(r.query_id, r.rank, r.vec_id) for r in ann.nearest_neighbours(frame).orderBy("rank").collect()] == [(0, 1, 2), (0, 2, 1)]
    assert ann.nearest_neighbours(frame.limit(0)).count() == 0


def test_pipeline_stages_take_effect(spark):
    docs = table(spark, SF, "documents")
    before = docs.count()
    counts = []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        counts.append(docs.count())
        if name != "mixing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        if name == "decontamination":
            with_secrets = secrets.find_secrets(docs).where("spans <> ''").count()
        if name == "secret_scan":
            assert with_secrets and docs.where("text LIKE '%[SECRET]%'").count() == with_secrets
    assert before >= counts[0] > counts[1] > counts[2] == counts[3] == counts[4] > before / 2
    assert docs.count() == corpus_pipeline.run(spark, SF).count()


def test_pipeline_on_an_empty_table(spark):
    docs = table(spark, SF, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0
