"""Operators 1 and 10: models fitted on labelled rows."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np

from leafmill.llm import language, quality, sampling
from tests.llm.conftest import make


def samples(n=400):
    rng = random.Random(6)
    good = [" ".join("".join(rng.choice("aeioulnrst") for _ in range(5)) for _ in range(40)) for _ in range(n)]
    bad = [" ".join("".join(rng.choice("aeioulnrst") for _ in range(5)) + rng.choice(["###", "!!!"]) for _ in range(40)) for _ in range(n // 4)]
    return [(k, t, 1) for k, t in enumerate(good)] + [(10_000 + k, t, 0) for k, t in enumerate(bad)]


def test_quality_on_held_out_rows(spark):
    rows = samples()
    docs = make(spark, [(k, t) for k, t, _ in rows])
    labels = spark.createDataFrame([(k, q) for k, _, q in rows] + [(None, 1), (3, None), (77_777, 0)], "doc_id long, quality int")
    weights = quality.fit(docs, quality.learning_labels(labels))
    score = {r.doc_id: r.score for r in quality.score(docs, weights).collect()}
    held = [(score[k], q) for k, _, q in rows if zlib.crc32(str(k).encode()) % 5 == 0]
    assert all((s >= 0.3) == bool(q) for s, q in held) and any(q == 0 for _, q in held)
    index, values = quality.features(rows[0][1])
    assert abs(score[0] - 1 / (1 + np.exp(-sum(weights[i] * v for i, v in zip(index, values, strict=True))))) < 1e-12


def test_quality_never_learns_from_held_out_labels(spark):
    rows = samples(60)
    docs = make(spark, [(k, t) for k, t, _ in rows])
    right = spark.createDataFrame([(k, q) for k, _, q in rows], "doc_id long, quality int")
    wrong = spark.createDataFrame([(k, 1 - q if zlib.crc32(str(k).encode()) % 5 == 0 else q) for k, _, q in rows], "doc_id long, quality int")
    assert np.array_equal(quality.fit(docs, quality.learning_labels(right)), quality.fit(docs, quality.learning_labels(wrong)))


def test_quality_of_every_kind_of_row(spark, docs, corpus, empty):
    none = spark.createDataFrame([], "doc_id long, quality int")
    weights = quality.fit(docs, none)
    assert {r.score for r in quality.score(docs, weights).collect()} == {0.5}
    one = quality.fit(docs, spark.createDataFrame([(100, 1), (101, 1)], "doc_id long, quality int"))
    got = quality.score(docs, one).collect()
    assert len(got) == len(corpus) and all(r.score == got[0].score > 0.5 for r in got)
    assert quality.score(empty, weights).count() == 0
    kept = quality.keep_good(docs, weights)
    assert kept.columns == docs.columns and kept.count() == len(corpus)
    assert quality.keep_good(docs, np.where(np.arange(len(weights)) == 0, -5.0, 0)).count() == 0


def plain_follower(rows, alpha=2.0, beta=1.0, l1=0.02, l2=0.05):
    """Proximal follow-the-regularised-leader, coordinate by coordinate, on (dict of values, label) rows in order."""
    z, n = {}, {}

    def weight(i):
        if abs(z.get(i, 0.0)) <= l1:
            return 0.0
        sign = 1 if z[i] > 0 else -1
        return -(z[i] - sign * l1) / ((beta + math.sqrt(n[i])) / alpha + l2)

    for x, label in rows:
        w = {i: weight(i) for i in x}
        p = 1 / (1 + math.exp(-sum(w[i] * v for i, v in x.items())))
        for i, v in x.items():
            g = (p - label) * v
            sigma = (math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))) / alpha
            z[i] = z.get(i, 0.0) + g - sigma * w[i]
            n[i] = n.get(i, 0.0) + g * g
    return {i: weight(i) for i in z}


def plain_features(text):
    """Root counts of words and of pairs of words by their strings, a repeat written '='; scaled to one, with an intercept."""
    tokens = re.findall(r"\w+|[^\w\s]+", text)
    tokens = [t if k == 0 or t != tokens[k - 1] else "=" for k, t in enumerate(tokens)]
    count = Counter(tokens) + Counter(zip(tokens, tokens[1:], strict=False))
    total = sum(count.values())
    return {k: math.sqrt(c / total) for k, c in count.items()} | {"": 1.0}


def test_weights_equal_a_plain_follower():
    texts = [("a b a b c", 1), ("a a a a", 0), ("b c d e", 1), ("z !! z !! z", 0), ("c d e a", 1), ("z z z", 0)]
    got = quality.train([(*quality.features(t), y) for t, y in texts], updates=24)
    order, epochs = np.random.default_rng(11), 4
    rows = [(plain_features(t), y) for t, y in texts]
    want = plain_follower([rows[k] for _ in range(epochs) for k in order.permutation(len(rows))])
    for text in [t for t, _ in texts] + ["a b !! q"]:
        index, values = quality.features(text)
        x = plain_features(text)
        assert len(index) == len(x)
        assert abs(got[index] @ values - sum(want.get(i, 0.0) * v for i, v in x.items())) < 1e-9


def test_the_sample_is_bounded_and_rows_keep_their_labels(spark):
    rows = [(5, f"der die und {k}" if k % 2 else f"the of and {k}", "de" if k % 2 else "en") for k in range(400)] + [(None, "ohne id", "de")] * 3
    own = sampling.fit_own_rows(make(spark, rows), "lang", 100, "doc_id", "text").collect()
    assert len(own) == 100 and all((r.lang == "de") == r.text.startswith(("der", "ohne")) for r in own)
    labels = spark.createDataFrame([(5, q) for q in (0, 1)] * 200, "doc_id long, quality int")
    other = sampling.fit_rows(make(spark, rows), labels, "quality", 100, "doc_id", "text").collect()
    assert sorted(r.quality for r in other) == [0, 1] and len({r.text for r in other}) == 1
    few = sampling.fit_own_rows(make(spark, [(k, "x", "en") for k in range(50)] * 4), "lang", 20, "doc_id", "text")
    assert few.count() == 20


SPEECH = {"en": "the of and with this from house", "de": "der die und mit für über straße", "fr": "le la les avec été où forêt"}


def spoken(n=150):
    rng = random.Random(1)
    return [(k * 10 + j, " ".join(rng.choice(SPEECH[lang].split()) for _ in range(12)), lang) for k in range(n) for j, lang in enumerate(SPEECH)]


def test_language_on_held_out_rows(spark):
    rows = spoken()
    docs = make(spark, rows)
    learn = docs.where(language.crc_rest("doc_id", 4) != 2)
    names, matrix = language.fit(docs, learn.select("doc_id", "lang"))
    assert names == ["de", "en", "fr"]
    got = {r.doc_id: r for r in language.predict(docs, names, matrix).collect()}
    assert all(got[k].lang_pred == lang and 0 <= got[k].score <= 1 for k, _, lang in rows if zlib.crc32(str(k).encode()) % 4 == 2)


def test_presence_is_the_set_of_grams():
    assert language.presence(None) is None and language.presence("12 !") is None
    assert np.array_equal(language.presence("Ab, ab"), language.presence("ab  ab"))
    assert not np.array_equal(language.presence("abc"), language.presence("abd"))


def test_scores_equal_the_kernel_machine_written_out():
    masks = np.stack([language.presence(t) for _, t, _ in spoken(20)])
    labels = [lang for _, _, lang in spoken(20)]
    names, matrix = language.solve(masks, labels)
    m = min(language.LANDMARKS, len(masks))
    kernel = lambda a, b: (a.astype(float) @ b.T.astype(float)) / np.sqrt(a.sum(1, dtype=float))[:, None] / np.sqrt(b.sum(1, dtype=float))[None, :]
    km, kn = kernel(masks[:m], masks[:m]), kernel(masks, masks[:m])
    val, vec = np.linalg.eigh(km)
    keep = val > 1e-8 * val.max()
    phi = kn @ (vec[:, keep] / np.sqrt(val[keep]))
    for c, name in enumerate(names):
        y = np.where(np.array(labels) == name, 1.0, -1.0)
        w = np.where(y > 0, 0.5 / (y > 0).sum(), 0.5 / (y < 0).sum())
        beta = np.linalg.solve((phi.T * w) @ phi + language.RIDGE * np.eye(phi.shape[1]), (phi.T * w) @ y)
        assert np.allclose(phi @ beta, masks.astype(float) @ matrix[:, c] / np.sqrt(masks.sum(1)), atol=1e-5)


def test_language_of_every_kind_of_row(spark, docs, corpus, empty):
    names, matrix = language.fit(docs, docs.select("doc_id", "lang").where("false"))
    got = language.predict(docs, names, matrix).collect()
    assert len(got) == len(corpus) and {r.lang_pred for r in got} == {"und"}
    names, matrix = language.fit(docs, docs.select("doc_id", "lang"))
    pairs = {(r.doc_id, r.lang_pred) for r in language.predict(docs, names, matrix).collect()}
    assert {(1, "und"), (2, "und"), (3, "und"), (4, "en"), (9, "en")} <= pairs
    assert language.predict(empty, names, matrix).count() == 0
