"""Operators 7, 8 and 9: links between texts and vectors, overlaps with a benchmark."""

import itertools
import math
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from leafmill.llm import decontamination, embedding_dedup, graph, jaccard_join
from leafmill.llm.storage import Scratch
from leafmill.llm.words import hashed, shingles, words
from tests.llm.conftest import make


def brute_classes(rows):
    sets = [frozenset(shingles(hashed(words(t))).tolist()) for _, t in rows]
    forest, links = jaccard_join.Forest(len(rows)), [0] * len(rows)
    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 9 * len(a & b) >= 4 * (len(a) + len(b)):
                links[i] += 1
                links[j] += 1
                forest.join(i, j)
    ids = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            ids[forest.find(i)] = min(key, ids.get(forest.find(i), key))
    return sorted((key or -1, ids.get(forest.find(i), -1), links[i]) for i, (key, _) in enumerate(rows))


@pytest.mark.parametrize("block", [2048, 3])
def test_jaccard_join_equals_brute_force(docs, corpus, block):
    got = jaccard_join.jaccard_classes(docs, block=block).collect()
    assert sorted((r.doc_id or -1, r.class_id or -1, r.n_links) for r in got) == brute_classes(corpus)


def test_jaccard_join_of_nothing(empty):
    assert jaccard_join.jaccard_classes(empty).count() == 0
    assert jaccard_join.one_of_each(empty).count() == 0


def test_one_of_each_group_stays(docs, corpus):
    kept = jaccard_join.one_of_each(docs)
    assert kept.columns == docs.columns
    classes = {c for _, c, _ in brute_classes([(i, t) for i, (_, t) in enumerate(corpus)])}
    assert kept.count() == len(classes)


def test_posterior_bounds_are_those_of_the_beta_distribution():
    least = jaccard_join.least_matches(Fraction(4, 5), 1e-6)
    rng = np.random.default_rng(0)
    for n, m in zip(jaccard_join.STEPS, least, strict=True):
        tail = [(rng.beta(k + 1, n - k + 1, 200_000) >= 0.8).mean() for k in (m - 1, m + 6)]
        assert tail[0] < 1e-4 and tail[1] < 0.2 and m < 0.8 * n


def test_intersections_equal_sets(monkeypatch):
    rng = random.Random(9)
    sets = [np.unique(np.array([rng.randrange(60) for _ in range(rng.randint(0, 50))], dtype=np.uint64)) for _ in range(25)]
    want = [[len(set(a.tolist()) & set(b.tolist())) for b in sets] for a in sets]
    for gathered in (1 << 20, 7):
        monkeypatch.setattr(jaccard_join, "GATHERED", gathered)
        members = jaccard_join.SharedMembers(sets)
        for i in range(25):
            others = np.array([j for j in range(25) if j != i])
            assert members.common(i, others).tolist() == [want[i][j] for j in others]
    assert jaccard_join.SharedMembers([]).weight.size == 0


def test_blocks_are_bounded_in_bytes(docs, corpus):
    got = jaccard_join.jaccard_classes(docs, block_bytes=4000).collect()
    assert sorted((r.doc_id or -1, r.class_id or -1, r.n_links) for r in got) == brute_classes(corpus)


def test_rows_without_an_id_keep_their_links(spark):
    words_ = [f"w{k}" for k in range(60)]
    near = [" ".join([*words_[:k], "changed", *words_[k + 1 :]]) for k in (1, 58)]
    rows = [(7, " ".join(words_)), (None, near[0]), (None, near[0]), (None, near[1]), (None, "a text apart from all the others")]
    got = sorted((r.n_links, r.class_id or -1, r.n_copies) for r in jaccard_join.jaccard_classes(make(spark, rows)).collect())
    assert got == [(0, -1, 1), (3, 7, 1), (3, 7, 1), (3, 7, 2), (3, 7, 2)]


@pytest.mark.parametrize("one_task", [0, 100, 200_000])
def test_components(spark, one_task, monkeypatch):
    monkeypatch.setattr(graph, "ONE_TASK", one_task)
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(1000, 1060)] + [(5, 5)]
    forest = jaccard_join.Forest(2000)
    for u, v in edges:
        forest.join(u, v)
    got = graph.components(spark.createDataFrame(edges, "u long, v long"), Scratch(spark, "test")).collect()
    assert sorted(map(tuple, got)) == sorted({(x, forest.find(x)) for e in edges if e[0] != e[1] for x in e})
    assert graph.components(spark.createDataFrame([], "u long, v long"), Scratch(spark, "test")).count() == 0
    named = graph.components(spark.createDataFrame([(f"n{u}", f"n{v}") for u, v in edges], "u string, v string"), Scratch(spark, "test")).collect()
    assert {r.component for r in named if r.node == "n1060"} == {"n1000"}


def test_labels_of_long_chains():
    rng = np.random.default_rng(6)
    order = rng.permutation(5000)
    assert (graph.labels(order[:-1], order[1:], 5000) == 0).all()
    left, right = rng.integers(0, 3000, 1500), rng.integers(0, 3000, 1500)
    forest = jaccard_join.Forest(3000)
    for u, v in zip(left.tolist(), right.tolist(), strict=True):
        forest.join(u, v)
    assert graph.labels(left, right, 3000).tolist() == [forest.find(k) for k in range(3000)]


def vectors():
    rng = np.random.default_rng(5)
    rows, key = [], 0
    for label in (0, 1, 2):
        base = rng.standard_normal((40, 16))
        for v in base:
            rows.append((key, v.tolist(), label))
            key += 1
            for _ in range(int(rng.integers(0, 4))):
                rows.append((key, (v + rng.standard_normal(16) * rng.choice([0.05, 0.2, 0.3])).tolist(), label))
                key += 1
    rows += [(key + k, rows[0][1], 0) for k in range(30)]  # hot copies
    key += 100
    odd = [None, [], [0.0] * 16, [float("nan")] + [1.0] * 15, [float("inf")] + [1.0] * 15, [None] + [1.0] * 15]
    rows += [(key + k, v, 0) for k, v in enumerate(odd)]
    rows += [(key + 10, rows[0][1], None), (key + 11, rows[0][1], 7), (key + 12, [x * 1e-200 for x in rows[0][1]], 0), (key + 13, rows[0][1][:8], 0), (key + 14, [-x for x in rows[0][1]], 0)]
    return rows


@pytest.mark.parametrize(("block", "cell_rows"), [(2048, 256), (8, 256), (2048, 3)])
def test_embedding_links_equal_brute_force(spark, block, cell_rows, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "CELL_ROWS", cell_rows)
    rows = vectors()
    df = spark.createDataFrame([(k, v, c, "x") for k, v, c in rows], "vec_id long, embedding array<double>, label int, node string")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.embedding_links(df, block=block).collect()}
    forest, links = jaccard_join.Forest(len(rows)), [0] * len(rows)

    def unit(v):
        if not v or None in v or not np.isfinite(v).all() or not np.any(v):
            return None
        v = np.array(v) / np.abs(v).max()
        return v / np.linalg.norm(v)

    units = [unit(v) for _, v, _ in rows]
    for i in range(len(rows)):
        for j in range(i):
            a, b = units[i], units[j]
            if rows[i][2] is not None and rows[i][2] == rows[j][2] and a is not None and b is not None and len(a) == len(b) and a @ b >= 0.98:
                links[i] += 1
                links[j] += 1
                forest.join(i, j)
    for i, (key, _, _) in enumerate(rows):
        home = rows[forest.find(i)][0]
        assert got[key] == (links[i], home, key == home), key


def test_embedding_links_of_nothing(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert embedding_dedup.embedding_links(df).count() == 0


def test_collision_count_is_calibrated():
    least, rng = embedding_dedup.required_count(), np.random.default_rng(1)
    q = np.zeros((1, embedding_dedup.PROJECTIONS))
    near = rng.standard_normal((2000, embedding_dedup.PROJECTIONS)) * 0.2  # pairs at the threshold
    i, _ = embedding_dedup.collisions(q, near, embedding_dedup.WIDTH * 0.2, least)
    far = rng.standard_normal((2000, embedding_dedup.PROJECTIONS)) * 1.4
    k, _ = embedding_dedup.collisions(q, far, embedding_dedup.WIDTH * 0.2, least)
    assert len(i) == 2000 and len(k) < 20


@pytest.mark.parametrize("largest", [300, 50_000, 20_000_000])
def test_pairs_at_the_threshold_share_a_cell(largest):
    rng = np.random.default_rng(8)
    x = rng.standard_normal((3000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    y = rng.standard_normal(x.shape)
    y -= (y * x).sum(1)[:, None] * x
    y = 0.98 * x + math.sqrt(1 - 0.98**2) * y / np.linalg.norm(y, axis=1)[:, None]
    radius = math.sqrt(0.04)
    width, grids = embedding_dedup.grids_for(largest, radius)
    a, b = (embedding_dedup.cells_of(v, width, grids, embedding_dedup.SIDE * radius) for v in (x, y))
    same = a == b
    assert same.any(axis=1).all()
    near = embedding_dedup.same_cell(embedding_dedup.SIDE) ** width
    assert abs(same.mean() - near) < 0.1 * near and (1 - near) ** grids <= embedding_dedup.PARTED
    other = (a == np.roll(a, 1, axis=0)).mean() * largest  # rows of other directions that a cell has
    assert other < 2 * embedding_dedup.CELL_ROWS


def test_collisions_equal_windows_written_out():
    rng = np.random.default_rng(2)
    q, base = rng.standard_normal((30, 12)), rng.standard_normal((41, 12))
    base[:5] = q[:5]
    for least in (1, 3, 12):
        want = (np.abs(q[:, None, :] - base[None, :, :]) <= 0.3).sum(axis=2) >= least
        i, j = embedding_dedup.collisions(q, base, 0.3, least)
        assert sorted(zip(i, j, strict=True)) == sorted(zip(*np.nonzero(want), strict=True))


def test_vectors_of_one_id_count_each(spark):
    v = [1.0, 2.0, 3.0]
    df = spark.createDataFrame([(1, v, 0), (1, v, 0), (1, [-1.0, 2.0, 3.0], 0), (2, v, 0)], "vec_id long, embedding array<double>, label int")
    got = sorted(tuple(r) for r in embedding_dedup.embedding_links(df).collect())
    assert got == [(1, 0, 1, True), (1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False)]


def bench(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def spoil(text, places):
    w = text.split()
    for p in places:
        w[p] = "spoilt"
    return " ".join(w)


def test_planted_passages_are_found_and_others_are_not(spark):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    item = [" ".join(word() for _ in range(30)) for _ in range(6)]
    around = lambda t: " ".join([word(), word(), t, word()])
    rows = [
        (1, around(item[0])), (2, around(" ".join(item[1].split()[5:19]))), (3, around(spoil(item[2], [4, 15, 23]))),
        (4, around(" ".join(item[3].split()[:8]))), (5, around(spoil(item[4], range(0, 30, 2)))), (6, None), (7, ""), (8, item[0] + " " + item[5]), (9, "a short item"), (10, around("five words of one item")),
    ]
    df = make(spark, rows)
    items = bench(spark, [*enumerate(item), (90, None), (91, "short item"), (92, "five words of one item"), (93, item[0])])
    got = {r.doc_id: r for r in decontamination.contamination(df, items).collect()}
    assert {k: v.item_ids for k, v in got.items()} == {1: [0, 93], 2: [1], 3: [2], 4: [], 5: [], 6: [], 7: [], 8: [0, 5, 93], 9: [], 10: [92]}
    assert (got[3].overlap_words, got[3].equal_words) == (30, 27)
    kept = decontamination.uncontaminated(df, items)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {4, 5, 6, 7, 9}
    assert decontamination.contamination(df, bench(spark, [])).where("contaminated").count() == 0


def evading(masks, n):
    """Least number of n words to substitute so that no mask finds equal words only."""
    span = max(map(len, masks))
    least = {(): 0}  # by the last span words, True for equal ones
    for _ in range(n):
        grown = {}
        for last, cost in least.items():
            for same in (True, False):
                now = (*last, same)[-span:]
                if not any(len(m) <= len(now) and all(x for x, c in zip(now[-len(m) :], m, strict=True) if c == "1") for m in masks):
                    grown[now] = min(cost + (not same), grown.get(now, n))
        least = grown
    return min(least.values())


def test_masks_hit_every_overlap_that_counts():
    # Longer stretches fall into parts of 13 to 25 words, of which one has a fifth of its words substituted at most.
    assert all(evading(decontamination.MASKS, n) > n // 5 for n in range(decontamination.MIN_WORDS, 2 * decontamination.MIN_WORDS))
    assert all(evading(decontamination.SHORT_MASKS, n) > n // 5 for n in range(decontamination.SHORTEST, decontamination.MIN_WORDS))


@pytest.mark.parametrize("n", [5, 9, 10, 12, 13, 15, 16, 20])
def test_every_placement_of_substitutions_is_found(n):
    item = [f"w{k}" for k in range(n)]
    index = decontamination.Index.build([(1, " ".join(item))])
    for places in itertools.combinations(range(1, n - 1), n // 5):
        text = spoil(" ".join(item), places)
        assert index.overlaps(hashed(words("before " + text + " after"))) == [(1, 1, n, n - n // 5)], places


def brute_overlap(h, w):
    """(words, equal words) of the longest overlap on any diagonal, by all starts and ends."""
    least, best = min(decontamination.MIN_WORDS, len(w)), (0, 0)
    for shift in range(-len(w) + 1, len(h)):
        a, b = max(0, shift), min(len(h), shift + len(w))
        same = [h[p] == w[p - shift] for p in range(a, b)]
        for x in range(len(same)):
            for e in range(x, len(same)):
                n, equal = e - x + 1, sum(same[x : e + 1])
                if same[x] and same[e] and n >= least and 5 * equal >= 4 * n:
                    best = max(best, (n, equal))
    return best


@pytest.mark.parametrize("sent", [2_000_000, 10])
def test_contamination_equals_a_scan_of_all_diagonals(spark, sent, monkeypatch):
    monkeypatch.setattr(decontamination, "BROADCAST_SEEDS", sent)
    monkeypatch.setattr(decontamination, "LOT", 50)
    rng = random.Random(21)
    pool = [f"w{k}" for k in range(40)]
    items = [[rng.choice(pool) for _ in range(n)] for n in (5, 8, 13, 20, 31)] + [["a"] * 16, ["a", "b"] * 9, ["of"] * 4]
    texts = []
    for k in range(60):
        w = list(rng.choice(items))
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(len(w))] = rng.choice(pool)
        texts.append([rng.choice(pool) for _ in range(rng.randint(0, 8))] + w[rng.randint(0, 3) :] + [rng.choice(pool) for _ in range(rng.randint(0, 8))])
    texts += [["a"] * 40, ["a", "b"] * 20, [], ["w1"], texts[0], texts[0]]
    df = make(spark, [(k, " ".join(t)) for k, t in enumerate(texts)] + [(500, None)])
    got = {r.doc_id: (r.item_ids, r.overlap_words, r.equal_words) for r in decontamination.contamination(df, bench(spark, [(k, " ".join(w)) for k, w in enumerate(items)])).collect()}
    assert got.pop(500) == ([], 0, 0) and len(got) == len(texts)
    for k, t in enumerate(texts):
        found = {i: brute_overlap(t, w) for i, w in enumerate(items) if len(w) >= decontamination.SHORTEST}
        hit = sorted(i for i, (n, _) in found.items() if n)
        assert got[k] == (hit, *max([found[i] for i in hit], default=(0, 0))), t


def test_a_large_benchmark_gives_the_same_by_joins(spark, docs, corpus, monkeypatch):
    items = bench(spark, [(k, r.text) for k, r in enumerate(docs.where(F.col("doc_id").between(100, 104)).select("text").collect())])
    want = sorted(map(str, decontamination.contamination(docs, items, ["doc_id", "node", "_row"]).collect()))
    kept = sorted(map(str, decontamination.uncontaminated(docs, items).collect()))
    assert 0 < len(kept) < len(want) == len(corpus)
    monkeypatch.setattr(decontamination, "BROADCAST_SEEDS", 10)
    monkeypatch.setattr(decontamination, "SIEVE_BITS", 16)
    assert sorted(map(str, decontamination.contamination(docs, items, ["doc_id", "node", "_row"]).collect())) == want
    assert sorted(map(str, decontamination.uncontaminated(docs, items).collect())) == kept


def test_names_that_are_used_inside_may_be_kept(spark):
    df = make(spark, [(1, "five words of one item")]).selectExpr("doc_id as found", "text", "uid as _k0", "node as a", "label as item_id")
    row = decontamination.contamination(df, bench(spark, [(92, "five words of one item")]), ["found", "_k0", "a", "item_id"]).first()
    assert row.asDict() == {"found": 1, "_k0": 1, "a": "y", "item_id": "z", "contaminated": True, "item_ids": [92], "overlap_words": 5, "equal_words": 5}


def test_overlaps_equal_an_exhaustive_search():
    rng = random.Random(7)
    for _ in range(60):
        same = np.array([rng.random() < 0.75 for _ in range(rng.randint(2, 30))])
        where = [rng.randrange(len(same))]
        best = 0
        for a in range(len(same)):
            for e in range(a, len(same)):
                n = e - a + 1
                if same[a] and same[e] and n >= 5 and same[a : e + 1].sum() >= 0.8 * n and a <= where[0] <= e:
                    best = max(best, n)
        found = decontamination.longest(same, 5, where)
        assert (found[1] if found else 0) == best


def test_decontamination_of_nothing(spark, empty, monkeypatch):
    items = bench(spark, [(1, "a b c d e f")])
    assert decontamination.contamination(empty, items).count() == 0
    assert decontamination.uncontaminated(empty, items).count() == 0
    monkeypatch.setattr(decontamination, "BROADCAST_SEEDS", 0)
    assert decontamination.contamination(empty, items).count() == 0
    assert decontamination.uncontaminated(empty, items).count() == 0
