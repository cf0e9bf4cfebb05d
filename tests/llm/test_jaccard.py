"""Operator 13 against all pairs, and what its index promises."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from demandlens.llm import jaccard


def shingles(text, k):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in low.translate(dict.fromkeys(map(ord, "\t\n\x0b\x0c\r"), " ")).split(" ") if w]
    return {" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def all_pairs(rows, k=3, num=9, den=10):
    found = [shingles(t, k) for _, t in rows]
    root = list(range(len(rows)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(found):
        for j in range(i):
            b = found[j]
            if a and b and den * len(a & b) >= num * len(a | b) and top(i) != top(j):
                root[max(top(i), top(j))] = min(top(i), top(j))
    least: dict = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[top(i)] = min(d, least.get(top(i), d))
    return sorted(((d, len(found[i]), least.get(top(i))) for i, (d, _) in enumerate(rows)), key=repr)


def edited(seed, texts, copies):
    """Texts with chains of copies, each with a few words replaced, dropped or added, around the similarity asked for."""
    rng = random.Random(seed)
    out = []
    for n in texts:
        words = [f"w{rng.randrange(4000)}" for _ in range(n)]
        for _ in range(copies):
            out.append((len(out), " ".join(words)))
            words = list(words)
            for _ in range(rng.choice([0, 1, 1, 2, max(1, n // 70), max(1, n // 50)])):
                at = rng.randrange(max(1, len(words)))
                words[at : at + 1] = rng.choice([[], [f"v{rng.randrange(4000)}"], [*words[at : at + 1], "new"]])
    rng.shuffle(out)
    return out


def found(frame):
    return sorted((tuple(r) for r in frame.collect()), key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_all_pairs(spark, seed):
    rows = edited(seed, [3, 9, 11, 12, 17, 20, 28, 40, 60, 61, 100, 150, 300, 700], 12)
    assert found(jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(6))) == all_pairs(rows)


def test_other_thresholds(spark):
    rows = edited(7, [5, 8, 16, 30, 80, 200], 8)
    got = found(jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 2, 7, 10))
    assert got == all_pairs(rows, 2, 7, 10)


def test_a_dense_group_without_links(spark):
    """A node of many alike sets of which few link: pages leave out what boxes and minima forbid, and lose nothing."""
    rng = random.Random(11)
    common = " ".join(f"c{i}" for i in range(60))
    rows = [(i, common + " " + " ".join(f"x{rng.randrange(10**6)}" for _ in range(12))) for i in range(300)]
    rows += [(1000 + i, rows[i][1] + " tail") for i in range(0, 300, 7)]
    assert found(jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"))) == all_pairs(rows)


def test_linked_sets_meet_in_a_node_and_within_the_bound():
    rng = np.random.default_rng(5)
    classes = jaccard.Classes(9, 10)
    met = 0
    for _ in range(3000):
        n = int(rng.integers(9, 400))
        a = rng.integers(0, 2**63, n, dtype=np.uint64)
        drop, add = rng.integers(0, n // 9 + 1, 2)
        b = np.unique(np.concatenate([a[drop:], rng.integers(0, 2**63, add, dtype=np.uint64)]))
        a = np.unique(a)
        common = len(np.intersect1d(a, b))
        minima = int(np.minimum(jaccard.point(a), jaccard.point(b)).sum())
        odd = int(np.bitwise_count((jaccard.parities(a) ^ jaccard.parities(b)).view(np.uint64)).sum())
        assert minima >= common and len(a) + len(b) - odd >= 2 * common
        if 10 * common >= 9 * (len(a) + len(b) - common) and len(a) != common:
            met += 1
            assert set(jaccard.nodes(a, classes)) & set(jaccard.nodes(b, classes))
    assert met > 500


def test_pages_cover_and_bound_their_points(spark):
    rows = [(i % 3, i, 5 + i % 4, i, i * 7 % 50, [(i * d) % 3 for d in range(jaccard.DIMS)], [i] * (jaccard.FINE // 64)) for i in range(400)]
    filed = spark.createDataFrame(rows, "key long, node long, n long, label long, place long, point array<int>, fine array<long>")
    got = jaccard.pages(filed).collect()
    assert sorted(x for p in got for x in p["node"]) == list(range(400))
    for p in got:
        points = np.array(p["point"]).reshape(-1, jaccard.COARSE, jaccard.DIMS // jaccard.COARSE).sum(axis=2)
        assert len(p["node"]) <= jaccard.PAGE and (points.min(axis=0) == p["low"]).all() and (points.max(axis=0) == p["high"]).all()


def test_edges(spark, docs, no_docs):
    assert jaccard.jaccard_components(no_docs).count() == 0
    pairs = [(r["doc_id"], r["text"]) for r in docs.collect()]
    want = [(d, n, d if n == 0 else c) for d, n, c in all_pairs(pairs)]
    assert found(jaccard.jaccard_components(docs)) == sorted(want, key=repr)


def test_rows_without_an_id_link_others(spark):
    words = [f"w{i}" for i in range(100)]
    step = lambda *gone: " ".join(w for i, w in enumerate(words) if i not in gone)
    rows = [(5, step()), (None, step(99, 98, 97)), (3, step(99, 98, 97, 0, 1, 2, 3, 4, 5, 6, 7)), (None, "alone " * 3)]
    got = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").withColumn("node", F.lit(1)))
    assert found(got) == all_pairs(rows)
