"""Greedy two-key deduplication against a scan in order, and the rounds that chains take."""

import random

import pytest

from demandlens.operators import merges

SCHEMA = "source string, ord long, exact string, finger string, note int"


def scan(rows):
    kept, taken = [], set()
    for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1])):
        keys = {(r[0], k, v) for k, v in (("e", r[2]), ("f", r[3])) if v is not None}
        if not keys & taken:
            taken |= keys
            kept.append(r)
    return sorted(kept, key=repr)


def run(spark, rows):
    return sorted((tuple(r) for r in merges.greedy_dedupe(spark.createDataFrame(rows, SCHEMA)).collect()), key=repr)


@pytest.mark.parametrize("seed", range(4))
def test_equals_a_scan(spark, seed):
    rng = random.Random(seed)
    size = rng.choice([5, 12, 40])
    value = lambda p: None if rng.random() < 0.15 else f"{p}{rng.randrange(size)}"
    rows = [(rng.choice(["a", "b", None]), i, value("e"), value("f"), i) for i in range(120)]
    assert run(spark, rows) == scan(rows)


@pytest.mark.parametrize("n", [16, 300])
def test_chains_take_few_rounds(spark, monkeypatch, n):
    """Each row shares one key with the row before, another with the next."""
    rows = [("s", i, f"e{i // 2}", f"f{(i + 1) // 2}", i) for i in range(n)]
    cuts = []
    plain = merges.cut_lineage
    monkeypatch.setattr(merges, "cut_lineage", lambda df: cuts.append(1) or plain(df))
    assert run(spark, rows) == scan(rows)
    assert len(cuts) <= 8 + n.bit_length()


def test_one_key_of_many_rows_and_none(spark):
    rows = [("s", i, "same", f"f{i}", i) for i in range(500)]
    assert run(spark, rows) == [("s", 0, "same", "f0", 0)]
    assert run(spark, []) == []
