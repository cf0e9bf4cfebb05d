"""Operator 12 against a plain computation, and its edge cases."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np

from demandlens.llm import resample

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def features(text, longest):
    words = WORDS.findall(lower(text))
    return len(words), [" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]


def plain(docs, target, percent, least, longest, buckets):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    found = [(d, *features(t, longest)) for d, t in docs]
    s = Counter(bucket(f) for _, _, fs in found for f in fs)
    t = Counter(bucket(f) for x in target for f in features(x, longest)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in range(buckets)]
    rows = []
    for d, n, fs in found:
        weight = sum(gain[bucket(f)] for f in fs) // len(fs) if fs else 0
        h = int(hashlib.sha256(f"2024:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        rows.append((d, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n))
    able = sorted((r for r in rows if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    ranks = {}
    for k, r in enumerate(able[: len(able) * percent // 100]):
        ranks.setdefault(r[:4], []).append(k + 1)
    return sorted(((*r[:4], (ranks.get(r[:4]) or [None]).pop(0) if ranks.get(r[:4]) else None) for r in rows), key=repr)


def test_equals_a_plain_computation(spark, docs):
    pairs = [(r["doc_id"], r["text"]) for r in docs.collect()]
    target = ["The quick brown fox", None, "", "FLUSS hund am 12345"]
    items = spark.createDataFrame([(k, t) for k, t in enumerate(target)], "item_id long, text string")
    for percent, least, longest, buckets in ((50, 1, 1, 10_000), (34, 0, 3, 7), (100, 2, 2, 100), (10, 10**6, 1, 50)):
        got = resample.resample(docs, items, percent, least, longest, buckets)
        assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
        assert sorted(map(tuple, got.collect()), key=repr) == plain(pairs, target, percent, least, longest, buckets)


def test_blocks_hold_the_whole_matrix(spark, docs, monkeypatch):
    monkeypatch.setattr(resample, "BLOCK_ROWS", 2)
    blocks = resample.count_matrix(docs, 1, 97).collect()
    got = []
    for b in blocks:
        assert len(b["doc_ids"]) + 1 == len(b["indptr"]) and b["indptr"][-1] == len(b["buckets"]) == len(b["counts"])
        for k, d in enumerate(b["doc_ids"]):
            at = slice(b["indptr"][k], b["indptr"][k + 1])
            got.append((d, b["words"][k], dict(zip(b["buckets"][at], b["counts"][at], strict=True))))
    want = [(r["doc_id"], features(r["text"], 1)[0], dict(Counter(zlib.crc32(f.encode()) % 97 for f in features(r["text"], 1)[1]))) for r in docs.collect()]
    assert sorted(got, key=repr) == sorted(([d, n, c] and (d, n, dict(sorted(c.items()))) for d, n, c in want), key=repr)
    assert int(np.max([len(b["doc_ids"]) for b in blocks])) <= 1024


def test_blocks_stay_small(spark):
    """Readers hold blocks by their number, so a block holds few entries beyond those of one document."""
    texts = spark.range(60).selectExpr("id AS doc_id", "array_join(transform(sequence(1, 400), x -> concat('w', x + id)), ' ') AS text").coalesce(1)
    matrix = resample.count_matrix(texts, 1, 10_000)
    assert matrix.selectExpr("max(size(buckets))").first()[0] <= 1400
    assert matrix.selectExpr("sum(size(doc_ids))").first()[0] == 60
    got = resample.weights(matrix, np.arange(10_000)).collect()
    for r in got:
        at = [zlib.crc32(f"w{x + r.doc_id}".encode()) % 10_000 for x in range(1, 401)]
        assert (r.words, r.n_features, r.weight) == (400, 400, sum(at) // 400)


def test_edges(spark, docs, no_docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert resample.resample(no_docs, none).count() == 0
    uniform = resample.resample(docs, none, 100, 1)
    assert uniform.where("rank IS NOT NULL").count() == docs.where("regexp_count(lower(text), '[0-9a-z]+') > 0").count()
    ranks = [r["rank"] for r in uniform.where("rank IS NOT NULL").orderBy("rank").collect()]
    assert ranks == list(range(1, len(ranks) + 1))
