import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from demandlens.llm import chat, decontam, lm
from tests.llm.conftest import TEXTS
from tests.llm.near_copies import kept_ids

DATA = "/root/testdata/sf0.001"

# --- operator 5


def cut(text, k):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", (text or "").lower()) if w]
    return words, [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)]


def reference_matches(docs, items, least=0.8):
    """Every window of every document against every item."""
    found = {}
    for item_id, item in items:
        words, _ = cut(item, 5)
        if not words:
            continue
        k = min(5, len(words))
        want = Counter(cut(item, k)[1])
        for doc_id, text in docs:
            _, s = cut(text, k)
            if not want.keys() & set(s):
                continue
            length = min(sum(want.values()), len(s))
            for at in range(len(s) - length + 1) if length else ():
                have = Counter(s[at : at + length])
                shared = sum((have & want).values())
                similarity = shared / (length + sum(want.values()) - shared)
                if similarity >= least and similarity > found.get((doc_id, item_id), (0, 0))[0]:
                    found[doc_id, item_id] = (similarity, at)
    return found


def test_matches_equal_brute_force(spark):
    rng = random.Random(5)
    words = [f"w{k}" for k in range(400)]
    items = [(k, " ".join(rng.choices(words, k=n))) for k, n in enumerate([30, 40, 55, 12, 9, 4, 1, 5])]
    items[6] = (6, "unheardof")
    items += [(8, ""), (9, None), (10, "a b a b a b a b a b")]
    docs = []
    for k in range(60):
        body = rng.choices(words, k=rng.randint(0, 120))
        item = (rng.choice(items)[1] or "").upper().split()
        if item and k % 2:
            item[rng.randrange(len(item))] = rng.choice(["zz", item[0]])
        if item and k % 5 == 0 and len(item) > 6:
            del item[rng.randrange(len(item))]
        at = rng.randint(0, len(body))
        docs.append((k, " ".join(body[:at] + item + body[at:])))
    docs += [(100, None), (101, ""), (None, items[0][1]), (102, items[1][1] + "\n" + items[1][1]), (103, "a b a b a b a"), (104, " ".join(items[2][1].split()[:48]))]
    made = spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id long, text string, key int").repartition(4)
    made = made.unionByName(made.where("doc_id = 102"))
    got = {(r["doc_id"], r["item_id"]): (r["similarity"], r["start"]) for r in decontam.matches(made, spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = reference_matches(docs, items)
    assert got.keys() == want.keys() and len(want) > 20
    for k, (similarity, at) in want.items():
        assert got[k] == (pytest.approx(similarity), at), k
    kept = decontam.without_matches(made, spark.createDataFrame(items, "item_id long, text string"))
    assert {r["doc_id"] for r in kept.collect()} == {d for d, _ in docs} - {d for d, _ in want} and kept.columns == made.columns


def test_matches_of_distant_fingerprints(spark):
    """Similarity 12 / 14 of texts whose fingerprints differ in over 20 bits: the shingle that differs decides many of them."""
    items = [(k, "a b " * 8 + f"z{k}") for k in range(400)]
    docs = [(0, "before " + "a b " * 8 + "y after")]  # the windows at 0 and 1 are equally alike
    got = decontam.matches(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {r["item_id"] for r in got} == set(range(400)) and max(r["bits"] for r in got) > 20
    assert all(r["similarity"] == pytest.approx(12 / 14) and r["start"] == 0 for r in got)


def test_match_of_a_very_long_item(spark):
    """80,000 words of which most repeat; a tenth of the windows around the best are alike too."""
    rng = random.Random(80)
    item = ["same"] * 30_000 + rng.choices([f"v{k}" for k in range(5000)], k=20_000) + ["again"] * 30_000
    text = rng.choices("abcdefg", k=500) + item[:40_000] + ["other"] + item[40_001:] + rng.choices("abcdefg", k=300)
    docs = spark.createDataFrame([(1, " ".join(text)), (2, "same " * 50_000)], "doc_id long, text string")
    (got,) = decontam.matches(docs, spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")).collect()
    have, want = Counter(cut(" ".join(text[500:80_500]), 5)[1]), Counter(cut(" ".join(item), 5)[1])
    shared = sum((have & want).values())
    assert (got["doc_id"], got["start"], got["n_words"]) == (1, 500, 80_000) and got["similarity"] == pytest.approx(shared / (2 * 79_996 - shared))


def test_matches_without_items_or_documents(spark, docs, no_docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontam.matches(docs, none).count() == 0
    assert decontam.matches(no_docs, spark.createDataFrame([(1, "a b c d e f g")], "item_id long, text string")).count() == 0


# --- operator 6


def test_lm_scores_equal_their_definition(spark, docs, no_docs):
    from demandlens.session import table

    for made in (table(spark, DATA, "documents").select("doc_id", "text"), docs.select("doc_id", "text")):
        rows = [(r["doc_id"], r["text"] or "") for r in made.collect()]
        out = lambda d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2
        seen = Counter()
        for d, t in rows:
            if not out(d):
                seen.update([*t.encode().lower().split(), None])
        n, v = sum(seen.values()), len(seen)
        got = lm.score_documents(made, own=30, endings=8, vectors=40, known_words=50, rounds=1, shard_rows=500).collect()
        assert len(got) == len(rows)
        want = {}
        for d, t in rows:
            tokens = [*t.encode().lower().split(), None]
            base = sum(math.log10((seen[w] + 1) / (n + v + 1)) for w in tokens)
            want[d] = (out(d), len(tokens), sum(seen[w] > 0 for w in tokens), n, base)
        for r in got:
            w = want[r["doc_id"]]
            assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == w[:4]
            assert r["base_score"] == pytest.approx(w[4], rel=1e-9) and -math.inf < r["score"] < 0
    assert lm.score_documents(no_docs).count() == 0


def test_scores_equal_brute_force(spark):
    """Every token's probability by the model's formula, worked out word by word over all classes."""
    rng = random.Random(4)
    rows = [(k, " ".join(rng.choices(["the", "cat", "sat", "on", "Mats.", "xyz", "running", "sitting", f"w{k}ing"], k=rng.randint(0, 9)))) for k in range(80)]
    made = spark.createDataFrame(rows, "doc_id long, text string")
    training = [(d, t) for d, t in rows if zlib.crc32(str(d).encode()) % 7 != 2]
    counts = lm.stored(lm.word_counts(made.where(~lm.held_out(F.col("doc_id")))), "counts")
    vocab = lm.vocabulary(counts, len(training), own=3, endings=4, vectors=5, known_words=7)
    seen = Counter(w for _, t in training for w in t.lower().encode().split())
    assert vocab.n == sum(seen.values()) + len(training) and vocab.v == len(seen) + 1
    sent = spark.sparkContext.broadcast(vocab)
    found = lm.stored(lm.ngrams(made.where(~lm.held_out(F.col("doc_id"))), sent, (vocab.n_contexts, vocab.n_classes)), "ngrams")
    model = lm.train(found, vocab, 1, 50)
    order = sorted(seen, key=lambda w: (-seen[w], w))
    ids = {w: k + 1 for k, w in enumerate(order) if k < len(vocab.ids)}
    ends = Counter()
    for w in order[3:]:
        ends[w[-2:]] += seen[w]
    for w in order[:3]:
        ends[w[-2:]] += 0
    named = sorted(ends, key=lambda e: (-ends[e], e))[:3]
    end = lambda w: named.index(w[-2:]) if w[-2:] in named else 3
    klass = lambda w: 0 if w is None else ids[w] if ids.get(w, 9) <= 3 else 4 + end(w)
    one_before = lambda w: 0 if w is None else ids[w] if ids.get(w, 9) <= 5 else 6 + end(w)
    two_before = lambda w: klass(w) if klass(w) <= 3 else klass(w) - 4 + 6
    grams = Counter()
    for _, t in training:
        tokens = [None, None, *t.lower().encode().split(), None]
        for a, b, c in zip(tokens, tokens[1:], tokens[2:], strict=False):
            grams[(two_before(a) * vocab.n_contexts + one_before(b)) * vocab.n_classes + klass(c)] += 1
    assert grams == {r["code"]: r["n"] for r in found.collect()}
    of_class, types = Counter(), Counter()
    for w, c in seen.items():
        of_class[klass(w)] += c
        types[klass(w)] += 1
    got = {r["doc_id"]: r["score"] for r in lm.score(made, counts, vocab, model).collect()}
    for d, t in rows:
        tokens, want = [None, None, *t.lower().encode().split(), None], 0.0
        for a, b, c in zip(tokens, tokens[1:], tokens[2:], strict=False):
            h = model.r[two_before(a)] * model.c1 + model.r[one_before(b)] * model.c2
            s = [math.exp(float(q @ h) + float(bias)) for q, bias in zip(model.q, model.b, strict=True)]
            want += math.log10(s[klass(c)] / sum(s))
            if klass(c) > 3:
                want += math.log10((seen[c] + 1) / (of_class[klass(c)] + types[klass(c)] + 1))
        assert got[d] == pytest.approx(want, rel=1e-4), d


def test_model_learns():
    rng = np.random.default_rng(0)
    n = 16
    u, v = (x.ravel() for x in np.meshgrid(np.arange(n), np.arange(n)))
    w, counts = (v + 1) % n, rng.integers(1, 50, n * n)
    unigram = np.full(n, 1 / n)
    model = lm.LogBilinear.start(unigram, n, 8)
    before = model.log_probabilities(u, v, w).mean()
    for k in range(30):
        model, met = lm.nce_pass(model, u, v, w, counts, unigram, k, 0.1)
    assert met.sum() == 2 * n * n and model.log_probabilities(u, v, w).mean() > before + 0.3
    every = np.array([model.log_probabilities(u, v, np.full(n * n, k)) for k in range(n)])
    assert np.allclose((10.0**every).sum(axis=0), 1, atol=1e-4)


def test_held_out_gain(spark):
    from demandlens.session import table

    got = lm.score_documents(table(spark, "/root/testdata/sf0.01", "documents")).where("held_out").agg(F.sum("base_score").alias("b"), F.sum("score").alias("s")).first()
    assert got["s"] > 0.97 * got["b"]  # scores are negative: three percent above the unigram at the least


# --- operator 7


def test_threads(spark):
    rows = [
        (1, 0, "user", "How do I join two tables?\nThanks"),
        (1, 1, "assistant", "Use a key."),
        (1, 2, "user", "What about nulls?"),
        (1, 3, "assistant", "> Use   a KEY.\nYes, one key."),
        (1, 4, "user", ">> Use a key.\n> Yes, one key.\nGood."),
        (2, 0, "user", "> What about nulls?\n\nThey never match."),
        (3, 0, "user", "> nobody wrote this\nHello"),
        (3, 1, "user", None),
        (None, 0, "user", "no conversation"),
        (4, 0, "user", "How do I join two tables?\nThanks"),
        (4, None, None, ""),
        (4, 0, "user", "How do I join two tables?\nThanks"),
    ]
    made = spark.createDataFrame([(c, t, r, x, 1, "k") for c, t, r, x in rows], "conv_id long, turn long, role string, text string, start int, mid string").repartition(3)
    got = chat.threads(made).orderBy("conversation", "position").collect()
    assert len(got) == len(rows)
    order = [(r["conv_id"], r["turn"]) for r in got if r["conversation"] == 1]
    assert order == [(1, 0), (1, 1), (1, 3), (1, 4), (1, 2), (2, 0)]
    by = {(r["conv_id"], r["turn"]): r for r in got}
    assert (by[1, 3]["reply_conv"], by[1, 3]["reply_turn"], by[1, 3]["text"]) == (1, 1, "Yes, one key.")
    assert (by[1, 4]["reply_turn"], by[1, 4]["levels"], by[1, 4]["n_quotes"], by[1, 4]["text"]) == (3, 2, 2, "Good.")
    assert (by[2, 0]["reply_conv"], by[2, 0]["reply_turn"], by[2, 0]["text"]) == (1, 2, "\nThey never match.")
    assert by[3, 0]["reply_turn"] is None and by[3, 0]["n_quotes"] == 1 and by[3, 0]["text"] == "Hello"
    assert by[3, 1]["text"] is None and by[None, 0]["conversation"] is None
    assert sorted(r["position"] for r in got if r["conversation"] == 4) == [0, 1, 2]
    assert chat.threads(made.where("false")).count() == 0
    assert chat.formatted(chat.threads(made)).where("conv_id = 1 AND turn = 1").first()["formatted"] == "<|assistant|>\nUse a key.\n"


def test_repeated_reply_keeps_its_link(spark):
    rows = [(1, 0, "user", "one two three\nfour five six"), (2, 0, "user", "other")]
    reply = (1, 1, "user", "> one two\n> three four\n> five six\nYes.")
    made = spark.createDataFrame(rows + [reply] * 3, "conv_id long, turn long, role string, text string").repartition(3)
    got = [r for r in chat.threads(made).collect() if r["turn"] == 1]
    assert [(r["reply_conv"], r["reply_turn"], r["n_linked"]) for r in got] == [(1, 0, 1)] * 3


def test_threads_without_quotes_keep_turns(spark):
    from demandlens.session import table

    made = table(spark, DATA, "conversations")
    got = {(r["conv_id"], r["turn"], r["role"], r["text"]): (r["conversation"], r["position"]) for r in chat.threads(made).collect()}
    for r in made.collect():
        assert got[r["conv_id"], r["turn"], r["role"], r["text"]][0] == r["conv_id"]
    turns = {}
    for (conv, turn, _, _), (_, position) in got.items():
        turns.setdefault(conv, []).append((position, turn))
    assert all([t for _, t in sorted(x)] == sorted(t for _, t in x) for x in turns.values())


# --- the pipeline


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline
    from demandlens.session import table

    docs = table(spark, "/root/testdata/sf0.001", "documents")
    benchmark = [(r["item_id"], r["text"]) for r in table(spark, DATA, "benchmark").collect()]
    assert [n for n, _ in corpus_pipeline.STAGES][1] == "SimHash near-dedup" and corpus_pipeline.ORACLE_SQL is None
    kept = docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = [(r["doc_id"], r["text"]) for r in kept.collect()] if k < 4 else []
        out = stage(spark, kept, DATA)
        out.write.parquet(f"file://{tmp_path}/{k}")
        after = spark.read.parquet(f"file://{tmp_path}/{k}")
        if k < 4:
            assert after.columns == list(corpus_pipeline.COLUMNS)
        ids = [r["doc_id"] for r in after.collect()]
        if k == 0:
            assert len(ids) > 0.9 * len(before)
        if k == 1:
            assert sorted(ids) == kept_ids(before)
        if k == 2:
            assert sorted(ids) == sorted({d for d, _ in before} - {d for d, _ in reference_matches(before, benchmark)})
        if k == 4:
            rows = after.orderBy("start").collect()
            assert all(r["verified"] for r in rows) and sorted(ids) == sorted(r["doc_id"] for r in kept.collect())
            assert ids == sorted(ids) or [r["doc_id"] for r in rows] == sorted(r["doc_id"] for r in rows)
        kept = after


@pytest.mark.parametrize("empty", [False, True])
def test_pipeline_edges(spark, docs, no_docs, empty):
    """Nulls in every column, blank and long texts, repeated rows, clashing and missing columns, and no rows at all."""
    import corpus_pipeline
    from demandlens.llm.util import stored

    kept = (no_docs if empty else docs).drop("n_chars").withColumn("_row", F.lit("x"))
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        kept = stored(stage(spark, kept, DATA), f"edge{k}")
        if k < 4:
            assert kept.columns == list(corpus_pipeline.COLUMNS)
            texts = [r["text"] for r in kept.collect()]
            assert (not texts) == empty and all(t and t.strip() for t in texts)
    assert (kept.count() == 0) == empty


def quoted_units(text):
    """Units of a message whose quoted lines come first, all of level one."""
    lines = [x[1:].removeprefix(" ") for x in (text or "").split("\n") if x.startswith(">")]
    flat = lambda x: " ".join(x.lower().split())
    return [u for u in dict.fromkeys([flat("\n".join(lines)), *map(flat, lines)]) if u]


def test_threads_of_quoting_conversations(spark):
    """The conversations of the table, every other message quoting the one before it or a line of a message elsewhere, against a search of all messages."""
    from demandlens.session import table

    rows = sorted((r["conv_id"], r["turn"], r["role"], r["text"] or "") for r in table(spark, DATA, "conversations").collect())
    own = {(c, t): x for c, t, _, x in rows}
    made = []
    for k, (c, t, role, x) in enumerate(rows):
        before = own.get((c, t - 1)) if k % 2 else own[rows[k // 2][:2]].split("\n")[0] if k % 5 == 0 else None
        quote = "".join(f"> {line}\n" for line in before.split("\n")) if before else ""
        made.append((c, t, role, quote + x))
    flat = lambda x: " ".join(x.lower().split())
    holds = {}
    for c, t, _, x in made:
        text = "\n".join(line for line in x.split("\n") if not line.startswith(">"))
        for u in {flat(text), *map(flat, text.split("\n"))} - {""}:
            holds.setdefault(u, []).append((c, t))
    want = {}
    for c, t, _, x in made:
        votes = Counter()
        for u in quoted_units(x):
            near = min((p for p in holds.get(u, []) if p[0] == c), default=None)
            far = min(holds.get(u, []), default=None)
            if near and near < (c, t):
                votes[near] += 1
            elif far and far[0] != c and far < (c, t):
                votes[far] += 1
        want[c, t] = max(((n, p) for p, n in votes.items()), default=(0, (None, None)))[1]
    got = chat.threads(spark.createDataFrame(made, "conv_id long, turn long, role string, text string")).collect()
    assert {(r["conv_id"], r["turn"]): (r["reply_conv"], r["reply_turn"]) for r in got} == want
    assert sum(p[0] is not None for p in want.values()) > len(rows) / 4


def test_every_operator_has_a_query():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names
    assert len(TEXTS) == 13
