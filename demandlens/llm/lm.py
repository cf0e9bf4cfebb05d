"""Language-model scores: a log-bilinear model trained by noise-contrastive estimation (operator 6)."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from demandlens.llm.util import doc_columns, id_crc, stored

#: Most frequent words that are a class of their own, and classes of the other words by their last two bytes.
OWN, ENDINGS = 127, 128
#: Words with a context vector of their own; the others have that of their ending.
VECTORS = 32_768
DIMENSIONS = 16
#: Words whose counts go to every task; the counts of the others are joined.
KNOWN_WORDS = 300_000
#: Distinct n-grams to a shard, passes over all of them, and how many partial models meet in a task.
SHARD_ROWS, ROUNDS, MEET = 1_000_000, 2, 8
BATCH, NOISE = 4096, 64
#: Work on about so many characters at a time, which bounds a task's memory.
CHUNK = 1 << 20
#: Most words and n-grams that a task counts before it sends them.
HELD, HELD_NGRAMS = 750_000, 2_000_000
_CONTEXTS = 2048


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def _chunks(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    begin, size = 0, 0
    for k, t in enumerate(texts):
        size += len(t or "") + 1
        if size >= CHUNK:
            yield begin, k + 1
            begin, size = k + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


def held_out(doc_id):
    """True for documents that are never learned from; false for a null doc_id."""
    return F.coalesce(id_crc(doc_id) % 7 == 2, F.lit(False))


def word_counts(texts: DataFrame) -> DataFrame:
    """(w binary, c) over all rows of the column text; a task counts before it sends."""

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter = Counter()
        for part in parts:
            for t in part["text"].tolist():
                seen.update(words_of(t))
                if len(seen) > HELD:
                    yield pd.DataFrame({"w": list(seen), "c": list(seen.values())})
                    seen = Counter()
        if seen:
            yield pd.DataFrame({"w": list(seen), "c": list(seen.values())})

    return texts.mapInPandas(count, "w binary, c long").groupBy("w").agg(F.sum("c").alias("c"))


def frequent(counts: DataFrame, most: int) -> dict[bytes, int]:
    """The most frequent words, at most ``most``: all above the least count, on a log scale of 16 steps a power of two, that keeps the bound."""
    step = F.floor(F.log2("c") * 16)
    sizes = {r["k"]: r["n"] for r in counts.groupBy(step.alias("k")).agg(F.count("*").alias("n")).collect()}  # at most 16 x 63 rows
    total, least = 0, None
    for k in sorted(sizes, reverse=True):
        total += sizes[k]
        if total > most:
            break
        least = k
    if least is None:
        return {}
    found = counts.where(step >= least).toPandas()
    return {bytes(w): int(c) for w, c in zip(found["w"], found["c"], strict=True)}


@dataclass
class Vocabulary:
    """What every task knows of the training text's words.

    A word's id is its rank by count, from 1 on; 0 is the end of a text. Classes: 0 the end, then ``own`` words, then
    the endings. Contexts: 0 the end, then ``vectors`` words, then the endings. The last ending stands for all others.
    """

    ids: dict[bytes, int]
    counts: np.ndarray  # by id
    own: int
    vectors: int
    endings: dict[bytes, int]
    n: int
    v: int
    n_docs: int
    class_counts: np.ndarray  # tokens of each class
    class_types: np.ndarray  # distinct words of each class
    klass: np.ndarray = field(init=False)
    context: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        end = np.array([0, *(self.ending(w) for w in self.ids)], dtype=np.int64)
        rank = np.arange(len(end))
        self.klass = np.where(rank <= self.own, rank, self.own + 1 + end)
        self.context = np.where(rank <= self.vectors, rank, self.vectors + 1 + end)

    def ending(self, word: bytes) -> int:
        return self.endings.get(word[-2:], len(self.endings))

    @property
    def n_classes(self) -> int:
        return self.own + 2 + len(self.endings)

    @property
    def n_contexts(self) -> int:
        return self.vectors + 2 + len(self.endings)

    @property
    def context_of_class(self) -> np.ndarray:
        c = np.arange(self.n_classes)
        return np.where(c <= self.own, c, c - self.own + self.vectors)


def vocabulary(counts: DataFrame, n_docs: int, own: int = OWN, endings: int = ENDINGS, vectors: int = VECTORS, known_words: int = KNOWN_WORDS) -> Vocabulary:
    """Ids, classes and totals; the sums by the last two bytes, 65,792 rows at most, cover all words."""
    top = frequent(counts, known_words)
    order = sorted(top, key=lambda w: (-top[w], w))
    own, vectors = min(own, len(order)), min(vectors, len(order))
    last = F.expr("substring(w, greatest(length(w) - 1, 1), 2)")
    ends = counts.groupBy(last.alias("e")).agg(F.sum("c").alias("c"), F.count("*").alias("n")).collect()
    tokens, types = {bytes(r["e"]): int(r["c"]) for r in ends}, {bytes(r["e"]): int(r["n"]) for r in ends}
    words, distinct = sum(tokens.values()), sum(types.values())
    for w in order[:own]:
        tokens[w[-2:]] -= top[w]
        types[w[-2:]] -= 1
    named = {e: k for k, e in enumerate(sorted(tokens, key=lambda e: (-tokens[e], e))[: max(endings - 1, 0)])}
    class_counts, class_types = np.zeros(own + 2 + len(named), dtype=np.int64), np.ones(own + 2 + len(named), dtype=np.int64)
    class_counts[0] = n_docs
    class_counts[1 : own + 1] = [top[w] for w in order[:own]]
    class_types[own + 1 :] = 0
    for e, c in tokens.items():
        k = own + 1 + named.get(e, len(named))
        class_counts[k] += c
        class_types[k] += types[e]
    return Vocabulary(
        {w: k + 1 for k, w in enumerate(order)}, np.array([n_docs, *(top[w] for w in order)], dtype=np.int64), own, vectors, named,
        words + n_docs, distinct + (n_docs > 0), n_docs, class_counts, class_types,
    )


@dataclass
class LogBilinear:
    """Class vectors q with biases b, context vectors r, and position weights c1, c2 by which the contexts two and one before are summed."""

    q: np.ndarray
    b: np.ndarray
    c1: np.ndarray
    c2: np.ndarray
    r: np.ndarray

    @staticmethod
    def start(unigram: np.ndarray, contexts: int, dimensions: int = DIMENSIONS, seed: int = 6) -> LogBilinear:
        rng = np.random.default_rng(seed)
        small = lambda n: rng.normal(0, 0.1, (n, dimensions)).astype(np.float32)
        half = np.full(dimensions, 0.5, dtype=np.float32)
        return LogBilinear(small(len(unigram)), np.log(unigram).astype(np.float32), half, 2 * half, small(contexts))

    def parts(self) -> list[np.ndarray]:
        return [self.q, self.b, self.c1, self.c2, self.r]

    def log_probabilities(self, before2: np.ndarray, before1: np.ndarray, klass: np.ndarray) -> np.ndarray:
        """log10 P(class | contexts two and one before), normalised over the classes; equal contexts are worked out once."""
        n = len(self.r)
        pairs, which = np.unique(before2 * n + before1, return_inverse=True)
        order = np.argsort(which, kind="stable")
        edges = np.searchsorted(which[order], np.arange(0, len(pairs) + _CONTEXTS, _CONTEXTS))
        out = np.empty(len(klass), dtype=np.float64)
        for k, at in enumerate(range(0, len(pairs), _CONTEXTS)):
            some = pairs[at : at + _CONTEXTS]
            s = (self.r[some // n] * self.c1 + self.r[some % n] * self.c2) @ self.q.T
            s += self.b
            s -= s.max(axis=1, keepdims=True)
            mine = order[edges[k] : edges[k + 1]]
            row = which[mine] - at
            picked = s[row, klass[mine]]
            np.exp(s, out=s)
            out[mine] = (picked - np.log(s.sum(axis=1))[row]) / math.log(10)
        return out


def _sums(rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows and the sum of each one's values."""
    order = np.argsort(rows, kind="stable")
    rows = rows[order]
    first = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
    return rows[first], np.add.reduceat(values[order], first, axis=0)


def nce_pass(model: LogBilinear, before2: np.ndarray, before1: np.ndarray, klass: np.ndarray, counts: np.ndarray, unigram: np.ndarray, seed: int, rate: float) -> tuple[LogBilinear, np.ndarray]:
    """Adagrad over all n-grams, each weighed by its count; one of a large count is visited several times, with equal parts of it.

    Weights are relative to the mean count, and visits are at most a quarter more than n-grams. A batch shares its noise classes, drawn from the unigram. Also returns how often each context was met.
    """
    model = LogBilinear(*(x.copy() for x in model.parts()))
    q, b, c1, c2, r = model.parts()
    rng = np.random.default_rng(seed)
    share = counts / counts.mean()
    visits = np.maximum(1, (share / 4).astype(np.int64))
    draws = np.repeat(np.arange(len(counts)), visits)
    rng.shuffle(draws)
    weight = (share / visits).astype(np.float32)
    met = np.bincount(before2[draws], minlength=len(r)) + np.bincount(before1[draws], minlength=len(r))
    squares = [np.full(x.shape, 1e-2, dtype=np.float32) for x in model.parts()]
    log_noise = (np.log(unigram) + math.log(NOISE)).astype(np.float32)

    def step(k: int, x: np.ndarray, g: np.ndarray, at=slice(None)) -> None:
        squares[k][at] += g * g
        x[at] += rate * g / np.sqrt(squares[k][at])

    for at in range(0, len(draws), BATCH):
        mine = draws[at : at + BATCH]
        u, v, w = before2[mine], before1[mine], klass[mine]
        noise = rng.choice(len(unigram), NOISE, p=unigram)
        ru, rv, qw, qn = r[u], r[v], q[w], q[noise]
        h = ru * c1 + rv * c2
        real = np.einsum("ij,ij->i", h, qw) + b[w] - log_noise[w]
        fake = h @ qn.T + (b[noise] - log_noise[noise])
        g_real = 1 / (1 + np.exp(np.clip(real, -30, 30)))  # ascent on log sigma(real)
        g_fake = -1 / (1 + np.exp(-np.clip(fake, -30, 30)))
        g_real, g_fake = g_real * weight[mine], g_fake * weight[mine, None]
        g_h = g_real[:, None] * qw + g_fake @ qn
        rows, g_q = _sums(np.concatenate([w, noise]), np.concatenate([g_real[:, None] * h, g_fake.T @ h]))
        g_b = np.bincount(w, g_real, len(b)) + np.bincount(noise, g_fake.sum(axis=0), len(b))
        step(0, q, g_q, rows)
        step(1, b, g_b.astype(np.float32))
        contexts, g_r = _sums(np.concatenate([u, v]), np.concatenate([g_h * c1, g_h * c2]))
        step(2, c1, (g_h * ru).sum(axis=0))
        step(3, c2, (g_h * rv).sum(axis=0))
        step(4, r, g_r, contexts)
    return model, met


def _sequence(texts: list[str | None], vocab: Vocabulary):
    """All tokens of the texts, each ended by the end: their ids (-1: not known), classes, contexts two and one before;
    the unknown words and their places, and where texts end."""
    words: list[bytes] = []
    ends = np.empty(len(texts), dtype=np.int64)
    for k, t in enumerate(texts):
        words += words_of(t)
        ends[k] = len(words) + k + 1
    code = np.zeros(len(words) + len(texts), dtype=np.int64)
    inner = np.ones(len(code), dtype=bool)
    inner[ends - 1] = False
    code[inner] = np.fromiter(map(vocab.ids.get, words, repeat(-1)), dtype=np.int64, count=len(words))
    klass, context = vocab.klass[code], vocab.context[code]
    lost = np.flatnonzero(code < 0)
    place = np.cumsum(inner) - 1
    unknown = [words[k] for k in place[lost].tolist()]
    end = np.fromiter(map(vocab.ending, unknown), dtype=np.int64, count=len(unknown))
    klass[lost], context[lost] = vocab.own + 1 + end, vocab.vectors + 1 + end
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    before1 = np.concatenate([[0], context[:-1]])
    before1[starts] = 0
    older = np.concatenate([[0, 0], vocab.context_of_class[klass[:-2]]])[: len(code)]
    older[starts] = 0
    older[starts + 1 - (ends - starts == 1)] = 0  # a text's first two tokens follow ends
    return code, klass, older, before1, unknown, lost, starts, ends


def ngrams(texts: DataFrame, sent, sizes: tuple[int, int]) -> DataFrame:
    """(code, n): how often each class follows each class and word, over all rows of the column text."""
    contexts, classes = sizes

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[np.ndarray] = []
        sums: list[np.ndarray] = []

        def merged() -> pd.DataFrame:
            code, at = np.unique(np.concatenate(held), return_inverse=True)
            return pd.DataFrame({"code": code, "n": np.bincount(at, np.concatenate(sums)).astype(np.int64)})

        for part in parts:
            texts = part["text"].tolist()
            for lo, hi in _chunks(texts):
                _, klass, before2, before1, *_ = _sequence(texts[lo:hi], sent.value)
                code, n = np.unique((before2 * contexts + before1) * classes + klass, return_counts=True)
                held.append(code)
                sums.append(n)
                if sum(map(len, held)) > 2 * HELD_NGRAMS:
                    some = merged()
                    held, sums = [some["code"].to_numpy()], [some["n"].to_numpy()]
                    if len(some) > HELD_NGRAMS:
                        yield some
                        held, sums = [], []
        if held:
            yield merged()

    return texts.mapInPandas(count, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


_MODEL_SCHEMA = "n double, fixed binary, met binary, r binary"


def _fitter(sent, unigram: np.ndarray, k: int, shard_rows: int):
    """Trains on the n-grams of a partition, ``shard_rows`` at a time; gives the sums that an average by weight is made of:
    each context by how often it was met."""

    def fit(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model: LogBilinear = sent.value
        contexts, classes = len(model.r), len(unigram)

        def fitted(held: list[pd.DataFrame]) -> pd.DataFrame:
            part = pd.concat(held).sort_values("code")
            code, counts = part["code"].to_numpy(), part["n"].to_numpy()
            seed = [k, *int(code[0]).to_bytes(8, "little")]
            got, met = nce_pass(model, code // classes // contexts, code // classes % contexts, code % classes, counts, unigram, seed, 0.1 / (1 + k))
            n = float(counts.sum())
            fixed = n * np.concatenate([x.ravel() for x in got.parts()[:4]]).astype("<f8")
            return pd.DataFrame({"n": [n], "fixed": [fixed.tobytes()], "met": [met.astype("<i8").tobytes()], "r": [(got.r * met[:, None]).astype("<f4").tobytes()]})

        held: list[pd.DataFrame] = []
        for part in parts:
            held.append(part)
            if sum(map(len, held)) >= shard_rows:
                yield fitted(held)
                held = []
        if held and sum(map(len, held)):
            yield fitted(held)

    return fit


def _added(part: pd.DataFrame) -> pd.DataFrame:
    part = part.sort_values("n")
    sums = {c: sum(np.frombuffer(x, dtype=kind).astype(kind) for x in part[c]).astype(kind).tobytes() for c, kind in (("fixed", "<f8"), ("met", "<i8"), ("r", "<f4"))}
    return pd.DataFrame({"n": [part["n"].sum()], **{c: [x] for c, x in sums.items()}})


def train(counted: DataFrame, vocab: Vocabulary, rounds: int = ROUNDS, shard_rows: int = SHARD_ROWS, dimensions: int = DIMENSIONS) -> LogBilinear:
    """Average of models trained on shards of the n-grams, the average starting the next round.

    The n-grams, which the count has dealt by hash, stand for the whole training text; the number of shards grows with them. Partial models meet a few to a
    task until one is left, and that one comes to the driver; its size is fixed by the vocabulary's bounds.
    """
    unigram = (vocab.class_counts + 1.0) / (vocab.class_counts + 1.0).sum()
    model = LogBilinear.start(unigram, vocab.n_contexts, dimensions)
    if counted.isEmpty():
        return model
    for k in range(rounds):
        sent = counted.sparkSession.sparkContext.broadcast(model)
        partial = stored(counted.mapInPandas(_fitter(sent, unigram, k, shard_rows), _MODEL_SCHEMA), "partial")
        left = partial.count()
        while left > 1:
            left = -(-left // MEET)
            partial = partial.withColumn("part", F.pmod(F.xxhash64("fixed"), F.lit(left)))
            partial = stored(partial.groupBy("part").applyInPandas(_added, _MODEL_SCHEMA), "partial")
            left = partial.count()
        row = partial.first()
        sent.unpersist()
        fixed, met = np.frombuffer(row["fixed"], dtype="<f8") / row["n"], np.frombuffer(row["met"], dtype="<i8")
        sizes = np.cumsum([x.size for x in model.parts()[:4]])[:-1]
        flat = [x.astype(np.float32).reshape(y.shape) for x, y in zip(np.split(fixed, sizes), model.parts()[:4], strict=True)]
        r = np.frombuffer(row["r"], dtype="<f4").reshape(model.r.shape) / np.maximum(met, 1)[:, None]
        model = LogBilinear(*flat, np.where((met > 0)[:, None], r, model.r).astype(np.float32))
    return model


def score(docs: DataFrame, counts: DataFrame, vocab: Vocabulary, model: LogBilinear) -> DataFrame:
    """(doc_id, n_tokens, n_known, base_score, score) for every row, as in ``score_documents``."""
    sent = docs.sparkSession.sparkContext.broadcast((vocab, model))
    base_norm = math.log10(vocab.n + vocab.v + 1)

    def work(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vocab, model = sent.value
        log_count = np.log10(vocab.counts + 1.0)
        log_class = np.log10(vocab.class_counts + vocab.class_types + 1.0)
        for part in parts:
            texts, ids = part["text"].tolist(), part["doc_id"].astype("Int64")
            for lo, hi in _chunks(texts):
                code, klass, before2, before1, unknown, lost, starts, ends = _sequence(texts[lo:hi], vocab)
                neural = model.log_probabilities(before2, before1, klass)
                base = np.where(code >= 0, log_count[code], 0.0)
                shared = klass > vocab.own  # a word within its class, by counts
                neural += np.where(shared, base - log_class[klass], 0.0)
                known = np.add.reduceat((code > 0).astype(np.int64), starts)
                cut = np.searchsorted(lost, ends)
                rare = [unknown[a:b] for a, b in zip([0, *cut[:-1].tolist()], cut.tolist(), strict=True)]
                yield pd.DataFrame({
                    "doc_id": ids.iloc[lo:hi].reset_index(drop=True), "n": ends - starts, "base": np.add.reduceat(base, starts),
                    "neural": np.add.reduceat(neural, starts), "n_known": known, "rare": rare,
                })

    schema = "doc_id long, n long, base double, neural double, n_known long, rare array<binary>"
    rows = stored(docs.mapInPandas(work, schema).withColumn("rid", F.monotonically_increasing_id()), "scored")
    sent.unpersist()
    found = rows.select("rid", F.explode("rare").alias("w")).join(counts, "w").groupBy("rid").agg(F.sum(F.log10(F.col("c") + 1)).alias("more"), F.count("*").alias("n_more"))
    both = rows.drop("rare").join(found, "rid", "left").withColumns({"more": F.coalesce("more", F.lit(0.0)), "n_more": F.coalesce("n_more", F.lit(0))})
    return both.select(
        "doc_id", F.col("n").alias("n_tokens"), (F.col("n_known") + F.col("n_more") + F.lit(int(vocab.n_docs > 0))).alias("n_known"),
        (F.col("base") + F.col("more") - F.col("n") * F.lit(base_norm)).alias("base_score"), (F.col("neural") + F.col("more")).alias("score"),
    )


def score_documents(docs: DataFrame, own: int = OWN, endings: int = ENDINGS, vectors: int = VECTORS, known_words: int = KNOWN_WORDS, rounds: int = ROUNDS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Learn from the documents outside the held-out fold, then score every row's whole text.

    Columns: doc_id, held_out, n_tokens, n_known, train_tokens, base_score (add-one unigram), score (both log10 of the
    text's probability). The model gives P(class | the class two before, the word before), normalised over the classes:
    the end, the most frequent words, and the others by their ending. A word of an ending's class is further
    divided by add-one counts within it, all unseen words of the class being one. Of the words before, the ``vectors`` most
    frequent have a vector of their own, the others that of their ending. Word counts, sums by ending and n-grams cover
    the whole training text; the counts of all but ``known_words`` words are joined, not sent.

    A null text is an empty one: its only token is the end. Rows with a null doc_id are learned from. Repeated rows
    count each time. Without training documents N is 0 and the classes are equally likely. Other columns are not read.
    """
    docs = doc_columns(docs, "doc_id", "text")
    training = docs.where(~held_out(F.col("doc_id"))).select("text")
    counts = stored(word_counts(training), "counts")
    vocab = vocabulary(counts, training.count(), own, endings, vectors, known_words)
    sent = docs.sparkSession.sparkContext.broadcast(vocab)
    counted = stored(ngrams(training, sent, (vocab.n_contexts, vocab.n_classes)), "ngrams")
    sent.unpersist()
    model = train(counted, vocab, rounds, shard_rows)
    return score(docs, counts, vocab, model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", F.lit(vocab.n).cast("long").alias("train_tokens"), "base_score", "score"
    )


def op6_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
