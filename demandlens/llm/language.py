"""Language identification: multinomial naive Bayes over hashed character n-grams (operator 9)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from demandlens.llm.util import doc_columns, id_crc

UNDETERMINED = "und"
#: Work on about so many characters at a time, which bounds a task's memory.
CHUNK = 1 << 18
#: A text of n n-grams may lie below its language's floor by so much over the root of n, in nats an n-gram.
SLACK = 10.0


def _letters() -> np.ndarray:
    """For each code point: is it a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)


_LETTERS: np.ndarray | None = None
_MIX = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D))


def features(texts: list[str], bits: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Bucket ids of the 1- to 3-grams of lower-cased letters and word gaps.

    Returns for n = 1, 2, 3 an array with one bucket for each character of the joined texts, the first
    position of each text, and for each text whether it has a letter. A character that is no letter is a gap.
    n-grams of gaps only, and those that would cross into the next text, fall in bucket 0, which never counts.
    """
    global _LETTERS
    if _LETTERS is None:
        _LETTERS = _letters()
    joined = "".join(t.lower() + "  " for t in texts)
    code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    lengths = np.array([len(t.lower()) + 2 for t in texts], dtype=np.int64)
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)
    letter = _LETTERS[code]
    code = np.where(letter, code, np.uint32(32))
    shift = np.uint32(32 - bits)
    out = []
    mixed, any_letter = np.zeros(len(code), dtype=np.uint32), np.zeros(len(code), dtype=bool)
    for n in range(3):
        ahead, seen = np.full(len(code), 32, dtype=np.uint32), np.zeros(len(code), dtype=bool)
        ahead[: len(code) - n], seen[: len(code) - n] = code[n:], letter[n:]
        mixed = (mixed ^ ahead) * _MIX[n]
        mixed ^= mixed >> np.uint32(15)
        any_letter = any_letter | seen
        bucket = ((mixed * np.uint32(0x27D4EB2F)) >> shift).astype(np.int64)
        found = np.where(any_letter & letter | (any_letter & (n > 0) & ~letter), np.maximum(bucket, 1), 0)
        for k in range(1, n + 1):
            found[starts + lengths - k] = 0
        out.append(found)
    has = np.add.reduceat(letter.astype(np.int64), starts) > 0 if len(texts) else np.zeros(0, dtype=bool)
    return out, starts, has


def _chunks(texts: list[str]) -> Iterator[tuple[int, int]]:
    begin, size = 0, 0
    for k, t in enumerate(texts):
        size += len(t) + 2
        if size >= CHUNK:
            yield begin, k + 1
            begin, size = k + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


def _fit(logs, grams):
    """Mean log probability of an n-gram, with the slack of short texts."""
    return logs / grams + SLACK / np.sqrt(grams)


@dataclass
class LanguageModel:
    """langs in order; table[n-gram order, bucket, lang] holds log probabilities, bucket 0 zeros; prior logs."""

    langs: list[str]
    bits: int
    prior: np.ndarray = field(default_factory=lambda: np.zeros(0))
    table: np.ndarray = field(default_factory=lambda: np.zeros((3, 0, 0), dtype=np.float32))
    #: For each language the least fit of its texts; only where train() was asked for it.
    floor: np.ndarray | None = None

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """The most probable language and its posterior; ``und`` with 0 for a text without a letter."""
        return self.fitted(texts)[:2]

    def fitted(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """As predict(), and by how much each text's fit lies above the floor of its language, negative below it."""
        pred, score, above = [UNDETERMINED] * len(texts), np.zeros(len(texts)), np.full(len(texts), -np.inf)
        if not self.langs:
            return pred, score, above
        whole = [t or "" for t in texts]
        for lo, hi in _chunks(whole):
            buckets, starts, has = features(whole[lo:hi], self.bits)
            logs = np.tile(self.prior, (hi - lo, 1))
            for n in range(3):
                for k in range(len(self.langs)):
                    logs[:, k] += np.add.reduceat(self.table[n, :, k][buckets[n]], starts, dtype=np.float64)
            best = logs.argmax(axis=1)
            grams = np.maximum(sum(np.add.reduceat((b > 0).astype(np.int64), starts) for b in buckets), 1)
            fit = _fit((logs - self.prior)[np.arange(hi - lo), best], grams)
            over = fit - (self.floor[best] if self.floor is not None else -np.inf)
            top = 1.0 / np.exp(logs - logs.max(axis=1, keepdims=True)).sum(axis=1)
            for k in np.flatnonzero(has):
                pred[lo + k] = self.langs[best[k]]
                score[lo + k] = top[k]
                above[lo + k] = over[k]
        return pred, score, above


def train(labelled: DataFrame, per_language: int = 4000, bits: int = 13, max_languages: int = 512, floors: bool = False) -> LanguageModel:
    """Fit on rows (doc_id, text, lang): at most about ``per_language`` documents of each language.

    The bounded sample takes the documents whose seeded hash of (doc_id, lang) lies below per_language / count,
    so it is the same in every run. The counts of all n-grams of the sampled whole texts are summed by Spark;
    what comes to the driver is one matrix of languages x 3 x 2^bits at most. Rows with a null text or lang
    teach nothing. More than ``max_languages`` labels raise an error.

    ``floors`` also fits, on the sample, the least mean log probability of an n-gram in each language: as far
    below the first percentile as that lies below the median, half a nat at least. Each text is held against
    the counts of the others only.
    """
    rows = labelled.where("lang IS NOT NULL AND text IS NOT NULL")
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy("lang").limit(max_languages + 1).collect()}
    if len(counts) > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    langs = sorted(counts)
    if not langs:
        return LanguageModel([], bits)
    share = F.create_map(*[F.lit(x) for lang in langs for x in (lang, min(1.0, per_language / counts[lang]))])
    unit = F.pmod(F.xxhash64("doc_id", "lang", F.lit(9)), F.lit(1 << 20)) / F.lit(float(1 << 20))
    sample = rows.where(unit < F.element_at(share, F.col("lang"))).select("lang", "text")

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((len(langs), 3, 1 << bits), dtype=np.int64)
        place = {x: k for k, x in enumerate(langs)}
        for part in parts:
            for lang, group in part.groupby("lang"):
                texts = group["text"].tolist()
                for lo, hi in _chunks(texts):
                    buckets, _, _ = features(texts[lo:hi], bits)
                    for n in range(3):
                        total[place[lang], n] += np.bincount(buckets[n], minlength=1 << bits)
        k, n, b = np.nonzero(total)
        yield pd.DataFrame({"k": k, "n": n, "b": b, "c": total[k, n, b]})

    sums = sample.mapInPandas(count, "k int, n int, b int, c long").groupBy("k", "n", "b").agg(F.sum("c").alias("c")).toPandas()
    total = np.zeros((3, 1 << bits, len(langs)))
    total[sums["n"].to_numpy(), sums["b"].to_numpy(), sums["k"].to_numpy()] = sums["c"].to_numpy()
    total[:, 0, :] = 0
    logs = np.log((total + 0.5) / (total.sum(axis=1, keepdims=True) + 0.5 * ((1 << bits) - 1)))
    logs[:, 0, :] = 0
    weight = np.array([counts[x] for x in langs], dtype=float)
    model = LanguageModel(langs, bits, np.log(weight / weight.sum()), logs.astype(np.float32))
    if not floors:
        return model
    sent = labelled.sparkSession.sparkContext.broadcast(total)

    def without_own(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        place = {x: k for k, x in enumerate(langs)}
        for part in parts:
            fits = []
            for lang, text in zip(part["lang"], part["text"], strict=True):
                buckets, _, _ = features([text], bits)
                log, grams = 0.0, 0
                for n in range(3):
                    own = np.bincount(buckets[n], minlength=1 << bits)
                    own[0] = 0
                    rest = sent.value[n, :, place[lang]] - own
                    log += float((own * np.log((rest + 0.5) / (rest.sum() + 0.5 * ((1 << bits) - 1)))).sum())
                    grams += int(own.sum())
                fits.append(_fit(log, grams) if grams else None)
            yield pd.DataFrame({"lang": part["lang"], "fit": pd.Series(fits, dtype=float)})

    fits = sample.mapInPandas(without_own, "lang string, fit double").where("fit IS NOT NULL AND NOT isnan(fit)")
    least = {r["lang"]: r["q"] for r in fits.groupBy("lang").agg(F.percentile_approx("fit", [0.01, 0.5], F.lit(10_000)).alias("q")).collect()}
    model.floor = np.array([q[0] - max(q[1] - q[0], 0.5) if (q := least.get(x)) else -np.inf for x in langs])
    return model


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """(doc_id, lang_pred, score) for every row of docs, in no stated order.

    The model's matrix, whose size is fixed by its bits and languages, goes to the tasks with the function.
    A null text, an empty text and one without letters give ``und`` and 0. Repeated rows give repeated rows;
    a null doc_id stays null. Other columns of docs are not read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def score(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            pred, prob = sent.value.predict(part["text"].tolist())
            yield pd.DataFrame({"doc_id": part["doc_id"].astype("Int64"), "lang_pred": pred, "score": prob})

    return doc_columns(docs, "doc_id", "text").mapInPandas(score, "doc_id long, lang_pred string, score double")


def keep_confident(docs: DataFrame, model: LanguageModel, sure: float) -> DataFrame:
    """The rows of docs, with all their columns, whose language is predicted with a probability of ``sure`` or more.

    Texts that are null or without a letter have no language and go, and so do those whose n-grams are rarer than
    the floor of the language predicted, if the model has floors: among languages that all fit badly one still wins.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def confident(text: pd.Series) -> pd.Series:
        pred, prob, above = sent.value.fitted(text.tolist())
        return pd.Series([p != UNDETERMINED and bool(q >= sure and a >= 0) for p, q, a in zip(pred, prob, above, strict=True)], dtype=bool)

    return docs.where(confident(F.col("text").cast("string")))


def held_out(doc_id):
    """True for the fold that is never learned from."""
    return F.coalesce(id_crc(doc_id) % 4 == 2, F.lit(False))


def language_id(docs: DataFrame, per_language: int = 4000) -> DataFrame:
    """Learn from the labelled documents outside the held-out fold, then predict every document."""
    known = doc_columns(docs, "doc_id", "text", "lang")
    model = train(known.where(~held_out(F.col("doc_id"))), per_language)
    return identify(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(spark.read.parquet(f"{sf_dir}/documents.parquet"))
