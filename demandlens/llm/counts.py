"""Token counts of sections by offset-mapped attribution (operator 4)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from demandlens.llm.encoding import batches, encoder
from demandlens.llm.util import doc_columns

RULES = ("first", "last", "most")


def attribute(starts: np.ndarray, begin: np.ndarray, end: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """The section of each token and whether it crosses a boundary.

    ``starts``: ascending first characters of the sections, which lie side by side; a token spans the
    characters begin <= c < end. ``first`` gives a crossing token to the section of its first character,
    ``last`` to that of its last, ``most`` to the one that holds most of its characters, the earlier of equals.
    """
    first = np.searchsorted(starts, begin, "right") - 1
    last = np.searchsorted(starts, np.maximum(end - 1, begin), "right") - 1
    crossing = first != last
    if rule == "first":
        return first, crossing
    if rule == "last":
        return last, crossing
    owner = first.copy()
    for k in np.flatnonzero(crossing):
        edges = np.concatenate([[begin[k]], starts[first[k] + 1 : last[k] + 1], [end[k]]])
        owner[k] = first[k] + int(np.argmax(np.diff(edges)))
    return owner, crossing


def section_counts(docs: DataFrame, vocabulary: str | None = None, rule: str = "first", fields: tuple[str, ...] = ("text",)) -> DataFrame:
    """(doc_id, section, field, char_start, char_end, n_tokens, n_crossing) for every section of every row.

    The fields of a row, joined by line ends, are one text that is encoded once; a section is a line of a
    field with its line end. Token spans come from the byte lengths of the ids, turned to characters, and are
    joined to the sections as intervals. The n_tokens of a row's sections add up to its whole count.
    A null field is an empty one, and every field has at least one section, empty or not. A byte-level
    vocabulary may cut a character: such a token spans that character. Repeated rows are counted each; other
    columns are not read.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    vocabulary = vocabulary or public_tokenizers.path("byte_bpe_50k.json")
    names = list(fields)

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(vocabulary)
        width = enc.byte_lengths()
        for part in parts:
            whole = [[x if isinstance(x, str) else "" for x in row] for row in part[names].to_numpy().tolist()]
            texts = ["\n".join(row) for row in whole]
            ids_of = part["doc_id"].astype("Int64").to_numpy()
            for lo, hi in batches(texts):
                some = texts[lo:hi]
                ids, lengths = enc.encode(some)
                raw = np.frombuffer("".join(some).encode("utf-8", "surrogatepass"), dtype=np.uint8)
                seen = np.cumsum((raw & 0xC0) != 0x80)  # characters up to and with each byte
                tail = np.cumsum(width[ids])
                begin = seen[tail - width[ids]] - 1 if len(ids) else np.zeros(0, dtype=np.int64)
                end = seen[tail - 1] if len(ids) else begin
                characters = np.array([len(t) for t in some], dtype=np.int64)
                base = np.cumsum(characters) - characters
                doc, field, start, stop = [], [], [], []
                for k, row in enumerate(whole[lo:hi]):
                    at = 0
                    for f, value in enumerate(row):
                        lines = value.split("\n")
                        sizes = [len(x) + 1 for x in lines[:-1]] + ([len(lines[-1])] if lines[-1] or len(lines) == 1 else [])
                        if f + 1 < len(row):
                            sizes[-1] += 1
                        for size in sizes:
                            doc.append(k)
                            field.append(names[f])
                            start.append(at)
                            at += size
                            stop.append(at)
                doc_no, first = np.array(doc), np.array(start, dtype=np.int64)
                last = np.array(stop, dtype=np.int64)
                full = np.flatnonzero(last > first)  # an empty section holds no character, and so no token
                owner, crossing = attribute((base[doc_no] + first)[full], begin, end, rule)
                n_tokens, n_crossing = np.zeros(len(doc_no), dtype=np.int64), np.zeros(len(doc_no), dtype=np.int64)
                n_tokens[full] = np.bincount(owner, minlength=len(full))[: len(full)]
                n_crossing[full] = np.bincount(owner[crossing], minlength=len(full))[: len(full)]
                numbered = np.arange(len(doc_no)) - np.searchsorted(doc_no, doc_no, "left")
                yield pd.DataFrame({"doc_id": ids_of[lo:hi][doc_no], "section": numbered, "field": field, "char_start": first, "char_end": last, "n_tokens": n_tokens, "n_crossing": n_crossing})

    schema = "doc_id long, section long, field string, char_start long, char_end long, n_tokens long, n_crossing long"
    return doc_columns(docs, "doc_id", *names).mapInPandas(count, schema)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return section_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def document_counts(sections: DataFrame) -> DataFrame:
    """Whole counts of documents from those of their sections."""
    return sections.groupBy("doc_id").agg(F.sum("n_tokens").alias("n_tokens"), F.sum("n_crossing").alias("n_crossing"), F.count("*").alias("n_sections"))
