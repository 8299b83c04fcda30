"""Problem 6: cutting oversized items at natural boundaries.

Each gap between two words has a strength (blank line, line break, end of sentence, clause, none). A
sparse table answers range-maximum queries over the strengths: the next cut is the strongest gap in the
permissible length window, the rightmost of equals; the next piece starts ``overlap`` words before the cut.

Defined results: null or blank text gives no piece; a text within the limit is one piece, unchanged but for white
space at its ends; a text without any boundary is cut at the limit; repeated rows give repeated pieces; other
columns are not read. Words are separated by white space of any kind.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow

LIMIT, OVERLAP = 400, 40
_WORD = re.compile(r"\S+")


def n_words(text: str) -> F.Column:
    """Number of words; Unicode white space separates."""
    return F.regexp_count(F.col(text), F.lit(r"(?U)[^\s\x1c-\x1f]+"))


def strengths(text: str, spans: list[tuple[int, int]]) -> np.ndarray:
    """Strength of the gap after each word but the last."""
    out = np.zeros(max(0, len(spans) - 1), dtype=np.int8)
    for k in range(len(out)):
        b, c = spans[k][1], spans[k + 1][0]
        gap = text[b:c]
        n = gap.count("\n")
        tail = text[max(spans[k][0], b - 3) : b].rstrip("\"')]”’»")
        end = tail[-1:] if tail else ""
        first = text[c]
        if n >= 2:
            out[k] = 5
        elif end in ".!?…" and end and not first.islower():
            out[k] = 4 if n else 3
        elif n:
            out[k] = 2 if end in ";:" and end else 1
        elif end and end in ";:,–—":
            out[k] = 1
    return out


class RangeMax:
    """Sparse table: position of the maximum of a range, the rightmost of equals, in two look-ups."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        self.values = values
        self.levels = [np.arange(n)]
        step = 1
        while 2 * step <= n:
            a, b = self.levels[-1][:-step], self.levels[-1][step:]
            self.levels.append(np.where(values[b] >= values[a], b, a))
            step *= 2

    def query(self, lo: int, hi: int) -> int:
        """Over lo..hi, both included."""
        k = (hi - lo + 1).bit_length() - 1
        a, b = self.levels[k][lo], self.levels[k][hi - (1 << k) + 1]
        return int(b if self.values[b] >= self.values[a] else a)


def pieces_of(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, str]]:
    """(first word, end word, substring) of each piece."""
    if not 0 <= overlap < limit // 2:
        raise ValueError("overlap must be less than half the limit")
    spans = [m.span() for m in _WORD.finditer(text)]
    n = len(spans)
    if not n:
        return []
    cut = lambda a, b: (a, b, text[spans[a][0] : spans[b - 1][1]])
    if n <= limit:
        return [cut(0, n)]
    table, out, start = RangeMax(strengths(text, spans)), [], 0
    while n - start > limit:
        end = table.query(start + limit // 2 - 1, start + limit - 1) + 1
        out.append(cut(start, end))
        start = end - overlap
    out.append(cut(start, n))
    return out


def split_oversized(df: DataFrame, id_col: str, text: str = "text", limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(id, piece, n_pieces, first_word, end_word, n_words, text). Only texts over the limit leave the JVM."""
    kind = dict(df.dtypes)[id_col]
    base = df.select(F.col(id_col).alias("id"), F.col(text).alias("t")).filter(F.col("t").isNotNull()).withColumn("n", n_words("t")).filter("n > 0")
    blank = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"
    short = base.filter(F.col("n") <= limit).select("id", F.lit(0).alias("piece"), F.lit(1).alias("n_pieces"), F.lit(0).alias("first_word"), F.col("n").alias("end_word"), F.col("n").alias("n_words"), F.regexp_replace("t", blank, "").alias("text"))

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        cols: list[list] = [[] for _ in range(7)]
        for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            found = pieces_of(t, limit, overlap)
            for k, (a, b, s) in enumerate(found):
                for col, v in zip(cols, (i, k, len(found), a, b, b - a, s)):
                    col.append(v)
        kinds = [batch.column(0).type, *[pa.int32()] * 5, pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["id", "piece", "n_pieces", "first_word", "end_word", "n_words", "text"])

    long = map_arrow(base.filter(F.col("n") > limit).select("id", "t"), fn, f"id {kind}, piece int, n_pieces int, first_word int, end_word int, n_words int, text string")
    return short.unionByName(long).withColumnRenamed("id", id_col)


def oversized(df: DataFrame, id_col: str, text: str = "text", limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """The ids of which ``split_oversized`` makes several pieces."""
    return split_oversized(df, id_col, text, limit, overlap).filter("n_pieces > 1").select(id_col).distinct()
