"""Problem 3: one consistent form for text that looks the same.

A transducer over grapheme clusters (a base character with its combining marks and invisible
characters) rewrites each cluster by the longest match in a mapping of characters and of bases with
their accents, which is built, checked for conflicts and compiled to an automaton when the module is
loaded; marks that no sequence of the mapping holds are put in canonical order. What is mapped: full-width and half-width forms, Latin
ligatures, kinds of hyphen, kinds of space, invisible characters, combining accents (composed), and
Cyrillic or Greek letters drawn like Latin ones. What looks different (case, digits, accents, words,
line breaks, dashes, quotation marks, superscripts) stays different.

Defined results: null stays null; empty text stays empty; ties and repeated rows are kept; other
columns pass through untouched; no bound on the length of a text.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, stash

# Letters of other scripts that are drawn like a Latin letter.
LOOK_ALIKES = {
    "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "Ү": "Y", "Ԛ": "Q", "Ԝ": "W",
    "а": "a", "е": "e", "ѕ": "s", "і": "i", "ј": "j", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Ϲ": "C",
    "ο": "o", "ν": "v", "ϲ": "c", "ϳ": "j", "ı": "i", "ɑ": "a", "ɡ": "g",
}
# Characters without a drawn form, hyphens other than U+002D, Latin ligatures.
INVISIBLE = "­͏؜᠎​‌‍‎‏⁠⁡⁢⁣⁤﻿" + "".join(map(chr, range(0xFE00, 0xFE10)))
HYPHENS = "‐‑⁃﹣－"
LIGATURES = "ﬀﬁﬂﬃﬄﬅﬆĲĳ"


def build_mapping() -> dict[str, str]:
    """Character, or base with accents, to replacement. Raises if two rules disagree or a replacement would be rewritten again."""
    table: dict[str, str] = {}

    def put(a: str, b: str) -> None:
        if table.setdefault(a, b) != b:
            raise ValueError(f"conflict for {a!r}: {table[a]!r} and {b!r}")

    for c in INVISIBLE:
        put(c, "")
    for c in HYPHENS:
        put(c, "-")
    for c in LIGATURES:
        put(c, unicodedata.normalize("NFKC", c))
    for i in [*range(0x80, 0x3001), *range(0xFF00, 0xFFF0)]:
        c = chr(i)
        kind = unicodedata.decomposition(c).partition(" ")[0]
        if c not in table and (kind in ("<wide>", "<narrow>") or unicodedata.category(c) == "Zs"):
            put(c, " " if unicodedata.category(c) == "Zs" else unicodedata.normalize("NFKC", c))
    for a, b in LOOK_ALIKES.items():
        put(a, b)
    for i in [*range(0x370, 0x530), *range(0x1F00, 0x2000)]:  # accented forms of the look-alikes
        whole = unicodedata.normalize("NFD", chr(i))
        if len(whole) > 1 and whole[0] in LOOK_ALIKES:
            put(chr(i), unicodedata.normalize("NFC", LOOK_ALIKES[whole[0]] + whole[1:]))
    singles: dict[str, list[str]] = {}
    for a, b in table.items():
        if len(a) == len(b) == 1:
            singles.setdefault(b, []).append(a)
    for i in range(0xC0, 0x20000):
        c = chr(i)
        seq = unicodedata.normalize("NFD", c) if unicodedata.decomposition(c)[:1] not in ("", "<") else c
        if len(seq) > 1 and c not in table and unicodedata.normalize("NFC", c) == c and all(map(unicodedata.combining, seq[1:])):
            for k in range(1, len(seq)):
                head = unicodedata.normalize("NFC", seq[:k])
                for h in (head, *singles.get(head, ())) if len(head) == 1 else ():
                    put(h + seq[k:], c)
    for a, b in table.items():
        if any(c in table for c in b):
            raise ValueError(f"{a!r} gives {b!r}, which is mapped again")
    return table


def compile_mapping(table: dict[str, str]) -> list[tuple[dict[str, int], str | None]]:
    """The states of the automaton: (character to next state, replacement of what was read so far)."""
    steps: list[dict[str, int]] = [{}]
    ends: list[str | None] = [None]
    for a, b in table.items():
        at = 0
        for c in a:
            if c not in steps[at]:
                steps[at][c] = len(steps)
                steps.append({})
                ends.append(None)
            at = steps[at][c]
        ends[at] = b
    return list(zip(steps, ends))


MAPPING = build_mapping()
_STATES = compile_mapping(MAPPING)
_RUN = re.compile(r"[^\x00-\x7f]+")
_JOINS = frozenset(INVISIBLE)


def _sticks(c: str) -> bool:
    return c in _JOINS or unicodedata.combining(c) > 0


def _longest(cluster: str, i: int) -> tuple[int, str]:
    """(end, replacement) of the longest match from ``i``; invisible characters between base and accents are read over."""
    best, state, j = (i + 1, cluster[i]), 0, i
    while j < len(cluster):
        if state and cluster[j] in _JOINS:
            j += 1
            continue
        state = _STATES[state][0].get(cluster[j], -1)
        if state < 0:
            break
        j += 1
        if _STATES[state][1] is not None:
            best = (j, _STATES[state][1])
        if cluster[i] in _JOINS:
            break
    return best


@lru_cache(maxsize=1 << 16)
def _rewrite(run: str) -> str:
    """One run of clusters, cluster by cluster."""
    out, i = [], 0
    while i < len(run):
        j = i + 1
        while j < len(run) and _sticks(run[j]):
            j += 1
        end, mapped = _longest(run[i:j], 0)
        whole = end == j - i > 1
        while end < j - i:
            end, more = _longest(run[i:j], end)
            mapped += more
        out.append(mapped if whole or mapped.isascii() else unicodedata.normalize("NFC", mapped))
        i = j
    return "".join(out)


def consistent(text: str | None) -> str | None:
    """The consistent form of one text."""
    if not text or text.isascii():
        return text
    out, last = [], 0
    for m in _RUN.finditer(text):
        a, b = m.span()
        run = m.group()
        if a > last and _sticks(run[0]):
            a -= 1
            run = text[a] + run
        out.append(text[last:a])
        out.append(_rewrite(run))
        last = b
    out.append(text[last:])
    return "".join(out)


def to_consistent(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with ``text`` in the consistent form; all other columns as they are."""
    schema = df.schema
    at = df.columns.index(text)

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        cols = list(batch.columns)
        cols[at] = pa.array([consistent(t) for t in cols[at].to_pylist()], pa.string())
        return pa.RecordBatch.from_arrays(cols, names=batch.schema.names)

    return map_arrow(df, fn, schema)


def form_keys(df: DataFrame, id_col: str, text: str = "text") -> DataFrame:
    """(id, raw, form): 128-bit hashes of the stored text and of its consistent form; null texts are left out."""

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        raw, form = [], []
        for t in batch.column(1).to_pylist():
            h = xxhash.xxh3_128_digest(t.encode("utf-8", "surrogatepass"))
            raw.append(h)
            c = consistent(t)
            form.append(h if c is t or c == t else xxhash.xxh3_128_digest(c.encode("utf-8", "surrogatepass")))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary()), pa.array(form, pa.binary())], names=["id", "raw", "form"])

    kind = dict(df.dtypes)[id_col]
    return map_arrow(df.filter(F.col(text).isNotNull()).select(F.col(id_col).alias("id"), F.col(text).alias("t")), fn, f"id {kind}, raw binary, form binary")


def look_alike_classes(df: DataFrame, id_col: str, text: str = "text") -> DataFrame:
    """(id, form, raw): the class (128-bit form) and the spelling (128-bit raw) of each id whose class has several spellings."""
    keys = stash(form_keys(df, id_col, text).distinct(), "form-keys")
    mixed = keys.groupBy("form").agg(F.min("raw").alias("lo"), F.max("raw").alias("hi")).filter("lo <> hi").select("form")
    return stash(keys.join(mixed, "form", "left_semi"), "form-mixed").select(F.col("id").alias(id_col), "form", "raw")


def look_alike_pairs(df: DataFrame, id_col: str, text: str = "text", per_part: int = 1_000) -> DataFrame:
    """Pairs of ids, smaller first, whose texts have the same consistent form but other characters.

    Exact copies are first collapsed into spellings of a class, so that a text stored in any number of copies costs no comparison with
    itself. Pairs of spellings are expanded to pairs of ids in blocks of ``per_part`` ids by ``per_part``, so no spelling with many
    copies is expanded in one task.
    """
    some = look_alike_classes(df, id_col, text).withColumnRenamed(id_col, "id")
    kinds = some.groupBy("form", "raw").agg(F.ceil(F.count("*") / per_part).cast("int").alias("k"))
    a, b = kinds.toDF("form", "raw_a", "ka"), kinds.toDF("form", "raw_b", "kb")
    pairs = a.join(b, "form").filter(F.col("raw_a") < F.col("raw_b"))
    pairs = pairs.withColumn("pa", F.explode(F.expr("sequence(0, ka - 1)"))).withColumn("pb", F.explode(F.expr("sequence(0, kb - 1)"))).drop("ka", "kb")
    parts = some.join(kinds, ["form", "raw"]).withColumn("p", F.pmod(F.xxhash64("id", F.lit(23)), F.col("k")).cast("int"))
    left = parts.select("form", F.col("raw").alias("raw_a"), F.col("p").alias("pa"), F.col("id").alias("ia"))
    right = parts.select("form", F.col("raw").alias("raw_b"), F.col("p").alias("pb"), F.col("id").alias("ib"))
    out = pairs.join(left, ["form", "raw_a", "pa"]).join(right, ["form", "raw_b", "pb"])
    return out.filter("ia <> ib").select(F.least("ia", "ib").alias(f"{id_col}_a"), F.greatest("ia", "ib").alias(f"{id_col}_b")).distinct()
