"""Problem 9: evaluation passages inside the corpus.

The test items become a hash set of word n-grams, which is broadcast (its size is checked; a set beyond the
bound is cut into blocks that are scanned one after another). Each document's words are turned into hashes of
sliding windows by numpy; a window in the set is a seed, and every seed is verified word by word: from it an exact
alignment counts changed, missing and added words, and the best stretch must span the whole item or
``min_words`` words of it with at most one change in ``per_change`` words.

Words are compared in the consistent form of problem 3, in lower case, without punctuation; a hyphen at a line end
joins the word; a document is compared as it is and without its page numbers and repeated page headers.

Defined results: null and empty texts leak nothing; an item found several times in a document is one row; repeated
documents give a row each; an item of fewer than ``min_words`` words leaks only whole; an empty set of items gives
no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow
from .text_form import consistent

GRAM, MIN_WORDS, PER_CHANGE = 7, 30, 12
_OUTER = re.compile(r"[^\w\s\x00-\x7f¬]+")
_PUNCTUATION = bytes(i for i in range(128) if not chr(i).isalnum() and not chr(i).isspace())
_LETTERS = re.compile(r"[^\W\d_]+")
_MULT = np.uint64(0x9E3779B97F4A7C15)


def without_furniture(text: str) -> list[str]:
    """The text in each form without page furniture, none for a text that has none; long texts and short ones alike.

    Left out are page numbers and short lines whose letters come back, in one form all of them, in others only those that come
    back at least so often; so a passage that is carried twice stays in a form without the headers between its lines.
    """
    lines = text.split("\n")
    short = [(k, "".join(_LETTERS.findall(l.lower()))) for k, l in enumerate(lines) if l.strip() and len(l) <= 100]
    seen = Counter(key for _, key in short if key)
    numbers = {k for k, key in short if not (key and len(key) > 4) and len(lines[k]) < 24 and re.fullmatch(r"\W*(?:page\W*)?(?:\d{1,4}|[ivxl]+)(?:\W*(?:of|/)\W*\d{1,4})?\W*", lines[k], re.I)}
    often = {k: seen[key] for k, key in short if len(key) > 4 and seen[key] > 1}
    drops = [numbers | {k for k, n in often.items() if n >= least} for least in [*sorted(set(often.values())), len(lines) + 1]]
    return ["\n".join(l for k, l in enumerate(lines) if k not in drop) for drop in drops if drop]


def quick_words(text: str) -> list[bytes]:
    """The words of a text, page furniture left in."""
    if not text.isascii():
        text = text.replace("\xad\n", "-\n")
        text = _OUTER.sub("", consistent(text))
    if "\n" in text:
        text = text.replace("-\n", "").replace("¬\n", "")
    return text.lower().encode("utf-8", "surrogatepass").translate(None, _PUNCTUATION).split()


def words_of(text: str) -> list[bytes]:
    """The words of a text without its page furniture."""
    return quick_words(next(iter(without_furniture(text)), text))


def grams(ids: np.ndarray, n: int) -> np.ndarray:
    """Hash of each window of n word numbers; 0 where a window holds a word that no item has."""
    if len(ids) < n:
        return np.zeros(0, dtype=np.uint64)
    x = (ids + 1).astype(np.uint64) * _MULT
    h = np.zeros(len(ids) - n + 1, dtype=np.uint64)
    ok = np.ones(len(h), dtype=bool)
    for k in range(n):
        part = x[k : k + len(h)]
        h = (h ^ (part >> np.uint64(29)) ^ part) * np.uint64(0xBF58476D1CE4E5B9)
        ok &= ids[k : k + len(h)] >= 0
    return np.where(ok, h, np.uint64(0))


class Items:
    """Test items as word numbers, with a sorted array of window hashes."""

    def __init__(self, rows: list[tuple[int, str]], n: int = GRAM):
        self.n, self.ids = n, [i for i, _ in rows]
        words = [words_of(t or "") for _, t in rows]
        self.number = {w: k for k, w in enumerate(dict.fromkeys(w for ws in words for w in ws))}
        self.words = [np.array([self.number[w] for w in ws], dtype=np.int64) for ws in words]
        self.lists = [w.tolist() for w in self.words]
        found = sorted((int(h), i, k) for i, ws in enumerate(self.words) for k, h in enumerate(grams(ws, n)) if h)
        self.hashes = np.array([h for h, _, _ in found], dtype=np.uint64)
        self.places = [(i, k) for _, i, k in found]
        self.short = [i for i, ws in enumerate(self.words) if 0 < len(ws) < n]


def _reach(a, b, i: int, j: int, step: int, most: int) -> list[int]:
    """For 0 to ``most`` changes: the words of the item reached beyond a seed in one direction, the last one equal.

    Changed, missing and added words cost one each; for each shift between item and document the furthest word is kept
    (what lies before it on the same shift takes no more changes).
    """
    la, lb = (len(a) - i, len(b) - j) if step > 0 else (i + 1, j + 1)
    far: dict[int, int] = {}
    out, best, todo = [], 0, [(0, 0)]
    for _ in range(most + 1):
        new = {}
        while todo:
            p, q = todo.pop()
            d = q - p
            past = far.get(d, max(0, -d) - 1)
            if past >= p:
                continue
            while p < la and q < lb and a[i + p * step] == b[j + q * step]:
                p, q = p + 1, q + 1
            best = max(best, next((x for x in range(p, max(past, best, -d, 0), -1) if a[i + (x - 1) * step] == b[j + (x + d - 1) * step]), 0))
            far[d] = new[d] = p
        out.append(best)
        ahead = ((min(p + by, la, lb - e), e) for d, p in new.items() for e, by in ((d, 1), (d - 1, 1), (d + 1, 0)))
        todo = [(p, p + e) for p, e in ahead if p >= max(0, -e)]
    return out


@lru_cache(maxsize=None)
def _least_run(words: int, min_words: int, per_change: int) -> int:
    """The longest equal run that every leaked stretch of an item has: ``k`` changes leave at most ``k + 1`` runs."""
    need = min(min_words, words)
    return min(-(-(max(need, k * per_change) - k) // (k + 1)) for k in range(words // per_change + 1))


def leaked(item, doc, i: int, j: int, n: int, min_words: int, per_change: int) -> bool:
    """Whether the match around an equal run of ``n`` words, the longest of it, spans enough words of the item with few enough changes."""
    most, need = len(item) // per_change, min(min_words, len(item))
    if n >= need or n < _least_run(len(item), min_words, per_change):
        return n >= need
    left = _reach(item, doc, i - 1, j - 1, -1, most)
    right = _reach(item, doc, i + n, j + n, 1, most)
    return any(n + wl + wr >= max(need, (cl + cr) * per_change) for cl, wl in enumerate(left) for cr, wr in enumerate(right))


def _seeds(items: Items, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(window, position among the item hashes) of the windows that an item has."""
    if not len(items.hashes):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    known = np.nonzero(np.convolve(ids >= 0, np.ones(items.n, dtype=np.int64), "valid") == items.n)[0] if len(ids) >= items.n else ids[:0]
    if not len(known):
        return known, known
    h = grams(ids, items.n)[known]
    at = np.searchsorted(items.hashes, h)
    at[at == len(items.hashes)] = 0
    hit = items.hashes[at] == h
    return known[hit], at[hit]


def matches(items: Items, text: str, min_words: int, per_change: int) -> list[int]:
    """Positions of the items that leaked into a document, as it is or in a form without page furniture."""
    get = items.number.get
    ids = np.array([get(w, -1) for w in quick_words(text)], dtype=np.int64)
    seeds, at = _seeds(items, ids)
    if not len(seeds) and not items.short:
        return []
    out: set[int] = set()
    _verify(items, ids, seeds, at, min_words, per_change, out)
    for form in without_furniture(text):
        ids = np.array([get(w, -1) for w in quick_words(form)], dtype=np.int64)
        _verify(items, ids, *_seeds(items, ids), min_words, per_change, out)
    return sorted(out)


def _verify(items: Items, ids: np.ndarray, seeds: np.ndarray, at: np.ndarray, min_words: int, per_change: int, out: set[int]) -> None:
    """Adds to ``out`` the items that leaked into the words ``ids``."""
    tried: dict[tuple[int, int], int] = {}
    doc = ids.tolist()
    for j, k in zip(seeds.tolist(), at.tolist()):
        h = items.hashes[k]
        while k < len(items.hashes) and items.hashes[k] == h:
            i, p = items.places[k]
            k += 1
            if i in out or j < tried.get((i, j - p), 0):
                continue
            item = items.lists[i]
            if item[p : p + items.n] != doc[j : j + items.n]:
                continue
            lo, hi = 0, items.n
            while lo < min(p, j) and item[p - lo - 1] == doc[j - lo - 1]:
                lo += 1
            while p + hi < len(item) and j + hi < len(doc) and item[p + hi] == doc[j + hi]:
                hi += 1
            tried[i, j - p] = j + hi
            if leaked(item, doc, p - lo, j - lo, lo + hi, min_words, per_change):
                out.add(i)
    for i in items.short:
        ws = items.words[i]
        if len(ids) >= len(ws) and any((ids[k : k + len(ws)] == ws).all() for k in np.nonzero(ids[: len(ids) - len(ws) + 1] == ws[0])[0]):
            out.add(i)


def find_leaks(corpus: DataFrame, tests: DataFrame, id_col: str, item_col: str, text: str = "text", item_text: str = "text", n: int = GRAM, min_words: int = MIN_WORDS, per_change: int = PER_CHANGE, block_chars: int = 32_000_000) -> DataFrame:
    """(id, item) for each test item that is in a document whole or in part.

    Items are read in blocks of about ``block_chars`` characters, so what is collected and broadcast at once is bounded (about 20 bytes
    a character); each block is one scan of the corpus.
    """
    spark = corpus.sparkSession
    kind, item_kind = dict(corpus.dtypes)[id_col], dict(tests.dtypes)[item_col]
    source = corpus.filter(F.col(text).isNotNull()).select(F.col(id_col).alias("id"), F.col(text).alias("t"))
    rows = tests.filter(F.col(item_text).isNotNull()).select(item_col, item_text)
    n_blocks = max(1, -(-(rows.agg(F.sum(F.length(item_text))).first()[0] or 0) // block_chars))
    schema = f"id {kind}, item {item_kind}"
    result = None
    for b in range(n_blocks):
        part = rows if n_blocks == 1 else rows.filter(F.pmod(F.xxhash64(item_col, item_text), F.lit(n_blocks)) == b)
        shared = spark.sparkContext.broadcast(Items([(r[0], r[1]) for r in part.collect()], n))

        def fn(batch: pa.RecordBatch, shared=shared) -> pa.RecordBatch:
            items, ids, found = shared.value, [], []
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for k in matches(items, t, min_words, per_change):
                    ids.append(i)
                    found.append(items.ids[k])
            return pa.RecordBatch.from_arrays([pa.array(ids, batch.column(0).type), pa.array(found, pa.int64() if item_kind == "bigint" else None)], names=["id", "item"])

        one = map_arrow(source, fn, schema)
        result = one if result is None else result.unionByName(one)
    return result.toDF(id_col, item_col).distinct()


def leak_report(leaks: DataFrame, tests: DataFrame, id_col: str, item_col: str) -> DataFrame:
    """(item, n_docs) of every test item, 0 for one that leaked nowhere."""
    n = leaks.groupBy(item_col).agg(F.count("*").alias("n_docs"))
    return tests.select(item_col).distinct().join(n, item_col, "left").na.fill(0, ["n_docs"])


def remove_leaking(corpus: DataFrame, leaks: DataFrame, id_col: str) -> DataFrame:
    """The corpus without the documents that hold a test item."""
    return corpus.join(leaks.select(id_col).distinct(), id_col, "left_anti")
