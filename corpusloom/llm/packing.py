"""Problem 8: filling fixed-capacity containers.

Token lengths come from a public byte-level BPE vocabulary (its path is a parameter). Shortest-pack-first
over the length histogram decides, on the driver, how many items of each length go into which range of
containers; only the histogram (at most ``capacity`` rows) and the resulting ranges leave the cluster.
Items are joined back by their rank among the items of the same length.

An item is split only if it exceeds the capacity on its own: into full containers and one remainder.

Defined results: null text counts as empty; an item of 0 tokens has no piece and is left out; repeated
rows are separate items; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import os
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, ranked, stash

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
CAPACITY = 4096
# Fixed value: the split pattern that belongs to the vocabulary.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# Controls that the standard library and the tokenizer's pattern class differently.
_CONTROLS = "\x1c\x1d\x1e\x1f"
_counters: dict = {}


class Counter(dict):
    """Tokens of each chunk between single spaces, the space before it included.

    The split pattern attaches one space to what follows and never matches across it, and BPE never merges across a
    match, so a text's count is the sum over its chunks; texts with runs of spaces are encoded as a whole.
    """

    def __init__(self, path: str, limit: int = 1 << 19):
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        self.limit = limit

    def __missing__(self, chunk: str) -> int:
        n = len(self.encoding.encode_ordinary(" " + chunk))
        if len(self) < self.limit and len(chunk) < 64:
            self[chunk] = n
        return n

    def count(self, text: str) -> int:
        if "  " in text or any(c in text for c in _CONTROLS):
            return len(self.encoding.encode_ordinary(text))
        first, _, rest = text.partition(" ")
        n = len(self.encoding.encode_ordinary(first))
        return n + sum(map(self.__getitem__, rest.split(" "))) if _ else n


def _counter(path: str) -> Counter:
    if path not in _counters:
        _counters[path] = Counter(path)
    return _counters[path]


def token_lengths(df: DataFrame, id_col: str, text: str = "text", vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """(id, n_tokens) of every row, over whole texts. The vocabulary is read where the driver finds it and shipped to the executors."""
    df.sparkSession.sparkContext.addFile(vocabulary)
    name = os.path.basename(vocabulary)

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        count = _counter(SparkFiles.get(name)).count
        n = [count(t) if t else 0 for t in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], names=["id", "n_tokens"])

    return map_arrow(df.select(F.col(id_col).alias("id"), F.col(text).alias("t")), fn, f"id {dict(df.dtypes)[id_col]}, n_tokens long")


def shortest_pack_first(histogram: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int]], int]:
    """Ranges (length, first rank, count, first container) and the number of containers.

    Lengths go longest first into the packs with most room; a group of packs with the same room is a
    range of container numbers, so updating a group's count is cutting its range.
    """
    room: dict[int, list[tuple[int, int]]] = defaultdict(list)
    ranges, used = [], 0
    most = 0
    for length in sorted((x for x in histogram if x > 0), reverse=True):
        left, rank = histogram[length], 0
        while left:
            while most >= length and not room[most]:
                most -= 1
            if most < length:
                ranges.append((length, rank, left, used))
                room[capacity - length].append((used, left))
                most, used, left = max(most, capacity - length), used + left, 0
            else:
                first, n = room[most].pop()
                m = min(n, left)
                if n > m:
                    room[most].append((first + m, n - m))
                ranges.append((length, rank, m, first))
                room[most - length].append((first, m))
                rank, left = rank + m, left - m
    return ranges, used


def pack(df: DataFrame, id_col: str, text: str = "text", capacity: int = CAPACITY, vocabulary: str = DEFAULT_VOCABULARY, max_ranges: int = 4_000_000) -> DataFrame:
    """(id, n_tokens, n_pieces, piece, first_token, length, container) for every piece of every item.

    Container numbers start at 0; full pieces of oversized items have containers of their own, numbered
    after the packed ones by (rank of the item among oversized ones). At most ``max_ranges`` ranges are broadcast at once; more are
    applied block by block.
    """
    sizes = stash(token_lengths(df, id_col, text, vocabulary), "token-lengths").filter("n_tokens > 0")
    sizes = sizes.withColumn("n_pieces", F.ceil(F.col("n_tokens") / capacity).cast("int"))
    pieces = sizes.withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("n_pieces") - 1)))
    pieces = pieces.withColumn("first_token", F.col("piece").cast("long") * capacity)
    pieces = pieces.withColumn("length", F.least(F.lit(capacity).cast("long"), F.col("n_tokens") - F.col("first_token")))
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    ranges, _ = shortest_pack_first(histogram, capacity)
    ranges.sort()
    width = 1 << 40
    rows = ranked(pieces, ["length"], F.xxhash64("id"), ["id", "piece"], "rank")
    names = ["id", "n_tokens", "n_pieces", "piece", "first_token", "length"]

    kind = dict(df.dtypes)[id_col]

    def placed(part: DataFrame, some: list[tuple[int, int, int, int]]) -> DataFrame:
        starts = np.array([a * width + b for a, b, _, _ in some], dtype=np.int64)
        shift = np.array([c - b for _, b, _, c in some], dtype=np.int64)
        shared = df.sparkSession.sparkContext.broadcast((starts, shift))

        def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
            starts, shift = shared.value
            rank = batch.column("rank").to_numpy()
            at = np.searchsorted(starts, batch.column("length").to_numpy() * width + rank, side="right") - 1
            return pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(shift[at] + rank if len(at) else rank)], names=[*names, "container"])

        return map_arrow(part.select(*names, "rank"), fn, f"id {kind}, n_tokens long, n_pieces int, piece int, first_token long, length long, container long").withColumnRenamed("id", id_col)

    if len(ranges) <= max_ranges:
        return placed(rows, ranges)
    out = None
    for lo in range(0, len(ranges), max_ranges):  # pieces find their range by (length, rank)
        some, ahead = ranges[lo : lo + max_ranges], ranges[lo + max_ranges : lo + max_ranges + 1]
        after = lambda r: (F.col("length") > r[0]) | ((F.col("length") == r[0]) & (F.col("rank") >= r[1]))
        part = placed(rows.filter(after(some[0]) & ~after(ahead[0]) if ahead else after(some[0])), some)
        out = part if out is None else out.union(part)
    return out
