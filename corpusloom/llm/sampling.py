"""Problem 4: a sample that matches target category proportions.

Documents are the distinct text paths; category spellings are brought to one form first. Quotas are
allocated top-down over the tree sector > year > doc_type: each node hands its quota to its children in proportion to
their shares by largest remainder, no child getting less than its minima or more than its documents; what a cell can't
give so passes to its siblings (same sector and year), then to its cousins (same sector), then to the rest. At the
leaves, documents are drawn by their rank under a seeded permutation.

Defined results: a null category belongs to no target cell; a null path is no document; a document listed
several times counts once, under its smallest non-null categories; an empty table gives quotas of 0; a cell repeated in
the targets counts with the sum of its shares and the largest minimum.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ranked, stash

LEVELS = ("sector", "year", "doc_type")
BROADCAST_CELLS = 100_000


def _plain(c: str) -> F.Column:
    return F.lower(F.regexp_replace(F.col(c), r"(?U)^\s+|\s+$", ""))


def sector_key(c: str = "sector") -> F.Column:
    return F.nullif(F.regexp_replace(F.regexp_replace(_plain(c), r"(?U)\s*&\s*", " and "), r"(?U)[\s_-]+", " "), F.lit(""))


def year_key(c: str = "year") -> F.Column:
    return F.nullif(F.regexp_extract(_plain(c), r"^(?:fy|f\.y\.)?[\s/_-]*((?:19|20)\d\d)(?:\.0+)?$", 1), F.lit(""))


def doc_type_key(c: str = "doc_type") -> F.Column:
    return F.nullif(F.regexp_replace(_plain(c), r"(?U)[\s_-]+", "_"), F.lit(""))


def distinct_documents(index: DataFrame, path: str = "text_path") -> DataFrame:
    """One row per document with its category keys."""
    rows = index.filter(F.col(path).isNotNull()).select(F.col(path).alias("path"), sector_key().alias("sector"), year_key().alias("year"), doc_type_key().alias("doc_type"))
    return rows.groupBy("path").agg(*[F.min(c).alias(c) for c in LEVELS])


def apportion(q: int, weights: list[float], low: list[int], high: list[int]) -> list[int]:
    """Whole numbers in proportion to ``weights``, each within its bounds, that sum to ``q`` as far as the bounds allow.

    What a bound takes from one goes to the others in proportion; fractions are given by largest remainder, ties to the first.
    """
    q = min(max(q, sum(low)), sum(high))
    w = [max(x, 1e-12) for x in weights]
    clamp = lambda m: [min(max(m * x, lo), hi) for x, lo, hi in zip(w, low, high)]
    lo, hi = 0.0, (q + 1) / min(w, default=1.0)
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sum(clamp(mid)) < q else (lo, mid)
    exact = clamp(hi)
    out = [int(x + 1e-6) for x in exact]
    rest = q - sum(out)
    for i in sorted(range(len(w)), key=lambda i: (-round(exact[i] - out[i], 6), i)):
        if rest > 0 and out[i] < high[i]:
            out[i], rest = out[i] + 1, rest - 1
    return out


def allocate(cells: list[dict], n: float) -> None:
    """Sets ``need``, ``quota`` and ``passed_in`` of each cell, which has key, share, min_count and available.

    From the root down, each node hands its quota to its children in proportion to their shares, within what their cells have and need
    at least. So what a cell can't give goes to its siblings, what they can't to its cousins, and the quotas sum to ``n``
    (rounded) unless all cells together have less or their minima ask for more.
    """
    for c in cells:
        c["need"] = max(c["min_count"], c["share"] * n)
        c["least"] = min(c["min_count"], c["available"])

    def hand_down(members: list[dict], q: int, depth: int) -> None:
        groups = defaultdict(list)
        for c in members:
            groups[c["key"][: depth + 1]].append(c)
        keys = sorted(groups, key=lambda k: tuple(map(str, k)))
        total = lambda k, x: sum(c[x] for c in groups[k])
        parts = apportion(q, [total(k, "share") for k in keys], [total(k, "least") for k in keys], [total(k, "available") for k in keys])
        for k, part in zip(keys, parts):
            if depth + 1 < len(LEVELS):
                hand_down(groups[k], part, depth + 1)
            else:
                groups[k][0]["quota"] = part

    hand_down(cells, int(n + 0.5), 0)
    for c in cells:
        c["passed_in"] = max(0, c["quota"] - int(c["need"] + 0.5))


def sample(index: DataFrame, targets: DataFrame, fraction: float = 0.3, seed: int = 7, path: str = "text_path") -> tuple[DataFrame, DataFrame]:
    """(drawn documents, report of every target cell)."""
    spark = index.sparkSession
    docs = stash(distinct_documents(index, path), "sample-documents")
    counts = docs.groupBy(*LEVELS).agg(F.count("*").alias("n"))
    total = docs.count()
    wanted = targets.select(*LEVELS, "share", "min_count", sector_key().alias("k0"), year_key().alias("k1"), doc_type_key().alias("k2"))
    wanted = wanted.groupBy("k0", "k1", "k2").agg(*[F.min(c).alias(c) for c in LEVELS], F.sum("share").alias("share"), F.max("min_count").alias("min_count"))
    met = wanted.join(counts.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(LEVELS)], "n"), F.expr("k0 = c0 and k1 = c1 and k2 = c2"), "left")
    cells = [
        {"key": (r.k0, r.k1, r.k2), "name": (r.sector, r.year, r.doc_type), "share": r.share or 0.0, "min_count": r.min_count or 0, "available": r.n or 0}
        for r in met.collect()  # one row per target cell
    ]
    cells.sort(key=lambda c: tuple(map(str, c["key"])))
    allocate(cells, fraction * total)
    rows = [(*c["name"], float(c["share"]), int(c["min_count"]), int(c["available"]), float(c["need"]), int(c["quota"]), int(c["passed_in"]), c["available"] + 1e-9 < c["need"], *c["key"]) for c in cells]
    report = spark.createDataFrame(rows, "sector string, year string, doc_type string, share double, min_count int, available long, needed double, quota long, passed_in long, short boolean, k0 string, k1 string, k2 string")
    leaf = report.filter("quota > 0").select("k0", "k1", "k2", "quota")
    leaf = F.broadcast(leaf) if len(rows) <= BROADCAST_CELLS else leaf
    mine = docs.join(leaf, F.expr("sector = k0 and year = k1 and doc_type = k2")).drop("k0", "k1", "k2")
    drawn = ranked(mine, list(LEVELS), F.xxhash64(F.lit(seed), "path"), ["path"], "rank").filter("rank < quota").select("path", *LEVELS, "rank")
    return drawn.withColumnRenamed("path", path), report.drop("k0", "k1", "k2")
