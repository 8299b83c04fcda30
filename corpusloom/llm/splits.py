"""Problem 7: splits that keep related records together.

Entities (companies, however written) and the groups that link them (passages) form a graph. Its components are kept in two
persisted tables, which are read with each delivery and added to: ``groups`` (group, anchor, torn), the entity each group hangs on, and
``nodes`` (node, component, split, n_rows), a row per entity. Links are first collapsed to distinct pairs of entities, then merged by
pointer jumping. A component that already has a split keeps it, new ones fill the deficits against the target shares, and a merge
of components with different splits is quarantined: its old entities keep their splits, its new ones go to ``quarantine``,
and so do the rows of every group whose entities aren't all of one split (a new such group is torn: it stays there), so no group is
ever in two splits.

A row whose company can't be told by itself takes the one its group hangs on, if that is one company only.

Defined results: a row whose company can't be told at all is an entity of its own passage; a row without passage and company is an
entity of its own; repeated rows count with their number; an empty delivery leaves the tables as they are; other columns are not read.
"""

from __future__ import annotations

import math
from itertools import count

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ranked, stash

QUARANTINE = "quarantine"


def name_key(c: F.Column) -> F.Column:
    """Company name without case, punctuation, legal form and country."""
    low = F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " ")
    bare = F.regexp_replace(low, r"\b(?:plc|ltd|limited|incorporated|inc|company|co|nigeria|nig)\b", " ")
    return F.nullif(F.trim(F.regexp_replace(bare, r"\s+", " ")), F.lit(""))


def ticker_key(c: F.Column) -> F.Column:
    """Ticker in capitals, without spaces and the suffix of an exchange."""
    up = F.upper(F.regexp_replace(c, r"(?U)\s+", ""))
    return F.nullif(F.regexp_replace(F.regexp_replace(up, r"^(?:NGX|NSE|NG)[:.]", ""), r"[.:_-](?:NG|LG|LAG|NGX|NSE|NL)$", ""), F.lit(""))


def told_by_itself(rows: DataFrame, companies: DataFrame) -> DataFrame:
    """``rows`` with ``listed``, the ticker of the company that a row names, by its name or else by its ticker, and ``__tk``."""
    c = companies.filter("ticker is not null").select(F.col("ticker").alias("__t"), name_key(F.col("name")).alias("nk"), ticker_key(F.col("ticker")).alias("tk"))
    one = lambda key, out: c.groupBy(F.col(key).alias(out)).agg(F.min("__t").alias(f"{out}_l"), F.count_distinct("__t").alias("__k")).filter(f"__k = 1 and {out} is not null").drop("__k")
    keyed = rows.withColumns({"__nk": name_key(F.col("company")), "__tk": ticker_key(F.col("ticker"))})
    met = keyed.join(one("nk", "by_name"), F.col("__nk") == F.col("by_name"), "left").join(one("tk", "by_ticker"), F.col("__tk") == F.col("by_ticker"), "left")
    return met.select(*rows.columns, "__tk", F.coalesce("by_name_l", "by_ticker_l").alias("listed"))


def hang_groups(pairs: DataFrame, old: DataFrame | None) -> DataFrame:
    """(g, anchor, one, new, torn) of each group of the delivery: the entity it hangs on, by the persisted table or else its smallest one, and whether it has no other.

    ``pairs``: distinct (e, g) of the delivery; a group without an entity is not among them.
    """
    pairs = pairs.select("g", "e", F.lit(1).alias("new"), F.lit(False).alias("torn"))
    if old is not None:
        known = old.select(F.col("group").alias("g"), F.col("anchor").alias("e"), F.lit(0).alias("new"), "torn")
        pairs = pairs.union(known.join(pairs.select("g").distinct(), "g", "left_semi"))
    return pairs.groupBy("g").agg(F.min_by("e", F.struct("new", "e")).alias("anchor"), (F.min("e") == F.max("e")).alias("one"), F.min("new").alias("new"), F.max("torn").alias("torn"))


def tell_companies(rows: DataFrame, companies: DataFrame, old: DataFrame | None = None) -> DataFrame:
    """``rows`` with ``listed``: by themselves; else by what their passage hangs on; else by the tickers seen elsewhere beside a name, if they agree."""
    met = stash(told_by_itself(rows, companies), "split-told")
    of_passage = hang_groups(met.filter("listed is not null and passage_id is not null").select(F.col("listed").alias("e"), F.col("passage_id").alias("g")).distinct(), None)
    if old is not None:
        mine = old.join(met.filter("listed is null").select(F.col("passage_id").alias("group")).distinct(), "group", "left_semi")
        of_passage = of_passage.select("g", "anchor", "one").union(mine.select(F.col("group"), "anchor", F.lit(True)))
        of_passage = of_passage.groupBy("g").agg(F.min("anchor").alias("anchor"), (F.min("one") & (F.min("anchor") == F.max("anchor"))).alias("one"))
    company = of_passage.filter("one").join(companies.select(F.col("ticker").alias("anchor")).distinct(), "anchor", "left_semi").select(F.col("g"), "anchor")
    alias = met.filter("__tk is not null and listed is not null").groupBy(F.col("__tk").alias("t")).agg(F.min("listed").alias("t_l"), F.max("listed").alias("__m")).filter("t_l = __m").drop("__m")
    open_ = met.filter("listed is null").drop("listed")
    found = open_.join(company, F.col("passage_id") == F.col("g"), "left").join(alias, F.col("__tk") == F.col("t"), "left")
    cols = [*rows.columns, "listed"]
    return met.filter("listed is not null").select(cols).unionByName(found.withColumn("listed", F.coalesce("anchor", "t_l")).select(cols))


def components(links: DataFrame) -> DataFrame:
    """(node, component) of the graph of ``links`` (a, b): the smallest node that can be reached.

    Each round hangs every node's root on the smallest root beside it, then jumps the pointers once; labels only fall, so it ends.
    """
    labels = stash(links.select(F.col("a").alias("node")).union(links.select("b")).distinct().withColumn("component", F.col("node")), "cc-0")
    edges = stash(links.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "cc-links")
    for i in count():
        la, lb = labels.toDF("a", "ca"), labels.toDF("b", "cb")
        across = edges.join(la, "a").join(lb, "b").filter("ca <> cb").select(F.greatest("ca", "cb").alias("root"), F.least("ca", "cb").alias("to")).groupBy("root").agg(F.min("to").alias("to"))
        across = stash(across, f"cc-hook-{i}")
        if across.isEmpty():
            return labels
        two = across.alias("x").join(across.alias("y"), F.expr("x.to = y.root"), "left").select(F.col("x.root").alias("root"), F.coalesce("y.to", "x.to").alias("to"))  # the jump
        labels = stash(labels.join(two, labels["component"] == two["root"], "left").select("node", F.coalesce("to", "component").alias("component")), f"cc-{i + 1}")


class SplitTables:
    """The two tables under ``path``; every update is a version of ``nodes`` and adds to ``groups``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _read(self, name: str) -> DataFrame | None:
        try:
            return self.spark.read.parquet(f"{self.path}/{name}")
        except AnalysisException:  # nothing persisted yet
            return None

    def read(self) -> tuple[DataFrame | None, DataFrame | None, int]:
        """(nodes, groups, version) as last written."""
        nodes = self._read("nodes")
        if nodes is None:
            return None, None, 0
        version = nodes.agg(F.max("version")).first()[0]
        groups = self._read("groups").filter(F.col("version") <= version).drop("version")  # what a failed update left has a later one
        return nodes.filter(F.col("version") == version).drop("version"), groups, version

    def write(self, nodes: DataFrame, new_groups: DataFrame, version: int) -> None:
        """First the groups, then the nodes, whose version makes both valid; what a failed update wrote is written over."""
        for df, name in ((new_groups, "groups"), (nodes, "nodes")):
            df.write.mode("overwrite").parquet(f"{self.path}/{name}/version={version}")


def assign_splits(rows: DataFrame, shares: DataFrame, nodes: DataFrame | None = None, groups: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(rows with ``component`` and ``split``, nodes, new groups, report) of ``rows`` with ``listed``, ``passage_id`` and ``row``, a unique text."""
    spark = rows.sparkSession
    g = F.col("passage_id").cast("string")
    own = F.coalesce(F.col("listed"), F.concat(F.lit("group:"), g), F.concat(F.lit("row:"), F.col("row")))
    base = rows.select("*", own.alias("e"), g.alias("g"))
    hung = stash(hang_groups(base.filter("g is not null").select("e", "g").distinct(), groups), "split-groups")
    # a row that names no company belongs to what its group hangs on
    placed = base.join(hung.select("g", "anchor", "torn"), "g", "left").withColumn("e", F.coalesce("listed", "anchor", "e"))
    links = placed.select(F.col("e").alias("a"), F.coalesce("anchor", "e").alias("b")).distinct()
    if nodes is not None:
        links = links.union(nodes.select("node", "component"))
    weight = placed.groupBy("e").agg(F.count("*").alias("n"))
    sized = components(links).join(weight, F.col("node") == F.col("e"), "left").select("node", "component", F.coalesce("n", F.lit(0)).alias("n"))
    old = nodes.select("node", F.col("split").alias("old"), F.col("n_rows").alias("before")) if nodes is not None else spark.createDataFrame([], "node string, old string, before long")
    sized = sized.join(old, "node", "left").withColumn("n", F.col("n") + F.coalesce("before", F.lit(0))).drop("before")
    sized = stash(sized, "split-nodes")
    comps = sized.groupBy("component").agg(F.sum("n").alias("n"), F.min("old").alias("first"), F.max("old").alias("last"))
    comps = stash(comps.withColumn("fixed", F.when(F.col("first") != F.col("last"), F.lit(QUARANTINE)).otherwise(F.col("first"))).select("component", "n", "fixed"), "split-components")
    chosen = stash(fill_deficits(comps, shares), "split-chosen")
    new = sized.join(chosen, "component").select("node", "component", F.when(F.col("split") == QUARANTINE, F.coalesce("old", F.lit(QUARANTINE))).otherwise(F.col("split")).alias("split"), F.col("n").cast("long").alias("n_rows"))
    new = stash(new, "split-state")
    where = sized.select(F.col("node").alias("e"), "component", F.coalesce("old", F.lit(QUARANTINE)).alias("old")).join(chosen, "component")
    met = placed.join(where, "e")
    # in a component of several splits: (g, kept) of the groups whose entities, that it hangs on included, are all of one
    doubt = met.filter(F.col("split") == QUARANTINE).select("g", "anchor", "old")
    ends = doubt.select("g", "old").union(doubt.select("g", F.col("anchor").alias("e")).distinct().join(where, "e").select("g", "old"))
    whole = ends.filter("g is not null").groupBy("g").agg(F.min("old").alias("kept"), F.max("old").alias("__m")).filter("kept = __m").select(F.col("g").alias("__g"), "kept")
    kept = F.when(F.col("torn"), F.lit(QUARANTINE)).when(F.col("split") != QUARANTINE, F.col("split")).when(F.col("g").isNull(), F.col("old")).otherwise(F.coalesce("kept", F.lit(QUARANTINE)))
    out = met.join(whole, F.col("g") == F.col("__g"), "left").select(*rows.columns, "component", kept.alias("split"))
    total = new.agg(F.sum("n_rows")).first()[0] or 1
    want = spark.createDataFrame([(r[0], float(r[1])) for r in shares.select("split_name", "share").collect()], "split string, target double")  # a row per split
    report = want.join(new.groupBy("split").agg(F.sum("n_rows").alias("n_rows"), F.count_distinct("component").alias("n_components")), "split", "full").select("split", "target", F.coalesce("n_rows", F.lit(0)).alias("n_rows"), F.coalesce("n_components", F.lit(0)).alias("n_components"), (F.coalesce("n_rows", F.lit(0)) / total).alias("reached"))
    torn = doubt.filter("g is not null").select(F.col("g").alias("__t")).distinct().join(whole, F.col("__t") == F.col("__g"), "left_anti")
    new_groups = hung.filter("new = 1").join(torn, F.col("g") == F.col("__t"), "left").select(F.col("g").alias("group"), "anchor", F.col("__t").isNotNull().alias("torn"))
    return out, new, new_groups, report


def place_sizes(histogram: dict[int, int], lack: dict[str, float]) -> list[tuple[int, str, int, int]]:
    """(size, split, first rank, end rank): components of each size, largest first, each to the split that then lacks most.

    All components of a size are placed at once: filling the largest lack again and again levels the lacks, so each split gets what
    lies above the common level. ``lack`` is updated.
    """
    out = []
    for n in sorted(histogram, reverse=True):
        k, w = histogram[n], max(n, 1)
        taken = dict.fromkeys(lack, 0)
        lo, hi = min(lack.values()) - (k + 1) * w, max(lack.values()) + w
        above = lambda level: {s: max(0, math.ceil((v - level) / w)) for s, v in lack.items()}
        while hi - lo > w / 1e6 and hi - lo > 1e-9 * (abs(hi) + abs(lo)):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if sum(above(mid).values()) > k else (lo, mid)
        taken = above(hi)
        for _ in range(k - sum(taken.values())):  # fewer than there are splits
            taken[max(lack, key=lambda s: (lack[s] - taken[s] * w, s))] += 1
        at = 0
        for s in sorted(taken):
            if taken[s]:
                out.append((n, s, at, at + taken[s]))
                at += taken[s]
                lack[s] -= taken[s] * n
    return out


def fill_deficits(comps: DataFrame, shares: DataFrame, max_broadcast: int = 100_000) -> DataFrame:
    """(component, split): fixed ones stay; new ones, largest first, go where the deficit is largest.

    The driver sees the sizes with their counts only (at most the square root of twice the number of rows); components are joined back by
    their rank among those of the same size.
    """
    spark = comps.sparkSession
    target = {r[0]: float(r[1]) for r in shares.select("split_name", "share").collect()}  # a row per split
    whole = sum(target.values()) or 1.0
    total = comps.agg(F.sum("n")).first()[0] or 0
    have = {r[0]: r[1] for r in comps.filter("fixed is not null").groupBy("fixed").agg(F.sum("n")).collect()}
    lack = {s: p / whole * total - have.get(s, 0) for s, p in target.items()}
    kept = comps.filter("fixed is not null").select("component", F.col("fixed").alias("split"))
    new = comps.filter("fixed is null")
    histogram = {r[0]: r[1] for r in new.groupBy("n").count().collect()}
    if not histogram or not lack:
        return kept.union(new.select("component", F.lit(QUARANTINE)))
    ranges = place_sizes(histogram, lack)
    table = spark.createDataFrame(ranges, "size long, split string, lo long, hi long")
    rank = ranked(new, ["n"], F.xxhash64("component"), ["component"], "rank")
    met = rank.join(F.broadcast(table) if len(ranges) <= max_broadcast else table, F.expr("n = size and rank >= lo and rank < hi"))
    return kept.union(met.select("component", "split"))


def misspelt_tickers(rows: DataFrame, id_col: str) -> DataFrame:
    """(id, ticker) of the ``rows`` (with ``listed``) whose ticker isn't written as in the list, with the listed one."""
    return rows.filter(F.col("listed").isNotNull() & ~F.col("ticker").eqNullSafe(F.col("listed"))).select(id_col, F.col("listed").alias("ticker")).distinct()


def rows_with_splits(rows: DataFrame, companies: DataFrame, shares: DataFrame, id_col: str, path: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows (id, passage_id, ticker, listed, component, split), nodes, report) of one delivery.

    ``path``: the folder of the persisted tables, which are read and then updated; without it the delivery is the first and only one.
    """
    tables = SplitTables(rows.sparkSession, path) if path else None
    nodes, groups, version = tables.read() if tables else (None, None, 0)
    keyed = rows.select(F.col(id_col).alias("row"), F.col("passage_id").cast("string").alias("passage_id"), "ticker", "company").withColumn("row", F.col("row").cast("string"))
    kind = dict(rows.dtypes)[id_col]
    told = stash(tell_companies(keyed, companies, groups), "split-rows")
    out, new, new_groups, report = assign_splits(told, shares, nodes, groups)
    out = stash(out, "split-out")
    if tables:
        tables.write(new, new_groups, version + 1)
    return out.select(F.col("row").cast(kind).alias(id_col), "passage_id", "ticker", "listed", "component", "split"), new, report
