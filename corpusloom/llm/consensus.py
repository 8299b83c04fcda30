"""Problem 1: consensus from several annotators' labels.

Per task, a regularised item-feature classifier (softmax regression on hashed words and word pairs of the passage)
and one confusion matrix per annotator are fitted together by expectation-maximisation: the classifier's
output is the prior of an item's label, the confusion matrices turn votes into likelihoods, and the posterior
labels refit both. Votes, posteriors and confusion counts cover all items and stay on the cluster; the
driver holds the matrices (annotators x labels x labels, checked) and a bounded sample of items for the classifier.

Defined results: a vote needs status ``done``, an annotator and a label of the scheme, else it is left out; of several
votes of one annotator on an item the latest counts (null time first, then the larger row id); null passages are left
out; a null text has no features; equal posteriors give the label that comes first in the scheme; no votes, no rows.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, stash
from .text_form import consistent

# The schemes and the short codes of the labels.
SCHEMES = {"sentiment": ("positive", "negative", "neutral"), "guidance": ("positive", "negative", "neutral", "conditional", "none")}
COLUMNS = {"sentiment": "sentiment_label", "guidance": "guidance_type"}
CODES = {"p": "positive", "n": "negative", "u": "neutral", "c": "conditional"}
DIMS, FIT_ITEMS, ROUNDS, WARM_UP, STEPS, PENALTY = 1 << 12, 15_000, 9, 3, 12, 0.5
_TOKEN = re.compile(r"[^\W\d_]+")


def tidy(c: F.Column) -> F.Column:
    return F.lower(F.regexp_replace(c, r"(?U)^[\s​﻿]+|[\s​﻿]+$", ""))


def valid_votes(queue: DataFrame) -> DataFrame:
    """(passage_id, task, annotator, label): the latest valid vote of each annotator."""
    done = queue.filter(tidy(F.col("annotation_status")) == "done").select("row_id", "passage_id", tidy(F.col("annotator")).alias("annotator"), "annotated_at", *COLUMNS.values())
    done = done.filter("passage_id is not null and annotator <> ''")
    codes = F.create_map(*[F.lit(x) for kv in CODES.items() for x in kv])
    both = done.select("row_id", "passage_id", "annotator", "annotated_at", F.explode(F.array(*[F.struct(F.lit(t).alias("task"), tidy(F.col(c)).alias("raw")) for t, c in COLUMNS.items()])).alias("v"))
    both = both.select("row_id", "passage_id", "annotator", "annotated_at", "v.task", F.coalesce(codes[F.col("v.raw")], F.col("v.raw")).alias("label"))
    scheme = F.lit(False)
    for t, labels in SCHEMES.items():
        scheme = scheme | ((F.col("task") == t) & F.col("label").isin(*labels))
    order = F.struct(F.coalesce(F.col("annotated_at").cast("timestamp_ntz"), F.lit("0001-01-01").cast("timestamp_ntz")), "row_id")
    return both.filter(scheme).groupBy("passage_id", "task", "annotator").agg(F.max_by("label", order).alias("label"))


def features_of(text: str | None, dims: int = DIMS) -> list[int]:
    """Sorted distinct buckets of the words and word pairs of a text."""
    words = _TOKEN.findall(consistent(text).lower()) if text else []
    keys = {zlib.crc32(w.encode()) % dims for w in words}
    keys |= {zlib.crc32(f"{a} {b}".encode()) % dims for a, b in zip(words, words[1:])}
    return sorted(keys)


def build_items(queue: DataFrame, votes: DataFrame, number: DataFrame) -> DataFrame:
    """(passage_id, task, half, feats, ann, lab), one row per passage and task."""
    labels = F.create_map(*[F.lit(x) for t, ls in SCHEMES.items() for i, l in enumerate(ls) for x in (f"{t}/{l}", i)])
    coded = votes.join(number, "annotator").select("passage_id", "task", F.struct("a", labels[F.concat_ws("/", "task", "label")].alias("l")).alias("v"))
    items = coded.groupBy("passage_id", "task").agg(F.sort_array(F.collect_list("v")).alias("v"))  # at most one vote per annotator
    texts = queue.filter("passage_id is not null").groupBy("passage_id").agg(F.min_by("text", "row_id").alias("text"))

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        f = [features_of(t) for t in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(f, pa.list_(pa.int32()))], names=["passage_id", "feats"])

    feats = map_arrow(texts.select("passage_id", "text"), fn, "passage_id string, feats array<int>")
    return items.join(feats, "passage_id").select("passage_id", "task", F.pmod(F.xxhash64("passage_id", F.lit(5)), F.lit(2)).alias("half"), "feats", F.col("v.a").alias("ann"), F.col("v.l").alias("lab"))


class Model:
    """Confusion matrices (log) and classifier weights of one task.

    Items are in two halves, and the prior of an item comes from the classifier of the other half: an item's own votes
    never come back to it as a prior.
    """

    def __init__(self, n_annotators: int, k: int, dims: int):
        self.k = k
        near = np.full((k, k), 0.3 / max(1, k - 1)) + np.eye(k) * (0.7 - 0.3 / max(1, k - 1))
        self.conf = np.log(np.tile(near, (n_annotators, 1, 1)))
        self.w = np.zeros((2, dims + 1, k))

    def scores(self, half: np.ndarray, item: np.ndarray, feat: np.ndarray) -> np.ndarray:
        """Log priors, n x k, by the weights numbered ``half``; features are scaled to unit length."""
        n = len(half)
        scale = 1 / np.sqrt(np.maximum(1, np.bincount(item, minlength=n)))
        z = self.w[half, -1]
        for c in range(self.k):
            z[:, c] += scale * np.bincount(item, self.w[half[item], feat, c], n)
        return z - np.logaddexp.reduce(z, axis=1, keepdims=True)

    def posterior(self, half: np.ndarray, item: np.ndarray, feat: np.ndarray, vote_item: np.ndarray, ann: np.ndarray, lab: np.ndarray) -> np.ndarray:
        """n x k; ``half`` is the half each item is in, ``item`` tells the item of each feature, ``vote_item`` of each vote."""
        z = self.scores(1 - half, item, feat)
        like = self.conf[ann, :, lab]
        for c in range(self.k):
            z[:, c] += np.bincount(vote_item, like[:, c], len(half))
        return np.exp(z - np.logaddexp.reduce(z, axis=1, keepdims=True))

    def set_confusion(self, counts: np.ndarray, strength: float = 3.0) -> None:
        """Counts (annotators x true x given) with a prior that leans to the diagonal."""
        k = self.k
        prior = (np.full((k, k), 0.35 / max(1, k - 1)) + np.eye(k) * (0.65 - 0.35 / max(1, k - 1))) * strength
        c = counts + prior
        self.conf = np.log(c / c.sum(axis=2, keepdims=True))

    def fit(self, half: np.ndarray, item: np.ndarray, feat: np.ndarray, q: np.ndarray, steps: int, penalty: float) -> None:
        """Accelerated steps on the penalised likelihood of the soft labels ``q``, each half by itself.

        With features of unit length, half the number of items with a feature bounds its curvature, which sets its step.
        """
        d = self.w.shape[1] - 1
        n = len(half)
        scale = 1 / np.sqrt(np.maximum(1, np.bincount(item, minlength=n)))
        bound = np.stack([0.5 * np.bincount(feat[half[item] == h], minlength=d) + penalty for h in (0, 1)])
        ahead, t = self.w.copy(), 1.0
        for _ in range(steps):
            old, self.w = self.w, ahead
            r = np.exp(self.scores(half, item, feat)) - q
            new = ahead.copy()
            for h in (0, 1):
                mine, f = half == h, half[item] == h
                if not mine.any():
                    continue
                new[h, -1] -= r[mine].sum(axis=0) / (0.5 * mine.sum())
                for c in range(self.k):
                    g = np.bincount(feat[f], (r[:, c] * scale)[item[f]], d) + penalty * ahead[h, :-1, c]
                    new[h, :-1, c] -= g / bound[h]
            t_new = (1 + (1 + 4 * t * t) ** 0.5) / 2
            self.w, ahead, t = new, new + (t - 1) / t_new * (new - old), t_new


def _flat(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """(row of each value, value) of a column of lists."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks() if lists.num_chunks != 1 else lists.chunk(0)
    sizes = np.diff(lists.offsets.to_numpy())
    return np.repeat(np.arange(len(lists)), sizes), lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)


def _data(part) -> tuple[np.ndarray, ...]:
    """half, item, feat, vote_item, ann, lab of a batch or table of items."""
    item, feat = _flat(part.column("feats"))
    vote_item, ann = _flat(part.column("ann"))
    return part.column("half").to_numpy(), item, feat, vote_item, ann, _flat(part.column("lab"))[1]


def _arrays(batch: pa.RecordBatch, at: list[int]):
    part = batch.take(pa.array(at))
    return part, _data(part)


def fit_consensus(queue: DataFrame, rounds: int = ROUNDS, fit_items: int = FIT_ITEMS, max_annotators: int = 200_000, tol: float = 1e-4):
    """(items, models, names): the stashed items, a Model per task and the annotators in order of their numbers."""
    spark = queue.sparkSession
    votes = stash(valid_votes(queue), "votes")
    names = sorted(r[0] for r in votes.select("annotator").distinct().limit(max_annotators + 1).collect())
    if len(names) > max_annotators:
        raise ValueError(f"more than max_annotators={max_annotators} annotators")
    number = spark.createDataFrame(list(zip(names, range(len(names)))), "annotator string, a int")
    items = stash(build_items(queue, votes, number), "items")
    models = {t: Model(len(names), len(ls), DIMS) for t, ls in SCHEMES.items()}
    samples = {}
    for t in SCHEMES:
        mine = items.filter(F.col("task") == t).withColumn("h", F.xxhash64("passage_id"))
        low = mine.select("h").orderBy("h").limit(fit_items).agg(F.max("h")).first()[0]  # only hashes are sorted
        samples[t] = _data(mine.filter(F.col("h") <= F.lit(low)).select("half", "feats", "ann", "lab").toArrow())
    for i in range(rounds):
        for t, model in models.items():
            if len(samples[t][0]) and i >= WARM_UP:
                model.fit(*samples[t][:3], model.posterior(*samples[t]), STEPS, PENALTY)
        counts = _confusion_counts(items, models)
        moved = 0.0
        for t, model in models.items():
            old = model.conf
            model.set_confusion(counts[t])
            moved = max(moved, float(np.abs(np.exp(old) - np.exp(model.conf)).max(initial=0.0)))
        if moved < tol and i > WARM_UP:
            break
    return items, models, names


def _confusion_counts(items: DataFrame, models: dict[str, Model]) -> dict[str, np.ndarray]:
    """Expected counts, annotators x true x given, per task; summed on the cluster."""
    shared = items.sparkSession.sparkContext.broadcast(models)

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: list[list] = [[], [], [], [], []]
        tasks = batch.column("task").to_pylist()
        for t, model in shared.value.items():
            at = [i for i, x in enumerate(tasks) if x == t]
            if not at:
                continue
            _, data = _arrays(batch, at)
            vi, ann, lab = data[3:]
            q = model.posterior(*data)
            k = model.k
            for c in range(k):
                sums = np.bincount(ann * k + lab, q[vi, c], len(model.conf) * k)
                for cell in np.nonzero(sums)[0]:
                    for col, v in zip(out, (t, int(cell) // k, c, int(cell) % k, float(sums[cell]))):
                        col.append(v)
        kinds = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.float64()]
        return pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(out, kinds)], names=["task", "a", "k", "l", "x"])

    sums = map_arrow(items, fn, "task string, a int, k int, l int, x double").groupBy("task", "a", "k", "l").agg(F.sum("x").alias("x")).toArrow()  # annotators x labels x labels
    names, cells = np.array(sums.column("task").to_pylist()), [sums.column(c).to_numpy() for c in ("a", "k", "l", "x")]
    found = {}
    for t, model in models.items():
        found[t] = np.zeros(model.conf.shape)
        a, k, l, x = (c[names == t] for c in cells)
        found[t][a, k, l] = x
    return found


def consensus(queue: DataFrame, min_annotators: int = 3, **fit) -> tuple[DataFrame, DataFrame]:
    """(labels, annotators).

    labels: (passage_id, task, label, n_votes, confidence, agreement), agreement being the share of votes for the label.
    annotators: (annotator, task, n_votes, accuracy, information), accuracy being the expected share of right
    votes and information the mutual information of vote and true label over the entropy of the true label.
    """
    spark = queue.sparkSession
    items, models, names = fit_consensus(queue, **fit)
    shared = spark.sparkContext.broadcast(models)

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: list[list] = [[] for _ in range(6)]
        tasks = batch.column("task").to_pylist()
        for t, model in shared.value.items():
            at = [i for i, x in enumerate(tasks) if x == t]
            if not at:
                continue
            part, data = _arrays(batch, at)
            vi, lab = data[3], data[5]
            q = model.posterior(*data)
            best = q.argmax(axis=1)
            n = np.bincount(vi, minlength=len(at))
            same = np.bincount(vi, (lab == best[vi]).astype(float), len(at))
            for col, v in zip(out, (part.column("passage_id").to_pylist(), [t] * len(at), [SCHEMES[t][b] for b in best], n.tolist(), q.max(axis=1).tolist(), (same / np.maximum(n, 1)).tolist())):
                col.extend(v)
        kinds = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.float64(), pa.float64()]
        return pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(out, kinds)], names=["passage_id", "task", "label", "n_votes", "confidence", "agreement"])

    labels = map_arrow(items, fn, "passage_id string, task string, label string, n_votes int, confidence double, agreement double").filter(F.col("n_votes") >= min_annotators)
    rows = []
    for t, c in _confusion_counts(items, models).items():
        if not c.sum():
            continue
        share = c.sum(axis=(0, 2)) / max(c.sum(), 1e-12)
        for a, name in enumerate(names):
            p = np.exp(models[t].conf[a])
            joint = share[:, None] * p
            given = joint.sum(axis=0)
            h = -(share * np.log(np.maximum(share, 1e-12))).sum()
            mi = (joint * (np.log(np.maximum(p, 1e-12)) - np.log(np.maximum(given, 1e-12)))).sum()
            rows.append((name, t, float(c[a].sum()), float((share * np.diag(p)).sum()), float(mi / h) if h > 0 else 0.0))
    return labels, spark.createDataFrame(rows, "annotator string, task string, n_votes double, accuracy double, information double")
