"""UDF and EVL: model scoring as a plug-in, with an offline lexicon scorer."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..functions.text import FORWARD_WORDS, fill_prompt, repair_json

Scorer = Callable[[str], str]
# Fixed values of the offline scorer.
UP = ("growth", "increase", "improved", "strong", "record", "advanced", "rise", "exceeded", "recovered", "better")
DOWN = ("decline", "decrease", "weak", "loss", "drop", "shortfall", "missed", "slipped", "pressure", "deteriorated")
ANSWER = "sentiment string, intensity string, guidance boolean, guidance_type string, key_phrase string, rationale string, confidence double, spans array<string>"


def lexicon_scorer(prompt: str) -> str:
    """A deterministic answer as JSON, from counts of words."""
    low = prompt.lower()
    up, down = sum(low.count(w) for w in UP), sum(low.count(w) for w in DOWN)
    guide = any(w in low for w in FORWARD_WORDS)
    label = "positive" if up > down else "negative" if down > up else "neutral"
    return json.dumps({"sentiment": label, "intensity": "strong" if abs(up - down) > 3 else "moderate" if up != down else "mild", "guidance": guide, "guidance_type": label if guide else "none", "key_phrase": "", "rationale": "word counts", "confidence": 0.5, "spans": []})


def score(rows: DataFrame, prompt: str, scorers: dict[str, Scorer], attempts: int = 3, keep: list[str] | None = None) -> DataFrame:
    """EVL-02, UDF-02: ``prompt`` of every row answered by every model: model, raw, error, attempts.

    An answer after a failed attempt has no error. Models are a short list, so they are exploded beside each row.
    """
    keep = keep or [c for c in rows.columns if c != prompt]
    base = rows.select(*keep, F.col(prompt).alias("__p"), F.explode(F.array(*[F.lit(m) for m in scorers])).alias("model"))
    schema = StructType([StructField(f.name, f.dataType) for f in base.drop("__p").schema]).add("raw", "string").add("error", "string").add("attempts", "integer")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            raw, errors, tries = [], [], []
            for p, m in zip(b["__p"], b["model"]):
                answer, error, k = None, None, 0
                while answer is None and k < attempts:
                    k += 1
                    try:
                        answer, error = scorers[m](p or ""), None
                    except Exception as e:  # noqa: BLE001
                        error = str(e)[:500]
                raw.append(answer)
                errors.append(error)
                tries.append(k)
            yield b.drop(columns="__p").assign(raw=raw, error=errors, attempts=tries)

    return base.mapInPandas(run, schema)


def unanswered(rows: DataFrame, answers: DataFrame, models: list[str], item: str = "item") -> DataFrame:
    """EVL-01: ``rows`` beside each model that has not answered them yet."""
    wanted = rows.withColumn("model", F.explode(F.array(*[F.lit(m) for m in models])))
    return wanted.join(answers.select(item, "model").distinct(), [item, "model"], "left_anti")


# The prompts by key with task and number of examples.
PROMPTS = (
    ("sentiment_0shot", "sentiment", 0), ("sentiment_3shot", "sentiment", 3), ("sentiment_5shot", "sentiment", 5),
    ("guidance_0shot", "guidance", 0), ("guidance_3shot", "guidance", 3),
    ("combined_0shot", "combined", 0), ("combined_5shot", "combined", 5),
)
_ASKED = {
    "sentiment": "Give the sentiment and its intensity",
    "guidance": "Say whether the passage gives guidance, and of which type",
    "combined": "Give the sentiment, its intensity, and the guidance with its type",
}
_SHOWN = ("Revenue rose and margins widened. -> positive", "Costs outran sales. -> negative", "The board met twice. -> neutral", "We expect growth if rates fall. -> conditional", "Output will double next year. -> positive")


def prompt_table(spark: SparkSession) -> DataFrame:
    """TXT-16: (prompt_key, task, shots, template); a template ends in JSON braces and the passage."""
    shown = lambda n: "".join(f"Example: {x}\n" for x in _SHOWN[:n])
    rows = [(k, t, n, f'{shown(n)}{_ASKED[t]} of the passage, as JSON like {{{{"{t}": ""}}}}.\nPassage: {{passage}}') for k, t, n in PROMPTS]
    return spark.createDataFrame(rows, "prompt_key string, task string, shots int, template string")


def get_prompts(rows: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """TXT-16: every row beside each filled prompt; an unknown key is an error."""
    known = [k for k, _, _ in PROMPTS]
    if unknown := [k for k in keys if k not in known]:
        raise ValueError(f"unknown prompts {unknown}; there are {known}")
    table = prompt_table(rows.sparkSession).filter(F.col("prompt_key").isin(*keys))
    return rows.crossJoin(F.broadcast(table)).withColumn("prompt", fill_prompt(F.col("template"), F.col(text))).drop("template")  # seven rows


def evaluation_rows(gold: DataFrame | None, queue: DataFrame, n: int | None = None, seed: int = 42, key: str = "row_id") -> DataFrame:
    """SRC-10: the gold standard, else passages of good or acceptable quality; on request a sample by the order of a seeded hash."""
    rows = gold if gold is not None and not gold.isEmpty() else queue.filter(F.col("quality").isin("good", "acceptable"))
    return rows if n is None else sample(rows, n, seed, key)


def flatten(answers: DataFrame) -> DataFrame:
    """EVL-03: the answer's fields as columns, defaults where it has none."""
    parsed = answers.withColumn("__a", repair_json(F.col("raw"), ANSWER))
    a = lambda f, d: F.coalesce(F.col(f"__a.{f}"), F.lit(d)).alias(f"pred_{f}")
    return parsed.select(*[c for c in answers.columns], a("sentiment", ""), a("intensity", ""), F.initcap(F.coalesce(F.col("__a.guidance"), F.lit(False)).cast("string")).alias("pred_guidance"), a("guidance_type", "none"), a("key_phrase", ""), a("rationale", ""), a("confidence", 0.0), F.to_json(F.coalesce("__a.spans", F.array().cast("array<string>"))).alias("pred_spans"))


def prompts(rows: DataFrame, template: str, text: str = "text") -> DataFrame:
    return rows.withColumn("prompt", fill_prompt(F.lit(template), F.col(text)))


def resolve_prompt(keys: dict[str, int], task: str, shots: int) -> str:
    """TXT-17: the prompt of a task with that many examples, else the one with the fewest."""
    name = f"{task}_{shots}shot"
    if name in keys:
        return name
    same = sorted((n, k) for k, n in keys.items() if k.startswith(f"{task}_"))
    if not same:
        raise KeyError(f"no prompt for {task}")
    return same[0][1]


def sample(rows: DataFrame, n: int, seed: int, key: str) -> DataFrame:
    """SRC-10: n rows by the order of a seeded hash; the same at any number of partitions."""
    return rows.orderBy(F.xxhash64(F.lit(seed), key), key).limit(n)
