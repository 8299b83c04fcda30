"""Text functions and passages on hand-made texts."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import passages as P


def one(spark, text, f):
    return spark.createDataFrame([(text,)], "t string").select(f(F.col("t")).alias("x")).first()["x"]


@pytest.mark.parametrize("text, kept", [("12\nA line", "A line"), ("Page 3 of 120\nx", "x"), ("ZENON BANK PLC\nx", "x"), ("| 7 |\nx", "x"), ("page 3 of nothing\nx", "page 3 of nothing\nx"), ("  kept  \n", "  kept  \n"), ("Something / Annual Report 2023\nx", "x")])
def test_noise_lines(spark, text, kept):
    assert one(spark, text, T.drop_noise_lines) == kept


def test_artifacts_and_currency(spark):
    assert one(spark, "strat-\negy a    b\n\n\n\nc || d....... e____f", T.repair_artifacts) == "strategy a  b\n\nc   d  e f"
    assert one(spark, "N'000 and n'million of naira, nairas", T.currency_words) == "(NGN thousands) and (NGN million) of NGN, nairas"


def test_paragraphs_join_lower_case(spark):
    assert one(spark, "One\ntwo\n\n \nthree\n\nFour", T.paragraphs) == "One two three\n\nFour"


@pytest.mark.parametrize("n, kind", [(0, "empty"), (199, "too_short"), (200, "poor"), (40_001, "truncated")])
def test_section_lengths(spark, n, kind):
    row = T.clean_sections(spark.createDataFrame([("x" * n,)], "text string")).first()
    assert row["quality"] == kind and row["char_count"] == n
    if kind == "truncated":
        assert row["text"].endswith("\n[TRUNCATED]")


def test_unicode_form(spark):
    assert one(spark, "ﬁrst ₦5 “q” a—b c", T.plain_characters) == 'first NGN5 "q" a - b c'


def test_words_split_at_any_space(spark):
    assert one(spark, "a b c d", T.n_words) == 4


def test_section_between_headings(spark):
    text = "Front\nChairman's Statement\nWe did well and this line is long enough to pass the header.\nChief Executive\nMore"
    df = spark.createDataFrame([(text,), ("nothing here",), (None,)], "t string")
    a, b, c = [r["x"] for r in df.select(T.section(F.col("t"), "chairman_statement").alias("x")).collect()]
    assert a.startswith("Chairman's Statement\nWe did") and a.endswith("header.") and b == "" and c == ""


def test_json(spark):
    assert one(spark, 'Sure:\n```json\n{"k": 4}\n```', lambda c: T.repair_json(c, "k int")["k"]) == 4
    assert one(spark, "no json", lambda c: T.repair_json(c, "k int")) is None


def brute_chunks(p):
    if len(p.split()) <= P.LONG_WORDS:
        return [p]
    out, cur = [], ""
    for s in re.split(r"(?<=[.!?])\s+", p):
        cur = (cur + " " + s).strip() if cur else s
        if len(cur.split()) >= P.PACK_WORDS:
            out.append(cur)
            cur = ""
    return out + ([cur] if cur else [])


@pytest.mark.parametrize("n", [10, 400, 401, 1000])
def test_chunks_as_by_hand(spark, n):
    p = " ".join(f"w{i}." if i % 17 == 0 else f"w{i}" for i in range(n))
    assert one(spark, p, P.chunks) == brute_chunks(p)


def test_short_paragraph_takes_the_next_and_numeric_ones_go(spark):
    short, long = "alpha " * 79, "beta " * 90
    numbers = "12 " * 11 + "word " * 29
    rows = [("d", "T", "2024", "outlook", "\n".join([short, long, numbers]), "good"), ("e", "T", None, "governance", long, "good"), ("f", "T", None, "outlook", long, "poor")]
    df = spark.createDataFrame(rows, "doc_id string, ticker string, year string, section string, text string, quality string")
    got = {r["passage_id"]: r for r in P.extract_passages(df).collect()}
    assert set(got) == {"T_2024_outlook_0_0", "T_2024_outlook_1_0"}
    assert got["T_2024_outlook_0_0"]["word_count"] == 169


def test_preserve(spark):
    cols = "row_id int, passage_id string, label string, annotation_status string"
    old = spark.createDataFrame([(1, "a", "x", "done"), (2, "a", "y", "skipped"), (3, "a", "z", "pending"), (4, "b", None, "done")], cols)
    new = spark.createDataFrame([(9, "a", None, "pending"), (8, "b", "keep", "pending"), (7, "c", None, "pending")], cols)
    got = {r["passage_id"]: (r["label"], r["annotation_status"]) for r in P.preserve_annotations(new, old, "passage_id", ["label", "annotation_status"], "row_id").collect()}
    assert got == {"a": ("y", "skipped"), "b": ("keep", "done"), "c": (None, "pending")}
