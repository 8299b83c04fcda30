"""Problems 3, 5, 6, 8 and 9 against plain versions and on odd input."""

from __future__ import annotations

import random
import re
import unicodedata
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusloom.llm import leakage, packing, site_lines, splitting, text_form

# --- 3 ---


@pytest.mark.parametrize(
    "a, b",
    [("ｆｕｌｌ　１", "full 1"), ("café", "café"), ("con​sent", "consent"), ("a b c", "a b c"), ("Οn thе", "On the"), ("ﬁrst", "first"), ("long‑term", "long-term"), ("soft­ware", "software"), ("о́", "ó"), ("e​́", "é")],
)
def test_same_look(a, b):
    assert text_form.consistent(a) == b == text_form.consistent(b)


@pytest.mark.parametrize("a, b", [("a b", "a  b"), ("A", "a"), ("café", "cafe"), ("x²", "x2"), ("1", "l"), ("a\nb", "a b"), ("a–b", "a-b"), ("“a”", '"a"')])
def test_other_look(a, b):
    assert text_form.consistent(a) != text_form.consistent(b)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from("aeoA0 \n-éо́̀​ ｅﬁ—"), max_size=30))
def test_form_is_stable_and_as_by_whole_text(t):
    f = text_form.consistent(t)
    assert text_form.consistent(f) == f
    whole = unicodedata.normalize("NFC", "".join(text_form.MAPPING.get(c, c) for c in t))
    assert unicodedata.normalize("NFC", f) == whole


def test_mapping_conflicts_are_found(monkeypatch):
    monkeypatch.setitem(text_form.LOOK_ALIKES, "​", "x")
    with pytest.raises(ValueError):
        text_form.build_mapping()


def test_clusters_are_in_the_mapping(monkeypatch):
    e = "e\u0301"
    assert text_form.MAPPING[e] == text_form.MAPPING["\u0435\u0301"] == "\u00e9" and text_form._longest(e + "x", 0) == (2, "\u00e9")
    assert text_form._longest("e\u200b\u0301", 0) == (3, "\u00e9") and text_form.MAPPING["\u00e2\u0301"] == "\u1ea5"
    monkeypatch.setitem(text_form.LOOK_ALIKES, e, "x")
    with pytest.raises(ValueError):
        text_form.build_mapping()


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from("aeAсоｅй\u00e2\u1ea5\u0301\u0302\u0323\u0327\u200b\u00ad ﬁ\u212bか\u3099"), max_size=12))
def test_longest_match_gives_composed_clusters(t):
    parts = re.findall(r"(?s).(?:[\u0300-\u036f\u3099]|[\u200b\u00ad])*", t)
    assert text_form.consistent(t) == "".join(unicodedata.normalize("NFC", "".join(text_form.MAPPING.get(c, c) for c in p)) for p in parts)


def test_look_alike_pairs(spark):
    rows = [(1, "café", "k"), (2, "café", "k"), (3, "café", "k"), (4, "cafe", "k"), (5, None, None), (6, "", None), (7, "", None), (7, "", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, form string")
    assert sorted(map(tuple, text_form.look_alike_pairs(df, "doc_id").collect())) == [(1, 2), (2, 3)]
    assert text_form.look_alike_pairs(df.limit(0), "doc_id").count() == 0
    many = spark.createDataFrame([(i, "caf\u00e9" if i % 3 else "cafe\u0301") for i in range(30)], "doc_id long, text string")
    want = sorted((a, b) for a in range(30) for b in range(a + 1, 30) if (a % 3 == 0) != (b % 3 == 0))
    assert sorted(map(tuple, text_form.look_alike_pairs(many, "doc_id", per_part=4).collect())) == want
    classes = text_form.look_alike_classes(many, "doc_id")
    assert classes.count() == 30 and classes.select("form").distinct().count() == 1 and classes.select("raw").distinct().count() == 2
    out = text_form.to_consistent(df.withColumnRenamed("form", "raw"))
    assert out.columns == ["doc_id", "text", "raw"] and out.filter("text = 'café'").count() == 3 and out.filter("text is null").count() == 1


# --- 5 ---


def test_site_lines_as_by_hand(spark, monkeypatch):
    rnd = random.Random(1)
    rows = []
    for i in range(40):
        tk = rnd.choice(["A", "A", "A", "B", None])
        lines = [f"Body {''.join(rnd.choice('abcdefgh') for _ in range(9))} {i}"]
        if rnd.random() < 0.6:
            lines.insert(0, rnd.choice(["Follow US: 12 readers", "follow us - 7 READERS!", "  Follow us 3 readers"]))
        if rnd.random() < 0.1:
            lines.append("rare line")
        rows.append((i, tk, "\n".join(lines), "x"))
    rows += [(100, "C", None, "x"), (101, "C", "", "x"), (102, "C", "123\n456", "x"), (103, "C", "123", "x"), (104, "C", "123", "x")]
    df = spark.createDataFrame(rows, "doc_id long, ticker string, text string, key string")
    seen, docs = defaultdict(set), defaultdict(set)
    key = lambda l: re.sub(r"[\W\d_]+", "", l.lower())
    for i, tk, t, _ in rows:
        if tk and t is not None:
            docs[tk].add(i)
            for l in t.split("\n"):
                if key(l):
                    seen[tk, key(l)].add(i)
    bad = {k for k, v in seen.items() if len(v) >= 3 and len(v) >= 0.2 * len(docs[k[0]])}
    want = sorted((i, n) for i, tk, t, _ in rows if tk and t for n, l in enumerate(t.split("\n")) if (tk, key(l)) in bad)
    assert want
    assert sorted(map(tuple, site_lines.repeated_occurrences(df, "doc_id", "ticker", None).collect())) == want
    clean = {r["doc_id"]: r["text"] for r in site_lines.remove_site_lines(df, "doc_id", "ticker", None).collect()}
    for i, tk, t, _ in rows:
        gone = {n for d, n in want if d == i}
        assert clean[i] == (t if t is None else "\n".join(l for n, l in enumerate(t.split("\n")) if n not in gone))
    assert site_lines.repeated_occurrences(df.limit(0), "doc_id", "ticker", None).count() == 0
    monkeypatch.setattr(site_lines, "MAX_BROADCAST", 0)
    assert sorted(map(tuple, site_lines.repeated_occurrences(df, "doc_id", "ticker", None).collect())) == want
    assert {r["doc_id"]: r["text"] for r in site_lines.remove_site_lines(df, "doc_id", "ticker", None).collect()} == clean


def test_republished_article_is_no_boilerplate(spark):
    rows = [(i, "A", "same article\nsecond line") for i in range(4)] + [(9, "A", "another")]
    df = spark.createDataFrame(rows, "doc_id long, ticker string, text string")
    assert site_lines.remove_site_lines(df, "doc_id", "ticker", None).filter("text like 'same%second line'").count() == 4


@pytest.mark.parametrize("days, kept", [(("2024-01-01",) * 3, True), (("2024-01-01", "2024-01-02", "2024-01-02"), False), ((None, "2024-01-01", "2024-01-01"), False), ((None,) * 3, False)])
def test_changed_copies_of_one_date_are_no_boilerplate(spark, days, kept):
    rows = [(i, "A", d, f"same article\nword {w}") for i, (d, w) in enumerate(zip(days, "abc"))] + [(9, "A", "2024-02-01", "another")]
    df = spark.createDataFrame(rows, "doc_id long, ticker string, day string, text string")
    assert site_lines.remove_site_lines(df, "doc_id", "ticker", "day").filter("text like 'same article%'").count() == 3 * kept
    assert site_lines.repeated_occurrences(df, "doc_id", "ticker", "day").count() == 3  # by documents


# --- 6 ---


def slow_max(values, lo, hi):
    return max(range(lo, hi + 1), key=lambda i: (values[i], i))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 5), min_size=1, max_size=60), st.data())
def test_range_max(values, data):
    lo = data.draw(st.integers(0, len(values) - 1))
    hi = data.draw(st.integers(lo, len(values) - 1))
    assert splitting.RangeMax(np.array(values)).query(lo, hi) == slow_max(values, lo, hi)


@pytest.mark.parametrize("n", [1, 400, 401, 780, 5000])
def test_pieces_cover_the_text(n):
    rnd = random.Random(n)
    text = "".join(f"w{i}" + rnd.choice([" ", " ", ". ", "\n", "\n\n", " ", ", "]) for i in range(n)).strip()
    words = text.split()
    got = splitting.pieces_of(text)
    assert got[0][0] == 0 and got[-1][1] == n
    for (a, b, s), nxt in zip(got, [*got[1:], None]):
        assert s.split() == words[a:b] and b - a <= 400 and s in text
        if nxt:
            assert b - nxt[0] == 40 and nxt[1] > b


def test_cut_at_the_strongest_boundary():
    words = [f"w{i}" for i in range(500)]
    words[299] += "."
    text = " ".join(words[:300]).capitalize() + " " + "W300 " + " ".join(words[301:])
    assert splitting.pieces_of(text)[0][1] == 300
    assert splitting.pieces_of(" ".join(f"w{i}" for i in range(500)))[0][1] == 400


def test_split_frame(spark):
    rows = [(1, "a " * 401, 3), (2, " a b ", 4), (3, None, 5), (4, "  \n", 6), (1, "a " * 401, 3)]
    df = spark.createDataFrame(rows, "row_id long, text string, piece int")
    got = sorted((r["row_id"], r["piece"], r["n_pieces"], r["n_words"]) for r in splitting.split_oversized(df, "row_id").collect())
    assert got == [(1, 0, 2, 400), (1, 0, 2, 400), (1, 1, 2, 41), (1, 1, 2, 41), (2, 0, 1, 2)]
    assert [r[0] for r in splitting.oversized(df, "row_id").collect()] == [1]
    assert splitting.oversized(df.limit(0), "row_id").count() == 0


# --- 8 ---


@pytest.mark.parametrize("text", ["a  b", " lead", "trail ", "it's 12 naïve\n\n things", "", "x\t y\n z", "²½ Ⅷ", "a\x1cb", "   "])
def test_chunked_count_is_exact(text):
    c = packing.Counter(packing.DEFAULT_VOCABULARY)
    assert c.count(text) == len(c.encoding.encode_ordinary(text))


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 50), st.integers(1, 40), max_size=20))
def test_packing_places_all_within_capacity(hist):
    ranges, used = packing.shortest_pack_first(hist, 50)
    room, placed = defaultdict(int), defaultdict(set)
    for length, rank, count, first in ranges:
        for i in range(count):
            assert rank + i not in placed[length]
            placed[length].add(rank + i)
            room[first + i] += length
    assert {k: len(v) for k, v in placed.items()} == hist
    assert all(v <= 50 for v in room.values()) and set(room) == set(range(used))


def test_pack_frame(spark):
    rows = [(i, "word " * (50 + i % 40), "x") for i in range(80)] + [(900, "word " * 700, "x"), (901, None, "x"), (902, "", "x"), (5, "word " * 55, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, container string")
    out = packing.pack(df, "doc_id", capacity=256).collect()
    load = defaultdict(int)
    for r in out:
        load[r["container"]] += r["length"]
        assert r["length"] <= 256
    assert max(load.values()) <= 256 and len(load) <= 1.25 * -(-sum(load.values()) // 256) + 1  # the bound of worst fit, longest first
    assert {r["doc_id"] for r in out if r["n_pieces"] > 1} == {900}
    big = sorted((r["first_token"], r["length"]) for r in out if r["doc_id"] == 900)
    assert sum(n for _, n in big) == 701 and big[0] == (0, 256)
    assert packing.pack(df.limit(0), "doc_id").count() == 0
    assert sorted(map(tuple, packing.pack(df, "doc_id", capacity=256, max_ranges=2).collect())) == sorted(map(tuple, out))


# --- 9 ---


def test_leaks(spark):
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(6))
    items = [[word() for _ in range(80)] for _ in range(6)]
    fill = lambda n: " ".join(word() for _ in range(n))
    changed = list(items[2][10:60])
    for k in (12, 30, 45):
        changed[k] = "other"
    tooMany = list(items[3][:40])
    for k in range(4, 40, 6):
        tooMany[k] = "other"
    added = items[4][:20] + ["more"] + items[4][20:45]
    broken = "\n".join(" ".join(items[5][k : k + 8]) for k in range(0, 80, 8)).replace(items[5][15], items[5][15][:3] + "-\n" + items[5][15][3:])
    rows = [
        (1, fill(20) + " " + " ".join(items[0]).upper() + "! " + fill(9)), (2, fill(5) + " " + " ".join(items[1][20:50])), (3, " ".join(items[1][20:45]) + " " + fill(30)), (4, ", ".join(changed)), (5, " ".join(tooMany)), (6, " ".join(added) + fill(4)), (7, broken), (8, None), (9, ""), (1, fill(3)),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "'x' as item")
    tests = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)] + [(99, None), (98, "")], "item_id long, text string")
    got = leakage.find_leaks(docs, tests, "doc_id", "item_id")
    assert sorted(map(tuple, got.collect())) == [(1, 0), (2, 1), (4, 2), (6, 4), (7, 5)]
    blocks = leakage.find_leaks(docs, tests, "doc_id", "item_id", block_chars=60)
    assert sorted(map(tuple, blocks.collect())) == sorted(map(tuple, got.collect()))
    assert leakage.find_leaks(docs, tests.limit(0), "doc_id", "item_id").count() == 0
    assert leakage.remove_leaking(docs, got, "doc_id").filter("doc_id = 2").count() == 0
    assert leakage.leak_report(got, tests, "doc_id", "item_id").filter("n_docs = 0").count() == 3


@pytest.mark.parametrize("at, leaks", [((14, 16), True), ((14, 17), True), ((14, 18), True), ((14, 15), True), ((9, 14, 16), False)])
def test_changes_near_each_other_are_counted(at, leaks):
    item = [f"w{k}" for k in range(30)]
    doc = [f"x{k}" if k in at else w for k, w in enumerate(item)]
    assert leakage.matches(leakage.Items([(1, " ".join(item))]), "some words " + " ".join(doc) + " and more", 30, 12) == [0] * leaks


def test_a_later_run_of_the_same_shift_is_tried():
    item = [f"w{k}" for k in range(60)]
    doc = [f"x{k}" if 10 <= k < 25 else w for k, w in enumerate(item)]
    assert leakage.matches(leakage.Items([(1, " ".join(item))]), " ".join(doc), 30, 12) == [0]


def test_reach_as_by_edit_distance():
    rnd = random.Random(5)
    for _ in range(200):
        a, b = ([rnd.randrange(3) for _ in range(rnd.randint(0, 12))] for _ in range(2))
        cost = [[x + y for y in range(len(b) + 1)] for x in range(len(a) + 1)]
        for x in range(1, len(a) + 1):
            for y in range(1, len(b) + 1):
                cost[x][y] = min(cost[x - 1][y] + 1, cost[x][y - 1] + 1, cost[x - 1][y - 1] + (a[x - 1] != b[y - 1]))
        ends = [(x, cost[x - 1][y - 1]) for x in range(1, len(a) + 1) for y in range(1, len(b) + 1) if a[x - 1] == b[y - 1]]
        want = [max((x for x, n in ends if n <= c), default=0) for c in range(5)]
        assert leakage._reach(a, b, 0, 0, 1, 4) == want == leakage._reach(a[::-1], b[::-1], len(a) - 1, len(b) - 1, -1, 4)


@pytest.mark.parametrize("copies", [1, 2, 10])
def test_a_wrapped_passage_leaks_in_any_number_of_copies(copies):
    item = [f"{a}word{b}" for a in "abcdefgh" for b in "abcdefgh"]
    lines = [" ".join(item[k : k + 8]) for k in range(0, 64, 8)]
    for sep in ([], ["12"], ["Page 3", "Zenon Bank Plc"]):
        paged = [x for k, l in enumerate(lines) for x in ([l, *sep] if k % 3 == 1 else [l])]
        assert leakage.matches(leakage.Items([(1, " ".join(item))]), "\n".join(paged * copies), 30, 12) == [0]


@pytest.mark.parametrize("header", [None, "Zenon Bank Plc - Report"])
def test_a_passage_carried_twice_leaks(header):
    item = [f"{a}word{b}" for a in "abcdefgh" for b in "abcdefgh"]
    lines = [" ".join(item[k : k + 8]) for k in range(0, 64, 8)]
    if header:  # a header that comes back more often than the passage, in other places of each copy
        first, second = [list(lines) for _ in range(2)]
        for copy, spots in ((first, (2, 5, 8)), (second, (1, 4, 7))):
            for k in reversed(spots):
                copy[k:k] = [header, str(k)]
        lines = first + ["Some other text stands here"] + second
    else:
        lines = lines * 2
    assert leakage.matches(leakage.Items([(1, " ".join(item))]), "\n".join(lines), 30, 12) == [0]
