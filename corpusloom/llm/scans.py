"""Problem 2: noise in text from scanned pages.

One pass counts, over all texts, every word (apart in clean and in page layout), every pair of word parts around a
hyphen at a line end, and every short line that comes back within a text. From those tables:

* words without support in clean text get correction candidates by an inverted join on character q-grams; a
  gradient-boosted ranker, trained on words of the lexicon that are spoilt by the known confusions of optical
  recognition, chooses the replacement or none;
* pairs around a hyphen are judged by a line-pair classifier, trained on words cut in two and on the compounds of the
  lexicon;
* lines are judged as header, page number or text by classifiers trained on clean texts laid out in pages.

A second pass applies the decisions to every text, or stretch of a text, in page layout. The classifiers are fitted on bounded samples
(``FIT_WORDS`` words for the ranker, ``FIT_JOIN_WORDS`` for broken words, the first ``FIT_CHARS`` characters of ``FIT_TEXTS``
texts of at least ``FIT_LEAST`` for lines, with ``FIT_NAMES`` company names as headers; whether a text is clean is judged on all of it);
all counts, candidates and decisions cover everything. Decisions reach the texts by broadcast up to a bound, beyond it by a join on
the words, pairs and line keys of each text, with the same result. Words of one or two characters are never corrected (no q-gram tells them
apart), and a correction differs by at most two characters in length; a header is a line of at most ``LONG_LINE`` characters.

Defined results: null and empty texts have no lines and stay as they are; texts without page layout stay as they are;
repeated rows are treated alike; other columns pass untouched; very long texts are read whole.
"""

from __future__ import annotations

import math
import random
import re
import textwrap
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .boosting import BoostedTrees
from .common import map_arrow, stash
from .text_form import consistent

FIT_WORDS, FIT_JOIN_WORDS, FIT_TEXTS, FIT_CHARS, FIT_LEAST, FIT_NAMES, Q = 3_000, 12_000, 400, 6_000, 600, 200, 3
LONG_LINE = 120
# What optical recognition reads in place of what is printed.
CONFUSIONS = {
    "l": ("1", "i", "t"), "i": ("1", "l", "j"), "o": ("0", "a", "c"), "s": ("5", "a"), "g": ("9", "q"), "b": ("6", "h"), "e": ("c", "o"), "c": ("e", "o"), "a": ("o", "e", "s"), "t": ("f", "l"), "f": ("t",), "h": ("b", "li"), "u": ("ii", "v", "n"),
    "n": ("ri", "u", "ii"), "m": ("rn", "in", "nn", "iii"), "r": ("i'", "t"), "d": ("cl",), "w": ("vv",), "v": ("y", "u"), "q": ("g",), "y": ("v",), "z": ("2",), "k": ("lc",), "rn": ("m",), "li": ("h",), "in": ("m",), "cl": ("d",), "ri": ("n",), "vv": ("w",), "ii": ("u",), "nn": ("m",), "fi": ("h",), "tt": ("ll",), "B": ("8",), "S": ("5",), "O": ("0",), "I": ("1", "l"), "l1": ("h",),
}
_STRIP = " \t.,;:!?()[]\"“”|/•*>—–©&"
_PLAIN_NUMBER = re.compile(r"[\W\d]*(?:ngn)?[\W\d]*%?")
_LETTER = re.compile(r"[^\W\d_]")
_LETTERS = re.compile(r"[^\W\d_]+")
_END = re.compile(r"([^\W_](?:[\w'’-]*[^\W_])?)(?:-|¬)$")
_START = re.compile(r"\W{0,1}([^\W_](?:[\w'’]*[^\W_])?)")
_PAGE = re.compile(r"\s*(?:(?P<word>page|p\.|pg\.?|seite)\s*)?(?P<deco>[-–—|\[(<~*•]{0,2})\s*(?P<n>\d{1,4}|[ivxlc]{1,7})(?P<of>\s*(?:of|/)\s*\d{1,4})?\s*[-–—|\])>~*•]{0,2}\s*$", re.I)
_NUMERIC = re.compile(r"[\s\d.,%()+-]*\d[\s\d.,%()+-]*$")
_NO_LETTERS, _UPPERS, _DIGITS = (bytes(i for i in range(128) if f(chr(i))) for f in (lambda c: not c.isalpha(), str.isupper, str.isdigit))
_TO_SPACES = bytes(i if chr(i).isalpha() else 32 for i in range(128)) + bytes(128)
_ROMAN = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100}


def _breaks(a: str, b: str) -> bool:
    """Whether line ``a`` ends in a hyphen after a letter and ``b`` goes on in lower case."""
    a = a.rstrip()
    return a[-1:] in ("-", "¬", "\xad") and a[-2:-1].isalpha() and b.lstrip()[:1].islower()


def _wide(lines: list[str]) -> bool:
    full = sorted(len(l) for l in lines)
    return bool(full) and full[len(full) // 2] >= 24


def _titled(line: str) -> bool:
    words = _LETTERS.findall(line)
    return sum(w[0].isupper() for w in words) * 5 >= 2 * len(words) > 0


def _short_lines(lines: list[str], after: str = "") -> tuple[bool, bool, bool]:
    """(wide enough lines, signs of pages, lines that run on) of a stretch of short lines; page numbers and repeated short lines don't count for the width."""
    full = [l for l in lines if l.strip()]
    keys = [key_of(l) for l in full]
    seen = Counter(k for k in keys if len(k) > 3)
    values = [page_value(l) for l in full]
    core = [l for l, k, v in zip(full, keys, values) if not v and seen[k] < 2]
    found = {v for v in values if v}
    numbered = any(s not in ("dFalseFalse", "rFalseFalse") for _, s in found) or any((v + 1, s) in found for v, s in found)
    on = sum(a.rstrip()[-1:] not in ".!?:" and b.lstrip()[:1].islower() for a, b in zip(core, core[1:]))
    headed = any(seen[k] > 1 and _titled(l) for l, k in zip(full, keys))
    signs = (len(full) > 1 or bool(after)) and (numbered or any(_breaks(a, b) for a, b in zip(core, [*core[1:], after])) or headed and len(full) >= 6 and _wide(core))
    return len(full) >= 6 and (_wide(full) or _wide(core)), signs, on * 4 >= len(core) > 0


def paged_lines(lines: list[str]) -> list[int]:
    """The numbers of the lines that are laid out as in scanned pages.

    A text without long lines is judged whole. In one with long lines each stretch of short lines is judged; if such stretches
    make up half of the text, it is all pages, otherwise only the stretches with page numbers, headers or broken words are.
    """
    full = [len(l) for l in lines if l.strip()]
    if not full:
        return []
    if max(full) <= LONG_LINE:
        if len(full) >= 6 and sorted(full)[len(full) // 2] >= 24:
            return list(range(len(lines)))
        wide, signs, _ = _short_lines(lines)
        return list(range(len(lines))) if wide or signs else []
    size, pages, lo = 0, [], 0
    for hi, l in enumerate([*lines, None]):
        if l is not None and (len(l) <= LONG_LINE or not l.strip()):
            continue
        a, b = lo, hi
        while a < b and not lines[a].strip():
            a += 1
        while b > a and not lines[b - 1].strip():
            b -= 1
        lo = hi + 1
        if a == b:
            continue
        wide, signs, on = _short_lines(lines[a:b], l or "")
        if signs or (wide and on):
            size += sum(len(lines[k]) for k in range(a, b))
        if signs:
            pages += range(a, b)
            if l is not None and _breaks(lines[b - 1], l):
                pages += range(b, hi + 1)
    return list(range(len(lines))) if 2 * size >= sum(full) else pages


def page_layout(lines: list[str]) -> bool:
    """Whether a text is laid out in short lines, as scanned pages are, in whole or in part."""
    return bool(paged_lines(lines))


def lines_of(text: str) -> list[str]:
    """Lines in the consistent form; a soft hyphen at a line end is a hyphen."""
    if "\xad" in text:
        text = text.replace("\xad\n", "-\n")
    return consistent(text).split("\n")


def key_of(line: str) -> str:
    """The letters of a line in lower case."""
    if line.isascii():
        return line.encode().translate(None, _NO_LETTERS).lower().decode()
    return "".join(_LETTERS.findall(line.lower()))


def word_of(token: str) -> str:
    return token.strip(_STRIP).lower()


def words_of_tokens(tokens: Counter) -> Counter:
    """Counts by word from counts by token in lower case; tokens are stripped once each, not once per occurrence."""
    out: Counter = Counter()
    for t, n in tokens.items():
        w = t.strip(_STRIP)
        if w and not _PLAIN_NUMBER.fullmatch(w):
            out[w] += n
    return out


def repeats(lines: list[str]) -> list[int]:
    """For each line, how many lines of the text have its letters, or the same first or second half of them."""
    keys = [key_of(l) if l.strip() and len(l) <= LONG_LINE else "" for l in lines]
    whole, first, second = Counter(keys), Counter(k[: len(k) // 2] for k in keys if len(k) > 11), Counter(k[len(k) // 2 :] for k in keys if len(k) > 11)
    out = []
    for k in keys:
        n = whole[k] if len(k) > 3 else 0
        if len(k) > 11:
            n = max(n, first[k[: len(k) // 2]], second[k[len(k) // 2 :]])
        out.append(n)
    return out


def page_value(line: str) -> tuple[int, str] | None:
    """(number, style) of a line that holds nothing but what could be a page number."""
    m = _PAGE.match(line)
    if not m:
        return None
    n = m["n"].lower()
    if n.isdigit():
        value, form = int(n), "d"
    else:
        value, form = 0, "r"
        for a, b in zip(n, [*n[1:], ""]):
            value += -_ROMAN[a] if b and _ROMAN[b] > _ROMAN[a] else _ROMAN[a]
    return value, f"{form}{bool(m['word'])}{m['deco'][:1]}{bool(m['of'])}"


def next_text(lines: list[str], reps: list[int], k: int) -> int:
    """The next line that may be running text, or -1."""
    for j in range(k + 1, len(lines)):
        l = lines[j]
        if l.strip() and not page_value(l) and not _NUMERIC.match(l) and not (reps[j] > 1 and len(key_of(l)) > 3 and not l[:1].islower()):
            return j
    return -1


def hyphen_pairs(lines: list[str], reps: list[int]) -> list[tuple[int, int, str, str]]:
    """(line, next line, part, rest) of each line that ends in a hyphen after a word."""
    out = []
    for k, l in enumerate(lines):
        l = l.rstrip()
        if l[-1:] in "-¬" and l and (m := _END.search(l)):
            j = next_text(lines, reps, k)
            if j >= 0 and (s := _START.match(lines[j].lstrip())):
                out.append((k, j, m[1].lower(), s[1].lower()))
    return out


def count_tables(texts: DataFrame) -> DataFrame:
    """(kind, a, b, clean, paged): w words, j joined words, p pairs around a hyphen, h repeated short lines; summed over all texts."""

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        raw_clean, raw_paged, joined, pairs, heads = Counter(), Counter(), Counter(), Counter(), Counter()
        for t in batch.column(0).to_pylist():
            lines = lines_of(t)
            at = paged_lines(lines)
            if not at:
                raw_clean.update((t if t.isascii() else "\n".join(lines)).lower().split())
                continue
            if len(at) < len(lines):
                paged = set(at)
                raw_clean.update("\n".join(l for k, l in enumerate(lines) if k not in paged).lower().split())
                lines = [lines[k] for k in at]
            reps = repeats(lines)
            low = [l.lower().split() for l in lines]
            for k, j, a, b in hyphen_pairs(lines, reps):
                pairs[a, b] += 1
                joined[a + b] += 1
                low[j] = low[j][1:]
            for l, ws in zip(lines, low):
                raw_paged.update(ws[:-1] if ws and l.rstrip()[-1:] in "-¬" else ws)
            heads.update({key_of(l) for l, r in zip(lines, reps) if r > 1 and len(key_of(l)) > 3 and l.rstrip()[-1:] not in (".", ",", ";", "-")})
        clean, paged = words_of_tokens(raw_clean), words_of_tokens(raw_paged)
        rows = [("w", w, "", clean[w], paged[w]) for w in clean.keys() | paged.keys()]
        rows += [("j", w, "", 0, n) for w, n in joined.items()] + [("p", a, b, 0, n) for (a, b), n in pairs.items()] + [("h", h, "", 0, n) for h, n in heads.items()]
        cols = list(zip(*rows)) or [()] * 5
        kinds = [pa.string()] * 3 + [pa.int64()] * 2
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["kind", "a", "b", "clean", "paged"])

    one = map_arrow(texts.select("text"), fn, "kind string, a string, b string, clean long, paged long")
    return stash(one.groupBy("kind", "a", "b").agg(F.sum("clean").alias("clean"), F.sum("paged").alias("paged")), "scan-counts")


# --- corrections -----------------------------------------------------------------------------------------------


_DRAWN = str.maketrans({"0": "o", "1": "l", "5": "s", "6": "b", "2": "z", "9": "g", "8": "b", "t": "l", "j": "l", "i": "l", "f": "l", "c": "o", "e": "o", "a": "o", "y": "v", "u": "v", "q": "g"})


def _shape_of_print(w: str) -> str:
    """The word with what is easily confused drawn alike."""
    for a, b in (("i'", "r"), ("rn", "m"), ("cl", "d"), ("vv", "w"), ("ii", "u"), ("nn", "m"), ("ri", "n"), ("li", "h")):
        w = w.replace(a, b)
    return w.translate(_DRAWN)


_REVERSE: dict[str, tuple[str, ...]] = {}
for _printed, _reads in CONFUSIONS.items():
    for _r in _reads:
        _REVERSE[_r] = (*_REVERSE.get(_r, ()), _printed.lower())


def edit_costs(s: str, c: str, limit: float = 3.0) -> tuple[float, float]:
    """(plain edits, edits with known confusions at a fifth) from what is read to what may be printed."""
    n, m = len(s), len(c)
    if abs(n - m) > 3:
        return limit + 1, limit + 1
    inf = 99.0
    plain = [[inf] * (m + 1) for _ in range(n + 1)]
    cost = [[inf] * (m + 1) for _ in range(n + 1)]
    plain[0][0] = cost[0][0] = 0.0
    for i in range(n + 1):
        for j in range(max(0, i - 4), min(m, i + 4) + 1):
            p, q = plain[i][j], cost[i][j]
            if q > limit + 2:
                continue
            if i < n and j < m:
                d = 0.0 if s[i] == c[j] else 1.0
                plain[i + 1][j + 1] = min(plain[i + 1][j + 1], p + d)
                cost[i + 1][j + 1] = min(cost[i + 1][j + 1], q + d)
            if i < n:
                plain[i + 1][j] = min(plain[i + 1][j], p + 1)
                cost[i + 1][j] = min(cost[i + 1][j], q + 1)
            if j < m:
                plain[i][j + 1] = min(plain[i][j + 1], p + 1)
                cost[i][j + 1] = min(cost[i][j + 1], q + 1)
            for k in (1, 2, 3):
                for printed in _REVERSE.get(s[i : i + k], ()) if i + k <= n else ():
                    if c.startswith(printed, j):
                        cost[i + k][j + len(printed)] = min(cost[i + k][j + len(printed)], q + 0.2)
    return plain[n][m], cost[n][m]


def grams_of(w: str) -> set[str]:
    x = f"^{_shape_of_print(w)}$"
    return {x[i : i + Q] for i in range(max(1, len(x) - Q + 1))}


def pair_features(s: str, s_clean: int, s_paged: int, c: str, c_clean: int, c_paged: int) -> list[float]:
    plain, cost = edit_costs(s, c)
    digits = sum(ch.isdigit() for ch in s)
    odd = sum(not ch.isalpha() for ch in s) - sum(not ch.isalpha() for ch in c)
    support = math.log1p(c_clean + c_paged)
    x, y = _shape_of_print(s), _shape_of_print(c)
    return [plain, cost, plain / max(1, len(c)), float(len(c)), support, support - math.log1p(s_paged), math.log1p(s_clean), float(digits), float(odd), float(x[0] == y[0]), float(x[-1] == y[-1]), float(x == y)]


def spoil(word: str, rnd: random.Random, times: int) -> str:
    for _ in range(times):
        spots = [(i, k, r) for i in range(len(word)) for k in (1, 2) for r in CONFUSIONS.get(word[i : i + k], ()) if len(word[i : i + k]) == k]
        if spots:
            i, k, r = rnd.choice(spots)
            word = word[:i] + r + word[i + k :]
    return word


def train_ranker(lexicon: list[tuple[str, int, int]], seed: int = 3) -> BoostedTrees:
    """From words of the lexicon: spoilt copies with their origin; words taken out of it and other inflections, which have none."""
    rnd = random.Random(seed)
    alpha = [(w, a, b) for w, a, b in lexicon if w.replace("-", "").replace("'", "").isalpha() and len(w) > 2]
    known = {w for w, _, _ in alpha}
    index: dict[str, list[int]] = {}
    for k, (w, _, _) in enumerate(alpha):
        for g in grams_of(w):
            index.setdefault(g, []).append(k)
    x, y = [], []
    for k, (w, a, b) in enumerate(alpha):
        freq = a + b
        suffix = rnd.choice(("s", "ed", "ing", "ly", "er", "d", "al"))
        other = w[: -len(suffix)] if w.endswith(suffix) and len(w) > len(suffix) + 3 else w + suffix
        forms = [(spoil(w, rnd, 1), k), (spoil(w, rnd, 1 + (rnd.random() < 0.25)), k), (w, None), *([(other, None)] if other not in known else [])]
        for s, origin in forms:
            if origin is not None and s == w:
                continue
            shared = Counter(j for g in grams_of(s) for j in index.get(g, ()))
            s_paged = max(1, int(freq * rnd.choice([0.0005, 0.002, 0.01, 0.03]))) if origin is not None else max(1, b or int(freq * rnd.choice([0.01, 0.1, 1.0])))
            s_clean = 0 if origin is not None or rnd.random() < 0.7 else rnd.randint(1, 3)
            near = sorted((j for j, n in shared.items() if (origin is not None or j != k or s != w) and n >= _least_shared(s, alpha[j][0])), key=lambda j: (-shared[j], j))
            for j in near[:6] + ([k] if origin is not None and k in shared and k not in near[:6] else []):
                x.append(pair_features(s, s_clean, s_paged, *alpha[j][:1], alpha[j][1], alpha[j][2]))
                y.append(float(j == origin))
    if not x or not any(y):
        return BoostedTrees(trees=0).fit(np.zeros((2, 12)), np.array([0.0, 0.0]))
    return BoostedTrees().fit(np.array(x), np.array(y))


def _least_shared(s: str, c: str) -> int:
    return max(1, min(len(s), len(c)) // 2 - 1)


def corrections(counts: DataFrame) -> DataFrame:
    """(word, fixed): the replacement of each spoilt word of the texts in page layout."""
    words = counts.filter("kind in ('w', 'j')").groupBy("a").agg(F.sum(F.when(F.col("kind") == "w", F.col("clean"))).alias("clean"), F.sum("paged").alias("paged"), F.max(F.when(F.col("kind") == "w", 1)).alias("seen"))
    words = stash(words.select(F.col("a").alias("w"), F.coalesce("clean", F.lit(0)).alias("clean"), "paged", "seen").filter(F.length("w") >= 3), "scan-words")
    lexicon = words.filter("clean >= 3 and seen = 1")
    fit = lexicon.orderBy(F.desc("clean"), "w").limit(FIT_WORDS).collect()
    ranker = train_ranker([(r["w"], r["clean"], r["paged"]) for r in fit])
    suspects = words.filter("paged > 0 and (clean <= 2 or clean * 400 < paged)")

    def gram_rows(df: DataFrame, names: list[str], spread: int) -> DataFrame:
        def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
            out: list[list] = [[], [], [], [], []]
            for w, a, b in zip(*(batch.column(i).to_pylist() for i in range(3))):
                for g in grams_of(w):
                    for d in range(-spread, spread + 1):
                        for col, v in zip(out, (g, len(w) + d, w, a, b)):
                            col.append(v)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, [pa.string(), pa.int32(), pa.string(), pa.int64(), pa.int64()])], names=["g", "n", *names])

        return map_arrow(df.select("w", "clean", "paged"), fn, f"g string, n int, {names[0]} string, {names[1]} long, {names[2]} long")

    near = gram_rows(suspects, ["s", "s_clean", "s_paged"], 2).join(gram_rows(lexicon, ["c", "c_clean", "c_paged"], 0), ["g", "n"])
    near = near.filter("s <> c").groupBy("s", "c").agg(F.count("*").alias("shared"), *[F.first(x).alias(x) for x in ("s_clean", "s_paged", "c_clean", "c_paged")])
    near = near.filter(F.col("shared") >= F.greatest(F.lit(1), F.floor(F.least(F.length("s"), F.length("c")) / 2) - 1))
    shared = counts.sparkSession.sparkContext.broadcast(ranker)

    def score(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = list(zip(*(batch.column(i).to_pylist() for i in range(6))))
        p = shared.value.predict(np.array([pair_features(r[0], r[2], r[3], r[1], r[4], r[5]) for r in rows]).reshape(len(rows), 12))
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(p), batch.column(4)], names=["s", "c", "p", "c_clean"])

    scored = map_arrow(near.select("s", "c", "s_clean", "s_paged", "c_clean", "c_paged"), score, "s string, c string, p double, c_clean long").filter("p >= 0.5")
    return scored.groupBy("s").agg(F.max_by("c", F.struct(F.round("p", 1), "c_clean", "c")).alias("fixed")).withColumnRenamed("s", "word")


# --- line pairs ------------------------------------------------------------------------------------------------


def join_features(a: str, b: str, joined: int, compound: int, left: int, right: int) -> list[float]:
    return [math.log1p(joined), math.log1p(compound), math.log1p(left), math.log1p(right), math.log1p(joined) - math.log1p(compound), float(len(a)), float(len(b)), float("-" in a or "-" in b)]


def train_joins(lexicon: dict[str, int], seed: int = 4) -> BoostedTrees:
    """Words cut in two against the compounds of the lexicon."""
    rnd = random.Random(seed)
    x, y = [], []
    for w, n in lexicon.items():
        if "-" in w.strip("-"):
            at = rnd.choice([i for i, ch in enumerate(w) if ch == "-" and 0 < i < len(w) - 1] or [0])
            a, b = w[:at], w[at + 1 :]
            label = 0.0
        elif w.isalpha() and len(w) > 4:
            at = rnd.randint(2, len(w) - 2)
            a, b, label = w[:at], w[at:], 1.0
        else:
            continue
        if a and b:
            for hidden in (0, 0, 0, 1):
                j, c = lexicon.get(a + b, 0), lexicon.get(f"{a}-{b}", 0)
                x.append(join_features(a, b, 0 if hidden else j, 0 if hidden else c, lexicon.get(a, 0), lexicon.get(b, 0)))
                y.append(label)
    if not y or len(set(y)) < 2:
        x += [join_features("ab", "cd", 9, 0, 0, 0), join_features("ab", "cd", 0, 9, 9, 9)]
        y += [1.0, 0.0]
    return BoostedTrees(depth=3).fit(np.array(x), np.array(y))


def judge_joins(counts: DataFrame, fixes: DataFrame) -> DataFrame:
    """(a, b) of the pairs that are one word broken at the line end."""
    spark = counts.sparkSession
    words = counts.filter("kind = 'w'").select("a", (F.col("clean") + F.col("paged")).alias("n"))
    fit = words.filter("n >= 3").orderBy(F.desc("n"), "a").limit(FIT_JOIN_WORDS).collect()
    model = spark.sparkContext.broadcast(train_joins({r[0]: r[1] for r in fit}))
    pairs = counts.filter("kind = 'p'").select("a", "b", F.concat("a", "b").alias("ab"), F.concat_ws("-", "a", "b").alias("a_b"))
    for c, out in (("ab", "n_join"), ("a_b", "n_comp"), ("a", "n_a"), ("b", "n_b")):
        pairs = pairs.join(words.toDF(f"__{out}", out), F.col(c) == F.col(f"__{out}"), "left").drop(f"__{out}")
    fixed = fixes.join(words.toDF("__f", "n_fixed"), F.col("fixed") == F.col("__f")).select(F.col("word").alias("__w"), "n_fixed")
    pairs = pairs.join(fixed, F.col("ab") == F.col("__w"), "left").na.fill(0, ["n_join", "n_comp", "n_a", "n_b", "n_fixed"])
    pairs = pairs.select("a", "b", F.greatest("n_join", "n_fixed").alias("n_join"), "n_comp", "n_a", "n_b")

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = list(zip(*(batch.column(i).to_pylist() for i in range(6))))
        p = model.value.predict(np.array([join_features(*r) for r in rows]).reshape(len(rows), 8))
        keep = pa.array(p >= 0.5)
        return pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    return map_arrow(pairs, fn, "a string, b string")


# --- furniture -------------------------------------------------------------------------------------------------


_NUMBERED = re.compile(r"\d+\s|.*\s\d+$")


def _letter_counts(l: str) -> tuple[int, int, int, int, int]:
    """Letters, capital letters, digits, words and capitalised words of a line."""
    if l.isascii():
        b = l.encode()
        n = len(b)
        words = b.translate(_TO_SPACES).split()
        return sum(map(len, words)), n - len(b.translate(None, _UPPERS)), n - len(b.translate(None, _DIGITS)), len(words), len([w for w in words if w[0] < 97])
    letters, words = [c for c in l if c.isalpha()], _LETTERS.findall(l)
    return len(letters), sum(c.isupper() for c in letters), sum(c.isdigit() for c in l), len(words), sum(w[0].isupper() for w in words)


def line_features(lines: list[str], heads: dict[str, int], reps: list[int]) -> tuple[list[int], list[list[float]]]:
    """(line numbers, features) of the lines that are not blank."""
    values = [page_value(l) for l in lines]
    full = [k for k, l in enumerate(lines) if l.strip()]
    width = sorted(len(lines[k]) for k in full)[len(full) // 2] if full else 1
    back, ahead = {}, {}
    run: dict[tuple[int, str], int] = {}
    for k in full:
        if values[k]:
            v, s = values[k]
            back[k] = run[v, s] = run.get((v - 1, s), 0) + 1
    run = {}
    for k in reversed(full):
        if values[k]:
            v, s = values[k]
            ahead[k] = run[v, s] = run.get((v + 1, s), 0) + 1
    bare = [lines[k].strip() for k in full]
    numeric = [bool(_NUMERIC.match(l)) for l in bare]
    rows = []
    for i, (k, l) in enumerate(zip(full, bare)):
        before, after = (bare[i - 1] if i else "", bare[i + 1] if i + 1 < len(full) else "")
        letters, uppers, digits, words, capitals = _letter_counts(l)
        key = key_of(l) if heads else ""
        value = values[k]
        rows.append([
            float(value is not None), float(value[0]) if value else -1.0, float(back.get(k, 0) + ahead.get(k, 0)), float(bool(value) and value[1] != "dFalseFalse"), float(numeric[i]),
            float(i > 0 and numeric[i - 1]), float(i + 1 < len(full) and numeric[i + 1]), float(reps[k]), math.log1p(heads.get(key, 0)) if len(key) > 3 else 0.0, len(l) / width,
            uppers / max(1, letters), capitals / max(1, words), float(l[-1] in ".,;:-¬"), float(l[0].islower()), float(bool(digits) and bool(_NUMBERED.match(l))),
            float(before[-1:] not in ".!?:" and bool(before)), float(after[:1].islower()), float(i == 0), float(i + 1 == len(full)), float(len(lines[k]) - len(lines[k].lstrip())), float(words),
            float(bool(i and values[full[i - 1]] or i + 1 < len(full) and values[full[i + 1]])), digits / len(l),
        ])
    return full, rows


def lay_out(text: str, name: str, rnd: random.Random) -> list[tuple[str, int]]:
    """A clean text in pages: (line, 0 text, 1 header, 2 page number)."""
    width, per_page = rnd.randint(46, 84), rnd.randint(8, 26)
    year = rnd.randint(2018, 2026)
    title = rnd.choice([f"Annual Report {year}", f"{year} Results", f"Interim Report {year}", f"Business Review / {name}", f"Review continued / {name}", f"Chairman's Statement continued / {name}", f"Notes to the accounts continued / {name}", f"Report of the directors - {name}", f"Strategic Report / {name}", f"{name} - Half-Year Report {year}", f"{name} | Accounts {year}", name])
    heads = [title, name] if rnd.random() < 0.4 else [title]
    if rnd.random() < 0.35:
        heads = [h.upper() for h in heads]
    style = rnd.choice(["{n}", "{n}", "Page {n}", "page {n} of {m}", "- {n} -", "| {n} |", "{r}", ""])
    in_head = not style and rnd.random() < 0.8
    with_heads = rnd.random() < 0.75
    n, m = rnd.randint(1, 95), rnd.randint(100, 140)
    body: list[str] = []
    for block in text.split("\n"):
        for l in textwrap.wrap(block, width) if block.strip() else [""]:
            while len(l) > 12 and rnd.random() < 0.12 and l[-1].isalpha() and l[-3:].isalpha():
                l = l[:-2] + "-"
            body.append(l)
        if rnd.random() < 0.12:
            block_n = rnd.randint(1, 6)
            years = rnd.random() < 0.3
            body += [str(year), str(year - 1)] if years else []
            body += [rnd.choice([f"{rnd.uniform(1, 99):.1f}%", f"{rnd.uniform(1, 400):.1f}", f"{rnd.randint(1, 9)},{rnd.randint(100, 999)}", str(rnd.randint(1, 999)), f"{rnd.uniform(1, 99):.2f}"]) for _ in range(block_n)]
    out: list[tuple[str, int]] = []
    bottom = rnd.random() < 0.5
    for p, lo in enumerate(range(0, len(body), per_page)):
        h = heads[p % len(heads)]
        if in_head:
            h = rnd.choice([f"{h}  {n + p}", f"{n + p}  {h}"]) if p % 2 else f"{h}  {n + p}"
        number = style.format(n=n + p, m=m, r=_to_roman(n % 30 + 1 + p)) if style else ""
        number = " " * rnd.choice([0, 0, 3, 20]) + number if number else ""
        if with_heads and not bottom:
            out.append((h, 1))
        out += [(l, 0) for l in body[lo : lo + per_page]]
        if with_heads and bottom:
            out.append((h, 1))
        if number:
            out.append((number, 2))
    return out


def _to_roman(v: int) -> str:
    out = ""
    for d, s in ((100, "c"), (90, "xc"), (50, "l"), (40, "xl"), (10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i")):
        while v >= d:
            out, v = out + s, v - d
    return out or "i"


def train_furniture(samples: list[tuple[str, str]], seed: int = 6) -> tuple[BoostedTrees, BoostedTrees]:
    """(header, page number) classifiers from clean texts laid out in pages."""
    rnd = random.Random(seed)
    xs, ys = [np.zeros((1, 23))], [np.zeros(1, dtype=int)]
    for text, name in samples:
        laid = lay_out(text[:FIT_CHARS], name, rnd)
        lines = [l for l, _ in laid]
        heads = {key_of(l): rnd.choice([0, 0, 2, 9, 60]) for l, k in laid if k == 1}
        full, x = line_features(lines, heads, repeats(lines))
        xs.append(np.array(x, dtype=float).reshape(len(x), 23))
        ys.append(np.array([laid[k][1] for k in full], dtype=int))
    x, y = np.concatenate(xs), np.concatenate(ys)
    return BoostedTrees().fit(x, (y == 1).astype(float)), BoostedTrees().fit(x, (y == 2).astype(float))


# --- application -----------------------------------------------------------------------------------------------


class _Spoilt(dict):
    """Whether the word of a token has a correction; answers are kept, up to a bound that only costs time."""

    def __init__(self, fixes: dict[str, str], limit: int = 1 << 18):
        self.fixes, self.limit = fixes, limit

    def __missing__(self, token: str) -> bool:
        found = word_of(token) in self.fixes
        if len(self) < self.limit:
            self[token] = found
        return found


class Repairer:
    """All decisions, as broadcast to the executors; where there are too many, ``decisions`` is a table of them."""

    def __init__(self, fixes: dict[str, str], broken: set[tuple[str, str]], heads: dict[str, int], header: BoostedTrees, number: BoostedTrees, decisions: DataFrame | None = None):
        self.fixes, self.broken, self.heads, self.header, self.number, self.decisions = fixes, broken, heads, header, number, decisions
        self.spoilt = _Spoilt(fixes)

    def judge_all(self, texts: list[list[str]]) -> list[tuple[dict[int, set[str]], dict[int, tuple[int, str, str]]]]:
        """For each text, the kinds of its spoilt lines and line -> (next line, part, rest) of the words broken at its end.

        The classifiers see the lines of all texts at once.
        """
        reps = [repeats(lines) for lines in texts]
        found = [line_features(lines, self.heads, r) for lines, r in zip(texts, reps)]
        x = np.array([row for _, rows in found for row in rows], dtype=float).reshape(-1, 23)
        h, p = self.header.predict(x), self.number.predict(x)
        out, at = [], 0
        for lines, r, (full, rows) in zip(texts, reps, found):
            out.append(self._judge(lines, r, full, h[at : at + len(rows)], p[at : at + len(rows)]))
            at += len(rows)
        return out

    def _judge(self, lines: list[str], reps: list[int], full: list[int], h: np.ndarray, p: np.ndarray):
        kinds: dict[int, set[str]] = {}
        for k, a, b in zip(full, h.tolist(), p.tolist()):
            if b >= 0.5 and page_value(lines[k]):
                kinds[k] = {"page_number"}
            elif a >= 0.5 and _LETTER.search(lines[k]):
                kinds[k] = {"header"}
        joins = {}
        edge: set[tuple[int, bool]] = set()
        for k, j, a, b in hyphen_pairs(lines, reps):
            if k in kinds or (a, b) not in self.broken:
                continue
            kinds.setdefault(k, set()).add("hyphen")
            joins[k] = (j, a, b)
            edge |= {(k, True), (j, False)}
            fixed = self.fixes.get(a + b)
            if fixed:
                for line, wrong in ((k, not fixed.startswith(a)), (j, not fixed.endswith(b))):
                    if wrong or fixed.startswith(a) and fixed.endswith(b):
                        kinds.setdefault(line, set()).add("misread")
        for k in full:
            if "page_number" in kinds.get(k, ()):
                continue
            tokens = lines[k].split()
            if (k, True) in edge:
                tokens = tokens[:-1]
            if any(map(self.spoilt.__getitem__, tokens[(k, False) in edge :])):
                kinds.setdefault(k, set()).add("misread")
        return kinds, joins

    def fix(self, token: str) -> str:
        w = word_of(token)
        f = self.fixes.get(w)
        if not f:
            return token
        at = token.lower().find(w)
        old = token[at : at + len(w)]
        new = f.upper() if old.isupper() and len(old) > 1 else f[0].upper() + f[1:] if old[0].isupper() else f
        return token[:at] + new + token[at + len(w) :]

    def repair_all(self, texts: list[str | None]) -> list[str | None]:
        out = list(texts)
        laid = [(i, lines, at) for i, t in enumerate(texts) if t and (at := paged_lines(lines := lines_of(t)))]
        for (i, lines, at), (kinds, joins) in zip(laid, self.judge_all([[lines[k] for k in at] for _, lines, at in laid])):
            kinds = {at[k]: found for k, found in kinds.items()}
            joins = {at[k]: (at[j], a, b) for k, (j, a, b) in joins.items()}
            if len(at) == len(lines):
                out[i] = self._repair(lines, kinds, joins, at, {})
                continue
            raw, new, taken, last = out[i].split("\n"), [], {}, 0
            cuts = [0, *(n for n in range(1, len(at)) if at[n] > at[n - 1] + 1), len(at)]
            for a, b in zip(cuts, cuts[1:]):
                new += raw[last : at[a]]
                last = at[b - 1] + 1
                if part := self._repair(lines, kinds, joins, at[a:b], taken):
                    new.append(part)
            out[i] = "\n".join(new + raw[last:])
        return out

    def _repair(self, lines: list[str], kinds: dict[int, set[str]], joins: dict[int, tuple[int, str, str]], at: list[int], taken: dict[int, bool]) -> str:
        """Continuous paragraphs of the lines ``at`` without furniture; rows of figures keep their lines. ``taken``: lines whose first word was joined to another."""
        out: list[str] = []
        gap = False
        for k in at:
            l = lines[k]
            if kinds.get(k, set()) & {"header", "page_number"}:
                continue
            if not l.strip():
                gap = True
                continue
            tokens = l.split()
            if k in taken:
                tokens = tokens[1:]
            tail = ""
            if k in joins:
                j, a, b = joins[k]
                rest = lines[j].split()[0]
                tail = self.fix(tokens[-1].rstrip("-¬") + rest) if tokens else rest
                tokens = tokens[:-1]
                taken[j] = True
            line = " ".join([*map(self.fix, tokens), *([tail] if tail else [])])
            figures = bool(_NUMERIC.match(l))
            ended = not out or out[-1][-1:] in ".!?:\"" or bool(_NUMERIC.match(out[-1].rpartition("\n")[2]))
            if not line:
                continue
            if not out or (gap and (ended or not l.strip()[0].islower())):
                out.append(line)
            elif figures or _NUMERIC.match(out[-1].rpartition("\n")[2]):
                out[-1] += "\n" + line
            else:
                out[-1] += " " + line
            gap = False
        return "\n\n".join(out)


def clean_starts(texts: DataFrame) -> list[str]:
    """The first ``FIT_CHARS`` characters of each (text) without page layout, judged on the whole text; distinct and in order."""

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [t[:FIT_CHARS] for t in batch.column(0).to_pylist() if not page_layout(lines_of(t))]
        return pa.RecordBatch.from_arrays([pa.array(found, pa.string())], names=["text"])

    return sorted({r[0] for r in map_arrow(texts, fn, "text string").collect()})


def fit_repairer(texts: DataFrame, names: DataFrame | None = None, max_broadcast: int = 2_000_000) -> Repairer:
    """``texts``: every (text) of the corpus; ``names``: (name) of companies, for the training layouts.

    Up to ``max_broadcast`` corrections, pairs and header keys are broadcast; more of them stay in a table that is joined to the texts.
    """
    counts = count_tables(texts.filter("text is not null and text <> ''"))
    fixes = stash(corrections(counts), "scan-fixes")
    broken = stash(judge_joins(counts, fixes), "scan-joins")
    nothing = F.lit("")
    decisions = fixes.select(F.lit("w").alias("kind"), F.col("word").alias("a"), nothing.alias("b"), F.col("fixed").alias("v"), F.lit(0).cast("long").alias("n"))
    decisions = decisions.union(broken.select(F.lit("p"), "a", "b", nothing, F.lit(0).cast("long"))).union(counts.filter("kind = 'h'").select("kind", "a", nothing, nothing, "paged"))
    hashed = texts.filter(F.length("text") > FIT_LEAST).withColumn("h", F.xxhash64("text"))
    low = hashed.select("h").distinct().orderBy("h").limit(4 * FIT_TEXTS).agg(F.max("h")).first()[0]
    sample = clean_starts(hashed.filter(F.col("h") <= F.lit(low)).select("text")) if low is not None else []
    clean = sample[:FIT_TEXTS]
    titles = [r[0] for r in names.filter("name is not null").select("name").distinct().orderBy("name").limit(FIT_NAMES).collect()] if names is not None else []
    rnd = random.Random(8)
    header, number = train_furniture([(consistent(t), rnd.choice(titles or ["Example Holdings Plc"])) for t in clean])
    if decisions.count() > max_broadcast:
        return Repairer({}, set(), {}, header, number, decisions)
    return Repairer(*_split_decisions(decisions.toArrow().to_pylist()), header, number)


def _split_decisions(rows: list[dict]) -> tuple[dict[str, str], set[tuple[str, str]], dict[str, int]]:
    """Corrections, broken pairs and header keys of (kind, a, b, v, n)."""
    return {r["a"]: r["v"] for r in rows if r["kind"] == "w"}, {(r["a"], r["b"]) for r in rows if r["kind"] == "p"}, {r["a"]: r["n"] for r in rows if r["kind"] == "h"}


def with_decisions(texts: DataFrame, decisions: DataFrame) -> DataFrame:
    """``texts`` with ``__decisions``: those on the words, pairs and line keys of each text; equal texts are looked up once."""
    key = lambda df: df.withColumns({"__h": F.xxhash64("text"), "__h2": F.xxhash64("text", F.lit(17))})

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: list[list] = [[], [], [], [], []]
        for h, h2, t in zip(*(batch.column(i).to_pylist() for i in range(3))):
            lines = lines_of(t)
            lines = [lines[k] for k in paged_lines(lines)]
            asked = {("w", word_of(x), "") for l in lines for x in l.split()} | {("h", key_of(l), "") for l in lines}
            for _, _, a, b in hyphen_pairs(lines, repeats(lines)):
                asked |= {("p", a, b), ("w", a + b, "")}
            for kind, a, b in asked:
                for col, v in zip(out, (h, h2, kind, a, b)):
                    col.append(v)
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=["h", "h2", "kind", "a", "b"])

    once = key(texts.filter("text is not null and text <> ''").select("text").distinct()).select("__h", "__h2", "text")
    asked = map_arrow(once, fn, "h long, h2 long, kind string, a string, b string")
    found = asked.join(decisions, ["kind", "a", "b"]).groupBy("h", "h2").agg(F.collect_list(F.struct("kind", "a", "b", "v", "n")).alias("__decisions"))
    return key(texts).join(found, F.expr("__h = h and __h2 = h2"), "left").select(*texts.columns, "__decisions")


def map_texts(texts: DataFrame, repairer: Repairer, fn, schema) -> DataFrame:
    """``fn(repairer, batch)`` over ``texts``, the repairer having the decisions that the texts of the batch need."""
    tables, repairer.decisions = repairer.decisions, None
    shared = texts.sparkSession.sparkContext.broadcast(repairer)
    repairer.decisions = tables
    if tables is None:
        return map_arrow(texts, lambda batch: fn(shared.value, batch), schema)

    def joined(batch: pa.RecordBatch) -> pa.RecordBatch:
        base = shared.value
        rows = [r for part in batch.column(batch.num_columns - 1).to_pylist() for r in part or ()]
        own = Repairer(*_split_decisions(rows), base.header, base.number)
        return fn(own, pa.RecordBatch.from_arrays(batch.columns[:-1], names=batch.schema.names[:-1]))

    return map_arrow(with_decisions(texts, tables), joined, schema)


def spoilt_lines(texts: DataFrame, repairer: Repairer) -> DataFrame:
    """(src, rec_id, line_no, kind) of ``texts`` (src, rec_id, text)."""

    def fn(repairer: Repairer, batch: pa.RecordBatch) -> pa.RecordBatch:
        out: list[list] = [[], [], [], []]
        laid = [(src, rec, at, lines) for src, rec, t in zip(*(batch.column(i).to_pylist() for i in range(3))) if (at := paged_lines(lines := lines_of(t)))]
        for (src, rec, at, _), (kinds, _) in zip(laid, repairer.judge_all([[lines[k] for k in at] for _, _, at, lines in laid])):
            for k, found in kinds.items():
                for kind in found:
                    for col, v in zip(out, (src, rec, at[k], kind)):
                        col.append(v)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, [pa.string(), pa.int64(), pa.int32(), pa.string()])], names=["src", "rec_id", "line_no", "kind"])

    return map_texts(texts.filter("text is not null and text <> ''").select("src", "rec_id", "text"), repairer, fn, "src string, rec_id long, line_no int, kind string").distinct()


def repair_texts(texts: DataFrame, repairer: Repairer) -> DataFrame:
    """``texts`` with the column ``text`` repaired."""
    at = texts.columns.index("text")

    def fn(repairer: Repairer, batch: pa.RecordBatch) -> pa.RecordBatch:
        cols = list(batch.columns)
        cols[at] = pa.array(repairer.repair_all(cols[at].to_pylist()), pa.string())
        return pa.RecordBatch.from_arrays(cols, names=batch.schema.names)

    return map_texts(texts, repairer, fn, texts.schema)
