"""Problem 10: personal information inside free text.

A linear-chain conditional random field tags every token of every text as part of an e-mail, phone, identity number, address or
person, or as nothing. Its features are word shapes, the words of a small labelled table (``labelled.py``) around
the token, and whether the token lies on a number, mail or address pattern. It is trained from that table by numpy on the
driver, once in a process, and broadcast (a fixed size). Texts are read in batches as arrays of characters: tokens, word numbers,
shapes and features come from array operations, tags by Viterbi over all texts of a batch at once. Spans are those of the best path;
an exact check follows (a number, mail or address must be a whole pattern, a name must consist of capitalised words).

A text of any length is read whole, in stretches of ``STRETCH`` characters that overlap by ``OVERLAP`` on each side; a span belongs to the
stretch it begins in. Look-alike and full-width characters are read in their consistent form; what is reported is the exact
substring of the stored text.

Defined results: null and empty texts hold nothing and stay as they are; a datum found twice in a document is one row of the
report and is replaced at every place; repeated documents are treated alike; other columns pass untouched.
"""

from __future__ import annotations

import random
import re
from bisect import bisect_right
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow
from .labelled import KINDS, STREETS, TITLES, examples, vocabulary
from .text_form import MAPPING

TAGS = ["O"] + [f"{p}-{k}" for k in KINDS for p in "BI"]
STRETCH, OVERLAP, BATCH_CHARS = 6_000, 400, 600_000
_STREET = "|".join(sorted((re.escape(s) for s in STREETS), key=len, reverse=True))
_TITLE = "|".join(sorted({re.escape(t.rstrip(".")) for t in TITLES if "(" not in t and t != "M."}, key=len, reverse=True))
_DOT = r"(?:\.|\s?(?:\(dot\)|\[dot\]|\{dot\})\s?|\sdot\s)"
_AT = r"(?:\s?(?:@|\(at\)|\[at\]|\{at\})\s?)"
EMAIL = re.compile(rf"[\w.+-]*\w(?:{_AT}[\w-]+(?:{_DOT}[\w-]+)+|\sat\s[\w-]+(?:\sdot\s[\w-]+)+)", re.I)
_CAP = r"[A-ZÀ-Þ][\w'’-]*"
ADDRESS = re.compile(
    rf"(?<![\w/.-])(?:(?:(?:Flat|Block|Plot|House|Suite|Apartment|Apt|Km|No)\.?\s+[A-Z]?\d+[A-Z]?,?\s+)+(?:(?:No\.?\s+)?\d+[A-Z]?,?\s+)?|(?:No\.?\s+)?\d+[A-Z]?,?\s+)"
    rf"(?:{_CAP}\s+){{1,3}}(?:{_STREET})(?![\w]),?\s+{_CAP}(?:\s+(?:City|Harcourt|Town|{_CAP}(?=,)))?(?:,\s+{_CAP}(?:\s+(?:City|Harcourt|Town))?)?"
)
NUMBER = re.compile(r"(?<![\w/.,@-])(?:\+\d|\(\d|\d|[A-Z]{1,3}\d)(?:[ \n]?[-().][ \n]?\(?(?=\d)|[ \n]\(?(?=\d)|\)[ \n-]?(?=\d)|[\dA-Z]){5,26}(?<![( -])(?![\w/]|[.,-]\d|%)")
_PHONE = re.compile(r"\+|00|0|\(0|234|1")

# Classes of characters; the separator stands between texts.
_SPACE, _WORD, _DIGIT, _OTHER, _PAD = range(5)
_SEPARATOR = "\U0010ffff"
_BASE = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(maxsize=1)
def _tables() -> dict[str, np.ndarray]:
    """Per character: class, lower-case form, upper and lower flags, length and character of the consistent form, shape of a sign."""
    size = 0x110000
    cls = np.full(size, _OTHER, dtype=np.uint8)
    low = np.arange(size, dtype=np.uint32)
    up, down = np.zeros(size, dtype=bool), np.zeros(size, dtype=bool)
    for i in [*range(0x3400), *range(0xA000, 0xAC00), *range(0xF900, 0x11000), *range(0x1D400, 0x1D800), *range(0x1F100, 0x1F200)]:
        c = chr(i)
        cls[i] = _SPACE if c.isspace() else _DIGIT if c.isdecimal() else _WORD if c.isalnum() else _OTHER
        up[i], down[i] = c.isupper(), c.islower()
        if len(c.lower()) == 1:
            low[i] = ord(c.lower())
    for lo, hi in ((0x3400, 0xA000), (0xAC00, 0xD7A4), (0x20000, 0x32000)):  # ideographs and syllables
        cls[lo:hi] = _WORD
    cls[ord("\n")], cls[ord(_SEPARATOR)] = _OTHER, _PAD
    times, to = np.ones(size, dtype=np.uint8), np.arange(size, dtype=np.uint32)
    for a, b in MAPPING.items():
        if len(a) == 1:
            times[ord(a)] = len(b)
            to[ord(a)] = ord(b[0]) if b else 0
    sign = np.full(size, SHAPES.index("?"), dtype=np.uint8)
    for s in SIGNS:
        sign[ord(s)] = SHAPES.index(s)
    number = cls == _DIGIT
    number[[ord(s) for s in " \n-().+ABCDEFGHIJKLMNOPQRSTUVWXYZ"]] = True
    return {"cls": cls, "low": low, "up": up, "down": down, "times": times, "to": to, "sign": sign, "number": number}


_LONGER = {ord(a): b for a, b in MAPPING.items() if len(a) == 1 and len(b) > 1}
CLASSES = ["", "B-E", "I-E", "B-A", "I-A", "B-T", "I-T", "B-D", "I-D", "B-L", "I-L"]
SIGNS = ".,;:()@\n\"'-/&|+"
SHAPES = ["<>", "d1", "d2", "d3", "d4", "d5", *SIGNS, "?", "X", "XX", "Xx", "x"]


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base, and of its inverse, modulo 2^64."""
    inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
    return tuple(np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n, b, dtype=np.uint64))]) for b in (_BASE, inverse))


def hash_of(word: str) -> int:
    """The number of a word, as ``Stream`` has it."""
    h, power = 0, 1
    for c in word:
        h, power = h + (ord(c) + 1) * power, power * int(_BASE)
    return h & ((1 << 64) - 1)


class Stream:
    """Texts as one array of characters in their consistent form, and its tokens.

    ``chars`` (``form`` as a string) have two separators before, between and after the texts; ``origin`` is the place of each
    character among the stored ones, ``begins`` where each text begins. Tokens are words (an apostrophe between letters is part of
    one), runs of digits, single signs, line ends and separators: ``start``, ``end``, ``cls``, ``hash`` of the lower-case form, ``shape``.
    """

    def __init__(self, texts: list[str]):
        table = _tables()
        between = _SEPARATOR * 2
        joined = between + "".join(t + between for t in texts)
        raw = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        self.raw_begins = np.cumsum([2, *(len(t) + 2 for t in texts)])
        self.origin: np.ndarray | None = None
        self.chars, self.form, self.begins = raw, joined, self.raw_begins
        to, times = table["to"][raw], table["times"][raw]
        if (to != raw).any():
            self.origin = np.repeat(np.arange(len(raw)), times)
            self.chars = np.repeat(to, times)
            before = np.cumsum(times, dtype=np.int64) - times
            for i in np.nonzero(times > 1)[0]:
                b = _LONGER[int(raw[i])]
                self.chars[before[i] : before[i] + len(b)] = [ord(x) for x in b]
            self.form = self.chars.tobytes().decode("utf-32-le", "surrogatepass")
            self.begins = np.append(before, len(self.chars))[self.raw_begins]
        c = table["cls"][self.chars]
        mark = np.nonzero((self.chars == 0x27) | (self.chars == 0x2019))[0]
        c[mark[(c[mark - 1] == _WORD) & (c[mark + 1] == _WORD)]] = _WORD
        turn = np.ones(len(c), dtype=bool)
        turn[1:] = (c[1:] != c[:-1]) | (c[1:] >= _OTHER)
        at = np.nonzero(turn)[0]
        keep = c[at] != _SPACE
        self.start, self.end = at[keep], np.append(at[1:], len(c))[keep]
        self.cls = c[self.start]
        powers, inverse = _powers(1 << max(12, len(c).bit_length()))
        sums = np.zeros(len(c) + 1, dtype=np.uint64)
        np.cumsum((table["low"][self.chars].astype(np.uint64) + np.uint64(1)) * powers[: len(c)], out=sums[1:])
        self.hash = (sums[self.end] - sums[self.start]) * inverse[self.start]
        self.shape = self._shapes(table)

    def _shapes(self, table: dict[str, np.ndarray]) -> np.ndarray:
        first, size = self.chars[self.start], self.end - self.start
        ups, downs = (np.concatenate([[0], np.cumsum(table[x][self.chars], dtype=np.int64)]) for x in ("up", "down"))
        capital = (ups[self.end] > ups[self.start]) & (downs[self.end] == downs[self.start])
        x = SHAPES.index("X")
        word = np.where(capital, np.where(size == 1, x, x + 1), np.where(table["up"][first], x + 2, x + 3))
        return np.select([self.cls == _WORD, self.cls == _DIGIT, self.cls == _OTHER], [word, np.minimum(size, 5), table["sign"][first]], 0)

    def stored(self, text: int, a: int, b: int) -> tuple[int, int]:
        """Begin and end in the stored text of the characters from ``a`` to ``b``."""
        x, y = (a, b - 1) if self.origin is None else (int(self.origin[a]), int(self.origin[b - 1]))
        return x - int(self.raw_begins[text]), y + 1 - int(self.raw_begins[text])


_STREET_HASHES = np.array(sorted({hash_of(s.rstrip(".").lower()) for s in STREETS}), dtype=np.uint64)


def covers(stream: Stream) -> list[tuple[int, int, str]]:
    """Disjoint (begin, end, class) of the patterns: E mail, A address, T phone-like, D digits, L letters and digits.

    A pattern is tried where it can match: at signs and words for `at`, at street words, and in runs of the characters of
    numbers with seven digits or more.
    """
    s, out, done = stream.form, [], 0
    for p in _mail_places(stream):
        a = p - 1 if s[p - 1].isspace() else p
        while a > done and (s[a - 1].isalnum() or s[a - 1] in "_.+-"):
            a -= 1
        if a >= done and (m := EMAIL.match(s, a)):
            out.append((*m.span(), "E"))
            done = m.end()
    done, mails = 0, [a for a, _, _ in out]
    free = lambda m, at: (k := bisect_right(at, m.start())) >= 0 and (k == 0 or out[k - 1][1] <= m.start()) and (k == len(at) or at[k] >= m.end())
    addresses = []
    for t in np.nonzero(np.isin(stream.hash, _STREET_HASHES))[0].tolist():
        if not s[stream.start[t]].isupper() or stream.start[t] < done:
            continue
        j = t
        while j and stream.cls[j - 1] != _PAD:
            x = int(stream.start[j - 1])
            if (stream.cls[j - 1] == _OTHER and s[x] not in ".,-'’_\n") or (stream.cls[j - 1] == _WORD and not s[x].isupper() and s[x - 1].isspace()):
                break
            j -= 1
        m = ADDRESS.search(s, max(done, int(stream.start[j])), int(stream.end[t]) + 200)
        if m:
            done = m.end()
            if free(m, mails):
                addresses.append((*m.span(), "A"))
    out = sorted(out + addresses)
    taken = [a for a, _, _ in out]
    is_number = _tables()["number"][stream.chars]
    edge = np.nonzero(np.diff(np.concatenate([[False], is_number, [False]]).astype(np.int8)))[0].reshape(-1, 2)
    digits = np.concatenate([[0], np.cumsum(_tables()["cls"][stream.chars] == _DIGIT)])
    numbers = []
    for a, b in edge[digits[edge[:, 1]] - digits[edge[:, 0]] >= 7].tolist():
        for m in NUMBER.finditer(s, a, b + 3):
            v = m.group()
            n = sum(c.isdigit() for c in v)
            if n >= 7 and not ("\n" in v and "." in v) and free(m, taken):
                numbers.append((*m.span(), "L" if any(c.isalpha() for c in v) else "T" if _PHONE.match(v) and 10 <= n <= 15 else "D"))
    return sorted(out + numbers)


def _mail_places(stream: Stream) -> list[int]:
    """Where an e-mail address goes from its name to its host: at-signs, brackets around `at`, the space before a spoken `at`."""
    s = stream.form
    out = set(np.nonzero(stream.chars == 0x40)[0].tolist())
    for t in np.nonzero(stream.hash == np.uint64(hash_of("at")))[0].tolist():
        a = int(stream.start[t])
        if s[a - 1] + s[a + 2] in ("()", "[]", "{}"):
            out.add(a - 1)
    for t in np.nonzero(stream.hash == np.uint64(hash_of("dot")))[0].tolist():
        b = int(stream.start[t]) - 1
        a = b
        while s[b].isspace() and (s[a - 1].isalnum() or s[a - 1] in "_-"):
            a -= 1
        if a < b and s[a - 1].isspace() and s[a - 3 : a - 1].lower() == "at" and s[a - 4].isspace():
            out.add(a - 4)
    return sorted(out)


class Tagger:
    """Feature columns are numbers in blocks; ``weights`` has a row per number and a column per tag."""

    def __init__(self, words: set[str]):
        known = sorted((hash_of(w), w) for w in words)
        self.hashes = np.array([h for h, _ in known], dtype=np.uint64)  # word number: place + 2; 0: beyond the text, 1: unknown
        v, s, c = len(known) + 2, len(SHAPES), len(CLASSES)
        self.sizes = [v, v, v, v, v, s**3, s**3, s**3, v * s, v * s, c * s, c * v, c * v, c * v]
        self.offsets = np.concatenate([[0], np.cumsum(self.sizes)[:-1]])
        self.weights = np.zeros((sum(self.sizes), len(TAGS)), dtype=np.float32)
        self.trans = np.zeros((len(TAGS) + 1, len(TAGS)), dtype=np.float32)  # last row: begin

    def words_of(self, stream: Stream) -> np.ndarray:
        at = np.searchsorted(self.hashes, stream.hash)
        at[at == len(self.hashes)] = 0
        return np.where(stream.cls == _PAD, 0, np.where(self.hashes[at] == stream.hash, at + 2, 1)) if len(self.hashes) else np.where(stream.cls == _PAD, 0, 1)

    def blocks(self, stream: Stream, spans: list[tuple[int, int, str]]) -> list[np.ndarray]:
        """The column of each block for every token; the last three are those of the tokens on patterns."""
        n, nv, ns = len(stream.start), len(self.hashes) + 2, len(SHAPES)
        w, sh = (np.concatenate([[0, 0], x, [0, 0]]) for x in (self.words_of(stream), stream.shape))
        cls, before, before2, after = (np.zeros(n, dtype=np.int64) for _ in range(4))
        if spans:
            first = np.searchsorted(stream.start, [a for a, _, _ in spans])
            stop = np.searchsorted(stream.start, [b for _, b, _ in spans])
            for k, e, (_, _, kind) in zip(first.tolist(), stop.tolist(), spans):
                if k < e:
                    c = CLASSES.index(f"B-{kind}")
                    cls[k], cls[k + 1 : e] = c, c + 1
                    before[k:e], before2[k:e], after[k:e] = w[k + 1], w[k], w[e + 2]
        tri = (sh[:-2] * ns + sh[1:-1]) * ns + sh[2:]
        out = [w[2:-2], w[1:-3], w[3:-1], w[:-4], w[4:], tri[1:-1], tri[:-2], tri[2:], w[1:-3] * ns + sh[2:-2], w[3:-1] * ns + sh[2:-2], cls * ns + sh[2:-2], cls * nv + before, cls * nv + before2, cls * nv + after]
        return [x + o for x, o in zip(out, self.offsets.tolist())]

    def emissions(self, stream: Stream, spans: list[tuple[int, int, str]]) -> np.ndarray:
        """The sum of the weights of each token's features, tokens x tags."""
        blocks = self.blocks(stream, spans)
        em = self.weights[blocks[0]]
        for b in blocks[1:11]:
            em += self.weights[b]
        plain = self.weights[self.offsets[11:]]
        em += plain.sum(axis=0)
        on = np.nonzero(blocks[11] >= self.offsets[11] + len(self.hashes) + 2)[0]
        for b, p in zip(blocks[11:], plain):
            em[on] += self.weights[b[on]] - p
        return em

    def decode(self, em: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The tags of the best path of each sequence: rows ``first`` to ``first + sizes`` of ``em``; other rows get 0.

        All sequences advance together, longest first, so that those still running are the first ones.
        """
        tags = np.zeros(len(em), dtype=np.int64)
        order = np.argsort(-sizes, kind="stable")
        first, sizes = first[order], sizes[order]
        alive = [int(x) for x in np.searchsorted(-sizes, -np.arange(int(sizes.max(initial=0))), side="left")]
        trans, scores = self.trans[:-1, :, None].astype(np.float32), []
        for t, n in enumerate(alive):
            here = em[first[:n] + t].T
            if t:
                s = scores[-1][:, :n]
                s = (s[:, None] + trans).max(axis=0) + here
                if t % 32 == 0:
                    s -= s.max(axis=0)
            else:
                s = here + self.trans[-1][:, None]
            scores.append(s)
        best = np.zeros(len(first), dtype=np.int64)
        later = 0
        for t in range(len(alive) - 1, -1, -1):
            n = alive[t]
            if later:
                best[:later] = (scores[t][:, :later] + self.trans[:-1][:, best[:later]]).argmax(axis=0)
            best[later:n] = scores[t][:, later:n].argmax(axis=0)
            tags[first[:n] + t] = best[:n]
            later = n
        return tags


def _forward_backward(em: np.ndarray, alive: list[int], trans: np.ndarray):
    """Scaled forward and backward tables (steps x sequences x tags) and log Z of sequences in falling order of length."""
    t_max, b, k = em.shape
    top = em.max(axis=2, keepdims=True)
    e, move = np.exp(em - top), np.exp(trans[:-1])
    a, be, scale = np.zeros_like(em), np.zeros_like(em), np.ones((t_max, b))
    for t, n in enumerate(alive):
        x = e[t, :n] * (a[t - 1, :n] @ move if t else np.exp(trans[-1]))
        scale[t, :n] = x.sum(axis=1)
        a[t, :n] = x / scale[t, :n, None]
    for t in range(t_max - 1, -1, -1):
        n = alive[t]
        later = alive[t + 1] if t + 1 < t_max else 0
        be[t, later:n] = 1.0
        if later:
            be[t, :later] = ((be[t + 1, :later] * e[t + 1, :later] / scale[t + 1, :later, None]) @ move.T)
    return a, be, e, scale, move


def labelled_texts(sentences: list[list[tuple[str, str | None]]], seed: int = 9) -> tuple[list[str], list[list[tuple[int, int, str]]]]:
    """Texts of one to five sentences each, and (begin, end, kind) of what is labelled in them."""
    rnd = random.Random(seed)
    pool = list(sentences)
    rnd.shuffle(pool)
    texts, marks = [], []
    while pool:
        s, found = "", []
        for _ in range(rnd.randint(1, 5)):
            for text, kind in pool.pop() if pool else ():
                if kind:
                    found.append((len(s), len(s) + len(text), kind))
                s += text
            s += rnd.choice(("\n", "\n", " ", "\n\n"))
        texts.append(s)
        marks.append(found)
    return texts, marks


def train(sentences: list[list[tuple[str, str | None]]] | None = None, rounds: int = 45, rate: float = 0.15, penalty: float = 0.02) -> Tagger:
    """A tagger fitted to the labelled table by Adam on the penalised conditional likelihood."""
    tagger = Tagger(vocabulary())
    texts, marks = labelled_texts(examples() if sentences is None else sentences)
    stream = Stream(texts)
    y = np.zeros(len(stream.start), dtype=np.int64)
    for begin, found in zip(stream.begins.tolist(), marks):
        for a, b, kind in found:
            i, j = np.searchsorted(stream.start, [begin + a, begin + b])
            y[i:j], y[i] = TAGS.index(f"I-{kind}"), TAGS.index(f"B-{kind}")
    first, sizes = sequences(stream)
    order = np.argsort(-sizes, kind="stable")
    first, sizes = first[order], sizes[order]
    row = np.repeat(np.arange(len(first)), sizes)
    pos = np.concatenate([np.arange(n) for n in sizes])
    token = first[row] + pos
    x = np.stack(tagger.blocks(stream, covers(stream)), axis=1)[token]
    y = y[token]
    used, inverse = np.unique(x.ravel(), return_inverse=True)
    x = inverse.reshape(x.shape)
    alive = [int(n) for n in np.searchsorted(-sizes, -np.arange(int(sizes.max())), side="left")]
    k, width = len(TAGS), x.shape[1]
    by_column = np.argsort(x.ravel(), kind="stable")
    starts = np.searchsorted(x.ravel()[by_column], np.arange(len(used)))
    rows_by_column = by_column // width
    w, trans = np.zeros((len(used), k), dtype=np.float32), np.zeros((k + 1, k))
    pair = np.nonzero(pos > 0)[0]
    seen = np.zeros((k, k))
    np.add.at(seen, (y[pair - 1], y[pair]), 1.0)
    moments = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(trans), np.zeros_like(trans)]
    for r in range(1, rounds + 1):
        em = np.zeros((len(alive), len(sizes), k))
        flat = w[x[:, 0]]
        for f in range(1, width):
            flat += w[x[:, f]]
        em[pos, row] = flat
        a, be, e, scale, move = _forward_backward(em, alive, trans)
        p = (a * be)[pos, row]
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(len(y)), y] -= 1.0
        gw = np.add.reduceat(p.astype(np.float32)[rows_by_column], starts, axis=0) + penalty * w
        gt = penalty * trans
        gt[-1] += p[pos == 0].sum(axis=0)
        i, t = row[pair], pos[pair]
        gt[:-1] += (a[t - 1, i].T @ (be[t, i] * e[t, i] / scale[t, i][:, None])) * move - seen
        for value, g, m, v in ((w, gw, moments[0], moments[1]), (trans, gt, moments[2], moments[3])):
            m *= 0.9
            m += 0.1 * g
            v *= 0.99
            v += 0.01 * g * g
            value -= rate * (m / (1 - 0.9**r)) / (np.sqrt(v / (1 - 0.99**r)) + 1e-8)
    tagger.weights[used] = w
    tagger.trans = trans.astype(np.float32)
    for i, tag in enumerate(TAGS):  # an inside follows its own kind only
        if tag[0] == "I":
            for j, prev in enumerate([*TAGS, "begin"]):
                if prev[2:] != tag[2:]:
                    tagger.trans[j, i] = -1e4
    return tagger


@lru_cache(maxsize=1)
def trained() -> Tagger:
    """The tagger of the labelled table, fitted once in a process."""
    return train()


def sequences(stream: Stream) -> tuple[np.ndarray, np.ndarray]:
    """(first token, number of tokens) of each text."""
    first, last = np.searchsorted(stream.start, stream.begins[:-1]), np.searchsorted(stream.start, stream.begins[1:] - 2)
    return first, last - first


_LEGAL = re.compile(r"\b(?:plc|ltd|limited|inc|bank|cement|foods|refinery|insurance|petroleum|telecoms|towers|paints|breweries|energy)\b", re.I)
_COMPANY = re.compile(r"\b(?:plc|ltd|limited|inc)\b", re.I)
# Words that begin or end no name, and those that do only after a title.
_FUNCTION = frozenset("a an and as at by for from if in is it its make no not of on or our per so than that the this to under we when while with also where there these those here after before between".split())
_NO_NAME = _FUNCTION | frozenset("upper lower port saint são côte note page phase read table tables north south east west new january february march april may june july august september october november december".split())
_TITLED = re.compile(rf"(?:(?:{_TITLE})\b\.?\s+(?:\(\w+\.?\)\s*)?)+")
_TITLE_BEFORE = re.compile(rf"(?<!\w)(?:{_TITLED.pattern})$")
_CUT = re.compile(r"(?<=[^\W\d_]{2})\.\s")
_PARTICLES = frozenset("de la le el al bin van von da di dos".split())


def _is_name(s: str, a: int, b: int, title: int = -1) -> bool:
    """The exact check of a name: two to five capitalised words, one comma at most, no company, no sentence in capitals.

    ``title``: where a title before the name begins; after one a single word will do, also one that is otherwise no name.
    """
    words = re.findall(r"[^\W\d_]+(?:['’-][^\W\d_]+)*", s[a:b])
    titled = title >= 0
    no_name, company = (_FUNCTION, _COMPANY) if titled else (_NO_NAME, _LEGAL)
    if not 2 - titled <= len(words) <= 5 or s.count(",", a, b) > 1 or re.search(r"\d|[;:!?\"/()]|\s\s|\n.*\n", s[a:b]):
        return False
    if words[0].lower() in no_name or words[-1].lower() in no_name:
        return False
    if any(not w[0].isupper() and w not in _PARTICLES for w in words) or not any(len(w) > 1 for w in words):
        return False
    after = re.match(r"\W{1,3}([^\W\d_]+)", s[b : b + 40].partition(_SEPARATOR)[0])
    if company.search(s[a:b]) or after and (company if titled and len(words) > 1 else _LEGAL).fullmatch(after[1]):
        return False
    if all(w.isupper() for w in words):
        a = title if titled else a
        before = re.search(r"([^\W\d_]{2,})\W{0,3}$", s[max(0, a - 40) : a].rpartition(_SEPARATOR)[2])
        return not (before and before[1].isupper() or after and len(after[1]) > 1 and after[1].isupper())
    return True


_NAME_END = re.compile(r"[\s,.;:()\"'-]+$")


_FITS = {"email": "E", "address": "A", "phone": "TD", "id_number": "TDL"}


def checked(s: str, a: int, b: int, kind: str, patterns: list[tuple[int, int, str]]) -> list[tuple[int, int]]:
    """What of a tagged span passes the exact check; ``patterns`` are those the span touches."""
    if kind != "person":
        return [(a, b)] if any((x, y) == (a, b) and c in _FITS[kind] for x, y, c in patterns) else []
    titled = _TITLED.match(s, a, b)
    title = a if titled else -1
    a = titled.end() if titled else a
    if not titled and (ahead := _TITLE_BEFORE.search(s[max(0, a - 40) : a])):
        title = max(0, a - 40) + ahead.start()
    cut = _CUT.search(s, a, b)
    b = a + len(_NAME_END.sub("", s[a : cut.start() if cut else b]))
    return [(a, b)] if _is_name(s, a, b, title) and not any(a < y and x < b for x, y, c in patterns if c in "EA") else []


def stretches(texts: list[str | None]) -> list[tuple[int, int, int, int, str]]:
    """(text, begin of the part, first and last place where its spans may begin, part), cut at white space where there is any."""
    out = []
    for n, t in enumerate(texts):
        lo = 0
        while t and lo < len(t):
            hi = lo + STRETCH
            if hi >= len(t) - OVERLAP:
                hi = len(t)
            a, b = max(0, lo - OVERLAP), min(len(t), hi + OVERLAP)
            while 0 < a < lo and not t[a - 1].isspace():
                a += 1
            while hi < b < len(t) and not t[b].isspace():
                b -= 1
            out.append((n, a, lo, hi, t[a:b]))
            lo = hi
    return out


def tag_texts(tagger: Tagger, texts: list[str | None]) -> list[list[tuple[int, int, str]]]:
    """(begin, end, kind) in each stored text, in order and disjoint."""
    out: list[list[tuple[int, int, str]]] = [[] for _ in texts]
    parts = stretches(texts)
    lo = 0
    while lo < len(parts):
        hi, size = lo + 1, len(parts[lo][4])
        while hi < len(parts) and size < BATCH_CHARS:
            size += len(parts[hi][4])
            hi += 1
        _tag_parts(tagger, parts[lo:hi], out)
        lo = hi
    return out


def _tag_parts(tagger: Tagger, parts: list[tuple[int, int, int, int, str]], out: list[list[tuple[int, int, str]]]) -> None:
    stream = Stream([p[4] for p in parts])
    patterns = covers(stream)
    tags = tagger.decode(tagger.emissions(stream, patterns), *sequences(stream))
    on = np.nonzero(tags)[0]
    if not len(on):
        return
    begins = on[(tags[on] % 2 == 1) | ~np.isin(on - 1, on)]
    stops = np.append(begins[1:], len(tags))
    texts = (np.searchsorted(stream.begins, stream.start[begins], side="right") - 1).tolist()
    ends = [int(on[np.searchsorted(on, e) - 1]) for e in stops]
    at, done = [a for a, _, _ in patterns], set()
    for k, e, n in zip(begins.tolist(), ends, texts):
        a, b = int(stream.start[k]), int(stream.end[e])
        first = max(0, bisect_right(at, a) - 1)
        near = [p for p in patterns[first : bisect_right(at, b)] if p[0] < b and a < p[1]]
        text, shift, lo, hi, _ = parts[n]
        for x, y in checked(stream.form, a, b, TAGS[tags[k]][2:], near):
            if (x, y) in done:
                continue
            done.add((x, y))
            i, j = stream.stored(n, x, y)
            if lo <= shift + i < hi and not (out[text] and shift + i < out[text][-1][1]):
                out[text].append((shift + i, shift + j, TAGS[tags[k]][2:]))


def find_personal(df: DataFrame, id_col: str, text: str = "text") -> DataFrame:
    """(id, kind, found), distinct."""
    shared = df.sparkSession.sparkContext.broadcast(trained())

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        rows: dict = {}
        for i, t, spans in zip(ids, texts, tag_texts(shared.value, texts)):
            rows.update(dict.fromkeys((i, kind, t[a:b]) for a, b, kind in spans))
        cols = list(zip(*rows)) or [(), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(cols[0], batch.column(0).type), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string())], names=["id", "kind", "found"])

    out = map_arrow(df.filter(F.col(text).isNotNull()).select(F.col(id_col).alias("id"), F.col(text).alias("t")), fn, f"id {dict(df.dtypes)[id_col]}, kind string, found string")
    return out.withColumnRenamed("id", id_col).distinct()


def redact(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with a typed placeholder such as [EMAIL] in place of each datum in ``text``."""
    shared = df.sparkSession.sparkContext.broadcast(trained())
    at_col = df.columns.index(text)

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, new = batch.column(at_col).to_pylist(), []
        for t, spans in zip(texts, tag_texts(shared.value, texts)):
            for a, b, kind in reversed(spans):
                t = t[:a] + f"[{kind.upper()}]" + t[b:]
            new.append(t)
        cols = list(batch.columns)
        cols[at_col] = pa.array(new, pa.string())
        return pa.RecordBatch.from_arrays(cols, names=batch.schema.names)

    return map_arrow(df, fn, df.schema)
