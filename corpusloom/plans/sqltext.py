"""Fragments of the SQL that the results are checked against."""

from __future__ import annotations

from ..functions import text as T
from ..operators.annotation import GUIDANCE, SENTIMENTS, SHORT_LABELS

WS = r"\t\n\v\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
WORD = r"\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}\x{200C}\x{200D}"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^[{WS}]+|[{WS}]+$', '', 'g')"


def words(x: str) -> str:
    return f"len(regexp_extract_all({x}, '[^{WS}]+'))"


def unicode_classes(p: str) -> str:
    """A pattern with the classes of the standard meaning spelt out."""
    out, inside, i = "", False, 0
    while i < len(p):
        two = p[i : i + 2]
        if two in (r"\s", r"\d", r"\w"):
            body = {r"\s": WS, r"\d": r"\p{Nd}", r"\w": WORD}[two]
            out += body if inside else f"[{body}]"
            i += 2
            continue
        inside = True if p[i] == "[" else False if p[i] == "]" else inside
        out += p[i]
        i += 1
    return out


def clean_chain(x: str) -> str:
    """TXT-02..06 as one expression."""
    noise = q("(?i)^(?:" + "|".join(map(unicode_classes, T.NOISE_LINES)) + ")")
    t = f"array_to_string(list_filter(string_split({x}, chr(10)), lambda l: NOT regexp_matches({strip('l')}, {noise})), chr(10))"
    for p in T.BOILERPLATE:
        t = f"regexp_replace({t}, {q('(?is)' + unicode_classes(p))}, ' ', 'g')"
    for p, r in ((rf"([{WORD}]+)-\n([{WORD}]+)", r"\1\2"), (" {3,}", "  "), (r"\|{2,}", " "), (r"\.{4,}", " "), ("_{3,}", " "), (r"[\x{E000}-\x{F8FF}]", " ")):
        t = f"regexp_replace({t}, {q(p)}, {q(r)}, 'g')"
        if p == " {3,}":
            t = f"regexp_replace({t}, '\\n{{3,}}', chr(10) || chr(10), 'g')"
    for p, r in ((r"[N₦]'000", "(NGN thousands)"), (r"[N₦]'(million|billion)", r"(NGN \1)"), (r"\bnaira\b", "NGN")):
        t = f"regexp_replace({t}, {q('(?i)' + p)}, {q(r)}, 'g')"
    one = strip(f"regexp_replace(b, '[{WS}]+', ' ', 'g')")
    blocks = f"list_filter(list_transform(regexp_split_to_array({t}, '\\n[{WS}]*\\n'), lambda b: {one}), lambda b: b <> '')"
    return strip(f"regexp_replace(array_to_string({blocks}, chr(10) || chr(10)), '\\n\\n(\\p{{Ll}})', ' \\1', 'g')")


def quality(x: str) -> str:
    f, s = (q("|".join(w)) for w in (T.FORWARD_WORDS, T.SENTIMENT_WORDS))
    a, b = f"regexp_matches(lower({x}), {f})", f"regexp_matches(lower({x}), {s})"
    return f"""CASE WHEN {x} IS NULL OR {x} = '' THEN 'empty' WHEN {words(x)} < 50 THEN 'poor'
      WHEN length(regexp_replace({x}, '[^\\p{{L}}{WS}]', '', 'g')) / length({x}) < 0.6 THEN 'poor'
      WHEN len(regexp_extract_all({x}, '[.!?]')) < 3 THEN 'poor' WHEN {a} AND {b} THEN 'good' WHEN {a} OR {b} THEN 'acceptable' ELSE 'poor' END"""


def full_label(x: str) -> str:
    s = f"lower({strip(x)})"
    return f"CASE {s} " + " ".join(f"WHEN {q(a)} THEN {q(b)}" for a, b in SHORT_LABELS.items()) + f" ELSE {s} END"


def listed(values) -> str:
    return "(" + ", ".join(map(q, values)) + ")"


VOTES = f"""done AS (SELECT passage_id, lower(trim(annotator)) AS annotator, annotated_at, row_id, sentiment_label, guidance_type FROM annotation_queue WHERE annotation_status = 'done'),
last AS (SELECT *, row_number() OVER (PARTITION BY passage_id, annotator ORDER BY annotated_at DESC, row_id DESC) AS rn FROM done WHERE annotator <> '' AND passage_id IS NOT NULL),
long AS (SELECT 'sentiment' AS task, passage_id AS item, annotator, {full_label('sentiment_label')} AS label FROM last WHERE rn = 1 UNION ALL SELECT 'guidance', passage_id, annotator, {full_label('guidance_type')} FROM last WHERE rn = 1),
votes AS (SELECT * FROM long WHERE (task = 'sentiment' AND label IN {listed(SENTIMENTS)}) OR (task = 'guidance' AND label IN {listed(GUIDANCE)}))"""
