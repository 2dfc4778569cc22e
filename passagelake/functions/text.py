"""Text functions over columns. All but NFC are built from Spark's own functions."""

from __future__ import annotations

import unicodedata
import urllib.parse
from collections.abc import Callable
from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from . import lang

# Characters that are removed or replaced.
INVISIBLE = "\u200b\u200e\u200f\u2060\ufeff\u00ad\u202a\u202c"
BRACKETS = "[]{}()<>|*_#`~"
#: The white space of Python's str.strip and \s, as a regex class body.
SPACE = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: The same characters, one by one; all but the space itself.
SPACES = "".join(c for c in map(chr, range(0x21, 0x3001)) if c.isspace()) + "\t\n\v\f\r\x1c\x1d\x1e\x1f"
TOKEN = r"[\x{980}-\x{9ff}]+|[a-zA-Z0-9]+"
DIGIT = f"[0-9{lang.BENGALI_DIGITS}]"
CITATION = rf"\[[{SPACE}]*({DIGIT}+(?:[{SPACE}]*[,،][{SPACE}]*{DIGIT}+)*)[{SPACE}]*\]"


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def bound(x: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once a row, however often ``use`` names it."""
    return F.get(F.transform(F.array(x), use), F.lit(0))


def any_of(haystack: Column, needles: list[str]) -> Column:
    """Whether a text contains one of the words."""
    return reduce(or_, [F.contains(haystack, F.lit(n)) for n in needles]) if needles else F.lit(False)


@pandas_udf(T.StringType())
def nfc(texts: pd.Series) -> pd.Series:
    """Unicode NFC; Spark has no function for it."""
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def strip(x: Column | str) -> Column:
    return F.btrim(col(x), F.lit(SPACES + " "))


def collapse(x: Column | str) -> Column:
    """White space to one space, ends stripped."""
    return _one_space(F.translate(col(x), SPACES, " " * len(SPACES)))


def _one_space(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, "  +", " "))


def drop_invisible(x: Column | str) -> Column:
    return F.translate(col(x), INVISIBLE, "")


def plain_spaces(x: Column | str) -> Column:
    """No-break spaces to spaces, carriage returns away."""
    return F.translate(col(x), "\u00a0\r", " ")


def normalize_query(x: Column | str) -> Column:
    return collapse(drop_invisible(nfc(col(x))))


def normalize_text(x: Column | str) -> Column:
    """Lower case, joiners away, dashes and brackets plain, white space collapsed."""
    t = F.translate(F.coalesce(col(x), F.lit("")), "—–" + BRACKETS + SPACES + "\u200c\u200d", "--" + " " * len(BRACKETS + SPACES))
    return F.lower(_one_space(t))


def tokenize(x: Column | str) -> Column:
    return F.regexp_extract_all(normalize_text(x), F.lit(TOKEN), F.lit(0))


def query_terms(x: Column | str) -> Column:
    """Distinct tokens of two characters or more that are no stop words, in order."""
    stops = F.array(*[F.lit(w) for w in lang.STOP_WORDS])
    return F.array_distinct(F.filter(tokenize(x), lambda t: (F.char_length(t) > 1) & ~F.array_contains(stops, t)))


def question_type(x: Column | str) -> Column:
    return bound(normalize_text(x), type_of)


def type_of(normalized: Column) -> Column:
    """:func:`question_type` of a question that is normalised already and stands in a column."""
    out = None
    for name, words, pattern in lang.QUESTION_TYPES:
        test = any_of(normalized, words)
        if pattern:
            test = normalized.rlike(pattern) | test
        out = F.when(test, name) if out is None else out.when(test, name)
    return out.otherwise(lang.DEFAULT_TYPE)


def by_type(kind: Column, values: dict[str, str]) -> Column:
    """A lookup in a small table keyed by question type."""
    pairs = [F.lit(x) for kv in values.items() for x in kv]
    return F.coalesce(F.create_map(*pairs)[kind], F.lit(values[lang.DEFAULT_TYPE]))


def expanded_queries(x: Column | str, most: int = 3) -> Column:
    """At most three variants: the question, with the hints of its type, and with the
    lexical variants it calls for; distinct after normalising. The question is stripped,
    collapsed and normalised once; what is added to it is, apart from it."""
    stripped = strip(x)
    hints = {k: " ".join(v) for k, v in lang.HINTS.items()}

    def variant(q: Column, more: Column) -> Column:
        return F.struct(F.trim(F.concat(q["key"], F.lit(" "), normalize_text(more))).alias("key"), F.trim(F.concat(q["text"], F.lit(" "), collapse(more))).alias("text"))

    def spread(q: Column) -> Column:
        extra = F.array_distinct(F.flatten(F.array(*[F.when(any_of(q["raw"], when), F.array(*[F.lit(w) for w in words])).otherwise(F.array().cast("array<string>")) for when, words in lang.VARIANTS])))
        lexical = bound(F.array_join(extra, " "), lambda e: F.when(e != "", variant(q, e)))
        variants = F.filter(F.array(F.struct(q["key"].alias("key"), q["text"].alias("text")), bound(by_type(type_of(q["key"]), hints), lambda h: variant(q, h)), lexical), lambda v: v["text"].isNotNull())
        empty = F.array().cast("array<struct<key:string,text:string>>")
        distinct = F.aggregate(variants, empty, lambda seen, v: F.when((v["key"] == "") | F.exists(seen, lambda s: s["key"] == v["key"]), seen).otherwise(F.concat(seen, F.array(v))))
        return F.slice(F.transform(distinct, lambda v: v["text"]), 1, most)

    return bound(bound(stripped, lambda q: F.struct(q.alias("raw"), normalize_text(q).alias("key"), collapse(q).alias("text"))), spread)


def _marker_share(content: Column, markers: list[str]) -> Column:
    hits = sum((F.contains(content, F.lit(m)).cast("int") for m in markers), F.lit(0))
    return F.least(hits / F.lit(3.0), F.lit(1.0))


def hint_scores(normalized: Column | str) -> Column:
    """By question type, :func:`hint_score` of a text that is normalised already."""
    return F.create_map(*[x for kind, markers in lang.MARKERS.items() for x in (F.lit(kind), _marker_share(col(normalized), markers))])


def hint_score(kind: Column, text: Column | str) -> Column:
    """Markers of the question's type in the text, three or more count as 1."""
    scores = bound(normalize_text(text), hint_scores)
    return bound(scores, lambda s: F.coalesce(s[kind], s[F.lit(lang.DEFAULT_TYPE)]))


def stem(x: Column | str) -> Column:
    """The first case ending that matches goes if three characters or more stay."""
    t = col(x)
    out = None
    for s in lang.SUFFIXES:
        test = t.endswith(s) & (F.char_length(t) - len(s) >= 3)
        value = F.left(t, F.char_length(t) - len(s))
        out = F.when(test, value) if out is None else out.when(test, value)
    return out.otherwise(t)


def ascii_digits(x: Column | str) -> Column:
    return F.translate(col(x), lang.BENGALI_DIGITS, lang.ASCII_DIGITS)


def bengali_digits(x: Column | str) -> Column:
    return F.translate(col(x).cast("string"), lang.ASCII_DIGITS, lang.BENGALI_DIGITS)


def chapter_number(x: Column | str) -> Column:
    """The ordinal of the first word, else the first run of digits, else null."""
    name = strip(col(x))
    first = F.split(name, rf"[{SPACE}]+")[0]
    ordinals = F.create_map(*[F.lit(v) for kv in lang.ORDINALS.items() for v in kv])
    digits = F.nullif(F.regexp_extract(name, f"({DIGIT}+)", 1), F.lit(""))
    return F.coalesce(ordinals[first], ascii_digits(digits).try_cast("int"))


def chapter_name(title: Column | str) -> Column:
    return F.substring_index(col(title), "/", -1)


def normalize_title(x: Column | str) -> Column:
    return strip(F.replace(nfc(col(x)), F.lit("_"), F.lit(" ")))


def page_url(host: str, title: Column | str) -> Column:
    """Host + /wiki/ + the percent-encoded title; / : ( ) stay, spaces are _."""
    out = F.url_encode(F.replace(col(title), F.lit(" "), F.lit("_")))
    for code, ch in (("%2F", "/"), ("%3A", ":"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        out = F.replace(out, F.lit(code), F.lit(ch))
    return F.concat(F.lit(host + "/wiki/"), F.replace(out, F.lit("*"), F.lit("%2A")))


def url_title(url: Column | str) -> Column:
    """The title in a page address; + is a plain character there."""
    tail = F.regexp_extract(col(url), r"/wiki/(.*)$", 1)
    return nfc(F.url_decode(F.replace(tail, F.lit("+"), F.lit("%2B"))))


def book_of_url(url: str) -> str:
    return unicodedata.normalize("NFC", urllib.parse.unquote(url.partition("/wiki/")[2])).replace("_", " ")


def extract_citations(x: Column | str, most: Column) -> Column:
    """Numbers in [n] and [n, m] from 1 to ``most``, distinct, in order."""
    bodies = F.regexp_extract_all(F.coalesce(col(x), F.lit("")), F.lit(CITATION), F.lit(1))
    parts = F.flatten(F.transform(bodies, lambda b: F.split(ascii_digits(b), "[,،]")))
    numbers = F.transform(parts, lambda p: strip(p).try_cast("int"))
    return F.array_distinct(F.filter(numbers, lambda n: n.between(F.lit(1), most)))


def clean_answer(x: Column | str) -> Column:
    """Without code fences and an answer prefix."""
    t = strip(F.coalesce(col(x), F.lit("")))
    t = F.regexp_replace(t, rf"(?i)^```(?:text|markdown)?[{SPACE}]*", "")
    t = F.regexp_replace(t, rf"[{SPACE}]*```$", "")
    return strip(F.regexp_replace(t, rf"(?iu)^(?:{'|'.join(lang.ANSWER_PREFIXES)})[{SPACE}]*:[{SPACE}]*", ""))


def abstains(x: Column | str) -> Column:
    return any_of(normalize_text(nfc(F.coalesce(col(x), F.lit("")))), lang.ABSTENTION)


def page_number_line(x: Column | str) -> Column:
    return col(x).rlike(rf"^{DIGIT}+$|^{DIGIT}+[{SPACE}]*[-–—][{SPACE}]*{DIGIT}+$")


def clean_text(x: Column | str, drop_lines: Column | None = None, header_markers: Column | None = None) -> Column:
    """Lines tidied; furniture, headers and page numbers away. ``drop_lines`` and
    ``header_markers`` are arrays of strings. Works on NFC text; :func:`cleaned` makes
    it first, since Spark allows no Python function inside its array functions."""
    none = F.array().cast("array<string>")
    drops, marks = F.coalesce(drop_lines if drop_lines is not None else none, none), F.coalesce(header_markers if header_markers is not None else none, none)
    drops, marks = F.transform(drops, strip), F.transform(F.filter(marks, lambda m: m.isNotNull() & (m != "")), strip)
    lines = F.transform(F.split(plain_spaces(drop_invisible(x)), "\n"), lambda s: strip(F.regexp_replace(s, r"[ \t]+", " ")))

    def stays(s: Column) -> Column:
        found = F.size(F.filter(marks, lambda m: F.contains(s, m)))
        return (s == "") | ~(F.array_contains(drops, s) | ((F.char_length(s) <= 160) & (found >= 2)) | page_number_line(s))

    return strip(F.regexp_replace(F.array_join(F.filter(lines, stays), "\n"), r"\n{3,}", "\n\n"))


def cleaned(df: DataFrame, column: str, drop_lines: Column | None = None, header_markers: Column | None = None) -> DataFrame:
    """``df`` with ``column`` cleaned; text, lines and markers in NFC."""
    none = F.array().cast("array<string>")
    parts = df.withColumns({"pl_text": nfc(col(column)), "pl_drops": nfc_all(drop_lines if drop_lines is not None else none), "pl_marks": nfc_all(header_markers if header_markers is not None else none)})
    return parts.withColumn(column, clean_text("pl_text", F.col("pl_drops"), F.col("pl_marks"))).drop("pl_text", "pl_drops", "pl_marks")


@pandas_udf(T.ArrayType(T.StringType()))
def nfc_all(arrays: pd.Series) -> pd.Series:
    return arrays.map(lambda a: None if a is None else [None if s is None else unicodedata.normalize("NFC", s) for s in a])


def md_escape(x: Column | str) -> Column:
    return F.replace(F.replace(col(x), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))


def percent(x: Column | str) -> Column:
    """Whole percents, half to even on the binary value."""
    return F.concat(F.bround(col(x) * 100, 0).cast("int").cast("string"), F.lit("%"))


def time_label(x: Column | str) -> Column:
    """A moment as it is written beside a fetched page, in the session's time zone."""
    return F.date_format(col(x), "yyyy-MM-dd HH:mm:ss")


def title_key(x: Column | str) -> Column:
    return F.substring(F.sha1(col(x)), 1, 12)


def first_truthy(*xs: Column | str) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*[F.nullif(col(x), F.lit("")) for x in xs])
