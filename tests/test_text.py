"""Text functions against cases written by hand."""

import pytest
from pyspark.sql import functions as F

from passagelake.functions import lang, text


def one(spark, column_of, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column_of(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(
    "value, want",
    [
        (None, ""), ("", ""), ("A—b–c", "a-b-c"), ("[x] {y} (z) <w> | * _ # ` ~", "x y z w"), ("a‌b‍c", "abc"), (" a \t b ", "a b"),
        ("ÀÉ\n\nx", "àé x"),
    ],
)
def test_normalize_text(spark, value, want):
    assert one(spark, text.normalize_text, value) == want


def test_tokens_and_terms(spark):
    assert one(spark, text.tokenize, "Hello, পার্বতী-ও naïve 12") == ["hello", lang.nfc("পার্বতী"), lang.nfc("ও"), "na", "ve", "12"]
    assert one(spark, text.query_terms, lang.nfc("x কে পার্বতী কে পার্বতী of of")) == [lang.nfc("পার্বতী"), "of"]
    assert one(spark, text.query_terms, None) == []


@pytest.mark.parametrize(
    "question, kind",
    [
        ("পার্বতীর বিয়ে কোথায় হয়েছিল?", "marriage"), ("সে কোথায় থাকে কখন?", "where"), ("কখন আসিল কেন?", "when"), ("কে আসিল", "who"), ("একে দেখ", "what"), ("কেন গেল", "why"), ("কীভাবে গেল", "how"),
        ("", "what"), (None, "what"),
    ],
)
def test_question_types(spark, question, kind):
    assert one(spark, text.question_type, lang.nfc(question) if question else question) == kind


def test_variants(spark):
    got = one(spark, text.expanded_queries, lang.nfc(" তাহার মৃত্যু  কোথায়? "))
    assert len(got) == 3 and got[0] == lang.nfc("তাহার মৃত্যু কোথায়?")
    assert got[1].startswith(got[0]) and got[2].endswith(lang.nfc("মরেছে"))
    assert len(one(spark, text.expanded_queries, "plain")) == 2
    assert one(spark, text.expanded_queries, None) == []


def test_stem(spark):
    for word, want in (("মানুষদের", "মানুষ"), ("নদীর", "নদী"), ("ঘর", "ঘর"), ("word", "word")):
        assert one(spark, text.stem, lang.nfc(word)) == lang.nfc(want)


def test_digits_and_chapters(spark):
    assert one(spark, text.ascii_digits, "১২৩") == "123" and one(spark, text.bengali_digits, 450, "int") == "৪৫০"
    for name, n in (("ষোড়শ পরিচ্ছেদ", 16), ("Chapter 7 of 9", 7), ("অধ্যায় ১২", 12), ("শেষ", None), ("", None)):
        assert one(spark, text.chapter_number, lang.nfc(name)) == n


@pytest.mark.parametrize("value, want", [("a [1] b [2, ৩] [9] [1]", [1, 2, 3]), ("(1) {2} [x] []", []), ("[ ৪ ، 5 ]", [4, 5]), (None, []), ("[99999999999]", [])])
def test_citations(spark, value, want):
    assert one(spark, lambda c: text.extract_citations(c, F.lit(5)), value) == want


def test_answers(spark):
    assert one(spark, text.clean_answer, "```markdown\nAnswer :  yes [1]\n```") == "yes [1]"
    assert one(spark, text.clean_answer, lang.nfc(" উত্তর: হ্যাঁ ")) == lang.nfc("হ্যাঁ")
    assert one(spark, text.abstains, "It was NOT  found.") and one(spark, text.abstains, "বইয়ে পাওয়া যায়নি") and not one(spark, text.abstains, "found")


def clean(spark, value, drops=(), marks=()):
    df = spark.createDataFrame([(value,)], "x string")
    arrays = [F.array(*map(F.lit, a)) if a else None for a in (drops, marks)]
    return text.cleaned(df, "x", *arrays).first()["x"]


def test_clean_text(spark):
    assert clean(spark, "a​b c\r\n  x \t y \n") == "ab c\nx y"
    assert clean(spark, "a\n\n\n\n\nb\n\nc") == "a\n\nb\n\nc"
    assert clean(spark, "12\n১০০–১১০\nno 12\n3 - 4") == "no 12"
    assert clean(spark, "Title\nkeep", ["Title "]) == "keep"
    long = "Book Author" + "x" * 149
    assert clean(spark, "Book Author 5\nBook only\n" + long, (), ["Book", "Author", ""]) == "Book only"
    assert clean(spark, long + "x", (), ["Book", "Author"]) == long + "x"
    assert clean(spark, "য়") == clean(spark, "য়")
    assert clean(spark, "") == "" and clean(spark, None) is None


def test_urls(spark):
    got = one(spark, lambda c: text.page_url("https://h", c), "দেব দাস/প্রথম (a):b~c+d*")
    assert got.startswith("https://h/wiki/%E0") and got.endswith("_(a):b~c%2Bd%2A")
    assert one(spark, text.url_title, got) == one(spark, text.normalize_query, "দেব_দাস/প্রথম_(a):b~c+d*").replace(" ", "_")
    assert one(spark, text.normalize_title, " a_b ") == "a b" and one(spark, text.chapter_name, "x/y/z") == "z"


def test_small_things(spark):
    assert one(spark, text.percent, 0.125, "double") == "12%" and one(spark, text.percent, 0.375, "double") == "38%"
    assert one(spark, text.md_escape, "a|b\nc") == "a\\|b c"
    assert one(spark, text.title_key, "x") == "11f6ad8ec52a"
    assert one(spark, lambda c: text.first_truthy(F.lit(""), c, F.lit("z")), "") == "z"
    assert one(spark, text.page_number_line, "১২") and not one(spark, text.page_number_line, "12a")
