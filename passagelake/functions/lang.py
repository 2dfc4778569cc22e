"""The language pack for Bengali questions: tables, no logic.

All literals are used in NFC, on both sides of a comparison.
"""

from __future__ import annotations

import unicodedata


def nfc(x):
    """NFC of strings inside lists, tuples and dicts."""
    if isinstance(x, str):
        return unicodedata.normalize("NFC", x)
    if isinstance(x, dict):
        return {nfc(k): nfc(v) for k, v in x.items()}
    return type(x)(map(nfc, x)) if isinstance(x, (list, tuple)) else x


BENGALI_DIGITS = "০১২৩৪৫৬৭৮৯"
ASCII_DIGITS = "0123456789"

# Words that a query leaves out.
STOP_WORDS = nfc(
    "এর র কে কি কী কোথায় কখন কেন কেমন কত কীভাবে কিভাবে কার কারা কাকে কাদের সঙ্গে সহ হয় হয়েছিল ছিল ছিলেন আছে আছেন করে "
    "করতে হওয়া হওয়ার মধ্যে পরে আগে এই সে তিনি তাহার তার তাঁর ও আর এবং যে যিনি যা".split()
)

# Question types in the order they are tried. A question is of the first
# type of which it contains a word; the third element is a pattern tried first.
QUESTION_TYPES = nfc(
    [
        ("marriage", ["বিয়ে", "বিবাহ", "স্বামী", "পতি", "বিবাহিত"], ""),
        ("where", ["কোথায়"], ""),
        ("when", ["কখন", "কতদিন", "কোন দিনে", "কোন সময়"], ""),
        ("who", ["কারা", "কাকে"], r"(^|\s)কে(\s|\?|$)"),
        ("why", ["কেন", "কারণ"], ""),
        ("how", ["কীভাবে", "কিভাবে"], ""),
    ]
)
DEFAULT_TYPE = "what"

# Words that widen a query of each type.
HINTS = nfc(
    {
        "where": ["স্থান", "অবস্থান", "জায়গা", "কোথায়"],
        "when": ["সময়", "কখন", "তারিখ", "দিন", "রাত", "সকাল", "সন্ধ্যা"],
        "who": ["ব্যক্তি", "পরিচয়", "চরিত্র", "নাম", "কে"],
        "why": ["কারণ", "কেন", "কারণে", "জন্য"],
        "how": ["কীভাবে", "কিভাবে", "উপায়", "পদ্ধতি", "করে"],
        "marriage": ["বিবাহ", "বিয়ে", "স্বামী", "পতি", "বিবাহিত"],
        "what": ["পরিচয়", "অর্থ", "মানে", "কি", "কী"],
    }
)

# If a question has one of the words, these variants are added.
VARIANTS = nfc(
    [
        (["বিয়ে"], ["বিবাহ", "স্বামী", "পতি"]),
        (["মারা", "মৃত্যু", "মরেছে", "মরিতেছে"], ["মৃত্যু", "মারা", "মরিতেছে", "মরেছে"]),
        (["কলকাতা"], ["কলিকাতা"]),
        (["বাড়ি"], ["বাটী", "বাড়ী"]),
    ]
)

# Markers of evidence for each type.
MARKERS = nfc(
    {
        "where": ["গাছতলা", "বেদী", "বাড়ির", "বাটী", "স্থান", "পথ", "বাগান", "কলিকাতা", "কলকাতা"],
        "when": ["সকাল", "দুপুর", "রাত্রি", "রাত", "ভোর", "দিন", "সময়", "বেলা", "তারিখ"],
        "who": ["কহিল", "বলিল", "নাম", "পরিচয়", "তিনি", "লোকট", "ব্যক্তি"],
        "why": ["কারণ", "জন্য", "ভয়", "রাগ", "অভিমান", "রাজি", "আপত্তি"],
        "how": ["করিয়া", "করে", "পদ্ধতি", "উপায়", "গিয়াছিল", "গিয়েছিল"],
        "marriage": ["বিবাহ", "বিয়ে", "স্বামী", "পতি", "বিবাহিতা", "ঘর", "জামাই"],
        "what": ["পরিচয়", "নাম", "হলেন", "হইল", "ছিলেন", "কহিল"],
    }
)

# Case endings in the order they are tried.
SUFFIXES = nfc(["দের", "কে", "র", "এর", "ের"])

# Place words and abstention phrases.
PLACE_MARKERS = nfc(["গাছতলা", "বেদী", "বাড়ির", "বাটী", "বাড়ী", "বাগান", "পথ", "জায়গা", "স্টেশন", "বাসা", "ঘর"])
ABSTENTION = nfc(["পাওয়া যায়নি", "not found", "cannot answer"])
CAUSE_WORDS = nfc(["প্লীহা", "লিভার", "কারণে", "রোগে", "জ্বরে"])

# Ordinals of chapters.
ORDINALS = nfc(
    {
        "প্রথম": 1, "দ্বিতীয়": 2, "তৃতীয়": 3, "চতুর্থ": 4, "পঞ্চম": 5, "ষষ্ঠ": 6, "সপ্তম": 7, "অষ্টম": 8, "নবম": 9, "দশম": 10,
        "একাদশ": 11, "দ্বাদশ": 12, "ত্রয়োদশ": 13, "চতুর্দ্দশ": 14, "চতুর্দশ": 14, "পঞ্চদশ": 15, "ষোড়শ": 16, "সপ্তদশ": 17,
        "অষ্টাদশ": 18, "ঊনবিংশ": 19, "বিংশ": 20,
    }
)

# Labels in contexts and answers.
LABEL_CHAPTER, LABEL_SECTION, LABEL_SOURCE, LABEL_UNKNOWN, LABEL_PART = nfc(("অধ্যায়", "অংশ", "উৎস", "অজানা অধ্যায়", "অংশ"))
ANSWER_PREFIXES = nfc(("উত্তর", "Answer"))
EMPTY_QUESTION = nfc("প্রশ্ন লিখুন।")
