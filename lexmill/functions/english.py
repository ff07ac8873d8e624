"""The English analyzer: words, stop words and the Porter2 stemmer, which a dictionary table applies once to each different word."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A word of the English analyzer, and of the simple one.
WORDS = {"english": r"[\p{L}\p{N}]+", "simple": "[a-z0-9]+"}

# The stop words of the English text search configuration.
STOP = frozenset(
    """i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them
    their theirs themselves what which who whom this that these those am is are was were be been being have has had having do does did doing a an the
    and but if or because as until while of at by for with about against between into through during before after above below to from up down in out
    on off over under again further then once here there when where why how all any both each few more most other some such no nor not only own same
    so than too very s t can will just don should now""".split()
)
# Words that Porter2 treats by themselves, suffixes of its steps and what replaces them.
ALONE = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
DONE = frozenset("inning outing canning herring earring proceed exceed succeed".split())
STEP_2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate",
    "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "ogi": "og", "fulli": "ful", "lessli": "less", "li": "",
}
STEP_3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
STEP_4 = dict.fromkeys("al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize ion".split(), "")
REGION = re.compile(r"[aeiouy][^aeiouy]")
SHORT = re.compile(r"(?:[^aeiouy][aeiouy][^aeiouywxY]|^[aeiouy][^aeiouy])$")
VOWEL = re.compile(r"[aeiouy]")


def past_region(word: str, at: int) -> int:
    """Where the region begins after the first consonant that follows a vowel from `at` on."""
    found = REGION.search(word, at)
    return found.end() if found else len(word)


def longest(word: str, suffixes) -> str | None:
    return max((s for s in suffixes if word.endswith(s)), key=len, default=None)


def stem(word: str) -> str:
    """The Porter2 stem of a lower-cased word."""
    if len(word) <= 2:
        return word
    if word in ALONE:
        return ALONE[word]
    word = re.sub(r"^y|(?<=[aeiouy])y", "Y", word.removeprefix("'"))
    head = re.match("gener|commun|arsen", word)
    r1 = head.end() if head else past_region(word, 0)
    r2 = past_region(word, r1)
    word = re.sub(r"'(?:s'?)?$", "", word)
    word = plural_off(word)
    if word in DONE:
        return word
    word = tense_off(word, r1)
    if len(word) > 2 and word[-1] in "yY" and not VOWEL.match(word[-2]):
        word = word[:-1] + "i"
    for steps in (STEP_2, STEP_3):
        end = longest(word, steps)
        if end and len(word) - len(end) >= r1 and fits(word, end, r2):
            word = word[: -len(end)] + steps[end]
    end = longest(word, STEP_4)
    if end and len(word) - len(end) >= r2 and (end != "ion" or word[-4] in "st"):
        word = word[: -len(end)]
    rest = len(word) - 1
    if word.endswith("e") and (rest >= r2 or rest >= r1 and not SHORT.search(word[:-1])) or word.endswith("ll") and rest >= r2:
        word = word[:-1]
    return word.replace("Y", "y")


def fits(word: str, end: str, r2: int) -> bool:
    before = word[: -len(end)]
    if end == "ogi":
        return before.endswith("l")
    if end == "li":
        return before[-1:] in tuple("cdeghkmnrt")
    return end != "ative" or len(before) >= r2


def plural_off(word: str) -> str:
    if word.endswith("sses"):
        return word[:-2]
    if word.endswith(("ied", "ies")):
        return word[:-2] if len(word) > 4 else word[:-1]
    if word.endswith("s") and not word.endswith(("us", "ss")) and VOWEL.search(word[:-2]):
        return word[:-1]
    return word


def tense_off(word: str, r1: int) -> str:
    end = longest(word, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if not end:
        return word
    before = word[: -len(end)]
    if end in ("eed", "eedly"):
        return before + "ee" if len(before) >= r1 else word
    if not VOWEL.search(before):
        return word
    if before.endswith(("at", "bl", "iz")):
        return before + "e"
    if before.endswith(("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")):
        return before[:-1]
    return before + "e" if len(before) <= r1 and SHORT.search(before) else before


@F.pandas_udf(T.StringType())
def stems(words: pd.Series) -> pd.Series:
    return words.map(stem)


def words_of(text: Column, analyzer: str) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORDS[analyzer]), F.lit(0))


def dictionary(words: DataFrame) -> DataFrame:
    """word, lexeme of the different words (word) that aren't stop words."""
    own = words.select("word").distinct()
    return own.filter(~F.col("word").isin(*sorted(STOP))).select("word", stems("word").alias("lexeme"))


def lexemes_of(query: str, analyzer: str) -> list[str]:
    """The different lexemes of a query, which is short."""
    import regex

    words = set(regex.findall(WORDS[analyzer], query.lower()))
    return sorted(words if analyzer == "simple" else {stem(w) for w in words - STOP})
