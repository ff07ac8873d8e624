"""The longest common subsequence against the usual table, and the score."""

import random
import time

import pytest

from lexmill.functions.sequences import longest_common, rouge_l, words_of


def table(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            row[j + 1], last = (last + 1 if x == y else max(row[j + 1], row[j])), row[j + 1]
    return row[-1]


def test_a_thousand_pairs():
    draw = random.Random(2)
    for _ in range(1000):
        words = "abcdefgh"[: draw.randint(1, 8)]
        a, b = ([draw.choice(words) for _ in range(draw.choice([0, 1, 5, 40, 130]))] for _ in range(2))
        assert longest_common(a, b) == table(a, b)


def test_ten_times_faster():
    draw = random.Random(4)
    a, b = ([f"w{draw.randrange(200)}" for _ in range(1500)] for _ in range(2))
    began = time.perf_counter()
    want = table(a, b)
    slow = time.perf_counter() - began
    began = time.perf_counter()
    assert longest_common(a, b) == want
    assert 10 * (time.perf_counter() - began) < slow


def test_score(spark):
    rows = [("The cats were running home.", "a cat runs home", 2 * 2 / 9), ("", "x", 0.0), (None, None, 0.0), ("same words here", "Same WORDS here!", 1.0)]
    got = spark.createDataFrame(rows, "a string, b string, want double").select("want", rouge_l("a", "b").alias("got")).collect()
    assert words_of("The cats were running") == ["the", "cat", "were", "run"]
    assert [r["got"] for r in got][1:] == [r["want"] for r in got][1:] and got[0]["got"] == pytest.approx(2 * 3 / 9)
