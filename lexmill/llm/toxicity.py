"""Toxicity by maximum-scoring segments.

Each word has a log-odds of standing in toxic rather than other documents. Its Dirichlet prior is that of the longest shorter
beginning of the word which the labelled rows know (beginnings of 3 to 8 letters), whose prior is that of the next shorter
one, down to the share of all words that toxic documents have; so words never seen before are scored by their stem. Less a drift
that makes ordinary text score below zero, these are the steps of a walk, and a linear-time scan (Ruzzo and Tompa) finds all of its
maximal segments, the toxic passages. By extreme-value theory the best segment of n words of ordinary text reaches S with
probability 1 - exp(-K n exp(-lambda S)); lambda solves E[exp(lambda x)] = 1 over ordinary words and K is fitted to the ordinary
labelled rows. What a passage has above that, lambda S - ln(K n), is its significance; the sum over all significant
passages and the greatest one are what a logistic curve turns into the document's score.

The model learns from labelled rows whose crc32(doc_id as text) mod 3 isn't 1, TRAIN of them at most (by a hash of doc_id); a row
that is used to fit the curve is scored without its own counts. Words in fewer than 3 such rows are left to their stems. Everything
else, the scan of all documents above all, covers all rows and whole texts.

Defined results: null, empty and wordless texts have no passage and get the curve's lowest score; without labelled rows of
both kinds every score is 0; repeated rows get equal scores; texts are scanned whole, however long, in linear time; of passages with
equal scores all are returned; an empty table gives no rows; rows with a null doc_id are not held out; a document with several
labels is toxic if one says so. Labels, language, source and doc_id are not looked at in scoring. Other columns pass through
`score`, whatever their names, but for those that it returns.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import by_place, cut, documents

#: Labelled rows that the model is fitted on, at most (about).
TRAIN = 12_000
LEAST_ROWS, STRENGTH, DRIFT = 3, 4.0, 1.0
SHORTEST, LONGEST = 3, 8
#: Words whose score a worker remembers, at most.
TABLE = 300_000
find_words = re.compile(r"[^\W\d_]+").findall


def features(word: str) -> list[str]:
    """What is known of a word, from the most general to the word itself."""
    return [word[:k] + "+" for k in range(SHORTEST, min(LONGEST, len(word) - 1) + 1)] + [word]


class Odds:
    """Log-odds of words from how many toxic and other rows have each feature."""

    def __init__(self, counts: dict[str, tuple[int, int]], toxic: float, other: float):
        self.counts, self.share = counts, toxic / (toxic + other)
        self.zero = math.log(self.share / (1 - self.share))
        self.known: dict[str, float] = {}

    def of(self, word: str, own: tuple[int, int] = (0, 0)) -> float:
        """own: what the row itself has added to the counts of each feature of the word."""
        share = self.share
        for f in features(word):
            if (c := self.counts.get(f)) is not None:
                t, o = c[0] - own[0], c[1] - own[1]
                share = (t + STRENGTH * share) / (t + o + STRENGTH)
        return math.log(share / (1 - share)) - self.zero - DRIFT

    def steps(self, words: list[str]) -> list[float]:
        if len(self.known) > TABLE:
            self.known.clear()
        known = self.known
        for w in set(words).difference(known):
            known[w] = self.of(w)
        return list(map(known.__getitem__, words))


def segments(steps: np.ndarray) -> list[tuple[float, int, int]]:
    """All maximal-scoring segments: score, first word, end.

    Each candidate keeps a link to the last one before it that starts at a lower sum. A search goes along these links only, and
    what it passes over is never met by a later one; a merge takes its candidates off the list. So the time is linear.
    """
    total, at = np.cumsum(steps), np.flatnonzero(steps > 0)
    lefts, rights, firsts, ends, links = [], [], [], [], []  # sum before, sum after, first, end, link
    for i, left, right in zip(at.tolist(), (total[at] - steps[at]).tolist(), total[at].tolist()):
        first, j = i, len(lefts) - 1
        while j >= 0 and lefts[j] >= left:
            j = links[j]
        while j >= 0 and rights[j] < right:
            left, first, before = lefts[j], firsts[j], links[j]
            for column in (lefts, rights, firsts, ends, links):
                del column[j:]
            j = before
        lefts.append(left)
        rights.append(right)
        firsts.append(first)
        ends.append(i + 1)
        links.append(j)
    return [(right - left, first, end) for left, right, first, end in zip(lefts, rights, firsts, ends)]


def solve_lambda(values: np.ndarray, weights: np.ndarray) -> float:
    """The positive root of E[exp(lambda x)] = 1."""
    weights = weights / weights.sum()
    low, high = 1e-3, 1e-3
    while high < 50 and (weights * np.exp(np.minimum(high * values, 700))).sum() < 1:
        low, high = high, high * 1.5
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if (weights * np.exp(np.minimum(mid * values, 700))).sum() < 1 else (low, mid)
    return low


def evidence(found: list[tuple[float, int, int]], n: int, scale: float, k: float) -> tuple[float, float]:
    """The sum of the significances of all passages that have one, and the greatest."""
    above = [x for s, _, _ in found if (x := scale * s - math.log(max(k * n, 1e-12))) > 0]
    return sum(above), max(above, default=0.0)


def fit_curve(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of a logistic curve (Newton's method, ridge 1e-2 but for the constant)."""
    x = np.column_stack((np.ones(len(x)), x))
    w, ridge = np.zeros(x.shape[1]), np.diag([1e-6] + [1e-2] * (x.shape[1] - 1))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + ridge, x.T @ (y - p) - ridge @ w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


def shape(x: np.ndarray) -> np.ndarray:
    return np.column_stack((np.log1p(x[:, 0]), np.log1p(x[:, 1])))


class Model:
    def __init__(self, odds: Odds | None, scale: float = 1.0, k: float = 1.0, curve: np.ndarray | None = None):
        self.odds, self.scale, self.k, self.curve = odds, scale, k, curve

    def passages(self, text: str) -> tuple[list[tuple[float, int, int]], int]:
        words = find_words(text.lower())
        return (segments(np.array(self.odds.steps(words))) if words else []), len(words)

    def evidence(self, text: str) -> tuple[float, float]:
        found, n = self.passages(text)
        return evidence(found, n, self.scale, self.k)

    def scores(self, texts: list[str]) -> np.ndarray:
        if self.odds is None:
            return np.zeros(len(texts))
        if not texts:
            return np.zeros(0)
        x = shape(np.array([self.evidence(t) for t in texts]))
        return 1 / (1 + np.exp(-np.clip(np.column_stack((np.ones(len(x)), x)) @ self.curve, -30, 30)))


def remainder(doc_id: str = "doc_id"):
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3


def training_rows(docs: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """text and toxic of the labelled rows to learn from."""
    able = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (remainder() != 1)).select("doc_id", (F.col("toxic") > 0).alias("toxic"))
    able = able.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = able.count()
    if n > most:
        able = able.filter(F.xxhash64("doc_id") < F.lit(int((most << 64) // n) - (1 << 63)))
    return docs.select("doc_id", "text").join(F.broadcast(able), "doc_id").select("text", "toxic")


def fit(docs: DataFrame, labels: DataFrame, most: int = TRAIN) -> Model:
    """Learns from docs (doc_id, text) and labels (doc_id, toxic). What comes to the driver is bounded by `most` rows' words."""
    rows = cut(training_rows(docs, labels, most), "toxic_rows")
    sizes = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(sizes) < 2:
        return Model(None)

    def count(batches):
        for batch in batches:
            toxic, other = Counter(), Counter()
            for text, label in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
                (toxic if label else other).update({f for w in set(find_words((text or "").lower())) for f in features(w)})
            names = list(toxic | other)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([toxic[f] for f in names], pa.int64()), pa.array([other[f] for f in names], pa.int64())], names=["f", "t", "o"])

    counts = rows.mapInArrow(count, "f string, t long, o long").groupBy("f").agg(F.sum("t").alias("t"), F.sum("o").alias("o"))
    counts = counts.filter(F.col("t") + F.col("o") >= LEAST_ROWS).toArrow()
    odds = Odds(dict(zip(counts.column("f").to_pylist(), zip(counts.column("t").to_pylist(), counts.column("o").to_pylist()))), sizes[True], sizes[False])
    del counts

    def leave_out(batches):
        for batch in batches:
            out = []
            for text, label in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
                words = find_words((text or "").lower())
                own = {w: odds.of(w, (1, 0) if label else (0, 1)) for w in set(words)}
                steps = np.array([own[w] for w in words])
                bins = Counter(np.round(steps, 1).tolist()) if not label else {}
                out.append((bool(label), len(words), [s for s, _, _ in segments(steps)] if words else [], list(bins), list(bins.values())))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.bool_(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.list_(pa.int64())))], names=["toxic", "n", "found", "values", "weights"])

    seen = rows.mapInArrow(leave_out, "toxic boolean, n long, found array<double>, values array<double>, weights array<long>").toArrow()
    values, weights = (np.array(seen.column(c).combine_chunks().flatten()) for c in ("values", "weights"))
    scale = solve_lambda(values, weights) if len(values) else 1.0
    toxic, n = np.array(seen.column("toxic")), np.array(seen.column("n"))
    found = seen.column("found").to_pylist()
    best = np.array([max(f, default=0.0) for f in found])
    plain = ~toxic & (n > 0)
    k = plain.sum() / max(1e-9, (n[plain] * np.exp(-scale * best[plain])).sum()) if plain.any() else 1.0
    x = shape(np.array([evidence([(s, 0, 0) for s in f], int(m), scale, k) for f, m in zip(found, n)]))
    return Model(odds, scale, float(k), fit_curve(x, toxic.astype(float)))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs without text, with score and passages (score, first word, end word of each significant one)."""
    plain, names, back = by_place(docs, ("text",), ("text", "score", "passages"))
    rest = [plain.schema[n] for n in names if n != "text"]
    span = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("first", T.IntegerType()), T.StructField("end", T.IntegerType())])
    out = T.StructType([*rest, T.StructField("score", T.DoubleType()), T.StructField("passages", T.ArrayType(span))])
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("score", pa.float64()), ("first", pa.int32()), ("end", pa.int32())]))

    def run(batches):
        own = shared.value
        for batch in batches:
            marks, spans = [], []
            for text in batch.column("text"):
                found, n = own.passages(text.as_py() or "") if own.odds else ([], 0)
                marks.append(evidence(found, n, own.scale, own.k))
                spans.append([{"score": s, "first": a, "end": b} for s, a, b in found if own.scale * s > math.log(max(own.k * n, 1e-12))])
            if own.odds and marks:
                x = shape(np.array(marks))
                scores = 1 / (1 + np.exp(-np.clip(np.column_stack((np.ones(len(x)), x)) @ own.curve, -30, 30)))
            else:
                scores = np.zeros(len(marks))
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in rest), pa.array(scores, pa.float64()), pa.array(spans, kind)], names=out.names)

    return back(plain.select(*(f.name for f in rest), "text").mapInArrow(run, out))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = score(docs, model)
    return scored.select("doc_id", F.coalesce(remainder() == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), F.size("passages").alias("n_passages"))
