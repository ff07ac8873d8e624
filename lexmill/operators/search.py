"""Hybrid retrieval: exact vector top-k and keyword top-k, fused by reciprocal rank, hydrated and reranked."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import verify_quote
from ..scratch import written
from .text_index import TextIndex, top

K_RRF = 60


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine_distance(a: Column, b: Column) -> Column:
    return 1 - dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def literal_vector(v: list[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in v])


def tokens(text: Column) -> Column:
    """The simple analyzer: lower-cased runs of ASCII letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def with_rank(top: DataFrame, order: list[Column], name: str) -> DataFrame:
    """rank 1, 2, ... over a top-k that is small by then."""
    return top.withColumn(name, F.row_number().over(Window.orderBy(*order)))


def vector_topk(df: DataFrame, query: list[float], k: int, id_col: str = "doc_id") -> DataFrame:
    scored = df.select(id_col, cosine_distance(F.col("embedding"), literal_vector(query)).alias("distance"))
    top = scored.orderBy("distance", id_col).limit(k)
    return with_rank(top, [F.col("distance"), F.col(id_col)], "rank")


def keyword_topk(df: DataFrame, query: str, k: int, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows that have every token of the query; score: how often they occur together."""
    asked = sorted(set(re.findall("[a-z0-9]+", query.lower())))
    counts = [_count(q) for q in asked]
    found = df.filter(F.lit(bool(asked)))
    for q in asked:  # a cheap test before any token is made out
        found = found.filter(F.contains(F.lower(text), F.lit(q)))
    found = found.withColumn("tokens", tokens(F.col(text)))
    for c in counts:
        found = found.filter(c > 0)
    score = sum(counts, F.lit(0)) if counts else F.lit(0)
    top = found.select(id_col, score.cast("long").alias("score")).orderBy(F.desc("score"), id_col).limit(k)
    return with_rank(top, [F.desc("score"), F.col(id_col)], "rank")


def _count(word: str) -> Column:
    return F.size(F.filter(F.col("tokens"), lambda t: t == word))


def rrf(legs: list[DataFrame], id_col: str = "doc_id") -> DataFrame:
    """id, score: the sum of 1 / (60 + rank) over legs; first: where it was first seen, to break ties as lists would."""
    rows = None
    for i, leg in enumerate(legs):
        part = leg.select(id_col, (1.0 / (K_RRF + F.col("rank"))).alias("part"), (F.lit(i * 1000) + F.col("rank")).alias("seen"))
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy(id_col).agg(F.sum("part").alias("score"), F.min("seen").alias("first_seen"))


def overlap_score(query: str, text: Column) -> Column:
    """The offline reranker: the share of the query's distinct tokens that the text has."""
    asked = F.array(*[F.lit(w) for w in sorted(set(re.findall("[a-z0-9]+", query.lower())))])
    return F.size(F.array_intersect(asked, F.array_distinct(tokens(text)))) / F.greatest(F.size(asked), F.lit(1))


def hybrid(df: DataFrame, query: str, vector: list[float], k: int = 8, leg: int = 20, pool: int = 30, rerank: bool = False, index: TextIndex | None = None) -> DataFrame:
    """The k best hits of df (scoped and filtered already), with rrf_score, score and reranked. With a stored index of the texts the keyword leg
    reads only the query's postings."""
    vec = vector_topk(df.filter(F.col("embedding").isNotNull()), vector, leg)
    key = keyword_topk(df, query, leg) if index is None else with_rank(top(index, query, leg, df), [F.desc("score"), F.col("doc_id")], "rank")
    fused = rrf([vec, key]).orderBy(F.desc("score"), "first_seen", "doc_id").limit(max(k, pool if rerank else k))
    hits = fused.select("doc_id", F.col("score").alias("rrf_score"), "first_seen").join(df, "doc_id")
    score = overlap_score(query, F.col("text")) if rerank else F.col("rrf_score")
    hits = hits.withColumn("score", score.cast("double")).withColumn("reranked", F.lit(rerank))
    return hits.orderBy(F.desc("score"), F.desc("rrf_score"), "first_seen", "doc_id").limit(k)


#: Words of the runs by which quotes and documents meet; short quotes that are looked for in one pass.
RUN, SHORT = 5, 256


def find_quotes(items: DataFrame, docs: DataFrame) -> DataFrame:
    """item_id, doc_id: every quote of items (item_id, quote) with every document (doc_id, text) that it stands in, as `verify_quote` has it.

    Any match holds the quote's longest segment, and so each run of RUN of its whole words (all but the first and the last, which may be cut)
    as words of the document. Quotes meet documents by that of their runs which the fewest documents have, and are then verified. Quotes
    too short for a run are looked for in the texts themselves, SHORT in one pass over the documents.
    """
    words = lambda x: F.filter(F.split(x, r"(?U)\s+"), lambda w: w != "")
    segments = F.transform(F.split("quote", r"(?U)\s*(?:\.{3}|…)\s*"), words)
    longest = F.array_max(F.transform(segments, lambda s: F.struct(F.size(s).alias("n"), s.alias("words"))))
    items = items.withColumn("longest", longest).withColumn("n", F.col("longest.n"))

    def runs_of(w: Column, first: int, last: Column) -> Column:
        return F.when(last >= first, F.array_distinct(F.transform(F.sequence(F.lit(first), F.when(last >= first, last).otherwise(first)), lambda i: F.xxhash64(F.slice(w, i, RUN)))))

    w = F.col("words")
    runs = items.filter(F.col("n") >= RUN + 2).select("item_id", "quote", F.explode(runs_of(F.col("longest.words"), 2, F.col("n") - RUN)).alias("run"))
    met = docs.select("doc_id", words(F.col("text")).alias("words")).select("doc_id", F.explode(runs_of(w, 1, F.size(w) - RUN + 1)).alias("run"))
    met = written(met.join(runs.select("run").distinct(), "run", "left_semi"), "quote_runs")
    counts = met.groupBy("run").agg(F.count(F.lit(1)).alias("held"))
    rarest = runs.join(counts, "run", "left").groupBy("item_id", "quote").agg(F.min_by("run", F.struct(F.coalesce("held", F.lit(0)), F.col("run"))).alias("run"))
    found = met.join(rarest, "run").select("item_id", "quote", F.col("doc_id").alias("__doc")).distinct()
    both = docs.join(found, F.col("doc_id").eqNullSafe(F.col("__doc"))).drop("__doc").filter(verify_quote(F.col("quote"), F.col("text"))).select("item_id", "doc_id")
    short = [(r[0], r[1]) for r in items.filter(F.col("n") < RUN + 2).select("item_id", "quote").distinct().toLocalIterator()]
    for at in range(0, len(short), SHORT):
        asked = F.array(*(F.struct(F.lit(i).cast(items.schema["item_id"].dataType).alias("item_id"), F.lit(q).alias("quote")) for i, q in short[at : at + SHORT]))
        held = F.filter(asked, lambda x: verify_quote(x["quote"], F.col("text")))
        both = both.unionByName(docs.select(F.explode(held).alias("x"), "doc_id").select(F.col("x.item_id").alias("item_id"), "doc_id"))
    return both
