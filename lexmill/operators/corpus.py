"""Building paired text corpora: pairing, splitting, scoring, placeholders."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import delex as D
from ..functions.text import RUBRIC, band, squeeze
from ..scratch import spread
from .state import numbered

# The classes of exhibits that an item's text can be paired with, in order of preference.
SOURCE_CLASSES = {
    "1.01": ["EX-10", "EX-2", "EX-4"],
    "1.02": ["EX-10"],
    "2.03": ["EX-10", "EX-4"],
    "3.02": ["EX-10", "EX-4"],
    "2.01": ["EX-2", "EX-10"],
    "5.02": ["EX-10"],
    "2.02": ["EX-99"],
    "7.01": ["EX-99"],
    "8.01": ["EX-99"],
}


def usable(pairs: DataFrame, least_input: int = 400, least_output: int = 150, most_output: int = 12_000) -> DataFrame:
    return pairs.filter((F.length("input") >= least_input) & F.length("output").between(least_output, most_output))


def pair_items(filings: DataFrame, exhibits: DataFrame, key: str) -> DataFrame:
    """key, item, source_ex, pairable, reason: each item with the first of its classes that is attached, unless redacted."""
    spark = filings.sparkSession
    classes = spark.createDataFrame([(i, c, p) for i, own in SOURCE_CLASSES.items() for p, c in enumerate(own)], "item string, cls string, p int")
    met = filings.join(F.broadcast(classes), "item").join(exhibits, [key, "cls"])
    best = met.groupBy(key, "item").agg(F.min_by(F.struct("cls", "redacted"), "p").alias("best"))
    rows = filings.join(best, [key, "item"], "left")
    reason = F.when(~F.col("item").isin(list(SOURCE_CLASSES)), "no source class").when(F.col("best").isNull(), "no matching exhibit").when(F.col("best.redacted"), "redacted").otherwise("")
    return rows.select(key, "item", F.col("best.cls").alias("source_ex"), F.coalesce(~F.col("best.redacted"), F.lit(False)).alias("pairable"), reason.alias("reason"))


def split_by_group(pairs: DataFrame, group: str, share: float, seed: int) -> DataFrame:
    """group, split: groups in the order of a hash; the first share of them, one at least, are for validation."""
    placed = numbered(pairs.select(group).distinct().withColumn("h", F.md5(F.concat(F.lit(f"{seed}:"), F.col(group).cast("string")))), ["h", group])
    held = max(1, int(placed.count() * share))
    return placed.select(group, F.when(F.col("n") <= held, "val").otherwise("train").alias("split"))


def rubric(rows: DataFrame, text: str, by: str, top: int = 6) -> DataFrame:
    """by, category, rate, band, place: how often each category shows, the most frequent ones of each group."""
    rates = [F.avg(F.col(text).rlike("(?i)" + pattern).cast("double")).alias(f"c{i}") for i, pattern in enumerate(RUBRIC.values())]
    wide = rows.groupBy(by).agg(*rates)
    long = wide.select(by, F.inline(F.array(*[F.struct(F.lit(name).alias("category"), F.col(f"c{i}").alias("rate")) for i, name in enumerate(RUBRIC)])))
    ranked = long.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("rate"), "category")))
    return ranked.filter(F.col("place") <= top).select(by, "category", F.round("rate", 9).alias("rate"), band(F.col("rate")).alias("band"), "place")


# Amounts, counts and percentages as they are compared; any run of digits as it must be kept.
FIGURE, DIGITS = r"\$[\d,]+(?:\.\d+)?|\b\d[\d,]*(?:\.\d+)?%?\b", r"\d[\d,.]*\d|\d"


def numbers(text: Column, pattern: str) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))


def number_recall(reference: Column, hypothesis: Column) -> Column:
    ref, hyp = numbers(reference, FIGURE), numbers(hypothesis, FIGURE)
    return F.when(F.size(ref) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(ref, hyp)) / F.size(ref))


def preserves_figures(before: Column, after: Column) -> Column:
    return F.size(F.array_except(numbers(before, DIGITS), numbers(after, DIGITS))) == 0


def number_placeholders(spans: DataFrame) -> DataFrame:
    """doc, typ, can, n: values numbered by type in the order in which they are met from the end of the text."""
    last = spans.groupBy("doc", "typ", "can").agg(F.max("start").alias("last"))
    return last.withColumn("n", F.dense_rank().over(Window.partitionBy("doc", "typ").orderBy(F.desc("last")))).drop("last")


def select_spans(spans: DataFrame) -> DataFrame:
    """doc, a, b: from left to right, longest first, the spans that begin at or after the end of the last one kept."""
    start = F.struct(F.lit(-1).alias("last"), F.array().cast("array<struct<a:int,b:int>>").alias("kept"))

    def step(acc, s):
        here = F.struct(s["a"].alias("a"), s["b"].alias("b"))
        return F.when(s["a"] >= acc["last"], F.struct(s["b"].alias("last"), F.concat(acc["kept"], F.array(here)).alias("kept"))).otherwise(acc)

    rows = spans.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("a", (-F.col("b")).alias("minus"), "b"))).alias("all"))
    return rows.select("doc", F.inline(F.aggregate("all", start, step, lambda x: x["kept"])))


def groundable(pairs: DataFrame, inputs: DataFrame, outputs: DataFrame, least: float = 0.9) -> DataFrame:
    """pair, share, kept: the share of output values (pair, typ, can) that the input has, 1 where there are none."""
    have = inputs.select("pair", "typ", "can").distinct().withColumn("hit", F.lit(1.0))
    share = outputs.join(have, ["pair", "typ", "can"], "left").groupBy("pair").agg(F.avg(F.coalesce("hit", F.lit(0.0))).alias("share"))
    rows = pairs.join(share, "pair", "left").withColumn("share", F.coalesce("share", F.lit(1.0)))
    return rows.withColumn("kept", F.col("share") >= least)


def yields(rows: DataFrame) -> DataFrame:
    """family, item, kept, total, percent, mean_kept of rows (family, item, share, kept): by item, by family and, with both null, all."""
    rows = rows.rollup("family", "item").agg(F.count_if("kept").alias("kept"), F.count(F.lit(1)).alias("total"), F.avg(F.when(F.col("kept"), F.col("share"))).alias("mean_kept"))
    return rows.withColumn("percent", F.expr("100 * kept div total"))


def metric_means(rows: DataFrame, by: str, metrics: list[str]) -> DataFrame:
    """by, n and the mean of each metric; nulls count for nothing."""
    return rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"), *(F.avg(m).alias(m) for m in metrics))


def delex_round_trip(docs: DataFrame, dealt: bool = False) -> DataFrame:
    """doc, n_placeholders, same: texts delexicalised, filled in again and compared, white space apart. dealt: docs are dealt out over all tasks already."""
    rows = docs.select("doc", "source")
    found = (rows if dealt else spread(rows)).select("doc", "source", D.spans(F.col("source")).alias("spans"))
    made = found.select("doc", "source", D.delex(F.col("source"), F.col("spans")).alias("made"))
    back = made.select("doc", "source", F.col("made.skeleton").alias("skeleton"), D.backfill(F.col("made.skeleton"), F.col("made.surfaces")).alias("back"))
    alike = (F.col("back.text") == F.col("source")) | (squeeze(F.col("back.text")) == squeeze(F.col("source")))
    return back.select("doc", F.regexp_count("skeleton", F.lit(D.PLACEHOLDER)).alias("n_placeholders"), (alike & (F.size("back.missing") == 0)).alias("same"))


def delex_pairs(pairs: DataFrame, keys: list[str], people: Callable[[Column], Column] | None = None, cores: bool = True, **how) -> DataFrame:
    """keys, input, output (skeletons with shared placeholders) and surfaces of pairs (keys, input, output): the input is numbered first, so that a placeholder
    that a model copies from it stands for the input's value. people: what recognises persons in a text; how: rules, canon and stop of `D.spans`; cores: whether
    companies' names without their endings are looked for."""
    spans = lambda c: D.spans(F.col(c), people(F.col(c)) if people else None, **how).alias(f"__{c}")
    found = pairs.select(*keys, "input", "output", spans("input"), spans("output"))
    made = found.select(*keys, D.delex_together([F.col("input"), F.col("output")], [F.col("__input"), F.col("__output")], cores).alias("made"))
    return made.select(*keys, F.get("made.skeletons", 0).alias("input"), F.get("made.skeletons", 1).alias("output"), F.col("made.surfaces").alias("surfaces"))


def groundable_texts(docs: DataFrame, least: float = 0.9, dealt: bool = False) -> DataFrame:
    """doc, share, kept: the share of the spans of a draft that its source has. dealt: docs are dealt out over all tasks already."""
    rows = docs.select("doc", "source", "draft")
    share = D.groundable_share(D.spans(F.col("source")), D.spans(F.col("draft")))
    return (rows if dealt else spread(rows)).select("doc", share.alias("share")).withColumn("kept", F.col("share") >= least)
