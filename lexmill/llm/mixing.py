"""Mixing sources to target weights by pivotal dependent rounding.

Every row of a source wants target / source_size copies, 2 at most; whole copies are certain, the fraction is rounded.
Equal rows are numbered, so that each is dealt by itself. Rows of a source are dealt into blocks in a seeded order. A block is folded from its largest row to its smallest: the running
unsettled row and the next one exchange mass at random until one of them is integral, where mass is copies times
size, so the block's words stay what they were and every row keeps its expected number of copies. The one row of
a block that stays fractional goes up to the next level, where blocks are made of such residuals, until each
source has one; that last one is rounded at random. Levels are as many as the logarithm of the rows to the base `fan`.

A source's taken words so differ from its target by less than the size of one row. All randomness is a hash of
doc_id, text, seed and level: reruns agree.

Defined results: null or wordless texts have size 0 and take 0 words; a source without words has target 0; null sources
are one source, the last; repeated rows are rounded one by one; texts are counted whole, however long; an empty table gives no rows. `mix` returns its own columns
alone; `taken_rows` returns those of its input, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import by_place, cut, documents, n_words, ranked, running, text_or_empty

#: Fractions this near to 0 or 1 are integral.
EPS = 1e-9
SETTLED = "struct<id:bigint,mark:bigint,no:bigint,size:bigint,whole:int,part:double>"


def source_targets(sizes: DataFrame, weights: list[float], share: float, most: float) -> DataFrame:
    """source, source_size, n_rows, target. sizes: source, size.

    Sources by the ratio of cap to weight: the first k are at their cap, the rest share what is left by weight; k is
    the least for which no other source goes over its cap. Both orders are made by ranges: sources may be many, as hosts are.
    """
    sums = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_rows"))
    n = F.pmod(F.col("turn"), F.lit(len(weights)))
    weighed = ranked(sums, [F.col("source").asc_nulls_last()], "turn").withColumn("weight", F.element_at(F.array(*map(F.lit, map(float, weights))), (n + 1).cast("int")))
    weighed = weighed.select("source", "source_size", "n_rows", "weight", (F.col("source_size") * F.lit(float(most))).alias("cap"))
    levels = running(weighed, [F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()], {"cap_before": "cap", "weight_before": "weight"})
    levels = cut(levels, "mix_caps")
    whole = levels.agg(F.sum("source_size"), F.sum("weight")).first()
    level = (F.lit(share * (whole[0] or 0)) - F.col("cap_before")) / (F.lit(float(whole[1] or 0)) - F.col("weight_before"))
    # The water level that holds if this source is the first that isn't full; it holds for good where it is under its cap.
    levels = levels.withColumn("level", level)
    order = F.struct(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    met = levels.filter(F.col("level") * F.col("weight") <= F.col("cap")).agg(F.min_by("level", order)).first()[0]
    return levels.select("source", "source_size", "n_rows", (F.col("cap") if met is None else F.least(F.col("cap"), F.lit(met) * F.col("weight"))).alias("target"))


def uniform(*parts: Column) -> Column:
    """A uniform number in [0, 1) from a hash."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") / F.lit(float(1 << 53))


def fold(rows: Column, seed: int, level: int) -> Column:
    """Pivotal rounding of a sorted array of SETTLED rows: struct of the settled ones and the one that stays."""

    def step(acc: Column, x: Column) -> Column:
        a = acc["open"]
        fa, fb = a["part"], x["part"]
        wa, wb = a["size"].cast("double"), x["size"].cast("double")
        ratio = wb / wa
        up, down = F.least(1 - fa, fb * ratio), F.least(fa, (1 - fb) * ratio)
        rise = uniform(F.lit(seed), F.lit(level), a["id"], a["mark"], a["no"], x["id"], x["mark"], x["no"]) * (up + down) < down
        na = F.when(rise, fa + up).otherwise(fa - down)
        nb = F.when(rise, fb - up / ratio).otherwise(fb + down / ratio)
        done_a = (na < EPS) | (na > 1 - EPS)

        def put(r: Column, f: Column) -> Column:
            return F.struct(r["id"].alias("id"), r["mark"].alias("mark"), r["no"].alias("no"), r["size"].alias("size"), r["whole"].alias("whole"), f.alias("part"))

        pair = F.struct(na.alias("na"), nb.alias("nb"), done_a.alias("done"))
        return F.element_at(
            F.transform(
                F.array(pair),
                lambda p: F.struct(
                    F.when(p["done"], put(x, p["nb"])).otherwise(put(a, p["na"])).alias("open"),
                    F.concat(acc["out"], F.array(F.when(p["done"], put(a, F.round(p["na"]))).otherwise(put(x, F.round(p["nb"]))))).alias("out"),
                ),
            ),
            1,
        )

    start = F.struct(F.element_at(rows, 1).alias("open"), F.array().cast(f"array<{SETTLED}>").alias("out"))
    return F.aggregate(F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0))), start, step)


def mix(docs: DataFrame, weights: list[float] = (5.0, 2.0, 1.0), share: float = 1.5, most: float = 2.0, seed: int = 17, fan: int = 64) -> DataFrame:
    """doc_id, mark (a hash of the text), source, size, source_size, target, copies (0, 1 or 2) and taken (copies times size).

    Sources by code point, null last, have the given weights in turn and share `share` of all words, none more than
    `most` (2 at most) times its own.
    """
    spark = docs.sparkSession
    sized = docs.select("doc_id", "source", n_words(text_or_empty()).alias("size"), F.xxhash64("text").alias("mark"))
    sized = cut(sized, "mix_sizes")
    equal = sized.groupBy("doc_id", "source", "size", "mark").agg(F.count(F.lit(1)).alias("equals"))
    targets = cut(source_targets(sized, list(weights), share, most), "mix_targets")
    wish = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(F.lit(0.0))
    # Targets are one row a source; where the sources are many they aren't broadcast, and hot ones are split at run time.
    numbered = equal.select("doc_id", "source", "size", "mark", F.explode(F.sequence(F.lit(1).cast("long"), F.col("equals"))).alias("no"))
    rows = numbered.join(targets, numbered["source"].eqNullSafe(targets["source"])).drop(targets["source"]).withColumn("wish", wish)
    nearest = F.round("wish")
    exact = F.abs(F.col("wish") - nearest) < EPS
    rows = rows.withColumn("whole", F.when(exact, nearest).otherwise(F.floor("wish")).cast("int"))
    rows = rows.withColumn("part", F.when(exact | (F.col("size") == 0), F.lit(0.0)).otherwise(F.col("wish") - F.col("whole")))
    rows = rows.withColumn("open", F.col("part") > 0)
    done = rows.filter(~F.col("open")).select("doc_id", "mark", "source", "size", F.col("whole").alias("copies"))
    todo = rows.filter("open").select("source", "n_rows", F.struct(F.col("doc_id").alias("id"), "mark", "no", "size", "whole", "part").alias("row"))
    # n: rows that a source may have at this level, at most.
    todo = todo.withColumn("n", F.col("n_rows")).drop("n_rows")
    largest, level = targets.agg(F.max("n_rows")).first()[0] or 0, 0
    while True:
        place = F.xxhash64(F.lit(seed), F.lit(level), "row.id", "row.mark", "row.no")
        block = F.pmod(place, F.ceil(F.col("n") / fan))
        blocks = todo.groupBy("source", "n", block.alias("block")).agg(F.array_sort(F.collect_list(F.struct((-F.col("row.size")).alias("by"), place.alias("at"), "row"))).alias("rows"))
        folded = blocks.select("source", F.ceil(F.col("n") / fan).alias("n"), fold(F.col("rows.row"), seed, level).alias("f"))
        folded = cut(folded, f"mix_level{level}")
        settled = folded.select("source", F.explode("f.out").alias("r"))
        done = done.unionByName(settled.select(F.col("r.id").alias("doc_id"), "r.mark", "source", "r.size", (F.col("r.whole") + F.col("r.part").cast("int")).alias("copies")))
        todo = folded.select("source", "n", F.col("f.open").alias("row"))
        largest, level = -(-largest // fan), level + 1
        if largest <= 1:
            break
    p = F.col("row.part")
    last = F.when(p < EPS, 0).when(p > 1 - EPS, 1).when(uniform(F.lit(seed), F.lit(level), "row.id", "row.mark", "row.no") < p, 1).otherwise(0)
    done = done.unionByName(todo.select(F.col("row.id").alias("doc_id"), "row.mark", "source", "row.size", (F.col("row.whole") + last).alias("copies")))
    done = done.join(targets.select(F.col("source").alias("__s"), "source_size", "target"), F.col("source").eqNullSafe(F.col("__s"))).drop("__s")
    return done.select("doc_id", "mark", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def taken_rows(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: docs' rows, each as many times as it is taken."""
    plain, rest, back = by_place(docs, ("doc_id", "text", "source"))
    picks = mix(plain, **how)
    # Repeated rows are told apart by their number among their equals, given as they stream by in sorted order; which equal gets which count doesn't matter.
    twins = Window.partitionBy("__id", "__mark", "__source").orderBy("__copies")
    picks = picks.select(F.col("doc_id").alias("__id"), F.col("mark").alias("__mark"), F.col("source").alias("__source"), F.col("copies").alias("__copies"))
    picks = picks.withColumn("__n", F.row_number().over(twins)).filter(F.col("__copies") > 0)
    own = Window.partitionBy("doc_id", "__m", "source").orderBy("__m")
    rows = plain.withColumn("__m", F.xxhash64("text")).withColumn("__i", F.row_number().over(own))
    match = rows["doc_id"].eqNullSafe(picks["__id"]) & (rows["__m"] == picks["__mark"]) & rows["source"].eqNullSafe(picks["__source"]) & (rows["__i"] == picks["__n"])
    kept = rows.join(picks, match).withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies"))))
    return back(kept.select(*rest))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "source", "text")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")
