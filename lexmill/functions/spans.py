"""Positions of a pattern's matches by built-in functions, and typed spans of text as arrays of structs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Matches whose positions are summed up together.
BLOCK = 64
#: A character of the private use area that parts matches from the rest of a text while it is cut up.
MARK = "\ue000"


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), value being worked out once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def pieces(text: Column, pattern: str) -> Column:
    """Array of the pieces of text before, between and after the matches of pattern and, at odd places, of the matches: text alone where there are none.

    The pattern goes over a text once, and `split` gets a single character, since it compiles a pattern anew for each text. Texts that have this character are
    split by the pattern itself.
    """
    plain = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda b, m: F.array(b, m))
    marked = F.split(F.regexp_replace(text, F.lit(pattern), F.lit(f"{MARK}$0{MARK}")), MARK, -1)
    return F.when(F.contains(text, F.lit(MARK)), F.filter(F.flatten(plain), lambda x: x.isNotNull())).otherwise(marked)


def matches(text: Column, pattern: str, sign: str | None = None) -> Column:
    """Array of struct pos (from 0) and raw for the matches of pattern, in time that grows with their number. sign: what every match has in it, so that
    texts without it need no search.

    The pieces between matches and the matches alternate; positions are running sums of their lengths, inside one block or first over blocks,
    then inside each.
    """
    kind = "array<struct<pos:int,raw:string>>"
    long = lambda x: x["gap"] + F.length(x["raw"])

    def place(block: Column, at: Column) -> Column:
        step = lambda a, x: F.struct((a["at"] + long(x)).alias("at"), F.array_append(a["out"], F.struct((a["at"] + x["gap"]).alias("pos"), x["raw"].alias("raw"))).alias("out"))
        return F.aggregate(block, F.struct(at.alias("at"), F.array().cast(kind).alias("out")), step, lambda a: a["out"])

    def starts(blocks: Column) -> Column:
        sums = F.transform(blocks, lambda block: F.aggregate(block, F.lit(0), lambda n, x: n + long(x)))
        step = lambda a, n: F.struct((a["at"] + n).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out"))
        return F.aggregate(sums, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")), step, lambda a: a["out"])

    def whole(own: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(own) - 1) / BLOCK).cast("int")), lambda k: F.slice(own, k * BLOCK + 1, F.lit(BLOCK)))
        return F.when(F.size(own) <= BLOCK, place(own, F.lit(0))).otherwise(F.flatten(bound(blocks, lambda b: F.zip_with(b, starts(b), place))))

    def placed(own: Column) -> Column:
        pairs = F.transform(F.sequence(F.lit(1), F.size(own) - 1, F.lit(2)), lambda i: F.struct(F.length(F.get(own, i - 1)).alias("gap"), F.get(own, i).alias("raw")))
        single = F.array(F.struct(F.length(F.get(own, 0)).alias("pos"), F.get(own, 1).alias("raw")))
        return F.when(F.size(own) > 3, bound(pairs, whole)).when(F.size(own) == 3, single).otherwise(F.array().cast(kind))

    found = bound(pieces(text, pattern), placed)
    return F.when(F.contains(text, F.lit(sign)), found).otherwise(F.array().cast(kind)) if sign else found


def blanked(text: Column, pattern: str) -> Column:
    """text with every match of pattern replaced by as many blanks."""
    blank = lambda own: F.array_join(F.transform(own, lambda x, i: F.when(i % 2 == 1, F.repeat(F.lit(" "), F.length(x))).otherwise(x)), "")
    return bound(pieces(text, pattern), lambda own: F.when(F.size(own) > 1, blank(own)).otherwise(text))
