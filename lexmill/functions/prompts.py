"""Instructions and chat rows of training pairs, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators.filing import ITEM_TITLES
from .text import is_missing


def item_title(item: Column) -> Column:
    titles = F.create_map(*[F.lit(x) for pair in ITEM_TITLES.items() for x in pair])
    return F.coalesce(titles[item], F.lit(""))


def instruction(item: Column, family: Column, noun: Column) -> Column:
    """What a drafter is asked for; the wording is a fixed value of the training set."""
    title = item_title(item)
    contract = F.format_string(
        "You are a securities lawyer drafting a U.S. SEC Form 8-K. Based solely on the following %2$s, draft the Item %1$s (%3$s) disclosure. Disclose only the terms that are material to the registrant, in the concise, neutral style of a real 8-K, and close with the standard exhibit incorporation-by-reference sentence. Use only facts present in the %2$s.",
        item, noun, title,
    )
    other = F.format_string("You are a securities lawyer drafting a U.S. SEC Form 8-K. Based on the following %2$s, draft the Item %1$s (%3$s) disclosure in the concise, neutral style of a real 8-K, using only the facts provided.", item, noun, title)
    return F.when(family == "contract", contract).otherwise(other)


def chat(system: Column, user: Column, reply: Column) -> Column:
    """A conversation as an array of (role, content)."""
    turn = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return F.array(turn("system", system), turn("user", user), turn("assistant", reply))


def alpaca(instruction_text: Column, source: Column, reply: Column, system: Column) -> Column:
    return F.struct(system.alias("system"), instruction_text.alias("instruction"), source.alias("input"), reply.alias("output"))


def strip_thinking(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?s)<think>.*?</think>", ""))


def facts_block(clauses: Column) -> Column:
    """'name: value' lines of the clauses (name, value) that say something."""
    return F.array_join(F.transform(F.filter(clauses, lambda c: ~is_missing(c["value"])), lambda c: F.concat(F.lit("- "), c["name"], F.lit(": "), c["value"])), "\n")


def sections(items: Column, item: Column, title: Column, disclosure: Column) -> Column:
    """The sections (item, title, disclosure) of a filing, or the single one that older rows have."""
    return F.coalesce(F.when(F.size(items) > 0, items), F.array(F.struct(item.alias("item"), title.alias("title"), disclosure.alias("disclosure"))))


def detected_items(said: Column) -> Column:
    """Known item numbers in an array of answers, once each, in order."""
    numbers = F.transform(said, lambda s: F.regexp_extract(s, r"\d\.\d\d", 0))
    return F.array_distinct(F.filter(numbers, lambda n: n.isin(list(ITEM_TITLES))))


def confirmed_items(checked: Column) -> Column:
    """What a reviewer confirmed; where nothing was, the entry into an agreement."""
    return F.when(F.size(F.coalesce(checked, F.array().cast("array<string>"))) > 0, F.array_distinct(checked)).otherwise(F.array(F.lit("1.01")))
