"""Drafting by a model: skeletons that hold placeholders alone, news, and rewrites with a reviewer's context; every question goes through a ledger of replies.

A skeleton is written from a source without its values, so the model can't write one: the values come back from the source, and a placeholder that the source doesn't
have becomes a marker and is reported. A rewrite counts only if all figures of what it replaces are still in it (`drafts.add_context`).
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import delex as D
from ..providers import STUB
from ..scratch import spread, written
from .drafts import BREAK, add_context
from .models import Chat
from .replies import Ledger

VERSION = "1"


def exhibit_sentence(number: Column, noun: str = "press release") -> Column:
    """The closing sentence of a news item; a fixed value."""
    return F.format_string("A copy of the %s is furnished as Exhibit %s to this Current Report on Form 8-K and is incorporated herein by reference.", F.lit(noun), number)


class DraftChat:
    """The offline stand-in: sentences with amounts, the first sentence, a note put before or, if it asks to drop figures, instead of them."""

    name = STUB

    def reply(self, task: str, text: str) -> str:
        if task == "skeleton":
            own = [s for s in text.split(". ") if "[AMOUNT_" in s]
            return ". ".join(own) or "[AMOUNT_99] is due."
        if task == "news":
            if "undisclosed" in text:
                raise ValueError("no answer")
            return json.dumps({"disclosure": text.split(". ")[0] + "."})
        asked = json.loads(text)
        opening = re.sub(r"\d", "", asked["opening"]) if "drop" in asked["note"] else asked["opening"]
        return json.dumps({"paragraph": f"{asked['note']} {opening}", "added_text": asked["note"]})


def skeletons(docs: DataFrame, ledger: Ledger, model: Chat, people: Callable[[Column], Column] | None = None) -> DataFrame:
    """doc, skeleton, disclosure, missing of docs (doc, source): disclosure is the skeleton with the source's values, missing its placeholders without one. All null where
    the model failed."""
    found = spread(docs.select("doc", "source")).select("doc", "source", D.spans(F.col("source"), people(F.col("source")) if people else None).alias("spans"))
    made = found.select("doc", D.delex(F.col("source"), F.col("spans")).alias("made")).select("doc", F.col("made.skeleton").alias("asked"), F.col("made.surfaces").alias("surfaces"))
    made = written(made, "delexed")
    said = ledger.ask(made, model, "skeleton", VERSION, "asked")
    filled = said.select("doc", F.col("reply").alias("skeleton"), F.when(F.col("reply").isNotNull(), D.backfill(F.col("reply"), F.col("surfaces"))).alias("filled"))
    return filled.select("doc", "skeleton", F.col("filled.text").alias("disclosure"), F.col("filled.missing").alias("missing"))


def news(docs: DataFrame, ledger: Ledger, model: Chat) -> DataFrame:
    """doc, disclosure of docs (doc, source, exhibit): the model's words, and the sentence on the exhibit unless they name it; that sentence alone where the model failed."""
    said = ledger.ask(docs, model, "news", VERSION, "source").withColumn("said", F.from_json("reply", "disclosure string"))
    words, closing = F.trim(F.coalesce("said.disclosure", F.lit(""))), exhibit_sentence(F.col("exhibit"))
    named = F.contains(F.lower(words), F.concat(F.lit("exhibit "), F.col("exhibit")))
    return said.select("doc", F.when(named, words).when(words == "", closing).otherwise(F.concat(words, F.lit(BREAK), closing)).alias("disclosure"))


def with_context(drafts: DataFrame, ledger: Ledger, model: Chat) -> DataFrame:
    """drafts (doc, draft: item, disclosure, sections, facts; note) with the draft as `drafts.add_context` makes it of the model's revision; as it is where the model failed."""
    opening = F.element_at(F.split(F.coalesce("draft.disclosure", F.lit("")), BREAK), 1)
    asked = drafts.withColumn("asked", F.when(F.trim(F.coalesce("note", F.lit(""))) != "", F.to_json(F.struct(opening.alias("opening"), "note"))))
    said = ledger.ask(asked, model, "context", VERSION, "asked").withColumn("said", F.from_json("reply", "paragraph string, added_text string"))
    return said.select("doc", "note", add_context(F.col("draft"), F.col("note"), F.col("said.paragraph"), F.col("said.added_text")).alias("draft"))
