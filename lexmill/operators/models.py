"""Steps that ask a model, behind a protocol: what is asked, how answers are read, and what holds when it fails.

A model answers in batches inside mapInPandas; a failed call is tried again and then recorded, never raised. The stand-in is
deterministic and offline: it shows the flow, not a model's quality.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.prompts import detected_items, strip_thinking
from ..functions.text import is_missing, verify_quote
from ..providers import STUB

TRIES = 3


class Chat(Protocol):
    name: str

    def reply(self, task: str, text: str) -> str: ...


class ExtractiveChat:
    """Answers from the text's own words: JSON for tasks that ask for it, the first sentence otherwise."""

    name = STUB

    def reply(self, task: str, text: str) -> str:
        if task == "metadata":
            day = re.search(r"\d{4}-\d\d-\d\d", text)
            kind = next((k for k in ("lease", "license", "purchase", "credit", "employment") if k in text.lower()), None)
            return json.dumps({"doc_type": kind, "doc_date": day.group() if day else None})
        if task == "items":
            return json.dumps({"items": re.findall(r"\b\d\.\d\d\b", text)})
        if task == "audit":
            claims = json.loads(text)
            return json.dumps({"flags": [i for i, c in enumerate(claims["claims"]) if c.lower() not in claims["evidence"].lower()]})
        if task == "confirm":
            claim = json.loads(text)
            return json.dumps({"unsupported": not set(re.findall(r"\w+", claim["claim"].lower())) <= set(re.findall(r"\w+", claim["evidence"].lower()))})
        return re.split(r"(?<=[.!?])\s", text.strip(), maxsplit=1)[0]


def ask(rows: DataFrame, model: Chat, task: str, text: str) -> DataFrame:
    """rows with reply: the model's answer without its thinking, null after TRIES failures or for a null text, and reply_error."""
    schema = T.StructType([*rows.schema.fields, T.StructField("reply", T.StringType()), T.StructField("reply_error", T.StringType())])

    def one(t: str | None) -> tuple[str | None, str | None]:
        if t is None:
            return None, None
        error = None
        for _ in range(TRIES):
            try:
                return model.reply(task, t), None
            except Exception as e:  # any failure of a service is recorded in the row
                error = f"{type(e).__name__}: {e}"
        return None, error

    def batches(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            said = [one(t) for t in part[text]]
            yield part.assign(reply=[r for r, _ in said], reply_error=[e for _, e in said])

    return rows.mapInPandas(batches, schema).withColumn("reply", strip_thinking(F.col("reply")))


def ask_json(rows: DataFrame, model: Chat, task: str, text: str, schema: str) -> DataFrame:
    """rows with said: the answer as a struct of the schema; null where the call fails or the answer isn't such JSON."""
    return ask(rows, model, task, text).withColumn("said", F.from_json("reply", schema))


def fill_metadata(given: Column, found: Column) -> Column:
    """The given value, or else the one found, or else empty."""
    empty = lambda c: F.nullif(F.trim(c), F.lit(""))
    return F.coalesce(empty(given), empty(found), F.lit(""))


def iso_day(value: Column) -> Column:
    """A date as it is written, if it is one; else empty."""
    return F.when(value.rlike(r"^\d{4}-\d\d-\d\d$") & F.try_to_timestamp(value, F.lit("yyyy-MM-dd")).isNotNull(), value).otherwise("")


def metadata(docs: DataFrame, model: Chat) -> DataFrame:
    """docs (text, doc_type, doc_date as a string) with the two filled by the model where they are unset, and metadata_error."""
    rows = ask_json(docs, model, "metadata", "text", "doc_type string, doc_date string")
    kind = fill_metadata(F.col("doc_type"), F.col("said.doc_type"))
    day = iso_day(fill_metadata(F.col("doc_date"), F.col("said.doc_date")))
    return rows.withColumns({"doc_type": kind, "doc_date": day}).withColumnRenamed("reply_error", "metadata_error").drop("reply", "said")


def item_suggestions(docs: DataFrame, model: Chat) -> DataFrame:
    """docs with items: known ones that the model names, none if it fails."""
    rows = ask_json(docs, model, "items", "text", "items array<string>")
    none = F.array().cast("array<string>")
    return rows.withColumn("items", F.coalesce(detected_items(F.col("said.items")), none)).drop("reply", "reply_error", "said")


def summaries(docs: DataFrame, model: Chat) -> DataFrame:
    """docs with summary, empty if the model fails."""
    return ask(docs, model, "summary", "text").withColumn("summary", F.coalesce("reply", F.lit(""))).drop("reply", "reply_error")


def repaired(old: Column, new: Column, quote: Column, source: Column) -> Column:
    """The value of a second pass, if the first found none and the quote for the new one stands in the source."""
    better = is_missing(old) & ~is_missing(new) & verify_quote(quote, source)
    return F.when(better, new).otherwise(old)


def narrative_flags(docs: DataFrame, model: Chat) -> DataFrame:
    """doc, claim: claims (docs: doc, claims, evidence) that the model flags as a batch and doesn't clear when it looks at each alone.

    A failed batch flags nothing; a failed second look keeps the flag.
    """
    asked = docs.withColumn("asked", F.to_json(F.struct("claims", "evidence")))
    first = ask_json(asked, model, "audit", "asked", "flags array<int>")
    flags = first.select("doc", "evidence", "claims", F.explode(F.array_distinct("said.flags")).alias("i")).filter((F.col("i") >= 0) & (F.col("i") < F.size("claims")))
    each = flags.select("doc", F.col("i").alias("pos"), F.col("claims")[F.col("i")].alias("claim"), "evidence").withColumn("asked", F.to_json(F.struct("claim", "evidence")))
    second = ask_json(each, model, "confirm", "asked", "unsupported boolean")
    return second.filter(F.coalesce("said.unsupported", F.lit(True))).select("doc", "pos", "claim")
