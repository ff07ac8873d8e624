"""The review of contracts by a model: windows, clauses that are asked for in each, a second pass behind a gate, and a summary of summaries.

A contract is read in overlapping windows. Of each clause the first window that says something counts. Clauses that no window has, or whose quote doesn't
stand in the contract, are asked for a second time, by themselves, and what comes back is taken only with a quote that does. Summaries of windows are joined in
order, FAN at a time, and summarised again until one is left. All questions go through a ledger of replies.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.spans import bound
from ..functions.text import is_missing, verify_quote, windows
from ..providers import STUB
from ..scratch import written
from .models import Chat
from .replies import Ledger

#: Characters of a window and of its overlap; summaries that are joined; the version of the prompts.
WIDTH, OVERLAP, FAN, VERSION = 9000, 2000, 8, "1"
NOT_FOUND = "Not found"
SAID = "clauses array<struct<name:string,value:string,quote:string>>"
BLANKS = " \t\n\r\f\v"


class SentenceChat:
    """The offline stand-in: of each clause the first sentence with its name. In the first pass it copies long sentences in capitals, as a model that drifts."""

    name = STUB

    def reply(self, task: str, text: str) -> str:
        asked = json.loads(text)
        pieces = asked["text"].split(".")
        if task == "summary":
            return pieces[0].strip(BLANKS)[:60].strip(BLANKS)
        out = []
        for name in asked["names"]:
            own = next((p.strip(BLANKS) for p in pieces if name in p.lower()), None)
            quote = own if own is None or task == "repair" or len(own) <= 80 else own.upper()
            out.append({"name": name, "value": NOT_FOUND if own is None else own[:40], "quote": quote or ""})
        return json.dumps({"clauses": out})


def cut_up(docs: DataFrame, *more: str) -> DataFrame:
    """doc, window (its start), text and the columns more of docs."""
    return docs.select("doc", *more, F.inline(windows(F.coalesce("text", F.lit("")), WIDTH, OVERLAP))).select("doc", F.col("start").alias("window"), F.col("window").alias("text"), *more)


def answers(rows: DataFrame, ledger: Ledger, model: Chat, task: str) -> DataFrame:
    """doc, window, name, value, quote of rows (doc, window, text, names); a failed or odd reply gives none."""
    asked = rows.withColumn("asked", F.to_json(F.struct("names", "text")))
    said = ledger.ask(asked, model, task, VERSION, "asked").withColumn("said", F.from_json("reply", SAID))
    return said.select("doc", "window", F.inline("said.clauses"))


def first_found(rows: DataFrame) -> DataFrame:
    """doc, name and the value and quote of the first window that says something, else of the first."""
    best = F.min_by(F.struct("value", "quote"), F.struct(is_missing(F.col("value")).cast("int"), F.col("window")))
    return rows.groupBy("doc", "name").agg(best.alias("best")).select("doc", "name", "best.value", "best.quote")


def clauses(docs: DataFrame, checklist: list[str], ledger: Ledger, model: Chat) -> DataFrame:
    """doc, name, value, quote, verified, repaired: a row for each of the docs (doc, text) and each clause of the checklist.

    A text meets what was said of it once for all clauses, and the second pass cuts it up where that stands beside it.
    """
    names = F.array(*map(F.lit, checklist))
    found = first_found(answers(cut_up(docs).withColumn("names", names), ledger, model, "clauses"))
    found = found.groupBy("doc").agg(F.collect_list(F.struct("name", "value", "quote")).alias("found"))
    own = lambda n: F.get(F.filter("found", lambda f: f["name"] == n), 0)
    check = lambda n, f: F.struct(n.alias("name"), f["value"].alias("value"), f["quote"].alias("quote"), verify_quote(F.coalesce(f["quote"], F.lit("")), F.coalesce("text", F.lit(""))).alias("verified"))
    said = F.transform(names, lambda n: bound(own(n), lambda f: check(n, f)))
    first = written(docs.join(found, "doc", "left").select("doc", "text", said.alias("said")), "first_pass")
    checked = first.select("doc", F.inline("said"))
    doubtful = F.array_sort(F.transform(F.filter("said", lambda s: is_missing(F.coalesce(s["value"], F.lit(""))) | ~s["verified"]), lambda s: s["name"]))
    again = answers(cut_up(first.select("doc", "text", doubtful.alias("names")).filter(F.size("names") > 0), "names"), ledger, model, "repair")
    again = again.filter(~is_missing(F.col("value"))).join(first.select("doc", "text"), "doc").filter(verify_quote(F.col("quote"), F.col("text")))
    again = again.groupBy("doc", "name").agg(F.min_by(F.struct("value", "quote"), "window").alias("new"))
    took = F.col("new").isNotNull()
    value, quote = (F.coalesce(F.col(f"new.{c}"), F.col(c), F.lit(d)).alias(c) for c, d in (("value", NOT_FOUND), ("quote", "")))
    return checked.join(again, ["doc", "name"], "left").select("doc", "name", value, quote, (took | F.col("verified")).alias("verified"), took.alias("repaired"))


def summary(docs: DataFrame, ledger: Ledger, model: Chat) -> DataFrame:
    """doc, summary, levels: the summary of summaries, and how often it was summarised; empty where the model failed."""
    rows, levels = cut_up(docs).withColumnRenamed("window", "at"), 0
    while True:
        asked = rows.withColumn("asked", F.to_json(F.struct("text")))
        said = ledger.ask(asked, model, "summary", VERSION, "asked").select("doc", "at", F.coalesce("reply", F.lit("")).alias("text"))
        said, levels = written(said, "summaries"), levels + 1
        counts = said.groupBy("doc").agg(F.count(F.lit(1)).alias("n"))
        done = said.join(counts.filter("n = 1"), "doc", "left_semi").select("doc", F.col("text").alias("summary"), F.lit(levels).alias("levels"))
        out = done if levels == 1 else out.unionByName(done)  # noqa: F821
        most = counts.agg(F.max("n")).first()[0]
        if not most or most == 1:
            return out
        left = said.join(counts.filter("n > 1"), "doc", "left_semi")
        # Windows and groups are numbered by their starts, whose strides are known: no sort of a contract's rows is asked for.
        place = F.floor(F.col("at") / (WIDTH - min(OVERLAP, WIDTH // 5)) / FAN) if levels == 1 else F.floor(F.col("at") / FAN)
        rows = left.groupBy("doc", place.alias("at")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "text"))), lambda x: x["text"]), "\n").alias("text"))
