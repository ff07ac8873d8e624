"""Skeletons, news and rewrites by a model."""

from pyspark.sql import functions as F

from lexmill.functions.delex import MARKER
from lexmill.operators import drafting as W
from lexmill.operators.replies import Ledger


class Broken:
    name = "broken"

    def reply(self, task, text):
        raise ValueError("down")


def test_drafts(spark, tmp_path):
    ledger = Ledger(spark, f"{tmp_path}/ledger", pause=0.0)
    texts = [(1, "On May 3, 2024 we met. Acme Corp. paid $5 to Frost Bank.", "99.1"), (2, "An undisclosed sum was paid.", "99.2"), (3, "", "99.1"), (4, None, "99.1")]
    docs = spark.createDataFrame(texts, "doc long, source string, exhibit string")
    own = {r["doc"]: tuple(r)[1:] for r in W.skeletons(docs, ledger, W.DraftChat()).collect()}
    assert own[1] == ("[ORG_2] paid [AMOUNT_1] to [ORG_1]", "Acme Corp. paid $5 to Frost Bank.", [])
    assert own[2] == ("[AMOUNT_99] is due.", f"{MARKER} is due.", ["[AMOUNT_99]"]) and own[4] == (None, None, None)
    told = {r["doc"]: r["disclosure"] for r in W.news(docs, ledger, W.DraftChat()).collect()}
    closing = "A copy of the press release is furnished as Exhibit {} to this Current Report on Form 8-K and is incorporated herein by reference."
    assert told[1] == "On May 3, 2024 we met.\n\n" + closing.format("99.1") and told[2] == closing.format("99.2") and told[4] == closing.format("99.1")


def test_rewrites_keep_figures(spark, tmp_path):
    ledger = Ledger(spark, f"{tmp_path}/ledger", pause=0.0)
    rows = [(1, "Paid $5.\n\nMore.", "We grow."), (2, "Paid $5.\n\nMore.", "Please drop it."), (3, "Paid $5.", None), (4, None, "Note.")]
    drafts = spark.createDataFrame(rows, "doc long, d string, note string")
    none = F.array().cast("array<struct<item:string,disclosure:string,cross_ref:boolean>>"), F.array().cast("array<struct<fact:string,source_quote:string,origin:string>>")
    drafts = drafts.select("doc", F.struct(F.lit("1.01").alias("item"), F.col("d").alias("disclosure"), none[0].alias("sections"), none[1].alias("facts")).alias("draft"), "note")
    got = {r["doc"]: r["draft"]["disclosure"] for r in W.with_context(drafts, ledger, W.DraftChat()).collect()}
    assert got[1] == "We grow. Paid $5.\n\nMore." and got[2] == "Paid $5. Please drop it.\n\nMore." and got[3] == "Paid $5."
    failed = {r["doc"]: r["draft"]["disclosure"] for r in W.with_context(drafts, Ledger(spark, f"{tmp_path}/other", 0.0), Broken()).collect()}
    assert failed == {1: "Paid $5.\n\nMore.", 2: "Paid $5.\n\nMore.", 3: "Paid $5.", 4: None}
