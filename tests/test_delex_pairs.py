"""Texts of a pair share a registry of placeholders, and both are restored from it; odd figures and names end no job."""

import re

import pytest
from pyspark.sql import functions as F

from lexmill.functions import boilerplate, delex, facts, spans
from lexmill.functions import text as X
from lexmill.operators import corpus
from lexmill.plans import catalog
from lexmill.providers import people
from lexmill.sources import tables

SF = "/root/testdata/sf0.001"
SCHEMA = "k long, input string, output string"


def test_registry_goes_from_input_to_output(spark):
    pair = (1, "SoundHound AI Inc. paid $5,000,000 to Frost Bank on May 3, 2024, said Jane Q. Roe.", "On 2024-05-03 Frost Bank got $5 million and $7 from SoundHound AI, by Max O. Weber and Jane Q. Roe.")
    row = corpus.delex_pairs(spark.createDataFrame([pair, (2, None, "paid $5"), (3, "", "")], SCHEMA), ["k"], people).filter("k = 1").first()
    assert row["input"] == "[ORG_2] paid [AMOUNT_1] to [ORG_1] on [DATE_1], said [PERSON_1]."
    assert row["output"] == "On [DATE_1] [ORG_1] got [AMOUNT_1] and [AMOUNT_2] from [ORG_2], by [PERSON_2] and [PERSON_1]."
    assert row["surfaces"]["[AMOUNT_1]"] == "$5,000,000" and row["surfaces"]["[AMOUNT_2]"] == "$7" and row["surfaces"]["[PERSON_1]"] == "Jane Q. Roe"


def test_single_text_is_the_first_of_several(spark):
    t = F.lit("Acme Corp paid $5 and $6, then Acme paid $5.")
    row = spark.range(1).select(delex.delex(t, delex.spans(t)).alias("one"), delex.delex_together([t, t], [delex.spans(t)] * 2).alias("two")).first()
    assert row["two"]["skeletons"] == [row["one"]["skeleton"]] * 2 and row["two"]["surfaces"] == row["one"]["surfaces"]


def test_round_trip_on_both(spark):
    """Inputs come back as they were; outputs with values as the input writes them, so their values are compared."""
    pairs = tables.signed_pairs(spark, SF)
    made = corpus.delex_pairs(pairs, ["conv_id", "turn"], people).withColumnsRenamed({"input": "si", "output": "so"})
    back = made.join(pairs, ["conv_id", "turn"]).select("input", "output", "si", "so", delex.backfill(F.col("si"), F.col("surfaces")).alias("bi"), delex.backfill(F.col("so"), F.col("surfaces")).alias("bo"))
    both = back.select("*", *(F.transform(delex.spans(c, people(c)), lambda s: F.concat_ws(" ", s["kind"], s["canon"])).alias(n) for n, c in (("vo", F.col("output")), ("vb", F.col("bo.text"))))).collect()
    assert len(both) == pairs.count() and any(re.search(r"\[AMOUNT_1\]", r["so"] or "") for r in both)
    for r in both:
        assert r["bi"]["text"] == r["input"] and r["bi"]["missing"] == [] == r["bo"]["missing"] and r["vo"] == r["vb"]


def test_figures_out_of_range(spark):
    digits = "9" * 40
    texts = [(1, "It paid $1,000,000,000 billion today and $5."), (2, f"It paid ${digits} and ${digits}.{digits} million"), (3, f"a rate of {digits}% or 5.{'1' * 60}%"), (4, f"{digits} shares and 1,000,000 shares")]
    rows = facts.extract(spark.createDataFrame(texts, "doc long, t string"), "t", ["doc"]).collect()
    assert [r["num"] for r in rows if r["doc"] == 1 and r["raw"].startswith("$1,000")] == [None]
    assert [float(r["num"]) for r in rows if r["doc"] == 1 and r["raw"] == "$5"] == [5.0]
    assert [r["num"] for r in rows if r["doc"] == 2 and r["num"] is not None] == []
    assert {float(r["num"]) for r in rows if r["doc"] == 4 and r["raw"].startswith("1,000")} == {1e6}
    amount = lambda t: spark.range(1).select(X.parse_amount(F.lit(t))).first()[0]
    assert float(amount("$1,000,000,000,000")) == 1e12 and amount(f"${digits}") is None and amount("none") is None and float(amount("$2 million")) == 2e6
    canon = lambda t: spark.range(1).select(delex.canon_number(F.lit(t))).first()[0]
    assert canon("9" * 19) == "10000000000000000000" and canon("1" + "0" * 45) == "1" + "0" * 45 and canon("1.50") == "1.5" and canon("5 million") == "5000000"


def test_names_that_end_a_quotation(spark):
    odd = r"A\E(c Corp"
    row = spark.range(1).select(F.regexp_replace(F.lit(f"by {odd}!"), boilerplate.quoted(F.lit(odd)), F.lit("X"))).first()
    assert row[0] == "by X!"

def test_fixed_rounds_the_double_itself(spark):
    own = [0.28945, 0.125405, 0.00005, 289450.00005, 1.5, 0.0, 123.9999995, -2.00015, 2.5e15]
    row = spark.createDataFrame([(x,) for x in own], "x double").select("x", X.fixed(F.col("x"), 4).alias("a"), X.fixed(F.col("x"), 6).alias("b")).collect()
    assert [(r["a"], r["b"]) for r in row] == [(f"{r['x']:.4f}", f"{r['x']:.6f}") for r in row]


def test_numbers_just_beside_a_whole_one(spark):
    """0.1251 million is 125099.99999999999 as a double."""
    assert spark.range(1).select(delex.canon_number(F.lit("$0.1251 million"))).first()[0] == "125100"
    share = delex.groundable_share(delex.spans(F.lit("pays $0.1251 million")), delex.spans(F.lit("pays $125,100.00")))
    assert spark.range(1).select(share).first()[0] == 1.0


def test_plain_rules_see_ascii_alone(spark):
    """The rules of the query's SQL: short names count, accented letters end a word, what is left of a name isn't looked for."""
    how = {"people": lambda t: people(t, catalog.ASCII_PERSON), "cores": False, **catalog.PLAIN_SPANS}
    row = corpus.delex_pairs(spark.createDataFrame([(1, "Ciónosar. Co pays.", "De. Co. pays Acme Corp and Acme $5.")], SCHEMA), ["k"], **how).first()
    assert row["input"] == "Ciónosar. Co pays." and row["output"] == "[ORG_2] pays [ORG_1] and Acme [AMOUNT_1]."


def plan_of(rows):
    return rows._jdf.queryExecution().executedPlan().toString()


def test_values_are_worked_out_once(spark):
    """A number's value takes three patterns and stands in thirty places of what is said of it."""
    made = spark.createDataFrame([("$5 million",)], "t string").select(delex.canon_number(F.col("t")).alias("n"))
    assert plan_of(made).count("regexp_replace") <= 4 and made.first()[0] == "5000000"


def test_patterns_go_over_a_text_once(spark):
    """Also where a text has the character that parts its matches from the rest."""
    texts = ["", "none", "$5", "a $5", "$5 b", "a $5 and $6", f"a {spans.MARK}$5{spans.MARK} and $6{spans.MARK}", "é $5 " * 200, None]
    found = spark.createDataFrame([(t,) for t in texts], "t string").select("t", spans.matches(F.col("t"), r"\$\d").alias("m"), spans.blanked(F.col("t"), r"\$\d").alias("b"))
    assert plan_of(found.select("m")).count("regexp_extract_all") == 1
    for r in found.collect():
        assert [(m["pos"], m["raw"]) for m in r["m"]] == [(m.start(), m.group()) for m in re.finditer(r"\$\d", r["t"] or "")]
        assert r["b"] == (r["t"] and re.sub(r"\$\d", "  ", r["t"]))


def test_texts_of_one_file_are_compared_in_all_tasks(spark):
    docs = spark.createDataFrame([(1, "paid $5 on May 3, 2024", "$5 million and $5"), (2, None, "$5"), (3, "x", None)], "doc long, source string, draft string").coalesce(1)
    made = corpus.groundable_texts(docs)
    assert made.rdd.getNumPartitions() == 4
    assert sorted(map(tuple, made.collect())) == [(1, 0.5, False), (2, 0.0, False), (3, 1.0, True)]


@pytest.mark.parametrize("query", ["groundable_texts", "delex_round_trip"])
def test_orders_are_dealt_before_their_texts(spark, query):
    """The orders' columns alone go through a shuffle, by the key of the join that follows."""
    plan = plan_of(catalog.QUERIES[query](spark, SF))
    assert plan.count("Exchange hashpartitioning(o_custkey") == 1 and "RoundRobin" not in plan and plan.count("Exchange") - plan.count("BroadcastExchange") == 1


def test_many_values_of_two_kinds(spark):
    """Values are numbered by kind from the text's end; a name that stands in no text any more has no pattern made for it."""
    text = " ".join(f"${i} and {i} percent" for i in range(60)) + " to Acme Corp by Acme, Acmes and $7."
    row = spark.createDataFrame([(text,)], "t string").select("t", delex.spans(F.col("t")).alias("s")).select(delex.delex(F.col("t"), F.col("s")).alias("d"), F.size("s").alias("n")).first()
    keys = re.findall(r"\[\w+\]", row["d"]["skeleton"])
    order = [f"${i}" for i in (7, *(i for i in range(59, -1, -1) if i != 7))]
    assert row["n"] == 122 and keys[:4] == [f"[AMOUNT_{order.index('$0') + 1}]", "[PCT_60]", f"[AMOUNT_{order.index('$1') + 1}]", "[PCT_59]"]
    assert row["d"]["skeleton"].endswith("to [ORG_1] by [ORG_1], Acmes and [AMOUNT_1].") and len(row["d"]["surfaces"]) == 121
    assert {k: v for k, v in row["d"]["surfaces"].items() if k.startswith("[AMOUNT")} == {f"[AMOUNT_{i}]": v for i, v in enumerate(order, 1)}
