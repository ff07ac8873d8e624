from pyspark.sql import functions as F

from lexmill.config import Config
from lexmill.functions import prompts


def test_config(monkeypatch):
    monkeypatch.setenv("LEXMILL_TOP_K", "3")
    assert Config.from_env().top_k == 3 and Config().chunk_chars == 1200


def test_prompts(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    text = one(prompts.instruction(F.lit("1.01"), F.lit("contract"), F.lit("note")))
    assert "Item 1.01 (Entry into a Material Definitive Agreement)" in text and text.endswith("Use only facts present in the note.")
    assert "using only the facts provided" in one(prompts.instruction(F.lit("8.01"), F.lit("news"), F.lit("release")))
    assert one(prompts.strip_thinking(F.lit("<think>a\nb</think> c "))) == "c"
    assert [t["role"] for t in one(prompts.chat(F.lit("s"), F.lit("u"), F.lit("a")))] == ["system", "user", "assistant"]
    assert one(prompts.detected_items(F.array(F.lit("Item 8.01 x"), F.lit("9.99"), F.lit("8.01")))) == ["8.01"]
    assert one(prompts.confirmed_items(F.lit(None).cast("array<string>"))) == ["1.01"]
    clauses = F.array(F.struct(F.lit("a").alias("name"), F.lit("1").alias("value")), F.struct(F.lit("b").alias("name"), F.lit("Not found").alias("value")))
    assert one(prompts.facts_block(clauses)) == "- a: 1"
