"""Adapter views over the driver's tables: a knowledge base, access grants, deals, clauses and text pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import fixed
from ..scratch import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def kb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as a library: type, client, author, date and filing items."""
    d = table(spark, sf_dir, "documents")
    items = F.when(F.col("doc_id") % 2 == 0, F.array(F.lit("1.01"), F.lit("9.01"))).otherwise(F.array(F.lit("1.01")))
    return d.select(
        "doc_id",
        "text",
        F.col("lang").alias("doc_type"),
        F.col("source").alias("client"),
        F.concat(F.lit("atty"), (F.col("doc_id") % 7).cast("string")).alias("author"),
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 365).cast("int")).alias("doc_date"),
        items.alias("filing_items"),
    )


def kb_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The library's rows that have an embedding."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return kb(spark, sf_dir).join(e, "doc_id")


def grants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, client: what each user may see."""
    client = F.concat(F.lit("src"), ((F.col("user_id") + F.col("event_id") % 3) % 20).cast("string"))
    return table(spark, sf_dir, "events").select("user_id", client.alias("client")).distinct()


def deals(spark: SparkSession, sf_dir: str, dealt: bool = False) -> DataFrame:
    """order, price, shares, and a draft and a source text: by order number mod 5 the source has the same figures, the amount
    in millions, another amount, no amount, or the date in ISO form.

    dealt: the orders go over all tasks before their texts are made, by the customer's key, which the join with the customers needs as well if
    it is a shuffled one; so the orders' columns alone are shuffled, once, at any size. The tasks are even as far as the customers' orders are.
    """
    orders = table(spark, sf_dir, "orders")
    orders = spread(orders, "o_custkey") if dealt else orders
    o = orders.join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    party = F.concat(F.regexp_replace("c_name", "#", "-"), F.lit(" Inc."))
    day, iso = F.date_format("o_orderdate", "MMMM d, yyyy"), F.date_format("o_orderdate", "yyyy-MM-dd")
    price, shares = F.col("o_totalprice"), F.col("o_orderkey") % 900 + 100
    money = F.concat(F.lit("$"), F.format_number(price, 2))
    kind = F.col("o_orderkey") % 5
    paid = (
        F.when(kind == 1, F.concat(F.lit("$"), fixed(price / 1e6, 4), F.lit(" million")))
        .when(kind == 2, F.concat(F.lit("$"), F.format_number(price + 1000, 2)))
        .when(kind == 3, F.lit("an undisclosed amount"))
        .otherwise(money)
    )
    return o.select(
        F.col("o_orderkey").alias("doc"),
        "o_orderdate",
        price.alias("price"),
        shares.alias("shares"),
        party.alias("party"),
        F.concat(F.lit("On "), day, F.lit(", "), party, F.lit(" agreed to pay "), money, F.lit(" for "), shares.cast("string"), F.lit(" shares.")).alias("draft"),
        F.concat(F.lit("Dated "), F.when(kind == 4, iso).otherwise(day), F.lit(". "), party, F.lit(" pays "), paid, F.lit(" and receives "), shares.cast("string"), F.lit(" shares.")).alias("source"),
    )


def clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """contract, window, pos, name, value: line items as extracted clauses, some of them not found."""
    line = table(spark, sf_dir, "lineitem")
    value = F.when(F.col("l_linenumber") % 3 == 0, F.lit("Not found")).otherwise(F.concat(F.lit("v"), F.col("l_partkey").cast("string")))
    return line.select(
        F.col("l_orderkey").alias("contract"),
        F.col("l_linenumber").cast("int").alias("window"),
        F.concat("l_returnflag", "l_linestatus").alias("name"),
        value.alias("value"),
    )


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, turn, input, output: a user's turn and the assistant's next one."""
    c = table(spark, sf_dir, "conversations")
    user = c.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("input"))
    reply = c.filter("role = 'assistant'").select(F.col("conv_id").alias("c2"), (F.col("turn") - 1).alias("t2"), F.col("text").alias("output"))
    return user.join(reply, (F.col("conv_id") == F.col("c2")) & (F.col("turn") == F.col("t2"))).select("conv_id", "turn", "input", "output")


def signed_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, turn, input, output: pairs whose texts go on with the source and the draft of a deal and with who signed."""
    deal = deals(spark, sf_dir).select("doc", "source", "draft")
    signer = F.element_at(F.array(*map(F.lit, SIGNERS)), (F.col("doc") % 3 + 1).cast("int"))
    other = F.when(F.col("doc") % 2 == 0, signer).otherwise(SIGNERS[2])
    signed = lambda text, deal, who: F.concat_ws(" ", F.col(text), F.col(deal), F.concat(F.lit("Signed by "), who, F.lit("."))).alias(text)
    p = pairs(spark, sf_dir)
    return p.join(deal, F.col("conv_id") * 8 + F.col("turn") == F.col("doc"), "left").select("conv_id", "turn", signed("input", "source", signer), signed("output", "draft", other))


SIGNERS = ["Ann B. Clark", "Jean R. Dubois", "Max O. Weber"]

# The same views in SQL, as common table expressions.
DEALS = """deals AS (SELECT o_orderkey AS doc, 'On ' || strftime(o_orderdate, '%B %-d, %Y') || ', ' || party || ' agreed to pay ' || money || ' for ' || shares || ' shares.' AS draft,
  'Dated ' || CASE WHEN k = 4 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE strftime(o_orderdate, '%B %-d, %Y') END || '. ' || party || ' pays ' ||
  CASE k WHEN 1 THEN '$' || printf('%.4f', o_totalprice / 1e6) || ' million' WHEN 2 THEN '$' || format('{:,.2f}', o_totalprice + 1000) WHEN 3 THEN 'an undisclosed amount' ELSE money END || ' and receives ' || shares || ' shares.' AS source
  FROM (SELECT *, o_orderkey % 5 AS k, o_orderkey % 900 + 100 AS shares, replace(c_name, '#', '-') || ' Inc.' AS party, '$' || format('{:,.2f}', o_totalprice) AS money FROM orders JOIN customer ON o_custkey = c_custkey))"""
KB = """kb AS (SELECT doc_id, text, lang AS doc_type, source AS client, 'atty' || (doc_id % 7) AS author,
  DATE '2024-01-01' + (doc_id % 365)::INT AS doc_date, CASE WHEN doc_id % 2 = 0 THEN ['1.01', '9.01'] ELSE ['1.01'] END AS filing_items FROM documents)"""
GRANTS = "grants AS (SELECT DISTINCT user_id, 'src' || ((user_id + event_id % 3) % 20) AS client FROM events)"
CLAUSES = """clauses AS (SELECT l_orderkey AS contract, l_linenumber::INT AS win, l_returnflag || l_linestatus AS name,
  CASE WHEN l_linenumber % 3 = 0 THEN 'Not found' ELSE 'v' || l_partkey END AS value FROM lineitem)"""
PAIRS = """pairs AS (SELECT u.conv_id, u.turn, u.text AS input, a.text AS output FROM conversations u JOIN conversations a
  ON u.conv_id = a.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant')"""
SIGNED = f"""signed AS (SELECT conv_id, turn, concat_ws(' ', input, source, 'Signed by ' || who || '.') AS input, concat_ws(' ', output, draft, 'Signed by ' || CASE WHEN doc % 2 = 0 THEN who ELSE '{SIGNERS[2]}' END || '.') AS output
  FROM (SELECT p.*, d.*, {SIGNERS}[(doc % 3 + 1)::INT] AS who FROM pairs p LEFT JOIN deals d ON conv_id * 8 + turn = doc))"""
