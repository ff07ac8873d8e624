"""Boilerplate, exports, accounts and the stemmed rank."""

import pytest
from pyspark.sql import functions as F

from lexmill.functions import boilerplate as B
from lexmill.operators import accounts, export, state

CLOSE = "is qualified in its entirety by reference to the full text of such"


@pytest.fixture()
def say(spark):
    """The value of a column expression."""
    return lambda column: spark.range(1).select(column).first()[0]


def many(*texts):
    return F.array(*map(F.lit, texts))


def test_sections(say):
    text = "x\nItem 1.01 Entry\nas in Item 8.01 above.\nItem 8.01 above is not one\nbody\nItem 1.01 again\nmore\n SIGNATURE \nItem 8.01. Other\nend"
    cut = lambda t, item: say(B.slice_item(F.lit(t), item))
    assert cut(text, "1.01").endswith("more") and cut(text, "1.01").startswith("Item 1.01 Entry\nas") and cut(text, "8.01") == "Item 8.01. Other\nend" and cut(text, "9.01") == ""
    assert cut("Item 1.01 A\nItem 8.01 B\nItem 2.02 too near the first, the next counts\nItem 3.03 C", "1.01") == "Item 1.01 A\nItem 8.01 B"


def test_section_bounds(spark, say):
    """A heading's blank lines are its own, so one that they let begin within 20 characters ends no section; a section without an end has no next heading."""
    bounds = lambda t: tuple(say(B.item_bounds(F.lit(t), "1.01")))
    short, blank = "Item 1.01 Entry.\nA.\nItem 8.01 Other.\nrest", "Item 1.01 Entry.\n\n\n\n\n\nItem 8.01 Other.\nrest"
    assert bounds(short) == bounds(blank) == (0, None) and say(B.slice_item(F.lit(blank), "1.01")) == blank and bounds("none") == (None, None)
    docs = spark.createDataFrame([(1, "A."), (2, "A section of its own."), (3, None)], "doc_id long, text string")
    t = F.concat(F.lit("Item 1.01 Entry.\n"), "text", F.lit("\nItem 8.01 Other.\nrest"))
    assert [r["doc_id"] for r in docs.filter(B.item_bounds(t, "1.01")["next"].isNotNull()).collect()] == [2]


def test_closings(say):
    one = say(B.ensure_qualifier(F.lit("A signed a Note."), "4.1"))
    assert "Exhibit 4.1" in one and f"{CLOSE} Note" in one and say(B.ensure_qualifier(F.lit(one))) == one
    party = "A Lease. The foregoing description of the Buyer does not purport to be and is qualified in entirety by the full text of such Buyer."
    assert say(B.ensure_qualifier(F.lit(party))) == "A Lease. The foregoing description of the Lease does not purport to be and is qualified in its entirety by the full text of such Lease."
    assert say(B.instrument_noun(F.lit('A (the "Facility") by (the "Agents")'))) == "Facility" and say(B.agreement_name(F.lit("A entered into a Registration Rights Agreement with B"))) == "Registration Rights Agreement"
    both = say(B.ensure_relationship(F.lit(one), F.lit("Seller: Foo Inc. (the “Seller”)")))
    assert both.index("no material relationship between the Company and Foo Inc.") < both.index("The foregoing") and say(B.ensure_relationship(F.lit(both), F.lit(None))) == both
    assert "Company and the Lender." in say(B.ensure_relationship(F.lit("X (the “Lender”) lends."), F.lit(None))) and "and the counterparty." in say(B.ensure_relationship(F.lit("X."), F.lit(" ")))
    assert say(B.strip_closing(F.lit(both))) == "A signed a Note."


def test_parties_and_terms(say):
    assert say(B.clean_party(F.lit('Seller: Foo LLC (the "Seller")'))) == "Foo LLC"
    pick = lambda names, own: say(B.pick_counterparty(names, F.lit(own)))
    assert pick(many("Acme, Inc.", "Buyer - Foo"), "ACME Inc") == "Foo" and pick(many("Acme"), "Acme") == "Acme" and pick(F.array().cast("array<string>"), None) is None
    term = lambda t: say(B.registrant_term(F.lit(t), F.lit("Acme Inc.")))
    assert term('Acme Inc. (the "Purchaser") buys. The Purchaser’s right.') == "Acme Inc. (the “Company”) buys. The Company’s right."
    assert term("Acme Inc., a Nevada corporation, buys.") == "Acme Inc., a Nevada corporation (the “Company”), buys."
    assert term('Acme Inc. (the "Company") buys.') == 'Acme Inc. (the "Company") buys.' and term("None of them.") == "None of them."
    assert say(B.distinct_terms(many("Securities Purchase Agreement", "Registration Rights Agreement"))) == ["Purchase Agreement", "Registration Rights Agreement"]
    assert say(B.distinct_terms(many("X Agreement", "X Agreement"))) == ["X Agreement (No. 1)", "X Agreement (No. 2)"]
    assert say(B.rename_term(F.lit('Loan Agreement (the "Agreement"). The Agreement says.'), F.lit("Loan Agreement"))) == 'Loan Agreement (the "Loan Agreement"). The Loan Agreement says.'
    first = 'On May 1, 2026, A (the "Company"), entered into a deal with B (the "Buyers").'
    second = 'On May 2, 2026, A (the "Company"), entered into a pact with B (the "Buyers") (the "Pact").'
    assert say(B.define_once(many(first, second), F.lit("Deal"))) == [first, 'In connection with the Deal, on May 2, 2026, the Company also entered into a pact with B (the "Pact").']


def test_pieces(say):
    assert say(B.sentences(F.lit('A of Foo Inc. is here. It pays; (then) "x". and so.'))) == ['A of Foo Inc. is here.', 'It pays; (then) "x". and so.']
    assert say(B.bold_html(F.lit('A (the "Co") b "q" <'))) == 'A (the <b>&quot;Co&quot;</b>) b &quot;q&quot; &lt;'
    assert say(B.report_date(many("none", "on May 1, 2026"))) == "May 1, 2026" and say(B.report_date(many(""))) == "[DATE]"
    assert say(B.disclosure_paragraphs(F.lit("Item 1.01 X\n\na\n\n b "), F.lit("1.01"))) == ["a", "b"]
    assert say(B.exhibit_number(F.lit("d_ex10-1.htm"))) == "10.1" and say(B.exhibit_description(F.lit("FORM OF WARRANT, x"), F.lit("4.1"))) == "Form of Warrant" and say(B.exhibit_description(F.lit(""), F.lit("5.1"))) == "Opinion of Counsel"


def test_exports(say):
    clauses = F.array(F.struct(F.lit("Term").alias("name"), F.lit("").alias("value"), F.lit("q").alias("quote"), F.lit(False).alias("verified")))
    assert say(export.memo(F.lit("c"), F.lit("MSA"), F.lit("s"), clauses, many("r"))) == "## c\n\n*MSA*\ns\n\n- **Term**: Not found (unverified)\n\n### Key risks\n- r\n"
    sections = F.array(F.struct(F.lit("1.01").alias("item"), F.lit("T").alias("title"), F.lit('Item 1.01 T\n\nOn May 1, 2026 (the "X") <b>').alias("disclosure")))
    html = say(export.filing_html(F.lit("A & B"), sections, F.array(F.struct(F.lit("10.1").alias("number"), F.lit("D").alias("description")))))
    assert "A &amp; B" in html and "<b>&quot;X&quot;</b>" in html and "&lt;b&gt;" in html and "May 1, 2026" in html
    items = F.array(F.struct(F.lit("fabricated").alias("status"), F.lit("$7").alias("raw"), F.lit("currency").alias("kind"), F.lit("").alias("source_snippet")))
    assert say(export.review_pack(F.lit("blocked"), items, F.array(F.struct(F.lit("r").alias("requirement"), F.lit(True).alias("satisfied"))))) == "# Review: blocked\n\n## fabricated (1)\n- $7 [currency]\n\n## Compliance\n- [x] r\n"


def test_accounts(spark, tmp_path):
    own = accounts.Accounts(state.Store(spark, str(tmp_path)))
    number = own.create("ann", "pw", clients=["b", "a", "a"])
    token = own.login("ann", "pw")
    assert own.login("ann", "no") is None and own.login("bob", "pw") is None
    assert own.resolve(token) == {"username": "ann", "role": "lawyer", "allowed_clients": ["a", "b"]}
    own.revoke(number, "a")
    assert own.allowed(number, "lawyer") == ["b"] and own.allowed(number, "admin") is None
    own.set_clients(number, ["z"])
    assert own.allowed(number, "lawyer") == ["z"]
    own.logout(token)
    assert own.resolve(token) is None and own.resolve(None) is None
    own.log("ann", "search", "x" * 3000)
    assert len(spark.read.parquet(f"{tmp_path}/audit_log").first()["detail"]) == 2000
    own.delete("ann")
    assert own.find("ann") is None and own.allowed(number, "lawyer") == []
