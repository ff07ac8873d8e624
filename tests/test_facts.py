"""Acceptance cases of reconciliation, and hand-worked vectors of the text functions."""

import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from lexmill.functions import delex, facts, text as X
from lexmill.operators import access, filing, reconcile, review, state
from lexmill.plans import catalog
from lexmill.providers import HashEmbedder, OverlapReranker, rerank_or_keep

ACT = "under Item 1.01, Rule 3b-7 and Section 18 of the Exchange Act"
PLAN = "The 2022 Plan authorizes 510,000,000 shares, with a maximum of 1,274,374,682 shares issuable under the formula."
DEBT = "At closing the Buyer discharged $1,100,000 of indebtedness owed to Frost Bank. Closing cash payment of $5,000,000."
PAID = "The Company paid $5,000,000 in cash at closing."
INSTALLMENTS = "$4,000,000 in four equal installments of $1,000,000 on March 31, 2027, June 30, 2027, September 30, 2027 and December 31, 2027."
# source, draft, words that must be disclosed, verdict, (normalized, status) that must be there
CASES = {
    "invented installment": ("Deferred cash payments of $500,000 per quarter, totaling $4,000,000, payable in eight installments from 2027-03-31 through 2028-12-31.", INSTALLMENTS, None, "blocked", [("1000000", "fabricated"), ("4000000", "matched")]),
    "omission not asked for": (DEBT, PAID, None, "clean", [("5000000", "matched")]),
    "omission asked for": (DEBT, PAID, ["indebtedness", "debt"], "needs_review", [("1100000", "omitted")]),
    "invented share count": (PLAN, "The 2022 Plan authorizes up to 500 million shares of common stock.", ["maximum"], "blocked", [("500000000", "fabricated"), ("1274374682", "omitted")]),
    "invented percentage": ("The 2022 Plan authorizes 510,000,000 shares of common stock.", "The plan provides an automatic annual increase of 1% of shares outstanding.", None, "blocked", [("0.01", "fabricated")]),
    "amount in words": ("a price of $5,000,000", "consideration of $5.0 million", None, "clean", []),
    "count with a unit": ("1,724,418", "1,724,418 shares of Class A Common Stock", None, "clean", []),
    "another date form": ("on 2024-04-29", "dated April 29, 2024", None, "clean", [("2024-04-29", "matched")]),
    "small amount": ("par value of $0.001", "par value $0.001 per share", None, "clean", []),
    "identifiers": (ACT, "pursuant to Item 1.01, Rule 3b-7 and Section 18 of the Exchange Act", None, "clean", []),
    "amount in figures": ("a price of $5.0 million", "consideration of $5,000,000", None, "clean", []),
}


@pytest.mark.parametrize("case", CASES)
def test_reconcile(spark, case):
    source, draft, must, verdict, wanted = CASES[case]
    docs = spark.createDataFrame([(1, draft, source)], "doc long, draft string, source string")
    assert reconcile.verdicts(docs, must_disclose=must).first()["verdict"] == verdict
    found = {(r["normalized"], r["status"]) for r in reconcile.reconcile_items(docs, must_disclose=must).collect()}
    assert set(wanted) <= found


def test_supplied_derivation(spark):
    source = "at a purchase price of $4.55 per share for aggregate gross proceeds of $38,675,000."
    drafts = [(1, "issued 8,500,000 shares at $4.55 per share for $38,675,000."), (2, "issued 1,000,000 shares at $4.55 per share for $4,550,000.")]
    docs = spark.createDataFrame([(i, d, source, [(Decimal(8_500_000), "= $38,675,000 ÷ $4.55")]) for i, d in drafts], "doc long, draft string, source string, derived array<struct<value:decimal(28,6),desc:string>>")
    got = {r["doc"]: r["verdict"] for r in reconcile.verdicts(docs).collect()}
    assert got == {1: "needs_review", 2: "blocked"}
    plain = spark.createDataFrame([(1, drafts[0][1], source)], "doc long, draft string, source string")
    items = {r["normalized"]: r["source_snippet"] for r in reconcile.reconcile_items(plain).filter("status = 'derived'").collect()}
    assert items == {"8500000": "= $38,675,000 ÷ $4.55"}


def test_strict_counts(spark):
    def kinds(text, **how):
        rows = facts.extract(spark.createDataFrame([(1, text)], "doc long, t string"), "t", ["doc"], **how).orderBy("ord").collect()
        return [(r["kind"], str(r["num"].normalize().to_integral_value() if r["num"] else r["text"])) for r in rows]

    assert [(k, Decimal(n)) for k, n in kinds("$5,000,000 and 12,345")] == [("currency", 5000000), ("count", 12345)]
    assert ("count", "0") in [(k, "0" if n == "None" else n) for k, n in kinds("$5,000,000 and 12,345", strict=True)]


def test_facts_of_one_text(spark):
    """Positions, raw texts, values, steps and surroundings, by hand."""
    text = "😀 Item 1.01 pays $1.5 million, 2 million shares and 1,234 units to Acme Inc. at 3.25% on May 3, 2026 (2026-05-04); ACME INC and Acme, Inc again"
    rows = facts.extract(spark.createDataFrame([(1, text), (2, None)], "doc long, t string"), "t", ["doc"]).orderBy("ord").collect()
    got = [(r["raw"], r["kind"], float(r["num"]) if r["num"] is not None else r["text"], float(r["step"])) for r in rows]
    assert got == [
        ("$1.5 million", "currency", 1.5e6, 1e5), ("2 million shares", "count", 2e6, 1e6), ("1,234 units", "count", 1234.0, 1.0), ("1,234", "count", 1234.0, 1.0), ("2 million", "count", 2e6, 1e6),
        ("3.25%", "percent", 0.0325, 0.0001), ("May 3, 2026", "date", "2026-05-03", 0.0), ("2026-05-04", "date", "2026-05-04", 0.0), ("Acme Inc", "party", "acme", 0.0),
    ]
    assert all(text[r["pos"] :].startswith(r["raw"][:4]) for r in rows) and rows[0]["ctx"].startswith("😀 pays $1.5 million, 2 million shares")


def test_derivations_among_many_figures(spark):
    """Every figure that two others make is found, against all pairs, without meeting all pairs."""
    r = random.Random(2)
    known = [r.randrange(2, 3000) * 1000 for _ in range(25)]
    made = [known[i] * known[i + 1] for i in range(3)] + [round(known[i] * 1000 / known[i + 5]) for i in range(3)] + [987_654_321_987]
    source = " and ".join(f"${x:,}" for x in known)
    draft = source + " so " + " and ".join(f"{x:,} shares" for x in made)
    docs = spark.createDataFrame([(1, draft, source)], "doc long, draft string, source string")
    got = {int(x["normalized"]): x["status"] for x in reconcile.reconcile_items(docs).filter("kind = 'count'").collect()}

    def derived(d):
        tol = abs(d) * 0.005 + 0.5
        return any((abs(a) >= 1000 and abs(d * b - a) <= tol * abs(b)) or (abs(d) >= 1000 and abs(d - a * b) <= tol) for i, a in enumerate(known) for j, b in enumerate(known) if i != j)

    shown = {x: "matched" if any(abs(x - k) <= 0.5 for k in known) else "derived" if derived(x) else "fabricated" for x in made}
    assert {x: got[x] for x in made} == shown and {"derived", "fabricated"} <= set(shown.values())


def test_lock(spark):
    docs = spark.createDataFrame([(1, "pays $7 and $77 to Acme Inc.", "nothing")], "doc long, draft string, source string")
    assert reconcile.lock_figures(docs).first()["locked"] == f"pays {reconcile.PLACEHOLDER} and {reconcile.PLACEHOLDER} to {reconcile.PLACEHOLDER}."


def test_chunks():
    assert X.chunk_text("ab\n" + "c" * 16, 10, 3) == ["c" * 10, "ab", "ab\nccccccccc"]
    assert X.chunk_text(" \n\n") == [] and X.chunk_text("aaaa\nbbbb\ncc", 10, 0) == ["aaaa\nbbbb", "cc"]
    with pytest.raises(ValueError):
        X.chunk_text("a", 10, 10)


def one(spark, column, **values):
    row = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items()))
    return row.select(column).first()[0]


def test_text_functions(spark):
    c = F.col
    for name in ("Acme Corp.", "ACME Corporation"):
        assert one(spark, X.normalize_key(c("n")), n=name) == "acme"
    quote = X.verify_quote(c("q"), c("s"))
    assert [one(spark, quote, q=q, s="A B\n C") for q in ("A ... C", "C ... A", "A  B", "", "a")] == [True, False, True, False, False]
    assert one(spark, X.scrub_redactions(c("t")), t="pay ***, _____ to **") == "pay [REDACTED] to **"
    assert one(spark, X.clean(c("t")), t="a \f12\n\n\n\nTable of Contents\nb") == "a\n\nb"
    assert one(spark, X.replace_nth(c("t"), "x", F.lit("y"), F.lit(1)), t="x x x") == "x y x"
    assert one(spark, X.parse_amount(c("t")), t="about $38.675 million") == Decimal("38675000")
    assert one(spark, X.citation(c("f"), c("p"), c("d")), f="a.pdf", p=3, d="msa") == "a.pdf p.3 [msa]"
    assert one(spark, X.strip_exhibit_header(c("t")), t="EX-10.1\nfoo.htm\nText") == "Text"
    assert one(spark, X.html_to_text(c("t"), True), t="<p>a&amp;b</p><p>c</p>") == "a&b\nc"


def test_filing_functions(spark):
    order = filing.filing_order(F.array(*map(F.lit, ["8.01", "1.01", "1.01", "x"])))
    assert spark.range(1).select(order).first()[0] == ["1.01", "8.01"]
    ex = spark.createDataFrame([(1, i, n, "d") for i, n in enumerate(["99.1", "10.2", "4.1", "10.1", "10.2", "draft"])], "filing long, pos int, number string, description string")
    assert [r["number"] for r in filing.exhibit_index(ex).orderBy("place").collect()] == ["4.1", "10.1", "10.2", "99.1", "draft", "104"]
    docs = spark.createDataFrame([(1, 1, "10", "10.2"), (1, 2, "10", None), (1, 3, "10", None), (1, 4, "99", None)], "filing long, pos int, prefix string, asked string")
    assert {r["pos"]: r["number"] for r in filing.number_exhibits(docs).collect()} == {1: "10.2", 2: "10.1", 3: "10.3", 4: "99.1"}


def test_delex(spark):
    text = "On August 20, 2024, SoundHound AI Inc. paid $38.7 million ($38,700,000) to Frost Bank. SoundHound AI agreed."
    row = spark.range(1).select(F.lit(text).alias("t")).select("t", delex.spans(F.col("t")).alias("s")).select(delex.delex(F.col("t"), F.col("s")).alias("d"), "s").first()
    skeleton, surfaces = row["d"]["skeleton"], row["d"]["surfaces"]
    assert skeleton == "On [DATE_1], [ORG_2] paid [AMOUNT_1] ([AMOUNT_1]) to [ORG_1] [ORG_2] agreed."
    assert surfaces == {"[DATE_1]": "August 20, 2024", "[ORG_2]": "SoundHound AI Inc.", "[AMOUNT_1]": "$38,700,000", "[ORG_1]": "Frost Bank."}
    assert all(text[s["a"] : s["b"]] == s["surface"] for s in row["s"])
    filled = one(spark, delex.backfill(F.col("t"), F.create_map(F.lit("[AMOUNT_1]"), F.lit("$5,000,000"))), t="The Company sold [AMOUNT_1] and also [AMOUNT_99].")
    assert tuple(filled) == (f"The Company sold $5,000,000 and also {delex.MARKER}.", ["[AMOUNT_99]"])
    share = delex.groundable_share(delex.spans(F.col("a")), delex.spans(F.col("b")))
    assert one(spark, share, a="paid $5 million", b="paid $5,000,000 on 2024-01-01") == 0.5 and one(spark, share, a="", b="nothing") == 1.0
    assert [one(spark, delex.canon_date(F.col("d")), d=d) for d in ("3/4/24", "May 3 2026", "2024-01-02", "X")] == ["2024-03-04", "2026-05-03", "2024-01-02", "x"]
    person = F.array(F.struct(F.lit(0).alias("a"), F.lit(8).alias("b")))
    assert [(s["kind"], s["canon"]) for s in one(spark, delex.spans(F.col("t"), person), t="Jane Roe paid 5 percent")] == [("PERSON", "jane roe"), ("PCT", "5")]


def test_access_and_state(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id long, client string")
    assert [access.scope(rows, a).count() for a in (None, ["a"], [])] == [3, 1, 0]
    store = state.Store(spark, str(tmp_path))
    assert store.read("t", rows.schema).count() == 0
    store.write("t", rows)
    store.change("t", rows.schema, lambda t: state.upsert(t, spark.createDataFrame([(1, "z"), (9, "n")], rows.schema), ["id"]))
    assert {tuple(r) for r in store.read("t", rows.schema).collect()} == {(1, "z"), (2, "b"), (3, None), (9, "n")}
    assert store.versions("t") == [1, 2]
    assert store.append_with_ids("t", rows.schema, spark.createDataFrame([("p",), ("q",)], "client string"), ["client"]) == [10, 11]
    assert {r["client"]: r["id"] for r in store.read("t", rows.schema).filter("id > 9").collect()} == {"p": 10, "q": 11}
    merged = review.merge_clauses(spark.createDataFrame([(1, 1, "n", "Not found"), (1, 2, "n", "x"), (1, 3, "n", "y")], "contract long, window int, name string, value string"))
    assert merged.first()["value"] == "x"


def test_providers():
    e = HashEmbedder(8)
    assert e.query("Foo bar") == e.documents(["foo BAR"])[0] and len(e.one("")) == 8
    assert OverlapReranker().scores("a b", ["b c", ""]) == [0.5, 0.0]

    class Broken:
        name = "broken"

        def scores(self, query, texts):
            raise RuntimeError

    assert rerank_or_keep(Broken(), "q", ["a", "b"]) == ([0.0, -1.0], False) and rerank_or_keep(Broken(), "q", []) == ([], True)


def test_many_figures_meet_in_linear_time(spark):
    """A document of five thousand different figures on each side, some of them rounded: as many pairs as there are matches."""
    source = " ".join(f"${i},{i % 1000:03d}.25 was paid." for i in range(1, 1000)) + " " + " ".join(f"{i},000 shares went." for i in range(1, 1000)) * 4
    draft = source.replace(".25 was", ".24 was") + " $3 million and $999,998,999.00 more."
    docs = spark.createDataFrame([(1, draft, source + " $3,200,000 came.")], "doc long, draft string, source string")
    d, s = (facts.extract(docs, side, ["doc"]) for side in ("draft", "source"))
    pairs = reconcile.met_facts(d, s).count()
    assert 1000 <= pairs < 4 * s.count()


def test_matches_are_those_of_all_pairs(spark):
    import itertools
    import random

    draw = random.Random(6)
    figure = lambda: draw.choice([f"${draw.randint(1, 30)} million", f"${draw.randint(1, 30)},{draw.randint(0, 9)}00,000", f"{draw.randint(1, 9)}.{draw.randint(0, 9)}%", f"${draw.randint(1, 20)}.{draw.randint(0, 9)}", "May 3, 2024", "2024-05-03", "Acme Holdings Corp.", "Acme Inc.", f"{draw.randint(1, 9)},000 shares"])
    texts = [(i, *(" and ".join(figure() for _ in range(25)) for _ in range(2))) for i in range(6)]
    docs = spark.createDataFrame(texts, "doc long, draft string, source string")
    d, s = (facts.extract(docs, side, ["doc"]) for side in ("draft", "source"))
    got = {(r["doc"], r["kind"], tuple(r["d"])[:3], tuple(r["s"])[:3], r["s"]["ord"]) for r in reconcile.met_facts(d, s).collect()}
    want = {}
    for a, b in itertools.product(d.collect(), s.collect()):
        if a["doc"] == b["doc"] and a["kind"] == b["kind"]:
            if a["kind"] in reconcile.NUMERIC:
                fits = abs(a["num"] - b["num"]) * 2 <= max(a["step"], b["step"])
            elif a["kind"] == "date":
                fits = a["text"] == b["text"]
            else:
                x, y = set(a["text"].split(" ")), set(b["text"].split(" "))
                fits = x <= y or y <= x
            if fits:
                key = (a["doc"], a["kind"], (a["num"], a["text"], a["step"]), (b["num"], b["text"], b["step"]))
                want[key] = min(want.get(key, b["ord"]), b["ord"])
    assert got == {(*k, o) for k, o in want.items()} and len(got) > 20


def test_short_documents_meet_inside_their_rows(spark, monkeypatch):
    """No join and one shuffle at most for short texts, and the items that the joins for long ones give."""
    price = "at $4.55 per share, or 1,000 units at $2,000, 12.5% to Acme Inc. on May 3, 2024"
    texts = [
        (1, f"issued 8,500,000 shares {price} for $38,675,000, $2,000,000 and $2 million", f"{price} for $38,675,000 and a maximum of $7, $7 and $8 debt", [(Decimal(2_000_000), "= given")]),
        (2, "pays $5 million to Acme Holdings Inc. and Zed Corp.", "the ACME holdings pay 5,000,000 shares, $5,000,100 of debt", None),
        (3, "$" + "9" * 40 + " and $1", "$" + "9" * 40, []),
        (4, None, "a maximum of $3", None),
        (5, "$3", None, None),
    ]
    docs = spark.createDataFrame(texts, "doc long, draft string, source string, derived array<struct<value:decimal(28,6),desc:string>>")
    how = {"must_disclose": ["maximum", "debt"]}
    items = lambda: {tuple(r) for r in reconcile.reconcile_items(docs, **how).collect()}
    plan = reconcile.verdicts(docs, **how)._jdf.queryExecution().executedPlan().toString()
    short = items()
    assert "Join" not in plan and plan.count("Exchange") <= 1
    monkeypatch.setattr(reconcile, "SHORT", (-1, -1))
    assert short == items() and {r[5] for r in short} == {"matched", "derived", "fabricated", "omitted"}


@pytest.mark.parametrize("query", ["figure_lock", "reconcile_verdict"])
def test_orders_are_shuffled_and_not_their_texts(spark, tmp_path, monkeypatch, query):
    """One exchange of the orders deals them out and serves the join, whether it is a broadcast or a shuffled one; long texts beside change no row."""
    orders = spark.range(40).selectExpr("id AS o_orderkey", "id % 7 AS o_custkey", "1000D + id AS o_totalprice", "timestamp_ntz'2024-05-03 00:00:00' AS o_orderdate")
    orders.coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    names = "if(id = 3, concat('Customer#', repeat('x', 1000)), concat('Customer#', id))"
    spark.range(0, 7, 1, 1).selectExpr("id AS c_custkey", f"{names} AS c_name").write.parquet(f"{tmp_path}/customer.parquet")
    rows = lambda: catalog.QUERIES[query](spark, str(tmp_path))
    bad = lambda n: n % 5 in (2, 3)
    want = [(n, bad(n), int(bad(n))) if query == "figure_lock" else (n, "blocked" if bad(n) else "clean") for n in range(40)]
    assert sorted(map(tuple, rows().collect())) == want
    monkeypatch.setattr(reconcile, "SHORT", (10**6, 10**6))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    for threshold, exchanges in ((before, 1), ("-1", 2)):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        try:
            found = rows()
            plan = found._jdf.queryExecution().executedPlan().toString()
            got = sorted(map(tuple, found.collect()))
        finally:
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        assert plan.count("Exchange hashpartitioning") == exchanges and "RoundRobin" not in plan
        assert got == want
