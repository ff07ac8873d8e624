"""Queries do the whole job: no row filter, no cut of texts or lists."""

import hashlib
import re

import duckdb
from pyspark.sql import functions as F

from lexmill.operators import filing, search
from lexmill.plans import catalog

SF = "/root/testdata/sf0.001"


def test_verify_quotes_looks_at_all_pairs(spark):
    squeeze = lambda t: " ".join((t or "").split())
    con = duckdb.connect()
    docs, items = (con.execute(f"SELECT {k}, text FROM '{SF}/{t}.parquet'").fetchall() for k, t in (("doc_id", "documents"), ("item_id", "benchmark")))
    want = sorted((i, d) for i, q in items for d, t in docs if squeeze(q) in squeeze(t))
    assert want and sorted(map(tuple, catalog.QUERIES["verify_quotes"](spark, SF).collect())) == want


def test_find_quotes(spark):
    texts = [(1, "zero one two three\n four  five six seven eight"), (2, "six seven ... one two"), (3, "one two three four five six seven x eight"), (4, None), (5, "a…b")]
    quotes = [(1, "ero one two three four five six sev"), (2, "one two"), (3, "one two three four five six seven … eight"), (4, "..."), (5, ""), (6, None), (7, "eight … one two three four five six seven")]
    docs, items = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(quotes, "item_id long, quote string")
    found = sorted(map(tuple, search.find_quotes(items, docs).collect()))
    assert found == [(1, 1), (2, 1), (2, 2), (2, 3), (3, 1), (3, 3), (4, 2)]


def test_gap_list_takes_long_texts(spark):
    con, want = duckdb.connect(), []
    for d, t in con.execute(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall():
        parts, at = (t or "").split(" the "), 0
        for n, part in enumerate(parts[:-1]):
            at += len(part)
            want.append((d, n, t[max(at - 70, 0) : at], t[at + 5 : at + 45]))
            at += 5
    assert sorted(tuple(r) for r in catalog.QUERIES["gap_list"](spark, SF).collect()) == sorted(want)


def test_gaps_close_together(spark):
    text = "a" + " the " * 40 + "b the  the c"
    rows = spark.createDataFrame([(text,)], "t string").select(F.inline(filing.gaps(F.col("t"), " the "))).collect()
    at, want = text.find(" the "), []
    while at >= 0:
        want.append((len(want), text[max(at - 70, 0) : at], text[at + 5 : at + 45]))
        at = text.find(" the ", at + 5)
    assert [tuple(r) for r in rows] == want


def test_precedent_groups_join_whole_texts(spark):
    sql = f"SELECT conv_id, min(turn), string_agg(text, chr(10) ORDER BY turn) FROM '{SF}/conversations.parquet' GROUP BY conv_id"
    want = sorted(duckdb.connect().execute(sql).fetchall())
    assert sorted(map(tuple, catalog.QUERIES["precedent_groups"](spark, SF).select("conv_id", "first_turn", "joined").collect())) == want


def test_percent_facts_take_all_lines(spark):
    want = duckdb.connect().execute(f"SELECT l_orderkey, l_linenumber, round(l_discount, 4) FROM '{SF}/lineitem.parquet'").fetchall()
    got = [(r["doc"], r["line"], r["share"]) for r in catalog.QUERIES["percent_facts"](spark, SF).collect()]
    assert sorted(got) == sorted((d, n, float(s)) for d, n, s in want)


def test_combined_qualifier_lists_all_exhibits(spark):
    want = dict(duckdb.connect().execute(f"SELECT l_orderkey, count(*) FROM '{SF}/lineitem.parquet' GROUP BY 1").fetchall())
    got = {r["filing"]: r["sentence"] for r in catalog.QUERIES["combined_qualifier"](spark, SF).collect()}
    assert got.keys() == want.keys() and max(want.values()) > 3
    for k, n in want.items():
        last = f"{'and ' * (n > 1)}10.{n} to this" if n != 1 else "Exhibit 10.1 to this"
        assert got[k].count("10.") == n and last in got[k]


def test_quote_ellipsis_and_section_slice_take_all_documents(spark, tmp_path):
    texts = ["short", "abcdefghij" + "k … l" * 60, "One two... three " * 20, "Intro\nSIGNATURE\nrest", "Intro\nItem 9.01 Exhibits\nrest", "plain words here " * 20]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")

    def holds(quote, text):
        at, parts = 0, [x for x in (" ".join(p.split()) for p in re.split(r"\.{3}|…", quote)) if x]
        for part in parts:
            at = text.find(part, at)
            if at < 0:
                return " ".join(quote.split()) in text
            at += len(part)
        return bool(parts) or " ".join(quote.split()) in text

    flat = [" ".join(t.split()) for t in texts]
    want = {i: (holds(f"{t[10:40]} ... {t[100:130]}", t), holds(f"{t[100:130]} … {t[10:40]}", t)) for i, t in enumerate(flat)}
    assert {r["doc_id"]: (r["forward"], r["backward"]) for r in catalog.QUERIES["quote_ellipsis"](spark, str(tmp_path)).collect()} == want
    cut = ["Item 1.01 Entry.\n" + t.split("\nSIG")[0].split("\nItem 9")[0].strip() for t in texts]
    got = {r["doc_id"]: r["section_sha256"] for r in catalog.QUERIES["section_slice"](spark, str(tmp_path)).collect()}
    assert got == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in enumerate(cut)}
