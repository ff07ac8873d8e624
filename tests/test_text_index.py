"""The stored text index against scans and a direct version of the rank; the stemmer against published stems."""

import math
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from lexmill.functions.english import STOP, dictionary, lexemes_of, stem
from lexmill.operators import search, text_index
from lexmill.plans import catalog

SF = "/root/testdata/sf0.001"
STEMS = """consign consign consigned consign consigning consign consignment consign consist consist consisted consist consistency consist consistently consist consolation consol consolatory consolatori
consolidate consolid consolingly consol consonant conson conspicuous conspicu conspiracy conspiraci conspirator conspir conspiring conspir constables constabl constancy constanc knackeries knackeri knavish knavish
kneeled kneel knightly knight knitted knit knives knive knockers knocker knopp knopp hoping hope hopped hop generalizations general relational relat conditional condit vietnamization vietnam happy happi flies fli dies die
agreed agre plastered plaster motoring motor sing sing conflated conflat troubled troubl sized size falling fall hissing hiss fizzed fizz controlling control roll roll cease ceas rate rate communism communism generously generous
gas gas gaps gap kiwis kiwi say say by by boyish boyish enjoy enjoy cries cri ties tie skies sky news news inning inning proceed proceed""".split()


def test_stems(spark):
    assert {w: stem(w) for w in STEMS[::2]} == dict(zip(STEMS[::2], STEMS[1::2]))
    words = spark.createDataFrame([(w,) for w in ["the", "agreements", "agreements", "agreement"]], "word string")
    assert sorted(map(tuple, dictionary(words).collect())) == [("agreement", "agreement"), ("agreements", "agreement")]
    assert lexemes_of("The Agreements of it", "english") == ["agreement"] and lexemes_of("the of", "english") == []


def direct(texts, query, k):
    """The k best by the rank's definition, pair by pair."""
    asked, out = sorted({stem(w) for w in re.findall(r"[^\W_]+", query.lower()) if w not in STOP}), []
    for number, text in texts:
        places = {a: [] for a in asked}
        for i, w in enumerate(re.findall(r"[^\W_]+", (text or "").lower()), 1):
            if w not in STOP and stem(w) in places:
                places[stem(w)].append(min(i, 16383))
        places = {a: p[:255] for a, p in places.items()}
        if not asked or not all(places.values()):
            continue
        if len(asked) == 1:
            out.append((0.1 * sum(1 / j**2 for j in range(1, len(places[asked[0]]) + 1)) / 1.64493406685, number))
            continue
        rest = 1.0
        for i, a in enumerate(asked):
            for b in asked[i + 1 :]:
                for p in places[a]:
                    for q in places[b]:
                        if p != q and abs(p - q) <= 100:
                            rest *= 1 - math.sqrt(0.01 / (1.005 + 0.05 * math.exp(abs(p - q) / 1.5 - 2)))
        out.append((1 - rest, number))
    return sorted(out, key=lambda x: (-x[0], x[1]))[:k]


@pytest.fixture(scope="module")
def texts():
    return duckdb.connect().execute(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()


@pytest.fixture(scope="module")
def english(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    return text_index.build(docs.withColumn("doc_id", F.col("doc_id") * 300), analyzer="english")


@pytest.mark.parametrize("query", ["the things of er", "things", "in est things", "le de thing", "nowhere thing", "the of"])
def test_rank_is_the_direct_one(english, texts, query):
    got = [(r["score"], r["doc_id"]) for r in text_index.top(english, query, 12, score="distance").orderBy(F.desc("score"), "doc_id").collect()]
    want = direct([(d * 300, t) for d, t in texts], query, 12)
    assert [d for _, d in got] == [d for _, d in want]
    assert [s for s, _ in got] == pytest.approx([s for s, _ in want])


def test_stemmed_search(spark, texts):
    scope = {r[0] for r in duckdb.connect().execute(f"SELECT doc_id FROM '{SF}/documents.parquet' WHERE source IN {catalog.IN_SCOPE}").fetchall()}
    want = direct([x for x in texts if x[0] in scope], "the things of er", 20)
    got = catalog.QUERIES["stemmed_search"](spark, SF).collect()
    assert sorted((r["doc_id"], round(r["score"], 9)) for r in got) == sorted((d, round(s, 9)) for s, d in want)


@pytest.mark.parametrize("query,k", [("the of", 5), ("the", 3), ("of and in the", 50), ("de la", 7), ("zzzz the", 5), ("...", 5)])
def test_top_is_the_scan(spark, query, k):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("doc_id", F.col("doc_id") * 700)
    index = text_index.stored(spark, text_index.build(docs).path, "simple")
    scope = docs.filter("lang <> 'de'")
    got = text_index.top(index, query, k, scope).collect()
    want = search.keyword_topk(scope, query, k).select("doc_id", "score").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_only_the_asked_parts_are_read(spark):
    rows = [(i, f"w{i % 40:02d} the common words of n{i}") for i in range(4000)]
    index = text_index.build(spark.createDataFrame(rows, "doc_id long, text string"))
    assert index.ranges.count() > 1
    own = text_index.rows_of(index, ["w07"])
    plan = own._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(part" in plan or "PartitionFilters: [(part" in plan or "PartitionFilters: [part" in plan
    assert "lexeme" in plan.split("PushedFilters:")[1]
    assert own.select("part").distinct().count() < index.ranges.count()
    assert [r["doc_id"] for r in text_index.top(index, "w07 common", 3).orderBy("doc_id").collect()] == [7, 47, 87]
    assert index.lexicon.filter("lexeme = 'common'").first()["df"] == 4000


def test_nulls_and_empty_tables(spark):
    docs = spark.createDataFrame([(None, "the of"), (1, None), (2, ""), (3, "the of the"), (3, "of")], "doc_id long, text string")
    assert [tuple(r) for r in text_index.top(text_index.build(docs), "of the", 5).collect()] == [(3, 4)]
    assert text_index.top(text_index.build(docs.limit(0)), "of the", 5).count() == 0


def test_lists_meet_over_batches(spark):
    """Lists of one lexeme and block that come in several batches, and rows of one id in different tasks, are one list."""
    import pyarrow as pa

    batch = lambda *rows: pa.RecordBatch.from_pylist([{"id": i, "words": w} for i, w in rows], pa.schema([("id", pa.int64()), ("words", pa.list_(pa.string()))]))
    parts = list(text_index.inverted(iter([batch((7, ["a", "b", "a"]), (2000, ["b"])), batch((7, ["a"]), (3, None), (5, ["a"])), batch()])))
    rows = sorted((r for p in parts for r in p.to_pylist()), key=lambda r: (r["lexeme"], r["block"]))
    whole = pa.RecordBatch.from_pylist(rows, parts[0].schema)
    for size in (1, 2, 9):
        own = [r for p in text_index.merged(whole.slice(i, size) for i in range(0, len(whole), size)) for r in p.to_pylist()]
        assert [(r["lexeme"], r["block"], r["n"], r["most"], r["times"], r["ids"], r["positions"]) for r in own] == [("a", 0, 2, 3, 4, [5, 7], [[1], [1, 1, 3]]), ("b", 0, 1, 1, 1, [7], [[2]]), ("b", 1, 1, 1, 1, [2000], [[1]])]
    docs = spark.createDataFrame([(1, "x y"), (1, "y"), (1025, "y x")], "doc_id long, text string").repartition(3)
    assert sorted((r["lexeme"], r["block"], r["positions"]) for r in text_index.build(docs).postings.collect()) == [("x", 0, [[1]]), ("x", 1, [[2]]), ("y", 0, [[1, 2]]), ("y", 1, [[1]])]
