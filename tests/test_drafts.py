"""Drafts, model-backed steps and the registrant: failures, empties, and what must not change."""

import json

from pyspark.sql import functions as F

from lexmill.operators import corpus, drafts, filing, models, registrant, state

FACT = "array<struct<fact:string,source_quote:string,origin:string>>"


class Broken:
    name = "broken"

    def __init__(self, tasks):
        self.tasks, self.calls = tasks, 0

    def reply(self, task, text):
        if task in self.tasks:
            raise OSError("no answer")
        return models.ExtractiveChat().reply(task, text)


def test_merge_signals(spark):
    schema = "filing int, item string, pos int, disclosure string, verdict string, items array<string>, flags array<string>, blanked array<string>, facts array<string>, derived array<string>, grounded string, source_text string"
    rows = spark.createDataFrame([(1, "1.01", 2, "b", "blocked", ["y"], None, [], ["f"], None, "", "t"), (1, "1.01", 1, "a", None, ["x"], ["n"], [], None, None, "g", None), (2, None, 1, None, None, None, None, None, None, None, None, None)], schema)
    one, two = drafts.merge_signals(rows).orderBy("filing").collect()
    assert (one.disclosure, one.verdict, one["items"], one.flags, one.facts, one.grounded, one.source_text) == ("a", "blocked", ["x", "y"], ["n"], ["f"], "g", "t")
    assert (two.disclosure, two.verdict, two["items"], two.source_text) == (None, "clean", [], "")
    assert drafts.merge_signals(rows.limit(0)).count() == 0


def test_trace(spark):
    facts = [("a", "the price ... cash", None), ("b", "nowhere", ""), ("c", "is qualified in its Entirety by", None), ("d", None, None), ("e", "said", "business_context")]
    row = spark.createDataFrame([(facts, "the  price is paid in cash")], f"f {FACT}, s string").select(drafts.trace(F.col("f"), F.col("s")).alias("t")).first()
    assert [(f.fact, f.verified) for f in row.t] == [("a", True), ("b", False), ("d", False), ("e", None)]


def context(spark, disclosure, note, revised, added="It will grow."):
    schema = f"d struct<item:string,disclosure:string,sections:array<struct<item:string,disclosure:string,cross_ref:boolean>>,facts:{FACT}>, note string, revised string, added string"
    sections = [("1.01", disclosure, False), ("1.01", disclosure, True), ("2.03", disclosure, None)]
    df = spark.createDataFrame([(("1.01", disclosure, sections, []), note, revised, added)], schema)
    return df.select(drafts.add_context(F.col("d"), F.col("note"), F.col("revised"), F.col("added")).alias("x")).first().x


def test_add_context(spark):
    kept = context(spark, "Pays $5,000.\n\nEnd.", "n", "It will grow and pays $5,000.")
    assert kept.disclosure == "It will grow and pays $5,000.\n\nEnd."
    assert [s.disclosure == kept.disclosure for s in kept.sections] == [True, False, False]
    assert [f.origin for f in kept.facts] == ["business_context"]
    assert context(spark, "Pays $5,000. \n\nEnd.", "n", "It pays $4,000.").disclosure == "Pays $5,000. It will grow.\n\nEnd."
    for note, revised in ((None, "x"), (" ", "x"), ("n", None)):
        assert context(spark, "Pays $5,000.", note, revised).disclosure == "Pays $5,000."


def test_model_failures(spark):
    docs = spark.createDataFrame([(1, "On Item 1.01. More.", "", "2020-13-01"), (2, None, None, None)], "doc int, text string, doc_type string, doc_date string")
    got = models.metadata(docs, Broken({"metadata"})).orderBy("doc").collect()
    assert [(r.doc_type, r.doc_date) for r in got] == [("", ""), ("", "")]
    assert got[0].metadata_error == "OSError: no answer" and got[1].metadata_error is None
    assert [r["items"] for r in models.item_suggestions(docs, models.ExtractiveChat()).orderBy("doc").collect()] == [["1.01"], []]
    assert [r["items"] for r in models.item_suggestions(docs, Broken({"items"})).collect()] == [[], []]
    assert [r.summary for r in models.summaries(docs, models.ExtractiveChat()).orderBy("doc").collect()] == ["On Item 1.01.", ""]
    assert {r.summary for r in models.summaries(docs, Broken({"summary"})).collect()} == {""}


def test_narrative_flags(spark):
    docs = spark.createDataFrame([(1, ["a b", "b a", "c"], "a b")], "doc int, claims array<string>, evidence string")
    found = lambda model: [(r.pos, r.claim) for r in models.narrative_flags(docs, model).orderBy("pos").collect()]
    assert found(models.ExtractiveChat()) == [(2, "c")]
    assert found(Broken({"confirm"})) == [(1, "b a"), (2, "c")]
    assert found(Broken({"audit"})) == []


def test_repaired(spark):
    rows = spark.createDataFrame([("Not found", "5 years", "five (5) years"), ("3 years", "5 years", "five (5) years"), ("", "5 years", "six years"), (None, "Not found", "five")], "old string, new string, quote string")
    assert [r[0] for r in rows.select(models.repaired(F.col("old"), F.col("new"), F.col("quote"), F.lit("a term of five (5) years"))).collect()] == ["5 years", "3 years", "", None]


def test_registrant(spark, tmp_path):
    good, bad = tmp_path / "good.json", tmp_path / "bad.json"
    good.write_text(json.dumps({"name": "Foo", "phone": None}, indent=2))
    bad.write_text("{")
    assert [registrant.load(spark, str(p)).first().name for p in (good, bad, tmp_path / "none.json")] == ["Foo", registrant.DEFAULT["name"], registrant.DEFAULT["name"]]
    assert registrant.load(spark, str(good)).first().phone == registrant.DEFAULT["phone"]
    store = state.Store(spark, str(tmp_path / "store"))
    saved = registrant.save(store, spark.createDataFrame([("Bar", None)], "name string, state string")).first()
    assert (saved.name, saved.state) == ("Bar", "Delaware")


def test_update_column(spark):
    table = spark.createDataFrame([(1, "a", 7), (2, "b", 8), (3, None, 9)], "id int, result string, n int")
    new = spark.createDataFrame([(2, None), (3, "c"), (4, "d")], "id int, result string")
    assert [tuple(r) for r in state.update_column(table, new, "id", "result").orderBy("id").collect()] == [(1, "a", 7), (2, None, 8), (3, "c", 9)]


def test_exhibit_links(spark):
    rows = spark.createDataFrame([(None,), ("",), ('<tr>EX-10.1<a href="/a"><TR>ex-99<a href="/a"><tr>EX-104<a href="/b">',)], "h string")
    got = [r[0] for r in rows.select(filing.exhibit_links(F.col("h"), "https://x")).collect()]
    assert got[1] == [] and [tuple(x) for x in got[2]] == [("EX-10", "https://x/a")]


def test_split_by_group(spark):
    pairs = spark.createDataFrame([(i % 40,) for i in range(200)], "g int")
    once, again = ({r.g: r.split for r in corpus.split_by_group(pairs.repartition(n), "g", 0.12, 7).collect()} for n in (1, 5))
    assert once == again and sorted(once) == list(range(40)) and list(once.values()).count("val") == 4
    assert [r.split for r in corpus.split_by_group(pairs.filter("g = 3"), "g", 0.12, 7).collect()] == ["val"]
    assert corpus.split_by_group(pairs.limit(0), "g", 0.12, 7).count() == 0


def test_round_trip_of_one_file_runs_in_all_tasks(spark):
    docs = spark.createDataFrame([(1, "On May 3, 2026, Acme Inc. paid $5."), (2, None)], "doc long, source string").coalesce(1)
    assert corpus.delex_round_trip(docs).rdd.getNumPartitions() == 4
