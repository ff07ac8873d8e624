"""Registered extractors, checklists and routes, called from SQL."""

from lexmill.functions.table_functions import Extensions, by_pattern


def test_called_from_sql(spark):
    own = Extensions()
    own.extractors["money"] = by_pattern("money", r"\$\d+")
    own.extractors["shouted"] = lambda text: (("word", text.index(w), w) for w in text.split() if w.isupper())
    own.checklists["lease"] = ["Term", "Rent"]
    own.routes += [("1.01", "agreement", lambda t: "agreement" in t.lower()), ("8.01", "any", bool)]
    own.register(spark)
    spark.createDataFrame([(1, "An AGREEMENT for $5 and $70"), (2, None), (3, "")], "id long, t string").createOrReplaceTempView("texts")
    rows = lambda sql: sorted(map(tuple, spark.sql(sql).collect()))
    assert rows("SELECT id, x.at, x.raw FROM texts, LATERAL extract('money', t) x") == [(1, 17, "$5"), (1, 24, "$70")]
    assert rows("SELECT id, x.raw FROM texts, LATERAL extract('shouted', t) x") == [(1, "AGREEMENT")]
    assert rows("SELECT * FROM extract('nobody', 'x')") == []
    assert rows("SELECT id, c.place, c.clause FROM texts, LATERAL checklist(CASE id WHEN 1 THEN 'lease' END) c") == [(1, 1, "Term"), (1, 2, "Rent")]
    assert rows("SELECT id, r.item FROM texts, LATERAL route(t) r") == [(1, "1.01"), (1, "8.01")]
