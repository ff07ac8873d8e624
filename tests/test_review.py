"""The ledger of replies over a run that dies, and the review's gate and summaries."""

import os
import time

import pytest
from pyspark.sql import functions as F

from lexmill.operators import contract_review as R
from lexmill.operators.replies import Ledger


class Counting:
    """Notes each question in a folder; fails or dies as told."""

    name = "test"

    def __init__(self, folder, fails=(), dies=()):
        self.folder, self.fails, self.dies = folder, set(fails), set(dies)

    def reply(self, task, text):
        if text in self.dies:
            time.sleep(12)  # the other tasks end meanwhile
            raise SystemExit("killed")
        with open(f"{self.folder}/{text}", "a") as f:
            f.write("x")
        if text in self.fails:
            raise ValueError("busy")
        return f"<think>hm</think>about {text}"


def test_a_run_that_dies_goes_on(spark, tmp_path):
    os.mkdir(tmp_path / "asked")
    ledger = Ledger(spark, f"{tmp_path}/ledger", pause=0.0)
    rows = spark.createDataFrame([(i, f"p{i % 40}") for i in range(80)] + [(99, None)], "id long, text string").repartition(4)
    with pytest.raises(Exception):
        ledger.ask(rows, Counting(tmp_path / "asked", dies=["p7"]), "t", "1", "text").collect()
    kept = {r["key"] for r in ledger.known().collect()}
    before = {f: os.path.getsize(tmp_path / "asked" / f) for f in os.listdir(tmp_path / "asked")}
    got = ledger.ask(rows, Counting(tmp_path / "asked", fails=["p7"]), "t", "1", "text").collect()
    after = {f: os.path.getsize(tmp_path / "asked" / f) for f in os.listdir(tmp_path / "asked")}
    assert {r["reply"] for r in got} == {None} | {f"about p{i}" for i in range(40) if i != 7}
    assert {r["text"] for r in got if r["reply_error"]} == {"p7"} and len(got) == 81
    # What the first run has committed isn't asked again, and nothing is asked twice in one run.
    assert sum(after.values()) - sum(before.values()) == 40 - len(kept) + 2
    assert 0 < len(kept) < 40
    again = ledger.ask(rows, Counting(tmp_path / "asked"), "t", "1", "text").collect()
    last = {f: os.path.getsize(tmp_path / "asked" / f) for f in os.listdir(tmp_path / "asked")}
    assert {f for f in last if last[f] != after[f]} == {"p7"} and not any(r["reply_error"] for r in again)
    assert ledger.ask(rows, Counting(tmp_path / "asked"), "t", "2", "text").filter("reply IS NULL").count() == 1


def test_gate_and_summaries(spark, tmp_path):
    long = "This very long clause on termination goes on and on, so that the first pass writes it in capitals and it has to be asked again"
    texts = [(1, f"Term is two years. {long}. Law of Ohio"), (2, "No such thing"), (3, None), (4, "x" * 8000 + "." + " y" * 4000 + ". The term ends. " + "z. " * 40_000)]
    docs = spark.createDataFrame(texts, "doc long, text string")
    ledger = Ledger(spark, f"{tmp_path}/ledger", pause=0.0)
    got = {(r["doc"], r["name"]): tuple(r)[2:] for r in R.clauses(docs, ["term", "termination", "law"], ledger, R.SentenceChat()).collect()}
    assert got[1, "term"] == ("Term is two years", "Term is two years", True, False)
    assert got[1, "termination"] == (long[:40], long, True, True)
    assert got[1, "law"] == ("Law of Ohio", "Law of Ohio", True, False)
    assert got[2, "term"] == got[3, "law"] == ("Not found", "", False, False)
    assert got[4, "term"] == ("The term ends", "The term ends", True, False) and len(got) == 12
    said = {r["doc"]: (r["summary"], r["levels"]) for r in R.summary(docs, ledger, R.SentenceChat()).collect()}
    assert said[1] == ("Term is two years", 1) and said[3] == ("", 1) and said[4] == ("x" * 60, 3) and len(said) == 4
    asked = ledger.rows().count()
    R.clauses(docs, ["term", "termination", "law"], ledger, R.SentenceChat()).collect()
    assert ledger.rows().count() == asked
    assert R.clauses(docs.limit(0), ["term"], ledger, R.SentenceChat()).count() == 0 and R.summary(docs.filter(F.lit(False)), ledger, R.SentenceChat()).count() == 0


def test_a_text_is_kept_once_for_all_clauses(spark, tmp_path, monkeypatch):
    kept, written = {}, R.written
    monkeypatch.setattr(R, "written", lambda df, name: kept.setdefault(name, written(df, name)))
    docs = spark.createDataFrame([(1, "Term is two years. Law of Ohio"), (2, "No such thing")], "doc long, text string")
    assert R.clauses(docs, ["term", "law", "fee"], Ledger(spark, f"{tmp_path}/ledger", pause=0.0), R.SentenceChat()).filter("verified").count() == 2
    assert {name: df.count() for name, df in kept.items()} == {"first_pass": 2}
