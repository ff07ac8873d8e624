"""The pipeline against a brute-force version of its stages."""

import hashlib
from collections import Counter

import corpus_pipeline
from lexmill.llm import bpe, mixing

from .test_operators import brute_components, brute_quality, key, near_copies, prose


def table():
    shared = "this line stands in many of the documents of the fixture"
    rows = [(i, t + ("\n" + shared if i % 5 == 0 else "")) for i, t in near_copies()]
    rows += [(9000 + i, "a b c d " * 30) for i in range(3)] + [(9100, None), (9101, "")]
    rows += [(9200 + i, prose(9200 + i, 70 + i) + "\nshort\n" + shared.upper()) for i in range(20)]
    return [(i, t, "en", f"src{i % 3}", len(t or "")) for i, t in rows]


def accepted(text):
    n, chars, symbols, _, repeated, dup, *cover = brute_quality(text)
    return not (n < 50 or 100 * repeated > 50 * n or 100 * dup > 30 * chars or 100 * symbols > 10 * n or any(100 * c > p * chars for c, p in zip(cover, (30, 25, 20))))


def test_pipeline(spark, tmp_path):
    docs = spark.createDataFrame(table(), "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = Counter((r["doc_id"], r["n_tokens"], r["decoded_sha256"]) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())

    rows = {i: t for i, t, *_ in table() if accepted(t)}
    owner = {}
    for i in sorted(rows):
        for line in rows[i].split("\n"):
            owner.setdefault(key(line), i)
    rows = {i: "\n".join(x for x in t.split("\n") if len(key(x)) < 10 or owner[key(x)] == i) for i, t in rows.items()}
    groups = brute_components(rows.items())
    rows = {i: t for i, t in rows.items() if groups[i][1] == i}
    kept = spark.createDataFrame([(i, t, f"src{i % 3}") for i, t in rows.items()], "doc_id long, text string, source string")
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(kept).collect()}
    path, pattern = bpe.default_vocabulary()
    own = bpe.codec(path, pattern)
    expected = Counter()
    for i, t in rows.items():
        ids, _ = next(own.encode([t]))
        expected[i, len(ids), hashlib.sha256(t.encode()).hexdigest()] += copies[i]
    assert got == +expected and sum(got.values()) > 20


def test_stages(spark):
    docs = spark.createDataFrame(table()[:40], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, "").count() == 0
