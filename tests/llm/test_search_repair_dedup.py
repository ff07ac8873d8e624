"""Ranked search, conversation repair and substring dedup: against SQL, brute force and edge cases."""

import hashlib
import itertools
import math
import random
import re
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from lexmill.llm import conversations, lexical, substring_dedup

SF = "/root/testdata/sf0.001"


def rows(frame):
    return sorted(map(tuple, frame[sorted(frame.columns)].itertuples(index=False)), key=str)


@pytest.mark.parametrize("query,sql", [(lexical.op11_lexical_search, lexical.OP11_SQL), (conversations.op12_conversation_repair, conversations.OP12_SQL), (substring_dedup.op13_substring_dedup, substring_dedup.OP13_SQL)])
def test_query_is_its_sql(spark, query, sql):
    duck = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    assert rows(query(spark, SF).toPandas()) == rows(duck.execute(sql).fetch_df())


# --- ranked search ---

LOW = {ord(c): ord(c) + 32 for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def ranked(docs, items, k):
    terms = lambda t: re.findall(lexical.TERM, (t or "").translate(LOW))
    own = [(d, terms(t)) for d, t in docs]
    own = [x for x in own if x[1]]
    n, total = len(own), sum(len(w) for _, w in own)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(terms(t))
    out = []
    for i, words in asked.items():
        found = []
        for d, w in own:
            m, score = 10 + (90 * len(w) * n) // total, 0
            for t in words & set(w):
                df = sum(t in x for _, x in own)
                score += math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1))) * ((1_000_000_000 * w.count(t)) // (1000 * w.count(t) + 8 * m))
            if score > 0:
                found.append((-score, d is None, d or 0, d))
        out += [(i, r, x[3], -x[0]) for r, x in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=str)


def searched(spark, docs, items, k=10, slices=None, monkeypatch=None):
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    return sorted(map(tuple, lexical.search(lexical.cut(lexical.build_index(d), "index"), i, k).collect()), key=str)


def test_search_is_brute_force(spark):
    draw = random.Random(5)
    words = [f"w{i}" for i in range(30)]
    docs = [(draw.choice([None, draw.randrange(-50, 10_000)]) if i % 40 == 0 else i * 3, " ".join(draw.choice(words[: draw.choice([3, 10, 30])]) for _ in range(draw.choice([1, 4, 20])))) for i in range(300)]
    items = [(i, " ".join(draw.sample(words, draw.choice([1, 3, 12])))) for i in range(25)]
    for k in (1, 3, 10):
        assert searched(spark, docs, items, k) == ranked(docs, items, k)


def test_search_over_small_blocks_of_items(spark, monkeypatch):
    docs = [(i, "the common word " + "x" * (i % 7 + 1)) for i in range(60)]
    items = [(i, "the word " + "x" * (i % 7 + 1)) for i in range(9)]
    want = ranked(docs, items, 10)
    monkeypatch.setattr(lexical, "ITEMS", 200)
    assert searched(spark, docs, items) == want


def test_search_edges(spark):
    docs = [(1, None), (2, ""), (3, "?!"), (4, "Alpha beta"), (4, "alpha beta"), (None, "ALPHA beta"), (5, "Élan alpha"), (5, "Élan alpha"), (6, "beta " * 50_000 + "gamma")]
    items = [(1, "alpha"), (1, "alpha beta"), (None, "gamma"), (2, None), (3, "nowhere"), (4, "Élan"), (5, "élan")]
    got = searched(spark, docs, items)
    assert got == ranked(docs, items, 10)
    assert [x for x in got if x[0] == 5] == [] and len([x for x in got if x[0] == 4]) == 2 and [x[2] for x in got if x[0] is None] == [6]
    assert searched(spark, docs[:0], items) == [] and searched(spark, docs, items[:0]) == []
    odd = spark.createDataFrame([(1, "alpha", "x", 2)], "doc_id long, text string, term string, shard int")
    assert lexical.search(lexical.cut(lexical.build_index(odd), "index"), spark.createDataFrame([(1, "alpha", 5)], "item_id long, text string, rank int")).count() == 1


def test_numbers_round_trip():
    import numpy as np

    values = np.array([0, 1, 127, 128, 16383, 16384, 2**31, 2**40, 2**62], np.uint64)
    body, sizes = lexical.varints(values)
    assert lexical.numbers(body.tobytes()).tolist() == values.tolist() and sizes.tolist() == [1, 1, 1, 2, 2, 3, 5, 6, 9]


# --- conversation repair ---


def damage(table):
    out = []
    for conv, turn, role, text in table:
        said = [" " if x is None else str(x) for x in (conv, turn, role, text)]
        fate, role, text = zlib.crc32(f"{said[0]}:{said[1]}".encode()) % 20, said[2], said[3]
        if fate == 0:
            continue
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        out += [(conv, turn, "user" if fate == 4 else role, text)] * (2 if fate == 3 else 1)
    return out


BLANKS = " \t\n\x0b\x0c\r"


def scripts(turns):
    """All edit scripts of up to two insertions in a row, as (cost, audit, roles, lines)."""
    fits = re.compile("(s?(ua)+)?$")
    choices = []
    for role, text, fault in turns:
        own = [(3, "D", "", [])]
        if fault not in ("b", "d"):
            t = int(fault == "t")
            own.append((t, "K", role[:1] or "?", [f"{role}:{text}"]))
            own += [(2 + t, "R", r[0], [f"{r}:{text}"]) for r in ("user", "assistant")]
        choices.append(own)
    add = [(0, "", "", [])] + [(2, "I", r[0], [f"{r}:"]) for r in ("user", "assistant")]
    add += [(4, "II", a[2] + b[2], a[3] + b[3]) for a in add[1:] for b in add[1:]]
    steps = [add, *itertools.chain.from_iterable((own, add) for own in choices)]
    best = None
    for way in itertools.product(*steps):
        if fits.match("".join(x[2] for x in way)):
            key = (sum(x[0] for x in way), "".join(x[1] for x in way))
            if best is None or key < best[0]:
                best = (key, "\n".join(line for x in way for line in x[3]))
    return best


def repaired(table):
    out, after = [], damage(table)
    for conv in {x[0] for x in table}:
        own = sorted((x for x in after if x[0] == conv), key=lambda x: (x[1] is not None, x[1] or 0, x[2].encode(), x[3].encode()))
        seen, turns = set(), []
        for _, _, role, text in own:
            solid = text.rstrip(BLANKS)
            turns.append((role, text, "b" if not solid else "d" if (role, text) in seen else "t" if solid[-1] not in ".!?" else ""))
            seen.add((role, text))
        numbers = [x[1] for x in own if x[1] is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        (cost, audit), lines = scripts(turns)
        faults = [sum(t[2] == f for t in turns) for f in "bdt"]
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(turns))
        out.append((conv, gaps, *faults, illegal, cost, audit, hashlib.sha256(lines.encode()).hexdigest()))
    return sorted(out, key=str)


CONV = "conv_id long, turn long, role string, text string"


def test_repair_is_brute_force(spark):
    draw = random.Random(3)
    table = []
    for conv in range(70):
        for turn in range(draw.choice([1, 2, 3])):
            table.append((conv if conv else None, draw.choice([turn, turn, turn, 0, None, 9]), draw.choice(["user", "assistant", "system", "user", "assistant", "tool", "", None]), draw.choice(["One.", "Two!", "open", "", " \n", None, "One."])))
    got = sorted(map(tuple, conversations.repair(spark.createDataFrame(table, CONV)).collect()), key=str)
    assert got == repaired(table)


def test_pieces_join_as_one(spark, monkeypatch):
    """A conversation in many pieces over many tasks is repaired as in one, ties and all."""
    draw = random.Random(8)
    table = [(7, t, draw.choice(["user", "assistant", "system", "user"]), draw.choice(["A.", "b", f"c{t}.", f"d{t}", ""])) for t in range(400)] + [(8, 0, "user", "x.")] * 30
    whole = sorted(map(tuple, conversations.repair(spark.createDataFrame(table, CONV)).collect()))
    monkeypatch.setattr(conversations, "PIECE", 3)
    assert sorted(map(tuple, conversations.repair(spark.createDataFrame(table, CONV).repartition(7)).collect())) == whole
    duck = duckdb.connect()
    duck.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    duck.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", table)
    assert [tuple(r) for r in duck.execute(conversations.OP12_SQL + " ORDER BY 1").fetchall()] == whole


def test_repair_edges(spark):
    assert conversations.repair(spark.createDataFrame([], CONV)).count() == 0
    gone = next(c for c in range(100) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    odd = spark.createDataFrame([(gone, 0, "user", "x.", "z", 1)], CONV + ", part string, pieces int")
    assert [tuple(r) for r in conversations.repair(odd).collect()] == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    many = spark.createDataFrame([(1, 5, "user", "Same.")], CONV).select("*", F.explode(F.sequence(F.lit(1), F.lit(20_000)))).drop("col")
    row = conversations.repair(many).first()
    n = len(row["audit"])
    assert row["duplicate"] == row["illegal"] == n - 2 and row["cost"] == 3 * (n - 2) + 2 and row["audit"] == "K" + "D" * (n - 2) + "I"


# --- substring dedup ---


def deduped(table, n):
    first, own = {}, []
    for doc, text in table:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        own.append((doc, words))
        for s in range(len(words) - n + 1):
            key = (2**63 - 1 if doc is None else doc, s)
            w = tuple(words[s : s + n])
            first[w] = min(first.get(w, key), key)
    out = []
    for doc, words in own:
        gone = set()
        for s in range(len(words) - n + 1):
            if first[tuple(words[s : s + n])] != (2**63 - 1 if doc is None else doc, s):
                gone.update(range(s, s + n))
        out.append((doc, len(words), len(gone), " ".join(w for i, w in enumerate(words) if i not in gone)))
    return sorted(out, key=str)


def without(spark, table, **more):
    docs = spark.createDataFrame(table, "doc_id long, text string")
    return sorted(map(tuple, substring_dedup.remove_repeats(docs, **more).select("doc_id", "n_words", "n_removed", "text").collect()), key=str)


@pytest.mark.parametrize("block,depth", [(8_000_000, 1), (300, 1), (300, 2)])
def test_dedup_is_brute_force(spark, block, depth):
    draw = random.Random(1)
    passages = [[f"p{k}x{i}" for i in range(draw.choice([4, 5, 9]))] for k in range(12)]
    table = []
    for i in range(120):
        words = list(itertools.chain.from_iterable(draw.choice([draw.choice(passages), [f"u{i}"], ["a"] * draw.choice([1, 12])]) for _ in range(draw.choice([0, 1, 5]))))
        table.append((None if i % 30 == 0 else i % 90, draw.choice([" ", "\n", " \t "]).join(words)))
    assert without(spark, table, n=5, block=block, depth=depth) == deduped(table, 5)


def test_dedup_edges(spark):
    long = " ".join(f"w{i}" for i in range(200_000))
    table = [(1, None), (2, ""), (3, "\x0b \x1c x"), (4, long), (5, "before " + long + " after"), (6, "a\xa0b " * 21), (7, "short text"), (7, "short text")]
    got = without(spark, table, block=1000)
    assert got == deduped(table, 20)
    assert [x[3] for x in got if x[0] == 5] == ["before after"]
    assert substring_dedup.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_dedup_keeps_odd_columns_and_equal_rows(spark):
    text = " ".join(f"w{i}" for i in range(30))
    docs = spark.createDataFrame([(1, text, 5, "a", "b")] * 3 + [(2, text, 6, "c", "d")], "doc_id long, text string, n_words int, __block string, `a.b` string")
    out = substring_dedup.remove_repeats(docs)
    assert out.columns == ["doc_id", "__block", "a.b", "text", "n_words", "n_removed"]
    assert sorted((r["doc_id"], r["__block"], r["n_words"], r["n_removed"]) for r in out.collect()) == [(1, "a", 30, 0)] * 3 + [(2, "c", 30, 30)]


def test_hot_window_is_one_entry_a_block(spark):
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.concat(F.lit(" ".join(f"s{i}" for i in range(20)) + " u"), "id").alias("text"))
    got = substring_dedup.remove_repeats(docs, block=20_000)
    assert got.agg(F.sum("n_removed")).first()[0] == 20 * 5999
