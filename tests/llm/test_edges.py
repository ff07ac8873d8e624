"""Odd column names, repeated rows, very long texts, many findings, shared ids; direct versions of mixing and sharding."""

import random
import re
import time
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lexmill.llm import bpe, common, fingerprints, licenses, line_dedup, mixing, ngram_join, quality, secrets, sharding, toxicity

from .test_operators import WORD, brute_components, brute_secrets, prose

ODD = ["a.b", "__id", "__t", "__m", "__o", "__c0", "__owner", "id", "TEXT", "Doc_ID", "b", "h1", "rank", "place", "n", "two words"]


def model():
    return toxicity.Model(toxicity.Odds({"vile": (5, 0)}, 10, 10), 1.0, 1.0, np.array([-1.0, 1.0, 1.0]))


OPERATORS = {
    "licenses": lambda d: licenses.scan(d),
    "line_dedup": lambda d: line_dedup.dedup_lines(d),
    "mixing": lambda d: mixing.taken_rows(d, share=2.0),
    "bpe": lambda d: bpe.encode(d, *bpe.default_vocabulary()),
    "ngram_join": lambda d: ngram_join.keep_one(d),
    "quality": lambda d: quality.measure(d),
    "quality keep": lambda d: quality.keep(d),
    "secrets": lambda d: secrets.scan(d),
    "toxicity": lambda d: toxicity.score(d, model()),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_column_names(spark, name):
    """Every extra column comes back under its own name with its own values."""
    texts = [prose(i, 60) for i in range(3)] + [None]
    rows = [(i, t, "s", *(f"{c}{i}" for c in ODD)) for i, t in enumerate(texts)]
    names = ["doc_id", "text", "source", *ODD]
    docs = spark.createDataFrame(rows, ", ".join(f"c{i} {'long' if not i else 'string'}" for i in range(len(names)))).toDF(*names)
    out = OPERATORS[name](docs)
    made = [i for i, c in enumerate(out.columns) if c in ODD]
    assert [out.columns[i] for i in made] == ODD
    at = out.columns.index("doc_id")
    found = [tuple(r) for r in out.collect()]
    assert found and all(r[i] == f"{out.columns[i]}{r[at]}" for r in found for i in made)


def long_text():
    r = random.Random(4)
    words = [f"w{r.randrange(10**6)}" for _ in range(300_000)]
    lines = [" ".join(words[i : i + 20]) for i in range(0, len(words), 20)]
    return "\n".join(lines) + "\nReleased under the MIT License.\npassword=hunter22"


def test_very_long_text(spark):
    """A text of 2.3 MB, twice, beside short ones: larger than any slice that the kernels work on."""
    big = long_text()
    docs = spark.createDataFrame([(1, big, "a"), (2, big + " more", "a"), (3, "short", "b"), (4, big, "b")], "doc_id long, text string, source string").repartition(2)
    docs = common.cut(docs, "long_texts")
    assert len(big) > 2_200_000
    by = lambda out: {r["doc_id"]: r for r in out.collect()}
    lines = by(line_dedup.dedup_lines(docs).select("doc_id", "n_lines", "n_dropped"))
    assert [tuple(lines[i])[1:] for i in (1, 2, 3, 4)] == [(15_002, 0), (15_002, 15_001), (1, 0), (15_002, 15_002)]
    links = by(ngram_join.link(docs))
    words = WORD.findall(big.lower())
    assert [links[i]["component_id"] for i in (1, 2, 3, 4)] == [1, 1, 3, 1] and links[1]["n_shingles"] == len(set(zip(*(words[k:] for k in range(5)))))
    counts = by(quality.measure(docs).select("doc_id", "n_words"))
    assert counts[1]["n_words"] == 300_006
    found = by(secrets.scan(docs).select("doc_id", "spans"))
    assert [s["start"] for s in found[1]["spans"]] == [len(big) - 17]
    assert by(licenses.scan(docs))[2]["license"] == "MIT-notice"
    tokens = by(bpe.encode(docs, *bpe.default_vocabulary()).select("doc_id", "n_tokens"))
    assert tokens[1]["n_tokens"] == tokens[4]["n_tokens"] > 300_000
    near = by(fingerprints.fingerprints(docs))
    assert near[1]["fingerprint"] == near[4]["fingerprint"] and near[1]["n_chars"] == len(big)
    assert {i: r["class_id"] for i, r in by(fingerprints.near_duplicates(docs)).items()} == {1: 1, 2: 1, 3: 3, 4: 1}
    assert by(toxicity.score(docs, model()))[1]["score"] == by(toxicity.score(docs, model()))[4]["score"]
    assert {r["size"] for r in mixing.mix(docs).collect()} == {300_006, 300_007, 1}
    assert {r["size"] for r in sharding.shard_rows(docs, 2).collect()} == {len(big) + 8, len(big) + 13, 13}


def test_many_repeated_rows(spark):
    """Ten thousand equal rows are rounded, ranked and linked one by one, in time that grows with their number."""
    docs = spark.range(10_000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("a b c d e f").alias("text"), F.lit("s").alias("source"))
    docs = docs.union(spark.createDataFrame([(8, "x " * 5_000, "t")], docs.schema))
    began = time.time()
    out = mixing.mix(docs)
    taken = {r["source"]: r["n"] for r in out.groupBy("source").agg(F.sum("taken").alias("n")).collect()}
    target = {r["source"]: r["target"] for r in out.select("source", "target").distinct().collect()}
    assert out.count() == 10_001 and abs(taken["s"] - target["s"]) <= 6
    own = sharding.shard_rows(docs).groupBy("shard").count().collect()
    assert sorted(r["count"] for r in own) == [416] * 7 + [417] * 17
    assert mixing.taken_rows(docs).count() == out.agg(F.sum("copies")).first()[0]
    assert time.time() - began < 120


def test_many_findings(spark):
    """Fifty thousand keys in one text: positions in time that grows with their number."""
    text = "".join(f"token=abcdef{i} 😀 " for i in range(50_000))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    began = time.time()
    found = [(s["start"], s["rule"], s["kind"], s["end"]) for s in secrets.scan(docs).first()["spans"]]
    assert time.time() - began < 60 and found == brute_secrets(text)


def test_base_patterns_find_what_the_contract_says(spark):
    """The least length inside a pattern finds the same spans as a check of each match afterwards."""
    r = random.Random(8)
    texts = ["".join(r.choice(["AKIA", "A", "9", "f", "0", "ab12", " ", "KIA", "g", "0123456789abcdef"]) for _ in range(r.randrange(60))) for _ in range(400)]
    want = {}
    for i, t in enumerate(texts):
        own = [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        want[i] = sorted(own + [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 24])
    got = secrets.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), rules=secrets.BASE).collect()
    assert {r["doc_id"]: [(s["start"], s["rule"], s["end"]) for s in r["spans"]] for r in got} == want and sum(map(len, want.values())) > 50


def test_ledger_has_no_order_of_rules(spark):
    """Rules scanned under another list keep their place in the list that asks."""
    ledger = secrets.BlobLedger(spark)
    docs = spark.createDataFrame([(1, "password=abcdefgh " + "0f" * 20)], "doc_id long, text string")
    assert [s["rule"] for s in secrets.scan(docs, ledger, secrets.BASE[2:]).first()["spans"]] == [0]
    assert [(s["rule"], s["kind"]) for s in secrets.scan(docs, ledger).first()["spans"]] == [(0, "assign"), (2, "hex")]
    assert ledger.rows().count() == len(secrets.RULES)


def test_rows_of_one_doc_id_are_one_node(spark):
    a, b, c = prose(1, 60), prose(2, 60), prose(3, 60)
    rows = [(3, a), (5, a), (5, b), (7, b), (8, c), (9, c), (9, ""), (10, None), (None, a)]
    got = ngram_join.link(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in got if r["doc_id"]) == [(3, 3), (5, 3), (5, 3), (7, 3), (8, 8), (9, 8), (9, 8), (10, 10)]


def test_links_of_large_sets_are_exact():
    """Counts beyond the whole numbers of 32-bit floats times a hundred decide as whole numbers do."""
    shared, only = 750_000, 125_000
    for more, linked in ((0, True), (1, False)):
        sizes = [shared + only, shared + only + more]
        tokens = np.concatenate((np.arange(sizes[0]), np.arange(shared), 10**7 + np.arange(sizes[1] - shared))).astype(np.uint64)
        owner = np.repeat([0, 1], sizes)
        order = np.argsort(tokens, kind="stable")
        found = ngram_join.links_inside(tokens[order], owner[order], np.array(sizes), np.array([1, 2]))
        assert (found == [(1, 2)]) is linked


def test_groups_with_many_queries(spark, monkeypatch):
    """Groups of three members, opened in several tasks each."""
    monkeypatch.setattr(ngram_join, "GROUP", 3)
    r, base = random.Random(6), prose(50, 80).split()
    table = []
    for i in range(60):
        own = list(base)
        for _ in range(i % 4):
            own[r.randrange(80)] = f"e{r.randrange(10**6)}"
        table.append((i, " ".join(own)))
    got = ngram_join.link(spark.createDataFrame(table, "doc_id long, text string").repartition(3)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute_components(table)


def test_segments_of_falling_walks_take_linear_time():
    for steps in (np.tile([0.5, -1.0], 500_000), np.tile([1.0, -0.5], 500_000), np.random.RandomState(1).randn(1_000_000)):
        began = time.time()
        toxicity.segments(steps)
        assert time.time() - began < 6


def best_segments(s, low=0):
    """The definition: the best segment, then those of what is left and right of it."""
    sums = [(sum(s[i:j]), i - j, i, j) for i in range(len(s)) for j in range(i + 1, len(s) + 1)]
    best = max(sums, default=(0,))
    if best[0] <= 0:
        return []
    _, _, i, j = best
    return best_segments(s[:i], low) + [(best[0], low + i, low + j)] + best_segments(s[j:], low + j)


def test_segments_are_those_of_the_definition():
    for k in range(500):
        r = random.Random(k)
        steps = [r.uniform(-3, 2.5) for _ in range(r.randrange(1, 25))]
        assert [(pytest.approx(x), a, b) for x, a, b in best_segments(steps)] == toxicity.segments(np.array(steps))


def signed(h):
    return h - (1 << 64) if h >> 63 else h


def spark_hash(*values):
    """xxhash64 of whole numbers (int: 4 bytes, ("l", x): 8) and texts, one after the other."""
    seed = 42
    for v in values:
        raw = v.encode() if isinstance(v, str) else v[1].to_bytes(8, "little", signed=True) if isinstance(v, tuple) and v[1] is not None else v.to_bytes(4, "little", signed=True) if isinstance(v, int) else None
        seed = seed if raw is None else xxhash.xxh64_intdigest(raw, seed)
    return signed(seed)


def direct_mix(rows, weights, share, most, seed, fan):
    """Copies of each (doc_id, source, text), all texts unlike, by the rules of the docstring, row by row."""
    sizes = {i: len(WORD.findall(t)) for i, _, t in rows}
    names = sorted({s for _, s, _ in rows})
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    total = {s: sum(sizes[i] for i, x, _ in rows if x == s) for s in names}
    target, left, open_ = {}, share * sum(total.values()), set(names)
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > most * total[s]}
        if not full:
            target |= {s: level * weight[s] for s in open_}
            break
        target |= {s: most * total[s] for s in full}
        left -= sum(target[s] for s in full)
        open_ -= full
    uniform = lambda *v: ((spark_hash(*v) & (2**64 - 1)) >> 11) / 2**53
    key = lambda r: (("l", r[0]), ("l", r[1]), ("l", 1))
    copies = {}
    for s in names:
        own, n, level = [], sum(x == s for _, x, _ in rows), 0
        for i, x, t in rows:
            if x == s:
                wish = min(target[s] / total[s], most)
                whole = round(wish) if abs(wish - round(wish)) < 1e-9 else int(wish)
                copies[i] = whole
                if sizes[i] and abs(wish - round(wish)) >= 1e-9:
                    own.append([i, spark_hash(t), sizes[i], wish - whole])
        largest = max(sum(x == y for _, x, _ in rows) for y in names)
        while own:
            blocks = {}
            for r in own:
                place = spark_hash(seed, level, *key(r))
                blocks.setdefault(place % -(-n // fan), []).append((-r[2], place, r))
            own = []
            for block in blocks.values():
                block.sort()
                a = block[0][2]
                for _, _, b in block[1:]:
                    ratio = b[2] / a[2]
                    up, down = min(1 - a[3], b[3] * ratio), min(a[3], (1 - b[3]) * ratio)
                    rise = uniform(seed, level, *key(a), *key(b)) * (up + down) < down
                    move = up if rise else -down
                    fa, fb = a[3] + move, b[3] - move / ratio
                    done, a = ((a, [*b[:3], fb]) if fa < 1e-9 or fa > 1 - 1e-9 else (b, [*a[:3], fa]))
                    copies[done[0]] += round(fa if done[0] != b[0] else fb)
                own.append(a)
            n, largest, level = -(-n // fan), -(-largest // fan), level + 1
            if largest <= 1:
                break
        for r in own:
            copies[r[0]] += 0 if r[3] < 1e-9 else 1 if r[3] > 1 - 1e-9 else int(uniform(seed, level, *key(r)) < r[3])
    return copies, target


def test_mixing_against_a_direct_version(spark):
    r = random.Random(12)
    rows = [(i, f"s{r.choice('aabccccd')}", f"d{i} " + "w " * r.randrange(40)) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(3)
    for weights, share, most, seed, fan in (((5.0, 2.0, 1.0), 1.5, 2.0, 17, 64), ((1.0, 4.0), 0.6, 2.0, 3, 5), ((1.0,), 9.0, 2.0, 3, 5)):
        copies, target = direct_mix(rows, weights, share, most, seed, fan)
        got = mixing.mix(docs, weights, share, most, seed, fan).collect()
        assert {x["doc_id"]: x["copies"] for x in got} == copies
        assert all(x["target"] == pytest.approx(target[x["source"]]) for x in got)


def test_rounding_is_fair():
    """Over many seeds each row is taken as often as its wish says, within three standard errors."""
    rows = [(i, "a", f"d{i} " + "w " * n) for i, n in enumerate([0, 1, 2, 4, 7, 11])] + [(9, "b", "w " * 60)]
    runs = [direct_mix(rows, (1.0, 4.0), 0.6, 2.0, seed, 3) for seed in range(3000)]
    wish = runs[0][1]["a"] / sum(len(WORD.findall(t)) for _, s, t in rows if s == "a")
    for i, s, _ in rows[:-1]:
        taken = [copies[i] for copies, _ in runs]
        assert abs(np.mean(taken) - wish) <= 3 * np.sqrt(wish % 1 * (1 - wish % 1) / len(taken)) + 1e-9


def test_sharding_against_a_direct_version(spark):
    r = random.Random(13)
    texts = [f"t{k}" for k in range(250)]
    rows = [(i, r.choice([None, "a", "a", "b", "c"]), r.choice(texts) if i % 3 else f"own {i}") for i in range(700)] + [(1000 + i, r.choice("abc"), "hot") for i in range(300)]
    hashes = {}
    seen = spark.createDataFrame(rows, "doc_id long, source string, text string")
    for x in seen.select("doc_id", "source", F.xxhash64(F.lit(29), "text").alias("h1"), F.xxhash64(F.lit(29), "doc_id").alias("h2")).collect():
        hashes[x["doc_id"]] = (x["source"], x["h1"], x["h2"])
    sources = {x["s"]: x["h"] for x in spark.createDataFrame([(s,) for s in (None, "a", "b", "c")], "s string").select("s", F.xxhash64(F.lit(29), "s").alias("h")).collect()}
    least, more = divmod(len(rows), 24)
    groups = {}
    for i, (s, h, _) in hashes.items():
        groups.setdefault(h, []).append(s)
    home = lambda s, h: min((x for x in groups[h] if x), default=None) if 2 <= len(groups[h]) <= least else s
    order = sorted((home(s, h) or "", h, i) for i, (s, h, _) in hashes.items())
    per = {}
    for s, h, i in order:
        per.setdefault(s, []).append((h, i))
    at = {}
    for s, own in per.items():
        first = {}
        for k, (h, i) in enumerate(own):
            at[i] = (first.setdefault(h, k) + 0.5) / len(own), sources[s or None], h, hashes[i][2], i
    want = {}
    for place, i in enumerate(sorted(at, key=at.get)):
        edge = more * (least + 1)
        shard, slot = divmod(place, least + 1) if place < edge else (more + (place - edge) // least, (place - edge) % least)
        want[i] = shard, slot
    got = {x["doc_id"]: (x["shard"], x["slot"]) for x in sharding.shard_rows(seen.repartition(5)).collect()}
    assert got == want
    shards = {}
    for i, (_, h, _) in hashes.items():
        shards.setdefault(h, set()).add(got[i][0])
    divided = [h for h, own in shards.items() if len(own) > 1 and len(groups[h]) <= least]
    assert len(divided) <= 23 and sum(len(g) > 1 for g in groups.values()) > 100


def test_near_duplicates_find_planted_copies(spark):
    """Recall of texts with some words replaced; unlike texts stay apart."""
    r = random.Random(21)
    base = [prose(7000 + i, 150) for i in range(120)]
    rows, planted = [(i, t) for i, t in enumerate(base)], {}
    for k, (rate, least) in enumerate(((0, 1.0), (0.007, 0.75), (0.02, 0.4))):
        for i, t in enumerate(base):
            words = t.split()
            for _ in range(round(rate * len(words))):
                words[r.randrange(len(words))] = prose(r.randrange(10**6), 1)
            rows.append((1000 * (k + 1) + i, " ".join(words)))
        planted[k] = least
    got = {x["doc_id"]: x["class_id"] for x in fingerprints.near_duplicates(spark.createDataFrame([*rows, (9000, ""), (9001, None)], "doc_id long, text string")).collect()}
    for k, least in planted.items():
        assert sum(got[1000 * (k + 1) + i] == i for i in range(120)) / 120 >= least
    assert all(got[i] == i for i in range(120)) and got[9001] == got[9000] == 9000


def test_clear_removes_what_was_written(spark):
    common.cut(spark.range(3).toDF("x"), "gone")
    kept, common.WRITTEN[:] = common.WRITTEN[:-1], common.WRITTEN[-1:]
    assert common.clear(spark) == 1 and not common.WRITTEN
    common.WRITTEN[:] = kept


def test_running_sums(spark):
    rows = [(i, (i * 7919) % 101 / 2) for i in range(101)]
    out = common.running(spark.createDataFrame(rows, "i long, x double"), [F.col("x"), F.col("i")], {"before": "x"}).collect()
    total = 0.0
    for r in sorted(out, key=lambda r: (r["x"], r["i"])):
        assert r["before"] == total
        total += r["x"]


def test_join_unique_deals_hot_keys(spark):
    rows = spark.range(1000).select(F.col("id").alias("r"), F.when(F.col("id") < 900, F.lit(5)).otherwise(F.col("id")).alias("k"))
    table = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), (F.max("k") * 2).alias("v")).filter("k % 2 = 1")
    out = {r["r"]: r["v"] for r in common.join_unique(rows, table, ["k"], "n", 1000, F.col("r")).collect()}
    assert out == {i: (10 if i < 900 else 2 * i if i % 2 else None) for i in range(1000)}


def test_crc_of_sharding(spark):
    assert {r["text_crc32"] for r in sharding.shard_rows(spark.createDataFrame([(1, "é", None)], "doc_id long, text string, source string")).collect()} == {zlib.crc32("é".encode())}
