"""N-gram Jaccard join by a token-group matrix.

Tokens are hashes of a document's distinct 5-word shingles; documents with equal token sets are one representative.
Representatives of similar content are partitioned into groups of bounded size, by their best MinHash neighbour. The
matrix says which tokens the members of a group have. A query document that reaches Jaccard t with a member shares at least
a(n, m) = ceil(t / (1 + t) * (n + m)) tokens with it; of its tokens in one global order, the first n - ceil(t * n) + 1 hold at least
one of these, and as many of them as a(n, m) less what can be shared further back. So the matrix keeps the leading
tokens of members only; the query's leading tokens are counted against each group's union, and a group
whose count stays below the bound for every size its members have is never opened. Groups that qualify are opened: the query's whole
set is intersected with those of the members, exactly. Groups whose members are all in the query's own
component are not opened, as no link could add to it.

The order puts tokens that occur again and again in a part of the table last (a bounded list of the most frequent is
broadcast), so that passages which very many documents share are not looked up; any order gives the same
links. With B parts of the table a token that f documents have, and that isn't seen twice in enough of the parts, has f * f below
about 24 * B: what such tokens cost grows in proportion to the table. MinHash only makes groups, finds easy links early and saves work: links do not hang on it.

Defined results: null and wordless texts have an empty set and link with nothing; texts of fewer than five words have their whole
sequence as one shingle; rows that share a doc_id are one node, whatever their texts; rows with a null doc_id are linked with nothing and have a null
component; a lone document is its own component; texts are taken whole, however long; an empty table gives no rows. Other columns of the
input are not looked at; `keep_one` returns them, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkernel as K
from .common import by_place, cut, documents, join_unique, width
from .components import components

WORDS = 5
#: Jaccard similarity of 75 / 100 or more.
NUM, DEN = 75, 100
BANDS, ROWS = 10, 3
#: Least share of equal MinHash values to share a group, and to be checked for a link at once.
KIN, NEAR = 0.4, 0.6
GROUP, FREQUENT, MOST_FREQUENT = 2048, 24, 1 << 20
#: Leading tokens that a task gathers before it hands them on; pairs that it looks at in one go.
BATCH, STEP = 500_000, 300_000
_RANDOM = np.random.RandomState(77)
MINS = _RANDOM.randint(1, 1 << 62, BANDS * ROWS, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def token_sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """The sorted token set of each text."""
    for part in K.slices(texts, lower=True):
        words = K.words(part)
        hashes, at = K.windows(words.hashes, words.cuts, WORDS)
        cuts = np.searchsorted(at, words.cuts)
        for i in range(part.last - part.first):
            a, b = words.cuts[i], words.cuts[i + 1]
            if 0 < b - a < WORDS:
                whole = (words.hashes[a:b] * K.STEPS[: b - a]).sum(dtype=np.uint64)
                yield K.mixed(np.array([whole ^ K.STEPS[8 + b - a]], np.uint64))
            else:
                yield np.unique(hashes[cuts[i] : cuts[i + 1]])


def as_column(batch: pa.RecordBatch, name: str) -> pa.Array:
    column = batch.column(name)
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def set_print(tokens: np.ndarray) -> tuple[int, int]:
    """Two 64-bit digests of a set."""
    if not len(tokens):
        return 0, 0
    a = K.mixed(tokens + np.uint64(0x9E3779B97F4A7C15)).sum(dtype=np.uint64)
    b = K.mixed(tokens ^ np.uint64(0xD1B54A32D192ED03)).sum(dtype=np.uint64)
    return int(a.view(np.int64)), int(b.view(np.int64))


SIGNED = "doc_id long, n int, fp1 long, fp2 long, mins array<int>, bands array<long>"


def sign(docs: DataFrame) -> DataFrame:
    """A row for each document, and rows with n = -1 for tokens that repeat in a part: fp1 the token, fp2 in how many documents."""

    def run(batches):
        for batch in batches:
            sets = list(token_sets(as_column(batch, "text")))
            sizes = np.array([len(s) for s in sets], np.int64)
            prints = np.array([set_print(s) for s in sets], np.int64).reshape(-1, 2)
            flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
            starts = np.concatenate(([0], np.cumsum(sizes)))[:-1]
            some = sizes > 0
            mins = np.zeros((len(sets), BANDS * ROWS), np.uint64)
            for k in range(BANDS * ROWS):
                if some.any():
                    mins[some, k] = np.minimum.reduceat(flat * MINS[k], starts[some])
            keys = np.zeros((len(sets), BANDS), np.uint64)
            for r in range(ROWS):
                keys += mins[:, r::ROWS] * K.STEPS[r]
            keys = K.mixed(keys + np.arange(BANDS, dtype=np.uint64))
            short = (mins >> np.uint64(32)).astype(np.uint32).view(np.int32)
            del mins
            flat.sort()
            ends = np.flatnonzero(np.concatenate((flat[1:] != flat[:-1], [True]))) if len(flat) else np.zeros(0, np.int64)
            count = np.diff(np.concatenate(([-1], ends)))
            token, count = flat[ends[count > 1]], count[count > 1]
            blank, total = len(token), len(sets) + len(token)

            def lists(rows, width):
                offsets = np.minimum(np.arange(total + 1), len(sets)) * width
                return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(rows.ravel()))

            columns = [
                pa.array([*batch.column("doc_id").to_pylist(), *[None] * blank], pa.int64()),
                pa.array(np.concatenate((sizes, np.full(blank, -1))), pa.int32()),
                pa.array(np.concatenate((prints[:, 0], token.view(np.int64)))),
                pa.array(np.concatenate((prints[:, 1], count.astype(np.int64)))),
                lists(short, BANDS * ROWS),
                lists(keys.view(np.int64), BANDS),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "fp1", "fp2", "mins", "bands"]) if total else None

    return docs.select("doc_id", "text").mapInArrow(lambda batches: filter(None, run(batches)), SIGNED)


def frequent_tokens(signed: DataFrame) -> np.ndarray:
    """The tokens that repeat most, MOST_FREQUENT at most, sorted."""
    counts = signed.filter("n = -1").groupBy("fp1").agg(F.sum("fp2").alias("n")).filter(F.col("n") >= FREQUENT)
    counts = cut(counts, "frequent")
    if (total := counts.count()) > MOST_FREQUENT:
        least = counts.agg(F.percentile_approx("n", 1 - MOST_FREQUENT / total, 100_000)).first()[0]
        counts = counts.filter(F.col("n") > least)
    found = counts.select("fp1").toArrow().column("fp1").to_numpy() if total else np.zeros(0, np.int64)
    return np.sort(found.astype(np.int64).view(np.uint64))


def sets_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """id and tokens (packed 64-bit numbers) of the representatives in ids (id, fp1)."""
    wanted = docs.select("doc_id", "text").join(ids.select(F.col("id"), F.col("fp1")), F.col("doc_id") == F.col("id")).select("id", "fp1", "text")

    def run(batches):
        for batch in batches:
            rows = [(i, s.tobytes()) for i, f, s in zip(batch.column("id").to_pylist(), batch.column("fp1").to_pylist(), token_sets(as_column(batch, "text"))) if set_print(s)[0] == f]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], names=["id", "tokens"])

    return wanted.mapInArrow(run, "id long, tokens binary")


def star_pairs(reps: DataFrame) -> DataFrame:
    """a, b (the smallest of a band group) and the share of MinHash values that agree, KIN at least."""
    keyed = reps.select("id", "n", "mins", F.posexplode("bands").alias("band", "key"))
    heads = keyed.groupBy("band", "key").agg(F.min("id").alias("head"), F.count(F.lit(1)).alias("many")).filter("many > 1").select("band", "key", "head")
    pairs = keyed.select("id", "band", "key").join(heads, ["band", "key"]).filter("id <> head").select(F.col("id").alias("a"), F.col("head").alias("b")).distinct()
    one, two = (reps.select(F.col("id").alias(k), F.col("mins").alias(f"m{k}"), F.col("n").alias(f"n{k}")) for k in "ab")
    same = F.aggregate(F.zip_with("ma", "mb", lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x) / (BANDS * ROWS)
    return pairs.join(one, "a").join(two, "b").select("a", "b", "na", "nb", same.alias("alike")).filter(F.col("alike") >= KIN)


def easy_links(docs: DataFrame, reps: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those of the pairs a, b that are links, checked exactly."""
    pairs = pairs.filter((F.col("alike") >= NEAR) & (DEN * F.least("na", "nb") >= NUM * F.greatest("na", "nb"))).select("a", "b")
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct().join(reps.select("id", "fp1"), "id")
    sets = cut(sets_of(docs, ids), "star_sets")
    joined = pairs.join(sets.select(F.col("id").alias("a"), F.col("tokens").alias("ta")), "a").join(sets.select(F.col("id").alias("b"), F.col("tokens").alias("tb")), "b")

    def run(batches):
        for batch in batches:
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            good = []
            for x, y in zip(batch.column("ta"), batch.column("tb")):
                s, t = (np.frombuffer(v.as_py(), np.uint64) for v in (x, y))
                shared = len(np.intersect1d(s, t, assume_unique=True))
                good.append(DEN * shared >= NUM * (len(s) + len(t) - shared))
            yield pa.RecordBatch.from_arrays([pa.array([v for v, g in zip(c, good) if g], pa.int64()) for c in (a, b)], names=["a", "b"])

    return cut(joined.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long"), "easy_links")


def partition(reps: DataFrame, pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """id, n, fp1, comp, g: each representative's component so far and its group of at most about GROUP members.

    A family is what chains of alike pairs hold together; it is dealt into as many groups as its size asks for.
    """
    heads = components(pairs).select("id", F.col("root").alias("head"))
    family = reps.select("id", "n", "fp1").join(heads, "id", "left").select("id", "n", "fp1", F.coalesce("head", "id").alias("head"))
    family = cut(family, "families")
    many = family.groupBy("head").agg(F.count(F.lit(1)).alias("many")).filter("many > 1")
    many = cut(many.select("head", "many", F.col("many").alias("n_rows")), "family_sizes")
    # No task gets a whole family: the sizes of the few that are large are broadcast.
    placed = join_unique(family, many, ["head"], "n_rows", reps.count(), F.col("id")).fillna(1, ["many"]).join(roots, "id", "left")
    chunk = F.pmod(F.xxhash64("id"), F.ceil(F.col("many") / GROUP))
    return placed.select("id", "n", "fp1", F.coalesce("root", "id").alias("comp"), F.when(F.col("many") == 1, F.col("id")).otherwise(F.xxhash64("head", chunk)).alias("g"))


def leading(n: int) -> int:
    """How many tokens of a set of n lead."""
    return n - -(-NUM * n // DEN) + 1


POSTED = "part int, token binary, q binary, g binary, n binary"


def post(docs: DataFrame, placed: DataFrame, frequent: np.ndarray, parts: int) -> DataFrame:
    """The leading tokens of all representatives of three tokens or more, by parts of the token space."""
    rows = docs.select("doc_id", "text").join(placed.filter("n > 2").select("id", "fp1", "g"), F.col("doc_id") == F.col("id")).select("id", "fp1", "g", "text")
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def flush(held):
        token, q, g, n = (np.concatenate(x) for x in zip(*held))
        part = (token % np.uint64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        cuts = np.searchsorted(part[order], np.arange(parts + 1))
        own = [p for p in range(parts) if cuts[p] < cuts[p + 1]]
        token = (token // np.uint64(parts)).astype(np.uint32)
        columns = [[x[order[cuts[p] : cuts[p + 1]]].tobytes() for p in own] for x in (token, q, g, n)]
        return pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), *(pa.array(c, pa.binary()) for c in columns)], names=["part", "token", "q", "g", "n"])

    def run(batches):
        often, held, size = shared.value, [], 0
        for batch in batches:
            for i, f, g, tokens in zip(batch.column("id").to_pylist(), batch.column("fp1").to_pylist(), batch.column("g").to_pylist(), token_sets(as_column(batch, "text"))):
                if set_print(tokens)[0] != f:
                    continue
                if len(often):
                    at = np.minimum(np.searchsorted(often, tokens), len(often) - 1)
                    last = often[at] == tokens
                    tokens_in_order = np.concatenate((tokens[~last], tokens[last]))
                else:
                    tokens_in_order = tokens
                n = leading(len(tokens))
                held.append((tokens_in_order[:n], np.full(n, i, np.int64), np.full(n, g, np.int64), np.full(n, len(tokens), np.int32)))
                size += n
                if size >= BATCH:
                    yield flush(held)
                    held, size = [], 0
        if held:
            yield flush(held)

    return rows.mapInArrow(run, POSTED)


def count_part(token: np.ndarray, q: np.ndarray, g: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """q, g and how many leading tokens of q are among those of members of another group g of a fitting size.

    A group is one entry of a token's row in the matrix, however many of its members have the token.
    """
    order = np.lexsort((g, token))
    token, q, g, n = token[order], q[order], g[order], n[order].astype(np.int64)
    new = np.concatenate(([True], (token[1:] != token[:-1]) | (g[1:] != g[:-1]))) if len(token) else np.zeros(0, bool)
    entry = np.flatnonzero(new)
    if not len(entry):
        return (np.zeros(0, np.int64),) * 3
    group, low, high = g[entry], np.minimum.reduceat(n, entry), np.maximum.reduceat(n, entry)
    first = np.searchsorted(token[entry], token, "left")
    spans = np.searchsorted(token[entry], token, "right") - first
    rows = np.flatnonzero(spans > 1)
    total = np.cumsum(spans[rows])
    met, at = [], 0
    while at < len(rows):
        stop = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + STEP, "right")))
        own, size = rows[at:stop], spans[rows[at:stop]]
        a = np.repeat(own, size)
        b = np.repeat(first[own] - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())
        fit = (g[a] != group[b]) & (DEN * n[a] >= NUM * low[b]) & (DEN * high[b] >= NUM * n[a])
        met.append(np.stack((q[a[fit]], group[b[fit]])))
        at = stop
    left, right = np.concatenate(met, axis=1) if met else np.zeros((2, 0), np.int64)
    order = np.lexsort((right, left))
    left, right = left[order], right[order]
    begins = np.flatnonzero(np.concatenate(([True], (left[1:] != left[:-1]) | (right[1:] != right[:-1])))) if len(left) else np.zeros(0, np.int64)
    return left[begins], right[begins], np.diff(np.concatenate((begins, [len(left)])))


def meetings(posted: DataFrame) -> DataFrame:
    """q, g, shared: how many leading tokens of q are in the union of the leading tokens of g."""

    def run(table: pa.Table) -> pa.Table:
        read = lambda name, kind: np.concatenate([np.frombuffer(v.as_py(), kind) for v in table.column(name)])
        found = count_part(read("token", np.uint32), read("q", np.int64), read("g", np.int64), read("n", np.int32))
        return pa.table([pa.array(c, pa.int64()) for c in found], names=["q", "g", "shared"])

    return posted.groupBy("part").applyInArrow(run, "q long, g long, shared long").groupBy("q", "g").agg(F.sum("shared").alias("shared"))


def qualifying(met: DataFrame, placed: DataFrame) -> DataFrame:
    """q, g: queries and the groups that some member could make a link in, of another component."""
    groups = placed.groupBy("g").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.min("comp").alias("c1"), F.max("comp").alias("c2"))
    known = met.join(placed.select(F.col("id").alias("q"), F.col("n").alias("nq"), "comp"), "q").join(groups, "g")
    rest = lambda n: F.ceil(n * NUM / DEN) - 1
    need = lambda n: F.ceil((F.col("nq") + n) * NUM / (NUM + DEN)) - F.greatest(rest(F.col("nq")), rest(n))
    least = F.greatest(F.col("low"), F.ceil(F.col("nq") * NUM / DEN))
    most = F.least(F.col("high"), F.floor(F.col("nq") * DEN / NUM))
    bound = F.greatest(F.least(need(least), need(most)), F.lit(1))
    same = (F.col("c1") == F.col("comp")) & (F.col("c2") == F.col("comp"))
    return known.filter((least <= most) & (F.col("shared") >= bound) & ~same).select("q", "g")


def links_inside(tokens: np.ndarray, owner: np.ndarray, sizes: np.ndarray, comps: np.ndarray) -> list[tuple[int, int]]:
    """Links between the components of a group's members, as few as hold the same components together.

    All intersections at once: tokens that many members have by a product of 0-1 matrices, the others by their pairs.
    """
    m = len(sizes)
    begins = np.flatnonzero(np.concatenate(([True], tokens[1:] != tokens[:-1])))
    many = np.diff(np.concatenate((begins, [len(tokens)])))
    kind = np.float32 if sizes.max(initial=0) < 1 << 24 else np.float64  # whole numbers are exact up to there
    shared = np.zeros((m, m), kind)
    wide = begins[many > max(16, m // 16)]
    length = many[many > max(16, m // 16)]
    for k in range(0, len(wide), 1024):
        block = np.zeros((m, min(1024, len(wide) - k)), kind)
        for j, (a, n) in enumerate(zip(wide[k : k + 1024], length[k : k + 1024])):
            block[owner[a : a + n], j] = 1
        shared += block @ block.T
    flat = shared.ravel()
    for n in np.unique(many[(many > 1) & (many <= max(16, m // 16))]).tolist():
        at = begins[many == n]
        i, j = np.triu_indices(n, 1)
        for k in range(0, len(at), max(1, STEP // len(i))):
            rows = owner[at[k : k + max(1, STEP // len(i)), None] + np.arange(n)]
            pair, times = np.unique((rows[:, i] * m + rows[:, j]).ravel(), return_counts=True)
            flat[pair] += times
            flat[pair % m * m + pair // m] += times
    found: set[tuple[int, int]] = set()
    for i in range(m):
        both = shared[i].astype(np.int64)
        good = (DEN * both >= NUM * (sizes[i] + sizes - both)) & (comps != comps[i])
        found.update((min(int(comps[i]), int(c)), max(int(comps[i]), int(c))) for c in np.unique(comps[good]))
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = x = root[root[x]]
        return x

    kept = []
    for a, b in sorted(found):
        x, y = find(a), find(b)
        if x != y:
            root[max(x, y)] = min(x, y)
            kept.append((a, b))
    return kept


def open_groups(docs: DataFrame, placed: DataFrame, wanted: DataFrame) -> DataFrame:
    """Links a, b between a query's and a member's component, one for each pair of query and component."""
    mixed = placed.groupBy("g").agg(F.min("comp").alias("c1"), F.max("comp").alias("c2")).filter("c1 <> c2").select("g")
    # A group that very many queries open is opened in several tasks, each with its members and about GROUP of the queries.
    asking = wanted.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    chunks = F.ceil(F.col("n") / GROUP).cast("int")
    asking = cut(asking.select("g", "n", chunks.alias("chunks")), "asking")
    opened = asking.select("g", "chunks").union(mixed.select("g", F.lit(1))).groupBy("g").agg(F.max("chunks").alias("chunks"))
    members = placed.join(opened, "g").select("g", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.lit(0).alias("role"), "id", "comp")
    dealt = join_unique(wanted, asking, ["g"], "n", wanted.count(), F.col("q"))
    dealt = dealt.select("g", F.pmod(F.xxhash64("q"), F.col("chunks")).cast("int").alias("chunk"), "q")
    queries = dealt.join(placed.select(F.col("id").alias("q"), "comp"), "q").select("g", "chunk", F.lit(1).alias("role"), F.col("q").alias("id"), "comp")
    asked = cut(members.union(queries), "asked")
    ids = asked.select("id").distinct().join(placed.select("id", "fp1"), "id").distinct()
    sets = sets_of(docs, ids)
    rows = asked.join(sets, "id").repartition(width(docs.sparkSession), "g", "chunk").sortWithinPartitions("g", "chunk", "role", "id")

    def index(members):
        sets = [np.frombuffer(t, np.uint64) for _, _, t in members]
        tokens, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        order = np.argsort(tokens, kind="stable")
        return tokens[order], owner[order], np.array([len(s) for s in sets]), np.array([c for _, c, _ in members])

    def links(table, row):
        tokens, owner, sizes, comps = table
        i, comp, packed = row
        own = np.frombuffer(packed, np.uint64)
        a, b = np.searchsorted(tokens, own, "left"), np.searchsorted(tokens, own, "right")
        spans = b - a
        at = np.repeat(a - np.concatenate(([0], np.cumsum(spans)[:-1])), spans) + np.arange(spans.sum())
        shared = np.bincount(owner[at], minlength=len(sizes))
        good = (DEN * shared >= NUM * (len(own) + sizes - shared)) & (comps != comp)
        return [(comp, int(c)) for c in np.unique(comps[good])]

    def run(batches):
        group, members, table = None, [], None
        for batch in batches:
            found = []
            for g, chunk, role, i, comp, tokens in zip(*(batch.column(c).to_pylist() for c in ("g", "chunk", "role", "id", "comp", "tokens"))):
                if (g, chunk) != group:
                    found += [] if table else inside(group, members, None)
                    group, members, table = (g, chunk), [], None
                if role == 0:
                    members.append((i, comp, tokens))
                else:
                    if table is None and members:
                        table = index(members)
                        found += inside(group, members, table)
                    if table is not None:
                        found += links(table, (i, comp, tokens))
            yield out(found)
        yield out([] if table else inside(group, members, None))

    def inside(group, members, table):
        """Links inside a group, which are looked for once: in its first task, before its first query or at its end."""
        if len({c for _, c, _ in members}) < 2 or group[1]:
            return []
        return links_inside(*(table or index(members)))

    def out(found):
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], names=["a", "b"])

    return rows.select("g", "chunk", "role", "id", "comp", "tokens").mapInArrow(run, "a long, b long")


def link(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of each row."""
    spark = docs.sparkSession
    texts = docs.select("doc_id", "text")
    signed = cut(sign(texts), "signed")
    own = signed.filter("n >= 0")
    able = own.filter("n > 0 AND doc_id IS NOT NULL")
    reps = cut(able.groupBy("fp1", "fp2").agg(F.min("doc_id").alias("id"), F.first("n").alias("n"), F.first("mins").alias("mins"), F.first("bands").alias("bands")), "reps")
    pairs = cut(star_pairs(reps), "stars")
    easy = easy_links(texts, reps, pairs)
    roots = components(easy)
    placed = cut(partition(reps, pairs, roots), "placed")
    posted = post(texts, placed, frequent_tokens(signed), width(spark))
    wanted = cut(qualifying(meetings(posted), placed), "wanted")
    more = open_groups(texts, placed, wanted)
    # Rows that share a doc_id are one node: what each of them stands for is linked with the doc_id.
    shared = cut(own.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("fp1").alias("lo"), F.max("fp1").alias("hi")).filter("lo <> hi").select("doc_id"), "shared_ids")
    twice = not shared.isEmpty()
    if twice:
        more = more.union(able.join(shared, "doc_id").join(reps.select("fp1", "fp2", "id"), ["fp1", "fp2"]).select(F.col("doc_id").alias("a"), F.col("id").alias("b")))
    # Links between components of the easy links; a component is named by its smallest id, so that both kinds fit together.
    roots = components(easy.union(more))
    named = reps.select("fp1", "fp2", "id").join(roots, "id", "left").select("fp1", "fp2", F.coalesce("root", "id").alias("component_id"))
    own_rows = own.select("doc_id", F.col("n").cast("long").alias("n_shingles"), "fp1", "fp2")
    linked = own_rows.join(named, ["fp1", "fp2"], "left")
    if twice:  # a row without words has the component of its doc_id's other rows
        named_ids = shared.join(roots, F.col("doc_id") == F.col("id")).select("id", "root")
        linked = linked.join(named_ids, F.col("doc_id") == F.col("id"), "left").withColumn("doc_root", F.col("root")).drop("id", "root")
        linked = linked.withColumn("component_id", F.coalesce("doc_root", "component_id")).withColumn("alone", F.coalesce("doc_root", "doc_id"))
    else:
        linked = linked.withColumn("alone", F.col("doc_id"))
    alone = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("alone"))
    return linked.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), alone).alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """docs, of each component the rows of its smallest doc_id alone; rows with a null doc_id stay."""
    plain, names, back = by_place(docs, ("doc_id", "text"))
    found = link(plain).filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("__id")).agg(F.min("component_id").alias("__c"))
    gone = found.filter("__id <> __c").select("__id")
    return back(plain.join(gone, F.col("doc_id") == F.col("__id"), "left_anti").select(*names))


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(documents(spark, sf_dir))


OP6_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_distinct(list_transform(generate_series(1, len(w) - 4), lambda i: array_to_string(w[i:i + 4], ' '))) END AS g FROM d),
u AS (SELECT min(doc_id) AS rep, g FROM (SELECT doc_id, list_sort(g) AS g FROM s) WHERE len(g) > 0 GROUP BY g),
t AS (SELECT rep, len(g) AS n, unnest(g) AS x FROM u),
p AS (SELECT a.rep AS a, b.rep AS b FROM t a JOIN t b ON a.x = b.x AND a.rep < b.rep AND 100 * a.n >= 75 * b.n AND 100 * b.n >= 75 * a.n
      GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
e AS (SELECT a, b FROM p UNION SELECT b, a FROM p),
r AS (SELECT rep AS a, rep AS b FROM u UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
c AS (SELECT a AS rep, min(b) AS root FROM r GROUP BY a)
SELECT s.doc_id, len(s.g)::BIGINT AS n_shingles, coalesce(c.root, s.doc_id) AS component_id
FROM s LEFT JOIN u ON len(s.g) > 0 AND list_sort(s.g) = u.g LEFT JOIN c ON c.rep = u.rep
"""
