"""Document fingerprints by randomised edit embedding.

All texts walk by the same random bits: at step j the walk writes the character it stands on, and bit (j, character)
tells whether it goes on to the next one. Texts at a small edit distance so write sequences at a small Hamming
distance: an edit throws two walks out of step for a while, then they meet again. The fingerprint samples the written sequence:
at level k one step of every 2**k, chosen at random; the samples of a level are among those of the level below,
so that texts of different lengths are compared at the coarser of their levels. A text takes the
lowest level that gives it at most SAMPLES samples. Likeness is the share of samples that agree.

`near_duplicates` makes equal fingerprints one and bands the samples (bit sampling): documents of one band key are compared by
likeness, first with the smallest of the key, then, where a key still has members of different classes, all of these with each other. A pair
is passed over only if earlier links have put both in one class, or if it meets in no band. A band has DIGITS samples: unlike texts
agree in one of about ten, so that a key brings about n / 10**DIGITS unlike documents to each; for very large tables take more.

Defined results: a null text is empty; an empty text has the fingerprint "0:" and likeness 1 to another empty one, with which it is in one
class, 0 to any other; rows are in the order of doc_id, null last, then of a hash of the text; the last row is followed by the first, a
lone row by itself; repeated rows get equal fingerprints; texts are walked whole, however long; an empty table gives no rows; rows
without doc_id have no class. Only doc_id and text are looked at, and no other column of the input is returned.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, documents, join_unique, width
from .components import components

SAMPLES = 256
#: The bits of the walk repeat after PERIOD steps; characters are told apart by an 8-bit hash.
PERIOD = 4096
#: Texts are walked side by side, about GROUP characters at a time; fewer than FEW that are left are walked one by one.
GROUP, FEW = 4_000_000, 24
#: Least likeness of near duplicates, bands, samples of a band, members that are compared with each other in one task.
LEAST, BANDS, DIGITS, BLOCK = 0.6, 32, 9, 4096
LAST = 2**63 - 1


@functools.lru_cache(maxsize=1)
def dwell() -> np.ndarray:
    """For each step of the period and each character class: after how many steps the walk leaves the character."""
    bits = np.random.RandomState(424243).randint(0, 2, (PERIOD, 256), dtype=np.int8).astype(bool)
    bits[-1] = True
    out = np.ones((PERIOD, 256), np.int32)
    for j in range(PERIOD - 2, -1, -1):
        out[j] = np.where(bits[j], 1, out[j + 1] + 1)
    return out


@functools.lru_cache(maxsize=1)
def dwell_rows() -> list[list[int]]:
    return dwell().tolist()


def classes(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return ((points * np.uint32(2654435761)) >> np.uint32(24)).astype(np.uint8)


def walk(parts: list[np.ndarray], starts: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """For each part the step at which each character is reached, and the step after the last; starts: the first steps."""
    sizes = np.array([len(p) for p in parts], np.int64)
    order = np.argsort(-sizes, kind="stable")
    flat = np.concatenate([parts[i] for i in order]) if len(parts) else np.zeros(0, np.uint8)
    lengths = sizes[order]
    offsets = np.concatenate(([0], np.cumsum(lengths)))[:-1]
    at, table = np.zeros(len(flat), np.int64), dwell().ravel()
    j, i = starts[order].astype(np.int64), 0
    alive = len(order)
    while True:
        while alive and lengths[alive - 1] <= i:
            alive -= 1
        if alive < FEW:
            break
        here = offsets[:alive] + i
        at[here] = j[:alive]
        j[:alive] += table[(j[:alive] & (PERIOD - 1)) << 8 | flat[here]]
        i += 1
    rows, mask = dwell_rows(), PERIOD - 1
    for d in range(alive):
        step, found = int(j[d]), []
        for c in flat[offsets[d] + i : offsets[d] + lengths[d]].tobytes():
            found.append(step)
            step += rows[step & mask][c]
        at[offsets[d] + i : offsets[d] + lengths[d]] = found
        j[d] = step
    out, ends = [None] * len(parts), np.empty(len(parts), np.int64)
    for d, own in enumerate(order):
        out[own], ends[own] = at[offsets[d] : offsets[d] + lengths[d]], j[d]
    return out, ends


def descend(blocks: np.ndarray, high: int, low: int) -> np.ndarray:
    """The block of level `low` that stands for each block of level `high`."""
    for level in range(high, low, -1):
        x = blocks.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(level)
        x ^= x >> np.uint64(31)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        blocks = 2 * blocks + (x >> np.uint64(63)).astype(np.int64)
    return blocks


@functools.lru_cache(maxsize=64)
def sampled_steps(level: int) -> np.ndarray:
    return descend(np.arange(SAMPLES + 1, dtype=np.int64), level, 0)


HEX = np.frombuffer(b"0123456789abcdef", np.uint8)


def fingerprint(own: np.ndarray, at: np.ndarray, end: int) -> str:
    """level:digits, a hexadecimal digit for each sampled step."""
    level = max(0, (int(end) - 1).bit_length() - SAMPLES.bit_length() + 1)
    steps = sampled_steps(level)
    steps = steps[: np.searchsorted(steps, end)]
    place = np.searchsorted(at, steps, "right") - 1
    return f"{level}:" + HEX[own[place] >> 4].tobytes().decode()


@functools.lru_cache(maxsize=4096)
def coarser(high: int, low: int) -> np.ndarray:
    return descend(np.arange(SAMPLES + 1, dtype=np.int64), high, low)


def likeness(a: str, b: str) -> float:
    """The share of samples that agree, at the coarser level of the two."""
    if a == b:
        return 1.0
    (la, _, xa), (lb, _, xb) = a.partition(":"), b.partition(":")
    levels, digits = [int(la), int(lb)], [np.frombuffer(x.encode(), np.uint8) for x in (xa, xb)]
    top = max(levels)
    for i in (0, 1):
        if levels[i] < top:
            keep = coarser(top, levels[i])
            digits[i] = digits[i][keep[: np.searchsorted(keep, len(digits[i]))]]
    n = min(map(len, digits))
    most = max(map(len, digits))
    return float((digits[0][:n] == digits[1][:n]).sum() / most) if most else 0.0


def follow(rows: list[tuple]) -> list[tuple]:
    """rows: (doc_id, text), each followed by the next, the last a mere follower. For all but that one: the digest columns."""
    texts = [t for _, t in rows]
    own = [classes(t) for t in texts]
    at, ends = walk(own, np.zeros(len(own), np.int64))
    prints = [fingerprint(c, a, e) for c, a, e in zip(own, at, ends)]
    tails, starts, cuts = [], [], []
    for i in range(len(rows) - 1):
        n = len(own[i])
        cut = n - n // 4
        cuts.append(cut)
        tails.append(own[i + 1][: n // 4])
        starts.append(at[i][cut] if cut < n else ends[i])
    more, stops = walk(tails, np.array(starts, np.int64))
    out = []
    for i, cut in enumerate(cuts):
        n, next_text = len(own[i]), texts[i + 1]
        edited = texts[i][:cut] + next_text[: n // 4]
        new = fingerprint(np.concatenate((own[i][:cut], tails[i])), np.concatenate((at[i][:cut], more[i])), stops[i])
        digest = hashlib.sha256(edited.encode()).hexdigest()
        out.append((rows[i][0], n, digest, prints[i], new, likeness(prints[i], new), likeness(prints[i], prints[i + 1])))
    return out


DIGESTS = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("n_chars", T.LongType()), T.StructField("edited_sha256", T.StringType()), T.StructField("fingerprint", T.StringType()), T.StructField("edited_fingerprint", T.StringType()), T.StructField("near_edited", T.DoubleType()), T.StructField("near_next", T.DoubleType())]
)
DEALT = "bucket int, follower boolean, at long, mark long, doc_id long, packed binary"


def in_order(docs: DataFrame) -> DataFrame:
    """docs by ranges of doc_id, one a partition, each range with the first row of the next one as follower.

    Bounds are quantiles of doc_id; they, and the first doc_id of each range, are as many as partitions. Texts travel compressed.
    """
    n = width(docs.sparkSession)
    ids = docs.select(F.coalesce("doc_id", F.lit(LAST)).alias("at"))
    bounds = ids.agg(F.percentile_approx("at", [i / n for i in range(1, n)], max(10_000, 20 * n))).first()[0] if n > 1 else []
    bounds = np.unique(np.array(bounds or [], np.int64))

    def bucket_of(batches):
        for batch in batches:
            found = np.searchsorted(bounds, batch.column("at").to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), batch.column("at")], names=["bucket", "at"])

    firsts = ids.mapInArrow(bucket_of, "bucket int, at long").groupBy("bucket").agg(F.min("at").alias("at")).collect()
    firsts = sorted((r["bucket"], r["at"]) for r in firsts)
    before = {at: firsts[i - 1][0] for i, (_, at) in enumerate(firsts)}  # the range that a first row follows
    leads = np.array(sorted(before), np.int64)

    def deal(batches):
        for batch in batches:
            at = batch.column("at").to_numpy()
            found = np.searchsorted(bounds, at)
            again = np.flatnonzero(np.isin(at, leads))
            rows = np.concatenate((np.arange(len(at)), again))
            to = np.concatenate((found, np.array([before[int(x)] for x in at[again]], found.dtype)))
            more = np.arange(len(rows)) >= len(at)
            picked = batch.take(pa.array(rows)) if len(again) else batch
            pack = zstandard.ZstdCompressor(level=1).compress
            packed = pa.array([pack(t.encode()) for t in picked.column("text").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), pa.array(more), *(picked.column(c) for c in ("at", "mark", "doc_id")), packed], names=["bucket", "follower", "at", "mark", "doc_id", "packed"])

    text = F.coalesce("text", F.lit(""))
    dealt = docs.select(F.coalesce("doc_id", F.lit(LAST)).alias("at"), F.xxhash64(text).alias("mark"), "doc_id", text.alias("text")).mapInArrow(deal, DEALT)
    return dealt.repartitionById(len(bounds) + 1, F.col("bucket")).sortWithinPartitions("bucket", "follower", "at", "mark")


def fingerprints(docs: DataFrame) -> DataFrame:
    """DIGESTS of docs (doc_id, text)."""

    def run(batches):
        held, size, done, bucket, unpack = [], 0, False, None, zstandard.ZstdDecompressor().decompress
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("bucket", "follower", "doc_id", "packed"))
            for b, follower, doc_id, packed in zip(*columns):
                if b != bucket:
                    held, size, done, bucket = [], 0, False, b
                if done:
                    continue
                text = unpack(packed).decode()
                held.append((doc_id, text))
                size += len(text)
                done = follower
                if done or size > GROUP:
                    yield from emit(held)
                    held, size = held[-1:], len(text)

    def emit(rows):
        if len(rows) > 1:
            columns = zip(*follow(rows))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=DIGESTS.names)

    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    return in_order(docs.select("doc_id", "text")).mapInArrow(run, DIGESTS)


PRINTS = "doc_id long, fingerprint string"


def prints_of(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint of docs (doc_id, text), in no order: nothing is shuffled."""

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                held.append((doc_id, text))
                size += len(text)
                if size > GROUP:
                    yield emit(held)
                    held, size = [], 0
        if held:
            yield emit(held)

    def emit(rows):
        own = [classes(t) for _, t in rows]
        at, ends = walk(own, np.zeros(len(own), np.int64))
        return pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows], pa.int64()), pa.array([fingerprint(c, x, e) for c, x, e in zip(own, at, ends)], pa.string())], names=["doc_id", "fingerprint"])

    return docs.filter("doc_id IS NOT NULL").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, PRINTS)


def digits_of(fp: str) -> tuple[int, np.ndarray]:
    """The level and the digits as numbers."""
    level, _, text = fp.partition(":")
    found = np.frombuffer(text.encode(), np.uint8)
    return int(level), np.where(found > 57, found - 87, found - 48).astype(np.uint8)


def lifted(digits: np.ndarray, level: int, high: int) -> np.ndarray:
    """The digits that are left at level `high`."""
    if high == level:
        return digits
    keep = coarser(high, level)
    return digits[keep[: np.searchsorted(keep, len(digits))]]


class Bits:
    """Digit rows as four planes of 256 bits and a mask, to compare one with many; the likeness is that of `likeness`."""

    def __init__(self, rows: list[np.ndarray]):
        full = np.zeros((len(rows), SAMPLES), np.uint8)
        self.sizes = np.array([len(r) for r in rows], np.int64)
        for i, r in enumerate(rows):
            full[i, : len(r)] = r
        pack = lambda x: np.ascontiguousarray(np.packbits(x, axis=1)).view(np.uint64)
        self.planes = [pack(full >> p & 1) for p in range(4)]
        self.mask = pack(np.arange(SAMPLES)[None, :] < self.sizes[:, None])

    def like(self, i, j) -> np.ndarray:
        """Likeness of rows i and j (arrays of the same length, or i a lone row)."""
        off = self.planes[0][i] ^ self.planes[0][j]
        for p in self.planes[1:]:
            off |= p[i] ^ p[j]
        off &= self.mask[i] & self.mask[j]
        n, most = np.minimum(self.sizes[i], self.sizes[j]), np.maximum(self.sizes[i], self.sizes[j])
        return (n - np.bitwise_count(off).sum(axis=-1, dtype=np.int64)) / np.maximum(most, 1)


def group_links(high: int, prints: list[str], label: np.ndarray, side: np.ndarray | None, least: float) -> list[tuple[int, int]]:
    """Links between the places of a band key's fingerprints that make the classes of ALL its pairs of likeness `least`.

    A pair is passed over only where `label`, the classes so far, or links found here have put both in one class. side: where given, only
    pairs of different sides.
    """
    found = [digits_of(fp) for fp in prints]
    level = np.array([f[0] for f in found])
    own, up = Bits([f[1] for f in found]), Bits([lifted(d, v, high) for v, d in found])
    label, out = label.copy(), []
    for i in range(len(prints) - 1):
        left = label[i + 1 :] != label[i]
        if side is not None:
            left &= side[i + 1 :] != side[i]
        j = np.flatnonzero(left) + i + 1
        if not len(j):
            continue
        likes = up.like(i, j)
        if level[i] < high:  # two of the level below are compared at their own
            low = level[j] < high
            likes[low] = own.like(i, j[low])
        good = j[likes >= least]
        if len(good):
            joined, first = np.unique(label[good], return_index=True)
            out += [(i, int(good[k])) for k in first]
            label[np.isin(label, joined)] = label[i]
    return out


def band_places(least: float, bands: int, digits: int) -> np.ndarray:
    """The places of each band's samples: among those that all texts have but the very short ones, also at the next level."""
    top = max(digits, int(least * (SAMPLES // 2)) - 2)
    return np.sort(np.stack([np.random.RandomState(k).choice(top, digits, replace=False) for k in range(bands)]), axis=1)


def band_rows(reps: DataFrame, least: float, bands: int, digits: int) -> DataFrame:
    """key, rep and head, the smallest of the key, of all band keys that several of reps (doc_id, fingerprint, all unlike) have.

    A text has keys at its own level; at the next one only if it can be like a text of that level, which is longer: if it has
    `least` of the most samples. Keys travel as packed numbers, by parts of the key space.
    """
    picks = band_places(least, bands, digits)
    shifts, parts = np.arange(digits, dtype=np.int64) * 4, width(reps.sparkSession)

    def band(batches):
        for batch in batches:
            ids, keys = [], []
            for doc_id, fp in zip(batch.column("doc_id").to_pylist(), batch.column("fingerprint").to_pylist()):
                level, mine = digits_of(fp)
                for high in (level, level + 1):
                    seen = lifted(mine, level, high)
                    if not len(seen) or (high > level and len(seen) < least * (SAMPLES // 2 - 1)):
                        continue
                    there = picks < len(seen)
                    value = (np.where(there, seen[np.minimum(picks, len(seen) - 1)], 0).astype(np.int64) << shifts).sum(axis=1)
                    n = there.sum(axis=1)
                    own = (((high * bands + np.arange(bands)) * (digits + 1) + n) << (4 * digits)) | value
                    keys.append(own[n > 0])
                    ids.append(np.full(len(keys[-1]), doc_id, np.int64))
            if not ids:
                continue
            key, rep = np.concatenate(keys), np.concatenate(ids)
            mixed = key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            part = ((mixed >> np.uint64(33)) % np.uint64(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            cuts = np.searchsorted(part[order], np.arange(parts + 1))
            some = [p for p in range(parts) if cuts[p] < cuts[p + 1]]
            columns = [[x[order[cuts[p] : cuts[p + 1]]].tobytes() for p in some] for x in (key, rep)]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), *(pa.array(c, pa.binary()) for c in columns)], names=["part", "key", "rep"])

    def several(table: pa.Table) -> pa.Table:
        key, rep = (np.concatenate([np.frombuffer(v.as_py(), np.int64) for v in table.column(c)]) for c in ("key", "rep"))
        order = np.lexsort((rep, key))
        key, rep = key[order], rep[order]
        new = np.concatenate(([True], key[1:] != key[:-1]))
        begins = np.flatnonzero(new)
        sizes = np.diff(np.append(begins, len(key)))
        head, keep = np.repeat(rep[begins], sizes), np.repeat(sizes > 1, sizes)
        return pa.table([pa.array(x[keep]) for x in (key, rep, head)], names=["key", "rep", "head"])

    return reps.mapInArrow(band, "part int, key binary, rep binary").groupBy("part").applyInArrow(several, "key long, rep long, head long")


def head_links(keyed: DataFrame, reps: DataFrame, least: float, block: int) -> DataFrame:
    """a, b: members of a key and its smallest one, where these are alike. A head of many members is compared in several tasks."""
    pairs = cut(keyed.select("rep", "head").filter("rep <> head").distinct(), "head_pairs")
    sizes = cut(pairs.groupBy("head").agg(F.count(F.lit(1)).alias("n")).withColumn("chunks", F.ceil(F.col("n") / block).cast("int")), "head_sizes")
    dealt = join_unique(pairs, sizes, ["head"], "n", pairs.count(), F.col("rep"))
    members = dealt.select("head", F.pmod(F.xxhash64("rep"), F.col("chunks")).cast("int").alias("chunk"), F.lit(1).alias("role"), "rep")
    heads = sizes.select("head", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.lit(0).alias("role"), F.col("head").alias("rep"))
    rows = heads.union(members).join(reps.select(F.col("doc_id").alias("rep"), "fingerprint"), "rep")
    rows = rows.repartition(width(reps.sparkSession), "head", "chunk").sortWithinPartitions("head", "chunk", "role")

    def run(batches):
        mark, first = None, None
        for batch in batches:
            out = []
            for head, chunk, role, rep, fp in zip(*(batch.column(c).to_pylist() for c in ("head", "chunk", "role", "rep", "fingerprint"))):
                if (head, chunk) != mark:
                    mark, first = (head, chunk), []
                if role == 0:  # a doc_id of several rows has several fingerprints
                    first.append(fp)
                elif any(likeness(fp, x) >= least for x in first):
                    out.append((rep, head))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return rows.select("head", "chunk", "role", "rep", "fingerprint").mapInArrow(run, "a long, b long")


def rest_links(keyed: DataFrame, reps: DataFrame, roots: DataFrame, least: float, digits: int, bands: int, block: int) -> DataFrame:
    """a, b: links that make the same classes as all pairs that share a key, beside those that `roots` (id, root) have."""
    own = keyed.select("key", "rep").join(roots.select(F.col("id").alias("rep"), "root"), "rep", "left").select("key", "rep", F.coalesce("root", "rep").alias("root"))
    own = cut(own, "band_classes")
    mixed = own.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi")
    mixed = cut(mixed.select("key", "n", F.ceil(F.col("n") / block).cast("int").alias("blocks")), "mixed_keys")
    met = join_unique(own, mixed, ["key"], "n", own.count(), F.col("rep")).filter("blocks IS NOT NULL")
    # A key of more than `block` members is cut into blocks; each two blocks meet, and each block meets itself.
    met = met.join(reps.select(F.col("doc_id").alias("rep"), "fingerprint"), "rep").withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select("key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "rep", "root", "fingerprint")
    # Dealt by key and both blocks, so that a key of many members fills many tasks.
    dealt = met.repartition(width(reps.sparkSession), "key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "rep")

    def verify(batches):
        mark, held = None, []
        for batch in batches:
            for key, lo, hi, own, rep, root, fp in zip(*(batch.column(c).to_pylist() for c in ("key", "lo", "hi", "own", "rep", "root", "fingerprint"))):
                if (key, lo, hi) != mark:
                    yield from emit(mark, held)
                    mark, held = (key, lo, hi), []
                held.append((own, rep, root, fp))
        yield from emit(mark, held)

    def emit(mark, held):
        if len(held) < 2:
            return
        high = (mark[0] >> (4 * digits)) // ((digits + 1) * bands)
        held = [h for h in held if int(h[3].partition(":")[0]) in (high - 1, high)]  # a doc_id of several rows brings other texts too
        if len(held) < 2 or len({h[2] for h in held}) < 2:
            return
        side = None if mark[1] == mark[2] else np.array([h[0] for h in held])
        found = group_links(high, [h[3] for h in held], np.unique([h[2] for h in held], return_inverse=True)[1], side, least)
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([held[x[k]][1] for x in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return dealt.select("key", "lo", "hi", "own", "rep", "root", "fingerprint").mapInArrow(verify, "a long, b long")


def near_roots(prints: DataFrame, least: float = LEAST, bands: int = BANDS, digits: int = DIGITS, block: int = BLOCK) -> DataFrame:
    """id and root of the documents of prints (doc_id, fingerprint) that have a link: equal fingerprints are one, others meet in bands."""
    prints = cut(prints, "prints", codec="zstd")
    reps = cut(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("doc_id")), "reps", codec="zstd")
    copies = cut(prints.join(reps.select("fingerprint", F.col("doc_id").alias("b")), "fingerprint").select(F.col("doc_id").alias("a"), "b").filter("a <> b"), "copies")
    keyed = cut(band_rows(reps, least, bands, digits), "band_rows")
    easy = cut(head_links(keyed, reps, least, block), "head_links")
    more = rest_links(keyed, reps, components(easy), least, digits, bands, block)
    return components(copies.union(easy).union(more))


def with_classes(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """rows with class_id; a row without doc_id has none."""
    return rows.join(roots, F.col("doc_id") == F.col("id"), "left").withColumn("class_id", F.coalesce("root", "doc_id")).drop("id", "root")


def near_duplicates(docs: DataFrame, least: float = LEAST, bands: int = BANDS, digits: int = DIGITS, block: int = BLOCK) -> DataFrame:
    """doc_id and class_id (the smallest doc_id of its class), of classes that links of likeness `least` make.

    Bands of `digits` sampled digits, at a text's own level and, where that can matter, the next, are the keys; of documents that share a key
    all pairs are compared, but for those that are in one class already. Equal fingerprints always are in one class.
    """
    prints = prints_of(docs)
    return with_classes(prints.select("doc_id"), near_roots(prints, least, bands, digits, block))


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return with_classes(fingerprints(docs), near_roots(prints_of(docs)))
