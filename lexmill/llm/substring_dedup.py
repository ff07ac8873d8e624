"""Substring dedup: count-min prefilter, then exact grouping of the windows that it estimates as repeated.

Documents are dealt into blocks of some megabytes. A block sends the cell number of each of its different windows to the task
that holds this part of the sketch; there the blocks' partial sketches are merged, and each block hears back which of its cells
at least two blocks have. Equal windows have equal cells, so the estimate is never too low and no repeated window is lost.
The windows whose cells are shared are grouped exactly, by 96 bits of hash over 64-bit hashes of words, and a block hears
back which of its windows start earlier elsewhere. Repeats inside a block need neither message. The sketch has no part that
is broadcast or gathered: with the input its number of parts grows, and a task holds one part (64 MB at most) and one message a block.
Since cell numbers travel in order, as differences, one row of many cells costs less than several rows of fewer for the same
false alarms; `depth` sets the number of rows.

Hot windows: a block sends a window once, however often it has it. Equal rows of one input partition share a block.

Defined results: words are runs other than [\\x20\\x09-\\x0D], null texts have none; a window is removed if the same words start
at a smaller (doc_id, start), so rows that share a doc_id count as one document, and windows that start at one place of one
doc_id in several rows are kept in all of them; null doc_ids come last, as one document with the doc_id 2**63 - 1; texts
are taken whole; an empty table gives no rows. Columns pass through, whatever their names, but for those that the operator returns.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkernel as K
from .common import by_place, documents, width

LAST = 2**63 - 1
#: Bytes of text in a block, cells of the sketch for a byte of text, and the largest part of the sketch.
BLOCK, CELLS, PART = 8_000_000, 3, 1 << 26
SEEDS = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9), np.uint64(0x27D4EB2F165667C5)]


def packed(numbers: np.ndarray) -> bytes:
    """Ascending numbers as differences, in the least width that holds them, which the first byte names."""
    steps = np.diff(numbers, prepend=np.uint64(0)).astype(np.uint64)
    size = next(s for s in (1, 2, 4, 8) if s == 8 or int(steps.max(initial=0)) < 1 << 8 * s)
    return bytes([size]) + steps.astype(f"<u{size}").tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(raw, f"<u{raw[0]}", offset=1).astype(np.uint64), dtype=np.uint64)


class Windows:
    """The windows of a block: hash, first word, doc_id and start of each; words of text i are cuts[i] to cuts[i + 1]."""

    def __init__(self, texts: pa.ChunkedArray, ids: np.ndarray, n: int):
        texts = pa.concat_arrays(texts.chunks) if texts.num_chunks else pa.array([], pa.string())
        hashes, cuts = [np.zeros(0, np.uint64)], [np.zeros(1, np.int64)]
        for part in K.slices(texts):
            found = K.words(part)
            cuts.append(found.cuts[1:] + cuts[-1][-1])
            hashes.append(found.hashes)
        self.n, self.words, self.cuts = n, np.concatenate(hashes), np.concatenate(cuts)
        up, down = K.powers(len(self.words) + 1)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.words * up[:-1], dtype=np.uint64)])
        counts = np.diff(self.cuts)
        self.at = np.flatnonzero(np.arange(len(self.words)) + n <= np.repeat(self.cuts[1:], counts))
        self.hash = K.mixed((sums[self.at + n] - sums[self.at]) * down[self.at])
        row = np.repeat(np.arange(len(counts)), counts)[self.at]
        self.id, self.start = ids[row], self.at - self.cuts[row]

    def second(self, chosen: np.ndarray) -> np.ndarray:
        """32 more bits for the chosen windows, by other factors than the hash's."""
        out = np.zeros(len(chosen), np.uint64)
        for k in range(self.n):
            out = (out + self.words[self.at[chosen] + k]) * K.BYTE[k % 256]
        return (K.mixed(out) >> np.uint64(32)).astype(np.uint32)

    def in_order(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The chosen windows by hash, doc_id and start, and which of them are the first of their hash."""
        chosen = chosen[np.lexsort((self.start[chosen], self.id[chosen], self.hash[chosen]))]
        new = np.ones(len(chosen), bool)
        new[1:] = self.hash[chosen[1:]] != self.hash[chosen[:-1]]
        return chosen, new


def cells_of(hashes: np.ndarray, row: int, bits: int) -> np.ndarray:
    return K.mixed(hashes ^ SEEDS[row]) >> np.uint64(64 - bits)


def among(values: np.ndarray, ascending: np.ndarray) -> np.ndarray:
    at = np.searchsorted(ascending, values)
    return (at < len(ascending)) & (ascending[np.minimum(at, len(ascending) - 1)] == values) if len(ascending) else np.zeros(len(values), bool)


def dealt(keys: np.ndarray, parts: int) -> list[tuple[int, int, int]]:
    """(part, from, to) of ascending keys."""
    cuts = np.searchsorted(keys, np.arange(parts + 1))
    return [(int(p), int(cuts[p]), int(cuts[p + 1])) for p in np.flatnonzero(np.diff(cuts))]


MESSAGE = "block long, part int, body binary"
ENTRY = [("hash", "<u8"), ("more", "<u4"), ("id", "<i8"), ("start", "<u4")]


def table(block: list[int], part: list[int], body: list[bytes]) -> pa.Table:
    return pa.table({"block": pa.array(block, pa.int64()), "part": pa.array(part, pa.int32()), "body": pa.array(body, pa.binary())})


def shared_cells(blocks: DataFrame, n: int, bits: int, parts: int, depth: int) -> DataFrame:
    """block, part, body: the cells of a block that another block has, too."""
    span = -(-(1 << bits) // parts)

    def send(docs: pa.Table) -> pa.Table:
        hashes, out = np.unique(Windows(docs["__t"], docs["__id"].to_numpy(), n).hash), ([], [], [])
        for row in range(depth):
            cells = np.unique(cells_of(hashes, row, bits))
            for p, lo, hi in dealt(cells // np.uint64(span), parts):
                for column, value in zip(out, (docs["__block"][0].as_py(), row * parts + p, packed(cells[lo:hi] - np.uint64(p * span)))):
                    column.append(value)
        return table(*out)

    def merge(messages: pa.Table) -> pa.Table:
        seen, own = np.zeros(span, np.uint8), messages["body"].to_pylist()
        for body in own:
            cells = unpacked(body).astype(np.int64)
            seen[cells] = np.minimum(seen[cells] + 1, 2)
        shared = [(c := unpacked(body))[seen[c.astype(np.int64)] > 1] for body in own]
        keep = [i for i, c in enumerate(shared) if len(c)]
        blocks, part = messages["block"].to_pylist(), messages["part"].to_pylist()
        return table([blocks[i] for i in keep], [part[i] for i in keep], [packed(shared[i]) for i in keep])

    return blocks.groupBy("__block").applyInArrow(send, MESSAGE).groupBy("part").applyInArrow(merge, MESSAGE)


def held_elsewhere(blocks: DataFrame, shared: DataFrame, n: int, bits: int, parts: int, depth: int) -> DataFrame:
    """block, part, body: hashes of a block's windows that start earlier in another block."""
    span, groups = -(-(1 << bits) // parts), 4 * parts

    def send(docs: pa.Table, replies: pa.Table) -> pa.Table:
        if not len(docs) or not len(replies):
            return table([], [], [])
        found = Windows(docs["__t"], docs["__id"].to_numpy(), n)
        held = np.ones(len(found.hash), bool)
        for row in range(depth):
            own = sorted((p - row * parts, b) for p, b in zip(replies["part"].to_pylist(), replies["body"].to_pylist()) if p // parts == row)
            cells = np.concatenate([np.zeros(0, np.uint64), *(unpacked(b) + np.uint64(p * span) for p, b in own)])
            held &= among(cells_of(found.hash, row, bits), cells)
        chosen, new = found.in_order(np.flatnonzero(held))
        first = chosen[new]
        entries = np.empty(len(first), ENTRY)
        entries["hash"], entries["more"], entries["id"], entries["start"] = found.hash[first], found.second(first), found.id[first], found.start[first]
        group = (entries["hash"] % np.uint64(groups)).astype(np.int64)
        order = np.argsort(group, kind="stable")
        cuts = dealt(group[order], groups)
        return table([docs["__block"][0].as_py()] * len(cuts), [p for p, _, _ in cuts], [columns(entries[order[lo:hi]]) for _, lo, hi in cuts])

    def settle(messages: pa.Table) -> pa.Table:
        own = [entries_of(b) for b in messages["body"].to_pylist()]
        block = np.repeat(messages["block"].to_numpy(), [len(e) for e in own])
        e = np.concatenate(own)
        order = np.lexsort((e["start"], e["id"], e["more"], e["hash"]))
        e, block = e[order], block[order]
        new = np.ones(len(e), bool)
        new[1:] = (e["hash"][1:] != e["hash"][:-1]) | (e["more"][1:] != e["more"][:-1])
        first = np.maximum.accumulate(np.where(new, np.arange(len(e)), 0))
        later = np.flatnonzero((e["id"] != e["id"][first]) | (e["start"] != e["start"][first]))
        later = later[np.argsort(block[later], kind="stable")]
        names, starts = np.unique(block[later], return_index=True)
        ends = [*starts[1:], len(later)]
        return table(names.tolist(), [0] * len(names), [packed(np.sort(e["hash"][later[lo:hi]])) for lo, hi in zip(starts, ends)])

    asked = blocks.groupBy("__block").cogroup(shared.groupBy("block")).applyInArrow(send, MESSAGE)
    return asked.groupBy("part").applyInArrow(settle, MESSAGE)


def columns(entries: np.ndarray) -> bytes:
    """Entries by column, ids and starts in the least width: they compress, and most need few bytes."""
    small = len(entries) and entries["id"].min() >= 0 and entries["id"].max() < 1 << 32
    short = len(entries) and entries["start"].max() < 1 << 16
    parts = (entries["hash"], entries["more"], entries["id"].astype("<u4") if small else entries["id"], entries["start"].astype("<u2") if short else entries["start"])
    return bytes([int(small), int(short)]) + len(entries).to_bytes(8, "little") + b"".join(p.tobytes() for p in parts)


def entries_of(raw: bytes) -> np.ndarray:
    at, out = 10, np.empty(int.from_bytes(raw[2:10], "little"), ENTRY)
    for name, kind in (("hash", "<u8"), ("more", "<u4"), ("id", "<u4" if raw[0] else "<i8"), ("start", "<u2" if raw[1] else "<u4")):
        out[name] = np.frombuffer(raw, kind, len(out), at)
        at += len(out) * np.dtype(kind).itemsize
    return out


def remove_repeats(docs: DataFrame, n: int = 20, depth: int = 1, block: int = BLOCK) -> DataFrame:
    """docs with `text` as its kept words, joined by one space, and n_words (before) and n_removed."""
    made = ("text", "n_words", "n_removed")
    plain, rest, back = by_place(docs, ("doc_id", "text"), made)
    rest = [c for c in rest if c != "text"]
    size = plain.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(16, (CELLS * size).bit_length())
    parts = max(width(docs.sparkSession), (1 << bits) // PART)
    place = F.pmod(F.xxhash64("doc_id", "text", F.spark_partition_id()), F.lit(size // block + 1))
    blocks = plain.select(*rest, F.coalesce("doc_id", F.lit(LAST)).alias("__id"), F.coalesce("text", F.lit("")).alias("__t"), place.alias("__block"))
    shared = shared_cells(blocks, n, bits, parts, depth)
    gone = held_elsewhere(blocks, shared, n, bits, parts, depth)
    types = [plain.schema[c] for c in rest]
    out = T.StructType([*types, T.StructField("text", T.StringType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType())])

    def drop(own: pa.Table, replies: pa.Table) -> pa.Table:
        found = Windows(own["__t"], own["__id"].to_numpy(), n)
        elsewhere = np.sort(np.concatenate([np.zeros(0, np.uint64), *(unpacked(b) for b in replies["body"].to_pylist())]))
        again = among(found.hash, elsewhere)
        chosen, new = found.in_order(np.flatnonzero(~again))
        first = np.maximum.accumulate(np.where(new, np.arange(len(chosen)), 0))
        again[chosen[(found.id[chosen] != found.id[chosen[first]]) | (found.start[chosen] != found.start[chosen[first]])]] = True
        cover = np.zeros(len(found.words) + 1, np.int64)
        np.add.at(cover, found.at[again], 1)
        np.add.at(cover, found.at[again] + n, -1)
        covered = np.cumsum(cover)[:-1] > 0
        texts, lost = [], []
        for i, text in enumerate(own["__t"]):
            own_words, mask = text.as_py().encode().split(), covered[found.cuts[i] : found.cuts[i + 1]]
            lost.append(int(mask.sum()))
            texts.append(b" ".join([w for w, m in zip(own_words, mask.tolist()) if not m] if lost[-1] else own_words).decode())
        kept = own.select(rest) if rest else own.select([])
        kept = kept.append_column("text", pa.array(texts, pa.string())).append_column("n_words", pa.array(np.diff(found.cuts), pa.int64()))
        return kept.append_column("n_removed", pa.array(lost, pa.int64()))

    return back(blocks.groupBy("__block").cogroup(gone.groupBy("block")).applyInArrow(drop, out))


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return remove_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2(F.col("text"), 256).alias("kept_sha256"))


OP13_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(doc_id, 9223372036854775807) AS id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
p AS (SELECT r, id, ws, unnest(range(1, len(ws) - 18)) AS s FROM d WHERE len(ws) >= 20),
w AS (SELECT r, id, s, md5(array_to_string(ws[s:s + 19], ' ')) AS h FROM p),
f AS (SELECT h, min((id, s)) AS first FROM w GROUP BY h HAVING count(*) > 1),
g AS (SELECT DISTINCT r, unnest(range(s, s + 20)) AS pos FROM w JOIN f ON w.h = f.h WHERE (id, s) <> first),
l AS (SELECT r, list(pos) AS gone FROM g GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
       sha256(array_to_string(CASE WHEN gone IS NULL THEN ws ELSE list_transform(list_filter(list_zip(ws, range(1, len(ws) + 1)), lambda x: NOT list_contains(gone, x[2])), lambda x: x[1]) END, ' ')) AS kept_sha256
FROM d LEFT JOIN l USING (r)
"""
