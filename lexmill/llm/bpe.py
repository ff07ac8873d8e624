"""Byte-level BPE encoding and decoding with a segment tree over byte positions.

A text is split by the tokenizer's pattern; each match is encoded by itself. Every byte of a match starts as a
token of its own, on a linked list of live neighbours. A segment tree over the byte positions stores, for each live
token, the rank of the pair it makes with its right neighbour; the root gives the leftmost pair of the lowest rank. A
merge unlinks the right token and updates three positions, each in logarithmic time, so that a match of n bytes
takes O(n log n), however long it is. The trees of short matches are worked on side by side, a row of numpy arrays
each; the ids of matches are kept in a table of bounded size per worker.

Defined results: a null text is empty and has no tokens; white space, control characters and any other text of valid
UTF-8 are encoded as they are; special tokens aren't looked for; decoding gives the text's bytes back; repeated
rows are encoded alike; an empty table gives no rows. Other columns pass through `encode`, whatever their names, but for those
that it returns.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import itertools

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import by_place, documents

#: Matches of at most KEEP bytes are merged side by side, ROWS at a time. Texts are taken in groups of about GROUP characters;
#: the table of matches is emptied when it would grow over TABLE.
KEEP, ROWS, GROUP, TABLE = 64, 4096, 1_000_000, 400_000
NO_PAIR = 1 << 60


@functools.lru_cache(maxsize=4)
def vocabulary(path: str) -> tuple[dict[bytes, int], list[bytes]]:
    """The ranks of a tiktoken file, and the bytes of each id."""
    with open(path, "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in file if line.strip())}
    pieces = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        pieces[rank] = token
    return ranks, pieces


class RankTree:
    """Segment tree of pair ranks; the root's minimum is the leftmost one of its value."""

    def __init__(self, ranks: list[int]):
        self.n = n = max(1, 1 << (len(ranks) - 1).bit_length())
        # A rank and its position are one number, so that the minimum is the leftmost pair of the lowest rank.
        self.tree = tree = [NO_PAIR] * (2 * n)
        for i, rank in enumerate(ranks):
            tree[n + i] = rank if rank == NO_PAIR else rank << 32 | i
        for i in range(n - 1, 0, -1):
            a, b = tree[2 * i], tree[2 * i + 1]
            tree[i] = a if a < b else b

    def least(self) -> int:
        """The position of the leftmost pair of the lowest rank, -1 where no pair has a rank."""
        return -1 if self.tree[1] >= NO_PAIR else self.tree[1] & 0xFFFFFFFF

    def put(self, i: int, rank: int) -> None:
        tree, i, value = self.tree, self.n + i, rank if rank == NO_PAIR else rank << 32 | i
        tree[i] = value
        while i > 1:
            a, b = tree[i & ~1], tree[i | 1]
            i >>= 1
            least = a if a < b else b
            if tree[i] == least:
                return
            tree[i] = least


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one match."""
    if piece in ranks:
        return [ranks[piece]]
    n = len(piece)
    tree = RankTree([ranks.get(piece[i : i + 2], NO_PAIR) for i in range(n - 1)] or [NO_PAIR])
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))  # live neighbours; a token at i ends where after[i] begins
    while (i := tree.least()) >= 0:
        gone = after[i]
        end = after[gone]
        after[i] = end
        if end < n:
            before[end] = i
            tree.put(i, ranks.get(piece[i : after[end]], NO_PAIR))
        else:
            tree.put(i, NO_PAIR)
        tree.put(gone, NO_PAIR) if gone < n - 1 else None
        if (left := before[i]) >= 0:
            tree.put(left, ranks.get(piece[left:end], NO_PAIR))
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i : after[i]]])
        i = after[i]
    return ids


class Pairs:
    """The rank of each pair of ids that makes a token, to look up many at a time."""

    def __init__(self, ranks: dict[bytes, int]):
        found = {}
        for token, rank in ranks.items():
            for at in range(1, len(token)):
                if (a := ranks.get(token[:at])) is not None and (b := ranks.get(token[at:])) is not None:
                    found[a << 32 | b] = rank
        self.keys = np.array(sorted(found), np.int64)
        self.ranks = np.array([found[k] for k in sorted(found)] or [0], np.int64)
        self.keys = self.keys if len(self.keys) else np.array([-1], np.int64)

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a << 32 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NO_PAIR)


def merge_many(pieces: list[bytes], pairs: Pairs, byte_ids: np.ndarray) -> list[tuple[int, ...]]:
    """The ids of each of many short matches: their segment trees, one a row, are worked on side by side."""
    count, length = len(pieces), np.array([len(p) for p in pieces])
    leaves = 1 << (int(length.max()) - 1).bit_length() if length.max() > 1 else 1
    raw = np.frombuffer(b"".join(p.ljust(leaves + 1, b"\0") for p in pieces), np.uint8).reshape(count, leaves + 1)
    ids, place = byte_ids[raw], np.arange(leaves + 1)
    inside = place < length[:, None]
    after, before = np.tile(place + 1, (count, 1)), np.tile(place - 1, (count, 1))

    def leaf(rank: np.ndarray, at: np.ndarray) -> np.ndarray:
        return np.where(rank == NO_PAIR, NO_PAIR, rank << 8 | at)

    tree = np.full((count, 2 * leaves), NO_PAIR, np.int64)
    tree[:, leaves:] = np.where(inside[:, 1:], leaf(pairs(ids[:, :-1], ids[:, 1:]), place[:-1]), NO_PAIR)
    for i in range(leaves - 1, 0, -1):
        np.minimum(tree[:, 2 * i], tree[:, 2 * i + 1], out=tree[:, i])

    def put(rows: np.ndarray, at: np.ndarray, value: np.ndarray) -> None:
        at = at + leaves
        tree[rows, at] = value
        for _ in range(leaves.bit_length() - 1):
            up = at >> 1
            tree[rows, up] = np.minimum(tree[rows, at], tree[rows, at ^ 1])
            at = up

    rows = np.arange(count)
    while len(rows := rows[tree[rows, 1] < NO_PAIR]):
        least = tree[rows, 1]
        i, n = least & 0xFF, length[rows]
        gone = after[rows, i]
        end = after[rows, gone]
        ids[rows, i] = least >> 8
        after[rows, i] = end
        before[rows, end] = i
        inside[rows, gone] = False
        put(rows, gone, np.full(len(rows), NO_PAIR))
        put(rows, i, np.where(end < n, leaf(pairs(ids[rows, i], ids[rows, end]), i), NO_PAIR))
        has = before[rows, i] >= 0
        r, left = rows[has], before[rows, i][has]
        put(r, left, leaf(pairs(ids[r, left], ids[r, i[has]]), left))
    flat, ends = ids[inside].tolist(), np.cumsum(inside.sum(axis=1)).tolist()
    return [tuple(flat[a:b]) for a, b in zip([0, *ends], ends)]


class Codec:
    """Encodes and decodes by the ranks in the file at `path`."""

    def __init__(self, path: str, pattern: str):
        self.ranks, self.pieces = vocabulary(path)
        self.pairs = Pairs(self.ranks)
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        self.split = regex.compile(pattern).findall
        self.kept: dict[str, tuple[int, ...]] = {}
        self.said: dict[str, str] = {}

    def learn(self, matches: set[str]) -> None:
        """Puts the ids of matches, and how they are written, into the table."""
        new = [m for m in matches if m not in self.kept]
        if len(self.kept) + len(new) > TABLE:
            self.kept.clear()
            self.said.clear()
            new = list(matches)
        by_size: dict[int, list[str]] = {}
        for m in new:
            raw = m.encode()
            if (rank := self.ranks.get(raw)) is not None:
                self.keep(m, (rank,))
            elif len(raw) <= KEEP:
                by_size.setdefault((len(raw) - 1).bit_length(), []).append(m)
            else:
                self.keep(m, tuple(merge(raw, self.ranks)))
        for own in by_size.values():
            for at in range(0, len(own), ROWS):
                some = own[at : at + ROWS]
                for m, ids in zip(some, merge_many([m.encode() for m in some], self.pairs, self.byte_ids)):
                    self.keep(m, ids)

    def keep(self, match: str, ids: tuple[int, ...]) -> None:
        self.kept[match], self.said[match] = ids, ",".join(map(str, ids))

    def encode(self, texts: list[str]):
        """For each text its ids and the same as decimal numbers joined by commas."""
        group, held = [], 0
        for text in texts:
            group.append(self.split(text))
            held += len(text)
            if held > GROUP:
                yield from self.ids_of(group)
                group, held = [], 0
        yield from self.ids_of(group)

    def ids_of(self, group: list[list[str]]):
        self.learn(set(itertools.chain.from_iterable(group)))
        kept, said = self.kept.__getitem__, self.said.__getitem__
        for matches in group:
            yield list(itertools.chain.from_iterable(map(kept, matches))), ",".join(map(said, matches))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.pieces.__getitem__, ids))


@functools.lru_cache(maxsize=4)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def encode(docs: DataFrame, path: str, pattern: str, what: str = "digests") -> DataFrame:
    """docs without text, with n_tokens and either ids (what="ids": array of int, and decoded text) or digests of both."""
    plain, names, back = by_place(docs, ("text",), ("text", "n_tokens", "ids", "decoded", "ids_sha256", "decoded_sha256"))
    rest = [plain.schema[n] for n in names if n != "text"]
    kinds = {"ids": [("ids", T.ArrayType(T.IntegerType())), ("decoded", T.StringType())], "digests": [("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType())]}[what]
    out = T.StructType([*rest, T.StructField("n_tokens", T.LongType()), *(T.StructField(n, t) for n, t in kinds)])

    def run(batches):
        own = codec(path, pattern)
        for batch in batches:
            counts, first, second = [], [], []
            for ids, said in own.encode([x or "" for x in batch.column("text").to_pylist()]):
                raw = own.decode(ids)
                counts.append(len(ids))
                if what == "ids":
                    first.append(ids)
                    second.append(raw.decode())
                else:
                    first.append(hashlib.sha256(said.encode()).hexdigest())
                    second.append(hashlib.sha256(raw).hexdigest())
            types = [pa.list_(pa.int32()), pa.string()] if what == "ids" else [pa.string(), pa.string()]
            columns = [batch.column(f.name) for f in rest] + [pa.array(counts, pa.int64()), pa.array(first, types[0]), pa.array(second, types[1])]
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in out.fields])

    return back(plain.select(*(f.name for f in rest), "text").mapInArrow(run, out))


def default_vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = default_vocabulary()
    return encode(documents(spark, sf_dir).select("doc_id", "text"), path, pattern)
