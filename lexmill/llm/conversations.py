"""Conversation structure repair by a dynamic program over the turns that stay.

A turn that stays is kept or given another role; the turns between two that stay are deleted, which a prefix sum of deletion costs prices, and
the roles of the two say which turns must be inserted between them. For each role that the last staying turn may have (or none yet), a running
minimum holds the least price so far less the prefix sum; a turn extends each of the four by what its role asks for. Ties go to the
ASCII-least audit: deletions stand before insertions in a gap, and since two audits over the same turns never are a prefix of each
other, an order of the four running audits, renewed at each turn, decides all ties without any string.

The program is a product of small tables, so a conversation is cut into pieces of at most PIECE different rows: each piece gives, for each
of the four states before it, the prices, order and states after it; a conversation's pieces are joined in sequence, and only then is each piece's
audit made out. Rows travel sorted by ranges, so a conversation with a third of all rows fills many tasks; equal rows are one row
with a count. What comes last, the text's SHA-256, is a chain over the whole conversation by its definition: its rows go through one
task in order, none held longer than its turn. The audit itself is one string with a letter for each turn.

Defined results: nulls in conv_id, turn, role and text count as one space where they are spelled out; a null conv_id is a conversation of its
own; null turns come first; rows of one turn are ordered by role and text (code points' bytes); equal rows stand side by side and all but the first are
duplicates; a role's initial is its first character, and one that is empty or other than s, u, a can't be kept; empty texts are blank;
conversations of which damage leaves nothing have a row, an empty table has none. Other columns aren't looked at.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BLANKS, cut, join_unique, width

#: Different rows of a piece.
PIECE = 1024
#: What may stand last: nothing yet, a system, a user, an assistant turn.
STATES = "-sua"
NAMES = {"u": "user", "a": "assistant"}
DELETE, RENAME, INSERT = 3, 2, 2


def gap(before: str, after: str) -> int | None:
    """How many turns must be inserted between these; None if no insertion helps."""
    if after == "s":
        return 0 if before == "-" else None
    return int((before == "u") == (after == "u"))


#: Insertions after the last turn.
CLOSING = {"-": 0, "s": 2, "u": 1, "a": 0}


@functools.lru_cache(maxsize=1 << 16)
def step(state: tuple, turn: str) -> tuple:
    """(state, base, back) after a turn: prices of the four less their least one, which is base, with the order of audits; where each came from and by what.

    turn: its role's initial (o: any other), in upper case if it is truncated; b: blank or a duplicate, which can't stay.
    """
    prices, order = state
    options: list[list[tuple]] = [[] for _ in STATES]
    for x, price in enumerate(prices):
        if price is None:
            continue
        options[x].append((price, order[x], "D", x))
        if turn == "b":
            continue
        truncated = int(turn.isupper())
        for y, after in enumerate(STATES):
            for letter, cost in (("K", 0), ("R", RENAME)):
                fits = after == turn.lower() if letter == "K" else after in "ua"
                if after != "-" and fits and (n := gap(STATES[x], after)) is not None:
                    options[y].append((price + cost + INSERT * n + truncated - DELETE, order[x], "I" * n + letter, x))
    chosen = [min(o) if o else None for o in options]
    rank = {c: i for i, c in enumerate(sorted((c[1], c[2]) for c in chosen if c))}
    base = min(c[0] for c in chosen if c)
    prices = tuple(c[0] - base if c else None for c in chosen)
    return (prices, tuple(rank[c[1], c[2]] if c else 0 for c in chosen)), base, tuple((c[3], c[2]) if c else None for c in chosen)


def start(x: int) -> tuple:
    return tuple(0 if i == x else None for i in range(4)), (0,) * 4


def summary(turns: str) -> list[list[tuple[int, int] | None]]:
    """For each state before the piece and each after it: the price less deletions of all, and the audit's place among those from the same state."""
    out = []
    for x in range(4):
        state, total = start(x), 0
        for turn in turns:
            state, base, _ = step(state, turn)
            total += base
        out.append([None if p is None else (p + total, r) for p, r in zip(*state)])
    return out


def audit(turns: str, before: int, after: int) -> list[str]:
    """What is done at each turn, insertions before it first, on the best way from one state to the other."""
    state, backs = start(before), []
    for turn in turns:
        state, _, back = step(state, turn)
        backs.append(back)
    out = []
    for back in reversed(backs):
        after, letters = back[after]
        out.append(letters)
    return out[::-1]


def plan(pieces: list[str]) -> list[tuple[int, int]]:
    """The states before and after each piece on the cheapest way, ASCII-least among those."""
    prices, order, backs = [0, None, None, None], [0] * 4, []
    for turns in pieces:
        table, chosen = summary(turns), [None] * 4
        for y in range(4):
            ways = [(prices[x] + table[x][y][0], order[x], table[x][y][1], x) for x in range(4) if prices[x] is not None and table[x][y]]
            chosen[y] = min(ways) if ways else None
        rank = {c: i for i, c in enumerate(sorted(c[1:3] for c in chosen if c))}
        prices, order = [c[0] if c else None for c in chosen], [rank[c[1:3]] if c else 0 for c in chosen]
        backs.append([c[3] if c else None for c in chosen])
    last = min((prices[x] + INSERT * CLOSING[STATES[x]], order[x], x) for x in range(4) if prices[x] is not None)[2]
    out = []
    for back in reversed(backs):
        out.append((back[last], last))
        last = back[last]
    return out[::-1]


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, n: rows after damage, equal ones as one with their number."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")) % 20
    rows = rows.select("conv_id", "turn", said("role").alias("role"), said("text").alias("text"), fate.alias("fate")).filter("fate <> 0")
    text = F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("fate") == 4, "user").otherwise(F.col("role"))
    n = F.when(F.col("fate") == 3, 2).otherwise(1).cast("long")
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), n.alias("n")).groupBy("conv_id", "turn", "role", "text").agg(F.sum("n").alias("n"))


def kinds(turns: DataFrame) -> DataFrame:
    """part, place, kind: the letter that `step` takes, or b, or d for what was seen in an earlier turn."""
    pair = [F.xxhash64(F.lit(i), F.col("conv_id").isNull(), "conv_id", "role", "text") for i in range(2)]
    now = F.struct(F.col("turn").isNotNull().alias("there"), F.col("turn").alias("turn"))
    light = turns.select("part", "place", "conv_id", "init", "blank", "truncated", "n", now.alias("now"), pair[0].alias("h0"), pair[1].alias("h1"))
    again = light.groupBy("h0", "h1").agg(F.min("now").alias("first"), F.count(F.lit(1)).alias("rows")).filter("rows > 1")
    light = join_unique(light, again, ["h0", "h1"], "rows", turns.count(), F.struct("part", "place"))
    letter = F.when(F.col("init").isin("s", "u", "a"), F.col("init")).otherwise("o")
    kind = F.when(F.col("blank"), "b").when(F.col("first").isNotNull() & (F.col("now") > F.col("first")), "d").when(F.col("truncated"), F.upper(letter)).otherwise(letter)
    return light.select("part", "place", "conv_id", kind.alias("kind"))


ROW = "part int, piece long, place long, turn long, role string, text string, n long, pieces string"


def repair(rows: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of each conversation (conv_id, turn, role, text)."""
    spark = rows.sparkSession
    key = rows.schema["conv_id"].dataType
    rows = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    solid = F.rtrim(F.col("text"), F.lit(BLANKS))
    turns = damaged(rows).select("*", F.substring("role", 1, 1).alias("init"), (solid == "").alias("blank"), (~F.substring(solid, -1, 1).isin(".", "!", "?")).alias("truncated"))
    turns = turns.repartitionByRange(width(spark), *order).sortWithinPartitions(*order)
    at = F.monotonically_increasing_id()
    turns = cut(turns.select("*", F.shiftright(at, 33).cast("int").alias("part"), at.bitwiseAND(F.lit((1 << 33) - 1)).alias("place")), "turns")
    piece = F.floor(F.col("place") / PIECE)
    pieces = kinds(turns).groupBy("conv_id", "part", piece.alias("piece")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "kind"))), lambda x: x["kind"]), "").alias("kinds"))
    whole = pieces.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("part", "piece", "kinds"))).alias("all"))

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            convs, rows = batch["conv_id"], batch["all"].to_pylist()
            own, out = [], {"part": [], "piece": [], "pieces": []}
            for i, all_of in enumerate(rows):
                letters = [p["kinds"].replace("d", "b") for p in all_of]
                for p, turns, (before, after) in zip(all_of, letters, plan(letters)):
                    own.append(i)
                    out["part"].append(p["part"])
                    out["piece"].append(p["piece"])
                    out["pieces"].append(" ".join(k + done for k, done in zip(p["kinds"], audit(turns, before, after))))
            columns = [convs.take(pa.array(own, pa.int64())), pa.array(out["part"], pa.int32()), pa.array(out["piece"], pa.int64()), pa.array(out["pieces"], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["conv_id", "part", "piece", "pieces"])

    planned = whole.mapInArrow(decide, T.StructType([T.StructField("conv_id", key), *T._parse_datatype_string("part int, piece long, pieces string").fields]))
    null = lambda c, kind: F.lit(None).cast(kind).alias(c)
    empty = [null(c, k) for c, k in (("turn", "long"), ("role", "string"), ("text", "string"), ("n", "long"))]
    marks = rows.select("conv_id").distinct().select("conv_id", F.lit(-1).alias("part"), F.lit(-1).cast("long").alias("piece"), F.lit(-1).cast("long").alias("place"), *empty, null("pieces", "string"))
    planned = planned.select("conv_id", "part", "piece", F.lit(-1).cast("long").alias("place"), *empty, "pieces")
    texts = turns.select("conv_id", "part", piece.alias("piece"), "place", "turn", "role", "text", "n", null("pieces", "string"))
    stream = marks.unionByName(planned).unionByName(texts).repartition(width(spark), "conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), "part", "piece", "place")
    out = T.StructType([T.StructField("conv_id", key), *T._parse_datatype_string("gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string").fields])

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        for batch in batches:
            done, own = [], []
            convs = batch["conv_id"]
            rest = zip(*(batch[c].to_pylist() for c in ("place", "turn", "role", "text", "n", "pieces", "part")))
            for i, (place, turn, role, text, n, pieces, part) in enumerate(rest):
                if part < 0:
                    if now:
                        done.append(now.end())
                    now = Repaired(convs.slice(i, 1))
                elif place < 0:
                    now.todo = iter(pieces.split(" "))
                else:
                    now.add(turn, role, text, n, next(now.todo))
            if done:
                yield batch_of(done)
        if now:
            yield batch_of([now.end()])

    def batch_of(done: list[tuple]) -> pa.RecordBatch:
        names = [f.name for f in out]
        arrays = [pa.concat_arrays([d[0] for d in done]), *(pa.array([d[c] for d in done], pa.int64() if c < 7 else pa.string()) for c in range(1, 9))]
        return pa.RecordBatch.from_arrays(arrays, names)

    return stream.mapInArrow(follow, out)


class Repaired:
    """A conversation whose turns come in order, each with what is done at it."""

    def __init__(self, conv: pa.Array):
        self.conv, self.todo, self.state, self.last = conv, iter(()), "-", None
        self.counts = dict.fromkeys(("b", "d", "t", "illegal", "cost"), 0)
        self.low, self.high, self.distinct = None, None, 0
        self.audit: list[str] = []
        self.hash, self.first = hashlib.sha256(), True

    def put(self, role: str, text: str) -> None:
        self.hash.update((f"{role}:{text}" if self.first else f"\n{role}:{text}").encode())
        self.first = False

    def next_role(self) -> str:
        self.state = "a" if self.state == "u" else "u"
        return NAMES[self.state]

    def add(self, turn: int | None, role: str, text: str, n: int, done: str) -> None:
        kind, letters = done[0], done[1:]
        if turn is not None and turn != self.high:
            self.distinct += 1
            self.low, self.high = turn if self.low is None else self.low, turn
        fault = "t" if kind.isupper() else kind if kind in "bd" else None
        if fault:
            self.counts[fault] += 1
        self.counts["b" if kind == "b" else "d"] += n - 1
        initial = role[:1]
        self.counts["illegal"] += (self.last is not None and self.last + initial not in ("su", "ua", "au")) + n - 1
        self.last = initial
        for letter in letters:
            if letter == "I":
                self.put(self.next_role(), "")
            elif letter == "R":
                self.put(self.next_role(), text)
            elif letter == "K":
                self.state = initial
                self.put(role, text)
        self.counts["cost"] += sum({"I": INSERT, "R": RENAME, "K": 0, "D": DELETE}[x] for x in letters) + DELETE * (n - 1) + (fault == "t" and "D" not in letters)
        self.audit.append(letters + "D" * (n - 1))

    def end(self) -> tuple:
        for _ in range(CLOSING[self.state]):
            self.put(self.next_role(), "")
            self.audit.append("I")
            self.counts["cost"] += INSERT
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.distinct
        c = self.counts
        return self.conv, gaps, c["b"], c["d"], c["t"], c["illegal"], c["cost"], "".join(self.audit), self.hash.hexdigest()


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


OP12_SQL = r"""
WITH RECURSIVE
k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
c AS (SELECT *, xor(list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(key, ''), lambda ch: [ord(ch)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
        lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, (a & 1) * 3988292384) END), 4294967295) % 20 AS fate FROM k),
m AS (SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role, CASE fate WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
             unnest(range(CASE WHEN fate = 3 THEN 2 ELSE 1 END)) AS copy FROM c WHERE fate <> 0),
o AS (SELECT *, row_number() OVER w AS i, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS solid, left(role, 1) AS init, left(lag(role) OVER w, 1) AS last
      FROM m WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
f AS (SELECT *, CASE WHEN solid = '' THEN 'b' WHEN i > min(i) OVER (PARTITION BY conv_id, role, text) THEN 'd' WHEN right(solid, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault FROM o),
g AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (WHERE fault = 'b')::BIGINT AS blank, count(*) FILTER (WHERE fault = 'd')::BIGINT AS duplicate,
             count(*) FILTER (WHERE fault = 't')::BIGINT AS truncated, count(*) FILTER (WHERE last IS NOT NULL AND last || init NOT IN ('su', 'ua', 'au'))::BIGINT AS illegal, count(*)::BIGINT AS n FROM f GROUP BY conv_id),
t AS (SELECT * FROM (VALUES ('-', 's', 0), ('-', 'u', 0), ('-', 'a', 1), ('s', 'u', 0), ('s', 'a', 1), ('u', 'u', 1), ('u', 'a', 0), ('a', 'u', 0), ('a', 'a', 1)) v(x, y, ins)),
e AS (SELECT x, y, ins, op FROM t, (VALUES ('K'), ('R')) v(op) WHERE op = 'K' OR y <> 's' UNION ALL SELECT x, x, 0, 'D' FROM (VALUES ('-'), ('s'), ('u'), ('a')) v(x)),
s AS (SELECT conv_id, 0::BIGINT AS i, '-' AS state, {'cost': 0::BIGINT, 'audit': '', 'body': ''} AS best FROM g
      UNION ALL
      SELECT s.conv_id, s.i + 1, e.y, min({'cost': best.cost + CASE op WHEN 'D' THEN 3 WHEN 'R' THEN 2 ELSE 0 END + 2 * ins + CASE WHEN op <> 'D' AND fault = 't' THEN 1 ELSE 0 END, 'audit': best.audit || repeat('I', ins) || op,
             'body': best.body || CASE WHEN ins = 0 THEN '' WHEN y = 'a' THEN chr(10) || 'user:' ELSE chr(10) || 'assistant:' END
                     || CASE op WHEN 'D' THEN '' WHEN 'K' THEN chr(10) || role || ':' || text ELSE CASE y WHEN 'u' THEN chr(10) || 'user:' ELSE chr(10) || 'assistant:' END || text END})
      FROM s JOIN f ON f.conv_id IS NOT DISTINCT FROM s.conv_id AND f.i = s.i + 1 JOIN e ON e.x = s.state AND (op = 'D' OR fault NOT IN ('b', 'd')) AND (op <> 'K' OR e.y = f.init)
      GROUP BY s.conv_id, s.i, e.y),
z AS (SELECT g.conv_id, min({'cost': best.cost + CASE state WHEN 'u' THEN 2 WHEN 's' THEN 4 ELSE 0 END, 'audit': best.audit || CASE state WHEN 'u' THEN 'I' WHEN 's' THEN 'II' ELSE '' END,
             'body': best.body || CASE state WHEN 'u' THEN chr(10) || 'assistant:' WHEN 's' THEN chr(10) || 'user:' || chr(10) || 'assistant:' ELSE '' END}) AS best
      FROM s JOIN g ON g.conv_id IS NOT DISTINCT FROM s.conv_id AND g.n = s.i GROUP BY g.conv_id),
a AS (SELECT DISTINCT conv_id FROM conversations)
SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       coalesce(best.cost, 0) AS cost, coalesce(best.audit, '') AS audit, sha256(coalesce(substr(best.body, 2), '')) AS repaired_sha256
FROM a LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN z ON z.conv_id IS NOT DISTINCT FROM a.conv_id
"""
