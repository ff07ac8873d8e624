"""Secret scans over an incremental blob ledger.

Every text is addressed by the SHA-256 of its bytes. The ledger has a row for each blob and rule version that has been
scanned, and the spans found. A scan of any number of document versions works on the blobs and rule versions that the
ledger lacks, once for each blob however many rows hold it, appends what it finds, and joins all findings back to every
row. A changed rule gets a new version: its findings alone are made anew, over blobs already known.

Spans come from built-in functions alone: the pieces between matches and the matches themselves, both by the same
pattern, give positions as running sums of their lengths, in blocks, so that a text with very many matches takes time in proportion.

Defined results: a null text is empty and has no span; a blob with a third of all rows is scanned once; findings keep
the order of start, then of the rule in the caller's list; repeated rows get the same findings; texts are searched whole, however
long; an empty table gives no rows. Other columns pass through `scan`, whatever their names, but for those that it returns.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import by_place, cut, documents, scratch, text_or_empty


@dataclass(frozen=True)
class Rule:
    """kind, version, pattern of the matches (leftmost, non-overlapping), and what a match must look like to count."""

    kind: str
    version: int
    pattern: str
    counts: str | None = None
    hint: str = "="  # a pattern without which a text has no match


# Fixed values of the contract: the three base rules. A run of the letters and digits of `access` or `hex` is matched whole or, being
# too short, not at all: the least length stands in the pattern, which finds the same spans as a check afterwards.
BASE = (
    Rule("assign", 1, r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", r"""^(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{6,}$""", r"[:=]"),
    Rule("access", 1, r"AKIA[A-Z0-9]{16,}", None, r"AKIA"),
    Rule("hex", 1, r"[0-9a-f]{24,}", None, r"[0-9a-f]{24}"),
)
# Public formats of keys, from their issuers' documentation.
MORE = (
    Rule("pem", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----", None, r"-----BEGIN"),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", None, r"eyJ"),
    Rule("hub", 1, r"gh[pousr]_[A-Za-z0-9]{36,}", None, r"gh[pousr]_"),
)
RULES = BASE + MORE
SPAN = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("rule", T.IntegerType()), T.StructField("kind", T.StringType()), T.StructField("end", T.IntegerType())])
PLACE = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
LEDGER = T.StructType([T.StructField("blob", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("version", T.IntegerType()), T.StructField("spans", T.ArrayType(PLACE))])
#: Hashes that are broadcast, at most (about 100 bytes each).
FEW = 100_000
#: Matches whose positions are summed up together.
BLOCK = 64


def bound(value: Column, f) -> Column:
    """f(value), value being worked out once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def spans(text: Column, rule: Rule) -> Column:
    """Array of PLACE for the rule's matches in text; positions are code points, end exclusive."""
    none = F.array().cast(T.ArrayType(PLACE))
    found, between = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)), F.split(text, rule.pattern, -1)
    counts = (lambda m: F.lit(True)) if rule.counts is None else (lambda m: m.rlike(rule.counts))
    lengths = F.zip_with(between, found, lambda b, m: F.struct(F.length(b).alias("b"), F.length(m).alias("m"), counts(m).alias("ok")))
    lengths = F.filter(lengths, lambda x: x["m"].isNotNull())  # the last piece is followed by no match

    def in_blocks(all_lengths: Column) -> Column:
        last = F.floor((F.size(all_lengths) - 1) / BLOCK).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda k: F.slice(all_lengths, k * BLOCK + 1, F.lit(BLOCK)))

    def begins(blocks: Column) -> Column:
        sums = F.transform(blocks, lambda block: F.aggregate(block, F.lit(0), lambda n, x: n + x["b"] + x["m"]))
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(sums, start, lambda a, n: F.struct((a["at"] + n).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")), lambda a: a["out"])

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["b"]
        end = start + x["m"]
        here = F.when(x["ok"], F.array(F.struct(start.alias("start"), end.alias("end")))).otherwise(none)
        return F.struct(end.alias("at"), F.concat(acc["out"], here).alias("out"))

    def placed(block: Column, at: Column) -> Column:
        return F.aggregate(block, F.struct(at.alias("at"), none.alias("out")), step, lambda a: a["out"])

    def whole(all_lengths: Column) -> Column:
        blocks = bound(in_blocks(all_lengths), lambda blocks: F.zip_with(blocks, begins(blocks), placed))
        return F.when(F.size(all_lengths) > 0, F.flatten(blocks)).otherwise(none)

    return F.when(text.rlike(rule.hint), bound(lengths, whole)).otherwise(none)


class BlobLedger:
    """What has been scanned, at `path` in the shared folder: blob, kind, version, spans. It knows nothing of any caller's list of rules."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or scratch(spark, "ledger")
        if path is None:
            spark.createDataFrame([], LEDGER).write.parquet(self.path)

    def rows(self) -> DataFrame:
        return self.spark.read.schema(LEDGER).parquet(self.path)

    def done(self, rules: tuple[Rule, ...]) -> DataFrame:
        """blob and done: those of the rule versions that the ledger has of it."""
        return self.rows().filter(chosen(rules)).groupBy("blob").agg(F.collect_set(F.concat_ws(":", "kind", F.col("version").cast("string"))).alias("done"))

    def add(self, docs: DataFrame, rules: tuple[Rule, ...]) -> None:
        """Scans the blobs of docs (blob, text) by those rules under which the ledger hasn't got them yet.

        The ledger is asked with the hashes alone. If those that lack a rule are FEW at most they are broadcast, and no other text is
        shuffled; else every blob's text is, once a task. Each blob is scanned once.
        """
        known = self.done(rules)
        lacking = docs.select("blob").distinct().join(known, "blob", "left").filter(F.col("done").isNull() | (F.size("done") < len(rules)))
        lacking = cut(lacking, "lacking").select(F.col("blob").alias("b"), "done")
        one = lambda rows, *more: rows.groupBy("blob").agg(F.first("text").alias("text"), *more)
        if lacking.limit(FEW + 1).count() <= FEW:
            texts = one(docs.join(F.broadcast(lacking), F.col("blob") == F.col("b")), F.first("done").alias("done"))
        else:  # copies of a blob meet as one row a task, so that a hot one does no harm
            texts = one(docs).join(lacking, F.col("blob") == F.col("b"))
        asked = []
        for rule in rules:
            new = F.col("done").isNull() | ~F.array_contains("done", f"{rule.kind}:{rule.version}")
            entry = F.struct(F.lit(rule.kind).alias("kind"), F.lit(rule.version).alias("version"), spans(F.col("text"), rule).alias("spans"))
            asked.append(F.when(new, entry))
        scanned = texts.select("blob", F.inline(F.filter(F.array(*asked), lambda x: x.isNotNull())))
        scanned.write.mode("append").parquet(self.path)

    def findings(self, rules: tuple[Rule, ...]) -> DataFrame:
        """blob and its spans (SPAN, rule being the place in `rules`) under the given rule versions, sorted; blobs with none are left out."""
        hit = self.rows().filter(chosen(rules) & (F.size("spans") > 0))
        place = F.array_position(F.array(*(F.lit(rule.kind) for rule in rules)), F.col("kind")).cast("int") - 1
        full = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), place.alias("rule"), F.col("kind").alias("kind"), s["end"].alias("end")))
        return hit.select("blob", full.alias("spans")).groupBy("blob").agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"))


def chosen(rules: tuple[Rule, ...]) -> Column:
    """Whether a row of the ledger is of one of the rule versions."""
    out = F.lit(False)
    for rule in rules:
        out = out | ((F.col("kind") == rule.kind) & (F.col("version") == rule.version))
    return out


def scan(docs: DataFrame, ledger: BlobLedger | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs with blob and spans (array of start, rule, kind, end), empty where nothing is found."""
    ledger = ledger or BlobLedger(docs.sparkSession)
    plain, rest, back = by_place(docs, ("text",), ("blob", "spans"))
    addressed = plain.select(*rest, F.sha2(text_or_empty(), 256).alias("blob"))
    ledger.add(addressed.select("blob", text_or_empty().alias("text")), rules)
    joined = addressed.join(ledger.findings(rules).withColumnRenamed("blob", "b"), F.col("blob") == F.col("b"), "left")
    return back(joined.select(*rest, "blob", F.coalesce("spans", F.array().cast(T.ArrayType(SPAN))).alias("spans")))


def written(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_of(kind: str) -> Column:
    return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(documents(spark, sf_dir).select("doc_id", "text")).drop("text")
    base = F.filter("spans", lambda s: s["rule"] < len(BASE))
    counts = [count_of(rule.kind).alias(f"n_{rule.kind}") for rule in BASE]
    return found.select("doc_id", *counts, F.sha2(written(base), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))


def _sql_rule(rule: Rule, order: int) -> str:
    counts = f"regexp_full_match(m, $q${rule.counts.strip('^$')}$q$, 's')" if rule.counts else "true"
    return f"""
SELECT doc_id, {order} AS rule, '{rule.kind}' AS kind, s, s + length(m) AS e FROM (
  SELECT doc_id, m, (sum(length(b)) OVER w + sum(length(m)) OVER w - length(m))::BIGINT AS s FROM (
    SELECT doc_id, unnest(ms) AS m, unnest(bs[1:len(ms)]) AS b, generate_subscripts(ms, 1) AS i FROM (
      SELECT doc_id, regexp_extract_all(text, $q${rule.pattern}$q$) AS ms, string_split_regex(text, $q${rule.pattern}$q$) AS bs
      FROM d WHERE regexp_matches(text, $q${rule.hint}$q$)))
  WINDOW w AS (PARTITION BY doc_id ORDER BY i)) WHERE {counts}"""


OP8_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
f AS ({" UNION ALL ".join(_sql_rule(r, i) for i, r in enumerate(RULES))}),
g AS (SELECT doc_id, count(*) FILTER (WHERE kind = 'assign') AS a, count(*) FILTER (WHERE kind = 'access') AS c, count(*) FILTER (WHERE kind = 'hex') AS h,
        string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rule) FILTER (WHERE rule < 3) AS base,
        string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rule) AS every FROM f GROUP BY doc_id)
SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(c, 0) AS n_access, coalesce(h, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(every, '') AS spans
FROM d LEFT JOIN g USING (doc_id)
"""
