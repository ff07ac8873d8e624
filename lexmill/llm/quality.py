"""Quality rules by repetition coverage.

Rolling hashes of the n-word windows of a text, for several n, tell which windows have occurred in it before; the characters
of all words inside such windows are the text's coverage at that n, each counted once. The first occurrence isn't
counted: a notice that a short text has twice is half as bad as it looks. Lines that equal an earlier line add theirs. A text is kept if it passes the base rules, no coverage is over its limit, and symbols of markup don't
stand in for words. All counts are whole numbers and are compared as such.

Defined results: null, empty and wordless texts have zeros everywhere and fail the base rules; texts are measured whole, however
long; repeated rows get the same results; an empty table gives no rows. Other columns pass through, whatever their
names, but for those that the operator returns.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkernel as K
from .common import by_place, documents

#: Percent of the characters of words that windows of n words which repeat an earlier one may cover.
COVERAGE = {5: 30, 7: 25, 10: 20}
#: Percent of the characters of words that lines equal to earlier ones may hold, and symbols for each hundred words.
LINES, SYMBOLS = 30, 10
LEAST_WORDS, MOST_REPEATED = 50, 50

SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True
LEAD = (np.arange(256) & 0xC0) != 0x80  # the first byte of a code point
LINE_BYTE = K.BYTE.copy()
LINE_BYTE[10] = 0
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "dup_line_chars", *(f"dup_chars_{n}" for n in COVERAGE)]


def per_text(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """How many of the flags are set in each text."""
    return np.diff(np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))[bounds])


def twice(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key whether it occurs twice or more, and whether it has occurred before."""
    order = np.argsort(keys, kind="stable")
    same = np.zeros(len(keys) + 1, bool)
    same[1:-1] = keys[order[1:]] == keys[order[:-1]]
    often, again = np.empty(len(keys), bool), np.empty(len(keys), bool)
    often[order], again[order] = same[1:] | same[:-1], same[:-1]
    return often, again


def covered(words: K.Words, text_of: np.ndarray, n: int, first: bool = False) -> np.ndarray:
    """For each word whether it stands in an n-word window that its text has had before (first: or has again later)."""
    keys, at = K.windows(words.hashes, words.cuts, n)
    often, again = twice(K.mixed(keys ^ K.mixed(text_of[at].astype(np.uint64) + np.uint64(1))))
    steps = np.zeros(len(words.hashes) + 1, np.int64)
    at = at[often if first else again]
    steps[at] += 1
    steps[at + n] -= 1
    return np.cumsum(steps)[:-1] > 0


def measure_slice(part: K.Slice) -> np.ndarray:
    """COUNTS of each text of the slice."""
    data, bounds = part.data, part.bounds
    words = K.words(part)
    solid, texts = ~K.BLANK[data], len(bounds) - 1
    out = np.zeros((len(COUNTS), texts), np.int64)
    chars = np.concatenate(([0], np.cumsum(solid & LEAD[data], dtype=np.int64)))
    out[0], out[1], out[2] = np.diff(words.cuts), np.diff(chars[bounds]), per_text(SYMBOL[data], bounds)
    if not len(words.hashes):
        return out
    breaks = np.flatnonzero(data == 10) + 1
    starts = np.unique(np.concatenate((bounds[:-1], breaks)))
    starts = starts[starts < len(data)]
    up, down = K.powers(len(data))
    hashes = np.add.reduceat(LINE_BYTE[data] * up, starts) * down[starts]
    ends = np.append(starts[1:], len(data))
    line_text = np.searchsorted(bounds, starts, "right") - 1
    real = np.add.reduceat(solid.astype(np.int64), starts) > 0
    _, again = twice(K.mixed(K.mixed(hashes[real]) ^ K.mixed(line_text[real].astype(np.uint64) + np.uint64(1))))
    np.add.at(out[3], line_text[real][again], 1)
    np.add.at(out[5], line_text[real][again], (chars[ends] - chars[starts])[real][again])
    text_of = np.repeat(np.arange(texts), out[0])
    sizes = chars[words.ends] - chars[words.starts]
    sums = lambda flags, weight: np.diff(np.concatenate(([0], np.cumsum(flags * weight)))[words.cuts])
    out[4] = sums(covered(words, text_of, 3, first=True), 1)
    for i, n in enumerate(COVERAGE):
        out[6 + i] = sums(covered(words, text_of, n), sizes)
    return out


def measure(docs: DataFrame) -> DataFrame:
    """docs with COUNTS."""
    plain, names, back = by_place(docs, ("text",), tuple(COUNTS))
    rest = [plain.schema[n] for n in names]
    out = T.StructType([*rest, *(T.StructField(c, T.LongType()) for c in COUNTS)])

    def run(batches):
        for batch in batches:
            found = [measure_slice(part) for part in K.slices(batch.column("text"))]
            counts = np.concatenate(found, axis=1) if found else np.zeros((len(COUNTS), 0), np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in rest), *(pa.array(c) for c in counts)], names=[f.name for f in out.fields])

    return back(plain.select(*names).mapInArrow(run, out))


def judge(measured: DataFrame) -> DataFrame:
    """measured with base_failed and kept."""
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    over = (100 * F.col("dup_line_chars") > LINES * F.col("word_chars")) | (100 * F.col("n_symbols") > SYMBOLS * F.col("n_words"))
    for n, most in COVERAGE.items():
        over = over | (100 * F.col(f"dup_chars_{n}") > most * F.col("word_chars"))
    return measured.withColumn("base_failed", failed).withColumn("kept", ~failed & ~over)


def keep(docs: DataFrame) -> DataFrame:
    """The documents that pass, with the columns that they came with, whatever their names."""
    plain, names, back = by_place(docs, ("text",))
    return back(judge(measure(plain)).filter("kept").select(*names))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return judge(measure(docs)).drop("text")


_COVER = """
g{n} AS (SELECT doc_id, i, {often} AS often FROM (
  SELECT doc_id, i, array_to_string(ws[i:i + {n} - 1], ' ') AS g FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - {n} + 1)) AS i FROM w))),
c{n} AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + {n} - 1)) AS i FROM g{n} WHERE often),
r{n} AS (SELECT doc_id, count(*) AS words, sum(length(ws[i])) AS chars FROM c{n} JOIN w USING (doc_id) GROUP BY doc_id)"""
OP7_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS ws FROM d),
l AS (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id, line ORDER BY i) > 1 AS again FROM (
  SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM d))
  WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')),
ll AS (SELECT doc_id, count(*) AS n, sum(length(regexp_replace(line, '[\\x20\\x09-\\x0D]+', '', 'g'))) AS chars FROM l WHERE again GROUP BY doc_id),
{_COVER.format(n=3, often="count(*) OVER (PARTITION BY doc_id, g) > 1")},
{",".join(_COVER.format(n=n, often="row_number() OVER (PARTITION BY doc_id, g ORDER BY i) > 1") for n in COVERAGE)},
m AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(ll.n, 0)::BIGINT AS n_dup_lines,
  coalesce(r3.words, 0)::BIGINT AS n_repeat_words, coalesce(ll.chars, 0)::BIGINT AS dup_line_chars,
  {", ".join(f"coalesce(r{n}.chars, 0)::BIGINT AS dup_chars_{n}" for n in COVERAGE)}
  FROM w LEFT JOIN ll USING (doc_id) LEFT JOIN r3 ON w.doc_id = r3.doc_id {" ".join(f"LEFT JOIN r{n} ON w.doc_id = r{n}.doc_id" for n in COVERAGE)}),
f AS (SELECT *, (n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words) AS base_failed FROM m)
SELECT *, NOT base_failed AND NOT (100 * dup_line_chars > {LINES} * word_chars OR 100 * n_symbols > {SYMBOLS} * n_words
  {" ".join(f"OR 100 * dup_chars_{n} > {most} * word_chars" for n, most in COVERAGE.items())}) AS kept FROM f
"""
