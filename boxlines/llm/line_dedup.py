"""Line dedup by content-defined chunks of lines, with DataFrame functions alone.

A text's lines are hashed one by one; a rolling polynomial hash over the hashes of the last two lines ends
a chunk where it is divisible by DIVISOR and was not a line before, so that no chunk but the last has a
single line. Where chunks end depends on the last three lines only, so text put in before or after a passage
shifts no boundary inside it. Chunks of several lines, and single lines of
LONG_LINE words or more, are counted over the whole table by hash; those that stand in more than one place
are compared byte by byte with their first place (least doc_id, then text hash, then position), and every
further place that has the same bytes is removed.

Edge cases: a null text stays null; an empty text has one empty line and nothing to remove; a chunk of under
MIN_WORDS words is never removed; rows that agree in doc_id and text are one document to this operator, so
they keep and lose the same chunks; null ids come first; texts may be of any length; an empty table stays one;
the input may have columns of any names, of which n_removed and removed_chars are replaced. What that leaves
of repeated passages, see `line_runs`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hot_keys, packed, salted, spread, stored

DIVISOR = 2
MIN_WORDS = 10
LONG_LINE = 50


def _line_hash(line: Column) -> Column:
    return F.conv(F.substring(F.md5(line.cast("binary")), 1, 8), 16, 10).cast("long")


def with_ends(texts: DataFrame, divisor: int = DIVISOR) -> DataFrame:
    """Adds `__lines` and `__ends`, array<int>: the lines with which chunks end."""
    lines = F.split("text", "\n", -1)
    made = texts.withColumn("__lines", lines).withColumn("__hashes", F.transform("__lines", _line_hash))
    rolling = lambda i: (F.get("__hashes", i) + 31 * F.coalesce(F.get("__hashes", i - 1), F.lit(0))) % divisor
    last = F.size("__lines") - 1
    ends = F.filter(F.sequence(F.lit(0), last), lambda i: ((i > 0) & (rolling(i) == 0) & (rolling(i - 1) != 0)) | (i == last))
    return made.withColumn("__ends", ends).drop("__hashes")


def with_chunks(texts: DataFrame, divisor: int = DIVISOR) -> DataFrame:
    """Adds `chunks`, array<string>: the text's lines in chunks, which joined by newlines give it back."""
    made = with_ends(texts, divisor)
    cut = F.transform("__ends", lambda end, k: F.array_join(F.slice("__lines", F.when(k > 0, F.get("__ends", k - 1) + 2).otherwise(1), F.when(k > 0, end - F.get("__ends", k - 1)).otherwise(end + 1)), "\n"))
    return made.withColumn("chunks", cut).drop("__lines", "__ends")


def _worth(chunk: Column, min_words: int, long_line: int) -> Column:
    words = F.regexp_count(chunk, F.lit(r"[^\x20\x09-\x0D]+"))
    return (words >= min_words) & (F.contains(chunk, F.lit("\n")) | (words >= long_line))


def _places(docs: DataFrame, divisor: int) -> DataFrame:
    """A row for each chunk: document (id and text hash), position, chunk. (The outer form, as for the
    inner one Spark would infer a filter which computes the chunks a second time, inlined.)"""
    keyed = docs.where("text IS NOT NULL").select("doc_id", F.xxhash64("text").alias("text_hash"), F.col("text").cast("string").alias("text"))
    return with_chunks(keyed, divisor).select("doc_id", "text_hash", F.posexplode_outer("chunks").alias("pos", "chunk"))


def removals(docs: DataFrame, divisor: int = DIVISOR, min_words: int = MIN_WORDS, long_line: int = LONG_LINE) -> DataFrame:
    """(doc_id, text_hash, removed array<int>): positions of the chunks that each document loses."""
    places = _places(docs, divisor).where(_worth(F.col("chunk"), min_words, long_line))
    hashed = places.select("doc_id", "text_hash", "pos", F.xxhash64("chunk").alias("a"), F.xxhash64(F.lit(7), "chunk").alias("b"), "chunk")
    # which chunks stand in several places: counts by hash, summed before the shuffle
    repeated = stored(hashed.groupBy("a", "b").agg(F.count("*").alias("n")).where("n > 1"), "repeated")
    hot = hot_keys(repeated, "a", "b")
    parts = spread(repeated.drop("n"), hot, ["a", "b"])
    found = stored(salted(hashed, hot, ["a", "b"], ["doc_id", "text_hash", "pos"]).join(parts.hint("merge"), ["a", "b", "__salt"]), "places")
    firsts = stored(found.groupBy("a", "b").agg(F.min(F.struct("doc_id", "text_hash", "pos", "chunk")).alias("first")), "firsts")
    is_first = F.struct("doc_id", "text_hash", "pos").eqNullSafe(F.struct("first.doc_id", "first.text_hash", "first.pos"))
    pairs = found.join(spread(firsts, hot, ["a", "b"]).hint("merge"), ["a", "b", "__salt"])
    same = pairs.where(~is_first & (F.col("chunk").cast("binary") == F.col("first.chunk").cast("binary")))
    return same.groupBy("doc_id", "text_hash").agg(F.collect_set("pos").alias("removed"))


def dedup(docs: DataFrame, divisor: int = DIVISOR, min_words: int = MIN_WORDS, long_line: int = LONG_LINE) -> DataFrame:
    """The rows of docs with `text` less its repeated chunks, and n_removed and removed_chars (long)."""
    kept = packed(docs, "n_removed", "removed_chars")
    lost = stored(removals(kept.select("row.doc_id", "row.text"), divisor, min_words, long_line).select(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash"), "removed"), "removals")
    keyed = kept.select("row", F.col("row.doc_id").alias("doc_id"), F.xxhash64("row.text").alias("text_hash"))
    joined = keyed.join(lost.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_hash") == F.col("hash")), "left")
    touched = with_chunks(joined.select("row", "removed", F.when(F.col("removed").isNotNull(), F.col("row.text")).alias("text")), divisor)
    rest = F.array_join(F.filter("chunks", lambda _, k: ~F.array_contains("removed", k)), "\n")
    made = touched.select("row", F.when(F.col("removed").isNull(), F.col("row.text")).otherwise(rest).alias("text"), F.greatest(F.coalesce(F.size("removed"), F.lit(0)), F.lit(0)).cast("long").alias("n_removed"))
    chars = F.coalesce(F.length("row.text") - F.length("text"), F.lit(0)).cast("long")
    return made.select(F.col("row").withField("text", F.col("text")).alias("row"), "n_removed", chars.alias("removed_chars")).select("row.*", "n_removed", "removed_chars")


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS row_id, doc_id, text, string_split(text, chr(10)) AS lines FROM documents),
h AS (SELECT row_id, doc_id, text, i, lines[i] AS line, CAST('0x' || substr(md5(lines[i]), 1, 8) AS BIGINT) AS hash
      FROM (SELECT *, unnest(range(1, len(lines) + 1)) AS i FROM d WHERE text IS NOT NULL)),
z AS (SELECT *, (hash + 31 * coalesce(lag(hash) OVER (PARTITION BY row_id ORDER BY i), 0)) % 2 = 0 AS zero FROM h),
e AS (SELECT *, i > 1 AND zero AND NOT lag(zero) OVER (PARTITION BY row_id ORDER BY i) AS ends FROM z),
c AS (SELECT row_id, doc_id, text, i, line, coalesce(sum(CAST(ends AS INT)) OVER (PARTITION BY row_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM e),
k AS (SELECT row_id, doc_id, text, pos, string_agg(line, chr(10) ORDER BY i) AS chunk, count(*) AS n_lines FROM c GROUP BY row_id, doc_id, text, pos),
w AS (SELECT *, len(regexp_extract_all(chunk, '[^\x20\x09-\x0D]+')) AS words FROM k),
f AS (SELECT *, words >= 10 AND (n_lines > 1 OR words >= 50)
             AND row_number() OVER (PARTITION BY chunk ORDER BY doc_id, pos) > 1 AS gone FROM w),
r AS (SELECT row_id, string_agg(chunk, chr(10) ORDER BY pos) FILTER (WHERE NOT gone) AS rest, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_removed FROM f GROUP BY row_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(r.rest, '') END AS text, coalesce(r.n_removed, 0) AS n_removed,
       CAST(coalesce(length(d.text) - length(coalesce(r.rest, '')), 0) AS BIGINT) AS removed_chars
FROM d LEFT JOIN r USING (row_id)
"""
