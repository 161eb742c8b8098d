"""Line dedup of every repeated run of lines, with DataFrame functions alone.

Two kinds of candidates: the chunks of `line_dedup`, and every pair of lines that follow each other (lines
without words aside), as well as every single line of LONG_LINE words. A line is hashed once, to 128 bits;
pairs and chunks are hashed from the hashes of their lines. Candidates are counted by half of their hash
alone; of those that stand in several places the first (least doc_id, then text hash, then line) keeps its
lines. Chunks of any other place go; of pairs, those that follow each other make a run, and a run of
LONG_LINE words goes. So a repeated passage of LONG_LINE words and more goes whole, whatever stands around
it and wherever its chunks end: its pairs are in it, and depend on nothing else. Bytes are compared by line:
a hash that two different lines share is found by the least and greatest line that has it, and candidates
with such a line stay.

Edge cases: within one document, a pair that begins within LONG_LINE words of its first place keeps its lines;
of every line that is removed an earlier copy remains, as a line's first copy can't be in a later place of
anything; lines without words go where they stand inside of what goes; a null text
stays null, an empty one empty; rows that agree in doc_id and text are one document, so they keep and lose
the same lines; null ids come first; texts may be of any length; an empty table stays one; the input may have
columns of any names, of which n_removed (lines) and removed_chars are replaced.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, hot_keys, packed, salted, spread, stored
from .line_dedup import LONG_LINE, MIN_WORDS, with_ends

#: A candidate is first line << 33 | last line << 2 | its kind: a single line, a pair or a chunk. Lines are
#: numbered from 0; single ones and pairs, among the lines that have words.
_SINGLE, _PAIR, _CHUNK = 0, 1, 2


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once, not for each element of a lambda that uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _code(first: Column, last: Column, kind: int) -> Column:
    return F.shiftleft(first.cast("long"), 33) + F.shiftleft(last.cast("long"), 2) + F.lit(kind).cast("long")


def _first(code: Column) -> Column:
    return F.shiftright(code, 33).cast("int")


def _last(code: Column) -> Column:
    return F.shiftright(code, 2).bitwiseAND((1 << 31) - 1).cast("int")


def _kind(code: Column) -> Column:
    return code.bitwiseAND(3)


def _line_hashes(line: Column) -> list[Column]:
    return [F.xxhash64(line).alias("a"), F.xxhash64(F.lit(7), line).alias("b")]


def with_candidates(texts: DataFrame, min_words: int = MIN_WORDS, long_line: int = LONG_LINE) -> DataFrame:
    """Adds `candidates`, array<struct<code,a,b>>: chunks worth removing, pairs and long lines of a text."""
    made = with_ends(texts)
    about = F.transform("__lines", lambda x, i: F.struct(i.alias("i"), F.regexp_count(x, F.lit(r"[^\x20\x09-\x0D]+")).alias("w"), *_line_hashes(x)))
    full = F.transform(F.filter("__about", lambda x: x["w"] > 0), lambda x, k: x.withField("i", k))
    made = made.withColumn("__about", about).withColumn("__full", full)

    def struct(first: Column, last: Column, kind: int, *of: Callable[[str], Column]) -> Column:
        a, b = (F.xxhash64(F.lit(kind), *(x(half) for x in of)) for half in "ab")
        return F.struct(_code(first, last, kind).alias("code"), a.alias("a"), b.alias("b"))

    singles = F.transform(F.filter("__full", lambda x: x["w"] >= long_line), lambda x: struct(x["i"], x["i"], _SINGLE, lambda half: x[half]))
    n = F.size("__full")
    ahead = F.slice("__full", F.lit(2), F.greatest(n - 1, F.lit(0)))
    pairs = F.zip_with(F.slice("__full", F.lit(1), F.greatest(n - 1, F.lit(0))), ahead, lambda x, y: struct(x["i"], y["i"], _PAIR, lambda half: x[half], lambda half: y[half]))

    def chunk(end: Column, k: Column) -> Column:
        """A chunk's code, hashes and words."""
        start = F.coalesce(F.get("__ends", k - 1) + 1, F.lit(0))
        hashes = lambda some: struct(start, end, _CHUNK, lambda half: F.transform(some, lambda x: x[half]))
        part = lambda some: hashes(some).withField("w", F.aggregate(some, F.lit(0), lambda n, x: n + x["w"]))
        return _let(F.slice("__about", start + 1, end - start + 1), part)

    worth = lambda c: (c["w"] >= min_words) & (_last(c["code"]) > _first(c["code"]))
    chunks = F.transform(F.filter(F.transform("__ends", chunk), worth), lambda c: c.dropFields("w"))
    return made.withColumn("candidates", F.concat(singles, pairs, chunks)).drop("__lines", "__ends", "__about", "__full")


def places(docs: DataFrame, min_words: int = MIN_WORDS, long_line: int = LONG_LINE) -> DataFrame:
    """(doc_id, text_hash, later, first): the candidates of each document (doc_id, text) that stand elsewhere
    too, by whether another place is the first; if that is in the document itself, `own` says with which line
    it begins."""
    keyed = docs.where("text IS NOT NULL").select("doc_id", F.xxhash64("text").alias("text_hash"), F.col("text").cast("string").alias("text"))
    listed = with_candidates(keyed, min_words, long_line).select("doc_id", "text_hash", F.explode_outer("candidates").alias("c"))
    hashed = stored(listed.select("doc_id", "text_hash", "c.*").where("code IS NOT NULL"), "candidates")
    # which stand in several places: counts by half a hash, summed before the shuffle
    several = stored(hashed.groupBy("a").agg(F.count("*").alias("n")).where("n > 1"), "several")
    hot = hot_keys(several, "a")
    parts = spread(several.drop("n"), hot, ["a"])
    hits = stored(salted(hashed, hot, ["a"], ["doc_id", "text_hash", "code"]).join(parts.hint("merge"), ["a", "__salt"]), "hits")
    place = F.struct("doc_id", "text_hash", "code")
    firsts = hits.groupBy("a", "b").agg(F.min(place).alias("first"), F.max(place).alias("last"))
    firsts = stored(firsts.where(F.col("first") != F.col("last")).drop("last"), "firsts")
    found = hits.join(spread(firsts, hot, ["a"]).hint("merge"), ["a", "b", "__salt"])
    is_first = place.eqNullSafe(F.col("first"))
    own = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_hash") == F.col("first.text_hash"))
    later = ~is_first & ~(own & (_first(F.col("code")) <= _last(F.col("first.code"))))
    told = F.struct("code", F.when(own, _first(F.col("first.code"))).alias("own"))
    listed = lambda which, what, name: F.sort_array(F.collect_set(F.when(which, what))).alias(name)
    out = stored(found.groupBy("doc_id", "text_hash").agg(listed(later, told, "later"), listed(is_first, F.col("code"), "first")), "places")
    discard(hashed, several, hits, firsts)
    return out


def _has_words(line: Column) -> Column:
    return line.rlike(r"[^\x20\x09-\x0D]")


def _worded(lines: Column) -> Column:
    """The numbers of the lines that have words."""
    return F.filter(F.transform(lines, lambda x, i: F.when(_has_words(x), i)), lambda i: i.isNotNull())


def _lines_of(code: Column, worded: Column) -> Column:
    """The numbers of a candidate's lines, those without words in between included."""
    at = lambda k: F.when(_kind(code) == _CHUNK, k).otherwise(F.get(worded, k))
    return F.sequence(at(_first(code)), at(_last(code)))


def _gone(lines: Column, worded: Column, later: Column, long_line: int) -> Column:
    """The numbers of the lines that go: of chunks, long lines, and runs of pairs with long_line words. A pair
    whose first place is in the same document goes from long_line words behind it on."""

    def words(some: Column) -> Column:
        return F.regexp_count(F.array_join(F.transform(some, lambda i: F.get(lines, i)), "\n"), F.lit(r"[^\x20\x09-\x0D]+"))

    def runs(pairs: Column) -> Column:
        number = F.sequence(F.lit(1), F.size(pairs))
        at = lambda k: F.get(pairs, k - 1)
        starts = F.filter(number, lambda k: (k == 1) | (_last(at(k - 1)) != _first(at(k))))
        ends = F.filter(number, lambda k: (k == F.size(pairs)) | (_last(at(k)) != _first(at(k + 1))))
        return F.when(F.size(pairs) > 0, F.zip_with(starts, ends, lambda s, e: _code(_first(at(s)), _last(at(e)), _PAIR))).otherwise(F.array().cast("array<long>"))

    def far(c: Column) -> Column:
        apart = _first(c["code"]) - c["own"]
        return c["own"].isNull() | (apart >= long_line) | (words(F.slice(worded, c["own"] + 1, F.greatest(apart, F.lit(0)))) >= long_line)

    pairs = F.transform(F.filter(later, lambda c: (_kind(c["code"]) == _PAIR) & far(c)), lambda c: c["code"])
    long_runs = F.filter(_let(pairs, runs), lambda c: words(F.slice(worded, _first(c) + 1, _last(c) - _first(c) + 1)) >= long_line)
    rest = F.transform(F.filter(later, lambda c: _kind(c["code"]) != _PAIR), lambda c: c["code"])
    return F.array_distinct(F.flatten(F.transform(F.concat(long_runs, rest), lambda c: _lines_of(c, worded))))


def _odd_lines(joined: DataFrame) -> DataFrame | None:
    """(id, hash, odd): the numbers of a document's lines that share their 128 bits with other bytes; None where
    no hash is shared, as always but by design. joined: (row, doc_id, text_hash, later, first), of which only the
    lines of candidates are looked at."""
    codes = F.concat(F.transform("later", lambda c: c["code"]), F.col("first"))
    of = lambda lines: _let(_worded(lines), lambda worded: F.transform(F.array_distinct(F.flatten(F.transform(codes, lambda c: _lines_of(c, worded)))), lambda i: F.struct(i.alias("i"), F.get(lines, i).alias("line"))))
    lines = joined.select("doc_id", "text_hash", F.explode_outer(_let(F.split("row.text", "\n", -1), of)).alias("l")).select("doc_id", "text_hash", "l.i", "l.line", *_line_hashes(F.col("l.line")))
    shared = lines.groupBy("a", "b").agg(F.min("line").alias("least"), F.max("line").alias("most")).where(F.col("least").cast("binary") != F.col("most").cast("binary"))
    shared = stored(shared.select("a", "b"), "shared_hashes")
    if not shared.limit(1).count():
        return None
    odd = lines.join(shared, ["a", "b"], "left_semi").groupBy(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash")).agg(F.collect_set("i").alias("odd"))
    return stored(odd, "odd_lines")


def dedup(docs: DataFrame, min_words: int = MIN_WORDS, long_line: int = LONG_LINE) -> DataFrame:
    """The rows of docs with `text` less its repeated runs and chunks, and n_removed (lines) and
    removed_chars (long)."""
    kept = packed(docs, "n_removed", "removed_chars")
    lost = places(kept.select("row.doc_id", "row.text"), min_words, long_line).withColumnsRenamed({"doc_id": "id", "text_hash": "hash"})
    keyed = kept.select("row", F.col("row.doc_id").alias("doc_id"), F.xxhash64("row.text").alias("text_hash"))
    same = F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_hash") == F.col("hash"))
    # texts are shuffled twice, to compare bytes and for the result, and not kept in between
    odd = _odd_lines(keyed.join(lost.hint("shuffle_hash"), same).drop("id", "hash"))
    told = keyed.join(lost.hint("shuffle_hash"), same, "left").drop("id", "hash")
    told = told.withColumn("odd", F.lit(None).cast("array<int>")) if odd is None else told.join(odd, same, "left").drop("id", "hash")

    def left(lines: Column) -> Column:
        """What is left of a text that has candidates in later places, and how many lines go."""

        def of(worded: Column) -> Column:
            sound = F.filter("later", lambda c: ~F.exists("odd", lambda i: F.array_contains(_lines_of(c["code"], worded), i)))
            return _let(_gone(lines, worded, F.when(F.col("odd").isNull(), F.col("later")).otherwise(sound), long_line), rest)

        def rest(gone: Column) -> Column:
            stays = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)
            return F.struct(F.array_join(F.transform(stays, lambda i: F.get(lines, i)), "\n").alias("text"), F.size(gone).cast("long").alias("n"))

        return _let(_worded(lines), of)

    made = told.select("row", F.when(F.size("later") > 0, _let(F.split("row.text", "\n", -1), left)).alias("left"))
    text = F.when(F.col("left.n") > 0, F.col("left.text")).otherwise(F.col("row.text"))
    done = made.select("row", text.alias("text"), F.coalesce("left.n", F.lit(0)).cast("long").alias("n_removed"))
    chars = F.coalesce(F.length("row.text") - F.length("text"), F.lit(0)).cast("long")
    return done.select(F.col("row").withField("text", F.col("text")).alias("row"), "n_removed", chars.alias("removed_chars")).select("row.*", "n_removed", "removed_chars")
