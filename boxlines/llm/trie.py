"""Prefix trie of conversations by heavy-path decomposition.

A node is a distinct sequence of first turns, known by two sums of hashes of its turns and their places (120
bits of each turn's SHA-256 go in), so that prefixes are running sums and no conversation has to stand in
one task. Nodes are counted by key, summed before the shuffle. The largest child of a node, by members,
continues its path; a path ends in a node without children and is named after that node's smallest member,
whose own prefixes say where the path begins: below its deepest node that is nobody's largest child. Passing
to a child that isn't the largest at least halves the members, so a path hangs on at most log2(members)
others. From the lowest such level up, paths hand their totals to the path they hang on, one round a level;
then one suffix sum along all paths' arrays gives every node its subtree.

Edge cases: null role or text counts as empty; turns with equal numbers come in the order of their SHA-256,
equal rows stay rows of their own; rows without conv_id take no part; a conversation without turns ends in
the root; an empty table gives an empty table; other input columns are not read; texts may be of any length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, stored
from .scan import running

#: Bytes of joined ids in one row while they are on their way to be hashed.
CHUNK_BYTES = 1 << 20


def turns_of(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos from 1, a, b, bytes): each turn's place, halves of its digest and its text's UTF-8 bytes."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.sha2(F.concat(F.length(role).cast("string"), F.lit("\n"), role, text), 256)
    half = lambda k: F.conv(F.substring("digest", k, 15), 16, 10).cast("long")
    known = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", digest.alias("digest"), F.octet_length(text).cast("long").alias("bytes"))
    turns = known.select("conv_id", "turn", half(1).alias("a"), half(16).alias("b"), "bytes", F.monotonically_increasing_id().alias("row"), F.lit(1).cast("long").alias("one"))
    placed = running(turns, "conv_id", [F.col("turn").asc_nulls_first(), F.col("a"), F.col("b"), F.col("row")], ["one"], "turns")
    return placed.select("conv_id", F.col("one_run").alias("pos"), "a", "b", "bytes")


def rebuilt(turns: DataFrame, group: int = 5, heads: int = 9) -> tuple[DataFrame, DataFrame]:
    """The turns with each conversation's first h replaced by those of the first conversation of its group
    of ids, h = crc32(id) % heads; and the conversations (conv_id)."""
    sizes = turns.groupBy("conv_id").agg(F.max("pos").alias("n"))
    c = F.col("conv_id")
    known = sizes.select("conv_id", (c - F.pmod(c, F.lit(group))).alias("source"), (F.crc32(c.cast("string").cast("binary")) % heads).alias("h"))
    convs = known.join(sizes.select(F.col("conv_id").alias("source"), "n"), "source", "left").withColumn("taken", F.least("h", F.coalesce("n", F.lit(0))))
    convs = stored(convs.select("conv_id", "source", "h", "taken"), "conversations")
    own = turns.join(convs.select("conv_id", "h", "taken"), "conv_id").where("pos > h").select("conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "a", "b", "bytes")
    takers = convs.select(F.col("source").alias("conv_id"), F.col("conv_id").alias("taker"), "h")
    copied = turns.where(F.col("pos") < heads).join(takers, "conv_id").where("pos <= h").select(F.col("taker").alias("conv_id"), "pos", "a", "b", "bytes")
    return own.unionByName(copied), convs.select("conv_id")


def _id_digests(ends: DataFrame) -> DataFrame:
    """(ka, kb, sha): the digest of each key's conv_ids, ascending and joined by commas. Ids are ranged by key
    and id; a key that lies inside one partition is hashed there, of others the ids go on in long pieces to
    the one task that streams through them."""
    piece = "ka long, kb long, part int, at long, ids binary, sha string"
    names = ["ka", "kb", "part", "at", "ids", "sha"]

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at, key, held, size, open_before = TaskContext.get().partitionId(), 0, None, [], 0, True
        made: list[list] = [[] for _ in names]

        def put(ids: bytes | None, sha: str | None) -> None:
            nonlocal at
            at += 1
            for column, x in zip(made, (*key, part, at, ids, sha), strict=True):
                column.append(x)

        def batch_of() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(made, (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.string()), strict=True)], names)
            for column in made:
                column.clear()
            return out

        for batch in batches:
            for ka, kb, c in zip(*(batch.column(x).to_pylist() for x in ("ka", "kb", "conv_id")), strict=True):
                if (ka, kb) != key:
                    if key is not None:
                        joined = b",".join(held)
                        if not open_before:
                            put(None, hashlib.sha256(joined).hexdigest())
                        elif held:
                            put(joined, None)
                        open_before = False
                    key, held, size = (ka, kb), [], 0
                held.append(b"%d" % c)
                size += len(held[-1]) + 1
                if size >= CHUNK_BYTES:
                    put(b",".join(held), None)
                    yield batch_of()
                    held, size, open_before = [], 0, True
            if len(made[0]) >= 4096:
                yield batch_of()
        if held:
            put(b",".join(held), None)
        if made[0]:
            yield batch_of()

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sha = None, None

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([key[0]]), pa.array([key[1]]), pa.array([sha.hexdigest()])], ["ka", "kb", "sha"])

        for batch in batches:
            for ka, kb, ids in zip(*(batch.column(x).to_pylist() for x in ("ka", "kb", "ids")), strict=True):
                if (ka, kb) != key:
                    if key is not None:
                        yield done()
                    key, sha = (ka, kb), hashlib.sha256(ids)
                else:
                    sha.update(b"," + ids)
        if key is not None:
            yield done()

    ranged = ends.repartitionByRange("ka", "kb", "conv_id").sortWithinPartitions("ka", "kb", "conv_id")
    pieces = stored(ranged.mapInArrow(gathered, piece), "end_ids")
    whole = pieces.where("sha IS NOT NULL").select("ka", "kb", "sha")
    parted = pieces.where("sha IS NULL").repartition("ka", "kb").sortWithinPartitions("ka", "kb", "part", "at")
    return whole.unionByName(parted.select("ka", "kb", "ids").mapInArrow(hashed, "ka long, kb long, sha string"))


def prefix_trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """A row a node of the trie of conversations (turns: conv_id, pos from 1, a, b, bytes; convs: every
    conv_id once): conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens and ends_sha256; besides them, path, the conv_id that names its path."""
    bounded_batches(turns.sparkSession)
    keyed = turns.withColumn("x", F.xxhash64("pos", "a", "b")).withColumn("y", F.xxhash64(F.lit(7), "pos", "b", "a"))
    summed = running(keyed.drop("a", "b"), "conv_id", [F.col("pos")], ["x", "y"], "prefix_sums")
    prefixes = stored(summed.select("conv_id", F.col("pos").alias("depth"), "bytes", F.col("x_run").alias("ka"), F.col("y_run").alias("kb"), F.col("x_before").alias("pa"), F.col("y_before").alias("pb")), "prefixes")

    # nodes, their children, and which child is the largest
    below = prefixes.groupBy("ka", "kb").agg(F.first("pa").alias("pa"), F.first("pb").alias("pb"), F.first("depth").alias("depth"), F.first("bytes").alias("bytes"), F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"))
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    root = convs.groupBy().agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id")).where("n_convs > 0")
    root = root.select(zero.alias("ka"), zero.alias("kb"), none.alias("pa"), none.alias("pb"), zero.alias("depth"), zero.alias("bytes"), "n_convs", "conv_id")
    nodes = stored(below.unionByName(root), "nodes")
    largest = F.max(F.struct("n_convs", F.bitwise_not("conv_id").alias("last"), "ka", "kb"))
    families = stored(nodes.where("pa IS NOT NULL").groupBy("pa", "pb").agg(F.count("*").alias("n_children"), largest.alias("heavy")), "families")
    counted = nodes.join(families.select(F.col("pa").alias("ka"), F.col("pb").alias("kb"), "n_children"), ["ka", "kb"], "left")
    heavy = families.select(F.col("heavy.ka").alias("ka"), F.col("heavy.kb").alias("kb"), F.lit(True).alias("heavy"))
    marked = counted.join(heavy, ["ka", "kb"], "left").withColumn("n_children", F.coalesce("n_children", zero)).withColumn("heavy", F.coalesce("heavy", F.lit(False)))
    marked = stored(marked, "marked_nodes")

    # paths: the prefixes of the conversation that names a leaf, from below its deepest light node
    leaves = marked.where("n_children = 0").select(F.col("conv_id").alias("path"))
    along = prefixes.select(F.col("conv_id").alias("path"), "ka", "kb").join(leaves, "path").join(marked, ["ka", "kb"])
    along = stored(along, "prefixes_of_leaves")
    light = F.when(~F.col("heavy"), F.col("depth"))
    begins = along.groupBy("path").agg(F.max(light).alias("head"), F.count(light).alias("level"))
    paths = stored(leaves.join(begins, "path", "left").select("path", F.coalesce("head", zero).alias("head"), F.coalesce("level", zero).alias("level")), "paths")
    placed = along.join(paths, "path").where("depth >= head")
    first = paths.where("head = 0").select("path").first()  # the one path that begins at the root
    top = marked.where("depth = 0").select("*", F.lit(first.path if first else None).cast("long").alias("path"), zero.alias("head"), zero.alias("level")).select(*placed.columns)
    placed = stored(placed.unionByName(top).withColumn("own", (F.col("n_convs") - 1) * F.col("bytes")), "path_nodes")
    above = placed.select(F.col("ka").alias("pa"), F.col("kb").alias("pb"), F.col("conv_id").alias("parent_conv_id"), F.col("path").alias("parent_path"))
    linked = stored(placed.join(above, ["pa", "pb"], "left"), "linked_nodes")

    # rounds: the paths of a level hand their totals to those they hang on
    own = placed.groupBy("path").agg(F.sum("own").alias("saved"))
    hung = linked.where("depth = head").select("path", "level", "parent_path", (F.col("depth") - 1).alias("at")).join(own, "path").withColumn("leaves", F.lit(1).cast("long"))
    hung = stored(hung, "path_totals")
    totals: DataFrame | None = None
    done: DataFrame | None = None
    for level in range(hung.agg(F.max("level").alias("level")).first().level or 0, 0, -1):
        here = hung.where(F.col("level") == level)
        if done is not None:
            given = done.groupBy(F.col("parent_path").alias("path")).agg(F.sum("saved").alias("more_saved"), F.sum("leaves").alias("more_leaves"))
            here = here.join(given, "path", "left").select("path", "level", "parent_path", "at", (F.col("saved") + F.coalesce("more_saved", zero)).alias("saved"), (F.col("leaves") + F.coalesce("more_leaves", zero)).alias("leaves"))
        done = stored(here.select("path", "level", "parent_path", "at", "saved", "leaves"), "path_totals")
        totals = done if totals is None else totals.unionByName(done)

    # one suffix sum along all paths
    values = linked.withColumn("leaf", F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long"))
    if totals is not None:
        attached = totals.groupBy(F.col("parent_path").alias("path"), F.col("at").alias("depth")).agg(F.sum("saved").alias("more_saved"), F.sum("leaves").alias("more_leaves"))
        values = values.join(attached, ["path", "depth"], "left").withColumn("own", F.col("own") + F.coalesce("more_saved", zero)).withColumn("leaf", F.col("leaf") + F.coalesce("more_leaves", zero))
    columns = ["ka", "kb", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "path", "own", "leaf"]
    sums = running(values.select(*columns), "path", [F.col("depth").desc()], ["own", "leaf"], "suffix_sums")

    last = prefixes.groupBy("conv_id").agg(F.max_by(F.struct("ka", "kb"), "depth").alias("k"))
    ends = convs.join(last, "conv_id", "left").select(F.coalesce("k.ka", zero).alias("ka"), F.coalesce("k.kb", zero).alias("kb"), "conv_id")
    out = sums.join(_id_digests(ends), ["ka", "kb"], "left")
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.col("leaf_run").alias("n_leaves"), F.col("own_run").alias("saved_tokens"), F.coalesce("sha", nothing).alias("ends_sha256"), "path")


def digests(conversations: DataFrame) -> DataFrame:
    """The trie of the rebuilt conversations; columns as in `prefix_trie`, without path."""
    turns, convs = rebuilt(turns_of(conversations))
    return prefix_trie(turns, convs).drop("path")


# crc32 of the id's decimal text, byte by byte and bit by bit
_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(1, len(conv_id::VARCHAR) + 1), lambda i: CAST(unicode(substr(conv_id::VARCHAR, i, 1)) AS BIGINT))),
    lambda crc, c: list_reduce([xor(crc, c), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, _: xor(x >> 1, 3988292384 * (x & 1)))))"""

SQL = f"""
WITH o AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS pos, coalesce(role, '') AS role, coalesce(text, '') AS text
           FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id - conv_id % 5 AS source, {_CRC} % 9 AS h FROM (SELECT DISTINCT conv_id FROM o)),
n AS (SELECT conv_id, count(*) AS n FROM o GROUP BY conv_id),
r AS (SELECT c.conv_id, o.pos, o.role, o.text FROM c JOIN o ON o.conv_id = c.source AND o.pos <= c.h
      UNION ALL SELECT c.conv_id, 1000000 + o.pos, o.role, o.text FROM c JOIN o ON o.conv_id = c.conv_id AND o.pos > c.h),
s AS (SELECT c.conv_id, coalesce(list({{'role': r.role, 'text': r.text}} ORDER BY r.pos) FILTER (WHERE r.pos IS NOT NULL), []) AS seq FROM c LEFT JOIN r USING (conv_id) GROUP BY c.conv_id),
p AS (SELECT conv_id, seq, d AS depth, CAST(seq[1:d] AS VARCHAR) AS key, CASE WHEN d > 0 THEN CAST(seq[1:d - 1] AS VARCHAR) END AS up, CASE WHEN d > 0 THEN seq[d].text ELSE '' END AS text, len(seq) = d AS ends
      FROM (SELECT conv_id, seq, unnest(range(0, len(seq) + 1)) AS d FROM s)),
k AS (SELECT depth, key, any_value(up) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * strlen(any_value(text)) AS w,
             sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256 FROM p GROUP BY depth, key),
h AS (SELECT k.*, u.conv_id AS parent_conv_id, (SELECT count(*) FROM k x WHERE x.depth = k.depth + 1 AND x.up = k.key) AS n_children FROM k LEFT JOIN k u ON u.depth = k.depth - 1 AND u.key = k.up),
t AS (SELECT DISTINCT a.depth, a.key, b.depth AS sub_depth, b.key AS sub_key FROM p a JOIN p b ON a.conv_id = b.conv_id AND b.depth >= a.depth)
SELECT h.conv_id, h.depth, h.parent_conv_id, h.n_convs, h.n_children, CAST(sum(CASE WHEN g.n_children = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_leaves,
       CAST(sum(g.w) AS BIGINT) AS saved_tokens, h.ends_sha256
FROM h JOIN t USING (depth, key) JOIN h g ON g.depth = t.sub_depth AND g.key = t.sub_key
GROUP BY h.depth, h.key, h.conv_id, h.parent_conv_id, h.n_convs, h.n_children, h.ends_sha256
"""
