"""N-gram Jaccard join by a blocked sparse product of the document by n-gram incidence.

1. Texts with equal shingle sets are one class; classes are the rows of the incidence matrix.
2. Its entries go in blocks to parts of the n-gram space, where n-grams of one class alone are dropped (they
   overlap with nothing) and the others get their document frequency.
3. Back at its class, each row is ordered rarest first. A pair that links must share an n-gram in the first
   |x| - ceil(3|x|/4) + 1 of both, so rows whose rare n-grams fill that prefix are done. The others meet in
   the lists of their prefix n-grams, cut where sizes differ by more than the threshold allows, and are
   chained, not paired: groups of connected chains hold every pair that can link.
4. In each group the most typical row meets all others. Rows that it links need not meet each other. The rest
   meet all rows of the group whose sizes the bound allows, in blocks: overlap counts are accumulated over
   slices of the n-grams, pairs below the bound are discarded, and a block hands on a spanning forest of its
   links in place of all pairs.
Components are exact up to equal 64-bit hashes of different shingles or classes.

Edge cases: texts that are null or have no words have an empty set and are linked with nothing; texts of
under five words have their whole sequence as one shingle; rows that agree in id and text are one document;
rows with one id and different texts are linked through the id; a row without id gets its size and a null
component; an empty table gives an empty table; other input columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, quoted, stored, words_of
from .graph import connected_components

WIDTH = 5
#: Incidence entries of a part or bucket: what one task holds at a time.
PART_ENTRIES = 2_000_000
#: Characters of the texts whose entries travel together.
BLOCK_CHARS = 6 << 20
#: Entries of a block in the product.
PRODUCT_ENTRIES = 130_000
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


class Shingles:
    """Distinct shingles of texts as sorted 64-bit hashes."""

    def __init__(self, width: int = WIDTH):
        self.width = width
        self.hashes = _WordHashes()

    def sets(self, texts: list[str | None]) -> list[np.ndarray]:
        if len(self.hashes) > 400_000:
            self.hashes.clear()
        words = [words_of(t) for t in texts]
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        flat = np.fromiter((h for ws in words for h in map(self.hashes.__getitem__, ws)), np.uint64, int(lengths.sum()))
        starts = np.cumsum(lengths) - lengths
        rolled = flat[: max(len(flat) - self.width + 1, 0)].copy()
        for i in range(1, self.width):
            rolled *= _MULTIPLIER
            rolled += flat[i : len(flat) - self.width + 1 + i]
        rolled ^= rolled >> np.uint64(29)
        rolled *= np.uint64(0xBF58476D1CE4E5B9)
        rolled ^= rolled >> np.uint64(32)
        out = []
        for at, n in zip(starts.tolist(), lengths.tolist(), strict=True):
            if n >= self.width:
                out.append(np.unique(rolled[at : at + n - self.width + 1]))
            elif n:
                out.append(np.array([xxhash.xxh3_64_intdigest(flat[at : at + n].tobytes(), seed=n)], dtype=np.uint64))
            else:
                out.append(np.zeros(0, np.uint64))
        return out


def _digest(shingles: np.ndarray) -> bytes | None:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest() if len(shingles) else None


def _key(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "little", signed=True)


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles long, key long): size and class of each row's set; no class for an empty set."""
    bounded_batches(docs.sparkSession)
    source = docs.select("doc_id", F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles()
        for batch in batches:
            sets = shingles.sets(batch.column(1).to_pylist())
            digests = [_digest(s) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([None if d is None else _key(d) for d in digests], pa.int64())],
                ["doc_id", "n_shingles", "key"],
            )

    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, n_shingles long, key long")


def _incidence(rows: DataFrame, parts: int) -> DataFrame:
    """(part, blob): the entries (n-gram, class) of the rows (key, text), in blocks, dealt by n-gram."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles()
        keys: list[int] = []
        sets: list[np.ndarray] = []
        size = 0

        def block() -> pa.RecordBatch:
            lengths = np.fromiter(map(len, sets), np.uint32, len(sets))
            flat = np.concatenate(sets)
            owner = np.repeat(np.arange(len(sets), dtype=np.uint16), lengths)
            part = ((flat >> np.uint64(48)) * np.uint64(parts) >> np.uint64(16)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            flat, owner, part = flat[order], owner[order], part[order]
            key_of = np.array(keys, dtype="<i8")
            names = np.unique(part)
            cuts = [*np.searchsorted(part, names).tolist(), len(part)]
            blobs = []
            for a, b in zip(cuts, cuts[1:], strict=False):
                low = flat[a:b] & np.uint64(0xFFFFFFFFFFFF)
                some, at = np.unique(owner[a:b], return_inverse=True)  # the rows that have an entry here
                blobs.append(np.array([len(some), b - a], dtype="<u4").tobytes() + key_of[some].tobytes() + lengths[some].astype("<u4").tobytes() + (low & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes() + (low >> np.uint64(32)).astype("<u2").tobytes() + at.astype("<u2").tobytes())
            return pa.RecordBatch.from_arrays([pa.array(names.astype(np.int32)), pa.array(blobs, pa.binary())], ["part", "blob"])

        for batch in batches:
            told, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a in range(0, len(texts), 500):
                for key, text, found in zip(told[a : a + 500], texts[a : a + 500], shingles.sets(texts[a : a + 500]), strict=True):
                    if len(found) and _key(_digest(found)) == key:  # not so for another text with this id
                        keys.append(key)
                        sets.append(found)
                        size += len(text)
                    if size >= BLOCK_CHARS or len(keys) >= 60_000:
                        yield block()
                        keys, sets, size = [], [], 0
        if keys:
            yield block()

    return rows.select("key", "text").mapInArrow(run, "part int, blob binary")


def _repeated(buckets: int):
    """For one part: entries whose n-gram stands in several classes, with its frequency, dealt by class."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        part = np.uint64(rows["part"].iloc[0])
        keys, sizes, grams = [], [], []
        for blob in rows["blob"]:
            n, m = np.frombuffer(blob, "<u4", 2).tolist()
            at = 8
            block_keys = np.frombuffer(blob, "<i8", n, at)
            block_sizes = np.frombuffer(blob, "<u4", n, at + 8 * n)
            at += 12 * n
            low, high, owner = np.frombuffer(blob, "<u4", m, at), np.frombuffer(blob, "<u2", m, at + 4 * m), np.frombuffer(blob, "<u2", m, at + 6 * m)
            grams.append(high.astype(np.uint64) << np.uint64(32) | low)
            keys.append(block_keys[owner])
            sizes.append(block_sizes[owner])
        gram, key, size = np.concatenate(grams), np.concatenate(keys), np.concatenate(sizes)
        order = np.lexsort((key, gram))
        gram, key, size = gram[order], key[order], size[order]
        fresh = np.append(True, (gram[1:] != gram[:-1]) | (key[1:] != key[:-1]))
        gram, key, size = gram[fresh], key[fresh], size[fresh]
        heads = np.flatnonzero(np.append(True, gram[1:] != gram[:-1]))
        df = np.diff(np.append(heads, len(gram)))
        df = np.repeat(df, df)
        some = df > 1
        gram, key, size, df = gram[some], key[some], size[some], np.minimum(df[some], 65535)
        bucket = (key.view(np.uint64) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        gram, key, size, df, bucket = gram[order], key[order], size[order], df[order], bucket[order]
        names = np.unique(bucket)
        cuts = [*np.searchsorted(bucket, names).tolist(), len(bucket)]
        blobs = [key[a:b].astype("<i8").tobytes() + (gram[a:b] | part << np.uint64(48)).astype("<u8").tobytes() + size[a:b].astype("<u4").tobytes() + df[a:b].astype("<u2").tobytes() for a, b in zip(cuts, cuts[1:], strict=False)]
        return pd.DataFrame({"bucket": names.astype(np.int32), "blob": blobs})

    return run


_CANDIDATES = "kind int, a long, b long, gram long, lo long, hi long, typical double, grams binary"


def _candidates(rows: pd.DataFrame) -> pd.DataFrame:
    """For one bucket of classes: kind 0, a class that may link (a, size lo, how typical, its shared
    n-grams); kind 1, a stretch of sizes (lo to hi) in which the bucket's classes stand in the list of a
    prefix n-gram, named by one of them (a); kind 2, a chain (a, b) within such a stretch."""
    n = [len(b) // 22 for b in rows["blob"]]
    key = np.concatenate([np.frombuffer(b, "<i8", m) for b, m in zip(rows["blob"], n, strict=True)])
    gram = np.concatenate([np.frombuffer(b, "<u8", m, 8 * m) for b, m in zip(rows["blob"], n, strict=True)])
    size = np.concatenate([np.frombuffer(b, "<u4", m, 16 * m) for b, m in zip(rows["blob"], n, strict=True)]).astype(np.int64)
    df = np.concatenate([np.frombuffer(b, "<u2", m, 20 * m) for b, m in zip(rows["blob"], n, strict=True)])
    order = np.lexsort((gram, df, key))
    key, gram, size, df = key[order], gram[order], size[order], df[order]
    heads = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    counts = np.diff(np.append(heads, len(key)))
    total = size[heads]
    prefix = total - (3 * total + 3) // 4 + 1 - (total - counts)  # what unique n-grams leave of the prefix
    place = np.arange(len(key)) - np.repeat(heads, counts)
    typical = np.add.reduceat(np.log2(df), heads) / total if len(heads) else np.zeros(0)
    made: dict[str, list] = {"kind": [], "a": [], "b": [], "gram": [], "lo": [], "hi": [], "typical": [], "grams": []}

    def add(kind: int, a: np.ndarray, b=None, gram=None, lo=None, hi=None, typical=None, grams=None) -> None:
        zeros = np.zeros(len(a), np.int64)
        for name, x in (("kind", zeros + kind), ("a", a), ("b", b), ("gram", gram), ("lo", lo), ("hi", hi)):
            made[name].append(zeros if x is None else x)
        made["typical"].append(zeros.astype(float) if typical is None else typical)
        made["grams"] += [b""] * len(a) if grams is None else grams

    live = np.flatnonzero(prefix > 0)
    add(0, key[heads[live]], lo=total[live], typical=typical[live], grams=[np.sort(gram[heads[i] : heads[i] + counts[i]]).astype("<u8").tobytes() for i in live])
    inside = place < np.repeat(prefix, counts)
    gram, key, size = gram[inside], key[inside], size[inside]
    order = np.lexsort((key, size, gram))
    gram, key, size = gram[order], key[order], size[order]
    if len(gram):
        joined = (gram[1:] == gram[:-1]) & (3 * size[1:] <= 4 * size[:-1])
        first = np.flatnonzero(np.append(True, ~joined))
        last = np.append(first[1:], len(gram)) - 1
        add(1, key[first], gram=gram[first].view(np.int64), lo=size[first], hi=size[last])
        leader = np.repeat(key[first], last - first + 1)
        chained = np.flatnonzero(np.append(False, joined))
        pairs = np.unique(np.stack([leader[chained], key[chained]], axis=1), axis=0)
        add(2, pairs[:, 0], b=pairs[:, 1])
    return pd.DataFrame({c: x if c == "grams" else np.concatenate(x) if x else [] for c, x in made.items()}).astype({"kind": np.int32})


def _chains(candidates: DataFrame) -> DataFrame:
    """Edges (a, b) which connect all classes that can link."""
    spans = candidates.where("kind = 1").select("gram", "lo", "hi", F.col("a").alias("key"))

    by = Window.partitionBy("gram").orderBy("lo", "hi", "key")
    before = F.max("hi").over(by.rowsBetween(Window.unboundedPreceding, -1))
    across = spans.withColumn("before", before).withColumn("a", F.lag("key").over(by)).where(3 * F.col("lo") <= 4 * F.col("before")).select("a", F.col("key").alias("b"))
    return candidates.where("kind = 2").select("a", "b").unionByName(across).distinct()


def _linked(n_a: np.ndarray | int, n_b: np.ndarray | int, overlap: np.ndarray | int) -> np.ndarray | bool:
    return 100 * overlap >= 75 * (n_a + n_b - overlap)


def _overlaps(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Shared n-grams of each row of a with each of b: the sparse product of two blocks, column by column.
    A column adds one where its rows of a and of b meet; columns that stand in the same rows go together."""
    out = np.zeros((len(a), len(b)), dtype=np.int64)
    rng = np.random.default_rng(0)
    sides = []
    for side in (a, b):
        flat, owner = np.concatenate(side), np.repeat(np.arange(len(side)), [len(x) for x in side])
        order = np.argsort(flat, kind="stable")
        flat, owner = flat[order], owner[order]
        heads = np.flatnonzero(np.append(True, flat[1:] != flat[:-1])) if len(flat) else np.zeros(0, np.int64)
        marks = rng.integers(1, 1 << 62, len(side), dtype=np.uint64)
        pattern = np.add.reduceat(marks[owner], heads) if len(heads) else np.zeros(0, np.uint64)
        sides.append((flat[heads] if len(heads) else flat, owner, np.append(heads, len(flat)), pattern))
    (cols_a, owner_a, ends_a, pattern_a), (cols_b, owner_b, ends_b, pattern_b) = sides
    _, at_a, at_b = np.intersect1d(cols_a, cols_b, assume_unique=True, return_indices=True)
    both = np.stack([pattern_a[at_a], pattern_b[at_b]], axis=1)
    _, first, times = np.unique(both, axis=0, return_index=True, return_counts=True)
    for i, n in zip(first.tolist(), times.tolist(), strict=True):
        x, y = at_a[i], at_b[i]
        rows, others = owner_a[ends_a[x] : ends_a[x + 1]], owner_b[ends_b[y] : ends_b[y + 1]]
        out[rows[:, None], others] += n
    return out


def _meet_leader(pairs: DataFrame) -> DataFrame:
    """Whether each class links to its group's leader: the product of the members that came together with
    that one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pydict()
            linked = [False] * batch.num_rows
            by_leader: dict[tuple, list[int]] = {}
            for i, (n, m) in enumerate(zip(rows["size"], rows["leader_size"], strict=True)):
                if 4 * min(n, m) >= 3 * max(n, m):
                    by_leader.setdefault((rows["group"][i], rows["leader"][i]), []).append(i)
            for at in by_leader.values():
                for start in range(0, len(at), 512):
                    some = at[start : start + 512]
                    overlap = _overlaps([np.frombuffer(rows["grams"][i], "<u8") for i in some], [np.frombuffer(rows["leader_grams"][some[0]], "<u8")])[:, 0]
                    for i, n in zip(some, overlap.tolist(), strict=True):
                        linked[i] = bool(_linked(rows["size"][i], rows["leader_size"][i], n))
            yield pa.RecordBatch.from_arrays([batch.column("group"), batch.column("key"), batch.column("leader"), pa.array(linked, pa.bool_())], ["group", "key", "leader", "linked"])

    return pairs.select("group", "key", "leader", "size", "leader_size", "grams", "leader_grams").mapInArrow(run, "group long, key long, leader long, linked boolean")


def _product(a: list[dict], b: list[dict]) -> list[tuple[int, int]]:
    """A spanning forest of the links between two blocks of rows (key, size, grams)."""
    overlap = _overlaps(*([np.frombuffer(x["grams"], "<u8") for x in side] for side in (a, b)))
    n_a, n_b = np.array([x["size"] for x in a]), np.array([x["size"] for x in b])
    links = np.argwhere(_linked(n_a[:, None], n_b[None, :], overlap))
    root = list(range(len(a) + len(b)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    out = []
    for i, j in links.tolist():
        x, y = find(i), find(len(a) + j)
        if x != y:
            root[y] = x
            out.append((a[i]["key"], b[j]["key"]))
    return out


def _meet_rest(pairs: DataFrame) -> DataFrame:
    """Links (a, b) of the pairs of blocks (left, right)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                found = _product(batch.column(0)[i].as_py(), batch.column(1)[i].as_py())
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], ["a", "b"])

    return pairs.select("left", "right").mapInArrow(run, "a long, b long")


def links(docs: DataFrame, sig: DataFrame) -> DataFrame:
    """Edges (a, b) between classes; their components are those of all links. sig: signatures(docs)."""
    classes = sig.where("key IS NOT NULL AND doc_id IS NOT NULL").groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.max("n_shingles").alias("size"))
    classes = stored(classes, "classes")
    entries = classes.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("n")).first().n
    parts = min(65_536, max(1, math.ceil(entries / PART_ENTRIES)))
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(classes.select("doc_id", "key").hint("shuffle_hash"), "doc_id")
    shared = _incidence(texts, parts).groupBy("part").applyInPandas(_repeated(parts), "bucket int, blob binary")
    candidates = stored(shared.groupBy("bucket").applyInPandas(_candidates, _CANDIDATES), "candidates")
    groups = connected_components(_chains(candidates)).withColumnRenamed("label", "group").withColumnRenamed("node", "key")
    rows = candidates.where("kind = 0").select(F.col("a").alias("key"), F.col("lo").alias("size"), "typical", "grams")

    # the most typical row of each group meets the others
    placed = stored(rows.drop("grams").join(groups, "key"), "groups")
    told = placed.groupBy("group").agg(F.max(F.struct("typical", "key"))["key"].alias("leader"), F.count("*").alias("n"), F.sum("size").alias("entries"))
    told = stored(told.withColumn("salts", F.ceil(F.col("n") / 256).cast("int")), "leaders")
    leaders = rows.select(F.col("key").alias("leader"), F.col("size").alias("leader_size"), F.col("grams").alias("leader_grams")).join(told.select("leader", "group", "salts"), "leader")
    leaders = leaders.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
    members = rows.join(placed.join(told.select("group", "salts", F.col("leader").alias("first")), "group").where("key <> first").select("key", "group", F.pmod(F.xxhash64("key"), F.col("salts")).cast("int").alias("salt")), "key")
    met = stored(_meet_leader(members.join(leaders, ["group", "salt"])), "met")

    # rows that it doesn't link meet all rows of their group whose sizes the bound allows, in blocks
    rest = met.where(~F.col("linked"))
    open_groups = stored(rest.select("group").distinct().join(told.select("group", "entries"), "group"), "open")
    step = F.floor(F.log(F.col("size").cast("double")) / F.lit(math.log(4 / 3)) + F.lit(1e-9)).cast("int")
    blocks = F.pmod(F.xxhash64("key"), F.ceil(F.col("entries") / PRODUCT_ENTRIES)).cast("int")
    inside = placed.join(open_groups, "group").select("key", "group", step.alias("step"), blocks.alias("block"))
    inside = rows.drop("typical").join(inside.join(rest.select("key", F.lit(True).alias("alone")), "key", "left"), "key")
    inside = stored(inside, "rest")
    row = F.struct("key", "size", "grams")
    right = inside.groupBy("group", "step", "block").agg(F.collect_list(row).alias("right"))  # PRODUCT_ENTRIES or so
    left = inside.where("alone").groupBy("group", "step", "block").agg(F.collect_list(row).alias("left"))
    left = left.select("group", "left", F.explode(F.array(F.col("step") - 1, F.col("step"), F.col("step") + 1)).alias("step"))
    found = stored(_meet_rest(left.join(right, ["group", "step"])), "links")
    return met.where("linked").select(F.col("leader").alias("a"), F.col("key").alias("b")).unionByName(found)


def components(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row."""
    sig = stored(signatures(docs), "signatures")
    found = links(docs, sig)
    # rows that share an id tie their classes together
    tied = sig.where("key IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("key").alias("a"), F.max("key").alias("b")).where("a <> b").select("a", "b")
    labels = connected_components(found.unionByName(tied))
    named = sig.join(labels.withColumnRenamed("node", "key"), "key", "left").withColumn("label", F.coalesce("label", "key"))
    least = named.where("label IS NOT NULL AND doc_id IS NOT NULL").groupBy("label").agg(F.min("doc_id").alias("component_id"))
    out = named.join(least, "label", "left")
    alone = F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", alone.alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of docs for each component, that of its least doc_id: of its rows every different text,
    of those that agree in the text too the one whose other columns have the least hash. Rows without id all
    stay."""
    kept = components(docs).where("doc_id = component_id").select("doc_id").distinct()
    named = docs.where("doc_id IS NOT NULL").join(kept.hint("shuffle_hash"), "doc_id", "left_semi")
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    first = [F.min_by(F.struct(*quoted(rest)), F.xxhash64(*quoted(rest))).alias("__rest")] if rest else []
    one = named.groupBy("doc_id", "text").agg(*first) if rest else named.distinct()
    return one.select(*(F.col("__rest").getField(c).alias(c) if c in rest else F.col(c) for c in docs.columns)).unionByName(docs.where("doc_id IS NULL"))


SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN text_words IS NULL OR len(text_words) = 0 THEN [] WHEN len(text_words) < 5 THEN [array_to_string(text_words, ' ')]
             ELSE list_transform(range(1, len(text_words) - 3), lambda i: array_to_string(text_words[i:i + 4], ' ')) END) AS grams
      FROM (SELECT doc_id, ws AS text_words FROM w)),
n AS (SELECT doc_id, CAST(len(grams) AS BIGINT) AS n_shingles FROM s),
g AS (SELECT doc_id, unnest(grams) AS gram FROM s),
o AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS overlap FROM g x JOIN g y ON x.gram = y.gram AND x.doc_id <> y.doc_id GROUP BY x.doc_id, y.doc_id),
e AS (SELECT a, b FROM o JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * overlap >= 75 * (p.n_shingles + q.n_shingles - overlap)),
r AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b)
SELECT n.doc_id, n.n_shingles, min(r.b) AS component_id FROM n JOIN r ON r.a = n.doc_id GROUP BY n.doc_id, n.n_shingles
"""
