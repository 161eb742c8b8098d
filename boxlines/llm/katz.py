"""Katz backoff language model over words, with Good-Turing discounts.

P(w | h) = d(c) c(h, w) / c(h) if the pair was seen, alpha(h) P(w) if only h was, P(w) if h was not; alpha(h)
is (1 - sum of the seen) / (1 - sum of P over the seen), so each history's probabilities, the unknown word
among them, sum to exactly 1. Counts up to LOW are discounted by Katz's Good-Turing factors from the counts
of counts of the whole corpus; P itself is discounted likewise, and what that leaves is the unknown word's.
Histories are one word: of longer ones the tables would not fit the disk that the work is given (README).

Nothing of the model is ever whole in one place, and where a token stands never leaves its block:
1. Blocks of texts are stored as numbers of their distinct words. They send counts of the distinct words, by
   hash, to the words' parts, which number the words, store the sums, and send each block those of its words.
2. Blocks send their distinct pairs with counts, and with the words' counts, to the histories' parts. A
   history of more than HOT tokens is dealt to several parts by its words. Parts store the summed pairs and
   both sums of alpha, and answer each block; a hot history's sums are put together over its parts. Hot
   histories are at most MOST_HOT, as what counts as hot grows with the corpus.
3. Each block evaluates its tokens: its pairs, or else the backoff weight and its words.
Words are told apart by 64 bits of hash, and all else by the words' numbers.

Edge cases: null and empty texts have the end alone; a null id counts as the empty text in the split, and is
returned null; repeated rows are trained on and scored row by row; a text of any length is one row of its
block; other input columns are not read; an empty table gives an empty table; with no training text every
word is unknown and has probability 1.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, stored, words_of

#: Counts above are not discounted.
LOW = 5
#: Bytes of text whose pairs make a part.
PART_BYTES = 12 << 20
#: Characters of the texts whose counts travel together.
BLOCK_CHARS = 6 << 20
#: Tokens from which a history is dealt to several parts, and the most histories that are.
HOT, MOST_HOT = 2_000_000, 20_000
#: Hashes of the start and the end; words hold no white space, so none has these names.
START, END = (xxhash.xxh3_64_intdigest(x) for x in (b" start", b" end"))


def held_out(doc_id: Column, parts: int = 7, part: int = 2) -> Column:
    """Whether crc32 of the id's text leaves the remainder that is kept out of training."""
    return (F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts) == part


def discounts(counts_of_counts: list[int]) -> np.ndarray:
    """d(0..LOW), with d(0) unused, from n_1..n_(LOW+1); a factor that is not between 0 and 1 falls back to
    a half subtracted from the count."""
    n = [0, *counts_of_counts]
    out = np.array([0.0] + [(r - 0.5) / r for r in range(1, LOW + 1)])
    if n[1] > 0 and n[LOW + 1] > 0:
        common = (LOW + 1) * n[LOW + 1] / n[1]
        for r in range(1, LOW + 1):
            if n[r] > 0 and n[r + 1] > 0 and common < 1:
                d = ((r + 1) * n[r + 1] / (r * n[r]) - common) / (1 - common)
                if 0 < d < 1:
                    out[r] = d
    return out


class Unigrams:
    """P(w) by the count of w."""

    def __init__(self, tokens: int, words: int, counts_of_counts: list[int]):
        self.tokens, self.words = tokens, words
        self.d = discounts(counts_of_counts)
        left = sum((1 - self.d[r]) * r * counts_of_counts[r - 1] for r in range(1, LOW + 1))
        if not tokens:
            self.total, self.unknown = 1.0, 1.0
        elif left > 0:
            self.total, self.unknown = float(tokens), left / tokens
        else:  # every count is high: the unknown word gets one more
            self.total, self.unknown = tokens + 1.0, 1.0 / (tokens + 1.0)

    def p(self, counts: np.ndarray) -> np.ndarray:
        low = np.where(counts <= LOW, self.d[np.minimum(counts, LOW)], 1.0)
        return np.where(counts > 0, low * counts / self.total, self.unknown)

    def log10_base(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 1) / (self.tokens + self.words + 1))


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays in one compressed piece: first bytes of all numbers, then second ones, and so on."""
    sizes = np.array([len(arrays), *(x for a in arrays for x in (ord(a.dtype.kind), a.dtype.itemsize, len(a)))], dtype="<i8")
    planes = [np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.dtype.itemsize).T.tobytes() for a in arrays]
    return zstandard.ZstdCompressor(level=3).compress(sizes.tobytes() + b"".join(planes))


def _unpack(blob: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(raw, "<i8", 1)[0])
    kinds = np.frombuffer(raw, "<i8", 3 * n, 8).reshape(n, 3).tolist()
    at, out = 8 + 24 * n, []
    for kind, width, length in kinds:
        planes = np.frombuffer(raw, np.uint8, width * length, at).reshape(width, length)
        out.append(np.ascontiguousarray(planes.T).view(f"<{chr(kind)}{width}").reshape(length))
        at += width * length
    return out


def _steps(ascending: np.ndarray) -> np.ndarray:
    """An ascending array as its differences; np.cumsum gives it back."""
    return np.diff(ascending, prepend=ascending.dtype.type(0))


def _narrow(x: np.ndarray) -> np.ndarray:
    top = int(x.max(initial=0))
    return x.astype(np.uint8 if top < 256 else np.uint16 if top < 65536 else np.uint32 if top < 1 << 32 else np.uint64)


def _part(hashes: np.ndarray, parts: int) -> np.ndarray:
    return ((hashes >> np.uint64(40)) * np.uint64(parts) >> np.uint64(24)).astype(np.int64)


def _blocks(rows: DataFrame, id_type: str) -> DataFrame:
    """(block, ids, held, sizes, words, blob): texts as numbers of the block's distinct words, whose hashes are
    in ascending order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        block = TaskContext.get().partitionId() << 32
        ids, held, flat, chars = [], [], [], 0

        def made() -> pa.RecordBatch:
            words, at = np.unique(np.concatenate(flat), return_inverse=True)
            rank = np.empty(len(words), dtype=np.int64)  # frequent words get the small numbers, which pack well
            order = np.argsort(-np.bincount(at, minlength=len(words)), kind="stable")
            rank[order] = np.arange(len(words))
            columns = ([block], [ids], [held], [[len(x) - 1 for x in flat]], [_pack(_steps(words))], [_pack(_narrow(rank[at]), _narrow(order))])
            types = (pa.int64(), pa.list_(kind), pa.list_(pa.bool_()), pa.list_(pa.int64()), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, types, strict=True)], ["block", "ids", "held", "sizes", "words", "blob"])

        for batch in batches:
            kind = batch.schema.types[0]
            for doc_id, text, out in zip(*(batch.column(i) for i in range(3)), strict=True):
                text = text.as_py()
                words = words_of(text)
                if len(known) > 400_000:
                    known = {}
                for w in set(words).difference(known):
                    known[w] = xxhash.xxh3_64_intdigest(w)
                row = np.empty(len(words) + 2, dtype=np.uint64)
                row[0], row[-1] = START, END
                row[1:-1] = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
                flat.append(row), ids.append(doc_id.as_py()), held.append(out.as_py())
                chars += len(text or "")
                if chars >= BLOCK_CHARS or len(ids) >= 60_000:
                    yield made()
                    block += 1
                    ids, held, flat, chars = [], [], [], 0
        if ids:
            yield made()

    return rows.mapInArrow(run, f"block long, ids array<{id_type}>, held array<boolean>, sizes array<long>, words binary, blob binary")


class _Block:
    """For each token of a block its history, word, row, and whether the row trains."""

    def __init__(self, blob: bytes, held: np.ndarray, sizes: np.ndarray):
        ranks, order = _unpack(blob)
        flat, sizes = order.astype(np.int64)[ranks], np.asarray(sizes, dtype=np.int64)
        inner = np.ones(len(flat), dtype=bool)
        inner[np.cumsum(sizes + 1) - 1] = False  # an end is no history
        at = np.flatnonzero(inner)
        self.history, self.word, self.row = flat[at], flat[at + 1], np.repeat(np.arange(len(sizes)), sizes)
        self.train = ~np.asarray(held, dtype=bool)[self.row]

    def pairs(self, ids: np.ndarray, parts: int, hot: dict[int, int]) -> None:
        """Distinct pairs in the order in which they are sent, and each token's; ids numbers the words."""
        pair, at = np.unique(self.history << 32 | self.word, return_inverse=True)
        h, w = pair >> 32, pair & 0xFFFFFFFF
        part = ids[h] % parts
        if hot:
            salts = np.array([hot.get(x, 1) for x in ids.tolist()], dtype=np.int64)[h]
            part = (part + ids[w] % salts * np.maximum(parts // salts, 1)) % parts
        order = np.lexsort((ids[w], ids[h], part))
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.arange(len(order))
        self.h, self.w, self.part, self.at = h[order], w[order], part[order], place[at]
        self.names = np.unique(self.part)
        self.cuts = np.append(np.searchsorted(self.part, self.names), len(self.part))


def _word_counts(blocks: DataFrame, parts: int) -> DataFrame:
    """(part, block, blob): words of blocks, their training counts and their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                b = _Block(row["blob"], row["held"], row["sizes"])
                words = np.cumsum(_unpack(row["words"])[0])
                n = len(words)
                trained, every = np.bincount(b.word, b.train, n).astype(np.int64), np.bincount(b.word, minlength=n)
                part = _part(words, parts)  # ascending, as the words are
                names = np.unique(part)
                cuts = np.append(np.searchsorted(part, names), n)
                blobs = [_pack(_steps(words[x:y]), _narrow(trained[x:y]), _narrow(every[x:y])) for x, y in zip(cuts, cuts[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([pa.array(names.astype(np.int32)), pa.array(np.full(len(names), row["block"])), pa.array(blobs, pa.binary())], ["part", "block", "blob"])

    return blocks.select("block", "held", "sizes", "words", "blob").mapInArrow(run, "part int, block long, blob binary")


_SUMS = "kind string, part int, block long, blob binary, h long, sums array<double>"


def _rows(**columns: list) -> pd.DataFrame:
    n = len(next(iter(columns.values())))
    return pd.DataFrame({c: columns.get(c, [None] * n) for c in ("kind", "part", "block", "blob", "h", "sums")}).astype({"part": "Int32", "block": "Int64", "h": "Int64"})


def _sum_words(parts: int, hot_from: float, n_rows: int):
    """Of one part: an answer to each block, the table of counts, the hot words, and counts of counts. The
    i-th word of part p has the number i * parts + p."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        blobs = [_unpack(b) for b in rows["blob"]]
        table, at = np.unique(np.concatenate([np.cumsum(b[0]) for b in blobs]), return_inverse=True)
        counts, every = (np.bincount(at, np.concatenate([b[i] for b in blobs]), len(table)).astype(np.int64) for i in (1, 2))
        every[table == START] = n_rows  # a history of each row, and no word
        ends = np.cumsum([0, *(len(b[0]) for b in blobs)])
        part = int(rows["part"].iloc[0])
        hot = np.flatnonzero(every > hot_from)
        stats = [float(counts.sum()), float((counts > 0).sum()), *(float((counts == r).sum()) for r in range(1, LOW + 2))]
        answers = _rows(kind=["answer"] * len(blobs), part=[part] * len(blobs), block=rows["block"].tolist(), blob=[_pack(_narrow(at[a:b]), _narrow(counts[at[a:b]])) for a, b in zip(ends, ends[1:], strict=False)])
        told = _rows(kind=["table", "stats"], part=[part] * 2, blob=[_pack(_steps(table), _narrow(counts)), None], sums=[None, stats])
        return pd.concat([answers, told, _rows(kind=["hot"] * len(hot), h=(hot * parts + part).tolist(), sums=[[float(x)] for x in every[hot]])])

    return run


def _words(answers: pd.DataFrame, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and counts of a block's words, from the parts' answers."""
    told = [(p, *_unpack(b)) for p, b in answers.sort_values("part")[["part", "blob"]].itertuples(index=False)]
    return np.concatenate([i.astype(np.int64) * parts + p for p, i, _ in told]), np.concatenate([c for *_, c in told]).astype(np.int64)


def _pairs(parts: int, hot: dict[int, int]):
    """Of one block: its pairs, dealt to parts. A history once, with the number of its pairs; for each pair
    its word, its training count, and the word's."""

    def run(block: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        told = block.iloc[0]
        b = _Block(told["blob"], told["held"], told["sizes"])
        ids, c_w = _words(answers, parts)
        b.pairs(ids, parts, hot)
        trained = np.bincount(b.at, b.train, len(b.h)).astype(np.int64)
        blobs = []
        for x, y in zip(b.cuts, b.cuts[1:], strict=False):
            heads = np.flatnonzero(np.append(True, b.h[x + 1 : y] != b.h[x : y - 1]))
            blobs.append(_pack(_narrow(_steps(ids[b.h[x:y][heads]])), _narrow(np.diff(np.append(heads, y - x))), _narrow(ids[b.w[x:y]]), _narrow(trained[x:y]), _narrow(c_w[b.w[x:y]])))
        return pd.DataFrame({"part": b.names.astype(np.int32), "block": told["block"], "blob": blobs})

    return run


def _sum_pairs(unigrams: Unigrams, hot: dict[int, int]):
    """Of one part: an answer to each block, the table of pairs, a hot history's sums as far as they lie here,
    and counts of counts. An answer has each pair's count, and of each history that is not hot twice its count
    and whether none of its counts is low; of those with a pair unseen, also the low counts' counts and what
    the words seen after it leave of P."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        blobs = [_unpack(b) for b in rows["blob"]]
        part = int(rows["part"].iloc[0])
        histories, h_at = np.unique(np.concatenate([np.cumsum(b[0].astype(np.int64)) for b in blobs]), return_inverse=True)
        h = np.repeat(h_at, np.concatenate([b[1] for b in blobs]).astype(np.int64))
        w = np.concatenate([b[2].astype(np.int64) for b in blobs])
        order = np.lexsort((w, h))
        fresh = np.append(True, (h[order][1:] != h[order][:-1]) | (w[order][1:] != w[order][:-1]))
        at = np.empty(len(order), dtype=np.int64)
        at[order] = np.cumsum(fresh) - 1
        first = order[fresh]
        ph, pw, c_w = h[first], w[first], np.concatenate([b[4] for b in blobs])[first].astype(np.int64)
        c = np.bincount(at, np.concatenate([b[3] for b in blobs]), len(first)).astype(np.int64)
        seen, n = c > 0, len(histories)
        c_h = np.bincount(ph, c, n).astype(np.int64)
        low = np.stack([np.bincount(ph[c == r], minlength=n) for r in range(1, LOW + 2)], axis=1)
        taken = np.bincount(ph[seen], unigrams.p(c_w[seen]), n)
        is_hot = np.array([x in hot for x in histories.tolist()], dtype=bool)
        rigid = (low[:, :LOW].sum(axis=1) == 0) & (c_h > 0)
        answers, i, j = [], 0, 0
        for b in blobs:
            mine, own = at[j : j + len(b[2])], h_at[i : i + len(b[0])]
            unseen = np.add.reduceat(~seen[mine], np.cumsum(b[1].astype(np.int64)) - b[1]) > 0
            plain = own[~is_hot[own]]
            more = own[unseen & ~is_hot[own] & (c_h[own] > 0)]
            answers.append(_pack(_narrow(c[mine]), _narrow(2 * c_h[plain] + rigid[plain]), _narrow(low[more][:, :LOW].ravel()), taken[more]))
            i, j = i + len(b[0]), j + len(b[2])
        stats = low[~is_hot & ~rigid].sum(axis=0).astype(float).tolist()
        some = np.flatnonzero(is_hot)
        told = _rows(kind=["table", "stats"], part=[part] * 2, blob=[_pack(_narrow(_steps(histories)), _narrow(np.bincount(ph, minlength=n)), _narrow(pw), _narrow(c)), None], sums=[None, stats])
        sums = [[float(c_h[x]), float(taken[x]), *low[x].astype(float).tolist()] for x in some]
        return pd.concat([_rows(kind=["answer"] * len(blobs), part=[part] * len(blobs), block=rows["block"].tolist(), blob=answers), told, _rows(kind=["hot"] * len(some), h=histories[some].tolist(), sums=sums)])

    return run


def _evaluate(parts: int, hot: dict[int, int], hot_sums: dict[int, list[float]], unigrams: Unigrams, pair_counts: list[float]):
    """Of one block: the rows' scores."""
    d = discounts(pair_counts)
    low_mass = (1 - d[1:]) * np.arange(1, LOW + 1)

    def run(block: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        row = block.iloc[0]
        b = _Block(row["blob"], row["held"], row["sizes"])
        ids, c_w = _words(told[told["level"] == 1], parts)
        b.pairs(ids, parts, hot)
        c, c_h, rigid, low, taken = (np.zeros(len(b.h), dtype=t) for t in (np.int64, np.int64, bool, np.float64, np.float64))
        is_hot = np.array([x in hot for x in ids.tolist()], dtype=bool)
        answers = [_unpack(x) for x in told[told["level"] == 2].sort_values("part")["blob"]]
        for x, y, (counts, twice, low_counts, of_p) in zip(b.cuts, b.cuts[1:], answers, strict=False):
            c[x:y] = counts
            heads = np.flatnonzero(np.append(True, b.h[x + 1 : y] != b.h[x : y - 1]))
            sizes = np.diff(np.append(heads, y - x))
            unseen = np.add.reduceat(c[x:y] == 0, heads) > 0
            plain = ~is_hot[b.h[x:y][heads]]
            of_h = np.zeros(len(heads), dtype=np.int64)
            of_h[plain] = twice
            more = plain & unseen & (of_h > 1)
            mass = np.zeros((len(heads), 2))
            mass[more, 0], mass[more, 1] = low_counts.reshape(-1, LOW) @ low_mass, of_p
            c_h[x:y], rigid[x:y] = np.repeat(of_h >> 1, sizes), np.repeat(of_h & 1, sizes).astype(bool)
            low[x:y], taken[x:y] = np.repeat(mass, sizes, axis=0).T
        for i in np.flatnonzero(is_hot[b.h]).tolist():
            n, p, *counts = hot_sums[int(ids[b.h[i]])]
            c_h[i], taken[i], rigid[i], low[i] = n, p, n > 0 and not any(counts[:LOW]), np.dot(counts[:LOW], low_mass)
        seen, total = c > 0, np.where(rigid, c_h + 1, c_h)
        kept = np.where((c <= LOW) & ~rigid, d[np.minimum(c, LOW)], 1.0)
        left = np.where(rigid, 1.0, low)
        with np.errstate(divide="ignore", invalid="ignore"):
            backed = np.where(c_h > 0, np.log10(left / total / (1.0 - taken)), 0.0)
            value = np.where(seen, np.log10(kept * c / total), backed + np.log10(unigrams.p(c_w))[b.w])
        n = len(row["sizes"])
        of_row = lambda x: np.bincount(b.row, x, n)
        base, score = of_row(unigrams.log10_base(c_w)[b.word]), of_row(value[b.at])
        return pd.DataFrame({"doc_id": list(row["ids"]), "held_out": list(row["held"]), "n_tokens": list(row["sizes"]), "n_known": of_row(c_w[b.word] > 0).astype(np.int64), "train_tokens": unigrams.tokens, "base_score": base, "score": score})

    return run


def _total(table: DataFrame, n: int) -> list:
    """The sums of the parts' statistics."""
    return list(table.where("kind = 'stats'").agg(*(F.coalesce(F.sum(F.col("sums")[i]), F.lit(0.0)).alias(f"s{i}") for i in range(n))).first())


def score(docs: DataFrame, held_parts: int = 7, held: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score for every row of docs."""
    bounded_batches(docs.sparkSession)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), held_out(F.col("doc_id"), held_parts, held).alias("held"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    blocks = stored(_blocks(rows, id_type), "blocks")
    size, n_rows = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count("*")).first()
    parts = max(1, math.ceil(size / PART_BYTES))
    hot_from = max(HOT, (size + n_rows) / MOST_HOT)  # no word stands so often in more than MOST_HOT of them
    words = stored(_word_counts(blocks, parts).groupBy("part").applyInPandas(_sum_words(parts, hot_from, n_rows), _SUMS), "words", ("kind",))
    told = [int(x) for x in _total(words, LOW + 3)]
    unigrams = Unigrams(told[0], told[1], told[2:])
    hot = {r.h: math.ceil(r.sums[0] / hot_from) for r in words.where("kind = 'hot'").select("h", "sums").collect()}  # MOST_HOT at most
    told_of = blocks.select("block", "ids", "held", "sizes", "blob").groupBy("block")
    answers = words.where("kind = 'answer'").select("block", "part", "blob")
    sent = told_of.cogroup(answers.groupBy("block")).applyInPandas(_pairs(parts, hot), "part int, block long, blob binary")
    pairs = stored(sent.groupBy("part").applyInPandas(_sum_pairs(unigrams, hot), _SUMS), "pairs", ("kind",))
    sums = pairs.where("kind = 'hot'").groupBy("h").agg(*(F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(LOW + 3))).collect()
    hot_sums = {r.h: list(r[1:]) for r in sums}
    pair_counts = np.array(_total(pairs, LOW + 1))
    for s in hot_sums.values():
        if any(s[2 : 2 + LOW]):
            pair_counts += s[2:]
    both = answers.withColumn("level", F.lit(1)).unionByName(pairs.where("kind = 'answer'").select("block", "part", "blob").withColumn("level", F.lit(2)))
    out = f"doc_id {id_type}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return told_of.cogroup(both.groupBy("block")).applyInPandas(_evaluate(parts, hot, hot_sums, unigrams, pair_counts.tolist()), out)
