"""Byte-level BPE by corpus-level merge replay, and its inverse.

Each task takes a block of its documents, gathers the distinct pre-tokens of the block, and replays the
merge list over all of them at once: an inverted index leads from each token pair (named by the rank that
joins it) to the word positions where it stands; ranks are taken in ascending order, every position of a
rank is merged from left to right, and only the two pairs that touch a merged position are looked up anew.
Words never interact, so blocks need no shuffle and give the same ids at any block size. A pre-token that is
a token itself needs no replay.

Edge cases: null and empty texts give no ids; repeated rows are encoded alike, row by row; an empty table
gives an empty table; a text of any length is one row of a block, whose pre-tokens alone are held; pairs of
one rank that overlap are merged from the left; input columns that are not asked for are not read, so other
columns of any name do no harm.
"""

from __future__ import annotations

import base64
import heapq
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from .common import bounded_batches

#: Distinct chunks remembered by a worker between blocks; beyond it the memory starts afresh.
REMEMBERED = 300_000
#: Longer chunks are forgotten after their block.
LONG_CHUNK = 64
#: Characters of a block.
BLOCK_CHARS = 16 << 20
#: Texts are cut at a space between two of these before the pattern is applied: no match spans such a place.
_SPACE = frozenset(map(chr, (9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
_RARE = re.compile("[" + "".join(sorted(c for c in _SPACE if ord(c) > 127)) + "]")
_MARKS = frozenset(".,;:!?")
_ASCII_PAIRS = tuple(p for c in "\t\n\v\f\r " for p in {c + " ", " " + c})


def _wide(text: str) -> bool:
    """Whether a space stands at an end of the text or beside white space."""
    return text[0] == " " or text[-1] == " " or any(p in text for p in _ASCII_PAIRS) or not text.isascii() and _RARE.search(text) is not None


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a rank file (base64 token, space, rank)."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class MergeReplay:
    """Encodes pre-tokens under a rank table, many at a time."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        vocabulary: list[bytes] = [b""] * (max(ranks.values()) + 1)
        joins = {}
        for token, rank in ranks.items():
            vocabulary[rank] = token
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    joins[left << 32 | right] = rank
        self.token_bytes = np.frombuffer(b"".join(vocabulary), np.uint8)
        self.token_ends = np.cumsum([0, *map(len, vocabulary)], dtype=np.int32)
        self.pair_keys = np.array(sorted(joins), dtype=np.int64)
        self.pair_ranks = np.array([joins[k] for k in self.pair_keys.tolist()], dtype=np.int32)
        self.matches = regex.compile(pattern)
        self.known: dict[str, bytes] = {}

    def ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the token that joins each pair, -1 where there is none or a wall stands."""
        keys = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where((self.pair_keys[at] == keys) & (left >= 0) & (right >= 0), self.pair_ranks[at], np.int32(-1))

    def replay(self, words: list[bytes]) -> list[bytes]:
        """Packed ids of each word (none of them empty)."""
        if not words:
            return []
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lengths + 1) - 1  # a wall stands after each word
        starts = ends - lengths
        n = int(ends[-1]) + 1
        token = np.full(n + 1, -1, dtype=np.int32)
        inside = np.ones(n + 1, dtype=bool)
        inside[ends] = inside[n] = False
        token[inside] = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        after = np.arange(1, n + 2, dtype=np.int32)
        before = np.arange(-1, n, dtype=np.int32)
        joined = np.append(self.ranks_of(token[:-1], token[1:]), np.int32(-1))  # rank of the pair that starts here
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def enter(positions: np.ndarray, ranks: np.ndarray) -> None:
            order = np.argsort(ranks, kind="stable")
            positions, ranks = positions[order], ranks[order]
            edges = np.flatnonzero(np.diff(ranks)) + 1
            for rank, some in zip(ranks[np.append(0, edges)].tolist(), np.split(positions, edges), strict=True):
                if rank >= 0:
                    if rank not in index:
                        index[rank] = []
                        heapq.heappush(heap, rank)
                    index[rank].append(some)

        enter(np.arange(n, dtype=np.int32), joined[:n])
        while heap:
            rank = heapq.heappop(heap)
            found = index.pop(rank)
            at = np.unique(np.concatenate(found))
            at = at[joined[at] == rank]
            if not len(at):
                continue
            if len(at) > 1:  # in a run of overlapping pairs every second one is merged, from the left
                linked = after[at[:-1]] == at[1:]
                if linked.any():
                    places = np.arange(len(at))
                    heads = np.maximum.accumulate(np.where(np.append(True, ~linked), places, 0))
                    at = at[(places - heads) % 2 == 0]
            gone = after[at]
            right = after[gone]
            token[at] = rank
            token[gone] = -2
            joined[gone] = -1
            after[at] = right
            before[right] = at
            left = before[at]
            left = left[left >= 0]
            touched = np.concatenate((at, left[token[left] >= 0]))
            ranks = self.ranks_of(token[touched], token[after[touched]])
            joined[touched] = ranks
            keep = ranks >= 0
            if keep.any():
                enter(touched[keep], ranks[keep])
        left_over = token >= 0
        packed = token[left_over].astype("<u4").tobytes()
        upto = np.append(0, np.cumsum(left_over))
        cuts_a, cuts_b = (upto[starts] * 4).tolist(), (upto[ends] * 4).tolist()
        return [packed[a:b] for a, b in zip(cuts_a, cuts_b, strict=True)]

    def chunks(self, text: str) -> list[str]:
        """The text cut before each space that stands between two characters which are not white space:
        no match of the pattern spans such a place, and none looks across it."""
        if "\0" not in text and not _wide(text):
            return text.replace(" ", "\0 ").split("\0")
        first, *rest = text.split(" ")
        out = [first]
        open_end = not first or first[-1] in _SPACE
        for piece in rest:
            if open_end or not piece or piece[0] in _SPACE:
                out[-1] += " " + piece
                open_end = not piece or piece[-1] in _SPACE
            else:
                out.append(" " + piece)
                open_end = piece[-1] in _SPACE
        return out

    def _learn(self, fresh: set[str]) -> None:
        """Enters the ids of chunks that are not known. An ASCII word is one match, and so is a mark after it;
        other chunks are left to the pattern."""
        ranks, known = self.ranks, self.known
        several: list[str] = []  # chunks of several matches, and these, joined
        joined: list[str] = []
        words: set[str] = set()
        for chunk in fresh:
            if chunk.isascii():
                body = chunk[1:] if chunk[0] == " " else chunk
                if body.isalpha():
                    words.add(chunk)
                    continue
                if body[-1:] in _MARKS and body[:-1].isalpha():
                    several.append(chunk)
                    joined.append(chunk[:-1] + "\0" + chunk[-1])
                    words.add(chunk[:-1])
                    words.add(chunk[-1])
                    continue
            found = self.matches.findall(chunk)
            words.update(found)
            if len(found) > 1:
                several.append(chunk)
                joined.append("\0".join(found) if "\0" not in chunk else "")
        words.difference_update(known)
        told = list(words)
        raw = [w.encode("utf-8", "replace") for w in told]
        long_words, long_raw = [], []
        for w, b in zip(told, raw, strict=True):
            if b in ranks:
                known[w] = ranks[b].to_bytes(4, "little")
            else:
                long_words.append(w)
                long_raw.append(b)
        known.update(zip(long_words, self.replay(long_raw), strict=True))
        look = known.__getitem__
        for chunk, parts in zip(several, joined, strict=True):
            known[chunk] = b"".join(map(look, parts.split("\0") if parts else self.matches.findall(chunk)))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text, as little-endian unsigned 32-bit integers."""
        if len(self.known) > REMEMBERED:
            self.known = {}
        known = self.known
        fresh: set[str] = set()
        for text in texts:
            if text:
                fresh.update(self.chunks(text))
        fresh = fresh.difference(known)
        if fresh:
            self._learn(fresh)
        out = [b"".join(map(known.__getitem__, self.chunks(text))) if text else b"" for text in texts]
        if fresh and max(map(len, fresh)) > LONG_CHUNK:
            self.known = {w: x for w, x in known.items() if len(w) <= LONG_CHUNK}
        return out

    def decode(self, packed: bytes | None) -> bytes:
        """Bytes of packed ids; an id outside the vocabulary raises IndexError."""
        ids = np.frombuffer(packed or b"", dtype="<u4")
        out = []
        for a in range(0, len(ids), 1 << 18):
            some = ids[a : a + (1 << 18)]
            lengths = self.token_ends[some + 1] - self.token_ends[some]
            # the place in the table of each byte: a token's first, and on by one from there
            step = np.ones(int(lengths.sum()) + 1, dtype=np.int32)
            heads = np.cumsum(lengths) - lengths
            first = self.token_ends[some]
            full = lengths > 0
            heads, first, lengths = heads[full], first[full], lengths[full]
            step[heads[1:]] = first[1:] - first[:-1] - lengths[:-1] + 1
            step[0] = first[0] if len(first) else 0
            out.append(self.token_bytes[np.cumsum(step[:-1], dtype=np.int32)].tobytes())
        return b"".join(out)


@lru_cache(maxsize=2)
def _replay(path: str, pattern: str) -> MergeReplay:
    return MergeReplay(load_ranks(path), pattern)


def _blocks(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    start = chars = 0
    for i, text in enumerate(texts):
        chars += len(text or "")
        if chars >= BLOCK_CHARS:
            yield start, i + 1
            start, chars = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def encode(docs: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """(id_col, n_tokens long, ids binary) for every row; rank_file must be readable on each executor. With
    `decoded`, the ids are decoded in the same pass into a further binary column of that name."""
    bounded_batches(docs.sparkSession)
    source = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("__text"))
    names = [id_col, "n_tokens", "ids", *(["decoded"] if decoded else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        replay = _replay(rank_file, pattern)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in _blocks(texts):
                packed = replay.encode(texts[a:b])
                made = [batch.column(0).slice(a, b - a), pa.array([len(x) // 4 for x in packed], pa.int64()), pa.array(packed, pa.binary())]
                if decoded:
                    made.append(pa.array([replay.decode(x) for x in packed], pa.binary()))
                yield pa.RecordBatch.from_arrays(made, names)

    kind = source.schema[id_col].dataType.simpleString()
    return source.mapInArrow(run, f"`{id_col}` {kind}, n_tokens long, ids binary" + (", decoded binary" if decoded else ""))


def decode(encoded: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """Adds `decoded` binary, the bytes that the packed `ids` stand for; null ids give no bytes."""
    bounded_batches(encoded.sparkSession)
    source = encoded.drop("decoded")
    at = source.columns.index("ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        replay = _replay(rank_file, pattern)
        for batch in batches:
            out = pa.array([replay.decode(x) for x in batch.column(at).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, out], [*batch.schema.names, "decoded"])

    return source.mapInArrow(run, StructType([*source.schema.fields, StructField("decoded", BinaryType())]))


def unpacked(encoded: DataFrame) -> DataFrame:
    """Turns packed `ids` into array<int>, for readers which want them so."""
    code = F.hex("ids")
    byte = lambda i, k: F.substring(code, i * 8 + 2 * k + 1, F.lit(2))
    one = lambda i: F.conv(F.concat(byte(i, 3), byte(i, 2), byte(i, 1), byte(i, 0)), 16, 10).cast("int")
    n = (F.length("ids") / 4).cast("int")
    ids = F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), one)).otherwise(F.array().cast("array<int>"))
    return encoded.withColumn("ids", ids)


def digests(docs: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """Encodes, decodes, and digests both: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    both = encode(docs, rank_file, pattern, decoded=True)
    return both.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
