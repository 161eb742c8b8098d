"""Secret scan over a trigram inverted index.

For each rule's pattern a Boolean trigram query is derived from its parse: a conjunction of clauses, each an
alternative of trigram sets of which one must be present in any text that matches. A task indexes a block of
its documents (trigram to ascending document positions, over ASCII-folded bytes), intersects and unites the
postings as the query says, and runs the pattern on the candidates alone, so the index never outgrows a block
and nothing is shuffled. Rules from which no trigram is mandatory run on every document.

Edge cases: null and empty texts have no spans; repeated rows are scanned alike; texts may be of any length;
kinds are found each for itself, so that a span of one may lie over another's and both stay; an empty table
gives an empty table; other input columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import product
from re import _constants as code
from re import _parser as parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, bounded_batches

#: Exact alternatives carried while a pattern is walked; more are cut into a clause.
ALTERNATIVES = 48

Clause = frozenset  # of trigram sets: one of them must be present in full


def _exact(op: object, arg: object, fold: bool) -> set[str] | None:
    """All strings that one parsed item can match, if they are few; None if not."""
    if op is code.LITERAL:
        return {chr(arg).lower() if fold else chr(arg)}
    if op is code.IN:
        out = set()
        for kind, x in arg:
            if kind is code.LITERAL:
                out.add(chr(x))
            elif kind is code.RANGE and x[1] - x[0] < 8:
                out |= {chr(c) for c in range(x[0], x[1] + 1)}
            else:
                return None
        return {x.lower() for x in out} if len(out) <= 8 else None
    if op is code.SUBPATTERN:
        return _all_exact(arg[3], fold)
    if op is code.BRANCH:
        parts = [_all_exact(x, fold) for x in arg[1]]
        return None if None in parts else set().union(*parts)
    if op in (code.MAX_REPEAT, code.MIN_REPEAT) and arg[1] <= 4:
        one = _all_exact(arg[2], fold)
        if one is None:
            return None
        return {"".join(x) for n in range(arg[0], arg[1] + 1) for x in product(one, repeat=n)}
    return None


def _all_exact(items: object, fold: bool) -> set[str] | None:
    out = {""}
    for op, arg in items:
        one = _exact(op, arg, fold)
        if one is None or len(out) * len(one) > ALTERNATIVES:
            return None
        out = {a + b for a in out for b in one}
    return out


def _clause(strings: set[str]) -> Clause | None:
    """The clause that says one of the strings is present; None if a string is too short to say so."""
    sets = set()
    for s in strings:
        raw = s.encode("utf-8").translate(LOWER)
        if len(raw) < 3:
            return None
        sets.add(frozenset(raw[i : i + 3] for i in range(len(raw) - 2)))
    return frozenset(x for x in sets if not any(y < x for y in sets))


def trigram_query(pattern: str, flags: int = 0) -> list[Clause]:
    """Clauses that every matching text fulfils; empty if no trigram is mandatory."""
    clauses: list[Clause] = []
    run = {""}

    def flush() -> None:
        nonlocal run
        if (found := _clause(run)) is not None:
            clauses.append(found)
        run = {""}

    def walk(items: object) -> None:
        nonlocal run
        for op, arg in items:
            one = _exact(op, arg, bool(flags & re.IGNORECASE))
            if one is not None and len(run) * len(one) <= ALTERNATIVES:
                run = {a + b for a in run for b in one}
            elif one is not None:
                flush()
                run = one
            else:
                flush()
                if op is code.SUBPATTERN:
                    walk(arg[3])
                    flush()
                elif op in (code.MAX_REPEAT, code.MIN_REPEAT) and arg[0] >= 1:
                    walk(arg[2])
                    flush()

    walk(parser.parse(pattern, flags))
    flush()
    return list(dict.fromkeys(clauses))


@dataclass(frozen=True)
class Rule:
    """A kind of secret: a match counts when `group` has `at_least` characters."""

    kind: str
    pattern: str
    flags: int = re.ASCII
    group: int = 0
    at_least: int = 0

    @cached_property
    def query(self) -> list[Clause]:
        return trigram_query(self.pattern, self.flags)

    @cached_property
    def compiled(self) -> re.Pattern:
        return re.compile(self.pattern, self.flags)

    def spans(self, text: str) -> list[tuple[int, int]]:
        """Leftmost non-overlapping matches in code points, the failing ones dropped."""
        return [m.span() for m in self.compiled.finditer(text) if m.end(self.group) - m.start(self.group) >= self.at_least]


#: The base kinds, in order. A run of hex digits is taken whole, so its length may stand in the pattern.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE, 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", re.ASCII, 0, 16),
    Rule("hex", r"[0-9a-f]{32,}"),
)
#: Further kinds with a fixed public shape.
MORE = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("forge", r"gh[opsu]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abps]-[A-Za-z0-9-]{10,}"),
    Rule("maps", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
)
RULES = BASE + MORE


class TrigramIndex:
    """Postings of a block of texts for the trigrams that a set of queries names."""

    def __init__(self, wanted: list[bytes]):
        self.slots = {t: i + 1 for i, t in enumerate(wanted)}
        self.table = np.zeros(1 << 24, dtype=np.uint16)
        for t, i in self.slots.items():
            self.table[int.from_bytes(t, "big")] = i

    def postings(self, texts: list[bytes]) -> dict[bytes, np.ndarray]:
        """Trigram to the ascending positions of the texts that hold it."""
        joined = np.frombuffer(b"\0".join([*texts, b"\0"]), np.uint8)
        starts = np.cumsum([0, *(len(t) + 1 for t in texts)])
        keys, at = [], []
        for a in range(0, len(joined) - 2, 1 << 22):
            part = joined[a : a + (1 << 22) + 2].astype(np.int32)
            slot = self.table[part[:-2] << 16 | part[1:-1] << 8 | part[2:]]
            hits = np.flatnonzero(slot)
            keys.append(slot[hits].astype(np.int64))
            at.append(np.searchsorted(starts, hits + a, "right") - 1)
        pairs = np.unique(np.concatenate(keys) << 32 | np.concatenate(at)) if keys else np.zeros(0, np.int64)
        slot, where = pairs >> 32, pairs & 0xFFFFFFFF
        return {t: where[np.searchsorted(slot, i) : np.searchsorted(slot, i, "right")] for t, i in self.slots.items()}


def _candidates(query: list[Clause], postings: dict[bytes, np.ndarray], n: int) -> np.ndarray:
    """Positions whose texts fulfil every clause."""
    out = None
    for clause in query:
        some = []
        for trigrams in clause:
            lists = sorted((postings[t] for t in trigrams), key=len)
            both = lists[0]
            for other in lists[1:]:
                both = np.intersect1d(both, other, assume_unique=True)
            some.append(both)
        either = np.unique(np.concatenate(some))
        out = either if out is None else np.intersect1d(out, either, assume_unique=True)
    return np.arange(n) if out is None else out


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, spans array<struct<kind, start, end>>) for every row; spans in code points, end exclusive,
    ordered by start and then by the order of the rules."""
    bounded_batches(docs.sparkSession)
    source = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("__text"))
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = TrigramIndex(sorted({t for r in rules for clause in r.query for s in clause for t in s}))
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            postings = index.postings([t.encode("utf-8", "replace").translate(LOWER) for t in texts])
            found: list[list] = [[] for _ in texts]
            for order, rule in enumerate(rules):
                for i in _candidates(rule.query, postings, len(texts)).tolist():
                    found[i] += [(a, order, b) for a, b in rule.spans(texts[i])]
            spans = [[{"kind": rules[k].kind, "start": a, "end": b} for a, k, b in sorted(x)] for x in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, kind)], [id_col, "spans"])

    id_type = source.schema[id_col].dataType.simpleString()
    return source.mapInArrow(run, f"`{id_col}` {id_type}, spans array<struct<kind:string,start:bigint,end:bigint>>")


def _joined(spans: F.Column) -> F.Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, base_sha256 and spans as text."""
    base = F.filter("spans", lambda s: s["kind"].isin([r.kind for r in BASE]))
    of_kind = lambda kind: F.filter("spans", lambda s: s["kind"] == kind)
    counts = [F.size(of_kind(r.kind)).cast("long").alias(f"n_{r.kind}") for r in BASE]
    return scan(docs).select("doc_id", *counts, F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))
