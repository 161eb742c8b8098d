"""Language ID by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary: the vocabulary's own
segmentation of the training words is counted per language and smoothed. A text is scored word by word; the
probability of a word is the sum over all its segmentations into pieces, by the forward recursion
f(end) = sum over pieces that end there of f(start) * p(piece), and the text's is the product over its
words. Words never span what stands between runs of letters, so a task runs the recursion once for each
distinct word of a block, for all languages of a group at once, and adds up the logarithms per text. Words of
any length are summed over whole: the recursion goes on from segment to segment with the last values that a
piece can reach back to, rescaled as it goes. More than LANGUAGES languages are scored group after group,
each pass over the texts carrying on the best language and the sum.

Edge cases: a text that is null or has no letter is `und`, score 0; so is every text if nothing can be
learned; ties go to the first language in code point order; a null id counts as the empty text in the split;
repeated rows are counted and predicted row by row; input columns that clash with computed ones are replaced;
an empty table gives an empty table.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, renamed, stored

UND = "und"
SMOOTHING = 0.1
#: Languages scored in one pass; a pass's model is this times the vocabulary's at most.
LANGUAGES = 64
#: Words' scores which a worker remembers between blocks, times languages.
REMEMBERED = 800_000
BLOCK_CHARS = 3 << 20
#: Bytes of a word that are worked on at a time, and after which the recursion is rescaled.
SEGMENT, RESCALED = 4096, 24
#: Values of the recursion that are held at a time.
HELD_VALUES = 4_000_000
#: Pieces' probabilities are scaled by this per byte, so that long words do not underflow.
_SCALE = 512.0
#: The vocabulary's mark of a word's start.
_SPACE = "▁".encode()
#: ASCII letters lower-cased, all other ASCII turned into spaces.
_LETTERS = bytes(b if b > 127 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


@lru_cache(maxsize=2)
def _vocabulary(path: str) -> tuple[object, dict[str, int]]:
    """The segmenter, and its ordinary pieces with their ids."""
    import sentencepiece

    pieces = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = {pieces.id_to_piece(i): i for i in range(pieces.get_piece_size()) if not (pieces.is_control(i) or pieces.is_unknown(i) or pieces.is_byte(i))}
    return pieces, ids


def held_out(doc_id: Column, parts: int = 4, part: int = 2) -> Column:
    """Whether crc32 of the id's text leaves the remainder that is kept out of training."""
    return (F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts) == part


def words_of(text: str) -> list[bytes]:
    """The runs of letters and of characters outside ASCII, in UTF-8, ASCII lower-cased."""
    return text.encode("utf-8", "replace").translate(_LETTERS).split()


def _blocks(texts: list[str], most: int = BLOCK_CHARS) -> Iterator[tuple[int, int]]:
    start = chars = 0
    for i, text in enumerate(texts):
        chars += len(text)
        if chars >= most:
            yield start, i + 1
            start, chars = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def learn(docs: DataFrame, model_file: str) -> DataFrame:
    """(lang, piece int, n long): how often each piece stands in the training texts of each language."""
    bounded_batches(docs.sparkSession)
    train = docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, ids = _vocabulary(model_file)
        size = pieces.get_piece_size()
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in _blocks(texts):
                for lang in sorted(set(langs[a:b])):
                    words = Counter()
                    for at in range(a, b):
                        if langs[at] == lang:
                            words.update(words_of(texts[at]))
                    told = list(words)
                    cut = pieces.encode([w.decode("utf-8", "replace") for w in told], num_threads=1)
                    lengths = np.fromiter(map(len, cut), np.int64, len(cut))
                    flat = np.fromiter((i for x in cut for i in x), np.int64, int(lengths.sum()))
                    times = np.repeat(np.fromiter((words[w] for w in told), np.int64, len(told)), lengths)
                    counts[lang] = counts.get(lang, np.zeros(size)) + np.bincount(flat, times, size)
        for lang, n in counts.items():
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some)), pa.array(some.astype(np.int32)), pa.array(n[some].astype(np.int64))], ["lang", "piece", "n"])

    return train.mapInArrow(run, "lang string, piece int, n long").groupBy("lang", "piece").agg(F.sum("n").alias("n"))


def language_groups(counts: DataFrame, size: int = LANGUAGES) -> Iterator[list[str]]:
    """The learned languages in code point order, `size` at a time."""
    langs, last = counts.select("lang").distinct(), None
    while True:
        left = langs if last is None else langs.where(F.col("lang") > last)
        some = [r.lang for r in left.orderBy("lang").limit(size).collect()]
        if some:
            yield some
        if len(some) < size:
            return
        last = some[-1]


def probabilities(counts: DataFrame, langs: list[str], model_file: str, smoothing: float = SMOOTHING) -> np.ndarray:
    """The probabilities (piece, language) of a group of languages."""
    pieces, ids = _vocabulary(model_file)
    table = np.zeros((pieces.get_piece_size(), len(langs)))
    rows = counts.where(F.col("lang").isin(langs)).toPandas()
    column = {x: i for i, x in enumerate(langs)}
    table[rows["piece"].to_numpy(dtype=np.int64), [column[x] for x in rows["lang"]]] = rows["n"]
    ordinary = np.zeros(len(table), dtype=bool)
    ordinary[list(ids.values())] = True
    table = np.where(ordinary[:, None], table + smoothing, 0.0)
    return table / np.maximum(table.sum(axis=0, keepdims=True), 1e-300)


class Scorer:
    """Log probabilities of words under each language, summed over all segmentations."""

    def __init__(self, model_file: str, table: np.ndarray):
        _, ids = _vocabulary(model_file)
        lengths = np.zeros(len(table))
        # a trie over the pieces' bytes, as sorted keys (node, byte) with the nodes they lead to
        children: dict[int, int] = {}
        piece_of = [-1]
        for piece, i in ids.items():
            raw = piece.encode("utf-8")
            lengths[i] = len(raw)
            node = 0
            for byte in raw:
                key = node << 8 | byte
                if key not in children:
                    children[key] = len(piece_of)
                    piece_of.append(-1)
                node = children[key]
            piece_of[node] = i
        self.keys = np.array(sorted(children), dtype=np.int64)
        self.nodes = np.array([children[k] for k in self.keys.tolist()], dtype=np.int32)
        self.piece_of = np.array(piece_of, dtype=np.int32)
        # the last row is a byte which is no piece alone: less than half a smoothed piece
        least = np.where(table > 0, table, 1.0).min(axis=0, keepdims=True) / 2
        self.scaled = np.vstack([table * _SCALE ** lengths[:, None], least * _SCALE])
        self.unknown = len(table)
        self.reach = int(lengths.max(initial=1))  # bytes of the longest piece
        own = np.array([chr(b) in ids if b < 128 else False for b in range(256)])
        self.alone = np.flatnonzero(~own).astype(np.uint8)
        self.at: dict[bytes, int] = {}
        self.scores = np.zeros((0, table.shape[1]))

    def _forward(self, segments: list[bytes], before: np.ndarray, given: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Runs the recursion over segments. Each begins with `before` bytes whose values are `given`
        (segment, reach + 1, language), the last of them 1. Returns the logarithm by which the value at the
        end exceeds 1, and the last values over that at the end."""
        n, langs = len(segments), self.scaled.shape[1]
        lengths = np.fromiter(map(len, segments), np.int64, n)
        heads = np.cumsum(lengths) - lengths
        raw = np.frombuffer(b"".join(segments), np.uint8)
        owner = np.repeat(np.arange(n), lengths)
        stop = (heads + lengths)[owner]
        start = np.arange(len(raw))
        odd = np.flatnonzero(np.isin(raw, self.alone))
        starts, ends, pieces = [odd], [odd + 1], [np.full(len(odd), self.unknown)]
        node, depth = np.zeros(len(raw), dtype=np.int64), 0
        while len(start):
            keys = node << 8 | raw[start + depth]
            at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            hit = self.keys[at] == keys
            start, node = start[hit], self.nodes[at[hit]].astype(np.int64)
            depth += 1
            piece = self.piece_of[node]
            some = piece >= 0
            starts.append(start[some]), ends.append(start[some] + depth), pieces.append(piece[some])
            inside = start + depth < stop[start]
            start, node = start[inside], node[inside]
        start, end, piece = np.concatenate(starts), np.concatenate(ends), np.concatenate(pieces)
        whose = owner[start]
        # a segment's slots: one before each byte, one after the last
        end_in = end - heads[whose]
        fresh = end_in > before[whose]
        start, piece, whose, end_in = start[fresh], piece[fresh], whose[fresh], end_in[fresh]
        order = np.lexsort((whose, end_in))
        start, piece, whose, end_in = start[order], piece[order], whose[order], end_in[order]
        slot = heads + np.arange(n)
        forward = np.zeros((len(raw) + n, langs))
        back = np.arange(self.reach + 1)
        known = back[None, :] <= before[:, None]  # given is read from its end
        forward[(slot + before)[:, None].repeat(len(back), 1)[known] - np.broadcast_to(back, known.shape)[known]] = given[:, ::-1][known]
        logs = np.zeros((n, langs))
        from_slot = start + whose

        def rescale(some: np.ndarray, e: np.ndarray | int) -> None:
            now = slot[some] + e
            level = forward[now]
            logs[some] += np.log(level)
            window = now[:, None] - back
            inside = window >= slot[some][:, None]
            window = np.where(inside, window, now[:, None])
            forward[window] = np.minimum(forward[window] / level[:, None, :], 1e290)
            forward[now] = 1.0

        top = int(lengths.max(initial=0))
        cuts = np.searchsorted(end_in, np.arange(1, top + 2))
        for e in range(1, top + 1):
            a, b = cuts[e - 1], cuts[e]
            if a < b:
                terms = forward[from_slot[a:b]] * self.scaled[piece[a:b]]
                firsts = np.flatnonzero(np.append(True, whose[a + 1 : b] != whose[a : b - 1]))
                forward[slot[whose[a:b][firsts]] + e] = np.add.reduceat(terms, firsts, axis=0)
            if e % RESCALED == 0 and e < top:
                some = np.flatnonzero((lengths > e) & (before < e))
                if len(some):
                    rescale(some, e)
        rescale(np.arange(n), lengths)
        window = (slot + lengths)[:, None] - back[::-1]
        return logs, np.where((window >= slot[:, None])[:, :, None], forward[np.maximum(window, 0)], 0.0)

    def log_probabilities(self, words: list[bytes]) -> np.ndarray:
        """(word, language): each whole word summed over its segmentations."""
        langs = self.scaled.shape[1]
        out = np.zeros((len(words), langs))
        raw = [_SPACE + w for w in words]
        reach, most = self.reach, max(SEGMENT, HELD_VALUES // langs)
        first = 0
        while first < len(raw):  # as many words as may be held
            last, size = first, 0
            while last < len(raw) and (last == first or size + min(len(raw[last]), SEGMENT) <= most and last - first < 20_000):
                size += min(len(raw[last]), SEGMENT)
                last += 1
            live, done = np.arange(first, last), 0
            given = np.zeros((len(live), reach + 1, langs))
            given[:, -1] = 1.0
            while len(live):
                context = min(reach, done)
                logs, values = self._forward([raw[i][done - context : done + SEGMENT] for i in live], np.full(len(live), context), given)
                out[live] += logs
                done += SEGMENT
                goes_on = np.array([len(raw[i]) > done for i in live])
                live, given = live[goes_on], values[goes_on]
            first = last
        return out - np.fromiter(map(len, raw), np.int64, len(raw))[:, None] * math.log(_SCALE)

    def remember(self, words: set[bytes]) -> None:
        """Scores the words that are not remembered yet."""
        fresh = sorted((w for w in words if w not in self.at), key=len)
        if fresh:
            self.at.update(zip(fresh, range(len(self.scores), len(self.scores) + len(fresh)), strict=True))
            self.scores = np.vstack([self.scores, self.log_probabilities(fresh)])

    def texts(self, texts: list[str]) -> np.ndarray:
        """Log probabilities (text, language)."""
        words = [words_of(t) for t in texts]
        if self.scores.size > REMEMBERED:
            self.at, self.scores = {}, self.scores[:0]
        self.remember(set().union(*words))
        at = self.at
        out = np.zeros((len(texts), self.scores.shape[1]))
        for i, ws in enumerate(words):
            if ws:
                out[i] = self.scores[np.fromiter(map(at.__getitem__, ws), np.int64, len(ws))].sum(axis=0)
        return out


def _pass(source: DataFrame, text_col: str, model_file: str, langs: list[str], table: np.ndarray) -> DataFrame:
    """Carries __lang, __best (its log probability) and __total (the logarithm of all languages' sum) on
    by a group of languages."""
    model = source.sparkSession.sparkContext.broadcast((langs, table))
    at = [source.columns.index(c) for c in (text_col, "__lang", "__best", "__total")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, table = model.value
        scorer = Scorer(model_file, table)
        for batch in batches:
            texts = [t or "" for t in batch.column(at[0]).to_pylist()]
            lang, best, total = (batch.column(i).to_pylist() for i in at[1:])
            for a, b in _blocks(texts, BLOCK_CHARS // max(1, len(langs) // 8)):
                logs = scorer.texts(texts[a:b])
                top = logs.argmax(axis=1)
                high = logs[np.arange(b - a), top]
                whole = high + np.log(np.exp(logs - high[:, None]).sum(axis=1))
                for i in range(a, b):
                    if best[i] is None or high[i - a] > best[i]:
                        lang[i], best[i] = langs[top[i - a]], float(high[i - a])
                    total[i] = float(whole[i - a]) if total[i] is None else float(np.logaddexp(total[i], whole[i - a]))
            columns = list(batch.columns)
            for i, x, kind in zip(at[1:], (lang, best, total), (pa.string(), pa.float64(), pa.float64()), strict=True):
                columns[i] = pa.array(x, kind)
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return source.mapInArrow(run, source.schema)


def predict(docs: DataFrame, model_file: str, counts: DataFrame, text_col: str = "text", size: int = LANGUAGES) -> DataFrame:
    """The rows of docs with lang_pred and score, the posterior under equal priors, by the languages of
    counts (see learn)."""
    bounded_batches(docs.sparkSession)
    kept, columns = renamed(docs, ("doc_id", text_col), ("lang_pred", "score"))
    found = kept.withColumns({"__lang": F.lit(None).cast("string"), "__best": F.lit(None).cast("double"), "__total": F.lit(None).cast("double")})
    for langs in language_groups(counts, size):
        found = _pass(found, text_col, model_file, langs, probabilities(counts, langs, model_file))
    told = F.col("__lang").isNotNull() & F.col(text_col).cast("string").rlike(r"\p{L}")
    pred, score = F.when(told, F.col("__lang")).otherwise(UND), F.when(told, F.exp(F.col("__best") - F.col("__total"))).otherwise(0.0)
    return found.select(*columns, pred.alias("lang_pred"), F.least(score, F.lit(1.0)).alias("score"))


def identify(docs: DataFrame, model_file: str) -> DataFrame:
    """Learns from the training documents of docs and predicts all of them."""
    return predict(docs, model_file, stored(learn(docs, model_file), "pieces"))


def digests(docs: DataFrame, model_file: str) -> DataFrame:
    """doc_id, held_out, lang_pred and score."""
    found = predict(docs.select("doc_id", "text"), model_file, stored(learn(docs, model_file), "pieces"))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
