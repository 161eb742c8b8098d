"""Every operator on documents, and every stage of the pipeline, on tables with odd rows and odd names."""

import hashlib
import random
import re

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from boxlines.llm import bpe, fingerprints, jaccard, katz, langid, line_dedup, line_runs, mixing, pii, secret_scan
from boxlines.llm.queries import PIECES, RANKS

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that meet those of helpers, or need quoting.
NAMES = ["__lines", "__id", "__hash", "__text_hash", "__removed", "__touched", "__salt", "__salts", "__key", "__draw", "__hits", "__new", "__lang", "__best", "__total", "__rest", "row", "id", "hash", "removed", "later", "first", "chunks", "candidates", "a", "b", "a.b", "a b", "key", "part", "label", "n"]
LONG = " ".join(f"word{i % 977} and{i % 31}" for i in range(60_000)) + "\n" + "\n".join(f"line {i % 700} of it" for i in range(20_000))

OPERATORS = {
    "bpe": lambda d: bpe.digests(d, public_tokenizers.path(RANKS), public_tokenizers.PATTERN),
    "katz": katz.score,
    "line_dedup": line_dedup.dedup,
    "line_runs": line_runs.dedup,
    "fingerprints": fingerprints.compared_with_next,
    "jaccard": jaccard.components,
    "keep_one": jaccard.keep_one,
    "langid": lambda d: langid.identify(d, public_tokenizers.path(PIECES)),
    "mixing": mixing.plan,
    "mix": mixing.mix,
    "pii": lambda d: pii.pseudonymise(d, "k"),
    "secrets": secret_scan.digests,
}
#: Those that give a row for each of the input's.
WHOLE = {"bpe", "katz", "line_dedup", "line_runs", "fingerprints", "langid", "mixing", "pii", "secrets"}
#: Those that keep the caller's columns.
CARRY = {"line_dedup", "line_runs", "keep_one", "langid", "mixing", "mix", "pii"}


def rows():
    prose = "the words of this text are plain and there are enough of them here"
    out = [(1, None, None, None, None), (2, "", "en", "", 0), (3, " \n\t\n ", "en", "a", 5), (4, prose, "en", "a", 70), (4, prose, "en", "a", 70), (4, prose + " now", "de", None, 74)]
    out += [(None, prose, "en", "a", 70), (None, None, "en", "a", 0), (5, LONG, "en", "b", len(LONG)), (6, LONG, "fr", "b", len(LONG)), (7, "x" * 1_000_000, "fr", "b", 1_000_000)]
    return out + [(8 + i, f"{prose} {i % 3}\nsecond line of number {i % 3}\nthird", "en", "c", 1) for i in range(9)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(rows(), SCHEMA)


@pytest.mark.parametrize("name", list(OPERATORS))
def test_operators_on_odd_rows_and_names(odd, name):
    more = odd.select("*", *(F.lit(f"v {n}").alias(n) for n in NAMES))
    got = OPERATORS[name](more)
    out = got.collect()
    if name in WHOLE:
        assert len(out) == len(rows())
    if name in CARRY:
        assert got.columns[: len(more.columns)] == more.columns
        assert all(r[5 + i] == f"v {n}" for r in out for i, n in enumerate(NAMES))
        plain = sorted(str([x for k, x in enumerate(r) if not 5 <= k < 5 + len(NAMES)]) for r in out)
        if name != "mix":
            assert plain == sorted(str(list(r)) for r in OPERATORS[name](odd).collect())
    empty = more.limit(0)
    assert OPERATORS[name](empty).count() == 0


@pytest.mark.parametrize("stage", [name for name, _ in corpus_pipeline.STAGES])
def test_stages_on_odd_rows_and_none(spark, odd, small, stage):
    work = dict(corpus_pipeline.STAGES)[stage]
    out = work(spark, odd, small)
    kept = out.collect()
    if stage != "byte_bpe":
        assert out.columns == odd.columns
        assert {r.doc_id for r in kept} <= {r[0] for r in rows()}
    if stage == "language_id":
        assert all(r.text and re.search("[a-z]", r.text) for r in kept)
    if stage == "line_dedup":
        assert all(r.text is not None for r in kept)
    assert work(spark, odd.limit(0), small).count() == 0


# line runs against a plain version


def brute_runs(docs, min_words=10, long_line=50):
    """docs: doc_id to text; ids are unique, so that places are in the order of ids, lines and kinds."""
    n_words = lambda x: len(re.findall(r"[^\x20\x09-\x0D]+", x))
    of = {}
    for doc, text in docs.items():
        if text is None:
            continue
        lines = text.split("\n")
        full = [i for i, x in enumerate(lines) if n_words(x)]
        found = [((k, k, 0), (lines[i],)) for k, i in enumerate(full) if n_words(lines[i]) >= long_line]
        found += [((k, k + 1, 1), (lines[full[k]], lines[full[k + 1]])) for k in range(len(full) - 1)]
        codes = [int(hashlib.md5(x.encode()).hexdigest()[:8], 16) for x in lines]
        zero = [(c + 31 * (codes[i - 1] if i else 0)) % 2 == 0 for i, c in enumerate(codes)]
        ends = [i for i in range(len(lines)) if i == len(lines) - 1 or i and zero[i] and not zero[i - 1]]
        for start, end in zip([0, *(e + 1 for e in ends)], ends, strict=False):
            if end > start and n_words("\n".join(lines[start : end + 1])) >= min_words:
                found.append(((start, end, 2), tuple(lines[start : end + 1])))
        of[doc] = (lines, full, found)
    first = {}
    for doc in sorted(of):
        for code, body in sorted(of[doc][2]):
            first.setdefault((code[2], body), (doc, code))
    out = {}
    for doc, text in docs.items():
        if text is None:
            out[doc] = (None, 0)
            continue
        lines, full, found = of[doc]
        gone, pairs = set(), []
        for code, body in sorted(found):
            where, at = first[code[2], body]
            if (where, at) == (doc, code) or where == doc and code[0] <= at[1]:
                continue
            if code[2] == 1:
                if where != doc or sum(n_words(lines[i]) for i in full[at[0] : code[0]]) >= long_line:
                    pairs.append(code[0])
            else:
                gone |= set(range(full[code[0]], full[code[1]] + 1) if code[2] == 0 else range(code[0], code[1] + 1))
        while pairs:
            run = [pairs.pop(0)]
            while pairs and pairs[0] == run[-1] + 1:
                run.append(pairs.pop(0))
            if sum(n_words(lines[i]) for i in full[run[0] : run[-1] + 2]) >= long_line:
                gone |= set(range(full[run[0]], full[run[-1] + 1] + 1))
        out[doc] = ("\n".join(x for i, x in enumerate(lines) if i not in gone), len(gone))
    return out


def test_line_runs_agree_with_brute_force(spark, small):
    table = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    rnd = random.Random(4)
    lines = ["", " ", "a b c", "ten words in a line that stands here many times", "w " * 60, *(f"line {i} with some words of its own to tell" for i in range(12))]
    made = spark.createDataFrame([(i, "\n".join(rnd.choice(lines) for _ in range(rnd.choice([1, 5, 30, 90])))) for i in range(40)], "doc_id long, text string")
    for some in (table, made):
        want = brute_runs({r.doc_id: r.text for r in some.collect()})
        assert {r.doc_id: (r.text, r.n_removed) for r in line_runs.dedup(some).collect()} == want


def test_line_runs_with_hashes_that_lines_share(spark, monkeypatch):
    """With the length as its hash, lines of other bytes look alike: what isn't the same stays."""
    monkeypatch.setattr(line_runs, "_line_hashes", lambda line: [F.length(line).cast("long").alias("a"), F.length(line).cast("long").alias("b")])
    same = "\n".join(f"a passage of equal lines that stands twice {'x' * i}" for i in range(9))
    other = "\n".join(f"lines of equal lengths and other bytes  {d} {'y' * (i + 40)}" for d in "pq" for i in range(9))
    half = len(other) // 2
    texts = ["own\n" + same, "mine own\n" + same, other[:half], other[half + 1 :]]
    out = {r.doc_id: r.text for r in line_runs.dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert out == {0: texts[0], 1: "mine own", 2: texts[2], 3: texts[3]}


@pytest.mark.parametrize("n_lines", [1, 2, 3, 4, 6, 10, 20])
def test_recall_of_planted_passages(spark, n_lines):
    """Of passages of 60 words and more that stand twice between own lines, the second goes whole."""
    rnd = random.Random(n_lines)
    docs, own_of = [], {}
    for k in range(12):
        passage = [" ".join(f"p{n_lines}x{k}x{i}x{w}" for w in range(-(-60 // n_lines))) for i in range(n_lines)]
        for _ in range(2):
            own = [f"own line {rnd.random()} here" for _ in range(8)]
            at = rnd.randrange(9)
            own_of[len(docs)] = "\n".join(own)
            docs.append((len(docs), "\n".join([*own[:at], *passage, *own[at:]])))
    out = line_runs.dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert all(r.text == (own_of[r.doc_id] if r.doc_id % 2 else docs[r.doc_id][1]) for r in out)
