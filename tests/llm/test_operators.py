"""Each operator against brute force, and on the edge cases that its docstring names."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from boxlines.llm import bpe, common, fingerprints, jaccard, katz, langid, line_dedup, line_runs, mixing, secret_scan, topk

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    (1, None, None, None, None),
    (2, "", "en", "a", 0),
    (3, " \n\t ", "en", "a", 4),
    (4, "word", "en", None, 4),
    (5, "One two three four five six seven.", "en", "b", 34),
    (5, "One two three four five six seven.", "en", "b", 34),
    (6, "ONE two three four five six seven.", None, "b", 34),
    (7, "x" * 3000, "de", "b", 3000),
    (8, "éa  ü\x1c\x85日本 \U0001f600 12 ²", "fr", "c", 15),
    (9, "\n".join(["a longer line of nine words is here now", "and another one of ten words stands below it here"] * 3), "en", "c", 300),
    (None, "no id here at all, none", "en", "c", 22),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


# 1 byte-level BPE


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(RANKS), special_tokens={})


def test_bpe_agrees_with_the_library(docs, odd, library):
    for df in (docs, odd):
        texts = df.select("doc_id", "text").collect()
        got = bpe.digests(df, RANKS, public_tokenizers.PATTERN).collect()
        want = []
        for r in texts:
            ids = library.encode_ordinary(r.text or "")
            want.append((r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
        assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_bpe_merges_overlaps_from_the_left_and_unpacks(spark, library):
    texts = ["a" * n for n in (1, 2, 3, 7, 64, 900)] + ["abab" * 50, "a\n \nb", "x  y", "'s don't  \t\n", " 　a"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = bpe.unpacked(bpe.encode(df, RANKS, public_tokenizers.PATTERN)).collect()
    assert {r.doc_id: r.ids for r in rows} == {i: library.encode_ordinary(t) for i, t in enumerate(texts)}


def test_bpe_of_nothing(empty):
    assert bpe.digests(empty, RANKS, public_tokenizers.PATTERN).count() == 0


# 2 Katz backoff


def brute_katz(rows):
    def discounts(counts):
        n = Counter(counts)
        d = {r: (r - 0.5) / r for r in range(1, 6)}
        if n[1] and n[6] and 6 * n[6] / n[1] < 1:
            common = 6 * n[6] / n[1]
            for r in d:
                if n[r] and n[r + 1]:
                    x = ((r + 1) * n[r + 1] / (r * n[r]) - common) / (1 - common)
                    if 0 < x < 1:
                        d[r] = x
        return d

    train = [r for r in rows if zlib.crc32(str("" if r.doc_id is None else r.doc_id).encode()) % 7 != 2]
    uni, bi = Counter(), defaultdict(Counter)
    for r in train:
        seq = ["<s>", *words(r.text), "</s>"]
        uni.update(seq[1:])
        for a, b in zip(seq, seq[1:], strict=False):
            bi[a][b] += 1
    total = sum(uni.values())
    d1 = discounts(uni.values())
    left = sum((1 - d1[c]) * c for c in uni.values() if c <= 5)
    norm, unknown = (total, left / total) if left > 0 else (total + 1, 1 / (total + 1))
    p1 = lambda w: d1.get(uni[w], 1) * uni[w] / norm if w in uni else unknown
    rigid = {h for h, c in bi.items() if min(c.values()) > 5}
    d2 = discounts([x for h, c in bi.items() if h not in rigid for x in c.values()])

    def p2(h, w):
        if h not in bi:
            return p1(w)
        c = bi[h]
        size = sum(c.values()) + (h in rigid)
        d = {} if h in rigid else d2
        if w in c:
            return d.get(c[w], 1) * c[w] / size
        mass = 1 - sum(d.get(x, 1) * x / size for x in c.values())
        return mass * p1(w) / (1 - sum(p1(x) for x in c))

    out = {}
    for r in rows:
        seq = ["<s>", *words(r.text), "</s>"]
        held = zlib.crc32(str("" if r.doc_id is None else r.doc_id).encode()) % 7 == 2
        out[r.doc_id] = (held, len(seq) - 1, sum(w in uni for w in seq[1:]), total, sum(math.log10((uni[w] + 1) / (total + len(uni) + 1)) for w in seq[1:]), sum(math.log10(p2(a, b)) for a, b in zip(seq, seq[1:], strict=False)))
    return out, p2, uni, bi


def test_katz_agrees_with_brute_force_in_any_number_of_parts(docs, odd, monkeypatch):
    for df in (docs, odd):
        rows = df.select("doc_id", "text").collect()
        want, p2, uni, bi = brute_katz(rows)
        for size, hot, chars in ((24 << 20, 10**9, 5 << 20), (1 << 14, 10**9, 1 << 14), (1 << 14, 40, 1 << 15)):
            monkeypatch.setattr(katz, "PART_BYTES", size)
            monkeypatch.setattr(katz, "HOT", hot)
            monkeypatch.setattr(katz, "BLOCK_CHARS", chars)
            got = katz.score(df).collect()
            assert len(got) == len(rows)
            for r in got:
                assert tuple(r)[1:5] == want[r.doc_id][:4]
                assert r.base_score == pytest.approx(want[r.doc_id][4], rel=1e-9) and r.score == pytest.approx(want[r.doc_id][5], rel=1e-9)
    for h in [*list(bi)[:3], "unheard of"]:
        assert sum(p2(h, w) for w in [*uni, "<unk>"]) == pytest.approx(1)


def test_katz_beats_single_words_on_held_out_texts(docs):
    held = [r for r in katz.score(docs).collect() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_katz_of_nothing(empty):
    assert katz.score(empty).count() == 0


# 3 line dedup


def test_line_dedup_removes_what_is_repeated_wherever_it_stands(spark):
    passage = "\n".join(f"shared line number {i} of the passage that stands in several texts" for i in range(40))
    head = [f"own line {i} of this text, unlike all others that there are" for i in range(12)]
    texts = ["\n".join([*head[:7], passage, *head[7:]]), "other words first here\n" + passage, "clean text\nwith two lines of its own and nothing else", passage + "\na tail"]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, chunks string")
    out = {r.doc_id: r for r in line_dedup.dedup(df).collect()}
    assert out[0].text == texts[0] and out[2].text == texts[2] and out[0].n_removed == 0
    for i in (1, 3):
        assert len(out[i].text) < 0.25 * len(texts[i]) and out[i].n_removed > 0
        assert out[i].removed_chars == len(texts[i]) - len(out[i].text)
    assert "a tail" in out[3].text


def test_line_dedup_chunks_give_the_text_back(docs):
    assert line_dedup.with_chunks(docs).where(F.array_join("chunks", "\n") != F.col("text")).count() == 0


def test_line_dedup_on_odd_rows(odd, empty):
    out = line_dedup.dedup(odd).collect()
    assert len(out) == len(ODD) and line_dedup.dedup(empty).count() == 0
    assert [r.text for r in out if r.doc_id == 1] == [None] and [r.text for r in out if r.doc_id == 2] == [""]


def test_line_runs_of_one_to_six_lines_go_wherever_they_stand(spark):
    rng = np.random.default_rng(5)
    rows, want = [], {}
    for n in range(1, 7):
        for turn in range(6):
            run = [" ".join(f"r{n}x{turn}x{i}x{w}" for w in range(-(-54 // n))) for i in range(n)]
            for copy in range(2):
                own = [f"own {n} {turn} {copy} {i} {rng.integers(10**9)}" for i in range(8)]
                at = int(rng.integers(1, 8))
                want[len(rows)] = "\n".join(own[:at] + (run if not copy else []) + own[at:])
                rows.append((len(rows), "\n".join(own[:at] + run + own[at:])))
    out = line_runs.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.text for r in out} == want
    assert all(r.removed_chars == len(rows[r.doc_id][1]) - len(r.text) for r in out)


def test_line_runs_keep_one_of_each_line(spark, docs, odd, empty):
    line = "ten words in a line that stands here many times"
    df = spark.createDataFrame([(1, "\n".join([line] * 10)), (2, "a\n" + "\n\n".join([line] * 5) + "\nz")], "doc_id long, text string")
    assert {r.doc_id: (r.text, r.n_removed) for r in line_runs.dedup(df).collect()} == {1: ("\n".join([line] * 5), 5), 2: ("a\nz", 9)}
    for some in (docs, odd.where("doc_id IS NOT NULL")):
        before = {x for r in some.collect() for x in (r.text or "").split("\n") if words(x)}
        after = line_runs.dedup(some.select("doc_id", "text")).collect()
        assert {x for r in after for x in (r.text or "").split("\n") if words(x)} == before and len(after) == some.count()
    assert len(line_runs.dedup(odd).collect()) == len(ODD) and line_runs.dedup(empty).count() == 0


def test_hot_chunks_and_runs_go_in_any_number_of_parts(spark, docs, odd, monkeypatch):
    passage = "\n".join(f"shared line number {i} of the passage that stands in several texts" for i in range(40))
    many = spark.createDataFrame([(i, f"own line {i} of this text\n{passage}\nown end {i}") for i in range(150)], "doc_id long, text string")
    for module in (line_dedup, line_runs):
        for df in (docs.select("doc_id", "text"), many, odd):
            monkeypatch.setattr(common, "SALT_ROWS", 10**9)
            want = sorted(map(str, module.dedup(df).collect()))
            monkeypatch.setattr(common, "SALT_ROWS", 3)
            assert sorted(map(str, module.dedup(df).collect())) == want


def test_hot_keys_are_bounded_and_none_is_lost(spark, monkeypatch):
    rows = spark.createDataFrame([(k, i) for k in range(40) for i in range(1 + 300 * (k == 7) + 20 * (k % 5 == 0))], "k int, i int")
    monkeypatch.setattr(common, "SALT_ROWS", 4)
    monkeypatch.setattr(common, "HOT_KEYS", 8)
    counted = rows.groupBy("k").agg(F.count("*").alias("n"))
    hot = common.hot_keys(counted, "k")
    assert 0 < hot.count() <= 8 and {r.k for r in hot.collect()} >= {7}
    dealt = common.salted(rows, hot, ["k"], ["i"])
    both = dealt.join(common.spread(counted, hot, ["k"]), ["k", "__salt"])
    assert both.count() == rows.count() and dealt.where("k = 7").select("__salt").distinct().count() > 1


# 4 fingerprints


def test_fingerprints_of_edited_and_next_texts(docs, odd):
    for df in (docs, odd.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])):
        rows = sorted((r.doc_id, r.text or "") for r in df.collect())
        got = {r.doc_id: r for r in fingerprints.compared_with_next(df).collect()}
        assert len(got) == len(rows)
        for i, (doc_id, text) in enumerate(rows):
            after = rows[(i + 1) % len(rows)][1]
            k = len(text) // 4
            edited = text[: len(text) - k] + after[:k]
            r = got[doc_id]
            assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
            assert r.fingerprint == fingerprints.fingerprint(text) and r.edited_fingerprint == fingerprints.fingerprint(edited)
            assert r.near_next == fingerprints.likeness(r.fingerprint, fingerprints.fingerprint(after)) and 0 <= r.near_edited <= 1
    near = [r for r in got.values() if r.n_chars > 300]
    assert all(r.near_edited >= r.near_next for r in near)


def test_fingerprints_of_repeated_rows_and_of_nothing(odd, empty):
    assert fingerprints.compared_with_next(odd).count() == len(ODD) and fingerprints.compared_with_next(empty).count() == 0
    assert fingerprints.with_fingerprints(odd).where("doc_id = 5").select("fingerprint").distinct().count() == 1
    assert fingerprints.likeness(fingerprints.fingerprint("a b c"), fingerprints.fingerprint("a b c")) == 1


# 5 n-gram Jaccard join


def brute_components(rows):
    sets = []
    for r in rows:
        w = words(r.text)
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if rows[i].doc_id is not None and rows[j].doc_id is not None and sets[i] and sets[j] and 100 * both >= 75 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r.doc_id is not None:
            least[find(i)] = min(least.get(find(i), r.doc_id), r.doc_id)
    return sorted((str(r.doc_id), len(s), str(None if r.doc_id is None else least[find(i)])) for i, (r, s) in enumerate(zip(rows, sets, strict=True)))


def near_copies(spark):
    rng = np.random.default_rng(3)
    rows = []
    for group in range(4):
        base = [f"w{x}" for x in rng.integers(0, 5000, 120)]
        for copy in range(60):
            w = list(base)
            for at in rng.integers(0, len(w), rng.integers(0, 5)):
                w[at] = f"e{rng.integers(0, 10**6)}"
            rows.append((len(rows), " ".join(w[: len(w) - int(rng.integers(0, 30))])))
    shared = " ".join(f"s{i}" for i in range(60))
    rows += [(len(rows) + i, shared + " " + " ".join(f"o{x}" for x in rng.integers(0, 10**6, 40))) for i in range(50)]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_jaccard_components_agree_with_brute_force(spark, docs, odd, monkeypatch):
    for size in (2_000_000, 3000):
        monkeypatch.setattr(jaccard, "PART_ENTRIES", size)
        monkeypatch.setattr(jaccard, "PRODUCT_ENTRIES", 130_000 if size > 10_000 else 2500)
        for df in (docs, odd, near_copies(spark)):
            got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in jaccard.components(df).collect())
            assert got == brute_components(df.collect())


def test_jaccard_keeps_one_of_each(spark, odd, empty):
    df = near_copies(spark)
    kept = jaccard.keep_one(df)
    assert {r.doc_id for r in kept.collect()} == {int(c) for _, _, c in brute_components(df.collect())}
    assert jaccard.components(empty).count() == 0 and jaccard.keep_one(empty).count() == 0
    assert jaccard.keep_one(odd).columns == odd.columns
    same_id = spark.createDataFrame([(1, "one two three four five", "x"), (1, "six seven eight nine ten", "x"), (1, "one two three four five", "y"), (2, "one two three four five", "z")], "doc_id long, text string, other string")
    out = sorted((r.doc_id, r.text) for r in jaccard.keep_one(same_id).collect())
    assert out == [(1, "one two three four five"), (1, "six seven eight nine ten")]


# 6 exact top-k


def brute_top(rows, k, every):
    vectors = []
    for i, v, *_ in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            vectors.append((i, [max(-(2**63), min(2**63 - 1, math.floor(64 * x))) for x in v]))
    out = []
    for at, (q, a) in enumerate(vectors):
        if q % every == 0:
            score = lambda b, a=a: max(-(2**63), min(2**63 - 1, sum(x * y for x, y in zip(a, b, strict=False))))
            scores = sorted((-score(b), i) for n, (i, b) in enumerate(vectors) if n != at)
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores[:k])]
    return sorted(out)


def test_top_k_agrees_with_brute_force(spark, small, monkeypatch):
    df = spark.read.parquet(f"{small}/embeddings.parquet")
    rows = [tuple(r) for r in df.collect()]
    rng = np.random.default_rng(1)
    uneven = [(i, [float(x) for x in rng.normal(0, 1, 8) * 10 ** rng.uniform(-1, 1)], 0) for i in range(700)]
    same = [(i, [0.5, 0.25], 0) for i in range(90)] + [(90, None, 0), (100, [None, 1.0], 0), (120, [float("nan"), 1.0], 0), (140, [float("inf"), 1.0], 0), (None, [1.0, 1.0], 0), (20, [0.5, 0.25], 0), (40, [-9.0, 0.0], 0), (160, [], 0)]
    monkeypatch.setattr(topk, "BUCKET_ROWS", 64)
    monkeypatch.setattr(topk, "QUERY_ROWS", 8)
    large = [(i, [x * 10.0**e for x in (1.5, -2.5)], 0) for i, e in enumerate([3, 8, 9, 10, 16, 17, 18, 30] * 4)]
    twice = [(i % 50, [float(x) for x in rng.normal(0, 1, 4)], 0) for i in range(200)]
    for some in (rows, uneven, same, large, twice, rows[:7], []):
        table = spark.createDataFrame(some, "vec_id long, embedding array<double>, label int")
        assert sorted(map(tuple, topk.top_k(table).collect())) == brute_top(some, 20, 20)


@pytest.mark.parametrize(("rows", "bucket", "values"), [(6_000, 1024, 1000), (49_000, 8192, 1000), (6_000, 1024, 3), (5_000, 300, 40)])
def test_top_k_of_ranges_that_make_several_buckets(spark, monkeypatch, rows, bucket, values):
    """Bounds of ranges are sampled, so that some hold more than a bucket; with few values ties go across."""
    monkeypatch.setattr(topk, "BUCKET_ROWS", bucket)
    x = F.transform(F.sequence(F.lit(1), F.lit(16)), lambda i: (F.pmod(F.xxhash64("id", i), F.lit(values)) / 64 - (values // 2) / 64).cast("float"))
    df = spark.range(rows).select(F.col("id").alias("vec_id"), x.alias("embedding"))
    v = np.array([r.embedding for r in df.orderBy("vec_id").collect()], dtype=np.float64)
    v = np.floor(64 * v).astype(np.int64)
    got = {}
    for r in topk.top_k(df).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    assert sorted(got) == list(range(0, rows, 20))
    for q, found in got.items():
        scores = v @ v[q]
        order = np.lexsort((np.arange(rows), -scores))
        order = order[order != q][:20]
        assert [found[k] for k in sorted(found)] == [(int(i), int(scores[i])) for i in order]


# 7 language ID


def test_language_of_held_out_texts(spark, small):
    df = spark.read.parquet(f"{small.replace('0.001', '0.01')}/documents.parquet")
    lang = {r.doc_id: r.lang for r in df.collect()}
    held = [r for r in langid.digests(df, PIECES).collect() if r.held_out]
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in held]) > 0.97 and all(0 <= r.score <= 1 for r in held)


def brute_log(word, ids, table, rescale=16):
    """The forward sum over one word, piece by piece, its logarithm kept apart."""
    pieces = {p.encode(): i for p, i in ids.items()}
    raw, least, reach = "▁".encode() + word, np.where(table > 0, table, 1.0).min(axis=0) / 2, max(map(len, pieces))
    f, shift = [np.zeros(table.shape[1])] + [None] * len(raw), [np.zeros(table.shape[1])]
    f[0] = np.zeros(table.shape[1])  # logarithms throughout
    for end in range(1, len(raw) + 1):
        terms = [f[s] + np.log(table[pieces[raw[s:end]]]) for s in range(max(0, end - reach), end) if raw[s:end] in pieces]
        if raw[end - 1] > 127 or chr(raw[end - 1]) not in ids:
            terms.append(f[end - 1] + np.log(least))
        f[end] = np.logaddexp.reduce(terms, axis=0)
    return f[-1]


def test_language_scores_sum_over_all_segmentations_of_words_of_any_length(monkeypatch):
    _, ids = langid._vocabulary(PIECES)
    rng = np.random.default_rng(0)
    size = max(ids.values()) + 1
    table = np.zeros((size, 2))
    table[list(ids.values())] = rng.random((len(ids), 2)) ** 9
    table /= table.sum(axis=0)
    some = [b"hello", b"zebra", "été".encode(), b"aaaaaaa", "日本語の文章は空白がないので長い".encode() * 9, "предложение".encode() * 30, b"z" * 777, "\U0001f600".encode() * 40, ("ภาษาไทย" * 60).encode(), b"internationalization" * 500]
    for segment in (4096, 64):
        monkeypatch.setattr(langid, "SEGMENT", segment)
        scorer = langid.Scorer(PIECES, table)
        scorer.remember(set(some))
        for w in some:
            assert scorer.scores[scorer.at[w]] == pytest.approx(brute_log(w, ids, table), rel=1e-9)


def test_language_agrees_with_brute_force_in_any_grouping(spark, small, odd):
    pieces, ids = langid._vocabulary(PIECES)
    few = spark.read.parquet(f"{small}/documents.parquet").where("length(text) < 700").select("doc_id", "text", "lang")
    for df in (few, odd.select("doc_id", "text", "lang")):
        rows = df.collect()
        crc = lambda i: zlib.crc32(str("" if i is None else i).encode()) % 4
        counts = defaultdict(Counter)
        runs = lambda t: re.findall(r"[a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        for r in rows:
            if crc(r.doc_id) != 2 and r.lang is not None and r.text is not None:
                counts[r.lang] += Counter()
                for w in runs(r.text):
                    counts[r.lang].update(pieces.encode(w))
        langs = sorted(x for x in counts if counts[x])
        table = np.zeros((pieces.get_piece_size(), len(langs)))
        for j, lang in enumerate(langs):
            for i in ids.values():
                table[i, j] = counts[lang][i] + 0.1
        table /= table.sum(axis=0)
        known = {}
        want = []
        for r in rows:
            logs = np.zeros(len(langs))
            for w in runs(r.text):
                if w not in known:
                    known[w] = brute_log(w.encode(), ids, table)
                logs = logs + known[w]
            told = any(map(str.isalpha, r.text or ""))
            want.append((r.doc_id, langs[int(np.argmax(logs))] if told else "und", float(1 / np.exp(logs - logs.max()).sum()) if told else 0.0))
        for size in (64, 1):
            got = langid.predict(df.select("doc_id", "text"), PIECES, langid.learn(df, PIECES), size=size).collect()
            assert sorted((str(r.doc_id), r.lang_pred, round(r.score, 6)) for r in got) == sorted((str(i), p, round(s, 6)) for i, p, s in want)


def test_language_of_odd_rows(odd, empty):
    got = langid.digests(odd, PIECES).collect()
    assert len(got) == len(ODD) and {r.lang_pred for r in got if r.doc_id in (1, 2, 3)} == {"und"}
    assert langid.digests(empty, PIECES).count() == 0


# 8 mixing


def test_mixing_targets_and_copies(docs, odd):
    for df in (docs, odd):
        rows = df.collect()
        planned = mixing.plan(df).collect()
        assert len(planned) == len(rows)
        size = Counter()
        for r in rows:
            size[r.source] += len(words(r.text))
        order = sorted(size, key=lambda s: (s is None, s or ""))
        weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
        target, total = dict.fromkeys(order, 0.0), sum(size.values())
        while True:  # share, stop, share what is over
            open_ = [s for s in order if target[s] < 3 * size[s]]
            over = total - sum(target.values())
            if over < 1e-6 or not open_:
                break
            for s in open_:
                target[s] = min(3 * size[s], target[s] + over * weight[s] / sum(weight[x] for x in open_))
        for r in planned:
            assert (r.source_size, r.target) == (size[r.source], pytest.approx(target[r.source]))
            rate = r.target / r.source_size if r.source_size else 0
            assert math.floor(rate + 1e-9) <= r.copies <= math.ceil(rate - 1e-9) or r.copies == math.floor(rate)
        mixed = mixing.mix(df)
        assert mixed.columns == df.columns and mixed.count() == sum(r.copies for r in planned)
        assert sorted(map(str, mixing.plan(df).collect())) == sorted(map(str, planned))


def test_mixing_in_any_number_of_parts(spark, docs, odd, monkeypatch):
    monkeypatch.setattr(common, "SALT_ROWS", 10**9)
    want = [sorted(map(str, mixing.digests(df).collect())) for df in (docs, odd)]
    monkeypatch.setattr(common, "SALT_ROWS", 2)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert [sorted(map(str, mixing.digests(df).collect())) for df in (docs, odd)] == want
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_mixing_moves_no_text_where_targets_are_small(docs):
    plan = mixing.mix(docs)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "Exchange hashpartitioning" not in plan


def test_mixing_keeps_clashing_columns(spark):
    rows = [(i, "some words here", "abc"[i % 3], -1, "t", 5, "k") for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size int, target string, copies int, __salt string")
    out = mixing.mix(df)
    assert out.columns == df.columns and {tuple(r) for r in out.collect()} <= set(rows)


def test_mixing_of_nothing(empty):
    assert mixing.plan(empty).count() == 0


# 10 secrets


def brute_secrets(text):
    text = text or ""
    found = []
    for order, (kind, pattern, flags, group, least) in enumerate(
        [
            ("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 0, 2, 8),
            ("access", r"AKIA[A-Z0-9]+", 0, 0, 16),
            ("hex", r"[0-9a-f]+", 0, 0, 32),
        ]
    ):
        found += [(m.start(), order, m.end(), kind) for m in re.finditer(pattern, text, flags) if len(m[group]) >= least]
    spans = ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(found))
    return (*(sum(x[3] == k for x in found) for k in ("assign", "access", "hex")), hashlib.sha256(spans.encode()).hexdigest())


def test_secrets_agree_with_brute_force(spark, docs, odd):
    made = ["toKen = 'abcdefgh'", "token: short", "api_key=0123456789abcdef apikey : \"x.y-z=12\"", "tokeNſ=aaaaaaaaa KEY", "AKIA" + "Z" * 11, "AKIA" + "Z" * 12 + "akia", "f" * 31 + " " + "0" * 32 + "G", "pass" + "word=" + "token=12345678", "é" * 5 + "secret=" + "k" * 9, "-----BEGIN RSA PRIVATE KEY-----"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(made)], "doc_id long, text string")
    for some in (df, docs, odd):
        want = sorted(str((r.doc_id, *brute_secrets(r.text))) for r in some.collect())
        got = secret_scan.digests(some).collect()
        assert sorted(str(tuple(r)[:5]) for r in got) == want
    assert [r.spans for r in secret_scan.digests(df.where("doc_id = 9")).collect()] == ["pem:0:31"]


def test_trigram_queries_are_fulfilled_by_every_match(docs):
    for rule in secret_scan.RULES:
        folded = lambda s: s.encode().translate(secret_scan.LOWER)
        for r in docs.collect():
            if rule.spans(r.text):
                assert all(any(all(t in folded(r.text) for t in s) for s in clause) for clause in rule.query)
    by = {r.kind: r.query for r in secret_scan.RULES}
    assert by["hex"] == [] and by["assign"] and by["access"] == [frozenset({frozenset({b"aki", b"kia"})})]


def test_secrets_of_nothing(empty):
    assert secret_scan.scan(empty).count() == 0
