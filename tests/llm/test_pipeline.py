"""The pipeline stage by stage against brute force on the smallest documents."""

import hashlib
import math

import numpy as np
import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from boxlines.llm import bpe, langid

from .test_edges import brute_runs
from .test_operators import PIECES, RANKS, brute_components, words


@pytest.fixture(scope="module")
def stages(spark, small, tmp_path_factory):
    """What each stage was given, and what the last one made."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    seen = [docs]
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp(name) / "out")
        stage(spark, seen[-1], small).write.parquet(path)
        seen.append(spark.read.parquet(path))
    return seen


def test_language_stage_keeps_what_has_a_language(stages):
    pred = {r.doc_id: r for r in langid.digests(stages[0], PIECES).collect()}
    want = {i: r.lang_pred for i, r in pred.items() if r.lang_pred != "und" and r.score >= corpus_pipeline.LEAST_SCORE}
    got = stages[1].collect()
    assert {r.doc_id: r.lang for r in got} == want
    assert len(got) == len(want) and stages[1].columns == list(corpus_pipeline.COLUMNS)
    assert len(want) > 0.9 * len(pred)


def test_line_stage_keeps_first_places(stages):
    given = {r.doc_id: r.text for r in stages[1].collect()}
    want = {i: (text, len(text)) for i, (text, lost) in brute_runs(given).items() if not lost or words(text)}
    got = {r.doc_id: (r.text, r.n_chars) for r in stages[2].collect()}
    assert got == want


def test_near_copy_stage_keeps_one_of_each(stages):
    least = {int(c) for _, _, c in brute_components(stages[2].collect())}
    assert sorted(r.doc_id for r in stages[3].collect()) == sorted(least)


def brute_targets(rows):
    """Words of each source and its target: shares by weight, what is over 3 times a source's words dealt anew."""
    sizes = {}
    for r in rows:
        sizes[r.source] = sizes.get(r.source, 0) + len(words(r.text))
    order = sorted(sizes, key=lambda x: (x is None, x or ""))
    weight = {x: (5, 2, 1)[i % 3] for i, x in enumerate(order)}
    capped = set()
    while True:
        free = sum(sizes.values()) - sum(3 * sizes[x] for x in capped)
        share = {x: free * weight[x] / sum(weight[y] for y in order if y not in capped) for x in order if x not in capped}
        over = {x for x, t in share.items() if t > 3 * sizes[x]}
        if not over:
            return sizes, {x: share.get(x, 3 * sizes[x]) for x in order}
        capped |= over


def test_mixing_stage_takes_whole_copies(stages):
    rows = stages[3].collect()
    sizes, targets = brute_targets(rows)
    got = [r.doc_id for r in stages[4].collect()]
    for r in rows:
        u = int(hashlib.md5(f"mix:{r.doc_id}".encode()).hexdigest()[:13], 16) / 2**52
        rate = targets[r.source] / sizes[r.source]
        assert got.count(r.doc_id) == math.floor(rate) + (u < rate - math.floor(rate))


def test_encoding_stage_is_the_library_s(stages):
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(RANKS), special_tokens={})
    texts = {r.doc_id: r.text for r in stages[4].collect()}
    rows = stages[5].collect()
    assert len(rows) == stages[4].count()
    for r in rows:
        assert np.frombuffer(r.ids, "<u4").tolist() == library.encode_ordinary(texts[r.doc_id]) and r.n_tokens == len(r.ids) // 4


def test_run_gives_the_stages_rows(spark, small, stages):
    got = sorted((r.doc_id, r.n_tokens) for r in corpus_pipeline.run(spark, small).collect())
    assert got == sorted((r.doc_id, r.n_tokens) for r in stages[5].collect())
