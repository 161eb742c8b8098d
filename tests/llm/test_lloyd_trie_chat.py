"""Operators 11 to 13 against brute force and their SQL, in many and few parts, and on the edge cases that
their docstrings name."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from boxlines.llm import chat, lloyd, trie
from boxlines.llm.queries import ORACLES, QUERIES

TURNS = "conv_id long, turn long, role string, text string"


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: tuple((x is None, x if x is not None else 0) for x in r))


@pytest.fixture(params=["3", "40"])
def parts(spark, request):
    """Few and many partitions, which Spark leaves as they are."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", request.param)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield int(request.param)
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("name", ["op11_dual_tree_lloyd", "op12_prefix_trie", "op13_chat_format"])
def test_queries_agree_with_their_sql(spark, small, name):
    db = duckdb.connect()
    for table in ("embeddings", "conversations"):
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{small}/{table}.parquet'")
    df = QUERIES[name](spark, small)
    found = db.execute(ORACLES[name])
    assert [c[0] for c in found.description] == df.columns
    assert ordered(df.collect()) == ordered(found.fetchall())


# 11 dual-tree Lloyd


def brute_lloyd(rows, k, rounds=5, width=64):
    held = lambda x: max(-(2**27), min(2**27, int(np.floor(256 * float(np.float32(x))))))
    kept = [(i, [held(x) for x in e]) for i, e in rows if e is not None and len(e) == width and all(x is not None and np.isfinite(x) for x in e)]
    v = np.array([e for _, e in kept], dtype=np.int64)
    first = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), e) for i, e in kept if i is not None)[:k]
    c = np.array([e for _, e in first], dtype=np.int64)

    def assigned():
        d = np.stack([((v - x) ** 2).sum(axis=1) for x in c], axis=1)
        a = d.argmin(axis=1)
        return a, d[np.arange(len(v)), a]

    for _ in range(rounds):
        a, _d = assigned()
        for j in range(len(c)):
            if (a == j).any():
                c[j] = [int(x) // int((a == j).sum()) for x in v[a == j].sum(axis=0)]
    a, d = assigned()
    inertia = {int(j): int(d[a == j].sum()) for j in set(a)}
    return [(i, int(x), int(y), inertia[int(x)], int(d.sum()), hashlib.sha256(",".join(map(str, c[x].tolist())).encode()).hexdigest()) for (i, _), x, y in zip(kept, a, d, strict=True)]


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(0)
    base = rng.normal(size=(6, 64))
    rows = [(i % 1100 if i % 50 else None, (base[i % 6] * (i % 3) + rng.normal(size=64) * 0.05 * (i % 4)).astype(np.float32).tolist()) for i in range(1200)]
    rows += [(9000 + i, [0.5] * 64) for i in range(500)]  # a third are equal
    return rows + [(1, None), (2, [1.0] * 63), (3, [float("nan")] * 64), (4, [None] * 64), (5, [1e30] * 64), (6, [-1e30] * 32 + [1e30] * 32), (7, [3e6] * 64)]


@pytest.mark.parametrize(("block", "k"), [(2048, 40), (90, 40), (200, 7)])
def test_lloyd_agrees_with_brute_force(spark, vectors, monkeypatch, parts, block, k):
    monkeypatch.setattr(lloyd, "BLOCK_ROWS", block)
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>").withColumn("anchor", F.lit("clash")).withColumn("cluster", F.lit(1))
    assert ordered(lloyd.digests(df.repartition(5), k=k).collect()) == ordered(brute_lloyd(vectors, k))


def test_lloyd_of_few_and_of_none(spark, vectors):
    df = spark.createDataFrame(vectors[:3], "vec_id long, embedding array<float>")
    assert ordered(lloyd.digests(df).collect()) == ordered(brute_lloyd(vectors[:3], 40))
    assert lloyd.digests(df.limit(0)).count() == 0
    assert lloyd.digests(df.withColumn("vec_id", F.lit(None).cast("long"))).count() == 0


@pytest.mark.parametrize(("n", "leaf"), [(1, 1), (2, 1), (300, 1), (700, 16)])
def test_cover_tree_covers_and_parts(n, leaf):
    rng = np.random.default_rng(n)
    points = np.unique(rng.integers(-50, 50, size=(n, 3)), axis=0)
    tree, order = lloyd.cover_tree(points, leaf)
    assert sorted(order) == list(range(len(points))) and (tree.points == points[order]).all()
    assert (tree.starts[0], tree.ends[0]) == (0, len(points))
    for node in range(len(tree.starts)):
        inside = tree.points[tree.starts[node] : tree.ends[node]]
        assert tree.starts[node] <= tree.centres[node] < tree.ends[node]
        assert np.isclose(np.sqrt(((inside - tree.points[tree.centres[node]]) ** 2).sum(axis=1)).max(), tree.radii[node])
        kids = range(tree.kids_from[node], tree.kids_to[node])
        if kids:  # they part the node's points, and one has its centre
            assert [tree.starts[node], *(tree.ends[x] for x in kids)] == [*(tree.starts[x] for x in kids), tree.ends[node]]
            assert tree.centres[node] in tree.centres[list(kids)]
    if leaf == 1:
        assert sum(tree.kids_to == tree.kids_from) == len(points)


def test_walk_hands_whole_nodes_over():
    rng = np.random.default_rng(5)
    spots = rng.integers(-1000, 1000, size=(8, 16))
    points = np.unique(spots[rng.integers(0, 8, size=900)] + rng.integers(-9, 9, size=(900, 16)), axis=0)
    tree, _ = lloyd.cover_tree(points, 16)
    centroids, numbers = lloyd._centroid_tree(np.concatenate([spots, spots[:3]]))
    runs, given = lloyd.walk(tree, centroids, numbers)
    assert sum(b - a for a, b, _ in runs) == len(points) and len(runs) < 100
    assert (given == ((tree.points[:, None] - spots[None]) ** 2).sum(axis=2).argmin(axis=1)).all()


# 12 prefix trie


def brute_trie(rows):
    known = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            known[c].append((t is not None, t or 0, hashlib.sha256(f"{len(role)}\n{role}{text}".encode()).hexdigest(), role, text))
    known = {c: [x[3:] for x in sorted(v)] for c, v in known.items()}
    h = {c: zlib.crc32(str(c).encode()) % 9 for c in known}
    nodes, kids, below = defaultdict(list), defaultdict(list), {}
    made = {c: known.get(c - c % 5, [])[: h[c]] + known[c][h[c] :] for c in known}
    for c, turns in made.items():
        for d in range(len(turns) + 1):
            nodes[tuple(turns[:d])].append(c)
    for key in nodes:
        if key:
            kids[key[:-1]].append(key)
    for key in sorted(nodes, key=len, reverse=True):
        own = (len(nodes[key]) - 1) * len(key[-1][1].encode()) if key else 0
        below[key] = (sum(below[x][0] for x in kids[key]) if kids[key] else 1, own + sum(below[x][1] for x in kids[key]))
    ends = {key: ",".join(str(c) for c in sorted(m) if len(made[c]) == len(key)) for key, m in nodes.items()}
    return [(min(m), len(key), min(nodes[key[:-1]]) if key else None, len(m), len(kids[key]), *below[key], hashlib.sha256(ends[key].encode()).hexdigest()) for key, m in nodes.items()]


@pytest.fixture(scope="module")
def turns():
    rnd = random.Random(1)
    rows = []
    for c in [*range(60), 1000, 1003, 1004]:
        for t in range(rnd.choice([0, 1, 2, 3, 9, 12, 30])):
            rows.append((c, None if rnd.random() < 0.05 else t, rnd.choice(["user", "assistant", None]), rnd.choice(["a", "b", "", None, "é" * rnd.choice([1, 1, 1, 5])])))
    rows += [(7, t, "user", f"hot {t % 3}") for t in range(500)]  # one conversation has a third of the rows
    rows += [(2000 + 5 * c, t, "user", "same") for c in range(150) for t in range(3)]  # and one sequence another
    return rows + [(77, 1, "u", "x")] * 20 + [(None, 1, "u", "x"), (78, 1, "u", "long " * 100_000), (83, 1, "u", "long " * 100_000)]


def test_trie_agrees_with_brute_force(spark, small, turns, monkeypatch, parts):
    monkeypatch.setattr(trie, "CHUNK_BYTES", 10)
    df = spark.createDataFrame(turns, TURNS).repartition(5).withColumn("path", F.lit("clash")).withColumn("ka", F.lit("clash"))
    assert ordered(trie.digests(df).collect()) == ordered(brute_trie(turns))


def test_trie_of_nothing_and_of_turnless_conversations(spark, turns):
    df = spark.createDataFrame(turns, TURNS)
    assert trie.digests(df.limit(0)).count() == 0
    short = [(c, 0, "u", "x") for c in range(4001, 4005)]  # their source isn't there, so those with h > 0 have no turn
    assert ordered(trie.digests(spark.createDataFrame(short, TURNS)).collect()) == ordered(brute_trie(short))
    gone = [r for r in short if zlib.crc32(str(r[0]).encode()) % 9]
    assert ordered(trie.digests(spark.createDataFrame(gone, TURNS)).collect()) == ordered(brute_trie(gone))


def test_paths_part_the_nodes_and_hang_few_deep(spark, turns):
    sequences, convs = trie.rebuilt(trie.turns_of(spark.createDataFrame(turns, TURNS)))
    nodes = trie.prefix_trie(sequences, convs).collect()
    by_path = defaultdict(list)
    for r in nodes:
        by_path[r.path].append(r)
    for some in by_path.values():
        assert sorted(r.depth for r in some) == list(range(min(r.depth for r in some), max(r.depth for r in some) + 1))
        assert sum(r.n_children == 0 for r in some) == 1


# 13 chat formatting


def brute_chat(rows, template=chat.Template()):  # noqa: B008
    found = defaultdict(list)
    for c, t, role, text in rows:
        found[c].append((t is not None, t or 0, role or "", text or ""))
    out = []
    for c, some in found.items():
        state, broken = template.states()[0], 0
        some.sort(key=lambda x: x[:3])
        for *_, role, _text in some:
            to = template.ways.get((state, role))
            broken += to is None
            state = to or template.recover.get(role, state)
        escapes = lambda x: len(x) + len(re.findall(r"<\\*\|", x))
        chars = sum(12 + escapes(role) + 5 * role.count("\n") + 1 + escapes(text) + 11 for *_, role, text in some)
        loss = "".join(text for *_, role, text in some if role == "assistant")
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        out.append((c, len(some), sha("".join(f"{role}\n{text}\n" for *_, role, text in some)), len(loss), sha(loss), chars, broken, state in template.final))
    return out


@pytest.fixture(scope="module")
def talks():
    rnd = random.Random(2)
    rows = []
    for c in range(40):
        for t in range(rnd.choice([1, 2, 9])):
            role = rnd.choice(["user", "assistant", "tool", None, "a\nb<|x", "system"])
            rows.append((c, None if t == 0 and c % 7 == 0 else t, role, rnd.choice(["<|", "<\\|a", "<\\\\|<|im_end|>|>", "", None, "ü" * 9, "<", "|", "\\", chat.HOSTILE])))
    rows += [(13, t + 100, rnd.choice(["user", "assistant", "odd"]), f"hot <| {t}") for t in range(200)]
    return rows + [(None, 1, "user", "x"), (None, 2, "assistant", "y"), (99, 1, "user", "<|" * 400_000), (98, 5, "user", "twice"), (98, 5, "user", "twice")]


def test_chat_agrees_with_brute_force(spark, talks, monkeypatch, parts):
    monkeypatch.setattr(chat, "CHUNK_BYTES", 200)
    df = spark.createDataFrame(talks, TURNS).repartition(6).withColumn("part", F.lit("clash")).withColumn("segments", F.lit(1))
    want = brute_chat(talks)
    assert ordered(chat.digests(df).collect()) == ordered(want)
    pieces = chat.segments(df).collect()
    texts = defaultdict(str)
    for r in sorted(pieces, key=lambda r: (r.part, r["at"], r.segment)):
        texts[r.conv_id] += r.text
    assert {c: len(x) for c, x in texts.items()} == {r[0]: r[5] for r in want}
    for c, *_ in want:  # a whole conversation's text gives its turns back, whatever they say
        some = sorted((x for x in talks if x[0] == c), key=lambda x: (x[1] is not None, x[1] or 0, x[2] or ""))
        assert chat.read_back(texts[c]) == [(role or "", text or "") for _, _, role, text in some]
    broken = defaultdict(int)
    for r in pieces:
        broken[r.conv_id] += r.invalid and r.segment == 0
    assert dict(broken) == {r[0]: r[6] for r in want}
    assert all(r.loss == (r.role == "assistant" and r.segment == 1) for r in pieces)


def test_chat_template_is_declared(spark):
    template = chat.Template(start="<|s|>", end="<|e|>", newline="<|n|>", trained=frozenset({"bot"}), ways={("begin", "me"): "a", ("a", "bot"): "b"}, recover={}, final=frozenset({"b"}))
    df = spark.createDataFrame([(1, 0, "me", "<|s|>"), (1, 1, "bot", "x"), (2, 0, "bot", "y")], TURNS)
    got = {r.conv_id: (r.n_invalid, r.ends_well, r.loss_chars) for r in chat.digests(df, template).collect()}
    assert got == {1: (0, True, 1), 2: (1, False, 1)}
    with pytest.raises(AssertionError):
        chat.Template(start="###").states()


def test_chat_of_nothing(spark):
    df = spark.createDataFrame([], TURNS)
    assert chat.digests(df).count() == 0 and chat.segments(df).count() == 0
