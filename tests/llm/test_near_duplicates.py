import itertools
import random
from collections import defaultdict

import numpy as np

from stratamem.llm import near_duplicates as nd


def _groups(rows, threshold=0.6):
    sets = [(i, nd.words_of(t)) for i, t in rows if t is not None and nd.words_of(t)]
    parent = {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, x), (b, y) in itertools.combinations(sets, 2):
        if len(x & y) >= threshold * len(x | y) - 1e-9:
            parent[find(a)] = find(b)
    by = defaultdict(list)
    for i, _ in sets:
        by[find(i)].append(i)
    return {p for g in by.values() for p in itertools.combinations(sorted(g), 2)}


def _corpus(rng, n):
    vocab = [f"w{k}" for k in range(600)] + ["the", "a", "on"] * 20
    texts = [" ".join(rng.choice(vocab) for _ in range(rng.randrange(8, 40))) for _ in range(n)]
    for _ in range(n):
        words = rng.choice(texts).split(" ")
        for _ in range(rng.randrange(0, max(1, len(words) // 5))):
            words[rng.randrange(len(words))] = rng.choice(vocab)
        rng.shuffle(words)
        texts.append(" ".join(words).title() if rng.random() < 0.3 else " ".join(words))
    return texts


def test_recall_and_precision_against_all_pairs(spark):
    rng = random.Random(1)
    rows = list(enumerate(_corpus(rng, 250))) + [(9000, None), (9001, ""), (9002, " ?! "), (9003, "same"), (9004, "Same!"), (9004, "Same!")]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "cand_id long, content string, node string, words int")
    groups = nd.near_duplicate_groups(df, "cand_id", "content")
    got = {(r["cand_a"], r["cand_b"]) for r in nd.grouped_pairs(groups).collect()}
    want = _groups(rows[:-1])
    assert got <= want
    assert len(got) >= 0.97 * len(want) and (9003, 9004) in got
    ids = [r["rec_id"] for r in groups.collect()]
    assert not {9000, 9001, 9002} & set(ids) and ids.count(9004) == 2


def test_many_copies_are_one_node(spark):
    rows = [(i, "the same few words again") for i in range(3000)] + [(5000, "the same few words once again")]
    groups = nd.near_duplicate_groups(spark.createDataFrame(rows, "id long, t string"), "id", "t").collect()
    assert len({r["group_id"] for r in groups}) == 1 and {r["n_links"] for r in groups} == {1}


def test_a_hot_group_of_edited_copies_stays_whole(spark):
    rng = random.Random(2)
    base = [f"word{k}" for k in range(40)]
    rows = []
    for i in range(1500):
        words = list(base)
        for _ in range(2):
            words[rng.randrange(40)] = f"x{rng.randrange(100000)}"
        rows.append((i, " ".join(words)))
    groups = nd.near_duplicate_groups(spark.createDataFrame(rows, "id long, t string"), "id", "t").collect()
    assert len({r["group_id"] for r in groups}) == 1


def test_a_hot_group_with_words_of_their_own_stays_whole(spark):
    rng = random.Random(3)
    shared = [f"shared{k}" for k in range(30)]
    rows = []
    for i in range(600):
        own = [f"own{i}x{k}" for k in range(rng.choice([7, 8, 9, 10]))]  # Jaccard from 0.6 to 0.68
        rows.append((i, " ".join(shared + own)))
    rows += [(10_000 + i, " ".join(f"v{rng.randrange(3000)}" for _ in range(30))) for i in range(1200)]
    groups = nd.near_duplicate_groups(spark.createDataFrame(rows, "id long, t string"), "id", "t").collect()
    assert len({r["group_id"] for r in groups if r["rec_id"] < 10_000}) == 1
    assert len({r["group_id"] for r in groups if r["rec_id"] >= 10_000}) == len({" ".join(sorted(set(t.split()))) for i, t in rows if i >= 10_000})


def test_groups_are_whole_where_the_trees_miss_nearly_all(spark, monkeypatch):
    monkeypatch.setattr(nd, "BLOCK", 20, raising=False)
    rows = list(enumerate(_corpus(random.Random(4), 250)))
    groups = nd.near_duplicate_groups(spark.createDataFrame(rows, "id long, t string"), "id", "t", trees=1, window=1)
    assert {(r["cand_a"], r["cand_b"]) for r in nd.grouped_pairs(groups).collect()} == _groups(rows)


def test_links_do_not_depend_on_the_partitions(spark):
    rows = list(enumerate(_corpus(random.Random(5), 600)))
    sets = nd.distinct_sets(nd.word_sets(spark.createDataFrame(rows, "id long, t string"), "id", "t"))
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    found = []
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        for n in (1, 16):
            spark.conf.set("spark.sql.shuffle.partitions", str(n))
            found.append({(r["a"], r["b"]) for r in nd.links(sets, trees=1).collect()})
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert found[0] == found[1] and found[0]


def test_empty(spark):
    df = spark.createDataFrame([], "id long, t string")
    assert nd.near_duplicate_groups(df, "id", "t").count() == 0


class _Asked(np.ndarray):
    """An array that counts what is looked up by lists of places."""

    asked = 0

    def __getitem__(self, at):
        if isinstance(at, np.ndarray) and at.dtype != bool:
            _Asked.asked += at.size
        return np.asarray(super().__getitem__(at))


def test_exact_search_looks_one_by_one_only_at_pairs_that_both_halves_of_the_bitmap_leave():
    size, threshold = 400, 0.6
    rng = np.random.default_rng(3)
    low, high = np.full(size, 5, np.uint64), rng.integers(0, 1 << 48, size).astype(np.uint64)  # alike in the first half only
    high[7] = high[300]
    n, nodes = np.full(size, 30).view(_Asked), np.arange(size, dtype=np.int32)
    own = nd._Entries(low, high, nodes, nodes, n, np.full(size, 8, np.uint8), np.ones(size, bool))
    slack = (1 - threshold) / (1 + threshold)
    apart = np.bitwise_count(high[:, None] ^ high)
    wanted = {(a, b) for a, b in np.argwhere(apart <= slack * 60 + 1e-9).tolist() if a != b}
    _Asked.asked = 0
    found = {tuple(p) for pairs in nd._compare(own, None, slack, threshold) for p in pairs.T.tolist()}
    assert found == wanted and (7, 300) in found
    assert _Asked.asked < size * size / 8
