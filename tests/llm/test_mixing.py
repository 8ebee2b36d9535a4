from collections import Counter, defaultdict

import numpy as np
import pytest

from stratascan.llm import mixing


def brute_targets(sizes, weights, most=3.0):
    fixed = {}
    while True:
        free = [k for k in range(len(sizes)) if k not in fixed]
        left = sum(sizes) - sum(fixed.values())
        got = {k: left * weights[k] / sum(weights[f] for f in free) for k in free}
        over = [k for k in free if got[k] > most * sizes[k]]
        if not over:
            return [fixed.get(k, got.get(k, 0.0)) for k in range(len(sizes))]
        fixed |= {k: most * sizes[k] for k in over}


@pytest.mark.parametrize("sizes", [[10, 10, 10], [1, 1000, 5, 7, 0, 300], [0, 0], [5], [100, 1, 1, 1, 1, 1, 1]])
def test_targets(sizes):
    w = [mixing.WEIGHTS[k % 3] for k in range(len(sizes))]
    assert mixing.targets(sizes, w) == pytest.approx(brute_targets(sizes, w))


def test_splitting_tree_is_exact():
    quotas = np.array([256, 0, 1, 77, 256])
    parts = mixing.split_quotas(quotas, 8, np.random.default_rng(1))
    assert parts.shape == (8, 5) and (parts.sum(0) == quotas).all() and np.ptp(parts.sum(1)) <= 3


def make(spark):
    rows = [(k, "w " * (k % 37) + "end", "src" + str(k % 4)) for k in range(400)] + [(1000 + k, "tiny", "zzz") for k in range(3)]
    rows += [(2000, None, "src1"), (2001, "", None), (2002, "a b c", None), (2002, "a b c", None), (None, "x y", "src2"), (2003, "v " * 50000, "src0")]
    return rows, spark.createDataFrame([(*r, "t") for r in rows], "doc_id long, text string, source string, `row.key` string")


def test_plan(spark):
    rows, docs = make(spark)
    got = mixing.plan(docs, blocks=32).collect()
    assert len(got) == len(rows)
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = dict(zip(order, brute_targets([sizes[s] for s in order], [mixing.WEIGHTS[k % 3] for k in range(len(order))])))
    taken, spans, in_block, in_shard = defaultdict(int), defaultdict(list), Counter(), Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert r.taken == sum(c.words for c in r.copies) <= 3 * r.size and all(c.words > 0 for c in r.copies)
        taken[r.source] += r.taken
        for c in r.copies:
            spans[r.source, c.block].append(c.shard)
            in_block[r.source, c.block] += c.words
            in_shard[c.shard] += c.words
    for s in order:
        assert abs(taken[s] - want[s]) <= 1
    assert all(len(set(v)) == 1 for v in spans.values())  # a block is one shard's
    # Blocks are of one size, whatever their source, and quotas follow the targets.
    size = sum(taken.values()) / (8 * 32)
    for s in order:
        own = [n for (of, _), n in in_block.items() if of == s]
        if own:
            assert max(own) - min(own) <= 1 and len(own) == max(1, round(taken[s] / size)) and abs(len(own) * size - taken[s]) <= size
    blocks = Counter(v[0] for v in spans.values())
    assert max(blocks.values()) - min(blocks.values()) <= 1 and abs(sum(blocks.values()) - 8 * 32) <= len(order)
    assert max(in_shard.values()) - min(in_shard.values()) <= 3 * size  # shards' words are even
    assert sorted(map(str, got)) == sorted(map(str, mixing.plan(docs, blocks=32).collect()))
    assert mixing.plan(docs.filter("false")).count() == 0
    assert [r.taken for r in mixing.plan(docs.filter("text is null")).collect()] == [0]


def test_the_tree_draws_as_dealing_all_blocks_at_random_does():
    """Counts of a source's blocks in shards have the mean and variance of a shuffle of all blocks that is dealt out."""
    quotas, shards, n = np.array([40, 9, 25, 6]), 4, 3000
    rng = np.random.default_rng(4)
    tree = np.array([mixing.split_quotas(quotas, shards, rng) for _ in range(n)])
    labels = np.repeat(np.arange(4), quotas)
    dealt = np.array([[np.bincount(part, minlength=4) for part in np.split(rng.permutation(labels), shards)] for _ in range(n)])
    assert np.abs(tree.mean(0) - dealt.mean(0)).max() < 0.2 and np.abs(tree.mean(0) - quotas / shards).max() < 0.2
    assert np.abs(tree.var(0) / dealt.var(0) - 1).max() < 0.15
    cross = lambda x: np.mean((x[:, 0, 0] - x[:, 0, 0].mean()) * (x[:, 0, 2] - x[:, 0, 2].mean()))
    assert abs(cross(tree) - cross(dealt)) < 0.3


def test_quotas():
    assert mixing.block_quotas([500, 300, 200, 0], 100).tolist() == [50, 30, 20, 0]
    assert mixing.block_quotas([10**6, 1, 0], 256).tolist() == [256, 1, 0]
    assert mixing.block_quotas([3, 2], 256).tolist() == [3, 2]
    assert mixing.block_quotas([], 8).tolist() == []


def test_mixed_documents(spark):
    rows, docs = make(spark)
    plan = Counter()
    for r in mixing.plan(docs).collect():
        for epoch in {c.epoch for c in r.copies}:
            plan[r.doc_id, r.source] += 2 * sum(c.words for c in r.copies if c.epoch == epoch) >= r.size
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    assert Counter((r.doc_id, r.source) for r in out.collect()) == +plan
    assert mixing.mixed_documents(docs.filter("false")).count() == 0


def test_a_row_that_repeats_in_full(spark):
    """Thousands of equal rows come as often as the plan takes them, and not from one task."""
    rows = [(k, f"own words {k} " * (1 + k % 5), f"src{k % 2}") for k in range(2000)] + [(9999, "the same row again", "src0")] * 4000 + [(9998, "twice the same", "src1")] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want = Counter()
    for r in mixing.plan(docs).collect():
        for epoch in {c.epoch for c in r.copies}:
            want[r.doc_id] += 2 * sum(c.words for c in r.copies if c.epoch == epoch) >= r.size
    out = mixing.mixed_documents(docs)
    assert Counter(r.doc_id for r in out.collect()) == +want and want[9999] > 3000
    assert {(r.text, r.source) for r in out.filter("doc_id = 9999").distinct().collect()} == {("the same row again", "src0")}
