"""Source mixing: targets, exact quotas of the tree, disjoint draws, and edge cases."""

from collections import Counter

import numpy as np
import pytest

from docloom.llm import mixing


def by_hand(sizes, most=3):
    """Targets by resharing one excess after the other."""
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        level = (total - sum(fixed.values())) / max(1, sum(weight[s] for s in free))
        over = [s for s in free if level * weight[s] > most * sizes[s]]
        if not over:
            return {s: fixed.get(s, level * weight[s]) for s in names}
        fixed |= {s: most * sizes[s] for s in over}


@pytest.fixture(scope="module")
def docs(spark):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(900):
        source = None if i % 50 == 0 else "big" if i % 3 else f"s{i % 7}"
        words = int(rng.integers(0, 60)) if i % 100 else 700
        rows.append((i if i % 40 else None, " ".join(["wörd\t"] * words) if words % 5 else None, source, i, "x", "y"))
    rows += [(5, "the same row twice", "tiny", 1, "x", "y")] * 2 + [(7, "", "void", 1, "x", "y")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, size int, target string, block string")


def test_targets_and_draws(docs):
    found = mixing.placements(docs).collect()
    sizes = {}
    for r in docs.collect():
        sizes[r["source"]] = sizes.get(r["source"], 0) + len((r["text"] or "").split())
    want = by_hand(sizes)
    assert len(found) == docs.count()
    taken = Counter()
    for r in found:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
        assert len(r["draws"]) <= 3 and len({d["copy"] for d in r["draws"]}) == len(r["draws"])
        taken[r["source"]] += r["size"] * len(r["draws"])
    assert Counter((r["doc_id"], r["size"]) for r in found) == Counter((r["doc_id"], len((r["text"] or "").split())) for r in docs.collect())
    for source, target in want.items():
        assert abs(taken[source] - target) <= max(0.02 * target, 4), source
    again = mixing.placements(docs.repartition(5)).collect()
    key = lambda r: (str(r["doc_id"]), r["size"], str(r["source"]), str(r["draws"]))
    assert sorted(map(key, found)) == sorted(map(key, again))


def test_tree_adds_up():
    quotas = np.array([500, 0, 3, 120, 77])
    total, shards = int(quotas.sum()), 23
    size = lambda a, b: b * total // shards - a * total // shards
    inner = list(mixing.split(quotas, np.zeros(5, np.int64), 0, shards, size, 1, 4))
    leaves = sorted((leaf for first, n, q, before in inner for leaf in mixing.split(q, before, first, n, size, 1, 1)), key=lambda x: x[0])
    assert [first for first, *_ in leaves] == list(range(shards))
    assert (sum(q for _, _, q, _ in leaves) == quotas).all()
    before = np.zeros(5, np.int64)
    for first, _, quota, at in leaves:
        assert quota.sum() == size(first, first + 1) and (at == before).all()
        before += quota


def test_tree_mixes():
    """A shard's share of a source varies as a random draw does, around the source's share."""
    quotas, size = np.array([300, 700]), lambda a, b: (b - a) * 100
    got = np.array([leaf[2][0] for seed in range(60) for leaf in mixing.split(quotas, np.zeros(2, np.int64), 0, 10, size, seed, 1)])
    assert abs(got.mean() - 30) < 1e-9 and 3.5 < got.std() < 5.2  # hypergeometric: 4.35


def test_mix_is_dealt_out(docs):
    mix = mixing.mixed_documents(docs, shard_blocks=16)
    assert mix.select("document.*").columns == docs.columns
    rows = mix.collect()
    drawn = Counter((r["document"]["doc_id"], r["document"]["text"]) for r in rows)
    placed = Counter()
    for r in mixing.placements(docs, shard_blocks=16).collect():
        placed[r["doc_id"]] += len(r["draws"])
    assert Counter({k: n for k, n in placed.items() if n}) == sum((Counter({k[0]: n}) for k, n in drawn.items()), Counter())
    assert len({r["shard"] for r in rows}) > 10


def test_empty_and_wordless(spark, docs):
    assert mixing.placements(docs.limit(0)).count() == 0
    assert mixing.mixed_documents(docs.limit(0)).count() == 0
    rows = mixing.placements(spark.createDataFrame([(1, None, None), (2, " ", "a")], "doc_id long, text string, source string")).collect()
    assert [(r["size"], r["target"]) for r in rows] == [(0, 0.0)] * 2
