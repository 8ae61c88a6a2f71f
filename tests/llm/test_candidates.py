"""Candidates for near copies: none is lost, and texts that have nothing rare in common aren't compared."""

import itertools

import numpy as np
import pytest

from barquet.llm import candidates, simhash
from barquet.llm.components import labels

from .test_pipeline import near_by_hand


def met(sets):
    """What each set's prefix, and the forest of those that meet, have for the sets' elements."""
    tokens = [(np.sort(x) >> np.uint64(32)).astype(candidates.TOKEN) for x in sets]
    counts = np.bincount(np.concatenate(tokens) >> candidates.TOKEN.type(32 - candidates.COUNT_BITS), minlength=1 << candidates.COUNT_BITS).astype(np.uint32)
    own = [candidates.prefix(t, counts, 0.8) for t in tokens]
    fps = np.array([simhash._majority([x], 4) for x in sets])
    u, v = candidates.bucket_links(np.concatenate(own), np.repeat(np.arange(len(own)), [len(x) for x in own]), fps, np.array([len(x) for x in sets]), 63, 0.8)
    return own, labels(len(sets), u, v)


def drawn(rng, n):
    return rng.integers(0, 1 << 63, n).astype(np.uint64) * 2


@pytest.mark.parametrize("few", [32, 2])
def test_no_pair_is_lost(monkeypatch, few):
    """Families on both sides of 0.8 that share common elements; buckets compared at once and one by one."""
    monkeypatch.setattr(candidates, "FEW", few)
    rng = np.random.default_rng(3)
    common, sets = drawn(rng, 40), []
    for _ in range(60):
        base = drawn(rng, int(rng.choice([3, 5, 6, 9, 20, 60, 300])))
        for _ in range(int(rng.integers(1, 12))):
            own = base.copy()
            new = rng.random(len(own)) < rng.random() * 0.25
            own[new] = drawn(rng, np.count_nonzero(new))
            sets.append(np.unique(np.concatenate([own, common[: int(rng.integers(0, 40))]])))
    own, label = met(sets)
    near = [(i, j) for i, j in itertools.combinations(range(len(sets)), 2) if 5 * len(both := np.intersect1d(sets[i], sets[j])) >= 4 * (len(sets[i]) + len(sets[j]) - len(both))]
    assert len(near) > 100 and all(len(np.intersect1d(own[i], own[j])) and label[i] == label[j] for i, j in near)
    assert len(set(label.tolist())) > 60


def test_work_follows_the_documents(monkeypatch):
    """Of 2,000,000 pairs of sets that share a passage only, few are compared; of a group of near copies, a few a member."""
    compared, near = [], candidates._near

    def counting(x, y, m, n, *more):
        compared.append(max(len(x), len(y)))
        return near(x, y, m, n, *more)

    monkeypatch.setattr(candidates, "_near", counting)
    rng = np.random.default_rng(4)
    passage = drawn(rng, 30)
    _, label = met([np.unique(np.concatenate([drawn(rng, 100), passage])) for _ in range(2000)])
    assert len(set(label.tolist())) == 2000 and sum(compared) < 2000
    compared.clear()
    base = drawn(rng, 100)
    _, label = met([np.unique(np.append(base, drawn(rng, 2))) for _ in range(2000)])
    assert len(set(label.tolist())) == 1 and sum(compared) < 30 * 2000


def test_near_copies_without_all_pairs(spark, monkeypatch):
    """The stage doesn't compare every two fingerprints; parts of few entries find what one part finds."""

    def all_pairs(*_):
        raise AssertionError("every two fingerprints are compared")

    monkeypatch.setattr(simhash, "link_forest", all_pairs)
    monkeypatch.setattr(candidates, "PART_ENTRIES", 50)
    rows = [(100 * f + k, " ".join([*(f"w{f}x{i}" for i in range(40)), *(f"y{k}" for _ in range(k // 3))])) for f in range(8) for k in range(12)]
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_classes(spark.createDataFrame([*rows, (9999, None)], "doc_id long, text string").repartition(3)).collect()}
    assert got == near_by_hand([*rows, (9999, None)])
