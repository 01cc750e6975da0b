import random

import pytest

from stratigraph.llm.ngram_join import jaccard_components, links, prefix_length, suffix_bound

from . import common


def near_copies(n, seed):
    """Groups of edited copies around the threshold, a passage all share, and unrelated texts."""
    rng, rows = random.Random(seed), []
    word = lambda: f"w{rng.randrange(4000)}"
    common_words = [word() for _ in range(30)]
    for g in range(n):
        base = [word() for _ in range(rng.randrange(6, 120))]
        for _ in range(rng.randrange(1, 12)):
            copy = list(base)
            for _ in range(rng.randrange(0, 6)):
                copy[rng.randrange(len(copy))] = word()
            rows.append((len(rows) * 7 % 1009 + 1009 * (len(rows) % 2), " ".join(copy if g % 3 else common_words + copy), "", "", 0))
    return rows


@pytest.mark.parametrize("rows", [common.AWKWARD, near_copies(25, 1), near_copies(25, 2), []])
def test_components(spark, rows):
    got = [tuple(r) for r in jaccard_components(common.docs(spark, rows)).collect()]
    key = lambda x: (x[0] is None, x)
    assert sorted(got, key=key) == sorted(common.jaccard_components(rows), key=key)


def test_hot_shingles_are_split(spark, monkeypatch):
    import stratigraph.llm.ngram_join as module

    monkeypatch.setattr(module, "HOT_ROWS", 2)
    rows = near_copies(25, 3)
    got = [tuple(r) for r in jaccard_components(common.docs(spark, rows)).collect()]
    assert sorted(got) == sorted(common.jaccard_components(rows))


def test_bounds():
    import numpy as np

    rng = np.random.default_rng(5)
    for _ in range(300):
        x, y = (np.unique(rng.integers(0, 60, rng.integers(1, 40)).astype(np.uint64)) for _ in range(2))
        both = len(np.intersect1d(x, y))
        assert suffix_bound(x, y) >= both
        assert links(x, y, 75) == (100 * both >= 75 * (len(x) + len(y) - both))
    assert [prefix_length(n, 75) for n in (0, 1, 4, 100)] == [0, 1, 2, 26]
