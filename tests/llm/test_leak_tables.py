"""The benchmark search's tables of minima grow with the items, not by a fixed size for each class and hash function."""

import numpy as np

from assetlake.llm import decontamination as D


def test_tables_are_small_and_find_each_item():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 2**63, n, np.uint64)) for n in range(5, 105)]
    classes = D.size_classes(sets, 20)
    assert sum(seen.nbytes for c in classes for _, _, seen in c.tables) < 2_000_000
    found, text = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    assert {(i, i) for i in range(len(sets))} <= D.candidates(found, text, classes)
