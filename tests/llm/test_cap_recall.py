"""The cap filters' recall at the cosine limit holds at any number of vectors and dimension, by simulation."""

import pytest

from skygrain.llm.cap_filters import ProductCode


@pytest.mark.parametrize("dim", [8, 64])
@pytest.mark.parametrize("vectors", [2_000, 1_000_000, 10_000_000])
def test_recall_at_the_limit(dim, vectors):
    code = ProductCode.fitted(dim, vectors, 0.95)
    assert code.recall(0.95, pairs=600, seed=9) >= 0.98
