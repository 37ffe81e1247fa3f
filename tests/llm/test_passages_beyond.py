"""What two texts share beyond the end of a passage that all texts share."""

import random

import pytest

from test_passages_popular import uncovered, words_from


@pytest.mark.parametrize("more", [10, 20])
def test_longer_stretch_after_a_popular_passage(spark, more):
    rng = random.Random(30 + more)
    popular, texts = words_from(rng, 50), []
    for _ in range(50):
        longer = words_from(rng, more)
        texts += [words_from(rng, 30) + popular + longer + words_from(rng, 30) for _ in range(2)]
    assert uncovered(spark, texts) == set()
