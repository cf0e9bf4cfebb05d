"""The language model learns from all n-grams, rare ones beside frequent ones included."""

import numpy as np

from demandlens.llm import lm


def test_every_n_gram_is_visited():
    counts = np.array([10_000] + [1] * 50)
    contexts = np.arange(51)
    unigram = np.full(4, 0.25)
    start = lm.LogBilinear.start(unigram, 51, 8)
    model, met = lm.nce_pass(start, contexts, contexts, contexts % 4, counts, unigram, 1, 0.1)
    assert (model.r != start.r).any(axis=1).all()
    assert (met > 0).all()
