"""What a batch of texts takes of a worker's memory."""

import tracemalloc

import numpy as np

from lengthloom.llm import hmm


def test_posteriors_hold_few_tables():
    rng = np.random.default_rng(2)
    m = hmm.Model(rng.dirichlet(np.ones(hmm.STATES)), rng.dirichlet(np.ones(hmm.STATES), hmm.STATES), rng.dirichlet(np.ones(500), hmm.STATES).T)
    texts = [rng.integers(0, 500, k) for k in (*rng.integers(1, 900, 400), 9000)]
    tracemalloc.start()
    hmm.posteriors(m, texts)
    most = tracemalloc.get_traced_memory()[1] / (sum(map(len, texts)) * hmm.STATES * 4)
    tracemalloc.stop()
    assert most < 6, most  # in tables of a float a symbol and state
