import numpy as np

from grainmill.llm import gru


def test_texts_scored_together_score_as_alone():
    rng = np.random.default_rng(5)
    sizes = np.array([3, 90, 1, 40])
    first, symbols = np.concatenate(([0], np.cumsum(sizes))), rng.integers(0, gru.SYMBOLS, sizes.sum())
    together = gru.score(gru.initial(), symbols, first, 7)
    alone = [gru.score(gru.initial(), symbols[a:b], np.array([0, b - a]), 7)[0] for a, b in zip(first[:-1], first[1:], strict=True)]
    assert np.allclose(together, alone, atol=1e-3)


def test_a_window_costs_few_new_pages():
    import resource

    from grainmill.llm.text import give_back, hold

    hold()
    rng = np.random.default_rng(6)
    symbols = rng.integers(0, gru.SYMBOLS, 200_000)
    gru.train(gru.initial(), symbols[:50_000], np.zeros(50_000, bool), 1, 1, 0.01)
    before = resource.getrusage(resource.RUSAGE_SELF).ru_minflt
    gru.train(gru.initial(), symbols, np.zeros(200_000, bool), 1, 1, 0.01)
    faults = resource.getrusage(resource.RUSAGE_SELF).ru_minflt - before
    give_back()
    assert faults < 20_000
