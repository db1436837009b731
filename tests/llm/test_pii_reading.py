"""op10's reading costs a fixed number of cheap passes over rows of memory."""

import numpy as np

from textloom.llm import crf, pii


def test_gates_cost_no_exp_or_tanh(monkeypatch):
    """Emissions are those of the plain LSTM, no row of gates goes through numpy's exp or tanh, and both ways are read in one step."""
    tagger = pii.CharTagger()
    rng = np.random.default_rng(4)
    for k in ("wf", "wb", "e"):
        tagger.p[k] = rng.normal(0, 0.7, tagger.p[k].shape)
    ids = rng.integers(0, pii._CODES, (90, 7)).astype(np.uint8)
    plain = tagger.emissions(ids.T.astype(int)).transpose(1, 0, 2)
    elements, products = [], []
    real = {f: getattr(np, f) for f in ("exp", "tanh", "matmul")}
    for f in ("exp", "tanh"):
        monkeypatch.setattr(np, f, lambda x, *a, f=f, **k: elements.append(np.size(x)) or real[f](x, *a, **k))
    monkeypatch.setattr(np, "matmul", lambda *a, **k: products.append(1) or real["matmul"](*a, **k))
    em = tagger.read(ids)
    assert np.abs(em - plain).max() < 2e-3 and em.transpose(0, 2, 1).flags.c_contiguous
    assert sum(elements) <= 2 * tagger.hidden * ids.size and len(products) == len(ids) + 1


def test_sigmoids():
    x = np.linspace(-60, 60, 4001, dtype=np.float32)
    y = x / np.float32(96)
    pii._sigmoids(y, np.empty_like(x), np.empty_like(x))
    assert np.abs(y - 1 / (1 + np.exp(x.astype(float)))).max() < 2e-6


def test_viterbi_is_the_best_path():
    """Against all paths, with ties, lengths of any size and labels beyond a sequence's end."""
    rng = np.random.default_rng(1)
    for _ in range(40):
        em, length = np.round(rng.normal(size=(3, 4, 3)), 1), rng.integers(1, 5, 3)
        trans, start = np.round(rng.normal(size=(3, 3)), 1), np.round(rng.normal(size=3), 1)
        path = crf.viterbi(em, length, trans, start)
        score = lambda b, y: start[y[0]] + sum(em[b, i, y[i]] for i in range(len(y))) + sum(trans[p, q] for p, q in zip(y, y[1:]))  # noqa: B023, B905, E731
        for b, n in enumerate(length):
            best = max(score(b, y) for y in np.ndindex(*[3] * n))
            assert abs(score(b, tuple(path[b, :n])) - best) < 1e-9 and not path[b, n:].any()
