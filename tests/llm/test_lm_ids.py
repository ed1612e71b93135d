"""The language model trains on every window and predicts ids by their context."""

import numpy as np
import pytest

from murmurlake.llm import lm_scoring as lm
from test_lm_scoring import small


def trees(seed):
    vocabulary, w = small()
    rng = np.random.default_rng(seed)
    return vocabulary, w | {"n": rng.normal(0, 0.5, (300, lm.WIDTH)).astype(np.float32), "nb": vocabulary.bias.copy()}, rng


def test_trees_begin_as_shares_and_add_up_to_one():
    vocabulary, w, _ = trees(1)
    b = np.random.default_rng(2).normal(size=(1, lm.WIDTH)).astype(np.float32)
    chances = np.exp(lm.within_class(w, vocabulary, np.repeat(b, 300, 0), np.arange(300)))
    assert np.allclose(np.bincount(vocabulary.kind, chances)[np.unique(vocabulary.kind)], 1, atol=1e-4)
    w["n"][:] = 0
    assert np.allclose(lm.within_class(w, vocabulary, np.repeat(b, 300, 0), np.arange(300)), vocabulary.within, atol=1e-4)


def test_gradients_of_ids_match_differences():
    vocabulary, w, rng = trees(3)
    w = {k: v.astype(np.float64) for k, v in w.items()}
    x, target = rng.integers(0, 300, (3, 7)), rng.integers(0, 300, (3, 7))
    use = rng.random((3, 7)) < 0.8
    place, node, right = vocabulary.paths(target[use])
    args = (x, vocabulary.kind[target], use.astype(float), (np.flatnonzero(use)[place], node, right))
    _, g = lm.gradients(w, *args)
    for k in ("n", "nb", "u", "o", "q", "e"):
        full = np.zeros_like(w[k])
        full[g["at"] if k in ("n", "nb") else slice(None)] = g[k]
        for i in rng.choice(np.flatnonzero(np.abs(full.ravel()) > 1e-4), 5):
            flat, step = w[k].reshape(-1), 1e-4
            old = flat[i]
            flat[i] = old + step
            up = lm.gradients(w, *args)[0]
            flat[i] = old - step
            down = lm.gradients(w, *args)[0]
            flat[i] = old
            assert full.ravel()[i] == pytest.approx((up - down) / 2 / step, rel=2e-2, abs=1e-5), k


def test_every_window_trains_and_rare_words_follow_their_context():
    # ids 2000 and 2001 are of one class and beyond those with input vectors of their own; each follows its own word
    counts = np.append(np.full(2100, 1000.0), np.ones(2000))
    counts[[2000 + 2100 - 100, 2001 + 2100 - 100]] = 1.5
    vocabulary = lm.Vocabulary.of(counts, lm.OWN, lm.CLASSES)
    one, two = 4000, 4001
    assert vocabulary.kind[one] == vocabulary.kind[two] and vocabulary.bucket[one] == vocabulary.bucket[two]
    rng = np.random.default_rng(5)
    pairs = [(7, one) if k else (8, two) for k in rng.integers(0, 2, 6000)]
    ids = np.array(pairs, np.int64).ravel()
    offsets = np.arange(0, len(ids) + 1, 100)
    w = lm.initial(vocabulary, lm.OWN, lm.CLASSES, lm.WIDTH) | {"n": np.zeros((len(counts), lm.WIDTH), np.float32), "nb": vocabulary.bias.copy()}
    seen, after = lm.train_part(iter([(ids, offsets)] * 4), w, vocabulary)
    assert seen == 4 * len(lm.windows(np.diff(offsets))[0])
    right, swapped = (lm.score_ids(after, vocabulary, np.array(x * 10, np.int64), np.array([0, 40]))[0] for x in ([7, one, 8, two], [7, two, 8, one]))
    assert right > swapped + 10
