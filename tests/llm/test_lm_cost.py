"""The language model does the same work with fewer calls and products."""

import numpy as np
import pytest

from murmurlake.llm import lm_scoring as lm
from test_lm_ids import trees


def test_new_segments_are_encoded_together_and_equal_the_tokenizer():
    ids = lm.Ids(lm.RANKS_PATH)
    encode, calls = ids.encode, []
    ids.encode = lambda text: calls.append(text) or encode(text)
    words = ["cat", "dog's", "naïve,", "日本", "x" * 100, "end.\nNext", "a\n\nb", "%%%", "12é", "'s", "cat"]
    for text in (" ".join(words), " ".join(words) + "\n\n", " " + " ".join(words) + " ", " ".join(f"w{i}" for i in range(3000)), "a� ‍ b", "\n x"):
        calls.clear()
        run = any(x in text for x in ("  ", "\n "))
        assert np.frombuffer(ids.of(text, run), np.uint16).tolist() == encode(text)
        assert len(calls) <= 2  # one for what stands before the first space
    assert max(map(len, ids)) <= lm.MEMO_CHARS


def test_levels_of_ways_are_beginnings_of_the_ones_before():
    vocabulary, _, rng = trees(7)
    ids = rng.integers(0, 300, 50)
    place, node, right = vocabulary.paths(ids)
    level = [*np.flatnonzero(place == place[0]), len(place)]
    for a, b in zip(level, level[1:]):
        assert (place[a:b] == place[: b - a]).all()
    for i, one in enumerate(ids):
        way = slice(vocabulary.first[one], vocabulary.first[one + 1])
        assert node[place == i].tolist() == vocabulary.node[way].tolist() and right[place == i].tolist() == vocabulary.right[way].tolist()
    assert [len(x) for x in vocabulary.paths(ids[:0])] == [0, 0, 0]


def test_large_scores_are_chances_too():
    vocabulary, w, rng = trees(8)
    b, kind = rng.normal(size=(50, lm.WIDTH)).astype(np.float32), rng.integers(0, lm.CLASSES, 50)
    for size in (0.1, 10, 100):
        w["u"] = rng.normal(0, size, w["u"].shape).astype(np.float32)
        z = (b @ w["u"] + w["c"]).astype(float)
        log_chance = z - np.logaddexp.reduce(z, 1, keepdims=True)
        e, factor, total, own = lm.classes_of(w, b, kind)
        assert np.allclose(e * factor / total[:, None], np.exp(log_chance), rtol=1e-3, atol=1e-6)
        assert own == pytest.approx(log_chance[np.arange(50), kind], rel=1e-3, abs=1e-3) and (lm.classes_of(w, b, z.argmax(1))[3] <= 0).all()
