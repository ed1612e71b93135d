"""The language model: gradients against differences, causality, every id scored once, learning, edge cases."""

import numpy as np
import pyarrow as pa
import pytest

from murmurlake.llm import lm_scoring as lm


def small():
    counts = np.arange(300, 0, -1).astype(float) ** 2
    vocabulary = lm.Vocabulary.of(counts, lm.OWN, lm.CLASSES)
    return vocabulary, lm.initial(vocabulary, lm.OWN, lm.CLASSES, lm.WIDTH)


def test_gradients_match_differences():
    vocabulary, w = small()
    rng = np.random.default_rng(1)
    w = {k: x.astype(np.float64) for k, x in w.items()}
    x, y = rng.integers(0, 300, (3, 7)), rng.integers(0, lm.CLASSES, (3, 7))
    use = (rng.random((3, 7)) < 0.8).astype(float)
    _, g = lm.gradients(w, x, y, use)
    for k in w:
        flat = w[k].reshape(-1)
        at = rng.choice(np.flatnonzero(np.abs(g[k].reshape(-1)) > 1e-4), 5)
        for i in at:
            old, step = flat[i], 1e-4
            flat[i] = old + step
            up = lm.gradients(w, x, y, use)[0]
            flat[i] = old - step
            down = lm.gradients(w, x, y, use)[0]
            flat[i] = old
            assert g[k].reshape(-1)[i] == pytest.approx((up - down) / 2 / step, rel=2e-2, abs=1e-5), k


def test_attention_is_causal():
    _, w = small()
    x = np.random.default_rng(2).integers(0, 300, (2, 20))
    other = x.copy()
    other[:, 12:] = 5
    a, b = lm.forward(w, x)["z"], lm.forward(w, other)["z"]
    assert np.allclose(a[:, :12], b[:, :12], atol=1e-5) and not np.allclose(a[:, 12:], b[:, 12:])


def test_scoring_is_the_forward_pass():
    _, w = small()
    x = np.random.default_rng(5).integers(0, 300, (4, lm.WINDOW))
    assert np.allclose(lm.class_scores(w, x), lm.forward(w, x)["z"], atol=1e-4)


def test_windows_score_each_place_once():
    lengths = np.array([0, 1, 31, 32, 33, 56, 57, 1000, 0])
    row, start, skip = lm.windows(lengths)
    seen = [np.zeros(n, int) for n in lengths]
    for r, s, k in zip(row, start, skip):
        seen[r][s + k : s + lm.WINDOW] += 1
    assert all((x == 1).all() for x in seen)


def test_scores_equal_one_window_at_a_time():
    vocabulary, w = small()
    rng = np.random.default_rng(3)
    rows = [rng.integers(0, 300, n) for n in (5, 0, 80, 33)]
    ids, offsets = lm.packed_ids(pa.array([r.astype(np.uint16).tobytes() for r in rows], pa.binary()))
    got = lm.score_ids(w, vocabulary, ids, offsets)
    for r, total in zip(rows, got):
        want = 0.0
        for i in range(len(r)):
            k = 0 if i < lm.WINDOW else -(-(i + 1 - lm.WINDOW) // lm.STRIDE)
            first = k * lm.STRIDE
            before = [lm.OWN + lm.CLASSES if first == 0 else vocabulary.bucket[r[first - 1]], *vocabulary.bucket[r[first:i]]]
            z = lm.forward(w, np.array([before]))["z"][0, -1].astype(float)
            want += z[vocabulary.kind[r[i]]] - np.log(np.exp(z).sum()) + vocabulary.within[r[i]]
        assert total == pytest.approx(want, abs=1e-2)


def test_chances_add_up_to_one():
    vocabulary, w = small()
    z = lm.forward(w, np.array([[lm.OWN + lm.CLASSES, 3, 7]]))["z"][0, -1].astype(float)
    assert np.exp(z[vocabulary.kind] - np.log(np.exp(z).sum()) + vocabulary.within).sum() == pytest.approx(1, abs=1e-5)


def test_ids_equal_the_tokenizer():
    own = lm.ids_of(lm.RANKS_PATH)
    for text in ("", "a quick  brown fox", "line\n\nline two", " lead", "日本 é"):
        assert np.frombuffer(own.of(text, "  " in text), np.uint16).tolist() == own.encode(text)


def test_learns_and_handles_odd_rows(spark):
    rng = np.random.default_rng(4)
    text = lambda n: " ".join(["the cat sat on the mat", "a dog ran to the park"][i] for i in rng.integers(0, 2, n))
    rows = [(i, text(40), 1, "p") for i in range(150)]
    words = "the cat sat on mat a dog ran to park".split()
    rows += [(1000, " ".join(rng.permutation(words * 24)), 1, "p"), (None, "the cat sat", 1, None), (1001, None, None, None), (1002, "", 1, ""), (1003, "the cat sat on the mat " * 3000, 1, "")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, n_tokens bigint, ids string")
    got = {r.doc_id: r for r in lm.score(df).collect()}
    own = lm.ids_of(lm.RANKS_PATH)
    assert len(got) == len(rows) and all(got[i].n_tokens == len(own.encode(t or "")) for i, t, *_ in rows)
    assert got[1001].perplexity is None and got[1002].log_chance == 0
    usual = np.median([got[i].perplexity for i in range(150)])
    assert usual < 0.6 * got[1000].perplexity and got[1003].perplexity < got[1000].perplexity
    assert lm.score(df.limit(0)).collect() == []
