"""The recurrent model against a plain scalar loop, numerical slopes, and itself in other company and file layouts."""

import math

import numpy as np

from panelwright.llm import language_model as lm


def drawn_network(seed):
    rng = np.random.default_rng(seed)
    return {k: (0.3 * rng.standard_normal(v.shape)).astype(np.float32) for k, v in lm.new_network(seed).items()}


def drawn_texts(seed, sizes):
    rng = np.random.default_rng(seed)
    return [rng.integers(0, lm.KNOWN, n).astype(np.int32) for n in sizes]


def scalar_score(net, ids, rounded=True):
    """Log-likelihood by one word and one state at a time, in double precision."""
    net = {k: (lm.rounded_matrix(v) if rounded and k in ("recur", "classes", "within") else v).astype(float) for k, v in net.items()}
    h, before, total, n = np.zeros(lm.HIDDEN), lm.END_ID, 0.0, lm.HIDDEN
    near = h
    for word in ids:
        x, u = net["inputs"][before], near @ net["recur"]
        r, z = (1 / (1 + np.exp(-(x[k * n : k * n + n] + u[k * n : k * n + n]))) for k in (0, 1))
        new = np.tanh(x[2 * n :] + r * u[2 * n :])
        h = new + z * (h - new)
        near = np.rint(h * lm.STEPS_OF_ONE) / lm.STEPS_OF_ONE if rounded else h
        c, place = divmod(int(word), lm.CLASS)
        for logits, goal in ((near @ net["classes"] + net["class_bias"], c), (near @ net["within"][c] + net["within_bias"][c], place)):
            total += logits[goal] - math.log(np.exp(logits).sum())
        before = word
    return total


def test_scores_equal_a_scalar_loop():
    net, texts = drawn_network(1), drawn_texts(2, [1, 2, 33, 64, 65, 200])
    for text, score in zip(texts, lm.text_scores(net, texts)):
        assert math.isclose(score, scalar_score(net, text), rel_tol=2e-4)
        assert math.isclose(score, scalar_score(net, text, rounded=False), rel_tol=1e-3)
    assert lm.text_scores(net, []).shape == (0,)


def test_scores_do_not_depend_on_company():
    net, texts = drawn_network(3), drawn_texts(4, [5, 70, 900, 1, 300] * 60 + [7000])
    texts += [texts[1], texts[300]]
    whole = lm.text_scores(net, texts)
    assert whole[301] == whole[1] and whole[302] == whole[300]
    for k in (0, 1, 2, 3, 150, 300):
        assert lm.text_scores(net, [texts[k]])[0] == whole[k]
        assert lm.text_scores(net, [*texts[k : k + 9], *texts[:5]])[0] == whole[k]


def test_gradients_against_differences():
    net = {k: v.astype(np.float64) for k, v in drawn_network(5).items()}
    rng = np.random.default_rng(6)
    ids, targets = rng.integers(0, 40, (6, 3)), rng.integers(0, lm.KNOWN, (6, 3))
    live, fresh = rng.random((6, 3)) < 0.9, rng.random((6, 3)) < 0.2
    state = 0.3 * rng.standard_normal((3, lm.HIDDEN))
    _, grads, _ = lm.gradients(net, ids, targets, live, state, fresh)

    def loss():
        return lm.gradients(net, ids, targets, live, state, fresh)[0]

    for name, slope in grads.items():
        for at in map(tuple, np.argwhere(np.abs(slope) > np.abs(slope).max() / 3)[:3]):
            kept, step = net[name][at], 1e-5
            net[name][at] = kept + step
            up = loss()
            net[name][at] = kept - step
            down = loss()
            net[name][at] = kept
            assert math.isclose((up - down) / (2 * step), slope[at], rel_tol=1e-3, abs_tol=1e-7), (name, at)


def test_file_layout_does_not_matter(spark):
    rng = np.random.default_rng(7)
    words = [f"w{k}" for k in range(50)]
    rows = [(k % 90, " ".join(rng.choice(words, rng.integers(0, 40)))) for k in range(120)]
    rows += [(3, "same text"), (3, "same text"), (5, "same text"), (None, "no id"), (6, None)]
    scores = []
    for order, parts in ((rows, 1), (rows[::-1], 7)):
        got = lm.text_likelihood(spark.createDataFrame(order, "report_id long, text string").repartition(parts)).collect()
        scores.append(sorted((r.report_id, r.n_tokens, r.n_known, r.score) for r in got))
    assert [r[:3] for r in scores[0]] == [r[:3] for r in scores[1]]
    assert all(math.isclose(a[3], b[3], rel_tol=1e-12) for a, b in zip(*scores))
