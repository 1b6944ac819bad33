"""The convolutional network against plain loops: replies, scores, gradients."""

import random

import numpy as np

from quizmill.llm import toxicity as t

WORDS = "red green blue bad worse worst fine calm word plain other thing".split()


def sample(n, seed):
    rng = random.Random(seed)
    texts = [" ".join(rng.choices(WORDS, k=rng.randrange(0, 9))) for _ in range(n)]
    return texts, np.array([float("bad" in x or "worst" in x) for x in texts], np.float32)


def plain_pooled(net, rows, begins):
    """Each text, filter and place by itself: a place is any word or the first padding word behind them; words behind the text are zero."""
    out = []
    for a, e in zip(begins[:-1], begins[1:], strict=True):
        words = [sum((net.table[r] for r in rows[i] if r >= 0), np.zeros(t._DIMS)) for i in range(a, e)]
        reply = []
        for w, f, b in zip(t._WIDTHS, net.filters, net.bias, strict=True):
            for k in range(t._FILTERS):
                places = [b[k] + sum(words[i + s] @ f[s * t._DIMS : (s + 1) * t._DIMS, k] for s in range(w)) for i in range(e - a - t._PAD + 1)]
                reply.append(max(0.0, max(places)))
        out.append(reply)
    return np.array(out)


def doubled(net):
    return t.TextCnn(net.table.astype(float), [f.astype(float) for f in net.filters], [b.astype(float) for b in net.bias], net.out.astype(float), net.out_bias, net.scale, net.shift)


def test_replies_and_scores():
    texts, y = sample(20, 1)
    rows, begins = t.word_rows(["", *texts])
    net = doubled(t.TextCnn.start(*t.word_rows(texts), y))
    net.scale, net.shift = 1.7, -0.4
    expected = plain_pooled(net, rows, begins)
    assert np.allclose(net.pooled(rows, begins), expected, atol=1e-9)
    z, _, where = net.pooled(rows, begins, keep=True)
    assert np.allclose(z, expected, atol=1e-9) and all((begins[:-1, None] <= w).all() and (w < begins[1:, None]).all() for w in where)
    assert np.allclose(net.score(rows, begins), [1 / (1 + np.exp(-(1.7 * (z_ @ net.out + net.out_bias) - 0.4))) for z_ in expected])
    assert net.score(np.zeros((0, 6), np.int32), np.array([0])).shape == (0,)


def test_gradients_against_differences():
    """One step over all rows: Adagrad moves a parameter by rate * g / sqrt(0.1 + g^2), so g can be read off and held against differences of the loss."""
    texts, y = sample(24, 2)
    rows, begins = t.word_rows(texts)
    start = t.TextCnn.start(rows, begins, y)
    after = t.train(rows, begins, y, epochs=1, batch=len(y), rate=0.05)
    weight = np.where(y == 1, min(4.0, max(1.0, (1 - y.mean()) / max(y.mean(), 1e-6) / 2)), 1.0)

    def loss(net):
        p = 1 / (1 + np.exp(-net.logits(rows, begins)))
        return float((weight * -(y * np.log(p) + (1 - y) * np.log(1 - p))).sum() / len(y))

    def told(old, new):
        r = (np.asarray(old, float) - np.asarray(new, float)) / 0.05
        return np.sqrt(0.1) * r / np.sqrt(1 - r**2)

    rng, pairs = np.random.default_rng(4), []
    used = np.unique(rows[rows >= 0])
    arrays = [("table", None), ("out", None), *[(name, k) for name in ("filters", "bias") for k in range(len(t._WIDTHS))]]
    for name, k in arrays:
        get = lambda net, name=name, k=k: getattr(net, name) if k is None else getattr(net, name)[k]
        g = told(get(start), get(after))
        for _ in range(30):
            at = tuple(rng.integers(0, s) for s in g.shape)
            if name == "table":
                at = (int(rng.choice(used)), at[1])
            ends = []
            for eps in (1e-5, -1e-5):
                net = doubled(start)
                get(net)[at] += eps
                ends.append(loss(net))
            slope = (ends[0] - ends[1]) / 2e-5 + (1e-4 * float(start.out[at]) if name == "out" else 0)
            pairs.append((slope, float(g[at])))
    slopes, told_ = np.array(pairs).T
    close = np.abs(slopes - told_) <= 1e-4 + 0.02 * np.abs(slopes)  # where the greatest reply changes hands the slope has a kink
    assert close.mean() >= 0.97 and np.corrcoef(slopes, told_)[0, 1] > 0.999 and np.abs(slopes).max() > 1e-3
