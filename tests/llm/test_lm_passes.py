"""The network's passes: no state where no target is scored, gradients and steps as plain ones."""

import math

import numpy as np
import pytest

from rallyframe.llm import lm


@pytest.fixture
def net():
    counts, starts = np.arange(9000, 0, -1.0), np.arange(9000) % 2 == 0
    group, place, share, inputs, many, n_starts = lm.make_groups(counts, starts, 0)
    return lm.Network(group, place, share, inputs, lm.start_parameters(many, group, place, counts), starts, n_starts, 0)


def test_windows_without_early_targets_have_states_only_after_the_overlap(net, monkeypatch):
    r = np.random.default_rng(0)
    p, n, t = {k: v.astype(float) for k, v in net.p.items()}, 6, lm.WINDOW
    y, on = r.integers(0, 9000, n * t), np.ones((n, t), bool)
    on[1:, : lm.OVERLAP], on[:, -3:], on[4] = False, False, False
    x, made, hidden = net.inputs[r.integers(0, 9000, (n, t))], [], lm.hidden
    monkeypatch.setattr(lm, "hidden", lambda *a: made.append(hidden(*a)) or made[-1])
    g = lm.gradient(p, x, net.group[y], net.place[y], on)
    assert sum(len(u) for u, _ in made) == t + 4 * (t - lm.OVERLAP)  # one window is whole, one has no target

    def loss():
        return -(lm.predicted(p, hidden(p, x)[0], net.group[y], net.place[y], 3)[0] * np.log(10))[on.reshape(-1)].mean()

    assert list(g) == list(p)
    for k in p:
        for at in (np.unravel_index(np.abs(g[k]).argmax(), g[k].shape), tuple(r.integers(0, p[k].shape))):
            was, both = p[k][at], []
            for e in (1e-5, -1e-5):
                p[k][at] = was + e
                both.append(loss())
            p[k][at] = was
            assert g[k][at] == pytest.approx((both[0] - both[1]) / 2e-5, rel=1e-3, abs=1e-8), k


def test_no_targets_no_gradient(net):
    x = np.zeros((2, lm.WINDOW), int)
    g = lm.gradient(net.p, x, net.group[x.reshape(-1)], net.place[x.reshape(-1)], np.zeros(x.shape, bool))
    assert all(g[k].shape == v.shape and not g[k].any() for k, v in net.p.items())


def test_steps_are_those_of_adam(net, monkeypatch):
    monkeypatch.setattr(lm, "ROUNDS", 2)
    r = np.random.default_rng(5)
    ids, bound, k = r.integers(0, 9000, 9000).astype("<u2"), np.array([0, 1, 30, 4000, 9000]), 1
    before, target, scored = lm.windows(ids, bound, net.end)
    mine = lm.share_of_round(len(before), 1, k, 7, 2)
    p, m1, m2 = {c: v.copy() for c, v in net.p.items()}, {}, {}
    steps = -(-len(mine) // lm.BATCH)
    assert steps == 2
    for step in range(1, steps + 1):
        pick = mine[(step - 1) * lm.BATCH : step * lm.BATCH]
        y = ids[target[pick].reshape(-1)]
        x = np.where(before[pick] < 0, net.inputs[net.end], net.inputs[ids[before[pick]]])
        g = lm.gradient(p, x, net.group[y], net.place[y], scored[pick])
        rate = 0.01 * min(1, step / 20) * (1 - 0.9 * (k + step / steps) / lm.ROUNDS)
        for c in p:
            m1[c] = m1.get(c, 0) * 0.9 + 0.1 * g[c]
            m2[c] = m2.get(c, 0) * 0.99 + 0.01 * g[c] ** 2
            p[c] = (p[c] - rate * m1[c] / (1 - 0.9**step) / (np.sqrt(m2[c] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    got = lm.learn(net, ids, bound, 7, k, 1)
    at = len(p["embed"]) + len(p["out2"])
    met, used, taken, at = got[: len(p["embed"])], got[len(p["embed"]) : at], got[at], at + 1
    assert taken == len(mine) and math.isclose(used.sum(), scored[mine].sum())
    for c, v in p.items():
        w = {"embed": met[:, None], "out2": used[:, None, None], "bias2": used[:, None]}.get(c, taken)
        assert np.allclose(got[at : at + v.size].reshape(v.shape), v * w, rtol=1e-3, atol=2e-4 * np.max(w)), c
        at += v.size
