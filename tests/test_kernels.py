from __future__ import annotations

import itertools

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from polycloud.functions import compress as C
from polycloud.functions import emd as E
from polycloud.functions import fde
from polycloud.functions import kernels as K
from polycloud.functions import quantize as Q


def naive_chamfer(a, b, metric):
    d = [[-np.dot(x, y) if metric == "ip" else ((x - y) ** 2).sum() for y in b] for x in a]
    return np.mean([min(r) for r in d])


@pytest.mark.parametrize("metric", K.METRICS)
@pytest.mark.parametrize("dim", [1, 15, 16, 128, 255])
def test_chamfer_equals_the_naive_loop(metric, dim):
    g = np.random.default_rng(dim)
    clouds = [g.normal(size=(n, dim)) for n in (1, 3, 7, 2)]
    flat, off = np.concatenate(clouds), np.concatenate([[0], np.cumsum([len(c) for c in clouds])])
    got = K.chamfer(flat, off, flat, off, metric)
    for i, j in itertools.product(range(4), range(4)):
        assert got[i, j] == pytest.approx(naive_chamfer(clouds[i], clouds[j], metric), abs=1e-9)
    if metric == "l2":
        assert np.allclose(np.diag(got), 0, atol=1e-9)


def test_empty_clouds_are_infinitely_far():
    flat, off = np.ones((2, 3)), np.array([0, 2, 2])
    assert np.isinf(K.chamfer(flat, off, flat, off, "ip")[1]).all()


@given(st.integers(1, 12), st.integers(1, 60), st.integers(0, 5))
@settings(max_examples=40, deadline=None)
def test_top_k_breaks_ties_by_id(k, n, seed):
    g = np.random.default_rng(seed)
    s, ids = g.integers(0, 4, (3, n)).astype(float), g.permutation(n)
    r, c, v = K.top_k(s, ids, k)
    for q in range(3):
        want = sorted(zip(s[q], ids))[:k]
        assert list(zip(v[r == q], c[r == q])) == want


def column(*x):
    return np.array(x, float)[:, None]


def test_emd_golden_values():
    assert E.emd(column(0, 2), column(2, 0)) == 0
    assert E.emd(column(0, 2), column(1, 3)) == 1
    assert E.emd(column(0, 2), column(0)) == 1
    assert E.emd(column(0, 2), column(0, 2, 2)) == pytest.approx(1 / 3)


def test_emd_is_an_optimal_assignment_and_its_cap_holds():
    g = np.random.default_rng(1)
    for n, m in [(1, 3), (3, 3), (4, 6), (5, 2)]:
        a, b = g.normal(size=(n, 8)), g.normal(size=(m, 8))
        both = np.repeat(a, m, 0), np.repeat(b, n, 0)
        exact = E.emd(a, b)
        assert exact == pytest.approx(E.emd(*both))
        for cap in (0.1, exact * 0.9, exact * 2):
            assert E.emd(a, b, cap) == pytest.approx(min(exact, cap), abs=1e-10)
    c = g.random((5, 5))
    assert c[np.arange(5), E.assignment(c)].sum() == pytest.approx(min(sum(c[i, p[i]] for i in range(5)) for p in itertools.permutations(range(5))))


def test_emd_top_k_solves_fewer_problems():
    clouds = [column(10, 11, 12), column(1, 3, 5), column(0, 2, 4), column(-1, 2, 4)]
    got, solved = E.emd_top_k(column(0, 2, 4), clouds, 2)
    every = sorted((E.emd(column(0, 2, 4), c), i) for i, c in enumerate(clouds))[:2]
    assert [(d, i) for i, d in got] == every and solved < 4


@pytest.mark.parametrize("name,least", [("none", 0.999), ("pq", 0.8), ("fastscan", 0.75), ("rabitq", 0.98), ("tq4", 0.98), ("tq8", 0.999), ("tq1", 0.55), ("tq1a", 0.7), ("sympq", 0.55), ("tqc", 0.98), ("tq2", 0.9)])
def test_quantizers_keep_the_order(name, least):
    g = np.random.default_rng(0)
    x = g.normal(size=(1500, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    q = x[:20] + 0.05 * g.normal(size=(20, 64))
    z = Q.make(name).fit(x)
    for metric in K.METRICS:
        assert np.corrcoef(z.scorer(metric)(q, x).ravel(), K.pair_distances(q, x, metric).ravel())[0, 1] > least
    assert (Q.make("tq4").scorer("ip")(q, x) == Q.make("tq4").scorer("ip")(q, x)).all()


def test_fde_finds_the_noisy_copy():
    g = np.random.default_rng(2)
    clouds = [g.normal(size=(8, 32)) for _ in range(40)]
    cfg = fde.FDEConfig.preset(5120)
    d = np.stack([fde.encode(c, cfg, False) for c in clouds])
    q = np.stack([fde.encode(c + 0.1 * g.normal(size=c.shape), cfg, True) for c in clouds])
    assert d.shape[1] == 5120 and ((q @ d.T).argmax(1) == np.arange(40)).mean() > 0.9
    with pytest.raises(ValueError):
        fde.FDEConfig.preset(100)


def test_gray_distance_is_zero_in_the_own_cell():
    bits = np.array(list(itertools.product([False, True], repeat=4)))
    cells = fde.gray(bits)
    assert sorted(cells) == list(range(16))
    assert all(fde.gray_distance(bits[i : i + 1], int(c))[0] == 0 for i, c in enumerate(cells))


def test_compression_keeps_sums():
    g = np.random.default_rng(3)
    q = g.normal(size=(12, 16))
    for method in ("ball", "ward", "dynamic", "strict"):
        got = C.compress(q, method, 0.5, quantizer="tq1", target=3)
        assert np.allclose(got.sum(0), q.sum(0)) and len(got) <= 12
    assert len(C.compress(q, "strict", target=3)) == 3
    assert len(C.compress(q, "dynamic", 1e9, align=4)) == 1 and len(C.compress(q, "dynamic", 0.0, align=4)) % 4 == 0
    assert C.compress(q, "none") is q


def test_lloyd_separates_two_blobs():
    g = np.random.default_rng(4)
    x = np.concatenate([g.normal(size=(30, 2)), g.normal(size=(30, 2)) + 20])
    _, a = Q.lloyd(x, 2, 10, 1)
    assert len(set(a[:30])) == 1 and len(set(a[30:])) == 1 and a[0] != a[-1]


@pytest.mark.parametrize("name", ["tq1", "tq1a"])
def test_sign_codes_equal_their_scalar_reference(name):
    g = np.random.default_rng(2)
    q, d = g.normal(size=(4, 24)), g.normal(size=(5, 24))
    z = Q.make(name)
    got = z.dots(q, z.encode(d))
    want = [[Q.sign_reference(a.tolist(), b.tolist(), Q.rotation(24).tolist(), name == "tq1a") for b in d] for a in q]
    assert np.allclose(got, want, atol=1e-9)


def test_smaller_symmetric_blocks_estimate_better():
    g = np.random.default_rng(3)
    q, d = g.normal(size=(30, 32)), g.normal(size=(40, 32))
    error = []
    for name in ("sympq1", "sympq2", "sympq", "sympq8", "sympq16"):
        z = Q.make(name)
        error.append(np.abs(z.dots(q, z.encode(d)) - q @ d.T).mean())
    assert error == sorted(error)


def naive_ward(q, target):
    """Merges by definition: the pair whose union adds least to the summed squared distances to the means."""
    groups = [[v] for v in q]
    cost = lambda m: ((np.array(m) - np.mean(m, 0)) ** 2).sum()
    while len(groups) > target:
        i, j = min(itertools.combinations(range(len(groups)), 2), key=lambda p: cost(groups[p[0]] + groups[p[1]]) - cost(groups[p[0]]) - cost(groups[p[1]]))
        groups[i] += groups.pop(j)
    return sorted(tuple(np.round(np.sum(m, 0), 9)) for m in groups)


@pytest.mark.parametrize("target", [1, 3, 7])
def test_ward_equals_its_definition(target):
    q = np.random.default_rng(target).normal(size=(12, 5))
    assert sorted(tuple(np.round(x, 9)) for x in C.ward(q, target=target, strict=True)) == naive_ward(q, target)


def test_ball_carving_equals_its_definition():
    q = np.random.default_rng(1).normal(size=(20, 4))
    q /= np.linalg.norm(q, axis=1, keepdims=True)
    left, want = list(range(20)), []
    while left:
        ball = [j for j in left if j == left[0] or q[left[0]] @ q[j] >= 0.4]
        want.append(q[ball].sum(0))
        left = [j for j in left if j not in ball]
    assert np.allclose(C.ball_carving(q, 0.4), want)


@pytest.mark.parametrize("scorer", [None, "tq8"])
def test_lloyd_lowers_the_cost(scorer):
    x = np.concatenate([np.random.default_rng(0).normal(size=(50, 6)) + 9 * k for k in range(3)])
    c, a = Q.lloyd(x, 3, 8, 1, None, False, Q.make(scorer) if scorer else None)
    assert ((x - c[a]) ** 2).sum() < 0.2 * ((x - x.mean(0)) ** 2).sum()


@given(st.integers(0, 50))
@settings(max_examples=20, deadline=None)
def test_encodings_follow_their_definition(seed):
    g = np.random.default_rng(seed)
    cfg = fde.FDEConfig(repetitions=2, bits=2, projected=3, fill_empty=False, seed=seed)
    cloud = g.normal(size=(5, 7))
    for query in (True, False):
        want = []
        for r in range(2):
            d = np.random.default_rng([seed, r])
            planes = d.normal(size=(7, 2))
            to, sign = d.integers(0, 3, 7), d.choice([-1.0, 1.0], 7)
            cells = {c: [] for c in range(4)}
            for v in cloud:
                low = np.zeros(3)
                for i in range(7):
                    low[to[i]] += sign[i] * v[i]
                first, second = (int(v @ planes[:, k] > 0) for k in range(2))
                cells[2 * first + (second ^ first)].append(low)
            want += [np.sum(m, 0) if query else np.mean(m, 0) if m else np.zeros(3) for m in (cells[c] or [np.zeros(3)] for c in range(4))]
        assert np.allclose(fde.encode(cloud, cfg, query), np.concatenate(want))
