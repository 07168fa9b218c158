"""Kernels against full recomputation, enumeration and known values."""

import itertools

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sylva.operators.kernels import partition as P
from sylva.operators.kernels import pi as Q
from sylva.operators.kernels import soft
from sylva.operators.kernels import trees as K
from sylva.operators.kernels.assign import best_matching
from sylva.sources import generators as S


def karate():
    return P.Net(34, [(*map(int, e.split(":")[0].split("-")), float(e.split(":")[1])) for e in S.KARATE.split()])


def random_net(seed, n=12, p=0.35, loops=False):
    edges, _ = S.sbm_lists([n], p, p, seed)
    return P.Net(n, [(u, v, 0.5 + (7 * u + v) % 5) for u, v in edges] + ([(0, 0, 2.0), (3, 3, 1.5)] if loops else []))


@given(st.integers(0, 10_000))
@settings(max_examples=30, deadline=None)
def test_trivial_partitions_have_h1_and_optimum_is_lower(seed):
    net = random_net(seed)
    h1 = P.entropy(net, list(range(net.n)))
    assert P.entropy(net, [0] * net.n) == pytest.approx(h1, abs=1e-9)
    assert P.entropy(net, P.optimised(net, starts=2)) <= h1 + 1e-9


@pytest.mark.parametrize("objective", P.OBJECTIVES)
@pytest.mark.parametrize("loops", [False, True])
def test_moves_keep_the_value(objective, loops):
    rng = np.random.default_rng(1)
    net = random_net(3, 14, 0.4, loops)
    state = P.Partition(net, rng.integers(0, 4, net.n).tolist(), objective)
    for _ in range(300):
        u = int(rng.integers(net.n))
        weights = state.toward(u)
        options = list(state.changes(u, {*weights, *state.volume, state.next}, weights))
        change, b = options[int(rng.integers(len(options)))]
        before = state.value()
        state.move(u, b, weights)
        assert state.value() == pytest.approx(before + change, abs=1e-9)
        assert P.Partition(net, state.labels, objective).value() == pytest.approx(state.value(), abs=1e-9)


def test_exhaustive_minimum_is_found():
    for seed in range(6):
        net = random_net(seed, 7, 0.5)
        assert P.entropy(net, P.optimised(net)) == pytest.approx(P.exhaustive(net)[0], abs=0.02)
        assert P.entropy(net, P.optimised(net)) >= P.exhaustive(net)[0] - 1e-9


def test_karate_values():
    net = karate()
    assert len(list(net.edges())) == 78 and net.m2 == 462
    assert P.entropy(net, list(range(34))) == pytest.approx(4.634008, abs=1e-6)
    assert P.entropy(net, P.optimised(net)) == pytest.approx(3.2287, abs=1e-4)
    tree = K.from_merges(net, P.agglomerated(net))
    assert tree.entropy() == pytest.approx(2.6932223, abs=1e-6) and tree.dasgupta() == 2304
    best = K.encoding_tree(net)
    assert best.entropy() == pytest.approx(2.48563059, abs=1e-6) and best.dasgupta() == 2625


def test_merge_down_and_fixed_k():
    net = random_net(5, 30, 0.2)
    labels = list(range(30))
    for k in (1, 3, 7):
        assert len(set(P.merged_down(net, labels, k))) == k
        assert len(set(P.fixed_k(net, k, starts=3))) == k
    with pytest.raises(ValueError):
        P.fixed_k(net, 31)
    parts = P.Net(6, [(0, 1, 1.0), (2, 3, 1.0), (4, 5, 1.0)])
    assert len(set(P.merged_down(parts, list(range(6)), 2))) == 3  # nothing adjoins


def test_two_level_tree_equals_h2():
    for loops in (False, True):
        net = random_net(2, 20, 0.3, loops)
        labels = np.random.default_rng(0).integers(0, 4, 20).tolist()
        assert K.from_labels(net, labels).entropy() == pytest.approx(P.entropy(net, labels), abs=1e-9)


@pytest.mark.parametrize("seed", range(4))
def test_relocations_and_collapses_against_recomputation(seed):
    net = random_net(seed, 14, 0.35, loops=seed % 2 == 1)
    tree = K.recursive(net) if seed % 2 else K.from_merges(net, P.agglomerated(net))
    for x in list(tree.parent):
        for change, q in list(tree.moves(x)):
            moved = K.Tree(net, tree.parent)
            moved.move(x, q)
            again = K.Tree(net, moved.parent)
            assert again.entropy() == pytest.approx(tree.entropy() + change, abs=1e-9)
            assert moved.entropy() == pytest.approx(again.entropy(), abs=1e-9)
    for x in list(tree.kids):
        flat = K.collapse(tree, x)
        assert flat is None or flat.entropy() >= tree.entropy() - 1e-9
    assert K.collapse(tree, 0) is None


def test_refinement_never_raises_entropy():
    net = random_net(2, 40, 0.12)
    tree = K.from_merges(net, P.agglomerated(net))
    before = tree.entropy()
    assert K.refined(tree, 5, "first").entropy() <= before + 1e-9
    assert K.encoding_tree(net).entropy() <= before + 1e-9


def test_linkages():
    net = karate()
    for merges in (P.paris(net), P.agglomerated(net), *(P.linkage(P.hops(net), k) for k in ("average", "complete", "ward"))):
        assert len(merges) == 33 and merges[-1][3] == 34
        assert len(set(P.cut_merges(merges, 34, 4))) == 4
    assert P.hops(P.Net(4, [(0, 1, 1.0), (1, 2, 1.0)])).tolist()[0] == [0, 1, 2, 3]


def test_soft_entropy_and_slopes():
    net = random_net(1, 20, 0.3)
    a, rng = soft.Sparse(net), np.random.default_rng(0)
    labels = rng.integers(0, 3, 20)
    assert soft.soft_entropy(a, np.eye(3)[labels])[0] == pytest.approx(P.entropy(net, labels.tolist()), abs=1e-6)
    x = rng.normal(size=(20, 3))
    for head in soft.HEADS.values():
        s, back = head(x)
        value, slope = soft.soft_entropy(a, s)
        step = rng.normal(size=x.shape) * 1e-5
        numeric = (soft.soft_entropy(a, head(x + step)[0])[0] - soft.soft_entropy(a, head(x - step)[0])[0]) / 2
        assert (back(slope) * step).sum() == pytest.approx(numeric, rel=1e-4)
    assert np.allclose(soft.Sparse(net) @ x, soft.dense(net) @ x)


def test_pi_entropy_equals_h2_under_the_degrees():
    net = karate()
    for seed in range(20):
        labels = np.random.default_rng(seed).integers(0, 5, 34).tolist()
        assert Q.entropy(labels, Q.degree_pi(net), Q.walk(net)) == pytest.approx(P.entropy(net, labels), abs=1e-9)
    pi, p = Q.ppr(net, 0), Q.ppr_transition(net, 0)
    assert pi.sum() == pytest.approx(1) and np.allclose(pi @ p, pi, atol=1e-9)
    assert Q.entropy(Q.search(net, pi, p), pi, p) <= Q.entropy([0] * 34, pi, p)


def test_matching_against_enumeration():
    rng = np.random.default_rng(0)
    for _ in range(60):
        gain = rng.integers(0, 20, rng.integers(1, 6, 2))
        wide = gain if gain.shape[0] <= gain.shape[1] else gain.T
        assert best_matching(gain) == max(sum(wide[i, c] for i, c in enumerate(p)) for p in itertools.permutations(range(wide.shape[1]), wide.shape[0]))


def test_spectral_without_the_whole_matrix(monkeypatch):
    """Vectors from the edges span what those of the whole matrix span, equal eigenvalues of equal components too."""
    rng = np.random.default_rng(5)
    part = [(a, b, float(rng.integers(1, 4))) for a in range(80) for b in range(a, 80) if rng.random() < (0.3 if a // 20 == b // 20 else 0.02)]
    net = P.Net(320, [(a + 80 * i, b + 80 * i, w) for i in range(4) for a, b, w in part])
    want, got = P._dense_vectors(net, 16), P._leading_vectors(net, 16)
    assert np.abs(want @ want.T - got @ got.T).max() < 1e-6
    labels = P.spectral(net, 16)
    monkeypatch.setattr(P, "DENSE", 0)
    monkeypatch.setattr(P, "_dense_vectors", None)
    assert P.spectral(net, 16) == labels


def test_sparse_products_by_blocks(monkeypatch):
    """A product held the elements of all rows at once; blocks give the same to the last bit."""
    net, x = random_net(3, n=60, loops=True), np.random.default_rng(1).random((60, 5))
    whole = soft.Sparse(net, 1.0)
    monkeypatch.setattr(soft, "BLOCK", 7)
    parts = soft.Sparse(net, 1.0)
    assert len(parts.blocks) > 10 and (whole @ x == parts @ x).all()
    assert np.allclose(parts @ x, (soft.dense(net) + np.eye(60)) @ x)


def test_fixed_k_has_its_spectral_start_at_any_size(monkeypatch):
    """Over 3,000 vertices the first start was a random one, whatever was asked for."""
    net, seen = P.Net(3001, [(i, i + 1, 1.0) for i in range(3000)]), []
    monkeypatch.setattr(P, "spectral", lambda net, k, seed=0: (seen.append(net.n), [i * k // net.n for i in range(net.n)])[1])
    assert P.fixed_k(net, 3, starts=1) == [i * 3 // 3001 for i in range(3001)]
    assert seen == [3001]
