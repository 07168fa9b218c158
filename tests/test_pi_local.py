import random

from sylva.operators import pi, search


def case(spark):
    rng = random.Random(9)
    n = 36
    rows = [("g", a, b, float(rng.randint(1, 3))) for a in range(n) for b in range(a, n) if rng.random() < (0.6 if a // 12 == b // 12 else 0.06)]
    edges = search.cut(spark.createDataFrame(rows, "graph_id string, src long, dst long, w double"))
    labels = search.cut(spark.createDataFrame([("g", v, rng.randrange(5)) for v in range(n)] + [("g", 99, 77)], "graph_id string, id long, c long").where("id < 99"))
    return rows, edges, labels


def test_push_reaches_pagerank(spark):
    rows, edges, _ = case(spark)
    start = spark.createDataFrame([("g", 0, 0.75), ("g", 20, 0.25)], "graph_id string, id long, q double")
    exact = {r.id: r.p for r in pi.ppr(edges, start, alpha=0.5, tol=1e-9).collect()}
    weight = {}
    for _, a, b, w in rows:
        for v in {a, b}:
            weight[v] = weight.get(v, 0.0) + w
    for eps in (1e-2, 1e-5):
        got = {r.id: (r.p, r.r) for r in pi.push(edges, start, alpha=0.5, eps=eps).collect()}
        left = sum(r for _, r in got.values())
        assert abs(sum(p for p, _ in got.values()) + left - 1) < 1e-9
        assert all(r <= eps * weight[v] for v, (_, r) in got.items())
        # PageRank of the residuals is what is missing.
        assert all(-1e-8 <= exact[v] - got.get(v, (0.0, 0.0))[0] <= left + 1e-8 for v in exact)
    assert left < 0.005
    assert pi.push(edges, start.limit(0)).count() == 0


def test_moves_equal_recomputed_entropies(spark):
    _, edges, labels = case(spark)
    trans = search.cut(pi.transitions(edges))
    start = spark.createDataFrame([("g", 3, 1.0)], "graph_id string, id long, q double")
    for at in (pi.degree_pi(edges), pi.ppr(edges, start, iters=3, tol=0.0)):  # the second isn't stationary for the walk, so flows aren't symmetric
        at = search.cut(at)
        value = lambda x: pi.pi_entropy(at, trans, x).first()["h_pi"]  # noqa: B023, E731
        before = value(labels)
        moves = pi.pi_moves(at, trans, labels).collect()
        assert len({(m.id, m.b) for m in moves}) == len(moves) > 60
        for m in random.Random(1).sample(moves, 3):
            moved = labels.selectExpr("graph_id", "id", f"if(id = {m.id}, {m.b}L, c) as c")
            assert abs(value(moved) - before - m.delta) < 1e-9


def test_a_module_of_one_vanishes(spark):
    edges = spark.createDataFrame([("g", 0, 1, 1.0), ("g", 1, 2, 1.0), ("g", 0, 2, 1.0)], "graph_id string, src long, dst long, w double")
    labels = spark.createDataFrame([("g", 0, 0), ("g", 1, 0), ("g", 2, 1)], "graph_id string, id long, c long")
    at, trans = pi.degree_pi(edges), pi.transitions(edges)
    (move,) = [m for m in pi.pi_moves(at, trans, labels).collect() if m.id == 2]
    whole = labels.selectExpr("graph_id", "id", "0L as c")
    value = lambda x: pi.pi_entropy(at, trans, x).first()["h_pi"]
    assert abs(value(whole) - value(labels) - move.delta) < 1e-12


def test_search_lowers_the_entropy(spark):
    _, edges, labels = case(spark)
    at, trans = search.cut(pi.degree_pi(edges)), search.cut(pi.transitions(edges))
    found = search.cut(pi.pi_search(at, trans, labels, rounds=2))
    value = lambda x: pi.pi_entropy(at, trans, x).first()["h_pi"]
    assert found.count() == labels.count() and value(found) < value(labels)
