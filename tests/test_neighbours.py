import numpy as np
import pytest

from sylva.operators import neighbours


def brute(ids, x, k):
    u = x / np.linalg.norm(x, axis=1)[:, None]
    cosine, out = np.round(u @ u.T, 9), set()
    for i, a in enumerate(ids):
        order = sorted((-cosine[i, j], b) for j, b in enumerate(ids) if b != a)
        out |= {(a, b, n + 1) for n, (_, b) in enumerate(order[:k])}
    return out


def frame(spark, ids, x, kind="long"):
    return spark.createDataFrame([(i, [float(c) for c in v]) for i, v in zip(ids, x)], f"vec_id {kind}, embedding array<float>")


def clustered(rng, groups, size, spread=0.02):
    centres = rng.normal(size=(groups, 16))
    return np.float32(np.repeat(centres, size, axis=0) + spread * rng.normal(size=(groups * size, 16)))


@pytest.mark.parametrize("spread", [0.02, 3.0])
def test_equals_brute_force(spark, spread):
    rng = np.random.default_rng(1)
    x = clustered(rng, 6, 40, spread)
    x[30:50] = x[30]  # copies over a cluster's edge: ties go by id
    got = neighbours.nearest(frame(spark, range(len(x)), x), 4, pivots=8, block=16).collect()
    assert len(got) == 4 * len(x) and {(r.u, r.v, r.place) for r in got} == brute(range(len(x)), x.astype(float), 4)


def test_few_rows_nulls_and_string_ids(spark):
    rows = [("a", [1.0, 0.0]), ("b", [2.0, 0.0]), ("c", [0.0, 1.0]), ("zero", [0.0, 0.0]), ("none", None)]
    docs = spark.createDataFrame(rows, "vec_id string, embedding array<float>")
    got = sorted((r.u, r.v, r.place) for r in neighbours.nearest(docs, 5).collect())
    assert got == [("a", "b", 1), ("a", "c", 2), ("b", "a", 1), ("b", "c", 2), ("c", "a", 1), ("c", "b", 2)]
    assert neighbours.nearest(docs.limit(0), 5).count() == 0


def test_clusters_are_not_compared_with_each_other(spark):
    """Under a tenth of the pairs between clusters are computed, also where one cluster holds a third of all vectors."""
    rng = np.random.default_rng(2)
    x = np.concatenate((clustered(rng, 40, 20), clustered(rng, 1, 400)))
    vectors = frame(spark, range(len(x)), x)
    packed, centres = neighbours.rings(vectors, "vec_id", "embedding", block=32)
    sizes = {(r.cell, r.ring): len(r.ids) for r in packed.select("cell", "ring", "ids").collect()}
    assert max(sizes.values()) <= 32 and sum(sizes.values()) == len(x)
    pairs = neighbours.ring_pairs(packed, centres, 5).where("to_cell is not null").collect()
    computed = sum(n * n for n in sizes.values()) + sum(sizes[(r.cell, r.ring)] * sizes[(r.to_cell, r.to_ring)] for r in pairs)
    within = 40 * 20 * 20 + 400 * 400
    assert computed - within < 0.1 * (len(x) ** 2 - within)
    near = neighbours.nearest(vectors, 5, block=32)
    assert {(r.u, r.v, r.place) for r in near.collect()} == brute(range(len(x)), x.astype(float), 5)


def test_a_ring_is_sent_once_to_a_group(spark):
    """What is shuffled grows with the vectors times the groups, not with the pairs of rings."""
    x = np.random.default_rng(3).normal(size=(3000, 16))
    packed, centres = neighbours.rings(frame(spark, range(len(x)), x), "vec_id", "embedding", pivots=4, block=16)
    rows, groups = neighbours.dealt(packed, centres, 5)
    n, sent = packed.count(), rows.count()
    assert n > 180 and groups == 2 * spark.sparkContext.defaultParallelism and n < sent <= n * (groups + 1)


def test_within_the_values_of_a_column(spark):
    rng = np.random.default_rng(4)
    x = clustered(rng, 5, 60, 0.5)
    part = rng.integers(0, 3, len(x))
    x[20:40] = x[20]  # copies, some of another value
    vectors = frame(spark, range(len(x)), x).join(spark.createDataFrame([(i, None if i == 7 else f"p{p}") for i, p in enumerate(part.tolist())], "vec_id long, part string"), "vec_id")
    got = {(r.u, r.v, r.place) for r in neighbours.nearest(vectors, 3, pivots=4, block=16, within="part").collect()}
    want = set()
    for p in range(3):
        ids = [i for i in range(len(x)) if part[i] == p and i != 7]
        want |= brute(ids, x[ids].astype(float), 3)
    assert got == want


def test_added_edges_follow_the_nearest_of_a_label(spark, tmp_path):
    """The query's plan has no join of all pairs of a label."""
    from sylva.plans import downstream_queries

    plan = downstream_queries.rewire_add(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "xu#" not in plan and "xv#" not in plan
