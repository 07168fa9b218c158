from sylva.operators.downstream import set_operations
from sylva.plans.benchmark import upserted


def test_new_rows_replace_old_ones(spark):
    schema = "dataset string, method string, x double, n long"
    old = spark.createDataFrame([("a", "m", 1.0, 1), ("a", "k", 2.0, 1), (None, "m", 3.0, 1), ("b", "m", None, 1)], schema)
    new = spark.createDataFrame([("a", "m", None, 2), (None, "m", 4.0, 2), ("c", "m", 5.0, 2), ("c", "m", 5.0, 2)], schema)
    got = upserted(old, new, ["dataset", "method"])
    assert got.columns == old.columns
    want = {("a", "m", None, 2), ("a", "k", 2.0, 1), (None, "m", 4.0, 2), ("b", "m", None, 1), ("c", "m", 5.0, 2)}
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(want) and set(rows) == want
    assert upserted(old.limit(0), new.limit(0), ["dataset", "method"]).count() == 0


def test_set_operations(spark):
    rows = [("a", 1), ("a", 1), ("a", 2), ("a", None), ("b", 2), ("b", 3), ("b", None), ("c", 4), (None, 1)]
    got = sorted(map(tuple, set_operations(spark.createDataFrame(rows, "set string, key long"), "a", "b").collect()), key=str)
    assert got == sorted([("intersect", 2), ("intersect", None), ("except", 1), *(("union", k) for k in (1, 2, 3, None))], key=str)
