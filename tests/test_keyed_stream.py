import random

import pytest

from sylva.streaming import incremental


@pytest.mark.parametrize("batches", [1, 3, 7])
def test_any_split_gives_the_same_steps(spark, tmp_path, batches):
    """Batches cut the stream by time; within a batch rows come in any order, and one user has half of them."""
    rng = random.Random(3)
    events = [(k, k // 3, 1 if rng.random() < 0.5 else rng.randint(2, 9), rng.choice(["a", "b", "c", None])) for k in range(300)]
    schema = "event_id long, ts long, user_id long, event_type string"
    for b in range(batches):
        part = [e for e in events if e[0] * batches // len(events) == b]
        rng.shuffle(part)
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    found = incremental.stateful_steps(stream)
    job = found.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    job.awaitTermination()
    last, want = {}, []
    for _, _, user, kind in events:
        if kind is not None:
            if user in last:
                want.append((last[user], kind))
            last[user] = kind
    assert sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == sorted(want)


def test_stream_is_dealt_out_to_several_tasks(spark, monkeypatch, tmp_path):
    """Each of the four parts was one file, written and read by one task; the steps of an actor must not depend on it."""
    from pyspark.sql.streaming import DataStreamReader

    from sylva.plans import downstream_queries as Q

    rows = [(i, i % 7, f"2024-01-01 {i // 60:02d}:{i % 60:02d}:00", "abc"[(i * i) % 3]) for i in range(400)]
    events = spark.createDataFrame(rows, "event_id long, user_id long, ts string, event_type string")
    events.selectExpr("event_id", "user_id", "cast(ts as timestamp) as ts", "event_type").write.parquet(str(tmp_path / "events.parquet"))
    paths, read = [], DataStreamReader.parquet
    monkeypatch.setattr(DataStreamReader, "parquet", lambda self, path: (paths.append(path), read(self, path))[1])
    got = {(r.src, r.dst): r.w for r in Q.stream_transitions(spark, str(tmp_path)).collect()}
    want = {}
    for user in range(7):
        states = [r[3] for r in rows if r[1] == user]
        for pair in zip(states, states[1:]):
            want[tuple(sorted(pair))] = want.get(tuple(sorted(pair)), 0.0) + 1.0
    assert got == want
    assert spark.read.parquet(paths[0]).selectExpr("input_file_name() as f").distinct().count() > 4
