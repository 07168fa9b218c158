"""Queries on uses of partitions, tables of results, exports and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.scalar import argmax, fixed, rounded, share, unit
from ..operators import downstream as D
from ..operators import learners, neighbours, search
from ..operators.checkpoints import folder
from ..operators.graph import GID, canonical, without_loops
from ..operators.kernels import trees as K
from ..sources import export
from ..sources import generators as S
from ..sources import tables as T
from ..streaming import incremental
from . import benchmark
from .register import CS, EV, NATIONS, query

SIM = "list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) / sqrt(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(a.embedding AS DOUBLE[]))) / sqrt(list_dot_product(CAST(b.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])))"
PAIRS = f"pr AS (SELECT a.vec_id AS u, b.vec_id AS v, round({SIM}, 9) AS sim FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id)"
NEAR = f"{PAIRS}, nn AS (SELECT *, row_number() OVER (PARTITION BY u ORDER BY sim DESC, v) AS place FROM pr QUALIFY place <= 5)"
RING = "e1 AS (SELECT least(vec_id, o) AS src, greatest(vec_id, o) AS dst, 1.0 AS w FROM (SELECT vec_id, (vec_id * 7 + 3) % (SELECT count(*) FROM embeddings) AS o FROM embeddings) WHERE vec_id <> o GROUP BY 1, 2)"


def _ring(spark, sf_dir):
    """A sparse graph over the vectors that doesn't follow their labels."""
    n = T.table(spark, sf_dir, "embeddings").count()
    rows = T.table(spark, sf_dir, "embeddings").select(F.lit("knn").alias(GID), F.col("vec_id").alias("a"), ((F.col("vec_id") * 7 + 3) % n).alias("b")).where("a <> b")
    return rows.select(GID, F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst"), F.lit(1.0).alias("w")).distinct()


def _edge_similarity(spark, sf_dir, edges):
    from ..functions.scalar import dot, norm

    x = T.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("x"))
    a, b = x.select(F.col("id").alias("src"), F.col("x").alias("xu")), x.select(F.col("id").alias("dst"), F.col("x").alias("xv"))
    sim = dot(F.col("xu"), F.col("xv")) / (norm(F.col("xu")) * norm(F.col("xv")))
    return edges.join(a, "src").join(b, "dst").select(GID, "src", "dst", F.round(sim, 9).alias("sim"))


@query("knn_pairs", f"""WITH pr AS (SELECT a.vec_id AS u, b.vec_id AS v, round({SIM}, 9) AS sim FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id)
SELECT u, v, round(sim, 6) + 0.0 AS sim, row_number() OVER (PARTITION BY u ORDER BY sim DESC, v) AS place FROM pr QUALIFY place <= 5""")
def knn_pairs(spark, sf_dir):
    """The five nearest of all vectors for each."""
    near = neighbours.nearest(T.table(spark, sf_dir, "embeddings"), 5)
    return near.select("u", "v", rounded(F.col("sim")).alias("sim"), F.col("place").cast("long").alias("place"))


@query("rewire_drop", f"""WITH {RING}, x AS (SELECT src, dst, round({SIM}, 9) AS sim FROM e1 JOIN embeddings a ON a.vec_id = src JOIN embeddings b ON b.vec_id = dst WHERE a.label <> b.label),
r AS (SELECT *, row_number() OVER (ORDER BY sim, src, dst) AS k, count(*) OVER () AS n FROM x) SELECT src, dst FROM r WHERE k <= floor(n * 0.05)""")
def rewire_drop(spark, sf_dir):
    edges = _ring(spark, sf_dir)
    return D.dropped_edges(edges, T.vector_labels(spark, sf_dir), _edge_similarity(spark, sf_dir, edges)).select("src", "dst")


@query("rewire_add", f"WITH {RING}, {NEAR} SELECT DISTINCT least(u, v) AS src, greatest(u, v) AS dst FROM nn WHERE place <= 2 AND NOT EXISTS (SELECT 1 FROM e1 WHERE src = least(u, v) AND dst = greatest(u, v))")
def rewire_add(spark, sf_dir):
    return D.added_edges(_ring(spark, sf_dir), T.nearest_pairs(T.table(spark, sf_dir, "embeddings"), "label", 2)).select("src", "dst")


@query("rewired_edges")
def rewired_edges(spark, sf_dir):
    edges = search.cut(_ring(spark, sf_dir))
    pairs = T.nearest_pairs(T.table(spark, sf_dir, "embeddings"), "label", 2)
    return D.rewired(edges, T.vector_labels(spark, sf_dir), pairs, _edge_similarity(spark, sf_dir, edges)).select("src", "dst", "w")


@query("symmetric_edges", f"WITH {EV} SELECT src, dst FROM e1 UNION ALL SELECT dst, src FROM e1 WHERE src <> dst")
def symmetric_edges(spark, sf_dir):
    return D.symmetric(T.event_transitions(spark, sf_dir)).select("src", "dst")


@query("transition_edges", f"WITH {EV} SELECT src, dst, w FROM e1")
def transition_edges(spark, sf_dir):
    return T.event_transitions(spark, sf_dir).select("src", "dst", "w")


@query("visit_counts", "SELECT event_id, count(*) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS visits FROM events")
def visit_counts(spark, sf_dir):
    return D.visit_counts(T.table(spark, sf_dir, "events"), "user_id", "event_type", ["ts", "event_id"]).select("event_id", "visits")


@query("cluster_visits", "SELECT user_id, CAST(length(event_type) % 2 AS BIGINT) AS c, count(*) AS visits FROM events GROUP BY 1, 2")
def cluster_visits(spark, sf_dir):
    states = T.table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    return states.groupBy("user_id", (F.length("event_type") % 2).cast("long").alias("c")).agg(F.sum("n").alias("visits"))


@query("cluster_bonus", """WITH v AS (SELECT event_id, count(*) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS a,
count(*) OVER (PARTITION BY user_id, length(event_type) % 2 ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS b FROM events) SELECT event_id, round(0.05 / sqrt(a) + 0.05 / sqrt(b), 6) + 0.0 AS bonus FROM v""")
def cluster_bonus(spark, sf_dir):
    events = T.table(spark, sf_dir, "events").withColumn("c", F.length("event_type") % 2)
    own = D.visit_counts(events, "user_id", "event_type", ["ts", "event_id"]).withColumnRenamed("visits", "own")
    both = D.visit_counts(own, "user_id", "c", ["ts", "event_id"])
    return both.select("event_id", rounded(D.bonus(F.col("own"), F.col("visits"))).alias("bonus"))


@query("mean_pool", "SELECT CAST(label AS BIGINT) AS c, CAST(k AS BIGINT) AS k, round(avg(CAST(embedding[k + 1] AS DOUBLE)), 6) + 0.0 AS mean FROM embeddings, range(64) t(k) GROUP BY 1, 2")
def mean_pool(spark, sf_dir):
    vectors = T.table(spark, sf_dir, "embeddings").select(F.lit("knn").alias(GID), F.col("vec_id").alias("id"), F.col("embedding").alias("x"))
    return D.mean_pooled(T.vector_labels(spark, sf_dir), vectors).select("c", F.col("k").cast("long").alias("k"), rounded(F.col("mean")).alias("mean"))


@query("pooled_adjacency", f"""WITH {CS}, {NATIONS}, x AS (SELECT a.c AS src, b.c AS dst, w FROM e1 JOIN lab a ON a.id = src JOIN lab b ON b.id = dst), y AS (SELECT src, dst, w FROM x UNION ALL SELECT dst, src, w FROM x),
z AS (SELECT src, dst, sum(w) AS w FROM y GROUP BY 1, 2) SELECT src, dst, round(w / sum(w) OVER (PARTITION BY src), 6) + 0.0 AS a FROM z""")
def pooled_adjacency(spark, sf_dir):
    return D.pooled_adjacency(T.customer_supplier(spark, sf_dir), T.nation_labels(spark, sf_dir)).select("src", "dst", rounded(F.col("a")).alias("a"))


@query("edge_view_prob", f"""WITH {CS}, {NATIONS}, x AS (SELECT src, dst, CASE WHEN a.c = b.c THEN 0.6 ELSE 0.1 END AS p FROM e1 JOIN lab a ON a.id = src JOIN lab b ON b.id = dst)
SELECT src, dst, CAST(p AS DOUBLE) AS p, round(avg(p) OVER (), 6) + 0.0 AS uniform FROM x""")
def edge_view_prob(spark, sf_dir):
    return D.drop_probabilities(T.customer_supplier(spark, sf_dir), T.nation_labels(spark, sf_dir)).select("src", "dst", "p", rounded(F.col("uniform")).alias("uniform"))


@query("contrastive_view")
def contrastive_view(spark, sf_dir):
    found = D.drop_probabilities(T.customer_supplier(spark, sf_dir), T.nation_labels(spark, sf_dir))
    return D.view(found, seed=1).select("src", "dst")


@query("feature_norms", """SELECT vec_id, CAST(k AS BIGINT) AS k, round(CAST(embedding[k + 1] AS DOUBLE) / greatest(sqrt(list_sum(list_transform(embedding, lambda v: CAST(v AS DOUBLE) * v))), 1e-12), 6) + 0.0 AS l2,
round(abs(CAST(embedding[k + 1] AS DOUBLE)) / greatest(list_sum(list_transform(embedding, lambda v: abs(CAST(v AS DOUBLE)))), 1e-12), 6) + 0.0 AS l1 FROM (SELECT *, unnest(range(len(embedding))) AS k FROM embeddings)""")
def feature_norms(spark, sf_dir):
    x = T.table(spark, sf_dir, "embeddings").select("vec_id", unit(F.col("embedding")).alias("l2"), share(F.transform("embedding", F.abs)).alias("l1"))
    rows = x.select("vec_id", F.posexplode(F.arrays_zip("l2", "l1")).alias("k", "v"))
    return rows.select("vec_id", F.col("k").cast("long").alias("k"), rounded(F.col("v.l2")).alias("l2"), rounded(F.col("v.l1")).alias("l1"))


@query("kfold_split", "SELECT vec_id, CAST(ntile(10) OVER (PARTITION BY label ORDER BY md5('0:' || vec_id), vec_id) AS BIGINT) AS fold FROM embeddings")
def kfold_split(spark, sf_dir):
    return D.folds(T.table(spark, sf_dir, "embeddings"), "vec_id", "label").select("vec_id", F.col("fold").cast("long").alias("fold"))


@query("linear_probe")
def linear_probe(spark, sf_dir):
    found = learners.probe(T.table(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label")
    return found.select("fold", "n", rounded(F.col("accuracy")).alias("accuracy"))


WORDS = "wd AS (SELECT DISTINCT conv_id AS qid, turn AS i, unnest(regexp_split_to_array(regexp_replace(regexp_replace(lower(text), '^[^a-z0-9]+', ''), '[^a-z0-9]+$', ''), '[^a-z0-9]+')) AS w FROM conversations), w1 AS (SELECT * FROM wd WHERE w <> ''), sz AS (SELECT qid, i, count(*) AS n FROM w1 GROUP BY 1, 2)"


@query("uq_pairs", f"""WITH {WORDS}, sh AS (SELECT a.qid, a.i, b.i AS j, count(*) AS s FROM w1 a JOIN w1 b ON a.qid = b.qid AND a.w = b.w AND a.i < b.i GROUP BY 1, 2, 3)
SELECT sh.qid, sh.i, sh.j, round(s / (x.n + y.n - s), 6) + 0.0 AS p FROM sh JOIN sz x ON x.qid = sh.qid AND x.i = sh.i JOIN sz y ON y.qid = sh.qid AND y.i = sh.j WHERE s / (x.n + y.n - s) >= 0.05""")
def uq_pairs(spark, sf_dir):
    answers = _answers(spark, sf_dir)
    return D.token_similarity(answers).where("p >= 0.05").select("qid", "i", "j", rounded(F.col("p")).alias("p"))


def _answers(spark, sf_dir):
    return T.table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("qid"), F.col("turn").alias("i")).agg(F.max("text").alias("text"))


@query("uq_score")
def uq_score(spark, sf_dir):
    answers = search.cut(_answers(spark, sf_dir))
    return D.uncertainty(answers, D.token_similarity(answers)).select("qid", "n", rounded(F.col("score")).alias("score"))


# --- exports ---


@query("communities_lines", f"WITH {NATIONS} SELECT c, string_agg(CAST(id + 1 AS VARCHAR), chr(9) ORDER BY id) AS line FROM lab GROUP BY c")
def communities_lines(spark, sf_dir):
    return export.community_lines(T.nation_labels(spark, sf_dir))


@query("edgelist_lines", f"WITH {CS} SELECT src, dst, (src + 1) || ' ' || (dst + 1) || ' ' || w AS line FROM e1")
def edgelist_lines(spark, sf_dir):
    return export.edge_lines(T.customer_supplier(spark, sf_dir), one_based=True, weighted=True)


@query("dedoc_lines", f"WITH {CS}, {NATIONS} SELECT src, dst, (src + 1) || ' ' || (dst + 1) || ' ' || w AS line FROM e1 UNION ALL SELECT -1, -1, CAST(count(*) AS VARCHAR) FROM lab")
def dedoc_lines(spark, sf_dir):
    return export.dedoc_lines(T.customer_supplier(spark, sf_dir), T.nation_labels(spark, sf_dir))


@query("label_lines", f"WITH {NATIONS} SELECT id, CAST(c AS VARCHAR) AS line FROM lab")
def label_lines(spark, sf_dir):
    return export.label_lines(T.nation_labels(spark, sf_dir))


@query("communities_read", "SELECT * FROM (VALUES (0, 0), (1, 1), (2, 1), (3, 0), (4, 2), (5, 3)) t(id, c)")
def communities_read(spark, sf_dir):
    """Later lines count, blank ones and unknown ids don't, vertices in none come last."""
    lines = spark.createDataFrame([(0, "1 2 4"), (1, ""), (2, "2\t3 99")], "n long, line string")
    vertices = spark.range(6).select(F.lit("g").alias(GID), "id")
    return export.read_communities(lines, vertices).select(F.col("id").cast("int").alias("id"), F.col("c").cast("int").alias("c"))


GML = """Creator "someone"
graph [
  node [
    id 10
    label "b"
    value 1
  ]
  node [
    id 20
    label "a"
    value 0
  ]
  node [
    id 30
    label "c"
    value 1
  ]
  edge [
    source 10
    target 20
  ]
  edge [
    source 30
    target 10
    weight 2.5
  ]
]"""


@query("gml_edges", "SELECT * FROM (VALUES (0, 1, 1.0::DOUBLE), (1, 2, 2.5)) t(src, dst, w)")
def gml_edges(spark, sf_dir):
    lines = spark.createDataFrame(list(enumerate(GML.split("\n"))), "n long, line string")
    return export.read_gml(lines)[0].select(F.col("src").cast("int").alias("src"), F.col("dst").cast("int").alias("dst"), "w")


@query("tree_json")
def tree_json(spark, sf_dir):
    """The karate club's encoding tree as nested JSON."""
    import json

    import pandas as pd

    edges, vertices = S.karate(spark)

    def run(key, e, v):
        net, _ = search.net_of(e, v)
        tree = K.encoding_tree(net)
        return pd.DataFrame({GID: [key[0]], "tree": [json.dumps(tree.nested())], "height": [tree.height()]})

    return edges.groupBy(GID).cogroup(search.renewed(vertices).groupBy(GID)).applyInPandas(run, f"{GID} string, tree string, height int")


# --- tables of results ---

REC = "rec AS (SELECT l_returnflag AS dataset, substr(CAST(l_shipdate AS VARCHAR), 1, 4) AS method, l_discount AS x FROM lineitem)"


def _records(spark, sf_dir):
    lines = T.table(spark, sf_dir, "lineitem")
    return lines.select(F.col("l_returnflag").alias("dataset"), F.substring(F.col("l_shipdate").cast("string"), 1, 4).alias("method"), F.col("l_discount").alias("x"))


YEARS = ["1995", "1996", "1997"]


@query("summarize_pivot", f"WITH {REC} SELECT dataset, {', '.join(f'''round(avg(CASE WHEN method = '{y}' THEN x END), 6) + 0.0 AS y{y}''' for y in YEARS)} FROM rec GROUP BY dataset")
def summarize_pivot(spark, sf_dir):
    wide = benchmark.summarize(_records(spark, sf_dir), "x", YEARS)
    return wide.select("dataset", *[rounded(F.col(y)).alias(f"y{y}") for y in YEARS])


@query("best_flag", f"WITH {REC}, m AS (SELECT dataset, method, round(avg(x), 9) AS x FROM rec GROUP BY 1, 2) SELECT dataset, method, round(x, 6) + 0.0 AS x, abs(x - min(x) OVER (PARTITION BY dataset)) < 1e-6 AS best FROM m")
def best_flag(spark, sf_dir):
    means = _records(spark, sf_dir).groupBy("dataset", "method").agg(F.round(F.avg("x"), 9).alias("x"))
    found = benchmark.flagged_best(means, "x", tolerance=1e-6)
    return found.select("dataset", "method", rounded(F.col("x")).alias("x"), "best")


@query("wins_total", f"WITH {REC}, m AS (SELECT dataset, method, round(avg(x), 9) AS x FROM rec GROUP BY 1, 2), b AS (SELECT *, abs(x - min(x) OVER (PARTITION BY dataset)) < 1e-6 AS best FROM m) SELECT count(*) FILTER (best) AS wins, count(*) AS total FROM b WHERE method = '1995'")
def wins_total(spark, sf_dir):
    means = _records(spark, sf_dir).groupBy("dataset", "method").agg(F.round(F.avg("x"), 9).alias("x"))
    return benchmark.wins(means, "x", "1995", tolerance=1e-6)


@query("half_range", f"WITH {REC} SELECT dataset, method, round(avg(x), 6) + 0.0 AS mean, round((max(x) - min(x)) / 2, 6) + 0.0 AS half_range, count(x) AS n, round(stddev_pop(x), 6) + 0.0 AS std FROM rec GROUP BY 1, 2")
def half_range(spark, sf_dir):
    found = benchmark.spread(_records(spark, sf_dir), "x")
    return found.select("dataset", "method", *[rounded(F.col(c)).alias(c) for c in ("mean", "half_range", "std")], "n")


@query("percent_change", f"""WITH {REC}, m AS (SELECT dataset, avg(x) FILTER (method = '1995') AS base, avg(x) FILTER (method = '1996') AS x FROM rec GROUP BY 1)
SELECT dataset, CASE WHEN x IS NULL OR base IS NULL THEN '—' ELSE format('{{:.2f}}', 100 * (x - base) / base) END AS change FROM m""")
def percent_change(spark, sf_dir):
    wide = benchmark.summarize(_records(spark, sf_dir), "x", ["1995", "1996"])
    return wide.select("dataset", fixed(100 * (F.col("1996") - F.col("1995")) / F.col("1995"), 2).alias("change"))


@query("facet_matrix", "SELECT a.p_brand AS \"row\", a.p_type AS col, count(DISTINCT a.p_partkey) AS n, string_agg(CAST(a.p_partkey AS VARCHAR), ',' ORDER BY p_size, a.p_partkey) AS keys FROM part a GROUP BY 1, 2")
def facet_matrix(spark, sf_dir):
    parts = T.table(spark, sf_dir, "part")
    facets = [parts.select(F.col("p_partkey").alias("key"), F.lit(f).alias("facet"), F.col(f).alias("value"), F.col("p_size").alias("year")) for f in ("p_brand", "p_type")]
    found = D.facet_matrix(facets[0].union(facets[1]), "p_brand", "p_type")
    return found.select("row", "col", "n", F.array_join(F.transform("keys", lambda k: k.cast("string")), ",").alias("keys"))


@query("latex_rows", f"""WITH {REC}, m AS (SELECT dataset, method, avg(x) AS x FROM rec GROUP BY 1, 2), b AS (SELECT *, abs(x - min(x) OVER (PARTITION BY dataset)) < 1e-9 AS best, format('{{:.3f}}', x) AS cell FROM m)
SELECT dataset, dataset || ' & ' || string_agg(CASE WHEN best THEN '\\textbf{{' || cell || '}}' ELSE cell END, ' & ' ORDER BY method) || ' \\\\' AS "row" FROM b GROUP BY dataset""")
def latex_rows(spark, sf_dir):
    return benchmark.latex_rows(_records(spark, sf_dir), "x", lower=True)


MEANS = f"{REC}, m AS (SELECT dataset, method, round(avg(x), 6) + 0.0 AS x, count(*) AS n FROM rec GROUP BY 1, 2)"


def _means(spark, sf_dir):
    return _records(spark, sf_dir).groupBy("dataset", "method").agg(rounded(F.avg("x")).alias("x"), F.count(F.lit(1)).alias("n"))


@query("results_upsert", f"""WITH {MEANS}, air AS (SELECT l_returnflag AS dataset, substr(CAST(l_shipdate AS VARCHAR), 1, 4) AS method, round(avg(l_tax), 6) + 0.0 AS x, count(*) AS n FROM lineitem GROUP BY 1, 2),
o AS (SELECT * FROM m WHERE method < '1997'), w AS (SELECT * FROM air WHERE method >= '1995')
SELECT dataset, method, x, n FROM w UNION ALL SELECT dataset, method, x, n FROM o WHERE (dataset, method) NOT IN (SELECT (dataset, method) FROM w)""")
def results_upsert(spark, sf_dir):
    """A table of results up to 1996 with another's from 1995 on: two years are replaced, later ones come in."""
    lines = T.table(spark, sf_dir, "lineitem")
    year = F.substring(F.col("l_shipdate").cast("string"), 1, 4).alias("method")
    other = lines.groupBy(F.col("l_returnflag").alias("dataset"), year).agg(rounded(F.avg("l_tax")).alias("x"), F.count(F.lit(1)).alias("n"))
    return benchmark.upserted(_means(spark, sf_dir).where("method < '1997'"), other.where("method >= '1995'"), ["dataset", "method"])


@query("set_operations", """WITH a AS (SELECT l_partkey AS key FROM lineitem WHERE l_returnflag = 'A'), b AS (SELECT l_partkey AS key FROM lineitem WHERE l_returnflag = 'R')
SELECT 'intersect' AS op, key FROM (SELECT key FROM a INTERSECT SELECT key FROM b) UNION ALL SELECT 'union', key FROM (SELECT key FROM a UNION SELECT key FROM b)
UNION ALL SELECT 'except', key FROM (SELECT key FROM a EXCEPT SELECT key FROM b)""")
def set_operations(spark, sf_dir):
    """Parts of lines with flag A against those with flag R."""
    return D.set_operations(T.table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("set"), F.col("l_partkey").alias("key")), "A", "R")


@query("json_records", f"WITH {MEANS} SELECT dataset, method, x, n FROM m")
def json_records(spark, sf_dir):
    """Results written as JSON and read back."""
    path = f"{folder(spark)}/records-{uuid.uuid4().hex}"
    export.write_records(_means(spark, sf_dir), path)
    return export.read_records(spark, path, "dataset string, method string, x double, n long")


@query("loops_dropped", f"WITH {EV} SELECT src, dst, w FROM e1 WHERE src <> dst")
def loops_dropped(spark, sf_dir):
    return without_loops(T.event_transitions(spark, sf_dir)).select("src", "dst", "w")


@query("largest_element", "SELECT vec_id, CAST(list_position(embedding, list_max(embedding)) - 1 AS BIGINT) AS place FROM embeddings")
def largest_element(spark, sf_dir):
    return T.table(spark, sf_dir, "embeddings").select("vec_id", argmax(F.col("embedding")).cast("long").alias("place"))


# --- streams ---


@query("stream_counts", "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_counts(spark, sf_dir):
    """Hourly counts by a streaming query over the events table, read to its end."""
    path = f"{folder(spark)}/counts-{uuid.uuid4().hex}"
    schema = T.table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    found = incremental.windowed_transitions(stream)
    job = incremental.to_batches(found, f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    job.awaitTermination()
    counts = incremental.latest_of(spark, found, f"{path}/out", ["start", "event_type"])
    return counts.select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n")


@query("stream_transitions", f"WITH {EV} SELECT src, dst, w FROM e1")
def stream_transitions(spark, sf_dir):
    """Transitions between event types by a stateful stream over the events table, dealt out by time into four micro-batches."""
    events = T.table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    path = f"{folder(spark)}/stream-{uuid.uuid4().hex}"
    bounds = events.select(F.percentile_approx(F.unix_micros("ts"), [0.25, 0.5, 0.75]).alias("q")).first()["q"] or []
    part = sum((F.coalesce((F.unix_micros("ts") > q).cast("int"), F.lit(0)) for q in bounds), F.lit(0))
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for k in range(len(bounds) + 1):  # files are read in the order in which they are written, and an actor's are one of each part
        events.where(part == k).repartition(width, "user_id").write.mode("append").parquet(f"{path}/in")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", width).parquet(f"{path}/in")
    found = incremental.stateful_steps(stream)
    schema = found.schema
    job = found.writeStream.outputMode("append").format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    job.awaitTermination()
    return canonical(spark.read.schema(schema).parquet(f"{path}/out"), graph_id="ev").select("src", "dst", "w")
