"""Joins, set operations and tournaments over results, and a few relational queries on the star schema.

The queries named q_x_ are Spark built-ins on the star schema: support for the other operators' categories, not operators of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quartzite.sources.tables import table


def mismatches(source: DataFrame, restored: DataFrame, id_col: str, value: str) -> DataFrame:
    """(id, problem): ids without a restored row are missing, others with another value differ."""
    r = restored.select(F.col(id_col).alias("_id"), F.col(value).alias("_v"))
    got = source.join(r, source[id_col] == r["_id"], "left")
    problem = F.when(F.col("_id").isNull(), "missing").when(~F.col(value).eqNullSafe(F.col("_v")), "differs")
    return got.select(id_col, problem.alias("problem")).where("problem is not null")


def winner(trials: DataFrame, keys: list[str], size: Column, order: Column, codec: str = "codec") -> DataFrame:
    """The smallest result of each key; of equals, the one that was tried first."""
    return trials.groupBy(*keys).agg(F.min_by(codec, F.struct(size, order)).alias("winner"), F.min(size).alias("size"))


def codec_totals(trials: DataFrame) -> DataFrame:
    """Per codec: bytes in and out, ratio, and how often it was the smallest."""
    best = winner(trials, ["doc_id"], F.col("size"), F.col("ord")).groupBy("winner").agg(F.count("*").alias("wins"))
    total = trials.groupBy("codec").agg(F.sum("n").alias("n"), F.sum("size").alias("size"))
    return total.join(best, total.codec == best.winner, "left").select("codec", "n", "size", F.round(F.col("n") / F.greatest("size", F.lit(1)), 4).alias("ratio"), F.coalesce("wins", F.lit(0)).cast("long").alias("wins"))


def best_ratio(trials: DataFrame, keys: list[str]) -> DataFrame:
    """The codec with the best ratio of each group's bytes; of equals, the one that was tried first."""
    per = trials.groupBy(*keys, "codec", "ord").agg((F.sum("n") / F.greatest(F.sum("size"), F.lit(1))).alias("ratio"))
    return per.groupBy(*keys).agg(F.max_by("codec", F.struct("ratio", -F.col("ord"))).alias("best_ratio_codec"), F.round(F.max("ratio"), 4).alias("best_ratio"))


def scorecard(trials: DataFrame, keys: list[str], groups: list[str]) -> DataFrame:
    """How many of each group's texts, the empty ones aside, got smaller."""
    best = winner(trials, keys, F.col("size"), F.col("ord"))
    return best.groupBy(*groups).agg(F.count(F.when((F.col("size") < F.col("n")) & (F.col("n") > 0), 1)).alias("improved"), F.count("*").alias("n_docs"))


def _docs(s, d):
    return table(s, d, "documents")


def _restored(s, d):
    """Documents as a faulty restore would have them: every 7th lost, every 11th cut short."""
    return _docs(s, d).where("doc_id % 7 <> 0").select("doc_id", F.when(F.col("doc_id") % 11 == 0, F.substring("text", 1, 10)).otherwise(F.col("text")).alias("text"))


def _revenue(s, d):
    li, o, c, n = (table(s, d, t) for t in ("lineitem", "orders", "customer", "nation"))
    j = li.join(o, li.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
    return j.groupBy("n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.countDistinct("o_orderkey").alias("n_orders"))


QUERIES = {
    "q_roundtrip_mismatches": lambda s, d: mismatches(_docs(s, d).select("doc_id", "text"), _restored(s, d), "doc_id", "text"),
    "q_union_corpora": lambda s, d: _docs(s, d).select(F.lit("documents").alias("corpus"), "text").unionAll(table(s, d, "benchmark").select(F.lit("benchmark"), "text")).unionAll(table(s, d, "conversations").select(F.lit("conversations"), "text")).groupBy("corpus").agg(F.count("*").alias("n"), F.countDistinct("text").alias("n_distinct")),
    "q_missing_docs": lambda s, d: _docs(s, d).join(table(s, d, "labels"), "doc_id", "left_anti").select("doc_id"),
    "q_distinct_texts": lambda s, d: _docs(s, d).select("text").distinct().agg(F.count("*").alias("n")),
    "q_price_enrichment": lambda s, d: (lambda li, p: li.join(p, li.l_partkey == p.k, "left").groupBy("l_returnflag").agg(F.round(F.sum(F.coalesce("p_retailprice", "l_extendedprice")), 2).alias("price"), F.count(F.when(F.col("k").isNull(), 1)).alias("n_kept")))(table(s, d, "lineitem"), table(s, d, "part").where("p_size > 10").select(F.col("p_partkey").alias("k"), "p_retailprice")),
    "q_x_star_join": _revenue,
    "q_x_semi_anti": lambda s, d: table(s, d, "customer").join(table(s, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").groupBy("c_mktsegment").agg(F.count("*").alias("n")),
    "q_x_rollup": lambda s, d: table(s, d, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("qty"), F.count("*").alias("n")),
    "q_x_cube": lambda s, d: table(s, d, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n")),
    "q_x_rank": lambda s, d: table(s, d, "orders").withColumn("rk", F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey"))).where("rk <= 2").select("o_custkey", "o_orderkey", "rk"),
    "q_x_topk": lambda s, d: table(s, d, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20).select("o_orderkey", "o_totalprice"),
    "q_x_intersect": lambda s, d: table(s, d, "nation").select(F.col("n_nationkey").alias("k")).intersect(table(s, d, "supplier").select(F.col("s_nationkey").alias("k"))),
    "q_x_tumbling": lambda s, d: table(s, d, "events").groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")),
}

ORACLE_SQL = {
    "q_roundtrip_mismatches": "WITH r AS (SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN substr(text, 1, 10) ELSE text END AS v FROM documents WHERE doc_id % 7 <> 0) SELECT d.doc_id, CASE WHEN r.doc_id IS NULL THEN 'missing' ELSE 'differs' END AS problem FROM documents d LEFT JOIN r USING (doc_id) WHERE r.doc_id IS NULL OR d.text IS DISTINCT FROM r.v",
    "q_union_corpora": "SELECT corpus, count(*) AS n, count(DISTINCT text) AS n_distinct FROM (SELECT 'documents' AS corpus, text FROM documents UNION ALL SELECT 'benchmark', text FROM benchmark UNION ALL SELECT 'conversations', text FROM conversations) GROUP BY corpus",
    "q_missing_docs": "SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)",
    "q_distinct_texts": "SELECT count(*) AS n FROM (SELECT DISTINCT text FROM documents)",
    "q_price_enrichment": "SELECT l_returnflag, round(sum(coalesce(p_retailprice, l_extendedprice)), 2) AS price, count(CASE WHEN p_partkey IS NULL THEN 1 END) AS n_kept FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_size > 10) ON l_partkey = p_partkey GROUP BY l_returnflag",
    "q_x_star_join": "SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(DISTINCT o_orderkey) AS n_orders FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name",
    "q_x_semi_anti": "SELECT c_mktsegment, count(*) AS n FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) GROUP BY c_mktsegment",
    "q_x_rollup": "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS qty, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)",
    "q_x_cube": "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)",
    "q_x_rank": "SELECT o_custkey, o_orderkey, CAST(rk AS INTEGER) AS rk FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rk FROM orders) WHERE rk <= 2",
    "q_x_topk": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20",
    "q_x_intersect": "SELECT n_nationkey AS k FROM nation INTERSECT SELECT s_nationkey FROM supplier",
    "q_x_tumbling": "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
}
