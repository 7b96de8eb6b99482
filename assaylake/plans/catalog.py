"""The job catalogue, warnings, progress and exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import catalog, geometry
from ..sources.tables import LEAF_SQL, plain_leaf, table
from ..streaming import progress
from .registry import query


@query("""SELECT CAST(ts AS DATE) AS day, count(*) AS jobs, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS tokens, CAST(floor(avg(CASE WHEN value > 0 THEN CAST(round(value * 100) AS BIGINT) END)) AS BIGINT) AS mean_duration FROM events GROUP BY 1""")
def q_day_groups(spark: SparkSession, d: str) -> DataFrame:
    v = F.round(F.col("value") * 100).cast("bigint")
    return table(spark, d, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("jobs"), F.sum(v).cast("bigint").alias("tokens"), F.floor(catalog.mean_positive(v)).cast("bigint").alias("mean_duration"))


@query("""SELECT count(*) AS total, count(*) FILTER (event_type = 'purchase') AS completed, count(DISTINCT user_id) AS subjects, CAST(floor(avg(CASE WHEN value > 0 AND event_type = 'purchase' THEN CAST(round(value * 100) AS BIGINT) END)) AS BIGINT) AS mean_duration FROM events""")
def q_catalog_kpis(spark: SparkSession, d: str) -> DataFrame:
    v = F.when(F.col("event_type") == "purchase", F.round(F.col("value") * 100).cast("bigint"))
    return table(spark, d, "events").agg(F.count("*").alias("total"), F.count_if(F.col("event_type") == "purchase").alias("completed"), F.countDistinct("user_id").alias("subjects"), F.floor(catalog.mean_positive(v)).cast("bigint").alias("mean_duration"))


@query("""WITH f AS (SELECT user_id, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS updates FROM events GROUP BY user_id)
SELECT e.user_id AS job_id, e.event_type AS status, e.event_id, f.updates, CAST((epoch_us(f.last_ts) - epoch_us(f.first_ts)) // 1000 AS BIGINT) AS duration_ms FROM events e JOIN f ON e.user_id = f.user_id QUALIFY row_number() OVER (PARTITION BY e.user_id ORDER BY e.ts DESC, e.event_id DESC) = 1""")
def q_job_latest(spark: SparkSession, d: str) -> DataFrame:
    """Each job's latest row and the time since its first: one grouping, nothing sorted."""
    e = table(spark, d, "events")
    last = F.max(F.struct("ts", "event_id", "event_type"))
    out = e.groupBy(F.col("user_id").alias("job_id")).agg(last.alias("m"), F.count("*").alias("updates"), F.min("ts").alias("t0"))
    return out.select("job_id", F.col("m.event_type").alias("status"), F.col("m.event_id").alias("event_id"), "updates", F.floor((F.unix_micros(F.col("m.ts").cast("timestamp")) - F.unix_micros(F.col("t0").cast("timestamp"))) / 1000).cast("bigint").alias("duration_ms"))


SEVERITY = {"error": 0, "purchase": 1, "signup": 2}


@query("""WITH r AS (SELECT *, CASE event_type WHEN 'error' THEN 0 WHEN 'purchase' THEN 1 WHEN 'signup' THEN 2 ELSE 3 END AS rk FROM events)
SELECT event_type, count(*) AS n, CAST(min(rk) AS BIGINT) AS severity_rank, arg_min(props, event_id) AS sample FROM r GROUP BY event_type ORDER BY severity_rank, n DESC, event_type""")
def q_warning_groups(spark: SparkSession, d: str) -> DataFrame:
    rank = F.lit(3)
    for name, value in SEVERITY.items():
        rank = F.when(F.col("event_type") == name, value).otherwise(rank)
    return catalog.grouped_warnings(table(spark, d, "events"), "event_type", rank.cast("bigint"), F.col("props"), ["event_id"])


@query("""SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'FURNITURE' AND contains(lower(c_name), '42')""")
def q_catalog_search(spark: SparkSession, d: str) -> DataFrame:
    return catalog.searched(table(spark, d, "customer"), "c_name", "42", {"c_mktsegment": "FURNITURE"}).select("c_custkey", "c_name")


@query("""SELECT user_id, count(*) AS calls, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS prompt_tokens, CAST(sum(length(props)) AS BIGINT) AS completion_tokens, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS models FROM events GROUP BY user_id""")
def q_token_usage(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("prompt_tokens", F.get_json_object("props", "$.k").cast("bigint")).withColumn("completion_tokens", F.length("props"))
    return catalog.token_usage(e, "user_id", "event_type", ["prompt_tokens", "completion_tokens"])


@query("""WITH c AS (SELECT o_orderkey, o_custkey, o_orderstatus FROM orders), s AS (SELECT l_orderkey, count(*) AS items, count(*) FILTER (l_returnflag = 'R') AS high FROM lineitem GROUP BY l_orderkey)
SELECT o_orderkey AS job_id, o_orderstatus AS status, COALESCE(items, 0) AS items, COALESCE(high, 0) AS high FROM c LEFT JOIN s ON o_orderkey = l_orderkey""")
def q_jobs_with_criteria(spark: SparkSession, d: str) -> DataFrame:
    sums = plain_leaf(spark, d).groupBy(F.col("exam_id").alias("job_id")).agg(F.count("*").alias("items"), F.count_if(F.col("flag") == "R").alias("high"))
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("job_id"), F.col("o_orderstatus").alias("status")).join(sums, "job_id", "left").fillna(0, ["items", "high"])


@query("""SELECT o_orderkey AS job_id, CAST(epoch_ms(o_orderdate) AS BIGINT) AS created_ms FROM orders""")
def q_newest_jobs(spark: SparkSession, d: str) -> DataFrame:
    """All jobs, newest first."""
    return table(spark, d, "orders").orderBy(F.col("o_orderdate").desc(), "o_orderkey").select(F.col("o_orderkey").alias("job_id"), F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("created_ms"))


@query(f"""WITH {LEAF_SQL}, m AS (SELECT DISTINCT exam_id, 'assets/' || CAST(part_id AS VARCHAR) || '.png' AS path FROM leaf WHERE flag <> 'R') SELECT exam_id, 'exam_' || CAST(exam_id AS VARCHAR) || '/' || path AS target FROM m
UNION ALL SELECT o_orderkey, 'exam_' || CAST(o_orderkey AS VARCHAR) || '/error.json' FROM orders WHERE o_orderkey NOT IN (SELECT exam_id FROM leaf)""")
def q_export_manifest(spark: SparkSession, d: str) -> DataFrame:
    """What a ZIP export holds: each exam's assets once, and an error file for exams without questions."""
    q = plain_leaf(spark, d)
    folder = F.concat(F.lit("exam_"), F.col("exam_id").cast("string"), F.lit("/"))
    assets = q.filter("flag <> 'R'").select("exam_id", "part_id").distinct().select("exam_id", F.concat(folder, F.lit("assets/"), F.col("part_id").cast("string"), F.lit(".png")).alias("target"))
    failed = table(spark, d, "orders").select(F.col("o_orderkey").alias("exam_id")).join(q.select("exam_id").distinct(), "exam_id", "left_anti")
    return assets.unionByName(failed.select("exam_id", F.concat(folder, F.lit("error.json")).alias("target")))


@query("""WITH e AS (SELECT user_id, event_type, CAST(CASE event_type WHEN 'signup' THEN 10 WHEN 'view' THEN 40 WHEN 'click' THEN 60 WHEN 'purchase' THEN 100 ELSE 0 END AS BIGINT) AS percent, ts, event_id FROM events)
SELECT user_id AS exam_id, event_type AS stage, percent FROM e QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""")
def q_progress_latest(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events").select(F.col("user_id").alias("exam_id"), F.col("event_type").alias("stage"), "ts", "event_id")
    return progress.latest_stage(events)


@query("""WITH e AS (SELECT user_id, event_type, CAST(CASE event_type WHEN 'signup' THEN 10 WHEN 'view' THEN 40 WHEN 'click' THEN 60 WHEN 'purchase' THEN 100 ELSE 0 END AS BIGINT) AS percent, ts, event_id FROM events)
SELECT user_id AS exam_id, event_type AS stage, percent FROM e QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""")
def q_progress_stream(spark: SparkSession, d: str) -> DataFrame:
    """The same from a stream that is read to its end; its state and result are one row per exam."""
    return progress.run_to_end(spark, f"{d}/events.parquet")


@query("""WITH b AS (SELECT p_partkey AS id, CAST(p_size * 7 AS BIGINT) AS x0, CAST(p_partkey % 200 AS BIGINT) AS y0, CAST(p_size * 7 + 40 + p_partkey % 50 AS BIGINT) AS x1, CAST(p_partkey % 200 + 30 AS BIGINT) AS y1 FROM part)
SELECT id, greatest(x0, 0) AS x0, greatest(y0, 0) AS y0, least(x1, 300) AS x1, least(y1, 200) AS y1, greatest(least(x1, 300) - greatest(x0, 0), 0) * greatest(least(y1, 200) - greatest(y0, 0), 0) AS area FROM b""")
def q_clip_boxes(spark: SparkSession, d: str) -> DataFrame:
    """Boxes clipped to a page of 300 by 200."""
    return geometry.clip(boxes(spark, d), 300, 200).select("id", "x0", "y0", "x1", "y1", geometry.area().alias("area"))


def boxes(spark: SparkSession, d: str) -> DataFrame:
    key, size = F.col("p_partkey"), F.col("p_size").cast("bigint")
    return table(spark, d, "part").select(key.alias("id"), (size * 7).alias("x0"), (key % 200).alias("y0"), (size * 7 + 40 + key % 50).alias("x1"), (key % 200 + 30).alias("y1"))


@query("""WITH b AS (SELECT p_partkey AS id, CAST(p_size * 7 AS BIGINT) AS x0, CAST(p_partkey % 200 AS BIGINT) AS y0, CAST(p_size * 7 + 40 + p_partkey % 50 AS BIGINT) AS x1, CAST(p_partkey % 200 + 30 AS BIGINT) AS y1 FROM part),
p AS (SELECT id, x0, y0, x1, y1, unnest([0, 5, 10, 15, 20, 25, 30, 40]) AS pad FROM b), c AS (SELECT id, pad, greatest(x0 - pad, 0) AS x0, greatest(y0 - pad, 0) AS y0, least(x1 + pad, 300) AS x1, least(y1 + pad, 200) AS y1 FROM p),
s AS (SELECT *, greatest(x1 - x0, 0) * greatest(y1 - y0, 0) - pad * pad * 10 AS score FROM c) SELECT id, CAST(pad AS BIGINT) AS pad, CAST(score AS BIGINT) AS score FROM s QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, pad) = 1""")
def q_crop_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Of eight paddings of each box the one whose crop scores best; ties: the least padding."""
    return geometry.best_crop(boxes(spark, d), [0, 5, 10, 15, 20, 25, 30, 40], 300, 200)


@query("""SELECT source, CAST(count(*) AS BIGINT) AS docs, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) AS first_docs FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents) WHERE rn <= 12 GROUP BY source""")
def q_topic_caps(spark: SparkSession, d: str) -> DataFrame:
    """The first twelve documents of each source: twelve is the report's length."""
    from pyspark.sql import Window

    top = table(spark, d, "documents").select("source", "doc_id").withColumn("rn", F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))).filter("rn <= 12")
    lists = top.groupBy("source").agg(F.count("*").alias("docs"), F.array_sort(F.collect_list("doc_id")).alias("a"))
    return lists.select("source", "docs", F.array_join(F.transform("a", lambda x: x.cast("string")), ",").alias("first_docs"))


@query("""SELECT c_custkey, 'exam_' || CAST(c_custkey AS VARCHAR) || '/' || t AS target FROM customer, (VALUES ('result.json'), ('assets'), ('debug'), ('state.json')) v(t) WHERE regexp_matches(c_name, '^Customer#[0-9]*7$')""")
def q_delete_targets(spark: SparkSession, d: str) -> DataFrame:
    """Paths that deleting jobs of valid ids removes."""
    ids = table(spark, d, "customer").filter(F.col("c_name").rlike("^Customer#[0-9]*7$"))
    names = F.explode(F.array(*map(F.lit, ["result.json", "assets", "debug", "state.json"])))
    return ids.select("c_custkey", names.alias("t")).select("c_custkey", F.concat(F.lit("exam_"), F.col("c_custkey").cast("string"), F.lit("/"), "t").alias("target"))


@query("""WITH b AS (SELECT p_partkey AS id, CAST(p_size * 7 AS BIGINT) AS x0, CAST(p_partkey % 200 AS BIGINT) AS y0, p_brand AS page FROM part) SELECT id, page, row_number() OVER (PARTITION BY page ORDER BY y0, x0, id) AS reading_order FROM b""")
def q_reading_order(spark: SparkSession, d: str) -> DataFrame:
    """Blocks of a page from top to bottom, then from left to right."""
    b = boxes(spark, d).join(table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("page")), "id")
    return geometry.reading_order(b, ["page"], ["id"]).select("id", "page", "reading_order")


@query("""SELECT p_partkey AS id, (p_size * 300.0 / 100)::DOUBLE AS x0, (p_partkey % 90 * 200.0 / 100)::DOUBLE AS y0, ((p_size + 10) * 300.0 / 100)::DOUBLE AS x1, ((p_partkey % 90 + 5) * 200.0 / 100)::DOUBLE AS y1 FROM part""")
def q_estimated_boxes(spark: SparkSession, d: str) -> DataFrame:
    """Boxes estimated in percent of a page of 300 by 200, in its points."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("x_pct"), (F.col("p_partkey") % 90).cast("double").alias("y_pct"), F.lit(10.0).alias("w_pct"), F.lit(5.0).alias("h_pct"))
    return geometry.from_percent(p, 300, 200).select("id", "x0", "y0", "x1", "y1")


@query("""SELECT epoch_ms(date_trunc('day', ts)) AS day_ms, event_type AS stage, count(*) AS n FROM events GROUP BY ALL""")
def q_windowed_counts(spark: SparkSession, d: str) -> DataFrame:
    """Events of each stage by day; the same plan runs on a stream, where the watermark ends its state."""
    events = table(spark, d, "events").select("ts", F.col("event_type").alias("stage"))
    return progress.windowed_counts(events).select(F.unix_millis(F.col("window.start").cast("timestamp")).alias("day_ms"), "stage", F.col("count").alias("n"))
