"""Queries on sources and sinks: each writes its input to a scratch folder and reads it back, or runs as a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.plans.catalog import query, table
from quillmill.plans.logs import actions
from quillmill.sources import readers, writers
from quillmill.sources.staging import scratch
from quillmill.streaming import keyed as K
from quillmill.streaming import reviewlog as L


@query("s1_catalogue_csv", """
SELECT p_brand, p_type, p_name FROM (SELECT *, row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_partkey) AS rn FROM part WHERE trim(p_name) <> '') WHERE rn = 1""")
def s1(spark, d):
    path = scratch(spark, "csv")
    table(spark, d, "part").select("p_brand", "p_type", "p_name", "p_partkey").repartitionByRange(4, "p_partkey").sortWithinPartitions("p_partkey").select("p_brand", "p_type", "p_name").write.option("header", True).csv(path)
    return readers.read_catalogue_csv(spark, path, ["p_brand", "p_type", "p_name"], ["p_brand", "p_type", "p_name"], ["p_brand", "p_type"]).select("p_brand", "p_type", "p_name")


@query("s2_csv_encoding", "SELECT r_regionkey::VARCHAR AS key, '지역 ' || r_name AS name FROM region")
def s2(spark, d):
    path = scratch(spark, "encoded")
    table(spark, d, "region").select(F.col("r_regionkey").alias("key"), F.concat(F.lit("지역 "), "r_name").alias("name")).coalesce(1).write.option("header", True).csv(path)
    return readers.read_csv_any_encoding(spark, f"{path}/*.csv", ["key", "name"])


@query("s3_positional", "SELECT c_custkey::VARCHAR AS code, c_name AS name FROM customer")
def s3(spark, d):
    c = table(spark, d, "customer")
    wide = c.select(*[F.lit(None).cast("string").alias(f"x{i}") for i in range(17)], "c_custkey", "c_name")
    return readers.positional(wide, {17: "code", 18: "name"})


@query("s4_build_index", "SELECT lpad(p_partkey::VARCHAR, 10, '0') AS code, p_name FROM part WHERE lpad(p_partkey::VARCHAR, 10, '0') LIKE '000000%'")
def s4(spark, d):
    path = scratch(spark, "index")
    p = table(spark, d, "part").select(F.lpad(F.col("p_partkey").cast("string"), 10, "0").alias("code"), "p_name")
    if not readers.build_index(p, path, "code", "v1") or readers.build_index(p, path, "code", "v1"):
        raise RuntimeError("an index must be written once for a fingerprint")
    return spark.read.parquet(f"{path}/fingerprint=v1").filter("code6 = '000000'").select("code", "p_name")


@query("s5_synonyms", """
SELECT 'by_code_no' AS kind, n_nationkey::VARCHAR AS key, lower(n_name) AS alias FROM nation UNION ALL SELECT 'by_name', n_name, replace(n_name, '_', ' ') FROM nation""")
def s5(spark, d):
    path = scratch(spark, "json")
    n = table(spark, d, "nation")
    to_map = lambda k, v: F.map_from_entries(F.collect_list(F.struct(k, F.array(v))))
    n.agg(to_map(F.col("n_nationkey").cast("string"), F.lower("n_name")).alias("by_code_no"), to_map(F.col("n_name"), F.replace("n_name", F.lit("_"), F.lit(" "))).alias("by_name")).coalesce(1).write.json(path)
    return readers.read_synonyms(spark, path)


@query("s6_relational_scan", """
SELECT l_orderkey, l_linenumber, c_name FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey ORDER BY l_orderkey, l_linenumber, c_name LIMIT 500""")
def s6(spark, d):
    t = lambda n: table(spark, d, n)
    joined = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    return joined.orderBy("l_orderkey", "l_linenumber", "c_name").limit(500).select("l_orderkey", "l_linenumber", "c_name")


@query("s14_archives", "SELECT n_regionkey::VARCHAR || '.txt' AS member, array_to_string(list(n_name ORDER BY n_name), chr(10)) AS content FROM nation GROUP BY n_regionkey")
def s14(spark, d):
    path = scratch(spark, "text")
    texts = table(spark, d, "nation").groupBy("n_regionkey").agg(F.array_join(F.array_sort(F.collect_list("n_name")), "\n").alias("value"))
    texts.select(F.concat(F.col("n_regionkey").cast("string"), F.lit(".txt")).alias("member"), "value").write.partitionBy("member").text(path)
    found = readers.read_archives(spark, f"{path}/*")
    return found.select(F.regexp_extract("file", r"member=([^/]+)/", 1).alias("member"), F.rtrim(F.regexp_replace("content", "\n$", "")).alias("content"))


@query("s16_newest_files", "SELECT 3 AS files")
def s16(spark, d):
    path = scratch(spark, "parts")
    table(spark, d, "nation").repartition(5, "n_nationkey").write.parquet(path)
    return readers.newest_files(spark, path, r"^part-\d+.*\.parquet$", 3).agg(F.count("*").cast("int").alias("files"))


@query("k4_append_runs", "SELECT 'sync' AS kind, count(*) AS n, count(DISTINCT status) AS states FROM events UNION ALL SELECT 'audit', count(*), count(DISTINCT event_type) FROM events".replace("count(DISTINCT status)", "count(DISTINCT event_type)"))
def k4(spark, d):
    path = scratch(spark, "runs")
    e = table(spark, d, "events")
    writers.append_run(e, path, "sync", F.col("ts"), F.col("event_type"))
    writers.append_run(e, path, "audit", F.col("ts"), F.col("event_type"))
    return spark.read.parquet(path).groupBy("kind").agg(F.count("*").alias("n"), F.count_distinct("status").alias("states"))


@query("k5_csv_report", "SELECT n_nationkey::VARCHAR AS n_nationkey, CASE WHEN n_regionkey = 1 THEN '' ELSE n_name END AS n_name, '' AS missing FROM nation")
def k5(spark, d):
    path = scratch(spark, "report")
    n = table(spark, d, "nation").withColumn("n_name", F.when(F.col("n_regionkey") != 1, F.col("n_name")))
    writers.write_csv_report(n, path, ["n_nationkey", "n_name", "missing"])
    return spark.read.option("header", True).csv(path).na.fill("")


@query("k6_json_report", """SELECT '{"n_name":"' || n_name || '","n_nationkey":' || n_nationkey || ',"n_regionkey":' || n_regionkey || '}' AS value FROM nation""")
def k6(spark, d):
    path = scratch(spark, "json-report")
    writers.write_json_report(table(spark, d, "nation"), path)
    return spark.read.text(path)


def streamed(df: DataFrame, name: str, step, last: DataFrame | None = None, **conf) -> DataFrame:
    """Run ``step`` over the files of ``df`` as a stream until all are read, some at a time; its output rows.

    ``last`` comes in a second run, which goes on from the checkpoint of the first: a row far ahead in
    time, say, that closes what waits for the watermark.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        for rows in (df, last) if last is not None else (df,):
            rows.write.mode("append").parquet(f"{path}/in")
            out = step(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 8).parquet(f"{path}/in"))
            run = out.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
            run.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return spark.read.schema(out.schema).parquet(f"{path}/out")


def timed(spark, d) -> DataFrame:
    """Events with a timestamp in several files, not in order of time."""
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return e.repartition(6, "event_id")


def far(df: DataFrame) -> DataFrame:
    """One row of its own keys, 900 days behind the last row of ``df``: no row waits for the watermark any more."""
    values = [(F.max("ts") + F.expr("INTERVAL 900 DAYS")).alias("ts") if f.name == "ts" else F.lit("__end" if f.dataType.simpleString() == "string" else None).cast(f.dataType).alias(f.name) for f in df.schema.fields]
    return df.agg(*values).select(*df.columns)


#: A delay that keeps every row of the table, in whatever order the files come.
DELAY = "800 days"
KEYED = dict([K.ROCKSDB])


@query("l1_review_stream")
def l1_stream(spark, d):
    log = actions(spark, d).join(timed(spark, d).select(F.col("event_id").alias("event"), "ts"), "event").repartition(6, "event")
    return streamed(log, "reviews", lambda s: K.replay_stream(s, delay=DELAY), far(log), **KEYED)


def requests(spark, d, *key: Column) -> DataFrame:
    return timed(spark, d).select(*key, F.col("event_id").alias("event"), "ts")


@query("l4_admitted_stream")
def l4_stream(spark, d):
    e = requests(spark, d, F.col("user_id").cast("string").alias("client"), F.col("event_type").alias("bucket"))
    return streamed(e, "limits", lambda s: K.admitted_stream(s, {"click": 2}, 4, 86400, delay=DELAY), far(e), **KEYED)


@query("l5_session_stream")
def l5_stream(spark, d):
    e = requests(spark, d, F.col("user_id").cast("string").alias("client"))
    return streamed(e, "sessions", lambda s: K.session_stream(s, 86400, delay=DELAY), far(e), **KEYED)


@query("l9_ring_stream", """
SELECT user_id::VARCHAR AS context, event_id AS event, least(row_number() OVER w, 20) AS held, lag(event_id, 20) OVER w AS evicted FROM events WHERE ts IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def l9_stream(spark, d):
    e = requests(spark, d, F.col("user_id").cast("string").alias("context"))
    return streamed(e, "rings", lambda s: K.ring_stream(s, 20, delay=DELAY), far(e), **KEYED)


@query("l7_event_windows", """
SELECT event_type, time_bucket(INTERVAL 1 DAY, ts) AS day, count(*) AS n FROM events GROUP BY ALL""")
def l7(spark, d):
    e = timed(spark, d).select("event_type", "ts")
    out = streamed(e, "windows", lambda s: s.withWatermark("ts", DELAY).groupBy("event_type", F.window("ts", "1 day").alias("w")).agg(F.count("*").alias("n")), far(e))
    return out.filter("event_type <> '__end'").select("event_type", F.col("w.start").cast("timestamp_ntz").alias("day"), "n")


@query("l6_queue_stream", """
SELECT count(*) FILTER (f AND r < 3) AS queued, count(*) FILTER (NOT f) AS processed, count(*) FILTER (f) AS failed, count(*) FILTER (f AND r >= 3) AS dead_letter FROM (SELECT value > 80 AS f, event_id % 5 AS r FROM events)""")
def l6_stream(spark, d):
    path = scratch(spark, "queue")
    tasks = table(spark, d, "events").select("event_id", "value", (F.col("event_id") % 5).alias("retries"))
    tasks.repartition(3).write.parquet(f"{path}/in")
    stream = spark.readStream.schema(tasks.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    L.route_queue(stream, f"{path}/out", f"{path}/state", F.col("value") > 80, "retries").awaitTermination()
    return L.queue_stats(spark.read.parquet(f"{path}/out"))
