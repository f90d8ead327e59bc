"""Logs and reports, made from the tables and read back; JSON; settings."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions.text import slug
from quern.operators import reports as R
from quern.operators import series as S
from quern.session import table


def _log(spark, d):
    """A log line per order: two kinds, numbers with commas."""
    own = table(spark, d, "orders")
    line = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("params: "), F.format_number(F.floor("o_totalprice"), 0))).when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit("bpb: "), F.format_string("%.2f", "o_totalprice"))).otherwise(F.lit("nothing to see"))
    return own.select(F.col("o_custkey").alias("run"), F.col("o_orderkey").alias("line_no"), line.alias("line"))


def log_extract(spark, d):
    return R.scraped(_log(spark, d), ["run"], "line_no", "line", {"params": (r"params: ([\d,]+)", None), "bpb": (r"bpb: ([\d.,]+)", 0.0), "core": (r"CORE: ([\d.]+)", 0.0)})


def section_values(spark, d):
    """The last value of each key in the notes of each market segment."""
    own = table(spark, d, "customer").select(F.col("c_mktsegment").alias("section"), F.col("c_custkey").alias("line_no"), F.concat(F.lit("- key"), (F.col("c_custkey") % 4).cast("string"), F.lit(": "), F.col("c_nationkey").cast("string"), F.lit(" : rest")).alias("line"))
    return R.last_values(own, ["key0", "key1", "key2"], ["section"], "line_no", "line")


def report_bullets(spark, d):
    own = table(spark, d, "part")
    whole = R.value_text(F.floor("p_retailprice") * F.col("p_size"), F.lit(False))
    return own.select("p_partkey", slug(F.col("p_name")).alias("slug"), F.concat(F.lit("- price: "), R.value_text(F.col("p_retailprice"), F.lit(True))).alias("price"), F.concat(F.lit("- whole: "), whole).alias("whole"))


def report_pivot(spark, d):
    """Metric by stage, a dash where there is none; CORE first, ChatCORE last."""
    own = table(spark, d, "orders").groupBy(F.when(F.col("o_orderpriority") == "1-URGENT", "CORE").when(F.col("o_orderpriority") == "5-LOW", "ChatCORE").otherwise(F.col("o_orderpriority")).alias("metric"), F.when(F.col("o_orderkey") % 7 == 0, "rl").otherwise(F.lower("o_orderstatus")).alias("stage")).agg(F.count("*").alias("n"))
    got = own.groupBy("metric").pivot("stage", ["o", "f", "rl", "none"]).agg(F.first("n"))
    place = F.when(F.col("metric") == "CORE", 0).when(F.col("metric") == "ChatCORE", 2).otherwise(1)
    return got.select("metric", place.alias("place"), *(F.coalesce(F.col(c).cast("string"), F.lit("-")).alias(c) for c in ("o", "f", "rl", "none")))


def report_wallclock(spark, d):
    """Start and end of each run as a report's header gives them, and the time between."""
    span = table(spark, d, "metrics").groupBy("run").agg(F.min("logged_at").alias("a"), F.max("logged_at").alias("b"))
    text = lambda p, c: F.concat(F.lit(f"## x\n{p}: not a time\n{p}: "), F.date_format(c, "yyyy-MM-dd HH:mm:ss"), F.lit("\n"))
    own = span.select("run", text("Run started", "a").alias("h"), text("timestamp", "b").alias("s"))
    return own.select("run", R.wall_clock(R.stamp(F.col("h"), "Run started:"), R.stamp(F.col("s"), "timestamp:")).alias("wall_clock"))


def report_end(spark, d):
    """The end of each run's report: the last section's time, whatever reinforcement learning's is; here each metric is a section."""
    last = table(spark, d, "metrics").groupBy("run", "metric").agg(F.max("logged_at").alias("t"))
    named = last.withColumn("file", F.when(F.col("metric") == "val/bpb", "chat-rl.md").otherwise(F.concat("metric", F.lit(".md"))))
    text = F.concat(F.lit("## x\ntimestamp: "), F.when(F.col("metric") == "train/mfu", "later").otherwise(F.date_format("t", "yyyy-MM-dd HH:mm:ss")), F.lit("\n"))
    return R.last_stamp(named.withColumn("text", text), ["run"], "metric", "file", "text").select("run", F.date_format("end", "yyyy-MM-dd HH:mm:ss").alias("end"))


def _results(spark, d):
    own = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("task")).agg(F.avg((F.col("o_orderstatus") == "F").cast("double")).alias("accuracy"))
    return own.withColumn("centered", (F.col("accuracy") - 0.25) / 0.75)


def core_csv(spark, d):
    return R.result_lines(_results(spark, d))


def core_csv_back(spark, d):
    return R.parsed_results(core_csv(spark, d), "line")


def gpu_lookup(spark, d):
    """Devices put together of table values: H100 of two kinds, an L4, an A100, an unknown one."""
    names = F.array(*map(F.lit, ("NVIDIA H100 PCIe", "NVIDIA H100 80GB HBM3", "NVIDIA L4", "NVIDIA A100-SXM4", "Abacus 3000")))
    own = table(spark, d, "supplier").select("s_suppkey", F.get(names, (F.col("s_suppkey") % 5).cast("int")).alias("device"))
    return own.select("s_suppkey", R.peak_flops(F.col("device")).alias("flops"), F.round(R.hourly_rate(F.col("device"), F.lit(8)), 2).alias("rate"))


def cost_estimate(spark, d):
    span = table(spark, d, "metrics").groupBy("run").agg((F.unix_micros(F.max("logged_at").cast("timestamp")) - F.unix_micros(F.min("logged_at").cast("timestamp"))).alias("us"))
    return span.select("run", F.round(R.hourly_rate(F.lit("NVIDIA H100"), F.lit(8)) * F.col("us") / 3.6e9, 4).alias("cost"))


def json_props(spark, d):
    own = table(spark, d, "events").select("event_type", F.from_json("props", "k int").alias("p"))
    return own.groupBy("event_type").agg(F.sum("p.k").alias("k"), F.count("p.k").alias("n"))


def json_out(spark, d):
    own = table(spark, d, "nation").select("n_nationkey", F.to_json(F.struct(F.col("n_name").alias("token"), F.col("n_regionkey").alias("gpu"))).alias("data"))
    return own.select("n_nationkey", F.concat(F.lit("data: "), "data").alias("line"))


def config_merge(spark, d):
    own = table(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, F.col("c_nationkey")).alias("given"), F.when(F.col("c_custkey") % 2 == 0, F.lit(100)).alias("stored"))
    value, origin = R.merged_setting(F.col("given"), F.col("stored"), F.lit(7))
    return own.select("c_custkey", value.alias("value"), origin.alias("origin"))


def checkpoints(spark, d):
    """The last step of the deepest model of each kind of run, from file names."""
    own = S.once(table(spark, d, "metrics")).select(F.format_string("%s/model_%06d.pt", "run", "step").alias("path")).distinct()
    depth, step = F.regexp_extract("path", r"d(\d+)_", 1).cast("int"), F.regexp_extract("path", r"model_(\d+)", 1).cast("int")
    return own.groupBy(F.regexp_extract("path", "_([a-z])", 1).alias("kind")).agg(F.max_by("path", F.struct(depth, step, F.col("path"))).alias("path"))


def skip_done(spark, d):
    """Runs of a grid of budgets and depths that aren't among the results yet."""
    grid = spark.createDataFrame([(float(b), k) for b in (1e18, 2e18, 5e18) for k in range(8, 21, 2)], "flops double, depth int")
    done = table(spark, d, "region").select(F.lit(1e18).alias("flops"), (F.col("r_regionkey") * 2 + 8).cast("int").alias("depth"))
    return grid.join(F.broadcast(done), ["flops", "depth"], "left_anti")


def display_size(spark, d):
    n = F.pow(F.lit(10.0), F.col("r_regionkey") + 6) * 1.3
    return table(spark, d, "region").select("r_regionkey", F.when(n >= 1e9, F.format_string("%.1fB", n / 1e9)).otherwise(F.format_string("%.0fM", n / 1e6)).alias("size"))


QUERIES = {
    "report_end": (report_end, "WITH l AS (SELECT run, metric, max(logged_at) AS t FROM metrics GROUP BY ALL) SELECT run, strftime(arg_max(t, metric) FILTER (metric NOT IN ('val/bpb', 'train/mfu') AND NOT contains(metric || '.md', 'rl')), '%Y-%m-%d %H:%M:%S') AS end FROM l WHERE metric <> 'val/bpb' GROUP BY run"),
    "log_extract": (log_extract, r"""WITH l AS (SELECT o_custkey AS run, o_orderkey AS n, CASE WHEN o_orderkey % 3 = 0 THEN 'params: ' || format('{:,}', floor(o_totalprice)::BIGINT) WHEN o_orderkey % 3 = 1 THEN 'bpb: ' || printf('%.2f', o_totalprice) ELSE 'nothing to see' END AS line FROM orders)
        SELECT run, arg_max(replace(nullif(regexp_extract(line, 'params: ([\d,]+)', 1), ''), ',', ''), n) FILTER (line LIKE 'params%')::DOUBLE AS params, coalesce(arg_max(regexp_extract(line, 'bpb: ([\d.,]+)', 1), n) FILTER (line LIKE 'bpb%')::DOUBLE, 0) AS bpb, 0.0::DOUBLE AS core FROM l GROUP BY run"""),
    "section_values": (section_values, "SELECT c_mktsegment AS section, 'key' || (c_custkey % 4) AS key, arg_max(c_nationkey, c_custkey)::VARCHAR AS value FROM customer WHERE c_custkey % 4 < 3 GROUP BY ALL"),
    "report_bullets": (report_bullets, "SELECT p_partkey, replace(lower(p_name), ' ', '-') AS slug, '- price: ' || printf('%.4f', p_retailprice) AS price, '- whole: ' || CASE WHEN floor(p_retailprice) * p_size >= 10000 THEN format('{:,}', (floor(p_retailprice) * p_size)::BIGINT) ELSE (floor(p_retailprice) * p_size)::BIGINT::VARCHAR END AS whole FROM part"),
    "report_pivot": (report_pivot, """WITH c AS (SELECT CASE o_orderpriority WHEN '1-URGENT' THEN 'CORE' WHEN '5-LOW' THEN 'ChatCORE' ELSE o_orderpriority END AS metric, CASE WHEN o_orderkey % 7 = 0 THEN 'rl' ELSE lower(o_orderstatus) END AS stage FROM orders)
        SELECT metric, CASE metric WHEN 'CORE' THEN 0 WHEN 'ChatCORE' THEN 2 ELSE 1 END AS place, coalesce(nullif(count(*) FILTER (stage = 'o'), 0)::VARCHAR, '-') AS o, coalesce(nullif(count(*) FILTER (stage = 'f'), 0)::VARCHAR, '-') AS f, coalesce(nullif(count(*) FILTER (stage = 'rl'), 0)::VARCHAR, '-') AS rl, '-' AS none FROM c GROUP BY metric"""),
    "report_wallclock": (report_wallclock, "SELECT run, (s // 3600) || 'h' || (s % 3600 // 60) || 'm' AS wall_clock FROM (SELECT run, epoch(date_trunc('second', max(logged_at)))::BIGINT - epoch(date_trunc('second', min(logged_at)))::BIGINT AS s FROM metrics GROUP BY run)"),
    "core_csv": (core_csv, "WITH r AS (SELECT o_orderpriority AS task, avg((o_orderstatus = 'F')::INT) AS a FROM orders GROUP BY 1) SELECT row_number() OVER (ORDER BY task) AS n, rpad(task, 35, ' ') || ', ' || rpad(printf('%.6f', a), 10, ' ') || ', ' || rpad(printf('%.6f', (a - 0.25) / 0.75), 10, ' ') AS line FROM r UNION ALL SELECT count(*) + 1, rpad('CORE', 35, ' ') || ', ' || rpad('', 10, ' ') || ', ' || rpad(printf('%.6f', avg((a - 0.25) / 0.75)), 10, ' ') FROM r"),
    "core_csv_back": (core_csv_back, "WITH r AS (SELECT o_orderpriority AS task, avg((o_orderstatus = 'F')::INT) AS a FROM orders GROUP BY 1) SELECT task, round(a, 6) AS accuracy, round((a - 0.25) / 0.75, 6) AS centered FROM r UNION ALL SELECT 'CORE', NULL, round(avg((a - 0.25) / 0.75), 6) FROM r"),
    "gpu_lookup": (gpu_lookup, "SELECT s_suppkey, (CASE s_suppkey % 5 WHEN 0 THEN 756e12 WHEN 1 THEN 989e12 WHEN 2 THEN 121e12 WHEN 3 THEN 312e12 ELSE 'inf' END)::DOUBLE AS flops, (CASE s_suppkey % 5 WHEN 0 THEN 24.0 WHEN 1 THEN 24.0 WHEN 3 THEN 14.32 ELSE 16.0 END)::DOUBLE AS rate FROM supplier"),
    "cost_estimate": (cost_estimate, "SELECT run, round(24.0::DOUBLE * (epoch_us(max(logged_at)) - epoch_us(min(logged_at))) / 3.6e9, 4) AS cost FROM metrics GROUP BY run"),
    "json_props": (json_props, "SELECT event_type, sum((props::JSON ->> 'k')::INT)::BIGINT AS k, count(props::JSON ->> 'k') AS n FROM events GROUP BY 1"),
    "json_out": (json_out, """SELECT n_nationkey, 'data: {"token":"' || n_name || '","gpu":' || n_regionkey || '}' AS line FROM nation"""),
    "config_merge": (config_merge, "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_nationkey WHEN c_custkey % 2 = 0 THEN 100 ELSE 7 END AS value, CASE WHEN c_custkey % 3 = 0 AND c_nationkey IS NOT NULL THEN 'given' WHEN c_custkey % 2 = 0 THEN 'stored' ELSE 'default' END AS origin FROM customer"),
    "checkpoints": (checkpoints, r"WITH p AS (SELECT DISTINCT run, step FROM metrics WHERE value IS NOT NULL AND NOT isnan(value)) SELECT regexp_extract(run || '/', '_([a-z])', 1) AS kind, arg_max(printf('%s/model_%06d.pt', run, step), (regexp_extract(run, 'd(\d+)_', 1)::INT, step, run)) AS path FROM p GROUP BY 1"),
    "skip_done": (skip_done, "SELECT f::DOUBLE AS flops, d::INT AS depth FROM (VALUES (1e18), (2e18), (5e18)) a(f), range(8, 21, 2) b(d) WHERE NOT EXISTS (SELECT 1 FROM region WHERE f = 1e18 AND d = r_regionkey * 2 + 8)"),
    "display_size": (display_size, "SELECT r_regionkey, CASE WHEN 1.3 * 10 ** (r_regionkey + 6) >= 1e9 THEN printf('%.1fB', 1.3 * 10 ** (r_regionkey - 3)) ELSE printf('%.0fM', 1.3 * 10 ** r_regionkey) END AS size FROM region"),
}
