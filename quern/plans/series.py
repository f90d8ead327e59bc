"""Metrics over training steps, fits of sweeps, schedules."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.functions import nn
from quern.functions.text import plain_name
from quern.operators import series as S
from quern.session import table

_ONCE = "(SELECT run, step, metric, arg_min(value, (arrived_at, value)) AS value FROM metrics WHERE value IS NOT NULL AND NOT isnan(value) GROUP BY run, step, metric)"
_LOSS = f"(SELECT run, step, value FROM {_ONCE} WHERE metric = 'train/loss')"


def _metric(spark, d, name):
    return S.once(table(spark, d, "metrics").where(F.col("metric") == name)).select("run", "step", "value")


def ema_loss(spark, d):
    return S.smoothed(_metric(spark, d, "train/loss"), ["run"], "step", "value").select("run", "step", F.round("ema", 4).alias("ema"))


def ema_loss_late(spark, d):
    """The finetuning variant: its step has moved on before the mean is debiased."""
    return S.smoothed(_metric(spark, d, "train/loss"), ["run"], "step", "value", late=1).select("run", "step", F.round("ema", 4).alias("ema"))


def running_min_bpb(spark, d):
    return S.running_min(_metric(spark, d, "val/bpb"), ["run"], "step", "value", "least").select("run", "step", "least")


def throughput_eta(spark, d):
    """Time counted after step 100 only, and what remains to 3,500 steps at its mean."""
    own = _metric(spark, d, "train/dt")
    w = Window.partitionBy("run").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    counted = F.when(F.col("step") > 100, F.col("value"))
    got = own.withColumn("total", F.coalesce(F.sum(counted).over(w), F.lit(0.0))).withColumn("n", F.count(counted).over(w))
    return got.select("run", "step", F.round("total", 2).alias("total"), F.round(F.when(F.col("n") > 0, F.col("total") / F.col("n") * (3500 - F.col("step"))), 1).alias("eta"))


def step_speed(spark, d):
    """Tokens a second of a batch of 524,288 and the share of 989e12 FLOPs they are at 1e9 FLOPs each."""
    own = _metric(spark, d, "train/dt").where("value > 0")
    return own.select("run", "step", F.floor(524288 / (F.col("value") / 1000)).alias("tok_per_sec"), F.round(100 * 1e9 * 524288 / (F.col("value") / 1000) / 989e12, 4).alias("mfu"))


def metric_every(spark, d):
    return S.once(table(spark, d, "metrics")).where("step % 100 = 0").groupBy("run", "metric").agg(F.count("*").alias("n"), F.max("step").alias("last_step"))


def argmin_step(spark, d):
    return _metric(spark, d, "val/bpb").groupBy("run").agg(F.min(F.struct("value", "step")).alias("x")).select("run", "x.step", F.col("x.value").alias("bpb"))


def first_of_run(spark, d):
    return _metric(spark, d, "train/loss").groupBy("run").agg(F.min_by("value", "step").alias("first_loss"), F.min("step").alias("first_step"))


def late_metrics(spark, d):
    """Rows that came more than a minute after they were logged, by run."""
    late = F.col("arrived_at") > F.col("logged_at") + F.expr("INTERVAL 1 MINUTE")
    return table(spark, d, "metrics").groupBy("run").agg(F.count("*").alias("n"), F.sum(late.cast("int")).alias("late"))


def distinct_metrics(spark, d):
    return table(spark, d, "metrics").groupBy("run").agg(F.array_join(F.sort_array(F.collect_set("metric")), ",").alias("metrics"))


#: The metrics and their columns in a pivot.
_PIVOT = {"train/loss": "loss", "val/bpb": "bpb", "train/lrm": "lrm", "train/dt": "dt", "train/mfu": "mfu", "train/tok_per_sec": "speed"}


def metric_pivot(spark, d):
    got = S.once(table(spark, d, "metrics")).groupBy("run").pivot("metric", list(_PIVOT)).agg(F.min("value"))
    return got.select("run", *(F.coalesce(F.format_string("%.4f", F.col(f"`{m}`")), F.lit("-")).alias(n) for m, n in _PIVOT.items()))


def progress_guard(spark, d):
    """Progress never falls back."""
    own = table(spark, d, "events").select("user_id", "event_id", "value")
    return S.running_min(own.withColumn("v", -F.col("value")), ["user_id"], "event_id", "v", "m").select("event_id", (-F.col("m")).alias("progress"))


def _sweep(spark, d):
    own = table(spark, d, "lineitem").where("l_quantity > 0 and l_extendedprice > 0")
    return own.select(F.col("l_linenumber").cast("long").alias("budget"), F.log10("l_quantity").alias("x"), F.log10("l_extendedprice").alias("y"))


def iso_fit(spark, d):
    got = S.quadratic_fit(_sweep(spark, d), "budget", F.col("x"), F.col("y"))
    optimum = F.when(F.col("a") > 0, -F.col("b") / (2 * F.col("a")))
    return got.select("budget", *(F.round(c, 4).alias(c) for c in "abc"), F.round(optimum, 3).alias("optimum"))


def power_law(spark, d):
    got = _sweep(spark, d).groupBy("budget").agg(F.regr_slope("y", "x").alias("power"), F.regr_intercept("y", "x").alias("scale"), F.regr_r2("y", "x").alias("r2"))
    return got.select("budget", F.round("power", 5).alias("power"), F.round("scale", 5).alias("scale"), F.round("r2", 5).alias("r2"))


def linreg(spark, d):
    got = table(spark, d, "part").groupBy("p_brand").agg(F.regr_slope("p_retailprice", "p_size").alias("a"), F.regr_intercept("p_retailprice", "p_size").alias("b"))
    return got.select("p_brand", F.round("a", 6).alias("a"), F.round("b", 4).alias("b"))


def r_squared(spark, d):
    """Of a guess, ten times the size and a thousand: one less the squared errors by the squared distances from the mean."""
    own = table(spark, d, "part").withColumn("e", F.col("p_retailprice") - (F.col("p_size") * 10 + 1000))
    got = own.groupBy("p_brand").agg((1 - F.sum(F.col("e") * F.col("e")) / (F.var_pop("p_retailprice") * F.count("*"))).alias("r2"))
    return got.select("p_brand", F.round("r2", 6).alias("r2"))


def ridge_sweep(spark, d):
    own = table(spark, d, "lineitem").select((F.col("l_quantity") / 50).alias("q"), "l_discount", "l_tax", (F.col("l_extendedprice") / 1e5).alias("y"))
    fits = S.ridge(own, ["q", "l_discount", "l_tax"], "y", _ALPHAS)
    rows = [(a, *(round(v, 6) for v in fit)) for a, fit in zip(_ALPHAS, fits, strict=True)]
    return spark.createDataFrame(rows, "alpha double, intercept double, w1 double, w2 double, w3 double")


def ridge_norms(spark, d):
    """Length of the weights at each penalty: the greater the penalty, the shorter."""
    own = ridge_sweep(spark, d).select("alpha", F.explode(F.array("w1", "w2", "w3")).alias("w"))
    return S.weight_norm(own, ["alpha"], "w").select("alpha", F.round("norm", 5).alias("norm"))


def task_fits(spark, d):
    """A line of price over size for each type, the best explained first."""
    got = S.ranked_fits(table(spark, d, "part"), "p_type", "p_size", "p_retailprice")
    return got.select("rank", "p_type", F.round("slope", 5).alias("slope"), F.round("r2", 6).alias("r2"))


def averaged_estimates(spark, d):
    """The mean of two estimates of a brand's price: of its small and of its large parts."""
    own = table(spark, d, "part")
    mean = lambda where: own.where(where).groupBy("p_brand").agg(F.avg("p_retailprice").alias("price"))
    return S.averaged(mean("p_size <= 10"), mean("p_size > 45"), ["p_brand"], "price").select("p_brand", F.round("price", 4).alias("price"))


def matrix_groups(spark, d):
    """Groups of matrices of one shape in models of several depths, with their rates."""
    shapes = S.with_shape(spark.range(4, 21, 8).withColumnRenamed("id", "depth"), "depth")
    return S.matrix_groups(S.layer_matrices(shapes)).select("rows", "columns", "matrices", F.round("lr", 8).alias("lr"))


def narrow_layers(spark, d):
    """Which matrices of models of several depths are computed in eight bits, by their plain names."""
    rows = S.layer_matrices(S.with_shape(spark.range(1, 6).withColumnRenamed("id", "depth"), "depth", 40, 40))
    name = plain_name(F.concat(F.when(F.col("layer") % 2 == 0, "_orig_mod.").otherwise(""), "name"))
    return rows.groupBy("depth", name.alias("name")).agg(F.sum(nn.convertible(F.col("rows"), F.col("columns")).cast("int")).alias("narrow"), F.count("*").alias("matrices"))


def data_ratio(spark, d):
    """Tokens for each effective parameter of models of several depths, after 1e9 tokens."""
    own = S.with_parameters(S.with_shape(spark.range(4, 21, 4).withColumnRenamed("id", "depth"), "depth"), "depth").withColumn("tokens_trained", F.lit(10**9))
    return S.with_ratio(own).select("depth", "effective_params", F.round("param_data_ratio", 6).alias("param_data_ratio"))


def interp(spark, d):
    points = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("g"), F.floor(F.col("o_totalprice") / 50000).cast("double").alias("x")).agg(F.round(F.avg("o_totalprice"), 2).alias("y"))
    wanted = table(spark, d, "orders").select(F.col("o_orderpriority").alias("g")).distinct().withColumn("point", F.explode(F.array(*map(F.lit, (-1.0, 0.5, 2.25, 99.0)))))
    return S.interpolated(points, wanted, "g", "x", "y", "point").select("g", "point", F.round("y", 3).alias("y"))


def lr_schedule(spark, d):
    n = spark.range(1000)
    return n.select("id", F.round(S.lr_multiplier(F.col("id"), 1000, 40, 650, 0.05), 8).alias("lr"), F.round(S.momentum(F.col("id"), 1000, 350), 8).alias("momentum"), F.round(S.weight_decay(F.col("id"), 1000, 0.28), 8).alias("wd"), F.round(1.0 - F.col("id") / 1000, 8).alias("rl"))


def lr_progress(spark, d):
    p = F.col("id") / 200
    return spark.range(201).select("id", F.round(S.lr_by_progress(p, 0.1, 0.5, 0.0), 8).alias("lr"), F.round((1 - F.least(F.col("id") / 300, F.lit(1.0))) * 0.85 + F.least(F.col("id") / 300, F.lit(1.0)) * 0.95, 8).alias("momentum"))


def param_counts(spark, d):
    shapes = S.with_parameters(S.with_shape(spark.range(2, 33, 2).withColumnRenamed("id", "depth"), "depth"), "depth")
    return shapes.select("depth", "width", "heads", "embedding", "value_embeddings", "head", "matrices", "scalars", "total")


def flops(spark, d):
    shapes = S.with_parameters(S.with_shape(spark.range(4, 27, 2).withColumnRenamed("id", "depth"), "depth"), "depth").withColumn("windows", S.windows(F.col("depth"), "SSSL", 2048))
    return shapes.select("depth", F.array_join("windows", ",").alias("windows"), S.flops_per_token(F.col("windows"), 2048).alias("flops"))


def auto_batch(spark, d):
    """Horizon, batch, and the scales of learning rate and weight decay of each depth at 12 tokens a parameter."""
    shapes = S.with_parameters(S.with_shape(spark.range(8, 33, 2).withColumnRenamed("id", "depth"), "depth"), "depth")
    scaling = shapes.select("depth", (F.col("matrices") + F.col("head")).alias("p"))
    ref = scaling.where(F.col("depth") == S.REFERENCE_DEPTH).select(F.col("p").alias("p_ref"))
    tokens, ref_tokens = F.col("p") * 12, F.col("p_ref") * 12
    batch = F.pow(F.lit(2.0), F.bround(F.log2(S.REFERENCE_BATCH * F.pow(tokens / ref_tokens, F.lit(S.BATCH_POWER))), 0)).cast("long")
    got = scaling.crossJoin(F.broadcast(ref)).withColumn("batch", batch)
    return got.select("depth", tokens.alias("tokens"), "batch", F.expr("(p * 12) div batch").alias("steps"), F.round(F.sqrt(F.col("batch") / S.REFERENCE_BATCH), 6).alias("lr_scale"), F.round(F.sqrt(F.col("batch") / S.REFERENCE_BATCH) * (ref_tokens / tokens), 6).alias("wd_scale"), F.expr(f"batch div {32 * 2048 * 8}").alias("accumulation"))


def residual_ramps(spark, d):
    """Start values of the residual scalars of a model of 12 layers."""
    residual, given = S.residual_ramps(12, F.col("id"))
    return spark.range(12).select("id", F.round(residual, 6).alias("residual"), F.round(given, 6).alias("input"))


def optimizer_groups(spark, d):
    got = S.optimizer_groups(S.with_shape(spark.range(4, 33, 4).withColumnRenamed("id", "depth"), "depth").select("width"))
    return got.select("width", "group", F.round("lr", 8).alias("lr"), "beta1", "beta2", "decay")


def horizons(spark, d):
    """Each part as a model of its size, with what its number gives."""
    p = F.col("p_partkey")
    own = table(spark, d, "part").select("p_partkey", F.when(p % 3 == 0, p).otherwise(-1).alias("i"), F.when(p % 3 == 1, p * 1e12).otherwise(-1.0).alias("f"), F.lit(12.0).alias("r"), (p * 1000).alias("n"))
    steps = S.horizon(F.col("i"), F.col("f"), F.col("r"), F.col("n"), F.col("n") * 6, F.lit(2048))
    return own.select("p_partkey", steps.cast("long").alias("steps"), S.whole_steps(p * 1000, F.lit(2048)).alias("eval_tokens"))


def price_middle(spark, d):
    got = S.geometric_middle(table(spark, d, "part"), "p_retailprice")
    return got.select(*(F.round(c, 4).alias(c) for c in ("mean", "std", "middle")))


def head_to_head(spark, d):
    """Mean price of each type by two brands, the difference and the gain in percent."""
    own = table(spark, d, "part").where("p_brand in ('Brand#11', 'Brand#12', 'Brand#13')").groupBy("p_type", "p_brand").agg(F.avg("p_retailprice").alias("m"))
    a, b = (own.where(F.col("p_brand") == n).select("p_type", F.col("m").alias(k)) for n, k in (("Brand#11", "a"), ("Brand#12", "b")))
    return a.join(b, "p_type").select("p_type", F.round(F.col("a") - F.col("b"), 4).alias("delta"), F.round((F.col("a") - F.col("b")) / F.col("b") * 100, 4).alias("gain"))


_ALPHAS = [0.0, 0.001, 0.01, 0.1, 1.0]


def _solved(k: int) -> list[str]:
    """The solution of k linear equations over columns g{i}_{j} and y{i} by Cramer's rule."""

    def det(rows: list[list[str]]) -> str:
        if len(rows) == 1:
            return rows[0][0]
        return "(" + " ".join(f"{'-' if j % 2 else '+'} {rows[0][j]} * {det([r[:j] + r[j + 1 :] for r in rows[1:]])}" for j in range(len(rows))) + ")"

    gram = [[f"g{min(i, j)}_{max(i, j)}" + (f" + a) * 1.0::DOUBLE" if i == j and i else ")") for j in range(k)] for i in range(k)]
    gram = [["(" + c for c in row] for row in gram]
    return [f"{det([[f'y{i}' if j == c else gram[i][j] for j in range(k)] for i in range(k)])} / {det(gram)}" for c in range(k)]


_FEATURES = ["1.0::DOUBLE", "q", "f", "t"]
_GRAM = ", ".join([f"sum({_FEATURES[i]} * {_FEATURES[j]}) AS g{i}_{j}" for i in range(4) for j in range(i, 4)] + [f"sum({x} * y) AS y{i}" for i, x in enumerate(_FEATURES)])
_RIDGE = f"""WITH r AS (SELECT l_quantity / 50 AS q, l_discount AS f, l_tax AS t, l_extendedprice / 1e5::DOUBLE AS y FROM lineitem), s AS (SELECT {_GRAM} FROM r), a AS (SELECT unnest({_ALPHAS})::DOUBLE AS a),
        w AS (SELECT a AS alpha, {', '.join(f'round({x}, 6) AS {n}' for n, x in zip(('intercept', 'w1', 'w2', 'w3'), _solved(4), strict=True))} FROM s, a)"""
_DET = "s4 * (s2 * n - s1 * s1) - s3 * (s3 * n - s1 * s2) + s2 * (s3 * s1 - s2 * s2)"
_SHAPE = "(SELECT depth, (ceil(depth * 64 / 128) * 128)::BIGINT AS width, ceil(depth * 64 / 128)::BIGINT AS heads, (depth + 1) // 2 AS ve FROM range({a}, {b}, 2) r(depth))"
_PARAMS = "(SELECT depth, width, heads, 32768 * width AS embedding, ve * 32768 * width AS value_embeddings, 32768 * width AS head, 12 * depth * width * width + ve * heads * 12 AS matrices, 2 * depth + 26 AS scalars FROM {s})"

QUERIES = {
    "ema_loss": (ema_loss, f"WITH RECURSIVE r AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY step) AS i FROM {_LOSS}), e AS (SELECT run, step, i, 0.1 * value AS s FROM r WHERE i = 1 UNION ALL SELECT r.run, r.step, r.i, 0.9 * e.s + 0.1 * r.value FROM e JOIN r ON r.run = e.run AND r.i = e.i + 1) SELECT run, step, round(s / (1 - 0.9::DOUBLE ** i), 4) AS ema FROM e"),
    "ema_loss_late": (ema_loss_late, f"WITH RECURSIVE r AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY step) AS i FROM {_LOSS}), e AS (SELECT run, step, i, 0.1 * value AS s FROM r WHERE i = 1 UNION ALL SELECT r.run, r.step, r.i, 0.9 * e.s + 0.1 * r.value FROM e JOIN r ON r.run = e.run AND r.i = e.i + 1) SELECT run, step, round(s / (1 - 0.9::DOUBLE ** (i + 1)), 4) AS ema FROM e"),
    "running_min_bpb": (running_min_bpb, f"SELECT run, step, min(value) OVER (PARTITION BY run ORDER BY step) AS least FROM {_ONCE} WHERE metric = 'val/bpb'"),
    "throughput_eta": (throughput_eta, f"SELECT run, step, round(coalesce(sum(value) FILTER (step > 100) OVER w, 0), 2) AS total, round((avg(value) FILTER (step > 100) OVER w) * (3500 - step), 1) AS eta FROM {_ONCE} WHERE metric = 'train/dt' WINDOW w AS (PARTITION BY run ORDER BY step)"),
    "step_speed": (step_speed, f"SELECT run, step, floor(524288 / (value / 1000))::BIGINT AS tok_per_sec, round(100 * 1e9 * 524288 / (value / 1000) / 989e12, 4) AS mfu FROM {_ONCE} WHERE metric = 'train/dt' AND value > 0"),
    "metric_every": (metric_every, f"SELECT run, metric, count(*) AS n, max(step) AS last_step FROM {_ONCE} WHERE step % 100 = 0 GROUP BY ALL"),
    "argmin_step": (argmin_step, f"SELECT run, arg_min(step, (value, step)) AS step, min(value) AS bpb FROM {_ONCE} WHERE metric = 'val/bpb' GROUP BY run"),
    "first_of_run": (first_of_run, f"SELECT run, arg_min(value, step) AS first_loss, min(step) AS first_step FROM {_LOSS} GROUP BY run"),
    "late_metrics": (late_metrics, "SELECT run, count(*) AS n, sum((arrived_at > logged_at + INTERVAL 1 MINUTE)::INT)::BIGINT AS late FROM metrics GROUP BY run"),
    "distinct_metrics": (distinct_metrics, "SELECT run, string_agg(DISTINCT metric, ',' ORDER BY metric) AS metrics FROM metrics GROUP BY run"),
    "metric_pivot": (metric_pivot, f"SELECT run, {', '.join(f'''coalesce(printf('%.4f', min(value) FILTER (metric = '{m}')), '-') AS {n}''' for m, n in _PIVOT.items())} FROM {_ONCE} GROUP BY run"),
    "progress_guard": (progress_guard, "SELECT event_id, max(value) OVER (PARTITION BY user_id ORDER BY event_id) AS progress FROM events"),
    "iso_fit": (iso_fit, f"""WITH p AS (SELECT l_linenumber::BIGINT AS budget, log10(l_quantity) AS x, log10(l_extendedprice) AS y FROM lineitem WHERE l_quantity > 0 AND l_extendedprice > 0), c AS (SELECT *, x - avg(x) OVER (PARTITION BY budget) AS t, avg(x) OVER (PARTITION BY budget) AS m FROM p),
        s AS (SELECT budget, max(m) AS m, count(*)::DOUBLE AS n, sum(t) AS s1, sum(t ** 2) AS s2, sum(t ** 3) AS s3, sum(t ** 4) AS s4, sum(y) AS t0, sum(t * y) AS t1, sum(t * t * y) AS t2 FROM c GROUP BY budget),
        f AS (SELECT budget, m, (t2 * (s2 * n - s1 * s1) - s3 * (t1 * n - s1 * t0) + s2 * (t1 * s1 - s2 * t0)) / ({_DET}) AS a, (s4 * (t1 * n - s1 * t0) - t2 * (s3 * n - s1 * s2) + s2 * (s3 * t0 - t1 * s2)) / ({_DET}) AS b1, (s4 * (s2 * t0 - t1 * s1) - s3 * (s3 * t0 - t1 * s2) + t2 * (s3 * s1 - s2 * s2)) / ({_DET}) AS c1 FROM s)
        SELECT budget, round(a, 4) AS a, round(b1 - 2 * a * m, 4) AS b, round(c1 - b1 * m + a * m * m, 4) AS c, CASE WHEN a > 0 THEN round(-(b1 - 2 * a * m) / (2 * a), 3) END AS optimum FROM f"""),
    "power_law": (power_law, "SELECT l_linenumber::BIGINT AS budget, round(regr_slope(log10(l_extendedprice), log10(l_quantity)), 5) AS power, round(regr_intercept(log10(l_extendedprice), log10(l_quantity)), 5) AS scale, round(regr_r2(log10(l_extendedprice), log10(l_quantity)), 5) AS r2 FROM lineitem WHERE l_quantity > 0 AND l_extendedprice > 0 GROUP BY 1"),
    "linreg": (linreg, "SELECT p_brand, round(regr_slope(p_retailprice, p_size), 6) AS a, round(regr_intercept(p_retailprice, p_size), 4) AS b FROM part GROUP BY 1"),
    "r_squared": (r_squared, "SELECT p_brand, round(1 - sum((p_retailprice - (p_size * 10 + 1000)) ** 2) / (var_pop(p_retailprice) * count(*)), 6) AS r2 FROM part GROUP BY 1"),
    "ridge_sweep": (ridge_sweep, f"{_RIDGE} SELECT alpha, intercept, w1, w2, w3 FROM w"),
    "ridge_norms": (ridge_norms, f"{_RIDGE} SELECT alpha, round(sqrt(w1 * w1 + w2 * w2 + w3 * w3), 5) AS norm FROM w"),
    "task_fits": (task_fits, "SELECT row_number() OVER (ORDER BY round(r2, 9) DESC NULLS LAST, p_type) AS rank, p_type, round(slope, 5) AS slope, round(r2, 6) AS r2 FROM (SELECT p_type, regr_slope(p_retailprice, p_size) AS slope, regr_r2(p_retailprice, p_size) AS r2 FROM part GROUP BY p_type)"),
    "averaged_estimates": (averaged_estimates, "SELECT coalesce(a.p_brand, b.p_brand) AS p_brand, round((coalesce(a.m, b.m) + coalesce(b.m, a.m)) / 2, 4) AS price FROM (SELECT p_brand, avg(p_retailprice) AS m FROM part WHERE p_size <= 10 GROUP BY 1) a FULL JOIN (SELECT p_brand, avg(p_retailprice) AS m FROM part WHERE p_size > 45 GROUP BY 1) b ON a.p_brand = b.p_brand"),
    "matrix_groups": (matrix_groups, "WITH m AS (SELECT depth, (ceil(depth * 64 / 128) * 128)::BIGINT AS w FROM range(4, 21, 8) r(depth)), s AS (SELECT w * r AS rows, w * c AS columns, depth * n AS n FROM m, (VALUES (1, 1, 4), (4, 1, 1), (1, 4, 1)) k(r, c, n)) SELECT rows, columns, sum(n)::BIGINT AS matrices, round(0.02 * sqrt(greatest(1.0, rows / columns)), 8)::DOUBLE AS lr FROM s GROUP BY rows, columns"),
    "narrow_layers": (narrow_layers, "SELECT depth, name, sum(((r * w) % 16 = 0 AND (c * w) % 16 = 0 AND least(r, c) * w >= 128)::INT)::BIGINT AS narrow, count(*) AS matrices FROM (SELECT depth, unnest(range(depth)) AS layer, ceil(depth * 40 / 40)::BIGINT * 40 AS w FROM range(1, 6) t(depth)), (VALUES ('query', 1, 1), ('key', 1, 1), ('value', 1, 1), ('projection', 1, 1), ('wide', 4, 1), ('narrow', 1, 4)) k(name, r, c) GROUP BY ALL"),
    "data_ratio": (data_ratio, f"SELECT depth, matrices + head AS effective_params, round(1e9 / (matrices + head), 6) AS param_data_ratio FROM {_PARAMS.format(s=_SHAPE.format(a=4, b=21))} WHERE depth % 4 = 0"),
    "interp": (interp, """WITH q AS (SELECT o_orderpriority AS g, floor(o_totalprice / 50000)::DOUBLE AS x, round(avg(o_totalprice), 2) AS y FROM orders GROUP BY ALL),
        w AS (SELECT DISTINCT o_orderpriority AS g, unnest([-1.0, 0.5, 2.25, 99.0])::DOUBLE AS point FROM orders),
        b AS (SELECT w.g, point, max(x) FILTER (x <= point) AS x0, min(x) FILTER (x >= point) AS x1, min(x) AS lo, max(x) AS hi FROM w JOIN q ON w.g = q.g GROUP BY ALL)
        SELECT b.g, point, round(CASE WHEN x0 IS NULL OR x1 IS NULL OR x0 = x1 THEN e.y ELSE s.y + (e.y - s.y) * (point - x0) / (x1 - x0) END, 3) AS y FROM b JOIN q e ON e.g = b.g AND e.x = coalesce(x1, hi) LEFT JOIN q s ON s.g = b.g AND s.x = x0"""),
    "lr_schedule": (lr_schedule, """SELECT range AS id, round(CASE WHEN range < 40 THEN (range + 1) / 40 WHEN range <= 350 THEN 1.0::DOUBLE ELSE (1000 - range) / 650 + (1 - (1000 - range) / 650) * 0.05 END, 8) AS lr, round(CASE WHEN range < 400 THEN (1 - range / 400) * 0.85 + range / 400 * 0.97 WHEN range >= 650 THEN 0.97 * (1 - (range - 650) / 350) + 0.9 * ((range - 650) / 350) ELSE 0.97 END, 8)::DOUBLE AS momentum, round(0.28 * 0.5 * (1 + cos(pi() * range / 1000)), 8) AS wd, round(1 - range / 1000, 8) AS rl FROM range(1000)"""),
    "lr_progress": (lr_progress, "SELECT range AS id, round(CASE WHEN range / 200 < 0.1 THEN (range / 200 + 1e-8) / 0.1 WHEN range / 200 <= 0.5 THEN 1.0 ELSE 1 - (range / 200 - 0.5) / 0.5 END, 8)::DOUBLE AS lr, round((1 - range / 300) * 0.85 + range / 300 * 0.95, 8) AS momentum FROM range(201)"),
    "param_counts": (param_counts, f"SELECT *, embedding + value_embeddings + head + matrices + scalars AS total FROM {_PARAMS.format(s=_SHAPE.format(a=2, b=33))}"),
    "flops": (flops, f"WITH p AS {_PARAMS.format(s=_SHAPE.format(a=4, b=27))}, l AS (SELECT p.*, unnest(range(0, depth)) AS i FROM p), w AS (SELECT *, CASE WHEN i = depth - 1 OR i % 4 = 3 THEN 2048 ELSE 512 END AS win FROM l) SELECT depth, string_agg(win::VARCHAR, ',' ORDER BY i) AS windows, (6 * (max(matrices) + max(head)) + sum(12 * heads * (width // heads) * win))::BIGINT AS flops FROM w GROUP BY depth"),
    "auto_batch": (auto_batch, f"WITH p AS (SELECT depth, matrices + head AS p FROM {_PARAMS.format(s=_SHAPE.format(a=8, b=33))}), r AS (SELECT p AS p_ref FROM p WHERE depth = 12), b AS (SELECT depth, p, p_ref, (2 ** round_even(log2(524288 * (p / p_ref) ** 0.383::DOUBLE), 0))::BIGINT AS batch FROM p, r) SELECT depth, p * 12 AS tokens, batch, (p * 12) // batch AS steps, round(sqrt(batch / 524288), 6) AS lr_scale, round(sqrt(batch / 524288) * (p_ref / p), 6) AS wd_scale, batch // 524288 AS accumulation FROM b"),
    "residual_ramps": (residual_ramps, "SELECT range AS id, round(1.15 - 0.10 * range / 11, 6)::DOUBLE AS residual, round(0.20 - 0.15 * range / 11, 6)::DOUBLE AS input FROM range(12)"),
    "optimizer_groups": (optimizer_groups, "SELECT width, g AS \"group\", round(lr * CASE WHEN wide = 1 THEN (width / 768) ** -0.5 ELSE 1 END, 8) AS lr, beta1, beta2, decay FROM (SELECT (ceil(depth * 64 / 128) * 128)::BIGINT AS width FROM range(4, 33, 4) r(depth)), (VALUES ('head', 0.004::DOUBLE, 1, 0.8::DOUBLE, 0.96::DOUBLE, 0.01::DOUBLE), ('embedding', 0.2::DOUBLE, 1, 0.8::DOUBLE, 0.995::DOUBLE, 0.001::DOUBLE), ('value_embeddings', 0.1::DOUBLE, 1, 0.8::DOUBLE, 0.995::DOUBLE, 0.01::DOUBLE), ('residual', 0.005::DOUBLE, 0, 0.8::DOUBLE, 0.95::DOUBLE, 0.05::DOUBLE), ('input', 0.5::DOUBLE, 0, 0.96::DOUBLE, 0.95::DOUBLE, 0.0::DOUBLE), ('smear', 0.2::DOUBLE, 0, 0.8::DOUBLE, 0.95::DOUBLE, 0.0::DOUBLE)) t(g, lr, wide, beta1, beta2, decay)"),
    "horizons": (horizons, "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_partkey WHEN 1 THEN round_even(p_partkey * 1e12 / (p_partkey * 6000.0::DOUBLE * 2048), 0)::BIGINT ELSE (p_partkey * 12000) // 2048 END AS steps, (p_partkey * 1000) // 2048 * 2048 AS eval_tokens FROM part WHERE p_partkey > 0 OR p_partkey % 3 <> 0 UNION ALL SELECT p_partkey, 0, 0 FROM part WHERE p_partkey = 0"),
    "price_middle": (price_middle, "SELECT round(avg(p_retailprice), 4) AS mean, round(stddev_samp(p_retailprice), 4) AS std, round(sqrt(min(p_retailprice) * max(p_retailprice)), 4) AS middle FROM part"),
    "head_to_head": (head_to_head, "WITH m AS (SELECT p_type, p_brand, avg(p_retailprice) AS m FROM part GROUP BY ALL) SELECT a.p_type, round(a.m - b.m, 4) AS delta, round((a.m - b.m) / b.m * 100, 4) AS gain FROM m a JOIN m b ON a.p_type = b.p_type AND a.p_brand = 'Brand#11' AND b.p_brand = 'Brand#12'"),
}
