"""Recurrences over metric series: folds over each series in order, native and exact."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.binding import bind

#: Steps that one array of a fold gathers; longer series are arrays of such arrays, so that work stays in proportion.
RUN = 256


def fold(df: DataFrame, key: str, order: list[str], value: str, start: dict, step) -> DataFrame:
    """key, order..., value and the fields of each step's state: step(state, x, index) gives the next state.

    A series is one array in order; its length is that of a metric log, not of a corpus. start: name -> first value.
    """
    item = F.struct(*order, F.col(value).cast("double").alias("__x"))
    series = df.groupBy(key).agg(F.array_sort(F.collect_list(item)).alias("__s"))
    state = F.struct(*[(v if isinstance(v, Column) else F.lit(v)).alias(k) for k, v in start.items()])
    fields = list(start)

    none = F.filter(F.array(state), lambda _: F.lit(False))

    def run(acc: Column, xs: Column) -> Column:
        def go(inner: Column, x: Column) -> Column:
            made = step(inner["state"], x["__x"], F.size(acc["out"]) * RUN + F.size(inner["out"]))
            after = F.struct(*[made[k].alias(k) for k in fields])
            return F.struct(after.alias("state"), F.concat(inner["out"], F.array(after)).alias("out"))

        folded = F.aggregate(xs, F.struct(acc["state"].alias("state"), none.alias("out")), go)
        return bind(folded, lambda r: F.struct(r["state"].alias("state"), F.concat(acc["out"], F.array(r["out"])).alias("out")))

    runs = F.transform(F.sequence(F.lit(0), F.ceil(F.size("__s") / RUN).cast("int") - 1), lambda i: F.slice("__s", i * RUN + 1, RUN))
    start_runs = F.struct(state.alias("state"), F.filter(F.array(none), lambda _: F.lit(False)).alias("out"))
    folded = F.flatten(F.aggregate(runs, start_runs, run)["out"])
    rows = series.select(key, F.explode(F.arrays_zip(F.col("__s"), folded.alias("__o"))).alias("r"))
    return rows.select(key, *[F.col(f"r.__s.{c}").alias(c) for c in order], F.col("r.__s.__x").alias(value), *[F.col(f"r.__o.{k}").alias(k) for k in fields])


def ema(df: DataFrame, key: str, order: list[str], value: str, decay: float = 0.999) -> DataFrame:
    """Exponential moving average; the first value starts it."""
    return fold(df, key, order, value, {"ema": F.lit(None).cast("double")}, lambda s, x, i: {"ema": F.when(i == 0, x).otherwise(decay * s["ema"] + (1 - decay) * x)})


def residual_ratio(df: DataFrame, key: str, order: list[str], main: str, residual: str, decay: float = 0.999, every: int = 100) -> DataFrame:
    """predicted residual maximum before each step (an eighth of the main one at first), and the ratio's average, which
    is renewed at the first step and each `every`-th."""
    packed = df.withColumn("__r", F.col(residual) / F.greatest(F.col(main), F.lit(1e-12)))

    def step(s: Column, x: Column, i: Column) -> dict:
        count = i + 1
        renew = (count == 1) | (count % every == 0)
        return {"ratio": F.when(renew, F.when(s["ratio"].isNull(), x).otherwise(decay * s["ratio"] + (1 - decay) * x)).otherwise(s["ratio"]), "before": s["ratio"]}

    out = fold(packed, key, order, "__r", {"ratio": F.lit(None).cast("double"), "before": F.lit(None).cast("double")}, step)
    joined = out.join(df.select(key, *order, main), [key, *order])
    return joined.select(key, *order, main, "ratio", F.greatest(F.col(main) * F.coalesce("before", F.lit(1 / 8)), F.lit(1e-12)).alias("predicted"))


def spike_quarantine(df: DataFrame, key: str, order: list[str], value: str, threshold: float = 5.0, decay: float = 0.99, snr: float = 0.1, safety: float = 2.0, warmup: int = 50) -> DataFrame:
    """Baseline, spike ratio, corrupt, quarantine of each step.

    The baseline doesn't take up spikes. A spike after the warm-up quarantines for max(3, ceil(log2(ratio) /
    log2(1+snr) * safety)) steps, unless a quarantine runs; each step ends with one less.
    """

    def step(s: Column, x: Column, i: Column) -> dict:
        base = F.coalesce(s["ema"], x)
        ratio = x / F.greatest(base, F.lit(1e-12))
        corrupt = ratio > threshold
        tau = F.greatest(F.lit(3), F.ceil(F.log2(F.greatest(ratio, F.lit(1.001))) / math.log2(1 + snr) * safety).cast("int"))
        left = F.greatest(s["quarantine"] - 1, F.lit(0))
        return {"ema": F.when(corrupt, s["ema"]).otherwise(decay * base + (1 - decay) * x), "spike_ratio": ratio, "corrupt": corrupt, "quarantine": F.when(corrupt & (i >= warmup) & (left == 0), tau).otherwise(left)}

    return fold(df, key, order, value, {"ema": F.lit(None).cast("double"), "spike_ratio": F.lit(0.0), "corrupt": F.lit(False), "quarantine": F.lit(0)}, step)


def cusum_phase(df: DataFrame, key: str, order: list[str], value: str, sigma_def: float = 2.0, sigma_off: float = 0.5, threshold: float = 10.0, reset: bool = False, reset_at: float = 5.0, mu: float = 1.0) -> DataFrame:
    """statistic, backward, phase: a shift to the steady phase, and back if reset is allowed."""
    drift = (sigma_def**2 - sigma_off**2) / 2

    def step(s: Column, x: Column, i: Column) -> dict:
        deviation = (x - mu) * (x - mu)
        up = F.greatest(F.lit(0.0), s["statistic"] + drift - deviation)
        turns = (s["phase"] == "defensive") & (up > threshold)
        phase = F.when(turns, "offensive").otherwise(s["phase"])
        if not reset:
            return {"statistic": up, "backward": F.when(turns, 0.0).otherwise(s["backward"]), "phase": phase}
        back = F.greatest(F.lit(0.0), F.when(turns, 0.0).otherwise(s["backward"]) - drift + deviation)
        back = F.when(phase == "offensive", back).otherwise(s["backward"])
        falls = (phase == "offensive") & (back > reset_at)
        return {"statistic": F.when(falls, 0.0).otherwise(up), "backward": back, "phase": F.when(falls, "defensive").otherwise(phase)}

    return fold(df, key, order, value, {"statistic": F.lit(0.0), "backward": F.lit(0.0), "phase": F.lit("defensive")}, step)


def stability(df: DataFrame, key: str, order: list[str], value: str, window: int = 50) -> DataFrame:
    """1 / (1 + sample deviation / |mean|) of the last values; 0 for one value, 1 for a mean of about 0."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(1 - window, 0)
    m, s, n = F.avg(value).over(w), F.stddev_samp(value).over(w), F.count(value).over(w)
    return df.withColumn("stability", F.when(n < 2, 0.0).when(F.abs(m) < 1e-12, 1.0).otherwise(1.0 / (1.0 + s / F.abs(m))))


def progressive_phase(df: DataFrame, key: str, order: list[str], value: str, needs: tuple[float, ...] = (0.0, 0.70, 0.85, 0.92), window: int = 50) -> DataFrame:
    """phase: one step up at most at a time, as stability reaches what the next phase needs; never down."""
    table = F.array(*[F.lit(x) for x in needs])
    last = len(needs) - 1

    def step(s: Column, x: Column, i: Column) -> dict:
        up = (s["phase"] < last) & (x >= F.get(table, s["phase"] + 1))
        return {"phase": s["phase"] + F.when(up, 1).otherwise(0)}

    return fold(stability(df, key, order, value, window), key, order, "stability", {"phase": F.lit(0)}, step)


def hysteresis(df: DataFrame, key: str, order: list[str], value: str, enable: float = 0.05, disable: float = 0.15, shield: int = 50, decay: float = 0.99) -> DataFrame:
    """ema (from 0), enabled, shield: on below one threshold, off above the other; each change is shielded."""

    def step(s: Column, x: Column, i: Column) -> dict:
        e = decay * s["ema"] + (1 - decay) * x
        free = s["shield"] == 0
        on, off = free & ~s["enabled"] & (e < enable), free & s["enabled"] & (e > disable)
        return {"ema": e, "enabled": F.when(on, True).when(off, False).otherwise(s["enabled"]), "shield": F.when(~free, s["shield"] - 1).when(on | off, shield).otherwise(s["shield"])}

    return fold(df, key, order, value, {"ema": F.lit(0.0), "enabled": F.lit(False), "shield": F.lit(0)}, step)


def alignment(df: DataFrame, key: str, order: list[str], value: str, decay: float = 0.95, drag: float = -0.3, reset_after: int = 100, fallback_after: int = 200, highway_after: int = 500, plain_after: int = 1000) -> DataFrame:
    """ema (from 0) of a cosine, steps in drag and their number since the last action, and the action of each step.

    What applies first of: `plain` for a highway that drags long enough, which ends all; `highway`; `fallback`, if the
    series was reset before, which ends all too; `reset`. An action starts average and counts anew.
    """

    def step(s: Column, x: Column, i: Column) -> dict:
        over = s["ended"]
        e = decay * s["ema"] + (1 - decay) * x
        steps, checks = F.when(e < drag, s["drag_steps"] + 1).otherwise(0), s["checks"] + 1
        dragging = ~over & (steps > 0)
        action = (
            F.when(dragging & s["highway"] & (steps >= plain_after), "plain")
            .when(dragging & ~s["highway"] & (steps >= highway_after), "highway")
            .when(dragging & (steps >= fallback_after) & (s["resets"] > 0), "fallback")
            .when(dragging & (steps >= reset_after) & (checks >= reset_after), "reset")
            .otherwise("")
        )
        acts = action != ""
        return {
            "ema": F.when(over, s["ema"]).when(acts, 0.0).otherwise(e), "drag_steps": F.when(over, s["drag_steps"]).when(acts, 0).otherwise(steps),
            "checks": F.when(over, s["checks"]).when(acts, 0).otherwise(checks), "resets": s["resets"] + F.when(action == "reset", 1).otherwise(0),
            "highway": s["highway"] | (action == "highway"), "ended": over | action.isin("plain", "fallback"), "action": action,
        }

    start = {"ema": F.lit(0.0), "drag_steps": F.lit(0), "checks": F.lit(0), "resets": F.lit(0), "highway": F.lit(False), "ended": F.lit(False), "action": F.lit("")}
    return fold(df, key, order, value, start, step)


def vector_bias(df: DataFrame, key: str, order: str, vector: str, momentum: float = 0.9) -> DataFrame:
    """key, bias: average of difference vectors in order; the first one starts it."""
    series = df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, F.col(vector).cast("array<double>").alias("v")))).alias("s"))
    none = F.lit(None).cast("array<double>")
    bias = F.aggregate("s", none, lambda a, x: F.when(a.isNull(), x["v"]).otherwise(F.zip_with(a, x["v"], lambda p, q: p * momentum + q * (1 - momentum))))
    return series.select(key, bias.alias("bias"))


def rolling_mean_square(df: DataFrame, key: str, order: list[str], value: str, window: int = 100) -> DataFrame:
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(1 - window, 0)
    return df.withColumn("mean_square", F.avg(F.col(value) * F.col(value)).over(w))


def best_before(df: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """best: the least value before each row; improved: whether the row is below it."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = df.withColumn("best", F.min(value).over(w))
    return out.withColumn("improved", F.col("best").isNull() | (F.col(value) < F.col("best")))


def kurtosis_alerts(df: DataFrame, key: str, step: str, value: str, window: int = 500, factor: float = 2.0) -> DataFrame:
    """first: the earliest value within the window of steps; doubled: the value is over `factor` times it."""
    w = Window.partitionBy(key).orderBy(step).rangeBetween(-window, 0)
    first = F.first(value).over(w)
    many = F.count(value).over(w) >= 2
    out = df.withColumn("first", first)
    return out.withColumn("doubled", many & (F.abs("first") > 1e-6) & (F.col(value) / F.when(F.col("first") != 0, F.col("first")) > factor))


def threshold_alerts(metrics: DataFrame, norm_limit: float = 100.0, buffer_limit: float = 1.0, norm_every: int = 10, buffer_every: int = 100) -> DataFrame:
    """level, layer, rule, value, step from rows (step, layer, kind, value): rules of three tiers.

    kind `loss`: not finite, at every step. `grad_norm`: above its limit, at every norm_every-th step. `buffer`: above
    its limit or ten times it, at every buffer_every-th.
    """
    finite = ~(F.isnan("value") | (F.abs("value") == float("inf")))
    rule = (
        F.when((F.col("kind") == "loss") & ~finite, "non_finite_loss")
        .when((F.col("kind") == "grad_norm") & ~finite, "non_finite_gradient")
        .when((F.col("kind") == "grad_norm") & (F.col("step") % norm_every == 0) & (F.col("value") > norm_limit), "grad_norm")
        .when((F.col("kind") == "buffer") & (F.col("step") % buffer_every == 0) & (F.col("value") > 10 * buffer_limit), "buffer_far")
        .when((F.col("kind") == "buffer") & (F.col("step") % buffer_every == 0) & (F.col("value") > buffer_limit), "buffer")
    )
    level = F.when(F.col("rule").isin("grad_norm", "buffer"), "WARNING").otherwise("CRITICAL")
    return metrics.withColumn("rule", rule).where(F.col("rule").isNotNull()).select(level.alias("level"), "layer", "rule", "value", "step")
