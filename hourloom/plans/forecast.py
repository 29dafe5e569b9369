"""Requests, seeds, and multi-step forecasts of many series at once."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.calendar import calendar_columns, cyclic_columns, growth_proxy
from ..functions.weather import degree_columns, synthetic_temperature
from ..operators.joins import fill_temperature, join_weather
from ..operators.rank import head, tail
from ..session import KEY, ensure_checkpoints
from .features import PROFILES, feature_names
from .intervals import const_band

# Seed length, minimum seed from the fresher store, constant seed.
SEED_ROWS = 200
MIN_SEED = 24
CONSTANT_SEED = 50.0
HOUR = "interval 1 hour"


def resolve_requests(requests: DataFrame, anchors: DataFrame) -> DataFrame:
    """Start of each request: as given, else one hour after the anchor, else the current hour."""
    return requests.join(anchors, KEY, "left").withColumn(
        "start_ts",
        F.coalesce("start_ts", F.col("anchor_ts") + F.expr(HOUR), F.date_trunc("hour", F.current_timestamp())),
    )


def request_hours(resolved: DataFrame) -> DataFrame:
    """One row per requested hour."""
    end = F.col("start_ts") + F.make_dt_interval(hours=F.col("hours") - 1)
    hours = F.sequence(F.col("start_ts"), end, F.expr(HOUR))
    return resolved.select("request_id", KEY, F.posexplode(hours).alias("step", "ts"))


def seed_arrays(df: DataFrame, rows: int = SEED_ROWS) -> DataFrame:
    """Last values of each series as an array, oldest first (at most ``rows`` long)."""
    return (
        tail(df.select(KEY, "ts", "demand_gw"), rows)
        .groupBy(KEY)
        .agg(F.array_sort(F.collect_list(F.struct("ts", "demand_gw"))).alias("_rows"))
        .select(KEY, F.element_at("_rows", -1)["ts"].alias("last_ts"), F.col("_rows.demand_gw").alias("seed"))
    )


def choose_seed(wanted: DataFrame, stored: DataFrame, fresher: DataFrame | None = None) -> DataFrame:
    """Seed per wanted series: fresher store if long enough, else stored, else constant."""
    out = wanted.select(KEY).distinct().join(stored, KEY, "left")
    if fresher is not None:
        newer = fresher.where(F.size("seed") >= MIN_SEED).select(
            KEY, F.col("seed").alias("_seed"), F.col("last_ts").alias("_last")
        )
        out = out.join(newer, KEY, "left").select(
            KEY, F.coalesce("_last", "last_ts").alias("last_ts"), F.coalesce("_seed", "seed").alias("seed")
        )
    constant = F.array_repeat(F.lit(CONSTANT_SEED), SEED_ROWS)
    return out.withColumn("seed", F.coalesce("seed", constant))


def array_mean(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v) / F.size(values)


def array_stddev(values: Column) -> Column:
    """Sample deviation in one pass (Welford), 0 for fewer than two values."""
    zero = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2"))

    def add(acc: Column, v: Column) -> Column:
        n = acc["n"] + 1
        mean = acc["mean"] + (v - acc["mean"]) / n
        return F.struct(n.alias("n"), mean.alias("mean"), (acc["m2"] + (v - acc["mean"]) * (v - mean)).alias("m2"))

    return F.aggregate(values, zero, add, lambda a: F.when(a["n"] > 1, F.sqrt(a["m2"] / (a["n"] - 1))).otherwise(0.0))


def last_values(values: Column, n: int) -> Column:
    size = F.least(F.size(values), F.lit(n))
    return F.slice(values, F.size(values) - size + 1, size)


def bridge_seeds(seeds: DataFrame, anchors: DataFrame) -> DataFrame:
    """Shift seeds forward to a newer anchor, filling with the mean of their last 24 values."""
    joined = seeds.join(anchors, KEY, "left")
    hours = F.floor((F.unix_timestamp("anchor_ts") - F.unix_timestamp("last_ts")) / 3600)
    gap = F.greatest(F.coalesce(hours, F.lit(0)), F.lit(0)).cast("int")
    kept = F.slice("seed", F.col("gap") + 1, F.greatest(F.size("seed") - F.col("gap"), F.lit(0)))
    moved = F.concat(kept, F.array_repeat(array_mean(last_values(F.col("seed"), 24)), F.col("gap")))
    return joined.withColumn("gap", gap).withColumn("seed", F.when(F.col("gap") > 0, moved).otherwise(F.col("seed")))


def clamped(values: Column, k: int) -> Column:
    """The k-th value from the end, or the first one when the array is shorter."""
    return F.element_at(values, -F.least(F.lit(k), F.size(values)))


@dataclass(frozen=True)
class LinearModel:
    """Fixed-coefficient predictor on lags, the trailing day mean, an hour term and the temperature."""

    intercept: float = 0.0
    lags: dict[int, float] = field(default_factory=dict)
    mean_24h: float = 0.0
    exogenous: Callable[[Column], Column] | None = None
    temperature: float = 0.0

    def prepared(self, rows: DataFrame) -> DataFrame:
        """Rows with what a step reads from them; nothing here."""
        return rows

    def step(self, history: Column, ts: Column, temperature: Column | None = None) -> Column:
        out = F.lit(self.intercept)
        for k, c in self.lags.items():
            out = out + clamped(history, k) * c
        if self.mean_24h:
            out = out + array_mean(last_values(history, 24)) * self.mean_24h
        if self.exogenous is not None:
            out = out + self.exogenous(ts)
        if self.temperature and temperature is not None:
            out = out + temperature * self.temperature
        return out


def history_rows(model: LinearModel, least: int = SEED_ROWS) -> int:
    """Rows of history that a model reads: its longest lag, and the seed length at least."""
    return max(least, 24, *model.lags)


def seeded(requests: DataFrame, seeds: DataFrame) -> DataFrame:
    """Requests with their seed; a series without history gets the constant one."""
    constant = F.array_repeat(F.lit(CONSTANT_SEED), SEED_ROWS)
    joined = requests.join(seeds.select(KEY, F.col("seed").alias("_seed")), KEY, "left")
    return joined.withColumn("seed", F.coalesce("_seed", constant)).drop("_seed")


def recursive_path(history: Column, start: Column, hours: Column, model: LinearModel, temperatures: Column | None = None) -> Column:
    """Array of predictions, each step reading the ones before it; ``temperatures`` has one value per step."""
    warmth = lambda h: None if temperatures is None else F.get(temperatures, h)
    ts = lambda h: start + F.make_dt_interval(hours=h)
    grown = F.aggregate(
        F.sequence(F.lit(0), hours - 1),
        history,
        lambda acc, h: F.concat(acc, F.array(model.step(acc, ts(h), warmth(h)))),
    )
    return F.slice(grown, F.size(history) + 1, hours)


def recursive_linear(requests: DataFrame, seeds: DataFrame, model: LinearModel) -> DataFrame:
    """Recursive forecast per resolved request, as one projection without a loop.

    ``model`` is anything with ``step`` and ``prepared``: coefficients or a fitted forest."""
    rows = model.prepared(seeded(requests, seeds)).where("hours > 0")
    path = recursive_path(F.col("seed"), F.col("start_ts"), F.col("hours"), model)
    return rows.select("request_id", KEY, "start_ts", F.posexplode(path).alias("step", "pred")).select(
        "request_id", KEY, "step", (F.col("start_ts") + F.make_dt_interval(hours=F.col("step"))).alias("ts"), "pred"
    )


def horizon_temperatures(resolved: DataFrame, forecast: DataFrame) -> DataFrame:
    """Per request the temperature of every requested hour: the cached forecast, else the proxy."""
    hours = fill_temperature(join_weather(request_hours(resolved), forecast), decimals=None)
    packed = hours.groupBy("request_id").agg(F.array_sort(F.collect_list(F.struct("step", "temperature_f"))).alias("_hours"))
    return packed.select("request_id", F.col("_hours.temperature_f").alias("temperatures"))


def serve_requests(
    requests: DataFrame,
    stored: DataFrame,
    anchors: DataFrame,
    model: LinearModel,
    fresher: DataFrame | None = None,
    weather: DataFrame | None = None,
    band: str = "context",
) -> DataFrame:
    """Requests to forecast points with bounds, as one plan.

    Start, seed (fresher store, stored one, constant) and shift to the anchor are resolved per
    request, temperatures looked up, and the recursion runs as one array fold. All joins are
    left joins: every request gets its ``hours`` points. ``stored`` and ``fresher`` are demand
    rows; seeds are as long as the model needs.
    """
    resolved = resolve_requests(requests, anchors).drop("anchor_ts")
    rows = history_rows(model)
    seeds = choose_seed(requests, seed_arrays(stored, rows), None if fresher is None else seed_arrays(fresher, rows))
    ready = seeded(resolved, bridge_seeds(seeds, anchors))
    temperatures = None
    if weather is not None:
        ready = ready.join(horizon_temperatures(resolved, weather), "request_id", "left")
        temperatures = F.col("temperatures")
    ready = model.prepared(ready)
    path = recursive_path(F.col("seed"), F.col("start_ts"), F.col("hours"), model, temperatures)
    points = ready.where("hours > 0").select("request_id", KEY, "start_ts", F.posexplode(path).alias("step", "pred")).select(
        "request_id", KEY, "step", (F.col("start_ts") + F.make_dt_interval(hours=F.col("step"))).alias("ts"), "pred")
    return const_band(points, band)


def serving_scalars(ts: Column, temperature: Column | None = None) -> dict[str, Column]:
    """Calendar, cyclic, degree and growth inputs of an hour, with the proxy temperature unless one is given."""
    warmth = synthetic_temperature(ts, None) if temperature is None else temperature
    return {**calendar_columns(ts, "serve"), **cyclic_columns(ts), **degree_columns(warmth), "data_center_load_gw": growth_proxy(ts)}


def serving_features(df: DataFrame) -> DataFrame:
    """All model inputs of the next step, from the grown ``_history`` and its hour ``_ts``."""
    inputs = {**serving_scalars(F.col("_ts")), **array_features(F.col("_history"))}
    return df.withColumns(inputs).fillna(0, subset=[n for n in feature_names() if n in inputs])


def array_features(history: Column, upto: Column | None = None) -> dict[str, Column]:
    """Serving lags and rolling statistics of the position after ``history[:upto]``."""
    past = history if upto is None else F.slice(history, F.lit(1), upto)
    day, week = last_values(past, 24), last_values(past, 168)
    mean = lambda a: F.when(F.size(a) > 0, array_mean(a)).otherwise(0.0)
    out = {f"demand_lag_{k}h": clamped(past, k) for k in PROFILES["full"]["lags"]}
    out["demand_roll_mean_24h"] = mean(day)
    out["demand_roll_std_24h"] = array_stddev(day)
    out["demand_roll_mean_168h"] = mean(week)
    return out


FILLERS = {
    "zero": lambda seed: F.lit(0.0),
    "mean": lambda seed: array_mean(last_values(seed, 168)),
}


def filled_horizon(requests: DataFrame, seeds: DataFrame, policy: str) -> DataFrame:
    """Horizon rows whose lags read a constant instead of predictions, ready for batch scoring."""
    rows = seeded(requests, seeds)
    grown = F.concat("seed", F.array_repeat(FILLERS[policy](F.col("seed")), F.col("hours")))
    rows = rows.withColumn("_grown", grown).withColumn("_size", F.size("seed"))

    def one(h: Column) -> Column:
        features = array_features(F.col("_grown"), F.col("_size") + h)
        at = F.col("start_ts") + F.make_dt_interval(hours=h)
        return F.struct(h.alias("step"), at.alias("ts"), *[c.alias(n) for n, c in features.items()])

    steps = F.transform(F.sequence(F.lit(0), F.col("hours") - 1), one)
    return rows.select("request_id", KEY, F.explode(steps).alias("_s")).select("request_id", KEY, "_s.*")


def recursive_model(
    requests: DataFrame,
    seeds: DataFrame,
    features: Callable[[DataFrame], DataFrame],
    score: Callable[[DataFrame], DataFrame],
    segment: int = 6,
) -> DataFrame:
    """Recursion for any fitted model: every step advances all open requests at once.

    The state is one row per request (its columns and its seed grown by the predictions),
    so a step is a projection and a model transform, without a shuffle. ``features`` adds
    the model inputs given ``_ts`` and ``_history``; ``score`` adds ``prediction``. Every
    ``segment`` steps a checkpoint cuts the lineage and finished requests leave the state;
    each gets exactly its own ``hours`` points.
    """
    ensure_checkpoints(requests.sparkSession)
    state = seeded(requests, seeds).withColumns({"_size": F.size("seed"), "_history": F.col("seed")}).drop("seed")
    names = [c for c in state.columns if c != "_history"]
    longest = requests.agg(F.max("hours")).head()[0] or 0
    done = [state.where("hours <= 0 OR hours IS NULL")]
    state = state.where("hours > 0")
    for h in range(longest):
        at = state.withColumn("_ts", F.col("start_ts") + F.make_dt_interval(hours=F.lit(h)))
        grown = F.concat("_history", F.array(F.col("prediction").cast("double")))
        state = score(features(at)).select(*names, grown.alias("_history"))
        if (h + 1) % segment == 0 or h + 1 == longest:
            state = state.checkpoint()
            done.append(state.where(F.col("hours") <= h + 1))
            state = state.where(F.col("hours") > h + 1)
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    path = F.slice("_history", F.col("_size") + 1, F.greatest(F.col("hours"), F.lit(0)))
    return out.where("hours > 0").select("request_id", KEY, "start_ts", F.posexplode(path).alias("step", "pred")).select(
        "request_id", KEY, "step", (F.col("start_ts") + F.make_dt_interval(hours=F.col("step"))).alias("ts"), "pred"
    )


def summarize(points: DataFrame, keys=("request_id",), value: str = "pred") -> DataFrame:
    """Peak and average of each forecast."""
    return points.groupBy(*keys).agg(
        F.count("*").alias("hours"), F.max(value).alias("peak_gw"), F.avg(value).alias("avg_gw")
    )


def precomputed(stored: DataFrame, hours: int, band: str = "context", use_actual: bool = False) -> DataFrame:
    """First ``hours`` stored predictions with bounds; ``use_actual`` serves the actual column."""
    point = stored.withColumn("pred", F.col("actual")) if use_actual else stored
    return const_band(head(point, hours), band)
