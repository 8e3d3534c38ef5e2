"""Analysis of benchmark runs: summaries, comparisons, variance, histories.

Scores are rows (run, track, item, composite, n, valid, fabricated, unsupportive, ts, version);
summaries are made from them when asked for and never stored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import finite
from ..sources.shared import stored


def track_summary(scores: DataFrame, *more: str) -> DataFrame:
    """(run, track, n, mean, valid_rate): means over scored items; citation rates sum before they divide, null without citations."""
    return scores.groupBy("run", "track", *more).agg(
        F.count("composite").alias("n"), F.avg("composite").alias("mean"), (F.sum("valid") / F.nullif(F.sum("n"), F.lit(0))).alias("valid_rate"),
        (F.sum("fabricated") / F.nullif(F.sum("n"), F.lit(0))).alias("fabricated_rate"),
    )


def report_mean(scores: DataFrame) -> DataFrame:
    """(run, track, mean) where items without a score count 0."""
    return scores.groupBy("run", "track").agg(F.avg(F.coalesce("composite", F.lit(0.0))).alias("mean"), F.count("*").alias("n"))


def overall(tracks: DataFrame, inactive: tuple[str, ...] = ()) -> DataFrame:
    """(run, overall, n): the mean of track means weighted by their items, over tracks with items; null without any."""
    rows = tracks.where((F.col("n") > 0) & ~F.col("track").isin(*inactive)) if inactive else tracks.where("n > 0")
    return rows.groupBy("run").agg((F.sum(F.col("mean") * F.col("n")) / F.sum("n")).alias("overall"), F.sum("n").alias("n"))


def run_list(scores: DataFrame) -> DataFrame:
    """(run, versions, started, modes): sorted distinct versions and modes joined by a slash, and the earliest time."""
    names = lambda c: F.array_join(F.sort_array(F.collect_set(c)), "/")
    return scores.groupBy("run").agg(names("version").alias("versions"), F.min("ts").alias("started"), names("mode").alias("modes"))


def run_positions(runs: DataFrame) -> DataFrame:
    """Runs with ``idx``, their 0-based place by time, and whether their version differs from the run before. One row a run, which one task orders."""
    order = Window.orderBy("started", "run")
    return runs.withColumns({
        "idx": F.row_number().over(order) - 1, "version_changed": F.coalesce(F.lag("versions").over(order) != F.col("versions"), F.lit(False)),
    })


def compare(a: DataFrame, b: DataFrame) -> DataFrame:
    """(track, mean_a, mean_b, delta, common): tracks of either run, with the number of items that both scored."""
    means = lambda x, name: x.groupBy("track").agg(F.avg("composite").alias(name))
    items = lambda x: x.where("composite IS NOT NULL").select("track", "item").distinct()
    shared = items(a).join(items(b), ["track", "item"]).groupBy("track").agg(F.count("*").alias("common"))
    out = means(a, "mean_a").join(means(b, "mean_b"), "track", "full").join(shared, "track", "left")
    return out.select("track", "mean_a", "mean_b", (F.col("mean_b") - F.col("mean_a")).alias("delta"), F.coalesce("common", F.lit(0)).alias("common"))


def item_deltas(a: DataFrame, b: DataFrame, least: float = 0.005) -> DataFrame:
    """(track, item, a, b, delta) of items in both runs that moved by at least ``least``."""
    mean = lambda x, name: x.groupBy("track", "item").agg(F.avg("composite").alias(name))
    both = mean(a, "a").join(mean(b, "b"), ["track", "item"]).withColumn("delta", F.col("b") - F.col("a"))
    return both.where(F.abs("delta") >= least)


def track_deltas(tracks: DataFrame, runs: DataFrame) -> DataFrame:
    """(track, latest, previous, delta) of the last two runs in time; null where one of them lacks the track."""
    order = [F.desc("started"), F.desc("run")]
    last = runs.orderBy(*order).limit(2)
    last = last.withColumn("back", F.row_number().over(Window.orderBy(*order))).select("run", "back")
    at = lambda k: F.max(F.when(F.col("back") == k, F.col("mean")))
    return tracks.join(last, "run").groupBy("track").agg(at(1).alias("latest"), at(2).alias("previous")).withColumn("delta", F.col("latest") - F.col("previous"))


def variance(tracks: DataFrame) -> DataFrame:
    """(track, mean, sigma, spread, runs) over runs, sample deviation, for tracks with at least two finite means."""
    rows = tracks.where(finite(F.col("mean")).isNotNull())
    out = rows.groupBy("track").agg(
        F.avg("mean").alias("mean_of_means"), F.stddev_samp("mean").alias("sigma"), (F.max("mean") - F.min("mean")).alias("spread"), F.count("*").alias("runs")
    )
    return out.where("runs >= 2")


def noisy_items(scores: DataFrame, least_runs: int = 2) -> DataFrame:
    """(track, item, mean, sigma, spread, n) over runs; the deviation of a single run is 0."""
    out = scores.groupBy("track", "item").agg(
        F.avg("composite").alias("mean"), F.coalesce(F.stddev_samp("composite"), F.lit(0.0)).alias("sigma"),
        (F.max("composite") - F.min("composite")).alias("spread"), F.count("composite").alias("n"),
    )
    return out.where(F.col("n") >= least_runs)


def probe_stats(rows: DataFrame, by: str, value: str) -> DataFrame:
    """(by, mean, sigma, spread): population deviation."""
    return rows.groupBy(by).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("sigma"), (F.max(value) - F.min(value)).alias("spread"))


def timeline(runs: DataFrame) -> DataFrame:
    """(version, low, high, mean, runs, first_run): overall scores a version; the first run by time."""
    return runs.groupBy("versions").agg(
        F.min("overall").alias("low"), F.max("overall").alias("high"), F.avg("overall").alias("mean"), F.count("*").alias("runs"),
        F.min_by("run", F.struct("started", "run")).alias("first_run"),
    )


def with_best(rows: DataFrame, keys: list[str], value: str, near: float) -> DataFrame:
    """Rows with the best value of their keys over all runs, and whether theirs is it."""
    best = F.max(value).over(Window.partitionBy(*keys))
    return rows.withColumn("best", best).withColumn("is_best", F.abs(F.col(value) - F.col("best")) < near)


def heatmap(scores: DataFrame, runs: list[str]) -> DataFrame:
    """(track, item, one column a run): mean composites, null where an item is missing. The runs are given, so that columns stay the same."""
    return scores.groupBy("track", "item").pivot("run", runs).agg(F.avg("composite"))


def fingerprint(scores: DataFrame) -> DataFrame:
    """(run, hash): eight hex digits of the SHA-1 of a run's items by track, as sorted JSON with items in their order. A run's text is hashed whole, and so made in one row."""
    items = F.transform(F.array_sort(F.collect_list(F.struct("ord", "item"))), lambda x: F.concat(F.lit('"'), x["item"].cast("string"), F.lit('"')))
    tracks = scores.groupBy("run", "track").agg(F.array_join(items, ", ").alias("items"))
    entry = F.struct("track", F.concat(F.lit('"'), F.col("track"), F.lit('": ['), F.col("items"), F.lit("]")).alias("text"))
    whole = tracks.groupBy("run").agg(F.array_join(F.transform(F.array_sort(F.collect_list(entry)), lambda x: x["text"]), ", ").alias("body"))
    return whole.select("run", F.substring(F.sha1(F.concat(F.lit("{"), F.col("body"), F.lit("}"))), 1, 8).alias("hash"))


def upper_medians(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(key, n, median): of a key's values the one at n // 2, counted from 0 in ascending order, nulls first."""
    found = selected(rows, key, value)
    return found.select(key, F.col("n").cast("int").alias("n"), F.col("value").alias("median"))


def selected(rows: DataFrame, key: str, value: str, share: float = 0.5, cuts: int = 64) -> DataFrame:
    """(key, n, value): of a key's n values the one at place floor(n * share), counted from 0 in ascending order, nulls first; the last for a share of 1."""
    return quantiles(rows, key, value, [share], cuts).select(key, "n", "value")


def quantiles(rows: DataFrame, key: str, value: str, shares: list[float], cuts: int = 64, few: int = 1 << 18) -> DataFrame:
    """(share, key, n, value): what ``selected`` finds, for all shares in the same passes.

    No group is sorted. A pass takes a key's totals and a sketch, which places two bounds close around each wanted place. The next pass
    counts what lies below, at, between and above them, by value between them, where one or two of ``16 * cuts`` parts of the rows are. If those
    are more than ``few`` values, or the sketch was wrong, the range with the place is sketched and counted again. Every pass sums before it
    shuffles, so that a key may hold all rows; the driver sees whether any key is open. A null key has no row.
    """
    data = rows.select(F.col(key).alias("__k"), F.col(value).alias("__v")).where("__k IS NOT NULL")
    parts = 16 * cuts
    sketch = F.percentile_approx("__v", [i / parts for i in range(parts + 1)], 8 * parts).alias("sketch")
    one = ["__k", "share"]

    def bounded(state: DataFrame) -> DataFrame:
        """With ``lo`` and ``hi``, at least twice the sketch's error from the wanted place; all of the range where the sketch, which works on doubles, rounds out of it. Each pass so settles one value at least."""
        at = (F.col("want") + 0.5) / F.nullif("m", F.lit(0)) * parts
        cut = lambda i: F.get("sketch", F.greatest(F.lit(0), F.least(F.lit(parts), i)).cast("int"))
        state = state.withColumns({"lo": cut(F.floor(at - 0.25)), "hi": cut(F.ceil(at + 0.25))}).drop("sketch")
        off = F.expr("lo < low OR hi > high")
        return stored(state.withColumns({"lo": F.when(off, F.col("low")).otherwise(F.col("lo")), "hi": F.when(off, F.col("high")).otherwise(F.col("hi"))}), "selection")

    total = data.groupBy("__k").agg(F.count("*").alias("n"), F.count("__v").alias("m"), F.min("__v").alias("low"), F.max("__v").alias("high"), sketch)
    total = total.withColumn("share", F.explode(F.array(*map(F.lit, sorted({float(s) for s in shares})))))
    place = F.least(F.floor(F.col("n") * F.col("share")), F.col("n") - 1)
    state = bounded(total.withColumn("want", place - (F.col("n") - F.col("m"))))
    out = state.where("want < 0 OR low = high").select(*one, "n", F.when(F.col("want") >= 0, F.col("low")).alias("value"))
    state = state.where("want >= 0 AND low <> high")
    while state.limit(1).count():
        if "lo" not in state.columns:
            left = data.join(state.select(*one, "low", "high"), "__k").where("__v BETWEEN low AND high")
            state = bounded(left.groupBy(*one).agg(sketch).join(state, one))
        inside = data.join(state.select(*one, "low", "high", "lo", "hi"), "__k").where("__v BETWEEN low AND high")
        inside = inside.withColumn("zone", F.expr("CASE WHEN __v < lo THEN 0 WHEN __v = lo THEN 1 WHEN __v < hi THEN 2 WHEN __v = hi THEN 3 ELSE 4 END"))
        counted = inside.groupBy(*one, "zone", F.expr("IF(zone = 2, __v, NULL)").alias("v")).agg(F.count("*").alias("c"), F.min("__v").alias("low"), F.max("__v").alias("high"))
        counted = stored(counted, "selection")
        zones = counted.groupBy(*one, "zone").agg(F.sum("c").alias("m"), F.count("*").alias("kinds"), F.min("low").alias("low"), F.max("high").alias("high"))
        zones = zones.withColumn("before", F.sum("m").over(Window.partitionBy(*one).orderBy("zone")) - F.col("m")).join(state.select(*one, "n", "want"), one)
        found = zones.where("before <= want AND want < before + m").withColumn("want", F.col("want") - F.col("before")).withColumn("last", F.expr(f"zone = 2 AND kinds <= {few}"))
        found = stored(found.drop("before"), "selection")
        values = counted.where("zone = 2").select(*one, "v", "c").join(found.where("low <> high AND last").select(*one, "n", "want"), one)
        values = values.withColumn("before", F.sum("c").over(Window.partitionBy(*one).orderBy("v")) - F.col("c"))  # at most ``few`` rows a key and share
        out = out.unionByName(found.where("low = high").select(*one, "n", F.col("low").alias("value")))
        out = out.unionByName(values.where("before <= want AND want < before + c").select(*one, "n", F.col("v").alias("value")))
        state = found.where("low <> high AND NOT last").select(*one, "n", "m", "want", "low", "high")
    return out.select("share", F.col("__k").alias(key), "n", "value")


def validation(rows: DataFrame, good: float = 0.85, bad: float = 0.55, gap: float = 0.30) -> DataFrame:
    """One row of (faithful, hallucinated, gap, passes) from scores of paired variants."""
    at = lambda v: F.avg(F.when(F.col("variant") == v, F.col("score")))
    out = rows.agg(at("faithful").alias("faithful"), at("hallucinated").alias("hallucinated")).withColumn("gap", F.col("faithful") - F.col("hallucinated"))
    return out.withColumn("passes", (F.col("faithful") >= good) & (F.col("hallucinated") <= bad) & (F.col("gap") >= gap))


def next_run_name(names: DataFrame, label: str) -> DataFrame:
    """The next ``rNN_label``, from the largest number among names."""
    number = F.regexp_extract("run", r"^r(\d+)_", 1).try_cast("int")
    slug = "_".join("".join(c if c.isalnum() else " " for c in label.lower()).split())
    n = (F.coalesce(F.max(number), F.lit(0)) + 1).cast("string")
    return names.agg(F.concat(F.lit("r"), F.when(F.length(n) < 2, F.lpad(n, 2, "0")).otherwise(n), F.lit(f"_{slug}")).alias("name"))


def find_run(names: DataFrame, wanted: str) -> DataFrame:
    """(wanted, run, matches): the exact name, else the only one with the wanted end, else the only one that has it; null where none or several fit."""
    kind = F.when(F.col("run") == wanted, 1).when(F.col("run").endswith(wanted), 2).when(F.col("run").contains(wanted), 3)
    hits = names.select("run", kind.alias("kind")).where("kind IS NOT NULL")
    best = hits.groupBy("kind").agg(F.count("*").alias("matches"), F.min("run").alias("run"))
    out = best.agg(F.min_by(F.struct("run", "matches"), "kind").alias("b"))
    return out.select(F.lit(wanted).alias("wanted"), F.when(F.col("b.matches") == 1, F.col("b.run")).alias("run"), F.coalesce("b.matches", F.lit(0)).alias("matches"))


