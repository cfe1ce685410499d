"""Offline metrics, weight grids, blended and Pareto selection."""

from __future__ import annotations

from collections.abc import Callable
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankloom.operators import ranking
from rankloom.operators.quantiles import quantile
from rankloom.operators.skyline import CHUNK_ROWS, chunks, skyband
from rankloom.store import written

EPSILON = 1e-9
SENT_CONFIGS = 10_000

# The grid of weights.
GRID = {
    "text": (0.70, 0.80, 0.85, 0.90),
    "amount": (0.05, 0.10, 0.20),
    "keyword": (0.05, 0.10, 0.15),
    "effort": (0.05, 0.10, 0.15),
    "score": (0.80, 0.85, 0.90, 0.95),
    "urgency": (0.05, 0.10, 0.15),
    "ev": (0.00, 0.05, 0.10),
}
BASELINE = (0.70, 0.20, 0.10, 0.10, 0.80, 0.15, 0.05)


def eligibility_precision(pairs: DataFrame, count: str | None = None) -> DataFrame:
    """One row; with `count`, a row stands for so many pairs."""
    n = F.col(count) if count else F.lit(1).cast("long")
    total = lambda x: F.coalesce(F.sum(x), F.lit(0).cast("long"))
    return pairs.agg(total(n).alias("n_pairs"), total(F.when(F.size("reasons") == 0, n)).alias("n_eligible")).withColumn("precision", F.coalesce(F.try_divide("n_eligible", "n_pairs"), F.lit(0.0)))


def reason_counts(pairs: DataFrame, count: str | None = None) -> DataFrame:
    """Pairs by reason; with `count`, a row stands for so many pairs."""
    n = F.col(count) if count else F.lit(1).cast("long")
    return pairs.groupBy("reasons").agg(F.sum(n).alias("n")).select(F.explode("reasons").alias("reason"), "n").groupBy("reason").agg(F.sum("n").alias("n"))


def coverage(top: DataFrame, *by: str) -> DataFrame:
    """Distinct recommended ids over recommended slots."""
    return top.groupBy(*by).agg((F.count_distinct(F.when(F.trim("item_id") != "", F.col("item_id"))) / F.count("*")).alias("coverage"))


def amount_stats(top: DataFrame) -> DataFrame:
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return top.agg(F.count("amount_max").alias("n"), zero(F.round(F.avg("amount_max"), 6)).alias("mean"), zero(F.median("amount_max")).alias("median"), zero(F.max("amount_max")).alias("max"))


def ndcg(labelled: DataFrame, *by: str, label: str = "relevance", rank: str = "place") -> DataFrame:
    """NDCG of each list; the ideal order is that of the list's own labels; 0 where nothing is relevant."""
    w = Window.partitionBy(*by).orderBy(F.col(label).desc(), F.col(rank))
    gain = F.pow(F.lit(2.0), F.greatest(F.col(label), F.lit(0)).cast("double")) - 1
    rows = labelled.withColumn("_ideal", F.row_number().over(w))
    sums = rows.groupBy(*by).agg(F.sum(gain / F.log2(F.col(rank) + 1.0)).alias("dcg"), F.sum(gain / F.log2(F.col("_ideal") + 1.0)).alias("idcg"))
    return sums.select(*by, F.when(F.col("idcg") > 0, F.round(F.col("dcg") / F.col("idcg"), 9)).otherwise(0.0).alias("ndcg"))


def same_rankings(a: DataFrame, b: DataFrame) -> DataFrame:
    """(profile_id, same): whether both runs give a profile the same ordered ids."""
    ordered = lambda d, name: d.groupBy("profile_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "item_id"))), lambda x: x["item_id"]).alias(name))
    return ordered(a, "x").join(ordered(b, "y"), "profile_id", "full_outer").select("profile_id", F.col("x").eqNullSafe(F.col("y")).alias("same"))


def threshold(scored: DataFrame, target_share: float = 0.25, expanded: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Median over profiles of the exact upper quantile of text_sim where no keyword overlaps.

    `expanded` gives the quantiles of profiles that stand for others to each of those.
    """
    quiet = scored.where(F.coalesce("keyword_overlap", F.lit(0.0)) <= 0).select("profile_id", "text_sim")
    each = quantile(quiet, ["profile_id"], "text_sim", 1 - target_share)
    each = expanded(each) if expanded else each
    return quantile(each.withColumn("_all", F.lit(1)), ["_all"], "q", 0.5).agg(F.round(F.max("q"), 9).alias("threshold"))


def config_id(mode: str = "log") -> Column:
    cols = [F.col(c) for c in ("text", "amount", "keyword", "effort", "score", "urgency", "ev")]
    return F.format_string(f"s2_t%.2f_a%.2f_k%.2f_e%.2f__s3_s%.2f_u%.2f_v%.2f__{mode}", *cols)


def grid(spark: SparkSession, most: int = 200) -> DataFrame:
    """(ordinal, config_id, weights): the baseline, then the grid in nested order, without repeats, up to `most`."""
    if most < 1:
        raise ValueError("most must be at least 1")
    rows = [BASELINE]
    for row in product(*GRID.values()):
        if abs(sum(row[4:]) - 1) <= 1e-6 and row != BASELINE:
            rows.append(row)
    rows = [(i, *r) for i, r in enumerate(rows[:most])]
    schema = "ordinal int, " + ", ".join(f"{c} double" for c in GRID)
    return spark.createDataFrame(rows, schema).withColumn("config_id", config_id())


def rescored(components: DataFrame, configs: DataFrame, n_configs: int, value: str = "ev_norm") -> DataFrame:
    """Every (config, profile, item) with its final score, from components that are there."""
    named = configs.select("config_id", *[F.col(c).alias(f"w_{c}") for c in GRID])
    return final_scores(components.crossJoin(F.broadcast(named) if n_configs <= SENT_CONFIGS else named), value)


def final_scores(both: DataFrame, value: str = "ev_norm") -> DataFrame:
    """both (components beside the weights w_ of a configuration) with the final score."""
    c = F.col
    stage = c("w_text") * c("text_sim") + c("w_amount") * c("amount_utility") + c("w_keyword") * c("keyword_overlap") - c("w_effort") * c("effort_penalty")
    stage = F.least(F.greatest(stage, F.lit(0.0)), F.lit(1.0))
    return both.withColumn("final_score", c("w_score") * stage + c("w_urgency") * c("urgency") + c("w_ev") * c(value))


MEASURES = ("text_sim", "amount_utility", "keyword_overlap", "_ease", "urgency")
CARRIED = ("item_id", "deadline", "relevance", "amount_max", "sponsor", "source")
NEAR = 1e-9  # of final scores, which are compared to 10 places


def contenders(components: DataFrame, k: int = 10, value: str = "ev_norm") -> DataFrame:
    """The rows that can stand among the k best of their profile under any weights.

    Every score rises with the components and falls with the effort, so a row that k others
    equal or surpass in all of them, and precede in the order among equal scores (also where
    clipping makes scores equal), stands in no list of k.
    """
    rows = components.withColumn("_ease", -F.col("effort_penalty"))
    return skyband(rows, ["profile_id"], [*MEASURES, value], k, ties=[("deadline", "ascending"), ("item_id", "ascending")]).drop("_ease")


def shortlisted(components: DataFrame, configs: DataFrame, k: int = 10, value: str = "ev_norm") -> DataFrame:
    """Rows of components beside the `config_id` of every configuration under which they can be among the k best of their profile.

    Tasks weigh their rows of a profile under all configurations as arrays and give out
    those that come within `NEAR` of the k-th best there; the exact score and order are for
    what they give out.
    """
    names = [*GRID]
    given = configs.select("config_id", *names).orderBy("config_id").collect()  # a grid: SENT_CONFIGS at most
    if len(given) > SENT_CONFIGS:
        raise ValueError(f"at most {SENT_CONFIGS} configurations")
    ids, weights = [r.config_id for r in given], [tuple(r[n] for n in names) for r in given]
    measures = ("text_sim", "amount_utility", "keyword_overlap", "effort_penalty", "urgency", value)

    def run(batches):
        for table in chunks(batches, ["profile_id"]):
            for lo in range(0, table.num_rows, CHUNK_ROWS):
                part = table.slice(lo, CHUNK_ROWS).combine_chunks()
                x, y, z, e, u, v = (np.nan_to_num(part.column(c).to_numpy(zero_copy_only=False).astype(float), nan=0.0) for c in measures)
                rows, which = [], []
                for c, (text, amount, keyword, effort, w_s, w_u, w_v) in enumerate(weights):
                    score = w_s * np.clip(text * x + amount * y + keyword * z - effort * e, 0.0, 1.0) + w_u * u + w_v * v
                    least = np.partition(score, len(score) - k)[len(score) - k] if len(score) > k else -np.inf
                    hit = np.flatnonzero(score >= least - NEAR)
                    rows.append(hit)
                    which.append(np.full(len(hit), c))
                got = part.take(pa.array(np.concatenate(rows))).append_column("config_id", pa.array(ids).take(pa.array(np.concatenate(which))))
                yield from got.combine_chunks().to_batches(max_chunksize=10_000)

    schema = T.StructType([*components.schema.fields, T.StructField("config_id", T.StringType())])
    return components.repartition("profile_id").sortWithinPartitions("profile_id").mapInArrow(run, schema)


def config_lists(components: DataFrame, configs: DataFrame, k: int = 10, value: str = "ev_norm") -> DataFrame:
    """(config_id, profile_id, top): the k best of every configuration, in order."""
    named = configs.select("config_id", *[F.col(c).alias(f"w_{c}") for c in GRID])
    every = final_scores(shortlisted(components, configs, k, value).join(F.broadcast(named), "config_id"), value)  # SENT_CONFIGS rows at most
    placed = every.withColumn("place", ranking.place("config_id", "profile_id")).where(F.col("place") <= k)
    row = F.struct("place", *[c for c in (*CARRIED, value, "p_win", "expected_value") if c in components.columns])
    return placed.groupBy("config_id", "profile_id").agg(F.array_sort(F.collect_list(row)).alias("top"))  # k rows at most


def list_ndcg(top: Column) -> Column:
    """NDCG of one list of rows in order with `relevance`."""
    gain = lambda r: F.pow(F.lit(2.0), F.greatest(r, F.lit(0)).cast("double")) - 1
    total = lambda labels: F.aggregate(F.transform(labels, lambda r, i: gain(r) / F.log2(i + 2.0)), F.lit(0.0), lambda a, x: a + x)
    labels = F.transform(top, lambda t: t["relevance"])
    ideal = total(F.reverse(F.array_sort(labels)))
    return F.when(ideal > 0, F.round(total(labels) / ideal, 9)).otherwise(0.0)


def list_median(values: Column) -> Column:
    """The median of an array without its nulls."""
    v = F.array_sort(F.filter(values, lambda x: x.isNotNull()))
    half = F.floor((F.size(v) - 1) / 2).cast("int"), F.ceil((F.size(v) - 1) / 2).cast("int")
    return F.when(F.size(v) > 0, (F.get(v, half[0]) + F.get(v, half[1])) / 2)


def tuned(components: DataFrame, configs: DataFrame, eligibility_rate: float | None = None, k: int = 10, value: str = "ev_norm", expanded: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """One row of metrics for every configuration, from one row a (profile, item) pair with all that a configuration weighs.

    Lists are cut twice from separate plans; `stable` says whether every list came out the
    same.  Values of a win model are averaged per list and then over the lists that have
    them.  `expanded` gives the lists of profiles that stand for others to each of those.
    """
    first = written(config_lists(components, configs, k, value), "lists")
    ids = lambda top: F.transform(top, lambda t: t["item_id"])
    again = config_lists(components.repartition(3), configs, k, value).select("config_id", "profile_id", ids(F.col("top")).alias("_again"))
    same = first.join(again, ["config_id", "profile_id"], "full_outer").groupBy("config_id").agg(F.bool_and(ids(F.col("top")).eqNullSafe(F.col("_again"))).alias("stable"))
    text = lambda c: F.nullif(F.trim(c), F.lit("")) if c in components.columns else F.lit(None).cast("string")
    share = lambda c: F.coalesce(F.try_divide(F.count_distinct(c), F.count(c)), F.lit(0.0))
    lists = [list_ndcg(F.col("top")).alias("_ndcg")]
    won = "p_win" in components.columns
    if won:
        of = lambda c: F.transform(F.col("top"), lambda t: t[c])
        mean = lambda v: F.try_divide(F.aggregate(F.filter(v, lambda x: x.isNotNull()), F.lit(0.0), lambda a, x: a + x), F.size(F.filter(v, lambda x: x.isNotNull())))
        lists += [f(of(c)).alias(f"_{n}_{c}") for c in ("p_win", "expected_value", value) for n, f in (("avg", mean), ("median", list_median))]
    # List values stand beside the first row of each list only, so that one grouping gives all metrics.
    each = first.select("config_id", "profile_id", "top", *lists)
    each = expanded(each) if expanded else each
    rows = each.select("config_id", *[c for c in each.columns if c.startswith("_")], F.explode("top").alias("t"))
    head = F.col("t.place") == 1
    rows = rows.select("config_id", *[F.when(head, F.col(c)).alias(c) for c in rows.columns if c.startswith("_")], "t.*")
    metrics = [
        F.round(F.avg("_ndcg"), 8).alias("ndcg"),
        (F.count_distinct(F.when(F.trim("item_id") != "", F.col("item_id"))) / F.count("*")).alias("coverage"),
        F.round(F.avg(value), 8).alias("ev"),
        share(text("sponsor")).alias("sponsor_diversity"),
        share(text("source")).alias("source_diversity"),
        F.count("amount_max").alias("n_amounts"),
        F.coalesce(F.round(F.avg("amount_max"), 6), F.lit(0.0)).alias("amount_mean"),
        F.coalesce(F.max("amount_max"), F.lit(0.0)).alias("amount_most"),
    ]
    if won:
        metrics += [F.round(F.avg(f"_{n}_{c}"), 9).alias(f"{n}_{c}") for c in ("p_win", "expected_value", value) for n in ("avg", "median")]
    middle = quantile(rows.select("config_id", "amount_max"), ["config_id"], "amount_max", 0.5).select("config_id", F.col("q").alias("amount_median"))
    out = rows.groupBy("config_id").agg(*metrics).join(middle, "config_id", "left").join(same, "config_id")
    return written(out.withColumns({"amount_median": F.coalesce("amount_median", F.lit(0.0)), "eligibility_rate": F.lit(eligibility_rate).cast("double")}), "tuned")


# What metrics may be called.
METRIC_NAMES = {"ndcg": "ndcg", "coverage": "coverage", "ev": "ev", "expected_value": "ev", "expected_value_norm": "ev"}


def metric_name(said: str) -> str:
    """The metric that a name means, in any case, with or without @k."""
    bare = said.strip().lower().removesuffix("@k").removesuffix("_at_k")
    if bare not in METRIC_NAMES:
        raise ValueError(f"unknown metric {said!r}; there are {', '.join(sorted(set(METRIC_NAMES.values())))}")
    return METRIC_NAMES[bare]


def objective_weights(said: str, with_win_model: bool, strict: bool = True) -> dict[str, float] | None:
    """Weights out of "ndcg=0.7,coverage=0.2,ev=0.1"; they sum to one.

    A weight of the expected value needs a win model: an error without one, or if not strict None.
    """
    given = [p.partition("=") for p in said.split(",") if p.strip()]
    if not given:
        raise ValueError("no objective weights are given")
    out = dict.fromkeys(("ndcg", "coverage", "ev"), 0.0)
    for name, sign, number in given:
        if not sign:
            raise ValueError(f"objective weights are name=number, not {name!r}")
        out[metric_name(name)] = float(number)
    if not abs(sum(out.values()) - 1) <= 1e-6:
        raise ValueError(f"objective weights must sum to 1, not {sum(out.values())}")
    if out["ev"] > 0 and not with_win_model:
        if strict:
            raise ValueError("a weight of ev needs a win model")
        return None
    return out


def pareto_metrics(said: str, with_win_model: bool) -> list[str]:
    """Different metrics in the order named; ev only with a win model."""
    named = [metric_name(n) for n in said.split(",")] if said.strip() else []
    out = [m for m in dict.fromkeys(named) if m != "ev" or with_win_model]
    if not out:
        raise ValueError("no metric is left for the Pareto front")
    return out


def blended(results: DataFrame, weights: dict[str, float]) -> DataFrame:
    """results with `blended`, the weighted sum of metrics; weights must sum to one."""
    if abs(sum(weights.values()) - 1) > 1e-6:
        raise ValueError("objective weights must sum to 1")
    return results.withColumn("blended", F.round(sum((w * F.coalesce(F.col(m), F.lit(0.0)) for m, w in weights.items()), F.lit(0.0)), 9))


def pareto_front(results: DataFrame, metrics: list[str]) -> DataFrame:
    """Rows that no other row dominates: at least as good on all metrics and better on one, each within EPSILON.

    Metrics without a value count 0.
    """
    named = [f"_m{i}" for i in range(len(metrics))]
    rows = results.withColumns({n: F.coalesce(F.col(m).cast("double"), F.lit(0.0)) for n, m in zip(named, metrics)})
    return skyband(rows, [], named, margin=EPSILON).drop(*named)


def knee(front: DataFrame, metrics: list[str], key: str = "config_id") -> DataFrame:
    """front with knee_score, the length of its min-max scaled metrics (a flat metric counts 1), best first."""
    ends = front.agg(*[f(m).alias(f"_{n}_{m}") for m in metrics for n, f in (("low", F.min), ("high", F.max))])  # one row
    scaled = []
    for m in metrics:
        low, high = F.col(f"_low_{m}"), F.col(f"_high_{m}")
        scaled.append(F.when(high - low > EPSILON, (F.col(m) - low) / (high - low)).otherwise(1.0))
    return front.crossJoin(F.broadcast(ends)).withColumn("knee_score", F.round(F.sqrt(sum((s * s for s in scaled), F.lit(0.0))), 9)).orderBy(F.desc("knee_score"), *[F.desc(m) for m in metrics], key).drop(*ends.columns)


def expected_value_metrics(top: DataFrame) -> DataFrame:
    """Per profile the mean and median of p_win and expected value over its list, and the mean scaled value."""
    each = lambda f, c, name: F.round(f(c), 9).alias(name)
    return top.groupBy("profile_id").agg(
        each(F.avg, "p_win", "avg_p_win"),
        each(F.median, "p_win", "median_p_win"),
        each(F.avg, "expected_value", "avg_expected_value"),
        each(F.median, "expected_value", "median_expected_value"),
        each(F.avg, "expected_value_norm", "avg_expected_value_norm"),
    )


def macro_average(by_profile: DataFrame) -> DataFrame:
    """One row: the mean of each metric over profiles that have it."""
    return by_profile.agg(*[F.round(F.avg(c), 9).alias(c) for c in by_profile.columns if c != "profile_id"])


def amount_penalty(median: Column, baseline_median: float) -> Column:
    """How far a median amount lies above one and a half times the baseline's; 0 without a baseline."""
    return F.greatest(median - 1.5 * baseline_median, F.lit(0.0)) if baseline_median > 0 else F.lit(0.0)


def relevance_order(baseline_median: float) -> list[Column]:
    """Stable first, then ndcg, coverage and sponsor diversity down, amount penalty up, id up."""
    return [F.desc("stable"), F.desc("ndcg"), F.desc("coverage"), F.desc("sponsor_diversity"), amount_penalty(F.col("amount_median"), baseline_median).asc(), F.col("config_id").asc()]


def by_relevance(results: DataFrame, baseline_median: float) -> DataFrame:
    return results.orderBy(*relevance_order(baseline_median))


def by_blend(results: DataFrame) -> DataFrame:
    return results.orderBy(F.desc("blended"), F.desc("ndcg"), F.desc("coverage"), F.desc("ev"), "config_id")
