"""Eligibility, scoring, reranking and top-K, set-at-a-time over (profile, item) pairs.

Pairs come from a cross join of items with profiles, which is the operation itself;
profiles are broadcast only up to `SENT_PROFILES`, and larger tables are left to Spark.
Frame-relative values (greatest amount, spread of expected value) are aggregates of a
profile's eligible items, added up in the tasks that hold them and joined back, so no
task needs a whole frame; give `score` a written table, since it is read twice.  The K
best are cut before the rows of a profile come together.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass
from math import isclose, isfinite

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom.functions.text import list_tokens, norm_list, norm_text, tokens

SENT_PROFILES = 50_000


def _checked(values: dict[str, float]) -> None:
    for name, v in values.items():
        if not isfinite(v) or not 0 <= v <= 1:
            raise ValueError(f"{name} must be finite and within [0, 1], not {v}")


@dataclass(frozen=True)
class ScoreWeights:
    text: float = 0.70
    amount: float = 0.20
    keyword: float = 0.10
    effort: float = 0.10

    def __post_init__(self):
        _checked(asdict(self))


@dataclass(frozen=True)
class RankWeights:
    score: float = 0.80
    urgency: float = 0.15
    ev: float = 0.05

    def __post_init__(self):
        _checked(asdict(self))
        if not isclose(self.score + self.urgency + self.ev, 1.0, abs_tol=1e-6):
            raise ValueError("score, urgency and ev must sum to 1")


def prepared_items(items: DataFrame) -> DataFrame:
    """items with what rules and scores compare, normalised once an item: n_states, n_majors, n_level, n_citizenship, n_has."""
    c = F.col
    return items.withColumns(
        {
            "n_states": norm_list(c("states_allowed")),
            "n_majors": norm_list(c("majors_allowed")),
            "n_level": norm_text(c("education_level")),
            "n_citizenship": norm_text(c("citizenship")),
            "n_has": F.array_distinct(F.concat(tokens(c("title")), list_tokens(c("keywords")))),
        }
    )


def prepared_profiles(profiles: DataFrame) -> DataFrame:
    """profiles with the prefix p_, and their side of the comparisons, normalised once a profile."""
    c = F.col
    named = profiles.select(*[c(x).alias(x if x == "profile_id" else f"p_{x}") for x in profiles.columns])
    return named.withColumns(
        {
            "p_n_state": norm_text(c("p_state")),
            "p_n_major": norm_text(c("p_major")),
            "p_n_level": norm_text(c("p_education_level")),
            "p_n_citizenship": norm_text(c("p_citizenship")),
            "p_n_wanted": F.array_distinct(F.concat(list_tokens(c("p_keywords")), list_tokens(c("p_interests")))),
        }
    )


def pairs(items: DataFrame, profiles: DataFrame, n_profiles: int | None = None) -> DataFrame:
    """Every item with every profile; profile columns get the prefix p_."""
    named = prepared_profiles(profiles)
    n = profiles.count() if n_profiles is None else n_profiles
    return prepared_items(items).crossJoin(F.broadcast(named) if n <= SENT_PROFILES else named)


# What the rules compare of an item, and of a profile beside its GPA with what the scores compare.
RULED = ("n_states", "n_majors", "n_level", "n_citizenship", "min_gpa", "deadline")
ASKED = ("p_n_state", "p_n_major", "p_n_level", "p_n_citizenship", "p_n_wanted", "p_today")


def rules() -> dict[str, Column]:
    """Code and failing condition of each rule, in fixed order; a condition that is null does not fail."""
    c = F.col
    outside = lambda listed, own: (F.size(c(listed)) > 0) & ~F.array_contains(c(listed), c(own))
    unlike = lambda item, own: (c(item) != "") & (c(item) != c(own))
    return {
        "DEADLINE_PASSED": c("deadline") < c("p_today"),
        "GPA_BELOW_MIN": c("p_gpa") < c("min_gpa"),
        "STATE_NOT_ALLOWED": outside("n_states", "p_n_state"),
        "MAJOR_NOT_ALLOWED": outside("n_majors", "p_n_major"),
        "EDUCATION_LEVEL_MISMATCH": unlike("n_level", "p_n_level"),
        "CITIZENSHIP_MISMATCH": unlike("n_citizenship", "p_n_citizenship"),
    }


def reasons() -> Column:
    """Codes of all rules that the pair fails, in fixed order; empty when eligible."""
    return F.array_compact(F.array(*[F.when(failed, code) for code, failed in rules().items()]))


def eligible() -> Column:
    """Whether the pair fails no rule: the same as empty reasons, without making them."""
    out = F.lit(True)
    for failed in rules().values():
        out = out & ~F.coalesce(failed, F.lit(False))
    return out


def clip(x: Column) -> Column:
    return F.least(F.greatest(F.when(~F.isnan(x), x), F.lit(0.0)), F.lit(1.0))


def amount() -> Column:
    return F.coalesce("amount_max", "amount_min", F.lit(0.0))


def amount_utility(mode: str = "log", top: Column | None = None) -> Column:
    """An amount beside the greatest of its frame (of `with_frame` unless given)."""
    top = F.col("f_amount_high") if top is None else top
    if mode == "linear":
        return F.when(top > 0, clip(amount() / top)).otherwise(0.0)
    if mode == "log":
        return F.when(top > 0, clip(F.log1p(F.greatest(amount(), F.lit(0.0))) / F.log1p(top))).otherwise(0.0)
    raise ValueError(f"amount utility is linear or log, not {mode!r}")


def effort_cost() -> Column:
    return F.when(F.coalesce("essay_required", F.lit(False)), 1.5).otherwise(1.0)


# What is compared within a frame, and the prefix of its least and greatest value.
FRAME = {"amount": amount, "ev": lambda: amount() / effort_cost(), "won": lambda: F.col("p_win") * amount()}


def frame_ends(columns: list[str]) -> list[Column]:
    """Aggregates of rows with these columns: the least and greatest of all that is compared within a frame."""
    names = [n for n in FRAME if n != "won" or "p_win" in columns]
    return [f(FRAME[n]()).alias(f"f_{n}_{end}") for n in names for end, f in (("low", F.min), ("high", F.max))]


def with_frame(rows: DataFrame, frames: DataFrame | None = None) -> DataFrame:
    """rows with the least and greatest amount, expected-value proxy and (given p_win) expected value of their profile's rows.

    `frames`: these by profile_id, where they are known already.
    """
    bare = rows.drop(*[f"f_{n}_{end}" for n in FRAME for end in ("low", "high")])
    if frames is None:
        frames = bare.groupBy("profile_id").agg(*frame_ends(rows.columns))
    n_profiles = frames.count()
    return bare.join(F.broadcast(frames) if n_profiles <= SENT_PROFILES else frames, "profile_id")


def keyword_overlap() -> Column:
    wanted = F.col("p_n_wanted")
    return F.when(F.size(wanted) > 0, F.size(F.array_intersect(wanted, "n_has")) / F.size(wanted)).otherwise(0.0)


def effort_penalty() -> Column:
    return F.when(F.coalesce("essay_required", F.lit(False)), 1.0).otherwise(0.0)


SCORE_OUTPUTS = ("tfidf_sim", "embed_sim", "text_sim", "amount_utility", "keyword_overlap", "effort_penalty", "stage_score")


def score(eligible: DataFrame, weights: ScoreWeights = ScoreWeights(), mode: str = "log", frames: DataFrame | None = None) -> DataFrame:
    """Components and `score`; a column text_sim is used where there is one and is 0 otherwise.

    Other outputs of an earlier scoring are dropped; an empty frame gives the same columns.
    """
    sim = F.coalesce(F.col("text_sim"), F.lit(0.0)) if "text_sim" in eligible.columns else F.lit(0.0)
    framed = with_frame(eligible.drop(*[c for c in SCORE_OUTPUTS if c not in ("text_sim", "tfidf_sim", "embed_sim")]), frames)
    out = framed.withColumns({"text_sim": sim, "amount_utility": amount_utility(mode), "keyword_overlap": keyword_overlap(), "effort_penalty": effort_penalty()})
    total = weights.text * F.col("text_sim") + weights.amount * F.col("amount_utility") + weights.keyword * F.col("keyword_overlap") - weights.effort * F.col("effort_penalty")
    return out.withColumn("stage_score", clip(total)).withColumn("text_sim", clip(F.col("text_sim")))


def minmax(x: str, frame: str) -> Column:
    low, high = F.col(f"f_{frame}_low"), F.col(f"f_{frame}_high")
    return F.when(high > low, (F.col(x) - low) / (high - low)).otherwise(0.0)


def rerank(scored: DataFrame, weights: RankWeights = RankWeights()) -> DataFrame:
    """days_to_deadline, urgency, effort_cost, ev_proxy and its spread, final_score.

    A column p_win gives the win branch: expected value in place of the proxy.
    """
    days = F.datediff("deadline", "p_today").cast("double")
    framed = scored if f"f_{'won' if 'p_win' in scored.columns else 'ev'}_low" in scored.columns else with_frame(scored)
    out = framed.withColumns({"days_to_deadline": days, "effort_cost": effort_cost()})
    out = out.withColumn("urgency", F.when(F.col("days_to_deadline").isNotNull(), clip(F.exp(-F.greatest("days_to_deadline", F.lit(0.0)) / 30.0))).otherwise(0.0))
    out = out.withColumn("ev_proxy", amount() / F.col("effort_cost")).withColumn("ev_norm", minmax("ev_proxy", "ev"))
    signal = "ev_norm"
    if "p_win" in scored.columns:
        out = out.withColumn("expected_value", F.col("p_win") * amount()).withColumn("expected_value_norm", minmax("expected_value", "won"))
        signal = "expected_value_norm"
    final = weights.score * F.coalesce("stage_score", F.lit(0.0)) + weights.urgency * F.col("urgency") + weights.ev * F.col(signal)
    return out.withColumn("final_score", final)


def place(*key: str) -> Column:
    """Total order: final score (to 10 places) down, deadline up with missing last, id up."""
    w = Window.partitionBy(*key).orderBy(F.round("final_score", 10).desc(), F.col("deadline").asc_nulls_last(), F.col("item_id").asc())
    return F.row_number().over(w)


def top_k(ranked: DataFrame, k: int = 10) -> DataFrame:
    return ranked.withColumn("place", place("profile_id")).where(F.col("place") <= k)


def similarity_of(*names: str) -> Column:
    """The first of the similarities that is there, else 0."""
    return F.coalesce(*[F.col(n) for n in names], F.lit(0.0))


def relevance(mode: str = "hybrid", threshold: float = 0.12) -> Column:
    """2: strict match with keyword overlap; 1: overlap, or in hybrid mode similarity at the threshold; else 0."""
    if mode not in ("hybrid", "no_similarity"):
        raise ValueError(f"unknown label mode {mode!r}")
    c = F.col
    some = F.coalesce(c("keyword_overlap"), F.lit(0.0)) > 0
    strict = ~F.exists(reasons_of_match(), lambda ok: ~ok)
    near = some | (F.coalesce(c("text_sim"), F.lit(0.0)) >= threshold) if mode == "hybrid" else some
    return F.when(strict & some, 2).when(near, 1).otherwise(0)


def reasons_of_match() -> Column:
    """The three strict matches: major, state and education level; an empty restriction matches."""
    c = F.col
    return F.array(
        (F.size("n_majors") == 0) | F.array_contains("n_majors", c("p_n_major")),
        (F.size("n_states") == 0) | F.array_contains("n_states", c("p_n_state")),
        (c("n_level") == "") | (c("n_level") == c("p_n_level")),
    )


def pair_features(flag_source: str = "live") -> dict[str, Column]:
    """The 13 features of a pair for the win-probability model."""
    c = F.col
    gpa = F.least(F.greatest(F.coalesce("p_gpa", F.lit(0.0)), F.lit(0.0)), F.lit(4.0))
    least = F.greatest(F.coalesce("min_gpa", F.lit(0.0)), F.lit(0.0))
    days = F.datediff("deadline", "p_today").cast("double")
    money = F.greatest(amount(), F.lit(0.0))
    match = reasons_of_match()
    flag = lambda x: F.when(x, 1.0).otherwise(0.0)
    return {
        "gpa": gpa,
        "min_gpa": least,
        "gpa_above_min": F.greatest(gpa - least, F.lit(0.0)),
        "keyword_overlap": F.greatest(F.coalesce(c("keyword_overlap"), F.lit(0.0)), F.lit(0.0)),
        "text_sim": F.greatest(F.coalesce(c("text_sim"), F.lit(0.0)), F.lit(0.0)),
        "days_to_deadline": F.when(days.isNull(), 365.0).otherwise(F.least(F.greatest(days, F.lit(0.0)), F.lit(365.0))),
        "amount_value": money,
        "amount_log": F.log1p(money),
        "major_match": flag(F.get(match, 0)),
        "state_match": flag(F.get(match, 1)),
        "education_level_match": flag(F.get(match, 2)),
        "essay_required": flag(F.coalesce("essay_required", F.lit(False))),
        "source_flag": flag(norm_text(c("source")).contains(flag_source)),
    }


def explanations(most: int = 3, with_win_model: bool = False) -> Column:
    """Up to `most` labels of the strongest positive signals, strongest first; with a win model its expected value is the fifth signal."""
    # The labels in their order, the weight of "no essay", and the fallback.
    c = F.col
    labels = (
        "Strong match to your goals/keywords",
        "High award amount",
        "High direct keyword overlap",
        "Deadline soon, boosted for urgency",
        "Strong expected-value proxy",
        "Lower effort (no essay)",
    )
    value = c("expected_value_norm") if with_win_model else c("ev_norm")
    scores = (c("text_sim"), c("amount_utility"), c("keyword_overlap"), c("urgency"), value, F.when(F.coalesce("essay_required", F.lit(False)), 0.0).otherwise(0.4))
    signals = F.array(*[F.struct((-F.coalesce(x, F.lit(0.0))).alias("s"), F.lit(i).alias("i"), F.lit(label).alias("l")) for i, (x, label) in enumerate(zip(scores, labels))])
    best = F.transform(F.slice(F.array_sort(F.filter(signals, lambda x: x["s"] < 0)), 1, most), lambda x: x["l"])
    return F.when(F.size(best) > 0, best).otherwise(F.array(F.lit("Balanced profile fit after scoring")))


def amount_text() -> Column:
    low, high = F.col("amount_min"), F.col("amount_max")
    money = lambda x: F.concat(F.lit("$"), F.format_number(x, 0))
    return (
        F.when(low.isNull() & high.isNull(), "Unknown")
        .when(low.isNull(), F.concat(F.lit("Up to "), money(high)))
        .when(high.isNull(), F.concat(money(low), F.lit("+")))
        .when(low == high, money(low))
        .otherwise(F.concat(money(low), F.lit(" - "), money(high)))
    )
