"""A search of items by profiles in which what is alike is met once.

Items that no rule tells apart are of one kind, items with one text share its similarity,
and profiles that are equal in all that is compared are asked once; `expanded` gives the
answer to each of them.  Rows are alike when the compared values themselves are equal, so
the results are those of the whole product, and where no two are alike it costs no more.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property, reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.functions.text import item_text, profile_text
from rankloom.operators import ranking, similarity
from rankloom.store import written

ITEMS_A_TASK = 10_000  # to be normalised
PAIRS_A_TASK = 100_000  # of kinds with profiles
ROWS_A_TASK = 5_000_000  # of items with profiles that are only given out
SENT_ITEMS = 1_000_000  # ids beside the number of their kind


def grouped(rows: DataFrame, name: str, columns: list[str], *more: Column) -> tuple[DataFrame, DataFrame]:
    """(rows with the number `name` of their group, groups): rows equal in all columns are a group; missing equals missing.

    groups: the columns, the number, the count `n` and what more is aggregated.
    """
    groups = written(rows.groupBy(*columns).agg(F.count("*").alias("n"), *more).withColumn(name, F.monotonically_increasing_id()), name)
    named = groups.select(name, *[F.col(c).alias(f"_{c}") for c in columns])
    on = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in columns])
    return rows.join(named, on).drop(*[f"_{c}" for c in columns]), groups


def reached(profiles: DataFrame, items: DataFrame) -> DataFrame:
    """Prepared profiles with `_reached`, the greatest least GPA of any item that theirs reaches, and `_gpa_known`: GPAs between two steps fail alike."""
    steps = items.select("min_gpa").where("min_gpa is not null").distinct()
    gpas = profiles.select(F.col("p_gpa").alias("_gpa")).distinct()
    best = gpas.join(steps, F.col("min_gpa") <= F.col("_gpa"), "left").groupBy("_gpa").agg(F.max("min_gpa").alias("_reached"))
    return profiles.join(best, F.col("p_gpa").eqNullSafe(F.col("_gpa"))).withColumn("_gpa_known", F.col("p_gpa").isNotNull()).drop("_gpa")


@dataclass(frozen=True)
class Search:
    """Prepared items (with text) and profiles (with p_text); each table is made when it is first asked for."""

    prepared: DataFrame
    profiles: DataFrame
    n_items: int
    own_gpa: bool

    @cached_property
    def _kinds(self) -> tuple[DataFrame, DataFrame]:
        return grouped(self.prepared, "kind", list(ranking.RULED))

    @cached_property
    def _asked(self) -> tuple[DataFrame, DataFrame]:
        gpa = ["p_gpa"] if self.own_gpa else ["_reached", "_gpa_known"]
        rows = self.profiles if self.own_gpa else reached(self.profiles, self.prepared)
        return grouped(rows, "asked", [*ranking.ASKED, "p_text", *gpa], *([] if self.own_gpa else [F.min("p_gpa").alias("p_gpa")]))

    @property
    def ruled(self) -> DataFrame:
        """Items with their kind."""
        return self._kinds[0]

    @property
    def kinds(self) -> DataFrame:
        return self._kinds[1]

    @property
    def asked(self) -> DataFrame:
        """Profiles that stand for those alike; profile_id is a number, `n` how many they are."""
        return self._asked[1].withColumnRenamed("asked", "profile_id").drop("_reached", "_gpa_known")

    @cached_property
    def members(self) -> DataFrame:
        """(profile_id, asked): who stands for each profile."""
        return written(self._asked[0].select("profile_id", "asked"), "members")

    @cached_property
    def _texts(self) -> tuple[DataFrame, DataFrame]:
        return grouped(self.ruled, "text_id", ["text"])

    @cached_property
    def items(self) -> DataFrame:
        """Items with kind and text_id."""
        return written(self._texts[0].drop("text"), "items")

    @cached_property
    def n_asked(self) -> int:
        return self.asked.count()

    def sent(self, by_profile: DataFrame) -> DataFrame:
        """A table with a row for each asked profile, broadcast up to SENT_PROFILES."""
        return F.broadcast(by_profile) if self.n_asked <= ranking.SENT_PROFILES else by_profile

    def kind_pairs(self) -> DataFrame:
        """Every kind with every asked profile; `n` is how many pairs of items and profiles that are."""
        tasks = -(-self.kinds.count() * self.n_asked // PAIRS_A_TASK)
        kinds = self.kinds.select("kind", *ranking.RULED, F.col("n").alias("_items")).repartition(max(1, min(tasks, 10_000)))
        return kinds.crossJoin(self.sent(self.asked.withColumnRenamed("n", "_profiles"))).withColumn("n", F.col("_items") * F.col("_profiles"))

    @cached_property
    def eligible(self) -> DataFrame:
        """(profile_id, kind) of asked profiles and the kinds that they are eligible for."""
        return written(self.kind_pairs().where(ranking.eligible()).select("profile_id", "kind"), "eligible")

    @cached_property
    def similarity(self) -> DataFrame:
        """(profile_id, text_id, text_sim) of asked profiles and the texts among their eligible items."""
        held = self.items.groupBy("kind", "text_id").agg(F.count("*").alias("n"))
        return written(similarity.tfidf_texts(self.eligible, held, self._texts[1], self.asked.select("profile_id", F.col("p_text").alias("text"))), "similarity")

    def frames(self, items: DataFrame | None = None) -> DataFrame:
        """Least and greatest values of each asked profile's items, as `ranking.with_frame` adds them, from those of the kinds."""
        own = self.items if items is None else items
        by_kind = own.groupBy("kind").agg(*ranking.frame_ends(own.columns))
        ends = [(F.min if c.endswith("_low") else F.max)(c).alias(c) for c in by_kind.columns if c != "kind"]
        return written(self.eligible.join(by_kind, "kind").groupBy("profile_id").agg(*ends), "frames")

    def similarities(self, items: DataFrame | None = None) -> DataFrame:
        """(profile_id, item_id, text_sim) of asked profiles with their eligible items, beside the columns of `items` if given."""
        own = self.items.select("item_id", "kind", "text_id") if items is None else items
        met = self.eligible.join(own, "kind").join(self.similarity, ["profile_id", "text_id"], "left")
        return met.withColumn("text_sim", F.coalesce("text_sim", F.lit(0.0))).drop("kind", "text_id")

    def pairs(self, items: DataFrame | None = None) -> DataFrame:
        """Every item with every asked profile that is eligible for it, with text_sim and the columns of both."""
        rows = self.similarities(self.items if items is None else items).join(self.sent(self.asked.drop("n", "p_text")), "profile_id")
        return rows.withColumn("reasons", F.array().cast("array<string>"))

    def expanded(self, rows: DataFrame) -> DataFrame:
        """rows of asked profiles for each profile that is like them, under its own profile_id."""
        out = rows.withColumnRenamed("profile_id", "_asked").join(self.members.select(F.col("asked").alias("_asked"), "profile_id"), "_asked")
        return out.select(*rows.columns)

    def verdicts(self, *columns: Column) -> DataFrame:
        """profile_id, item_id and the columns of every profile with every item; columns of what the rules compare, found once for a kind and an asked profile."""
        found = self.expanded(self.kind_pairs().select("profile_id", "kind", *columns))
        tasks = -(-self.n_items * self.members.count() // ROWS_A_TASK)
        few = self.ruled.select("item_id", "kind")
        rows = found.repartition(max(1, min(tasks, 100_000))).join(F.broadcast(few) if self.n_items <= SENT_ITEMS else few, "kind")
        return rows.select("item_id", *[c for c in found.columns if c != "kind"])


def search(items: DataFrame, profiles: DataFrame, own_gpa: bool = False) -> Search:
    """The search of items by profiles; with own_gpa, profiles that differ in their GPA are asked apart, also where no rule tells them apart."""
    n = items.count()
    dealt = items.repartition(max(1, min(-(-n // ITEMS_A_TASK), 1_000)))
    named = ranking.prepared_profiles(profiles.withColumn("text", profile_text()))
    return Search(ranking.prepared_items(dealt).withColumn("text", item_text()), named, n, own_gpa)
