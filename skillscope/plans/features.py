"""User-level expertise features.

Plan shape: every per-user statistic is aggregated *before* it meets the
user table (the reference joins first and aggregates the join), the nine
filter-and-self-join medal frames are one conditional aggregation, the three
per-user kernel means are one aggregation, and every global percentile uses
the exact distributed ranker instead of a single-partition window.  All joins
are on ``UserId``, so the user side keeps its hash partitioning through the
chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import ACTIVE_TIERS
from ..operators.ranking import RankSpec, percent_rank, rank_stored

TYPE_SUFFIX = {"Discussion": "Disc", "Competitions": "Comp", "Scripts": "Script"}
RANKING_COLUMN = {"Competitions": "CompetitionPerRanking", "Discussion": "DiscussionPerRanking",
                  "Scripts": "ScriptPerRanking"}


def active_users(users: DataFrame, tiers=ACTIVE_TIERS) -> DataFrame:
    """Drop inactive (tier 0) and unknown tiers."""
    return users.filter(F.col("PerformanceTier").isin(*tiers))


def _org_counts(orgs: DataFrame) -> DataFrame:
    return orgs.groupBy("UserId").agg(F.countDistinct("OrganizationId").alias("NumOrgs"))


def _follower_counts(followers: DataFrame) -> DataFrame:
    return followers.groupBy("UserId").agg(F.countDistinct("FollowingUserId").alias("NumFollowers"))


def _membership():
    return [F.coalesce("NumOrgs", F.lit(0)).alias("NumOrgs"),
            F.coalesce("NumFollowers", F.lit(0)).alias("NumFollowers")]


def membership_counts(active: DataFrame, orgs: DataFrame, followers: DataFrame) -> DataFrame:
    """Distinct organisations and follow edges per user (0 if none)."""
    return (active.select("UserId")
            .join(_org_counts(orgs), "UserId", "left")
            .join(_follower_counts(followers), "UserId", "left")
            .select("UserId", *_membership()))


def _medal_pivot(achievements: DataFrame) -> DataFrame:
    aggs = []
    for typ, sfx in TYPE_SUFFIX.items():
        is_t = F.col("AchievementType") == typ
        for medal in ("Gold", "Silver", "Bronze"):
            aggs.append(F.sum(F.when(is_t, F.col(f"Total{medal}"))).alias(f"Total{medal}{sfx}"))
        aggs.append(F.max(F.when(is_t, F.lit(1))).alias(f"_has{sfx}"))
    per_user = achievements.groupBy("UserId").agg(*aggs)
    cols = []
    for sfx in TYPE_SUFFIX.values():
        g, s, b = (F.col(f"Total{m}{sfx}") for m in ("Gold", "Silver", "Bronze"))
        has = F.col(f"_has{sfx}") == 1
        cols += [F.when(has, g).alias(f"TotalGold{sfx}"), F.when(has, s).alias(f"TotalSilver{sfx}"),
                 F.when(has, b).alias(f"TotalBronze{sfx}"), F.when(has, g + s + b).alias(f"Total{sfx}")]
    medals = per_user.select("UserId", *cols)
    return medals.withColumn("TotalMedals", F.col("TotalDisc") + F.col("TotalComp") + F.col("TotalScript"))


def medal_totals(active: DataFrame, achievements: DataFrame) -> DataFrame:
    """gold/silver/bronze per type as one pivoting
    aggregation; a type's columns are null when the user has no row of that
    type, and ``TotalMedals`` is null unless all three types exist (Q15)."""
    return active.select("UserId").join(_medal_pivot(achievements), "UserId", "left")


def _author_stats(kernels: DataFrame) -> DataFrame:
    return kernels.groupBy("UserId").agg(
        F.countDistinct("KernelId").alias("KernelsCreated"),
        F.avg("TotalViews").alias("KernelsAvgViews"),
        F.avg("TotalComments").alias("KernelsAvgComments"),
        F.avg("TotalVotes").alias("KernelsAvgVotes"),
    )


def _author():
    return [F.coalesce("KernelsCreated", F.lit(0)).alias("KernelsCreated"),
            *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("KernelsAvgViews", "KernelsAvgComments",
                                                             "KernelsAvgVotes")]]
_KERNEL_RANKS = [RankSpec("KernelsAvgViews", "KernelsViewsPerRanking"),
                 RankSpec("KernelsAvgComments", "KernelsCommentsPerRanking"),
                 RankSpec("KernelsAvgVotes", "KernelsVotesPerRanking")]
def _user_kernel_score():
    return ((F.col("KernelsViewsPerRanking") + F.col("KernelsCommentsPerRanking")
             + F.col("KernelsVotesPerRanking")) / 3).alias("UserKernelScore")


def kernel_features(active: DataFrame, kernels: DataFrame, rank=rank_stored) -> DataFrame:
    """Kernels authored, mean views/comments/votes
    (0 when none), their global percentiles and their mean ``UserKernelScore``."""
    base = active.select("UserId").join(_author_stats(kernels), "UserId", "left").select("UserId", *_author())
    out = rank(base, _KERNEL_RANKS)
    return out.select("UserId", "KernelsCreated", "KernelsViewsPerRanking", "KernelsCommentsPerRanking",
                      "KernelsVotesPerRanking", _user_kernel_score())


def ranking_percentiles(active: DataFrame, achievements: DataFrame) -> DataFrame:
    """Percentile of HighestRanking inside each achievement
    type over all users, ordered descending as coded (the largest value gets
    0), one column per type.  One partitioned ranking replaces three global
    windows."""
    return active.select("UserId").join(_ranking_pivot(achievements), "UserId", "left")


def _ranking_pivot(achievements: DataFrame) -> DataFrame:
    ranked = achievements.select("UserId", "AchievementType", "HighestRanking").filter(
        F.col("HighestRanking").isNotNull())
    pct = percent_rank(ranked, "HighestRanking", "_pct", descending=True, partition_by=["AchievementType"])
    return pct.groupBy("UserId").agg(
        *[F.max(F.when(F.col("AchievementType") == t, F.col("_pct"))).alias(c) for t, c in RANKING_COLUMN.items()])


FEATURE_COLUMNS = [
    "UserId", "UserName", "DisplayName", "PerformanceTier", "NumOrgs", "NumFollowers",
    "TotalGoldDisc", "TotalSilverDisc", "TotalBronzeDisc", "TotalDisc",
    "TotalGoldComp", "TotalSilverComp", "TotalBronzeComp", "TotalComp",
    "TotalGoldScript", "TotalSilverScript", "TotalBronzeScript", "TotalScript", "TotalMedals",
    "KernelsCreated", "KernelsViewsPerRanking", "KernelsCommentsPerRanking", "KernelsVotesPerRanking",
    "UserKernelScore", "CompetitionPerRanking", "DiscussionPerRanking", "ScriptPerRanking",
]


def user_features(c) -> DataFrame:
    """The user feature table over active users (one row per user).

    One chain of left joins of per-user aggregates onto the active users, all
    on UserId; the W1 ranks are taken on a narrow table before they join."""
    active = active_users(c.users())
    ach = c.user_achievements()
    out = (active
           .join(membership_counts(active, c.user_organizations(), c.user_followers()), "UserId", "left")
           .join(_medal_pivot(ach), "UserId", "left")
           .join(kernel_features(active, c.kernels()), "UserId", "left")
           .join(_ranking_pivot(ach), "UserId", "left"))
    return out.select(*FEATURE_COLUMNS)
