"""Expert / non-expert cohorts, labels, balancing, the unlabelled rest, and
train-time features (C7, C8)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import ExpertRule, NonExpertRule
from ..operators.sampling import downsample


def expert_filter(rule: ExpertRule = ExpertRule()):
    """F3 (three-valued: a null comparison excludes the user)."""
    c = F.col
    ranked = ((c("CompetitionPerRanking") > rule.comp_pct_gt) | (c("ScriptPerRanking") >= rule.script_pct_ge)
              | (c("DiscussionPerRanking") >= rule.disc_pct_ge))
    social = (c("PerformanceTier") > rule.tier_gt) & (c("NumFollowers") >= rule.followers_ge)
    medals = ((c("TotalDisc") >= rule.type_medals_ge) | (c("TotalComp") >= rule.type_medals_ge)
              | (c("TotalScript") >= rule.type_medals_ge))
    work = (c("KernelsCreated") >= rule.kernels_ge) & (c("TotalMedals") >= rule.total_medals_ge)
    return ranked & social & medals & work


def non_expert_filter(rule: NonExpertRule = NonExpertRule()):
    """F4."""
    c = F.col
    return (c("CompetitionPerRanking").isNull() & c("ScriptPerRanking").isNull() & c("DiscussionPerRanking").isNull()
            & (c("PerformanceTier") == rule.tier_eq) & (c("NumFollowers") < rule.followers_lt)
            & (c("TotalDisc") <= rule.type_medals_le) & (c("TotalComp") <= rule.type_medals_le)
            & (c("TotalScript") <= rule.type_medals_le) & (c("KernelsCreated") < rule.kernels_lt)
            & (c("UserKernelScore") <= rule.kernel_score_le))


def experts(features: DataFrame, rule: ExpertRule = ExpertRule()) -> DataFrame:
    return features.filter(expert_filter(rule)).withColumn("Expert", F.lit(1))


def non_experts(features: DataFrame, rule: NonExpertRule = NonExpertRule()) -> DataFrame:
    return features.filter(non_expert_filter(rule)).withColumn("Expert", F.lit(0))


def cohorts(features: DataFrame) -> dict:
    """Experts, non-experts, the balanced training set (U1) and the
    unlabelled rest (J12, left anti join).

    ``features`` is read by several branches; pass a materialised frame
    (``session.materialize``) so the feature plan runs once."""
    ex = experts(features)
    ne = non_experts(features)
    ne_down = downsample(ne, "UserId", ex)
    train = ex.unionByName(ne_down)
    unlabelled = features.join(train.select("UserId"), "UserId", "left_anti")
    return {"experts": ex, "non_experts": ne, "non_experts_downsampled": ne_down,
            "train": train, "unlabelled": unlabelled}


NUMERIC_FEATURES = [
    "NumOrgs", "NumFollowers", "TotalGoldDisc", "TotalSilverDisc", "TotalBronzeDisc", "TotalDisc",
    "TotalGoldComp", "TotalSilverComp", "TotalBronzeComp", "TotalComp", "TotalGoldScript", "TotalSilverScript",
    "TotalBronzeScript", "TotalScript", "TotalMedals", "KernelsCreated", "KernelsViewsPerRanking",
    "KernelsCommentsPerRanking", "KernelsVotesPerRanking", "UserKernelScore", "CompetitionPerRanking",
    "DiscussionPerRanking", "ScriptPerRanking",
]


def model_inputs(df: DataFrame) -> DataFrame:
    """Fill the numeric features with 0 (named columns
    only, Q26), average the three ranking percentiles, flag ``Ranked``."""
    filled = df.fillna(0, subset=[c for c in NUMERIC_FEATURES if c in df.columns])
    avg = (F.col("CompetitionPerRanking") + F.col("DiscussionPerRanking") + F.col("ScriptPerRanking")) / 3
    return (filled.withColumn("AvgPerRanking", avg)
            .withColumn("Ranked", F.when(F.col("AvgPerRanking") > 0, 1).otherwise(0)))


def population(parts: dict) -> DataFrame:
    """Of the frames of :func:`cohorts`, train (labelled) appended to the unlabelled users; the label stays
    null for the unlabelled (Q11).  Every active user appears once."""
    return parts["train"].unionByName(parts["unlabelled"], allowMissingColumns=True)
