"""Expert search (C12, C13): combined score, skill filter, top 25, renamed.

Plan: the skill predicate is applied to the skill-score side before the join
(one tag's rows), the join is on UserId, and the top 25 is a
``TakeOrderedAndProject`` (each partition keeps its 25 best).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import EXPERTISE_WEIGHT, SEARCH_RENAMES, SEARCH_SIZE, SKILL_WEIGHT

SEARCH_COLUMNS = ["DisplayName", "ExpertiseScore", "SkillScore", "CombinedScore", "PerformanceTier", "NumOrgs",
                  "KernelsCreated", "NumFollowers", "TotalComp", "TotalDisc", "TotalScript", "TotalMedals", "Ranked"]
INT_COLUMNS = SEARCH_COLUMNS[4:]


def users_and_skills(scored_users: DataFrame, skill_scores: DataFrame, skill: str | None = None,
                     every: bool = False) -> DataFrame:
    """Users with their skill scores and
    CombinedScore = 0.25 * ExpertiseScore + 0.75 * SkillScore.

    With ``skill`` only that tag's rows are joined (F10: the argument is
    lowercased, the column is compared as is); with ``every`` the rows of all
    tags, without the users who have none."""
    skills = skill_scores
    if skill is not None:
        skills = skills.filter(F.col("Name") == skill.lower())
    joined = scored_users.join(skills, "UserId", "inner" if skill is not None or every else "left")
    score_cols = ["CompScore", "KernelScore", "DiscScore", "SkillScore"]
    joined = joined.fillna(0, subset=[c for c in score_cols if c in joined.columns])
    return joined.withColumn("CombinedScore", F.col("ExpertiseScore") * EXPERTISE_WEIGHT
                             + F.col("SkillScore") * SKILL_WEIGHT)


def expertise_finding(scored_users: DataFrame, skill_scores: DataFrame, skill: str,
                      size: int = SEARCH_SIZE) -> DataFrame:
    """The ``size`` best users for ``skill`` by CombinedScore, 13 renamed
    columns with counts as integers and a 1-based ``Rank``."""
    uas = users_and_skills(scored_users, skill_scores, skill)
    top = uas.orderBy(F.col("CombinedScore").desc(), F.col("UserId").asc()).limit(size)
    ranked = top.withColumn("Rank", F.row_number().over(
        Window.orderBy(F.col("CombinedScore").desc(), F.col("UserId").asc())))
    renames = dict(SEARCH_RENAMES)
    renames["SkillScore"] = f"{skill.title()} Score"
    cols = [F.col("Rank")]
    for c in SEARCH_COLUMNS:
        col = F.col(c).cast("int") if c in INT_COLUMNS else F.col(c)
        cols.append(col.alias(renames.get(c, c)))
    return ranked.select(*cols)


def list_skills(tags: DataFrame) -> DataFrame:
    """The skill names."""
    return tags.select("Name")
