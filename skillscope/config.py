"""Settings of the expertise pipeline.

Fixed values that must equal the reference's settings for the same results
are grouped here, stated plainly:

- active performance tiers: 1, 2, 3, 4, 5 (tier 0 is inactive)
- expert rule: competition percentile > 0, or script percentile >= 0, or
  discussion percentile >= 0; tier > 1; followers >= 5; at least 2 medals in
  some type; at least 3 kernels; at least 3 medals overall
- non-expert rule: no percentile in any type; tier = 1; followers < 5; at most
  1 medal per type; fewer than 2 kernels; user kernel score <= 0.25
- model features: NumFollowers, TotalMedals, KernelsCreated, KernelScore, Ranked
- combined score = 0.25 * ExpertiseScore + 0.75 * SkillScore
- search result size: 25; skill-score preview size: 10
- the medal code given to teams without a medal: 4
- logistic regression: C = 1 (L2), so regParam = 1 / (C * n_train)
"""

from __future__ import annotations

from dataclasses import dataclass

# ---- fixed values (reference settings) -------------------------------------
ACTIVE_TIERS = (1, 2, 3, 4, 5)
EXPERTISE_WEIGHT = 0.25
SKILL_WEIGHT = 0.75
SEARCH_SIZE = 25
TOP_SKILLS_SIZE = 10
NO_MEDAL_CODE = 4
LOGISTIC_C = 1.0
HOLDOUT_FRACTION = 0.2
DOWNSAMPLE_FRACTION = 0.2

# Presentation names of the search result (the reference's rename map; the
# followers key is spelled correctly here, see SURVEY Q10).
SEARCH_RENAMES = {
    "DisplayName": "Name",
    "ExpertiseScore": "Expertise Score",
    "CombinedScore": "Combined Score",
    "PerformanceTier": "Performance Tier",
    "NumOrgs": "# of Orgs",
    "KernelsCreated": "# of Kernels Created",
    "NumFollowers": "# of Followers",
    "TotalComp": "# of Competition Medals",
    "TotalDisc": "# of Discussion Medals",
    "TotalScript": "# of Script Medals",
    "TotalMedals": "# of Total Medals",
}

# Fixed coefficients for the SQL-checkable linear score (M14).  They are this
# project's own choice, used where a score must be reproducible without
# fitting (oracle checks); the fitted model has queries of its own.
FIXED_INTERCEPT = -3.0
FIXED_WEIGHTS = (0.2, 0.15, 0.1, 2.0, 1.0)


@dataclass(frozen=True)
class ExpertRule:
    comp_pct_gt: float = 0.0
    script_pct_ge: float = 0.0
    disc_pct_ge: float = 0.0
    tier_gt: int = 1
    followers_ge: int = 5
    type_medals_ge: int = 2
    kernels_ge: int = 3
    total_medals_ge: int = 3


@dataclass(frozen=True)
class NonExpertRule:
    tier_eq: int = 1
    followers_lt: int = 5
    type_medals_le: int = 1
    kernels_lt: int = 2
    kernel_score_le: float = 0.25
