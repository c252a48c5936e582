"""The plans run unchanged on the community's CSV exports."""

import os
import tempfile

from skillscope.plans import cohorts as co
from skillscope.plans import features as fe
from skillscope.plans import model as mo
from skillscope.plans import search as se
from skillscope.plans import skills as sk
from skillscope.session import materialize
from skillscope.sources.community_csv import CsvCommunity

TABLES = {
    "Users": ["Id,UserName,DisplayName,RegisterDate,PerformanceTier",
              "1,ann,Ann,2019-01-01,2", "2,bob,Bob,2019-01-01,3", "3,cy,Cy,2019-01-01,1",
              "4,di,Di,2019-01-01,1", "5,ed,Ed,2019-01-01,0", "6,flo,Flo,2019-01-01,4"],
    "UserOrganizations": ["Id,UserId,OrganizationId,JoinDate", "1,1,10,x", "2,1,11,x", "3,2,10,x"],
    "UserFollowers": ["Id,UserId,FollowingUserId,CreationDate"] + [f"{i},1,{100 + i},x" for i in range(6)]
                     + [f"{10 + i},2,{200 + i},x" for i in range(5)],
    "UserAchievements": ["Id,UserId,AchievementType,Tier,TierAchievementDate,Points,CurrentRanking,HighestRanking,"
                         "TotalGold,TotalSilver,TotalBronze"]
                        + [f"{u * 3 + k},{u},{t},1,x,0,,{r},{g},1,0"
                           for u, r, g in ((1, 5, 2), (2, 9, 1), (3, "", 0), (4, "", 0), (6, 3, 1))
                           for k, t in enumerate(("Competitions", "Discussion", "Scripts"))],
    # an extra leading column and a different order: read by header name
    "Kernels": ["CurrentKernelVersionId,Id,AuthorUserId,TotalVotes,TotalViews,TotalComments,Medal",
                "0,1,1,5,100,2,", "0,2,1,3,50,1,", "0,3,1,9,400,7,1", "0,4,2,1,10,0,", "0,5,2,2,20,1,",
                "0,6,2,0,5,0,", "0,7,3,1,1,0,"],
    "KernelTags": ["Id,KernelId,TagId", "1,1,1", "2,2,1", "3,3,2", "4,4,2", "5,7,1"],
    "Tags": ["Id,Name", "1,machine learning", "2,time series"],
    "Teams": ["Id,CompetitionId,TeamName,ScoreFirstSubmittedDate,PublicLeaderboardRank,PrivateLeaderboardRank,Medal",
              "1,50,a,2019-02-01 00:00:00,1,1,1", "2,50,b,2019-02-01 00:00:00,2,2,", "3,51,c,,3,3,",
              "4,51,d,2019-02-01 00:00:00,,4,3"],
    "CompetitionTags": ["Id,CompetitionId,TagId", "1,50,2", "2,51,1"],
    "TeamMemberships": ["Id,TeamId,UserId", "1,1,1", "2,2,2", "3,4,6", "4,4,1"],
    "ForumMessages": ["Id,ForumTopicId,PostUserId,PostDate,Message,Medal",
                      '1,7,1,x,"<p>I love <b>Machine Learning</b>,\nand Time-Series too.</p>",',
                      '2,7,2,x,"time series, time series &amp; more",',
                      '3,8,,x,"machine learning without an author",',
                      '4,9,3,x,"nothing here",'],
    "ForumTopics": ["Id,ForumId,Title", "7,70,t7", "8,70,t8", "9,71,t9"],
    "Forums": ["Id,ParentForumId,Title", "70,,general", "71,,other"],
}


def _folder():
    d = tempfile.mkdtemp(prefix="skillscope-community-")
    for name, lines in TABLES.items():
        with open(os.path.join(d, f"{name}.csv"), "w") as f:
            f.write("\n".join(lines) + "\n")
    return d


def test_plans_on_csv_exports(spark):
    c = CsvCommunity(spark, _folder())
    feats = materialize(fe.user_features(c))
    rows = {r["UserId"]: r for r in feats.collect()}
    assert set(rows) == {1, 2, 3, 4, 6}                      # tier 0 dropped
    assert rows[1]["NumOrgs"] == 2 and rows[1]["NumFollowers"] == 6 and rows[1]["KernelsCreated"] == 3
    assert rows[1]["TotalMedals"] == 9                         # (2+1+0) x 3 types

    scores = sk.skill_scores(c)
    got = {(r["UserId"], r["Name"]): r for r in scores.collect()}
    assert got[(1, "machine learning")]["DiscScore"] > 0       # HTML, multi-line message matched
    assert got[(2, "time series")]["DiscScore"] > 0            # "time series" twice
    assert all(k[0] is not None for k in got)                  # the author-less message counts for nobody
    assert got[(6, "machine learning")]["CompScore"] > 0       # team 4 in competition 51 (tag 1)

    pop = mo.linear_score(co.model_inputs(co.population(co.cohorts(feats))))
    top = se.expertise_finding(pop, scores, "Time Series").collect()
    assert top and top[0]["Rank"] == 1 and "Time Series Score" in top[0].asDict()
