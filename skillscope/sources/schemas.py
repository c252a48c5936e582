"""Declared schemas of the community tables (no inference pass at scale)."""

from pyspark.sql import types as T

L, I, S = T.LongType(), T.IntegerType(), T.StringType()


def _schema(*cols):
    return T.StructType([T.StructField(n, t, True) for n, t in cols])


# Source-file column names (as exported by the community site); renames to
# engine names happen in the readers.  Dates stay text: they are only tested
# for null, and exports write them in several formats.
SCHEMAS = {
    "Users": _schema(("Id", L), ("UserName", S), ("DisplayName", S), ("RegisterDate", S), ("PerformanceTier", I)),
    "UserOrganizations": _schema(("Id", L), ("UserId", L), ("OrganizationId", L), ("JoinDate", S)),
    "UserFollowers": _schema(("Id", L), ("UserId", L), ("FollowingUserId", L), ("CreationDate", S)),
    "UserAchievements": _schema(
        ("Id", L), ("UserId", L), ("AchievementType", S), ("Tier", I), ("TierAchievementDate", S), ("Points", L),
        ("CurrentRanking", L), ("HighestRanking", L), ("TotalGold", L), ("TotalSilver", L), ("TotalBronze", L)),
    "Kernels": _schema(("Id", L), ("AuthorUserId", L), ("Medal", I), ("TotalViews", L), ("TotalComments", L), ("TotalVotes", L)),
    "KernelTags": _schema(("Id", L), ("KernelId", L), ("TagId", L)),
    "Tags": _schema(("Id", L), ("Name", S)),
    "Teams": _schema(("Id", L), ("CompetitionId", L), ("TeamName", S), ("ScoreFirstSubmittedDate", S),
                     ("PublicLeaderboardRank", L), ("PrivateLeaderboardRank", L), ("Medal", I)),
    "CompetitionTags": _schema(("Id", L), ("CompetitionId", L), ("TagId", L)),
    "TeamMemberships": _schema(("Id", L), ("TeamId", L), ("UserId", L)),
    "ForumMessages": _schema(("Id", L), ("ForumTopicId", L), ("PostUserId", L), ("PostDate", S), ("Message", S), ("Medal", I)),
    "ForumTopics": _schema(("Id", L), ("ForumId", L), ("Title", S)),
    "Forums": _schema(("Id", L), ("ParentForumId", L), ("Title", S)),
    "Competitions": _schema(("Id", L), ("OrganizationId", L), ("Title", S)),
}

# Source-name -> engine-name renames applied when reading.
RENAMES = {
    "Users": {"Id": "UserId"},
    "Kernels": {"Id": "KernelId", "AuthorUserId": "UserId"},
    "Tags": {"Id": "TagId"},
    "Teams": {"Id": "TeamId"},
    "ForumMessages": {"Id": "MessageId", "PostUserId": "UserId"},
    "ForumTopics": {"Id": "ForumTopicId"},
    "Forums": {"Id": "ForumId"},
    "Competitions": {"Id": "CompetitionId"},
}
