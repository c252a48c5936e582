"""The community's own CSV exports as a source.

Same interface as ``bindings.Community``, so every plan runs unchanged on the
exported tables.  Tables are read with declared schemas (no inference pass),
renamed to engine names, and forum messages with the multi-line reader.  The
skill taxonomy is the tag names themselves, as in the reference.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .readers import read_csv_table, read_messages_csv, spread


class CsvCommunity:
    """Engine tables from a folder of ``<Table>.csv`` exports (lazy)."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")
        self._cache: dict[str, DataFrame] = {}

    def _t(self, table: str) -> DataFrame:
        if table not in self._cache:
            path = f"{self.folder}/{table}.csv"
            if table == "ForumMessages":
                self._cache[table] = spread(read_messages_csv(self.spark, path))
            else:
                self._cache[table] = read_csv_table(self.spark, path, table)
        return self._cache[table]

    def users(self):
        return self._t("Users").select("UserId", "UserName", "DisplayName", "PerformanceTier")

    def user_organizations(self):
        return self._t("UserOrganizations").select("UserId", "OrganizationId")

    def user_followers(self):
        return self._t("UserFollowers").select("UserId", "FollowingUserId")

    def user_achievements(self):
        return self._t("UserAchievements").select("UserId", "AchievementType", "TotalGold", "TotalSilver",
                                                  "TotalBronze", "HighestRanking")

    def kernels(self):
        return self._t("Kernels").select("KernelId", "UserId", "TotalViews", "TotalComments", "TotalVotes")

    def tags(self):
        return self._t("Tags").select("TagId", "Name")

    def kernel_tags(self):
        return self._t("KernelTags").select("KernelId", "TagId")

    def teams(self):
        return self._t("Teams").select("TeamId", "CompetitionId", "Medal", "PublicLeaderboardRank",
                                       "ScoreFirstSubmittedDate")

    def competition_tags(self):
        return self._t("CompetitionTags").select("CompetitionId", "TagId")

    def team_memberships(self):
        return self._t("TeamMemberships").select("TeamId", "UserId")

    def forum_messages(self, html: bool = False):
        # message bodies are HTML in the exports; the cleaning handles both
        return self._t("ForumMessages").select("MessageId", "ForumTopicId", "UserId", "Message")

    def forum_topics(self, html: bool = False):
        return self._t("ForumTopics").select("ForumTopicId", "ForumId")

    def forums(self, html: bool = False):
        return self._t("Forums").select("ForumId", "Title")

    def skill_phrases(self, tokens, vocabulary):
        """Each tag's own name is its phrase (normalised like message text)."""
        return self.tags().select("TagId", "Name", F.col("Name").alias("phrase"), F.lit(None).cast("long")
                                  .alias("doc_count"))
