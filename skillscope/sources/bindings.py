"""Shape the driver's TPC-H-like tables into the community tables the
pipeline expects (rules: FIXTURES.md section C).

Every binding is a lazy DataFrame derived from the driver tables, so its work
grows with them.  Rules marked * create the nulls and ties the data lacks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ranking import ordinal
from .readers import DriverTables

# Fixed values of the binding rules:
# - tier from m = custkey % 12: 0 if m = 0, 1 if 1 <= m <= 7, else m - 6
# - owner of an order: its customer if m >= 10 or orderkey % 12 = 0, else the customer of the same dozen with
#   m = 10 + orderkey % 2 (every order has an owner; most customers own few orders, two in twelve own many)
# - achievement flags: A = Competitions, N = Discussion, R = Scripts; the Scripts row of a customer with
#   custkey % 11 = 0 has no user
# - medals: quantity 50 = gold, 49 = silver, 48 = bronze; ranked when max quantity >= 48
# - teams: medal when min line number <= 3; rank when max quantity < 45; no submission when min flag = 'R'
# - memberships: one for each order; no user when orderkey % 13 = 0
# - messages: topic = doc_id // 20, forum = topic // 10, author = doc_id // 2 (none when doc_id % 17 = 0)
ACHIEVEMENT_FLAGS = (("A", "Competitions"), ("N", "Discussion"), ("R", "Scripts"))
GOLD_QTY, SILVER_QTY, BRONZE_QTY = 50.0, 49.0, 48.0
_RANKED, _BRONZE, _SILVER, _GOLD = 1, 2, 3, 4      # what a line's quantity brings; 0: nothing


def users(t: DriverTables) -> DataFrame:
    m = F.col("c_custkey") % 12
    tier = F.when(m == 0, 0).when(m <= 7, 1).otherwise(m - 6).cast("int")
    return t.customer.select(
        F.col("c_custkey").alias("UserId"),
        F.col("c_name").alias("UserName"),
        F.col("c_name").alias("DisplayName"),
        tier.alias("PerformanceTier"),
    )


def owned_orders(t: DriverTables) -> DataFrame:
    """All orders with their ``owner``."""
    m, key = F.col("o_custkey") % 12, F.col("o_orderkey")
    owner = F.when((m >= 10) | (key % 12 == 0), F.col("o_custkey")).otherwise(F.col("o_custkey") - m + 10 + key % 2)
    return t.orders.withColumn("owner", owner)


def _owned_lines(t: DriverTables, *line_cols: str) -> DataFrame:
    o = owned_orders(t).select("o_orderkey", "owner")
    li = t.lineitem.select("l_orderkey", *line_cols)
    return o.join(li, o.o_orderkey == li.l_orderkey, "inner")


def user_organizations(t: DriverTables) -> DataFrame:
    return _owned_lines(t, "l_suppkey").select(
        F.col("owner").alias("UserId"), F.col("l_suppkey").alias("OrganizationId")).distinct()


def user_followers(t: DriverTables) -> DataFrame:
    return _owned_lines(t, "l_partkey").select(
        F.col("owner").alias("UserId"), F.col("l_partkey").alias("FollowingUserId")).distinct()


def user_achievements(t: DriverTables) -> DataFrame:
    """*Three rows per customer; the Scripts row has no user when custkey % 11 = 0.

    Per-owner statistics are pivoted by flag in one aggregation, then
    unpivoted into three rows per customer (no cross join)."""
    q, flag = F.col("l_quantity"), F.col("l_returnflag")
    # flag and medal of a line in one number: lines are shuffled by order, so their rows are kept small
    medal = (F.when(q == GOLD_QTY, _GOLD).when(q == SILVER_QTY, _SILVER).when(q == BRONZE_QTY, _BRONZE)
             .when(q >= BRONZE_QTY, _RANKED).otherwise(0))
    number = F.coalesce(*[F.when(flag == f, i) for i, (f, _) in enumerate(ACHIEVEMENT_FLAGS)])
    li = t.lineitem.filter(flag.isin(*[f for f, _ in ACHIEVEMENT_FLAGS])).select(
        "l_orderkey", (number * 8 + medal).alias("code"), "l_extendedprice")
    o = owned_orders(t).select("o_orderkey", "owner")
    lines = o.join(li, o.o_orderkey == li.l_orderkey, "inner")
    aggs = []
    for i, (f, _) in enumerate(ACHIEVEMENT_FLAGS):
        is_f, m = F.shiftright("code", 3) == i, F.col("code").bitwiseAND(7)
        aggs += [
            F.count(F.when(is_f & (m == _GOLD), 1)).alias(f"g_{f}"),
            F.count(F.when(is_f & (m == _SILVER), 1)).alias(f"s_{f}"),
            F.count(F.when(is_f & (m == _BRONZE), 1)).alias(f"b_{f}"),
            F.max(F.when(is_f, m)).alias(f"m_{f}"),
            F.min(F.when(is_f, F.col("l_extendedprice"))).alias(f"mp_{f}"),
        ]
    per_owner = lines.groupBy("owner").agg(*aggs)
    cust = t.customer.select("c_custkey")
    joined = cust.join(per_owner, cust.c_custkey == per_owner.owner, "left")
    entries = []
    for flag, name in ACHIEVEMENT_FLAGS:
        unowned = (F.lit(name) == "Scripts") & (F.col("c_custkey") % 11 == 0)
        entries.append(F.struct(
            F.when(~unowned, F.col("c_custkey")).alias("UserId"),
            F.lit(name).alias("AchievementType"),
            F.coalesce(F.col(f"g_{flag}"), F.lit(0)).cast("long").alias("TotalGold"),
            F.coalesce(F.col(f"s_{flag}"), F.lit(0)).cast("long").alias("TotalSilver"),
            F.coalesce(F.col(f"b_{flag}"), F.lit(0)).cast("long").alias("TotalBronze"),
            F.when(F.col(f"m_{flag}") > 0, F.floor(F.col(f"mp_{flag}"))).cast("long").alias("HighestRanking"),
        ))
    return joined.select(F.explode(F.array(*entries)).alias("a")).select("a.*")


def kernels(t: DriverTables) -> DataFrame:
    """*Orders left join lineitem; votes null when an order has no lines."""
    o = owned_orders(t).select("o_orderkey", "owner", "o_totalprice")
    li = t.lineitem.select("l_orderkey", "l_quantity")
    per_order = li.groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("n_lines"), F.sum("l_quantity").alias("qty"))
    j = o.join(per_order, o.o_orderkey == per_order.l_orderkey, "left")
    return j.select(
        F.col("o_orderkey").alias("KernelId"),
        F.col("owner").alias("UserId"),
        F.floor("o_totalprice").cast("long").alias("TotalViews"),
        F.coalesce(F.col("n_lines"), F.lit(0)).cast("long").alias("TotalComments"),
        F.col("qty").cast("long").alias("TotalVotes"),
    )


def tags(t: DriverTables) -> DataFrame:
    """Distinct part names; TagId = 1-based position in name order."""
    names = t.part.select(F.col("p_name").alias("Name")).distinct()
    return ordinal(names, "Name", "TagId").select("TagId", "Name")


def kernel_tags(t: DriverTables, tag_df: DataFrame | None = None) -> DataFrame:
    tag_df = tag_df if tag_df is not None else tags(t)
    p = t.part.select("p_partkey", "p_name")
    named = p.join(tag_df, F.col("p_name") == F.col("Name")).select("p_partkey", "TagId")
    lines = t.lineitem.select("l_orderkey", "l_partkey").join(named, F.col("l_partkey") == F.col("p_partkey"))
    # the orders last: their partitioning serves the distinct and later joins by kernel.  No semi join, which would be
    # pushed below the join with the parts; the distinct drops the rows of repeated orders
    orders = t.orders.select(F.col("o_orderkey").alias("KernelId"))
    held = lines.join(orders, F.col("l_orderkey") == F.col("KernelId"))
    return held.select("KernelId", "TagId").distinct()


def teams(t: DriverTables) -> DataFrame:
    """*One team per order; ranks summed in exact cents."""
    li = t.lineitem
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    g = li.groupBy("l_orderkey").agg(
        F.min("l_partkey").alias("CompetitionId"),
        F.min("l_linenumber").alias("min_line"),
        F.max("l_quantity").alias("max_qty"),
        F.sum(cents).alias("cents"),
        F.min("l_returnflag").alias("min_flag"),
        F.min("l_shipdate").alias("min_ship"),
    )
    return g.select(
        F.col("l_orderkey").alias("TeamId"),
        "CompetitionId",
        F.when(F.col("min_line") <= 3, F.col("min_line")).alias("Medal"),
        F.when(F.col("max_qty") < 45, F.floor(F.col("cents") / 100)).cast("long").alias("PublicLeaderboardRank"),
        F.when(F.col("min_flag") != "R", F.col("min_ship")).alias("ScoreFirstSubmittedDate"),
    )


def competition_tags(t: DriverTables, tag_df: DataFrame | None = None) -> DataFrame:
    tag_df = tag_df if tag_df is not None else tags(t)
    p = t.part.select("p_partkey", "p_name")
    return p.join(tag_df, p.p_name == tag_df.Name).select(F.col("p_partkey").alias("CompetitionId"), "TagId")


def team_memberships(t: DriverTables) -> DataFrame:
    """*One membership per order, without a user when orderkey % 13 = 0."""
    return t.orders.select(F.col("o_orderkey").alias("TeamId"),
                           F.when(F.col("o_orderkey") % 13 != 0, F.col("o_custkey")).alias("UserId"))


def _topic(message_id) -> Column:
    return F.floor(message_id / 20).cast("long")


def forum_messages(t: DriverTables, html: bool = False) -> DataFrame:
    """*Messages from ``documents`` (or raw HTML from ``pages``)."""
    if html:
        src = t.pages.select(F.col("page_id").alias("id"), F.col("html").alias("Message"))
    else:
        src = t.documents.select(F.col("doc_id").alias("id"), F.col("text").alias("Message"))
    return src.select(
        F.col("id").alias("MessageId"),
        _topic(F.col("id")).alias("ForumTopicId"),
        F.when(F.col("id") % 17 != 0, F.floor(F.col("id") / 2).cast("long")).alias("UserId"),
        "Message",
    )


def forum_topics(t: DriverTables, html: bool = False) -> DataFrame:
    ids = (t.plain("pages").select(F.col("page_id").alias("id")) if html
           else t.plain("documents").select(F.col("doc_id").alias("id")))
    return (ids.select(_topic(F.col("id")).alias("ForumTopicId")).distinct()
            .withColumn("ForumId", F.floor(F.col("ForumTopicId") / 10).cast("long")))


def forums(t: DriverTables, html: bool = False) -> DataFrame:
    return forum_topics(t, html).select("ForumId").distinct().withColumn(
        "Title", F.concat(F.lit("forum "), F.col("ForumId").cast("string")))


class Community:
    """All engine tables bound from one driver folder (lazy).  ``keep(name, build)`` may store what many tables are
    made from: the tags, one row for each distinct part name."""

    def __init__(self, tables: DriverTables, keep=None):
        self.t = tables
        self._keep = keep or (lambda name, build: build())
        self._tags = None

    @property
    def spark(self):
        return self.t.spark

    def users(self):
        return users(self.t)

    def user_organizations(self):
        return user_organizations(self.t)

    def user_followers(self):
        return user_followers(self.t)

    def user_achievements(self):
        return user_achievements(self.t)

    def kernels(self):
        return kernels(self.t)

    def tags(self):
        if self._tags is None:
            self._tags = self._keep("tags", lambda: tags(self.t))
        return self._tags

    def kernel_tags(self):
        return kernel_tags(self.t, self.tags())

    def teams(self):
        return teams(self.t)

    def competition_tags(self):
        return competition_tags(self.t, self.tags())

    def team_memberships(self):
        return team_memberships(self.t)

    def skill_phrases(self, tokens, vocabulary):
        """Tag names paired with frequent phrases of the prose (FIXTURES C):
        the driver's tag names never occur in its documents.  ``tokens``: the
        cleaned messages, ``vocabulary``: their distinct tokens."""
        from ..plans.skills import phrase_taxonomy
        return phrase_taxonomy(tokens, vocabulary, self.tags())

    def forum_messages(self, html: bool = False):
        return forum_messages(self.t, html)

    def forum_topics(self, html: bool = False):
        return forum_topics(self.t, html)

    def forums(self, html: bool = False):
        return forums(self.t, html)


def community(spark, sf_dir: str, keep=None) -> Community:
    return Community(DriverTables(spark, sf_dir), keep)
