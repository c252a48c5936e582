"""DuckDB text of the table bindings (FIXTURES.md section C), used as the
common prefix of every oracle query.

These CTEs are written independently of the Spark code in
``skillscope.sources.bindings``; both follow the same written rules.
"""

# Engine tables as CTEs over the driver tables.  Each name below is usable
# by the oracle queries that follow ``WITH`` + ``BINDINGS`` + ``,``.
BINDINGS = """
users AS (
  SELECT c_custkey AS UserId, c_name AS UserName, c_name AS DisplayName,
         CAST(CASE WHEN c_custkey % 12 = 0 THEN 0
                   WHEN c_custkey % 12 <= 7 THEN 1
                   ELSE c_custkey % 12 - 6 END AS INTEGER) AS PerformanceTier
  FROM customer
),
owned_orders AS (
  SELECT *, CASE WHEN o_custkey % 12 >= 10 OR o_orderkey % 12 = 0 THEN o_custkey
                 ELSE o_custkey - o_custkey % 12 + 10 + o_orderkey % 2 END AS owner
  FROM orders
),
owned_lines AS (
  SELECT o.o_orderkey, o.owner, l.l_partkey, l.l_suppkey, l.l_quantity, l.l_returnflag, l.l_extendedprice
  FROM owned_orders o JOIN lineitem l ON l.l_orderkey = o.o_orderkey
),
user_organizations AS (
  SELECT DISTINCT owner AS UserId, l_suppkey AS OrganizationId FROM owned_lines
),
user_followers AS (
  SELECT DISTINCT owner AS UserId, l_partkey AS FollowingUserId FROM owned_lines
),
achievement_types AS (
  SELECT * FROM (VALUES ('A', 'Competitions'), ('N', 'Discussion'), ('R', 'Scripts')) t(flag, AchievementType)
),
user_achievements AS (
  SELECT CASE WHEN t.AchievementType = 'Scripts' AND c.c_custkey % 11 = 0 THEN NULL ELSE c.c_custkey END AS UserId,
         t.AchievementType,
         CAST(count(cl.l_quantity) FILTER (WHERE cl.l_quantity = 50) AS BIGINT) AS TotalGold,
         CAST(count(cl.l_quantity) FILTER (WHERE cl.l_quantity = 49) AS BIGINT) AS TotalSilver,
         CAST(count(cl.l_quantity) FILTER (WHERE cl.l_quantity = 48) AS BIGINT) AS TotalBronze,
         CASE WHEN max(cl.l_quantity) >= 48 THEN CAST(floor(min(cl.l_extendedprice)) AS BIGINT) END AS HighestRanking
  FROM customer c
  CROSS JOIN achievement_types t
  LEFT JOIN owned_lines cl ON cl.owner = c.c_custkey AND cl.l_returnflag = t.flag
  GROUP BY c.c_custkey, t.AchievementType
),
kernels AS (
  SELECT o.o_orderkey AS KernelId, o.owner AS UserId,
         CAST(floor(o.o_totalprice) AS BIGINT) AS TotalViews,
         CAST(count(l.l_orderkey) AS BIGINT) AS TotalComments,
         CAST(sum(l.l_quantity) AS BIGINT) AS TotalVotes
  FROM owned_orders o LEFT JOIN lineitem l ON l.l_orderkey = o.o_orderkey
  GROUP BY o.o_orderkey, o.owner, o.o_totalprice
),
tags AS (
  SELECT CAST(row_number() OVER (ORDER BY p_name) AS BIGINT) AS TagId, p_name AS Name
  FROM (SELECT DISTINCT p_name FROM part)
),
kernel_tags AS (
  SELECT DISTINCT al.o_orderkey AS KernelId, tg.TagId
  FROM owned_lines al JOIN part p ON p.p_partkey = al.l_partkey JOIN tags tg ON tg.Name = p.p_name
),
teams AS (
  SELECT l_orderkey AS TeamId, min(l_partkey) AS CompetitionId,
         CASE WHEN min(l_linenumber) <= 3 THEN min(l_linenumber) END AS Medal,
         CASE WHEN max(l_quantity) < 45
              THEN CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) // 100 AS BIGINT) END AS PublicLeaderboardRank,
         CASE WHEN min(l_returnflag) = 'R' THEN NULL ELSE min(l_shipdate) END AS ScoreFirstSubmittedDate
  FROM lineitem GROUP BY l_orderkey
),
competition_tags AS (
  SELECT p.p_partkey AS CompetitionId, tg.TagId FROM part p JOIN tags tg ON tg.Name = p.p_name
),
team_memberships AS (
  SELECT o_orderkey AS TeamId, CASE WHEN o_orderkey % 13 <> 0 THEN o_custkey END AS UserId FROM orders
),
forum_messages AS (
  SELECT doc_id AS MessageId, doc_id // 20 AS ForumTopicId,
         CASE WHEN doc_id % 17 <> 0 THEN doc_id // 2 END AS UserId,
         text AS Message
  FROM documents
),
forum_topics AS (
  SELECT DISTINCT ForumTopicId, ForumTopicId // 10 AS ForumId FROM forum_messages
),
forums AS (
  SELECT DISTINCT ForumId, 'forum ' || CAST(ForumId AS VARCHAR) AS Title FROM forum_topics
),
forum_messages_html AS (
  SELECT page_id AS MessageId, page_id // 20 AS ForumTopicId,
         CASE WHEN page_id % 17 <> 0 THEN page_id // 2 END AS UserId,
         html AS Message
  FROM pages
),
forum_topics_html AS (
  SELECT DISTINCT ForumTopicId, ForumTopicId // 10 AS ForumId FROM forum_messages_html
),
forums_html AS (
  SELECT DISTINCT ForumId, 'forum ' || CAST(ForumId AS VARCHAR) AS Title FROM forum_topics_html
)
"""


def with_bindings(body_ctes: str, final_select: str) -> str:
    """Compose ``WITH <bindings>, <body_ctes> <final_select>``."""
    body = BINDINGS.rstrip()
    if body_ctes.strip():
        body += ",\n" + body_ctes.strip()
    return "WITH " + body.strip() + "\n" + final_select.strip()
