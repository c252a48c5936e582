"""Named queries over a driver-table folder: one per operator group of the
survey's inventory.  Each takes ``(spark, sf_dir)`` and returns a DataFrame
over the whole tables; tables that several branches read are written when the
query is built (``session.materialize``), the rest is lazy.  Doubles are rounded to 6 digits at the end
so an independent SQL engine can be compared value by value.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .config import DOWNSAMPLE_FRACTION, SEARCH_SIZE, TOP_SKILLS_SIZE
from .functions.sentences import abbreviations, sentences, text_words
from .functions.stem import stemmed_rows
from .functions.text import normalized_text, tidy_split
from .operators.sampling import hash_sample
from .plans import cohorts as co
from .plans import features as fe
from .plans import model as mo
from .plans import search as se
from .plans import skills as sk
from .session import materialize, shared_folder, store_by
from .sources.bindings import community
from .sources.readers import convert_messages, read_csv_table

# The skill searched by the registered search query (a tag of the bound data).
SEARCH_SKILL = "Blue Rod"

# The tables that many queries start from (features, cleaned tokens, vocabulary, taxonomy, mention counts,
# skill scores), by application and state of the input: each is written once.
_TABLES: dict[tuple, DataFrame] = {}


def _version(spark, sf_dir):
    """What tells a rewritten input from the old one: name, length and time of each table's file or folder."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(sf_dir)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path)
    return tuple(sorted((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in found))


def _kept(spark, sf_dir, name, build, store=materialize):
    """The table of that name, built and stored at its first use; ``store`` returns a scan of the files it wrote."""
    key = (spark.sparkContext.applicationId, sf_dir, _version(spark, sf_dir), name)
    if key not in _TABLES:
        _TABLES[key] = store(build())
    return _TABLES[key]


def _c(spark, sf_dir):
    return community(spark, sf_dir, _keeper(spark, sf_dir))


def _features(spark, sf_dir):
    return _kept(spark, sf_dir, "features", lambda: fe.user_features(_c(spark, sf_dir)))


def _cohorts(spark, sf_dir):
    return co.cohorts(_features(spark, sf_dir))


def _population(spark, sf_dir):
    return co.model_inputs(co.population(_cohorts(spark, sf_dir)))


def _keeper(spark, sf_dir):
    return lambda name, build: _kept(spark, sf_dir, name, build)


def _disc(spark, sf_dir, html=False, scored=False):
    return sk.discussion_pipeline(_c(spark, sf_dir), html, scored, _keeper(spark, sf_dir))


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(F.col(f.name), digits).alias(f.name) if isinstance(f.dataType, (T.DoubleType, T.FloatType))
                       else F.col(f.name) for f in df.schema.fields])


def _scored_population(spark, sf_dir):
    """Every active user with model inputs and the fixed-weight score."""
    return mo.linear_score(_population(spark, sf_dir))


# ---- sources ---------------------------------------------------------------------
def s_scan_counts(spark, sf_dir):
    c = _c(spark, sf_dir)
    tables = {"users": c.users(), "user_organizations": c.user_organizations(), "user_followers": c.user_followers(),
              "user_achievements": c.user_achievements(), "kernels": c.kernels(), "tags": c.tags(),
              "kernel_tags": c.kernel_tags(), "teams": c.teams(), "competition_tags": c.competition_tags(),
              "team_memberships": c.team_memberships(), "forum_messages": c.forum_messages(),
              "forum_topics": c.forum_topics(), "forums": c.forums()}
    out = None
    for name, df in tables.items():
        one = df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows")
        out = one if out is None else out.unionByName(one)
    return out


def s_preview(spark, sf_dir):
    return _c(spark, sf_dir).users().orderBy("UserId").limit(20)


def _exported(spark, df, **options):
    """``df`` written as a CSV export to the scratch folder; its path."""
    path = f"{shared_folder(spark)}/export-{uuid.uuid4().hex}"
    df.write.options(header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
                     **options).csv(path)
    return path


def s_csv_users(spark, sf_dir):
    """The users written as the community's CSV export and read back by the declared schema."""
    out = _c(spark, sf_dir).users().selectExpr(
        "UserId AS Id", "UserName", "DisplayName", "CAST(NULL AS string) AS RegisterDate", "PerformanceTier")
    return read_csv_table(spark, _exported(spark, out), "Users").select(
        "UserId", "UserName", "DisplayName", "PerformanceTier")


def s_csv_messages(spark, sf_dir):
    """The messages (line breaks, quotes and commas in their text) as a multi-line CSV export, converted once
    to Parquet and read from there."""
    out = _c(spark, sf_dir).forum_messages().selectExpr(
        "MessageId AS Id", "ForumTopicId", "UserId AS PostUserId", "CAST(NULL AS string) AS PostDate", "Message",
        "CAST(NULL AS int) AS Medal")
    stored = f"{shared_folder(spark)}/messages-{uuid.uuid4().hex}"
    convert_messages(spark, _exported(spark, out), stored, spark.sparkContext.defaultParallelism)
    return spark.read.parquet(stored).select("MessageId", "ForumTopicId", "UserId", "Message")


# ---- projections -------------------------------------------------------------------
def p_rename_select(spark, sf_dir):
    return _c(spark, sf_dir).kernels().select("KernelId", "UserId", "TotalViews", "TotalComments", "TotalVotes")


def p_derived_scores(spark, sf_dir):
    m = fe.medal_totals(fe.active_users(_c(spark, sf_dir).users()), _c(spark, sf_dir).user_achievements())
    return m.select("UserId", "TotalDisc", "TotalComp", "TotalScript", "TotalMedals")


def p_flags_casts(spark, sf_dir):
    df = co.model_inputs(_features(spark, sf_dir))
    return _rounded(df.select("UserId", "AvgPerRanking", F.col("Ranked").cast("double").alias("Ranked"),
         F.col("PerformanceTier").cast("int").alias("PerformanceTier")))


# ---- filters ------------------------------------------------------------------------
def f_active_users(spark, sf_dir):
    return fe.active_users(_c(spark, sf_dir).users())


def f_expert_rule(spark, sf_dir):
    return _cohorts(spark, sf_dir)["experts"].select("UserId", "Expert")


def f_non_expert_rule(spark, sf_dir):
    return _cohorts(spark, sf_dir)["non_experts"].select("UserId", "Expert")


def f_dropna_fillna(spark, sf_dir):
    t = _c(spark, sf_dir).teams()
    return (t.filter(F.col("ScoreFirstSubmittedDate").isNotNull())
            .select("TeamId", "CompetitionId", F.coalesce("Medal", F.lit(4)).alias("Medal"), "PublicLeaderboardRank"))


def f_point_lookup(spark, sf_dir):
    return _c(spark, sf_dir).users().filter(F.col("UserName") == "Customer#000000001")


def f_user_skill_lookup(spark, sf_dir):
    """one user's scores for a set of tags (point lookup on the joined
    users-and-skills table)."""
    uas = se.users_and_skills(_scored_population(spark, sf_dir), c_skill_scores_raw(spark, sf_dir))
    return _rounded(uas.filter((F.col("UserId") == 11) & F.col("Name").isin("blue rod", "cold gear", "hot plate"))
                    .select("UserId", "DisplayName", "Name", "DiscScore", "SkillScore"))


def f_skill_list(spark, sf_dir):
    return se.list_skills(_c(spark, sf_dir).tags())


# ---- joins ---------------------------------------------------------------------------
def j_left_counts(spark, sf_dir):
    c = _c(spark, sf_dir)
    return fe.membership_counts(fe.active_users(c.users()), c.user_organizations(), c.user_followers())


def j_inner_medals(spark, sf_dir):
    """A4: medal sums per (user, type) over the user x achievement left join."""
    c = _c(spark, sf_dir)
    active = fe.active_users(c.users()).select("UserId")
    ach = c.user_achievements()
    per = ach.groupBy("UserId", "AchievementType").agg(
        F.sum("TotalGold").alias("TotalGold"), F.sum("TotalSilver").alias("TotalSilver"),
        F.sum("TotalBronze").alias("TotalBronze"))
    return active.join(per, "UserId", "left")


def j_left_anti(spark, sf_dir):
    return _cohorts(spark, sf_dir)["unlabelled"].select("UserId")


def j_full_outer_scores(spark, sf_dir):
    """J21, J22 as literal full outer joins of the three branches, which the
    union form of ``c_skill_scores`` must equal."""
    c = _c(spark, sf_dir)
    tags = c.tags()
    kernel = sk.kernel_skill_scores(c.kernels(), c.kernel_tags(), tags)
    comp = sk.competition_skill_scores(c.teams(), c.competition_tags(), tags, c.team_memberships())
    return _rounded(sk.outer_skill_scores(comp, kernel, _disc(spark, sf_dir, scored=True)["scores"]))


def j_tag_chain(spark, sf_dir):
    c = _c(spark, sf_dir)
    return _rounded(sk.kernel_tag_rows(c.kernels(), c.kernel_tags(), c.tags()))


def j_team_fanout(spark, sf_dir):
    c = _c(spark, sf_dir)
    return _rounded(sk.team_member_tag_rows(c.teams(), c.competition_tags(), c.tags(), c.team_memberships()))


def j_forum_path(spark, sf_dir):
    c = _c(spark, sf_dir)
    rows = sk.forum_message_rows(c.forum_messages(), c.forum_topics(), c.forums())
    return rows.select("MessageId", "UserId", "ForumTopicId", "Title", F.length("Message").alias("message_chars"))


# ---- aggregations ----------------------------------------------------------------------
def a_distinct_counts(spark, sf_dir):
    f = _features(spark, sf_dir)
    return f.select("UserId", "NumOrgs", "NumFollowers", "KernelsCreated")


def a_medal_pivot(spark, sf_dir):
    c = _c(spark, sf_dir)
    return fe.medal_totals(fe.active_users(c.users()), c.user_achievements())


def a_content_means(spark, sf_dir):
    c = _c(spark, sf_dir)
    active = fe.active_users(c.users()).select("UserId")
    per = c.kernels().groupBy("UserId").agg(F.avg("TotalViews").alias("KernelsAvgViews"),
                                            F.avg("TotalComments").alias("KernelsAvgComments"),
                                            F.avg("TotalVotes").alias("KernelsAvgVotes"))
    out = active.join(per, "UserId", "left").fillna(0.0, subset=["KernelsAvgViews", "KernelsAvgComments",
                                                                  "KernelsAvgVotes"])
    return _rounded(out)


def a_tag_means(spark, sf_dir):
    c = _c(spark, sf_dir)
    return _rounded(sk.kernel_skill_scores(c.kernels(), c.kernel_tags(), c.tags()))


def a_mentions(spark, sf_dir):
    return _disc(spark, sf_dir)["counts"]


def a_mentions_html(spark, sf_dir):
    """A9 over raw HTML messages (pages): markup, scripts, styles, comments,
    entities and links go through F11-F14 before tagging."""
    return _disc(spark, sf_dir, html=True)["counts"]


def a_counts(spark, sf_dir):
    parts = _cohorts(spark, sf_dir)
    cols = []
    for name in ("experts", "non_experts", "non_experts_downsampled", "train", "unlabelled"):
        cols.append(parts[name].agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("cohort"), "n"))
    out = cols[0]
    for x in cols[1:]:
        out = out.unionByName(x)
    return out


def a_corr_matrix(spark, sf_dir):
    train = co.model_inputs(_cohorts(spark, sf_dir)["train"])
    cols = ["NumOrgs", "NumFollowers", "TotalMedals", "KernelsCreated", "UserKernelScore", "AvgPerRanking", "Expert"]
    return _rounded(mo.correlations(train, cols))


def _holdout_predictions(spark, sf_dir):
    train = co.model_inputs(_cohorts(spark, sf_dir)["train"])
    split = mo.holdout_split(train)
    return mo.linear_score(split.filter(F.col("is_holdout") == 1))


def a_confusion(spark, sf_dir):
    return mo.confusion(_holdout_predictions(spark, sf_dir))


# ---- windows --------------------------------------------------------------------------
def w_user_content_pct(spark, sf_dir):
    c = _c(spark, sf_dir)
    return _rounded(fe.kernel_features(fe.active_users(c.users()), c.kernels()))


def w_rankings_pct(spark, sf_dir):
    c = _c(spark, sf_dir)
    return _rounded(fe.ranking_percentiles(fe.active_users(c.users()), c.user_achievements()))


def w_item_pct(spark, sf_dir):
    c = _c(spark, sf_dir)
    return _rounded(sk.kernel_item_scores(c.kernels()))


def w_team_pct(spark, sf_dir):
    c = _c(spark, sf_dir)
    return _rounded(sk.team_scores(c.teams()))


def w_team_rank_pct(spark, sf_dir):
    """Leaderboard percentile of each team with a first submission."""
    return w_team_pct(spark, sf_dir).select("TeamId", "PublicLeaderboardRank", "RankPer")


def w_medal_pct(spark, sf_dir):
    """Medal percentile (no medal = 4) of each team with a first submission."""
    return w_team_pct(spark, sf_dir).select("TeamId", "Medal", "MedalPer")


def w_team_pct_by_competition(spark, sf_dir):
    return _rounded(sk.team_scores(_c(spark, sf_dir).teams(), per_competition=True))


def w_team_pct_compat(spark, sf_dir):
    return _rounded(sk.team_scores(_c(spark, sf_dir).teams(), compat=True))


def w_within_tag_avg_rank(spark, sf_dir):
    return _rounded(_disc(spark, sf_dir, scored=True)["scores"])


# ---- sorts, limits, sampling -------------------------------------------------------------
def o_top_skill_scores(spark, sf_dir):
    return _rounded(sk.top_skill_scores(c_skill_scores_raw(spark, sf_dir), TOP_SKILLS_SIZE))


def o_top_experts_of_every_skill(spark, sf_dir):
    """O2 for all tags at once: the 25 best users of every skill by CombinedScore."""
    uas = se.users_and_skills(_scored_population(spark, sf_dir), c_skill_scores_raw(spark, sf_dir), every=True)
    top = sk.top_in_each(uas.select("Name", "UserId", "CombinedScore"), "Name",
                         [F.col("CombinedScore").desc(), F.col("UserId")], SEARCH_SIZE)
    return _rounded(top.select("Name", "Rank", "UserId", "CombinedScore"))


def o_limit(spark, sf_dir):
    return _c(spark, sf_dir).tags().orderBy("TagId").limit(10)


def o_hash_sample(spark, sf_dir):
    return hash_sample(_cohorts(spark, sf_dir)["non_experts"], "UserId", DOWNSAMPLE_FRACTION).select("UserId")


def o_downsample(spark, sf_dir):
    return _cohorts(spark, sf_dir)["non_experts_downsampled"].select("UserId", "Expert")


def o_seeded_sample(spark, sf_dir):
    """O4 as coded in the reference: Bernoulli sample without replacement,
    fraction 0.2, seed 1 (engine-specific draw: rows-only check)."""
    return _cohorts(spark, sf_dir)["non_experts"].sample(False, DOWNSAMPLE_FRACTION, 1).select("UserId")


def o_random_split(spark, sf_dir):
    """O6 as coded: random 80/20 split (seeded here), flagged (rows-only check)."""
    train = _cohorts(spark, sf_dir)["train"].select("UserId", "Expert")
    fit_part, holdout = train.randomSplit([0.8, 0.2], seed=1)
    return fit_part.withColumn("is_holdout", F.lit(0)).unionByName(holdout.withColumn("is_holdout", F.lit(1)))


def o_hash_split(spark, sf_dir):
    return mo.holdout_split(_cohorts(spark, sf_dir)["train"]).select("UserId", "Expert", "is_holdout")


# ---- set operations ----------------------------------------------------------------------
def u_train_union(spark, sf_dir):
    return _cohorts(spark, sf_dir)["train"].select("UserId", "Expert")


def u_append_missing_cols(spark, sf_dir):
    return co.population(_cohorts(spark, sf_dir)).select("UserId", "Expert")


# ---- text -----------------------------------------------------------------------------
def t_html_clean(spark, sf_dir):
    pages = _c(spark, sf_dir).t.pages
    return pages.select("page_id", normalized_text("html").alias("text"))


def t_token_clean(spark, sf_dir):
    """Every message cleaned and stemmed through the vocabulary, as one phrase."""
    d = _disc(spark, sf_dir)
    stems = stemmed_rows(d["tokens"], "MessageId", "tokens", d["vocabulary"])
    return stems.select(F.col("MessageId").alias("doc_id"), F.array_join("tokens", " ").alias("message_clean"))


def _worded(spark, sf_dir):
    """The messages as words (markup removed, punctuation kept), stored once."""
    return _kept(spark, sf_dir, "words", lambda: _c(spark, sf_dir).forum_messages().filter("Message IS NOT NULL").select(
        "MessageId", text_words("Message").alias("words")))


def _abbreviations(spark, sf_dir):
    return _kept(spark, sf_dir, "abbreviations", lambda: abbreviations(_worded(spark, sf_dir)))


def t_abbreviations(spark, sf_dir):
    """F16: the words that the messages write with a dot most of the time."""
    return _abbreviations(spark, sf_dir)


def t_sentences(spark, sf_dir):
    """F16: every sentence of every message, by the positions of its words."""
    return sentences(_worded(spark, sf_dir), "MessageId", _abbreviations(spark, sf_dir))


def t_explode_split(spark, sf_dir):
    """tidy split of each message's comma-joined match list."""
    m = _disc(spark, sf_dir)["mentions"]
    listed = m.groupBy("MessageId").agg(F.array_join(F.array_sort(F.collect_list("Name")), ",").alias("names"))
    return listed.select("MessageId", F.explode(tidy_split("names")).alias("Name")).groupBy("MessageId", "Name").agg(
        F.count(F.lit(1)).alias("n"))


def t_vocab_stem(spark, sf_dir):
    """each distinct token of the messages with its stem and the number of messages that hold it."""
    return _disc(spark, sf_dir)["vocabulary"]


def t_ngram_candidates(spark, sf_dir):
    return _disc(spark, sf_dir)["phrases"]


def t_tag_keywords(spark, sf_dir):
    """T2 on the tag names themselves."""
    tags = _c(spark, sf_dir).tags()
    return sk.keyword_taxonomy(tags.select("Name", F.col("Name").alias("phrase"))).select("keyword", "Name", "n_tokens")


def t_taxonomy_keywords(spark, sf_dir):
    return _disc(spark, sf_dir)["taxonomy"].select("keyword", "Name", "n_tokens")


def t_phrase_tag(spark, sf_dir):
    m = _disc(spark, sf_dir)["mentions"]
    return m.groupBy("MessageId").agg(F.count(F.lit(1)).alias("n_mentions"),
                                      F.count_distinct("Name").alias("n_names"))


# ---- model ------------------------------------------------------------------------------
def m_features(spark, sf_dir):
    return _rounded(_population(spark, sf_dir).select("UserId", *mo.FEATURES, "Expert"))


def m_onehot(spark, sf_dir):
    """One named 0/1 column for each category of a string column."""
    return mo.one_hot(_c(spark, sf_dir).t.orders.select("o_orderkey", "o_orderpriority"), "o_orderpriority")


def m_index_encoding(spark, sf_dir):
    """The order days (some thousand categories) as frequency-ordered index and sparse one-hot vector."""
    days = _c(spark, sf_dir).t.orders.select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))
    out = mo.encode_categorical(days, "day")
    return out.select("o_orderkey", "day", "day_index", F.col("day_vector.size").alias("n_categories"),
                      F.try_element_at("day_vector.indices", F.lit(1)).alias("hot"),
                      F.size("day_vector.values").alias("n_hot"))


def m_linear_score(spark, sf_dir):
    return _rounded(_scored_population(spark, sf_dir).select("UserId", "ExpertiseScore", "ExpertisePred"))


def m_metrics(spark, sf_dir):
    return _rounded(mo.binary_metrics(_holdout_predictions(spark, sf_dir)))


def m_auc(spark, sf_dir):
    return _rounded(mo.roc_auc(_holdout_predictions(spark, sf_dir)))


def _fitted(spark, sf_dir):
    """The model of the hash split's training part."""
    split = mo.holdout_split(co.model_inputs(_cohorts(spark, sf_dir)["train"]))
    return mo.fit(split.filter(F.col("is_holdout") == 0)), split.filter(F.col("is_holdout") == 1)


def m_coefficients(spark, sf_dir):
    """M6: intercept and coefficients of the fitted model."""
    return _rounded(mo.coefficients(_fitted(spark, sf_dir)[0], spark))


def m_logistic_fit_score(spark, sf_dir):
    """M5: every active user scored by the fitted model."""
    model, _ = _fitted(spark, sf_dir)
    return _rounded(mo.score(model, _population(spark, sf_dir)).select("UserId", "ExpertisePred", "ExpertiseScore"))


def m_fitted_metrics(spark, sf_dir):
    """M7-M11 of the fitted model on the holdout."""
    model, holdout = _fitted(spark, sf_dir)
    scored = materialize(mo.score(model, holdout).select("Expert", "ExpertisePred", "ExpertiseScore"))
    return _rounded(mo.binary_metrics(scored).withColumn("auc", mo.roc_auc(scored).scalar()))


# ---- composites --------------------------------------------------------------------------
def c_user_features(spark, sf_dir):
    return _rounded(_features(spark, sf_dir))


def c_cohorts(spark, sf_dir):
    return co.model_inputs(_cohorts(spark, sf_dir)["train"]).select("UserId", "Expert", "Ranked")


def c_kernel_scores(spark, sf_dir):
    return a_tag_means(spark, sf_dir)


def c_comp_scores(spark, sf_dir):
    c = _c(spark, sf_dir)
    return _rounded(sk.competition_skill_scores(c.teams(), c.competition_tags(), c.tags(), c.team_memberships()))


def c_skill_scores_raw(spark, sf_dir):
    """The score store: one folder for each tag, so that a search reads one folder."""
    return _kept(spark, sf_dir, "skill_scores", lambda: sk.skill_scores(_c(spark, sf_dir), keep=_keeper(spark, sf_dir)),
                 lambda df: store_by(df, "Name"))


def c_skill_scores(spark, sf_dir):
    return _rounded(c_skill_scores_raw(spark, sf_dir))


def c_users_and_skills(spark, sf_dir):
    """J23 + P7: every active user with each of their skills (or none) and
    CombinedScore = 0.25 * ExpertiseScore + 0.75 * SkillScore."""
    uas = se.users_and_skills(_scored_population(spark, sf_dir), c_skill_scores_raw(spark, sf_dir))
    return _rounded(uas.select("UserId", "Name", "ExpertiseScore", "SkillScore", "CombinedScore"))


def c_expert_search(spark, sf_dir):
    users = _scored_population(spark, sf_dir)
    return _rounded(se.expertise_finding(users, c_skill_scores_raw(spark, sf_dir), SEARCH_SKILL))


def c_fitted_search(spark, sf_dir):
    """C9 + C12: fit on the training part, score every user with the fit, and
    search with that score."""
    model, _ = _fitted(spark, sf_dir)
    users = mo.score(model, _population(spark, sf_dir))
    return _rounded(se.expertise_finding(users, c_skill_scores_raw(spark, sf_dir), SEARCH_SKILL))


QUERIES = {name: fn for name, fn in list(globals().items())
           if callable(fn) and name[:2] in ("s_", "p_", "f_", "j_", "a_", "w_", "o_", "u_", "t_", "m_", "c_")
           and name != "c_skill_scores_raw"}
