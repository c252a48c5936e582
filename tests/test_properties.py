"""Properties from the survey's test strategy on the sf0.001 tables."""

from pyspark.sql import functions as F

from locations import SF_SMALL
from skillscope.plans import cohorts as co
from skillscope.plans import features as fe
from skillscope.plans import skills as sk
from skillscope.session import materialize
from skillscope.sources.bindings import community


def test_cohort_properties(spark):
    c = community(spark, SF_SMALL)
    feats = materialize(fe.user_features(c))
    parts = co.cohorts(feats)
    train = {r["UserId"] for r in parts["train"].select("UserId").collect()}
    unlabelled = {r["UserId"] for r in parts["unlabelled"].select("UserId").collect()}
    assert not (train & unlabelled)
    assert parts["non_experts_downsampled"].count() <= parts["experts"].count()
    pop = co.population(parts).groupBy("UserId").count()
    assert pop.filter("count <> 1").count() == 0
    assert pop.count() == fe.active_users(c.users()).count()
    # every percentile lies in [0, 1]
    pct_cols = ["KernelsViewsPerRanking", "KernelsCommentsPerRanking", "KernelsVotesPerRanking",
                "CompetitionPerRanking", "DiscussionPerRanking", "ScriptPerRanking"]
    bad = feats.filter(F.exists(F.array(*pct_cols), lambda x: (x < 0) | (x > 1)))
    assert bad.count() == 0


def test_union_form_equals_full_outer_joins(spark):
    c = community(spark, SF_SMALL)
    tags = c.tags()
    kernel = sk.kernel_skill_scores(c.kernels(), c.kernel_tags(), tags)
    comp = sk.competition_skill_scores(c.teams(), c.competition_tags(), tags, c.team_memberships())
    disc = sk.discussion_pipeline(c)["scores"]
    union_form = sk.combine_skill_scores(comp, kernel, disc)
    joined = (comp.join(kernel, ["UserId", "Name"], "full").join(disc, ["UserId", "Name"], "full")
              .fillna(0.0, subset=["CompScore", "KernelScore", "DiscScore"]))
    joined = joined.withColumn("SkillScore", (F.col("CompScore") + F.col("KernelScore") + F.col("DiscScore")) / 3)
    cols = ["UserId", "Name", "CompScore", "KernelScore", "DiscScore", "SkillScore"]
    a = sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in union_form.select(*cols).collect())
    b = sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in joined.select(*cols).collect())
    assert a == b and len(a) > 0


def test_mentions_never_overlap(spark):
    """Within a message, chosen matches cover disjoint token spans."""
    from skillscope.functions.stem import stemmed_vocabulary
    from skillscope.functions.text import stemmed_tokens
    from skillscope.operators.tagging import tag_documents
    c = community(spark, SF_SMALL)
    tokens = sk.message_tokens(c.forum_messages())
    tax = materialize(sk.keyword_taxonomy(sk.phrase_taxonomy(tokens, stemmed_vocabulary(tokens), c.tags())))
    kwset = {r["keyword"]: r["Name"] for r in tax.collect()}
    docs = c.t.documents.select("doc_id", stemmed_tokens("text").alias("tokens"))
    names = {r["doc_id"]: r["names"] for r in tag_documents(docs, "tokens", ["doc_id"], tax).collect()}
    assert names
    chosen = docs.collect()
    for r in chosen:
        # re-walk the tokens greedily: the chosen keywords must appear in order without overlap
        toks, i, out = r["tokens"], 0, []
        while i < len(toks):
            two = " ".join(toks[i:i + 2]) if i + 1 < len(toks) else None
            if two in kwset:
                out.append(kwset[two])
                i += 2
            elif toks[i] in kwset:
                out.append(kwset[toks[i]])
                i += 1
            else:
                i += 1
        assert out == list(names.get(r["doc_id"], []))


def test_radix_selection_equals_a_sort(spark):
    from skillscope.operators.sampling import cap_by_hash, key_hash, kth_hash
    df = spark.range(3000).select(F.when(F.col("id") % 50 > 0, F.col("id")).alias("k"), "id")
    hashes = sorted((r.h, r.k) for r in df.filter("k IS NOT NULL").select(key_hash("k").alias("h"), "k").collect())
    for n in (0, 1, 700, 2940, 5000):
        kept = cap_by_hash(df, "k", F.lit(n))
        assert kept.columns == df.columns
        assert sorted(r.k for r in kept.collect()) == sorted(k for _, k in hashes[:n])
    assert spark.range(1).select(kth_hash(df, "k", F.lit(700)).alias("h")).first().h == hashes[699][0]
    assert cap_by_hash(df.limit(0), "k", F.lit(5)).count() == 0
    plan = cap_by_hash(df, "k", F.lit(700))._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "hashpartitioning(k" not in plan and "rangepartitioning" not in plan


def test_top_in_each_keeps_the_best_before_the_shuffle(spark):
    df = spark.range(5000).select(F.when(F.col("id") % 3 > 0, "hot").when(F.col("id") % 2 == 0, F.lit("other")).alias("g"),
                                  "id", ((F.col("id") * 7919) % 101).alias("s"))
    top = sk.top_in_each(df, "g", [F.col("s").desc(), F.col("id")], 4)
    rows = [tuple(r) for r in df.collect()]
    want = {(g, i, s, n + 1) for k in {r[0] for r in rows}
            for n, (g, i, s) in enumerate(sorted([r for r in rows if r[0] == k], key=lambda r: (-r[2], r[1]))[:4])}
    assert {tuple(r) for r in top.collect()} == want
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and plan.index("Final") < plan.index("Exchange") < plan.index("Partial")


def test_a_search_reads_one_folder_of_the_store(spark):
    from skillscope import catalog
    catalog.c_skill_scores_raw(spark, SF_SMALL)
    plan = catalog.c_expert_search(spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    scans = [x for x in plan.split("\n") if "/store-" in x]
    assert scans and all("PartitionFilters: [isnotnull(Name" in x and "= blue rod)" in x for x in scans)
    assert "documents.parquet" not in plan and "Message" not in plan


def test_store_keeps_rows_types_and_column_order(spark):
    from skillscope.session import store_by
    df = spark.createDataFrame([("1", 1), ("a/b=c %", 2), (None, 3), ("1", 4)], "g string, x int")
    kept = store_by(df, "g")
    assert kept.dtypes == df.dtypes and sorted(map(str, kept.collect())) == sorted(map(str, df.collect()))


def test_factorised_means_equal_the_fan_out(spark):
    c = community(spark, SF_SMALL)
    tags = c.tags()
    rows = sk.team_member_tag_rows(c.teams(), c.competition_tags(), tags, c.team_memberships())
    plain = rows.filter("UserId IS NOT NULL AND Name IS NOT NULL").groupBy("UserId", "Name").agg(F.avg("CompScore").alias("m"))
    got = sk.competition_skill_scores(c.teams(), c.competition_tags(), tags, c.team_memberships())
    both = got.join(plain, ["UserId", "Name"], "full")
    assert both.count() > 0 and both.filter("CompScore IS NULL OR m IS NULL OR abs(CompScore - m) > 1e-12").isEmpty()
