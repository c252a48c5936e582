"""DuckDB oracle SQL, one statement per registered query.

Every statement starts from the binding CTEs (``bindings_sql.BINDINGS``) and
re-derives the result with plain SQL windows and joins: ``percent_rank()``
over whole tables, ``row_number()`` for ordering, a closed form for the
leftmost-longest tagging of phrases of at most two tokens.  Doubles are
rounded to 6 digits, like the Spark side.
"""

from __future__ import annotations

from html.entities import name2codepoint

from .bindings_sql import with_bindings

# Values shared with the Spark side because they are the specification.
from skillscope.config import FIXED_INTERCEPT, FIXED_WEIGHTS

SAMPLE_LIMIT = int(0.2 * float(1 << 60))
HOLDOUT_LIMIT = int(0.2 * (1 << 32))
SEARCH_SKILL = "Blue Rod"


def hk(col: str) -> str:
    return f"('0x' || substr(md5(CAST({col} AS VARCHAR)), 1, 15))::BIGINT"


def hsplit(col: str) -> str:
    return f"('0x' || substr(md5(CAST({col} AS VARCHAR)), 17, 8))::BIGINT"


def sq(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


# ---- text expressions (DuckDB dialect), written from SURVEY F11-F18 ------------------
_NAMES = "MAP {" + ", ".join(f"'{k}': {v}" for k, v in sorted({**name2codepoint, "apos": 39}.items())) + "}"


def decoded(x: str) -> str:
    code = (f"CASE WHEN regexp_matches(p, '^#[0-9]{{1,7}};') THEN CAST(regexp_extract(p, '^#([0-9]+);', 1) AS INTEGER) "
            f"WHEN regexp_matches(p, '^#[xX][0-9a-fA-F]{{1,6}};') "
            f"THEN CAST('0x' || regexp_extract(p, '^#[xX]([0-9a-fA-F]+);', 1) AS INTEGER) "
            f"ELSE ({_NAMES})[regexp_extract(p, '^([a-zA-Z][a-zA-Z0-9]*);', 1)] END")
    char = (f"chr(CASE WHEN ({code}) BETWEEN 1 AND 1114111 AND NOT ({code}) BETWEEN 55296 AND 57343 THEN ({code}) "
            f"ELSE 65533 END)")
    return (f"array_to_string(list_transform(string_split({x}, '&'), lambda p, i: CASE WHEN i = 1 THEN p "
            f"WHEN ({code}) IS NULL THEN '&' || p ELSE {char} || regexp_replace(p, '^[^;]*;', '') END), '')")


def normalized_text(x: str) -> str:
    s = x
    for pat in (r"(?is)<script[^>]*>.*?</script[^>]*>", r"(?is)<style[^>]*>.*?</style[^>]*>", r"(?s)<!--.*?-->",
                r"<[a-zA-Z/!][^>]*>"):
        s = f"regexp_replace({s}, {sq(pat)}, ' ', 'g')"
    s = f"(CASE WHEN contains({x}, '<') OR contains({x}, '&') THEN {decoded(s)} ELSE {x} END)"
    return f"regexp_replace({spaced(s)}, 'https?://[^ ]+', '', 'g')"


def spaced(x: str) -> str:
    return f"regexp_replace({x}, '[\\t\\n\\x0B\\f\\r\\p{{Z}}]+', ' ', 'g')"


def word_tokens(x: str) -> str:
    s = f"regexp_replace({x}, {sq(r'[][(){}<>;@#$%&?!"]|--+|[.][.][.]+')}, ' ', 'g')"
    s = f"regexp_replace({s}, '[:,]([^0-9]|$)', ' \\1', 'g')"
    s = f"regexp_replace({s}, '(?i)(''ll|''re|''ve|n''t|''s|''m|''d)([^a-zA-Z]|$)', ' \\1\\2', 'g')"
    return (f"list_transform(list_filter(string_split({s}, ' '), lambda w: regexp_matches(w, '[a-zA-Z]')), "
            f"lambda w: lower(regexp_replace(w, '[[:punct:]]', '', 'g')))")


# The published Snowball English steps, on a table of distinct words.  Fixed values of the algorithm.
_WORDS_APART = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl",
                "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
_AS_THEY_ARE = "sky news howe atlas cosmos bias andes".split()
_AFTER_1A = "inning outing canning herring earring proceed exceed succeed".split()
_SHORT = "([^aeiouy][aeiouy][^aeiouywxY]|^[aeiouy][^aeiouy])$"
_SECOND = [("ization", "ize"), ("ational", "ate"), ("fulness", "ful"), ("ousness", "ous"), ("iveness", "ive"),
           ("tional", "tion"), ("biliti", "ble"), ("lessli", "less"), ("entli", "ent"), ("ation", "ate"), ("alism", "al"),
           ("aliti", "al"), ("ousli", "ous"), ("iviti", "ive"), ("fulli", "ful"), ("enci", "ence"), ("anci", "ance"),
           ("abli", "able"), ("izer", "ize"), ("ator", "ate"), ("alli", "al"), ("bli", "ble"), ("ogi", "og"), ("li", "")]
_THIRD = [("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ative", ""),
          ("ical", "ic"), ("ness", ""), ("ful", "")]
_FOURTH = "ement ance ence able ible ment ant ent ism ate iti ous ive ize ion al er ic".split()


def _first_suffix(rules, condition) -> str:
    """CASE over suffixes, longest first: the first that fits decides, and rewrites only on its condition."""
    whens = []
    for suffix, repl in rules:
        rest = f"substr(w, 1, length(w) - {len(suffix)})"
        whens.append(f"WHEN suffix(w, {sq(suffix)}) THEN CASE WHEN {condition(suffix, rest)} THEN {rest} || {sq(repl)} ELSE w END")
    return f"CASE {' '.join(whens)} ELSE w END"


def stems(words: str, name: str) -> str:
    """CTEs that end in ``name`` (token, stem) for the distinct tokens of the query ``words``."""
    def second(suffix, rest):
        extra = {"ogi": f" AND suffix({rest}, 'l')", "li": f" AND regexp_matches({rest}, '[cdeghkmnrt]$')"}.get(suffix, "")
        return f"length({rest}) >= p1{extra}"

    def third(suffix, rest):
        return f"length({rest}) >= {'p2' if suffix == 'ative' else 'p1'}"

    def fourth(suffix, rest):
        return f"length({rest}) >= p2" + (f" AND regexp_matches({rest}, '[st]$')" if suffix == "ion" else "")

    region = "^[^aeiouy]*[aeiouy]+[^aeiouy]"
    apart = " ".join(f"WHEN {sq(k)} THEN {sq(v)}" for k, v in [*_WORDS_APART.items(), *[(w, w) for w in _AS_THEY_ARE]])
    steps = [
        f"SELECT token, regexp_replace(regexp_replace(token, '^y', 'Y'), '([aeiouy])y', '\\1Y', 'g') AS w FROM ({words})",
        f"""SELECT *, CASE WHEN regexp_matches(w, '^(gener|commun|arsen)') THEN length(regexp_extract(w, '^(gener|commun|arsen)'))
              WHEN regexp_matches(w, '{region}') THEN length(regexp_extract(w, '{region}')) ELSE length(w) END AS p1 FROM @""",
        f"""SELECT *, CASE WHEN regexp_matches(substr(w, p1 + 1), '{region}')
              THEN p1 + length(regexp_extract(substr(w, p1 + 1), '{region}')) ELSE length(w) END AS p2 FROM @""",
        """SELECT * REPLACE (CASE WHEN suffix(w, 'sses') THEN substr(w, 1, length(w) - 2)
              WHEN suffix(w, 'ied') OR suffix(w, 'ies') THEN substr(w, 1, length(w) - CASE WHEN length(w) > 4 THEN 2 ELSE 1 END)
              WHEN suffix(w, 'us') OR suffix(w, 'ss') THEN w
              WHEN regexp_matches(w, '[aeiouy].+s$') THEN substr(w, 1, length(w) - 1) ELSE w END AS w) FROM @""",
        f"SELECT *, CASE WHEN w IN ({', '.join(map(sq, _AFTER_1A))}) THEN w END AS done FROM @",
        """SELECT *, CASE WHEN suffix(w, 'eedly') THEN 5 WHEN suffix(w, 'ingly') THEN 5 WHEN suffix(w, 'edly') THEN 4
              WHEN suffix(w, 'eed') OR suffix(w, 'ing') THEN 3 WHEN suffix(w, 'ed') THEN 2 ELSE 0 END AS cut FROM @""",
        "SELECT *, substr(w, 1, length(w) - cut) AS rest, suffix(w, 'eed') OR suffix(w, 'eedly') AS eed FROM @",
        f"""SELECT token, p1, p2, done, CASE WHEN cut = 0 THEN w
              WHEN eed THEN CASE WHEN length(rest) >= p1 THEN rest || 'ee' ELSE w END
              WHEN NOT regexp_matches(rest, '[aeiouy]') THEN w
              WHEN regexp_matches(rest, '(at|bl|iz)$') THEN rest || 'e'
              WHEN regexp_matches(rest, '(bb|dd|ff|gg|mm|nn|pp|rr|tt)$') THEN substr(rest, 1, length(rest) - 1)
              WHEN length(rest) <= p1 AND regexp_matches(rest, '{_SHORT}') THEN rest || 'e' ELSE rest END AS w FROM @""",
        """SELECT * REPLACE (CASE WHEN regexp_matches(w, '^.+[^aeiouy][yY]$') THEN substr(w, 1, length(w) - 1) || 'i'
              ELSE w END AS w) FROM @""",
        f"SELECT * REPLACE ({_first_suffix(_SECOND, second)} AS w) FROM @",
        f"SELECT * REPLACE ({_first_suffix(_THIRD, third)} AS w) FROM @",
        f"SELECT * REPLACE ({_first_suffix([(x, '') for x in _FOURTH], fourth)} AS w) FROM @",
        f"""SELECT * REPLACE (CASE WHEN suffix(w, 'e') AND (length(w) - 1 >= p2 OR (length(w) - 1 >= p1
                AND NOT regexp_matches(substr(w, 1, length(w) - 1), '{_SHORT}'))) THEN substr(w, 1, length(w) - 1)
              WHEN suffix(w, 'll') AND length(w) - 1 >= p2 THEN substr(w, 1, length(w) - 1) ELSE w END AS w) FROM @"""]
    out = [f"{name}_{i} AS ({s.replace('@', f'{name}_{i - 1}')})" for i, s in enumerate(steps)]
    out.append(f"""{name} AS MATERIALIZED (SELECT token, CASE WHEN length(token) <= 2 THEN token ELSE CASE token {apart}
      ELSE replace(coalesce(done, w), 'Y', 'y') END END AS stem FROM {name}_{len(steps) - 1})""")
    return ",\n".join(out)


def clean_tokens(x: str) -> str:
    return word_tokens(normalized_text(x))


def keywords(source: str, phrase: str, name: str) -> str:
    """CTEs that end in ``name`` (keyword, Name, n_tokens) for the phrases of the table ``source``."""
    return f"""
{name}_words AS (
  SELECT Name, {phrase} AS phrase, unnest(t) AS token, generate_subscripts(t, 1) AS i
  FROM (SELECT Name, {phrase}, {word_tokens(spaced(phrase))} AS t FROM {source})),
{stems(f"SELECT DISTINCT token FROM {name}_words", name + "_stems")},
{name}_joined AS (
  SELECT w.Name, string_agg(s.stem, ' ' ORDER BY w.i) AS keyword
  FROM {name}_words w JOIN {name}_stems s ON s.token = w.token GROUP BY w.Name, w.phrase),
{name} AS (
  SELECT keyword, min(Name) AS Name, CAST(len(string_split(keyword, ' ')) AS INTEGER) AS n_tokens
  FROM {name}_joined WHERE length(keyword) > 0 GROUP BY keyword)"""


def r6(e: str, name: str) -> str:
    return f"round({e}, 6) AS \"{name}\""


def _words_of_messages() -> str:
    x = "Message"
    for pat in (r"(?is)<script[^>]*>.*?</script[^>]*>", r"(?is)<style[^>]*>.*?</style[^>]*>", r"(?s)<!--.*?-->",
                r"<[a-zA-Z/!][^>]*>"):
        x = f"regexp_replace({x}, {sq(pat)}, ' ', 'g')"
    x = f"(CASE WHEN contains(Message, '<') OR contains(Message, '&') THEN {decoded(x)} ELSE Message END)"
    return f"list_filter(string_split({spaced(x)}, ' '), lambda w: w <> '')"


# F16: words in order, abbreviations by counts, ends of sentences.
SENTENCES = f"""
texts AS (SELECT MessageId, {_words_of_messages()} AS t FROM forum_messages WHERE Message IS NOT NULL),
each AS MATERIALIZED (SELECT MessageId, unnest(t) AS w, generate_subscripts(t, 1) - 1 AS i, len(t) AS n FROM texts),
named AS (
  SELECT *, lower(regexp_extract(w, '^["''(\\[]*((?:\\p{{L}}+[.])*\\p{{L}}+)[.]$', 1)) AS dotted,
         lower(regexp_extract(w, '^["''(\\[]*((?:\\p{{L}}+[.])*\\p{{L}}+)[,;:!?"'')\\]]*$', 1)) AS plain,
         lead(w) OVER (PARTITION BY MessageId ORDER BY i) AS after FROM each),
abbr AS (
  SELECT CASE WHEN dotted <> '' THEN dotted ELSE plain END AS word, count(*) FILTER (WHERE dotted <> '') AS n_dotted,
         count(*) FILTER (WHERE dotted = '') AS n_plain
  FROM named GROUP BY 1 HAVING length(word) BETWEEN 1 AND 6 AND n_dotted >= 3 AND n_dotted >= 0.75 * (n_dotted + n_plain)),
ends AS (
  SELECT MessageId, i FROM named
  WHERE i = n - 1 OR (regexp_matches(w, '[.!?]["''\u2019\u201D\u00BB)\\]]*$')
    AND regexp_matches(after, '^["''\u2018\u201C\u00AB(\\[]*[\\p{{Lu}}\\p{{N}}]')
    AND dotted NOT IN (SELECT word FROM abbr)))
"""

# ---- shared CTE blocks ---------------------------------------------------------------
FEATURES = """
active_users AS (SELECT * FROM users WHERE PerformanceTier IN (1, 2, 3, 4, 5)),
f_orgs AS (SELECT UserId, count(DISTINCT OrganizationId) AS NumOrgs FROM user_organizations GROUP BY UserId),
f_fol AS (SELECT UserId, count(DISTINCT FollowingUserId) AS NumFollowers FROM user_followers GROUP BY UserId),
membership AS (
  SELECT u.UserId, coalesce(o.NumOrgs, 0) AS NumOrgs, coalesce(f.NumFollowers, 0) AS NumFollowers
  FROM active_users u LEFT JOIN f_orgs o ON o.UserId = u.UserId LEFT JOIN f_fol f ON f.UserId = u.UserId),
medal_rows AS (
  SELECT u.UserId, a.AchievementType, CAST(sum(a.TotalGold) AS BIGINT) AS g, CAST(sum(a.TotalSilver) AS BIGINT) AS s,
         CAST(sum(a.TotalBronze) AS BIGINT) AS b
  FROM active_users u LEFT JOIN user_achievements a ON a.UserId = u.UserId GROUP BY u.UserId, a.AchievementType),
medals AS (
  SELECT u.UserId,
    d.g AS TotalGoldDisc, d.s AS TotalSilverDisc, d.b AS TotalBronzeDisc, d.g + d.s + d.b AS TotalDisc,
    c.g AS TotalGoldComp, c.s AS TotalSilverComp, c.b AS TotalBronzeComp, c.g + c.s + c.b AS TotalComp,
    x.g AS TotalGoldScript, x.s AS TotalSilverScript, x.b AS TotalBronzeScript, x.g + x.s + x.b AS TotalScript,
    (d.g + d.s + d.b) + (c.g + c.s + c.b) + (x.g + x.s + x.b) AS TotalMedals
  FROM active_users u
  LEFT JOIN medal_rows d ON d.UserId = u.UserId AND d.AchievementType = 'Discussion'
  LEFT JOIN medal_rows c ON c.UserId = u.UserId AND c.AchievementType = 'Competitions'
  LEFT JOIN medal_rows x ON x.UserId = u.UserId AND x.AchievementType = 'Scripts'),
kernel_user AS (
  SELECT u.UserId, count(DISTINCT k.KernelId) AS KernelsCreated, coalesce(avg(k.TotalViews), 0) AS KernelsAvgViews,
         coalesce(avg(k.TotalComments), 0) AS KernelsAvgComments, coalesce(avg(k.TotalVotes), 0) AS KernelsAvgVotes
  FROM active_users u LEFT JOIN kernels k ON k.UserId = u.UserId GROUP BY u.UserId),
kernel_feat0 AS (
  SELECT UserId, KernelsCreated,
    percent_rank() OVER (ORDER BY KernelsAvgViews) AS KernelsViewsPerRanking,
    percent_rank() OVER (ORDER BY KernelsAvgComments) AS KernelsCommentsPerRanking,
    percent_rank() OVER (ORDER BY KernelsAvgVotes) AS KernelsVotesPerRanking
  FROM kernel_user),
kernel_feat AS (
  SELECT *, (KernelsViewsPerRanking + KernelsCommentsPerRanking + KernelsVotesPerRanking) / 3 AS UserKernelScore
  FROM kernel_feat0),
rank_pct AS (
  SELECT UserId, AchievementType,
         percent_rank() OVER (PARTITION BY AchievementType ORDER BY HighestRanking DESC) AS pr
  FROM user_achievements WHERE HighestRanking IS NOT NULL),
rankings AS (
  SELECT u.UserId,
    max(CASE WHEN r.AchievementType = 'Competitions' THEN r.pr END) AS CompetitionPerRanking,
    max(CASE WHEN r.AchievementType = 'Discussion' THEN r.pr END) AS DiscussionPerRanking,
    max(CASE WHEN r.AchievementType = 'Scripts' THEN r.pr END) AS ScriptPerRanking
  FROM active_users u LEFT JOIN rank_pct r ON r.UserId = u.UserId GROUP BY u.UserId),
features AS (
  SELECT u.UserId, u.UserName, u.DisplayName, u.PerformanceTier, m.NumOrgs, m.NumFollowers,
    md.TotalGoldDisc, md.TotalSilverDisc, md.TotalBronzeDisc, md.TotalDisc,
    md.TotalGoldComp, md.TotalSilverComp, md.TotalBronzeComp, md.TotalComp,
    md.TotalGoldScript, md.TotalSilverScript, md.TotalBronzeScript, md.TotalScript, md.TotalMedals,
    kf.KernelsCreated, kf.KernelsViewsPerRanking, kf.KernelsCommentsPerRanking, kf.KernelsVotesPerRanking,
    kf.UserKernelScore, r.CompetitionPerRanking, r.DiscussionPerRanking, r.ScriptPerRanking
  FROM active_users u JOIN membership m ON m.UserId = u.UserId JOIN medals md ON md.UserId = u.UserId
  JOIN kernel_feat kf ON kf.UserId = u.UserId JOIN rankings r ON r.UserId = u.UserId)
"""

COHORTS = FEATURES.rstrip() + f""",
experts AS (
  SELECT *, 1 AS Expert FROM features
  WHERE (CompetitionPerRanking > 0 OR ScriptPerRanking >= 0 OR DiscussionPerRanking >= 0)
    AND PerformanceTier > 1 AND NumFollowers >= 5
    AND (TotalDisc >= 2 OR TotalComp >= 2 OR TotalScript >= 2)
    AND KernelsCreated >= 3 AND TotalMedals >= 3),
non_experts AS (
  SELECT *, 0 AS Expert FROM features
  WHERE CompetitionPerRanking IS NULL AND ScriptPerRanking IS NULL AND DiscussionPerRanking IS NULL
    AND PerformanceTier = 1 AND NumFollowers < 5 AND TotalDisc <= 1 AND TotalComp <= 1 AND TotalScript <= 1
    AND KernelsCreated < 2 AND UserKernelScore <= 0.25),
ne_sample AS (SELECT * FROM non_experts WHERE {hk('UserId')} < {SAMPLE_LIMIT}),
ne_down AS (
  SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (ORDER BY {hk('UserId')}) AS rn FROM non_experts)
  WHERE rn <= (SELECT count(*) FROM experts)),
train AS (SELECT * FROM experts UNION ALL BY NAME SELECT * FROM ne_down),
unlabelled AS (SELECT f.* FROM features f WHERE NOT EXISTS (SELECT 1 FROM train t WHERE t.UserId = f.UserId)),
population AS (SELECT * FROM train UNION ALL BY NAME SELECT * FROM unlabelled)
"""


def model_inputs(src: str, name: str) -> str:
    fill = ["NumOrgs", "NumFollowers", "TotalGoldDisc", "TotalSilverDisc", "TotalBronzeDisc", "TotalDisc",
            "TotalGoldComp", "TotalSilverComp", "TotalBronzeComp", "TotalComp", "TotalGoldScript",
            "TotalSilverScript", "TotalBronzeScript", "TotalScript", "TotalMedals", "KernelsCreated",
            "KernelsViewsPerRanking", "KernelsCommentsPerRanking", "KernelsVotesPerRanking", "UserKernelScore",
            "CompetitionPerRanking", "DiscussionPerRanking", "ScriptPerRanking"]
    repl = ", ".join(f"coalesce({c}, 0) AS {c}" for c in fill)
    return f"""
{name}_f AS (SELECT * REPLACE ({repl}) FROM {src}),
{name} AS (
  SELECT *, (CompetitionPerRanking + DiscussionPerRanking + ScriptPerRanking) / 3 AS AvgPerRanking,
         CASE WHEN (CompetitionPerRanking + DiscussionPerRanking + ScriptPerRanking) / 3 > 0 THEN 1 ELSE 0 END AS Ranked
  FROM {name}_f)"""


def linear(src: str, name: str) -> str:
    feats = ["NumFollowers", "TotalMedals", "KernelsCreated", "UserKernelScore", "Ranked"]
    z = f"CAST({FIXED_INTERCEPT!r} AS DOUBLE)"
    for f, w in zip(feats, FIXED_WEIGHTS):
        z = f"({z} + {float(w)!r} * CAST({f} AS DOUBLE))"
    return f"""
{name}_z AS (SELECT *, 1.0 / (1.0 + exp(-{z})) AS ExpertiseScore FROM {src}),
{name} AS (SELECT *, CASE WHEN ExpertiseScore > 0.5 THEN 1 ELSE 0 END AS ExpertisePred FROM {name}_z)"""


MODEL = COHORTS.rstrip() + "," + model_inputs("train", "train_in") + "," + model_inputs(
    "population", "pop_in") + "," + linear("pop_in", "scored") + f""",
holdout AS (SELECT * FROM train_in WHERE {hsplit('UserId')} < {HOLDOUT_LIMIT}),""" + linear("holdout", "holdout_pred")

def fitted(rounds: int = 20) -> str:
    """CTEs up to ``fit`` (w0..w5): Newton rounds from zero, each an aggregate of the training rows and an elimination of
    the 6 x 6 system, column by column."""
    feats = ["NumFollowers", "TotalMedals", "KernelsCreated", "UserKernelScore", "Ranked"]
    n = len(feats) + 1
    out = ["fit_rows AS MATERIALIZED (SELECT CAST(1 AS DOUBLE) AS x0, "
           + ", ".join(f"CAST({f} AS DOUBLE) AS x{i + 1}" for i, f in enumerate(feats))
           + f", CAST(Expert AS DOUBLE) AS y FROM train_in WHERE NOT {hsplit('UserId')} < {HOLDOUT_LIMIT})",
           "fit0 AS (SELECT " + ", ".join(f"CAST(0 AS DOUBLE) AS w{i}" for i in range(n)) + ")"]
    for r in range(rounds):
        z = " + ".join(f"w{i} * x{i}" for i in range(n))
        ridge = {(i, i): " + 1" for i in range(1, n)}
        sums = [f"sum(v * x{i} * x{j}){ridge.get((i, j), '')} AS a{i}_{j}" for i in range(n) for j in range(n)]
        sums += [f"sum((p - y) * x{i})" + (f" + any_value(w{i})" if i else "") + f" AS a{i}_{n}" for i in range(n)]
        keep = ", ".join(f"any_value(w{i}) AS w{i}" for i in range(n))
        out.append(f"sys{r}_0 AS MATERIALIZED (SELECT {keep}, {', '.join(sums)} FROM (SELECT *, p * (1 - p) AS v FROM "
                   f"(SELECT *, 1 / (1 + exp(-({z}))) AS p FROM fit_rows, fit{r})))")
        for k in range(n):
            cells = [f"w{i}" for i in range(n)]
            for i in range(n):
                for j in range(k + 1, n + 1):
                    cells.append(f"a{k}_{j} / a{k}_{k} AS a{k}_{j}" if i == k else
                                 f"a{i}_{j} - a{i}_{k} * a{k}_{j} / a{k}_{k} AS a{i}_{j}")
            out.append(f"sys{r}_{k + 1} AS MATERIALIZED (SELECT {', '.join(cells)} FROM sys{r}_{k})")
        out.append(f"fit{r + 1} AS MATERIALIZED (SELECT " + ", ".join(f"w{i} - a{i}_{n} AS w{i}" for i in range(n)) + f" FROM sys{r}_{n})")
    out.append(f"fit AS (SELECT * FROM fit{rounds})")
    return ",\n".join(out)


def fitted_score(src: str, name: str) -> str:
    return f"""
{name} AS (
  SELECT * EXCLUDE (p), p AS ExpertiseScore, CASE WHEN p > 0.5 THEN 1 ELSE 0 END AS ExpertisePred
  FROM (SELECT s.*, 1 / (1 + exp(-(w0 + w1 * NumFollowers + w2 * TotalMedals + w3 * KernelsCreated
                                   + w4 * UserKernelScore + w5 * Ranked))) AS p FROM {src} s, fit))"""


FIT = (COHORTS.rstrip() + "," + model_inputs("train", "train_in") + "," + model_inputs("population", "pop_in") + ","
       + fitted() + "," + fitted_score("pop_in", "scored") + f""",
holdout AS (SELECT * FROM train_in WHERE {hsplit('UserId')} < {HOLDOUT_LIMIT}),""" + fitted_score("holdout", "holdout_pred"))

METRICS = """
SELECT round(avg((Expert - ExpertisePred) * (Expert - ExpertisePred)), 6) AS mse,
  round(avg(CASE WHEN Expert = ExpertisePred THEN 1.0 ELSE 0.0 END), 6) AS accuracy,
  round(CASE WHEN sum(ExpertisePred) > 0 THEN sum(Expert * ExpertisePred) / sum(ExpertisePred) ELSE 0.0 END, 6) AS precision,
  round(CASE WHEN sum(Expert) > 0 THEN sum(Expert * ExpertisePred) / sum(Expert) ELSE 0.0 END, 6) AS recall,
  round((sum(Expert * ExpertisePred) / sum(Expert) + sum((1 - Expert) * (1 - ExpertisePred)) / sum(1 - Expert)) / 2, 6)
    AS auc_hard
FROM holdout_pred"""

SKILLS = """
kernel_items0 AS (
  SELECT KernelId, UserId, TotalViews, TotalComments, TotalVotes,
    percent_rank() OVER (ORDER BY TotalViews ASC NULLS FIRST) AS KernelsViewsPercentile,
    percent_rank() OVER (ORDER BY TotalComments ASC NULLS FIRST) AS KernelsCommentsPercentile,
    percent_rank() OVER (ORDER BY TotalVotes ASC NULLS FIRST) AS KernelsVotesPercentile
  FROM kernels),
kernel_items AS (
  SELECT *, (KernelsViewsPercentile + KernelsCommentsPercentile + KernelsVotesPercentile) / 3 AS KernelScore
  FROM kernel_items0),
kernel_tag_rows AS (
  SELECT ki.KernelId, ki.UserId, ki.KernelScore, kt.TagId, t.Name
  FROM kernel_items ki JOIN kernel_tags kt ON kt.KernelId = ki.KernelId JOIN tags t ON t.TagId = kt.TagId
  WHERE t.Name IS NOT NULL),
kernel_scores AS (
  SELECT UserId, Name, avg(KernelScore) AS KernelScore FROM kernel_tag_rows WHERE UserId IS NOT NULL
  GROUP BY UserId, Name),
teams2 AS (SELECT TeamId, CompetitionId, Medal, PublicLeaderboardRank FROM teams WHERE ScoreFirstSubmittedDate IS NOT NULL),
team_scores0 AS (
  SELECT *, percent_rank() OVER (ORDER BY PublicLeaderboardRank DESC NULLS FIRST) AS RankPer,
         percent_rank() OVER (ORDER BY coalesce(Medal, 4) DESC) AS MedalPer
  FROM teams2),
team_scores AS (SELECT *, (RankPer + MedalPer) / 2 AS CompScore FROM team_scores0),
comp_rows AS (
  SELECT ts.TeamId, ts.CompetitionId, ts.CompScore, ct.TagId, t.Name, tm.UserId
  FROM team_scores ts JOIN competition_tags ct ON ct.CompetitionId = ts.CompetitionId
  JOIN tags t ON t.TagId = ct.TagId JOIN team_memberships tm ON tm.TeamId = ts.TeamId),
comp_scores AS (
  SELECT UserId, Name, avg(CompScore) AS CompScore FROM comp_rows
  WHERE UserId IS NOT NULL AND Name IS NOT NULL GROUP BY UserId, Name)
"""

DISC = f"""
en_tokens AS (SELECT doc_id, {clean_tokens('text')} AS t FROM documents),
phrase_cands AS (
  SELECT doc_id, unnest(list_distinct(list_concat(
    list_filter(t, lambda w: length(w) >= 4),
    [t[i] || ' ' || t[i + 1] FOR i IN range(1, len(t)) IF length(t[i]) >= 4 AND length(t[i + 1]) >= 4]))) AS phrase
  FROM en_tokens),
phrase_freq AS (SELECT phrase, count(*) AS doc_count FROM phrase_cands GROUP BY phrase),
phrase_top AS (
  SELECT * FROM (SELECT phrase, doc_count, row_number() OVER (ORDER BY doc_count DESC, phrase ASC) AS rn FROM phrase_freq)
  WHERE rn <= (SELECT count(*) FROM tags)),
phrases AS (SELECT t.TagId, t.Name, p.phrase, p.doc_count FROM tags t JOIN phrase_top p ON p.rn = t.TagId),
{keywords('phrases', 'phrase', 'taxonomy').strip()},
messages AS (
  SELECT m.MessageId, m.UserId, m.ForumTopicId, f.Title, m.Message
  FROM forum_messages m JOIN forum_topics tp ON tp.ForumTopicId = m.ForumTopicId JOIN forums f ON f.ForumId = tp.ForumId
  WHERE m.Message IS NOT NULL),
msg_tokens AS (SELECT MessageId, UserId, {clean_tokens('Message')} AS s FROM messages),
msg_words AS MATERIALIZED (SELECT MessageId, UserId, unnest(s) AS token, generate_subscripts(s, 1) AS i FROM msg_tokens),
{stems("SELECT DISTINCT token FROM msg_words", "msg_stems")},
positions AS (SELECT m.MessageId, m.UserId, s.stem AS w, m.i FROM msg_words m JOIN msg_stems s ON s.token = m.token),
pos2 AS (SELECT *, lead(w) OVER (PARTITION BY MessageId ORDER BY i) AS w_next FROM positions),
cand AS (
  SELECT p.MessageId, p.UserId, p.i, b.Name AS b_name, u.Name AS u_name
  FROM pos2 p
  LEFT JOIN (SELECT * FROM taxonomy WHERE n_tokens = 2) b ON b.keyword = p.w || ' ' || p.w_next
  LEFT JOIN (SELECT * FROM taxonomy WHERE n_tokens = 1) u ON u.keyword = p.w),
bruns AS (
  SELECT MessageId, i, i - row_number() OVER (PARTITION BY MessageId ORDER BY i) AS grp
  FROM cand WHERE b_name IS NOT NULL),
bstart AS (SELECT MessageId, i, min(i) OVER (PARTITION BY MessageId, grp) AS run_start FROM bruns),
chosen0 AS (
  SELECT c.*, (c.b_name IS NOT NULL AND (c.i - s.run_start) % 2 = 0) AS b_chosen
  FROM cand c LEFT JOIN bstart s ON s.MessageId = c.MessageId AND s.i = c.i),
chosen1 AS (
  SELECT *, coalesce(lag(b_chosen) OVER (PARTITION BY MessageId ORDER BY i), false) AS covered FROM chosen0),
mentions AS (
  SELECT MessageId, UserId, i, b_name AS Name FROM chosen1 WHERE b_chosen
  UNION ALL
  SELECT MessageId, UserId, i, u_name AS Name FROM chosen1 WHERE NOT b_chosen AND NOT covered AND u_name IS NOT NULL),
mention_counts AS (
  SELECT UserId, Name, count(*) AS Count FROM mentions WHERE UserId IS NOT NULL GROUP BY UserId, Name),
disc_scores AS (
  SELECT UserId, Name,
    (rank() OVER (PARTITION BY Name ORDER BY Count) + (count(*) OVER (PARTITION BY Name, Count) - 1) / 2.0)
      / count(*) OVER (PARTITION BY Name) AS DiscScore
  FROM mention_counts)
"""

DISC_HTML = (DISC.replace("FROM forum_messages m JOIN forum_topics tp", "FROM forum_messages_html m JOIN forum_topics_html tp")
             .replace("JOIN forums f ON", "JOIN forums_html f ON"))

SKILL_SCORES = SKILLS.rstrip() + "," + DISC.rstrip() + """,
skill_union AS (
  SELECT UserId, Name, CompScore, NULL::DOUBLE AS KernelScore, NULL::DOUBLE AS DiscScore FROM comp_scores
  UNION ALL SELECT UserId, Name, NULL, KernelScore, NULL FROM kernel_scores
  UNION ALL SELECT UserId, Name, NULL, NULL, DiscScore FROM disc_scores),
skill_scores0 AS (
  SELECT UserId, Name, coalesce(max(CompScore), 0) AS CompScore, coalesce(max(KernelScore), 0) AS KernelScore,
         coalesce(max(DiscScore), 0) AS DiscScore FROM skill_union GROUP BY UserId, Name),
skill_scores AS (SELECT *, (CompScore + KernelScore + DiscScore) / 3 AS SkillScore FROM skill_scores0)
"""


def q(ctes: str, select: str) -> str:
    return with_bindings(ctes, select)


FEATURE_DOUBLES = ["KernelsViewsPerRanking", "KernelsCommentsPerRanking", "KernelsVotesPerRanking", "UserKernelScore",
                   "CompetitionPerRanking", "DiscussionPerRanking", "ScriptPerRanking"]


def _feature_select() -> str:
    cols = ["UserId", "UserName", "DisplayName", "PerformanceTier", "NumOrgs", "NumFollowers",
            "TotalGoldDisc", "TotalSilverDisc", "TotalBronzeDisc", "TotalDisc",
            "TotalGoldComp", "TotalSilverComp", "TotalBronzeComp", "TotalComp",
            "TotalGoldScript", "TotalSilverScript", "TotalBronzeScript", "TotalScript", "TotalMedals",
            "KernelsCreated"]
    return ", ".join(cols + [r6(c, c) for c in FEATURE_DOUBLES])


def _search_select() -> str:
    title = SEARCH_SKILL.title() + " Score"
    ints = [("PerformanceTier", "Performance Tier"), ("NumOrgs", "# of Orgs"),
            ("KernelsCreated", "# of Kernels Created"), ("NumFollowers", "# of Followers"),
            ("TotalComp", "# of Competition Medals"), ("TotalDisc", "# of Discussion Medals"),
            ("TotalScript", "# of Script Medals"), ("TotalMedals", "# of Total Medals"), ("Ranked", "Ranked")]
    cols = ["CAST(row_number() OVER (ORDER BY CombinedScore DESC, UserId ASC) AS INTEGER) AS \"Rank\"",
            "DisplayName AS \"Name\"", r6("ExpertiseScore", "Expertise Score"), r6("SkillScore", title),
            r6("CombinedScore", "Combined Score")]
    cols += [f"CAST({a} AS INTEGER) AS \"{b}\"" for a, b in ints]
    return ", ".join(cols)


def _corr_select() -> str:
    cols = ["NumOrgs", "NumFollowers", "TotalMedals", "KernelsCreated", "UserKernelScore", "AvgPerRanking", "Expert"]
    parts = []
    for i, a in enumerate(cols):
        for b in cols[i + 1:]:
            parts.append(f"SELECT '{a}' AS a, '{b}' AS b, round(corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)), 6) "
                         f"AS corr FROM train_in")
    return " UNION ALL ".join(parts)


ORACLE = {
    # sources
    "s_scan_counts": q("", """
SELECT 'users' AS table_name, count(*) AS n_rows FROM users UNION ALL
SELECT 'user_organizations', count(*) FROM user_organizations UNION ALL
SELECT 'user_followers', count(*) FROM user_followers UNION ALL
SELECT 'user_achievements', count(*) FROM user_achievements UNION ALL
SELECT 'kernels', count(*) FROM kernels UNION ALL
SELECT 'tags', count(*) FROM tags UNION ALL
SELECT 'kernel_tags', count(*) FROM kernel_tags UNION ALL
SELECT 'teams', count(*) FROM teams UNION ALL
SELECT 'competition_tags', count(*) FROM competition_tags UNION ALL
SELECT 'team_memberships', count(*) FROM team_memberships UNION ALL
SELECT 'forum_messages', count(*) FROM forum_messages UNION ALL
SELECT 'forum_topics', count(*) FROM forum_topics UNION ALL
SELECT 'forums', count(*) FROM forums"""),
    "s_preview": q("", "SELECT * FROM users ORDER BY UserId LIMIT 20"),
    "s_csv_users": q("", "SELECT UserId, UserName, DisplayName, PerformanceTier FROM users"),
    "s_csv_messages": q("", "SELECT MessageId, ForumTopicId, UserId, Message FROM forum_messages"),
    # projections
    "p_rename_select": q("", "SELECT KernelId, UserId, TotalViews, TotalComments, TotalVotes FROM kernels"),
    "p_derived_scores": q(FEATURES, "SELECT UserId, TotalDisc, TotalComp, TotalScript, TotalMedals FROM medals"),
    "p_flags_casts": q(FEATURES.rstrip() + "," + model_inputs("features", "fi"),
                       "SELECT UserId, round(AvgPerRanking, 6) AS AvgPerRanking, CAST(Ranked AS DOUBLE) AS Ranked, "
                       "PerformanceTier FROM fi"),
    # filters
    "f_active_users": q("", "SELECT * FROM users WHERE PerformanceTier IN (1, 2, 3, 4, 5)"),
    "f_expert_rule": q(COHORTS, "SELECT UserId, Expert FROM experts"),
    "f_non_expert_rule": q(COHORTS, "SELECT UserId, Expert FROM non_experts"),
    "f_dropna_fillna": q("", "SELECT TeamId, CompetitionId, coalesce(Medal, 4) AS Medal, PublicLeaderboardRank "
                             "FROM teams WHERE ScoreFirstSubmittedDate IS NOT NULL"),
    "f_point_lookup": q("", "SELECT * FROM users WHERE UserName = 'Customer#000000001'"),
    "f_skill_list": q("", "SELECT Name FROM tags"),
    "f_user_skill_lookup": q(MODEL.rstrip() + "," + SKILL_SCORES, """
SELECT s.UserId, s.DisplayName, k.Name, round(k.DiscScore, 6) AS DiscScore, round(k.SkillScore, 6) AS SkillScore
FROM scored s JOIN skill_scores k ON k.UserId = s.UserId
WHERE s.UserId = 11 AND k.Name IN ('blue rod', 'cold gear', 'hot plate')"""),
    # joins
    "j_left_counts": q(FEATURES, "SELECT UserId, NumOrgs, NumFollowers FROM membership"),
    "j_inner_medals": q(FEATURES, "SELECT UserId, AchievementType, g AS TotalGold, s AS TotalSilver, "
                                  "b AS TotalBronze FROM medal_rows"),
    "j_left_anti": q(COHORTS, "SELECT UserId FROM unlabelled"),
    "j_full_outer_scores": q(SKILL_SCORES, "SELECT UserId, Name, round(CompScore, 6) AS CompScore, "
                                           "round(KernelScore, 6) AS KernelScore, round(DiscScore, 6) AS DiscScore, "
                                           "round(SkillScore, 6) AS SkillScore FROM skill_scores"),
    "j_tag_chain": q(SKILLS, "SELECT TagId, KernelId, UserId, round(KernelScore, 6) AS KernelScore, Name "
                             "FROM kernel_tag_rows"),
    "j_team_fanout": q(SKILLS, "SELECT TeamId, TagId, CompetitionId, round(CompScore, 6) AS CompScore, Name, UserId "
                               "FROM comp_rows"),
    "j_forum_path": q("""
messages AS (
  SELECT m.MessageId, m.UserId, m.ForumTopicId, f.Title, m.Message
  FROM forum_messages m JOIN forum_topics tp ON tp.ForumTopicId = m.ForumTopicId JOIN forums f ON f.ForumId = tp.ForumId
  WHERE m.Message IS NOT NULL)""", "SELECT MessageId, UserId, ForumTopicId, Title, CAST(length(Message) AS INTEGER) AS message_chars "
                                   "FROM messages"),
    # aggregations
    "a_distinct_counts": q(FEATURES, "SELECT UserId, NumOrgs, NumFollowers, KernelsCreated FROM features"),
    "a_medal_pivot": q(FEATURES, "SELECT * FROM medals"),
    "a_content_means": q(FEATURES, "SELECT UserId, round(KernelsAvgViews, 6) AS KernelsAvgViews, "
                                   "round(KernelsAvgComments, 6) AS KernelsAvgComments, "
                                   "round(KernelsAvgVotes, 6) AS KernelsAvgVotes FROM kernel_user"),
    "a_tag_means": q(SKILLS, "SELECT UserId, Name, round(KernelScore, 6) AS KernelScore FROM kernel_scores"),
    "a_mentions": q(SKILLS.rstrip() + "," + DISC, "SELECT UserId, Name, Count FROM mention_counts"),
    "a_mentions_html": q(SKILLS.rstrip() + "," + DISC_HTML, "SELECT UserId, Name, Count FROM mention_counts"),
    "a_counts": q(COHORTS, """
SELECT 'experts' AS cohort, count(*) AS n FROM experts UNION ALL
SELECT 'non_experts', count(*) FROM non_experts UNION ALL
SELECT 'non_experts_downsampled', count(*) FROM ne_down UNION ALL
SELECT 'train', count(*) FROM train UNION ALL
SELECT 'unlabelled', count(*) FROM unlabelled"""),
    "a_corr_matrix": q(MODEL, _corr_select()),
    "a_confusion": q(MODEL, """
SELECT a.actual, p.predicted,
  CAST((SELECT count(*) FROM holdout_pred h WHERE h.Expert = a.actual AND h.ExpertisePred = p.predicted) AS BIGINT) AS n
FROM (VALUES (0), (1)) a(actual), (VALUES (0), (1)) p(predicted)"""),
    # windows
    "w_user_content_pct": q(FEATURES, "SELECT UserId, KernelsCreated, " + ", ".join(
        r6(c, c) for c in ["KernelsViewsPerRanking", "KernelsCommentsPerRanking", "KernelsVotesPerRanking",
                           "UserKernelScore"]) + " FROM kernel_feat"),
    "w_rankings_pct": q(FEATURES, "SELECT UserId, round(CompetitionPerRanking, 6) AS CompetitionPerRanking, "
                                  "round(DiscussionPerRanking, 6) AS DiscussionPerRanking, "
                                  "round(ScriptPerRanking, 6) AS ScriptPerRanking FROM rankings"),
    "w_item_pct": q(SKILLS, "SELECT KernelId, UserId, TotalViews, TotalComments, TotalVotes, " + ", ".join(
        r6(c, c) for c in ["KernelsViewsPercentile", "KernelsCommentsPercentile", "KernelsVotesPercentile",
                           "KernelScore"]) + " FROM kernel_items"),
    "w_team_pct": q(SKILLS, "SELECT TeamId, CompetitionId, Medal, PublicLeaderboardRank, round(RankPer, 6) AS RankPer, "
                            "round(MedalPer, 6) AS MedalPer, round(CompScore, 6) AS CompScore FROM team_scores"),
    "w_team_rank_pct": q(SKILLS, "SELECT TeamId, PublicLeaderboardRank, round(RankPer, 6) AS RankPer FROM team_scores"),
    "w_medal_pct": q(SKILLS, "SELECT TeamId, Medal, round(MedalPer, 6) AS MedalPer FROM team_scores"),
    "w_team_pct_by_competition": q(SKILLS.rstrip() + """,
tpc AS (SELECT *,
  percent_rank() OVER (PARTITION BY CompetitionId ORDER BY PublicLeaderboardRank DESC NULLS FIRST) AS RankPer,
  percent_rank() OVER (PARTITION BY CompetitionId ORDER BY coalesce(Medal, 4) DESC) AS MedalPer FROM teams2)""",
        "SELECT TeamId, CompetitionId, Medal, PublicLeaderboardRank, round(RankPer, 6) AS RankPer, "
        "round(MedalPer, 6) AS MedalPer, round((RankPer + MedalPer) / 2, 6) AS CompScore FROM tpc"),
    "w_team_pct_compat": q(SKILLS.rstrip() + """,
tcp AS (SELECT *,
  percent_rank() OVER (ORDER BY PublicLeaderboardRank DESC NULLS LAST) AS RankPer,
  percent_rank() OVER (ORDER BY coalesce(Medal, 4) ASC) AS MedalPer FROM teams2)""",
        "SELECT TeamId, CompetitionId, Medal, PublicLeaderboardRank, round(RankPer, 6) AS RankPer, "
        "round(MedalPer, 6) AS MedalPer, round((RankPer + MedalPer) / 2, 6) AS CompScore FROM tcp"),
    "w_within_tag_avg_rank": q(SKILLS.rstrip() + "," + DISC,
                               "SELECT UserId, Name, round(DiscScore, 6) AS DiscScore FROM disc_scores"),
    # sorts, limits, sampling
    "o_top_skill_scores": q(SKILL_SCORES, "SELECT UserId, Name, round(CompScore, 6) AS CompScore, "
                                          "round(KernelScore, 6) AS KernelScore, round(DiscScore, 6) AS DiscScore, "
                                          "round(SkillScore, 6) AS SkillScore FROM skill_scores "
                                          "ORDER BY SkillScore DESC, UserId, Name LIMIT 10"),
    "o_top_experts_of_every_skill": q(MODEL.rstrip() + "," + SKILL_SCORES.rstrip() + """,
combined AS (
  SELECT k.Name, s.UserId, s.ExpertiseScore * 0.25 + k.SkillScore * 0.75 AS CombinedScore
  FROM scored s JOIN skill_scores k ON k.UserId = s.UserId),
placed AS (SELECT *, row_number() OVER (PARTITION BY Name ORDER BY CombinedScore DESC, UserId) AS place FROM combined)""",
        "SELECT Name, CAST(place AS INTEGER) AS Rank, UserId, round(CombinedScore, 6) AS CombinedScore FROM placed "
        "WHERE place <= 25"),
    "o_limit": q("", "SELECT * FROM tags ORDER BY TagId LIMIT 10"),
    "o_hash_sample": q(COHORTS, "SELECT UserId FROM ne_sample"),
    "o_downsample": q(COHORTS, "SELECT UserId, Expert FROM ne_down"),
    "o_hash_split": q(COHORTS, f"SELECT UserId, Expert, CASE WHEN {hsplit('UserId')} < {HOLDOUT_LIMIT} THEN 1 ELSE 0 END "
                               "AS is_holdout FROM train"),
    # set operations
    "u_train_union": q(COHORTS, "SELECT UserId, Expert FROM train"),
    "u_append_missing_cols": q(COHORTS, "SELECT UserId, Expert FROM population"),
    # text
    "t_html_clean": q("", f"SELECT page_id, {normalized_text('html')} AS text FROM pages"),
    "t_token_clean": q(f"""
words AS (SELECT doc_id, unnest(t) AS token, generate_subscripts(t, 1) AS i
          FROM (SELECT doc_id, {clean_tokens('text')} AS t FROM documents)),
{stems("SELECT DISTINCT token FROM words", "stemmed")},
cleaned AS (SELECT w.doc_id, string_agg(s.stem, ' ' ORDER BY w.i) AS m FROM words w JOIN stemmed s ON s.token = w.token
            GROUP BY w.doc_id)""", """
SELECT d.doc_id, coalesce(c.m, '') AS message_clean FROM documents d LEFT JOIN cleaned c ON c.doc_id = d.doc_id
WHERE d.text IS NOT NULL"""),
    "t_vocab_stem": q(f"""
vocab AS (SELECT token, count(*) AS doc_count FROM (
  SELECT doc_id, unnest(list_distinct({clean_tokens('text')})) AS token FROM documents) GROUP BY token),
{stems("SELECT token FROM vocab", "stemmed")}""",
                      "SELECT v.token, s.stem, v.doc_count FROM vocab v JOIN stemmed s ON s.token = v.token"),
    "t_abbreviations": q(SENTENCES, "SELECT word, n_dotted, n_plain FROM abbr"),
    "t_sentences": q(SENTENCES, """
SELECT MessageId, CAST(row_number() OVER m - 1 AS INTEGER) AS sentence,
       CAST(coalesce(lag(i) OVER m, -1) + 1 AS INTEGER) AS first_word,
       CAST(i - coalesce(lag(i) OVER m, -1) AS INTEGER) AS n_words
FROM ends WINDOW m AS (PARTITION BY MessageId ORDER BY i)"""),
    "t_ngram_candidates": q(SKILLS.rstrip() + "," + DISC, "SELECT TagId, Name, phrase, doc_count FROM phrases"),
    "t_taxonomy_keywords": q(SKILLS.rstrip() + "," + DISC, "SELECT keyword, Name, CAST(n_tokens AS INTEGER) AS n_tokens "
                                                           "FROM taxonomy"),
    "t_tag_keywords": q(keywords("(SELECT Name, Name AS tag FROM tags)", "tag", "kw"),
                        "SELECT keyword, Name, n_tokens FROM kw"),
    "t_phrase_tag": q(SKILLS.rstrip() + "," + DISC, "SELECT MessageId, count(*) AS n_mentions, "
                                                    "count(DISTINCT Name) AS n_names FROM mentions GROUP BY MessageId"),
    "t_explode_split": q(SKILLS.rstrip() + "," + DISC, "SELECT MessageId, Name, count(*) AS n FROM mentions "
                                                       "GROUP BY MessageId, Name"),
    # model
    "m_features": q(MODEL, "SELECT UserId, NumFollowers, TotalMedals, KernelsCreated, "
                           "round(UserKernelScore, 6) AS UserKernelScore, Ranked, Expert FROM pop_in"),
    "m_onehot": "SELECT o_orderkey, " + ", ".join(
        f"CAST(o_orderpriority = '{p}' AS INTEGER) AS \"o_orderpriority_{p}\""
        for p in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")) + " FROM orders",
    "m_index_encoding": """
WITH days AS (SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders),
counts AS (SELECT day, row_number() OVER (ORDER BY count(*) DESC, day) - 1 AS k FROM days WHERE day IS NOT NULL GROUP BY day)
SELECT d.o_orderkey, d.day, CAST(c.k AS INTEGER) AS day_index, CAST((SELECT count(*) FROM counts) AS INTEGER) AS n_categories,
       CAST(c.k AS INTEGER) AS hot, CAST(CASE WHEN c.k IS NULL THEN 0 ELSE 1 END AS INTEGER) AS n_hot
FROM days d LEFT JOIN counts c ON c.day = d.day""",
    "m_coefficients": q(FIT, """
SELECT unnest(['intercept', 'NumFollowers', 'TotalMedals', 'KernelsCreated', 'UserKernelScore', 'Ranked']) AS term,
       round(unnest([w0, w1, w2, w3, w4, w5]), 6) AS weight FROM fit"""),
    "m_logistic_fit_score": q(FIT, "SELECT UserId, ExpertisePred, round(ExpertiseScore, 6) AS ExpertiseScore FROM scored"),
    "m_fitted_metrics": q(FIT.rstrip() + """,
ranks AS (SELECT Expert, rank() OVER (ORDER BY ExpertiseScore) + (count(*) OVER (PARTITION BY ExpertiseScore) - 1) / 2.0
          AS r FROM holdout_pred),
area AS (SELECT round((sum(CASE WHEN Expert = 1 THEN r END) - sum(Expert) * (sum(Expert) + 1) / 2.0)
             / (sum(Expert) * (count(*) - sum(Expert))), 6) AS auc FROM ranks),
metrics AS (""" + METRICS + ")", "SELECT m.*, a.auc FROM metrics m, area a"),
    "c_fitted_search": q(FIT.rstrip() + "," + SKILL_SCORES.rstrip() + f""",
uas AS (
  SELECT s.*, k.Name, k.SkillScore, s.ExpertiseScore * 0.25 + k.SkillScore * 0.75 AS CombinedScore
  FROM scored s JOIN skill_scores k ON k.UserId = s.UserId WHERE k.Name = {sq(SEARCH_SKILL.lower())}),
top AS (SELECT * FROM uas ORDER BY CombinedScore DESC, UserId ASC LIMIT 25)""", f"SELECT {_search_select()} FROM top"),
    "m_linear_score": q(MODEL, "SELECT UserId, round(ExpertiseScore, 6) AS ExpertiseScore, ExpertisePred FROM scored"),
    "m_metrics": q(MODEL, """
SELECT round(avg((Expert - ExpertisePred) * (Expert - ExpertisePred)), 6) AS mse,
  round(avg(CASE WHEN Expert = ExpertisePred THEN 1.0 ELSE 0.0 END), 6) AS accuracy,
  round(CASE WHEN sum(ExpertisePred) > 0 THEN sum(Expert * ExpertisePred) / sum(ExpertisePred) ELSE 0.0 END, 6) AS precision,
  round(CASE WHEN sum(Expert) > 0 THEN sum(Expert * ExpertisePred) / sum(Expert) ELSE 0.0 END, 6) AS recall,
  round((sum(Expert * ExpertisePred) / sum(Expert) + sum((1 - Expert) * (1 - ExpertisePred)) / sum(1 - Expert)) / 2, 6)
    AS auc_hard
FROM holdout_pred"""),
    "m_auc": q(MODEL.rstrip() + """,
ranks AS (SELECT Expert, rank() OVER (ORDER BY ExpertiseScore) + (count(*) OVER (PARTITION BY ExpertiseScore) - 1) / 2.0
          AS r FROM holdout_pred)""", """
SELECT round((sum(CASE WHEN Expert = 1 THEN r END) - sum(Expert) * (sum(Expert) + 1) / 2.0)
             / (sum(Expert) * (count(*) - sum(Expert))), 6) AS auc FROM ranks"""),
    # composites
    "c_user_features": q(FEATURES, f"SELECT {_feature_select()} FROM features"),
    "c_cohorts": q(MODEL, "SELECT UserId, Expert, Ranked FROM train_in"),
    "c_kernel_scores": q(SKILLS, "SELECT UserId, Name, round(KernelScore, 6) AS KernelScore FROM kernel_scores"),
    "c_comp_scores": q(SKILLS, "SELECT UserId, Name, round(CompScore, 6) AS CompScore FROM comp_scores"),
    "c_skill_scores": q(SKILL_SCORES, "SELECT UserId, Name, round(CompScore, 6) AS CompScore, "
                                      "round(KernelScore, 6) AS KernelScore, round(DiscScore, 6) AS DiscScore, "
                                      "round(SkillScore, 6) AS SkillScore FROM skill_scores"),
    "c_users_and_skills": q(MODEL.rstrip() + "," + SKILL_SCORES, """
SELECT s.UserId, k.Name, round(s.ExpertiseScore, 6) AS ExpertiseScore, round(coalesce(k.SkillScore, 0), 6) AS SkillScore,
       round(s.ExpertiseScore * 0.25 + coalesce(k.SkillScore, 0) * 0.75, 6) AS CombinedScore
FROM scored s LEFT JOIN skill_scores k ON k.UserId = s.UserId"""),
    "c_expert_search": q(MODEL.rstrip() + "," + SKILL_SCORES.rstrip() + f""",
uas AS (
  SELECT s.*, k.Name, k.SkillScore, s.ExpertiseScore * 0.25 + k.SkillScore * 0.75 AS CombinedScore
  FROM scored s JOIN skill_scores k ON k.UserId = s.UserId WHERE k.Name = {sq(SEARCH_SKILL.lower())}),
top AS (SELECT * FROM uas ORDER BY CombinedScore DESC, UserId ASC LIMIT 25)""", f"SELECT {_search_select()} FROM top"),
}
