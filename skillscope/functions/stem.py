"""English stemming (F19) as column expressions: the suffix steps of the
published Snowball English algorithm over a token column.

A step looks at the longest suffix that it knows and rewrites it if the suffix
lies in a region: the first region begins after the first non-vowel that follows
a vowel, the second is the same inside the first.  Regions are kept as positions,
so they hold while the word gets shorter.  ``y`` is written ``Y`` where it is a
consonant.

Every step binds its input once (``let``), so the expression grows linearly.
It is meant for vocabularies: :func:`stemmed_vocabulary` stems each distinct
token of a corpus once, and readers join tokens with it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the published algorithm.
VOWEL, CONSONANT = "[aeiouy]", "[^aeiouy]"
REGION_RE = "^[^aeiouy]*[aeiouy]+[^aeiouy]"
REGION_PREFIX_RE = "^(gener|commun|arsen)"
SHORT_RE = "([^aeiouy][aeiouy][^aeiouywxY]|^[aeiouy][^aeiouy])$"
DOUBLE_RE = "(bb|dd|ff|gg|mm|nn|pp|rr|tt)$"
SPECIAL = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl",
           "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe",
           "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes"}
FINISHED = ("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed")
STEP_2 = {"tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize",
          "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful",
          "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "ogi": "og",
          "fulli": "ful", "lessli": "less", "li": ""}
STEP_3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "",
          "ness": "", "ative": ""}
STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive",
          "ize", "ion")


def let(value: Column, body) -> Column:
    """``value`` evaluated once and handed to ``body`` as a lambda variable."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _longest(w: Column, suffixes) -> Column:
    """The longest of the suffixes that ``w`` ends with, or the empty string."""
    return F.regexp_extract(w, "^.*?(" + "|".join(suffixes) + ")$", 1)


def _cut(w: Column, n) -> Column:
    return w.substr(F.lit(1), F.length(w) - n)


def _map(rules: dict) -> Column:
    return F.expr("map(" + ", ".join(f"'{k}', '{v}'" for k, v in rules.items()) + ")")


def _marked(t: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(t, "^y", "Y"), "([aeiouy])y", "$1Y")


def _regions(w: Column) -> Column:
    """Begin of the first and the second region, counted from 0."""
    prefix = F.length(F.regexp_extract(w, REGION_PREFIX_RE, 0))
    end = F.length(F.regexp_extract(w, REGION_RE, 0))
    first = F.when(prefix > 0, prefix).when(end > 0, end).otherwise(F.length(w))

    def second(p):
        more = F.length(F.regexp_extract(w.substr(p + 1, F.length(w)), REGION_RE, 0))
        return F.struct(p.alias("p1"), F.when(more > 0, p + more).otherwise(F.length(w)).alias("p2"))
    return let(first, second)


def _step_1a(w: Column) -> Column:
    return (F.when(w.endswith("sses"), _cut(w, 2))
            .when(w.rlike("ie[ds]$"), F.when(F.length(w) > 4, _cut(w, 2)).otherwise(_cut(w, 1)))
            .when(w.rlike("[us]s$"), w)
            .when(w.rlike(f"{VOWEL}.+s$"), _cut(w, 1)).otherwise(w))


def _step_1b(w: Column, p1: Column) -> Column:
    def repaired(x):
        return (F.when(x.rlike("(at|bl|iz)$"), F.concat(x, F.lit("e"))).when(x.rlike(DOUBLE_RE), _cut(x, 1))
                .when((F.length(x) <= p1) & x.rlike(SHORT_RE), F.concat(x, F.lit("e"))).otherwise(x))

    def step(s):
        rest = _cut(w, F.length(s))
        return (F.when(s == "", w)
                .when(s.startswith("eed"), F.when(F.length(rest) >= p1, F.concat(rest, F.lit("ee"))).otherwise(w))
                .when(rest.rlike(VOWEL), let(rest, repaired)).otherwise(w))
    return let(_longest(w, ("ingly", "eedly", "edly", "eed", "ing", "ed")), step)


def _step_1c(w: Column) -> Column:
    return F.regexp_replace(w, f"^(.+{CONSONANT})[yY]$", "$1i")


def _step_2(w: Column, p1: Column) -> Column:
    def step(s):
        rest = _cut(w, F.length(s))
        blocked = ((s == "") | (F.length(rest) < p1) | ((s == "ogi") & ~rest.endswith("l"))
                   | ((s == "li") & ~rest.rlike("[cdeghkmnrt]$")))
        return F.when(blocked, w).otherwise(F.concat(rest, F.try_element_at(_map(STEP_2), s)))
    return let(_longest(w, STEP_2), step)


def _step_3(w: Column, p1: Column, p2: Column) -> Column:
    def step(s):
        rest = _cut(w, F.length(s))
        blocked = (s == "") | (F.length(rest) < p1) | ((s == "ative") & (F.length(rest) < p2))
        return F.when(blocked, w).otherwise(F.concat(rest, F.try_element_at(_map(STEP_3), s)))
    return let(_longest(w, STEP_3), step)


def _step_4(w: Column, p2: Column) -> Column:
    def step(s):
        rest = _cut(w, F.length(s))
        return F.when((s == "") | (F.length(rest) < p2) | ((s == "ion") & ~rest.rlike("[st]$")), w).otherwise(rest)
    return let(_longest(w, STEP_4), step)


def _step_5(w: Column, p1: Column, p2: Column) -> Column:
    rest, at = _cut(w, 1), F.length(w) - 1
    drop_e = w.endswith("e") & ((at >= p2) | ((at >= p1) & ~rest.rlike(SHORT_RE)))
    return F.when(drop_e | (w.endswith("ll") & (at >= p2)), rest).otherwise(w)


def stem_token(t: Column) -> Column:
    """The stem of one lower-case token; tokens of one or two letters stay as they are."""
    def with_regions(w):
        def later(a, r):
            b = let(_step_1b(a, r["p1"]), _step_1c)
            c = let(b, lambda x: _step_2(x, r["p1"]))
            d = let(c, lambda x: _step_3(x, r["p1"], r["p2"]))
            e = let(d, lambda x: _step_4(x, r["p2"]))
            return F.when(a.isin(*FINISHED), a).otherwise(let(e, lambda x: _step_5(x, r["p1"], r["p2"])))
        return let(_regions(w), lambda r: let(_step_1a(w), lambda a: later(a, r)))
    return (F.when(F.length(t) <= 2, t)
            .otherwise(F.coalesce(F.try_element_at(_map(SPECIAL), t), F.translate(let(_marked(t), with_regions), "Y", "y"))))


def stem_tokens(tokens: Column) -> Column:
    """Every element of an array<string> column stemmed in place: for few rows (names, queries).  Corpora go through
    :func:`stemmed_vocabulary`."""
    return F.transform(tokens, stem_token)


def stemmed_vocabulary(docs: DataFrame, tokens_col: str = "tokens") -> DataFrame:
    """(token, stem, doc_count): each distinct token of the rows, stemmed once."""
    each = docs.select(F.explode(F.array_distinct(F.col(tokens_col))).alias("token"))
    return each.groupBy("token").agg(F.count(F.lit(1)).alias("doc_count")).select(
        "token", stem_token(F.col("token")).alias("stem"), "doc_count")


def stemmed_rows(docs: DataFrame, key: str, tokens_col: str, vocabulary: DataFrame) -> DataFrame:
    """(key, tokens): the token arrays with every token replaced by its stem from the vocabulary, in order.  Null
    arrays stay null; ``key`` is unique."""
    each = docs.select(key, F.col(tokens_col).isNull().alias("none"), F.posexplode_outer(tokens_col).alias("pos", "token"))
    found = each.join(vocabulary.select("token", "stem"), "token", "left")
    back = found.groupBy(key).agg(F.max("none").alias("none"), F.sort_array(F.collect_list(F.when(
        F.col("pos").isNotNull(), F.struct("pos", "stem")))).alias("s"))
    return back.select(key, F.when(~F.col("none"), F.col("s")["stem"]).alias("tokens"))
