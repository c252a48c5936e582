"""Dictionary phrase tagging (T3, T4): case-insensitive, word-bounded,
leftmost-longest, non-overlapping, repeats kept, canonical names returned.

No per-row keyword trie and no keyword list on the driver:

1. The words of the taxonomy are matched to the corpus tokens that stem to them
   (through the vocabulary).  Their hashes set bits of a bitmap of fixed size,
   which every row tests inside its token array; so only tokens that may
   be part of a phrase are exploded, whatever the length of the texts.
2. These occurrences join the matched tokens, which drops false hits and gives
   the stem, and meet again in their document, ordered by position.
3. Runs of adjacent positions give the n-grams up to the longest phrase, which
   join the taxonomy.  The matches of a document (bounded by its own tokens)
   are sorted by (start asc, len desc), and a left fold keeps one iff it starts
   at or after the end of the last kept one.

Joins are left to the optimizer: a side whose size in bytes is small is
broadcast, a larger one is shuffled.  A taxonomy far beyond the size of the
bitmap saturates it; then more occurrences reach the join, with equal results.

Generators are the ``_outer`` forms throughout: the plain ones make the
optimizer infer a ``size(array) > 0`` filter and push it below the
projection, which would evaluate the whole token expression again; empty
documents fall out at the joins instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BITMAP_WORDS = 1 << 14      # longs of 64 bits: 128 KB whatever the taxonomy's size
BITMAP_SHIFT = 14


def prepare_taxonomy(taxonomy: DataFrame, keyword_col: str = "keyword", name_col: str = "Name") -> DataFrame:
    """One row per normalised keyword; when two names share a keyword the
    smallest name wins (Q28).  Empty keywords never match."""
    kw = taxonomy.select(F.col(keyword_col).alias("keyword"), F.col(name_col).alias("Name"))
    kw = kw.filter(F.length("keyword") > 0)
    return kw.groupBy("keyword").agg(F.min("Name").alias("Name")).withColumn(
        "n_tokens", F.size(F.split("keyword", " ")))


def _taxonomy_tokens(taxonomy: DataFrame, vocabulary: DataFrame | None) -> DataFrame:
    """(token, stem) of the tokens whose stem is a word of the taxonomy."""
    words = taxonomy.select(F.explode(F.split("keyword", " ")).alias("stem")).distinct()
    if vocabulary is None:
        return words.select(F.col("stem").alias("token"), "stem")
    return vocabulary.select("token", "stem").join(words, "stem").select("token", "stem")


def hash_bitmap(tokens: DataFrame) -> Column:
    """The hashes of a token column as BITMAP_WORDS longs of 64 bits each, in one lazily evaluated array."""
    spark = tokens.sparkSession
    bits = tokens.selectExpr("xxhash64(token) AS h").selectExpr(
        f"CAST(h & {BITMAP_WORDS - 1} AS bigint) AS w", f"shiftleft(1L, CAST(shiftright(h, {BITMAP_SHIFT}) & 63 AS int)) AS m")
    words = bits.unionByName(spark.range(BITMAP_WORDS).selectExpr("id AS w", "0L AS m")).groupBy("w").agg(
        F.bit_or("m").alias("m"))
    return words.agg(F.sort_array(F.collect_list(F.struct("w", "m")))["m"].alias("bitmap")).scalar()


def in_bitmap(token: str, bitmap: str) -> str:
    """SQL condition: the hash of the expression ``token`` is in the column ``bitmap``."""
    return (f"get({bitmap}, CAST(xxhash64({token}) & {BITMAP_WORDS - 1} AS int)) "
            f"& shiftleft(1L, CAST(shiftright(xxhash64({token}), {BITMAP_SHIFT}) & 63 AS int)) <> 0")


def _possible(docs: DataFrame, tokens_col: str, keys: list[str], tokens: DataFrame) -> DataFrame:
    """(keys, pos, token): the occurrences whose hash is in the bitmap, tested before anything is exploded."""
    named = [f"`{k}`" for k in keys]
    held = docs.select(*named, F.col(tokens_col).alias("_tokens"), hash_bitmap(tokens).alias("_bitmap"))
    # structs are made for the hits only
    return held.selectExpr(*named, f"""explode_outer(filter(transform(_tokens, (t, i) ->
        if({in_bitmap('t', '_bitmap')}, struct(i AS pos, t AS token), NULL)), x -> x IS NOT NULL)) AS o""").selectExpr(
        *named, "o.pos AS pos", "o.token AS token")


def _grams(occurrences: DataFrame, keys: list[str], taxonomy: DataFrame) -> DataFrame:
    """(keys, start, neg_len, gram): n-grams of adjacent occurrences, up to the taxonomy's longest phrase."""
    named = [f"`{k}`" for k in keys]
    longest = taxonomy.agg(F.max("n_tokens")).scalar()
    per_doc = occurrences.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("pos", "stem"))).alias("_at"))
    # a single word is its own gram; longer ones start where the next occurrence is adjacent
    ones = "transform(_at, x -> struct(x.pos AS start, -1 AS neg_len, x.stem AS gram))"
    more = """flatten(transform(filter(transform(_at, (x, i) -> if(get(_at, i + 1).pos = x.pos + 1, struct(x.pos AS pos, i AS i), NULL)),
        y -> y IS NOT NULL), y -> transform(
        filter(if(_longest > 1, sequence(2, _longest), CAST(array() AS array<int>)), n -> get(_at, y.i + n - 1).pos = y.pos + n - 1),
        n -> struct(y.pos AS start, -n AS neg_len, array_join(slice(_at, y.i + 1, n).stem, ' ') AS gram))))"""
    return per_doc.withColumn("_longest", longest).selectExpr(*named, f"explode_outer(concat({ones}, {more})) AS g").filter(
        "g IS NOT NULL").selectExpr(*named, "g.*")


def _greedy(cands, value: str):
    init = F.struct(F.lit(0).alias("end"), F.array().cast(T.ArrayType(T.StringType())).alias("out"))

    def step(acc, c):
        take = c["start"] >= acc["end"]
        return F.when(take, F.struct((c["start"] - c["neg_len"]).alias("end"),
                                     F.concat(acc["out"], F.array(c[value])).alias("out"))).otherwise(acc)

    return F.aggregate(cands, init, step, lambda acc: acc["out"])


def tag_documents(docs: DataFrame, tokens_col: str, keys: list[str], taxonomy: DataFrame,
                  vocabulary: DataFrame | None = None) -> DataFrame:
    """Return ``keys + [names]``: the ordered list of matched canonical names
    for each document with at least one match (T4 drops the others).

    ``taxonomy`` must come from :func:`prepare_taxonomy`; ``vocabulary`` (token,
    stem) says what the tokens stem to (without it they are compared as they
    are)."""
    tokens = _taxonomy_tokens(taxonomy, vocabulary)
    found = _possible(docs, tokens_col, keys, tokens).join(tokens, "token").select(*keys, "pos", "stem")
    hits = _grams(found, keys, taxonomy).join(taxonomy.select(F.col("keyword").alias("gram"), "Name"), "gram", "inner")
    per_doc = hits.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("start", "neg_len", "Name"))).alias("cands"))
    return per_doc.select(*keys, _greedy(F.col("cands"), "Name").alias("names"))


def tag_mentions(docs: DataFrame, tokens_col: str, keys: list[str], taxonomy: DataFrame,
                 vocabulary: DataFrame | None = None) -> DataFrame:
    """T3 + T4 + F12: one row per chosen mention (``keys``, ``pos`` 0-based
    order within the document, ``Name``)."""
    out = tag_documents(docs, tokens_col, keys, taxonomy, vocabulary).select(*keys, F.posexplode_outer("names").alias("pos", "Name"))
    return out.filter(F.col("Name").isNotNull())
