"""Sentence splitting (the first half of F16), learned from the corpus itself.

A sentence ends at a word with a final ``.``, ``!`` or ``?`` (closing quotes and
brackets may follow) if the next word begins like a sentence (a capital letter, a
digit, or either behind an opening quote or bracket), and at the end of the text.
A dot of an abbreviation ends nothing.  Abbreviations are learned by counting:
the short words that the corpus writes with a final dot most of the time, which a
word that merely ends a sentence now and then does not reach.

Only words with a final mark leave their row; the texts are never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import collapse_spaces, strip_html

MIN_DOTTED = 3          # occurrences with a dot that make an abbreviation possible
MIN_SHARE = 0.75        # of all occurrences of the word that have the dot
MAX_LETTERS = 6         # longer words are no abbreviations
# The regular expressions.
ENDING_RE = r"[.!?][\"'\x{2019}\x{201D}\x{00BB})\]]*$"
DOT_WORD_RE = r"^[\"'(\[]*((?:\p{L}+[.])*\p{L}+)[.]$"
PLAIN_WORD_RE = r"^[\"'(\[]*((?:\p{L}+[.])*\p{L}+)[,;:!?\"')\]]*$"
OPENING_RE = r"^[\"'\x{2018}\x{201C}\x{00AB}(\[]*[\p{Lu}\p{N}]"


def text_words(col) -> Column:
    """The space-separated words of a text, markup removed, in order."""
    return F.array_remove(F.split(collapse_spaces(strip_html(col)), " "), "")


def abbreviations(words: DataFrame, col: str = "words") -> DataFrame:
    """(word, n_dotted, n_plain) of the abbreviations of a corpus, in small
    letters and without their last dot.  ``words`` holds arrays from
    :func:`text_words`."""
    each = words.select(F.explode_outer(col).alias("w")).filter("w IS NOT NULL")
    dotted = F.lower(F.regexp_extract("w", DOT_WORD_RE, 1))
    plain = F.lower(F.regexp_extract("w", PLAIN_WORD_RE, 1))
    named = each.select(F.when(dotted != "", dotted).otherwise(plain).alias("word"), (dotted != "").alias("dot")).filter(
        (F.length("word") > 0) & (F.length("word") <= MAX_LETTERS))
    counts = named.groupBy("word").agg(F.count_if("dot").alias("n_dotted"), F.count_if(~F.col("dot")).alias("n_plain"))
    return counts.filter((F.col("n_dotted") >= MIN_DOTTED)
                         & (F.col("n_dotted") >= MIN_SHARE * (F.col("n_dotted") + F.col("n_plain"))))


def sentences(words: DataFrame, key: str, abbreviated: DataFrame, col: str = "words") -> DataFrame:
    """(key, sentence, first_word, n_words): the sentences of every text with a
    word, numbered from 0, by the numbers of their words.  ``key`` is unique;
    ``abbreviated`` holds a column ``word``."""
    marks = F.transform(col, lambda w, i: F.struct(
        i.alias("pos"), w.alias("w"), F.get(col, i + 1).alias("after")))
    ends = F.filter(marks, lambda x: x["after"].isNull() | (x["w"].rlike(ENDING_RE) & x["after"].rlike(OPENING_RE)))
    rows = words.select(key, F.explode_outer(ends).alias("e")).filter("e IS NOT NULL").select(
        key, "e.pos", F.when(F.col("e.after").isNotNull(), F.lower(F.regexp_extract("e.w", DOT_WORD_RE, 1))).alias("word"))
    real = rows.join(abbreviated.select("word"), "word", "left_anti")
    per_text = real.groupBy(key).agg(F.sort_array(F.collect_list("pos")).alias("at"))
    spans = per_text.selectExpr(f"`{key}`", "posexplode(transform(at, (e, i) -> struct(coalesce(get(at, i - 1), -1) + 1 AS first, e AS last))) AS (sentence, s)")
    return spans.selectExpr(f"`{key}`", "sentence", "s.first AS first_word", "s.last - s.first + 1 AS n_words")
