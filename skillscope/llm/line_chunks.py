"""Line dedup with content-defined chunks, in DataFrame functions only.

A text is cut into chunks of whole lines.  A rolling hash over the hashes of a
line and the one before decides whether the line is a boundary, so an insertion
or deletion shifts no boundary beyond its neighbourhood.  A chunk runs from one
boundary line to the next and holds both, so neighbouring chunks share a line;
lines without a word are never boundaries, but the first and the last line of a
text always are.  Chunks with a word in two or more lines that occur more than once in
the corpus are compared byte by byte, and the lines of every occurrence but the
first, in order of id and line, are removed.

A shared block is found from its first to its last boundary line.  Most lines are
boundaries (DIVISOR), because a block that holds no whole chunk is lost, and what
lies outside of its chunks stays.  The first occurrence of a line's text in the
corpus always stays: a chunk that holds it has no earlier occurrence.

Plan: (1) hashes of all chunks, without their text, are written once
and counted with partial aggregation; (2) only texts with a repeated hash are cut again, and their
repeated chunks grouped by hash and bytes to find first occurrences - a chunk
that a third of all texts share is one pre-aggregated group; (3) first
occurrences travel back by document, and the lines of every other repeated chunk are
dropped.  Nothing is joined on the chunk of a hot group except the short list
of repeated hashes.

Defined results: a null text stays null; an empty text stays empty; chunks
with words in fewer than two lines are never removed; repeated rows (same id, same text) all
keep what the first of them keeps; a null id orders last.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, stored

#: A line is no boundary if its rolling hash is divisible by this: one line in DIVISOR.
DIVISOR = 13
#: Multiplier of the rolling hash over line hashes.
ROLL = 31
#: A chunk is one number: first line (from 0) times SPAN, plus its number of lines.
SPAN = 1 << 31
#: A word character.
WORD = "[^\\x20\\x09-\\x0D]"
#: A word, and another one in a later line.
TWO_LINES = f"{WORD}[^\\n]*\\n(?s:.*){WORD}"


def line_hash(line: Column) -> Column:
    return F.conv(F.substring(F.md5(line.cast("binary")), 1, 8), 16, 10).cast("bigint")


def chunk_codes(lines: Column) -> Column:
    """Array of chunk codes of an array of lines."""
    def boundaries(hashes):
        def is_one(line, i):
            rolled = F.get(hashes, i - 1) * ROLL + F.get(hashes, i)
            return (i == 0) | (i == F.size(lines) - 1) | (line.rlike(WORD) & (rolled % DIVISOR != 0))
        at = F.transform(lines, lambda line, i: F.when(is_one(line, i), i))
        return F.filter(at, lambda i: i.isNotNull())

    def codes(at):
        return F.transform(F.slice(at, 1, F.size(at) - 1), lambda a, j: (
            a.cast("bigint") * SPAN + F.get(at, j + 1) - a + 1).cast("bigint"))

    return bound(F.transform(lines, line_hash), lambda h: bound(boundaries(h), codes))


def bound(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.get(F.transform(F.array(value), body), 0)


def chunk_text(lines: Column, code: Column) -> Column:
    return F.array_join(F.slice(lines, F.floor(code / SPAN).cast("int") + 1, (code % SPAN).cast("int")), "\n")


def chunk_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, mark, code, hash) of every chunk with words in two or more lines."""
    def hashes(lines):
        return F.transform(chunk_codes(lines), lambda c: bound(chunk_text(lines, c), lambda chunk: F.struct(
            c.alias("code"), F.when(chunk.rlike(TWO_LINES), F.xxhash64(chunk)).alias("hash"))))

    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("body"))
    cut = rows.select("id", F.xxhash64("body").alias("mark"), bound(F.split("body", "\n"), hashes).alias("chunks"))
    # the outer form keeps the optimizer from evaluating the chunks once more for an inferred size filter
    return (cut.select("id", "mark", F.explode_outer("chunks").alias("c"))
            .select("id", "mark", "c.code", "c.hash").filter("hash is not null"))


def known_by(docs: DataFrame, rows: DataFrame, id_col: str, mark: str) -> Column:
    """Join condition between documents and (id, mark) rows."""
    return docs[f"`{id_col}`"].eqNullSafe(rows["id"]) & (docs[mark] == rows["mark"])


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 removed_col: str | None = None) -> DataFrame:
    """``docs`` with the text of every row rid of repeated chunks; with
    ``removed_col``, also a column of that name with the removed lines' count."""
    chunks = stored(chunk_rows(docs, id_col, text_col), "chunks")
    # written first, so that the join sees two plain shuffles and can split a chunk that very many documents share
    repeated = stored(chunks.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("hash"),
                      "repeated")
    wanted = stored(chunks.join(repeated, "hash", "left_semi").groupBy("id", "mark")
                    .agg(F.collect_set("code").alias("wanted")), "wanted")
    # Both joins below read the documents under the same key: where no other column is asked for,
    # the texts are shuffled once.  Their other sides grow with the corpus, so they are never broadcast.
    mark = free_name(docs, "mark")
    rows = docs.withColumn(mark, F.xxhash64(docs[f"`{text_col}`"]))
    body = rows[f"`{text_col}`"]
    texts = bound(F.split(body, "\n"), lambda lines: F.transform(wanted["wanted"], lambda c: F.struct(
        c.alias("code"), chunk_text(lines, c).alias("chunk"))))
    found = (rows.join(wanted.hint("merge"), known_by(rows, wanted, id_col, mark))
             .select(wanted["id"], wanted["mark"], F.explode_outer(texts).alias("c"))
             .select("id", "mark", "c.code", "c.chunk"))
    # equal bytes meet in one pre-aggregated group, which only remembers its first occurrence
    order = F.struct(F.col("id").isNull().alias("last"), "id", "mark", "code")
    first = (found.groupBy(F.xxhash64("chunk").alias("hash"), "chunk").agg(F.min(order).alias("first"))
             .select("first.id", "first.mark", "first.code").groupBy("id", "mark")
             .agg(F.collect_set("code").alias("kept")))
    same = wanted["id"].eqNullSafe(first["id"]) & (wanted["mark"] == first["mark"])
    removed = F.array_except("wanted", F.coalesce("kept", F.array().cast("array<bigint>")))
    gone = (wanted.join(first, same, "left").select(wanted["id"], wanted["mark"], removed.alias("_removed"))
            .filter(F.size("_removed") > 0))
    out = rows.join(gone.hint("merge"), known_by(rows, gone, id_col, mark), "left")
    removed = gone["_removed"]
    text = F.when(removed.isNull(), body).otherwise(kept_text(body, removed)).alias(text_col)
    lines = F.when(removed.isNull(), 0).otherwise(F.size(F.array_distinct(lines_of(removed)))).cast("bigint")
    return out.select(*[text if c == text_col else docs[f"`{c}`"] for c in docs.columns],
                      *([lines.alias(removed_col)] if removed_col else []))


def lines_of(codes: Column) -> Column:
    """Numbers (from 0) of the lines of the chunks, shared ones repeated."""
    def numbers(code):
        start = F.floor(code / SPAN)
        return F.sequence(start, start + code % SPAN - 1)
    return F.flatten(F.transform(codes, numbers))


def kept_text(text: Column, removed: Column) -> Column:
    """The lines outside of the removed chunks, joined again."""
    def joined(lines):
        left = F.array_except(F.sequence(F.lit(0).cast("bigint"), F.size(lines).cast("bigint") - 1), lines_of(removed))
        return F.array_join(F.transform(left, lambda i: F.get(lines, i.cast("int"))), "\n")
    return bound(F.split(text, "\n"), joined)
