"""Chat formatting by quotation linking, in DataFrame functions only.

Messages quote earlier messages of their conversation with ``>`` markers, as
in mail; nested quotes carry several markers.  Each message is parsed into
passages (runs of lines of one quote level).  Quoted passages and their lines
are normalised, hashed and joined to the messages that first wrote them
unquoted; the text is compared as well, so a hash collision links nothing.  The
outermost level with a linked passage names the message that is answered.
Replies are followed to the message that began their thread, and each
conversation is put in reply order - thread by thread in order of their first
messages, inside a thread by turn, so an answer never stands before what it
answers - with quotes (and the line that announces one) taken out.

For scale: an original passage is one pre-aggregated row (its first turn)
however often it occurs, so the join is linear in the number of quoted
passages; following replies doubles the distance in each round, and only
messages that answer another take part; positions inside a conversation come
from counts of fixed-size ranges of turns, so a conversation with a third of all
messages is not sorted in one task.

Defined results: a null text is an empty message; a null conversation or turn
never links, but the message stays, with null turns first; repeated rows stay and
get equal threads and separate positions; a quote without an original links nothing and is
taken out all the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_stored, stored

MARKS = r"^[ \t]*(>[ \t]*)+"
ANNOUNCES = r"(?i)(wrote|writes|said|schrieb|escribió|a écrit)[ \t]*:[ \t]*$"
#: Turns in a range that is numbered as a unit.
RANGE = 1024


def normal(text: Column) -> Column:
    """Lower case, with every run of white space as one space."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def parsed_lines(text: Column) -> Column:
    """Array of (level, body) of the lines of a text."""
    def line(x):
        level = F.length(F.regexp_replace(F.regexp_extract(x, MARKS, 0), "[^>]", ""))
        return F.struct(level.alias("level"), F.regexp_replace(x, MARKS, "").alias("body"))

    return F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), line)


def passages(lines: Column) -> Column:
    """Array of (level, passage text, number of lines) of parsed lines."""
    def starts(ls):
        at = F.transform(ls, lambda x, i: F.when(
            (i == 0) | (F.get(ls, i - 1)["level"] != x["level"]), i))
        return F.concat(F.filter(at, lambda i: i.isNotNull()), F.array(F.size(ls)))

    def cut(begin):
        def one(b, j):
            part = F.slice(lines, b + 1, F.greatest(F.get(begin, j + 1) - b, F.lit(0)))
            return F.struct(F.get(lines, b)["level"].alias("level"),
                            F.array_join(F.transform(part, lambda x: x["body"]), "\n").alias("passage"),
                            F.size(part).alias("n"))
        return F.transform(F.slice(begin, 1, F.size(begin) - 1), one)

    return F.get(F.transform(F.array(starts(lines)), cut), 0)


def own_text(lines: Column) -> Column:
    """The unquoted lines, without one that announces a following quote."""
    kept = F.filter(lines, lambda x, i: (x["level"] == 0) & ~(
        F.coalesce(F.get(lines, i + 1)["level"] > 0, F.lit(False)) & x["body"].rlike(ANNOUNCES)))
    return F.trim(F.array_join(F.transform(kept, lambda x: x["body"]), "\n"))


def units_of(messages: DataFrame) -> DataFrame:
    """(conv, turn, level, unit, key) of every passage and, for passages of
    several lines, of each line, that has any text; key is the unit's hash."""
    each = messages.select("conv", "turn", F.explode_outer(passages(F.col("lines"))).alias("p"))
    split = F.when(F.col("p.n") > 1, F.concat(F.array("p.passage"), F.split("p.passage", "\n"))).otherwise(
        F.array("p.passage"))
    return (each.select("conv", "turn", "p.level", F.explode_outer(split).alias("raw"))
            .select("conv", "turn", "level", normal(F.col("raw")).alias("unit")).filter(F.col("unit") != "")
            .select("conv", "turn", "level", "unit", F.xxhash64("unit").alias("key")))


def links(messages: DataFrame) -> DataFrame:
    """(conv, turn, reply_to, n_linked): the message each message answers.

    Among originals linked at the outermost level the one with most linked
    units wins, then the latest."""
    units = units_of(messages).filter("conv is not null and turn is not null")
    origin = (units.filter("level = 0").groupBy("conv", "key", "unit").agg(F.min("turn").alias("origin")))
    quoted = units.filter("level > 0").distinct()
    found = quoted.join(origin, ["conv", "key", "unit"]).filter("origin < turn")
    tally = found.groupBy("conv", "turn", "level", "origin").agg(F.count(F.lit(1)).alias("n"))
    best = F.max(F.struct((-F.col("level")).alias("outer"), "n", "origin"))
    return tally.groupBy("conv", "turn").agg(best.alias("best"), F.sum("n").alias("n_linked")).select(
        "conv", "turn", F.col("best.origin").alias("reply_to"), "n_linked")


def threads(replies: DataFrame) -> DataFrame:
    """(conv, turn, thread) for messages that answer another: the turn at the
    start of their chain, found by doubling the followed distance each round."""
    known = stored(replies.select("conv", "turn", F.col("reply_to").alias("thread")), "threads")
    while True:
        up = known.select("conv", F.col("turn").alias("thread"), F.col("thread").alias("further"))
        step = stored(known.join(up, ["conv", "thread"], "left").select(
            "conv", "turn", F.coalesce("further", "thread").alias("thread"),
            F.col("further").isNotNull().alias("moved")), "threads")
        moved = not step.filter("moved").isEmpty()
        drop_stored(known)
        known = step.drop("moved")
        if not moved:
            return known


def reply_ordered(chat: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                  text_col: str = "text") -> DataFrame:
    """One row for each message: conv_id, turn, role, text without quotes,
    n_quoted_lines, n_linked, reply_to, thread, position (from 0, in reply order)."""
    lines = parsed_lines(F.col(f"`{text_col}`"))
    messages = chat.select(F.col(f"`{conv_col}`").alias("conv"), F.col(f"`{turn_col}`").alias("turn"),
                           F.col(f"`{role_col}`").alias("role"), lines.alias("lines"))
    replies = stored(links(messages.select("conv", "turn", "lines")), "replies")
    chains = replies.join(threads(replies), ["conv", "turn"])
    quoted = F.size(F.filter("lines", lambda x: x["level"] > 0))
    rows = (messages.select("conv", "turn", "role", own_text(F.col("lines")).alias("text"),
                            quoted.alias("n_quoted_lines"))
            .join(chains, ["conv", "turn"], "left")
            .withColumn("thread", F.coalesce("thread", "turn")))
    return positioned(rows).select(F.col("conv").alias("conv_id"), "turn", "role", "text", "n_quoted_lines",
                                   F.coalesce("n_linked", F.lit(0)).alias("n_linked"), "reply_to", "thread", "position")


def positioned(rows: DataFrame) -> DataFrame:
    """``rows`` with their place in reply order inside each conversation.

    Rows are numbered inside ranges of turns of one thread; counts of the
    ranges, threads and ranges of threads before supply the rest.  No window
    sorts more than the rows of one range, or one small row for each range."""
    def before(frame, keys, order):
        ahead = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return frame.withColumn("before", F.coalesce(F.sum("size").over(ahead), F.lit(0)))

    def matched(a, b, keys):
        on = a[keys[0]].eqNullSafe(b[keys[0]])
        for k in keys[1:]:
            on = on & a[k].eqNullSafe(b[k])
        return a.join(b, on).select(a["*"], b["before"].alias("ahead")).withColumn(
            "before", F.col("before") + F.col("ahead")).drop("ahead")

    cut = rows.withColumn("part", F.floor(F.col("turn") / RANGE))
    parts = before(cut.groupBy("conv", "thread", "part").agg(F.count(F.lit(1)).alias("size")), ["conv", "thread"], "part")
    thread = parts.groupBy("conv", "thread").agg(F.sum("size").alias("size")).withColumn(
        "block", F.floor(F.col("thread") / RANGE))
    blocks = before(thread.groupBy("conv", "block").agg(F.sum("size").alias("size")), ["conv"], "block")
    thread = matched(before(thread, ["conv", "block"], "thread"), blocks, ["conv", "block"])
    parts = matched(parts, thread, ["conv", "thread"]).drop("size")
    inside = Window.partitionBy("conv", "thread", "part").orderBy("turn", "role", "text")
    numbered = cut.withColumn("before", F.row_number().over(inside) - 1)
    return matched(numbered, parts, ["conv", "thread", "part"]).withColumnRenamed("before", "position")
