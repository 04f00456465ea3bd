"""Quotation linking: conversations in reply order, without the quoted text.

A line's quote level is the number of `>` at its start (white space between them is skipped). A passage is a run of lines of one level. Lines are
normalised (marks dropped, white space single, lower case, ends trimmed; blank ones left out) and a piece of text is the hash of its lines, joined by
a space. A quoted passage is looked up whole (part 0), by its paragraphs (1) and by its lines (2). A message says all the pieces of its own
text (level 0): the whole, its paragraphs, and each sequence of as many consecutive lines as a passage, paragraph or line quoted in its conversation
has. So a quote of any consecutive lines of a message is found, rewrapped ones if they are whole paragraphs or the whole text.
A message is linked to the one of its conversation, in an earlier turn, that says such a piece: the lowest level first, then whole passages
before paragraphs before lines, then the latest such turn. Messages without a link are roots.

Reply order is depth first: a message, then the replies to it by turn; roots by turn. Places and depths come from the Euler tours of the trees of
replies, ranked by pointer doubling: rounds grow with the logarithm of the largest tree, and rows have a fixed width, however deep the replies are.
Neighbours and sums go by range-sorted partitions, so a root with countless replies and a conversation with countless roots are split.

Null or empty text: empty body, no link. Null conv_id: those rows are one conversation. Null turn: no link from or to it, first in order. Repeated
turns and equal rows: each row is kept, in order of its place in the input; a link goes to one of equal turns.
Attribution lines (ending in `wrote:`) before a quote are dropped from the body. Very long texts: time grows with their lines.
An empty table gives no rows. Other columns of the input aren't read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamellar.llm.common import broadcast_if_small, drop_staged, staged

MARKS = r"^\s*((?:>\s?)+)"


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def bound(value: Column, use) -> Column:
    """use(value) with the value computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def lines_of(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"\r?\n"), normalised), lambda x: x != "")


def pieces(run: Column) -> Column:
    """The distinct pieces (part, lines, hash) of a run of lines: part 0 is the whole, 1 its paragraphs, 2 its lines; each has its least part."""
    row = lambda part, of: F.struct(F.lit(part).alias("part"), F.size(of).alias("lines"), F.xxhash64(F.array_join(of, " ")).alias("hash"))
    whole = bound(lines_of(run), lambda x: F.array(row(0, x)))
    paragraphs = F.transform(F.filter(F.transform(F.split(run, r"\n\s*\n"), lines_of), lambda x: F.size(x) > 0), lambda x: row(1, x))
    lines = F.transform(lines_of(run), lambda x: row(2, F.array(x)))
    every = F.filter(F.concat(whole, paragraphs, lines), lambda p: p["lines"] > 0)
    return F.array_distinct(every)


def parsed(messages: DataFrame) -> DataFrame:
    """Each message with body (text without quotes) and quotes: (level, part, lines, hash) of the pieces of its quoted passages."""
    text = F.coalesce("text", F.lit(""))
    level = lambda x: F.length(F.regexp_replace(F.regexp_extract(x, MARKS, 1), r"[^>]", ""))
    marked = F.transform(F.split(text, r"\r?\n"), lambda x: F.struct(level(x).alias("level"), F.regexp_replace(x, MARKS, "").alias("line")))

    def runs_of(m):
        """The runs of lines of one level; m: the marked lines."""
        first = F.filter(F.sequence(F.lit(1), F.size(m)), lambda i: (i == 1) | (F.get(m, i - 1)["level"] != F.get(m, i - 2)["level"]))

        def run(starts):
            end = lambda j: F.coalesce(F.get(starts, j + 1), F.size(m) + 1)
            return F.transform(starts, lambda s, j: F.struct(F.get(m, s - 1)["level"].alias("level"), F.array_join(F.transform(F.slice(m, s, end(j) - s), lambda x: x["line"]), "\n").alias("line")))

        return bound(first, run)

    quoted = text.rlike(r"(?m)^\s*>")
    runs = F.when(quoted, bound(marked, runs_of)).otherwise(F.array(F.struct(F.lit(0).alias("level"), text.alias("line"))))
    own = F.filter("runs", lambda r: r["level"] == 0)
    unquoted = F.array_join(F.transform(own, lambda r: F.regexp_replace(r["line"], r"(?m)^.*wrote:\s*$", "")), "\n")
    body = F.when(quoted, F.regexp_replace(F.regexp_replace(unquoted, r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")).otherwise(text)
    of_run = lambda r: F.transform(pieces(r["line"]), lambda p: F.struct(r["level"].alias("level"), p["part"].alias("part"), p["lines"].alias("lines"), p["hash"].alias("hash")))
    quotes = F.flatten(F.transform(F.filter("runs", lambda r: r["level"] > 0), of_run))
    out = messages.select("conv_id", "turn", "role", "text").withColumn("runs", runs)
    return out.withColumns({"body": body, "quotes": quotes}).select("conv_id", "turn", "role", "body", "quotes")


def conversation_key() -> Column:
    return F.coalesce(F.concat(F.lit("c"), F.col("conv_id").cast("string")), F.lit("null"))


def parents(messages: DataFrame, block: int = 1000) -> DataFrame:
    """messages (staged: row, conv_id, turn, body, quotes). Rows (row, parent) of the messages that quote an earlier one.

    The latest earlier turn with a hash is an as-of lookup: a running maximum within blocks of turns, and over the blocks before, of one row
    for each passage and turn. So a passage that is said and quoted countless times makes no pairs, and no task holds all of it.
    """
    asked = messages.where((F.size("quotes") > 0) & F.col("turn").isNotNull()).select(conversation_key().alias("c"), "row", F.col("turn").alias("at"), F.explode("quotes").alias("q"))
    asked = staged(asked.select("c", F.col("q.hash").alias("h"), "at", "row", "q.level", "q.part", "q.lines"), "quotes")
    lengths = staged(asked.groupBy("c").agg(F.collect_set("lines").alias("lengths")), "lengths")  # numbers of lines
    own = messages.where("turn is not null").withColumn("c", conversation_key()).join(broadcast_if_small(lengths, 100_000), "c").select("c", F.col("turn").alias("at"), "row", "body", "lengths")
    hash_ = lambda of: F.xxhash64(F.array_join(of, " "))
    paragraphs = F.transform(F.split("body", r"\n\s*\n"), lambda p: hash_(lines_of(p)))
    grams = lambda x: F.flatten(F.transform(F.filter("lengths", lambda n: n <= F.size(x)), lambda n: F.transform(F.sequence(F.lit(1), F.size(x) - n + 1), lambda i: hash_(F.slice(x, i, n)))))
    said = F.array_distinct(F.concat(bound(lines_of(F.col("body")), lambda x: F.concat(F.array(hash_(x)), grams(x))), paragraphs))
    own = own.select("c", "at", "row", F.explode(said).alias("h")).join(broadcast_if_small(staged(asked.select("c", "h").distinct(), "asked")), ["c", "h"], "left_semi")
    said = own.groupBy("c", "h", "at").agg(F.min("row").alias("parent")).select("c", "h", "at", F.struct(F.col("at").alias("said"), "parent").alias("s"), F.lit(1).alias("kind"))
    none = F.lit(None).cast("struct<said:bigint,parent:bigint>")
    both = said.union(asked.select("c", "h", "at").distinct().select("c", "h", "at", none.alias("s"), F.lit(0).alias("kind")))
    both = staged(both.withColumn("block", F.floor(F.col("at") / block)), "turns")
    upto = Window.partitionBy("c", "h", "block").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = Window.partitionBy("c", "h").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = both.groupBy("c", "h", "block").agg(F.max("s").alias("m")).select("c", "h", "block", F.max("m").over(earlier).alias("before"))
    found = both.withColumn("within", F.max("s").over(upto)).where("kind = 0").join(blocks, ["c", "h", "block"]).select("c", "h", "at", F.coalesce("within", "before").alias("s")).where("s is not null")
    hit = asked.join(broadcast_if_small(staged(found, "found"), 100_000), ["c", "h", "at"])
    return hit.groupBy("row").agg(F.min_by("s.parent", F.struct(F.col("level"), F.col("part"), -F.col("s.said"), F.col("s.parent"))).alias("parent"))


def range_sorted(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """df (order: columns that make rows unique), staged in range-sorted partitions numbered by `part`: no key is one task, however many rows it has."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return staged(df.repartitionByRange(n, *order).withColumn("part", F.spark_partition_id()), name)


def sums_before(df: DataFrame, order: list[str], value: str, name: str) -> DataFrame:
    """df with `before`: the sum of `value` over all rows before, in the order of the columns. Prefix sums within partitions, then over partitions."""
    rows = range_sorted(df, order, name)
    upto = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    parts = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    totals = rows.groupBy("part").agg(F.sum(value).alias("total")).select("part", F.coalesce(F.sum("total").over(parts), F.lit(0)).alias("offset"))
    return rows.withColumn("within", F.coalesce(F.sum(value).over(upto), F.lit(0))).join(F.broadcast(totals), "part").withColumn("before", F.col("within") + F.col("offset")).drop("part", "within", "offset")


def next_sibling(children: DataFrame) -> DataFrame:
    """children: up, turn, row. Staged with `after`, the next row of the same parent by turn and row."""
    rows = range_sorted(children, ["up", "turn", "row"], "siblings")
    lead = lambda x: F.lead(x).over(Window.partitionBy("part").orderBy("up", "turn", "row"))
    # the first row of the next partition, for the last of each
    firsts = rows.groupBy("part").agg(F.min(F.struct("up", "turn", "row")).alias("f")).select("part", F.lead("f").over(Window.orderBy("part")).alias("f"))
    out = rows.withColumns({"up2": lead("up"), "row2": lead("row")}).join(F.broadcast(firsts), "part")
    out = out.withColumns({"row2": F.coalesce("row2", F.when(F.col("up2").isNull(), F.col("f.row"))), "up2": F.coalesce("up2", "f.up")})
    return staged(out.select("up", "turn", "row", F.when(F.col("up2") == F.col("up"), F.col("row2")).alias("after")), "siblings")


def tours(links: DataFrame, turns: DataFrame) -> DataFrame:
    """links (staged: row, parent); turns: row, turn. For each message of a tree of two or more: row, root, place in the tree, depth, and size of the tree (at the root).

    An Euler tour enters and leaves each message once: entering goes on to the first reply, or leaves; leaving goes on to the next reply to the same
    message, or leaves that message. Doubling the pointers gives the numbers of enterings, and of enterings less leavings, from each step to the end.
    """
    spark = links.sparkSession
    children = next_sibling(links.select(F.col("parent").alias("up"), "row").join(turns, "row").select("up", "turn", "row"))
    first = children.groupBy("up").agg(F.min_by("row", F.struct("turn", "row")).alias("first"))
    nodes = staged(children.select("row", "up", "after").join(first.select(F.col("up").alias("row"), "first"), "row", "full_outer"), "nodes")
    enter, leave = lambda x: F.col(x) * 2, lambda x: F.col(x) * 2 + 1
    steps = F.array(
        F.struct(enter("row").alias("x"), F.coalesce(enter("first"), leave("row")).alias("to"), F.lit(1).cast("long").alias("enters"), F.lit(1).cast("long").alias("level")),
        F.struct(leave("row").alias("x"), F.coalesce(enter("after"), leave("up")).alias("to"), F.lit(0).cast("long").alias("enters"), F.lit(-1).cast("long").alias("level")),
    )
    now = staged(nodes.select(F.explode(steps).alias("s")).select("s.*", F.col("s.x").alias("last")), "tour")
    while not now.where("to is not null").isEmpty():
        onward = now.select(F.col("x").alias("to"), F.col("to").alias("to2"), F.col("enters").alias("enters2"), F.col("level").alias("level2"), F.col("last").alias("last2"))
        moved = now.where("to is not null").join(onward, "to").select("x", F.col("to2").alias("to"), (F.col("enters") + F.col("enters2")).alias("enters"), (F.col("level") + F.col("level2")).alias("level"), F.col("last2").alias("last"))
        before, now = now, staged(now.where("to is null").union(moved), "tour")
        drop_staged(spark, before)
    entered = now.where("x % 2 = 0").select(F.expr("x div 2").alias("row"), F.expr("last div 2").alias("root"), "enters", (-F.col("level")).alias("depth"))
    sizes = entered.where("row = root").select("root", F.col("enters").alias("size"))
    return staged(entered.join(sizes, "root").select("row", "root", (F.col("size") - F.col("enters")).alias("at"), "depth", "size"), "tours")


def conversations(messages: DataFrame, block: int = 1000) -> DataFrame:
    """conv_id, turn, role, body, parent_turn, depth and `place`, gapless from 0 in reply order within the conversation, for each message."""
    rows = staged(parsed(messages).withColumn("row", F.monotonically_increasing_id()).withColumn("c", conversation_key()), "messages")
    links = staged(parents(rows, block), "parents")
    trees = tours(links, rows.select("row", "turn")) if not links.isEmpty() else links.select("row", F.col("parent").alias("root"), F.lit(0).alias("at"), F.lit(0).alias("depth"), F.lit(1).alias("size"))
    one = rows.select("row", "c", "turn").join(broadcast_if_small(trees, 100_000), "row", "left")
    one = staged(one.select("row", "c", "turn", F.coalesce("root", "row").alias("root"), *(F.coalesce(F.col(n).cast("long"), F.lit(v).cast("long")).alias(n) for n, v in (("at", 0), ("depth", 0), ("size", 1)))), "order")
    roots = sums_before(one.where("root = row").select("c", "turn", F.col("row").alias("root"), "size"), ["c", "turn", "root"], "size", "roots")
    roots = staged(roots.select("c", "root", "before"), "roots")
    starts = broadcast_if_small(staged(roots.groupBy("c").agg(F.min("before").alias("start")), "starts"), 100_000)
    roots = roots.join(starts, "c").select("root", (F.col("before") - F.col("start")).alias("begin"))
    places = one.join(roots, "root").select("row", "depth", (F.col("begin") + F.col("at")).alias("place"))
    turns = links.join(rows.select(F.col("row").alias("parent"), F.col("turn").alias("parent_turn")), "parent").select("row", "parent_turn")
    out = rows.join(places, "row").join(broadcast_if_small(staged(turns, "turns"), 100_000), "row", "left")
    return out.select("conv_id", "turn", "role", "body", "parent_turn", "depth", "place")


def op6_quotation_linking(spark, sf_dir: str) -> DataFrame:
    """All conversations, in reply order."""
    out = conversations(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return out.select("conv_id", "turn", "role", F.col("body").alias("text"), "parent_turn", F.col("depth").cast("int").alias("depth"), "place")
