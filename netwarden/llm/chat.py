"""Reply trees as training conversations: paths by iterated self-joins, the best of them formatted.

A message knows its parent. Joining the table of jumps with itself doubles how far each message sees, so
the depth, the summed score and the root of all messages are known after a number of joins that grows
with the logarithm of the longest path. Leaves are ranked by the mean score of their path; the
paths of the chosen leaves are walked back through the same jump tables.

Template of a turn: ``<turn>role``, line break, text, ``</turn>``, line break. In texts one backslash is put
into each ``<turn`` or ``</turn``, behind the bracket and before any that are there already, and taken out
again when read. In roles, line breaks and backslashes are written as backslash sequences.

Defined cases: a message without a parent in its tree is a root; a tree or message id may be null and is
then an id like others; messages that reach no root because of a cycle are on no path; null roles and
texts are empty, null scores zero; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from netwarden.llm.common import running
from netwarden.plans.scale import stage

OPEN, CLOSE = "<turn>", "</turn>\n"
CONTROL = r"<(\\*)(/?turn)"
ESCAPED = r"<\\(\\*)(/?turn)"
LEARNED = "assistant"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, r"<\\$1$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, "<$1$2")


def escape_role(role: Column) -> Column:
    return F.replace(F.replace(escape(role), F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    broken = F.regexp_replace(role, r"(?<!\\)((?:\\\\)*)\\n", "$1\n")
    return unescape(F.replace(broken, F.lit("\\\\"), F.lit("\\")))


def chains(rows: DataFrame, tree: str, order: list[str]) -> DataFrame:
    """Rows of plain conversations as messages, each the reply to the one before it in ``order``."""
    nth = F.row_number().over(Window.partitionBy(tree).orderBy(*order)).cast("long")
    numbered = rows.withColumn("node", nth)
    return numbered.withColumn("parent", F.when(F.col("node") > 1, F.col("node") - 1))


def best_paths(messages: DataFrame, best: int = 1) -> DataFrame:
    """``(tree, leaf, rank, node, depth)``: the messages on the ``best`` ranked paths of each tree.

    ``messages`` has ``tree, node, parent, score``; ``node`` is unique in its tree.
    """
    known = messages.select(
        F.struct("tree", "node").alias("at"),
        F.when(F.col("parent").isNotNull(), F.struct("tree", F.col("parent").alias("node"))).alias("up"),
        F.coalesce("score", F.lit(0.0)).cast("double").alias("score"),
    )
    present = known.select(F.col("at").alias("up"), F.lit(True).alias("there"))
    jumps = known.join(present, known["up"].eqNullSafe(present["up"]), "left").select(
        "at", F.when(F.col("there"), known["up"]).alias("up"), "score", F.lit(1).cast("long").alias("depth")
    )
    jumps = stage(jumps, "jumps0")
    parents = jumps
    tables, most = [jumps], jumps.count()
    while jumps.where(F.col("up").isNotNull()).limit(1).count() and 1 << (len(tables) - 1) <= most:
        upper = jumps.select(
            F.col("at").alias("up"), F.col("up").alias("top"), F.col("score").alias("s"), F.col("depth").alias("d")
        )
        joined = jumps.join(upper, "up", "left").select(
            "at",
            F.col("top").alias("up"),
            (F.col("score") + F.coalesce("s", F.lit(0.0))).alias("score"),
            (F.col("depth") + F.coalesce("d", F.lit(0))).alias("depth"),
        )
        jumps = stage(joined, f"jumps{len(tables)}")
        tables.append(jumps)
    # Whoever still has somewhere to jump runs in a circle.
    settled = jumps.where(F.col("up").isNull())
    inner = parents.where(F.col("up").isNotNull()).select(F.col("up").alias("at")).distinct()
    leaves = settled.join(inner, "at", "left_anti")
    order = Window.partitionBy("at.tree").orderBy(F.desc(F.col("score") / F.col("depth")), "at.node")
    ranked = leaves.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best)
    path = stage(ranked.select(F.col("at").alias("leaf"), "rank", "at"), "path")
    for jumps_back in reversed(tables[:-1]):
        moved = path.join(jumps_back.select("at", "up"), "at").where(F.col("up").isNotNull())
        # Written each time: otherwise every round would repeat the plans of all rounds before it.
        path = stage(path.union(moved.select("leaf", "rank", F.col("up").alias("at"))).distinct(), "path")
    depth = settled.select("at", "depth")
    return path.join(depth, "at").select(
        F.col("at.tree").alias("tree"), F.col("leaf.node").alias("leaf"), "rank", F.col("at.node").alias("node"), "depth"
    )


def formatted(messages: DataFrame, best: int = 1) -> DataFrame:
    """``(tree, leaf, rank, text, loss)``: each chosen path as one text, and where its learned parts lie.

    ``loss`` lists ``(start, end)`` of the assistant's texts, in code points.
    """
    paths = stage(best_paths(messages, best), "paths")
    said = messages.select(
        F.struct("tree", "node").alias("at"),
        escape_role(F.coalesce("role", F.lit(""))).alias("head"),
        escape(F.coalesce("text", F.lit(""))).alias("body"),
        F.coalesce(F.col("role") == LEARNED, F.lit(False)).alias("learned"),
    )
    lines = paths.withColumn("at", F.struct("tree", "node")).join(said, "at")
    turns = lines.groupBy("tree", "leaf", "rank").agg(
        F.sort_array(F.collect_list(F.struct("depth", "head", "body", "learned"))).alias("turns")
    )
    written = F.transform(
        "turns", lambda t: F.concat(F.lit(OPEN), t["head"], F.lit("\n"), t["body"], F.lit(CLOSE))
    )

    def step(at, t):
        begin = at + len(OPEN) + F.length(t["head"]) + 1
        end = begin + F.length(t["body"])
        return end + len(CLOSE), F.when(t["learned"], F.struct(begin.alias("start"), end.alias("end")))

    loss = running(F.col("turns"), "struct<start:int,end:int>", step)
    return turns.select("tree", "leaf", "rank", F.array_join(written, "").alias("text"), loss.alias("loss"))


def turns_of(text: Column) -> Column:
    """``[(role, text)]`` read back from a formatted conversation."""
    pieces = F.filter(F.split(text, CLOSE), lambda p: p != "")

    def read(piece):
        inner = F.substr(piece, F.lit(len(OPEN) + 1))
        head = F.substring_index(inner, "\n", 1)
        body = F.substr(inner, F.length(head) + 2)
        return F.struct(unescape_role(head).alias("role"), unescape(body).alias("text"))

    return F.transform(pieces, read)


def learned_text(text: Column, loss: Column) -> Column:
    """What lies under the loss mask, unescaped."""
    return F.array_join(F.transform(loss, lambda s: unescape(F.substr(text, s["start"] + 1, s["end"] - s["start"]))), "")
