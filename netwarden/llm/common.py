"""Text conventions and graph components shared by the corpus operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netwarden.plans.scale import pin_small, stage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACES = " \t\n\x0b\x0c\r"
BREAK = r"[\x20\x09-\x0D]+"


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case and nothing else changed; plain ``lower`` where the text is ASCII."""
    plain = F.length(text) == F.octet_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def wrapped(docs: DataFrame) -> DataFrame:
    """Each row of ``docs`` as one struct ``row``, so that no name of its columns can clash."""
    return docs.select(F.struct("*").alias("row"))


def words(text: Column) -> Column:
    """Maximal runs without ASCII white space; none for null."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, BREAK))


def sent(table: DataFrame) -> DataFrame:
    """A table that was counted and found small goes to all tasks; a larger one is joined by shuffle."""
    pinned = pin_small(table)
    return table if pinned is table else F.broadcast(pinned)


# Elements that one inner fold of ``running`` takes.
CHUNK = 256


def running(values: Column, one: str, step) -> Column:
    """The list that ``step`` makes from ``values`` while it carries an int, ``at``.

    ``step(at, value)`` gives ``(next at, element or null)``; ``one`` is the element's type. Lists grow
    within stretches of ``CHUNK`` values and are joined once per stretch, so that many values cost
    little more than few.
    """
    none = F.array().cast(f"array<{one}>")

    def stretch(every: Column):
        def grow(a, x):
            at, new = step(a["at"], x)
            more = F.when(new.isNull(), a["out"]).otherwise(F.concat(a["out"], F.array(new)))
            return F.struct(at.alias("at"), more.cast(f"array<{one}>").alias("out"))

        def join(a, chunk):
            start = F.struct(a["at"].alias("at"), none.alias("out"))
            part = F.slice(every, chunk * CHUNK + 1, F.lit(CHUNK))
            return F.aggregate(
                part, start, grow, lambda b: F.struct(b["at"].alias("at"), F.concat(a["out"], b["out"]).alias("out"))
            )

        chunks = F.sequence(F.lit(0), F.floor((F.size(every) - 1) / CHUNK).cast("int"))
        begin = F.struct(F.lit(0).alias("at"), none.alias("out"))
        return F.when(F.size(every) == 0, none).otherwise(F.aggregate(chunks, begin, join, lambda a: a["out"]))

    return F.get(F.transform(F.array(values), stretch), 0)


def connected(edges: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """``(node, root)``: for every node of the undirected ``edges`` the smallest node it is linked with.

    Every round hangs the parents of two linked nodes under the smaller grandparent and then
    shortens all paths, so rounds grow with the logarithm of the longest chain. Each round is
    written to the shared folder; nothing is collected but one sum. Joins are on nodes, whose
    links are few, or on parents, where one side has a row per node (adaptive execution
    splits the other); minima are combined before the shuffle.
    """
    pairs = edges.select(F.col(left).alias("a"), F.col(right).alias("b"))
    links = stage(pairs.union(pairs.select("b", "a")).where("a != b").distinct(), "links")
    parent = stage(
        links.groupBy("a").agg(F.min("b").alias("m")).select(
            F.col("a").alias("node"), F.least("a", "m").alias("root")
        ),
        "parents",
    )
    total = _checksum(parent)
    while True:
        upper = parent.select(F.col("node").alias("root"), F.col("root").alias("grand"))
        grand = stage(parent.join(upper, "root").select("node", "root", "grand"), "grandparents")
        near = links.join(grand.select(F.col("node").alias("b"), "grand"), "b").groupBy("a").agg(
            F.min("grand").alias("low")
        )
        hooked = grand.join(near.withColumnRenamed("a", "node"), "node")
        offers = (
            hooked.select(F.col("root").alias("node"), F.col("low").alias("root"))
            .union(hooked.select("node", F.least("grand", "low")))
        )
        parent = stage(offers.union(grand.select("node", "grand")).groupBy("node").agg(F.min("root").alias("root")), "parents")
        now = _checksum(parent)
        if now == total:
            return parent
        total = now


def _checksum(parent: DataFrame):
    """Parents only ever fall, so an equal sum means that none changed."""
    return parent.agg(F.sum(F.col("root").cast("decimal(38,0)"))).first()[0]
