"""Building blocks that keep every task bounded when one key holds much of the data.

* ``stage``            writes an intermediate result to the shared checkpoint folder,
* ``pin_small``        turns a result into a local relation, only behind a row-count check,
* ``take_by_hash``     exact "first n per class in hash order" without ranking the data,
* ``index_by_hash``    exact dense 0-based index per class without a per-class sort,
* ``running_totals``   exact running sums over a total order without a one-task window.
"""

from __future__ import annotations

import math
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Rows a single window group may hold before it is split into more hash ranges.
GROUP_ROWS = 1 << 20
# Rows a result may have to become a local relation (and so a broadcast candidate).
SMALL_ROWS = 20_000
# Rows that one task of a look-up by shuffle should read.
TASK_ROWS = 1 << 20


# Folders made for local applications whose session names none, as in tests.
_OWN_FOLDERS: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a temporary one only for a local session without any.

    On a cluster a folder of the driver's own is invisible to executors, so a missing setting is an error there.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        if app not in _OWN_FOLDERS:
            _OWN_FOLDERS[app] = tempfile.mkdtemp(prefix="netwarden-")
        folder = _OWN_FOLDERS[app]
    return folder.rstrip("/")


def stage_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def remove_at_exit(spark: SparkSession, path: str) -> None:
    """Have the file system delete ``path`` when the application ends."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).deleteOnExit(place)


def stage(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` once and read it back: lineage is cut and lost executors cost nothing."""
    path = stage_path(df.sparkSession, name)
    df.write.parquet(path)
    remove_at_exit(df.sparkSession, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def pin_small(df: DataFrame, limit: int | None = None) -> DataFrame:
    """A local copy of ``df`` if it has at most ``limit`` rows (``SMALL_ROWS``), else ``df`` unchanged.

    Only a result that passed the check becomes cheap to broadcast; a larger one stays
    distributed and joins by shuffle (adaptive execution splits skewed partitions).
    """
    limit = SMALL_ROWS if limit is None else limit
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        return df
    return df.sparkSession.createDataFrame(rows, df.schema)


def seats(spark: SparkSession, n: int) -> list[int]:
    """``n`` keys that ``repartition(n, key)`` puts into as many different partitions, so that no task gets two of them."""
    found: dict[int, int] = {}
    tried = spark.range(32 * n).select("id", F.pmod(F.hash("id"), F.lit(n)).alias("p"))
    for r in tried.groupBy("p").agg(F.min("id").alias("id")).collect():
        found[r["p"]] = r["id"]
    # A partition that no key was found for shares another's task; keys differ all the same.
    return [found.get(p, 32 * n + p) for p in range(n)]


def hash_hex(seed: str | int, *parts: Column) -> Column:
    """Hex digest of ``seed:part:part...``; the deterministic source of every random choice."""
    pieces = [F.lit(str(seed))]
    for part in parts:
        pieces += [F.lit(":"), part.cast("string")]
    return F.md5(F.concat(*pieces).cast("binary"))


def hash_unit(seed: str | int, *parts: Column) -> Column:
    """Uniform double in [0, 1) from the first 32 bits of the digest."""
    head = F.conv(F.substring(hash_hex(seed, *parts), 1, 8), 16, 10).cast("double")
    return head / F.lit(4294967296.0)


# MD5's turns and constants, step by step, and where its four words start.
_TURNS = [t for four in ([7, 12, 17, 22], [5, 9, 14, 20], [4, 11, 16, 23], [6, 10, 15, 21]) for t in four * 4]
_SINES = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)


def _first_words(fixed: np.ndarray, moving: dict[int, np.ndarray]) -> np.ndarray:
    """First 32 bits of the MD5 digests of one-block messages: ``fixed`` words that all share, plus ``moving`` ones."""
    n = len(next(iter(moving.values())))
    a, b, c, d = (np.full(n, v, np.uint32) for v in _START)
    mix, low = np.empty(n, np.uint32), np.empty(n, np.uint32)
    for i in range(64):
        if i < 16:
            place = i
            np.bitwise_xor(c, d, out=mix)
            mix &= b
            mix ^= d
        elif i < 32:
            place = (5 * i + 1) % 16
            np.bitwise_xor(b, c, out=mix)
            mix &= d
            mix ^= c
        elif i < 48:
            place = (3 * i + 5) % 16
            np.bitwise_xor(b, c, out=mix)
            mix ^= d
        else:
            place = 7 * i % 16
            np.invert(d, out=mix)
            mix |= b
            mix ^= c
        a += mix
        a += np.uint32((_SINES[i] + int(fixed[place])) % 2**32)
        if place in moving:
            a += moving[place]
        np.right_shift(a, np.uint32(32 - _TURNS[i]), out=low)
        a <<= np.uint32(_TURNS[i])
        a |= low
        a += b
        a, b, c, d = d, a, b, c
    return (a + np.uint32(_START[0])).byteswap()


def hash_units(seeds: list[str], ids: np.ndarray) -> np.ndarray:
    """``hash_unit(seed, id)`` inside a task, one row per seed: digests of a whole batch of ids at a time."""
    out = np.empty((len(seeds), len(ids)))
    text = ids.astype("S20")
    sizes = np.char.str_len(text)
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        digits = text[at].view(np.uint8).reshape(len(at), -1)[:, :size]
        moving: dict[int, dict[int, np.ndarray]] = {}
        for row, seed in enumerate(seeds):
            head = f"{seed}:".encode()
            first, end = len(head), len(head) + int(size)
            if end > 55:
                raise ValueError("seed and id must fit into one block of MD5")
            if first not in moving:
                block = np.zeros((len(at), 64), np.uint8)
                block[:, first:end] = digits
                words = block.view("<u4")
                moving[first] = {w: words[:, w].astype(np.uint32) for w in range(first // 4, (end + 3) // 4)}
            message = head + bytes(int(size)) + b"\x80" + bytes(55 - end) + (8 * end).to_bytes(8, "little")
            out[row, at] = _first_words(np.frombuffer(message, "<u4"), moving[first]) / 4294967296.0
    return out


def _prefix_length(rows: int) -> int:
    return max(1, min(8, math.ceil(math.log(max(rows, 1) / GROUP_ROWS, 16)) + 1))


def _with_hash(df: DataFrame, row_id: str, seed: str | int, rows: int) -> DataFrame:
    hashed = df.withColumn("__h", hash_hex(seed, F.col(row_id)))
    return hashed.withColumn("__p", F.substring("__h", 1, _prefix_length(rows)))


def _prefix_totals(hashed: DataFrame, group: str) -> DataFrame:
    """Rows per (class, hash prefix) with running totals; one row per prefix, not per row."""
    counts = hashed.groupBy(group, "__p").agg(F.count(F.lit(1)).alias("__n"))
    upto = Window.partitionBy(group).orderBy("__p")
    return counts.withColumn("__upto", F.sum("__n").over(upto))


def mark_by_hash(
    df: DataFrame, group: str, row_id: str, quotas: DataFrame, seed: str | int, rows: int, name: str = "taken"
) -> DataFrame:
    """Add ``name``: whether the row's rank in its class, in hash order, is within the quota.

    ``quotas`` has ``(group, quota)``. Only the one hash range per class that contains the
    cut is ranked; every other row is decided by comparing its digest with the cut, so the
    data itself is never shuffled.
    """
    hashed = _with_hash(df, row_id, seed, rows)
    totals = _prefix_totals(hashed, group)
    edge = pin_small(
        totals.join(quotas, group)
        .where((F.col("quota") > F.col("__upto") - F.col("__n")) & (F.col("quota") <= F.col("__upto")))
        .select(group, "__p", (F.col("quota") - F.col("__upto") + F.col("__n")).alias("__need"))
    )
    order = Window.partitionBy(group, "__p").orderBy("__h", row_id)
    cuts = pin_small(
        hashed.select(group, row_id, "__h", "__p")
        .join(edge, [group, "__p"])
        .withColumn("__rn", F.row_number().over(order))
        .where(F.col("__rn") == F.col("__need"))
        .select(group, F.col("__h").alias("__cut"), F.col(row_id).alias("__cut_id"))
    )
    below = (F.col("__h") < F.col("__cut")) | (
        (F.col("__h") == F.col("__cut")) & (F.col(row_id) <= F.col("__cut_id"))
    )
    return (
        hashed.join(cuts, group, "left")
        .withColumn(name, F.coalesce(below, F.lit(False)))
        .drop("__h", "__p", "__cut", "__cut_id")
    )


def take_by_hash(
    df: DataFrame, group: str, row_id: str, quotas: DataFrame, seed: str | int, rows: int
) -> DataFrame:
    """The first ``quota`` rows of each class in hash order, exactly."""
    return mark_by_hash(df, group, row_id, quotas, seed, rows, "__in").where("__in").drop("__in")


def index_by_hash(
    df: DataFrame, group: str, row_id: str, seed: str | int, rows: int, name: str = "idx"
) -> DataFrame:
    """Dense 0-based index of each row within its class, in hash order.

    Rows are numbered inside short hash ranges and shifted by the rows of earlier ranges.
    """
    hashed = _with_hash(df, row_id, seed, rows)
    shifts = pin_small(
        _prefix_totals(hashed, group).select(
            group, "__p", (F.col("__upto") - F.col("__n")).alias("__shift")
        )
    )
    order = Window.partitionBy(group, "__p").orderBy("__h", row_id)
    return (
        hashed.withColumn("__rn", F.row_number().over(order))
        .join(shifts, [group, "__p"])
        .withColumn(name, (F.col("__shift") + F.col("__rn") - 1).cast("long"))
        .drop("__h", "__p", "__rn", "__shift")
    )


# A key holding more than this share of the rows counts as frequent; there are at most 100.
FREQUENT_SHARE = 0.01


def lookup(df: DataFrame, table: DataFrame, keys: list[str], weight: str, how: str = "inner") -> DataFrame:
    """Join ``df`` with ``table``, which has one row per key and in ``weight`` the rows of ``df`` it meets.

    A small table is broadcast after a check of its size. Of a large one the frequent keys, a
    bounded number, are broadcast and the rest is joined by shuffle; rows that already found
    their match are spread by input partition, so no key piles up in one task.
    """
    values = [c for c in table.columns if c not in keys and c != weight]
    plain = table.select(*keys, *values)
    small = pin_small(plain)
    if small is not plain:
        return df.join(small, keys, how)
    total = table.agg(F.sum(weight)).first()[0]
    frequent = pin_small(table.where(F.col(weight) > total * FREQUENT_SHARE).select(*keys, *values))
    hot = frequent.select(*keys, F.struct(*values, F.lit(True).alias("__m")).alias("__hot"))
    cold = plain.select(
        *keys, F.lit(-1).alias("__s"), F.struct(*values, F.lit(True).alias("__m")).alias("__cold")
    )
    spread = F.when(F.col("__hot").isNotNull(), F.spark_partition_id()).otherwise(-1)
    spread_rows = df.join(F.broadcast(hot), keys, "left").withColumn("__s", spread)
    # Partitions grow in number with the rows told by the weights, so that none grows in size.
    parts = math.ceil((total or 0) / TASK_ROWS)
    if parts > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        spread_rows = spread_rows.repartition(parts, *keys, "__s")
    out = (
        spread_rows.join(cold, [*keys, "__s"], "left")
        .withColumn("__v", F.coalesce("__hot", "__cold"))
    )
    if how == "inner":
        out = out.where(F.col("__v").isNotNull())
    return out.select(*df.columns, *[F.col(f"__v.{c}").alias(c) for c in values])


def running_totals(
    df: DataFrame, order: list[str], sums: dict[str, str], by: list[str] | None = None
) -> DataFrame:
    """Running sums of ``sums`` (source -> output) in ``order``, separately per ``by`` key.

    Rows are range-partitioned once by key and order, and stored with their slice number, so
    a key with most of the rows spreads over many slices. Slices are summed separately; a
    slice starts from the totals of the same key in the slices before it. Only a table that
    was counted and found small skips this.
    """
    by = by or []
    stored = stage(df, "totals")
    if stored.count() <= SMALL_ROWS:
        upto = Window.partitionBy(*by).orderBy(*order)
        return stored.select("*", *[F.sum(c).over(upto).alias(t) for c, t in sums.items()])
    slices = stage(
        stored.repartitionByRange(*by, *order).withColumn("__slice", F.spark_partition_id()), "ranges"
    )
    totals = slices.groupBy("__slice", *by).agg(*[F.sum(c).alias(f"__t_{c}") for c in sums])
    before = Window.partitionBy(*by).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    # One row per slice, plus one per key: a key only meets the slices it spans.
    carried = pin_small(
        totals.select(
            "__slice",
            *by,
            *[F.coalesce(F.sum(f"__t_{c}").over(before), F.lit(0)).alias(f"__c_{c}") for c in sums],
        )
    )
    inside = Window.partitionBy("__slice", *by).orderBy(*order)
    out = slices.select(
        "*", *[F.sum(c).over(inside).alias(f"__r_{c}") for c in sums]
    ).join(carried, ["__slice", *by])
    for source, target in sums.items():
        out = out.withColumn(target, F.col(f"__c_{source}") + F.col(f"__r_{source}"))
    drop = ["__slice"] + [f"__{p}_{c}" for p in "rc" for c in sums]
    return out.drop(*drop)


def exact_quantiles(df: DataFrame, value: str, shares: list[float], by: list[str] | None = None) -> DataFrame:
    """Linearly interpolated quantiles ``q_0, q_1, ...`` of ``shares``, one row per ``by`` key.

    Values are counted, ranked by running totals and picked by position; nothing holds the
    values of a key in one place.
    """
    by = by or []
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("__v")).agg(
        F.count(F.lit(1)).alias("__n")
    )
    ranked = running_totals(counts, ["__v"], {"__n": "__upto"}, by=by)
    if by:
        sizes = ranked.groupBy(*by).agg(F.max("__upto").alias("__size"))
        ranked = ranked.join(sizes, by)
    else:
        ranked = ranked.withColumn("__size", ranked.agg(F.max("__upto")).scalar())
    picks = []
    for i, share in enumerate(shares):
        place = (F.col("__size") - 1) * F.lit(float(share))
        for name, at in ((f"__lo{i}", F.floor(place)), (f"__hi{i}", F.ceil(place))):
            inside = (F.col("__upto") > at) & (F.col("__upto") - F.col("__n") <= at)
            picks.append(F.max(F.when(inside, F.col("__v"))).alias(name))
    out = ranked.groupBy(*by).agg(F.max("__size").alias("__size"), *picks)
    return out.select(
        *by,
        *[
            (
                F.col(f"__lo{i}")
                + (F.col(f"__hi{i}") - F.col(f"__lo{i}"))
                * (F.pmod((F.col("__size") - 1) * F.lit(float(share)), F.lit(1.0)))
            ).alias(f"q_{i}")
            for i, share in enumerate(shares)
        ],
    )


def repeat_rows(df: DataFrame, count: str, number: str, chunk: int = 1 << 16) -> DataFrame:
    """Each row ``count`` times with ``number`` = 0.., spread so that one row may repeat without bound."""
    chunks = df.where(F.col(count) > 0).withColumn(
        "__chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"({count} - 1) div {chunk}")))
    )
    first = F.col("__chunk") * chunk
    last = F.least(first + chunk, F.col(count)) - 1
    return (
        chunks.repartition("__chunk", *[c for c, t in df.dtypes if t in ("bigint", "int", "string")])
        .withColumn(number, F.explode(F.sequence(first, last)))
        .drop("__chunk")
    )
