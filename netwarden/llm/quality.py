"""Quality rules whose cutoffs carry a guarantee: at most a given share of good documents is rejected.

Every rule compares one measure of a text with a cutoff. Which cutoffs may be used is decided on
labelled documents (holdouts: the cutoffs are listed beforehand and not fitted to them). Within a
stratum, a language, the cutoffs of a rule are tested from lenient to strict. A cutoff passes if the
exact binomial probability of rejecting no more good documents than it did, were its true rate above
``ALPHA`` shared by the rules, is at most ``DELTA`` shared by all rules and strata (Bonferroni). The
first failure ends the series (fixed-sequence testing, which needs no further correction), so with
probability ``1 - DELTA`` no stratum loses more than ``ALPHA`` of its good documents to all rules together.

A stratum with too few good labels to certify any cutoff is judged by the pooled stratum, which takes in
all such strata; if that is too small as well, only the fixed base rules reject. How many labels are enough
depends on the number of strata, as all share ``DELTA``: from the best labelled language down, as many get
cutoffs of their own as could certify one beside the others and the pool.

Defined cases: a null text has no words and fails the base rules; a document labelled more than once is
good only if all labels say so; null labels are ignored; null languages belong to the pooled stratum;
repeated rows get the same verdict; empty tables give an empty result; other columns are untouched.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from netwarden.llm.common import SPACES, sent, words, wrapped
from netwarden.plans.scale import stage

ALPHA = 0.03
DELTA = 0.05
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
POOLED = "*"

# Rules: name -> (left side, right side without the cutoff, cutoffs from lenient to strict).
# A text is rejected where left > cutoff * right; all are whole numbers.
RULES = {
    "symbols": ("1000 * n_symbols", "word_chars", [300, 250, 200, 150, 120, 100, 80, 60]),
    "repeats": ("100 * n_repeat_words", "n_words", [45, 40, 35, 30]),
    "same_lines": ("100 * n_dup_lines", "n_lines", [60, 50, 40, 30]),
    "capitals": ("100 * n_capitals", "word_chars", [60, 50, 40, 30]),
    "shouts": ("100 * n_shouts", "n_words", [60, 50, 40, 30, 20, 15]),
    "long_words": ("10 * word_chars", "n_words", [200, 180, 160, 140, 120]),
}
COUNTS = [
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_shouts",
]


def _repeat_words(w: Column) -> Column:
    """Words inside 3-word windows that occur twice or more.

    Windows are compared by a 64-bit hash. Where all differ nothing is sorted; otherwise windows are
    sorted by hash, those next to an equal one are kept, and the places they cover are added up.
    """
    last = F.size(w) - 3
    grams = F.transform(
        F.sequence(F.lit(0), F.greatest(last, F.lit(0))),
        lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)),
    )

    def covered(g: Column) -> Column:
        pairs = F.sort_array(F.transform(g, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def found(sorted_pairs: Column) -> Column:
            def twin(x, j):
                before = F.get(sorted_pairs, j - 1)["h"] == x["h"]
                after = F.get(sorted_pairs, j + 1)["h"] == x["h"]
                return F.coalesce(before, F.lit(False)) | F.coalesce(after, F.lit(False))

            return F.sort_array(F.transform(F.filter(sorted_pairs, twin), lambda x: x["i"]))

        at = _with(pairs, found)
        start = F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last"))
        return F.aggregate(
            at,
            start,
            lambda a, i: F.struct(
                (a["n"] + F.least(F.lit(3), i - a["last"])).alias("n"), i.alias("last")
            ),
            lambda a: a["n"],
        )

    def counted(g: Column) -> Column:
        return F.when(F.size(F.array_distinct(g)) == F.size(g), 0).otherwise(covered(g))

    return F.when(last < 0, 0).otherwise(_with(grams, counted))


def _with(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once per row."""
    return F.get(F.transform(F.array(value), use), 0)


def features(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the struct ``measures`` of ``COUNTS``, all longs."""
    whole = F.coalesce(F.col(text), F.lit(""))
    w = F.col("__words")
    lines = F.filter(F.split(whole, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    counts = {
        "n_words": F.size(w),
        "word_chars": F.length(F.array_join(w, "")),
        "n_symbols": F.regexp_count(whole, F.lit("[#*$%&|<>]")),
        "n_dup_lines": _with(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))),
        "n_repeat_words": _repeat_words(w),
        "n_lines": F.size(F.split(whole, "\n")),
        "n_capitals": F.regexp_count(whole, F.lit("[A-Z]")),
        "n_shouts": F.regexp_count(whole, F.lit("[!?]")),
    }
    measures = F.struct(*[c.cast("long").alias(n) for n, c in counts.items()])
    # The generator keeps the optimizer from computing the measures anew wherever one is used.
    worded = docs.withColumn("__words", words(F.col(text)))
    return worded.withColumn("measures", F.explode(F.array(measures))).drop("__words")


def base_failed(m: str = "measures.") -> Column:
    few = F.col(f"{m}n_words") < MIN_WORDS
    return few | (100 * F.col(f"{m}n_repeat_words") > MAX_REPEAT_PERCENT * F.col(f"{m}n_words"))


def _fires(rule: str, cutoff: Column | int, m: str = "measures.") -> Column:
    left, right, _ = RULES[rule]
    factor, name = left.split(" * ")
    return int(factor) * F.col(f"{m}{name}") > cutoff * F.col(f"{m}{right}")


def binomial_tail(k: Column, n: Column, rate: float) -> Column:
    """Exact ``P(Bin(n, rate) <= k)`` for ``k`` below the mean, else 1; summed down from its largest term."""
    odds = math.log(rate) - math.log1p(-rate)
    steps = F.filter(F.sequence(F.lit(0).cast("long"), k), lambda i: i > 0)
    top = F.aggregate(steps, F.lit(0.0), lambda a, i: a + F.log((n - i + 1) / i))
    top = top + k * F.lit(odds) + n * F.lit(math.log1p(-rate))
    start = F.struct(F.lit(1.0).alias("sum"), F.lit(1.0).alias("term"))

    def down(a, i):
        j = k - i + 1
        term = a["term"] * j / (n - j + 1) * F.lit(math.exp(-odds))
        return F.struct((a["sum"] + term).alias("sum"), term.alias("term"))

    total = F.aggregate(steps, start, down, lambda a: a["sum"])
    return F.when(k >= n * F.lit(rate), 1.0).otherwise(F.exp(top) * total)


def least_labels(strata: Column | int) -> Column:
    """Good documents that certify a cutoff which rejects none of them, if ``strata`` share ``DELTA``."""
    share = F.lit(DELTA / len(RULES)) / strata
    return F.ceil(F.log(share) / F.lit(math.log1p(-ALPHA / len(RULES))))


def cutoffs(measured: DataFrame, labels: DataFrame, row_id: str = "doc_id", stratum: str = "lang") -> DataFrame:
    """``(stratum, rule, cutoff, n_good, n_rejected)``: the strictest certified cutoff of each rule.

    ``measured`` has ``measures``. All sums are combined before the shuffle, and what remains is a row
    per stratum, rule and cutoff.
    """
    good = (
        labels.where(F.col(row_id).isNotNull() & F.col("quality").isNotNull())
        .groupBy(F.col(row_id).alias("__label"))
        .agg(F.min("quality").alias("q"))
        .where("q = 1")
    )
    judged = measured.join(good, measured[row_id] == F.col("__label"), "left_semi").where(~base_failed())
    cells = [(rule, nth, cut) for rule, (_, _, cuts) in RULES.items() for nth, cut in enumerate(cuts)]
    sums = [
        F.sum(F.when(_fires(rule, cut), 1).otherwise(0)).cast("long").alias(f"k_{rule}_{nth}")
        for rule, nth, cut in cells
    ]
    own = stage(judged.groupBy(F.col(stratum).alias("stratum")).agg(F.count(F.lit(1)).alias("n"), *sums), "labelled")
    # Languages that could have cutoffs of their own beside the pool; one row each, with labels by the hundred.
    able = own.where(F.col("stratum").isNotNull() & (F.col("n") >= least_labels(F.lit(2))))
    ranked = able.select(
        "stratum", "n", F.row_number().over(Window.orderBy(F.desc("n"), "stratum")).alias("nth")
    )
    upto = ranked.where(F.col("n") >= least_labels(F.col("nth") + 1)).agg(F.max("nth")).first()[0] or 0
    names = ranked.where(F.col("nth") <= upto).select(F.col("stratum").alias("__big"))
    big = own.join(names, F.col("stratum") == F.col("__big"), "left_semi")
    rest = own.join(names, F.col("stratum") == F.col("__big"), "left_anti")
    numbers = ["n", *[f"k_{rule}_{nth}" for rule, nth, _ in cells]]
    pooled = rest.select(F.lit(POOLED).alias("stratum"), *numbers).groupBy("stratum").agg(
        *[F.sum(c).alias(c) for c in numbers]
    )
    counted = stage(big.unionByName(pooled), "strata")
    tests = (upto + 1) * len(RULES)
    tries = counted.select(
        "stratum",
        "n",
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(rule).alias("rule"), F.lit(nth).alias("nth"), F.lit(cut).alias("cutoff"),
                        F.col(f"k_{rule}_{nth}").alias("k"),
                    )
                    for rule, nth, cut in cells
                ]
            )
        ).alias("x"),
    ).select("stratum", "n", "x.*")
    tail = binomial_tail(F.col("k"), F.col("n"), ALPHA / len(RULES))
    tested = tries.withColumn("passes", tail <= F.lit(DELTA / tests))
    upto = Window.partitionBy("stratum", "rule").orderBy("nth")
    certified = tested.withColumn("all", F.min("passes").over(upto)).where("all")
    best = certified.groupBy("stratum", "rule").agg(
        F.max_by(F.struct("cutoff", "n", "k"), "nth").alias("b")
    )
    return best.select(
        "stratum", "rule", F.col("b.cutoff").alias("cutoff"), F.col("b.n").alias("n_good"),
        F.col("b.k").alias("n_rejected"),
    ).unionByName(
        counted.select("stratum", F.lit("").alias("rule"), F.lit(None).cast("int").alias("cutoff"),
                       F.col("n").alias("n_good"), F.lit(None).cast("long").alias("n_rejected"))
    )


def with_verdict(measured: DataFrame, certified: DataFrame, stratum: str = "lang") -> DataFrame:
    """``measured`` with ``base_failed`` and ``kept``; a row per stratum joins, broadcast if there are few."""
    table = certified.groupBy("stratum").agg(
        *[F.max(F.when(F.col("rule") == r, F.col("cutoff"))).alias(r) for r in RULES]
    )
    cuts = F.struct(*RULES)
    own = table.select(F.col("stratum").alias("__stratum"), cuts.alias("__own"))
    pooled = table.where(F.col("stratum") == POOLED).select(cuts.alias("__pooled"))
    shared = pooled.first()
    met = measured.join(sent(own), F.col(stratum) == F.col("__stratum"), "left")

    def cutoff(rule: str) -> Column:
        value = shared["__pooled"][rule] if shared else None
        return F.when(F.col("__own").isNotNull(), F.col(f"__own.{rule}")).otherwise(F.lit(value).cast("int"))

    fired = reduce(lambda a, b: a | b, [F.coalesce(_fires(r, cutoff(r)), F.lit(False)) for r in RULES])
    out = met.withColumn("base_failed", base_failed()).withColumn("kept", ~base_failed() & ~fired)
    return out.drop("__stratum", "__own")


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(doc_id, measures, base_failed, kept)`` of every document; texts are measured once."""
    measured = stage(features(docs.select("doc_id", "lang", "text")).drop("text"), "measures")
    return with_verdict(measured, cutoffs(measured, labels)).drop("lang")


def kept_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep.

    Every text is measured once and stored beside its measures unless the base rules reject it; labels
    then meet measures only, and the cutoffs come to the stored rows without a shuffle.
    """
    rows = wrapped(docs).select("row", F.col("row.doc_id"), F.col("row.lang"), F.col("row.text"))
    measured = stage(features(rows).drop("text").where(~base_failed()), "measures")
    certified = stage(cutoffs(measured.select("doc_id", "lang", "measures"), labels), "cutoffs")
    return with_verdict(measured.drop("doc_id"), certified).where("kept").select("row.*")
