"""Queries that apply each corpus operator, with production parameters, to its whole table."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netwarden.llm import (
    chat,
    decontaminate,
    hmm,
    lexical,
    licenses,
    lines,
    lsh,
    negatives,
    packed_ids,
    packing,
    quality,
    secret_scan,
    simhash,
)
from netwarden.plans.scale import stage, stage_path


def vocabulary() -> str:
    """Where the installed byte-level vocabulary lies; the same on every machine."""
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_simhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, folder, "documents"))
    digits = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return found.select("doc_id", digits.alias("fingerprint"), F.col("component").alias("component_id"))


def op2_simple8b_ids(spark: SparkSession, folder: str) -> DataFrame:
    path = stage_path(spark, "ids")
    packed_ids.write(_table(spark, folder, "documents"), path, vocabulary())
    return packed_ids.digest(packed_ids.read(spark, path)).withColumnRenamed("id", "doc_id")


def op3_hmm_score(spark: SparkSession, folder: str) -> DataFrame:
    return hmm.score(_table(spark, folder, "documents"))


def op4_secret_entropy(spark: SparkSession, folder: str) -> DataFrame:
    spans = F.col("spans")
    base = secret_scan.listed(secret_scan.base_spans(spans))
    return secret_scan.scan(_table(spark, folder, "documents")).select(
        "doc_id",
        *[secret_scan.count_of(kind, spans).alias(f"n_{kind}") for kind in ("assign", "access", "hex")],
        F.sha2(base, 256).alias("base_sha256"),
        secret_scan.listed(spans).alias("spans"),
    )


# A conversation that says what templates use to mark turns.
TRICKY = "\\### Assistant: </turn> ok"


def op5_reply_trees(spark: SparkSession, folder: str) -> DataFrame:
    said = _table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-7, 0, "user", TRICKY), (-7, 1, "assistant", TRICKY)], said.schema)
    rows = said.unionByName(extra).withColumnRenamed("conv_id", "tree")
    replies = chat.chains(rows, "tree", ["turn", "role", "text"]).withColumn("score", F.lit(1.0))
    made = stage(chat.formatted(stage(replies, "messages")), "formatted")
    text, turns, learned = F.col("text"), F.col("turns"), F.col("learned")
    back = made.select(
        F.col("tree").alias("conv_id"),
        "text",
        chat.turns_of(text).alias("turns"),
        chat.learned_text(text, F.col("loss")).alias("learned"),
    )
    flat = F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return back.select(
        "conv_id",
        F.size(turns).cast("long").alias("n_turns"),
        F.sha2(F.array_join(flat, ""), 256).alias("turns_sha256"),
        F.length(learned).cast("long").alias("loss_chars"),
        F.sha2(learned, 256).alias("loss_sha256"),
        F.length(text).cast("long").alias("formatted_chars"),
    )


def op6_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    found = quality.judged(_table(spark, folder, "documents"), _table(spark, folder, "labels"))
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return found.select("doc_id", *[F.col(f"measures.{c}").alias(c) for c in counts], "base_failed", "kept")


def op7_license_templates(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan(_table(spark, folder, "documents"))


def op8_sum_of_squares_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.packed_digests(_table(spark, folder, "documents"), vocabulary())


def op9_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = lines.dropped_lines(_table(spark, folder, "documents"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op10_benchmark_leaks(spark: SparkSession, folder: str) -> DataFrame:
    items = _table(spark, folder, "benchmark")
    found = decontaminate.leaks(_table(spark, folder, "documents"), items)
    # Items with equal words are found together; each of them is reported.
    members = decontaminate.item_classes(items).distinct().withColumnRenamed("item", "item_id")
    return found.join(members, found["item"] == members["class"]).select(
        F.col("id").alias("doc_id"), "item_id", "n_shingles", "n_shared", "containment"
    )


def op11_multiprobe_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    vectors = _table(spark, folder, "embeddings")
    return lsh.nearest(vectors, vectors.where("vec_id % 100 = 0"))


def op12_nra_search(spark: SparkSession, folder: str) -> DataFrame:
    found = lexical.search(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))
    return found.select(F.col("item").alias("item_id"), "rank", F.col("id").alias("doc_id"), "score")


def op13_shared_list_negatives(spark: SparkSession, folder: str) -> DataFrame:
    label = F.when(F.col("id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(_table(spark, folder, "embeddings"), F.col("id") % 100 == 0, label)


QUERIES = {
    f.__name__: f
    for f in [
        op1_simhash_near_dedup,
        op2_simple8b_ids,
        op3_hmm_score,
        op4_secret_entropy,
        op5_reply_trees,
        op6_quality_rules,
        op7_license_templates,
        op8_sum_of_squares_packing,
        op9_line_dedup,
        op10_benchmark_leaks,
        op11_multiprobe_neighbours,
        op12_nra_search,
        op13_shared_list_negatives,
    ]
}

SPACES = r"' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _fires(cutoff: str) -> str:
    """Whether the rule named in ``rule`` fires at ``cutoff``."""
    cases = " ".join(f"WHEN '{r}' THEN {left} > {cutoff} * {right}" for r, (left, right, _) in quality.RULES.items())
    return f"CASE rule {cases} END"


_RULES = ", ".join(f"('{r}', {nth}, {cut})" for r, (_, _, cuts) in quality.RULES.items() for nth, cut in enumerate(cuts))
_RATE = quality.ALPHA / len(quality.RULES)


def _least(strata: str) -> str:
    """Good documents that certify a cutoff where ``strata`` share the chance of failure."""
    return f"ceil(ln({quality.DELTA / len(quality.RULES)!r}::DOUBLE / ({strata})) / {math.log1p(-_RATE)!r}::DOUBLE)"


_FAILED = (
    f"(n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words)"
)

ORACLE: dict[str, str] = {
    "op6_quality_rules": f"""
        WITH worded AS (
            SELECT doc_id, lang, coalesce(text, '') AS t,
                regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w
            FROM documents
        ),
        windows AS (
            SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
            FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM worded)
        ),
        repeated AS (
            SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS n FROM windows) WHERE n > 1
        ),
        covered AS (
            SELECT doc_id, count(DISTINCT i + k) AS n FROM repeated, (VALUES (0), (1), (2)) v(k) GROUP BY doc_id
        ),
        lines AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM worded),
        same AS (
            SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM lines WHERE trim(line, {SPACES}) <> '' GROUP BY doc_id
        ),
        m AS (
            SELECT worded.doc_id, lang, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
                length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
                coalesce(same.n, 0) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words,
                len(string_split(t, chr(10))) AS n_lines,
                length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS n_capitals,
                length(t) - length(regexp_replace(t, '[!?]', '', 'g')) AS n_shouts
            FROM worded LEFT JOIN same USING (doc_id) LEFT JOIN covered USING (doc_id)
        ),
        good AS (SELECT doc_id FROM labels WHERE quality IS NOT NULL GROUP BY doc_id HAVING min(quality) = 1),
        judged AS (SELECT m.* FROM m JOIN good USING (doc_id) WHERE NOT {_FAILED}),
        able AS (
            SELECT lang, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, lang) AS nth
            FROM judged WHERE lang IS NOT NULL GROUP BY lang
        ),
        own AS (SELECT coalesce(max(nth), 0) AS m FROM able WHERE n >= {_least('nth + 1')}),
        big AS (SELECT lang FROM able, own WHERE nth <= m),
        held AS (
            SELECT *, CASE WHEN lang IN (SELECT lang FROM big) THEN lang ELSE '{quality.POOLED}' END AS stratum FROM judged
        ),
        rules AS (SELECT * FROM (VALUES {_RULES}) v(rule, nth, cutoff)),
        tries AS (
            SELECT stratum, rule, nth, cutoff, count(*) AS n, count(*) FILTER ({_fires('cutoff')}) AS k
            FROM held, rules GROUP BY ALL
        ),
        tails AS (
            SELECT *, CASE WHEN k >= n * {_RATE!r}::DOUBLE THEN 1 ELSE list_sum(list_transform(range(0, k + 1), lambda i:
                exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({_RATE!r}::DOUBLE)
                    + (n - i) * ln(1 - {_RATE!r}::DOUBLE)))) END AS tail
            FROM tries
        ),
        passed AS (
            SELECT *, min((tail <= {quality.DELTA} / ((SELECT m + 1 FROM own) * {len(quality.RULES)}))::INT)
                OVER (PARTITION BY stratum, rule ORDER BY nth) AS ok
            FROM tails
        ),
        cuts AS (SELECT stratum, rule, max_by(cutoff, nth) AS cutoff FROM passed WHERE ok = 1 GROUP BY stratum, rule),
        placed AS (
            SELECT *, CASE WHEN lang IN (SELECT stratum FROM held) THEN lang ELSE '{quality.POOLED}' END AS stratum FROM m
        ),
        fired AS (
            SELECT DISTINCT doc_id FROM placed JOIN cuts USING (stratum) WHERE {_fires('cutoff')}
        )
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, {_FAILED} AS base_failed,
            NOT {_FAILED} AND doc_id NOT IN (SELECT doc_id FROM fired) AS kept
        FROM placed
    """,
    "op9_line_dedup": f"""
        WITH cut AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
        lines AS (
            SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS pos FROM cut
        ),
        keyed AS (SELECT *, translate(trim(line, {SPACES}), '{UPPER}', '{LOWER}') AS k FROM lines),
        common AS (
            SELECT k FROM keyed WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT doc_id) >= 10
        ),
        marked AS (
            SELECT keyed.*, common.k IS NOT NULL AS lost FROM keyed LEFT JOIN common ON keyed.k = common.k
        )
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (lost) AS n_dropped,
            sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT lost), '')) AS kept_sha256
        FROM marked GROUP BY doc_id
    """,
    "op10_benchmark_leaks": """
        WITH worded AS (
            SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM documents
        ),
        shingles AS (
            SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s
            FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM worded)
        ),
        items AS (
            SELECT DISTINCT item_id, w
            FROM (SELECT item_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM benchmark)
        ),
        wanted AS (
            SELECT DISTINCT item_id, w, array_to_string(w[i:i + 4], ' ') AS s
            FROM (SELECT item_id, w, unnest(range(1, len(w) - 3)) AS i FROM items)
        ),
        sized AS (SELECT *, count(*) OVER (PARTITION BY item_id, w) AS n_shingles FROM wanted)
        SELECT doc_id, item_id, n_shingles, count(*) AS n_shared, count(*) / n_shingles AS containment
        FROM shingles JOIN sized USING (s) GROUP BY doc_id, item_id, w, n_shingles
        HAVING count(*) >= 0.8 * n_shingles
    """,
    "op12_nra_search": f"""
        WITH d AS (
            SELECT doc_id, row_number() OVER () AS doc, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{_TERM}') AS t
            FROM documents WHERE doc_id IS NOT NULL
        ),
        sized AS (SELECT doc_id, doc, t, len(t)::BIGINT AS n FROM d WHERE len(t) > 0),
        totals AS (SELECT count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS total FROM sized),
        tf AS (SELECT doc_id, doc, n, term, count(*)::BIGINT AS tf FROM (SELECT doc_id, doc, n, unnest(t) AS term FROM sized) GROUP BY ALL),
        items AS (SELECT item_id, min(text) AS text FROM benchmark WHERE item_id IS NOT NULL GROUP BY item_id),
        wanted AS (
            SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{_TERM}')) AS term FROM items
        ),
        weights AS (
            SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
            FROM tf, totals GROUP BY term, n_docs
        ),
        scored AS (
            SELECT item_id, doc_id, doc,
                sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // total))))::BIGINT AS score
            FROM wanted JOIN tf USING (term) JOIN weights USING (term), totals GROUP BY item_id, doc_id, doc
        ),
        ranked AS (
            SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id, doc) AS rank FROM scored WHERE score > 0
        )
        SELECT item_id, rank::INT AS rank, doc_id, score FROM ranked WHERE rank <= 50
    """,
    "op13_shared_list_negatives": """
        WITH fine AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS x,
                CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label
            FROM embeddings
            WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
                AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ),
        pairs AS (
            SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same,
                list_inner_product(a.x::DOUBLE[], b.x::DOUBLE[])::BIGINT AS score
            FROM fine a JOIN fine b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0
        ),
        positives AS (
            SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM pairs WHERE same
            QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
        )
        SELECT anchor_id, positive_id,
            (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id))::INT AS rank,
            vec_id AS negative_id, positive_score, score AS negative_score
        FROM positives JOIN pairs USING (anchor_id)
        WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
        QUALIFY rank <= 10
    """,
}
