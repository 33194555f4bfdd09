"""Small tables with everything that may go wrong in a row."""

import duckdb
from pyspark.sql import functions as F

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts):
    """``documents`` rows from texts or ``(doc_id, text)`` pairs."""
    rows = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
    full = [(i, t, "en", "src0", len(t or "")) for i, t in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(3)


def with_clashes(docs):
    """Columns named like those that operators make on their way."""
    names = "id t h row runs fp near bucket node root class item word words place measures kept spans score labels"
    for name in [*names.split(), "__id", "__t", "__key", "__words", "__text", "__h"]:
        docs = docs.withColumn(name, F.lit("mine"))
    return docs


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def oracle(sql, folder=FOLDER):
    con = duckdb.connect()
    for name in ("documents", "benchmark", "labels", "conversations", "embeddings"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    order = sorted(range(len(names)), key=lambda k: names[k])
    return [names[k] for k in order], sorted((tuple(r[k] for k in order) for r in found.fetchall()), key=repr)
