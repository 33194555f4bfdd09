"""Operators that look across documents, against brute force over the same rows."""

import collections
import random
import re

import pytest
from pyspark.sql import functions as F

from netwarden.llm import common, decontaminate, lines, queries, simhash
from tests.llm.helpers import FOLDER, documents, oracle, rows, with_clashes

ODD = [None, "", " \n\t", "x", "x", "\n\n\n", "é ß ö", "w" * 20_000]


# Components and near-duplicates


def roots_of(nodes, links):
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("shape", ["chain", "star", "random", "none"])
def test_components(spark, shape):
    draw = random.Random(5)
    names = draw.sample(range(-1000, 1000), 60)
    links = {
        "chain": list(zip(names, names[1:])),
        "star": [(max(names), n) for n in names if n != max(names)],
        "random": [(draw.choice(names), draw.choice(names)) for _ in range(40)],
        "none": [],
    }[shape]
    found = dict(rows(common.connected(spark.createDataFrame(links, "a long, b long"))))
    linked = {n for a, b in links if a != b for n in (a, b)}
    assert found == {n: r for n, r in roots_of(names, links).items() if n in linked}


def test_close_pairs_finds_all(spark):
    draw = random.Random(9)
    fps = set()
    for _ in range(20):
        centre = draw.getrandbits(64)
        for _ in range(12):
            near = centre
            for bit in draw.sample(range(64), draw.randint(0, 4)):
                near ^= 1 << bit
            fps.add(near)
    fps = sorted(fps)
    table = spark.createDataFrame([(simhash._signed(f),) for f in fps], "fp long")
    for bits in (1, 2):
        found = {tuple(sorted((a % 2**64, b % 2**64))) for a, b in simhash.close_pairs(table, bits).collect()}
        wanted = {(a, b) for i, a in enumerate(fps) for b in fps[i + 1 :] if (a ^ b).bit_count() <= bits}
        assert found == wanted and wanted


def bits_of(text):
    """The contract's fingerprint, bit by bit."""
    import xxhash

    lowered = (text or "").translate({c: c + 32 for c in range(65, 91)})
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    ones = [0] * 64
    for g in grams:
        h = xxhash.xxh64_intdigest(g.encode(), 42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(grams))


def test_fingerprint_of_very_long_texts():
    draw = random.Random(2)
    for n in (simhash.CHUNK + 1, simhash.CHUNK + 2, simhash.CHUNK + 3, 2 * simhash.CHUNK + 777):
        text = " ".join(draw.choices(["aa", "Bb", "cc", "ÄÖ", "x1"], k=n))
        assert simhash.fingerprint(text.encode()) == bits_of(text)


def groups_of(texts):
    fps = {i: bits_of(t) for i, t in texts.items()}
    ids = sorted(fps)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if (fps[a] ^ fps[b]).bit_count() <= 2]
    return fps, roots_of(ids, links)


def test_near_duplicates(spark):
    base = [f"word{i}" for i in range(300)]
    near = [" ".join(base[:k] + ["other"] + base[k + 1 :]) for k in range(0, 300, 30)]
    texts = dict(enumerate(ODD + [" ".join(base), " ".join(base).upper(), *near, "two words", "TWO  words"]))
    docs = with_clashes(documents(spark, list(texts.items())))
    fps, roots = groups_of(texts)
    found = simhash.near_duplicates(docs.drop("fp")).collect()
    assert {r.doc_id: (r.fp % 2**64, r.component) for r in found} == {i: (fps[i], roots[i]) for i in texts}
    assert fps[0] == 0 and roots[1] == 0 and len(found) == len(texts)
    kept = simhash.keep_one(docs)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(roots.values())) and kept.columns == docs.columns
    assert simhash.near_duplicates(documents(spark, [])).count() == 0


def test_one_row_of_each_group_stays(spark):
    docs = documents(spark, [(1, "a b c d"), (1, "a b c d"), (None, "a b c d"), (None, None), (None, ""), (7, "q r s")])
    kept = simhash.keep_one(docs).collect()
    assert len(kept) == 3 and {simhash.fingerprint((r.text or "").encode()) for r in kept} == {
        simhash.fingerprint(t) for t in (b"a b c d", b"", b"q r s")
    }


def test_hashes_are_xxh64_with_seed_42(spark):
    import xxhash

    text = "one two three"
    native = spark.createDataFrame([(text,)], "t string").select(F.xxhash64("t")).first()[0]
    assert native % 2**64 == xxhash.xxh64_intdigest(text.encode(), 42) == simhash.fingerprint(text.encode())


# Lines


def key_of(line):
    return line.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})


def cut(texts, least=10, keep_first=False):
    found = collections.Counter(k for t in texts.values() for k in {key_of(x) for x in (t or "").split("\n")} if k)
    out, met = {}, set()
    for i, t in sorted(texts.items()):
        every = (t or "").split("\n")
        stay = []
        for x in every:
            if found[key_of(x)] < least or keep_first and key_of(x) not in met:
                stay.append(x)
            met.add(key_of(x))
        out[i] = (len(every), len(every) - len(stay), "\n".join(stay))
    return out


def line_texts():
    shared = [f"own {i}\n  SHARED Line \nshared line\nrest {i}\n\n" for i in range(12)]
    nearly = [f"Nine\n{i}" for i in range(9)]
    return dict(enumerate(ODD + shared + nearly + ["shared line", "shared line\n\nShared line\t", "É\né\n" * 5]))


def test_lines(spark):
    texts = line_texts()
    docs = with_clashes(documents(spark, list(texts.items())))
    found = {r.doc_id: tuple(r)[1:] for r in lines.dropped_lines(docs).collect()}
    assert found == cut(texts)
    cleaned = lines.without_common_lines(docs)
    assert cleaned.columns == docs.columns
    for r in cleaned.collect():
        assert (r.text or "", r.runs) == (found[r.doc_id][2], "mine")
        assert r.n_chars == len(r.text or "")
    assert lines.dropped_lines(documents(spark, [])).count() == 0


def test_first_line_stays_on_demand(spark):
    docs = documents(spark, [(i, f"{i}\nsame\nsame") for i in range(12)])
    kept = {r.doc_id: r.kept for r in lines.dropped_lines(docs, keep_first=True).collect()}
    assert kept[0] == "0\nsame" and all(kept[i] == str(i) for i in range(1, 12))


def test_equal_rows_are_one_document(spark):
    docs = documents(spark, [(1, "a line")] * 15 + [(None, "b line")] * 15)
    assert {(r.n_lines, r.n_dropped) for r in lines.dropped_lines(docs).collect()} == {(1, 0)}


# Benchmark items


def shingles_of(text):
    words = re.findall(r"[^\W_]+", (text or "").lower())
    if len(words) < 5:
        return {" ".join(words)} if words else set(), len(words)
    return {" ".join(words[i : i + 5]) for i in range(len(words) - 4)}, 5


def leaks_of(texts, items):
    found = set()
    for i, t in texts.items():
        words = re.findall(r"[^\W_]+", (t or "").lower())
        for j, u in items.items():
            wanted, n = shingles_of(u)
            have = {" ".join(words[k : k + n]) for k in range(len(words) - n + 1)}
            if wanted and len(wanted & have) >= 0.8 * len(wanted) - 1e-9:
                found.add((i, j, len(wanted), len(wanted & have)))
    return found


def test_leaks(spark):
    draw = random.Random(3)
    vocabulary = [f"w{i}" for i in range(400)]
    items = {j: " ".join(draw.choices(vocabulary, k=n)) for j, n in enumerate([3, 1, 8, 14, 30, 59, 200])}
    items |= {50: None, 51: "  ", 52: items[4].upper() + "!"}
    texts = dict(enumerate(ODD))
    for j in range(7):
        words = items[j].split()
        for share in (1.0, 0.9, 0.8, 0.7, 0.5):
            part = words[: max(1, round(len(words) * share))]
            filler = draw.choices(["f", "g", "h"], k=50)
            texts[len(texts)] = " ".join(filler + part + filler)
    texts[len(texts)] = items[5].replace(" ", ",\n").title()
    docs = with_clashes(documents(spark, list(texts.items())))
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string").withColumn("h", F.lit("mine"))
    found = {tuple(r) for r in decontaminate.leaks(docs, bench).select("id", "item", "n_shingles", "n_shared").collect()}
    wanted = leaks_of(texts, {j: t for j, t in items.items() if j != 52})
    assert found == wanted and len(wanted) > 10
    clean = decontaminate.without_leaks(docs, bench)
    assert clean.columns == docs.columns
    assert {r.doc_id for r in clean.collect()} == set(texts) - {i for i, *_ in wanted}
    assert rows(decontaminate.item_classes(bench).where("item = 52 OR item = 4")) == [(4, 4), (52, 4)]
    assert decontaminate.leaks(docs, bench.limit(0)).count() == 0
    assert decontaminate.leaks(docs.limit(0), bench).count() == 0
    assert decontaminate.leaks(docs.union(docs), bench).count() == len(wanted)


# Registered queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_against_sql(spark, name):
    found = queries.QUERIES[name](spark, FOLDER)
    names, wanted = oracle(queries.ORACLE[name])
    assert rows(found.select(*names)) == wanted and sorted(found.columns) == names


def test_fingerprint_query(spark):
    texts = dict(spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect())
    fps, roots = groups_of(texts)
    found = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op1_simhash_near_dedup(spark, FOLDER).collect()}
    assert found == {i: (f"{fps[i]:016x}", roots[i]) for i in texts}


def test_every_repeated_item_is_reported(spark, tmp_path):
    text = " ".join(f"word{i}" for i in range(30))
    docs = documents(spark, [(1, f"x {text} y"), (2, "nothing here")])
    items = [(7, text), (5, text.upper() + "!"), (9, text), (9, text), (11, "other words that are not there at all")]
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    found = queries.op10_benchmark_leaks(spark, str(tmp_path)).select("doc_id", "item_id")
    assert rows(found) == [(1, 5), (1, 7), (1, 9)]


# The pipeline


def test_lines_of_many_copies_survive(spark):
    """A text with ten copies or more keeps its lines in the first of them, and near-dedup keeps that one."""
    import corpus_pipeline

    clean = "\n".join(" ".join(f"w{i}x{k}" for i in range(12)) for k in range(8))
    docs = documents(spark, [(i, clean) for i in range(5, 25)] + [(30, "a text of its own that stays")])
    kept = corpus_pipeline.near_dedup(spark, corpus_pipeline.line_dedup(spark, docs, ""), "").collect()
    assert {r.doc_id: r.text for r in kept if r.text} == {5: clean, 30: "a text of its own that stays"}


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    items = dict(spark.read.parquet(f"{FOLDER}/benchmark.parquet").select("item_id", "text").collect())
    verdicts = dict(queries.op6_quality_rules(spark, FOLDER).select("doc_id", "kept").collect())
    texts = {r.doc_id: r.text for r in docs.collect() if verdicts[r.doc_id]}
    texts = {i: t for i, (_, _, t) in cut(texts, keep_first=True).items()}
    _, roots = groups_of(texts)
    texts = {i: t for i, t in texts.items() if roots[i] == i}
    held = {i for i, *_ in leaks_of(texts, items)}
    texts = {i: t for i, t in texts.items() if i not in held}
    now = docs
    for name, function in corpus_pipeline.STAGES[:-1]:
        now = common.stage(function(spark, now, FOLDER), name)
        assert now.columns == docs.columns
    assert labels.count() and {r.doc_id: r.text for r in now.collect()} == texts
    packed = corpus_pipeline.run(spark, FOLDER).collect()
    assert {r.doc_id for r in packed} == set(texts)
    assert all(r.length <= 2048 for r in packed)
