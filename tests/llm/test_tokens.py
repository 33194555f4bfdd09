"""Token files, packing, language-model scores and conversations: round trips and brute force."""

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from netwarden.llm import chat, hmm, packed_ids, packing, queries
from netwarden.plans.scale import stage_path
from tests.llm.helpers import FOLDER, documents, with_clashes

ODD = [
    None, "", " ", "\n", "x", "x", "  lead and\n\ndouble  \n", "a <|endoftext|> b", "tab\there nb 's don't\r\n x",
    "\nfoo", " foo bar", "foo  bar 　z", "w" * 30_000, "plain words\nand 3 lines\nof it.", "a\x1cb \x85 c\x1d d",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(queries.vocabulary())


def ids_of(library, text, end):
    return library.encode(text or "", add_special_tokens=False).ids + [end]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


# Simple-8b


@pytest.mark.parametrize(
    "ids",
    [
        [], [5], [0] * 1000, [0] * 239, [1, 0] * 400, list(range(3000)), [2**64 - 1, 0, 2**60, 2**60 - 1, 2**32, 2**32 - 1],
        [50256] * 7, [2**k for k in range(64)], [2**k - 1 for k in range(1, 65)],
    ],
)
def test_words_hold_the_ids(ids):
    ids = np.array(ids, "<u8")
    words, literals = packed_ids.pack(ids)
    assert (packed_ids.unpack(words, literals) == ids).all()
    assert packed_ids.word_counts(words).sum() == len(ids)


def test_words_are_dense():
    ids = np.random.default_rng(1).integers(0, 1 << 15, 40_000)
    words, literals = packed_ids.pack(ids)
    assert len(words) <= len(ids) / 4 + 1 and not len(literals)


def test_files(spark, library):
    texts = dict(enumerate(ODD, -3))
    docs = with_clashes(documents(spark, list(texts.items())))
    path = stage_path(spark, "ids")
    packed_ids.write(docs, path, queries.vocabulary())
    found = {r.id: r for r in packed_ids.digest(packed_ids.read(spark, path)).collect()}
    start = 0
    for i in sorted(texts):
        ids = ids_of(library, texts[i], 2)
        assert (found[i].start, found[i].n_tokens, found[i].ids_crc32) == (start, len(ids), crc(ids))
        start += len(ids)
    assert len(found) == len(texts)


def test_blocks_can_be_read_alone(spark):
    docs = documents(spark, ["some words in a text " * 400])
    path = stage_path(spark, "ids")
    packed_ids.write(docs, path, queries.vocabulary())
    record = spark.read.parquet(path).first()
    words, literals = np.frombuffer(record.words, "<u8"), np.frombuffer(record.literals, "<u8")
    whole = packed_ids.unpack(words, literals)
    for k, offset in enumerate(record.offsets):
        part = packed_ids.unpack(words[k * packed_ids.STRIDE : (k + 1) * packed_ids.STRIDE], literals)
        assert (whole[offset : offset + len(part)] == part).all()


def test_no_files_from_no_rows(spark):
    path = stage_path(spark, "ids")
    packed_ids.write(documents(spark, []), path, queries.vocabulary())
    assert packed_ids.read(spark, path).count() == 0
    path = stage_path(spark, "ids")
    packed_ids.write(documents(spark, [(None, "a"), (None, "a"), (1, None)]), path, queries.vocabulary())
    starts = sorted((r.start, r.n_tokens) for r in packed_ids.digest(packed_ids.read(spark, path)).collect())
    assert starts == [(0, 2), (2, 2), (4, 1)]


# Packing


def check_packed(pieces, texts, library):
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for r in pieces:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append((r.offset, r.length))
    total = 0
    for i, text in texts.items():
        ids, at = ids_of(library, text, 0), 0
        for k, r in enumerate(sorted(by_doc[i], key=lambda r: r.piece)):
            assert (r.piece, r.start, r.ids_crc32) == (k, at, crc(ids[at : at + r.length]))
            assert r.length == 2048 or k == 0
            at += r.length
        assert at == len(ids)
        total += at
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    return len(by_sequence), -(-total // 2048)


def test_packing(spark, library):
    texts = dict(enumerate([*ODD, "one two three " * 2000, "x " * 2046 + "x"]))
    docs = with_clashes(documents(spark, list(texts.items())))
    check_packed(packing.packed_digests(docs, queries.vocabulary()).collect(), texts, library)
    pieces = packing.token_pieces(docs, queries.vocabulary())
    full = packing.sequences(pieces, packing.place(pieces)).collect()
    assert sum(len(r.tokens) for r in full) == 4 * sum(len(ids_of(library, t, 0)) for t in texts.values())
    assert packing.packed_digests(documents(spark, []), queries.vocabulary()).count() == 0
    twice = documents(spark, [(None, "a b"), (None, "a b")])
    assert packing.packed_digests(twice, queries.vocabulary()).count() == 2


def test_packing_wastes_little(spark, library):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    texts = dict(docs.select("doc_id", "text").collect())
    used, least = check_packed(queries.op8_sum_of_squares_packing(spark, FOLDER).collect(), texts, library)
    assert used <= 1.01 * least + 1


def test_each_piece_goes_where_squares_are_smallest():
    draw = np.random.default_rng(4)
    sizes = np.sort(draw.integers(1, 60, 300))[::-1]
    sequences, offsets = packing.place_by_squares(sizes, 64)
    gaps: dict[int, int] = {}
    for size, sequence, offset in zip(sizes.tolist(), sequences.tolist(), offsets.tolist()):

        def squares(choice):
            after = collections.Counter(g for s, g in gaps.items() if s != choice and g)
            left = gaps.get(choice, 64) - size
            after[left] += left > 0
            return sum(n * n for n in after.values())

        fits = [s for s, g in gaps.items() if g >= size]
        if fits:
            assert sequence in fits and squares(sequence) == min(map(squares, fits))
        else:
            assert sequence not in gaps
        assert offset == 64 - gaps.get(sequence, 64)
        gaps[sequence] = gaps.get(sequence, 64) - size


# Language model


def likelihood(model, symbols):
    """Plain forward recursion without scaling tricks, in log10."""
    alpha, total = model.start * model.emit[symbols[0]], 0.0
    for s in symbols[1:]:
        scale = alpha.sum()
        total += math.log10(scale)
        alpha = (alpha / scale) @ model.step * model.emit[s]
    return total + math.log10(alpha.sum())


def tiny_model(states=3, symbols=7):
    draw = np.random.default_rng(2)
    emit, step, start = draw.random((symbols, states)), draw.random((states, states)), draw.random(states)
    return hmm.Model(start / start.sum(), start[::-1] / start.sum(), step / step.sum(1, keepdims=True), emit / emit.sum(0))


def test_forward_is_exact():
    model, draw = tiny_model(), random.Random(1)
    texts = [[draw.randrange(7) for _ in range(n)] for n in (1, 5, 2, 40, 5)]
    sizes = np.array([len(t) for t in texts])
    found = hmm.forward(model, np.concatenate(texts), np.cumsum(sizes) - sizes, sizes)
    assert np.allclose(found, [likelihood(model, t) for t in texts], rtol=1e-10)
    short = hmm.forward(model, np.arange(7), np.arange(7), np.ones(7, int))
    assert abs((10**short).sum() - 1) < 1e-9


def test_expected_counts_by_enumeration():
    from itertools import product

    model = tiny_model(2, 3)
    windows, opens = [[0, 2, 1, 1], [2], [1, 0]], [True, False, True]
    sizes = np.array([len(w) for w in windows])
    expected = hmm.Expected(model)
    expected.add(np.concatenate(windows), np.cumsum(sizes) - sizes, sizes, np.array(opens))
    emit, step = np.zeros((3, 2)), np.zeros((2, 2))
    start, later = np.zeros(2), np.zeros(2)
    for window, first in zip(windows, opens):
        weights = {}
        for path in product(range(2), repeat=len(window)):
            p = (model.start if first else model.later)[path[0]]
            for t, s in enumerate(path):
                p *= model.emit[window[t], s] * (model.step[path[t - 1], s] if t else 1)
            weights[path] = p
        for path, p in weights.items():
            share = p / sum(weights.values())
            (start if first else later)[path[0]] += share
            for t, s in enumerate(path):
                if t or first:
                    emit[window[t], s] += share
                if t:
                    step[path[t - 1], s] += share
    for found, wanted in ((expected.emit, emit), (expected.step, step), (expected.start, start), (expected.later, later)):
        assert np.allclose(found, wanted, atol=1e-5)


def test_windows_hold_every_token_and_step_once():
    for n in (0, 1, 4, 5, 8, 9, 23):
        text, tokens, steps = np.arange(n), [], []
        for window, first in hmm.windows(text, 4):
            tokens += window.tolist()[0 if first else 1 :]
            steps += list(zip(window[:-1].tolist(), window[1:].tolist()))
        assert tokens == text.tolist() and steps == [(i, i + 1) for i in range(n - 1)]


def test_words_of_one_count_do_not_push_each_other_out(spark):
    rows = [(f"w{i}".encode(), 1) for i in range(1000)] + [(b"often", 50), (b"l" * 65, 90)]
    counts = spark.createDataFrame(rows, "word binary, c long").repartition(3)
    for most in (0, 1, 300, 5000):
        found = hmm._frequent(counts, most)
        assert len(found) == len(set(found)) <= most and (b"often" in dict(found)) == (most > 0)
        assert found == [] or set(found) <= set(rows) - {(b"l" * 65, 90)}
        assert len(found) >= min(most, 1001) - 5
    vocabulary = hmm.Vocabulary(counts, 3, 100, 300)
    assert vocabulary.symbols == 100 and vocabulary.words[0] == b"often"
    assert sorted(hmm._frequent(counts, 300)) == sorted(hmm._frequent(counts.repartition(7), 300))


def test_scores(spark, monkeypatch):
    monkeypatch.setattr(hmm, "KNOWN", 300)
    monkeypatch.setattr(hmm.Vocabulary.__init__, "__defaults__", (100, 300))
    texts = dict(spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect())
    texts |= {1000: None, 1001: "", 1002: "never seen words", 1003: "A a A", 1004: "l" * 500 + " " + "l" * 500}
    found = hmm.score(with_clashes(documents(spark, list(texts.items()))), rounds=2).collect()
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in texts}
    counts, ends = collections.Counter(), 0
    for i, t in texts.items():
        if not held[i]:
            counts.update((t or "").encode().lower().split())
            ends += 1
    total, kinds = sum(counts.values()) + ends, len(counts) + 1
    assert len(found) == len(texts)
    for r in found:
        words = (texts[r.doc_id] or "").encode().lower().split()
        base = sum(math.log10((counts[w] + 1) / (total + kinds + 1)) for w in words)
        base += math.log10((ends + 1) / (total + kinds + 1))
        assert (r.held_out, r.n_tokens, r.train_tokens) == (held[r.doc_id], len(words) + 1, total)
        assert r.n_known == sum(counts[w] > 0 for w in words) + 1
        assert abs(r.base_score - base) < 1e-6 * abs(base) and r.score < 0


def test_held_out_texts_gain(spark):
    found = queries.op3_hmm_score(spark, FOLDER).where("held_out")
    n, base, score = found.agg(F.sum("n_tokens"), F.sum("base_score"), F.sum("score")).first()
    assert score / n > base / n


def test_scores_without_rows(spark):
    assert hmm.score(documents(spark, []), rounds=1).count() == 0
    only_held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    row = hmm.score(documents(spark, [(only_held, "a b")]), rounds=1).first()
    assert (row.n_known, row.train_tokens) == (0, 0) and math.isfinite(row.score)


# Conversations


def chat_rows():
    control = "<turn><\\/turn <\\\\\\turn < </turn>\n"
    tricky = [
        (-8, 0, "us\ner\\n<turn>", None), (-8, 1, "assistant", control), (-8, 2, None, "x"), (None, 0, "user", "null id"),
        (-9, 0, "assistant", "a"), (-9, 0, "assistant", "a"), (-10, 5, "assistant", ""), (-11, None, "assistant", control),
    ]
    return tricky + [(5, k, "assistant" if k % 2 else "user", f"{k} " * k) for k in range(40)]


def test_conversations_are_read_back(spark):
    table = spark.createDataFrame(chat_rows(), "tree long, turn long, role string, text string")
    replies = chat.chains(table, "tree", ["turn", "role", "text"]).withColumn("score", F.lit(1.0))
    found = chat.formatted(replies).withColumn("turns", chat.turns_of(F.col("text")))
    found = found.withColumn("learned", chat.learned_text(F.col("text"), F.col("loss"))).collect()
    wanted = collections.defaultdict(list)
    for tree, turn, role, text in chat_rows():
        wanted[tree].append((-1 if turn is None else turn, role or "", text or ""))
    assert len(found) == len(wanted)
    for r in found:
        turns = [t[1:] for t in sorted(wanted[r.tree])]
        assert [tuple(t) for t in r.turns] == turns
        assert r.learned == "".join(text for role, text in turns if role == "assistant")
    assert chat.formatted(replies.limit(0)).count() == 0


def test_best_branches(spark):
    said = [
        ("t", 1, None, "user", "q", 1.0), ("t", 2, 1, "assistant", "bad", 0.1), ("t", 3, 1, "assistant", "good", 0.9),
        ("t", 4, 3, "user", "more", 0.5), ("t", 5, 3, "user", "less", 0.2), ("u", 1, 2, "a", "circle", 1.0),
        ("u", 2, 1, "a", "circle", 1.0), ("v", 7, 99, "user", "no parent", None),
    ]
    table = spark.createDataFrame(
        said, "tree string, node long, parent long, role string, text string, score double"
    )
    found = {(r.tree, r["rank"]): r for r in chat.formatted(table, best=2).collect()}
    turns = {k: [t.split("\n")[1] for t in r.text.split("</turn>\n")[:-1]] for k, r in found.items()}
    assert turns == {("t", 1): ["q", "good", "more"], ("t", 2): ["q", "good", "less"], ("v", 1): ["no parent"]}


def test_conversation_query(spark):
    found = {r.conv_id: r for r in queries.op5_reply_trees(spark, FOLDER).collect()}
    rows = spark.read.parquet(f"{FOLDER}/conversations.parquet").orderBy("conv_id", "turn").collect()
    wanted = collections.defaultdict(list)
    for r in rows:
        wanted[r.conv_id].append((r.role, r.text))
    wanted[-7] = [("user", "\\### Assistant: </turn> ok"), ("assistant", "\\### Assistant: </turn> ok")]
    assert set(found) == set(wanted)
    for key, turns in wanted.items():
        r = found[key]
        learned = "".join(t for role, t in turns if role == "assistant")
        assert r.n_turns == len(turns) and r.loss_chars == len(learned)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(learned.encode()).hexdigest()
