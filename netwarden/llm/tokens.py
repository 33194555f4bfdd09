"""Token ids of whole texts, for use inside Arrow tasks.

A byte-level BPE never merges across the start of a word that follows a plain space, nor across a
single line break between words. Texts without other white space are therefore cut there, and each
distinct piece is encoded by the tokenizers library once and remembered, within a bound; any other
text is encoded whole. The ids are the same either way.
"""

from __future__ import annotations

import os
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Pieces and ids a worker remembers at most, and bytes of text that it cuts at once.
MAX_PIECES = 1_000_000
MAX_IDS = 8_000_000
SLICE_BYTES = 4 << 20
# White space beyond single spaces and line breaks between words.
IRREGULAR = r"[ \n](?:[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]|\z)|[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]\n|\A[ \n]"

_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for a vocabulary file; kept between tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


class Encoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        vocabulary = self.library.get_vocab()
        # Ids of tokens that begin with a space.
        self.opens = np.zeros(max(vocabulary.values()) + 1, bool)
        for token, number in vocabulary.items():
            self.opens[number] = token.startswith("Ġ")
        self._forget()

    def _forget(self) -> None:
        self.numbers: dict[str, int] = {}
        self.pool = np.zeros(1 << 16, "<u4")
        self.used = 0
        # Where the ids of each piece begin in the pool; the next piece begins where they end.
        self.starts = np.zeros(1 << 16, np.int32)
        # Whether a piece was met again after the slice in which it was learned.
        self.again = np.zeros(1 << 16, bool)

    def _shrink(self) -> None:
        """Keep the pieces that were met again, the oldest of them if these are many."""
        kept = np.flatnonzero(self.again[: len(self.numbers)])[: MAX_PIECES // 2]
        sizes = np.diff(self.starts[: len(self.numbers) + 1])[kept]
        ends = np.cumsum(sizes)
        if len(kept) and ends[-1] <= MAX_IDS // 2:
            pieces = list(self.numbers)
            ids = self.pool[np.arange(ends[-1]) + np.repeat(self.starts[kept] - (ends - sizes), sizes)]
            self._forget()
            self._remember([pieces[n] for n in kept.tolist()], ids, sizes)
        else:
            self._forget()

    def _remember(self, pieces: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        """Number ``pieces`` in order after those known; ``ids`` are theirs, one after the other."""
        have, end = len(self.numbers), self.used + len(ids)
        while end > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        while have + len(pieces) >= len(self.starts):
            self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
            self.again = np.concatenate([self.again, np.zeros_like(self.again)])
        self.pool[self.used : end] = ids
        self.starts[have + 1 : have + len(pieces) + 1] = self.used + np.cumsum(sizes)
        self.numbers.update(zip(pieces, range(have, have + len(pieces))))
        self.used = end

    def _learn(self, spaced: list[str], broken: list[str]) -> None:
        """Encode and remember pieces that follow a space, then those that begin with a line break."""
        if spaced:
            whole = self.library.encode_batch_fast([" " + " ".join(spaced)], add_special_tokens=False)[0]
            ids = np.array(whole.ids, "<u4")
            at = np.flatnonzero(self.opens[ids])
            self._remember(spaced, ids, np.diff(np.append(at, len(ids))))
        if broken:
            each = [e.ids for e in self.library.encode_batch_fast(broken, add_special_tokens=False)]
            self._remember(
                broken,
                np.array([i for x in each for i in x], "<u4"),
                np.array([len(x) for x in each], np.int64),
            )

    def _regular(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of texts in which every piece is known by the white space before it."""
        led = pc.binary_join_element_wise(pa.scalar("\n", pa.large_string()), texts, pa.scalar("", pa.large_string()))
        cut = pc.split_pattern(pc.replace_substring(led, "\n", " \n"), " ")
        coded = cut.flatten().dictionary_encode()
        pieces = coded.dictionary.to_pylist()
        if len(self.numbers) + len(pieces) > MAX_PIECES or self.used > MAX_IDS:
            self._shrink()
        known = np.fromiter(map(self.numbers.get, pieces, repeat(-1)), np.int32, len(pieces))
        self.again[known[known >= 0]] = True
        unseen = np.flatnonzero(known < 0).tolist()
        # The empty piece before the first line break has no ids and stays unknown.
        broken = [k for k in unseen if pieces[k][:1] == "\n"]
        spaced = [k for k in unseen if pieces[k] and pieces[k][0] != "\n"]
        have = len(self.numbers)
        self._learn([pieces[k] for k in spaced], [pieces[k] for k in broken])
        known[spaced] = np.arange(have, have + len(spaced), dtype=np.int32)
        known[broken] = np.arange(have + len(spaced), len(self.numbers), dtype=np.int32)
        piece_sizes = np.where(known >= 0, self.starts[known + 1] - self.starts[known], 0)
        at = coded.indices.to_numpy()
        sizes, begins = piece_sizes[at], self.starts[known][at]
        ends = np.cumsum(sizes, dtype=np.int64)
        place = np.arange(ends[-1], dtype=np.int32) + np.repeat(begins - (ends - sizes).astype(np.int32), sizes)
        ids = self.pool[place]
        bounds = np.concatenate([[0], ends])[cut.offsets.to_numpy()]
        # Each text begins with the line break put before it, one id.
        return [ids[a + 1 : b] for a, b in zip(bounds[:-1], bounds[1:])]

    def _encode(self, texts: pa.Array) -> list[np.ndarray]:
        odd = pc.fill_null(pc.match_substring_regex(texts, IRREGULAR), False)
        odd = pc.or_(odd, pc.equal(pc.binary_length(texts), 0))
        found: list[np.ndarray | None] = [None] * len(texts)
        regular = np.flatnonzero(~odd.to_numpy(zero_copy_only=False))
        if len(regular):
            for at, ids in zip(regular, self._regular(texts.take(pa.array(regular)))):
                found[at] = ids
        for at in np.flatnonzero(odd.to_numpy(zero_copy_only=False)):
            whole = self.library.encode_batch_fast([texts[at].as_py()], add_special_tokens=False)[0]
            found[at] = np.array(whole.ids, "<u4")
        return found

    def encode(self, texts: pa.Array):
        """Yield the ids of each text, null like empty, as unsigned 32-bit integers."""
        sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < len(texts):
            before = sizes[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(sizes, before + SLICE_BYTES, "right")))
            yield from self._encode(pc.fill_null(texts[at:end].cast(pa.large_string()), ""))
            at = end
        pa.default_memory_pool().release_unused()
