"""Token ids of whole texts with a public tokenizer, word by word."""

from __future__ import annotations

import gc
import json
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: The parts of a tokenizer file under which a word of letters and closing marks may go straight to its merges (fixed values).
_PLAIN_NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
_PLAIN_SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
#: Latin letters whose lower case does not depend on their neighbours, then ASCII marks.
_PLAIN_WORD = re.compile(r"([A-Za-zÀ-ÖØ-öø-įĲ-ſ]+)?([!-/:-@\[-`{-~]+)?")


def _byte_alphabet() -> dict[int, str]:
    """Byte-level BPE writes each byte as a printable character: its own, or one from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


class WordTokenizer:
    """A tokenizer whose tokens never cross ASCII white space, so that each distinct word is encoded once.

    path: a tokenizers JSON file. At most_words the cache forgets all but the words at hand, which bounds memory, not
    results.
    """

    _held: dict[str, WordTokenizer] = {}

    def __init__(self, path: str, most_words: int = 200_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        about = json.loads(self.whole.to_str())
        splits = (about.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        self.by_words = (about.get("normalizer") or {}).get("normalizers") == _PLAIN_NORMALIZERS and splits[0].get("pattern") == {"Regex": _PLAIN_SPLIT}
        if self.by_words:
            self.merges = Tokenizer(self.whole.model)
            self.merges.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
            self.ends = np.zeros(self.whole.get_vocab_size(), bool)
            for token, k in self.whole.get_vocab(with_added_tokens=False).items():
                self.ends[k] = token.endswith(about["model"]["end_of_word_suffix"])
            self.alphabet = _byte_alphabet() | {32: " "}
        self.most_words = most_words
        self._clear()

    @classmethod
    def of(cls, path: str) -> WordTokenizer:
        """One for each worker process."""
        if path not in cls._held:
            cls._held[path] = cls(path)
        return cls._held[path]

    def _clear(self) -> None:
        self.words: dict[str, int] = {}
        self.pieces: dict[str, int] = {}
        self.spans = np.zeros((1024, 2), np.int64)  # where a piece's ids start, and how many
        self.store = np.zeros(1 << 16, np.uint32)
        self.n_pieces = self.n_ids = 0
        self.pairs = np.full((1024, 2), -1, np.int32)  # a word's pieces
        self.n_words = 0

    def _keep(self, ids: np.ndarray, lengths: np.ndarray) -> int:
        """Store pieces; the number of the first."""
        first = self.n_pieces
        while self.n_ids + len(ids) > len(self.store):
            self.store = np.concatenate([self.store, np.zeros_like(self.store)])
        while first + len(lengths) > len(self.spans):
            self.spans = np.concatenate([self.spans, np.zeros_like(self.spans)])
        self.store[self.n_ids : self.n_ids + len(ids)] = ids
        self.spans[first : first + len(lengths), 0] = self.n_ids + np.cumsum(lengths) - lengths
        self.spans[first : first + len(lengths), 1] = lengths
        self.n_ids += len(ids)
        self.n_pieces += len(lengths)
        return first

    def _merge(self, fresh: list[str]) -> None:
        """Encode new plain pieces."""
        plain = [" ".join(fresh[k : k + 1000]).encode().decode("latin-1").translate(self.alphabet) for k in range(0, len(fresh), 1000)]
        ids = np.concatenate([np.array(x.ids, np.uint32) for x in self.merges.encode_batch_fast(plain, add_special_tokens=False)])
        at = np.flatnonzero(self.ends[ids]) + 1
        if len(at) != len(fresh):
            raise ValueError("the tokenizer's pieces don't end in its word suffix")
        first = self._keep(ids, np.diff(at, prepend=0))
        self.pieces.update(zip(fresh, range(first, first + len(fresh)), strict=True))

    def _learn(self, words: list[str]) -> list[int]:
        """Numbers of new words."""
        parts, fresh, odd = [], {}, []
        for w in words:
            m = _PLAIN_WORD.fullmatch(w)
            if m is None:
                odd.append(w)
                parts.append((w, None))
                continue
            a, b = m.groups()
            a = a and a.lower()
            if a and a not in self.pieces:
                fresh[a] = None
            if b and b not in self.pieces:
                fresh[b] = None
            parts.append((a or b, b if a else None))
        if fresh:
            self._merge(list(fresh))
        other = {}
        if odd:
            got = [x.ids for x in self.whole.encode_batch(odd, add_special_tokens=False)]
            first = self._keep(np.array([i for x in got for i in x], np.uint32), np.array([len(x) for x in got], np.int64))
            other = dict(zip(odd, range(first, first + len(odd)), strict=True))
        where = self.pieces
        pairs = [(other[a] if a in other else where[a] if a else -1, where[b] if b else -1) for a, b in parts]
        first = self.n_words
        while first + len(pairs) > len(self.pairs):
            self.pairs = np.concatenate([self.pairs, np.full_like(self.pairs, -1)])
        self.pairs[first : first + len(pairs)] = pairs
        self.n_words += len(pairs)
        return list(range(first, self.n_words))

    def _ids(self, numbers: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words, end to end, and where each ends."""
        flat = self.pairs[np.array(numbers, np.int64)].ravel() if numbers else np.zeros(0, np.int32)
        start, length = self.spans[flat, 0], np.where(flat >= 0, self.spans[flat, 1], 0)
        ends = np.cumsum(length)
        at = np.repeat(start - (ends - length), length) + np.arange(int(ends[-1]) if len(ends) else 0)
        return self.store[at], ends[1::2]

    def _renew(self, words: list[str]) -> None:
        """Forget all but these words."""
        known = [w for w in words if w in self.words]
        ids, ends = self._ids([self.words[w] for w in known])
        self._clear()
        self._keep(ids, np.diff(ends, prepend=0))
        self.pairs = np.full((max(1024, len(known)), 2), -1, np.int32)
        self.pairs[: len(known), 0] = np.arange(len(known))
        self.n_words = len(known)
        self.words.update(zip(known, range(len(known)), strict=True))

    def encode(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids (uint32) of all rows, end to end, and the rows' offsets in them; null counts as empty."""
        was = gc.isenabled()
        gc.disable()  # many small tuples, no cycles
        try:
            return self._encode(col)
        finally:
            if was:
                gc.enable()

    def _encode(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if isinstance(col, pa.ChunkedArray):
            col = col.combine_chunks()
        col = col.fill_null("")
        if not self.by_words:
            got = [np.array(x.ids, np.uint32) for x in self.whole.encode_batch(col.to_pylist(), add_special_tokens=False)]
            return np.concatenate([np.zeros(0, np.uint32), *got]), np.concatenate(([0], np.cumsum([len(x) for x in got], dtype=np.int64)))
        split = pc.ascii_split_whitespace(col)
        coded = split.flatten().dictionary_encode()
        words = coded.dictionary.to_pylist()
        if len(self.words) + len(words) > self.most_words:
            self._renew(words)
        numbers = list(map(self.words.get, words))
        fresh = [w for w, k in zip(words, numbers, strict=True) if k is None]
        if fresh:
            self.words.update(zip(fresh, self._learn(fresh), strict=True))
            numbers = list(map(self.words.__getitem__, words))
        each, ends = self._ids(numbers)
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)).astype(np.int32)), pa.array(each))
        taken = lists.take(coded.indices)
        word_at = np.asarray(taken.offsets).astype(np.int64)
        ids = np.asarray(taken.values)
        return ids, word_at[np.asarray(split.offsets)] if len(col) else np.zeros(1, np.int64)
