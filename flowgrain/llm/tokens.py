"""Token ids by a vocabulary file of the ``tokenizers`` library, looked up by the pieces of words.

For the files whose pre-tokenizer never joins text over white space (lower-casing word BPE with a word-end
mark), the ids of a text are those of its white-space separated words, one after the other, and a word's are those
of its pieces (runs of letters, single digits, runs of signs). A batch of texts is split and made distinct by Arrow;
the pieces of its distinct words are found and looked up with numpy in a table that each process keeps, and only
pieces not in it become Python strings and go through the model, in bulk. The table is bound by its number of
pieces and has two generations: when the younger is full, the older is dropped, and pieces still in use move over.

A piece is known by its bytes up to 16 of them, above by two XXH64 hashes. What the byte classes don't plainly cover
(letters other than ASCII and U+00C0 to U+00FF, apostrophes, controls) goes through the file's own tokenizer word by
word, texts with special tokens or U+001C to U+001F as a whole; other vocabulary files always do.
"""

from __future__ import annotations

import json
import os
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .bytetext import LOWER, flatten, mix, xxh64

#: Pieces that one generation of a process's table holds, and slow words that are remembered.
PIECES, SLOW = 1 << 20, 1 << 16
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_U = np.uint64
LETTER, DIGIT, SIGN, SLOW_BYTE = 1, 2, 3, 4
_KIND = np.full(256, SLOW_BYTE, np.uint8)
_KIND[[*range(0x01, 0x1C), *range(0x20, 0x80)]] = SIGN
_KIND[[*range(65, 91), *range(97, 123)]] = LETTER
_KIND[48:58] = DIGIT
_KIND[39] = SLOW_BYTE


class Table:
    """Ids of pieces by a 128-bit key, with open addressing; two arrays of keys and ragged ids."""

    def __init__(self, most: int):
        self.most, self.n = most, 0
        self.bits = (2 * most - 1).bit_length()
        self.at = np.full(1 << self.bits, -1, np.int32)
        self.low, self.high = np.empty(most, np.uint64), np.empty(most, np.uint64)
        self.stop = np.zeros(most + 1, np.int64)
        self.ids = np.zeros(4 * most, np.uint32)

    def _slot(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return (mix(low ^ mix(high + _U(0x9E3779B97F4A7C15))) >> _U(64 - self.bits)).astype(np.int64)

    def find(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The row of each key, -1 where it is unknown."""
        out = np.full(len(low), -1, np.int64)
        slot, todo = self._slot(low, high), np.arange(len(low))
        while len(todo):
            row = self.at[slot]
            there = row >= 0
            todo, slot, row = todo[there], slot[there], row[there]
            same = (self.low[row] == low[todo]) & (self.high[row] == high[todo])
            out[todo[same]] = row[same]
            todo, slot = todo[~same], (slot[~same] + 1) & ((1 << self.bits) - 1)
        return out

    def add(self, low: np.ndarray, high: np.ndarray, ids: np.ndarray, size: np.ndarray) -> None:
        """Put in new, distinct keys with ``size`` ids each."""
        first, end = self.n, self.n + len(low)
        self.low[first:end], self.high[first:end] = low, high
        self.stop[first + 1 : end + 1] = self.stop[first] + np.cumsum(size)
        while self.stop[end] > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(len(self.ids), np.uint32)])
        self.ids[self.stop[first] : self.stop[end]] = ids
        self.n = end
        slot, row = self._slot(low, high), np.arange(first, end, dtype=np.int32)
        while len(row):
            free = self.at[slot] < 0
            self.at[slot[free]] = row[free]
            left = self.at[slot] != row
            row, slot = row[left], (slot[left] + 1) & ((1 << self.bits) - 1)


def ragged(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Positions start, start + 1, … of ``size`` entries each, one run after the other."""
    end = np.cumsum(size)
    return np.repeat(start - (end - size), size) + np.arange(end[-1] if len(end) else 0)


def keys(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits for each byte range: the bytes themselves up to 16 of them, else two hashes."""
    pad = np.zeros(len(data) + 16, np.uint8)
    pad[: len(data)] = data
    eight = np.ndarray((len(data) + 9,), "<u8", pad.data, 0, (1,))
    size = end - start

    def part(at: np.ndarray, n: np.ndarray) -> np.ndarray:
        left = 8 * (8 - np.clip(n, 0, 8))
        return np.where(n > 0, eight[np.minimum(at, len(data))] << np.minimum(left, 63).astype(np.uint64) >> np.minimum(left, 63).astype(np.uint64), _U(0))

    low, high = part(start, size), part(start + 8, size - 8)
    wide = np.flatnonzero(size > 16)
    if len(wide):
        low[wide], high[wide] = xxh64(data, start[wide], end[wide], 1), xxh64(data, start[wide], end[wide], 2)
    return low, high


class Encoder:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.path = path
        self.special = [t["content"] for t in spec.get("added_tokens", ())]
        self.fast = self._is_word_bpe(spec)
        if self.fast:
            self._prepare(spec, path)

    @cached_property
    def full(self):
        """The file's own tokenizer, loaded when a text needs it."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    @staticmethod
    def _is_word_bpe(spec: dict) -> bool:
        steps = [n.get("type") for n in (spec.get("normalizer") or {}).get("normalizers", ())]
        pre = (spec.get("pre_tokenizer") or {}).get("pretokenizers", ())
        return (
            spec["model"].get("end_of_word_suffix") == "</w>"
            and steps == ["NFC", "Replace", "Lowercase"]
            and [p.get("type") for p in pre] == ["Split", "ByteLevel"]
            and pre[0]["pattern"].get("Regex") == _PATTERN
            and not pre[1]["use_regex"]
        )

    def _prepare(self, spec: dict, path: str) -> None:
        from tokenizers import Tokenizer, pre_tokenizers

        self.model = Tokenizer.from_file(path)
        self.model.normalizer = None
        self.model.post_processor = None
        self.model.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocab = spec["model"]["vocab"]
        self.ends = np.zeros(max(vocab.values()) + 2, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.young, self.old = Table(PIECES), Table(1)
        self.slow: dict[str, np.ndarray] = {}

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.full.encode(text, add_special_tokens=False).ids, np.uint32)

    def _slow(self, word: str) -> np.ndarray:
        """The ids of a word that the byte classes don't cover."""
        ids = self.slow.get(word)
        if ids is None:
            if len(self.slow) >= SLOW:
                self.slow.clear()
            ids = self.slow[word] = self._whole(word)
        return ids

    def _model(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pieces through the model, and how many each has."""
        # The library's time for one text grows faster than its length, that for a call is fixed: 64 at a time.
        lines = self.model.encode_batch_fast([" ".join(pieces[i : i + 64]) for i in range(0, len(pieces), 64)], add_special_tokens=False)
        ids = np.concatenate([np.array(x.ids, np.uint32) for x in lines])
        stop = np.flatnonzero(self.ends[ids]) + 1
        if len(stop) != len(pieces):
            raise RuntimeError("the vocabulary does not mark the end of each word")
        return ids, np.diff(stop, prepend=0)

    def _rows(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The row of each piece in the younger table, after those that are new to it went in."""
        low, high = keys(data, start, end)
        row = self.young.find(low, high)
        new = np.flatnonzero(row < 0)
        if len(new):
            order = new[np.lexsort((high[new], low[new]))]
            distinct = np.ones(len(order), bool)
            distinct[1:] = (low[order][1:] != low[order][:-1]) | (high[order][1:] != high[order][:-1])
            one = order[distinct]
            if self.young.n + len(one) > self.young.most:
                self.old, self.young = self.young, Table(max(PIECES, 2 * len(start)))
                return self._rows(data, start, end)
            have = self.old.find(low[one], high[one])
            moved, had = one[have >= 0], have[have >= 0]
            if len(moved):
                size = self.old.stop[had + 1] - self.old.stop[had]
                self.young.add(low[moved], high[moved], self.old.ids[ragged(self.old.stop[had], size)], size)
            fresh = one[have < 0]
            if len(fresh):
                raw = data.tobytes()
                self.young.add(low[fresh], high[fresh], *self._model([raw[a:b].decode() for a, b in zip(start[fresh].tolist(), end[fresh].tolist(), strict=True)]))
            row[new] = self.young.find(low[new], high[new])
        return row

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words, one after the other, and the bounds of each word's."""
        data, off = flatten(words)
        n = len(off) - 1
        kind = _KIND[data]
        # U+00C0 to U+00FF but for the two signs in it: both bytes are letters.
        lead = np.flatnonzero(data[:-1] == 0xC3) if len(data) else np.zeros(0, np.int64)
        lead = lead[(data[lead + 1] != 0x97) & (data[lead + 1] != 0xB7)]
        kind[lead] = kind[lead + 1] = LETTER
        slow = np.add.reduceat(kind == SLOW_BYTE, off[:-1], dtype=np.int64) > 0 if n else np.zeros(0, bool)
        fold = LOWER[data]
        fold[lead + 1] += np.where(data[lead + 1] < 0x9F, 0x20, 0).astype(np.uint8)
        first = np.ones(len(data), bool)
        first[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)
        first[off[:-1]] = True
        start = np.flatnonzero(first)
        word = np.searchsorted(off, start, "right") - 1
        end = np.r_[start[1:], len(data)]
        fast = ~slow[word]
        row = self._rows(fold, start[fast], end[fast])
        size = self.young.stop[row + 1] - self.young.stop[row]
        per_word = np.bincount(word[fast], size, n).astype(np.int64)
        ids = self.young.ids[ragged(self.young.stop[row], size)]
        at = np.flatnonzero(slow)
        if len(at):
            own = [self._slow(w) for w in words.take(pa.array(at)).to_pylist()]
            per_word[at] = [len(x) for x in own]
            where = np.repeat(~slow, per_word)
            whole = np.empty(len(where), np.uint32)
            whole[where], whole[~where] = ids, np.concatenate(own)
            ids = whole
        return ids, np.r_[0, np.cumsum(per_word)]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, bounds of each text's); no special tokens are added, a null is empty."""
        texts = texts.cast(pa.large_string()).fill_null("")
        if not self.fast:
            lists = [np.array(e.ids, np.uint32) for e in self.full.encode_batch(texts.to_pylist(), add_special_tokens=False)]
            return np.concatenate([np.zeros(0, np.uint32), *lists]), np.r_[0, np.cumsum([len(x) for x in lists], dtype=np.int64)]
        odd = pc.match_substring_regex(texts, "[\\x1c-\\x1f]")
        for s in self.special:
            odd = pc.or_(odd, pc.match_substring(texts, s))
        at = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
        split = pc.ascii_split_whitespace(pc.if_else(odd, "", texts))
        bound = split.offsets.to_numpy() - split.offsets[0].as_py()
        # An empty text is split into one empty word, as are the ends of a text beside white space.
        flat = split.flatten()
        real = pc.greater(pc.binary_length(flat), 0)
        bound = np.r_[0, np.cumsum(real.to_numpy(zero_copy_only=False))][bound]
        coded = flat.filter(real).dictionary_encode()
        ids, stop = self._words(coded.dictionary)
        code = coded.indices.to_numpy(zero_copy_only=False)
        size = np.diff(stop)[code]
        total = np.r_[0, np.cumsum(size)]
        out, bounds = ids[ragged(stop[code], size)], total[bound]
        if not len(at):
            return out, bounds
        parts, done, shift = [], 0, np.zeros(len(texts) + 1, np.int64)
        for i, text in zip(at.tolist(), texts.take(pa.array(at)).to_pylist(), strict=True):
            own = self._whole(text)
            parts += [out[done : bounds[i]], own]
            done = bounds[i]
            shift[i + 1 :] += len(own)
        return np.concatenate([*parts, out[done:]]), bounds + shift

    def encode_batch(self, texts: list[str]) -> list[list[int]]:
        """The ids of each text."""
        ids, bound = self.encode(pa.array(texts, pa.large_string()))
        return [ids[a:b].tolist() for a, b in zip(bound[:-1], bound[1:], strict=True)]


#: Name of the vocabulary file in the package of public tokenizers.
VOCABULARY = "word_bpe_49k.json"


def vocabulary() -> str:
    """The path of the vocabulary file; the package has the same place on all machines."""
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


@lru_cache(2)
def encoder(path: str) -> Encoder:
    """The process's encoder of a vocabulary file.

    The library's own threads are off: a task has one core, and every thread would hold memory of its own.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Encoder(path)
