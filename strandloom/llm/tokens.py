"""Token ids of whole batches of texts by a tokenizer of the tokenizers library.

The tokenizers of this kind split a text before a run of white space, so a text's ids are those of its
units, one after the other. A unit is a run of white space with the word behind it, or the punctuation that
follows an ASCII letter; each different unit of a batch is encoded once, and a bounded cache keeps ids between
batches. Where the character before white space may itself be white space outside ASCII, there is no cut.
"""

from __future__ import annotations

import os
from array import array

import numpy as np
import pyarrow as pa

from .text import SPACE, utf8

#: Last bytes of characters that a tokenizer may count as white space; a cut behind them would be unsafe. Only the last byte is looked at.
UNSAFE = np.zeros(256, bool)
UNSAFE[[0x1C, 0x1D, 0x1E, 0x1F, 0x80, 0x85, 0xA0, 0xA8, 0xA9, 0xAF, 0x9F, 0x8E, 0xBF, *range(0x81, 0x8B)]] = True
#: Between an ASCII letter and one of these marks the tokenizers' patterns always split.
LETTER, STOP = np.zeros(256, bool), np.zeros(256, bool)
LETTER[[*range(65, 91), *range(97, 123)]] = True
STOP[list(b".,;:!?")] = True


class Encoder:
    def __init__(self, path: str, end_id: int | None = None, cache: int = 250_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.end_id, self.limit = end_id, cache
        self.young: dict[bytes, bytes] = {}  # what doesn't come up again while `cache` others do is forgotten
        self.old: dict[bytes, bytes] = {}
        self.mark, self.mark_id = None, -1
        for mark in ("\n", " \x01 "):
            ids = self.tokenizer.encode(mark, add_special_tokens=False).ids
            if len(ids) == 1:
                self.mark, self.mark_id = mark, ids[0]
                break

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """uint32 ids of all texts of a string column, and the n + 1 offsets of its rows; nulls are empty."""
        data, offsets = utf8(column)
        rows = len(offsets) - 1
        cut = np.zeros(len(data), bool)
        if len(data):
            space = SPACE[data]
            at = np.flatnonzero(space[1:] & ~space[:-1]) + 1
            cut[at[~self._risky(data, at - 1)]] = True
            at = np.flatnonzero(STOP[data[1:]]) + 1
            cut[at[LETTER[data[at - 1]]]] = True
            begin = offsets[:-1]
            cut[begin[begin < len(data)]] = True
        start = np.flatnonzero(cut)
        first = np.searchsorted(start, offsets)
        bounds = np.append(start, len(data)).astype(np.int64)
        units = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data))])
        coded = units.dictionary_encode()
        code = coded.indices.to_numpy(zero_copy_only=False)
        found = self._lookup(coded.dictionary.to_pylist())
        size = np.fromiter(map(len, found), np.int64, len(found)) // 4
        flat = np.frombuffer(b"".join(found), np.uint32)
        at = np.cumsum(size) - size
        length = size[code]
        ends = np.zeros(len(code) + 1, np.int64)
        np.cumsum(length, out=ends[1:])
        ids = flat[np.repeat(at[code] - ends[:-1], length) + np.arange(ends[-1])] if len(code) else np.zeros(0, np.uint32)
        bounds = ends[first]
        if self.end_id is None:
            return ids, bounds
        out = np.empty(len(ids) + rows, np.uint32)
        closed = bounds + np.arange(rows + 1)
        mask = np.ones(len(out), bool)
        mask[closed[1:] - 1] = False
        out[mask] = ids
        out[~mask] = self.end_id
        return out, closed

    @staticmethod
    def _risky(data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Of each place: its byte may end a character that counts as white space outside ASCII."""
        last, back1, back2 = data[at], data[np.maximum(at - 1, 0)], data[np.maximum(at - 2, 0)]
        return UNSAFE[last] & (((last >= 0x1C) & (last <= 0x1F)) | (back1 == 0xC2) | np.isin(back2, (0xE1, 0xE2, 0xE3, 0xEF)))

    def _lookup(self, units: list[bytes]) -> list[bytes]:
        young, old = self.young, self.old
        missing = [u for u in units if u not in young]
        if missing and old:
            for u in missing:
                if (ids := old.get(u)) is not None:
                    young[u] = ids
            missing = [u for u in missing if u not in young]
        plain = [u for u in missing if self._joins(u)] if self.mark is not None else []
        if len(plain) >= 64:
            self._encode_joined(plain)
            missing = [u for u in missing if u not in young]
        for at in range(0, len(missing), 4096):
            self._encode_each(missing[at : at + 4096])
        out = [young[u] for u in units]
        if len(young) > self.limit:
            self.old, self.young = young, {}
        return out

    @staticmethod
    def _joins(unit: bytes) -> bool:
        """Whether a unit is one space and a word whose end can't run into white space behind it."""
        return unit[0] == 32 and len(unit) > 1 and unit[1] > 32 and (32 < unit[-1] < 127 or unit[-2] == 0xC3)

    def _encode_each(self, units: list[bytes]) -> None:
        for u, e in zip(units, self.tokenizer.encode_batch_fast([u.decode() for u in units], add_special_tokens=False)):
            self.young[u] = array("I", e.ids).tobytes()

    def _encode_joined(self, units: list[bytes], size: int = 512) -> None:
        """Encode many units as one text with marks between them, which saves most of the calls' overhead."""
        parts = [units[at : at + size] for at in range(0, len(units), size)]
        for at in range(0, len(parts), 8):
            some = parts[at : at + 8]
            texts = [self.mark.join([u.decode() for u in part]) for part in some]
            for part, e in zip(some, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)):
                ids = np.array(e.ids, np.uint32)
                cuts = np.flatnonzero(ids == self.mark_id)
                if len(cuts) != len(part) - 1:  # the mark occurs in a unit
                    self._encode_each(part)
                    continue
                raw, lo = ids.tobytes(), 0
                for u, hi in zip(part, [*cuts.tolist(), len(ids)]):
                    self.young[u] = raw[4 * lo : 4 * hi]
                    lo = hi + 1


_ENCODERS: dict[tuple, Encoder] = {}


def encoder(path: str, end_id: int | None = None) -> Encoder:
    """One encoder for each Python worker, whose cache serves all its tasks."""
    if (path, end_id) not in _ENCODERS:
        _ENCODERS[path, end_id] = Encoder(path, end_id)
    return _ENCODERS[path, end_id]
