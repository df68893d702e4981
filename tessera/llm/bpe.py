"""Byte-level BPE over Arrow batches. A text is parted where the tokenizer's own pattern is sure to part it, each
distinct unit is encoded once by the tokenizers library, and ids are put together by numpy."""

from __future__ import annotations

import os
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa

from .common import _BYTE, _byte_values, mix, text_bytes

#: Texts are encoded in pieces of about so many bytes, which bounds the temporaries of a worker (some twenty arrays of 8 bytes a byte).
_PIECE_BYTES = 1 << 19
_U = np.uint64


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@lru_cache(None)
def _classes() -> tuple[np.ndarray, ...]:
    b = np.arange(256)
    sure = (b > 0x20) & (b < 0x7F)
    alnum = ((b >= 48) & (b < 58)) | ((b >= 65) & (b < 91)) | ((b >= 97) & (b < 123))
    return sure, alnum, sure & ~alnum & (b != 0x27)


@lru_cache(None)
def _marks() -> np.ndarray:
    """The classes of each byte as bits 1, 2 and 4."""
    return sum(c.astype(np.uint8) << np.uint8(k) for k, c in enumerate(_classes())).astype(np.uint8)


def unit_starts(part: np.ndarray, rel: np.ndarray) -> np.ndarray:
    """Where units of the texts part[rel[i]:rel[i+1]] start. Only places where the pattern of byte-level BPE parts
    any text: a space beside visible ASCII, a single line feed's ends beside it, and between ASCII letters or digits and
    punctuation other than the apostrophe. A place left out only makes a longer unit."""
    n = len(part)
    if not n:
        return np.zeros(0, np.int64)
    mark = _marks()[part]
    sure, alnum, punct = (mark & np.uint8(bit) != 0 for bit in (1, 2, 4))
    edge = np.zeros(n, bool)  # of a text: neighbours across it don't count
    edge[rel[:-1][rel[:-1] < n]] = True
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:] = sure[:-1]
    after[:-1] = sure[1:] & ~edge[1:]
    before &= ~edge
    start = edge | ((part == 0x20) & (before | after)) | ((part == 0x0A) & before)
    inner = np.zeros(n, bool)
    inner[1:] = (punct[1:] & alnum[:-1]) | (alnum[1:] & punct[:-1])
    inner[2:] |= (part[1:-1] == 0x0A) & before[1:-1] & sure[2:]
    return np.flatnonzero(start | inner)


class Encoder:
    """Ids of texts, as the tokenizers library gives them with add_special_tokens=False. Strings of special tokens
    are ordinary text. Units are told apart by a 64-bit hash of their bytes and their length; two generations of at
    most most_units are remembered, so memory is bounded."""

    def __init__(self, path: str, most_units: int = 400_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = True
        self.vocab_size = self.tok.get_vocab_size(with_added_tokens=True)
        self.most = most_units
        self.young = self.old = (np.zeros(0, _U), np.zeros(0, np.int64), np.zeros(1, np.int64), np.zeros(0, np.uint32))

    @staticmethod
    def _find(table, keys: np.ndarray) -> np.ndarray:
        """Slot of each key in a table, -1 if it has none."""
        known, slots = table[0], table[1]
        if not len(known):
            return np.full(len(keys), -1, np.int64)
        at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
        return np.where(known[at] == keys, slots[at], -1)

    def _learn(self, keys, ids_at, ids) -> None:
        """Add units, with the ends of their ids, to the young table; a full one becomes the old one."""
        known, slots, ends, flat = self.young
        if len(known) + len(keys) > self.most and len(known):
            self.old = self.young
            known, slots, ends, flat = np.zeros(0, _U), np.zeros(0, np.int64), np.zeros(1, np.int64), np.zeros(0, np.uint32)
        order = np.argsort(keys, kind="stable")
        at = np.searchsorted(known, keys[order])
        self.young = np.insert(known, at, keys[order]), np.insert(slots, at, len(ends) - 1 + order), np.concatenate([ends, ends[-1] + ids_at]), np.concatenate([flat, ids])

    def _encode_units(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of single units, and the ends of each unit's ids."""
        found = [e.ids for e in self.tok.encode_batch([u.decode() for u in units], add_special_tokens=False)]
        n = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), np.uint32, int(n.sum())), np.cumsum(n)

    @lru_cache(1)  # noqa: B019  one encoder lives as long as its process
    def _begins(self) -> np.ndarray:
        """Which ids' strings begin with a space."""
        out = np.zeros(self.vocab_size, bool)
        for s, i in self.tok.get_vocab(with_added_tokens=True).items():
            out[i] = s.startswith("Ġ")
        return out

    def _encode_words(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The same for units that begin with a space and have no other: they are joined for fewer calls, and told apart by their spaces."""
        joined = [b"".join(units[i : i + 128]).decode() for i in range(0, len(units), 128)]
        found = [e.ids for e in self.tok.encode_batch(joined, add_special_tokens=False)]
        ids = np.fromiter(chain.from_iterable(found), np.uint32, sum(map(len, found)))
        starts = np.flatnonzero(self._begins()[ids])
        assert len(starts) == len(units)
        return ids, np.append(starts[1:], len(ids))

    def _piece(self, data: np.ndarray, rel: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        starts = unit_starts(data, rel)
        n_rows = len(rel) - 1
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(n_rows, np.int64)
        ends = np.append(starts[1:], len(data))
        up, down = _BYTE.get(len(data) + 1)
        total = np.zeros(len(data) + 1, _U)
        np.cumsum(_byte_values(False)[data] * up[: len(data)], out=total[1:])
        keys, first, which = np.unique(mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(_U)), return_index=True, return_inverse=True)
        del total
        young, old = self._find(self.young, keys), self._find(self.old, keys)
        old[young >= 0] = -1
        parts, sizes = [], np.zeros(len(keys), np.int64)
        begin = np.zeros(len(keys), np.int64)
        base = 0
        fresh_keys, fresh_ids, fresh_n = [], [], []
        for slot, (_, _, at, flat) in ((young, self.young), (old, self.old)):
            if (hit := slot >= 0).any():
                s = slot[hit]
                begin[hit], sizes[hit] = base + at[s], at[s + 1] - at[s]
                parts.append(flat)
                base += len(flat)
                if slot is old:  # what is used again stays
                    fresh_keys.append(keys[hit])
                    fresh_n.append(sizes[hit])
                    fresh_ids.append(flat[np.repeat(at[s] - np.cumsum(sizes[hit]) + sizes[hit], sizes[hit]) + np.arange(sizes[hit].sum())])
        miss = np.flatnonzero((young < 0) & (old < 0))
        if len(miss):
            raw = data.tobytes()
            lo, hi = starts[first[miss]], ends[first[miss]]
            # a space and a letter, then no byte with which white space of any kind begins: only the first id can begin with a space
            space = (data <= 0x20) | (data == 0xC2) | ((data >= 0xE1) & (data <= 0xE3))
            seen = np.concatenate([[0], np.cumsum(space)])
            second = data[np.minimum(lo + 1, len(data) - 1)]
            plain = (data[lo] == 0x20) & (hi - lo > 1) & (seen[hi] - seen[lo] == 1) & (_classes()[1][second] | (second == 0xC3))
            for chosen, how in ((miss[plain], self._encode_words), (miss[~plain], self._encode_units)):
                if len(chosen):
                    units = [raw[a:b] for a, b in zip(starts[first[chosen]].tolist(), ends[first[chosen]].tolist(), strict=True)]
                    ids, at = how(units)
                    n = np.diff(at, prepend=0)
                    begin[chosen], sizes[chosen] = base + at - n, n
                    parts.append(ids)
                    base += len(ids)
                    fresh_keys.append(keys[chosen])
                    fresh_n.append(n)
                    fresh_ids.append(ids)
        flat = np.concatenate(parts)
        if fresh_keys:
            self._learn(np.concatenate(fresh_keys), np.cumsum(np.concatenate(fresh_n)), np.concatenate(fresh_ids))
        size = sizes[which]
        ends_at = np.concatenate([[0], np.cumsum(size)])
        out = flat[np.repeat(begin[which] - ends_at[:-1], size) + np.arange(ends_at[-1])]
        row_at = ends_at[np.searchsorted(starts, rel)]
        return out, np.diff(row_at)

    def encode(self, texts: pa.Array):
        """Yields (first row, ids of consecutive rows, number of ids of each), a bounded piece at a time. Null: no ids."""
        data, offsets = text_bytes(texts)
        i, n = 0, len(texts)
        while i < n:
            j = min(n, max(i + 1, int(np.searchsorted(offsets, offsets[i] + _PIECE_BYTES, "right")) - 1))
            part = data[offsets[i] : offsets[j]]
            ids, count = self._piece(part, offsets[i : j + 1] - offsets[i]) if len(part) <= 2 * _PIECE_BYTES else self._long(part)
            yield i, ids, count
            i = j

    def _long(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of one long text, by pieces that end where a unit starts."""
        found, at, size = [], 0, _PIECE_BYTES
        while at < len(data):
            end = min(len(data), at + size)
            if end < len(data):
                # the byte behind is looked at too: whether a unit starts depends on its neighbours
                starts = unit_starts(data[at : end + 1], np.array([0, end + 1 - at]))
                starts = starts[(starts > 1) & (starts < end - at)]
                if not len(starts):  # one unit: try a longer piece
                    size *= 2
                    continue
                end = at + int(starts[-1])
            found.append(self._piece(data[at:end], np.array([0, end - at]))[0])
            at, size = end, _PIECE_BYTES
        ids = np.concatenate(found)
        return ids, np.array([len(ids)])


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each worker process."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def with_end(ids: np.ndarray, n: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The same rows, each with end_id behind its ids."""
    ends = np.cumsum(n + 1)
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint32)
    mask = np.ones(len(out), bool)
    mask[ends - 1] = False
    out[mask] = ids
    out[ends - 1] = end_id
    return out, n + 1
