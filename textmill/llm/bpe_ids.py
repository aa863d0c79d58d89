"""Token ids of whole texts with a public byte-level BPE, through the tokenizers library.

A byte-level BPE never merges across pre-tokens, so equal pieces of text between safe cuts always get equal ids.
Each worker cuts a block of text at such places with NumPy, looks the pieces up by hash and then by their bytes, and hands the library
only pieces it has not seen. The ids are those of ``Tokenizer.encode(text, add_special_tokens=False)``.

Safe cuts are the places where the pre-token pattern always ends a token: before a space or line feed that
follows a solid character, and before ASCII punctuation that follows an ASCII letter. Where the preceding
character is not surely solid, there is no cut, and the piece is longer.
"""

from __future__ import annotations

import numpy as np

from .common import KEPT, SpanHasher, mix

#: Pieces, and bytes of them, that a worker remembers at most; beyond it the memory starts afresh. About 90 bytes a piece with what a growing table copies.
REMEMBER, REMEMBER_BYTES = 400_000, 1 << 24

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x0A]] = True
_SOLID = np.zeros(256, dtype=bool)
_SOLID[0x21:0x7F] = True
_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_PUNCT = _SOLID & ~_LETTER
_PUNCT[0x30:0x3A] = False
_LEAD2 = np.zeros(256, dtype=bool)
_LEAD2[0xC3:0xE0] = True  # two-byte characters without U+0085 and U+00A0


def _byte_alphabet() -> list[str]:
    """The printable stand-in of each byte in a byte-level BPE: itself if printable, else the next free from U+0100."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Runs:
    """Numbered runs of values in one growing array."""

    def __init__(self, kind):
        self.pool, self.used = np.zeros(1 << 20, kind), 0
        self.first, self.length, self.n = np.zeros(1 << 17, np.int32), np.zeros(1 << 17, np.int32), 0

    def append(self, flat: np.ndarray, length: np.ndarray) -> None:
        while self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        while self.n + len(length) > len(self.first):
            self.first, self.length = (np.concatenate([x, np.zeros_like(x)]) for x in (self.first, self.length))
        self.pool[self.used : self.used + len(flat)] = flat
        self.first[self.n : self.n + len(length)] = self.used + np.cumsum(length) - length
        self.length[self.n : self.n + len(length)] = length
        self.used, self.n = self.used + len(flat), self.n + len(length)


class PieceTable:
    """Open addressing from 64-bit piece hashes to entries, which have the piece's bytes and its ids; all steps are vectorised."""

    def __init__(self, bits: int = 18):
        self._reset(bits)
        self.ids, self.raw = Runs(np.uint32), Runs(np.uint8)

    def _reset(self, bits: int) -> None:
        self.mask = np.uint64((1 << bits) - 1)
        self.key, self.at = np.zeros(1 << bits, np.uint64), np.full(1 << bits, -1, np.int32)

    def find(self, h: np.ndarray) -> np.ndarray:
        """The entry of each hash, -1 where there is none."""
        slot = (h & self.mask).astype(np.int64)
        out = self.at[slot]
        wait = np.flatnonzero((out >= 0) & (self.key[slot] != h))
        while len(wait):
            slot[wait] = (slot[wait] + 1) & int(self.mask)
            out[wait] = self.at[slot[wait]]
            wait = wait[(out[wait] >= 0) & (self.key[slot[wait]] != h[wait])]
        return out

    def _place(self, h: np.ndarray, entry: np.ndarray) -> None:
        slot = (h & self.mask).astype(np.int64)
        left = np.arange(len(h))
        while len(left):
            free = left[self.at[slot[left]] < 0]
            _, one = np.unique(slot[free], return_index=True)
            won = free[one]
            self.key[slot[won]], self.at[slot[won]] = h[won], entry[won]
            left = left[self.key[slot[left]] != h[left]]
            slot[left] = (slot[left] + 1) & int(self.mask)

    def append(self, pieces: list[bytes], ids: list[list[int]]) -> np.ndarray:
        """New entries, which no hash finds yet."""
        n = self.ids.n
        length = np.fromiter(map(len, ids), np.int32, len(ids))
        self.ids.append(np.fromiter((x for y in ids for x in y), np.uint32, int(length.sum())), length)
        self.raw.append(np.frombuffer(b"".join(pieces), np.uint8), np.fromiter(map(len, pieces), np.int32, len(pieces)))
        return np.arange(n, self.ids.n, dtype=np.int32)

    def add(self, h: np.ndarray, pieces: list[bytes], ids: list[list[int]]) -> None:
        """Adds distinct hashes that find() doesn't know."""
        entry = self.append(pieces, ids)
        if 2 * self.ids.n > len(self.key):
            known = np.flatnonzero(self.at >= 0)
            k, e = self.key[known], self.at[known]
            bits = int(self.mask).bit_length()
            while 2 * self.ids.n > 1 << bits:
                bits += 1
            self._reset(bits)
            self._place(k, e)
        self._place(h, entry)

    def differing(self, entry: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Which of the pieces, that cover data one after another, are not the bytes of their entries."""
        out = self.raw.length[entry] != end - start
        first = np.where(out, 0, self.raw.first[entry] - start.astype(np.int32))
        at = np.repeat(first, end - start)
        at += np.arange(len(data), dtype=np.int32)
        if out.any():
            at[np.repeat(out, end - start)] = 0
        return out | np.logical_or.reduceat(self.raw.pool[at] != data, start)


class Encoder:
    """One tokenizer file; encode() takes a block of rows (see common.blocks)."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.alphabet = {i: c for i, c in enumerate(_byte_alphabet())}
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.table = PieceTable()

    def _ids(self, pieces: list[str]) -> list[list[int]]:
        out: list[list[int] | None] = [None] * len(pieces)
        whole = []
        for i, piece in enumerate(pieces):
            body = piece[1:] if piece[0] == " " else piece
            if body.isalpha() and max(body) < "ƀ":  # surely one pre-token
                known = piece.encode().decode("latin-1").translate(self.alphabet)
                out[i] = [t.id for t in self.model.tokenize(known)]
            else:
                whole.append(i)
        for i, e in zip(whole, self.tokenizer.encode_batch_fast([pieces[i] for i in whole], add_special_tokens=False), strict=True):
            out[i] = e.ids
        return out

    def encode(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the block (uint32), and the bounds of each row among them."""
        n, rows = len(data), len(off) - 1
        if not n:
            return np.zeros(0, np.uint32), np.zeros(rows + 1, np.int64)
        solid, letter = _SOLID[data], _LETTER[data]
        solid[1:] |= ((data[1:] & 0xC0) == 0x80) & _LEAD2[data[:-1]]
        cut = np.zeros(n, dtype=bool)
        cut[1:] = (_SPACE[data[1:]] & solid[:-1]) | (_PUNCT[data[1:]] & letter[:-1])
        raw = data.tobytes()
        for name in self.special:  # the library takes these out of a text first, so they stay whole
            at = raw.find(name)
            while at >= 0:
                cut[at + 1 : at + len(name)] = False
                at = raw.find(name, at + 1)
        cut[off[:-1][off[:-1] < n]] = True
        start = np.flatnonzero(cut)
        end = np.append(start[1:], n)
        h = mix(SpanHasher(data).spans(start, end) ^ np.uint64(1))
        if self.table.ids.n > REMEMBER or self.table.raw.used > REMEMBER_BYTES:
            self.table = PieceTable()
        entry = self.table.find(h)
        new = np.flatnonzero(entry < 0)
        if len(new):
            keys, one = np.unique(h[new], return_index=True)
            pieces = [raw[start[i] : end[i]] for i in new[one]]
            self.table.add(keys, pieces, self._ids([x.decode() for x in pieces]))
            entry = self.table.find(h)
        other = np.flatnonzero(self.table.differing(entry, data, start, end))
        if len(other):  # a hash that two pieces have
            pieces = [raw[start[i] : end[i]] for i in other]
            entry[other] = self.table.append(pieces, self._ids([x.decode() for x in pieces]))
        runs = self.table.ids
        length = runs.length[entry].astype(np.int64)
        stop = np.cumsum(length)
        flat = runs.pool[np.repeat(runs.first[entry].astype(np.int64) - (stop - length), length) + np.arange(stop[-1])]
        ends = np.concatenate([[0], stop])
        return flat, ends[np.searchsorted(start, off)]


_encoders: dict[str, Encoder] = {}
KEPT.append(_encoders)


def encoder(path: str) -> Encoder:
    """The worker's encoder of a tokenizer file; it stays until a map of another kind begins."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
