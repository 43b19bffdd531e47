"""Exact ids of a `tokenizers` file, encoding each distinct white-space piece once.

Both vocabularies split their input at white space, and between an ASCII letter
and a stop, before any merge, so the ids of a text are the ids of its pieces
one after the other.  Texts repeat most of their words; each worker process
keeps the ids of pieces it has met and gathers the ids of a whole Arrow batch
with numpy.  What it keeps is bounded: when a generation of pieces is full the
next begins, takes over the pieces that are met again, and the one before goes.
Texts with white space outside ASCII are encoded directly: there a piece's
surroundings could matter.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import held

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: White space outside ASCII's own, as Python's str.isspace has it (fixed values).
_ODD_SPACE = r"[\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_SPACES = b" \t\n\v\f\r"
_IS_SPACE = np.isin(np.arange(256), list(_SPACES))
_IS_STOP = np.isin(np.arange(256), list(b".,;:!?"))
_IS_LETTER = np.array([bytes([b]).isalpha() for b in range(256)])
_FOLDED = np.array([32 if b in _SPACES else bytes([b]).lower()[0] for b in range(256)], np.uint8)
_PIECE_CHARS = 1_500_000
_BATCH_BYTES = 4_000_000


def public_path(name: str) -> str:
    """Where the public vocabulary file ``name`` is on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def encoder(name: str) -> "PieceEncoder":
    """This process's encoder of a vocabulary: a file's path, or the name of a public one."""
    return held(("encoder", name), lambda: PieceEncoder(name if os.path.sep in name else public_path(name)))


def text_slices(part: pa.RecordBatch, text_at: int = 1) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with a bounded number of text bytes, one row at least."""
    ends = np.cumsum(pc.binary_length(part.column(text_at)).to_numpy(zero_copy_only=False))
    lo = 0
    while lo < part.num_rows:
        before = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, before + _BATCH_BYTES, side="right")))
        yield part.slice(lo, hi - lo)
        lo = hi


def _as_bytes(a: pa.Array) -> list[bytes]:
    """The values of a binary array without nulls, several times as fast as its own conversion."""
    ends = np.frombuffer(a.buffers()[1], np.int32, len(a) + 1, a.offset * 4).tolist()
    raw = a.buffers()[2].to_pybytes()
    return [raw[lo:hi] for lo, hi in zip(ends, ends[1:])]


def _gathered(flat: np.ndarray, start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """So many values of ``flat`` from each ``start`` on, in a row."""
    return flat[np.arange(int(n.sum())) + np.repeat(start - np.cumsum(n) + n, n)]


def _folded(chars: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The bytes, those of ASCII pieces in lower case and with plain spaces."""
    out = _FOLDED[chars]
    wide = np.repeat(np.maximum.reduceat(chars, starts) > 127, np.diff(starts, append=len(chars)))
    out[wide] = chars[wide]
    return out


def _folds(normalizer: dict) -> bool:
    """Whether a normaliser composes, makes runs of white space one space, and lower-cases: all of it within a piece, ASCII by the byte."""
    return normalizer.get("normalizers") == [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]


class PieceEncoder:
    """Encodes string arrays to flat uint32 ids; control strings inside texts are ordinary text."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        vocabulary = self.tokenizer.get_vocab()
        self.largest_id = max(vocabulary.values(), default=0)
        self.normalizer = self.tokenizer.normalizer
        self.as_is = self.normalizer is None
        self.folds = not self.as_is and _folds(json.loads(self.normalizer.__getstate__()))
        if not self.as_is:
            self.tokenizer.normalizer = None  # `_normal` applies it, to what it may change
        suffix = self.tokenizer.model.end_of_word_suffix or ""
        self.bytes_of = np.zeros(self.largest_id + 1, np.int64)  # in byte-level vocabularies each letter is a byte
        for token, i in vocabulary.items():
            self.bytes_of[i] = len(token.removesuffix(suffix))
        self._begin()
        self.before = ({}, self.flat, self.start, self.length)

    def _begin(self) -> None:
        self.index: dict[bytes, int] = {}
        self.weight = self.used = 0
        self.flat = np.zeros(1 << 16, np.uint32)
        self.start = np.zeros(1 << 14, np.int64)
        self.length = np.zeros(1 << 14, np.int64)

    def _add(self, new: list[bytes]) -> None:
        index, flat, start, length = self.before
        again = [p for p in new if p in index]
        at = np.fromiter(map(index.__getitem__, again), np.int64, len(again))
        parts = [(_gathered(flat, start[at], length[at]), length[at])]
        *joined, alone = self._joinable([p for p in new if p not in index])
        parts += [self._chained(pieces) for pieces in joined]
        if alone:
            got = self._encoded([p.decode() for p in alone])
            parts.append((np.concatenate(got), np.fromiter(map(len, got), np.int64, len(got))))
        new = sum(joined, again) + alone
        ids, lengths = (np.concatenate(x) for x in zip(*parts))
        n, total = len(self.index), len(ids)
        while n + len(new) > len(self.start):
            self.start, self.length = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.length))
        while self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used : self.used + total] = ids
        self.length[n : n + len(new)] = lengths
        self.start[n : n + len(new)] = self.used + np.cumsum(lengths) - lengths
        self.index.update(zip(new, range(n, n + len(new))))
        self.used += total
        self.weight += sum(map(len, new))

    def _joinable(self, new: list[bytes]) -> tuple[list[bytes], list[bytes], list[bytes]]:
        """ASCII pieces and others that can be encoded one after the other in a string, and the rest.

        Joined ones begin with white space and end with a word, so each keeps
        its own surroundings.  Under a normaliser that isn't known to stay
        within a piece none is joined.
        """
        odd = pc.match_substring_regex(pa.array(new, pa.binary()).cast(pa.string()), _ODD_SPACE).to_pylist()
        out: tuple[list[bytes], ...] = ([], [], [])
        for p, o in zip(new, odd):
            ok = not o and (self.as_is or self.folds) and p[0] in _SPACES and p[-1] not in _SPACES
            out[(0 if p.isascii() else 1) if ok else 2].append(p)
        return out

    def _normal(self, text: str) -> str:
        return text if self.as_is else self.normalizer.normalize_str(text)

    def _encoded(self, texts: list[str]) -> list[np.ndarray]:
        got = self.tokenizer.encode_batch_fast([self._normal(t) for t in texts], add_special_tokens=False)
        return [np.array(e.ids, np.uint32) for e in got]

    def _chained(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of joined pieces, all ASCII or none, and how many each has: an id stands for a fixed number of bytes, so these tell the pieces apart.

        Where case is folded ASCII pieces are in lower case already, and in
        the normalised string of the others each space begins a piece.
        """
        change = self.folds and bool(pieces) and not pieces[0].isascii()
        all_ids, all_lengths = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for i in range(0, len(pieces), 1024):  # one at a time: the library's results are large
            chain = pieces[i : i + 1024]
            text = b"".join(chain).decode()
            if change:
                text = self._normal(text)
            ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
            sizes = map(len, text.encode().split(b" ")[1:] if change else chain if self.as_is else (p.strip(_SPACES) for p in chain))
            ends = np.cumsum(np.fromiter(sizes, np.int64))
            upto = np.cumsum(self.bytes_of[ids])
            last = np.searchsorted(upto, ends)
            if len(ends) != len(chain) or upto[-1] != ends[-1] or (upto[last] != ends).any():
                raise ValueError("the tokenizer's ids don't add up to its input")
            all_ids.append(ids)
            all_lengths.append(np.diff(last + 1, prepend=0))
        return np.concatenate(all_ids), np.concatenate(all_lengths)

    def _pieces(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The known-piece number of each piece of the texts, and where each text's pieces begin (and the last ones end).

        A piece is a run of white space with the word after it, either alone
        at a text's ends; a stop that closes a word after an ASCII letter is a
        piece of its own.  Where case is folded ASCII pieces are, so that all
        spellings of a word are one piece.
        """
        if self.weight > _PIECE_CHARS:
            self.before = (self.index, self.flat, self.start, self.length)
            self._begin()
        bounds = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, texts.offset * 4).astype(np.int64)
        if bounds[-1] == bounds[0]:
            return np.zeros(0, np.int64), np.zeros(len(texts) + 1, np.int64)
        raw = texts.buffers()[2].slice(int(bounds[0]), int(bounds[-1] - bounds[0]))
        bounds -= bounds[0]
        chars = np.frombuffer(raw, np.uint8)
        space = _IS_SPACE[chars]
        begins = space.copy()
        begins[1:] &= ~space[:-1]
        firsts = bounds[:-1][bounds[:-1] < len(space)]
        begins[firsts] = True
        stops = np.flatnonzero(_IS_STOP[chars[1:]] & _IS_LETTER[chars[:-1]]) + 1
        closed = np.append(space, True)
        closed[firsts] = True
        begins[stops[closed[stops + 1]]] = True
        starts = np.flatnonzero(begins)
        if self.folds:
            raw = pa.py_buffer(_folded(chars, starts))
        ends = pa.py_buffer(np.append(starts, len(space)).astype(np.int32))
        coded = pa.Array.from_buffers(pa.binary(), len(starts), [None, ends, raw]).dictionary_encode()
        distinct = _as_bytes(coded.dictionary)
        if new := [p for p in distinct if p not in self.index]:
            self._add(new)
        at = np.fromiter(map(self.index.__getitem__, distinct), np.int64, len(distinct))
        return at[coded.indices.to_numpy()], np.searchsorted(starts, bounds)

    def _odd(self, texts: pa.Array) -> list[int]:
        return np.flatnonzero(pc.match_substring_regex(texts, _ODD_SPACE).to_numpy(zero_copy_only=False)).tolist()

    def _direct(self, texts: pa.Array, at: list[int]) -> list[np.ndarray]:
        return self._encoded([texts[i].as_py() for i in at])

    def counts(self, texts: pa.Array) -> np.ndarray:
        """How many ids each text has."""
        pieces, begin = self._pieces(texts)
        out = np.diff(np.concatenate([[0], np.cumsum(self.length[pieces])])[begin])
        if odd := self._odd(texts):
            out[odd] = [len(x) for x in self._direct(texts, odd)]
        return out

    def encode(self, texts: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and where each text's begin (and the last ones end); ``end_id`` closes each text."""
        pieces, begin = self._pieces(texts)
        n = self.length[pieces]
        before = np.concatenate([[0], np.cumsum(n)])
        flat = _gathered(self.flat, self.start[pieces], n)
        bounds = before[begin]
        if odd := self._odd(texts):
            parts = [flat[lo:hi] for lo, hi in zip(bounds[:-1], bounds[1:])]
            for i, ids in zip(odd, self._direct(texts, odd)):
                parts[i] = ids
            flat, bounds = np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        if end_id is not None:
            flat = np.insert(flat, bounds[1:], np.uint32(end_id))
            bounds = bounds + np.arange(len(bounds))
        return flat, bounds
