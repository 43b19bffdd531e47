"""Fill-in-the-middle transformation: cuts come from packed boundary bitvectors by rank and select."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_text

#: The control strings of the output (fixed values).
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"

#: 64-bit words of a block of the directory.
BLOCK = 8
#: Bytes of text whose bitvectors are held at once; a longer text is held alone.
_CHUNK = 4_000_000

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[32, *range(9, 14)]] = True
#: Place of the j-th set bit of a byte, by byte and j.
_PLACE = np.array([[([i for i in range(8) if b >> i & 1] + [8] * 8)[j] for j in range(8)] for b in range(256)], np.int64)


class BitVector:
    """Packed bits with a directory of set bits before each block: rank and select on whole arrays of arguments."""

    def __init__(self, bits: np.ndarray) -> None:
        self.size = len(bits)
        blocks = self.size // (64 * BLOCK) + 1  # one word more than the bits fill, so that rank(size) has its word
        packed = np.zeros(blocks * BLOCK * 8, np.uint8)
        ones = np.packbits(bits, bitorder="little")
        packed[: len(ones)] = ones
        self.words = packed.view("<u8")
        inside = np.bitwise_count(self.words).astype(np.int64).reshape(blocks, BLOCK)
        self.inside = np.cumsum(inside, 1) - inside
        self.before = np.concatenate(([0], np.cumsum(inside.sum(1))))

    @property
    def total(self) -> int:
        return int(self.before[-1])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """How many set bits stand before each place, from 0 to size."""
        word = at >> 6
        low = self.words[word] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1))
        return self.before[word // BLOCK] + self.inside[word // BLOCK, word % BLOCK] + np.bitwise_count(low).astype(np.int64)

    def select(self, k: np.ndarray) -> np.ndarray:
        """The place of the k-th set bit, k from 0 to total - 1."""
        block = np.searchsorted(self.before, k, "right") - 1
        left = k - self.before[block]
        word = (self.inside[block] <= left[:, None]).sum(1) - 1
        left = left - self.inside[block, word]
        eight = self.words[block * BLOCK + word].reshape(-1, 1).view(np.uint8)
        upto = np.cumsum(np.bitwise_count(eight), 1, dtype=np.int64)
        byte = (upto <= left[:, None]).sum(1)
        row = np.arange(len(k))
        left = left - np.where(byte > 0, upto[row, byte - 1], 0)
        return (block * BLOCK + word) * 64 + byte * 8 + _PLACE[eight[row, byte], left]


def token_starts(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Marks the first byte of every token of texts that lie one after another; ``starts`` has the first byte of each text that isn't empty.

    A token is white space with the word after it, or the white space at a
    text's end: it starts where a text does, and where white space follows a word.
    """
    space = _IS_SPACE[data]
    bits = np.empty(len(data), bool)
    bits[:1] = True
    np.logical_and(space[1:], ~space[:-1], out=bits[1:])
    bits[starts] = True
    return bits


def _cut(data: np.ndarray, ends: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, ...]:
    """n, first cut, second cut (bytes of all texts), and code points of prefix and middle, by text."""
    begins = np.concatenate(([0], ends[:-1]))
    tokens = BitVector(token_starts(data, begins[ends > begins]))
    points = BitVector((data & 0xC0) != 0x80)
    first = tokens.rank(begins)
    n = tokens.rank(ends) - first
    a, b = h1 % (n + 1), h2 % (n + 1)

    def place(k: np.ndarray) -> np.ndarray:
        out, inner = ends.copy(), np.flatnonzero(k < n)
        out[inner] = tokens.select(first[inner] + k[inner])
        return out

    lo, hi = place(np.minimum(a, b)), place(np.maximum(a, b))
    at_lo, at_hi = points.rank(lo), points.rank(hi)
    return n, lo, hi, at_lo - points.rank(begins), at_hi - at_lo


def _draws(seed: int) -> tuple[Column, Column, Column, Column]:
    """h1 to h4 of a row's id; an id of null counts as no digits."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    return tuple(F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("bigint") for i in range(4))


def _chunks(ends: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of texts of bounded size, one text at least."""
    lo = 0
    while lo < len(ends):
        base = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, base + _CHUNK, "right")))
        yield lo, hi
        lo = hi


def fill_in_middle(docs: DataFrame, seed: int = 42, percent: int = 50, spm_percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, n, form, prefix_chars, middle_chars, output.

    A text is cut at two of its n + 1 token boundaries, drawn by its id.  Form
    is plain for ``percent`` in a hundred left out, for empty texts and for
    texts that hold a control string (which could not be read back); of the
    others ``spm_percent`` in a hundred have the suffix first.

    Texts of a batch lie one after another in one buffer.  One bitvector marks
    the first byte of each token, one the first byte of each code point; both
    are packed with a directory of counts by block.  Rank differences are n
    and the numbers of code points, select on two ranks gives the byte cuts.
    Rows are cut where they are read; nothing is shuffled.  A task holds one
    batch, and bitvectors for 4 MB of it or for one longer text.

    Null text is empty text; a null id draws as an empty one.  White space
    alone is one token.  Rows that repeat have equal results; an empty table
    gives none; other columns are left out.
    """
    h1, h2, h3, h4 = _draws(seed)
    text = F.col("text")
    plain = (text == "") | text.contains(PREFIX) | text.contains(SUFFIX) | text.contains(MIDDLE) | (h3 % 100 >= percent)
    form = F.when(plain, "plain").when(h4 % 100 < spm_percent, "spm").otherwise("psm")
    rows = id_text(docs, id_col, text_col).select("doc_id", "text", form.alias("form"), h1.alias("h1"), h2.alias("h2"))
    marks = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, s, m = marks
        for part in parts:
            texts = part.column(1).cast(pa.large_binary())
            offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
            whole = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
            ends = offsets[1:] - offsets[0]
            draws = [part.column(i).to_numpy() for i in (3, 4)]
            for lo, hi in _chunks(ends):
                at = offsets[lo]
                data = whole[at : offsets[hi]]
                n, one, two, prefix, middle = _cut(data, offsets[lo + 1 : hi + 1] - at, *(d[lo:hi] for d in draws))
                raw, begins = memoryview(data), (offsets[lo:hi] - at).tolist()
                forms = part.column(2).slice(lo, hi - lo)
                out = []
                for a, x, y, b, f in zip(begins, one.tolist(), two.tolist(), (offsets[lo + 1 : hi + 1] - at).tolist(), forms.to_pylist()):
                    if f == "plain":
                        out.append(bytes(raw[a:b]))
                    elif f == "psm":
                        out.append(b"".join((p, raw[a:x], s, raw[y:b], m, raw[x:y])))
                    else:
                        out.append(b"".join((s, raw[y:b], p, raw[a:x], m, raw[x:y])))
                none = np.array([f == "plain" for f in forms.to_pylist()], bool)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).slice(lo, hi - lo), pa.array(n), forms, pa.array(prefix, mask=none), pa.array(middle, mask=none), pa.array(out, pa.binary()).cast(pa.string())],
                    names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
                )

    return rows.mapInArrow(run, "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string")


def restored(form: Column, output: Column) -> Column:
    """The text that an output was made of, from output and form alone."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}")
    psm, spm = F.concat(parts[1], parts[3], parts[2]), F.concat(parts[2], parts[3], parts[1])
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)
