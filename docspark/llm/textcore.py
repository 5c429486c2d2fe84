"""Vectorised text kernels over Arrow string columns.

Every kernel works on the UTF-8 bytes of a slice of whole documents at once.  A slice holds at most
``SLICE_BYTES`` of text unless one document alone is longer, so memory follows the longest document
and not the batch.  Null texts count as empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 18
U = np.uint64

_rng = np.random.default_rng(20240501)
#: A random value for each byte: the alphabet of the polynomial hash.
BYTE_CODE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
BASE = U(0x9E3779B97F4A7C15)
INVERSE = U(pow(0x9E3779B97F4A7C15, -1, 2**64))

#: ASCII lower-casing of A-Z only.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes that separate words: blank and \x09-\x0D.
BLANK = np.zeros(256, dtype=bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True


def mask_of(characters: str) -> np.ndarray:
    """Look-up table that is true for the given ASCII characters."""
    out = np.zeros(256, dtype=bool)
    out[[ord(c) for c in characters]] = True
    return out


class _Powers:
    """Powers of the hash base and of its inverse, extended on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            m = max(n, SLICE_BYTES + 1)
            for name, x in (("up", BASE), ("down", INVERSE)):
                a = np.full(m, x, dtype=np.uint64)
                a[0] = 1
                setattr(self, name, np.cumprod(a))
        return self.up[:n], self.down[:n]


_powers = _Powers()


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of 64-bit values (splitmix64); bijective."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


@dataclass
class Slice:
    """Documents ``first .. first + n`` of a batch: their bytes, and n + 1 offsets into them."""

    first: int
    n: int
    data: np.ndarray
    offsets: np.ndarray

    def per_doc(self, flags: np.ndarray) -> np.ndarray:
        """Sum of a value per byte over each document."""
        total = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
        return total[self.offsets[1:]] - total[self.offsets[:-1]]


def slices(texts: pa.Array | pa.ChunkedArray, most: int | None = None) -> Iterator[Slice]:
    """Whole documents in order, about ``most`` bytes at a time (``SLICE_BYTES`` if not given)."""
    most = SLICE_BYTES if most is None else most
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if len(texts) == 0:
        return
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    _, off, values = texts.buffers()
    offsets = np.frombuffer(off, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(values, dtype=np.uint8) if values is not None else np.zeros(0, np.uint8)
    i, n = 0, len(texts)
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1)
        yield Slice(i, j - i, data[offsets[i] : offsets[j]], (offsets[i : j + 1] - offsets[i]).astype(np.int64))
        i = j


@dataclass
class Words:
    """Words of a slice: byte bounds, 64-bit hash, and for each document where its words begin."""

    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray  # n + 1 offsets into the words

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def runs(inside: np.ndarray, offsets: np.ndarray, cuts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of true bytes that stay within one document and cross no cut: starts, ends, first run of each document."""
    n = len(inside)
    if n == 0:
        e = np.zeros(0, np.int64)
        return e, e, np.zeros(len(offsets), np.int64)
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    if cuts is not None:
        edge[cuts] = True
    before = np.concatenate(([False], inside[:-1]))
    after = np.concatenate((inside[1:], [False]))
    start = np.flatnonzero(inside & (~before | edge[:-1]))
    end = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return start, end, np.searchsorted(start, offsets)


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hash of each byte span, independent of where it stands."""
    if len(start) == 0:
        return np.zeros(0, np.uint64)
    up, down = _powers.get(len(data) + 1)
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(BYTE_CODE[data] * up[: len(data)], out=total[1:])
    h = (total[end] - total[start]) * down[start]
    return mix(h + U(seed) + (end - start).astype(np.uint64) * U(0xD6E8FEB86659FD93))


#: First bytes of the three-byte characters from U+3000 on: most scripts that are written without blanks.
UNSPACED = np.zeros(256, bool)
UNSPACED[0xE3:0xEE] = True


def words(s: Slice, lower: bool = True, separators: np.ndarray = BLANK, alone: bool = False) -> Words:
    """Runs of bytes other than separators; ``alone``: characters of unspaced scripts are a word each."""
    data = LOWER[s.data] if lower else s.data
    at = np.flatnonzero(UNSPACED[data]) if alone else None
    start, end, first = runs(~separators[data], s.offsets, np.concatenate((at, at + 3)) if alone else None)
    return Words(start, end, span_hashes(data, start, end), first)


def windows(w: Words, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of every run of ``k`` words within a document: index of its first word, document, hash."""
    n = len(w.hash)
    if n < k:
        e = np.zeros(0, np.int64)
        return e, e, np.zeros(0, np.uint64)
    h = np.zeros(n - k + 1, dtype=np.uint64)
    for j in range(k):
        h = h * BASE + w.hash[j : n - k + 1 + j]
    doc = w.doc()
    whole = doc[: n - k + 1] == doc[k - 1 :]
    at = np.flatnonzero(whole)
    return at, doc[at], mix(h[at])


def repeated(doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per item: whether its (document, hash) occurs more than once, and whether it occurred before."""
    n = len(h)
    more, later = np.zeros(n, bool), np.zeros(n, bool)
    if n < 2:
        return more, later
    order = np.lexsort((h, doc))
    same = (doc[order[1:]] == doc[order[:-1]]) & (h[order[1:]] == h[order[:-1]])
    later[order[1:]] = same  # lexsort is stable: the first of equals stays the earliest
    more[order[1:]] |= same
    more[order[:-1]] |= same
    return more, later


SYMBOLS = mask_of("#*$%&|<>")
UPPER = np.zeros(256, bool)
UPPER[65:91] = True
LETTER = UPPER.copy()
LETTER[97:123] = True
LETTER[128:] = True
DIGIT = np.zeros(256, bool)
DIGIT[48:58] = True
PUNCTUATION = ~(LETTER | DIGIT | BLANK)
CONTINUATION = np.zeros(256, bool)
CONTINUATION[128:192] = True

#: Columns made by ``statistics``; all whole numbers.
STATISTICS = (
    "n_chars", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_distinct_words",
    "n_same_words", "n_upper", "n_letters", "n_digits", "n_punctuation", "n_marked_words", "n_upper_words",
)


def statistics(texts: pa.Array) -> dict[str, np.ndarray]:
    """Counts over whole texts, as int64 arrays.

    Words are runs of bytes other than blanks; lines are split at \\n.  ``n_dup_lines``: lines with a word that
    equal an earlier line; ``n_repeat_words``: words in windows of eight that occur twice or more in the text;
    ``n_same_words``: words equal to the word before; ``n_marked_words``: words that end in a mark other than
    a full stop or comma; ``n_upper_words``: words with capitals and no ASCII small letters.
    """
    out = {k: [] for k in STATISTICS}
    for s in slices(texts):
        d = s.data
        w = words(s, lower=False)
        doc = w.doc()
        inside = ~BLANK[d]
        point = ~CONTINUATION[d]
        count = lambda flags, doc=doc, n=s.n: np.bincount(doc[flags], minlength=n)
        out["n_chars"].append(s.per_doc(point))
        out["n_words"].append(w.counts)
        out["word_chars"].append(s.per_doc(point & inside))
        out["n_symbols"].append(s.per_doc(SYMBOLS[d]))
        out["n_upper"].append(s.per_doc(UPPER[d]))
        out["n_letters"].append(s.per_doc(LETTER[d] & point))
        out["n_digits"].append(s.per_doc(DIGIT[d]))
        out["n_punctuation"].append(s.per_doc(PUNCTUATION[d]))
        start, end, first = runs(d != 10, s.offsets)
        line_doc = np.repeat(np.arange(s.n), np.diff(first))
        has_word = np.searchsorted(w.start, end) > np.searchsorted(w.start, start)
        _, again = repeated(line_doc, span_hashes(d, start, end))
        out["n_lines"].append(np.bincount(line_doc[has_word], minlength=s.n))
        out["n_dup_lines"].append(np.bincount(line_doc[has_word & again], minlength=s.n))
        at, at_doc, h = windows(w, 8)
        more, _ = repeated(at_doc, h)
        cover = np.zeros(len(w.hash) + 1, np.int64)
        np.add.at(cover, at[more], 1)
        np.add.at(cover, at[more] + 8, -1)
        out["n_repeat_words"].append(count(np.cumsum(cover)[:-1] > 0))
        _, seen = repeated(doc, w.hash)
        out["n_distinct_words"].append(count(~seen))
        same = np.zeros(len(w.hash), bool)
        same[1:] = (w.hash[1:] == w.hash[:-1]) & (doc[1:] == doc[:-1])
        out["n_same_words"].append(count(same))
        last = d[w.end - 1] if len(w.end) else np.zeros(0, np.uint8)
        out["n_marked_words"].append(count(PUNCTUATION[last] & (last != 46) & (last != 44)))
        total = lambda flags, w=w: (lambda c: c[w.end] - c[w.start])(np.concatenate(([0], np.cumsum(flags, dtype=np.int64))))
        out["n_upper_words"].append(count((total(UPPER[d]) > 0) & (total((d >= 97) & (d <= 122)) == 0)))
    return {k: (np.concatenate(v).astype(np.int64) if v else np.zeros(0, np.int64)) for k, v in out.items()}
