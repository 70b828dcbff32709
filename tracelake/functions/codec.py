"""Lossless coding of sample matrices, and its inverse, in numpy.

A matrix has one row a sensor.  A row block is a header (word size, method, widths, first value)
and the residuals of the row.  Methods: 0 the words as they are, 1 differences, 2 differences of
differences, 3 differences against the row before.  Residuals have n bits each; those that need
more, or equal the marker 1 << (n-1), are the marker and then nexc bits.  Arithmetic is modulo
2^width.  The method, n and nexc with the fewest bytes are taken, exactly.

Two header layouts: ``compatible`` (32-bit words, stored in 16 or 32) and ``extended`` (8, 16, 32 or
64 bits).  Rows don't store their length in bytes, so rows of a block are read in order; blocks
(epochs) are independent of each other.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from tracelake.errors import DataError, LimitError

COPY, TIME, TIME2, CHAN = range(4)
_POWERS = np.array([1 << k for k in range(64)], dtype=np.uint64)


@dataclass(frozen=True)
class Layout:
    """Row header fields by word size in bits: the size's code and the width of n and nexc."""

    name: str
    fields: dict[int, tuple[int, int]]

    def header_bits(self, size: int) -> int:
        return 4 + 2 * self.fields[size][1] + size

    def stored_width(self, value: int, size: int) -> int:
        """n or nexc as written: a width that fills its field is 0."""
        return value % (1 << self.fields[size][1])

    def smallest(self, *widths: int) -> int:
        return next(s for s in sorted(self.fields) if s >= max(widths))


COMPATIBLE = Layout("compatible", {16: (0b00, 4), 32: (0b10, 6)})
EXTENDED = Layout("extended", {8: (0, 3), 16: (1, 4), 32: (2, 5), 64: (3, 6)})
LAYOUTS = {x.name: x for x in (COMPATIBLE, EXTENDED)}


def unsigned(width: int) -> np.dtype:
    return np.dtype(f"u{width // 8}")


def signed_view(x: np.ndarray) -> np.ndarray:
    return x.view(f"i{x.dtype.itemsize}")


def bit_widths(x: np.ndarray) -> np.ndarray:
    """Bits of each word as a signed number, 2 at least."""
    s = signed_view(x)
    magnitude = s ^ (s >> (8 * s.dtype.itemsize - 1))
    if s.dtype.itemsize < 8 or int(magnitude.max(initial=0)) < 1 << 53:
        return np.maximum(2, np.frexp(magnitude.astype(np.float64))[1] + 1)  # exact below 2^53
    return np.maximum(2, np.searchsorted(_POWERS, magnitude.astype(np.uint64), side="right") + 1)


def difference(x: np.ndarray) -> np.ndarray:
    out = x.copy()
    out[1:] -= x[:-1]
    return out


def residuals(x: np.ndarray, before: np.ndarray, method: int) -> np.ndarray:
    """Residuals of a row; its first value stays."""
    if method == COPY:
        return x
    if method == CHAN:
        out = difference(x - before)
        out[:1] = x[:1]
        return out
    out = difference(x)
    if method == TIME2:
        out[2:] -= out[1:-1].copy()
    return out


def restored(r: np.ndarray, before: np.ndarray, method: int) -> np.ndarray:
    if method == COPY or not len(r):
        return r
    r = r.copy()
    if method == TIME2:
        r[1:] = np.cumsum(r[1:], dtype=r.dtype)
    if method == CHAN:
        r[:1] -= before[:1]
        return before + np.cumsum(r, dtype=r.dtype)
    return np.cumsum(r, dtype=r.dtype)


@dataclass
class Choice:
    method: int
    size: int
    n: int
    nexc: int
    bits: int
    values: np.ndarray

    @property
    def bytes(self) -> int:
        return -(-self.bits // 8)


def parameters(r: np.ndarray, method: int, layout: Layout, folded: bool = False) -> Choice:
    """Widths with the fewest bits; the smallest n among equals.

    ``folded``: the row's first value was wider than a word.  Differences against the row before
    keep it as it was, so they take a whole word for it, as :mod:`tracelake.operators.cost` counts."""
    word = 8 * r.dtype.itemsize
    if method == COPY:
        return Choice(COPY, word, word, word, 8 + word * len(r), r)
    widths = bit_widths(r)
    if len(r) == 1:
        return Choice(method, word, 2, 2, layout.header_bits(word), r)
    nexc = int(widths[1:].max())
    size = layout.smallest(nexc, word if folded and method == CHAN else int(widths[0]))
    count = np.bincount(widths[1:], minlength=nexc + 1)
    marker = signed_view(r[1:]) == -(np.int64(1) << (widths[1:] - 1).astype(np.int64))
    marked = np.bincount(widths[1:][marker], minlength=nexc + 1)
    n = np.arange(2, nexc + 1)
    wider = len(r) - 1 - np.cumsum(count)[2:]
    cost = layout.header_bits(size) + n * (len(r) - 1) + nexc * (wider + marked[2:]) * (n < nexc)
    best = int(cost.argmin())
    return Choice(method, size, int(n[best]), nexc, int(cost[best]), r)


def choose(x: np.ndarray, before: np.ndarray, layout: Layout, folded: bool = False) -> Choice:
    """The coding of a row with the fewest bytes; the first method among equals."""
    return min((parameters(residuals(x, before, m), m, layout, folded) for m in (COPY, TIME, TIME2, CHAN)), key=lambda c: c.bytes)


def pack_bits(values: np.ndarray, widths: np.ndarray) -> np.ndarray:
    """Bits (0/1) of the low ``widths`` bits of each value, most significant first."""
    if len(widths) and (widths == widths[0]).all():
        left = np.arange(int(widths[0]) - 1, -1, -1, dtype=np.uint64)
        return ((values.astype(np.uint64)[:, None] >> left) & np.uint64(1)).astype(np.uint8).ravel()
    ends = np.cumsum(widths)
    left = np.repeat(ends, widths) - np.arange(int(ends[-1]) if len(ends) else 0) - 1
    return ((np.repeat(values.astype(np.uint64), widths) >> left.astype(np.uint64)) & np.uint64(1)).astype(np.uint8)


def encode_row(x: np.ndarray, before: np.ndarray, layout: Layout, folded: bool = False) -> bytes:
    c = choose(x, before, layout, folded)
    code, field = layout.fields[c.size]
    if c.method == COPY:
        return bytes([(code << 6) | (COPY << 4)]) + x.astype(x.dtype.newbyteorder(">")).tobytes()
    values = [code, c.method, layout.stored_width(c.n, c.size), layout.stored_width(c.nexc, c.size), int(c.values[0])]
    widths = [2, 2, field, field, c.size]
    r = c.values[1:].astype(np.uint64)
    if c.n == c.nexc:
        out, by = r, np.full(len(r), c.n)
    else:
        w = bit_widths(c.values[1:])
        odd = (w > c.n) | ((w == c.n) & (signed_view(c.values[1:]) == -(1 << (c.n - 1))))
        at = np.repeat(np.arange(len(r)), 1 + odd)
        second = np.concatenate(([False], at[1:] == at[:-1]))
        mark = odd[at] & ~second
        out = np.where(mark, _POWERS[c.n - 1], r[at])
        by = np.where(second, c.nexc, c.n)
    first = pack_bits(np.array(values[:4], np.uint64), np.array(widths[:4]))
    master = pack_bits(np.array([values[4]], np.uint64), np.array(widths[4:]))
    return np.packbits(np.concatenate((first, master, pack_bits(out, by)))).tobytes()


class BitReader:
    def __init__(self, data: bytes):
        self.bits, self.at = np.unpackbits(np.frombuffer(data, dtype=np.uint8)), 0

    def take(self, count: int, width: int) -> np.ndarray:
        """``count`` numbers of ``width`` bits."""
        end = self.at + count * width
        if end > len(self.bits):
            raise DataError("block ends early")
        out = self.bits[self.at : end].reshape(count, width).astype(np.uint64) @ _POWERS[:width][::-1]
        self.at = end
        return out

    def one(self, width: int) -> int:
        return int(self.take(1, width)[0])

    def flush(self) -> None:
        self.at = -(-self.at // 8) * 8


def _extend(values: np.ndarray, width: int, dtype: np.dtype) -> np.ndarray:
    """Sign-extend numbers of ``width`` bits to words."""
    if width < 64:
        values = np.where(values >= _POWERS[width - 1], values | ~(_POWERS[width] - np.uint64(1)), values)
    return values.astype(dtype)


def decode_row(bits: BitReader, before: np.ndarray, length: int, layout: Layout, dtype: np.dtype) -> np.ndarray:
    word = 8 * dtype.itemsize
    code, method = bits.one(2), bits.one(2)
    size = next((s for s, (c, _) in layout.fields.items() if c == code or layout == COMPATIBLE and c == code & 0b10), 0)
    if not size or size > word:
        raise DataError(f"word size code {code} in a block of {word}-bit words")
    if method == COPY:
        bits.take(1, 4)
        out = _extend(bits.take(length, size), size, dtype)
        return out
    field = layout.fields[size][1]
    n, nexc = bits.one(field), bits.one(field)
    if layout == EXTENDED or size == 16:
        n, nexc = n or size, nexc or size
    if not 2 <= n <= nexc <= size:
        raise DataError(f"row header: n {n}, nexc {nexc}, {size}-bit words")
    out = np.empty(length, dtype)
    if length:
        out[0] = _extend(bits.take(1, size), size, dtype)[0]
    if n == nexc:
        out[1:] = _extend(bits.take(max(0, length - 1), n), n, dtype)
    else:
        at, step = 1, 64
        mark = _POWERS[n - 1]
        while at < length:
            start = bits.at
            count = min(step, length - at, (len(bits.bits) - start) // n)
            if count <= 0:
                raise DataError("block ends early")
            got = bits.take(count, n)
            odd = np.flatnonzero(got == mark)
            plain = int(odd[0]) if len(odd) else count
            out[at : at + plain] = _extend(got[:plain], n, dtype)
            at += plain
            step = min(4096, 2 * step)
            if len(odd):
                bits.at = start + (plain + 1) * n
                out[at] = _extend(bits.take(1, nexc), nexc, dtype)[0]
                at, step = at + 1, 64
    bits.flush()
    return restored(out, before, method)


def check_order(order: list[int] | np.ndarray | None, sensors: int) -> np.ndarray:
    """Row order: stored row k is client row order[k]; must be a permutation of 0..sensors-1."""
    if order is None:
        return np.arange(sensors)
    order = np.asarray(order)
    if sensors > 1 << 15 or not np.array_equal(np.sort(order), np.arange(sensors)):
        raise LimitError(f"row order is no permutation of 0..{sensors - 1}")
    return order


def encode_matrix(x: np.ndarray, layout: Layout = COMPATIBLE, order=None, folded: np.ndarray | None = None) -> bytes:
    """Bytes of a matrix [sensor, sample] of integers; nothing for an empty one.  ``folded`` marks
    rows whose first value was wider than a word."""
    if layout == COMPATIBLE and x.dtype.itemsize != 4:
        raise LimitError("compatible blocks hold 32-bit words")
    if not x.size:
        return b""
    order = check_order(order, len(x))
    words = np.ascontiguousarray(x).view(unsigned(8 * x.dtype.itemsize))
    before, out = np.zeros(x.shape[1], words.dtype), []
    for k in order:
        out.append(encode_row(words[k], before, layout, folded is not None and bool(folded[k])))
        before = words[k]
    return b"".join(out)


def decode_matrix(data: bytes, sensors: int, length: int, dtype: np.dtype | str = "i4", layout: Layout = COMPATIBLE, order=None, needed: int | None = None) -> np.ndarray:
    """The matrix [sensor, sample] of a block.  Bytes left over are a data error.

    ``needed``: read only that many stored rows (the others stay 0); nothing is checked then
    beyond them.
    """
    dtype = np.dtype(dtype)
    if sensors < 0 or length < 0:
        raise LimitError("negative dimension")
    if not sensors or not length:
        if data:
            raise DataError("bytes without samples")
        return np.zeros((sensors, length), dtype)
    order = check_order(order, sensors)
    bits, word = BitReader(data), unsigned(8 * dtype.itemsize)
    out, before = np.zeros((sensors, length), word), np.zeros(length, word)
    for k in order[: sensors if needed is None else needed]:
        before = out[k] = decode_row(bits, before, length, layout, word)
    if needed is None and bits.at != len(bits.bits):
        raise DataError(f"{(len(bits.bits) - bits.at) // 8} bytes left over")
    return out.view(dtype)


def max_block_bytes(length: int, width: int) -> int:
    """Bytes of a row block at most: the words as they are."""
    return 1 + length * width // 8
