import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tracelake.errors import DataError, LimitError
from tracelake.functions import codec, leb128

VECTORS = [
    ([[0, 1, 2], [3, 4, 5]], "1220000512200035"),
    ([[7]], "8000000007"),
    ([[5, -3, 100000, 7]], "915200000005c4186a384f2ce0"),
    ([[-2147483648, 2147483647, -2147483648, 2147483647, 0]], "90a080000000de80000001"),
    ((np.array([range(11, 17), range(21, 27), range(31, 37), range(41, 47)]) * 256).tolist(), "22a0b00900003221500000 3221f000003222900000".replace(" ", "")),
]


@pytest.mark.parametrize("matrix,encoded", VECTORS)
def test_known_bytes(matrix, encoded):
    x = np.array(matrix, dtype="i4")
    assert codec.encode_matrix(x).hex() == encoded
    assert np.array_equal(codec.decode_matrix(bytes.fromhex(encoded), *x.shape), x)


FORMATS = [(codec.COMPATIBLE, "i4"), (codec.COMPATIBLE, "u4")] + [(codec.EXTENDED, t) for t in ("i1", "i2", "i4", "i8", "u2", "u4", "u8")]


@pytest.mark.parametrize("layout,dtype", FORMATS)
@settings(max_examples=40, deadline=None)
@given(data=st.data())
def test_round_trip(layout, dtype, data):
    info = np.iinfo(dtype)
    sensors, length = data.draw(st.integers(1, 5)), data.draw(st.integers(1, 40))
    edge = st.sampled_from([int(info.min), int(info.max), 0, 1])
    near = st.integers(max(int(info.min), -9), 9)
    value = st.one_of(edge, near, st.integers(int(info.min), int(info.max)))
    x = np.array(data.draw(st.lists(st.lists(value, min_size=length, max_size=length), min_size=sensors, max_size=sensors)), dtype=dtype)
    order = data.draw(st.permutations(range(sensors)))
    raw = codec.encode_matrix(x, layout, order)
    assert np.array_equal(codec.decode_matrix(raw, sensors, length, dtype, layout, order), x)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(-(1 << 31), (1 << 31) - 1), min_size=2, max_size=60), st.sampled_from([codec.COMPATIBLE, codec.EXTENDED]))
def test_best_width_is_the_exhaustive_one(values, layout):
    r = np.array(values, dtype="i4").view("u4")
    got = codec.parameters(r, codec.TIME, layout)
    widths = codec.bit_widths(r)
    nexc = int(widths[1:].max())
    head = layout.header_bits(layout.smallest(nexc, int(widths[0])))
    sizes = []
    for n in range(2, nexc + 1):
        bits = head
        for v, w in zip(codec.signed_view(r)[1:].tolist(), widths[1:].tolist(), strict=True):
            odd = n < nexc and (w > n or (w == n and v == -(1 << (n - 1))))
            bits += n + (nexc if odd else 0)
        sizes.append((bits, n))
    assert (got.bits, got.n) == min(sizes)


@pytest.mark.parametrize("method", [codec.COPY, codec.TIME, codec.TIME2, codec.CHAN])
def test_residuals_invert(method):
    rng = np.random.default_rng(1)
    for dtype in ("u1", "u2", "u4", "u8"):
        x = rng.integers(0, np.iinfo(dtype).max, 50, dtype=dtype, endpoint=True)
        p = rng.integers(0, np.iinfo(dtype).max, 50, dtype=dtype, endpoint=True)
        assert np.array_equal(codec.restored(codec.residuals(x, p, method), p, method), x)


def test_malformed():
    raw = codec.encode_matrix(np.arange(12, dtype="i4").reshape(3, 4))
    with pytest.raises(DataError):
        codec.decode_matrix(raw + b"\0", 3, 4)
    with pytest.raises(DataError):
        codec.decode_matrix(raw[:-4], 3, 4)
    with pytest.raises(DataError):
        codec.decode_matrix(b"\x10\x10\0\0\0", 1, 4)  # n below 2
    with pytest.raises(DataError):
        codec.decode_matrix(raw, 0, 4)
    with pytest.raises(LimitError):
        codec.decode_matrix(raw, 3, 4, order=[0, 0, 1])
    assert codec.encode_matrix(np.zeros((0, 4), "i4")) == b""


def test_fewer_rows_are_decoded():
    x = np.arange(40, dtype="i4").reshape(4, 10) ** 2
    got = codec.decode_matrix(codec.encode_matrix(x), 4, 10, needed=2)
    assert np.array_equal(got[:2], x[:2]) and not got[2:].any()


@pytest.mark.parametrize("value,raw", [(2, "02"), (127, "7f"), (128, "8001"), (129, "8101"), (130, "8201"), (12857, "b964")])
def test_leb128_unsigned(value, raw):
    assert leb128.encode(value, signed=False).hex() == raw
    assert leb128.decode(bytes.fromhex(raw), signed=False) == (value, len(raw) // 2)


@pytest.mark.parametrize("value,raw", [(2, "02"), (-2, "7e"), (127, "ff00"), (-127, "817f"), (128, "8001"), (-128, "807f"), (129, "8101"), (-129, "ff7e")])
def test_leb128_signed(value, raw):
    assert leb128.encode(value).hex() == raw
    assert leb128.decode(bytes.fromhex(raw)) == (value, len(raw) // 2)


@pytest.mark.parametrize("raw", ["", "80", "8080", "80" * 11])
def test_leb128_without_end(raw):
    with pytest.raises(DataError):
        leb128.decode(bytes.fromhex(raw))


@given(st.integers(-(1 << 63), (1 << 63) - 1))
def test_leb128_round_trip(x):
    assert leb128.decode(leb128.encode(x))[0] == x
