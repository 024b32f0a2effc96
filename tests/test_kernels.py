import binascii

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quartzite.functions import codecs as X
from quartzite.functions import kernels as K
from quartzite.operators import context, text

EDGES = [b"", b"B", b"\xde\xad", b"\0" * 3000, b"\xff" * 1000, b"\xaa\x55" * 500, bytes(range(256)) * 3, np.random.default_rng(42).integers(0, 256, 5000, dtype=np.uint8).tobytes(), "中文😀é".encode() * 50, b"XYZ!" * 300, b"abc" * 21 + b"\0\0\0\0x\0"]
data = st.binary(max_size=600) | st.lists(st.sampled_from([0, 0, 0, 1, 255]), max_size=700).map(bytes)


@settings(max_examples=150, deadline=None)
@given(data)
def test_every_transform_has_an_inverse(x):
    a = K.as_bytes(x)
    assert K.undelta(K.delta(a)).tobytes() == x
    assert K.unxor_blocks(K.xor_blocks(a)).tobytes() == x
    assert K.unrle_zero(K.rle_zero(a)).tobytes() == x
    assert K.unrle(K.rle(a)).tobytes() == x
    assert K.unbit_planes(K.bit_planes(a)).tobytes() == x
    assert K.unmtf(K.mtf(a)).tobytes() == x
    assert K.unbwt(*K.bwt(a)).tobytes() == x
    for elem in (1, 2, 3, 4):
        assert K.from_planes(K.to_planes(a, elem)[0], elem, K.to_planes(a, elem)[1]).tobytes() == x
        for d in (False, True):
            y, pad = K.shuffle(a, elem, d)
            assert K.unshuffle(y, elem, pad, d).tobytes() == x


@pytest.mark.parametrize("x", EDGES, ids=lambda x: str(len(x)))
def test_edges_and_codecs(x):
    a = K.as_bytes(x)
    assert K.unbwt(*K.bwt(a)).tobytes() == x and K.unrle(K.rle(a)).tobytes() == x and K.unrle_zero(K.rle_zero(a)).tobytes() == x
    for name, (pack, unpack) in X.CODECS.items():
        y = x if name in X.LIBRARY or name in ("block", "sorted") else x[:400]
        assert unpack(pack(y)) == y, name


def test_bwt_of_a_known_text():
    last, primary = K.bwt(K.as_bytes(b"banana"))
    assert (last.tobytes(), primary) == (b"nnbaaa", 3)


@settings(max_examples=80, deadline=None)
@given(st.binary(max_size=2000))
def test_crc32c(x):
    c = 0xFFFFFFFF
    for b in x:
        c ^= b
        for _ in range(8):
            c = c >> 1 ^ (0x82F63B78 if c & 1 else 0)
    assert K.crc32c(K.as_bytes(x)) == c ^ 0xFFFFFFFF
    assert K.crc32c(K.as_bytes(b"123456789")) == 0xE3069283 != binascii.crc32(b"123456789")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=700), max_size=12))
def test_crc32c_of_rows_equals_each(rows):
    offs = np.append(0, np.cumsum([len(r) for r in rows])).astype(np.int64)
    assert K.crc32c_rows(K.as_bytes(b"".join(rows)), offs).tolist() == [K.crc32c(K.as_bytes(r)) for r in rows]


@given(st.integers(0, 2**63))
def test_varint(n):
    assert K.read_varint(b"x" + K.varint(n) + b"y", 1) == (n, 1 + len(K.varint(n)))


def test_masks():
    x = np.array([1.5, -3.1415927, 1e-20, 0.0, 65504.0], "<f4")
    raw = K.as_bytes(x.tobytes() + b"abc")
    for level, bits in ((1, 8), (2, 16), (3, 23), (4, 24), (7, 7)):
        y = K.mask_floats(raw, level)
        assert y.tobytes()[-3:] == b"abc"
        assert (y[:20].view("<u4") == x.view("<u4") & np.uint32(0xFFFFFFFF << bits & 0xFFFFFFFF)).all()
    assert K.mask_pcm(K.as_bytes(b"\x1f" * 50), 1).tobytes() == b"\x1f" * 44 + b"\x10\x1f" * 3
    assert K.mask_pixels(K.as_bytes(b"\xff" * 60), 2).tobytes() == b"\xff" * 54 + b"\xf0" * 6


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=120) | st.lists(st.sampled_from(b"ab"), max_size=120).map(bytes))
def test_context_counts_equal_a_loop(x):
    a = K.as_bytes(x)
    for order in (1, 2, 3):
        n, hit = context.context_counts(a, order)
        for i in range(order, len(x)):
            c = x[i - order : i]
            before = [j for j in range(order, i) if x[j - order : j] == c]
            assert n[i - order] == len(before) and hit[i - order] == sum(x[j] == x[i] for j in before)
    longest = context.matched_order(a, 4)
    for i in range(len(x)):
        want = 0
        for order in range(1, 5):
            if i < order or not any(x[j - order : j] == x[i - order : i] for j in range(order, i)):
                break
            want = order
        assert longest[i] == want


def test_adaptive_models_halve():
    assert context.adaptive_frequency(K.as_bytes(b"a" * 3000))[0] <= 32_016
    assert sum(context.binary_counts(K.as_bytes(b"\1" * 3000))) <= 4004


@pytest.mark.parametrize("code", [b"", b"def f():\n    return total\n    total = total + 1\n        yield total\n", "é = 1".encode(), b"    \n  x\n\treturn return_ return\n" * 9])
def test_code_tokens_come_back(code):
    packed, own = text.code_tokens(code)
    assert text.code_text(packed, own, code.isascii()) == code
    assert len(packed) <= len(code)


def test_a_changed_payload_is_noticed():
    y = X.pack_block(b"hello world" * 100)
    with pytest.raises(ValueError):
        X.unpack_block(2, y[1])


@given(st.lists(st.floats(width=32), max_size=30))
def test_ordinals_keep_the_order_and_come_back(values):
    x = np.array(values, "<f4")
    raw = x.view(np.uint8)
    n = K.ordinal(raw).view("<i4")
    real = ~np.isnan(x)
    a, b = x[real], n[real]
    assert ((a[1:] > a[:-1]) == (b[1:] > b[:-1])).all() and ((a[1:] < a[:-1]) == (b[1:] < b[:-1])).all()
    back = K.unordinal(n.view(np.uint8)).view("<u4")
    assert (back == np.where(x.view("<u4") == 0x80000000, 0, x.view("<u4"))).all()
    assert K.byte_swap(K.byte_swap(raw)).tobytes() == raw.tobytes() and K.byte_swap(raw).tobytes() == x.astype(">f4").tobytes()
