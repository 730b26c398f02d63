"""Codes and blobs: fixed vectors, and round trips of random data."""

from __future__ import annotations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from framelake.functions import blobs, coder, codes, rle

PLANE = np.array([10, 12, 11, 13, 15, 14, 10, 10, 200], np.uint8)
RESIDUAL = bytes([10, 2, 255, 3, 2, 0, 252, 254, 190])


def test_run_bytes():
    assert [codes.run_byte(k) for k in range(6)] == [0, 255, 1, 254, 2, 253]
    assert all(codes.run_extra(codes.run_byte(k)) == k for k in range(256))


@pytest.mark.parametrize("data, level, expected", [
    ([7, 0, 0, 0, 0, 5, 0, 0, 9], 1, [7, 0, 254, 5, 0, 255, 9]),
    ([7, 0, 0, 0, 0, 5, 0, 0, 9], 3, [7, 0, 0, 0, 255, 5, 0, 0, 9]),
    ([1] + [0] * 300, 1, [1, 0, 128, 0, 234]),
    ([1] + [0] * 300, 3, [1, 0, 0, 0, 128, 0, 0, 0, 236]),
])
def test_rle_vectors(data, level, expected):
    assert list(rle.encode(bytes(data), level)) == expected


def test_header_vectors():
    counts = np.zeros(256, np.int64)
    counts[0], counts[3] = 5, 1
    assert codes.encode_counts(counts) == bytes.fromhex("3b66c3f8")
    freq, scale = coder.rescaled(counts)
    assert scale == 3 and list(np.cumsum(freq)[:5]) == [7, 7, 7, 8, 8]


def test_prediction_and_channel_vectors():
    assert blobs.predicted(PLANE, 3).tobytes() == RESIDUAL
    assert blobs.restored(np.frombuffer(RESIDUAL, np.uint8)[None], 3).tobytes() == PLANE.tobytes()
    counts = np.bincount(np.frombuffer(RESIDUAL, np.uint8), minlength=256)
    assert codes.encode_counts(counts).hex() == "6f76ce6c366dcfadecc0"
    assert coder.encode(RESIDUAL, counts).hex() == "afb4c509000000"


def test_solid_blobs():
    assert blobs.compress(bytes([7, 7, 7] * 6), 3) == bytes([5, 7])
    assert blobs.compress(bytes([1, 2, 3] * 6), 3) == bytes([6, 1, 2, 3])
    assert blobs.decompress(bytes([6, 1, 2, 3]), 3, 2) == bytes([1, 2, 3] * 6)
    assert blobs.decompress(b"", 3, 2) is None
    old = bytearray(15)
    old[0], old[10], old[12], old[14] = 4, 250, 9, 3
    assert blobs.decompress(bytes(old), 2, 1) == bytes([3, 9, 12] * 2)


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 9), st.integers(1, 9), st.sampled_from([0.0, 0.2, 0.9, 0.99, 1.0]), st.sampled_from([2, 5, 256]), st.integers(0, 2**32 - 1))
def test_frames_round_trip(width, height, zeros, values, seed):
    rng = np.random.default_rng(seed)
    x = rng.integers(0, values, (width * height, 3)).astype(np.uint8)
    x[rng.random(len(x)) < zeros] = 0
    blob = blobs.compress(x.tobytes(), width)
    assert blobs.decompress(blob, width, height) == x.tobytes()
    assert len(blob) <= 3 * width * height + (3 * width * height >> 16) + 256


@pytest.mark.parametrize("level", [1, 3])
@pytest.mark.parametrize("n", [*range(253, 261), *range(508, 520)])
def test_long_runs(level, n):
    data = b"\1" + bytes(n) + b"\2" + bytes(n)
    coded = rle.encode(data, level)
    assert rle.decode(coded, level) == data
    assert len(coded) == rle.encoded_length(np.frombuffer(data, np.uint8), level)


@pytest.mark.parametrize("values", [[200] * 9, [255] * 50 + [254], [0] * 10, [255, 0] * 100, list(range(256))])
def test_channels_round_trip(values):
    data = bytes(values)
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    assert coder.decode(coder.encode(data, counts), counts, len(data)) == data
    assert blobs.uncompact(blobs.compact(data), len(data)) == data


def test_large_channel_is_clamped():
    x = np.random.default_rng(1).integers(0, 40, 600_000).astype(np.uint8)
    counts = coder.clamped(np.bincount(x, minlength=256))
    assert counts.sum() == coder.MOST and (counts[:40] > 0).all()
    assert coder.decode(coder.encode(x.tobytes(), counts), counts, len(x)) == x.tobytes()


def test_nothing_at_all():
    none = np.zeros(256, np.int64)
    assert rle.encode(b"", 3) == rle.decode(b"", 3) == b"" and rle.choose_level(np.zeros(0, np.uint8)) == -1
    assert coder.decode(coder.encode(b"", none), none, 0) == b"" and len(coder.encode(b"", none)) == 4
    assert not codes.decode_counts(codes.encode_counts(none))[0].any() and not coder.clamped(none).any()
    assert blobs.decompress(b"", 2, 2) is None and rle.decode(b"a\0\0", 3) == b"a\0\0"
    for f in (lambda: blobs.compact(b""), lambda: blobs.compress(b"", 1), lambda: codes.decode_counts(b""), lambda: blobs.uncompact(b"", 4)):
        with pytest.raises(ValueError):
            f()


@pytest.mark.parametrize("zeros", [0, 60, 95])
def test_blobs_damaged_anywhere_raise_one_error_or_give_a_raster(zeros):
    rng = np.random.default_rng(zeros)
    raster = (rng.integers(0, 256, 12 * 9 * 3) * (rng.integers(0, 100, 12 * 9 * 3) >= zeros)).astype(np.uint8).tobytes()
    blob = blobs.compress(raster, 12)
    damaged = [blob[:n] for n in range(1, len(blob), 3)] + [bytes([k]) for k in range(8)]
    for at in range(0, len(blob), 2):
        damaged += [blob[:at] + bytes([blob[at] ^ x]) + blob[at + 1 :] for x in (1, 128, 255)]
    for b in damaged:
        try:
            assert len(blobs.decompress(b, 12, 9)) == len(raster)
        except ValueError:
            pass


def test_a_channel_that_claims_four_gigabytes():
    with pytest.raises(ValueError):
        coder.decode(bytes(9), np.full(256, 1 << 62), 5)  # a total that does not fit in 64 bits
    with pytest.raises(ValueError):
        blobs.uncompact(b"\1" + b"\xff" * 4 + codes.encode_counts(np.ones(256, np.int64)) + bytes(8), 100)


def test_damaged_blobs():
    with pytest.raises(ValueError):
        blobs.decompress(bytes([9, 1]), 2, 2)
    with pytest.raises(ValueError):
        blobs.uncompact(bytes([5, 1, 2]), 9)


def test_headers_look_at_occurring_symbols_alone():
    """A header of few symbols is that of the plain walk over all 256, without reading the others one by one."""

    class Counts(np.ndarray):
        reads = 0

        def __getitem__(self, at):
            Counts.reads += 1
            return super().__getitem__(at)

    from framelake.functions import codes

    for some in ([0], [255], [3, 4, 200], [], range(256)):
        plain = np.zeros(256, np.int64)
        plain[list(some)] = 5
        Counts.reads = 0
        header = codes.encode_counts(plain.view(Counts))
        assert Counts.reads < 10 and codes.decode_counts(header)[0].tolist() == plain.tolist()
