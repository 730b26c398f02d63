"""Blobs of channels and frames: how a plane of residuals, and three of them, are stored.

Defined results: a plane or raster without bytes has no blob (ValueError); an empty blob has no raster (None); damaged blobs, cut short or
changed anywhere, raise ValueError or give another raster of the right length, and what they claim to hold sets no memory aside
beyond twice the plane; frames of any valid dimensions are handled, in memory in proportion to their pixels. Nulls stay with the callers.
"""

from __future__ import annotations

import struct

import numpy as np

from . import coder, codes, rle

# Fixed values of the format: first bytes of frames.
GENERAL, GREY, COLOUR = 4, 5, 6
#: First byte of a channel whose bytes after the first are all zero.
SOLID = 0xFF


def compact(plane: bytes) -> bytes:
    """The smallest of a channel's representations, as the level rule picks them."""
    if not plane:
        raise ValueError("a plane without bytes")
    level = rle.choose_level(np.frombuffer(plane, np.uint8))
    if level == -1:
        return bytes([SOLID, plane[0]])
    body = rle.encode(plane, level) if level else plane
    counts = coder.clamped(np.bincount(np.frombuffer(body, np.uint8), minlength=256))
    coded = codes.encode_counts(counts) + coder.encode(body, counts)
    if not level:
        return b"\0" + coded
    coded = struct.pack("<BI", level, len(body)) + coded
    return coded if len(body) >= len(coded) else bytes([level + 4]) + body


def uncompact(blob: bytes, length: int) -> bytes:
    """The plane of ``length`` bytes; raises ValueError if the blob isn't one's."""
    try:
        return _uncompacted(blob, length)
    except (IndexError, OverflowError, ZeroDivisionError, struct.error) as e:
        raise ValueError("a damaged channel") from e


def _uncompacted(blob: bytes, length: int) -> bytes:
    kind = blob[0]
    if kind == SOLID:
        return bytes([blob[1]]) + bytes(length - 1)
    if kind in (5, 6, 7):
        out = rle.decode(blob[1:], kind - 4)
    else:
        level = kind if kind in (1, 2, 3) else 0
        size, at = (struct.unpack_from("<I", blob, 1)[0], 5) if level else (length, 1)
        if size > 2 * length + 8:  # a run-encoded body is no longer than 4/3 of its plane
            raise ValueError(f"{size} bytes for a channel of {length}")
        counts, used = codes.decode_counts(blob[at:])
        if not counts.any():
            raise ValueError("a channel without frequencies")
        out = coder.decode(blob[at + used :], counts, size)
        out = rle.decode(out, level) if level else out
    if len(out) != length:
        raise ValueError(f"a channel of {len(out)} bytes instead of {length}")
    return out


def predicted(plane: np.ndarray, width: int) -> np.ndarray:
    """Residuals of one plane: each byte less its prediction, modulo 256."""
    v = plane.astype(np.int16)
    guess = np.zeros_like(v)
    guess[1:width] = v[: width - 1][: len(v) - 1]
    if len(v) > width:
        guess[width] = v[0]
        left, up, corner = v[width:-1], v[1 : len(v) - width], v[: len(v) - width - 1]
        guess[width + 1 :] = np.maximum(np.minimum(left, up), np.minimum(np.maximum(left, up), left + up - corner))
    return (v - guess).astype(np.uint8)


def restored(residuals: np.ndarray, width: int) -> np.ndarray:
    """Planes from residuals, one plane a row; place by place, all planes at once."""
    d = np.ascontiguousarray(residuals.T, dtype=np.int16)
    v = np.empty_like(d)
    n = len(d)
    if n:
        v[: min(width, n)] = np.cumsum(d[:width], axis=0, dtype=np.int64) & 255
    for p in range(width, n):
        if p == width:
            v[p] = d[p] + v[0] & 255
            continue
        left, up = v[p - 1], v[p - width]
        v[p] = d[p] + np.maximum(np.minimum(left, up), np.minimum(np.maximum(left, up), left + up - v[p - width - 1])) & 255
    return v.T.astype(np.uint8)


def transcode(raster: bytes, pixels: int, bpp: int) -> bytes:
    """A raster of this many pixels with ``bpp`` bits each: 32 bits add the byte X of 255, 24 bits drop X.

    The raster's own form follows from its length; raises ValueError if it has neither.
    """
    if len(raster) not in (3 * pixels, 4 * pixels) or bpp not in (24, 32):
        raise ValueError(f"{len(raster)} bytes are no raster of {pixels} pixels")
    own = len(raster) // pixels if pixels else bpp // 8
    if 8 * own == bpp:
        return raster
    x = np.frombuffer(raster, np.uint8).reshape(-1, own)
    if bpp == 24:
        return x[:, :3].tobytes()
    return np.column_stack([x, np.full(len(x), 255, np.uint8)]).tobytes()


def compress(raster: bytes, width: int, height: int | None = None) -> bytes:
    """A frame of interleaved B, G, R (with a height also B, G, R, X) bytes as a blob; X is not kept.

    Raises ValueError if the bytes are no raster of these dimensions, or of no pixels.
    """
    if height is not None:
        raster = transcode(raster, width * height, 24)
    if not raster or len(raster) % (3 * width):
        raise ValueError(f"{len(raster)} bytes are no raster {width} pixels wide")
    x = np.frombuffer(raster, np.uint8).reshape(-1, 3)
    if (x == x[0]).all():
        b, g, r = x[0].tolist()
        return bytes([GREY, b]) if b == g == r else bytes([COLOUR, b, g, r])
    planes = (x[:, 0] - x[:, 1], x[:, 1], x[:, 2] - x[:, 1])
    b, g, r = (compact(predicted(v, width).tobytes()) for v in planes)
    return struct.pack("<BII", GENERAL, 9 + len(b), 9 + len(b) + len(g)) + b + g + r


def decompress(blob: bytes, width: int, height: int, bpp: int = 24) -> bytes | None:
    """The raster of a blob; None for an empty one, which leaves a frame as it was."""
    raster = _raster(blob, width, height)
    return raster if raster is None else transcode(raster, width * height, bpp)


def _raster(blob: bytes, width: int, height: int) -> bytes | None:
    n = width * height
    if not blob:
        return None
    if len(blob) < {GREY: 2, COLOUR: 4, GENERAL: 10}.get(blob[0], 0):
        raise ValueError("a frame cut short")
    if blob[0] == GREY:
        return bytes([blob[1]] * 3) * n
    if blob[0] == COLOUR:
        return bytes(blob[1:4]) * n
    if blob[0] != GENERAL:
        raise ValueError(f"a frame of type {blob[0]}")
    if len(blob) == 15:  # an older form of solid frames, of which only the channels' first bytes count
        g = blob[12]
        return bytes([blob[10] + g & 255, g, blob[14] + g & 255]) * n
    at_g, at_r = struct.unpack_from("<II", blob, 1)
    if not 9 < at_g < at_r < len(blob):
        raise ValueError("channels that begin beyond the frame")
    residuals = np.stack([np.frombuffer(uncompact(part, n), np.uint8) for part in (blob[9:at_g], blob[at_g:at_r], blob[at_r:])])
    b, g, r = restored(residuals, width)
    return np.stack([b + g, g, r + g], axis=1).astype(np.uint8).tobytes()


def describe(blob: bytes) -> str:
    """general, grey, colour or empty."""
    return {GREY: "grey", COLOUR: "colour", GENERAL: "general"}[blob[0]] if blob else "empty"
