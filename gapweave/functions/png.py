"""PNG images of 8 bits a sample, grey to RGBA, as numpy arrays; no interlacing, no palette."""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC = b"\x89PNG\r\n\x1a\n"
CHANNELS = {0: 1, 2: 3, 4: 2, 6: 4}  # fixed values: samples of a pixel by colour type


def encode(a: np.ndarray) -> bytes:
    """An image of (height, width) or (height, width, channels) bytes."""
    a = np.ascontiguousarray(a, np.uint8)
    a = a[..., None] if a.ndim == 2 else a
    h, w, c = a.shape
    kind = next(k for k, n in CHANNELS.items() if n == c)
    chunk = lambda name, data: struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))
    lines = np.concatenate([np.zeros((h, 1), np.uint8), a.reshape(h, w * c)], 1)
    return MAGIC + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, kind, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines.tobytes())) + chunk(b"IEND", b"")


def decode(raw: bytes) -> np.ndarray:
    """(height, width, channels) bytes; other kinds of PNG and damaged files are errors."""
    if raw[:8] != MAGIC:
        raise ValueError("no PNG file")
    at, body, head = 8, b"", None
    while at + 12 <= len(raw):
        size, name = struct.unpack(">I4s", raw[at : at + 8])
        data = raw[at + 8 : at + 8 + size]
        if zlib.crc32(name + data) != struct.unpack(">I", raw[at + 8 + size : at + 12 + size])[0]:
            raise ValueError("a chunk is damaged")
        head = struct.unpack(">IIBBBBB", data) if name == b"IHDR" else head
        body += data if name == b"IDAT" else b""
        at += 12 + size
    if head is None or head[2] != 8 or head[3] not in CHANNELS or head[6]:
        raise ValueError("not a plain image of 8 bits a sample")
    w, h, c = head[0], head[1], CHANNELS[head[3]]
    lines = np.frombuffer(zlib.decompress(body), np.uint8).reshape(h, 1 + w * c)
    out = np.zeros((h + 1, w + 1, c), np.uint8)  # a border of zeros stands for what lies outside
    for y in range(h):
        line, up = lines[y, 1:].reshape(w, c), out[y, 1:]
        kind = lines[y, 0]
        if kind == 0:
            out[y + 1, 1:] = line
        elif kind == 1:
            out[y + 1, 1:] = np.cumsum(line, 0, dtype=np.uint8)
        elif kind == 2:
            out[y + 1, 1:] = line + up
        else:
            for x in range(w):
                left, above, corner = (v.astype(int) for v in (out[y + 1, x], out[y, x + 1], out[y, x]))
                if kind == 3:
                    guess = (left + above) // 2
                else:
                    d = [np.abs(above - corner), np.abs(left - corner), np.abs(left + above - 2 * corner)]
                    guess = np.where((d[0] <= d[1]) & (d[0] <= d[2]), left, np.where(d[1] <= d[2], above, corner))
                out[y + 1, x + 1] = (line[x] + guess) % 256
    return out[1:, 1:]
