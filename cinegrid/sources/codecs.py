"""Small byte helpers for the decode and encode steps: PNM, Farbfeld and PNG. Everything relational happens around them.

A picture is (width, height, channels, bits, samples): samples is an array of shape height x width x channels.
"""

from __future__ import annotations

import re
import struct
import zlib

import numpy as np

PNG_MAGIC = b"\x89PNG\r\n\x1a\n"
PNG_CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
#: An ASCII header may be so long.
HEADER_LIMIT = 1 << 20


class Picture:
    def __init__(self, samples: np.ndarray, bits: int):
        self.samples, self.bits = samples, bits
        self.height, self.width, self.channels = samples.shape


def rescaled(v: np.ndarray, most: int, bits: int) -> np.ndarray:
    """Samples of 0..most as samples of that many bits, rounded half away from zero in single precision."""
    target = (1 << bits) - 1
    if most == target:
        return v
    scaled = np.floor(v.astype(np.float32) * (np.float32(target) / np.float32(most)) + np.float32(0.5))
    return np.minimum(scaled, target).astype(v.dtype)


def pnm_header(data: bytes) -> tuple[str, int, int, int, int, int]:
    """kind, width, height, channels, maxval and where the raster starts."""
    head = data[:HEADER_LIMIT]
    kind = head[:2].decode("latin-1")
    if kind == "P7":
        fields, at = {}, 2
        for m in re.finditer(rb"[ \t\r\n]*(?:#[^\n]*\n|([A-Z]+)[ \t]*([^\n#]*)\n)", head[2:]):
            at = 2 + m.end()
            if m[1] == b"ENDHDR":
                break
            if m[1]:
                fields[m[1].decode()] = m[2].strip().decode("latin-1")
        else:
            raise ValueError("the PAM header does not end")
        return kind, int(fields["WIDTH"]), int(fields["HEIGHT"]), int(fields["DEPTH"]), int(fields["MAXVAL"]), at
    numbers, at = [], 2
    token = re.compile(rb"(?:[ \t\r\n\x0b\x0c]|#[^\n\r]*[\n\r])+([0-9]+)")
    for _ in range(2 if kind in ("P1", "P4") else 3):
        m = token.match(head, at)
        if not m:
            raise ValueError("the PNM header is not complete")
        numbers.append(int(m[1]))
        at = m.end()
    if kind in ("P1", "P4"):
        numbers.append(1)
    if not numbers[0] or not numbers[1] or not 1 <= numbers[2] <= 65535:
        raise ValueError("the PNM header states no picture")
    return kind, numbers[0], numbers[1], 3 if kind in ("P3", "P6") else 1, numbers[2], at + 1


def read_pnm(data: bytes) -> Picture:
    kind, w, h, c, most, at = pnm_header(data)
    bits, n = 16 if most > 255 else 8, w * h * c
    if kind == "P1":
        raster = re.sub(rb"[ \t\r\n\x0b\x0c]", b"", data[at - 1 :])[:n]
        v = np.frombuffer(raster, np.uint8) - 48
        if len(v) < n or (v > 1).any():
            raise ValueError("a PBM raster holds 0 and 1 only")
        return Picture(((1 - v) * 255).astype(np.uint8).reshape(h, w, 1), 8)
    if kind in ("P2", "P3"):
        words = data[at - 1 :].split()[:n]
        if len(words) < n or not all(x.isdigit() for x in words):
            raise ValueError("an ASCII raster holds numbers only")
        v = np.array(words, dtype=np.int64)
    elif kind == "P4":
        rows = np.frombuffer(data, np.uint8, h * (-(-w // 8)), at).reshape(h, -1)
        return Picture(((1 - np.unpackbits(rows, axis=1)[:, :w]) * 255).astype(np.uint8)[:, :, None], 8)
    else:
        v = np.frombuffer(data, ">u2" if most > 255 else np.uint8, n, at).astype(np.int64)
    if (v > most).any():
        raise ValueError("a sample is larger than the stated maximum")
    return Picture(rescaled(v, most, bits).astype(np.uint16 if bits == 16 else np.uint8).reshape(h, w, c), bits)


def read_farbfeld(data: bytes) -> Picture:
    w, h = struct.unpack(">II", data[8:16])
    return Picture(np.frombuffer(data, ">u2", w * h * 4, 16).astype(np.uint16).reshape(h, w, 4), 16)


def png_chunks(data: bytes) -> list[tuple[bytes, bytes]]:
    out, at = [], 8
    while at + 8 <= len(data):
        size, name = struct.unpack(">I4s", data[at : at + 8])
        out.append((name, data[at + 8 : at + 8 + size]))
        at += 12 + size
        if name == b"IEND":
            break
    return out


def unfilter(raw: bytes, h: int, stride: int, step: int) -> np.ndarray:
    """PNG row filters undone: none, sub, up, average, Paeth."""
    rows = np.frombuffer(raw, np.uint8, h * (stride + 1)).reshape(h, stride + 1)
    out = np.zeros((h + 1, stride), np.uint8)
    for y in range(h):
        kind, line, above = rows[y, 0], rows[y, 1:], out[y]
        if kind == 0:
            out[y + 1] = line
        elif kind == 2:
            out[y + 1] = line + above
        elif kind == 1:
            pad = np.zeros(-(-stride // step) * step, np.uint8)
            pad[:stride] = line
            out[y + 1] = np.cumsum(pad.reshape(-1, step), axis=0, dtype=np.uint8).reshape(-1)[:stride]
        else:
            left, up, cur = [0] * step, above.tolist(), []
            corner = [0] * step + up
            full = left + [0] * stride
            for i, v in enumerate(line.tolist()):
                a, b, c = full[i], up[i], corner[i]
                if kind == 3:
                    guess = (a + b) >> 1
                else:
                    p = a + b - c
                    da, db, dc = abs(p - a), abs(p - b), abs(p - c)
                    guess = a if da <= db and da <= dc else b if db <= dc else c
                cur.append((v + guess) & 255)
                full[i + step] = cur[-1]
            out[y + 1] = cur
    return out[1:]


def read_png(data: bytes) -> Picture:
    """A still PNG without interlace; palettes and narrow samples are expanded to 8 bits."""
    chunks = png_chunks(data)
    w, h, depth, kind, _, _, interlace = struct.unpack(">IIBBBBB", chunks[0][1])
    if interlace:
        raise ValueError("interlaced PNG files are not read")
    c = PNG_CHANNELS[kind]
    stride, step = -(-w * c * depth // 8), max(1, c * depth // 8)
    rows = unfilter(zlib.decompress(b"".join(d for n, d in chunks if n == b"IDAT")), h, stride, step)
    if depth == 16:
        return Picture(rows.view(">u2").astype(np.uint16).reshape(h, w, c), 16)
    if depth < 8:
        bits = np.unpackbits(rows, axis=1).reshape(h, -1, depth)
        v = (bits << np.arange(depth - 1, -1, -1, dtype=np.uint8)).sum(2, dtype=np.uint8)[:, : w * c].reshape(h, w, c)
        if kind == 0:
            v = v * np.uint8(255 // ((1 << depth) - 1))
    else:
        v = rows.reshape(h, w, c)
    named = dict(reversed(chunks))
    if kind == 3:
        palette = np.frombuffer(named[b"PLTE"], np.uint8).reshape(-1, 3)
        if b"tRNS" in named:
            alpha = np.full(len(palette), 255, np.uint8)
            stated = np.frombuffer(named[b"tRNS"], np.uint8)
            alpha[: len(stated)] = stated
            palette = np.concatenate([palette, alpha[:, None]], 1)
        v = palette[v[:, :, 0]]
    return Picture(v, 8)


def write_png(samples: np.ndarray, bits: int, level: int = 6, extra: list[tuple[bytes, bytes]] = ()) -> bytes:
    """Bytes of a PNG: samples are height x width x channels, bits is 1, 2, 4, 8 or 16; extra chunks go before the data."""
    h, w, c = samples.shape
    kind = {1: 0, 2: 4, 3: 2, 4: 6}[c]
    if bits == 16:
        rows = samples.astype(">u2").reshape(h, -1).view(np.uint8)
    elif bits == 8:
        rows = samples.astype(np.uint8).reshape(h, -1)
    else:
        wide = ((samples.reshape(h, -1, 1) >> np.arange(bits - 1, -1, -1)) & 1).astype(np.uint8).reshape(h, -1)
        rows = np.packbits(wide, axis=1)
    if level:  # each row as its difference from the one above
        body = np.concatenate([np.full((h, 1), 2, np.uint8), rows - np.concatenate([np.zeros((1, rows.shape[1]), np.uint8), rows[:-1]])], 1)
    else:
        body = np.concatenate([np.zeros((h, 1), np.uint8), rows], 1)

    def chunk(name: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))

    parts = [(b"IHDR", struct.pack(">IIBBBBB", w, h, bits, kind, 0, 0, 0)), *extra, (b"IDAT", zlib.compress(body.tobytes(), level)), (b"IEND", b"")]
    return PNG_MAGIC + b"".join(chunk(n, d) for n, d in parts)


DECODERS = {"pnm": read_pnm, "farbfeld": read_farbfeld, "png": read_png}


def decode(route: str, data: bytes) -> Picture:
    if route not in DECODERS:
        raise ValueError(f"no reader here decodes {route}")
    return DECODERS[route](data)
