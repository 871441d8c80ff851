"""Image bytes to RGB pixels: JPEG, TIFF and BMP beside PNG; what the inputs of scanners hold.

Entropy-coded data is read symbol by symbol in Python, all else is arithmetic on whole images; an image is decoded by one
task. JPEG: sequential and progressive Huffman coding, 8 bits, restarts, any sampling, grey, YCbCr, RGB and CMYK. TIFF: strips
and tiles, 1 to 16 bits, grey, palette and RGB, plain, PackBits, LZW, deflated, or JPEG. BMP: 1 to 32 bits, plain or RLE.
WEBP is not decoded: its bitstream needs a library.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

from foliospark.errors import FolioError
from foliospark.operators.raster import decode_png


def _broken(what: str) -> FolioError:
    return FolioError("IMAGE_DECODE_FAILED", what)


def decode_image(data: bytes) -> np.ndarray:
    """Pixels of an image of any supported kind, which its first bytes tell; transparency is dropped."""
    kinds = {b"\x89PNG": decode_png, b"\xff\xd8": decode_jpeg, b"II*\0": decode_tiff, b"MM\0*": decode_tiff, b"BM": decode_bmp}
    for head, decode in kinds.items():
        if data.startswith(head):
            try:
                return decode(data)
            except (struct.error, zlib.error, IndexError, KeyError, ValueError, TypeError, OverflowError) as error:
                raise _broken(f"broken image: {error}") from error
    raise _broken("WEBP is not supported" if data[8:12] == b"WEBP" else "not an image of a supported kind")


# --- JPEG

#: The order in which a block's coefficients are coded.
ZIGZAG = np.array([y * 8 + x for _, _, y, x in sorted((y + x, y if (y + x) % 2 else x, y, x) for y in range(8) for x in range(8))])
_COS = np.array([[np.cos((2 * x + 1) * u * np.pi / 16) * (np.sqrt(0.125) if u == 0 else 0.5) for u in range(8)] for x in range(8)])


class _Table:
    """A Huffman table by the next 16 bits: length of the code and its symbol."""

    def __init__(self, counts: bytes, symbols: bytes) -> None:
        self.by = [0] * 65536
        code = at = 0
        for length in range(1, 17):
            for _ in range(counts[length - 1]):
                span = 1 << (16 - length)
                start = code << (16 - length)
                self.by[start : start + span] = [length << 8 | symbols[at]] * span
                code, at = code + 1, at + 1
            code <<= 1


class _Bits:
    """Bits of entropy-coded data between two markers; ones after its end."""

    def __init__(self, data: bytes) -> None:
        self.data, self.at, self.held, self.n = data.replace(b"\xff\0", b"\xff") + b"\xff" * 64, 0, 0, 0

    def peek(self) -> int:
        if self.n < 16:
            if self.at + 6 > len(self.data):
                raise _broken("the image breaks off")
            self.held = (self.held & ((1 << self.n) - 1)) << 48 | int.from_bytes(self.data[self.at : self.at + 6])
            self.at, self.n = self.at + 6, self.n + 48
        return self.held >> (self.n - 16) & 0xFFFF

    def symbol(self, table: _Table) -> int:
        found = table.by[self.peek()]
        if not found:
            raise _broken("no such code")
        self.n -= found >> 8
        return found & 255

    def take(self, k: int) -> int:
        if not k:
            return 0
        value = self.peek() >> (16 - k)
        self.n -= k
        return value

    def signed(self, k: int) -> int:
        value = self.take(k)
        return value if not k or value >> (k - 1) else value - (1 << k) + 1


class _Part:
    """A component: its sampling, and its coefficients, block by block in rows padded to whole units."""

    def __init__(self, ident: int, h: int, v: int, table: int) -> None:
        self.ident, self.h, self.v, self.quant = ident, h, v, table
        self.rows = self.cols = self.own_rows = self.own_cols = 0
        self.coded: list[list[int]] = []


class _Scan:
    """One scan of a JPEG: which coefficients of which components it codes, and with what tables."""

    def __init__(self, parts: list[_Part], dc: list[_Table | None], ac: list[_Table | None], first: int, last: int, high: int, low: int, progressive: bool) -> None:
        self.parts, self.dc, self.ac, self.first, self.last, self.high, self.low, self.progressive = parts, dc, ac, first, last, high, low, progressive
        self.run = 0  # blocks that end at once
        self.before = [0] * len(parts)

    def reset(self) -> None:
        self.run, self.before = 0, [0] * len(self.parts)

    def block(self, bits: _Bits, k: int, out: list[int]) -> None:
        if not self.progressive:
            self._dc(bits, k, out)
            self._sequential(bits, self.ac[k], out)
        elif self.first == 0:
            if self.high:
                out[0] |= bits.take(1) << self.low
            else:
                self._dc(bits, k, out)
        elif self.high:
            self._refine(bits, self.ac[k], out)
        else:
            self._begin(bits, self.ac[k], out)

    def _dc(self, bits: _Bits, k: int, out: list[int]) -> None:
        self.before[k] += bits.signed(bits.symbol(self.dc[k]))
        out[0] = self.before[k] << self.low

    @staticmethod
    def _sequential(bits: _Bits, table: _Table, out: list[int]) -> None:
        at = 1
        while at < 64:
            s = bits.symbol(table)
            if s == 0:
                return
            at += s >> 4
            if s & 15:
                out[at] = bits.signed(s & 15)
            at += 1

    def _begin(self, bits: _Bits, table: _Table, out: list[int]) -> None:
        if self.run:
            self.run -= 1
            return
        at = self.first
        while at <= self.last:
            s = bits.symbol(table)
            zeros, size = s >> 4, s & 15
            if size:
                at += zeros
                out[at] = bits.signed(size) << self.low
            elif zeros < 15:
                self.run = (1 << zeros) + bits.take(zeros) - 1
                return
            else:
                at += 15
            at += 1

    def _refine(self, bits: _Bits, table: _Table, out: list[int]) -> None:
        one, at = 1 << self.low, self.first

        def better(i: int) -> None:
            if bits.take(1) and not abs(out[i]) & one:
                out[i] += one if out[i] > 0 else -one

        if not self.run:
            while at <= self.last:
                s = bits.symbol(table)
                zeros, new = s >> 4, 0
                if s & 15:
                    new = one if bits.take(1) else -one
                elif zeros < 15:
                    self.run = (1 << zeros) + bits.take(zeros)
                    break
                while at <= self.last:
                    if out[at]:
                        better(at)
                    elif zeros:
                        zeros -= 1
                    else:
                        if new:
                            out[at] = new
                        at += 1
                        break
                    at += 1
        if self.run:
            for i in range(at, self.last + 1):
                if out[i]:
                    better(i)
            self.run -= 1


def decode_jpeg(data: bytes, tables: bytes = b"") -> np.ndarray:
    """A JPEG to RGB. ``tables``: another one with tables alone, which come first."""
    state = _Jpeg()
    if tables:
        state.read(tables)
    state.read(data)
    return state.image()


class _Jpeg:
    def __init__(self) -> None:
        self.quant: dict[int, np.ndarray] = {}
        self.huffman: dict[tuple[int, int], _Table] = {}
        self.parts: list[_Part] = []
        self.width = self.height = self.interval = 0
        self.progressive, self.adobe = False, None

    def read(self, data: bytes) -> None:
        at = 2
        while at + 4 <= len(data):
            if data[at] != 0xFF:
                at += 1
                continue
            kind = data[at + 1]
            if kind in (0xFF, 0x00, 0x01) or 0xD0 <= kind <= 0xD8:
                at += 1 if kind == 0xFF else 2
                continue
            if kind == 0xD9:
                return
            size = struct.unpack_from(">H", data, at + 2)[0]
            body = data[at + 4 : at + 2 + size]
            at += 2 + size
            if kind == 0xDB:
                self._quantisation(body)
            elif kind == 0xC4:
                self._codes(body)
            elif kind in (0xC0, 0xC1, 0xC2):
                self._frame(body, kind == 0xC2)
            elif 0xC3 <= kind <= 0xCF and kind not in (0xC8, 0xCC):
                raise _broken("a kind of JPEG that is not supported")
            elif kind == 0xDD:
                self.interval = struct.unpack(">H", body[:2])[0]
            elif kind == 0xEE and body[:5] == b"Adobe":
                self.adobe = body[11]
            elif kind == 0xDA:
                at = self._scan(body, data, at)

    def _quantisation(self, body: bytes) -> None:
        at = 0
        while at < len(body):
            wide, ident = body[at] >> 4, body[at] & 15
            size = 128 if wide else 64
            self.quant[ident] = np.frombuffer(body, ">u2" if wide else np.uint8, 64, at + 1).astype(np.float64)
            at += 1 + size

    def _codes(self, body: bytes) -> None:
        at = 0
        while at < len(body):
            counts = body[at + 1 : at + 17]
            n = sum(counts)
            self.huffman[body[at] >> 4, body[at] & 15] = _Table(counts, body[at + 17 : at + 17 + n])
            at += 17 + n

    def _frame(self, body: bytes, progressive: bool) -> None:
        depth, self.height, self.width, n = struct.unpack_from(">BHHB", body)
        if depth != 8 or not self.height or not self.width or not 1 <= n <= 4:
            raise _broken("a JPEG of that depth or size is not supported")
        self.progressive = progressive
        self.parts = [_Part(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
        self.h, self.v = max(p.h for p in self.parts), max(p.v for p in self.parts)
        self.units_x, self.units_y = -(-self.width // (8 * self.h)), -(-self.height // (8 * self.v))
        for p in self.parts:
            p.rows, p.cols = self.units_y * p.v, self.units_x * p.h
            p.own_cols, p.own_rows = -(-self.width * p.h // (8 * self.h)), -(-self.height * p.v // (8 * self.v))
            p.coded = [[0] * 64 for _ in range(p.rows * p.cols)]

    def _scan(self, body: bytes, data: bytes, at: int) -> int:
        n = body[0]
        by = {p.ident: p for p in self.parts}
        parts = [by[body[1 + 2 * i]] for i in range(n)]
        ids = [body[2 + 2 * i] for i in range(n)]
        first, last, approx = body[1 + 2 * n : 4 + 2 * n]
        scan = _Scan(parts, [self.huffman.get((0, i >> 4)) for i in ids], [self.huffman.get((1, i & 15)) for i in ids], first, last, approx >> 4, approx & 15, self.progressive)
        end, cuts = at, [at]
        while True:  # up to the next marker that is not a restart
            end = data.find(b"\xff", end)
            if end < 0 or end + 1 >= len(data):
                end = len(data)
                break
            if data[end + 1] == 0 or data[end + 1] == 0xFF:
                end += 2 if data[end + 1] == 0 else 1
            elif 0xD0 <= data[end + 1] <= 0xD7:
                cuts.append(end + 2)
                end += 2
            else:
                break
        pieces = [data[a:b] for a, b in zip(cuts, [c - 2 for c in cuts[1:]] + [end], strict=True)]
        order = self._order(parts)
        step = self.interval or len(order) or 1
        for k in range(0, len(order), step):
            if k // step >= len(pieces):
                raise _broken("the image breaks off")
            bits = _Bits(pieces[k // step])
            scan.reset()
            for unit in order[k : k + step]:
                for part, block in unit:
                    scan.block(bits, part, parts[part].coded[block])
        return end

    def _order(self, parts: list[_Part]) -> list[list[tuple[int, int]]]:
        """The units of a scan: which blocks of which components come together."""
        if len(parts) == 1:
            p = parts[0]
            return [[(0, y * p.cols + x)] for y in range(p.own_rows) for x in range(p.own_cols)]
        return [[(k, (uy * p.v + y) * p.cols + ux * p.h + x) for k, p in enumerate(parts) for y in range(p.v) for x in range(p.h)] for uy in range(self.units_y) for ux in range(self.units_x)]

    def image(self) -> np.ndarray:
        if not self.parts:
            raise _broken("a JPEG without an image")
        planes = []
        for p in self.parts:
            coded = np.array(p.coded, np.float64) * self.quant[p.quant]
            blocks = np.zeros_like(coded)
            blocks[:, ZIGZAG] = coded
            pixels = _COS @ blocks.reshape(-1, 8, 8) @ _COS.T + 128.0
            plane = pixels.reshape(p.rows, p.cols, 8, 8).transpose(0, 2, 1, 3).reshape(p.rows * 8, p.cols * 8)
            plane = plane.repeat(self.v // p.v, 0).repeat(self.h // p.h, 1) if self.v % p.v == self.h % p.h == 0 else plane[np.ix_(np.arange(self.height) * p.v // self.v, np.arange(self.width) * p.h // self.h)]
            planes.append(np.clip(plane[: self.height, : self.width], 0, 255))
        if len(planes) < 3:
            return np.repeat(np.floor(planes[0] + 0.5).astype(np.uint8)[..., None], 3, -1)
        named = [p.ident for p in self.parts[:3]] == [82, 71, 66]  # the letters of its colours
        rgb = planes[:3]
        if self.adobe in (1, 2) or self.adobe is None and len(planes) == 3 and not named:
            y, cb, cr = planes[0], planes[1] - 128, planes[2] - 128
            rgb = [y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb]
        if len(planes) == 4:  # inks, which such files store upside down
            rgb = [np.clip(c, 0, 255) * planes[3] / 255 for c in rgb] if self.adobe is not None else [(255 - c) * (255 - planes[3]) / 255 for c in rgb]
        return np.clip(np.floor(np.stack(rgb, -1) + 0.5), 0, 255).astype(np.uint8)


# --- BMP

def _run_lengths(data: bytes, width: int, height: int, nibbles: bool) -> np.ndarray:
    out = np.zeros((height, width), np.uint8)
    at = x = y = 0
    while at + 1 < len(data) and y < height:
        n, value = data[at], data[at + 1]
        at += 2
        if n:
            both = (value >> 4, value & 15) if nibbles else (value, value)
            for i in range(min(n, width - x)):
                out[y, x + i] = both[i % 2]
            x = min(width, x + n)
        elif value == 0:
            x, y = 0, y + 1
        elif value == 1:
            break
        elif value == 2:
            x, y, at = x + data[at], y + data[at + 1], at + 2
        else:
            size = (value + 1) // 2 if nibbles else value
            raw = data[at : at + size]
            flat = [v for b in raw for v in (b >> 4, b & 15)][:value] if nibbles else list(raw)
            flat = flat[: width - x]
            out[y, x : x + len(flat)] = flat
            x, at = x + len(flat), at + size + size % 2
    return out


def decode_bmp(data: bytes) -> np.ndarray:
    start, head = struct.unpack_from("<II", data, 10)
    if head == 12:
        width, height, _, depth = struct.unpack_from("<HHHH", data, 18)
        packing, used, entry = 0, 0, 3
    else:
        width, height, _, depth, packing = struct.unpack_from("<iiHHI", data, 18)
        used, entry = struct.unpack_from("<I", data, 46)[0], 4
    down, height = height < 0, abs(height)
    if width <= 0 or height <= 0 or packing not in (0, 1, 2, 3):
        raise _broken("a BMP of that size or packing is not supported")
    if depth <= 8:
        palette = np.frombuffer(data, np.uint8, (used or 1 << depth) * entry, 14 + head).reshape(-1, entry)[:, 2::-1]
    stride = (width * depth + 31) // 32 * 4
    if packing in (1, 2):
        pixels = palette[_run_lengths(data[start:], width, height, packing == 2)]
    else:
        raw = np.frombuffer(data, np.uint8, stride * height, start).reshape(height, stride)
        if depth < 8:
            at = np.unpackbits(raw, axis=1).reshape(height, -1, depth) @ (1 << np.arange(depth - 1, -1, -1))
            pixels = palette[at[:, :width]]
        elif depth == 8:
            pixels = palette[raw[:, :width]]
        elif depth in (24, 32) and packing == 0:
            pixels = raw[:, : width * depth // 8].reshape(height, width, -1)[..., 2::-1]
        elif depth in (16, 32):
            masks = struct.unpack_from("<III", data, 54) if packing == 3 else (0x7C00, 0x3E0, 0x1F)
            words = raw[:, : width * depth // 8].copy().view("<u2" if depth == 16 else "<u4").astype(np.uint64)
            pixels = np.stack([(words & m) // (m & -m) * 255 // max(1, m // (m & -m)) for m in masks], -1).astype(np.uint8)
        else:
            raise _broken("a BMP of that depth is not supported")
    return np.ascontiguousarray(pixels if down else pixels[::-1]).astype(np.uint8)


# --- TIFF

_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 11: 4, 12: 8}
_LETTERS = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d"}


def _tags(data: bytes, order: str) -> dict[int, list]:
    at = struct.unpack_from(order + "I", data, 4)[0]
    out: dict[int, list] = {}
    for i in range(struct.unpack_from(order + "H", data, at)[0]):
        tag, kind, n = struct.unpack_from(order + "HHI", data, at + 2 + 12 * i)
        if kind not in _SIZES:
            continue
        place = at + 10 + 12 * i
        if _SIZES[kind] * n > 4:
            place = struct.unpack_from(order + "I", data, place)[0]
        if kind in (2, 7):
            out[tag] = [data[place : place + n]]
        elif kind in _LETTERS:
            out[tag] = list(struct.unpack_from(f"{order}{n}{_LETTERS[kind]}", data, place))
    return out


def _pack_bits(data: bytes) -> bytes:
    out, at = bytearray(), 0
    while at < len(data):
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += 2 + n
        else:
            if n > 128:
                out += data[at + 1 : at + 2] * (257 - n)
            at += 2 if n > 128 else 1
    return bytes(out)


def _lzw(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, high bits first, which grow one code early."""
    out, words, before = [], [bytes([i]) for i in range(256)] + [b"", b""], b""
    held = n = at = 0
    width = 9
    while True:
        while n < width:
            if at >= len(data):
                return b"".join(out)
            held, n, at = (held << 8 | data[at]) & 0xFFFFFF, n + 8, at + 1
        code = held >> (n - width) & ((1 << width) - 1)
        n -= width
        if code == 257:
            return b"".join(out)
        if code == 256:
            del words[258:]
            width, before = 9, b""
            continue
        if code > len(words) or code == len(words) and not before:
            raise _broken("no such code")
        word = words[code] if code < len(words) else before + before[:1]
        out.append(word)
        if before:
            words.append(before + word[:1])
        before = word
        width = min(12, (len(words) + 1).bit_length())


def decode_tiff(data: bytes) -> np.ndarray:
    """The first image of a TIFF."""
    order = "<" if data[:2] == b"II" else ">"
    t = _tags(data, order)
    one = lambda tag, default: t.get(tag, [default])[0]
    width, height, packing, meaning, samples = t[256][0], t[257][0], one(259, 1), one(262, 1), one(277, 1)
    depth = one(258, 1)
    if depth not in (1, 2, 4, 8, 16) or packing not in (1, 5, 7, 8, 32773, 32946) or meaning not in (0, 1, 2, 3, 5, 6) or one(266, 1) != 1 or width <= 0 or height <= 0:
        raise _broken("a TIFF of that packing or colour is not supported")
    planar = one(284, 1) == 2 and samples > 1
    each = 1 if planar else samples
    tiled = 322 in t
    tw, th = (t[322][0], t[323][0]) if tiled else (width, min(height, one(278, height)))
    across, down = -(-width // tw), -(-height // th)
    places, sizes = (t[324], t[325]) if tiled else (t[273], t.get(279, [len(data)]))
    unpack = {1: bytes, 5: _lzw, 8: zlib.decompress, 32946: zlib.decompress, 32773: _pack_bits}
    image = np.zeros((down * th, across * tw, samples), np.uint8)
    for k, (place, size) in enumerate(zip(places, sizes, strict=True)):
        plane, rest = divmod(k, across * down)
        y, x = rest // across * th, rest % across * tw
        rows = th if tiled else min(th, height - y)
        raw = data[place : place + size]
        if packing == 7:
            pixels = decode_jpeg(raw, one(347, b""))[:rows, :tw, :each]
        else:
            stride = (tw * each * depth + 7) // 8
            flat = np.frombuffer(unpack[packing](raw)[: stride * rows].ljust(stride * rows, b"\0"), np.uint8).reshape(rows, stride)
            if depth < 8:
                flat = (np.unpackbits(flat, axis=1).reshape(rows, -1, depth) @ (1 << np.arange(depth - 1, -1, -1)))[:, : tw * each]
            elif depth == 16:
                flat = flat.copy().view(order + "u2")
            pixels = flat.reshape(rows, tw, each)
            if one(317, 1) == 2:
                pixels = np.cumsum(pixels, 1, dtype=pixels.dtype)
            if depth == 16 and meaning != 3:
                pixels = pixels >> 8
            elif depth < 8 and meaning in (0, 1):
                pixels = pixels * (255 // ((1 << depth) - 1))
        image[y : y + rows, x : x + tw, plane if planar else slice(None)] = pixels[..., 0] if planar else pixels
    image = image[:height, :width]
    if meaning == 3:
        return (np.array(t[320]).reshape(3, -1).T[image[..., 0]] >> 8).astype(np.uint8)
    if meaning in (0, 1):
        grey = 255 - image[..., 0] if meaning == 0 else image[..., 0]
        return np.repeat(grey[..., None], 3, -1)
    if meaning == 5:
        inks = 255 - image[..., :4].astype(np.uint16)
        return (inks[..., :3] * inks[..., 3:] // 255).astype(np.uint8)
    if meaning == 6 and packing != 7:
        y, cb, cr = (image[..., i].astype(np.float64) for i in range(3))
        return np.clip(np.stack([y + 1.402 * (cr - 128), y - 0.344136 * (cb - 128) - 0.714136 * (cr - 128), y + 1.772 * (cb - 128)], -1) + 0.5, 0, 255).astype(np.uint8)
    return np.ascontiguousarray(image[..., :3])
