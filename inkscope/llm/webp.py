"""Lossless WebP: a decoder for the whole format, and a writer for payloads.

``decode`` reads canonical prefix codes (one group or many, chosen by an entropy
image), back-references, the colour cache, and inverts the predictor,
cross-colour, subtract-green and palette transforms; it returns an array of
ARGB pixels.

``store`` writes bytes as red, green and blue samples of an image 64 pixels wide
(192 bytes a row).  An image of at most 256 colours is stored by a palette; any
other by a predictor image (for each tile the cheapest of three modes that row
operations invert) and, where it shortens the code, a cross-colour image.  What is left is coded by back-references to the last place where the next
pixels occurred, the colour cache where it pays, and Huffman codes of at most
ten bits.  ``fetch`` reads all of that back through the decoder.  A chunk
``TXLN`` holds the payload's length.  Equal payloads give equal files.  What
exceeds one image of 16,384 rows continues in the next file, appended, so memory
is bounded by an image.
"""

from __future__ import annotations

import functools
import math
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_slices, sha256_hex

UNIT = 192
SIDE = 16_384
#: Fixed values of the format: order of the code-length codes, hash multiplier.
CODE_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
CACHE_MULTIPLIER = 0x1E35A7BD
LENGTHS = 24
BLACK = 0xFF000000


def _near_offsets() -> list[tuple[int, int]]:
    """(x, y) of the 120 short distance codes: by distance, then |x|, right first."""
    near = [(x, y) for y in range(8) for x in range(-7, 9) if y or x > 0]
    return sorted(near, key=lambda p: (p[0] ** 2 + p[1] ** 2, abs(p[0]), p[0] < 0))


NEAR = _near_offsets()


class FormatError(ValueError):
    """The bytes are no readable lossless WebP."""


class Bits:
    """Least-significant-bit-first reader."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def read(self, n: int) -> int:
        if not n:
            return 0
        lo = self.at >> 3
        if self.at + n > 8 * len(self.data):
            raise FormatError("the stream ends early")
        word = int.from_bytes(self.data[lo : lo + 5], "little") >> (self.at & 7)
        self.at += n
        return word & ((1 << n) - 1)

    def peek(self, n: int) -> int:
        lo = self.at >> 3
        return (int.from_bytes(self.data[lo : lo + 5], "little") >> (self.at & 7)) & ((1 << n) - 1)


class Code:
    """A canonical prefix code given by the lengths of its symbols' codes, symbols rising."""

    def __init__(self, symbols, lengths):
        self.symbols, self.lengths = np.array(symbols, np.int64), np.array(lengths, np.int64)
        if len(symbols) <= 1:  # one symbol takes no bits
            self.symbols, self.lengths = np.array([*symbols, 0][:1], np.int64), np.zeros(1, np.int64)
        self.longest = int(self.lengths.max())
        if (1 << (self.longest - self.lengths)).sum() != 1 << self.longest:
            raise FormatError("a prefix code is not complete")
        self._tables: dict[int, list[int]] = {}
        self._arrays: tuple[np.ndarray, np.ndarray] | None = None

    @property
    def first(self) -> int:
        return int(self.symbols[0])

    def table(self, shift: int = 0) -> list[int]:
        """symbol << (shift + 4) | length, by the next ``longest`` bits of the stream."""
        if shift not in self._tables:
            order = np.argsort(self.lengths, kind="stable")
            size = self.lengths[order]
            by_code = np.repeat(self.symbols[order] << (shift + 4) | size, 1 << (self.longest - size))
            self._tables[shift] = by_code[_reversal(self.longest)].tolist()
        return self._tables[shift]

    def arrays(self) -> tuple[np.ndarray, np.ndarray]:
        """(symbol, length of its code) by the next ``longest`` bits of the stream."""
        if self._arrays is None:
            entry = np.array(self.table(), np.uint32)
            self._arrays = entry >> 4, (entry & 15).astype(np.uint8)
        return self._arrays

    def read(self, bits: Bits) -> int:
        if not self.longest:
            return self.first
        entry = self.table()[bits.peek(self.longest)]
        bits.at += entry & 15
        return entry >> 4


@functools.lru_cache(maxsize=16)
def _reversal(n: int) -> np.ndarray:
    """Every number of ``n`` bits, read backwards."""
    out = np.zeros(1, np.int64)
    for _ in range(n):
        out = np.concatenate([out * 2, out * 2 + 1])
    return out


@functools.lru_cache(maxsize=1_024)
def _single(symbol: int) -> Code:
    return Code([symbol], [1])


#: Codes read last, by alphabet: (bits of the declaration, their number, the code).  A declaration
#: that comes again bit for bit is not parsed again.
_SEEN: dict[int, list[tuple[int, int, Code]]] = {}


def _read_code(bits: Bits, alphabet: int) -> Code:
    begin, shift = bits.at >> 3, bits.at & 7
    head = int.from_bytes(bits.data[begin : begin + 3], "little") >> shift
    if head & 7 == 5 and bits.at + 11 <= 8 * len(bits.data):  # one symbol of eight bits
        bits.at += 11
        return _single(head >> 3 & 255)
    for known, n, code in _SEEN.get(alphabet, ()):
        if (int.from_bytes(bits.data[begin : begin + (n + shift + 7 >> 3)], "little") >> shift) & ((1 << n) - 1) == known:
            bits.at += n
            return code
    start = bits.at
    code = _parse_code(bits, alphabet)
    if len(code.symbols) > 2 and (n := bits.at - start) < 4_096:
        known = (int.from_bytes(bits.data[begin : begin + (n + shift + 7 >> 3)], "little") >> shift) & ((1 << n) - 1)
        _SEEN[alphabet] = [(known, n, code), *_SEEN.get(alphabet, ())][:4]
    return code


def _parse_code(bits: Bits, alphabet: int) -> Code:
    if bits.read(1):
        two = bits.read(1)
        used = {bits.read(8 if bits.read(1) else 1)}
        if two:
            used.add(bits.read(8))
        return Code(sorted(used), [1] * len(used)) if len(used) > 1 else _single(used.pop())
    given = [bits.read(3) for _ in range(4 + bits.read(4))]
    inner = sorted((s, n) for s, n in zip(CODE_ORDER, given) if n)
    code = Code([s for s, _ in inner], [n for _, n in inner])
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else alphabet
    each: list[int] = []
    before = 8
    table, mask = code.table(), (1 << code.longest) - 1
    word = held = 0
    while len(each) < alphabet and left > 0:
        left -= 1
        if held < 14:
            begin = bits.at >> 3
            word = int.from_bytes(bits.data[begin : begin + 128], "little") >> (bits.at & 7)
            held = 1_024 - (bits.at & 7)
        entry = table[word & mask]
        size, token = entry & 15, entry >> 4
        if token < 16:
            if token:
                before = token
            each.append(token)
        elif token == 16:
            each += [before] * (3 + (word >> size & 3))
            size += 2
        elif token == 17:
            each += [0] * (3 + (word >> size & 7))
            size += 3
        else:
            each += [0] * (11 + (word >> size & 127))
            size += 7
        word >>= size
        held -= size
        bits.at += size
    if len(each) > alphabet or bits.at > 8 * len(bits.data):
        raise FormatError("code lengths run over")
    lengths = np.array(each, np.int64)
    symbols = np.flatnonzero(lengths)
    return Code(symbols, lengths[symbols])


def _prefix_value(bits: Bits, symbol: int) -> int:
    if symbol < 4:
        return symbol + 1
    extra = (symbol - 2) >> 1
    return ((2 + (symbol & 1)) << extra) + bits.read(extra) + 1


def _image(bits: Bits, width: int, height: int, main: bool) -> np.ndarray:
    """An entropy-coded image as uint32 [height, width]."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    if cache_bits > 11:
        raise FormatError("the colour cache is too large")
    groups, meta, meta_bits = 1, None, 0
    if main and bits.read(1):
        meta_bits = bits.read(3) + 2
        meta = _image(bits, (width + (1 << meta_bits) - 1) >> meta_bits, (height + (1 << meta_bits) - 1) >> meta_bits, False)
        meta = (meta >> 8) & 0xFFFF
        groups = int(meta.max()) + 1
    cache_size = (1 << cache_bits) if cache_bits else 0
    alphabets = (256 + LENGTHS + cache_size, 256, 256, 256, 40)
    codes = [[_read_code(bits, a) for a in alphabets] for _ in range(groups)]
    deep = sum(c.longest for c in codes[0][:4])
    if groups == 1 and not deep and codes[0][0].first < 256:  # every pixel is the one that takes no bits
        green, red, blue, alpha = (c.first for c in codes[0][:4])
        return np.full((height, width), alpha << 24 | red << 16 | green << 8 | blue, np.uint32)
    if groups == 1 and deep <= 48 and width * height > FEW:
        if cache_bits or not deep:
            return _one_group(bits, codes[0], width, height, cache_bits)
        return _stretches(bits, codes[0], width, height)
    return _pixels(bits, codes, width, height, meta, meta_bits, cache_bits)


#: Images of so few pixels are read pixel by pixel.
FEW = 32
#: Bytes of the stream whose literals are measured at once.
STRETCH = 1 << 15
_SHIFTS = np.arange(8)
_BEYOND = b"\xff" * 64


def _stretches(bits: Bits, group: list[Code], width: int, height: int) -> np.ndarray:
    """Pixels under one group of codes without a cache.

    What a literal would take is told for every bit of a stretch of the stream at
    once; walking the literals is then a sum of lengths, and their samples are
    looked up together.
    """
    total = width * height
    base = bits.at >> 3
    data = bits.data[base:] + b"\0" * 16
    end = 8 * (len(data) - 16)
    inner = Bits(data)
    green, red, blue, alpha = (c.arrays() for c in group[:4])
    masks = [len(t[1]) - 1 for t in (green, red, blue, alpha)]
    taken = green[1] | (green[0] > 255).astype(np.uint8) << np.uint8(7)  # 128 and more: no literal
    others = [(c[1], m, len(c[1]) > 1) for c, m in zip((red, blue, alpha), masks[1:])]
    literals: list[np.ndarray] = []
    refs: list[tuple[int, int, int]] = []  # literals before, distance, length
    p, done, said = bits.at & 7, 0, 0
    while done < total:
        if p > end:
            raise FormatError("the stream ends early")
        begin = p >> 3
        n_bytes = min(STRETCH, len(data) - 7 - begin)
        words = np.ndarray((n_bytes,), "<i8", data, begin, (1,))
        windows = (words[:, None] >> _SHIFTS).ravel()
        left = windows
        size = taken.take(left & masks[0])
        lengths = size.copy()
        for sizes, mask, many in others:
            if many:
                left = left >> size
                size = sizes.take(left & mask)
                lengths += size
        steps = lengths.tobytes() + _BEYOND
        places: list[int] = []
        put = places.append
        p -= 8 * begin
        while done < total:
            before = len(places)
            for _ in range(total - done):
                n = steps[p]
                if n > 127:
                    break
                put(p)
                p += n
            done += len(places) - before
            if done == total or n == 255 or p + 8 * begin > end:
                break
            inner.at = p + 8 * begin
            run = _prefix_value(inner, group[0].read(inner) - 256)
            far = _prefix_value(inner, group[4].read(inner))
            p = inner.at - 8 * begin
            far = far - len(NEAR) if far > len(NEAR) else max(1, NEAR[far - 1][0] + NEAR[far - 1][1] * width)
            if far > done or done + run > total:
                raise FormatError("a reference leaves the image")
            refs.append((said + len(places), far, run))
            done += run
            if p >= 8 * n_bytes:
                break
        said += len(places)
        p += 8 * begin
        left = windows[places]
        pixel = np.zeros(len(places), np.uint32)
        for (symbols, sizes), mask, shift in zip((green, red, blue, alpha), masks, (8, 16, 0, 24)):
            at = left & mask
            pixel |= symbols[at] << np.uint32(shift)
            left = left >> sizes[at]
        literals.append(pixel)
    bits.at = 8 * base + p
    if bits.at > 8 * len(bits.data):
        raise FormatError("the stream ends early")
    flat = np.concatenate(literals)
    if refs:
        out = np.empty(total, np.uint32)
        at = used = 0
        for before, far, run in refs:
            out[at : at + before - used] = flat[used:before]
            at += before - used
            used = before
            out[at : at + run] = out[at - far : at - far + run] if far >= run else np.resize(out[at - far : at], run)
            at += run
        out[at:] = flat[used:]
        flat = out
    return flat.reshape(height, width)


def _one_group(bits: Bits, group: list[Code], width: int, height: int, cache_bits: int) -> np.ndarray:
    """Pixels under one group of codes: a literal takes one look at the stream."""
    total = width * height
    data = bits.data[bits.at >> 3 :] + b"\0" * 16
    rows = np.lib.stride_tricks.sliding_window_view(np.frombuffer(data, np.uint8), 8)[:-1]
    look = (np.ascontiguousarray(rows).view(np.uint64)[:, 0] & np.uint64((1 << 60) - 1)).tolist()
    end = 8 * (len(data) - 16)
    greens, reds, blues, alphas = (c.table(at) for c, at in zip(group, (0, 16, 0, 24)))
    green_mask, red_mask, blue_mask, alpha_mask = (len(t) - 1 for t in (greens, reds, blues, alphas))
    cache = [0] * (1 << cache_bits) if cache_bits else []
    back = 32 - cache_bits
    out: list[int] = []
    put = out.append
    p, stored = bits.at & 7, 0
    inner = Bits(data)
    look += [0] * 8
    base = sum(t[0] >> 4 for t in (reds, blues, alphas) if len(t) == 1)  # channels of one value take no bits
    several = alpha_mask > 0 or (red_mask > 0) != (blue_mask > 0)
    grey = not red_mask and not blue_mask
    try:
        while len(out) < total:
            if p > end:
                raise FormatError("the stream ends early")
            for _ in range(total - len(out)):  # literals, up to the next other symbol
                word = look[p >> 3] >> (p & 7)
                code = greens[word & green_mask]
                n = code & 15
                symbol = code >> 4
                if symbol > 255:
                    break
                if several:
                    word >>= n
                    red = reds[word & red_mask]
                    word >>= red & 15
                    blue = blues[word & blue_mask]
                    alpha = alphas[word >> (blue & 15) & alpha_mask]
                    p += n + (red & 15) + (blue & 15) + (alpha & 15)
                    put(alpha >> 4 | red >> 4 | symbol << 8 | blue >> 4)
                elif grey:
                    p += n
                    put(base | symbol << 8)
                else:
                    word >>= n
                    red = reds[word & red_mask]
                    blue = blues[word >> (red & 15) & blue_mask]
                    p += n + (red & 15) + (blue & 15)
                    put(base | red >> 4 | symbol << 8 | blue >> 4)
            else:
                break
            if symbol < 256 + LENGTHS:
                inner.at = p + n
                run = _prefix_value(inner, symbol - 256)
                far = _prefix_value(inner, group[4].read(inner))
                p = inner.at
                far = far - len(NEAR) if far > len(NEAR) else max(1, NEAR[far - 1][0] + NEAR[far - 1][1] * width)
                at = len(out)
                if far > at or at + run > total:
                    raise FormatError("a reference leaves the image")
                piece = out[at - far : at - far + run]
                out += (piece * (run // far + 1))[:run] if far < run else piece
            else:
                p += n
                for pixel in out[stored:]:
                    cache[(CACHE_MULTIPLIER * pixel & 0xFFFFFFFF) >> back] = pixel
                stored = len(out)
                put(cache[symbol - 256 - LENGTHS])
    except IndexError:
        raise FormatError("the stream ends early") from None
    bits.at += p - (bits.at & 7)
    if bits.at > 8 * len(bits.data):
        raise FormatError("the stream ends early")
    return np.array(out, np.uint32).reshape(height, width)


def _pixels(bits, codes, width, height, meta, meta_bits, cache_bits) -> np.ndarray:
    total = width * height
    out = [0] * total
    cache = [0] * (1 << cache_bits) if cache_bits else []
    at = stored = 0
    group = codes[0]
    while at < total:
        if meta is not None:
            group = codes[meta[(at // width) >> meta_bits, (at % width) >> meta_bits]]
        s = group[0].read(bits)
        if s < 256:
            red, blue, alpha = group[1].read(bits), group[2].read(bits), group[3].read(bits)
            out[at] = alpha << 24 | red << 16 | s << 8 | blue
            at += 1
        elif s < 256 + LENGTHS:
            run = _prefix_value(bits, s - 256)
            far = _prefix_value(bits, group[4].read(bits))
            if far > len(NEAR):
                far -= len(NEAR)
            else:
                x, y = NEAR[far - 1]
                far = max(1, x + y * width)
            if far > at or at + run > total:
                raise FormatError("a reference leaves the image")
            for k in range(at, at + run):
                out[k] = out[k - far]
            at += run
        else:
            for k in range(stored, at):
                cache[(CACHE_MULTIPLIER * out[k] & 0xFFFFFFFF) >> (32 - cache_bits)] = out[k]
            stored = at
            out[at] = cache[s - 256 - LENGTHS]
            at += 1
        if bits.at > 8 * len(bits.data):
            raise FormatError("the stream ends early")
    return np.array(out, np.uint32).reshape(height, width)


# -- transforms ---------------------------------------------------------------


def _channels(pixels: np.ndarray) -> np.ndarray:
    """uint32 [h, w] -> uint8 [h, w, 4] as blue, green, red, alpha."""
    return np.ascontiguousarray(pixels).view(np.uint8).reshape(*pixels.shape, 4)


def _packed(channels: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(channels).view(np.uint32)[..., 0]


def _average(a, b):
    return (a + b) >> 1


def _predict(mode: int, L, T, TR, TL):
    """Predicted samples from int arrays of the neighbours' four channels."""
    if mode == 1:
        return L
    if mode == 2:
        return T
    if mode == 3:
        return TR
    if mode == 4:
        return TL
    if mode == 5:
        return _average(_average(L, TR), T)
    if mode == 6:
        return _average(L, TL)
    if mode == 7:
        return _average(L, T)
    if mode == 8:
        return _average(TL, T)
    if mode == 9:
        return _average(T, TR)
    if mode == 10:
        return _average(_average(L, TL), _average(T, TR))
    if mode == 11:
        return L if np.abs(T - TL).sum() < np.abs(L - TL).sum() else T
    if mode == 12:
        return np.clip(L + T - TL, 0, 255)
    if mode == 13:
        mean = _average(L, T)
        return np.clip(mean + np.trunc((mean - TL) / 2).astype(int), 0, 255)
    return np.array([0, 0, 0, 255])


def _invert_predictor(pixels: np.ndarray, modes: np.ndarray, size_bits: int) -> np.ndarray:
    height, width = pixels.shape
    out = _channels(pixels).astype(np.int64)
    modes = (modes >> 8) & 15
    out[0, 0, 3] += 255
    out[0] = np.cumsum(out[0], axis=0) & 255  # the first row is predicted from the left
    size = 1 << size_bits
    plain = {k for k in range(len(modes)) if not modes[k].any()}
    for k in plain:  # tiles of mode 0 only: their pixels lean on none but the first column
        rows = slice(max(1, k * size), (k + 1) * size)
        out[rows, 1:, 3] = (out[rows, 1:, 3] + 255) & 255
    for y in range(1, height):
        if y >> size_bits in plain:
            if not y & (size - 1) or y == 1:
                rows = slice(y - 1, ((y >> size_bits) + 1) * size)
                out[rows, 0] = np.cumsum(out[rows, 0], axis=0) & 255
            continue
        row, above = out[y], out[y - 1]
        row[0] = (row[0] + above[0]) & 255
        strip = modes[y >> size_bits]
        for block in range(len(strip)):
            lo, hi = max(1, block << size_bits), min(width, (block + 1) << size_bits)
            mode = int(strip[block])
            if lo >= hi:
                continue
            if mode == 1:
                row[lo:hi] = (np.cumsum(row[lo:hi], axis=0) + row[lo - 1]) & 255
            elif mode in (0, 2, 3, 4, 8, 9):
                right = np.concatenate([above[lo + 1 : hi + 1], row[:1]])[: hi - lo] if mode in (3, 9) else None
                row[lo:hi] = (row[lo:hi] + _predict(mode, None, above[lo:hi], right, above[lo - 1 : hi - 1])) & 255
            else:
                for x in range(lo, hi):
                    right = above[x + 1] if x + 1 < width else row[0]
                    row[x] = (row[x] + _predict(mode, row[x - 1], above[x], right, above[x - 1])) & 255
    return _packed(out.astype(np.uint8))


def _invert_colour(pixels: np.ndarray, elements: np.ndarray, size_bits: int) -> np.ndarray:
    if not (elements & np.uint32(0xFFFFFF)).any():
        return pixels
    height, width = pixels.shape
    grid = _channels(elements).view(np.int8)
    grid = grid[np.arange(height)[:, None] >> size_bits, np.arange(width)[None, :] >> size_bits].astype(np.int32)
    out = _channels(pixels).copy()
    green = out[..., 1].view(np.int8).astype(np.int32)
    red = (out[..., 2] + (grid[..., 0] * green >> 5)) & 255
    blue = out[..., 0] + (grid[..., 1] * green >> 5) + (grid[..., 2] * red.astype(np.uint8).view(np.int8).astype(np.int32) >> 5)
    out[..., 2], out[..., 0] = red, blue & 255
    return _packed(out)


def _invert_green(pixels: np.ndarray) -> np.ndarray:
    out = _channels(pixels).copy()
    out[..., 0] += out[..., 1]
    out[..., 2] += out[..., 1]
    return _packed(out)


def _invert_palette(pixels: np.ndarray, palette: np.ndarray, width: int, pack: int) -> np.ndarray:
    index = (pixels >> 8) & 255
    if pack:
        depth = 8 >> pack
        x = np.arange(width)
        index = (index[:, x >> pack] >> ((x & ((1 << pack) - 1)) * depth)) & ((1 << depth) - 1)
    table = np.zeros(256, np.uint32)
    table[: len(palette)] = palette
    return table[index]


def decode_vp8l(data: bytes) -> np.ndarray:
    """ARGB pixels, uint32 [height, width], of a VP8L chunk's content."""
    bits = Bits(data)
    if bits.read(8) != 0x2F:
        raise FormatError("no lossless signature")
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise FormatError("unknown version")
    undo = []
    coded = width
    while bits.read(1):
        kind = bits.read(2)
        if kind in (0, 1):
            size_bits = bits.read(3) + 2
            step = (1 << size_bits) - 1
            part = _image(bits, (coded + step) >> size_bits, (height + step) >> size_bits, False)
            undo.append((_invert_colour if kind else _invert_predictor, (part, size_bits)))
        elif kind == 2:
            undo.append((_invert_green, ()))
        else:
            count = bits.read(8) + 1
            palette = _packed((np.cumsum(_channels(_image(bits, count, 1, False)), axis=1) & 255).astype(np.uint8))[0]
            pack = 3 if count <= 2 else 2 if count <= 4 else 1 if count <= 16 else 0
            undo.append((_invert_palette, (palette, coded, pack)))
            coded = (coded + (1 << pack) - 1) >> pack
    pixels = _image(bits, coded, height, True)
    for invert, given in reversed(undo):
        pixels = invert(pixels, *given)
    return pixels


def chunks(data: bytes) -> tuple[dict[bytes, bytes], int]:
    """(chunks of the first RIFF file in ``data``, its length)."""
    if data[:4] != b"RIFF" or data[8:12] != b"WEBP":
        raise FormatError("no WebP file")
    end = 8 + struct.unpack_from("<I", data, 4)[0]
    if end > len(data):
        raise FormatError("the file is cut short")
    out, at = {}, 12
    while at + 8 <= end:
        size = struct.unpack_from("<I", data, at + 4)[0]
        out.setdefault(data[at : at + 4], data[at + 8 : at + 8 + size])
        at += 8 + size + size % 2
    return out, end


def decode(data: bytes) -> np.ndarray:
    """ARGB pixels of a lossless WebP file."""
    found, _ = chunks(data)
    if b"VP8L" not in found:
        raise FormatError("no lossless image")
    return decode_vp8l(found[b"VP8L"])


# -- writing ------------------------------------------------------------------

#: Longest code written: small tables, and a literal fits one look.
DEEPEST = 10
#: Modes that the writer chooses among: their inverse needs no loop over pixels.
MODES = (0, 1, 2)
CACHE_BITS = 8
MATCH = 4  # pixels a back-reference replaces at least
_REVERSED = _reversal(DEEPEST).astype(np.uint64)


class Out:
    """Least-significant-bit-first writer of (value, size) fields, given one by one or as arrays."""

    def __init__(self):
        self.values: list = []
        self.sizes: list = []
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []

    def put(self, value: int, size: int) -> None:
        self.values.append(value)
        self.sizes.append(size)

    def extend(self, values: np.ndarray, sizes: np.ndarray) -> None:
        if self.values:
            self.parts.append((np.array(self.values, np.uint64), np.array(self.sizes, np.uint8)))
            self.values, self.sizes = [], []
        self.parts.append((values, sizes))

    def bytes(self) -> bytes:
        self.extend(np.zeros(0, np.uint64), np.zeros(0, np.uint8))
        values, sizes = (np.concatenate(x) for x in zip(*self.parts))
        ends = np.cumsum(sizes, dtype=np.int64)
        begins = ends - sizes
        place, shift = begins >> 6, (begins & 63).astype(np.uint64)
        first = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
        words = np.zeros(int(ends[-1] >> 6) + 2, np.uint64)
        words[place[first]] = np.bitwise_or.reduceat(values << shift, first)
        over = np.flatnonzero((begins & 63) + sizes > 64)  # one field at most runs into each next word
        words[place[over] + 1] |= values[over] >> (np.uint64(64) - shift[over])
        return words.astype("<u8").tobytes()[: int(ends[-1]) + 7 >> 3]


def _code_lengths(counts: np.ndarray, deepest: int = DEEPEST) -> tuple[np.ndarray, np.ndarray]:
    """(symbols that occur, their Huffman code lengths); counts are levelled until no code is too long."""
    used = np.flatnonzero(counts)
    n = len(used)
    if n < 2:
        return (used, np.ones(1, np.int64)) if n else (np.zeros(1, np.int64), np.ones(1, np.int64))
    weights = counts[used]
    while True:
        order = np.argsort(weights, kind="stable")
        w = weights[order].tolist()
        parent = [0] * (2 * n - 1)
        leaf, node = 0, n
        w.append(1 << 62)  # stands for leaves that are used up
        inner: list[int] = []
        for k in range(n, 2 * n - 1):  # leaves and inner nodes both come by rising weight
            if node >= k or w[leaf] <= inner[node - n]:
                total, parent[leaf], leaf = w[leaf], k, leaf + 1
            else:
                total, parent[node], node = inner[node - n], k, node + 1
            if node >= k or w[leaf] <= inner[node - n]:
                total, parent[leaf], leaf = total + w[leaf], k, leaf + 1
            else:
                total, parent[node], node = total + inner[node - n], k, node + 1
            inner.append(total)
        depth = [0] * (2 * n - 1)
        for k in range(2 * n - 3, -1, -1):
            depth[k] = depth[parent[k]] + 1
        if max(depth) <= deepest:
            lengths = np.empty(n, np.int64)
            lengths[order] = depth[:n]
            return used, lengths
        weights = (weights + 1) >> 1  # ends at ones, whose code is balanced


def _words(symbols: np.ndarray, lengths: np.ndarray, alphabet: int) -> tuple[np.ndarray, np.ndarray]:
    """(bits as written, number of bits) of every symbol of a canonical code."""
    words, sizes = np.zeros(alphabet, np.uint64), np.zeros(alphabet, np.uint8)
    if len(symbols) > 1:
        order = np.argsort(lengths, kind="stable")
        room = 1 << (DEEPEST - lengths[order])
        words[symbols[order]] = _REVERSED[np.cumsum(room) - room]  # left-justified codes
        sizes[symbols] = lengths
    return words, sizes


@functools.lru_cache(maxsize=4)
def _text_code(alphabet: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A fixed code for samples of text: its declaration (values, sizes) and its words (bits, sizes)."""
    weight = np.ones(alphabet, np.int64)
    weight[256:] = 3
    weight[0x80:0xC0], weight[0xC3] = 8, 30
    weight[32:127], weight[ord("A") : ord("Z") + 1] = 5, 10
    for rank, letter in enumerate("etaoinshrdlucmfwypvbgkjqxz"):
        weight[ord(letter)] = 500 // (1 + rank)
    weight[[32, 46, 44, 10]] = 800, 70, 60, 30
    out = Out()
    words, sizes = _put_own_code(out, weight, alphabet)
    out.extend(words[:0], sizes[:0])
    return *(np.concatenate(x) for x in zip(*out.parts)), words, sizes


def _put_code(out: Out, counts: np.ndarray, alphabet: int) -> tuple[np.ndarray, np.ndarray]:
    """Declare a code for ``counts``; its words.  A code of their own is built where it saves a fifth."""
    if alphabet in (256, 256 + LENGTHS):
        used = np.count_nonzero(counts)
        if used > 2:
            values, sizes, words, size = _text_code(alphabet)
            if _entropy(counts) + 6 * used > 0.8 * (int(counts @ size) + int(sizes.sum())):
                out.extend(values, sizes)
                return words, size
    return _put_own_code(out, counts, alphabet)


def _put_single(out: Out, symbol: int) -> None:
    """Declare a code of one symbol, which takes no bits."""
    out.put(5 | symbol << 3, 11)


def _put_own_code(out: Out, counts: np.ndarray, alphabet: int) -> tuple[np.ndarray, np.ndarray]:
    """Declare a Huffman code for ``counts``; its words."""
    if np.count_nonzero(counts) <= 1 and (only := int(counts.argmax())) < 256:
        _put_single(out, only)
        return np.zeros(alphabet, np.uint64), np.zeros(alphabet, np.uint8)
    symbols, lengths = _code_lengths(counts)
    if len(symbols) <= 2 and symbols[-1] < 256:
        for value, size in ((1, 1), (len(symbols) - 1, 1), (1, 1), *((s, 8) for s in symbols.tolist())):
            out.put(value, size)
        return _words(symbols, lengths, alphabet)
    each = np.zeros(alphabet, np.int64)
    each[symbols] = lengths
    ends = np.flatnonzero(np.append(each[1:] != each[:-1], True)) + 1
    said: list[int] = []  # token | extra bits << 5 | their number << 12
    for length, run in zip(each[ends - 1].tolist(), np.diff(ends, prepend=0).tolist()):
        if length:
            said.append(length)
            run -= 1
            while run >= 3:
                said.append(16 | min(run, 6) - 3 << 5 | 2 << 12)
                run -= min(run, 6)
        else:
            while run >= 11:
                said.append(18 | min(run, 138) - 11 << 5 | 7 << 12)
                run -= min(run, 138)
            if run >= 3:
                said.append(17 | run - 3 << 5 | 3 << 12)
                run = 0
        if run:
            said += [length] * run
    given = np.array(said)
    tokens, extras, mores = given & 31, given >> 5 & 127, given >> 12
    inner = _code_lengths(np.bincount(tokens, minlength=19), 7)
    length_of = dict(zip(*(x.tolist() for x in inner)))
    last = max(max(k for k, s in enumerate(CODE_ORDER) if s in length_of) + 1, 4)
    head = last - 4 << 1
    for k, s in enumerate(CODE_ORDER[:last]):
        head |= length_of.get(s, 0) << 5 + 3 * k
    out.put(head, 5 + 3 * last)  # and a zero bit: all lengths are given
    out.put(0, 1)
    words, sizes = _words(*inner, 19)
    size = sizes[tokens]
    out.extend(words[tokens] | extras.astype(np.uint64) << size.astype(np.uint64), size + mores.astype(np.uint8))
    return _words(symbols, lengths, alphabet)


def _split(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(prefix symbol, extra bits, their number) of lengths or distances."""
    if values.max() < 1 << 14:
        symbol, extra, more = _short_splits()
        return symbol[values], extra[values], more[values]
    return _split_any(values)


@functools.lru_cache(maxsize=1)
def _short_splits() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return _split_any(np.arange(1 << 14))


def _split_any(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    x = np.maximum(values.astype(np.int64) - 1, 0)
    high = np.frexp(np.maximum(x, 1).astype(np.float64))[1] - 1
    more = np.maximum(high - 1, 0)
    symbol = np.where(x < 4, x, 2 * high + (x >> more & 1))
    more = np.where(x < 4, 0, more)
    return symbol, (x & ((1 << more) - 1)).astype(np.uint64), more.astype(np.uint8)


def _matches(flat: np.ndarray) -> tuple[list[int], list[int], list[int]]:
    """(positions, lengths, distances) of back-references, left to right, each to the last place of its next pixels."""
    starts: list[int] = []
    runs: list[int] = []
    fars: list[int] = []
    n = len(flat)
    if n <= MATCH:
        return starts, runs, fars
    key = flat[: n - MATCH + 1].astype(np.uint64)
    for k in range(1, MATCH):
        key = key * np.uint64(0x9E3779B97F4A7C15) + flat[k : n - MATCH + 1 + k]
    held = np.sort(key)
    if not (held[1:] == held[:-1]).any():
        return starts, runs, fars
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    later = order[1:][same]
    rank = np.argsort(later)
    before = order[:-1][same][rank].tolist()
    free = 0
    for c, j in zip(later[rank].tolist(), before):
        if c < free:
            continue
        run, step = 0, 16
        while run < 4_096:
            differ = flat[c + run : c + run + step] != flat[j + run : min(n, j + run + step)][: max(0, n - c - run)]
            if differ.any():
                run += int(differ.argmax())
                break
            run += len(differ)
            if c + run >= n:
                break
            step = min(2 * step, 4_096 - run)
        if run >= MATCH:
            starts.append(c)
            runs.append(run)
            fars.append(c - j)
            free = c + run
    return starts, runs, fars


def _entropy(counts: np.ndarray) -> float:
    """Bits that an ideal code spends on symbols that occur so often."""
    held = counts[counts > 0].astype(np.float64)
    total = float(np.add.reduce(held))
    return total * math.log2(total) - float(np.add.reduce(held * np.log2(held))) if total else 0.0


def _cached(flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key of each pixel, whether the cache holds the pixel when its turn comes)."""
    key = ((flat.astype(np.uint64) * np.uint64(CACHE_MULTIPLIER) & np.uint64(0xFFFFFFFF)) >> np.uint64(32 - CACHE_BITS)).astype(np.uint16)
    order = np.argsort(key, kind="stable")
    hit = np.zeros(len(flat), bool)
    hit[order[1:]] = (key[order[1:]] == key[order[:-1]]) & (flat[order[1:]] == flat[order[:-1]])
    return key, hit


@functools.lru_cache(maxsize=64)
def _near_codes(width: int) -> dict[int, int]:
    out: dict[int, int] = {}
    for k, (x, y) in enumerate(NEAR):
        if x + y * width > 0:
            out.setdefault(x + y * width, k + 1)
    return out


def _put_image(out: Out, pixels: np.ndarray, main: bool) -> None:
    """An entropy-coded image: references, cache codes where they pay, literals."""
    flat = np.ascontiguousarray(pixels).ravel()
    if not main and (flat == flat[0]).all():  # codes of one symbol each: pixels take no bits
        out.put(0, 1)
        for symbol in (int(flat[0]) >> 8 & 255, int(flat[0]) >> 16 & 255, int(flat[0]) & 255, int(flat[0]) >> 24, 0):
            _put_single(out, symbol)
        return
    starts, runs, fars = _matches(flat)
    literal = np.ones(len(flat), bool)
    for c, run in zip(starts, runs):
        literal[c : c + run] = False
    at = np.flatnonzero(literal)
    each = np.ascontiguousarray(flat[at].astype("<u4")).view(np.uint8).reshape(-1, 4)
    planes = [each[:, k] for k in (1, 2, 0, 3)]  # green, red, blue, alpha
    counts = [np.bincount(plane, minlength=256) for plane in planes]
    cache_size, held = 0, np.zeros(len(at), bool)
    if main and len(at) > 64:  # the cache is weighed where a quarter of the pixels would come from it
        key, hit = _cached(flat)
        hit = hit[at]
        if 4 * np.count_nonzero(hit) > len(hit):
            rest = [np.bincount(plane[~hit], minlength=256) for plane in planes]
            keys = np.bincount(key[at][hit], minlength=1 << CACHE_BITS)
            spent = _entropy(np.concatenate([rest[0], keys])) + sum(map(_entropy, rest[1:])) + 4 * int((keys > 0).sum())
            if spent < 0.9 * sum(map(_entropy, counts)):
                cache_size, held, counts = 1 << CACHE_BITS, hit, rest
    far_counts, greens = np.zeros(40, np.int64), [counts[0], np.zeros(LENGTHS, np.int64)]
    if starts:
        near = _near_codes(pixels.shape[1])
        run_symbol, run_extra, run_more = _split(np.array(runs, np.int64))
        far_symbol, far_extra, far_more = _split(np.array([near.get(d, d + len(NEAR)) for d in fars], np.int64))
        far_counts, greens[1] = np.bincount(far_symbol, minlength=40), np.bincount(run_symbol, minlength=LENGTHS)
    if cache_size:
        greens.append(np.bincount(key[at][held], minlength=cache_size))
    out.put(1 if cache_size else 0, 1)
    if cache_size:
        out.put(CACHE_BITS, 4)
    if main:
        out.put(0, 1)
    words, sizes = zip(
        *[_put_code(out, c, a) for c, a in zip([np.concatenate(greens), *counts[1:], far_counts], (256 + LENGTHS + cache_size, 256, 256, 256, 40))]
    )
    head = planes[0]
    if cache_size:
        head = np.where(held, 256 + LENGTHS + key[at].astype(np.int64), head)
    value, size = words[0][head], sizes[0][head].astype(np.uint64)
    for code, length, plane in zip(words[1:4], sizes[1:4], planes[1:]):
        if not length.any():
            continue
        more, n = code[plane] << size, length[plane].astype(np.uint64)
        if cache_size:
            more[held], n[held] = 0, 0
        value |= more
        size += n
    if starts:
        ref, n = words[0][256 + run_symbol], sizes[0][256 + run_symbol].astype(np.uint64)
        for code, length in ((run_extra, run_more), (words[4][far_symbol], sizes[4][far_symbol]), (far_extra, far_more)):
            ref = ref | code << n
            n = n + length.astype(np.uint64)
        order = np.argsort(np.concatenate([at, starts]), kind="stable")
        value, size = np.concatenate([value, ref])[order], np.concatenate([size, n])[order]
    out.extend(value, size.astype(np.uint8))


def _spread(samples: np.ndarray, where: np.ndarray, cells: int) -> np.ndarray:
    """Bits that the samples of each cell spend, by the collision entropy of their counts."""
    counts = np.bincount((where + samples).ravel(), minlength=256 * cells).reshape(cells, 256)
    total = counts.sum(1)
    return total * np.log2(np.maximum(total * total, 1) / np.maximum((counts * counts).sum(1), 1))


def _put_predictor(out: Out, rgb: np.ndarray) -> np.ndarray:
    """Choose and write modes by tile; what is left of samples uint8 [h, w, 3], modulo 256."""
    height, width, _ = rgb.shape
    size_bits = 5 if height <= 1_024 else 9
    across = (width + (1 << size_bits) - 1) >> size_bits
    tile = (np.arange(height)[:, None] >> size_bits) * across + (np.arange(width)[None, :] >> size_bits)
    tiles = int(tile[-1, -1]) + 1
    left = rgb.copy()
    if height > 1:  # the first row and column have modes of their own
        here, where = rgb[1:, 1:], 256 * (3 * tile[1:, 1:, None] + np.arange(3))
        rests = [here, here - rgb[1:, :-1], here - rgb[:-1, 1:]]
        costs = [_spread(rest, where, 3 * tiles).reshape(tiles, 3).sum(1) for rest in rests]
        chosen = np.argmin(costs, axis=0)
        modes = {*chosen.tolist()}
        if len(modes) == 1:
            left[1:, 1:] = rests[modes.pop()]
        for k in modes - {0}:
            inside = (chosen == k)[tile[1:, 1:]]
            left[1:, 1:][inside] = rests[k][inside]
        left[1:, 0] = rgb[1:, 0] - rgb[:-1, 0]
    else:
        chosen = np.zeros(tiles, np.int64)
    best = np.array(MODES)[chosen]
    left[0, 1:] = rgb[0, 1:] - rgb[0, :-1]
    out.put(1, 1)
    out.put(0, 2)
    out.put(size_bits - 2, 3)
    _put_image(out, (np.uint32(BLACK) | best.astype(np.uint32) << np.uint32(8)).reshape(-1, across), False)
    return left


def _put_colour(out: Out, rgb: np.ndarray) -> np.ndarray:
    """Choose and write the multipliers that shorten the code; what is left of samples uint8 [h, w, 3]."""
    height, width, _ = rgb.shape
    red, green, blue = (np.ascontiguousarray(rgb[..., c]).view(np.int8) for c in range(3))
    floats = {id(x): x.ravel().astype(np.float32) for x in (red, green, blue)}

    def crowding(samples: np.ndarray) -> int:
        """Squares of the counts, added up: the more, the fewer bits samples spend."""
        counts = np.bincount(samples.view(np.uint8).ravel(), minlength=256)
        return int(counts @ counts)

    def choose(of: np.ndarray, by: np.ndarray) -> tuple[int, np.ndarray]:
        """Multiplier, and ``of`` (8 bits, signed) less its share of ``by``."""
        x, y = floats.get(id(of), None), floats[id(by)]
        x = of.ravel().astype(np.float32) if x is None else x
        shared, varies, own = float(x @ y), float(y @ y), float(x @ x)
        if 8 * shared * shared < varies * own or not shared:
            return 0, of
        k = int(np.clip(np.rint(32 * shared / varies), -128, 127))
        if not k:
            return 0, of
        less = (of - (np.int16(k) * by.astype(np.int16) >> 5)).astype(np.int8)
        if crowding(less) > crowding(of):
            return k, less
        return 0, of

    to_red, less_red = choose(red, green)
    to_blue, less_blue = choose(blue, green)
    red_blue, less_blue = choose(less_blue, red)
    if not (to_red or to_blue or red_blue):
        return rgb
    size_bits = 9
    tiles = ((height + 511) >> size_bits, (width + 511) >> size_bits)
    element = BLACK | (red_blue & 255) << 16 | (to_blue & 255) << 8 | (to_red & 255)
    out.put(1, 1)
    out.put(1, 2)
    out.put(size_bits - 2, 3)
    _put_image(out, np.full(tiles, element, np.uint32), False)
    return np.stack([less_red.view(np.uint8), rgb[..., 1], less_blue.view(np.uint8)], 2)


def _put_palette(out: Out, colours: np.ndarray, index: np.ndarray) -> np.ndarray:
    """Write a palette; the pixels of bundled indices."""
    height, width = index.shape
    pack = 3 if len(colours) <= 2 else 2 if len(colours) <= 4 else 1 if len(colours) <= 16 else 0
    out.put(1, 1)
    out.put(3, 2)
    out.put(len(colours) - 1, 8)
    steps = _channels(colours[None, :]).astype(np.int16)
    steps[:, 1:] -= steps[:, :-1].copy()
    _put_image(out, _packed((steps & 255).astype(np.uint8)), False)
    wide = -(-width >> pack) if pack else width
    padded = np.zeros((height, wide << pack), np.uint32)
    padded[:, :width] = index
    depth = 8 >> pack
    bundled = (padded.reshape(height, wide, 1 << pack) << (np.arange(1 << pack, dtype=np.uint32) * depth)).sum(2).astype(np.uint32)
    return np.uint32(BLACK) | bundled << np.uint32(8)


def encode_rgb(samples: np.ndarray) -> bytes:
    """VP8L content for uint8 [height, width, 3] of red, green and blue."""
    height, width, _ = samples.shape
    out = Out()
    for value, size in ((0x2F, 8), (width - 1, 14), (height - 1, 14), (0, 4)):
        out.put(value, size)
    plane = samples.astype(np.uint32)
    pixels = np.uint32(BLACK) | plane[..., 0] << np.uint32(16) | plane[..., 1] << np.uint32(8) | plane[..., 2]
    colours = np.sort(pixels, axis=None)
    colours = colours[np.append(True, colours[1:] != colours[:-1])]
    if len(colours) <= 256 and 3 * len(colours) <= pixels.size:
        pixels = _put_palette(out, colours, np.searchsorted(colours, pixels))
    else:
        rest = _put_colour(out, _put_predictor(out, samples)).astype(np.uint32)
        pixels = rest[..., 0] << np.uint32(16) | rest[..., 1] << np.uint32(8) | rest[..., 2]
    out.put(0, 1)
    _put_image(out, pixels, True)
    return out.bytes()


def _chunk(name: bytes, content: bytes) -> bytes:
    return name + struct.pack("<I", len(content)) + content + b"\0" * (len(content) % 2)


def store(payload: bytes) -> bytes:
    """A WebP file (or several, appended) holding ``payload``."""
    out = []
    for begin in range(0, max(1, len(payload)), SIDE * UNIT):
        piece = payload[begin : begin + SIDE * UNIT]
        rows = max(1, -(-len(piece) // UNIT))
        samples = np.zeros(rows * UNIT, np.uint8)
        samples[: len(piece)] = np.frombuffer(piece, np.uint8)
        image = encode_rgb(samples.reshape(rows, 64, 3))
        frame = b"\0" * 4 + (63).to_bytes(3, "little") + (rows - 1).to_bytes(3, "little")
        body = b"WEBP" + _chunk(b"VP8X", frame) + _chunk(b"VP8L", image) + _chunk(b"TXLN", struct.pack("<Q", len(piece)))
        out.append(b"RIFF" + struct.pack("<I", len(body)) + body)
    return b"".join(out)


def fetch(data: bytes) -> tuple[bytes, list[np.ndarray]]:
    """(payload, RGB sample arrays of the images) read back from ``store``'s bytes."""
    parts, images = [], []
    while data:
        found, end = chunks(data)
        pixels = _channels(decode_vp8l(found[b"VP8L"]))
        rgb = np.ascontiguousarray(pixels[..., 2::-1])
        images.append(rgb)
        parts.append(rgb.tobytes()[: struct.unpack("<Q", found[b"TXLN"])[0]])
        data = data[end:]
    return b"".join(parts), images


def payload_of(text: str | None) -> tuple[bytes, int]:
    """(UTF-8 bytes padded with spaces to a positive multiple of 192, bytes before)."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + b" " * (-len(raw) % UNIT or (0 if raw else UNIT)), len(raw)


def features(images: list[np.ndarray]) -> str:
    """Size, mean and spread of each channel, and sample entropy, as text."""
    value = np.arange(256)
    counts = np.stack([sum(np.bincount(i[..., c].ravel(), minlength=256) for i in images) for c in range(3)])
    size = counts.sum(1)
    mean = counts @ value / size
    spread = np.sqrt(np.maximum(counts @ (value * value) / size - mean * mean, 0))
    p = counts.sum(0)[counts.sum(0) > 0] / counts.sum()
    shape = "+".join(f"{i.shape[1]}x{i.shape[0]}" for i in images)
    return f"{shape};mean={','.join(f'{v:.4f}' for v in mean)};std={','.join(f'{v:.4f}' for v in spread)};entropy={abs(float(-(p * np.log2(p)).sum())):.4f}"


def media(df: DataFrame, key: str = "doc_id", text: str = "text", keep_bytes: bool = False) -> DataFrame:
    """One row per input row: the stored form's figures, optionally its bytes.

    Null and empty texts are one row of spaces.
    """

    def run(part: pa.RecordBatch) -> dict:
        rows = []
        seen: dict[str, tuple] = {}
        for t in part.column(text).to_pylist():
            t = t or ""
            if t not in seen:
                payload, n = payload_of(t)
                stored = store(payload)
                back, images = fetch(stored)
                if back != payload:
                    raise FormatError("the stored bytes do not give the payload back")
                seen[t] = (n, len(back), sha256_hex(back), zlib.crc32(back[-16:]), len(stored), sha256_hex(stored), features(images), stored)
            rows.append(seen[t])
        names = ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "media")
        return {key: part.column(key)} | {n: [r[k] for r in rows] for k, n in enumerate(names) if keep_bytes or n != "media"}

    kind = df.schema[key].dataType.simpleString()
    ddl = f"{key} {kind}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"
    return map_slices(df.select(key, text), run, ddl + (", media binary" if keep_bytes else ""), text)
