"""Media columns as lossless WebP (VP8L): decoding to pixel arrays, and an encoder for storing.

The decoder reads prefix codes (simple and normal, one group or several by an entropy image),
back-references and the colour cache, and inverts the predictor, cross-colour, subtract-green
and palette transforms in the reverse of the order in which they were applied.

Its fast path is for images with one group of codes and no cache: for a slice of the stream
the place where a pixel ends is computed for every bit at which one might begin, at once for
all bits; decoding is then one step from place to place for each literal pixel, and only
back-references are read one by one. Memory is bounded by SLICE_BITS, not by the image.

A payload is stored three bytes a pixel (red, green, blue), WIDTH pixels a row, and in several
images if it needs more than MAX_ROWS rows. Every image is stored with all of the format's means:
the predictor, subtract-green and cross-colour transforms, a colour cache, groups of prefix codes
by blocks, back-references for runs, and a palette before them if its colours are few. Each block
has the cross-colour factors (of FACTORS) and the predictor (of all 14) that take the fewest bits, by
the entropies of the image's residues in one row of SAMPLE_ROWS. Predictors that take equally many, as
all do in a first row, where the format has its own, go round from block to block, from a first one
that follows from the payload's checksum (SHARES). On text the black predictor wins most blocks.

``store_many`` and ``decode_many`` do in numpy, for up to LANES images side by side, what ``encode``
and ``decode`` do for one: each step reads a token of every stream, or adds a prediction to a pixel
of every row. Streams of other encoders that don't fit that go through ``decode``.

Null texts count as empty, so their payload is PAD alone. Equal texts give equal bytes. Texts of
any length are stored whole. An empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import struct
import zlib
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulith.llm.common import released, staged

PAD, UNIT = 255, 576
WIDTH = UNIT // 3
MAX_ROWS = 1 << 14
SLICE_BITS = 1 << 20
RUN_LEAST, RUN_SHARE, COPY_MOST = 6, 4, 4096
SHARES, SHARE_BITS, CACHE_BITS = 256, 5, 6
LANES, LANE_PIXELS, STORE_PIXELS, SLICE_BYTES, LEAST_LANES, TABLE_BITS, CODE_BITS = 4096, 1 << 22, 1 << 18, 8 << 20, 4, 11, 9
GREENS, LENGTHS, DISTANCES = 256, 24, 40
SAMPLE_ROWS, FACTORS = 8, (-32, -24, -16, -8, 0, 8, 16, 24)
# Fixed values of the format: the order of the code lengths of code lengths, and the hash factor of the colour cache.
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
CACHE_FACTOR = 0x1E35A7BD
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = range(4)
#: Short distances by code: the nearest of 120 places above or to the left come first.
NEAR = sorted(((x, y) for y in range(8) for x in range(-7, 9) if y or x > 0), key=lambda p: (p[0] ** 2 + p[1] ** 2, abs(p[0]), -p[0]))


BLACK = np.array([0, 0, 0, 255], dtype=np.int16)


class Corrupt(ValueError):
    """The bytes aren't a lossless WebP image."""


def _blocks(n: int, bits: int) -> int:
    return (n + (1 << bits) - 1) >> bits


# ---- prefix codes -----------------------------------------------------------------------


def code_lengths(counts: np.ndarray, longest: int = 15) -> list[int]:
    """Huffman code lengths, none above ``longest``; counts are halved until that holds."""
    lengths = [0] * len(counts)
    used = np.flatnonzero(counts).tolist()
    if len(used) < 2:
        for i in used:
            lengths[i] = 1
        return lengths
    weights = [int(counts[i]) for i in used]
    while True:
        n = len(used)
        parent = [0] * (2 * n - 1)
        heap = [(w, i) for i, w in enumerate(weights)]
        heapq.heapify(heap)
        for node in range(n, 2 * n - 1):
            w, a = heapq.heappop(heap)
            v, b = heap[0]
            parent[a] = parent[b] = node
            heapq.heapreplace(heap, (w + v, node))
        depth = [0] * (2 * n - 1)
        for node in range(2 * n - 3, -1, -1):
            depth[node] = depth[parent[node]] + 1
        if max(depth[:n]) <= longest:
            for i, d in zip(used, depth, strict=False):
                lengths[i] = d
            return lengths
        weights = [(w + 1) // 2 for w in weights]


@lru_cache(maxsize=16)
def _reversed(bits: int) -> np.ndarray:
    """All numbers of so many bits, in reversed order of bits."""
    x = np.arange(1 << bits, dtype=np.int64)
    out = np.zeros_like(x)
    for k in range(bits):
        out |= (x >> k & 1) << (bits - 1 - k)
    return out


@lru_cache(maxsize=64)
def _codewords(lengths: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Each symbol's code, first bit lowest, and its length in the stream (0 if it is the only symbol)."""
    size = np.frombuffer(lengths, dtype=np.uint8).astype(np.int64)
    code = np.zeros(len(size), dtype=np.uint64)
    used = np.flatnonzero(size)
    if len(used) == 1:
        return code, np.zeros(len(size), dtype=np.int64)
    used = used[np.argsort(size[used], kind="stable")]
    bits = int(size[used[-1]])
    width = 1 << (bits - size[used])  # of the codes of ``bits`` bits that begin with the symbol's
    code[used] = _reversed(bits)[np.cumsum(width) - width]
    return code, size


class Code:
    """Decoding table: by the next ``bits`` bits the symbol and the length of its code."""

    __slots__ = ("bits", "only", "size", "symbol")

    def __init__(self, lengths: bytes):
        size = np.frombuffer(lengths, dtype=np.uint8).astype(np.int32)
        used = np.flatnonzero(size)
        if not len(used):
            raise Corrupt("a prefix code without symbols")
        self.only = int(used[0]) if len(used) == 1 else None
        if self.only is not None:
            self.bits, self.symbol, self.size = 0, used.astype(np.int32), np.zeros(1, dtype=np.int32)
            return
        used = used[np.argsort(size[used], kind="stable")].astype(np.int32)
        self.bits = int(size[used[-1]])
        width = 1 << (self.bits - size[used])
        if width.sum() != 1 << self.bits:
            raise Corrupt("an incomplete prefix code")
        turned = _reversed(self.bits)
        self.symbol = np.repeat(used, width)[turned]
        self.size = size[self.symbol]


@lru_cache(maxsize=256)
def _table(lengths: bytes) -> Code:
    return Code(lengths)


# ---- reading ----------------------------------------------------------------------------


class Reader:
    def __init__(self, data: bytes):
        self.data, self.at, self.end = data, 0, 8 * len(data)
        self.told = (0, 0, b"")  # the last code whose number of lengths was given: its size, its bits, its lengths

    def peek(self, n: int) -> int:
        k = self.at >> 3
        return int.from_bytes(self.data[k : k + 8], "little") >> (self.at & 7) & ((1 << n) - 1)

    def read(self, n: int) -> int:
        value = self.peek(n)
        self.at += n
        if self.at > self.end:
            raise Corrupt("the stream ends early")
        return value

    def symbol(self, code: Code) -> int:
        if code.only is not None:
            return code.only
        k = self.peek(code.bits)
        self.at += int(code.size[k])
        if self.at > self.end:
            raise Corrupt("the stream ends early")
        return int(code.symbol[k])

    def value(self, prefix: int) -> int:
        """A length or distance: its prefix gives the size and the first bits."""
        if prefix < 4:
            return prefix + 1
        extra = (prefix - 2) >> 1
        return ((2 + (prefix & 1)) << extra) + self.read(extra) + 1

    def bits(self, at: int, n: int) -> int:
        k = at >> 3
        return int.from_bytes(self.data[k : k + (n >> 3) + 2], "little") >> (at & 7) & ((1 << n) - 1)

    def code(self, symbols: int) -> Code:
        size, value, known = self.told
        if size and self.bits(self.at, size) == value and not any(known[symbols:]):  # told once more
            self.at += size
            if self.at > self.end:
                raise Corrupt("the stream ends early")
            return _table(known[:symbols].ljust(symbols, b"\0"))
        lengths = bytearray(symbols)
        if self.read(1):
            two, wide = self.read(1), self.read(1)
            own = [self.read(8 if wide else 1)] + ([self.read(8)] if two else [])
            for s in own:
                if s >= symbols:
                    raise Corrupt("a symbol outside of the alphabet")
                lengths[s] = 1
            return _table(bytes(lengths))
        begin = self.at - 1
        of_lengths = bytearray(19)
        for i in range(4 + self.read(4)):
            of_lengths[LENGTH_ORDER[i]] = self.read(3)
        code = _table(bytes(of_lengths))
        limited = self.read(1)
        left = 2 + self.read(2 + 2 * self.read(3)) if limited else symbols
        symbol, size, mask = code.symbol.tolist(), code.size.tolist(), (1 << code.bits) - 1
        held, have = 0, 0  # bits taken from the stream, but not yet used
        k, at, last = self.at >> 3, 0, 8
        skip = self.at & 7
        while at < symbols and left:
            left -= 1
            if have < 32 + skip:
                held |= int.from_bytes(self.data[k : k + 32], "little") << have
                have += 256
                k += 32
                if skip:
                    held, have, skip = held >> skip, have - skip, 0
            w = held & mask
            n = symbol[w]
            used = size[w]
            if n < 16:
                lengths[at] = n
                at += 1
                if n:
                    last = n
            else:
                extra = 2 if n == 16 else 3 if n == 17 else 7
                times = (11 if n == 18 else 3) + (held >> used & ((1 << extra) - 1))
                used += extra
                if at + times > symbols:
                    raise Corrupt("code lengths beyond the alphabet")
                if n == 16:
                    lengths[at : at + times] = bytes([last]) * times
                at += times
            held >>= used
            have -= used
            self.at += used
        if self.at > self.end:
            raise Corrupt("the stream ends early")
        if limited:
            self.told = (self.at - begin, self.bits(begin, self.at - begin), bytes(lengths))
        return _table(bytes(lengths))


def _copy(out: np.ndarray, at: int, length: int, back: int) -> None:
    """out[at:at + length] from ``back`` places before; the two may overlap."""
    if back > at or at + length > len(out):
        raise Corrupt("a back-reference outside of the image")
    done = 0
    while done < length:  # what is copied may be copied again
        n = min(back + done, length - done)
        out[at + done : at + done + n] = out[at - back : at - back + n]
        done += n


def _distance(r: Reader, code: Code, width: int) -> int:
    d = r.value(r.symbol(code))
    if d > len(NEAR):
        return d - len(NEAR)
    x, y = NEAR[d - 1]
    return max(1, x + y * width)


def _one_group(r: Reader, codes: list[Code], width: int, n: int) -> np.ndarray:
    """n pixels by one group of codes without a colour cache."""
    out = np.empty(n, dtype=np.uint32)
    done = 0
    while done < n:
        # the places of a slice, from the byte in which the next pixel begins
        first = r.at >> 3
        raw = np.frombuffer(r.data[first : first + SLICE_BITS // 8 + 16] + bytes(16), dtype=np.uint8).astype(np.uint32)
        window = ((raw[:-2] | raw[1:-1] << 8 | raw[2:] << 16)[:, None] >> np.arange(8, dtype=np.uint32)).ravel()
        places = len(window) - 64  # from these on all four codes stand in the window
        ends, at_code, widths = np.arange(len(window), dtype=np.int32), [], {}
        for code in codes[:4]:
            at_code.append(ends)
            if code.only is None:
                key = code.size.tobytes()
                if key not in widths:
                    widths[key] = code.size[window & ((1 << code.bits) - 1)]
                    widths[key][places:] = 0
                ends = ends + (widths[key][ends] if at_code[1:] else widths[key])
        green = codes[0]
        literal = green.symbol < GREENS
        if not literal.all():
            ends = np.where(literal[window & ((1 << green.bits) - 1)], ends, np.int32(-1))
        step = memoryview(ends)
        p, last = r.at - 8 * first, min(places, SLICE_BITS)
        while done < n:
            begins: list[int] = []
            add, left = begins.append, n - done
            while left and p < last:
                q = step[p]
                if q < 0:
                    break
                add(p)
                p = q
                left -= 1
            if begins:
                at = np.array(begins)
                parts = []
                for code, where in zip(codes, at_code, strict=False):
                    parts.append(np.uint32(code.only) if code.only is not None else code.symbol[window[where[at]] & ((1 << code.bits) - 1)].astype(np.uint32))
                out[done : done + len(at)] = parts[3] << np.uint32(24) | parts[1] << np.uint32(16) | parts[0] << np.uint32(8) | parts[2]
                done += len(at)
            r.at = 8 * first + p
            if r.at > r.end:
                raise Corrupt("the stream ends early")
            if done == n or p >= last:
                break
            length = r.value(r.symbol(green) - GREENS)
            _copy(out, done, length, _distance(r, codes[4], width))
            done += length
            p = r.at - 8 * first
    return out


def _many_groups(r: Reader, groups: list[list[Code]], of: np.ndarray | None, bits: int, cache_bits: int, width: int, n: int) -> np.ndarray:
    """n pixels by the group of each pixel's block, with a colour cache where there is one."""
    out = np.empty(n, dtype=np.uint32)
    cache = [0] * (1 << cache_bits) if cache_bits else []
    shift = 32 - cache_bits
    done, across = 0, _blocks(width, bits) if of is not None else 1
    while done < n:
        y, x = divmod(done, width)
        codes = groups[int(of[(y >> bits) * across + (x >> bits)])] if of is not None else groups[0]
        s = r.symbol(codes[0])
        if s < GREENS:
            red, blue, alpha = (r.symbol(c) for c in codes[1:4])
            out[done] = alpha << 24 | red << 16 | s << 8 | blue
            count = 1
        elif s < GREENS + LENGTHS:
            count = r.value(s - GREENS)
            _copy(out, done, count, _distance(r, codes[4], width))
        else:
            out[done] = cache[s - GREENS - LENGTHS]
            count = 1
        if cache_bits:
            for v in out[done : done + count].tolist():
                cache[(CACHE_FACTOR * v & 0xFFFFFFFF) >> shift] = v
        done += count
    return out


def _image(r: Reader, width: int, height: int, main: bool) -> np.ndarray:
    """An entropy-coded image: its pixels in one row."""
    cache_bits = r.read(4) if r.read(1) else 0
    if cache_bits > 11:
        raise Corrupt("too large a colour cache")
    of, bits, groups = None, 0, 1
    if main and r.read(1):
        bits = r.read(3) + 2
        of = _image(r, _blocks(width, bits), _blocks(height, bits), False) >> np.uint32(8) & np.uint32(0xFFFF)
        groups = int(of.max()) + 1
    sizes = (GREENS + LENGTHS + (1 << cache_bits if cache_bits else 0), 256, 256, 256, DISTANCES)
    codes = [[r.code(s) for s in sizes] for _ in range(groups)]
    if groups == 1 and not cache_bits:
        return _one_group(r, codes[0], width, width * height)
    return _many_groups(r, codes, of, bits, cache_bits, width, width * height)


# ---- transforms -------------------------------------------------------------------------


def _channels(argb: np.ndarray) -> np.ndarray:
    """Four bytes a pixel, as integers that hold sums: blue, green, red, alpha."""
    return np.ascontiguousarray(argb).view(np.uint8).reshape(*argb.shape, 4).astype(np.int16)


def _joined(channels: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(channels.astype(np.uint8)).view(np.uint32)[..., 0]


def predicted(mode: int, left: np.ndarray, top: np.ndarray, top_right: np.ndarray, top_left: np.ndarray) -> np.ndarray:
    """What one of the 14 predictors expects of pixels, given their neighbours' channels."""
    mean = lambda a, b: (a + b) >> 1
    if mode == 1:
        return left
    if mode == 2:
        return top
    if mode == 3:
        return top_right
    if mode == 4:
        return top_left
    if mode == 5:
        return mean(mean(left, top_right), top)
    if mode == 6:
        return mean(left, top_left)
    if mode == 7:
        return mean(left, top)
    if mode == 8:
        return mean(top_left, top)
    if mode == 9:
        return mean(top, top_right)
    if mode == 10:
        return mean(mean(left, top_left), mean(top, top_right))
    if mode == 11:
        to_left, to_top = (np.abs(x - top_left).sum(axis=-1, keepdims=True) for x in (top, left))
        return np.where(to_left < to_top, left, top)
    if mode == 12:
        return np.clip(left + top - top_left, 0, 255)
    if mode == 13:
        half = mean(left, top)
        off = half - top_left
        return np.clip(half + np.where(off < 0, -(-off >> 1), off >> 1), 0, 255)
    return np.broadcast_to(BLACK, left.shape)


def _modes(image: np.ndarray, bits: int, x: int, y: int) -> np.ndarray:
    """The value of each pixel's block."""
    return np.repeat(np.repeat(image, 1 << bits, axis=0)[:y], 1 << bits, axis=1)[:, :x]


def add_predictions(residue: np.ndarray, modes: np.ndarray, bits: int) -> np.ndarray:
    """Pixels from residues. Rows go one after another; within a row only what needs its left neighbour goes pixel by pixel."""
    height, width = residue.shape
    mode = _modes((modes >> np.uint32(8) & np.uint32(15)).astype(np.int64), bits, width, height)
    out = _channels(residue)
    out[0, 0, 3] = (out[0, 0, 3] + 255) & 255
    out[0] = np.cumsum(out[0], axis=0, dtype=np.int64) & 255
    for y in range(1, height):
        above, row = out[y - 1], out[y]
        row[0] = (row[0] + above[0]) & 255
        if width == 1:
            continue
        # the pixel above and to the right of the last one is the first of its own row
        right = np.concatenate([above[2:], row[:1]])
        free = np.isin(mode[y, 1:], (0, 2, 3, 4, 8, 9, 14, 15))
        for m in np.unique(mode[y, 1:][free]).tolist():
            at = np.flatnonzero(mode[y, 1:] == m)
            row[at + 1] = (row[at + 1] + predicted(m, above[at], above[at + 1], right[at], above[at])) & 255
        for x in np.flatnonzero(~free).tolist():
            row[x + 1] = (row[x + 1] + predicted(int(mode[y, x + 1]), row[x], above[x + 1], right[x], above[x])) & 255
    return _joined(out)


def take_predictions(argb: np.ndarray, modes: np.ndarray, bits: int) -> np.ndarray:
    """Residues of pixels: the inverse of add_predictions."""
    height, width = argb.shape
    mode = _modes((modes >> np.uint32(8) & np.uint32(15)).astype(np.int64), bits, width, height)
    c = _channels(argb)
    flat = c.reshape(-1, 4)
    place = np.arange(height * width)
    left, top, right, corner = (flat[np.maximum(place - k, 0)].reshape(c.shape) for k in (1, width, width - 1, width + 1))
    want = np.zeros_like(c)
    for m in np.unique(mode).tolist():
        want = np.where((mode == m)[..., None], predicted(m, left, top, right, corner), want)
    want[:, 0], want[0] = top[:, 0], left[0]
    want[0, 0] = (0, 0, 0, 255)
    return _joined((c - want) & 255)


def cross_colour(argb: np.ndarray, factors: np.ndarray, bits: int, sign: int) -> np.ndarray:
    """sign 1 adds what green says of red and blue, and red of blue (decoding); -1 takes it away."""
    return _crossed(argb, _modes(factors, bits, argb.shape[1], argb.shape[0]), sign)


def _crossed(argb: np.ndarray, f: np.ndarray, sign: int) -> np.ndarray:
    """cross_colour with the factors of each pixel."""
    signed = lambda x: (x & np.uint32(255)).astype(np.uint8).view(np.int8).astype(np.int32)
    green, red, blue = signed(argb >> np.uint32(8)), (argb >> np.uint32(16) & np.uint32(255)).astype(np.int32), (argb & np.uint32(255)).astype(np.int32)
    changed = (red + sign * (signed(f) * green >> 5)) & 255
    original = changed if sign > 0 else red
    of_red = original.astype(np.uint8).view(np.int8).astype(np.int32)
    blue = (blue + sign * (signed(f >> np.uint32(8)) * green >> 5) + sign * (signed(f >> np.uint32(16)) * of_red >> 5)) & 255
    return argb & np.uint32(0xFF00FF00) | changed.astype(np.uint32) << np.uint32(16) | blue.astype(np.uint32)


def shift_green(argb: np.ndarray, sign: int) -> np.ndarray:
    c = _channels(argb)
    c[..., 0] = (c[..., 0] + sign * c[..., 1]) & 255
    c[..., 2] = (c[..., 2] + sign * c[..., 1]) & 255
    return _joined(c)


def _bundle_bits(colours: int) -> int:
    """How many palette indices share a pixel, as a power of two."""
    return 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0


def from_palette(packed: np.ndarray, palette: np.ndarray, width: int) -> np.ndarray:
    bundle = _bundle_bits(len(palette))
    each = 8 >> bundle
    index = (packed >> np.uint32(8) & np.uint32(255))[..., None] >> (np.arange(1 << bundle, dtype=np.uint32) * np.uint32(each)) & np.uint32((1 << each) - 1)
    colours = np.concatenate([palette, np.zeros(256, dtype=np.uint32)])[:256]  # an index beyond the palette is transparent
    return colours[index.reshape(len(packed), -1)[:, :width]]


# ---- images -----------------------------------------------------------------------------


def _transforms(r: Reader, width: int, height: int, image: Callable) -> tuple[list[tuple], int]:
    """Each transform with the width to which it leads back, its data and the bits of its blocks; and the width of the coded image."""
    todo, x = [], width
    while r.read(1):
        kind = r.read(2)
        if kind in (t[0] for t in todo):
            raise Corrupt("a transform twice")
        if kind in (PREDICTOR, CROSS_COLOUR):
            bits = r.read(3) + 2
            shape = (_blocks(height, bits), _blocks(x, bits))
            todo.append((kind, x, image(r, shape[1], shape[0], False).reshape(shape), bits))
        elif kind == PALETTE:
            n = r.read(8) + 1
            steps = _channels(image(r, n, 1, False))
            palette = _joined(np.cumsum(steps, axis=0, dtype=np.int64) & 255)
            todo.append((kind, x, palette, 0))
            x = _blocks(x, _bundle_bits(n))
        else:
            todo.append((kind, x, None, 0))
    return todo, x


def _opened(data: bytes) -> tuple[Reader, int, int]:
    """The stream behind the file's header, and the image's width and height."""
    if len(data) < 25 or data[:4] != b"RIFF" or data[8:16] != b"WEBPVP8L" or data[20] != 0x2F:
        raise Corrupt("no lossless WebP image")
    r = Reader(data[21 : 20 + struct.unpack("<I", data[16:20])[0]])
    width, height, _, version = r.read(14) + 1, r.read(14) + 1, r.read(1), r.read(3)
    if version:
        raise Corrupt("an unknown version")
    return r, width, height


def decode(data: bytes) -> np.ndarray:
    """The image's pixels, [row, column], as ARGB."""
    r, width, height = _opened(data)
    todo, x = _transforms(r, width, height, _image)
    argb = _image(r, x, height, True).reshape(height, x)
    for kind, own, extra, bits in reversed(todo):
        if kind == PREDICTOR:
            argb = add_predictions(argb, extra, bits)
        elif kind == CROSS_COLOUR:
            argb = cross_colour(argb, extra, bits, 1)
        elif kind == SUBTRACT_GREEN:
            argb = shift_green(argb, 1)
        else:
            argb = from_palette(argb, extra, own)
    return argb


class Writer:
    """Bits, first lowest; numbers are kept with their sizes and packed together at the end."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.sizes: list[int] = []
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []

    def put(self, value: int, size: int) -> None:
        self.values.append(value)
        self.sizes.append(size)

    def put_all(self, values: np.ndarray, sizes: np.ndarray) -> None:
        self._settle()
        self.parts.append((values, sizes))

    def _settle(self) -> None:
        if self.values:
            self.parts.append((np.array(self.values, dtype=np.uint64), np.array(self.sizes, dtype=np.int64)))
            self.values, self.sizes = [], []

    def joined(self) -> tuple[np.ndarray, np.ndarray]:
        self._settle()
        return tuple(np.concatenate(x) for x in zip(*self.parts, strict=True))

    def bytes(self) -> bytes:
        values, sizes = self.joined()
        ends = np.cumsum(sizes)
        out = []
        for lo in range(0, len(values), 1 << 17):  # bounded memory: a byte for each bit
            v, s = values[lo : lo + (1 << 17)], sizes[lo : lo + (1 << 17)]
            place = np.arange(int(s.sum())) - np.repeat(np.cumsum(s) - s, s)
            out.append((np.repeat(v, s) >> place.astype(np.uint64) & np.uint64(1)).astype(np.uint8))
        bits = np.concatenate(out) if out else np.zeros(0, dtype=np.uint8)
        assert len(bits) == ends[-1]
        return np.packbits(bits, bitorder="little").tobytes()


@lru_cache(maxsize=64)
def _header(lengths: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The numbers, and their sizes, that tell a prefix code's lengths."""
    w = Writer()
    used = [i for i, n in enumerate(lengths) if n]
    if len(used) <= 2 and all(i < 256 for i in used):
        used = used or [0]
        for value, size in ((1, 1), (len(used) - 1, 1), (1, 1), *((i, 8) for i in used)):
            w.put(value, size)
        return w.joined()
    runs: list[tuple[int, int, int]] = []  # symbol, extra bits, their number
    i, last = 0, 8
    end = used[-1] + 1
    while i < end:
        n = lengths[i]
        k = i
        while k < end and lengths[k] == n:
            k += 1
        times = k - i
        if n == 0:
            while times >= 11:
                runs.append((18, min(times, 138) - 11, 7))
                times -= min(times, 138)
            if times >= 3:
                runs.append((17, times - 3, 3))
                times = 0
        else:
            if n != last:
                runs.append((n, 0, 0))
                last, times = n, times - 1
            while times >= 3:
                runs.append((16, min(times, 6) - 3, 2))
                times -= min(times, 6)
        runs += [(n, 0, 0)] * times
        i = k
    of_lengths = code_lengths(np.bincount([s for s, _, _ in runs], minlength=19), 7)
    told = max([4, *(k + 1 for k, s in enumerate(LENGTH_ORDER) if of_lengths[s])])
    w.put(0, 1)
    w.put(told - 4, 4)
    for s in LENGTH_ORDER[:told]:
        w.put(of_lengths[s], 3)
    w.put(1, 1)  # how many code lengths follow
    size = max(2, (len(runs) - 2).bit_length() + (len(runs) - 2).bit_length() % 2) if len(runs) > 2 else 2
    w.put((size - 2) // 2, 3)
    w.put(max(0, len(runs) - 2), size)
    told_runs = np.array(runs if len(runs) >= 2 else [*runs, (0, 0, 0)], dtype=np.int64)
    code, n = _codewords(bytes(of_lengths))
    symbol, extra, bits = told_runs.T
    size = n[symbol]
    w.put_all(code[symbol] | (extra << size).astype(np.uint64), size + bits)
    return w.joined()


def _prefix(value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Prefix, number of extra bits and extra bits of lengths and distances from 1."""
    v = np.asarray(value, dtype=np.int64) - 1
    top = np.maximum(1, np.frexp(np.maximum(v, 1).astype(np.float64))[1] - 1)
    extra = np.where(v < 4, 0, top - 1)
    return np.where(v < 4, v, 2 * top + (v >> extra & 1)), extra, np.where(v < 4, 0, v & ((1 << extra) - 1))


def _tokens(flat: np.ndarray, cache_bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each token begins, its length as a back-reference by one pixel (0: none) and its cache index (-1: none)."""
    n = len(flat)
    begins = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))
    runs = np.diff(begins, append=n)
    long = np.flatnonzero(runs > RUN_LEAST)
    if RUN_SHARE * int(runs[long].sum()) < n:  # then one code for all three colours is shorter than another for lengths
        at, length = np.arange(n), np.zeros(n, dtype=np.int64)
    else:
        keep = np.ones(n, dtype=bool)
        length = np.zeros(n, dtype=np.int64)
        for lo, size in zip((begins[long] + 1).tolist(), (runs[long] - 1).tolist(), strict=True):
            keep[lo : lo + size] = False
            for k in range(lo, lo + size, COPY_MOST):
                keep[k], length[k] = True, min(COPY_MOST, lo + size - k)
        at = np.flatnonzero(keep)
        length = length[at]
    cached = np.full(len(at), -1, dtype=np.int64)
    if cache_bits:
        held: dict[int, int] = {}
        for i, (p, k) in enumerate(zip(at.tolist(), length.tolist(), strict=True)):
            v = int(flat[p])
            slot = (CACHE_FACTOR * v & 0xFFFFFFFF) >> (32 - cache_bits)
            if not k and held.get(slot) == v:
                cached[i] = slot
            held[slot] = v
    return at, length, cached


def _write(w: Writer, argb: np.ndarray, main: bool, cache_bits: int = 0, groups: np.ndarray | None = None, bits: int = 2) -> None:
    """An entropy-coded image; groups: the group of each block of 2 ** bits pixels square."""
    flat, width = argb.ravel(), argb.shape[1]
    w.put(cache_bits > 0, 1)
    if cache_bits:
        w.put(cache_bits, 4)
    if main:
        w.put(groups is not None, 1)
        if groups is not None:
            w.put(bits - 2, 3)
            _write(w, groups.astype(np.uint32) << np.uint32(8), False)
    at, length, cached = _tokens(flat, cache_bits)
    own = None if groups is None else _modes(groups.astype(np.int64), bits, width, argb.shape[0]).ravel()[at]
    token = flat[at]
    channel = [(token >> np.uint32(s) & np.uint32(255)).astype(np.int64) for s in (8, 16, 0, 24)]
    first = channel[0].copy()
    first[cached >= 0] = GREENS + LENGTHS + cached[cached >= 0]
    copies = np.flatnonzero(length)
    prefix, extra, low = _prefix(length[copies])
    first[copies] = GREENS + prefix
    sizes = (GREENS + LENGTHS + (1 << cache_bits if cache_bits else 0), 256, 256, 256, DISTANCES)
    near = np.array([NEAR.index((1, 0))])  # the code of distance 1
    values, lengths = np.zeros(len(at), dtype=np.uint64), np.zeros(len(at), dtype=np.int64)
    for g in range(int(groups.max()) + 1 if groups is not None else 1):
        mine = np.arange(len(at)) if own is None else np.flatnonzero(own == g)
        plain = mine[first[mine] < GREENS]
        counts = [np.bincount(first[mine], minlength=sizes[0]), *(np.bincount(channel[k][plain], minlength=256) for k in (1, 2, 3)), np.bincount(near[: len(copies)], minlength=DISTANCES)]
        counts[1] += counts[2]  # red and blue share their code lengths, and green too if it has literals alone
        if len(plain) == len(mine):
            counts[1] += counts[0][:GREENS]
        told = [bytes(code_lengths(c)) if c.any() else bytes([1]) + bytes(sizes[k] - 1) for k, c in enumerate(counts) if k in (1, 3, 4)]
        told.insert(1, told[0])
        told.insert(0, told[0] + bytes(sizes[0] - GREENS) if len(plain) == len(mine) else bytes(code_lengths(counts[0])))
        for lengths_of in told:
            w.put_all(*_header(lengths_of.rstrip(b"\0")))
        code, size = _codewords(told[0])
        values[mine], lengths[mine] = code[first[mine]], size[first[mine]]
        v, s = values[plain], lengths[plain]
        for k in (1, 2, 3):
            code, size = _codewords(told[k])
            if size.any():
                v |= code[channel[k][plain]] << s.astype(np.uint64)
                s += size[channel[k][plain]]
        values[plain], lengths[plain] = v, s
    values[copies] |= low.astype(np.uint64) << lengths[copies].astype(np.uint64)
    lengths[copies] += extra  # the distance has one symbol, so it takes no bits
    w.put_all(values, lengths)


def _palette(argb: np.ndarray) -> np.ndarray | None:
    few = np.sort(argb.ravel()[:600])
    if np.count_nonzero(few[1:] != few[:-1]) > 255:
        return None
    colours = np.unique(argb)
    return colours if len(colours) <= 256 else None


def _tell_palette(w: Writer, palette: np.ndarray) -> None:
    w.put(len(palette) - 1, 8)
    c = _channels(palette)
    _write(w, _joined(np.diff(c, axis=0, prepend=np.zeros((1, 4), dtype=np.int16)) & 255)[None, :], False)


def _packed(argb: np.ndarray, palette: np.ndarray) -> np.ndarray:
    """Indices in the palette, several a pixel where it is small: the inverse of from_palette."""
    height, width = argb.shape
    bundle = _bundle_bits(len(palette))
    across = _blocks(width, bundle)
    padded = np.zeros((height, across << bundle), dtype=np.uint32)
    padded[:, :width] = np.searchsorted(palette, argb)
    shifts = np.arange(1 << bundle, dtype=np.uint32) * np.uint32(8 >> bundle)
    return np.uint32(0xFF000000) | (padded.reshape(height, across, -1) << shifts).sum(axis=2).astype(np.uint32) << np.uint32(8)


def _file(stream: bytes) -> bytes:
    body = b"\x2f" + stream
    chunk = b"VP8L" + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)
    return b"RIFF" + struct.pack("<I", 4 + len(chunk)) + b"WEBP" + chunk


def encode(argb: np.ndarray, transforms: tuple[int, ...] = (), cache_bits: int = 0, groups: np.ndarray | None = None, modes: np.ndarray | None = None, factors: np.ndarray | None = None, bits: int = 2) -> bytes:
    """A lossless WebP file of ARGB pixels [row, column].

    transforms are applied in their order; modes (predictors) and factors (cross-colour) are given
    for blocks of 2 ** bits pixels square, in the form of the format's own images.
    """
    height, width = argb.shape
    w = Writer()
    for value, size in ((width - 1, 14), (height - 1, 14), (bool((argb >> np.uint32(24) != 255).any()), 1), (0, 3)):
        w.put(int(value), size)
    for kind in transforms:
        w.put(1, 1)
        w.put(kind, 2)
        if kind in (PREDICTOR, CROSS_COLOUR):
            w.put(bits - 2, 3)
            _write(w, modes if kind == PREDICTOR else factors, False)
            argb = take_predictions(argb, modes, bits) if kind == PREDICTOR else cross_colour(argb, factors, bits, -1)
        elif kind == SUBTRACT_GREEN:
            argb = shift_green(argb, -1)
        else:
            palette = _palette(argb)
            if palette is None:
                raise ValueError("more than 256 colours")
            _tell_palette(w, palette)
            argb = _packed(argb, palette)
    w.put(0, 1)
    _write(w, argb, True, cache_bits, groups, bits)
    return _file(w.bytes())


# ---- many images at once ----------------------------------------------------------------


def _code_lengths_at_once(counts: np.ndarray, longest: int) -> np.ndarray:
    """Huffman code lengths of each row of counts, none above ``longest``; a row without counts gets its first symbol."""
    used = np.count_nonzero(counts, axis=1)
    lengths = np.zeros(counts.shape, dtype=np.uint8)
    lengths[used == 1] = counts[used == 1] > 0
    lengths[used == 0, 0] = 1
    rows = np.flatnonzero(used > 1)
    if not len(rows):
        return lengths
    rows = rows[np.argsort(-used[rows], kind="stable")]
    used = used[rows]
    most = int(used[0])
    absent = np.int64(1) << 60
    weight = counts[rows] << 12 | np.arange(counts.shape[1])
    weight[counts[rows] == 0] = absent
    weight = np.sort(weight, axis=1)[:, :most]
    order, weight = weight & 4095, weight >> 12
    across = most + 1
    # the two queues of each row: symbols by weight, and nodes in the order in which they are made
    queue = np.full((2, len(rows), across), absent, dtype=np.int64)
    queue[0, :, :most] = np.where(np.arange(most) < used[:, None], weight, absent)
    leaf, node = queue[0].ravel(), queue[1].ravel()
    parent = np.zeros(2 * len(rows) * across, dtype=np.int64)
    to_node = len(rows) * across
    begin = np.arange(len(rows)) * across
    i, j = begin.copy(), begin.copy()
    active = [int(np.searchsorted(-used, -step - 1)) for step in range(most - 1)]  # rows with a node of this number
    for step, n in enumerate(active):
        total = np.zeros(n, dtype=np.int64)
        p, q = i[:n], j[:n]
        for _ in range(2):
            a, b = leaf.take(p), node.take(q)
            first = a <= b
            parent[np.where(first, p, q + to_node)] = step
            total += np.where(first, a, b)
            p += first
            q += ~first
        node[begin[:n] + step] = total
    depth = np.zeros(to_node, dtype=np.int64)
    for step in range(most - 2, -1, -1):
        n = active[step]
        at = begin[:n] + step
        depth[at] = np.where(used[:n] == step + 2, 0, depth.take(begin[:n] + parent.take(at + to_node)) + 1)
    of_leaf = depth.take(begin[:, None] + parent[:to_node].reshape(-1, across)[:, :most]) + 1
    of_leaf[np.arange(most) >= used[:, None]] = 0
    long = of_leaf.max(axis=1) > longest
    at, k = np.nonzero(of_leaf)
    lengths[rows[at], order[at, k]] = np.minimum(of_leaf[at, k], 255)
    rows = rows[long]
    if len(rows) <= LEAST_LANES:
        for i in rows.tolist():
            lengths[i] = code_lengths(counts[i], longest)
    else:
        lengths[rows] = _code_lengths_at_once((counts[rows] + 1) // 2, longest)
    return lengths


def _canonical(lengths: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, symbol, size in the stream and share of 2 ** bits of each used symbol, in the order of codes; rows are complete codes or of one symbol."""
    row, symbol = np.nonzero(lengths)
    order = np.sort(row << 16 | lengths[row, symbol].astype(np.int64) << 12 | symbol)
    row, size, symbol = order >> 16, order >> 12 & 15, order & 4095
    only = (np.bincount(row, minlength=len(lengths)) == 1)[row]
    size[only] = 0
    return row, symbol, size, 1 << (bits - size)


def _codewords_at_once(lengths: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Each row's codes, first bit lowest, and their sizes in the stream."""
    row, symbol, size, width = _canonical(lengths, bits)
    code, sizes = np.zeros(lengths.shape, dtype=np.uint64), np.zeros(lengths.shape, dtype=np.int64)
    code[row, symbol] = _reversed(bits)[(np.cumsum(width) - width) & ((1 << bits) - 1)]
    sizes[row, symbol] = size
    return code, sizes


def _tables_at_once(lengths: np.ndarray, bits: int, bad: np.ndarray) -> np.ndarray:
    """Decoding tables, by the next ``bits`` bits: symbol << 4 | size. Rows that are no code, or of longer ones, become bad."""
    width = np.where((lengths > 0) & (lengths <= bits), 1 << (bits - np.minimum(lengths, bits).astype(np.int64)), 0).sum(axis=1)
    wrong = (lengths.max(axis=1) > bits) | (width != 1 << bits) & (np.count_nonzero(lengths, axis=1) != 1)
    if wrong.any():
        bad |= wrong.reshape(len(bad), -1).any(axis=1)
        lengths = lengths.copy()
        lengths[wrong] = 0
        lengths[wrong, 0] = 1
    _, symbol, size, width = _canonical(lengths, bits)
    return np.repeat((symbol << 4 | size).astype(np.uint16), width).reshape(len(lengths), -1)[:, _reversed(bits)]


class _Numbers:
    """Numbers and their sizes for many streams, section by section; within a section the streams' numbers follow one another."""

    def __init__(self, streams: int):
        self.streams = streams
        self.sections: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, values: np.ndarray, sizes: np.ndarray, counts: np.ndarray) -> None:
        self.sections.append((values, sizes, counts))

    def bytes(self) -> list[bytes]:
        counts = np.stack([c for _, _, c in self.sections], axis=1)
        begins = (np.cumsum(counts) - counts.ravel()).reshape(counts.shape)
        values, sizes = np.zeros(int(counts.sum()), dtype=np.uint64), np.zeros(int(counts.sum()), dtype=np.int64)
        for k, (v, s, c) in enumerate(self.sections):
            at = np.arange(len(v)) + np.repeat(begins[:, k] - (np.cumsum(c) - c), c)
            values[at], sizes[at] = v, s
        self.sections.clear()
        ends = np.cumsum(sizes)
        bits = np.diff(ends[np.cumsum(counts.sum(axis=1)) - 1], prepend=0)
        words = _blocks(bits, 6)
        first = np.cumsum(words) - words  # each stream begins in a word of its own
        place = ends - sizes + np.repeat(64 * first - (np.cumsum(bits) - bits), counts.sum(axis=1))
        word, shift = place >> 6, (place & 63).astype(np.uint64)
        out = np.zeros(int(words.sum()) + 1, dtype=np.uint64)
        begin = np.flatnonzero(np.diff(word, prepend=-1))
        out[word[begin]] = np.bitwise_or.reduceat(values << shift, begin)
        over = np.flatnonzero((place & 63) + sizes > 64)
        out[word[over] + 1] |= values[over] >> (np.uint64(64) - shift[over])
        whole = out.view(np.uint8)
        return [whole[8 * f : 8 * f + n].tobytes() for f, n in zip(first.tolist(), _blocks(bits, 3).tolist(), strict=True)]


def _headers_at_once(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The numbers, and their sizes, that tell each row's code lengths, and how many a row has."""
    n, symbols = lengths.shape
    flat = lengths.ravel().astype(np.int64)
    new = np.concatenate([[True], flat[1:] != flat[:-1]])
    new[::symbols] = True
    begins = np.flatnonzero(new)
    value, times = flat[begins], np.diff(begins, append=len(flat))
    times = np.where(value > 0, times - 1, times)  # after the length itself
    most = np.where(value > 0, 6, 138)
    full, rest = times // most, times % most
    count = (value > 0) + full + np.where(rest >= 3, 1, rest)
    run = np.repeat(np.arange(len(begins)), count)
    k = np.arange(len(run)) - np.repeat(np.cumsum(count) - count, count)
    value, full, rest, most = value[run], full[run], rest[run], most[run]
    k -= value > 0
    times = np.where((k >= 0) & (k < full), most, np.where((k == full) & (rest >= 3), rest, 1))
    symbol = np.where(times < 3, value, np.where(value > 0, 16, np.where(times >= 11, 18, 17)))
    extra = np.where(times < 3, 0, times - np.where(symbol == 18, 11, 3))
    row = begins[run] // symbols
    of_lengths = _code_lengths_at_once(np.bincount(19 * row + symbol, minlength=19 * n).reshape(n, 19), 7)
    code, size = _codewords_at_once(of_lengths, 7)
    in_order = of_lengths[:, LENGTH_ORDER].astype(np.uint64)
    told = np.maximum(4, 19 - np.argmax(in_order[:, ::-1] > 0, axis=1))
    head = (told - 4).astype(np.uint64) << np.uint64(1) | (in_order << (np.arange(19) * 3 + 5).astype(np.uint64)).sum(axis=1, dtype=np.uint64)
    counts = 1 + np.bincount(row, minlength=n)
    first = np.cumsum(counts) - counts
    values, sizes = np.zeros(int(counts.sum()), dtype=np.uint64), np.zeros(int(counts.sum()), dtype=np.int64)
    values[first], sizes[first] = head, 6 + 3 * told  # the last of these bits: all code lengths follow
    at = np.arange(len(row)) + row + 1
    values[at] = code[row, symbol] | extra.astype(np.uint64) << size[row, symbol].astype(np.uint64)
    sizes[at] = size[row, symbol] + np.array([0] * 16 + [2, 3, 7])[symbol]
    return values, sizes, counts


def _rows_of(blocks: list[np.ndarray], heights: np.ndarray, bits: int, width: int) -> np.ndarray:
    """The value of each pixel's block, for images of one width below one another."""
    across = [len(b) for b in blocks]
    first = np.repeat(np.cumsum(across) - across, heights)
    return np.repeat(np.concatenate(blocks)[first + (_within(heights) >> bits)], 1 << bits, axis=1)[:, :width]


def _within(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... for each of the counts."""
    return np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)


def _edged(mode: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Predictors, with those that the format fixes for the first row and column."""
    mode = mode.astype(np.uint8)
    mode[:, 0] = 2
    mode[y == 0] = 1
    mode[y == 0, 0] = 0
    return mode


def _expected(pixels: np.ndarray, at: np.ndarray, mode: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The places in the order of their predictors, and what is expected there. pixels: four int16 in one number."""
    order = np.argsort(mode, kind="stable")
    at = at[order]
    counts = np.bincount(mode, minlength=16)
    black = lo = int(counts[0])  # these need no neighbours
    near = _neighbours(pixels, at[black:], width)
    want = np.empty((len(at), 4), dtype=np.int16)
    want[:black] = BLACK
    for m in (np.flatnonzero(counts[1:]) + 1).tolist():
        s = slice(lo, lo + int(counts[m]))
        want[s] = predicted(m, *(x[s.start - black : s.stop - black] for x in near))
        lo = s.stop
    return at, want


def _neighbours(pixels: np.ndarray, at: np.ndarray, width: int) -> list[np.ndarray]:
    """The pixels to the left, above, and above to the right and left."""
    return [pixels.take(at - k, mode="clip").view(np.int16).reshape(-1, 4) for k in (1, width, width - 1, width + 1)]


def _add_predictions_at_once(residue: np.ndarray, mode: np.ndarray, heights: np.ndarray) -> np.ndarray:
    """add_predictions for images below one another: a pixel needs none whose column plus twice the row is as large as its own."""
    width = residue.shape[1]
    y = _within(heights)
    flat_mode = _edged(mode, y).ravel()
    channels = _channels(residue).reshape(-1, 4)
    pixels = channels.view(np.int64)[:, 0]
    black = flat_mode == 0  # waits for no other pixel
    channels[black, 3] = (channels[black, 3] + BLACK[3]) & 255
    by_row = np.argsort(y, kind="stable")
    y = y[by_row]
    begin = by_row * width - 2 * y
    for t in range(width + 2 * int(y[-1])):
        lo, hi = np.searchsorted(y, (max(0, (t - width + 2) // 2), t // 2 + 1)).tolist()
        at = begin[lo:hi] + t
        at = at[~black[at]]
        if not len(at):
            continue
        at, want = _expected(pixels, at, flat_mode[at], width)
        want += channels[at]
        want &= 255
        channels[at] = want
    return _joined(channels).reshape(residue.shape)


def _take_predictions_at_once(argb: np.ndarray, mode: np.ndarray, heights: np.ndarray) -> np.ndarray:
    """The inverse of _add_predictions_at_once."""
    width = argb.shape[1]
    flat_mode = _edged(mode, _within(heights)).ravel()
    channels = _channels(argb).reshape(-1, 4)
    pixels = channels.view(np.int64)[:, 0]
    out = np.empty((argb.size, 4), dtype=np.uint8)
    for lo in range(0, argb.size, 1 << 17):
        at, want = _expected(pixels, np.arange(lo, min(argb.size, lo + (1 << 17))), flat_mode[lo : lo + (1 << 17)], width)
        out[at] = channels[at] - want & 255
    return _joined(out).reshape(argb.shape)


def _cache_slots(flat: np.ndarray, cache_bits: int) -> np.ndarray:
    return (flat * np.uint32(CACHE_FACTOR) >> np.uint32(32 - cache_bits)).astype(np.uint16)


@lru_cache(maxsize=1)
def _logs() -> np.ndarray:
    """Logarithms to base 2 in 64ths, whole, so that sums are exact; of 0 as of 1. An image's sample has fewer than 2 ** 20 values of a code."""
    return np.rint(64 * np.log2(np.maximum(np.arange(1 << 20), 1))).astype(np.int32)


def _bits(values: list[np.ndarray], image: np.ndarray, images: int) -> np.ndarray:
    """What the values (0 to 255) of each place take by the entropy of its image's values, in 64ths of a bit."""
    found = [image | v for v in values]
    counts = sum(np.bincount(of, minlength=images << 8) for of in found).reshape(-1, 256)
    logs = _logs()
    bits = (logs.take(counts.sum(axis=1), mode="clip")[:, None] - logs.take(counts, mode="clip")).ravel()
    return sum(bits.take(of) for of in found)


class _Sample:
    """Some pixels of images of one width below one another: one row of SAMPLE_ROWS, and at least one of each block."""

    def __init__(self, heights: np.ndarray, width: int):
        self.heights, self.width, self.images = heights, width, len(heights)
        self.across = _blocks(width, SHARE_BITS)
        self.blocks = self.across * _blocks(heights, SHARE_BITS)
        self.begins = np.cumsum(self.blocks) - self.blocks
        y, image = _within(heights), np.repeat(np.arange(self.images), heights)
        rows = np.flatnonzero((y % SAMPLE_ROWS == 1) | (y % (1 << SHARE_BITS) == 0) & (y == heights[image] - 1))
        columns = np.arange(1, width)  # the first column's predictor is fixed
        self.at = (rows[:, None] * width + columns).ravel()
        self.image = np.repeat(image[rows] << 8, width - 1)  # times 256
        self.block = ((self.begins[image] + self.across * (y >> SHARE_BITS))[rows, None] + (columns >> SHARE_BITS)).ravel()
        self.below = np.repeat(y[rows] > 0, width - 1)  # in the first row it is fixed too

    def sums(self, bits: np.ndarray, where: np.ndarray | slice = slice(None)) -> np.ndarray:
        """By block."""
        return np.bincount(self.block[where], bits, int(self.blocks.sum()))

    def split(self, of_block: np.ndarray) -> list[np.ndarray]:
        """Each image's blocks as [row, column]."""
        return [x.reshape(-1, self.across) for x in np.split(of_block.astype(np.uint32), self.begins[1:])]


def _best_factors(argb: np.ndarray, sample: _Sample) -> list[np.ndarray]:
    """The cross-colour factors, of FACTORS, with which the sampled red and blue residues of a block take the fewest bits."""
    c = np.ascontiguousarray(argb).view(np.uint8).reshape(-1, 4)[sample.at]
    blue, red = c[:, 0], c[:, 2]
    of_green, of_red = (c[:, k].copy().view(np.int8).astype(np.int16) for k in (1, 2))

    def best(channel: np.ndarray, by: np.ndarray, factors: tuple[int, ...]) -> np.ndarray:
        found = [sample.sums(_bits([channel - (f * by >> 5).astype(np.uint8)], sample.image, sample.images)) for f in factors]
        return np.array(factors)[np.argmin(found, axis=0)]

    green_to_red, green_to_blue = best(red, of_green, FACTORS), best(blue, of_green, FACTORS)
    blue = blue - (green_to_blue[sample.block] * of_green >> 5).astype(np.uint8)
    red_to_blue = best(blue, of_red, (0, *(f for f in FACTORS if f)))
    return sample.split((red_to_blue & 255) << 16 | (green_to_blue & 255) << 8 | green_to_red & 255)


def _best_modes(argb: np.ndarray, sample: _Sample, shares: list[int]) -> list[np.ndarray]:
    """The predictors with whose residues a block's sampled pixels take the fewest bits; equal ones go round, from the share's."""
    place = _within(sample.blocks) + np.repeat(shares, sample.blocks)
    below = np.flatnonzero(sample.below)
    if not len(below):
        return sample.split((place % 14) << 8)
    at = sample.at[below]
    channels = _channels(argb).reshape(-1, 4)
    own, near = channels[at], _neighbours(channels.view(np.int64)[:, 0], at, sample.width)
    image = sample.image[below]
    found = np.empty((14, int(sample.blocks.sum())))
    for m in range(14):
        residue = (own - predicted(m, *near)).astype(np.uint8)
        # red and blue share a code, green has its own
        found[m] = sample.sums(_bits([residue[:, 0], residue[:, 2]], image, sample.images) + _bits([residue[:, 1]], image, sample.images), below)
    turn = (place + np.arange(14)[:, None]) % 14
    return sample.split(((place + np.argmin(np.take_along_axis(found, turn, axis=0), axis=0)) % 14) << 8)


def _groups_of(height: int, width: int) -> np.ndarray:
    """Groups of an image's blocks; they follow from places."""
    shape = _blocks(height, SHARE_BITS), _blocks(width, SHARE_BITS)
    return np.arange(shape[0] * shape[1], dtype=np.uint32).reshape(shape) % 2


def _told(kind: int, across: int, data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The numbers, and their sizes, of a transform with the data of its blocks (uint32), ``across`` a row. Those of few blocks are kept."""
    return (_told_once if len(data) <= 256 else _told_once.__wrapped__)(kind, across, data)


@lru_cache(maxsize=4096)
def _told_once(kind: int, across: int, data: bytes) -> tuple[np.ndarray, np.ndarray]:
    w = Writer()
    w.put(1, 1)
    w.put(kind, 2)
    if data:
        w.put(SHARE_BITS - 2, 3)
        _write(w, np.frombuffer(data, dtype=np.uint32).reshape(-1, across), False)
    return w.joined()


@lru_cache(maxsize=1024)
def _told_groups(height: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The numbers, and their sizes, from the end of the transforms to the codes, for an image of so many blocks."""
    w = Writer()
    for value, size in ((0, 1), (1, 1), (CACHE_BITS, 4), (1, 1), (SHARE_BITS - 2, 3)):
        w.put(value, size)
    _write(w, _groups_of(height << SHARE_BITS, width << SHARE_BITS) << np.uint32(8), False)
    return w.joined()


def _encode_at_once(images: list[np.ndarray], heads: list[Writer], shares: list[int]) -> list[bytes]:
    """Opaque images of one width, by every transform, a colour cache, several groups of codes and back-references for runs."""
    n, width = len(images), images[0].shape[1]
    heights = np.array([len(a) for a in images])
    groups = [_groups_of(len(a), width) for a in images]
    sample = _Sample(heights, width)
    argb = np.concatenate(images)
    modes = _best_modes(argb, sample, shares)
    argb = _take_predictions_at_once(argb, _rows_of(modes, heights, SHARE_BITS, width) >> np.uint32(8), heights)
    argb = shift_green(argb, -1)
    factors = _best_factors(argb, sample)
    flat = _crossed(argb, _rows_of(factors, heights, SHARE_BITS, width), -1).ravel()
    # tokens: runs of a pixel, then what the cache holds
    first = width * (np.cumsum(heights) - heights)
    new = np.concatenate([[True], flat[1:] != flat[:-1]])
    new[first] = True
    begins = np.flatnonzero(new)
    runs = np.diff(begins, append=len(flat))
    long = np.flatnonzero(runs > RUN_LEAST)
    parts = -(-(runs[long] - 1) // COPY_MOST)
    keep = np.ones(len(flat) + 1, dtype=np.int8)
    keep[np.repeat(begins[long] + 1, runs[long] - 1) + _within(runs[long] - 1)] = 0
    copies = np.repeat(begins[long] + 1, parts) + COPY_MOST * _within(parts)
    keep[copies] = 1
    at = np.flatnonzero(keep[:-1])
    copies = np.searchsorted(at, copies)
    length = np.diff(at, append=len(flat))[copies]
    token = flat[at]
    stream = np.repeat(np.arange(n), np.diff(np.searchsorted(at, first), append=len(at)))
    plain = np.ones(len(at), dtype=bool)
    plain[copies] = False
    slot = _cache_slots(token, CACHE_BITS)
    by_slot = np.argsort(slot, kind="stable")
    same = (token[by_slot][1:] == token[by_slot][:-1]) & (stream[by_slot][1:] == stream[by_slot][:-1])
    cached = np.zeros(len(at), dtype=bool)
    cached[by_slot[1:]] = same
    cached &= plain
    plain &= ~cached
    # codes
    group = _rows_of(groups, heights, SHARE_BITS, width).ravel()[at]
    code_of = 2 * stream + group
    green, red, blue = ((token >> np.uint32(s) & np.uint32(255)).astype(np.int64) for s in (8, 16, 0))
    assert not (token >> np.uint32(24)).any()
    green[cached] = GREENS + LENGTHS + slot[cached]
    prefix, extra, low = _prefix(length)
    green[copies] = GREENS + prefix
    symbols = GREENS + LENGTHS + (1 << CACHE_BITS)
    at_plain = np.flatnonzero(plain)
    code_plain, red, blue = code_of[at_plain], red[at_plain], blue[at_plain]
    counts = np.zeros((4 * n, symbols), dtype=np.int64)
    counts[: 2 * n] = np.bincount(symbols * code_of + green, minlength=2 * n * symbols).reshape(-1, symbols)
    for channel in (red, blue):  # which share their code lengths
        counts[2 * n :, :256] += np.bincount(256 * code_plain + channel, minlength=512 * n).reshape(-1, 256)
    least = counts.sum(axis=1, keepdims=True) >> CODE_BITS - 1  # with it few codes are too long at first
    lengths = _code_lengths_at_once(np.where(counts > 0, np.maximum(counts, least), 0), CODE_BITS)
    of_green, of_both = lengths[: 2 * n], lengths[2 * n :, :256]
    code, size = _codewords_at_once(of_green, CODE_BITS)
    values, sizes = code[code_of, green], size[code_of, green]
    values[copies] |= low.astype(np.uint64) << sizes[copies].astype(np.uint64)
    sizes[copies] += extra  # the distance has one symbol, so it takes no bits
    code, size = _codewords_at_once(of_both, CODE_BITS)
    plain_values, plain_sizes = values[at_plain], sizes[at_plain]
    for channel in (red, blue):
        of = 256 * code_plain + channel
        plain_values |= code.ravel()[of] << plain_sizes.astype(np.uint64)
        plain_sizes += size.ravel()[of]
    values[at_plain], sizes[at_plain] = plain_values, plain_sizes
    out = _Numbers(n)
    for w, f, m in zip(heads, factors, modes, strict=True):
        for kind, data in ((PREDICTOR, m.tobytes()), (SUBTRACT_GREEN, b""), (CROSS_COLOUR, f.tobytes())):
            w.put_all(*_told(kind, sample.across, data))
        w.put_all(*_told_groups(*m.shape))
    told = [w.joined() for w in heads]
    out.add(*(np.concatenate(x) for x in zip(*told, strict=True)), np.array([len(v) for v, _ in told]))
    for g in (0, 1):
        used = np.array([int(b.max()) >= g for b in groups])
        if not used.any():
            continue
        header = [_headers_at_once(x[g::2][used]) for x in (of_green, of_both)]
        for v, s, c in (header[0], header[1], header[1]):
            counts = np.zeros(n, dtype=np.int64)
            counts[used] = c
            out.add(v, s, counts)
        alpha, distance = (5 | symbol << 3 for symbol in (0, NEAR.index((1, 0))))  # codes of one symbol
        out.add(np.tile(np.array([alpha, distance], dtype=np.uint64), int(used.sum())), np.full(2 * int(used.sum()), 11), 2 * used)
    out.add(values, sizes, np.bincount(stream, minlength=n))
    return [_file(stream) for stream in out.bytes()]


def _images_of(raw: bytes) -> Iterator[np.ndarray]:
    """The padded payload as images of WIDTH pixels a row."""
    payload = raw + bytes([PAD]) * (-len(raw) % UNIT or (0 if raw else UNIT))
    for lo in range(0, len(payload), MAX_ROWS * UNIT):
        c = np.frombuffer(payload[lo : lo + MAX_ROWS * UNIT], dtype=np.uint8).reshape(-1, WIDTH, 3).astype(np.uint32)
        yield np.uint32(0xFF000000) | c[..., 0] << np.uint32(16) | c[..., 1] << np.uint32(8) | c[..., 2]


def _parts(items: Iterable, size: Callable, most: int) -> Iterator[list]:
    """Items, in their order, in lists of at most so large a sum (or of one item), and of at most LANES."""
    part, total = [], 0
    for item in items:
        n = size(item)
        if part and (total + n > most or len(part) == LANES):
            yield part
            part, total = [], 0
        part.append(item)
        total += n
    if part:
        yield part


def store_many(raws: list[bytes]) -> list[list[bytes]]:
    """Each padded payload as images of WIDTH pixels a row, every one stored with all of the format's means."""
    out: list[list[bytes]] = [[] for _ in raws]
    for part in _parts(((i, argb) for i, raw in enumerate(raws) for argb in _images_of(raw)), lambda x: x[1].size, STORE_PIXELS):
        by_width: dict[int, list[tuple]] = {}
        for k, (i, argb) in enumerate(part):
            w = Writer()
            for value, size in ((argb.shape[1] - 1, 14), (argb.shape[0] - 1, 14), (0, 4)):
                w.put(value, size)
            colours = _palette(argb)
            if colours is not None and 4 * len(colours) <= argb.size:
                w.put(1, 1)
                w.put(PALETTE, 2)
                _tell_palette(w, colours)
                argb = _packed(argb, colours)
            by_width.setdefault(argb.shape[1], []).append((k, argb, w, zlib.crc32(raws[i]) % SHARES))
        done: list[bytes] = [b""] * len(part)
        for same in by_width.values():
            places, images, heads, shares = zip(*same, strict=True)
            for k, data in zip(places, _encode_at_once(images, heads, shares), strict=True):
                done[k] = data
        for (i, _), data in zip(part, done, strict=True):
            out[i].append(data)
    return out


def store(raw: bytes) -> list[bytes]:
    return store_many([raw])[0]


def _lengths_at_once(window: np.ndarray, at: np.ndarray, symbols: int, bad: np.ndarray) -> np.ndarray:
    """The code lengths told at each stream's place, which is moved past them. What is no code makes a stream bad."""
    peek = lambda p: window.take(p >> 3, mode="clip") >> (p & 7)
    n = len(at)
    lengths = np.zeros((n, symbols), dtype=np.uint8)
    w = peek(at)
    simple = w & 1 == 1
    who = np.flatnonzero(simple)
    if len(who):
        w = w[who]
        two, wide = w >> 1 & 1, w >> 2 & 1
        size = np.where(wide == 1, 8, 1)
        a, b = w >> 3 & ((1 << size) - 1), np.where(two == 1, w >> (3 + size) & 255, 0)
        bad[who] |= (a >= symbols) | (b >= symbols)
        lengths[who, np.minimum(a, symbols - 1)] = 1
        second = two == 1
        lengths[who[second], np.minimum(b, symbols - 1)[second]] = 1
        at[who] += 3 + size + 8 * two
    who = np.flatnonzero(~simple)
    if not len(who):
        return lengths
    p = at[who]
    told = 4 + (peek(p) >> 1 & 15)
    w = peek(p + 5)
    of_lengths = np.zeros((len(who), 19), dtype=np.uint8)
    for i, symbol in enumerate(LENGTH_ORDER):
        of_lengths[:, symbol] = np.where(i < told, w >> 3 * i & 7, 0)
    wrong = bad[who]
    table = _tables_at_once(of_lengths, 7, wrong).ravel().astype(np.int64)
    p += 5 + 3 * told
    w = peek(p)
    size = np.where(w & 1, 2 + 2 * (w >> 1 & 7), 0)
    left = np.where(w & 1, 2 + (w >> 4 & ((1 << size) - 1)), symbols)
    p += np.where(w & 1, 4 + size, 1)
    extras, least = np.array([0] * 16 + [2, 3, 7]), np.array([1] * 16 + [3, 3, 11])
    done, last = np.zeros(len(who), dtype=np.int64), np.full(len(who), 8)
    live = np.arange(len(who))
    values, times = [], []
    q, have, rest, before = p.copy(), done.copy(), left, last
    while len(live):
        w = peek(q)
        entry = table.take(live << 7 | w & 127)
        symbol, size = entry >> 4, entry & 15
        extra = extras.take(symbol)
        count = least.take(symbol) + (w >> size & ((1 << extra) - 1))
        value = np.where(symbol < 16, symbol, np.where(symbol == 16, before, 0))
        v, c = np.zeros((2, len(who)), dtype=np.uint16)
        v[live], c[live] = value, count
        values.append(v)
        times.append(c)
        q = q + size + extra
        have = have + count
        rest = rest - 1
        before = np.where((symbol > 0) & (symbol < 16), symbol, before)
        more = (have < symbols) & (rest > 0)
        if not more.all():
            ended = ~more
            p[live[ended]], done[live[ended]] = q[ended], have[ended]
            live, q, have, rest, before = live[more], q[more], have[more], rest[more], before[more]
    at[who] = p
    wrong |= done > symbols
    counts = np.stack([*times, np.maximum(0, symbols - done).astype(np.uint16)], axis=1)
    counts[wrong] = 0
    counts[wrong, -1] = symbols
    values.append(np.zeros(len(who), dtype=np.uint16))
    lengths[who] = np.repeat(np.stack(values, axis=1).ravel(), counts.ravel()).reshape(-1, symbols)
    bad[who] = wrong
    return lengths


def _pixels_at_once(jobs: list[tuple], cache_bits: int, groups: int) -> list[np.ndarray | None]:
    """The coded pixels of streams that stand at their codes; None where a stream needs ``decode``.

    Each step reads one token of every stream. Back-references other than to the pixel before, codes
    of more than TABLE_BITS bits and several values of alpha in a group are left to ``decode``.
    """
    n = len(jobs)
    data = b"".join(x for job in jobs for x in (job[0].data, bytes(16)))
    bytes_of = np.array([len(job[0].data) + 16 for job in jobs])
    begin = 8 * (np.cumsum(bytes_of) - bytes_of)
    at, ends = begin + np.array([job[0].at for job in jobs]), begin + 8 * bytes_of - 128
    window = np.ascontiguousarray(np.ndarray(len(data) - 7, "<i8", data, strides=(1,)))
    bad = np.zeros(n, dtype=bool)
    sizes = (GREENS + LENGTHS + (1 << cache_bits if cache_bits else 0), 256, 256, 256, DISTANCES)
    lengths = [[_lengths_at_once(window, at, s, bad) for s in sizes] for _ in range(groups)]
    of_green, of_red, of_blue, of_alpha, of_distance = (np.stack(x, axis=1).reshape(n * groups, -1) for x in zip(*lengths, strict=True))
    alpha, distance = of_alpha.argmax(axis=1), of_distance.argmax(axis=1)
    bad |= (np.count_nonzero(of_alpha, axis=1) != 1).reshape(n, -1).any(axis=1)
    distance[np.count_nonzero(of_distance, axis=1) != 1] = -1
    bits = int(min(TABLE_BITS, max(of_green.max(), of_red.max(), of_blue.max())))
    greens, reds = (_tables_at_once(x, bits, bad).ravel() for x in (of_green, of_red))
    blues = reds if (of_red == of_blue).all() else _tables_at_once(of_blue, bits, bad).ravel()
    many = np.array([job[1] * job[2] for job in jobs])
    first = np.cumsum(many) - many
    total = int(many.sum())
    # the place of the tables of each pixel's group
    tables = np.repeat(np.arange(n) * groups, many)
    if groups > 1:
        tables += np.concatenate([_modes(of, b, x, y).ravel() for _, x, y, of, b, _ in jobs])
    tables <<= bits
    mask = (1 << bits) - 1
    extras, least = (np.array(x) for x in zip(*(((0, k + 1) if k < 4 else ((k - 2) >> 1, ((2 + (k & 1)) << ((k - 2) >> 1)) + 1)) for k in range(LENGTHS)), strict=True))
    green, red, blue = np.full(total, 0xFFFF, dtype=np.uint16), np.zeros(total, dtype=np.uint16), np.zeros(total, dtype=np.uint16)
    p, pos, end, lane = at, first.copy(), first + many, np.arange(n)
    while len(pos):
        w = window.take(p >> 3, mode="clip") >> (p & 7)
        table = tables.take(pos)
        g = greens.take(table + (w & mask))
        size = (g & 15).astype(np.int64)
        w >>= size
        r = reds.take(table + (w & mask))
        of_r = (r & 15).astype(np.int64)
        w >>= of_r
        b = blues.take(table + (w & mask))
        green[pos], red[pos], blue[pos] = g, r, b
        step = of_r + (b & 15)
        after = pos + 1
        other = (g >= GREENS << 4).nonzero()[0]
        if len(other):
            step[other] = 0
            copies = other[g[other] < GREENS + LENGTHS << 4]
            if len(copies):
                prefix = (g[copies] >> 4).astype(np.int64) - GREENS
                q = p[copies] + size[copies]
                step[copies] = extras[prefix]
                after[copies] += least[prefix] + (window.take(q >> 3, mode="clip") >> (q & 7) & ((1 << extras[prefix]) - 1)) - 1
        step += size
        p = p + step
        pos = after
        more = pos < end
        if np.count_nonzero(more) < len(more):
            ended = ~more
            bad[lane[ended]] |= (pos[ended] != end[ended]) | (p[ended] > ends[lane[ended]])
            p, pos, end, lane = p[more], pos[more], end[more], lane[more]
    symbol = green >> 4
    literal = symbol < GREENS
    argb = alpha.astype(np.uint32)[tables >> bits] << np.uint32(24) | (red >> 4).astype(np.uint32) << np.uint32(16) | symbol.astype(np.uint32) << np.uint32(8) | blue >> 4
    copied = (symbol >= GREENS) & (symbol < GREENS + LENGTHS)
    wrong = np.flatnonzero(copied)
    group = tables[wrong] >> bits
    bad[group[distance[group] != NEAR.index((1, 0))] // groups] = True
    copied |= green == 0xFFFF
    bad |= copied[first]
    if cache_bits:  # a slot holds the last literal of its hash; what the cache or a run gives changes no slot
        token = np.flatnonzero(~copied)
        slot = np.where(literal[token], _cache_slots(argb[token], cache_bits), symbol[token] - np.uint16(GREENS + LENGTHS))
        order = np.argsort(slot, kind="stable")
        place, slot = token[order], slot[order]
        is_literal = literal[place]
        source = np.maximum.accumulate(np.where(is_literal, np.arange(len(place)), 0))
        from_cache = np.flatnonzero(~is_literal)
        to, source = place[from_cache], source[from_cache]
        streams = tables[to] >> bits
        streams //= groups
        argb[to] = argb[place[source]]
        bad[streams[~is_literal[source] | (slot[source] != slot[from_cache]) | (place[source] < first[streams])]] = True
    if copied.any():
        argb = argb[np.maximum.accumulate(np.where(copied, 0, np.arange(total)))]
    return [None if b else argb[lo : lo + k].reshape(job[2], job[1]) for job, b, lo, k in zip(jobs, bad.tolist(), first.tolist(), many.tolist(), strict=True)]


def _undone_at_once(images: list[np.ndarray], todos: list[list[tuple]]) -> list[np.ndarray]:
    """Images of one width after the inverses of their transforms, which are of the same kinds and blocks; a palette can come first only."""
    heights = np.array([len(a) for a in images])
    width = images[0].shape[1]
    argb = np.concatenate(images)
    for k in range(len(todos[0]) - 1, -1, -1):
        kind, _, _, bits = todos[0][k]
        if kind == PREDICTOR:
            modes = _rows_of([t[k][2] for t in todos], heights, bits, width)
            argb = _add_predictions_at_once(argb, modes >> np.uint32(8) & np.uint32(15), heights)
        elif kind == CROSS_COLOUR:
            argb = _crossed(argb, _rows_of([t[k][2] for t in todos], heights, bits, width), 1)
        elif kind == SUBTRACT_GREEN:
            argb = shift_green(argb, 1)
    out = np.split(argb, np.cumsum(heights)[:-1])
    if todos[0] and todos[0][0][0] == PALETTE:
        out = [from_palette(a, t[0][2], t[0][1]) for a, t in zip(out, todos, strict=True)]
    return out


_known: dict[tuple[int, int, int], list[tuple[int, int, np.ndarray]]] = {}


def _image_once(r: Reader, width: int, height: int, main: bool) -> np.ndarray:
    """_image, for images of blocks; a small one with the same bits as one read before isn't read again."""
    key = (width, height, r.peek(48))
    for size, value, pixels in _known.get(key, ()):
        if r.at + size <= r.end and r.bits(r.at, size) == value:
            r.at += size
            return pixels
    begin = r.at
    pixels = _image(r, width, height, main)
    if len(pixels) <= 256:
        if len(_known) >= 4096:
            _known.clear()
        if len(seen := _known.setdefault(key, [])) < 64:
            seen.append((r.at - begin, r.bits(begin, r.at - begin), pixels))
    return pixels


def _decode_part(images: list[bytes]) -> list[np.ndarray]:
    by_kind: dict[tuple, list[tuple]] = {}
    for i, data in enumerate(images):
        r, width, height = _opened(data)
        todo, x = _transforms(r, width, height, _image_once)
        cache_bits = r.read(4) if r.read(1) else 0
        of, bits, groups = None, 0, 1
        if r.read(1):
            bits = r.read(3) + 2
            shape = (_blocks(height, bits), _blocks(x, bits))
            of = (_image_once(r, shape[1], shape[0], False) >> np.uint32(8) & np.uint32(0xFFFF)).astype(np.int64).reshape(shape)
            groups = int(of.max()) + 1
        if cache_bits <= 11 and groups <= 4 and all(t[0] != PALETTE for t in todo[1:]):
            by_kind.setdefault((cache_bits, groups), []).append((i, (r, x, height, of, bits, todo)))
    out: list[np.ndarray | None] = [None] * len(images)
    same: dict[tuple, list[tuple]] = {}
    for kind, found in by_kind.items():
        sizes = sorted((job[1] * job[2] for _, job in found), reverse=True)
        most = 2 * sizes[LEAST_LANES - 1] if len(sizes) >= LEAST_LANES else 0  # a few long streams take less time one by one
        found = [(i, job) for i, job in found if job[1] * job[2] <= most]
        if found:
            for (i, job), argb in zip(found, _pixels_at_once([job for _, job in found], *kind), strict=True):
                if argb is not None:
                    same.setdefault((job[1], *((t[0], t[3]) for t in job[5])), []).append((i, argb, job[5]))
    for found in same.values():
        places, argbs, todos = zip(*found, strict=True)
        for i, argb in zip(places, _undone_at_once(argbs, todos), strict=True):
            out[i] = argb
    return [decode(data) if argb is None else argb for data, argb in zip(images, out, strict=True)]


def decode_many(images: Iterable[bytes]) -> Iterator[np.ndarray]:
    """The pixels of each image, as ``decode`` gives them."""
    pixels = lambda data: ((int.from_bytes(data[21:25], "little") & 0x3FFF) + 1) * ((int.from_bytes(data[21:25], "little") >> 14 & 0x3FFF) + 1)
    for part in _parts(images, pixels, LANE_PIXELS):
        yield from _decode_part(part)


def samples(argb: np.ndarray) -> bytes:
    """Red, green and blue of every pixel."""
    return np.stack([argb >> np.uint32(s) & np.uint32(255) for s in (16, 8, 0)], axis=-1).astype(np.uint8).tobytes()


def features(payload: bytes) -> str:
    """rows x WIDTH, the means of red, green and blue, and 64 bits: which of 8 by 8 areas are lighter than the image."""
    c = np.frombuffer(payload, dtype=np.uint8).reshape(-1, UNIT)
    means = c.sum(axis=0, dtype=np.int64).reshape(WIDTH, 3).sum(axis=0) / (len(c) * WIDTH)
    rows = np.linspace(0, len(c), 9).astype(np.int64)
    by_row = c.reshape(len(c), 8, UNIT // 8).sum(axis=2, dtype=np.int64)
    sums = np.concatenate([np.zeros((1, 8), dtype=np.int64), np.cumsum(by_row, axis=0)])
    light = (sums[rows[1:]] - sums[rows[:-1]]) * len(c) * WIDTH > int(sums[-1].sum()) * (np.diff(rows) * (WIDTH // 8))[:, None]
    return f"{len(c)}x{WIDTH}:{','.join(f'{m:.3f}' for m in means)}:{np.packbits(light).tobytes().hex()}"


def _slices(batch: pa.RecordBatch, sizes: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Slices of at most LANES rows and SLICE_BYTES (or of one row); none if there are no rows."""
    for part in _parts(enumerate(sizes.tolist()), lambda x: x[1], SLICE_BYTES):
        yield batch.slice(part[0][0], len(part))


def _store_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in _slices(batch, pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy()):
            raw = [t or b"" for t in part.column(1).to_pylist()]
            known = dict(zip(once := list(dict.fromkeys(raw)), store_many(once), strict=True))
            yield pa.record_batch([part.column(0), pa.array([len(t) for t in raw], pa.int64()), pa.array([known[t] for t in raw], pa.list_(pa.binary()))], names=["doc_id", "n_bytes", "media"])


def stored(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media (the images of its text's payload), written to the shared folder."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    read = docs.select("doc_id", F.col("text").cast("string").cast("binary").alias("text"))
    return staged(read.mapInArrow(lambda batches: released(_store_rows(batches)), f"doc_id {kind}, n_bytes long, media array<binary>"), "webp-media")


def pixels(media: DataFrame, column: str = "media") -> DataFrame:
    """Each image of ``column`` (binary) with width, height and pixels (bytes of red, green, blue and alpha); null stays null, bytes that are no image give null pixels."""

    @F.pandas_udf("width int, height int, pixels binary")
    def opened(found):
        import pandas as pd

        rows = []
        for data in found:
            try:
                argb = decode(bytes(data)) if data is not None else None
            except Corrupt:
                argb = None
            rows.append((None, None, None) if argb is None else (argb.shape[1], argb.shape[0], np.ascontiguousarray(_channels(argb)[..., [2, 1, 0, 3]]).astype(np.uint8).tobytes()))
        return pd.DataFrame(rows, columns=["width", "height", "pixels"]).astype({"width": "Int32", "height": "Int32"})

    row = F.struct(*[F.col(f"`{c}`") for c in media.columns]).alias("row")
    return media.select(row, opened(F.col(f"`{column}`")).alias("got")).select("row", "got.*")


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole_batch in batches:
        # what is read back is as long as the texts, however small its media
        for batch in _slices(whole_batch, pc.fill_null(whole_batch.column(1), 0).to_numpy()):
            stored_rows = batch.column(2).to_pylist()
            images = (samples(argb) for argb in decode_many([m for media in stored_rows for m in media]))
            out = []
            for media in stored_rows:
                payload = b"".join(next(images) for _ in media)
                whole = hashlib.sha256()
                for m in media:
                    whole.update(m)
                out.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), sum(map(len, media)), whole.hexdigest(), features(payload)))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            columns = list(zip(*out, strict=True)) if out else [[]] * 6
            yield pa.record_batch([batch.column(0), batch.column(1), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])


def described(media: DataFrame) -> DataFrame:
    """From doc_id, n_bytes and media: sizes and digests of payload and stored form, and the features of the pixels read back."""
    kind = media.schema["doc_id"].dataType.simpleString()
    made = f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return media.select("doc_id", "n_bytes", "media").mapInArrow(lambda batches: released(_described(batches)), made)
