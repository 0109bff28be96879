"""Lossless WebP images of byte samples: a decoder of the whole bitstream and an encoder for samples in one channel.

Pixels are 32-bit ARGB numbers in numpy arrays. The decoder handles prefix codes and groups of them, back-references,
the colour cache and the four transforms; entropy-coded data are decoded by looking up a code at every bit position at
once and then following the chain of code lengths.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from itertools import groupby

import numpy as np

MAX_SIDE = 1 << 14
_SIZES = (256 + 24, 256, 256, 256, 40)
#: Fixed value: the order in which the lengths of the code-length code are stored.
_CODE_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
#: The 120 nearest places of earlier pixels (dx to the left, dy up), nearest first, then by column, left before right.
_NEAR = sorted(((x, y) for y in range(8) for x in range(-7, 9) if y or x > 0),
               key=lambda p: (p[0] ** 2 + p[1] ** 2, abs(p[0]), p[0] < 0))
_REVERSED = np.array([int(f"{i:08b}"[::-1], 2) for i in range(256)], np.uint8)


# Bits -------------------------------------------------------------------------------------------------------------------

class Bits:
    """Bits of a stream, least significant bit of each byte first."""

    def __init__(self, raw: bytes):
        self.raw, self.at = raw, 0
        self._windows: np.ndarray | None = None

    def read(self, n: int) -> int:
        low = self.at >> 3
        value = int.from_bytes(self.raw[low:low + (n + 14) // 8 + 1], "little") >> (self.at & 7) & ((1 << n) - 1)
        self.at += n
        if self.at > 8 * len(self.raw):
            raise ValueError("image data end too soon")
        return value

    def windows(self) -> np.ndarray:
        """The 25 bits and more from each byte on, first bit highest, as 32-bit numbers."""
        if self._windows is None:
            data = np.concatenate([_REVERSED[np.frombuffer(self.raw, np.uint8)], np.zeros(24, np.uint8)]).astype(np.uint32)
            n = len(data) - 3
            self._windows = data[:n] << 24 | data[1:n + 1] << 16 | data[2:n + 2] << 8 | data[3:n + 3]
        return self._windows


class BitWriter:
    """Collects (value, bits) pairs; values are written lowest bit first."""

    def __init__(self):
        self.values: list[np.ndarray] = []
        self.sizes: list[np.ndarray] = []
        self._value, self._size = [], []

    def put(self, value: int, size: int) -> None:
        self._value.append(value)
        self._size.append(size)

    def _turn(self) -> None:
        if self._value:
            self.values.append(np.array(self._value, np.uint64))
            self.sizes.append(np.array(self._size, np.int64))
            self._value, self._size = [], []

    def extend(self, values: np.ndarray, sizes: np.ndarray) -> None:
        self._turn()
        self.values.append(values.astype(np.uint64))
        self.sizes.append(sizes.astype(np.int64))

    def bytes(self) -> bytes:
        self._turn()
        values, sizes = np.concatenate(self.values), np.concatenate(self.sizes)
        start = np.cumsum(sizes) - sizes
        total = int(start[-1] + sizes[-1])
        place = (start & 31).astype(np.uint64)
        word = start >> 5
        spread = values << place  # values have at most 32 bits
        n = total // 32 + 2
        low = np.bincount(word, (spread & np.uint64(0xFFFFFFFF)).astype(np.float64), n)
        high = np.bincount(word + 1, (spread >> np.uint64(32)).astype(np.float64), n + 1)[:n]
        return (low + high).astype(np.uint32).astype("<u4").tobytes()[:(total + 7) // 8]


# Prefix codes -----------------------------------------------------------------------------------------------------------

class Prefix:
    """A canonical prefix code as a table of symbols and lengths under the next ``bits`` bits, first bit highest."""

    def __init__(self, lengths: np.ndarray):
        used = np.flatnonzero(lengths)
        if len(used) <= 1:
            self.bits, self.symbols, self.sizes = 0, np.array([used[0] if len(used) else 0]), np.zeros(1, np.int64)
            return
        self._turned: list[tuple[int, int]] | None = None
        order = used[np.argsort(lengths[used], kind="stable")]
        size = lengths[order].astype(np.int64)
        self.bits = int(size[-1])
        room = 1 << (self.bits - size)
        if room.sum() != 1 << self.bits:
            raise ValueError("prefix code is not complete")
        self.symbols, self.sizes = np.repeat(order, room), np.repeat(size, room)

    def one(self, bits: Bits) -> int:
        if not self.bits:
            return int(self.symbols[0])
        if self._turned is None:
            self._turned = self.turned()
        raw = int.from_bytes(bits.raw[bits.at >> 3:(bits.at >> 3) + 4], "little") >> (bits.at & 7)
        symbol, size = self._turned[raw & ((1 << self.bits) - 1)]
        bits.at += size
        if bits.at > 8 * len(bits.raw):
            raise ValueError("image data end too soon")
        return symbol

    def turned(self) -> list[tuple[int, int]]:
        """(symbol, length) under the next ``bits`` bits taken as a number, first bit lowest."""
        at = np.arange(1 << self.bits)
        back = (_REVERSED[at & 255].astype(np.int64) << 8 | _REVERSED[at >> 8]) >> (16 - self.bits)
        return list(zip(self.symbols[back].tolist(), self.sizes[back].tolist()))

    def at(self, bits: Bits, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols and lengths of the codes that begin at some bit positions."""
        if not self.bits:
            return np.full(len(place), self.symbols[0]), np.zeros(len(place), np.int64)
        windows = bits.windows()
        byte = np.minimum(place >> 3, len(windows) - 1)
        key = (windows[byte] >> (32 - self.bits - (place & 7)).astype(np.uint32)).astype(np.int64) & ((1 << self.bits) - 1)
        return self.symbols[key], self.sizes[key]


def read_lengths(bits: Bits, size: int) -> np.ndarray:
    lengths = np.zeros(size, np.uint8)
    if bits.read(1):
        two, wide = bits.read(1), bits.read(1)
        lengths[bits.read(8 if wide else 1)] = 1
        if two:
            lengths[bits.read(8)] = 1
        return lengths
    own = np.zeros(19, np.uint8)
    for place in _CODE_ORDER[:4 + bits.read(4)]:
        own[place] = bits.read(3)
    code, left = Prefix(own), size
    if bits.read(1):
        left = 2 + bits.read(2 + 2 * bits.read(3))
    at, last, table, mask = 0, 8, code.turned() if code.bits else [(int(code.symbols[0]), 0)], (1 << code.bits) - 1
    word = int.from_bytes(bits.raw[bits.at >> 3:(bits.at >> 3) + 2 * size + 64], "little") >> (bits.at & 7)
    out: list[int] = []
    used = 0
    while at < size and left:
        left -= 1
        symbol, n = table[word & mask]
        word >>= n
        used += n
        if symbol < 16:
            out.append(symbol)
            last = symbol or last
            at += 1
            continue
        value, low, n = (last, 3, 2) if symbol == 16 else (0, 3, 3) if symbol == 17 else (0, 11, 7)
        count = low + (word & ((1 << n) - 1))
        word >>= n
        used += n
        out += [value] * count
        at += count
    bits.at += used
    if at > size or bits.at > 8 * len(bits.raw):
        raise ValueError("code lengths do not fit")
    lengths[:at] = out
    return lengths


def code_lengths(counts: list[int], longest: int = 15) -> list[int]:
    """Lengths of an optimal prefix code, made a little flatter until none is longer than ``longest``."""
    out = [0] * len(counts)
    leaves = sorted((n, i) for i, n in enumerate(counts) if n)
    if len(leaves) < 2:
        for _, i in leaves:
            out[i] = 1
        return out
    while True:
        # two queues, both in rising order: leaves, and joined nodes as they are made
        n, weight = len(leaves), [w for w, _ in leaves]
        parent, leaf, node = [0] * (2 * n - 1), 0, n
        for made in range(n, 2 * n - 1):
            total = 0
            for _ in (0, 1):
                if leaf < n and (node >= made or weight[leaf] <= weight[node]):
                    child, leaf = leaf, leaf + 1
                else:
                    child, node = node, node + 1
                parent[child] = made
                total += weight[child]
            weight.append(total)
        depth = [0] * (2 * n - 1)
        for k in range(2 * n - 3, -1, -1):
            depth[k] = depth[parent[k]] + 1
        if max(depth[:n]) <= longest:
            for k, (_, i) in enumerate(leaves):
                out[i] = depth[k]
            return out
        leaves = sorted(((w >> 1) + 1, i) for w, i in leaves)


def canonical(lengths: list[int]) -> np.ndarray:
    """The codes of a canonical prefix code, turned around so that they are written lowest bit first."""
    size = np.array(lengths)
    out = np.zeros(len(size), np.int64)
    used = np.flatnonzero(size)
    order = used[np.argsort(size[used], kind="stable")]
    room = 1 << (16 - size[order])
    left = np.cumsum(room) - room  # the code, moved to the top of 16 bits
    out[order] = _REVERSED[left & 255].astype(np.int64) << 8 | _REVERSED[left >> 8 & 255]
    return out


def write_lengths(out: BitWriter, lengths: list[int]) -> None:
    used = [i for i, n in enumerate(lengths) if n]
    if len(used) <= 2 and all(i < 256 for i in used):
        out.put(1, 1)
        out.put(len(used) == 2, 1)
        first = used[0] if used else 0
        out.put(first > 1, 1)
        out.put(first, 8 if first > 1 else 1)
        if len(used) == 2:
            out.put(used[1], 8)
        return
    runs: list[tuple[int, int, int]] = []
    for value, group in groupby(lengths):
        count = len(list(group))
        if value:
            runs.append((value, 0, 0))
            count -= 1
            while count >= 3:
                n = min(count, 6)
                runs.append((16, n - 3, 2))
                count -= n
        else:
            while count >= 3:
                n = min(count, 138)
                runs.append((17, n - 3, 3) if n <= 10 else (18, n - 11, 7))
                count -= n
        runs += [(value, 0, 0)] * count
    counts = [0] * 19
    for symbol, _, _ in runs:
        counts[symbol] += 1
    own = code_lengths(counts, 7)
    if sum(map(bool, own)) == 1:
        own[0 if not own[0] else 1] = 1  # a code of one symbol would be read without bits
    codes = canonical(own).tolist()
    stored = max(4, 1 + max(i for i, place in enumerate(_CODE_ORDER) if own[place]))
    out.put(0, 1)
    out.put(stored - 4, 4)
    for place in _CODE_ORDER[:stored]:
        out.put(own[place], 3)
    out.put(0, 1)
    for symbol, extra, size in runs:  # the extra bits follow the code
        out.put(codes[symbol] | extra << own[symbol], own[symbol] + size)


# Decoder ----------------------------------------------------------------------------------------------------------------

def _prefix_value(symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Base value and number of extra bits of length and distance symbols."""
    extra = np.maximum(0, (symbol - 2) >> 1)
    return np.where(symbol < 4, symbol + 1, ((2 + (symbol & 1)) << extra) + 1), extra


def _extra_bits(bits: Bits, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Extra bits at the given positions: they are plain numbers, lowest bit first."""
    raw = np.frombuffer(bits.raw + bytes(8), np.uint8).astype(np.uint64)
    byte = at >> 3
    value = raw[byte]
    for k in range(1, 4):
        value = value | raw[byte + k] << np.uint64(8 * k)
    return (value >> (at & 7).astype(np.uint64) & ((np.uint64(1) << size.astype(np.uint64)) - np.uint64(1))).astype(np.int64)


def _distance(code: int, width: int) -> int:
    if code > 120:
        return code - 120
    x, y = _NEAR[code - 1]
    return max(1, x + y * width)


def _one_channel(bits: Bits, codes: list[Prefix], count: int, width: int) -> np.ndarray:
    """Pixels under one group of codes in which only the first channel takes bits, and without a cache."""
    base = int(codes[1].symbols[0]) << 16 | int(codes[2].symbols[0]) | int(codes[3].symbols[0]) << 24
    if not codes[0].bits and int(codes[0].symbols[0]) < 256:
        return np.full(count, base | int(codes[0].symbols[0]) << 8, np.uint32)
    # every bit position: the code that would begin there; 0 stands for codes of lengths until their bits are added up
    code, first, end = codes[0], bits.at & ~7, 8 * len(bits.raw)
    sizes = np.where(code.symbols < 256, code.sizes, 0).astype(np.uint8)
    windows = bits.windows()[first >> 3:]
    key = ((windows[:, None] >> (32 - code.bits - np.arange(8)).astype(np.uint32)) & np.uint32((1 << code.bits) - 1)).reshape(-1)
    key = key.astype(np.intp)
    step = sizes[key]
    far = np.flatnonzero(step[:end - first] == 0)
    if len(far):
        length, extra = _prefix_value(code.symbols[key[far]] - 256)
        place = np.minimum(far + code.sizes[key[far]] + first, end)
        length = length + _extra_bits(bits, place, extra)
        place = np.minimum(place + extra, end)
        back, back_size = codes[4].at(bits, place)
        distance, extra = _prefix_value(back)
        place = np.minimum(place + back_size, end)
        distance = distance + _extra_bits(bits, place, extra)
        step[far] = np.maximum(1, place + extra - first - far)
    if not step[:end - first].all():
        step = np.maximum(step, 1)
    # two codes at a time through the chain, then the place between
    spots = np.arange(end - first)
    pair = (step[:end - first] + step[np.minimum(spots + step[:end - first], len(step) - 1)]).tobytes()
    spot, limit, steps = bits.at - first, end - first, []
    add = steps.append
    while spot < limit:
        add(spot)
        spot += pair[spot]
    index = np.empty(2 * len(steps), np.int64)
    index[0::2] = steps
    index[1::2] = index[0::2] + step[index[0::2]]
    index = index[index < limit]
    taken = code.symbols[key[index]]
    if not (taken >= 256).any():
        if len(index) < count:
            raise ValueError("image data end too soon")
        index, taken = index[:count], taken[:count]
        bits.at = first + int(index[-1]) + int(step[index[-1]])
        if bits.at > end:
            raise ValueError("image data end too soon")
        return np.uint32(base) | taken.astype(np.uint32) << np.uint32(8)
    slot = np.minimum(np.searchsorted(far, index), len(far) - 1)
    pixels = np.where(taken >= 256, length[slot], 1)
    total = np.cumsum(pixels)
    used = int(np.searchsorted(total, count)) + 1
    if used > len(index) or total[used - 1] != count:
        raise ValueError("image data end too soon")
    index, taken, slot = index[:used], taken[:used], slot[:used]
    bits.at = first + int(index[-1]) + int(step[index[-1]])
    if bits.at > end:
        raise ValueError("image data end too soon")
    out, low = bytearray(), 0
    values = np.minimum(taken, 255).astype(np.uint8).tobytes()
    for k in np.flatnonzero(taken >= 256).tolist():
        out += values[low:k]
        low = k + 1
        n, back = int(length[slot[k]]), _distance(int(distance[slot[k]]), width)
        start = len(out) - back
        if start < 0:
            raise ValueError("back-reference before the first pixel")
        while n > 0:
            piece = out[start:start + min(n, len(out) - start)]
            out += piece
            n -= len(piece)
    out += values[low:]
    return np.uint32(base) | np.frombuffer(bytes(out), np.uint8).astype(np.uint32) << np.uint32(8)


def _pixels(bits: Bits, width: int, height: int, top: bool) -> np.ndarray:
    """An entropy-coded image as ARGB numbers in scan order."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    if cache_bits > 11:
        raise ValueError("bad colour cache size")
    groups, shift, plan = 1, 0, None
    if top and bits.read(1):
        shift = bits.read(3) + 2
        across = (width + (1 << shift) - 1) >> shift
        plan = _pixels(bits, across, (height + (1 << shift) - 1) >> shift, False) >> np.uint32(8) & np.uint32(0xFFFF)
        groups = int(plan.max()) + 1
    codes = []
    for _ in range(groups):
        codes.append([Prefix(read_lengths(bits, n + ((1 << cache_bits) if cache_bits and k == 0 else 0)))
                      for k, n in enumerate(_SIZES)])
    count = width * height
    if top and groups == 1 and not cache_bits and not any(c.bits for c in codes[0][1:4]):
        return _one_channel(bits, codes[0], count, width)
    out = np.zeros(count, np.uint32)
    cache = [0] * (1 << cache_bits) if cache_bits else []
    at = 0

    def keep(argb: int) -> None:
        cache[(argb * 0x1E35A7BD & 0xFFFFFFFF) >> (32 - cache_bits)] = argb

    while at < count:
        group = codes[int(plan[(at // width >> shift) * across + (at % width >> shift)]) if plan is not None else 0]
        green = group[0].one(bits)
        if green < 256:
            red, blue, alpha = group[1].one(bits), group[2].one(bits), group[3].one(bits)
            argb = alpha << 24 | red << 16 | green << 8 | blue
            out[at] = argb
            at += 1
            if cache_bits:
                keep(argb)
        elif green < 280:
            base, extra = _prefix_value(np.array([green - 256]))
            n = int(base[0]) + bits.read(int(extra[0]))
            base, extra = _prefix_value(np.array([group[4].one(bits)]))
            back = _distance(int(base[0]) + bits.read(int(extra[0])), width)
            if back > at or at + n > count:
                raise ValueError("back-reference outside the image")
            for k in range(at, at + n):
                out[k] = out[k - back]
                if cache_bits:
                    keep(int(out[k]))
            at += n
        else:
            argb = cache[green - 280]
            out[at] = argb
            keep(argb)
            at += 1
    return out


def _add(a: int, b: int) -> int:
    """Sum of two pixels, each channel modulo 256."""
    return ((a & 0xFF00FF00) + (b & 0xFF00FF00) & 0xFF00FF00) | ((a & 0x00FF00FF) + (b & 0x00FF00FF) & 0x00FF00FF)


def _channels(p: int) -> tuple[int, int, int, int]:
    return p >> 24, p >> 16 & 255, p >> 8 & 255, p & 255


def _join(c) -> int:
    a, r, g, b = c
    return a << 24 | r << 16 | g << 8 | b


def _average(a: int, b: int) -> int:
    return (((a ^ b) & 0xFEFEFEFE) >> 1) + (a & b)


def predict(mode: int, left: int, top: int, top_left: int, top_right: int) -> int:
    """The fourteen predictors of a pixel from its neighbours."""
    if mode == 0 or mode > 13:
        return 0xFF000000
    if mode <= 4:
        return (left, top, top_right, top_left)[mode - 1]
    if mode == 5:
        return _average(_average(left, top_right), top)
    if mode <= 10:
        return (_average(left, top_left) if mode == 6 else _average(left, top) if mode == 7 else _average(top_left, top) if mode == 8
                else _average(top, top_right) if mode == 9 else _average(_average(left, top_left), _average(top, top_right)))
    a, b, c = _channels(left), _channels(top), _channels(top_left)
    if mode == 11:
        to_left = sum(abs(x + y - z - x) for x, y, z in zip(a, b, c))  # distance of the gradient from each neighbour
        to_top = sum(abs(x + y - z - y) for x, y, z in zip(a, b, c))
        return left if to_left < to_top else top
    if mode == 12:
        return _join(min(255, max(0, x + y - z)) for x, y, z in zip(a, b, c))
    mean = _channels(_average(left, top))
    return _join(min(255, max(0, m + int((m - z) / 2))) for m, z in zip(mean, c))


def predictions(modes: np.ndarray, shift: int, width: int, height: int, known: np.ndarray) -> Iterator[tuple[int, int]]:
    """(place, prediction) of every pixel in scan order; ``known`` must hold the true pixels before each place."""
    across = (width + (1 << shift) - 1) >> shift
    for at in range(width * height):
        x, y = at % width, at // width
        if not at:
            yield at, 0xFF000000
        elif not y:
            yield at, int(known[at - 1])
        elif not x:
            yield at, int(known[at - width])
        else:
            mode = int(modes[(y >> shift) * across + (x >> shift)]) >> 8 & 15
            yield at, predict(mode, int(known[at - 1]), int(known[at - width]), int(known[at - width - 1]), int(known[at - width + 1]))


def _undo_predictor(pixels: np.ndarray, modes: np.ndarray, shift: int, width: int) -> np.ndarray:
    out = pixels.copy()
    for at, guess in predictions(modes, shift, width, len(pixels) // width, out):
        out[at] = _add(int(pixels[at]), guess)
    return out


def colour_deltas(multiplier: np.ndarray, value: np.ndarray) -> np.ndarray:
    """What one channel adds to another: both are signed bytes, the product is in 32nds."""
    return multiplier.astype(np.uint8).astype(np.int8).astype(np.int32) * value.astype(np.uint8).astype(np.int8) >> 5


def cross_colour(pixels: np.ndarray, factors: np.ndarray, shift: int, width: int, sign: int) -> np.ndarray:
    """Take the colour transform out (``sign`` 1) or put it in (-1)."""
    across = (width + (1 << shift) - 1) >> shift
    at = np.arange(len(pixels))
    f = factors[(at // width >> shift) * across + (at % width >> shift)]
    red, green, blue = (pixels >> s & np.uint32(255) for s in (np.uint32(16), np.uint32(8), np.uint32(0)))
    new_red = (red.astype(np.int32) + sign * colour_deltas(f & np.uint32(255), green)) & 255
    true_red = new_red if sign > 0 else red
    new_blue = (blue.astype(np.int32) + sign * colour_deltas(f >> np.uint32(8) & np.uint32(255), green)
                + sign * colour_deltas(f >> np.uint32(16) & np.uint32(255), true_red)) & 255
    return pixels & np.uint32(0xFF00FF00) | new_red.astype(np.uint32) << np.uint32(16) | new_blue.astype(np.uint32)


def subtract_green(pixels: np.ndarray, sign: int) -> np.ndarray:
    green = pixels >> np.uint32(8) & np.uint32(255)
    green = green if sign > 0 else (np.uint32(256) - green) & np.uint32(255)
    red = (pixels >> np.uint32(16)) + green & np.uint32(255)
    blue = pixels + green & np.uint32(255)
    return pixels & np.uint32(0xFF00FF00) | red << np.uint32(16) | blue


def _packing(colours: int) -> int:
    """Log2 of the pixels that share one when a palette is small."""
    return 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0


def _undo_palette(pixels: np.ndarray, palette: np.ndarray, width: int, height: int) -> np.ndarray:
    pack = _packing(len(palette))
    index = pixels >> np.uint32(8) & np.uint32(255)
    if pack:
        each = 8 >> pack
        index = index.reshape(height, -1, 1) >> (np.arange(1 << pack, dtype=np.uint32) * np.uint32(each)) & np.uint32((1 << each) - 1)
        index = index.reshape(height, -1)[:, :width].reshape(-1)
    return np.concatenate([palette, np.zeros(256, np.uint32)])[index]


def decode(image: bytes) -> np.ndarray:
    """The pixels of one file as a (height, width) array of ARGB numbers."""
    if image[:4] != b"RIFF" or image[8:16] != b"WEBPVP8L" or image[20] != 0x2F:
        raise ValueError("not a lossless image")
    bits = Bits(image[21:20 + struct.unpack_from("<I", image, 16)[0]])
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise ValueError("unknown version")
    undo, coded, seen = [], width, set()
    while bits.read(1):
        kind = bits.read(2)
        if kind in seen:
            raise ValueError("a transform comes twice")
        seen.add(kind)
        if kind == 2:
            undo.append((kind, None, 0, coded))
        elif kind == 3:
            palette = _pixels(bits, bits.read(8) + 1, 1, False)
            table = np.stack([np.cumsum(palette >> np.uint32(s) & np.uint32(255), dtype=np.uint32) & np.uint32(255) for s in (24, 16, 8, 0)])
            palette = table[0] << np.uint32(24) | table[1] << np.uint32(16) | table[2] << np.uint32(8) | table[3]
            undo.append((kind, palette, 0, coded))
            pack = _packing(len(palette))
            coded = (coded + (1 << pack) - 1) >> pack
        else:
            shift = bits.read(3) + 2
            data = _pixels(bits, (coded + (1 << shift) - 1) >> shift, (height + (1 << shift) - 1) >> shift, False)
            undo.append((kind, data, shift, coded))
    pixels = _pixels(bits, coded, height, True)
    for kind, data, shift, wide in reversed(undo):
        if kind == 0:
            pixels = _undo_predictor(pixels, data, shift, wide)
        elif kind == 1:
            pixels = cross_colour(pixels, data, shift, wide, 1)
        elif kind == 2:
            pixels = subtract_green(pixels, 1)
        else:
            pixels = _undo_palette(pixels, data, wide, height)
    return pixels.reshape(height, width)


# Encoder of samples -----------------------------------------------------------------------------------------------------

#: Pieces whose repeats are looked for: clauses, up to a mark, line end or zero byte and what follows of these.
_PIECE = re.compile(rb"[^.,;:!?\n\0]+[.,;:!?\n\0 ]*|[.,;:!?\n\0 ]+")
#: Shortest repeat worth a back-reference; length and distance code end at the other two.
_REPEAT = 7
_LONGEST = 4096
_FARTHEST = (1 << 20) - 120


def _prefix_of(value: int) -> tuple[int, int, int]:
    """Symbol, extra bits and their number of a length or distance."""
    value -= 1
    if value < 4:
        return value, 0, 0
    high = value.bit_length() - 1
    extra = high - 1
    return 2 * high + (value >> extra & 1), value & ((1 << extra) - 1), extra


def _repeats(samples: bytes) -> list[tuple[int, int, int]]:
    """(start, length, distance) of repeats: pieces that came before, joined where they run on."""
    last: dict[bytes, int] = {}
    out: list[tuple[int, int, int]] = []
    start = length = back = 0
    for found in _PIECE.finditer(samples):
        piece, at = found.group(), found.start()
        earlier = last.get(piece)
        last[piece] = at
        if earlier is not None and length and at - earlier == back and length + len(piece) <= _LONGEST:
            length += len(piece)
            continue
        if length >= _REPEAT:
            out.append((start, length, back))
        if earlier is not None and len(piece) <= _LONGEST and at - earlier <= _FARTHEST:
            start, length, back = at, len(piece), at - earlier
        else:
            length = 0
    if length >= _REPEAT:
        out.append((start, length, back))
    return out


def _write_pixels(out: BitWriter, samples: bytes, top: bool, far: bool) -> None:
    """Entropy-coded samples in the green channel; the other channels are constant and take no bits."""
    out.put(0, 1)
    if top:
        out.put(0, 1)
    repeats = _repeats(samples) if far else []
    raw = np.frombuffer(samples, np.uint8)
    covered = np.zeros(len(raw) + 1, np.int8)
    for start, length, _ in repeats:
        covered[start] += 1
        covered[start + length] -= 1
    literal = np.flatnonzero(np.cumsum(covered[:-1], dtype=np.int8) == 0)
    counts = np.bincount(raw[literal], minlength=280).tolist()
    back = [0] * 40
    coded = []
    for start, length, distance in repeats:
        a, b = _prefix_of(length), _prefix_of(distance + 120)
        counts[256 + a[0]] += 1
        back[b[0]] += 1
        coded.append((start, a, b))
    green, distances = code_lengths(counts), code_lengths(back)
    write_lengths(out, green)
    out.put(1, 4)  # red and blue: the one symbol 0
    out.put(1, 4)
    out.put(1 | 1 << 2 | 255 << 3, 11)  # alpha: the one symbol 255
    if repeats:
        write_lengths(out, distances)
    else:
        out.put(1, 4)
    codes, far_codes = canonical(green).tolist(), canonical(distances).tolist()
    if sum(map(bool, green)) == 1:
        green = [0] * 280
    if sum(map(bool, distances)) == 1:
        distances = [0] * 40
    code, size = np.array(codes, np.uint64), np.array(green, np.int64)
    values, sizes = code[raw[literal]], size[raw[literal]]
    if coded:
        order, extra_value, extra_size = [], [], []
        for start, a, b in coded:
            order += [start] * 4
            extra_value += [codes[256 + a[0]], a[1], far_codes[b[0]], b[1]]
            extra_size += [green[256 + a[0]], a[2], distances[b[0]], b[2]]
        where = np.argsort(np.concatenate([literal, np.array(order)]), kind="stable")
        values = np.concatenate([values, np.array(extra_value, np.uint64)])[where]
        sizes = np.concatenate([sizes, np.array(extra_size, np.int64)])[where]
    if len(values):
        out.extend(values, sizes)


def file_of(bits: bytes) -> bytes:
    chunk = b"\x2f" + bits
    padded = chunk + b"\0" * (len(chunk) & 1)
    return b"RIFF" + struct.pack("<I", 12 + len(padded)) + b"WEBPVP8L" + struct.pack("<I", len(chunk)) + padded


def header(out: BitWriter, width: int, height: int) -> None:
    out.put(width - 1, 14)
    out.put(height - 1, 14)
    out.put(0, 1)
    out.put(0, 3)


def encode(samples: bytes, width: int) -> bytes:
    """One opaque grey-less image whose green channel holds ``samples``, ``width`` in each row.

    Up to 16 distinct samples are coded by a palette that packs several pixels into one; others as they are, with
    back-references for repeated pieces.
    """
    if not samples or len(samples) % width or width > MAX_SIDE or len(samples) // width > MAX_SIDE:
        raise ValueError("samples must fill rows of at most 16384 pixels, and at most as many rows")
    height = len(samples) // width
    out = BitWriter()
    header(out, width, height)
    raw = np.frombuffer(samples, np.uint8)
    colours = np.flatnonzero(np.bincount(raw, minlength=256))
    if len(colours) <= 16:
        out.put(1, 1)
        out.put(3, 2)
        out.put(len(colours) - 1, 8)
        steps = np.diff(colours, prepend=0) & 255
        _write_palette(out, steps.astype(np.uint8).tobytes())
        index = np.searchsorted(colours, raw).astype(np.uint8).reshape(height, width)
        pack = _packing(len(colours))
        each, wide = 8 >> pack, (width + (1 << pack) - 1) >> pack
        index = np.pad(index, ((0, 0), (0, (wide << pack) - width))).reshape(height, wide, 1 << pack)
        packed = (index << (np.arange(1 << pack, dtype=np.uint8) * np.uint8(each))).sum(axis=2).astype(np.uint8)
        out.put(0, 1)
        _write_pixels(out, packed.tobytes(), True, False)
    else:
        out.put(0, 1)
        _write_pixels(out, samples, True, True)
    return file_of(out.bytes())


def _write_palette(out: BitWriter, steps: bytes) -> None:
    """The palette's differences: alpha 255 in the first colour and 0 after it, so alpha has a code of two symbols."""
    out.put(0, 1)
    counts = np.bincount(np.frombuffer(steps, np.uint8), minlength=280).tolist()
    green = code_lengths(counts)
    write_lengths(out, green)
    for _ in range(2):
        write_lengths(out, [0] * 256)
    alpha = [1] + [0] * 254 + [1] if len(steps) > 1 else [0] * 255 + [1]
    write_lengths(out, alpha)
    write_lengths(out, [0] * 40)
    codes = canonical(green).tolist()
    single = sum(map(bool, green)) == 1
    for k, value in enumerate(steps):
        if not single:
            out.put(codes[value], green[value])
        if len(steps) > 1:
            out.put(0 if k else 1, 1)


def samples_of(image: bytes) -> bytes:
    """The green channel of a file, row by row."""
    return (decode(image) >> np.uint32(8) & np.uint32(255)).astype(np.uint8).tobytes()
