"""Lossless WebP: a decoder (and a small encoder) of the published VP8L bitstream, and columns made with them.

The decoder reads prefix codes (simple and normal, with meta prefix images), back-references with the two-dimensional
distance codes and the colour cache, and inverts the predictor, cross-colour, subtract-green and palette transforms.
Pixels are rows of (red, green, blue, alpha) bytes.

Prefix codes are decoded for all bit positions of a run at once: tables give, for each position, the symbol that would
start there and where the next one would; the real path is then followed through these. Copied pixels and those from
the cache then point to the pixels that they repeat, and the pointers are shortened by doubling until all end at
literals. Images with several groups of codes are read symbol by symbol.

The encoder looks for pixels in fours that came before. Where those are a share of the image, it writes back-references
and a colour cache, after a palette if there are few colours, or else after the one of subtract-green, cross-colour,
the left or the upper predictor (or none) whose literals have least entropy. Other images are literals alone.
"""

from __future__ import annotations

import functools
import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm import textbytes as tb
from tessella.llm.common import modest_batches

#: Fixed values of the format: the order in which code length code lengths are stored.
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
#: Fixed values of the format: (dx, dy) of the 120 short distance codes, nearest first.
DISTANCES = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3), (-1, 3),
    (3, 1), (-3, 1), (2, 3), (-2, 3), (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4),
    (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0), (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2),
    (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1), (2, 6), (-2, 6), (6, 2), (-6, 2),
    (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1),
    (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5),
    (8, 0), (4, 7), (-4, 7), (7, 4), (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5), (8, 4), (6, 7),
    (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)
#: Fixed value of the format: the colour cache's multiplier.
CACHE_MULTIPLIER = 0x1E35A7BD
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = range(4)
LITERALS, LENGTHS, DISTANCE_SYMBOLS = 256, 24, 40


# ---- reading ----


class Bits:
    """Bits of a byte string, least significant first. Past the end they are 0, as in the format's readers."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0
        self.ended = -1  # lengths of the last code that was read, if it gave their number, else -1

    def read(self, n: int) -> int:
        begin = self.at >> 3
        value = int.from_bytes(self.data[begin : begin + 8], "little") >> (self.at & 7)
        self.at += n
        return value & ((1 << n) - 1)


@functools.lru_cache(maxsize=16)
def _reversals(width: int) -> np.ndarray:
    value, out = np.arange(1 << width), np.zeros(1 << width, np.int64)
    for _ in range(width):
        out = (out << 1) | (value & 1)
        value = value >> 1
    return out


@functools.lru_cache(maxsize=256)
def code_table(lengths: tuple[int, ...]) -> tuple[int, np.ndarray, np.ndarray]:
    """(width, symbols, lengths) by the next width bits of a canonical prefix code. One symbol alone takes no bits."""
    used = np.array(lengths, np.int64)
    symbols = np.flatnonzero(used)
    if len(symbols) == 1:
        return 0, symbols.astype(np.intp), np.zeros(1, np.intp)
    if not len(symbols):
        raise ValueError("a prefix code that is not complete")
    width = int(used.max())
    order = symbols[np.argsort(used[symbols], kind="stable")]
    spans = 1 << (width - used[order])
    if spans.sum() != 1 << width:
        raise ValueError("a prefix code that is not complete")
    found = np.repeat(order, spans)[_reversals(width)]
    return width, found, used[found]


#: Extra bits and least number of repeats of the symbols for runs of code lengths.
_RUNS = {16: (2, 3), 17: (3, 3), 18: (7, 11)}


def _read_codes(bits: Bits, sizes: tuple[int, ...]) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """Tables of codes of these sizes, one after the other; one whose bits are those of the code before isn't read again."""
    codes, size, raw, n = [], -1, 0, 0
    for own in sizes:
        # what ended before its alphabet did is the same code in any alphabet that holds it
        if (own == size or 0 <= bits.ended <= own) and codes and _raw(bits, n) == raw:
            bits.at += n
            codes.append(codes[-1])
            continue
        begin = bits.at
        codes.append(code_table(_read_lengths(bits, own)))
        size, n, bits.at = own, bits.at - begin, begin
        raw = _raw(bits, n)
        bits.at += n
    return codes


def _raw(bits: Bits, n: int) -> int:
    """The next n bits, which aren't passed over."""
    begin = bits.at >> 3
    return (int.from_bytes(bits.data[begin : begin + (n >> 3) + 2], "little") >> (bits.at & 7)) & ((1 << n) - 1)


def _read_lengths(bits: Bits, size: int) -> tuple[int, ...]:
    lengths = [0] * size
    bits.ended = -1
    if bits.read(1):  # simple: one or two symbols
        two = bits.read(1)
        lengths[bits.read(8 if bits.read(1) else 1)] = 1
        if two:
            lengths[bits.read(8)] = 1
        return tuple(lengths)
    first = [0] * 19
    for i in range(4 + bits.read(4)):
        first[LENGTH_ORDER[i]] = bits.read(3)
    most = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else size
    width, symbols, used = code_table(tuple(first))
    symbols, used = symbols.tolist(), used.tolist()
    at, before, data, place = 0, 8, bits.data, bits.at
    mask, window, seen = (1 << width) - 1, 0, 0
    while at < size and most > 0:
        most -= 1
        if seen < 16:  # bits of the window; a symbol takes 14 with its extra bits
            window, seen = int.from_bytes(data[place >> 3 : (place >> 3) + 64], "little") >> (place & 7), 504
        symbol, n = symbols[window & mask], used[window & mask]
        if symbol < 16:
            window >>= n
            place += n
            seen -= n
            if symbol:
                lengths[at] = before = symbol
            at += 1
            continue
        extra, least = _RUNS[symbol]
        times = least + ((window >> n) & ((1 << extra) - 1))
        n += extra
        window >>= n
        place += n
        seen -= n
        if at + times > size:
            raise ValueError("code lengths run over")
        if symbol == 16:
            lengths[at : at + times] = [before] * times
        at += times
    bits.at = place
    bits.ended = at if most <= 0 and at < size else -1
    return tuple(lengths)


def _value(bits: Bits, symbol: int) -> int:
    """A length or distance from its prefix symbol and extra bits."""
    if symbol < 4:
        return symbol + 1
    extra = (symbol - 2) >> 1
    return ((2 + (symbol & 1)) << extra) + bits.read(extra) + 1


class _Cache:
    def __init__(self, width: int):
        self.shift, self.colours = 32 - width, [0] * (1 << width)

    def add(self, colour: int) -> None:
        self.colours[(colour * CACHE_MULTIPLIER & 0xFFFFFFFF) >> self.shift] = colour


def _read_image(bits: Bits, width: int, height: int, top: bool) -> np.ndarray:
    """An entropy-coded image as height * width colours, alpha << 24 | red << 16 | green << 8 | blue."""
    cache_width = bits.read(4) if bits.read(1) else 0
    if cache_width > 11:
        raise ValueError("a colour cache of more than 11 bits")
    groups, which, block = 1, None, 0
    if top and bits.read(1):
        block = 2 + bits.read(3)
        across = (width + (1 << block) - 1) >> block
        which = (_read_image(bits, across, (height + (1 << block) - 1) >> block, False) >> 8) & 0xFFFF
        groups = int(which.max()) + 1
    sizes = (LITERALS + LENGTHS + (1 << cache_width if cache_width else 0), 256, 256, 256, DISTANCE_SYMBOLS)
    codes = [_read_codes(bits, sizes) for _ in range(groups)]
    if groups == 1 and not cache_width and not codes[0][0][1].max() >= LITERALS:
        return _read_literals(bits, width * height, codes[0])
    if groups == 1:
        return _read_tokens(bits, width * height, codes[0], width, cache_width)
    return _read_symbols(bits, width, height, codes, which, block, cache_width)


#: Bits that _read_literals looks at together.
_RUN = 1 << 22


def _read_literals(bits: Bits, n: int, codes: list) -> np.ndarray:
    """n colours of one group of codes without back-references: every bit position is decoded, then the path followed."""
    out = np.empty(n, np.uint32)
    done = 0
    longest = sum(c[0] for c in codes[:4])
    if not longest:  # a single colour, which takes no bits
        out[:] = sum(int(c[1][0]) << s for c, s in zip(codes[:4], (8, 16, 0, 24), strict=True))
        return out
    while done < n:
        first = bits.at >> 3
        data = np.frombuffer(bits.data, np.uint8)[first : first + (_RUN >> 3) + 8]
        own = (bits.at & 7) + (n - done) * longest
        data = np.concatenate([data[: (own >> 3) + 1], np.zeros(24, np.uint8)]).astype(np.intp)
        spots = (len(data) - 24) * 8
        three = data[:-2] | data[1:-1] << 8 | data[2:] << 16
        windows = (three[:, None] >> np.arange(8)[None, :]).ravel() & 0x7FFF
        tables = [(c[1], c[2], (1 << c[0]) - 1) for c in codes[:4]]
        lengths = {}
        for symbols, used, mask in tables:
            if id(used) not in lengths:
                lengths[id(used)] = used[windows & mask] if mask else None
        last = spots + 63

        def after(place: np.ndarray, k: int) -> np.ndarray:
            step = lengths[id(tables[k][1])]
            return place if step is None else place + step[place]

        place = np.arange(spots + 64)
        for k in range(4):
            place = after(place, k)
        place = np.minimum(place, last)
        # the next colour's place, eight at a time
        one = place
        eight = one
        for _ in range(3):
            eight = eight[eight]
        jump, at, starts = memoryview(eight), bits.at & 7, []
        end = min(spots, len(place) - 64)
        while at < end and 8 * len(starts) < n - done:
            starts.append(at)
            at = jump[at]
        rows = np.empty((len(starts), 8), np.intp)
        rows[:, 0] = starts
        for j in range(1, 8):
            rows[:, j] = one[rows[:, j - 1]]
        path = rows.ravel()[: n - done]
        more = done + len(path) < n
        if more:  # colours near the end of what was looked at are read again with the next run
            path = path[path < spots - 64]
            if not len(path):
                raise ValueError("the image ends early")
        colour = np.zeros(len(path), np.uint32)
        where = path
        for k, shift in enumerate((8, 16, 0, 24)):
            symbols, _, mask = tables[k]
            colour |= symbols[windows[where] & mask].astype(np.uint32) << np.uint32(shift)
            where = after(where, k)
        out[done : done + len(path)] = colour
        done += len(path)
        bits.at = (first << 3) + int(where[-1])
        if bits.at > 8 * len(bits.data):
            raise ValueError("the image ends early")
    return out


#: Extra bits of a length or distance symbol, and the least value of one.
_EXTRA = np.array([0 if s < 4 else (s - 2) >> 1 for s in range(DISTANCE_SYMBOLS)], np.intp)
_LEAST = np.array([s + 1 if s < 4 else ((2 + (s & 1)) << ((s - 2) >> 1)) + 1 for s in range(DISTANCE_SYMBOLS)], np.int64)
_LEAP_X, _LEAP_Y = (np.array([d[k] for d in DISTANCES], np.int64) for k in (0, 1))


def _bits_at(data: np.ndarray, at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """n (up to 24) bits from each bit position; data has 4 bytes to spare."""
    byte = at >> 3
    four = data[byte] | data[byte + 1] << 8 | data[byte + 2] << 16 | data[byte + 3] << 24
    return (four >> (at & 7)) & ((1 << n) - 1)


def _read_tokens(bits: Bits, n: int, codes: list, width: int, cache_width: int) -> np.ndarray:
    """n colours of one group of codes with back-references and cache."""
    masks = [(1 << c[0]) - 1 for c in codes]
    (g_symbols, g_used), (r_symbols, r_used), (b_symbols, b_used), (a_symbols, a_used), (d_symbols, d_used) = ((c[1], c[2]) for c in codes)
    first_cache = LITERALS + LENGTHS
    greens, colours, sizes, leaps, have = [], [], [], [], 0
    while have < n:
        first = bits.at >> 3
        data = np.frombuffer(bits.data, np.uint8)[first : first + (_RUN >> 3) + 16]
        whole = first + len(data) >= len(bits.data)
        data = np.concatenate([data, np.zeros(32, np.uint8)]).astype(np.intp)
        spots = (len(data) - 24) * 8
        windows = ((data[:-2] | data[1:-1] << 8 | data[2:] << 16)[:, None] >> np.arange(8)[None, :]).ravel() & 0x7FFF
        last = spots + 160

        def after(place: np.ndarray, used: np.ndarray, mask: int) -> np.ndarray:
            return np.minimum(place + used[windows[place] & mask], last) if mask else place

        here = np.arange(spots + 161)
        green = g_symbols[windows[here] & masks[0]]
        one = after(here, g_used, masks[0])
        follows = one.copy()
        kind = green < LITERALS
        place = one[kind]
        for used, mask in ((r_used, masks[1]), (b_used, masks[2]), (a_used, masks[3])):
            place = after(place, used, mask)
        follows[kind] = place
        kind = ~kind & (green < first_cache)
        place = np.minimum(one[kind] + _EXTRA[green[kind] - LITERALS], last)
        follows[kind] = np.minimum(after(place, d_used, masks[4]) + _EXTRA[d_symbols[windows[place] & masks[4]]], last)
        end = spots if whole else spots - 160  # tokens near the end of what was looked at are read again with the next run
        jump, at, starts, room = memoryview(follows), bits.at & 7, [], n - have
        stuck = len(bits.data) * 8 + 1
        while at < end and len(starts) < room:
            starts.append(at)
            step = jump[at]
            if step == at and len(starts) > stuck:
                break
            at = step
        if not starts:
            raise ValueError("the image ends early")
        path = np.array(starts, np.intp)
        green = g_symbols[windows[path] & masks[0]]
        size, leap, colour = np.ones(len(path), np.int64), np.zeros(len(path), np.int64), np.zeros(len(path), np.uint32)
        lit = green < LITERALS
        place = one[path[lit]]
        value = green[lit].astype(np.uint32) << np.uint32(8)
        for symbols, used, mask, shift in ((r_symbols, r_used, masks[1], 16), (b_symbols, b_used, masks[2], 0), (a_symbols, a_used, masks[3], 24)):
            value |= symbols[windows[place] & mask].astype(np.uint32) << np.uint32(shift)
            place = after(place, used, mask)
        colour[lit] = value
        back = ~lit & (green < first_cache)
        if back.any():
            place, symbol = one[path[back]], green[back] - LITERALS
            size[back] = _LEAST[symbol] + _bits_at(data, place, _EXTRA[symbol])
            place = place + _EXTRA[symbol]
            symbol = d_symbols[windows[place] & masks[4]]
            place = after(place, d_used, masks[4])
            code = _LEAST[symbol] + _bits_at(data, place, _EXTRA[symbol])
            near = np.minimum(code, len(DISTANCES)) - 1
            leap[back] = np.where(code > len(DISTANCES), code - len(DISTANCES), np.maximum(1, _LEAP_X[near] + _LEAP_Y[near] * width))
        upto = np.cumsum(size)
        keep = int(np.searchsorted(upto, room)) + 1  # the token that reaches the end is the last
        if keep < len(path):
            path, green, size, leap, colour = path[:keep], green[:keep], size[:keep], leap[:keep], colour[:keep]
        have += int(size.sum())
        bits.at = (first << 3) + int(follows[path[-1]])
        if bits.at > 8 * len(bits.data):
            raise ValueError("the image ends early")
        for whole_list, part in ((greens, green), (colours, colour), (sizes, size), (leaps, leap)):
            whole_list.append(part)
    if have > n:
        raise ValueError("a back-reference that leaves the image")
    return _resolved(n, *(np.concatenate(x) for x in (greens, colours, sizes, leaps)), cache_width)


def _resolved(n: int, green: np.ndarray, colour: np.ndarray, size: np.ndarray, leap: np.ndarray, cache_width: int) -> np.ndarray:
    """The colours of n pixels from tokens: literals, copies (size, leap) and cache symbols."""
    out = np.repeat(colour, size)
    source = np.arange(n + 1)  # the last one is the empty cache's colour
    copied = np.repeat(leap, size)
    source[:n] -= copied
    if (source < 0).any():
        raise ValueError("a back-reference that leaves the image")
    first_cache = LITERALS + LENGTHS
    while True:  # copies of copies
        further = source[source]
        if (further == source).all():
            break
        source = further
    if cache_width:
        token = np.repeat(green, size)
        cached = (token >= first_cache) & (copied == 0)
        slot = ((out * np.uint32(CACHE_MULTIPLIER)) >> np.uint32(32 - cache_width)).astype(np.int64)
        slot = np.where(cached, token - first_cache, slot)[source[:n]]
        order = np.argsort(slot, kind="stable")
        before = np.full(n, n)
        same = slot[order[1:]] == slot[order[:-1]]
        before[order[1:][same]] = order[:-1][same]
        source[:n] = np.where(cached, before, source[:n])
        while True:
            further = source[source]
            if (further == source).all():
                break
            source = further
    elif (green >= first_cache).any():
        raise ValueError("a cache symbol without a cache")
    return np.append(out, np.uint32(0))[source[:n]]


def _read_symbols(bits: Bits, width: int, height: int, codes: list, which: np.ndarray | None, block: int, cache_width: int) -> np.ndarray:
    n = width * height
    out, at = [0] * n, 0
    cache = _Cache(cache_width) if cache_width else None
    tables = [[((1 << c[0]) - 1, c[1].tolist(), c[2].tolist()) for c in group] for group in codes]
    groups = which.tolist() if which is not None else None
    across = (width + (1 << block) - 1) >> block if groups else 0
    limit = 8 * len(bits.data) + 64

    def symbol(code: tuple) -> int:
        mask, symbols, used = code
        window = int.from_bytes(bits.data[bits.at >> 3 : (bits.at >> 3) + 4], "little") >> (bits.at & 7) & mask
        bits.at += used[window]
        return symbols[window]

    while at < n:
        if bits.at > limit:
            raise ValueError("the image ends early")
        group = tables[groups[(at // width >> block) * across + (at % width >> block)]] if groups else tables[0]
        green = symbol(group[0])
        if green < LITERALS:
            colour = symbol(group[1]) << 16 | green << 8
            colour |= symbol(group[2])
            colour |= symbol(group[3]) << 24
        elif green < LITERALS + LENGTHS:
            length = _value(bits, green - LITERALS)
            code = _value(bits, symbol(group[4]))
            if code > len(DISTANCES):
                back = code - len(DISTANCES)
            else:
                dx, dy = DISTANCES[code - 1]
                back = max(1, dx + dy * width)
            if back > at or at + length > n:
                raise ValueError("a back-reference that leaves the image")
            for i in range(at, at + length):
                out[i] = out[i - back]
                if cache:
                    cache.add(out[i])
            at += length
            continue
        else:
            if cache is None:
                raise ValueError("a cache symbol without a cache")
            colour = cache.colours[green - LITERALS - LENGTHS]
        out[at] = colour
        if cache:
            cache.add(colour)
        at += 1
    return np.array(out, np.uint32)


# ---- transforms ----


def _bytes_of(colours: np.ndarray) -> np.ndarray:
    """(..., 4): blue, green, red, alpha."""
    return colours.astype("<u4").view(np.uint8).reshape(*colours.shape, 4)


def _mode(mode: int, left: np.ndarray, up: np.ndarray, right: np.ndarray, corner: np.ndarray) -> np.ndarray:
    """One pixel's prediction (4 integers) from its neighbours: left, up, up and right, up and left."""

    def mean(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (a + b) >> 1

    if mode == 0:
        return np.array([0, 0, 0, 255])
    if mode <= 4:
        return (left, up, right, corner)[mode - 1]
    if mode == 5:
        return mean(mean(left, right), up)
    if mode <= 9:
        return mean(*((left, corner), (left, up), (corner, up), (up, right))[mode - 6])
    if mode == 10:
        return mean(mean(left, corner), mean(up, right))
    if mode == 11:
        to_left, to_up = np.abs(up - corner).sum(), np.abs(left - corner).sum()
        return left if to_left < to_up else up
    if mode == 12:
        return np.clip(left + up - corner, 0, 255)
    if mode == 13:
        middle = mean(left, up)
        return np.clip(middle + np.trunc((middle - corner) / 2).astype(np.int64), 0, 255)
    raise ValueError("a predictor mode above 13")


def _predictors(modes: np.ndarray, width: int, height: int, block: int) -> np.ndarray:
    rows = ((modes >> 8) & 0xFF).astype(np.int64).reshape((height + (1 << block) - 1) >> block, -1)
    return np.repeat(np.repeat(rows, 1 << block, 0), 1 << block, 1)[:height, :width]


def _predicted(image: np.ndarray, x: int, y: int, mode: int, width: int) -> np.ndarray:
    if y == 0:
        return image[0, x - 1] if x else np.array([0, 0, 0, 255])
    if x == 0:
        return image[y - 1, 0]
    # to the right of the last column stands the row's own first pixel
    right = image[y - 1, x + 1] if x + 1 < width else image[y, 0]
    return _mode(mode, image[y, x - 1], image[y - 1, x], right, image[y - 1, x - 1])


#: Modes whose prediction has nothing of the left neighbour.
_FROM_ABOVE = (0, 2, 3, 4, 8, 9)


def undo_predictor(colours: np.ndarray, modes: np.ndarray, width: int, height: int, block: int) -> np.ndarray:
    """Row by row, and in a row by runs of one mode: those that need only the row above, and the left neighbour's as a
    running sum, are undone together; others pixel by pixel."""
    image = _bytes_of(colours).reshape(height, width, 4).astype(np.int64)
    mode = _predictors(modes, width, height, block)
    image[0, 0] = (image[0, 0] + np.array([0, 0, 0, 255])) & 255
    image[0] = np.cumsum(image[0], axis=0) & 255
    edges = [0, *range(1 << block, width, 1 << block), width]
    for y in range(1, height):
        row, above = image[y], image[y - 1]
        row[0] = (row[0] + above[0]) & 255
        for begin, end in zip(edges, edges[1:], strict=False):
            m, x = int(mode[y, begin]), max(begin, 1)
            if x >= end:
                continue
            if m == 1:
                row[x:end] = (row[x - 1] + np.cumsum(row[x:end], axis=0)) & 255
            elif m in _FROM_ABOVE:
                right = above[x + 1 : end + 1] if end < width else np.concatenate([above[x + 1 :], row[:1]])
                row[x:end] = (row[x:end] + _mode(m, above[x:end], above[x:end], right, above[x - 1 : end - 1])) & 255
            else:
                for i in range(x, end):
                    row[i] = (row[i] + _predicted(image, i, y, m, width)) & 255
    return np.ascontiguousarray(image.astype(np.uint8)).view("<u4").ravel()


def do_predictor(colours: np.ndarray, modes: np.ndarray, width: int, height: int, block: int) -> np.ndarray:
    image = _bytes_of(colours).reshape(height, width, 4).astype(np.int64)
    mode = _predictors(modes, width, height, block)
    out = np.array([[(image[y, x] - _predicted(image, x, y, int(mode[y, x]), width)) & 255 for x in range(width)] for y in range(height)], np.uint8)
    return out.view("<u4").ravel()


def cross_colour(colours: np.ndarray, factors: np.ndarray, width: int, height: int, block: int, sign: int) -> np.ndarray:
    """sign 1 inverts the transform, -1 applies it."""
    image = _bytes_of(colours).reshape(height, width, 4).astype(np.int64)
    rows = _bytes_of(factors).astype(np.int8).astype(np.int64).reshape((height + (1 << block) - 1) >> block, -1, 4)
    each = np.repeat(np.repeat(rows, 1 << block, 0), 1 << block, 1)[:height, :width]
    green_to_red, green_to_blue, red_to_blue = each[..., 0], each[..., 1], each[..., 2]

    def signed(v: np.ndarray) -> np.ndarray:
        return (v & 255).astype(np.uint8).view(np.int8).astype(np.int64)

    green, old_red = signed(image[..., 1]), image[..., 2]
    red = (old_red + sign * ((green_to_red * green) >> 5)) & 255
    true_red = red if sign > 0 else old_red
    blue = image[..., 0] + sign * (((green_to_blue * green) >> 5) + ((red_to_blue * signed(true_red)) >> 5))
    out = np.stack([blue & 255, image[..., 1], red, image[..., 3]], axis=-1).astype(np.uint8)
    return np.ascontiguousarray(out).view("<u4").ravel()


def green_added(colours: np.ndarray, sign: int) -> np.ndarray:
    image = _bytes_of(colours).copy()
    for k in (0, 2):
        image[:, k] += image[:, 1] if sign > 0 else -image[:, 1]
    return image.view("<u4").ravel()


def packing(n: int) -> int:
    """log2 of the pixels that a palette of n colours packs into one."""
    return 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0


def undo_palette(colours: np.ndarray, palette: np.ndarray, width: int, height: int) -> np.ndarray:
    pack = packing(len(palette))
    green = ((colours >> 8) & 0xFF).astype(np.int64).reshape(height, -1)
    if pack:
        step = 8 >> pack
        green = ((green[:, :, None] >> (np.arange(1 << pack) * step)) & ((1 << step) - 1)).reshape(height, -1)[:, :width]
    table = np.zeros(256, np.uint32)  # indices beyond the palette are transparent black
    table[: len(palette)] = palette
    return table[green].ravel()


# ---- files ----


def chunk_of(data: bytes) -> bytes:
    """The VP8L chunk's payload of a RIFF file."""
    if data[:4] != b"RIFF" or data[8:12] != b"WEBP":
        raise ValueError("not a WebP file")
    at = 12
    while at + 8 <= len(data):
        name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        if name == b"VP8L":
            return data[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    raise ValueError("no lossless image in the file")


def decode(data: bytes) -> np.ndarray:
    """Pixels (height, width, 4) as red, green, blue, alpha of a lossless WebP file."""
    bits = Bits(chunk_of(data))
    if bits.read(8) != 0x2F:
        raise ValueError("not a lossless image")
    width, height = bits.read(14) + 1, bits.read(14) + 1
    alpha = bits.read(1)
    if bits.read(3):
        raise ValueError("an unknown version")
    inverse, across = [], width
    while bits.read(1):
        kind = bits.read(2)
        if any(kind == done for done, _ in inverse):
            raise ValueError("a transform used twice")
        if kind in (PREDICTOR, CROSS_COLOUR):
            block = bits.read(3) + 2
            inside = _read_image(bits, (across + (1 << block) - 1) >> block, (height + (1 << block) - 1) >> block, False)
            inverse.append((kind, (inside, across, block)))
        elif kind == SUBTRACT_GREEN:
            inverse.append((kind, ()))
        else:
            n = bits.read(8) + 1
            entries = _bytes_of(_read_image(bits, n, 1, False))
            palette = np.ascontiguousarray(np.cumsum(entries, axis=0, dtype=np.uint8)).view("<u4").ravel()
            inverse.append((kind, (palette, across)))
            pack = packing(n)
            across = (across + (1 << pack) - 1) >> pack
    colours = _read_image(bits, across, height, True)
    for kind, with_ in reversed(inverse):
        if kind == PREDICTOR:
            colours = undo_predictor(colours, with_[0], with_[1], height, with_[2])
        elif kind == CROSS_COLOUR:
            colours = cross_colour(colours, with_[0], with_[1], height, with_[2], 1)
        elif kind == SUBTRACT_GREEN:
            colours = green_added(colours, 1)
        else:
            colours = undo_palette(colours, with_[0], with_[1], height)
    pixels = _bytes_of(colours)[:, [2, 1, 0, 3]].reshape(height, width, 4)
    if not alpha:
        pixels[..., 3] = 255
    return pixels


# ---- writing ----


def code_lengths(counts: np.ndarray, most: int = 15) -> list[int]:
    """Lengths of a prefix code by counts, at most most bits; a single symbol gets length 1."""
    lengths = [0] * len(counts)
    used = np.flatnonzero(counts).tolist()
    if len(used) <= 1:
        for s in used:
            lengths[s] = 1
        return lengths
    weights = counts[used].tolist()
    while True:
        order = sorted(range(len(used)), key=weights.__getitem__)
        depths = _depths([weights[i] for i in order])
        if depths[0] <= most:
            for i, depth in zip(order, depths, strict=True):
                lengths[used[i]] = depth
            return lengths
        weights = [(w >> 1) + 1 for w in weights]  # flatter counts give a shallower tree


def _depths(weights: list[int]) -> list[int]:
    """Depths in a Huffman tree of two or more ascending weights; the first is a deepest one."""
    n = len(weights)
    leaf = inner = 0
    # weights of inner nodes, which ascend as well, and each node's parent: leaves, then inner nodes
    made, parent = [], [0] * (2 * n - 1)
    for k in range(n, 2 * n - 1):
        total = 0
        for _ in (0, 1):
            if leaf < n and (inner == len(made) or weights[leaf] <= made[inner]):
                total += weights[leaf]
                parent[leaf] = k
                leaf += 1
            else:
                total += made[inner]
                parent[n + inner] = k
                inner += 1
        made.append(total)
    depths = [0] * (2 * n - 1)
    for k in range(2 * n - 3, -1, -1):
        depths[k] = depths[parent[k]] + 1
    return depths[:n]


def code_words(lengths: list[int]) -> np.ndarray:
    """Canonical code words, bit-reversed as the format stores them."""
    sizes = np.array(lengths, np.int64)
    out, used = np.zeros(len(sizes), np.int64), np.flatnonzero(sizes)
    if len(used):
        order = used[np.argsort(sizes[used], kind="stable")]
        width = int(sizes[order[-1]])
        spans = 1 << (width - sizes[order])
        out[order] = _reversals(width)[np.cumsum(spans) - spans]  # a word is the first that many bits of its place
    return out


class Writer:
    """Bits, least significant first."""

    def __init__(self) -> None:
        self.value, self.size = 0, 0
        self.total = 0  # bits with those that _put_literals added

    def put(self, value: int, n: int) -> None:
        self.value |= value << self.size
        self.size += n


def _put_lengths(out: Writer, lengths: list[int]) -> None:
    upto = len(lengths)
    while upto and not lengths[upto - 1]:
        upto -= 1
    out.put(*_length_bits(tuple(lengths[:upto])))


@functools.lru_cache(maxsize=64)
def _length_bits(lengths: tuple[int, ...]) -> tuple[int, int]:
    """A prefix code's bits and their number: simple if it has one small symbol, else with runs of zeros as 17 and 18
    and the rest as it is, up to the last symbol, so that alphabets of any size have the same bits for the same code."""
    out = Writer()
    used = [s for s, n in enumerate(lengths) if n]
    if len(used) <= 1 and (not used or used[0] < 256):
        out.put(0b101, 3)  # simple, one symbol, of 8 bits
        out.put(used[0] if used else 0, 8)
        return out.value, out.size
    tokens: list[tuple[int, int, int]] = []
    begin = 0
    for s in used:
        run = s - begin
        while run >= 3:
            some = min(run, 138)
            tokens.append((18, some - 11, 7) if some >= 11 else (17, some - 3, 3))
            run -= some
        tokens += [(0, 0, 0)] * run
        tokens.append((lengths[s], 0, 0))
        begin = s + 1
    counts = np.bincount([t[0] for t in tokens], minlength=19)
    inner = code_lengths(counts, 7)
    if np.count_nonzero(counts) == 1:
        inner[1 if not inner[1] else 0] = 1  # two symbols, so that the code is complete
    words = code_words(inner).tolist()
    last = max(i for i, s in enumerate(LENGTH_ORDER) if inner[s])
    out.put(0, 1)
    out.put(max(0, last - 3), 4)
    for i in range(max(4, last + 1)):
        out.put(inner[LENGTH_ORDER[i]], 3)
    pairs = max(0, (len(tokens) - 2).bit_length() - 1) >> 1  # two tokens at least, as one symbol alone is simple or after zeros
    out.put(1 | pairs << 1, 4)
    out.put(len(tokens) - 2, 2 + 2 * pairs)
    value = at = 0
    for symbol, extra, n in tokens:
        value |= (words[symbol] | extra << inner[symbol]) << at
        at += inner[symbol] + n
    out.put(value, at)
    return out.value, out.size


def _put_literals(out: Writer, colours: np.ndarray, one_code: bool, top: bool) -> bytes:
    """The rest of the stream: codes and all colours as literals. one_code: red, green and blue share lengths."""
    planes = _bytes_of(colours)[:, [1, 2, 0, 3]]  # green, red, blue, alpha, as they are stored
    out.put(0, 1)  # no colour cache
    if top:
        out.put(0, 1)  # one group of codes
    if one_code:
        same = code_lengths(np.bincount(planes[:, :3].ravel(), minlength=256))
        own = [same, same, same, code_lengths(np.bincount(planes[:, 3], minlength=256))]
    else:
        own = [code_lengths(np.bincount(planes[:, k], minlength=256)) for k in range(4)]
    for k, lengths in enumerate(own):
        _put_lengths(out, lengths + [0] * LENGTHS if k == 0 else lengths)
    _put_lengths(out, [0] * DISTANCE_SYMBOLS)
    words, sizes = np.zeros((4, 256), np.int64), np.zeros((4, 256), np.int64)
    for k, lengths in enumerate(own):
        if len(lengths) - lengths.count(0) > 1:
            words[k], sizes[k] = code_words(lengths) if k in (0, 3) or not one_code else words[0], lengths
    n = sizes[np.arange(4), planes].ravel()
    out.total = out.size + int(n.sum())
    return _bytes_with(out, words[np.arange(4), planes].ravel(), n)


#: Pixels of a group that the encoder looks for, and the share of them that must repeat for more than literals.
_FOUR, _REPEATED = 4, 0.125
_LONGEST = 4096
CACHE_BITS = 5


def repeats(colours: np.ndarray) -> np.ndarray:
    """For each pixel the place before at which the same four pixels stand last, or -1."""
    n = len(colours) - _FOUR + 1
    if n < 2:
        return np.zeros(0, np.int64)
    key = np.zeros(n, np.uint64)
    for k in range(_FOUR):
        key = (key ^ colours[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    order = np.argsort(key, kind="stable")
    before = np.full(n, -1)
    same = np.flatnonzero(key[order[1:]] == key[order[:-1]])
    before[order[same + 1]] = order[same]
    return before


def _repeating(colours: np.ndarray) -> bool:
    """Whether fours that came before are more than the share that pays, by the distinct ones of a 32-bit hash."""
    n = len(colours) - _FOUR + 1
    if n < 2:
        return False
    key = colours[:n] * np.uint32(0x9E3779B1)
    for k, odd in enumerate((0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F), 1):
        key ^= colours[k : k + n] * np.uint32(odd)
    key.sort()
    return np.count_nonzero(key[1:] == key[:-1]) > _REPEATED * len(colours)


def _tokens(colours: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, length, distance) of the tokens: copies where four pixels or more came before, else single pixels."""
    n = len(colours)
    places, lengths, distances, at = [], [], [], 0
    for i in np.flatnonzero(before >= 0).tolist():
        if i < at:
            continue
        p, most = int(before[i]), min(_LONGEST, n - i)
        length = 0
        while length < most:  # the match, in growing steps
            step = min(most - length, max(16, length))
            differ = np.flatnonzero(colours[i + length : i + length + step] != colours[p + length : p + length + step])
            length += int(differ[0]) if len(differ) else step
            if len(differ):
                break
        if length < _FOUR:  # another four with the same key
            continue
        places.append(i)
        lengths.append(length)
        distances.append(i - p)
        at = i + length
    copy = np.array(places, np.int64)
    size = np.array(lengths, np.int64)
    inside = np.zeros(n + 1, np.int64)
    np.add.at(inside, copy, 1)
    np.add.at(inside, copy + size, -1)
    single = np.flatnonzero(np.cumsum(inside[:n]) == 0)
    place = np.concatenate([single, copy])
    length = np.concatenate([np.ones(len(single), np.int64), size])
    distance = np.concatenate([np.zeros(len(single), np.int64), np.array(distances, np.int64)])
    order = np.argsort(place)
    return place[order], length[order], distance[order]


def _symbols(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Prefix symbols, extra bits and their number of lengths or distance codes."""
    symbol = np.searchsorted(_LEAST, values, side="right") - 1
    return symbol, values - _LEAST[symbol], _EXTRA[symbol]


def _put_tokens(out: Writer, colours: np.ndarray, width: int, before: np.ndarray, cache_bits: int, top: bool = True) -> bytes:
    """The rest of the stream: codes, and the colours as literals, back-references and cache symbols."""
    place, length, distance = _tokens(colours, before)
    out.put(1, 1)
    out.put(cache_bits, 4)
    if top:
        out.put(0, 1)  # one group of codes
    slot = ((colours * np.uint32(CACHE_MULTIPLIER)) >> np.uint32(32 - cache_bits)).astype(np.int64)
    order = np.argsort(slot, kind="stable")
    hit = np.zeros(len(colours), bool)
    hit[order[1:]] = (slot[order[1:]] == slot[order[:-1]]) & (colours[order[1:]] == colours[order[:-1]])
    copy, cached = distance > 0, hit[place] & (distance == 0)
    literal = ~copy & ~cached
    planes = _bytes_of(colours)[place][:, [1, 2, 0, 3]].astype(np.int64)
    short = {dx + dy * width: k + 1 for k, (dx, dy) in reversed(list(enumerate(DISTANCES))) if dx + dy * width > 0}
    far = np.array([short.get(d, d + len(DISTANCES)) for d in distance[copy].tolist()], np.int64)
    l_symbol, l_extra, l_bits = _symbols(length[copy])
    d_symbol, d_extra, d_bits = _symbols(far)
    symbols = np.zeros((len(place), 4), np.int64)  # of green, red or none, blue or distance, alpha
    symbols[literal] = planes[literal]
    symbols[copy, 0], symbols[copy, 2] = LITERALS + l_symbol, d_symbol
    symbols[cached, 0] = LITERALS + LENGTHS + slot[place[cached]]
    counts = [np.bincount(symbols[:, 0], minlength=LITERALS + LENGTHS + (1 << cache_bits))]
    counts += [np.bincount(symbols[literal, k], minlength=256) for k in (1, 2, 3)]
    counts.append(np.bincount(d_symbol, minlength=DISTANCE_SYMBOLS))
    words, sizes = np.zeros((5, len(counts[0])), np.int64), np.zeros((5, len(counts[0])), np.int64)
    for k, count in enumerate(counts):
        lengths = code_lengths(count)
        _put_lengths(out, lengths)
        if len(lengths) - lengths.count(0) > 1:
            words[k, : len(lengths)], sizes[k, : len(lengths)] = code_words(lengths), lengths
    value, n = np.zeros((len(place), 4), np.int64), np.zeros((len(place), 4), np.int64)
    value[:, 0], n[:, 0] = words[0, symbols[:, 0]], sizes[0, symbols[:, 0]]
    for k in (1, 2, 3):
        value[literal, k], n[literal, k] = words[k, symbols[literal, k]], sizes[k, symbols[literal, k]]
    value[copy, 1], n[copy, 1] = l_extra, l_bits
    value[copy, 2], n[copy, 2] = words[4, d_symbol], sizes[4, d_symbol]
    value[copy, 3], n[copy, 3] = d_extra, d_bits
    return _bytes_with(out, value.ravel(), n.ravel())


def _bytes_with(out: Writer, value: np.ndarray, n: np.ndarray) -> bytes:
    """What was written and values of n bits each."""
    value, n = value[n > 0], n[n > 0].astype(np.int32)
    inside = np.arange(n.sum(), dtype=np.int32) - np.repeat(np.cumsum(n, dtype=np.int32) - n, n)
    body = ((np.repeat(value.astype(np.int32), n) >> inside) & 1).astype(np.uint8)
    head = np.unpackbits(np.frombuffer(out.value.to_bytes((out.size + 7) // 8, "little"), np.uint8), bitorder="little")[: out.size]
    return np.packbits(np.concatenate([head, body]), bitorder="little").tobytes()


def _put_image(out: Writer, colours: np.ndarray) -> None:
    """An image of a transform as literals, into what is written."""
    inner = Writer()
    body = int.from_bytes(_put_literals(inner, colours, False, False), "little")
    out.put(body, inner.total)


def _entropy(colours: np.ndarray) -> float:
    """Bits that the colours take as literals, about."""
    bits = 0.0
    for plane in _bytes_of(colours).T:
        count = np.bincount(plane)
        count = count[count > 0]
        bits += float((count * np.log2(len(plane) / count)).sum()) + 4 * len(count)
    return bits


def _put_rich(out: Writer, colours: np.ndarray, width: int, height: int, before: np.ndarray) -> bytes:
    """Transforms that pay, then tokens."""
    palette, index = np.unique(colours, return_inverse=True)
    if len(palette) <= 256 and 3 * len(palette) <= len(colours):
        pack = packing(len(palette))
        across = (width + (1 << pack) - 1) >> pack
        padded = np.zeros((height, across << pack), np.int64)
        padded[:, :width] = index.reshape(height, width)
        packed = sum(padded[:, i :: 1 << pack] << (i * (8 >> pack)) for i in range(1 << pack)) << 8
        out.put(1, 1)
        out.put(PALETTE, 2)
        out.put(len(palette) - 1, 8)
        entries = _bytes_of(palette)
        _put_image(out, np.ascontiguousarray(np.diff(entries, axis=0, prepend=np.zeros((1, 4), np.uint8))).view("<u4").ravel())
        out.put(0, 1)
        index_image = packed.ravel().astype(np.uint32) | np.uint32(0xFF000000)
        return _put_tokens(out, index_image, across, repeats(index_image), CACHE_BITS)
    block, planes = 9, _bytes_of(colours).reshape(height, width, 4)
    blocks = (height + (1 << block) - 1) >> block
    left, up = planes.copy(), planes.copy()
    for moved in (left, up):  # the first row goes by the left, the first column by the row above, whatever the mode
        moved[0, 1:] -= planes[0, :-1]
        moved[0, 0, 3] -= 255
        moved[1:, 0] -= planes[:-1, 0]
    left[1:, 1:] -= planes[1:, :-1]
    up[1:, 1:] -= planes[:-1, 1:]
    half = np.full(blocks, 16 | 16 << 8, np.uint32)  # red and blue less half of green
    best = min(
        (
            (_entropy(colours), None, None, colours),
            (_entropy(green := green_added(colours, -1)), SUBTRACT_GREEN, None, green),
            (_entropy(cross := cross_colour(colours, half, width, height, block, -1)), CROSS_COLOUR, half, cross),
            (_entropy(a := np.ascontiguousarray(left).view("<u4").ravel()), PREDICTOR, np.full(blocks, 1 << 8, np.uint32), a),
            (_entropy(b := np.ascontiguousarray(up).view("<u4").ravel()), PREDICTOR, np.full(blocks, 2 << 8, np.uint32), b),
        ),
        key=lambda x: x[0],
    )
    _, kind, inside, changed = best
    if kind is not None:
        out.put(1, 1)
        out.put(kind, 2)
        if inside is not None:
            out.put(block - 2, 3)
            _put_image(out, inside)
    out.put(0, 1)
    return _put_tokens(out, changed, width, before if kind is None else repeats(changed), CACHE_BITS)


def encode(pixels: np.ndarray, one_code: bool = True) -> bytes:
    """A lossless WebP file of pixels (height, width, 3 or 4)."""
    height, width, channels = pixels.shape
    whole = np.full((height * width, 4), 255, np.uint8)
    whole[:, [2, 1, 0, 3][:channels]] = pixels.reshape(-1, channels)
    colours = whole.view("<u4").ravel()
    out = Writer()
    out.put(0x2F, 8)
    out.put(width - 1, 14)
    out.put(height - 1, 14)
    out.put(int(channels == 4), 1)
    out.put(0, 3)
    if _repeating(colours):
        return riff(_put_rich(out, colours, width, height, repeats(colours)))
    out.put(0, 1)  # no transform
    return riff(_put_literals(out, colours, one_code, True))


def riff(stream: bytes) -> bytes:
    padded = stream + b"\0" * (len(stream) & 1)
    return b"RIFF" + struct.pack("<I", 12 + len(padded)) + b"WEBPVP8L" + struct.pack("<I", len(stream)) + padded


# ---- columns ----

#: Payloads are padded with spaces to a positive multiple of this: a row of 64 pixels.
ROW = 192
#: Rows of one image at most; a longer payload is stored as several images, one after the other.
MAX_ROWS = 16_383


def payload_of(text: bytes) -> bytes:
    return text + b" " * (-len(text) % ROW if text else ROW)


def store(payload: bytes) -> bytes:
    """A payload as images of 64 pixels a row, one byte a sample."""
    most = ROW * MAX_ROWS
    return b"".join(encode(np.frombuffer(payload[at : at + most], np.uint8).reshape(-1, 64, 3)) for at in range(0, len(payload), most))


def images(media: bytes) -> Iterator[np.ndarray]:
    at = 0
    while at < len(media):
        size = 8 + struct.unpack_from("<I", media, at + 4)[0]
        yield decode(media[at : at + size])
        at += size


def load(media: bytes) -> bytes:
    return b"".join(pixels[..., :3].tobytes() for pixels in images(media))


def feature(payload: bytes) -> str:
    """64 bits as hex: whether each of 64 column means of all rows is above their mean."""
    columns = np.frombuffer(payload, np.uint8).reshape(-1, 64, 3).sum(axis=(0, 2), dtype=np.int64)
    return np.packbits(columns * 64 > columns.sum()).tobytes().hex()


def media_columns(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, media.

    A null text counts as empty, whose payload is ROW spaces. Rows are independent, so equal texts get equal values and
    ties or repeated ids change nothing. A very long text is several images of MAX_ROWS rows, one after the other. An
    empty table gives no rows. Only doc_id and text are read, so further columns change nothing.
    """
    import zlib

    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in tb.slices(batches):
            out = []
            for one in texts:
                media = store(payload_of(one))
                back = load(media)
                out.append((len(one), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature(back), media))
            columns = list(zip(*out, strict=True))
            types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), *[pa.array(c, t) for c, t in zip(columns, types, strict=True)]], names=names)

    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "media"]
    rows = modest_batches(docs).select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, media binary")


def pixel_arrays(files: DataFrame, media: str = "media") -> DataFrame:
    """files with width, height, pixels (binary rows of red, green, blue, alpha) and error.

    A file that is null or that isn't a whole lossless WebP image gets nulls and the reason in error. Columns of these
    names are replaced.
    """
    from pyspark.sql.types import BinaryType, IntegerType, StringType, StructField, StructType

    kept = modest_batches(files).drop("width", "height", "pixels", "error")
    schema = StructType([*kept.schema.fields, StructField("width", IntegerType()), StructField("height", IntegerType()), StructField("pixels", BinaryType()), StructField("error", StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for one in batch.column(media).to_pylist():
                try:
                    if one is None:
                        raise ValueError("null")
                    found = decode(one)
                    out.append((found.shape[1], found.shape[0], found.tobytes(), None))
                except (ValueError, IndexError, struct.error) as e:
                    out.append((None, None, None, str(e)))
            w, h, p, e = zip(*out, strict=True) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(w, pa.int32()), pa.array(h, pa.int32()), pa.array(p, pa.binary()), pa.array(e, pa.string())], names=[*batch.schema.names, "width", "height", "pixels", "error"])

    return kept.mapInArrow(run, schema)
