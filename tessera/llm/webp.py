"""Lossless WebP (VP8L) in Python and numpy: a decoder for any valid stream, and two encoders.

The decoder reads prefix codes (simple and normal, with meta prefix codes per tile), LZ77 back-references, and colour
cache codes, and inverts the predictor, cross-colour, subtract-green and palette (colour indexing, bundled) transforms.
Pixels are numpy ``uint32`` ARGB arrays of shape (height, width).

Where a stream's green code has one length and the other literal codes one symbol each (what :func:`encode_samples`
writes), runs of literals are cut from the bit string in bulk; every other stream goes symbol by symbol.
"""

from __future__ import annotations

import heapq
from collections import Counter

import numpy as np

# Fixed values of the format.
ORDER_OF_CODE_LENGTHS = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
NEAR = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2),
    (0, 3), (3, 0), (1, 3), (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3), (3, 2), (-3, 2), (0, 4), (4, 0),
    (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4),
    (-3, 4), (4, 3), (-4, 3), (5, 0), (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2),
    (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1),
    (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3),
    (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1), (4, 6), (-4, 6), (6, 4), (-6, 4),
    (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5),
    (8, 0), (4, 7), (-4, 7), (7, 4), (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7),
    (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)
PREDICTOR, CROSS_COLOR, SUBTRACT_GREEN, PALETTE = range(4)
HASH = 0x1E35A7BD
GREEN, RED, BLUE, ALPHA, DISTANCE = range(5)
MOST = 1 << 14


def tiles(n: int, bits: int) -> int:
    return (n + (1 << bits) - 1) >> bits


class Bits:
    """Reads a bit string, least significant bit first; zeros follow its end."""

    def __init__(self, data: bytes):
        self.data, self.at, self.end = data, 0, 8 * len(data)

    def peek(self, n: int) -> int:
        start = self.at >> 3
        return (int.from_bytes(self.data[start : start + (n >> 3) + 2], "little") >> (self.at & 7)) & ((1 << n) - 1)

    def read(self, n: int) -> int:
        out = self.peek(n) if n else 0
        self.at += n
        if self.at > self.end + 64:
            raise ValueError("the stream ends early")
        return out


class Code:
    """A canonical prefix code: symbol and length for every window of ``longest`` bits."""

    def __init__(self, lengths: np.ndarray | None, only: int | None = None):
        if lengths is None:
            self.only, self.longest = only, 0
            return
        used = np.flatnonzero(lengths)
        if len(used) == 0:
            used, lengths = np.array([0]), np.ones(1, int)
        self.only = int(used[0]) if len(used) == 1 else None
        if self.only is not None:
            self.longest = 0
            return
        of = lengths[used]
        order = np.lexsort((used, of))
        symbols, of = used[order], of[order]
        if np.sum(2.0 ** -of) != 1:
            raise ValueError("a prefix code is not complete")
        self.longest = top = int(of[-1])
        #: symbols by code, where all codes have one length
        self.flat = symbols if of[0] == top else None
        # left-aligned, a complete canonical code's entries lie one after another
        spread = np.repeat(np.arange(len(symbols)), 1 << (top - of))
        backwards = np.zeros(1 << top, np.int64)
        for b in range(top):
            backwards |= ((np.arange(1 << top) >> b) & 1) << (top - 1 - b)
        entry = spread[backwards]
        self.symbols, self.lengths = symbols[entry].tolist(), of[entry].tolist()

    def next(self, bits: Bits) -> int:
        if self.only is not None:
            return self.only
        window = bits.peek(self.longest)
        bits.at += self.lengths[window]
        return self.symbols[window]


def read_code(bits: Bits, alphabet: int) -> Code:
    if bits.read(1):
        two, wide = bits.read(1), bits.read(1)
        first = bits.read(8 if wide else 1)
        if not two:
            return Code(None, first)
        lengths = np.zeros(256, int)
        lengths[[first, bits.read(8)]] = 1
        return Code(lengths)
    lengths = np.zeros(max(alphabet, 256), int)
    of_lengths = np.zeros(19, int)
    for k in ORDER_OF_CODE_LENGTHS[: 4 + bits.read(4)]:
        of_lengths[k] = bits.read(3)
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else alphabet
    code, at, last = Code(of_lengths), 0, 8
    if code.longest == 1 and max(code.symbols) < 16 and left >= alphabet:  # a bit for each symbol
        start = bits.at >> 3
        window = np.frombuffer(bits.data[start : start + (alphabet >> 3) + 2], np.uint8)
        row = np.unpackbits(window, bitorder="little")[bits.at & 7 :][:alphabet]
        bits.read(alphabet)
        lengths[: len(row)] = np.array(code.symbols)[row]
        return Code(lengths)
    while at < alphabet and left:
        left -= 1
        k = code.next(bits)
        if k < 16:
            lengths[at] = k
            last = k or last
            at += 1
            continue
        n, value = (3 + bits.read(2), last) if k == 16 else (3 + bits.read(3), 0) if k == 17 else (11 + bits.read(7), 0)
        if at + n > alphabet:
            raise ValueError("a code has too many lengths")
        lengths[at : at + n] = value
        at += n
    return Code(lengths)


def _prefixed(bits: Bits, k: int) -> int:
    if k < 4:
        return k + 1
    extra = (k - 2) >> 1
    return ((2 + (k & 1)) << extra) + bits.read(extra) + 1


def read_image(bits: Bits, width: int, height: int, main: bool) -> np.ndarray:
    """An entropy-coded image; ``main``: the one that may have meta prefix codes."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    if cache_bits > 11:
        raise ValueError("the colour cache is too large")
    tile, group_of, n_groups = 0, None, 1
    if main and bits.read(1):
        tile = bits.read(3) + 2
        meta = read_image(bits, tiles(width, tile), tiles(height, tile), False)
        group_of = ((meta >> 8) & 0xFFFF).tolist()
        n_groups = max(map(max, group_of)) + 1
    sizes = (256 + 24 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)
    groups = [[read_code(bits, n) for n in sizes] for _ in range(n_groups)]
    total, at = width * height, 0
    out = np.zeros(total, np.uint32)
    cache = [0] * (1 << cache_bits) if cache_bits else None
    if group_of is None and not cache_bits and all(groups[0][k].only is not None for k in (RED, BLUE, ALPHA)) and groups[0][GREEN].longest and groups[0][GREEN].flat is not None:
        _read_flat(bits, groups[0], width, out)
        return out.reshape(height, width)
    green, red, blue, alpha, distance = groups[0]
    cached = 0
    while at < total:
        if group_of is not None:
            green, red, blue, alpha, distance = groups[group_of[(at // width) >> tile][(at % width) >> tile]]
        k = green.next(bits)
        if k < 256:
            r, b = red.next(bits), blue.next(bits)
            out[at] = alpha.next(bits) << 24 | r << 16 | k << 8 | b
            at += 1
        elif k < 280:
            at = _copy(bits, k, distance, width, out, at)
        else:
            if cache is None:
                raise ValueError("a cache code without a cache")
            # the cache takes in pixels only when it is asked
            for p in out[cached:at].tolist():
                cache[((HASH * p) & 0xFFFFFFFF) >> (32 - cache_bits)] = p
            cached = at
            out[at] = cache[k - 280]
            at += 1
        if bits.at > bits.end + 64:
            raise ValueError("the stream ends early")
    return out.reshape(height, width)


def _copy(bits: Bits, k: int, distance: Code, width: int, out: np.ndarray, at: int) -> int:
    n = _prefixed(bits, k - 256)
    d = _prefixed(bits, distance.next(bits))
    if d > 120:
        d -= 120
    else:
        x, y = NEAR[d - 1]
        d = max(1, x + y * width)
    if d > at or at + n > len(out):
        raise ValueError("a back-reference leaves the image")
    if d >= n:
        out[at : at + n] = out[at - d : at - d + n]
    else:
        out[at : at + n] = np.resize(out[at - d : at], n)
    return at + n


def _read_flat(bits: Bits, codes: list[Code], width: int, out: np.ndarray) -> None:
    """Literals of one code length, in bulk up to the next back-reference."""
    rest = np.uint32(codes[ALPHA].only << 24 | codes[RED].only << 16 | codes[BLUE].only)
    n_bits, symbols, at, step = codes[GREEN].longest, codes[GREEN].flat, 0, 1024
    weights = 1 << np.arange(n_bits - 1, -1, -1)
    raw = np.frombuffer(bits.data, np.uint8)
    while at < len(out):
        n = min(step, len(out) - at)
        start = bits.at >> 3
        window = np.unpackbits(raw[start : start + ((n * n_bits) >> 3) + 2], bitorder="little")[bits.at & 7 :][: n * n_bits]
        window = window[: len(window) // n_bits * n_bits].reshape(-1, n_bits)
        if not len(window):
            raise ValueError("the stream ends early")
        code = np.zeros(len(window), np.int64)
        for j, w in enumerate(weights):
            code += window[:, j] * w
        found = symbols[code]
        odd = np.flatnonzero(found >= 256)
        n = int(odd[0]) if len(odd) else len(found)
        out[at : at + n] = found[:n].astype(np.uint32) << 8 | rest
        at, bits.at, step = at + n, bits.at + n * n_bits, min(4 * step, 1 << 18)
        if len(odd):
            bits.at += n_bits
            at, step = _copy(bits, int(found[n]), codes[DISTANCE], width, out, at), 1024


def _split(p: np.ndarray) -> np.ndarray:
    """uint32 (..., ) -> int (..., 4): blue, green, red, alpha."""
    return np.ascontiguousarray(p).view(np.uint8).reshape(*p.shape, 4).astype(np.int32)


def _joined(c: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray((c & 255).astype(np.uint8)).view(np.uint32)[..., 0]


def _average(a, b):
    return [(x + y) >> 1 for x, y in zip(a, b)]


def _clamped(v: int) -> int:
    return 0 if v < 0 else 255 if v > 255 else v


def _predicted(mode: int, left, top, right, corner):
    """Of 4 channels each; right: above and to the right; corner: above and to the left."""
    if mode == 1:
        return left
    if mode == 2:
        return top
    if mode == 3:
        return right
    if mode == 4:
        return corner
    if mode == 5:
        return _average(_average(left, right), top)
    if mode == 6:
        return _average(left, corner)
    if mode == 7:
        return _average(left, top)
    if mode == 8:
        return _average(corner, top)
    if mode == 9:
        return _average(top, right)
    if mode == 10:
        return _average(_average(left, corner), _average(top, right))
    if mode == 11:
        to_left = sum(abs(t - c) for t, c in zip(top, corner))
        to_top = sum(abs(a - c) for a, c in zip(left, corner))
        return left if to_left < to_top else top
    if mode == 12:
        return [_clamped(a + t - c) for a, t, c in zip(left, top, corner)]
    if mode == 13:
        return [_clamped(m + int((m - c) / 2)) for m, c in zip(_average(left, top), corner)]
    return [0, 0, 0, 255]


def _predictions(pixels: np.ndarray, modes: np.ndarray, bits: int, inverse: bool) -> np.ndarray:
    """Add (inverse) or take away what each pixel's neighbours predict. pixels: (h, w, 4)."""
    h, w, _ = pixels.shape
    done = pixels.tolist()  # of true pixels when inverse; else the pixels themselves
    out = [] if not inverse else done
    source = pixels.tolist()
    for y in range(h):
        row = []
        for x in range(w):
            if not y:
                guess = done[0][x - 1] if x else [0, 0, 0, 255]
            elif not x:
                guess = done[y - 1][0]
            else:
                above = done[y - 1]
                # the pixel to the right of the last one above is the first of this row
                right = above[x + 1] if x + 1 < w else done[y][0]
                guess = _predicted(modes[y >> bits][x >> bits], done[y][x - 1], above[x], right, above[x - 1])
            if inverse:
                done[y][x] = [(a + b) & 255 for a, b in zip(source[y][x], guess)]
            else:
                row.append([(a - b) & 255 for a, b in zip(source[y][x], guess)])
        if not inverse:
            out.append(row)
    return np.array(out, np.int32).reshape(h, w, 4)


def _signed(v: np.ndarray) -> np.ndarray:
    return ((v & 255) ^ 128) - 128


def _cross(pixels: np.ndarray, multipliers: np.ndarray, bits: int, inverse: bool) -> np.ndarray:
    """multipliers: (tile rows, tile columns, 4), blue: green to red, green: green to blue, red: red to blue."""
    h, w, _ = pixels.shape
    m = np.repeat(np.repeat(multipliers, 1 << bits, 0), 1 << bits, 1)[:h, :w]
    delta = lambda by, of: (_signed(by) * _signed(of)) >> 5
    out, sign = pixels.copy(), 1 if inverse else -1
    out[..., 2] = (pixels[..., 2] + sign * delta(m[..., 0], pixels[..., 1])) & 255
    red = out[..., 2] if inverse else pixels[..., 2]
    out[..., 0] = (pixels[..., 0] + sign * (delta(m[..., 1], pixels[..., 1]) + delta(m[..., 2], red))) & 255
    return out


def _unbundled(indices: np.ndarray, width: int, bits: int) -> np.ndarray:
    if not bits:
        return indices[:, :width]
    per, depth = 1 << bits, 8 >> bits
    return ((indices[:, :, None] >> (np.arange(per) * depth)) & ((1 << depth) - 1)).reshape(len(indices), -1)[:, :width]


def _bundle_bits(colours: int) -> int:
    return 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0


def chunk(data: bytes) -> bytes:
    """The VP8L chunk of a WebP file, plain or extended."""
    if data[:4] != b"RIFF" or data[8:12] != b"WEBP":
        raise ValueError("not a WebP file")
    at = 12
    while at + 8 <= len(data):
        n = int.from_bytes(data[at + 4 : at + 8], "little")
        if data[at : at + 4] == b"VP8L":
            return data[at + 8 : at + 8 + n]
        at += 8 + n + (n & 1)
    raise ValueError("no lossless image in the file")


def decode(data: bytes) -> np.ndarray:
    """A lossless WebP file -> uint32 ARGB pixels (height, width)."""
    bits = Bits(chunk(data))
    if bits.read(8) != 0x2F:
        raise ValueError("not a lossless stream")
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise ValueError("unknown version")
    undo, seen, now = [], set(), width
    while bits.read(1):
        kind = bits.read(2)
        if kind in seen:
            raise ValueError("a transform occurs twice")
        seen.add(kind)
        if kind in (PREDICTOR, CROSS_COLOR):
            tile = bits.read(3) + 2
            side = _split(read_image(bits, tiles(now, tile), tiles(height, tile), False))
            if kind == PREDICTOR:
                undo.append(lambda p, m=(side[..., 1] & 15).tolist(), t=tile: _joined(_predictions(_split(p), m, t, True)))
            else:
                undo.append(lambda p, m=side, t=tile: _joined(_cross(_split(p), m, t, True)))
        elif kind == SUBTRACT_GREEN:

            def add_green(p):
                c = _split(p)
                c[..., 0] += c[..., 1]
                c[..., 2] += c[..., 1]
                return _joined(c)

            undo.append(add_green)
        else:
            n = bits.read(8) + 1
            colours = np.zeros(256, np.uint32)
            colours[:n] = _joined(np.cumsum(_split(read_image(bits, n, 1, False)[0]), 0))
            pack = _bundle_bits(n)
            undo.append(lambda p, c=colours, w=now, b=pack: c[_unbundled((p >> 8) & 255, w, b)])
            now = tiles(now, pack)
    out = read_image(bits, now, height, True)
    for inverse in reversed(undo):
        out = inverse(out)
    return out


# Encoding.


class Writer:
    """Gathers bits, least significant first."""

    def __init__(self):
        self.parts: list[np.ndarray] = []
        self.number, self.n = 0, 0

    def put(self, value: int, n: int) -> None:
        self.number |= value << self.n
        self.n += n
        if self.n > 2048:
            self.flush()

    def flush(self) -> None:
        if self.n:
            raw = np.frombuffer(self.number.to_bytes((self.n + 7) >> 3, "little"), np.uint8)
            self.parts.append(np.unpackbits(raw, count=self.n, bitorder="little"))
            self.number, self.n = 0, 0

    def bits(self, array: np.ndarray) -> None:
        self.flush()
        self.parts.append(array)

    def bytes(self) -> bytes:
        self.flush()
        return np.packbits(np.concatenate(self.parts), bitorder="little").tobytes()


def _file(stream: bytes) -> bytes:
    pad = b"\0" * (len(stream) & 1)
    return b"RIFF" + (12 + len(stream) + len(pad)).to_bytes(4, "little") + b"WEBPVP8L" + len(stream).to_bytes(4, "little") + stream + pad


def _header(out: Writer, width: int, height: int, alpha: int) -> None:
    out.put(0x2F, 8)
    out.put(width - 1, 14)
    out.put(height - 1, 14)
    out.put(alpha, 1)
    out.put(0, 3)


def _prefix_of(value: int) -> tuple[int, int, int]:
    """Symbol, extra bits, and their number, of a length or a distance."""
    if value <= 4:
        return value - 1, 0, 0
    v = value - 1
    top = v.bit_length() - 1
    second = (v >> (top - 1)) & 1
    extra = top - 1
    return 2 * top + second, v & ((1 << extra) - 1), extra


def _lengths_of(counts: Counter, most: int = 15) -> dict[int, int]:
    """Huffman's code lengths; counts are flattened until none is over ``most``."""
    if len(counts) == 1:
        return dict.fromkeys(counts, 1)
    flat = 0
    while True:
        heap = [(max(n >> flat, 1), k, (s,)) for k, (s, n) in enumerate(sorted(counts.items()))]
        heapq.heapify(heap)
        out, k = dict.fromkeys(counts, 0), len(heap)
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            for s in a[2] + b[2]:
                out[s] += 1
            heapq.heappush(heap, (a[0] + b[0], k, a[2] + b[2]))
            k += 1
        if max(out.values()) <= most:
            return out
        flat += 1


def _codes_of(lengths: dict[int, int]) -> dict[int, tuple[int, int]]:
    """symbol -> (bits in reading order, their number); a lone symbol takes none."""
    if len(lengths) == 1:
        return {s: (0, 0) for s in lengths}
    out, code, last = {}, 0, 0
    for n, s in sorted((n, s) for s, n in lengths.items()):
        code <<= n - last
        out[s] = int(f"{code:0{n}b}"[::-1], 2), n
        code, last = code + 1, n
    return out


def _write_code(out: Writer, lengths: dict[int, int], alphabet: int) -> None:
    if len(lengths) <= 2 and max(lengths, default=0) < 256:
        symbols = sorted(lengths) or [0]
        out.put(1, 1)
        out.put(len(symbols) - 1, 1)
        out.put(1, 1)
        for s in symbols:
            out.put(s, 8)
        return
    out.put(0, 1)
    row = [lengths.get(s, 0) for s in range(alphabet)]
    of = _lengths_of(Counter(row), 7)
    out.put(15, 4)
    for k in ORDER_OF_CODE_LENGTHS:
        out.put(of.get(k, 0), 3)
    out.put(0, 1)
    codes = _codes_of(of)
    for n in row:
        out.put(*codes[n])


def _write_image(out: Writer, pixels: np.ndarray, cache_bits: int = 0, main: bool = False, tile: int = 0) -> None:
    """Greedy LZ77 and the colour cache; ``tile``: two prefix code groups in turn by tiles of 2**tile pixels."""
    h, w = pixels.shape
    flat = pixels.ravel().tolist()
    out.put(1 if cache_bits else 0, 1)
    if cache_bits:
        out.put(cache_bits, 4)
    group_at, n_groups = (lambda at: 0), 1
    if main:
        out.put(1 if tile else 0, 1)
        if tile:
            out.put(tile - 2, 3)
            groups = np.add.outer(np.arange(tiles(h, tile)), np.arange(tiles(w, tile))) % 2
            _write_image(out, (groups << 8).astype(np.uint32))
            group_at, n_groups = (lambda at: int(groups[(at // w) >> tile, (at % w) >> tile])), int(groups.max()) + 1
    cache = [0] * (1 << cache_bits)
    place = lambda p: ((HASH * p) & 0xFFFFFFFF) >> (32 - cache_bits)
    near = {max(1, x + y * w): k + 1 for k, (x, y) in reversed(list(enumerate(NEAR)))}
    tokens, seen, at = [], {}, 0
    while at < len(flat):
        start, n = seen.get(tuple(flat[at : at + 3]), -1), 0
        if start >= 0:
            while at + n < len(flat) and n < 4096 and flat[start + n] == flat[at + n]:
                n += 1
        if n >= 3:
            d = at - start
            ls, le, ln = _prefix_of(n)
            ds, de, dn = _prefix_of(near.get(d, d + 120))
            tokens.append((group_at(at), ((GREEN, 256 + ls), (le, ln), (DISTANCE, ds), (de, dn)), True))
        else:
            n, p = 1, flat[at]
            if cache_bits and cache[place(p)] == p and at:
                tokens.append((group_at(at), ((GREEN, 280 + place(p)),), False))
            else:
                tokens.append((group_at(at), ((GREEN, (p >> 8) & 255), (RED, (p >> 16) & 255), (BLUE, p & 255), (ALPHA, p >> 24)), False))
        for i in range(at, at + n):
            seen[tuple(flat[i : i + 3])] = i
            if cache_bits:
                cache[place(flat[i])] = flat[i]
        at += n
    sizes = (280 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)
    counts = [[Counter() for _ in sizes] for _ in range(n_groups)]
    for g, parts, copy in tokens:
        for kind, s in parts[::2] if copy else parts:
            counts[g][kind][s] += 1
    codes = []
    for group in counts:
        lengths = [_lengths_of(c) if c else {} for c in group]
        for of, n in zip(lengths, sizes):
            _write_code(out, of, n)
        codes.append([_codes_of(of) if of else {} for of in lengths])
    for g, parts, copy in tokens:
        for i, (a, b) in enumerate(parts):
            out.put(*((a, b) if copy and i % 2 else codes[g][a][b]))


def encode(pixels: np.ndarray, modes: np.ndarray | None = None, multipliers: np.ndarray | None = None, tile: int = 2, subtract_green: bool = False, palette: bool = False, cache_bits: int = 0, groups: int = 0) -> bytes:
    """uint32 ARGB pixels -> a lossless WebP file. modes, multipliers: per tile of 2**tile pixels (0 to 13; three signed bytes)."""
    h, w = pixels.shape
    if not (0 < h <= MOST and 0 < w <= MOST):
        raise ValueError("a side is from 1 to 16384 pixels long")
    out, p = Writer(), pixels.astype(np.uint32)
    _header(out, w, h, 1)
    if palette:
        colours, index = np.unique(p, return_inverse=True)
        if len(colours) > 256:
            raise ValueError("a palette has 256 colours at most")
        out.put(1, 1)
        out.put(PALETTE, 2)
        out.put(len(colours) - 1, 8)
        _write_image(out, _joined(np.diff(_split(colours), axis=0, prepend=np.zeros((1, 4), np.int32)))[None, :])
        p = _bundled(index.reshape(h, w), _bundle_bits(len(colours))).astype(np.uint32) << 8 | np.uint32(0xFF000000)
    if modes is not None:
        out.put(1, 1)
        out.put(PREDICTOR, 2)
        out.put(tile - 2, 3)
        _write_image(out, modes.astype(np.uint32) << 8 | np.uint32(0xFF000000))
        p = _joined(_predictions(_split(p), modes.tolist(), tile, False))
    if multipliers is not None:
        out.put(1, 1)
        out.put(CROSS_COLOR, 2)
        out.put(tile - 2, 3)
        side = np.concatenate([multipliers & 255, np.full((*multipliers.shape[:2], 1), 255)], -1)
        _write_image(out, _joined(side))
        p = _joined(_cross(_split(p), side.astype(np.int32), tile, False))
    if subtract_green:
        out.put(1, 1)
        out.put(SUBTRACT_GREEN, 2)
        c = _split(p)
        c[..., 0] -= c[..., 1]
        c[..., 2] -= c[..., 1]
        p = _joined(c)
    out.put(0, 1)
    _write_image(out, p, cache_bits, True, groups)
    return _file(out.bytes())


def _bundled(index: np.ndarray, bits: int) -> np.ndarray:
    if not bits:
        return index
    per, depth = 1 << bits, 8 >> bits
    h, w = index.shape
    wide = np.zeros((h, tiles(w, bits) * per), np.int64)
    wide[:, :w] = index
    return (wide.reshape(h, -1, per) << (np.arange(per) * depth)).sum(-1)


#: A run of equal samples at least so long becomes a back-reference.
RUN = 16


_POWERS = 1 << np.arange(10)


def _write_flat(out: Writer, index: np.ndarray) -> None:
    """The codes and data of an image whose green samples are ``index``, the other channels 0: one code length, back-references for runs."""
    edges = np.concatenate([[-1], np.flatnonzero(np.diff(index)), [len(index) - 1]])
    lengths = np.diff(edges)
    runs = []  # (start, length) of what is copied from the sample before
    for k in np.flatnonzero(lengths > RUN).tolist():
        s, n = int(edges[k]) + 2, int(lengths[k]) - 1
        while n:
            part = min(n, 4096)
            runs.append((s, part))
            s, n = s + part, n - part
    here = np.zeros(280, bool)
    here[index] = True
    if len({_prefix_of(n)[0] for _, n in runs}) + int(here.sum()) > 256:
        runs = []  # over 256 symbols have no complete code of one length in an alphabet of 280
    prefixes = [_prefix_of(n) for _, n in runs]
    for s, _, _ in prefixes:
        here[256 + s] = True
    used = int(here.sum())
    n_bits = max(1, (used - 1).bit_length())
    here[np.flatnonzero(~here)[: (1 << n_bits) - used]] = True
    code = np.cumsum(here) - 1
    # normal code: the code lengths are 0 or n_bits, a bit for each symbol
    out.put(15 << 1, 5)
    for k in ORDER_OF_CODE_LENGTHS:
        out.put(1 if k in (0, n_bits) else 0, 3)
    out.put(0, 1)
    out.bits(here.view(np.uint8))
    for only in (0, 0, 0, 1):  # red, blue, alpha; distance code 1 is the prefix of 2: the sample before
        out.put(1 | 0 << 1 | 1 << 2 | only << 3, 11)
    table = ((code[:, None] & _POWERS[n_bits - 1 :: -1] if n_bits > 1 else code[:, None] & 1) != 0).astype(np.uint8)
    at = 0
    for (s, n), (symbol, extra, extra_bits) in zip(runs, prefixes):
        out.bits(table[index[at:s]].ravel())
        out.bits(table[256 + symbol])
        out.put(extra, extra_bits)
        at = s + n
    out.bits(table[index[at:]].ravel())


def encode_samples(samples: np.ndarray) -> bytes:
    """uint8 samples (height, width) -> a lossless WebP file with a palette, one code length, and back-references for runs.

    One code length costs some size against Huffman's code, and lets a reader take runs of samples in bulk.
    """
    h, w = samples.shape
    used = np.flatnonzero(np.bincount(samples.ravel(), minlength=256))
    place = np.zeros(256, np.int64)
    place[used] = np.arange(len(used))
    index = _bundled(place[samples], _bundle_bits(len(used))).ravel()
    out = Writer()
    _header(out, w, h, 0)
    out.put(1 | PALETTE << 1 | (len(used) - 1) << 3, 11)
    # the palette is an image of its own, without a cache: each colour's difference from the one before
    out.put(0, 1)
    _write_flat(out, np.diff(used, prepend=0))
    # no more transforms, no cache, no meta prefix codes
    out.put(0, 3)
    _write_flat(out, index)
    return _file(out.bytes())
