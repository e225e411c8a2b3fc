"""Progressive JPEG in numpy: coefficient coding and decoding, inverse transform, chroma upsampling and RGB tensors.

A decoder adds each scan, whatever its spectral band and bit position, to whole coefficient arrays; pixels are made once at the end. Entropy coding is exact for any Huffman tables. Two things are done for many symbols at once, and are checked rather than assumed: runs of equal-length symbols, and the correction bits of blocks without new coefficients.
"""

from __future__ import annotations

import heapq
import re
from functools import cache

import numpy as np


class BadJpeg(ValueError):
    """The bytes aren't a JPEG that this decoder knows."""


def _zigzag() -> np.ndarray:
    """The row-major place of each coefficient in zigzag order: along rising and falling diagonals in turn."""
    return np.array(sorted(range(64), key=lambda p: (p // 8 + p % 8, (p // 8 if (p // 8 + p % 8) % 2 else p % 8))))


ZIGZAG = _zigzag()
#: The cosine transform's matrix in whole numbers, so that sums are exact in any order.
SCALE = 12
_COS = np.array([[np.cos((2 * x + 1) * u * np.pi / 16) * (0.5 if u else 8**-0.5) for x in range(8)] for u in range(8)])
_WHOLE = np.rint(_COS * (1 << SCALE))
#: Coefficients in zigzag order times this are pixels in row-major order, times 2^(2 * SCALE).
INVERSE = np.einsum("ux,vy->uvxy", _WHOLE, _WHOLE).reshape(64, 64)[ZIGZAG]
MARKER = re.compile(rb"\xff[^\x00\xd0-\xd7\xff]")
RESTART = re.compile(rb"\xff[\xd0-\xd7]")


# Huffman tables
def code_lengths(counts: dict[int, int]) -> dict[int, int]:
    """Lengths of at most 16 bits of a Huffman code that leaves the all-ones word free."""
    counts = dict(counts)
    while True:
        heap = [(n, k, [s]) for k, (s, n) in enumerate(sorted(counts.items()))] + [(0, -1, [])]  # the last one gets the word left free
        heapq.heapify(heap)
        depth = dict.fromkeys(counts, 0)
        tick = len(heap)
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            for s in a[2] + b[2]:
                depth[s] += 1
            heapq.heappush(heap, (a[0] + b[0], tick, a[2] + b[2]))
            tick += 1
        if max(depth.values()) <= 15:
            return depth
        counts = {s: n // 2 + 1 for s, n in counts.items()}


class Table:
    """A Huffman table from code lengths: word and length by symbol, and symbol and length by the next 16 bits."""

    def __init__(self, lengths: dict[int, int]):
        self.lengths = lengths
        self.symbols = sorted(lengths, key=lambda s: (lengths[s], s))
        self._index()

    @classmethod
    def parsed(cls, counts: bytes, symbols: bytes) -> Table:
        t = cls.__new__(cls)
        lens = [k + 1 for k, n in enumerate(counts) for _ in range(n)]
        t.symbols, t.lengths = list(symbols), dict(zip(symbols, lens, strict=True))
        t._index()
        return t

    def _index(self) -> None:
        self.word, self.look = {}, np.full(1 << 16, -1, np.int32)
        word = last = 0
        for s in self.symbols:
            n = self.lengths[s]
            word <<= n - last
            self.word[s] = word
            self.look[word << (16 - n) : (word + 1) << (16 - n)] = n << 8 | s
            word, last = word + 1, n
        self.list = self.look.tolist()

    def segment(self, kind: int, number: int) -> bytes:
        lens = [self.lengths[s] for s in self.symbols]
        return bytes([kind << 4 | number, *(lens.count(k) for k in range(1, 17)), *self.symbols])


@cache
def _table(counts: bytes, symbols: bytes) -> Table:
    return Table.parsed(counts, symbols)


class Bits:
    """A reader of single codes from entropy-coded bytes without stuffing."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data + b"\xff" * 8, at

    def peek16(self) -> int:
        k = self.at >> 3
        return int.from_bytes(self.data[k : k + 3], "big") >> (8 - (self.at & 7)) & 0xFFFF

    def symbol(self, table: Table) -> int:
        if self.at > 8 * len(self.data):
            raise BadJpeg("a scan ends early")
        hit = table.list[self.peek16()]
        if hit < 0:
            raise BadJpeg("unknown code word")
        self.at += hit >> 8
        return hit & 255

    def take(self, n: int) -> int:
        if not n:
            return 0
        v = self.peek16() >> (16 - n)
        self.at += n
        return v

    def many(self, n: int) -> np.ndarray:
        """The next n bits."""
        k, skip = self.at >> 3, self.at & 7
        self.at += n
        return np.unpackbits(np.frombuffer(self.data, np.uint8, (n + skip + 7) // 8, k))[skip : skip + n]


def extend(v: int, n: int) -> int:
    return v if not n or v >> (n - 1) else v - (1 << n) + 1


def extend_all(v: np.ndarray, n: int) -> np.ndarray:
    return np.where(v >> (n - 1), v, v - ((1 << n) - 1))


# decoding
class Component:
    def __init__(self, ident: int, h: int, v: int, quant: int):
        self.id, self.h, self.v, self.quant = ident, h, v, quant

    def shape(self, width: int, height: int, hmax: int, vmax: int) -> None:
        """wide, high: blocks of the component alone; coefs also has those that fill the last MCUs."""
        across, down = -(-width // (8 * hmax)), -(-height // (8 * vmax))
        self.wide, self.high = -(-(-(-width * self.h // hmax)) // 8), -(-(-(-height * self.v // vmax)) // 8)
        self.coefs = np.zeros((down * self.v, across * self.h, 64), np.int16)


class Image:
    width = height = 0
    restart = 0

    def __init__(self):
        self.components: list[Component] = []
        self.quant: dict[int, np.ndarray] = {}
        self.comments: list[bytes] = []


def decode(data: bytes) -> Image:
    """All scans of a progressive JPEG as coefficient arrays in zigzag order."""
    if data[:2] != b"\xff\xd8":
        raise BadJpeg("no start marker")
    img, tables, at = Image(), {}, 2
    while True:
        while data[at : at + 2] == b"\xff\xff":
            at += 1
        if at + 2 > len(data) or data[at] != 0xFF:
            raise BadJpeg(f"no marker at byte {at}")
        kind = data[at + 1]
        at += 2
        if kind == 0xD9:
            return img
        size = int.from_bytes(data[at : at + 2], "big")
        body = data[at + 2 : at + size]
        at += size
        if kind == 0xC4:
            k = 0
            while k < len(body):
                n = sum(body[k + 1 : k + 17])
                tables[body[k]] = _table(body[k + 1 : k + 17], body[k + 17 : k + 17 + n])
                k += 17 + n
        elif kind == 0xDB:
            k = 0
            while k < len(body):
                wide = body[k] >> 4
                q = np.frombuffer(body, ">u2" if wide else np.uint8, 64, k + 1)
                img.quant[body[k] & 15] = q.astype(np.int64)
                k += 1 + 64 * (1 + wide)
        elif kind == 0xC2:
            if body[0] != 8:
                raise BadJpeg("samples must have 8 bits")
            img.height, img.width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
            img.components = [Component(body[k], body[k + 1] >> 4, body[k + 1] & 15, body[k + 2]) for k in range(6, 6 + 3 * body[5], 3)]
            hmax, vmax = max(c.h for c in img.components), max(c.v for c in img.components)
            for c in img.components:
                c.shape(img.width, img.height, hmax, vmax)
        elif kind == 0xDD:
            img.restart = int.from_bytes(body, "big")
        elif kind == 0xFE:
            img.comments.append(body)
        elif kind == 0xDA:
            end = MARKER.search(data, at)
            if not end:
                raise BadJpeg("no end marker")
            _scan(img, tables, body, data[at : end.start()])
            at = end.start()
        elif 0xC0 <= kind <= 0xCF:
            raise BadJpeg(f"frame type {kind:#x} isn't progressive with Huffman codes")


def _scan(img: Image, tables: dict[int, Table], head: bytes, raw: bytes) -> None:
    by_id = {c.id: c for c in img.components}
    parts = [(by_id[head[k]], head[k + 1] >> 4, head[k + 1] & 15) for k in range(1, 1 + 2 * head[0], 2)]
    first, last, high, low = head[-3], head[-2], head[-1] >> 4, head[-1] & 15
    pieces = [p.replace(b"\xff\x00", b"\xff") for p in (RESTART.split(raw) if img.restart else [raw])]
    if first == 0:
        _dc_scan(img, parts, tables, pieces, high, low)
        return
    (c, _, number) = parts[0]
    whole = c.coefs[: c.high, : c.wide]
    blocks = whole.reshape(-1, 64)
    per = img.restart or len(blocks)
    for k, piece in enumerate(pieces):
        own = blocks[k * per : (k + 1) * per]
        if high == 0:
            _ac_first(piece, tables[0x10 | number], own, first, last, low)
        else:
            _ac_refine(piece, tables[0x10 | number], own, first, last, low)
    if blocks.base is not whole.base and not np.shares_memory(blocks, whole):
        whole[:] = blocks.reshape(whole.shape)


def _dc_scan(img: Image, parts, tables, pieces, high: int, low: int) -> None:
    if len(parts) == 1:
        c = parts[0][0]
        slots = [(c, parts[0][1], c.coefs[: c.high, : c.wide, 0].reshape(-1, 1))]
    else:
        slots = []
        for c, number, _ in parts:
            rows, cols, _ = c.coefs.shape
            grid = c.coefs[:, :, 0].reshape(rows // c.v, c.v, cols // c.h, c.h).transpose(0, 2, 1, 3)
            slots.append((c, number, grid.reshape(-1, c.v * c.h)))  # a copy: one row an MCU
    units = len(slots[0][2])
    per = img.restart or units
    wide = sum(v.shape[1] for _, _, v in slots)
    lists = [tables[n].list for _, n, v in slots for _ in range(v.shape[1])] if not high else []
    for k, piece in enumerate(pieces):
        n = min(per, units - k * per)
        if high:
            got = Bits(piece).many(n * wide).reshape(n, wide).astype(np.int16) << low
        else:
            got = np.array(_differences(piece, lists, n), np.int64).reshape(n, wide)
        j = 0
        for _, _, v in slots:
            own = got[:, j : j + v.shape[1]]
            j += v.shape[1]
            if high:
                v[k * per : k * per + n] |= own
            else:
                v[k * per : k * per + n] = np.cumsum(own.ravel()).reshape(own.shape) << low
    for c, _, v in slots:
        if len(parts) == 1:
            c.coefs[: c.high, : c.wide, 0] = v.reshape(c.high, c.wide)
        else:
            rows, cols, _ = c.coefs.shape
            c.coefs[:, :, 0] = v.reshape(rows // c.v, cols // c.h, c.v, c.h).transpose(0, 2, 1, 3).reshape(rows, cols)


def _differences(data: bytes, lists: list[list[int]], n: int) -> list[int]:
    """n times one DC difference by each of the tables in turn."""
    data += b"\xff" * 8
    at, out = 0, []
    for _ in range(n):
        for look in lists:
            k = at >> 3
            window = int.from_bytes(data[k : k + 5], "big") << (at & 7) & 0xFFFFFFFFFF
            hit = look[window >> 24]
            if hit < 0:
                raise BadJpeg("unknown code word")
            used, size = hit >> 8, hit & 255
            at += used + size
            if size:
                v = window >> (40 - used - size) & ((1 << size) - 1)
                out.append(v if v >> (size - 1) else v - (1 << size) + 1)
            else:
                out.append(0)
    return out


def _ac_first(data: bytes, table: Table, blocks: np.ndarray, first: int, last: int, low: int) -> None:
    width, done = last - first + 1, 0
    hit = table.list[int.from_bytes((data + b"\xff\xff")[:2], "big")]
    size = hit & 255
    if hit > 0 and 0 < size < 16 and (hit >> 8) + size == 8:  # symbols of a byte each, as far as they go
        raw = np.frombuffer(data, np.uint8, min(len(data), len(blocks) * width))
        same = raw >> size == raw[0] >> size
        done = (len(raw) if same.all() else int(same.argmin())) // width
        v = extend_all((raw[: done * width] & ((1 << size) - 1)).astype(np.int16), size)
        blocks[:done, first : last + 1] = v.reshape(done, width) * (1 << low)
    bits, run = Bits(data, done * width * 8), 0
    for b in blocks[done:]:
        if run:
            run -= 1
            continue
        k = first
        while k <= last:
            s = bits.symbol(table)
            r, s = s >> 4, s & 15
            if s:
                k += r
                if k > last:
                    raise BadJpeg("a coefficient is beyond its band")
                b[k] = extend(bits.take(s), s) * (1 << low)
                k += 1
            elif r == 15:
                k += 16
            else:
                run = (1 << r) - 1 + bits.take(r)
                break


def _ac_refine(data: bytes, table: Table, blocks: np.ndarray, first: int, last: int, low: int) -> None:
    bits, one, i, n = Bits(data), 1 << low, 0, len(blocks)

    def correct(band: np.ndarray) -> None:
        """A correction bit for each coefficient of the band that isn't zero."""
        there = band != 0
        more = bits.many(int(there.sum())).astype(bool)
        old = band[there]
        band[there] = old + np.where(more & (np.abs(old) & one == 0), np.sign(old) * one, 0)

    while i < n:
        b, k, run = blocks[i], first, 0
        while k <= last:
            s = bits.symbol(table)
            r, s = s >> 4, s & 15
            if not s and r < 15:
                run = (1 << r) + bits.take(r)
                break
            new = (one if bits.take(1) else -one) if s else 0
            while k <= last:
                if b[k]:
                    if bits.take(1) and not abs(int(b[k])) & one:
                        b[k] += one if b[k] > 0 else -one
                elif r == 0:
                    if new:
                        b[k] = new
                    k += 1
                    break
                else:
                    r -= 1
                k += 1
        if run:
            correct(b[k : last + 1])
            if run > 1:
                correct(blocks[i + 1 : i + run, first : last + 1])
            i += run
        else:
            i += 1


def planes(img: Image) -> list[np.ndarray]:
    """The components' samples at their own resolution."""
    out = []
    for c in img.components:
        q = img.quant[c.quant]
        rows, cols, _ = c.coefs.shape
        flat, px = c.coefs.reshape(-1, 64), np.empty((rows * cols, 64), np.uint8)
        for k in range(0, len(flat), 4096):
            x = (flat[k : k + 4096] * q).astype(np.float64) @ INVERSE
            px[k : k + 4096] = np.clip(np.floor(x / (1 << 2 * SCALE) + 0.5) + 128, 0, 255)
        out.append(px.reshape(rows, cols, 8, 8).transpose(0, 2, 1, 3).reshape(rows * 8, cols * 8))
    return out


def rgb(img: Image) -> np.ndarray:
    """The (height, width, 3) tensor. Chroma is repeated up to full resolution; one component is grey."""
    px = planes(img)
    hmax, vmax = max(c.h for c in img.components), max(c.v for c in img.components)
    grow = lambda a, c: a.repeat(vmax // c.v, axis=0).repeat(hmax // c.h, axis=1)[: img.height, : img.width]
    y = grow(px[0], img.components[0]).astype(np.int16)
    if len(px) == 1:
        return np.repeat(y[:, :, None], 3, axis=2).astype(np.uint8)
    cb, cr = (a.astype(np.int32) - 128 for a in px[1:3])
    if cb.shape != cr.shape:
        cb, cr = grow(cb, img.components[1]), grow(cr, img.components[2])
        grown = lambda a: a
    else:
        grown = lambda a: grow(a, img.components[1])
    part = lambda v: grown((v + (1 << 15) >> 16).astype(np.int16))
    out = np.empty((img.height, img.width, 3), np.uint8)
    # 1.402, 0.344136, 0.714136 and 1.772 times 2^16.
    for k, v in enumerate((91881 * cr, -22553 * cb - 46802 * cr, 116130 * cb)):
        out[:, :, k] = np.clip(y + part(v), 0, 255)
    return out


# encoding
def _stuff(bits: np.ndarray) -> bytes:
    """Bits to bytes, filled with ones, with a zero byte after each 255."""
    return np.packbits(np.concatenate((bits, np.ones(-len(bits) % 8, np.uint8)))).tobytes().replace(b"\xff", b"\xff\x00")


def _spread(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The bits of values, each in its own length."""
    ends = np.cumsum(lengths)
    place = np.repeat(ends, lengths) - np.arange(ends[-1] if len(ends) else 0) - 1
    return (np.repeat(values, lengths) >> place & 1).astype(np.uint8)


_SIZE = np.array([int(v).bit_length() for v in range(1 << 12)], np.int64)


def _magnitudes(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(size, bits) of signed values."""
    size = _SIZE[np.abs(v)]
    return size, np.where(v < 0, v + (1 << size) - 1, v)


class Writer:
    """A JPEG's bytes from coefficient arrays. Values stay below 2^11 in size."""

    def __init__(self, width: int, height: int, components: list[tuple[int, int, int, np.ndarray]], quant: np.ndarray | None = None, comment: bytes = b"", restart: int = 0):
        """components: (id, h, v, coefs), coefs as in Component."""
        self.frame = Image()
        self.frame.width, self.frame.height, self.restart = width, height, restart
        hmax, vmax = max(c[1] for c in components), max(c[2] for c in components)
        for ident, h, v, coefs in components:
            c = Component(ident, h, v, 0)
            c.shape(width, height, hmax, vmax)
            if coefs.shape != c.coefs.shape:
                raise ValueError(f"component {ident} needs coefficients of the shape {c.coefs.shape}")
            c.coefs = coefs
            self.frame.components.append(c)
        q = np.ones(64, int) if quant is None else quant
        self.out = [b"\xff\xd8"]
        if comment:
            self._segment(0xFE, comment)
        self._segment(0xDB, bytes([0, *q.tolist()]))
        parts = b"".join(bytes([c.id, c.h << 4 | c.v, 0]) for c in self.frame.components)
        self._segment(0xC2, bytes([8]) + height.to_bytes(2, "big") + width.to_bytes(2, "big") + bytes([len(components)]) + parts)
        if restart:
            self._segment(0xDD, restart.to_bytes(2, "big"))

    def _segment(self, kind: int, body: bytes) -> None:
        self.out.append(bytes([0xFF, kind]) + (len(body) + 2).to_bytes(2, "big") + body)

    def _start(self, ids: list[int], table: Table | None, kind: int, first: int, last: int, high: int, low: int) -> None:
        if table:
            self._segment(0xC4, table.segment(kind, 0))
        self._segment(0xDA, bytes([len(ids), *(x for i in ids for x in (i, 0)), first, last, high << 4 | low]))

    def _pieces(self, pieces: list[bytes]) -> None:
        for k, p in enumerate(pieces):
            self.out.append(p + (bytes([0xFF, 0xD0 + k % 8]) if k + 1 < len(pieces) else b""))

    def _dc_units(self, ids: list[int]) -> list[np.ndarray]:
        cs = [c for c in self.frame.components if c.id in ids]
        if len(cs) == 1:
            return [cs[0].coefs[: cs[0].high, : cs[0].wide, 0].reshape(-1, 1).astype(np.int64)]
        out = []
        for c in cs:
            rows, cols, _ = c.coefs.shape
            out.append(c.coefs[:, :, 0].reshape(rows // c.v, c.v, cols // c.h, c.h).transpose(0, 2, 1, 3).reshape(-1, c.v * c.h).astype(np.int64))
        return out

    def dc(self, ids: list[int], high: int, low: int, table: Table | None = None) -> None:
        """A DC scan of the components: the first at bit `low` if high is 0, else a refinement."""
        units = self._dc_units(ids)
        n, per = len(units[0]), self.restart or len(units[0])
        cuts = range(0, n, per)
        if high:
            both = np.concatenate(units, axis=1) >> low & 1
            self._start(ids, None, 0, 0, 0, high, low)
            self._pieces([_stuff(both[k : k + per].ravel().astype(np.uint8)) for k in cuts])
            return
        diffs = []
        for k in cuts:
            part = [(u[k : k + per] >> low) for u in units]
            diffs.append(np.concatenate([np.diff(p.ravel(), prepend=0).reshape(p.shape) for p in part], axis=1).ravel())
        sized = [_magnitudes(d) for d in diffs]
        if table is None:
            sizes, counts = np.unique(np.concatenate([s for s, _ in sized]), return_counts=True)
            table = Table(code_lengths(dict(zip(sizes.tolist(), counts.tolist(), strict=True))))
        word, length = np.zeros(16, np.int64), np.zeros(16, np.int64)
        for s in table.symbols:
            word[s], length[s] = table.word[s], table.lengths[s]
        self._start(ids, table, 0, 0, 0, high, low)
        self._pieces([_stuff(_spread(word[s] << s | v, length[s] + s)) for s, v in sized])

    def _blocks(self, ident: int) -> np.ndarray:
        c = next(c for c in self.frame.components if c.id == ident)
        return c.coefs[: c.high, : c.wide].reshape(-1, 64)

    def ac(self, ident: int, first: int, last: int, high: int, low: int) -> None:
        """An AC scan of one component's band."""
        blocks = self._blocks(ident)
        per = self.restart or len(blocks)
        bands = [blocks[k : k + per, first : last + 1].astype(np.int32) for k in range(0, len(blocks), per)]
        if high == 0 and (done := self._uniform(bands, low)):
            table, pieces = done
            self._start([ident], table, 1, first, last, high, low)
            self._pieces(pieces)
            return
        made = [(_ac_refine_tokens if high else _ac_first_tokens)(b, low) for b in bands]
        counts: dict[int, int] = {}
        for tokens in made:
            for s, _ in tokens:
                if s is not None:
                    counts[s] = counts.get(s, 0) + 1
        table = _EOB_RUNS if high and counts.keys() <= _EOB_RUNS.word.keys() else Table(code_lengths(counts))
        self._start([ident], table, 1, first, last, high, low)
        pieces = []
        for tokens in made:
            bits = [x if s is None else np.concatenate((_spread(np.array([table.word[s]]), np.array([table.lengths[s]])), x)) for s, x in tokens]
            pieces.append(_stuff(np.concatenate(bits)))
        self._pieces(pieces)

    @staticmethod
    def _uniform(bands: list[np.ndarray], low: int) -> tuple[Table, list[bytes]] | None:
        """If every coefficient has 7 bits: a byte each, from a code of one bit."""
        v = [np.abs(b) >> low for b in bands]
        if not all(len(x) and x.min() >= 64 and x.max() < 128 for x in v):
            return None
        return _SEVEN, [np.where(b < 0, 127 - x, x).astype(np.uint8).tobytes() for b, x in zip(bands, v, strict=True)]

    def done(self) -> bytes:
        return b"".join([*self.out, b"\xff\xd9"])


_SEVEN = Table({7: 1})
_EOB_RUNS = Table({r << 4: 4 for r in range(15)})
_NO_BITS = np.zeros(0, np.uint8)


def _some(v: int, n: int) -> np.ndarray:
    return np.array([v >> k & 1 for k in range(n - 1, -1, -1)], np.uint8)


def _end_run(run: int) -> tuple[int, np.ndarray]:
    r = run.bit_length() - 1
    return r << 4, _some(run - (1 << r), r)


def _ac_first_tokens(band: np.ndarray, low: int) -> list[tuple[int | None, np.ndarray]]:
    """(symbol, bits that follow) of a band's blocks."""
    out, run = [], 0
    values = np.sign(band) * (np.abs(band) >> low)
    for row in values:
        k = -1
        for j in np.flatnonzero(row):
            if run:
                out.append(_end_run(run))
                run = 0
            zeros = j - k - 1
            out += [(0xF0, _NO_BITS)] * (zeros // 16)
            size, v = _magnitudes(row[j : j + 1].astype(np.int64))
            out.append((int(zeros % 16 << 4 | size[0]), _some(int(v[0]), int(size[0]))))
            k = j
        if k < len(row) - 1:
            run += 1
            if run == 0x7FFF:
                out.append(_end_run(run))
                run = 0
    return [*out, _end_run(run)] if run else out


def _ac_refine_tokens(band: np.ndarray, low: int) -> list[tuple[int | None, np.ndarray]]:
    out: list[tuple[int | None, np.ndarray]] = []
    size = np.abs(band) >> low
    if (size > 1).all():  # nothing new: correction bits alone, behind runs of block ends
        for k in range(0, len(band), 0x7FFF):
            part = size[k : k + 0x7FFF]
            out += [_end_run(len(part)), (None, (part & 1).astype(np.uint8).ravel())]
        return out
    run, waiting = 0, []

    def flush():
        nonlocal run, waiting
        if run:
            out.extend([_end_run(run), (None, np.array(waiting, np.uint8))])
            run, waiting = 0, []

    for row, source in zip(size.tolist(), band.tolist(), strict=True):
        final = max((j for j, v in enumerate(row) if v == 1), default=-1)
        zeros, own = 0, []
        for j, v in enumerate(row):
            if v == 0:
                zeros += 1
                continue
            while zeros > 15 and j <= final:
                flush()
                out.extend([(0xF0, _NO_BITS), (None, np.array(own, np.uint8))])
                zeros, own = zeros - 16, []
            if v > 1:
                own.append(v & 1)
                continue
            flush()
            out.extend([(zeros << 4 | 1, np.array([source[j] > 0], np.uint8)), (None, np.array(own, np.uint8))])
            zeros, own = 0, []
        if final < len(row) - 1 or own:
            run += 1
            waiting += own
            if run == 0x7FFF:
                flush()
    flush()
    return out


# payloads
CODES = Table({s: 4 for s in range(12)})
SLOTS = 6  # blocks of an MCU: four of luma, one of each chroma
COMPONENTS = ((1, 2, 2), (2, 1, 1), (3, 1, 1))
MOST_ACROSS = 4095  # MCUs, as widths and heights have 16 bits


def store(payload: bytes) -> bytes:
    """A payload of whole 64-byte blocks as a colour JPEG with halved chroma. Byte b is the coefficient whose JPEG magnitude has 8 bits, namely b, so a block is 64 bytes in zigzag order. Blocks of zero bytes fill the last MCUs; the comment has the length."""
    raw = np.frombuffer(payload, np.uint8).reshape(-1, 64)
    units = -(-len(raw) // SLOTS)
    down = -(-units // MOST_ACROSS)
    across = -(-units // down)
    full = np.zeros((down * across * SLOTS, 64), np.int16)
    full[: len(raw)] = raw
    full = np.where(full < 128, full - 255, full).astype(np.int16).reshape(down, across, SLOTS, 64)
    luma = full[:, :, :4].reshape(down, across, 2, 2, 64).transpose(0, 2, 1, 3, 4).reshape(2 * down, 2 * across, 64)
    w = Writer(16 * across, 16 * down, [(i, h, v, c) for (i, h, v), c in zip(COMPONENTS, (luma, full[:, :, 4], full[:, :, 5]), strict=True)], comment=f"payload {len(payload)}".encode())
    w.dc([1, 2, 3], 0, 1, CODES)
    for i in (1, 2, 3):
        w.ac(i, 1, 63, 0, 1)
    w.dc([1, 2, 3], 1, 0)
    for i in (1, 2, 3):
        w.ac(i, 1, 63, 1, 0)
    return w.done()


def payload(img: Image) -> bytes:
    """The payload of a decoded image that store() made."""
    note = next((c for c in img.comments if c.startswith(b"payload ")), None)
    if note is None:
        raise BadJpeg("no payload note")
    y, cb, cr = (c.coefs for c in img.components)
    down, across = cb.shape[:2]
    full = np.empty((down, across, SLOTS, 64), np.int16)
    full[:, :, :4] = y.reshape(down, 2, across, 2, 64).transpose(0, 2, 1, 3, 4).reshape(down, across, 4, 64)
    full[:, :, 4], full[:, :, 5] = cb, cr
    return np.where(full < 0, full + 255, full).astype(np.uint8).tobytes()[: int(note[8:])]


def feature(pixels: np.ndarray) -> str:
    """width x height and the mean colour of the whole and of the four quarters, in hexadecimal."""
    h, w, _ = pixels.shape
    parts = [pixels, *(pixels[a : a + h // 2, b : b + w // 2] for a in (0, h - h // 2) for b in (0, w - w // 2))]
    means = [p.reshape(-1, 3).sum(axis=0, dtype=np.int64) // max(1, p.shape[0] * p.shape[1]) for p in parts]
    return f"{w}x{h}:" + "-".join(bytes(m.astype(np.uint8)).hex() for m in means)


__all__ = ["BadJpeg", "Image", "Writer", "decode", "feature", "payload", "planes", "rgb", "store"]
