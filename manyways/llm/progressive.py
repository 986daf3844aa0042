"""Progressive JPEG in numpy: scans of many files are coded and decoded in step, one restart interval beside the other."""

from __future__ import annotations

import struct
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np

INTERVAL = 8

#: Fixed values of the JPEG standard: the zigzag order of an 8 x 8 block, by rule.
ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, (i // 8 if (i // 8 + i % 8) % 2 else i % 8))))


def _inverse() -> np.ndarray:
    """From 64 coefficients in zigzag order to 64 samples in rows."""
    u = np.arange(8)
    c = np.cos((2 * u[:, None] + 1) * u[None, :] * np.pi / 16) * np.where(u == 0, np.sqrt(0.125), 0.5)[None, :]
    full = np.einsum("yv,xu->vuyx", c, c).reshape(64, 64)
    return full[ZIGZAG].astype(np.float32)


IDCT = _inverse()


# ---- Huffman tables -------------------------------------------------------------------------------------------------------


def _codes(counts: list[int], symbols: list[int]) -> dict[int, tuple[int, int]]:
    out, code, at = {}, 0, 0
    for length, n in enumerate(counts, 1):
        for s in symbols[at : at + n]:
            out[s] = (code, length)
            code += 1
        at += n
        code <<= 1
    return out


@lru_cache(64)
def lookup(counts: bytes, symbols: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Symbol and code length for each 16 bits that may come next; length 0: no code."""
    s, n = np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int32)
    for symbol, (code, length) in _codes(list(counts), list(symbols)).items():
        a = code << (16 - length)
        s[a : a + (1 << (16 - length))] = symbol
        n[a : a + (1 << (16 - length))] = length
    return s, n


def _even(symbols: list[int]) -> tuple[bytes, bytes]:
    """A table in which code and further bits are 16 bits together, so that streams are made of 16-bit words."""
    by = sorted(symbols, key=lambda s: (16 - (s & 15), s))
    counts = [sum(16 - (s & 15) == n for s in by) for n in range(1, 17)]
    return bytes(counts), bytes(by)


DC_TABLE = _even(list(range(11)))
AC_TABLE = _even([r << 4 | s for r in range(16) for s in range(1, 10)] + [0xF0, 0])


def _words(table: tuple[bytes, bytes], runs: int, most: int) -> np.ndarray:
    """The 16-bit word of each run and value."""
    codes, out = _codes(list(table[0]), list(table[1])), np.zeros((runs, 2 * most + 1), np.uint16)
    for r in range(runs):
        for v in range(-most, most + 1):
            s = abs(v).bit_length()
            if (v or runs == 1) and (r << 4 | s) in codes:
                out[r, v + most] = codes[r << 4 | s][0] << s | (v if v > 0 else v + (1 << s) - 1 if v else 0)
    return out


_DC, _AC = _words(DC_TABLE, 1, 511), _words(AC_TABLE, 16, 511)
_CODES = _codes(*map(list, AC_TABLE))
_ZRL, _EOB = (np.uint16(_CODES[s][0]) for s in (0xF0, 0))


# ---- encoding -------------------------------------------------------------------------------------------------------------


def grid(blocks: int) -> tuple[int, int]:
    """Columns and rows of 16 x 16 units of a 4:2:0 picture that holds so many blocks."""
    units = -(-blocks // 6)
    wide = min(units, max(64, -(-units // 4095)))
    return wide, -(-units // wide)


def _stuffed(words: np.ndarray, marker: np.ndarray, ends: np.ndarray) -> list[bytes]:
    """Bytes of big-endian words, a 0 behind each 255 that isn't a marker's, cut behind the words at ends."""
    b = words.astype(">u2").view(np.uint8)
    return _stuffed_bytes(b, np.repeat(marker, 2), 2 * ends)


def _stuffed_bytes(b: np.ndarray, marker: np.ndarray, ends: np.ndarray) -> list[bytes]:
    twice = (b == 255) & ~marker
    if twice.any():
        n = 1 + twice.astype(np.int64)
        total = np.cumsum(n)
        out = np.repeat(b, n)
        out[total[twice] - 1] = 0
        ends = np.concatenate(([0], total))[ends]
        b = out
    raw, at, cut = b.tobytes(), 0, []
    for e in ends.tolist():
        cut.append(raw[at:e])
        at = e
    return cut


class _Order:
    """Restart intervals of units that lie in files one after the other: unit numbers in their files, and which end an interval or a file."""

    def __init__(self, per_file: np.ndarray):
        total = np.cumsum(per_file)
        self.n = int(total[-1])
        self.file = np.repeat(np.arange(len(per_file)), per_file)
        self.local = np.arange(self.n) - np.repeat(total - per_file, per_file)
        self.first = self.local % INTERVAL == 0
        self.last = np.zeros(self.n, bool)
        self.last[total - 1] = True
        self.cut = (self.local % INTERVAL == INTERVAL - 1) & ~self.last
        self.number = (self.local // INTERVAL) % 8
        self.total = total


def _ac(values: np.ndarray, order: _Order) -> list[bytes]:
    """A band's first scan of each file. values: units x band."""
    rows, cols = np.nonzero(values)
    n, width = values.shape
    before = np.full(len(rows), -1)
    same = np.zeros(len(rows), bool)
    same[1:] = rows[1:] == rows[:-1]
    before[1:][same[1:]] = cols[:-1][same[1:]]
    run = cols - before - 1
    need = 1 + run // 16
    last = np.full(n, -1)
    last[rows] = cols  # the last one stays
    end = last < width - 1
    per = np.bincount(rows, need, n).astype(np.int64) + end + order.cut
    total = np.cumsum(per)
    begin = total - per
    c = np.cumsum(need)
    row_base = np.zeros(n, np.int64)
    firsts = ~same
    row_base[rows[firsts]] = (c - need)[firsts]
    out = np.full(int(total[-1]), _ZRL, np.uint16)
    out[begin[rows] + c - 1 - row_base[rows]] = _AC[run % 16, values[rows, cols] + 511]
    out[(total - 1 - order.cut)[end]] = _EOB
    marker = np.zeros(len(out), bool)
    at = (total - 1)[order.cut]
    out[at] = 0xFFD0 + order.number[order.cut]
    marker[at] = True
    return _stuffed(out, marker, total[order.total - 1])


def _bits(count: np.ndarray, order: _Order, fill) -> list[bytes]:
    """A scan of single bits: count of each unit's bits; fill(flat, begin) writes them where each unit begins. Intervals end on bytes."""
    group = np.cumsum(order.first) - 1
    bits = np.bincount(group, count).astype(np.int64)
    size = -(-bits // 8)
    begin_byte = np.cumsum(size) - size
    within = np.cumsum(count) - count
    within = within - within[order.first][group]
    flat = np.ones(8 * int(size.sum()), np.uint8)
    fill(flat, 8 * begin_byte[group] + within)
    b = np.packbits(flat)
    closes = order.cut[np.append(np.flatnonzero(order.first)[1:] - 1, order.n - 1)]
    number = order.number[order.first]
    n = size + 2 * closes
    total = np.cumsum(n)
    out, marker = np.zeros(int(total[-1]), np.uint8), np.zeros(int(total[-1]), bool)
    at = (total - 2)[closes]
    marker[at] = marker[at + 1] = True
    out[at], out[at + 1] = 0xFF, 0xD0 + number[closes]
    out[~marker] = b
    return _stuffed_bytes(out, marker, total[np.cumsum(np.bincount(order.file[order.first])) - 1])


def _refined(y: np.ndarray, order: _Order) -> list[bytes]:
    """The refinement of a short band from Al 1 to 0."""
    n, width = y.shape
    known = np.abs(y) >= 2
    plain = known.all(axis=1)
    count = np.full(n, 16 + width)
    odd: dict[int, list[int]] = {}
    for i in np.flatnonzero(~plain).tolist():
        bits: list[int] = []
        held: list[int] = []
        run = 0
        for v in y[i].tolist():
            if abs(v) >= 2:
                held.append(abs(v) & 1)
            elif v:
                code, length = _CODES[run << 4 | 1]
                bits += [code >> j & 1 for j in range(length - 1, -1, -1)] + [int(v > 0), *held]
                held, run = [], 0
            else:
                run += 1
        if run or held:
            bits += [int(_EOB) >> j & 1 for j in range(15, -1, -1)] + held
        odd[i] = bits
        count[i] = len(bits)
    eob = np.array([int(_EOB) >> j & 1 for j in range(15, -1, -1)], np.uint8)

    def fill(flat: np.ndarray, begin: np.ndarray) -> None:
        at = begin[plain][:, None]
        flat[at + np.arange(16)] = eob
        flat[at + 16 + np.arange(width)] = np.abs(y[plain]) & 1
        for i, bits in odd.items():
            flat[begin[i] : begin[i] + len(bits)] = bits

    return _bits(count, order, fill)


def _segment(kind: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, kind, len(body) + 2) + body


_TABLES = _segment(0xC4, b"".join(bytes([k]) + t[0] + t[1] for k, t in ((0x00, DC_TABLE), (0x10, AC_TABLE))))
_HEAD = b"\xff\xd8" + _segment(0xDB, b"\x00" + b"\x01" * 64)


def _scan(components: list[int], ss: int, se: int, ah: int, al: int) -> bytes:
    return _segment(0xDA, bytes([len(components), *(x for c in components for x in (c, 0x00)), ss, se, ah << 4 | al]))


def encode(blocks: list[np.ndarray]) -> list[bytes]:
    """A 4:2:0 progressive file for each array of blocks (n x 64 coefficients, -128 to 127, zigzag order).

    Blocks fill the luma plane's rows, then Cb, then Cr. Scans: all DC without the lowest bit; luma 1-5 without the lowest bit, luma
    6-63; Cb and Cr 1-63; DC's lowest bit; luma 1-5's lowest bit.
    """
    grids = [grid(len(b)) for b in blocks]
    wide = np.array([g[0] for g in grids], np.int64)
    units = np.array([g[0] * g[1] for g in grids], np.int64)
    y, cb, cr = (np.zeros((k * int(units.sum()), 64), np.int16) for k in (4, 1, 1))
    at = np.cumsum(units) - units
    for b, n, a in zip(blocks, units.tolist(), at.tolist(), strict=True):
        y[4 * a : 4 * a + min(len(b), 4 * n)] = b[: 4 * n]
        if len(b) > 4 * n:
            c = b[4 * n : 5 * n]
            cb[a : a + len(c)] = c
            c = b[5 * n :]
            cr[a : a + len(c)] = c
    mcu, luma = _Order(units), _Order(4 * units)
    w = wide[mcu.file]
    row, col = mcu.local // w, mcu.local % w
    corner = 4 * at[mcu.file] + 4 * w * row + 2 * col
    dc = np.column_stack([y[corner, 0], y[corner + 1, 0], y[corner + 2 * w, 0], y[corner + 2 * w + 1, 0], cb[:, 0], cr[:, 0]]).astype(np.int64)
    high = dc >> 1
    before = np.zeros_like(high)
    before[:, 1:4] = high[:, :3]
    before[1:, 0], before[1:, 4:] = high[:-1, 3], high[:-1, 4:]
    before[mcu.first, 0] = 0
    before[np.ix_(mcu.first, [4, 5])] = 0
    words = np.zeros((len(high), 7), np.uint16)
    words[:, :6] = _DC[0, high - before + 511]
    words[:, 6] = 0xFFD0 + mcu.number
    use = np.ones(words.shape, bool)
    use[:, 6] = mcu.cut
    marker = np.zeros(words.shape, bool)
    marker[:, 6] = True
    per = use.sum(axis=1)
    first = _stuffed(words[use], marker[use], np.cumsum(per)[mcu.total - 1])

    def low(flat: np.ndarray, begin: np.ndarray) -> None:
        flat[begin[:, None] + np.arange(6)] = dc & 1

    half = np.sign(y[:, 1:6]) * (np.abs(y[:, 1:6]) >> 1)
    scans = [(_scan([1, 2, 3], 0, 0, 0, 1), first)]
    scans += [(_scan([1], 1, 5, 0, 1), _ac(half, luma)), (_scan([1], 6, 63, 0, 0), _ac(y[:, 6:], luma))]
    scans += [(_scan([i], 1, 63, 0, 0), _ac(c[:, 1:], mcu)) for i, c in ((2, cb), (3, cr))]
    scans += [(_scan([1, 2, 3], 0, 0, 1, 0), _bits(np.full(mcu.n, 6), mcu, low)), (_scan([1], 1, 5, 1, 0), _refined(y[:, 1:6], luma))]
    out = []
    for i, (across, down) in enumerate(grids):
        frame = _segment(0xC2, struct.pack(">BHHB", 8, 16 * down, 16 * across, 3) + b"\x01\x22\x00\x02\x11\x00\x03\x11\x00")
        out.append(b"".join([_HEAD, frame, _TABLES, _segment(0xDD, struct.pack(">H", INTERVAL)), *(x for head, data in scans for x in (head, data[i])), b"\xff\xd9"]))
    return out


# ---- decoding -------------------------------------------------------------------------------------------------------------


@dataclass
class Component:
    name: int
    h: int
    v: int
    q: int
    across: int = 0  # blocks that hold samples
    down: int = 0
    wide: int = 0  # blocks with those that fill the last units
    tall: int = 0


@dataclass
class Picture:
    width: int = 0
    height: int = 0
    components: list[Component] = field(default_factory=list)
    tables: dict[int, np.ndarray] = field(default_factory=dict)
    scans: list[tuple] = field(default_factory=list)
    coefficients: list[np.ndarray] = field(default_factory=list)


def parse(data: bytes) -> Picture:
    """The parts of a file. Raises ValueError where it isn't an 8-bit Huffman-coded JPEG."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("no JPEG")
    p, at, interval, huffman = Picture(), 2, 0, {}
    b = np.frombuffer(data, np.uint8)
    ff = np.flatnonzero(b[:-1] == 255)
    stops = ff[(b[ff + 1] != 0) & ((b[ff + 1] & 0xF8) != 0xD0) & (b[ff + 1] != 255)]
    while at + 4 <= len(data):
        kind = data[at + 1]
        if data[at] != 255:
            raise ValueError("a marker is missing")
        if kind == 0xD9:
            break
        if kind == 255:
            at += 1
            continue
        size = int.from_bytes(data[at + 2 : at + 4], "big")
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if kind == 0xDB:
            while body:
                wide = body[0] >> 4
                n = 65 + 64 * bool(wide)
                p.tables[body[0] & 15] = np.frombuffer(body[1:n], ">u2" if wide else np.uint8).astype(np.float32)
                body = body[n:]
        elif kind == 0xC4:
            while body:
                n = sum(body[1:17])
                huffman[body[0]] = (body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif kind == 0xDD:
            interval = int.from_bytes(body, "big")
        elif kind in (0xC0, 0xC1, 0xC2):
            depth, p.height, p.width, n = struct.unpack(">BHHB", body[:6])
            if depth != 8 or not p.width or not p.height:
                raise ValueError("only 8 bits and known sizes")
            p.components = [Component(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
            most_h, most_v = max(c.h for c in p.components), max(c.v for c in p.components)
            across, down = -(-p.width // (8 * most_h)), -(-p.height // (8 * most_v))
            for c in p.components:
                c.across, c.down = -(-(-(-p.width * c.h // most_h)) // 8), -(-(-(-p.height * c.v // most_v)) // 8)
                c.wide, c.tall = across * c.h, down * c.v
        elif 0xC3 <= kind <= 0xCF and kind != 0xC8 and kind != 0xCC:
            raise ValueError("only Huffman-coded DCT files")
        elif kind == 0xDA:
            n = body[0]
            which = {c.name: i for i, c in enumerate(p.components)}
            parts = tuple((which[body[1 + 2 * i]], body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(n))
            ss, se, a = body[1 + 2 * n : 4 + 2 * n]
            k = np.searchsorted(stops, at)
            end = int(stops[k]) if k < len(stops) else len(data)
            p.scans.append((parts, ss, se, a >> 4, a & 15, interval, tuple((huffman.get(d), huffman.get(16 + c)) for _, d, c in parts), at, end))
            at = end
    if not p.components:
        raise ValueError("no frame")
    return p


def _orders(p: Picture, parts) -> np.ndarray:
    """units x blocks of a unit: the flat numbers of the scan's blocks (component-wise padded grids, one behind the other)."""
    return _unit_blocks(tuple((c.h, c.v, c.across, c.down, c.wide, c.tall) for c in p.components), tuple(i for i, _, _ in parts))


@lru_cache(512)
def _unit_blocks(shape, chosen) -> np.ndarray:
    base = np.cumsum([0, *(s[4] * s[5] for s in shape)])
    if len(chosen) == 1:
        h, v, across, down, wide, _ = shape[chosen[0]]
        return (base[chosen[0]] + np.arange(down)[:, None] * wide + np.arange(across)[None, :]).reshape(-1, 1)
    columns = []
    for i in chosen:
        h, v, _, _, wide, tall = shape[i]
        rows, cols = np.arange(tall // v), np.arange(wide // h)
        for dy in range(v):
            for dx in range(h):
                columns.append((base[i] + (rows[:, None] * v + dy) * wide + cols[None, :] * h + dx).ravel())
    return np.column_stack(columns)


class _Streams:
    """Bits of many intervals; each has its own place."""

    def __init__(self, chunks: list[np.ndarray]):
        sizes = np.array([len(c) for c in chunks], np.int64) + 8
        flat = np.zeros(int(sizes.sum()) + 8, np.uint32)
        self.begin = np.cumsum(sizes) - sizes
        for c, a in zip(chunks, self.begin.tolist(), strict=True):
            flat[a : a + len(c)] = c
        self.window = flat[:-3] << 24 | flat[1:-2] << 16 | flat[2:-1] << 8 | flat[3:]

    def peek(self, pos: np.ndarray) -> np.ndarray:
        """The next 16 bits at each place."""
        return (self.window[pos >> 3] >> (16 - (pos & 7)).astype(np.uint32)).astype(np.int64) & 0xFFFF


def _take(s: _Streams, pos: np.ndarray, n: np.ndarray) -> np.ndarray:
    return s.peek(pos) >> (16 - n)


def _extended(v: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.where(v < (1 << np.maximum(n - 1, 0)), v - (1 << n) + 1, v)


def _scan_together(scan, flat: np.ndarray, units: list[np.ndarray], chunks: list[np.ndarray]) -> None:
    """Decodes intervals (units of block numbers, and their bytes) of one kind of scan into the coefficients."""
    parts, ss, se, ah, al, _, tables = scan[:7]
    s = _Streams(chunks)
    pos = 8 * s.begin
    lengths = np.array([len(u) for u in units])
    width = units[0].shape[1]
    order = np.argsort(-lengths, kind="stable")
    pos, lengths = pos[order], lengths[order]
    blocks = np.zeros((len(units), int(lengths.max()), width), np.int64)
    for i, o in enumerate(order.tolist()):
        blocks[i, : len(units[o])] = units[o]
    if ss == 0:
        of = np.concatenate([np.full(width // len(parts) if len(parts) == 1 else 0, 0), []]).astype(int) if len(parts) == 1 else None
        pred = np.zeros((len(units), len(parts)), np.int64)
        owner = scan[9] if of is None else of
        for u in range(int(lengths.max())):
            n = int(np.searchsorted(-lengths, -u, "left"))
            n = int((lengths > u).sum())
            for j in range(width):
                at, target = pos[:n], blocks[:n, u, j]
                if ah:
                    flat[target, 0] |= ((s.peek(at) >> 15) << al).astype(flat.dtype)
                    pos[:n] = at + 1
                    continue
                k = int(owner[j])
                symbols, sizes = lookup(*tables[k][0])
                code = s.peek(at)
                cat, at = symbols[code], at + sizes[code]
                pred[:n, k] += np.where(cat > 0, _extended(_take(s, at, cat), cat), 0)
                flat[target, 0] = pred[:n, k] << al
                pos[:n] = at + cat
        return
    symbols, sizes = lookup(*tables[0][1])
    blocks = blocks[:, :, 0]
    live = np.arange(len(units))
    b, k = np.zeros(len(units), np.int64), np.full(len(units), ss)
    if not ah:
        while len(live):
            code = s.peek(pos)
            symbol = symbols[code]
            at = pos + sizes[code]
            r, n = symbol >> 4, symbol & 15
            value = n > 0
            more = np.where(value, n, np.where(r < 15, r, 0))
            bits = _take(s, at, more)
            pos = at + more
            k = k + np.where(value | (r == 15), r, 0)
            if (k[value] > 63).any() or (sizes[code] == 0).any():
                raise ValueError("the scan is damaged")
            hit = np.flatnonzero(value)
            flat[blocks[live[hit], b[hit]], k[hit]] = _extended(bits[hit], n[hit]) << al
            k += 1
            ended = ~value & (r < 15)
            b = b + np.where(ended, (1 << np.minimum(r, 14)) + bits, k > se)
            k = np.where(ended | (k > se), ss, k)
            left = b < lengths[live]
            if not left.all():
                live, b, k, pos = live[left], b[left], k[left], pos[left]
        return
    need, run, value, eob = np.ones(len(units), bool), np.zeros(len(units), np.int64), np.zeros(len(units), np.int64), np.zeros(len(units), np.int64)
    bit = 1 << al
    while len(live):
        a = np.flatnonzero(need & (eob == 0))
        if len(a):
            code = s.peek(pos[a])
            symbol, at = symbols[code], pos[a] + sizes[code]
            if (sizes[code] == 0).any():
                raise ValueError("the scan is damaged")
            r, n = symbol >> 4, symbol & 15
            ends = (n == 0) & (r < 15)
            more = np.where(ends, r, n > 0)
            bits = _take(s, at, more)
            pos[a] = at + more
            eob[a] = np.where(ends, (1 << np.minimum(r, 14)) + bits, 0)
            run[a], value[a] = r, np.where(n > 0, np.where(bits > 0, bit, -bit), 0)
            need[a] = False
        target = blocks[live, b]
        now = flat[target, k].astype(np.int64)
        known = now != 0
        fix = known & (s.peek(pos) >> 15 > 0) & (np.abs(now) & bit == 0)
        pos = pos + known
        place = ~known & (eob == 0) & (run == 0)
        flat[target, k] = np.where(fix, now + np.sign(now) * bit, np.where(place, value, now))
        need |= place
        run -= ~known & (eob == 0) & ~place
        k += 1
        over = k > se
        eob -= over & (eob > 0)
        need |= over
        b += over
        k[over] = ss
        left = b < lengths[live]
        if not left.all():
            live, b, k, pos, need, run, value, eob = (x[left] for x in (live, b, k, pos, need, run, value, eob))


def decode_coefficients(files: list[bytes]) -> list[Picture]:
    """Each file's coefficients by component (blocks of the padded grid x 64, zigzag order). Scans of one kind that stand at the
    same place in their files are decoded in step."""
    pictures = [parse(f) for f in files]
    blocks = [sum(c.wide * c.tall for c in p.components) for p in pictures]
    base = np.cumsum([0, *blocks])
    flat = np.zeros((int(base[-1]), 64), np.int16)
    for depth in range(max((len(p.scans) for p in pictures), default=0)):
        kinds: dict[tuple, tuple[list, list]] = {}
        for i, p in enumerate(pictures):
            if depth >= len(p.scans):
                continue
            scan = p.scans[depth]
            parts, ss, se, ah, al, interval, tables, at, end = scan
            if ss == 0 and se:
                raise ValueError("a sequential scan")
            unit = _orders(p, parts) + base[i]
            b = np.frombuffer(files[i], np.uint8, end - at, at)
            ff = np.flatnonzero(b[:-1] == 255)
            after = b[ff + 1]
            marks = ff[after != 0]
            keep = np.ones(len(b), bool)
            keep[ff[after == 0] + 1] = False
            owner = tuple(k for k, (c, _, _) in enumerate(parts) for _ in range(p.components[c].h * p.components[c].v)) if len(parts) > 1 else (0,)
            held = kinds.setdefault((len(parts), ss, se, ah, al, tables, owner), ([], []))
            begins, ends = np.append(0, marks + 2), np.append(marks, len(b))
            step = interval or len(unit)
            for j, (x, y) in enumerate(zip(begins.tolist(), ends.tolist(), strict=True)):
                part = unit[j * step : (j + 1) * step]
                if len(part):
                    held[0].append(part)
                    held[1].append(b[x:y][keep[x:y]])
        for (n, ss, se, ah, al, tables, owner), (units, chunks) in kinds.items():
            _scan_together((range(n), ss, se, ah, al, 0, tables, 0, 0, owner), flat, units, chunks)
    for i, p in enumerate(pictures):
        at = base[i]
        for c in p.components:
            p.coefficients.append(flat[at : at + c.wide * c.tall])
            at += c.wide * c.tall
    return pictures


def pixels(p: Picture) -> np.ndarray:
    """The height x width x 3 tensor: dequantised, inverse-transformed, chroma repeated to full resolution, YCbCr to RGB."""
    most_h, most_v = max(c.h for c in p.components), max(c.v for c in p.components)
    planes = []
    for c, k in zip(p.components, p.coefficients, strict=True):
        samples = (k * p.tables[c.q]).astype(np.float32) @ IDCT
        plane = samples.reshape(c.tall, c.wide, 8, 8).transpose(0, 2, 1, 3).reshape(8 * c.tall, 8 * c.wide)
        plane = np.clip(np.rint(plane + np.float32(128)), 0, 255)
        if (c.h, c.v) != (most_h, most_v):
            plane = plane.repeat(most_v // c.v, axis=0).repeat(most_h // c.h, axis=1)
        planes.append(plane[: p.height, : p.width])
    if len(planes) == 1:
        return np.repeat(planes[0][:, :, None], 3, axis=2).astype(np.uint8)
    y, cb, cr = planes[0], planes[1] - np.float32(128), planes[2] - np.float32(128)
    out = np.empty((p.height, p.width, 3), np.uint8)
    for i, plane in enumerate((y + np.float32(1.402) * cr, y - np.float32(0.344136) * cb - np.float32(0.714136) * cr, y + np.float32(1.772) * cb)):
        out[:, :, i] = np.clip(np.rint(plane), 0, 255)
    return out
