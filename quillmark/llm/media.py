"""Media columns: lossless storage of byte payloads in baseline JPEG, and DC-only thumbnails.

A payload byte less 128 becomes one quantised coefficient, which is what a baseline scan stores without loss. An MCU has
three blocks (Y, Cb, Cr), thus 192 bytes. The scan is Huffman-coded as usual: categories of DC differences, run lengths and categories
of the others, end of block; with tables of optimal length for the counts of each image. A restart marker follows each
MCU, so that segments can be decoded side by side.

The reader takes any baseline JPEG: it walks the markers, Huffman-decodes all scans and dequantises the DC
coefficients of the first component into a thumbnail of one pixel for each block. Scans with restart intervals are decoded
in numpy, a symbol of every segment of every image of a batch at a time; the others bit by bit.
"""

from __future__ import annotations

import hashlib
import heapq
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.llm.common import lean

UNIT = 192
#: Blocks in a column of an image: 65,535 pixels at most.
MAX_ROWS = 8191
#: Bytes that are coded or decoded at once; a longer image forms a batch of its own.
BATCH_BYTES = 1 << 21


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _header(width: int, height: int, dc: tuple[bytes, bytes], ac: tuple[bytes, bytes]) -> bytes:
    quantiser = _segment(0xDB, bytes([0]) + bytes([1] * 64))
    frame = _segment(0xC0, struct.pack(">BHHB", 8, height, width, 3) + b"".join(bytes([c, 0x11, 0]) for c in (1, 2, 3)))
    tables = _segment(0xC4, bytes([0x00]) + dc[0] + dc[1]) + _segment(0xC4, bytes([0x10]) + ac[0] + ac[1])
    restart = _segment(0xDD, struct.pack(">H", 1))
    scan = _segment(0xDA, bytes([3, 1, 0x00, 2, 0x00, 3, 0x00, 0, 63, 0]))
    return b"\xff\xd8" + quantiser + frame + tables + restart + scan


def huffman(counts: np.ndarray) -> tuple[bytes, bytes]:
    """(codes of each length from 1 to 16, symbols in order of their codes) for the counts of 256 symbols.

    A symbol that does not occur takes the last place, which is the code of ones that JPEG leaves out. Counts are
    halved until no code is longer than 16 bits.
    """
    used = np.flatnonzero(counts).tolist()
    weight = [int(counts[k]) for k in used]
    while True:
        heap = [(w, k, (k,)) for k, w in enumerate(weight)] + [(0, len(weight), (len(weight),))]
        heapq.heapify(heap)
        length = [0] * (len(weight) + 1)
        turn = len(heap)
        while len(heap) > 1:
            (a, _, x), (b, _, y) = heapq.heappop(heap), heapq.heappop(heap)
            for k in x + y:
                length[k] += 1
            heapq.heappush(heap, (a + b, turn, x + y))
            turn += 1
        if max(length) <= 16:
            break
        weight = [(w + 1) // 2 for w in weight]
    length.pop()  # the last place is one of the longest codes, and its own is left out
    order = sorted(range(len(used)), key=lambda k: (length[k], used[k]))
    return bytes(np.bincount(length, minlength=17)[1:17].astype(np.uint8)), bytes(used[k] for k in order)


def pad(data: bytes) -> bytes:
    """Bytes 32 appended up to a positive multiple of the unit."""
    return data + b" " * (-len(data) % UNIT if data else UNIT)


def _columns(mcus: int) -> int:
    """The largest divisor up to 64, so that the image is a full rectangle."""
    return max(d for d in range(1, 65) if mcus % d == 0)


def _category(x: np.ndarray) -> np.ndarray:
    """Bits of the magnitude."""
    return _CATEGORIES[np.abs(x)]


_CATEGORIES = np.array([int(k).bit_length() for k in range(1 << 12)], dtype=np.int64)


def _tokens(v: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of blocks of 64 coefficients whose DC is coded as it is: (block, is it DC, symbol, value) of each token."""
    blocks = len(v)
    at = np.flatnonzero(v[:, 1:])
    block, place = np.divmod(at, 63)
    first = np.ones(len(at), dtype=bool)
    first[1:] = block[1:] != block[:-1]
    run = place - np.where(first, 0, np.concatenate([[0], place[:-1]]) + 1)
    long_runs = run >> 4
    own = np.bincount(block, weights=1 + long_runs, minlength=blocks).astype(np.int64)
    last = np.full(blocks, -1)
    last[block] = place
    ends = (last < 62).astype(np.int64)
    begin = np.concatenate([[0], np.cumsum(own + 1 + ends)])
    ended = np.concatenate([[0], np.cumsum(ends)[:-1]])
    n = int(begin[-1])
    symbol, value = np.full(n, 0xF0, dtype=np.int64), np.zeros(n, dtype=np.int64)  # what is not overwritten is a run of 16 zeros
    is_dc = np.zeros(n, dtype=bool)
    dc = v[:, 0].astype(np.int64)
    is_dc[begin[:-1]] = True
    symbol[begin[:-1]], value[begin[:-1]] = _category(dc), dc
    to = np.cumsum(1 + long_runs) + block + ended[block]
    ac = v[:, 1:].reshape(-1)[at].astype(np.int64)
    symbol[to], value[to] = (run & 15) << 4 | _category(ac), ac
    symbol[(begin[1:] - 1)[ends > 0]] = 0
    return np.repeat(np.arange(blocks), own + 1 + ends), is_dc, symbol, value


def _encode_images(payloads: list[np.ndarray]) -> list[bytes]:
    """One image for each payload."""
    mcus = np.array([len(p) // UNIT for p in payloads])
    v = np.concatenate(payloads).astype(np.int16).reshape(-1, 64) - 128
    block, is_dc, symbol, value = _tokens(v)
    mcu = block // 3
    image = np.repeat(np.arange(len(payloads)), mcus)[mcu]
    row = 2 * image + is_dc
    counts = np.bincount(row * 256 + symbol, minlength=512 * len(payloads)).reshape(-1, 256)
    books = [huffman(c) for c in counts]
    code, length = np.zeros(counts.shape, dtype=np.int64), np.zeros(counts.shape, dtype=np.int64)
    for k, book in enumerate(books):
        for (n, c), x in _codes(*book).items():
            code[k, x], length[k, x] = c, n
    size = np.where(is_dc, symbol, symbol & 15)
    bits = code[row, symbol] << size | np.where(value < 0, value + (1 << size) - 1, value)
    n = length[row, symbol] + size
    # each MCU fills whole bytes, the rest of the last one with ones
    used = np.bincount(mcu, weights=n, minlength=len(v) // 3).astype(np.int64)
    whole = (used + 7) // 8
    start = np.concatenate([[0], np.cumsum(whole)])
    before = np.concatenate([[0], np.cumsum(n)[:-1]])
    offset = before - np.concatenate([[0], np.cumsum(used)[:-1]])[mcu] + 8 * start[mcu]
    spare = 8 * whole - used
    bits, n, offset = np.concatenate([bits, (1 << spare) - 1]), np.concatenate([n, spare]), np.concatenate([offset, 8 * start[1:] - spare])
    wide = bits.astype(np.uint64) << (64 - (offset & 31) - n).astype(np.uint64) % np.uint64(64)
    wide[n == 0] = 0
    words = np.bincount(offset >> 5, weights=(wide >> np.uint64(32)).astype(np.float64), minlength=int(start[-1]) // 4 + 2)
    low = np.bincount((offset >> 5) + 1, weights=(wide & np.uint64(0xFFFFFFFF)).astype(np.float64), minlength=len(words))
    words = words + low[: len(words)]  # sums of bits that do not meet, below 2 ** 32
    flat = words.astype(np.uint64).astype(">u4").view(np.uint8)[: int(start[-1])]
    ff = np.flatnonzero(flat == 0xFF)
    final = np.zeros(len(whole), dtype=bool)
    final[np.cumsum(mcus) - 1] = True
    number = np.arange(len(whole)) - np.repeat(np.cumsum(mcus) - mcus, mcus)
    marked = np.flatnonzero(~final)
    places = np.concatenate([ff + 1, np.repeat(start[marked + 1], 2)])
    values = np.concatenate([np.zeros(len(ff), dtype=np.uint8), np.stack([np.full(len(marked), 0xFF, dtype=np.uint8), (0xD0 + number[marked] % 8).astype(np.uint8)], 1).reshape(-1)])
    out = np.insert(flat, places, values)
    stuffed = np.bincount(np.searchsorted(start, ff, side="right") - 1, minlength=len(whole))
    edge = np.concatenate([[0], np.cumsum(whole + stuffed + 2 * ~final)])[np.concatenate([[0], np.cumsum(mcus)])]
    files = []
    for k, m in enumerate(mcus.tolist()):
        across = _columns(m)
        files.append(_header(8 * across, 8 * (m // across), books[2 * k + 1], books[2 * k]) + out[edge[k] : edge[k + 1]].tobytes() + b"\xff\xd9")
    return files


def _batches(sizes: list[int]) -> Iterator[tuple[int, int]]:
    first = 0
    while first < len(sizes):
        end, total = first, 0
        while end < len(sizes) and (end == first or total + sizes[end] <= BATCH_BYTES):
            total += sizes[end]
            end += 1
        yield first, end
        first = end


def encode_all(payloads: list[bytes]) -> list[bytes]:
    """Each payload as images one after another; one is enough up to 1.5 MB."""
    step = UNIT * MAX_ROWS
    parts = [(k, np.frombuffer(p, dtype=np.uint8)[a : a + step]) for k, p in enumerate(payloads) for a in range(0, len(p), step)]
    out: list[list[bytes]] = [[] for _ in payloads]
    for a, b in _batches([len(p) for _, p in parts]):
        for (k, _), image in zip(parts[a:b], _encode_images([p for _, p in parts[a:b]]), strict=True):
            out[k].append(image)
    return [b"".join(x) for x in out]


def encode(payload: bytes) -> bytes:
    return encode_all([payload])[0]


class JpegError(ValueError):
    """Bytes that are no baseline JPEG."""


def _codes(counts: bytes, symbols: bytes) -> dict[tuple[int, int], int]:
    """(length, code) to symbol."""
    table, code, k = {}, 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            table[length, code] = symbols[k]
            code, k = code + 1, k + 1
        code <<= 1
    return table


def _images(media: bytes) -> Iterator[dict]:
    """The parsed images of a stream: frame, tables, and each scan with its entropy-coded bytes."""
    at, image = 0, None
    while at < len(media):
        if media[at] != 0xFF:
            raise JpegError(f"no marker at byte {at}")
        marker = media[at + 1]
        at += 2
        if marker == 0xD8:
            image = {"quantisers": {}, "tables": {}, "restart": 0, "scans": []}
        elif image is None:
            raise JpegError("no start of image")
        elif marker == 0xD9:
            yield image
            image = None
        elif marker == 0xFF:
            at -= 1
        else:
            length = struct.unpack_from(">H", media, at)[0]
            body = media[at + 2 : at + length]
            at += length
            if marker == 0xDB:
                while body:
                    wide = 2 if body[0] >> 4 else 1
                    image["quantisers"][body[0] & 15] = np.frombuffer(body[1 : 1 + 64 * wide], dtype=">u2" if wide == 2 else np.uint8).astype(np.int64)
                    body = body[1 + 64 * wide :]
            elif marker in (0xC0, 0xC1):
                precision, height, width, n = struct.unpack_from(">BHHB", body)
                if precision != 8:
                    raise JpegError("samples must have 8 bits")
                image |= {"height": height, "width": width, "parts": [(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(n)]}
            elif 0xC2 <= marker <= 0xCF and marker != 0xC4 and marker != 0xC8 and marker != 0xCC:
                raise JpegError("only baseline frames are read")
            elif marker == 0xC4:
                while body:
                    n = sum(body[1:17])
                    image["tables"][body[0]] = (body[1:17], body[17 : 17 + n])
                    body = body[17 + n :]
            elif marker == 0xDD:
                image["restart"] = struct.unpack(">H", body)[0]
            elif marker == 0xDA:
                end = at
                while True:
                    end = media.find(b"\xff", end)
                    if end < 0 or end + 1 >= len(media):
                        raise JpegError("a scan does not end")
                    if media[end + 1] and not 0xD0 <= media[end + 1] <= 0xD7:
                        break
                    end += 2
                n = body[0]
                image["scans"].append(([(body[1 + 2 * k], body[2 + 2 * k]) for k in range(n)], np.frombuffer(media, dtype=np.uint8, count=end - at, offset=at), dict(image["tables"]), image["restart"]))
                at = end
    if image is not None:
        raise JpegError("an image does not end")


def _segments(scan: np.ndarray) -> list[np.ndarray]:
    """The bytes between restart markers, without stuffing."""
    ff = np.flatnonzero(scan == 0xFF)
    follow = scan[np.minimum(ff + 1, len(scan) - 1)]
    cuts = ff[follow != 0]
    edges = np.concatenate([[-2], cuts, [len(scan)]])
    parts = []
    for a, b in zip(edges[:-1] + 2, edges[1:], strict=True):
        part = scan[a:b]
        inside = ff[(ff >= a) & (ff < b)] - a
        parts.append(np.delete(part, inside + 1) if len(inside) else part)
    return parts


def _layout(image: dict, parts: list[tuple[int, int]]) -> tuple[list[tuple[int, int, int, int]], int]:
    """For each block of an MCU: component, DC table, AC table, blocks; and the number of MCUs."""
    known = {c[0]: c for c in image["parts"]}
    top_h, top_v = max(c[1] for c in image["parts"]), max(c[2] for c in image["parts"])
    if len(parts) == 1:
        c = known[parts[0][0]]
        wide = -(-(-(-image["width"] * c[1] // top_h)) // 8)
        high = -(-(-(-image["height"] * c[2] // top_v)) // 8)
        return [(c[0], parts[0][1] >> 4, 0x10 | parts[0][1] & 15, 1)], wide * high
    blocks = [(i, t >> 4, 0x10 | t & 15, 1) for i, t in parts for _ in range(known[i][1] * known[i][2])]
    return blocks, -(-image["width"] // (8 * top_h)) * -(-image["height"] // (8 * top_v))


def _side_by_side(scans: list[tuple[dict, tuple]]) -> list[np.ndarray]:
    """All coefficients of scans with restart intervals, in zigzag order, block by block as coded; one step decodes a symbol of every segment."""
    books: dict[tuple[bytes, bytes], int] = {}
    base, shift, luts = [], [], []

    def book(table: tuple[bytes, bytes] | None) -> int:
        if table is None:
            raise JpegError("a Huffman table is missing")
        if table not in books:
            longest = max((n for n, c in enumerate(table[0], 1) if c), default=1)
            lut = np.zeros(1 << longest, dtype=np.int64)
            for (n, code), x in _codes(*table).items():
                lut[code << (longest - n) : (code + 1) << (longest - n)] = n << 8 | x
            books[table] = len(base)
            base.append(sum(map(len, luts)))
            shift.append(16 - longest)
            luts.append(lut)
        return books[table]

    # the entropy-coded bytes without stuffing and markers, and where each segment begins
    data = np.concatenate([x for _, (_, d, _, _) in scans for x in (d, np.zeros(2, dtype=np.uint8))])
    scan_start = np.concatenate([[0], np.cumsum([len(d) + 2 for _, (_, d, _, _) in scans])])
    ff = np.flatnonzero(data[:-1] == 0xFF)
    follow = data[ff + 1]
    keep = np.ones(len(data), dtype=bool)
    keep[ff[follow == 0] + 1] = False
    restarts = ff[(follow >= 0xD0) & (follow <= 0xD7)]
    keep[restarts], keep[restarts + 1] = False, False
    rank = np.concatenate([[0], np.cumsum(keep)])
    data = np.concatenate([data[keep], np.zeros(8, dtype=np.uint8)]).astype(np.uint64)
    n = len(data) - 4
    window = data[:n] << np.uint64(32) | data[1 : n + 1] << np.uint64(24) | data[2 : n + 2] << np.uint64(16) | data[3 : n + 3] << np.uint64(8) | data[4 : n + 4]
    pos, end, per_lane, first_block, tables, width, edges = [], [], [], [], [], [], [0]
    for k, (image, (parts, _, known, interval)) in enumerate(scans):
        layout, mcus = _layout(image, parts)
        cuts = restarts[(restarts >= scan_start[k]) & (restarts < scan_start[k + 1])]
        segments = -(-mcus // interval)
        if len(cuts) + 1 != segments:
            raise JpegError("a restart interval is missing")
        begin = rank[np.concatenate([[scan_start[k]], cuts + 2])]
        pos.append(begin)
        end.append(np.append(begin[1:], rank[scan_start[k + 1] - 2]))
        count = np.full(segments, interval * len(layout))
        count[-1] = (mcus - interval * (segments - 1)) * len(layout)
        per_lane.append(count)
        first_block.append(edges[-1] + np.concatenate([[0], np.cumsum(count)[:-1]]))
        edges.append(edges[-1] + mcus * len(layout))
        tables.append(np.array([x for _, dc, ac, _ in layout for x in (book(known.get(dc)), book(known.get(ac)))]))
        width.append(np.full(segments, len(layout)))
    lane_table = np.repeat(np.concatenate([[0], np.cumsum([len(t) for t in tables])[:-1]]), [len(p) for p in pos])
    flat_tables, lut = np.concatenate(tables), np.concatenate(luts)
    table_base, table_shift = np.array(base)[flat_tables], np.array(shift)[flat_tables]
    lane_pos, lane_end, lane_count, lane_block, lane_width = (np.concatenate(x).astype(np.int64) for x in (pos, end, per_lane, first_block, width))
    lane_pos, lane_end = 8 * lane_pos, 8 * lane_end
    out = np.zeros((edges[-1], 64), dtype=np.int16)
    flat_out = out.reshape(-1)
    at, left, in_mcu = np.zeros(len(lane_pos), dtype=np.int64), lane_count.copy(), np.zeros(len(lane_pos), dtype=np.int64)
    while len(lane_pos):
        if (lane_pos >= lane_end).any():
            raise JpegError("a scan ends too early")
        which = lane_table + 2 * in_mcu + (at > 0)
        byte, bit = lane_pos >> 3, lane_pos & 7
        w = window[byte].astype(np.int64)
        entry = lut[table_base[which] + ((w >> (24 - bit) & 0xFFFF) >> table_shift[which])]
        used, symbol = entry >> 8, entry & 255
        if not used.all():
            raise JpegError("no such Huffman code")
        size, run = symbol & 15, symbol >> 4
        x = w >> (40 - bit - used - size) & ((1 << size) - 1)
        x = np.where(x >> np.maximum(size - 1, 0), x, x - (1 << size) + 1)
        dc = at == 0
        place = at + np.where(dc, 0, run)
        some = size > 0
        if (place[some] > 63).any():
            raise JpegError("a block is too long")
        flat_out[(lane_block * 64 + place)[some]] = x[some]
        at = np.where(dc | some, place + 1, np.where(run == 15, at + 16, 64))
        lane_pos = lane_pos + used + size
        done = at >= 64
        if done.any():
            at[done] = 0
            lane_block, left, in_mcu = lane_block + done, left - done, in_mcu + done
            in_mcu[in_mcu == lane_width] = 0
            if not left.all():
                alive = left > 0
                lane_pos, lane_end, lane_block, lane_table, lane_width, at, left, in_mcu = (a[alive] for a in (lane_pos, lane_end, lane_block, lane_table, lane_width, at, left, in_mcu))
    found = []
    for k, (image, (parts, _, _, interval)) in enumerate(scans):
        blocks = out[edges[k] : edges[k + 1]]
        layout, mcus = _layout(image, parts)
        if interval > 1 or len({x[0] for x in layout}) < len(layout):  # DC differences add up within an interval
            names = np.tile([x[0] for x in layout], mcus)
            lane = np.arange(mcus * len(layout)) // (interval * len(layout))
            for name in {x[0] for x in layout}:
                own = np.flatnonzero(names == name)
                total = np.cumsum(blocks[own, 0].astype(np.int64))
                opening = np.concatenate([[True], np.diff(lane[own]) > 0])
                before = np.concatenate([[0], total[:-1]])[opening]
                blocks[own, 0] = total - np.repeat(before, np.diff(np.append(np.flatnonzero(opening), len(own))))
        found.append(blocks)
    return found


def _general(image: dict, scan: tuple) -> np.ndarray:
    """All coefficients of any baseline scan, in zigzag order, block by block as coded."""
    parts, data, tables, restart = scan
    layout, mcus = _layout(image, parts)
    books = {k: _codes(*v) for k, v in tables.items()}
    out = np.zeros((mcus * len(layout), 64), dtype=np.int16)
    segments = iter(_segments(data))
    bits, at, left = "", 0, 0
    before: dict[int, int] = {}

    def symbol(book: dict) -> int:
        nonlocal at
        code = 0
        for length in range(1, 17):
            if at >= len(bits):
                raise JpegError("a scan ends too early")
            code = code << 1 | (bits[at] == "1")
            at += 1
            if (length, code) in book:
                return book[length, code]
        raise JpegError("no such Huffman code")

    def magnitude(n: int) -> int:
        nonlocal at
        if not n:
            return 0
        x = int(bits[at : at + n], 2)
        at += n
        return x if x >> (n - 1) else x - (1 << n) + 1

    k = 0
    for m in range(mcus):
        if not left:
            part = next(segments, None)
            if part is None:
                raise JpegError("a restart interval is missing")
            bits, at, before, left = "".join(f"{x:08b}" for x in part.tolist()), 0, {}, restart or mcus
        left -= 1
        for name, dc, ac, _ in layout:
            before[name] = out[k, 0] = before.get(name, 0) + magnitude(symbol(books[dc]))
            i = 1
            while i < 64:
                s = symbol(books[ac])
                if s & 15:
                    i += s >> 4
                    out[k, i] = magnitude(s & 15)
                    i += 1
                elif s == 0xF0:
                    i += 16
                else:
                    break
            k += 1
    return out


def _thumbnail(image: dict, scan: tuple, coefficients: np.ndarray) -> np.ndarray:
    """The DC-only pixels of the first component, from the scan that has it."""
    layout, mcus = _layout(image, scan[0])
    first = [k for k, x in enumerate(layout) if x[0] == image["parts"][0][0]]
    dc = coefficients[:, 0].reshape(mcus, len(layout))[:, first].astype(np.float64)
    step = image["quantisers"][image["parts"][0][3]][0]
    pixels = np.clip(np.rint(dc * step / 8 + 128), 0, 255).astype(np.uint8)
    across = -(-image["width"] // (8 * max(c[1] for c in image["parts"]))) if len(scan[0]) > 1 else -(-image["width"] // 8)
    _, h, v, _ = image["parts"][0]
    if len(first) > 1:
        return pixels.reshape(-1, across, v, h).transpose(0, 2, 1, 3).reshape(-1, across * h)
    return pixels.reshape(-1, across)


def decode_all(files: list[bytes]) -> list[list[dict]]:
    """For each file its images: width, height, the coefficients of all scans (of the first, the second and so on), and the DC-only luminance thumbnail."""
    images = [list(_images(f)) for f in files]
    scans = [(image, scan) for x in images for image in x for scan in image["scans"]]
    coefficients: list[np.ndarray] = [np.zeros((0, 64), dtype=np.int16)] * len(scans)
    quick = [k for k, (_, s) in enumerate(scans) if s[3]]
    for a, b in _batches([len(scans[k][1][1]) for k in quick]):
        for k, c in zip(quick[a:b], _side_by_side([scans[k] for k in quick[a:b]]), strict=True):
            coefficients[k] = c
    for k, (image, scan) in enumerate(scans):
        if not scan[3]:
            coefficients[k] = _general(image, scan)
    out, at = [], 0
    for x in images:
        found = []
        for image in x:
            own = coefficients[at : at + len(image["scans"])]
            at += len(image["scans"])
            lead = next((k for k, s in enumerate(image["scans"]) if any(name == image["parts"][0][0] for name, _ in s[0])), None)
            if lead is None:
                raise JpegError("the first component has no scan")
            found.append({"width": image["width"], "height": image["height"], "coefficients": np.concatenate(own), "thumbnail": _thumbnail(image, image["scans"][lead], own[lead])})
        out.append(found)
    return out


def decode(media: bytes) -> list[dict]:
    return decode_all([media])[0]


def payload_of(images: list[dict]) -> bytes:
    """The bytes that ``encode`` stored."""
    return (np.concatenate([x["coefficients"].reshape(-1) for x in images]) + 128).astype(np.uint8).tobytes()


def thumbnail_hash(pixels: np.ndarray) -> str:
    """64 bits: is a cell of the 8 x 8 means brighter than all cells' mean; then the crc32 of the thumbnail."""
    rows = np.array_split(np.arange(pixels.shape[0]), 8)
    columns = np.array_split(np.arange(pixels.shape[1]), 8)
    total = np.zeros((pixels.shape[0] + 1, pixels.shape[1] + 1))
    total[1:, 1:] = pixels.astype(np.float64).cumsum(0).cumsum(1)
    r = np.array([[x[0], x[-1] + 1] if len(x) else [0, 1] for x in rows])
    c = np.array([[x[0], x[-1] + 1] if len(x) else [0, 1] for x in columns])
    cell = total[r[:, 1]][:, c[:, 1]] - total[r[:, 0]][:, c[:, 1]] - total[r[:, 1]][:, c[:, 0]] + total[r[:, 0]][:, c[:, 0]]
    cell /= (r[:, 1] - r[:, 0])[:, None] * (c[:, 1] - c[:, 0])[None, :]
    bits = (cell > pixels.mean()).reshape(-1)
    return f"{int.from_bytes(np.packbits(bits).tobytes(), 'big'):016x}-{zlib.crc32(pixels.tobytes()):08x}"


FIELDS = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def describe(stored: bytes, images: list[dict]) -> tuple[int, str, int, int, str, str]:
    """What the stored bytes hold, with the images read from them: length, digest and tail of the payload, their own length and digest, and the feature."""
    payload = payload_of(images)
    feature = ";".join(f"{x['width']}x{x['height']}:{thumbnail_hash(x['thumbnail'])}" for x in images)
    return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(stored), hashlib.sha256(stored).hexdigest(), feature


def media_column(docs: DataFrame, key: str = "doc_id", text: str = "text", with_media: bool = False) -> DataFrame:
    """key, FIELDS and, with_media, the JPEG bytes: each text is stored, and what is returned is read from the stored bytes.

    A null text is an empty one, which is stored as 192 blanks. One row for each input row, whatever repeats;
    rows with a null key stay. A text of any length is stored whole: over 1.5 MB as several images. Columns
    other than the two are not carried.
    """
    names = [x.split()[0] for x in FIELDS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                raw = [(t or "").encode() for t in part.column(1).to_pylist()]
                media = encode_all([pad(r) for r in raw])
                rows = [(len(r), *describe(f, images)) for r, f, images in zip(raw, media, decode_all(media), strict=True)]
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
                columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
                columns += [pa.array(media, pa.binary())] * with_media
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], ["key", *names, *["media"] * with_media])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key), F.col(text)).mapInArrow(lean(run), f"key {kind}, {FIELDS}{', media binary' * with_media}").withColumnRenamed("key", key)
