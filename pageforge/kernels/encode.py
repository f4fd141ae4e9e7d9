"""JPEG files of pages: baseline, all channels at full resolution, code tables from the page's own symbol counts."""

from __future__ import annotations

import heapq
import struct

import numpy as np

# The quantization tables of the JPEG standard's Annex K, by rows.
_LUMA = np.array([
    16, 11, 10, 16, 24, 40, 51, 61, 12, 12, 14, 19, 26, 58, 60, 55, 14, 13, 16, 24, 40, 57, 69, 56, 14, 17, 22, 29, 51, 87, 80, 62,
    18, 22, 37, 56, 68, 109, 103, 77, 24, 35, 55, 64, 81, 104, 113, 92, 49, 64, 78, 87, 103, 121, 120, 101, 72, 92, 95, 98, 112, 100, 103, 99,
])
_CHROMA = np.full((8, 8), 99)
_CHROMA[:4, :4] = [[17, 18, 24, 47], [18, 21, 26, 66], [24, 26, 56, 99], [47, 66, 99, 99]]
_CHROMA = _CHROMA.ravel()

_U, _X = np.arange(8)[:, None], np.arange(8)
_DCT = np.where(_U == 0, np.sqrt(1 / 8), 0.5) * np.cos((2 * _X + 1) * _U * np.pi / 16)
#: The zigzag: by diagonals, every other one upwards.
ZIGZAG = np.array(sorted(range(64), key=lambda k: (k // 8 + k % 8, k // 8 if (k // 8 + k % 8) % 2 else k % 8)))


def quantizers(quality: int) -> tuple[np.ndarray, np.ndarray]:
    scale = 5000 // quality if quality < 50 else 200 - 2 * quality
    return tuple(np.clip((t * scale + 50) // 100, 1, 255) for t in (_LUMA, _CHROMA))


def _blocks(plane: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Quantized coefficients of each block of 8 by 8, in zigzag order."""
    h, w = plane.shape
    p = np.pad(plane, ((0, -h % 8), (0, -w % 8)), "edge") - 128.0
    tiles = p.reshape(p.shape[0] // 8, 8, p.shape[1] // 8, 8).swapaxes(1, 2).reshape(-1, 8, 8)
    return np.rint((_DCT @ tiles @ _DCT.T).reshape(-1, 64) / table).astype(np.int32)[:, ZIGZAG]


def _bits(values: np.ndarray) -> np.ndarray:
    """How many bits each magnitude takes."""
    return np.frexp(np.abs(values))[1].astype(np.int64)


def _symbols(blocks: np.ndarray) -> tuple[np.ndarray, ...]:
    """(block, place in its stream, symbol, extra bits, how many, whether of the first coefficient), in stream order."""
    n = len(blocks)
    first = np.diff(blocks[:, 0], prepend=0)
    row, at = np.nonzero(blocks[:, 1:])
    at = at + 1
    value = blocks[row, at]
    before = np.where(np.append(True, row[1:] != row[:-1])[: len(row)], 0, np.concatenate([[0], at[:-1]])) if len(row) else at
    run = at - before - 1
    wide = np.repeat(np.arange(len(row)), run // 16)  # runs of sixteen zeros have a symbol of their own
    last = np.zeros(n, np.int64)
    last[row] = at
    ends = np.flatnonzero(last < 63)
    size, size0 = _bits(value), _bits(first)
    block = np.concatenate([np.arange(n), row, row[wide], ends])
    place = np.concatenate([np.zeros(n, int), 4 * at + 2, 4 * at[wide] + 1, np.full(len(ends), 4 * 64)])
    symbol = np.concatenate([size0, (run % 16) * 16 + size, np.full(len(wide), 0xF0), np.zeros(len(ends), int)])
    both = np.concatenate([first, value])
    extra = np.concatenate([np.where(both < 0, both + (1 << np.concatenate([size0, size])) - 1, both), np.zeros(len(wide) + len(ends), int)])
    count = np.concatenate([size0, size, np.zeros(len(wide) + len(ends), int)])
    order = np.lexsort((place, block))
    return block[order], symbol[order], extra[order], count[order], (place == 0)[order]


def _code_lengths(counts: np.ndarray) -> dict[int, int]:
    """Huffman code lengths of the symbols that occur, 16 bits at most; one spare symbol keeps the code of all ones free."""
    least = 0
    while True:
        heap = [(max(int(c), least), i, (i,)) for i, c in enumerate(counts) if c] + [(0 if not least else 1, 256, (256,))]
        heapq.heapify(heap)
        depth = dict.fromkeys((x[1] for x in heap), 0)
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            for s in (*a[2], *b[2]):
                depth[s] += 1
            heapq.heappush(heap, (a[0] + b[0], min(a[1], b[1]), a[2] + b[2]))
        if max(depth.values()) <= 16:
            # The spare symbol must have the longest code: it trades places with a longest one.
            longest = max(depth, key=lambda s: depth[s])
            depth[256], depth[longest] = depth[longest], depth[256]
            del depth[256]
            return {s: max(d, 1) for s, d in depth.items()}
        least = max(1, 2 * least, int(counts.sum()) >> 14)


def _table(counts: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The table as the file has it, and each symbol's code and its length."""
    lengths = _code_lengths(counts)
    order = sorted(lengths, key=lambda s: (lengths[s], s))
    code, size, at, long = np.zeros(256, np.int64), np.zeros(256, np.int64), 0, 0
    for s in order:
        at <<= lengths[s] - long
        long = lengths[s]
        code[s], size[s] = at, long
        at += 1
    per = [sum(1 for s in order if lengths[s] == n) for n in range(1, 17)]
    return bytes(per) + bytes(order), code, size


def jpeg(page: np.ndarray, quality: int = 95) -> bytes:
    b, g, r = (page[..., k].astype(np.float64) for k in range(3))
    planes = (0.299 * r + 0.587 * g + 0.114 * b, 128 - 0.168736 * r - 0.331264 * g + 0.5 * b, 128 + 0.5 * r - 0.418688 * g - 0.081312 * b)
    luma, chroma = quantizers(quality)
    parts = [_symbols(_blocks(np.clip(np.floor(p + 0.5), 0, 255), t)) for p, t in zip(planes, (luma, chroma, chroma))]
    out = bytearray(b"\xff\xd8\xff\xe0" + struct.pack(">H5sHBHHBB", 16, b"JFIF\0", 0x0101, 0, 1, 1, 0, 0))
    segment = lambda mark, body: out.extend(b"\xff" + bytes([mark]) + struct.pack(">H", len(body) + 2) + body)
    for k, t in enumerate((luma, chroma)):
        segment(0xDB, bytes([k]) + bytes(t[ZIGZAG].tolist()))
    segment(0xC0, struct.pack(">BHHB", 8, *page.shape[:2], 3) + bytes([1, 0x11, 0, 2, 0x11, 1, 3, 0x11, 1]))
    codes = {}
    for k in (0, 1):
        for of_first in (True, False):
            own = parts[:1] if k == 0 else parts[1:]
            body, code, size = _table(sum(np.bincount(p[1][p[4] == of_first], minlength=256) for p in own))
            segment(0xC4, bytes([(0 if of_first else 16) + k]) + body)
            codes[k, of_first] = code, size
    segment(0xDA, bytes([3, 1, 0x00, 2, 0x11, 3, 0x11, 0, 63, 0]))
    block, channel, value, size = [], [], [], []
    for c, p in enumerate(parts):
        k = min(c, 1)
        code, long = (np.where(p[4], codes[k, True][i][p[1]], codes[k, False][i][p[1]]) for i in (0, 1))
        block.append(p[0])
        channel.append(np.full(len(p[0]), c))
        value.append(code << p[3] | p[2])
        size.append(long + p[3])
    order = np.lexsort((np.concatenate(channel), np.concatenate(block)))  # stable: a block's symbols stay in order
    value, size = np.concatenate(value)[order], np.concatenate(size)[order]
    ends = np.cumsum(size)
    bits = np.ones(-(-int(ends[-1]) // 8) * 8, np.uint8)
    for n in range(int(size.max())):  # the n-th bit from the end of every code that has one
        own = np.flatnonzero(size > n)
        bits[ends[own] - 1 - n] = value[own] >> n & 1
    return bytes(out) + np.packbits(bits).tobytes().replace(b"\xff", b"\xff\0") + b"\xff\xd9"
