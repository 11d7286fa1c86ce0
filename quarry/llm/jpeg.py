"""Baseline JPEG in a media column: parse, Huffman-decode, and take DC-only thumbnails.

``decode_luminance`` reads baseline JPEGs of any component layout: it parses the
markers, decodes the scan, and reconstructs the luminance thumbnail that has one
pixel per 8 x 8 block, from the DC coefficients alone.  Restart intervals are
independent, so those of all images of a batch are decoded in step, each numpy
operation taking one symbol of every interval.

``encode_bytes`` stores bytes without loss in that thumbnail: each byte is one
flat block (quantiser 8, so the DC coefficient is the sample less 128), 96 blocks
or more wide, a restart interval for each row of 96.  Samples are bytes in another
order, in which characters that are frequent in text lie around 128: neighbours
then differ by little, and short differences have short codes.  A payload above
the format's largest image goes into several images, one after another; images
are encoded and decoded some megabytes at a time, however long one text is.

Defined cases: a null or empty text becomes one unit of padding; a very long text
becomes several images, of which some megabytes are expanded at once; repeated
rows get equal values; null ids are kept; an empty table gives no rows; further
columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The payload's unit, its padding byte, blocks of a restart interval, and the largest side in blocks.
UNIT, PAD, INTERVAL, MOST_BLOCKS = 576, 255, 96, 8184
#: Characters in their order of frequency in running text; all other bytes follow in theirs.
FREQUENT = " eaionrtslhdcumpgbfvkwyzjx.,\n"
#: How often each code length occurs, and the symbols by code, of the standard luminance DC table.
DC_LENGTHS = (0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0)
DC_SYMBOLS = tuple(range(12))
#: Blocks are flat, so the AC table has the end of block alone.
AC_LENGTHS, AC_SYMBOLS = (1, *[0] * 15), (0,)
#: Payload bytes that are encoded or decoded at once.
BATCH_BYTES = 1 << 21


@cache
def sample_of_byte() -> np.ndarray:
    """Bytes by rank are 128, 127, 129, 126, 130 and so on."""
    first = list(FREQUENT.encode())
    ranked = np.array(first + [b for b in range(256) if b not in first])
    rank = np.arange(256)
    out = np.zeros(256, np.uint8)
    out[ranked] = 128 + np.where(rank % 2, -(rank + 1) // 2, rank // 2)
    return out


@cache
def byte_of_sample() -> np.ndarray:
    return np.argsort(sample_of_byte()).astype(np.uint8)


def canonical_codes(lengths: Iterable[int], symbols: Iterable[int]) -> dict[int, tuple[int, int]]:
    """symbol: (code, length), codes counting up within and across lengths."""
    code, out, left = 0, {}, iter(symbols)
    for n, count in enumerate(lengths, 1):
        for _ in range(count):
            out[next(left)] = (code, n)
            code += 1
        code <<= 1
    return out


@cache
def _difference_bits() -> tuple[np.ndarray, np.ndarray]:
    """For a DC difference plus 255: its bits (code, magnitude, end of block), and which of 16 are used."""
    codes, eob = canonical_codes(DC_LENGTHS, DC_SYMBOLS), canonical_codes(AC_LENGTHS, AC_SYMBOLS)[0]
    bits, used = np.zeros((511, 16), np.uint8), np.zeros((511, 16), bool)
    for d in range(-255, 256):
        size = abs(d).bit_length()
        text = f"{codes[size][0]:0{codes[size][1]}b}"
        if size:
            text += f"{d if d > 0 else d + (1 << size) - 1:0{size}b}"
        text += f"{eob[0]:0{eob[1]}b}"
        bits[d + 255, : len(text)], used[d + 255, : len(text)] = list(map(int, text)), True
    return bits, used


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _huffman(kind: int, lengths: Iterable[int], symbols: Iterable[int]) -> bytes:
    return bytes([kind << 4, *lengths, *symbols])


def _header(width: int, height: int) -> bytes:
    """All up to the scan, of one grey component, sizes in blocks."""
    return (
        b"\xff\xd8"
        + _segment(0xE0, b"JFIF\0\x01\x01\0\0\x01\0\x01\0\0")
        + _segment(0xDB, bytes([0] + [8] * 64))
        + _segment(0xC0, struct.pack(">BHHB", 8, 8 * height, 8 * width, 1) + bytes([1, 0x11, 0]))
        + _segment(0xC4, _huffman(0, DC_LENGTHS, DC_SYMBOLS) + _huffman(1, AC_LENGTHS, AC_SYMBOLS))
        + _segment(0xDD, struct.pack(">H", INTERVAL))
        + _segment(0xDA, bytes([1, 1, 0, 0, 63, 0]))
    )


def shape_of(n: int) -> tuple[int, int]:
    """Blocks across and down for ``n`` bytes, a multiple of 24: the narrowest that fits the height."""
    rows = n // INTERVAL
    for across in range(1, MOST_BLOCKS // INTERVAL + 1):
        if rows % across == 0 and rows // across <= MOST_BLOCKS:
            return across * INTERVAL, rows // across
    raise ValueError("no image of this size")


def images_of(n: int) -> list[int]:
    """Bytes of each image of a payload: whole units, as many as one row of INTERVAL blocks allows down."""
    most = MOST_BLOCKS // (UNIT // INTERVAL) * UNIT
    return [most] * (n // most) + ([n % most] if n % most else [])


def grouped(sizes: Iterable[int], most: int = BATCH_BYTES) -> Iterator[slice]:
    """Runs of items of some ``most`` together."""
    start, total, k = 0, 0, -1
    for k, n in enumerate(sizes):
        total += n
        if total >= most:
            yield slice(start, k + 1)
            start, total = k + 1, 0
    if start <= k:
        yield slice(start, k + 1)


def _encode_images(parts: list[memoryview]) -> Iterator[bytes]:
    """One image for each part, of whole intervals."""
    flat = sample_of_byte()[np.frombuffer(b"".join(parts), np.uint8)].astype(np.int16).reshape(-1, INTERVAL)
    diff = np.diff(flat - 128, axis=1, prepend=np.int16(0)) + 255
    bits, used = _difference_bits()
    lengths = used.sum(1)[diff].sum(1)
    pad = -lengths % 8
    # A column of bits for each block, and one more for the ones that fill an interval's last byte.
    grid = np.ones((len(diff), INTERVAL + 1, 16), np.uint8)
    grid[:, :INTERVAL] = bits[diff]
    mask = np.zeros((len(diff), INTERVAL + 1, 16), bool)
    mask[:, :INTERVAL] = used[diff]
    mask[:, INTERVAL] = np.arange(16) < pad[:, None]
    data = np.packbits(grid[mask])
    ends = np.cumsum((lengths + pad) // 8)
    # Each 0xFF is followed by a zero, each interval by a restart marker.
    stuffed = data == 0xFF
    extra = stuffed.astype(np.int64)
    extra[ends - 1] += 2
    place = np.cumsum(1 + extra) - (1 + extra)
    out = np.zeros(int(place[-1] + 1 + extra[-1]), np.uint8)
    out[place] = data
    after = place[ends - 1] + 1 + stuffed[ends - 1]
    counts = [len(p) // INTERVAL for p in parts]
    within = np.concatenate([np.arange(c) for c in counts])
    out[after], out[after + 1] = 0xFF, 0xD0 + within % 8
    stops, row, at = after + 2, 0, 0
    for p, count in zip(parts, counts, strict=True):
        row += count
        yield _header(*shape_of(len(p))) + out[at : stops[row - 1] - 2].tobytes() + b"\xff\xd9"
        at = int(stops[row - 1])


def encode_bytes(payloads: list[bytes]) -> list[bytes]:
    """The media of each payload (multiples of UNIT bytes)."""
    parts, owner = [], []
    for k, p in enumerate(payloads):
        view, at = memoryview(p), 0
        for n in images_of(len(p)):
            parts.append(view[at : at + n])
            owner.append(k)
            at += n
    media: list[list[bytes]] = [[] for _ in payloads]
    for s in grouped(map(len, parts)):
        for k, image in zip(owner[s], _encode_images(parts[s]), strict=True):
            media[k].append(image)
    return [b"".join(m) for m in media]


class Image:
    """A parsed baseline image: its size, components, tables and scan."""

    def __init__(self, data: bytes, at: int = 0):
        if data[at : at + 2] != b"\xff\xd8":
            raise ValueError("no start of image")
        self.quant, self.huffman, self.interval, at = {}, {}, 0, at + 2
        while True:
            while data[at + 1] == 0xFF:
                at += 1
            marker, size = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
            body = data[at + 4 : at + 2 + size]
            at += 2 + size
            if marker == 0xDB:
                self._quantisers(body)
            elif marker == 0xC4:
                self._huffman(body)
            elif marker == 0xDD:
                self.interval = struct.unpack(">H", body)[0]
            elif marker in (0xC0, 0xC1):
                self.height, self.width, n = struct.unpack_from(">HHB", body, 1)
                self.components = {body[6 + 3 * k]: (body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(n)}
            elif 0xC2 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
                raise ValueError("only baseline and sequential Huffman images are read")
            elif marker == 0xDA:
                self.scan = [(body[1 + 2 * k], body[2 + 2 * k] >> 4, body[2 + 2 * k] & 15) for k in range(body[0])]
                break
        self._entropy(data, at)

    def _quantisers(self, b: bytes) -> None:
        while b:
            n = 128 if b[0] >> 4 else 64
            self.quant[b[0] & 15] = struct.unpack(">H", b[1:3])[0] if n == 128 else b[1]
            b = b[1 + n :]

    def _huffman(self, b: bytes) -> None:
        while b:
            n = sum(b[1:17])
            self.huffman[b[0]] = (bytes(b[1:17]), bytes(b[17 : 17 + n]))
            b = b[17 + n :]

    def _entropy(self, data: bytes, at: int) -> None:
        """Splits the scan at its restart markers, and finds where the image ends."""
        self.intervals, start = [], at
        while True:
            k = data.index(b"\xff", at)
            mark = data[k + 1]
            if mark == 0 or mark == 0xFF:
                at = k + 2 - (mark == 0xFF)
                continue
            self.intervals.append(data[start:k].replace(b"\xff\0", b"\xff"))
            if not 0xD0 <= mark <= 0xD7:
                break
            start = at = k + 2
        self.end = k + 2 if mark == 0xD9 else k
        if mark != 0xD9:
            raise ValueError("only images of one scan are read")

    def layout(self) -> tuple[list[tuple[int, int, int]], int, int]:
        """Blocks of a unit as (DC table, AC table, component), luminance first; units across and down."""
        if len(self.scan) == 1:
            _, dc, ac = self.scan[0]
            h, v, _ = self.components[self.scan[0][0]]
            top = [max(c[k] for c in self.components.values()) for k in (0, 1)]
            wide, high = -(-self.width * h // top[0]), -(-self.height * v // top[1])
            return [(dc, ac, 0)], -(-wide // 8), -(-high // 8)
        blocks = [(dc, ac, k) for k, (c, dc, ac) in enumerate(self.scan) for _ in range(self.components[c][0] * self.components[c][1])]
        h, v = max(c[0] for c in self.components.values()), max(c[1] for c in self.components.values())
        return blocks, -(-self.width // (8 * h)), -(-self.height // (8 * v))


@cache
def _lookup(lengths: bytes, symbols: bytes) -> np.ndarray:
    """For the next 16 bits: code length << 8 | symbol; 0 for none."""
    table = np.zeros(1 << 16, np.uint16)
    for symbol, (code, n) in canonical_codes(lengths, symbols).items():
        table[code << 16 - n : code + 1 << 16 - n] = n << 8 | symbol
    return table


def _decode_dc(images: list[Image], units: list[list[int]], pattern: list[tuple[np.ndarray, np.ndarray, int]]) -> np.ndarray:
    """DC values [interval, unit, block] of images that share tables and block pattern."""
    streams = [s for im in images for s in im.intervals]
    many = np.array([n for of in units for n in of])
    starts = np.cumsum([0] + [len(s) + 8 for s in streams[:-1]]).astype(np.int64) * 8
    buffer = np.frombuffer(b"".join(s + b"\xff" * 8 for s in streams), np.uint8).astype(np.uint32)
    # The 24 bits from each byte on hold any 16 that start in it.
    window = buffer[:-2] << 16 | buffer[1:-1] << 8 | buffer[2:]
    at = starts
    out = np.zeros((int(many.max()), len(pattern), len(streams)), np.int32)
    last = np.zeros((1 + max(c for *_, c in pattern), len(streams)), np.int32)

    def peek(p: np.ndarray) -> np.ndarray:
        return window[p >> 3] >> (8 - (p & 7)).astype(np.uint32) & 0xFFFF

    for unit in range(len(out)):
        live = many > unit
        for b, (dc, ac, component) in enumerate(pattern):
            got = dc[peek(at)].astype(np.int64)
            at = at + (got >> 8)
            size = got & 15
            value = (peek(at) >> (16 - size).astype(np.uint32)).astype(np.int32)
            half = np.left_shift(1, size) >> 1
            value = np.where(size == 0, 0, np.where(value < half, value - 2 * half + 1, value)).astype(np.int32)
            at = at + size
            last[component] += np.where(live, value, 0).astype(np.int32)
            out[unit, b] = last[component]
            # AC symbols are skipped until every interval is at its end of block.
            got = ac[peek(at)].astype(np.int64)
            at = at + (got >> 8)
            if not (got & 0xFF).any():
                continue
            k, symbol, lanes = np.ones(len(at), int), got & 0xFF, np.nonzero((got & 0xFF) & np.where(live, 0xFF, 0))[0]
            while len(lanes):
                s = symbol[lanes]
                at[lanes] += s & 15
                k[lanes] += (s >> 4) + 1
                lanes = lanes[k[lanes] < 64]
                got = ac[peek(at[lanes])].astype(np.int64)
                at[lanes] += got >> 8
                symbol[lanes] = got & 0xFF
                lanes = lanes[symbol[lanes] != 0]
        at = np.where(live, at, starts)
    return out.transpose(2, 0, 1)


def decode_luminance(images: list[Image]) -> list[np.ndarray]:
    """The thumbnail of each image: one pixel per luminance block, rounded and clipped to a byte."""
    out: list[np.ndarray | None] = [None] * len(images)
    groups: dict[tuple, list[int]] = {}
    for k, im in enumerate(images):
        blocks, *_ = im.layout()
        groups.setdefault(tuple((im.huffman[dc], im.huffman[16 | ac], c) for dc, ac, c in blocks), []).append(k)
    for shape, members in groups.items():
        pattern = [(_lookup(*dc), _lookup(*ac), c) for dc, ac, c in shape]
        some = [images[k] for k in members]
        units = []
        for im in some:
            _, across, down = im.layout()
            step = im.interval or across * down
            units.append([min(step, across * down - at) for at in range(0, across * down, step)])
        dc, row = _decode_dc(some, units, pattern), 0
        for k, im, of in zip(members, some, units, strict=True):
            mine = np.concatenate([dc[row + j, :n] for j, n in enumerate(of)]) if min(of) != max(of) else dc[row : row + len(of), : of[0]].reshape(-1, len(pattern))
            row += len(of)
            _, across, down = im.layout()
            h, v, q = im.components[im.scan[0][0]]
            h, v = (1, 1) if len(im.scan) == 1 else (h, v)
            luminance = mine[:, : h * v].reshape(down, across, v, h).transpose(0, 2, 1, 3).reshape(down * v, across * h)
            out[k] = np.clip((luminance * im.quant[q] + 4 >> 3) + 128, 0, 255).astype(np.uint8)
    return out


def parse_media(media: bytes) -> list[Image]:
    """The images of a media value, one after another."""
    out, at = [], 0
    while at < len(media):
        out.append(Image(media, at))
        at = out[-1].end
    return out


def thumbnail_hash(pixels: np.ndarray) -> str:
    """64 bits: which cells of an 8 x 8 reduction are lighter than their right neighbour's mean."""
    rows = [np.linspace(0, pixels.shape[0], 9).astype(int), np.linspace(0, pixels.shape[1], 10).astype(int)]
    sums = np.zeros((pixels.shape[0] + 1, pixels.shape[1] + 1), np.int64)
    sums[1:, 1:] = pixels.cumsum(0, dtype=np.int64).cumsum(1)
    r, c = rows
    area = sums[r[1:]][:, c[1:]] - sums[r[:-1]][:, c[1:]] - sums[r[1:]][:, c[:-1]] + sums[r[:-1]][:, c[:-1]]
    count = np.maximum(1, np.diff(r)[:, None] * np.diff(c)[None, :])
    mean = area / count
    return np.packbits(mean[:, :-1] > mean[:, 1:]).tobytes().hex()


def padded(text: bytes) -> bytes:
    return text + bytes([PAD]) * (max(UNIT, -(-len(text) // UNIT) * UNIT) - len(text))


def encode_media(docs: DataFrame) -> DataFrame:
    """(doc_id, media) of each text's UTF-8 bytes."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            for s in grouped(len(t or b"") for t in texts):
                media = encode_bytes([padded(t or b"") for t in texts[s]])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(s.start, s.stop - s.start), pa.array(media, pa.binary())], ["doc_id", "media"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return slim.mapInArrow(run, "doc_id long, media binary")


FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, width long, height long, n_images long, feature string"
_FEATURES = pa.schema([(x.split()[0], pa.string() if x.endswith("string") else pa.int64()) for x in FEATURES.split(", ")])


class _Payload:
    """What is known of a media value's payload as its images are decoded, in order."""

    def __init__(self, doc_id: int | None, media: bytes):
        self.doc_id, self.media, self.sum, self.hashes = doc_id, media, hashlib.sha256(), []
        self.n = self.width = self.height = 0
        self.last = b""

    def add(self, pixels: np.ndarray) -> None:
        self.last = byte_of_sample()[pixels].tobytes()
        self.sum.update(self.last)
        self.hashes.append(thumbnail_hash(pixels))
        self.n += len(self.last)
        self.width, self.height = self.width or 8 * pixels.shape[1], self.height + 8 * pixels.shape[0]

    def row(self) -> tuple:
        # Padding is less than a unit or all of an only one, so it lies in the last image; UTF-8 has no byte 255.
        pad = len(self.last) - len(self.last.rstrip(bytes([PAD])))
        digests = self.sum.hexdigest(), zlib.crc32(self.last[-32:]), len(self.media), hashlib.sha256(self.media).hexdigest()
        return self.doc_id, self.n - pad, self.n, *digests, self.width, self.height, len(self.hashes), f"{self.width}x{self.height}:{'.'.join(self.hashes)}"


def media_features(media: DataFrame) -> DataFrame:
    """Dimensions, digests and thumbnail hash of each media value, from its stored bytes alone."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, values = b.column(0).to_pylist(), b.column(1).to_pylist()
            for s in grouped(map(len, values)):
                found = [_Payload(doc_id, m) for doc_id, m in zip(ids[s], values[s], strict=True)]
                parts = [(f, im) for f in found for im in parse_media(f.media)]
                for some in grouped(im.width * im.height // 64 for _, im in parts):
                    for (f, _), pixels in zip(parts[some], decode_luminance([im for _, im in parts[some]]), strict=True):
                        f.add(pixels)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*(f.row() for f in found), strict=True), _FEATURES, strict=True)], schema=_FEATURES)

    return media.mapInArrow(run, FEATURES)
