"""GIF as a media column: LZW streams, palettes, disposal, transparency, timed frames and colour histograms.

``decode`` reads any GIF87a or GIF89a: global and local palettes, interlaced frames, frames smaller than the canvas,
early and deferred clear codes. ``rendered`` composes its frames under the disposal rules. ``encode`` writes frames
without loss. ``store`` keeps bytes as the samples of frames 64 wide with a palette of 256 greys, so that a sample's
colour is its value, and ``load`` reads them back from the file.

Cases: a null or empty text is one row of 64 zero bytes; equal texts give equal files; rows with equal ids are kept
each for itself; a text beyond one frame goes on in further frames; an empty table gives no rows; other columns are
left out; a file that is cut off or not a GIF raises ValueError.
"""

from __future__ import annotations

import gc
import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelry.llm.text import slices, texts_of

WIDTH, FRAME_ROWS, BINS, MAX_CODES = 64, 1024, 16, 4096
#: Bytes that are coded at once.
SLICE = 1 << 20


@dataclass
class Frame:
    """``samples``: palette indices, rows by columns; delay in hundredths of a second; disposal 0 to 3."""

    samples: np.ndarray
    palette: np.ndarray | None = None
    x: int = 0
    y: int = 0
    delay: int = 0
    disposal: int = 0
    transparent: int | None = None


@dataclass
class Gif:
    width: int
    height: int
    palette: np.ndarray | None
    background: int = 0
    frames: list[Frame] = field(default_factory=list)


def code_widths(bits: int) -> np.ndarray:
    """Width of each code after a clear code: it grows when the decoder's next entry needs one more bit."""
    entries = (1 << bits) + 2 + np.maximum(np.arange(MAX_CODES + 1) - 1, 0)
    return np.clip(np.floor(np.log2(entries)).astype(np.int64) + 1, bits + 1, 12)


def lzw_codes(data: bytes, bits: int = 8) -> tuple[list[int], list[int]]:
    """Codes of ``data``, each times 256, with a clear code at the start and whenever the table is full, and where those
    stand. The table maps such a code plus a byte to the code of the longer string."""
    clear = 1 << bits
    codes, clears = [clear << 8], [0]
    if data:
        emit, table, entry, full = codes.append, {}, clear + 2 << 8, MAX_CODES << 8
        get, current = table.get, data[0] << 8
        for b in data[1:]:
            longer = get(current + b)
            if longer is not None:
                current = longer
                continue
            emit(current)
            table[current + b] = entry
            entry += 256
            current = b << 8
            if entry == full:
                clears.append(len(codes))
                emit(clear << 8)
                table.clear()
                entry = clear + 2 << 8
        emit(current)
    codes.append(clear + 1 << 8)
    return codes, clears


def packed(streams: list[tuple[list[int], list[int]]], bits: list[int]) -> list[bytes]:
    """Bytes of each code stream, low bits first, a code as wide as its place behind the last clear code asks for."""
    if not streams:
        return []
    sizes = np.array([len(c) for c, _ in streams])
    codes = np.fromiter(chain.from_iterable(c for c, _ in streams), np.int64, int(sizes.sum())) >> 8
    offset = np.cumsum(sizes) - sizes
    after = np.concatenate([np.append(o, np.array(x, np.int64) + o + 1) for o, (_, x) in zip(offset.tolist(), streams, strict=True)])
    place = np.arange(len(codes)) - np.repeat(after, np.diff(np.append(after, len(codes))))
    kinds = sorted(set(bits))
    width = np.stack([code_widths(k) for k in kinds])[np.repeat(np.searchsorted(kinds, bits), sizes), place]
    ends = np.cumsum(width)
    begin = ends[offset] - width[offset]
    n_bytes = (ends[offset + sizes - 1] - begin + 7) // 8
    base = np.cumsum(n_bytes) - n_bytes
    at = ends - width + np.repeat(8 * base - begin, sizes)
    value = codes << (at & 7)
    out = np.zeros(int(n_bytes.sum()) + 3, np.uint8)
    for k in range(3):
        out |= np.bincount((at >> 3) + k, weights=value >> 8 * k & 255, minlength=len(out))[: len(out)].astype(np.uint8)
    raw = out.tobytes()
    return [raw[x : x + n] for x, n in zip(base.tolist(), n_bytes.tolist(), strict=True)]


def lzw_encode(data: bytes, bits: int = 8) -> bytes:
    """The code stream of ``data``."""
    return packed([lzw_codes(data, bits)], [bits])[0]


def unpacked(stream: bytes, bits: int) -> list[np.ndarray]:
    """Codes of a stream up to its end code (or its end), a run for each clear code."""
    clear, end = 1 << bits, (1 << bits) + 1
    raw = np.concatenate([np.frombuffer(stream, np.uint8), np.zeros(4, np.uint8)]).astype(np.int64)
    total, at, schedule = len(stream) * 8, 0, code_widths(bits)
    found, run, read = [], [], 0
    while at < total:
        widths = schedule[np.minimum(np.arange(read, read + min(MAX_CODES, (total - at) // bits + 1)), MAX_CODES)]
        ends = at + np.cumsum(widths)
        n = int(np.searchsorted(ends, total, side="right"))
        if not n:
            break
        place = ends[:n] - widths[:n]
        byte = place >> 3
        codes = (raw[byte] | raw[byte + 1] << 8 | raw[byte + 2] << 16) >> (place & 7) & (1 << widths[:n]) - 1
        stop = np.flatnonzero((codes == clear) | (codes == end))
        m = int(stop[0]) if len(stop) else n
        run.append(codes[:m])
        if not len(stop):
            at, read = int(ends[n - 1]), read + n
            continue
        found.append(np.concatenate(run))
        run, at, read = [], int(ends[m]), 0
        if codes[m] == end:
            break
    return [*found, np.concatenate(run)] if run else found


def lzw_decode_all(streams: list[bytes], bits: list[int]) -> list[bytes]:
    """What code streams say, all at once.

    The entry that the code at place j adds to the table is its string and the first byte of the next one. So a code
    above the roots points back to a place, its string is that place's string and one byte more, and lengths and first
    bytes come from following these pointers, twice as far in each step.
    """
    runs, clear, of = [], [], []
    for i, (stream, b) in enumerate(zip(streams, bits, strict=True)):
        for run in unpacked(stream, b):
            runs.append(run), clear.append(1 << b), of.append(i)
    if not runs:
        return [b""] * len(streams)
    sizes = np.array([len(r) for r in runs])
    code = np.concatenate(runs)
    at, base, root = np.arange(len(code)), np.repeat(np.cumsum(sizes) - sizes, sizes), np.repeat(clear, sizes)
    longer = code >= root
    parent = np.where(longer, base + code - root - 2, at)
    if (parent >= at)[longer].any():
        raise ValueError("a code is not in the table")
    depth, up = longer.astype(np.int64), parent
    while (more := depth[up]).any():
        depth, up = depth + more, up[up]
    first = code[up]
    last = np.where(longer, first[np.minimum(parent + 1, len(code) - 1)], code).astype(np.uint8)
    ends = np.cumsum(depth + 1)
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
    place = ends - 1
    while len(at):
        out[place] = last[at]
        on = depth[at] > 0
        at, place = parent[at[on]], place[on] - 1
    length = np.bincount(np.repeat(of, sizes), weights=depth + 1, minlength=len(streams)).astype(np.int64)
    stop = np.cumsum(length)
    raw = out.tobytes()
    return [raw[b - n : b] for b, n in zip(stop.tolist(), length.tolist(), strict=True)]


def lzw_decode(stream: bytes, bits: int = 8) -> bytes:
    """All bytes of one code stream."""
    return lzw_decode_all([stream], [bits])[0]


def blocks(data: bytes) -> bytes:
    return b"".join(bytes([len(data[i : i + 255])]) + data[i : i + 255] for i in range(0, len(data), 255)) + b"\0"


def table_of(palette: np.ndarray) -> tuple[int, bytes]:
    """Size code and bytes of a colour table, filled up to a power of two."""
    n = max(1, int(np.ceil(np.log2(max(2, len(palette))))))
    return n - 1, palette.astype(np.uint8).tobytes() + bytes(3 * ((1 << n) - len(palette)))


def encode_all(gifs: list[Gif]) -> list[bytes]:
    """Files of some GIFs; their code streams are packed together."""
    frames = [f for g in gifs for f in g.frames]
    bits = [8 if f.samples.size == 0 or f.samples.max() > 127 else max(2, int(f.samples.max()).bit_length()) for f in frames]
    collecting = gc.isenabled()
    gc.disable()  # the trees of the tables hold no cycles
    streams = iter(zip(bits, packed([lzw_codes(f.samples.astype(np.uint8).tobytes(), n) for f, n in zip(frames, bits, strict=True)], bits), strict=True))
    if collecting:
        gc.enable()
    files = []
    for gif in gifs:
        out = [b"GIF89a"]
        flags, table = (0, b"") if gif.palette is None else table_of(gif.palette)
        out.append(struct.pack("<HHBBB", gif.width, gif.height, (0 if gif.palette is None else 0x80) | 0x70 | flags, gif.background, 0) + table)
        if len(gif.frames) > 1:
            out.append(b"\x21\xff\x0bNETSCAPE2.0\x03\x01\0\0\0")
        for f in gif.frames:
            out.append(struct.pack("<BBBBHBB", 0x21, 0xF9, 4, f.disposal << 2 | (f.transparent is not None), f.delay, f.transparent or 0, 0))
            flags, table = (0, b"") if f.palette is None else table_of(f.palette)
            h, w = f.samples.shape
            out.append(struct.pack("<BHHHHB", 0x2C, f.x, f.y, w, h, (0 if f.palette is None else 0x80) | flags) + table)
            n, stream = next(streams)
            out += [bytes([n]), blocks(stream)]
        files.append(b"".join(out) + b"\x3b")
    return files


def encode(gif: Gif) -> bytes:
    return encode_all([gif])[0]


def decode_all(files: list[bytes]) -> list[Gif]:
    """GIFs from their files; their code streams are read together."""
    found = [parsed(x) for x in files]
    streams = [s for _, own in found for s in own]
    texts = iter(lzw_decode_all([s for s, _, _ in streams], [b for _, b, _ in streams]))
    for gif, own in found:
        for f, (_, _, interlaced) in zip(gif.frames, own, strict=True):
            h, w = f.samples.shape
            text = next(texts)[: w * h]
            f.samples = np.frombuffer(text + bytes(w * h - len(text)), np.uint8).reshape(h, w)
            if interlaced:  # every eighth row, those between, every fourth, every second
                order = np.concatenate([np.arange(s, h, d) for s, d in ((0, 8), (4, 8), (2, 4), (1, 2))])
                straight = np.empty_like(f.samples)
                straight[order] = f.samples
                f.samples = straight
    return [gif for gif, _ in found]


def decode(data: bytes) -> Gif:
    return decode_all([data])[0]


def parsed(data: bytes) -> tuple[Gif, list[tuple[bytes, int, bool]]]:
    """A GIF whose frames are still empty, and each frame's code stream, code size and whether it is interlaced."""
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF")
    try:
        return _parsed(data)
    except (struct.error, IndexError) as e:
        raise ValueError("the GIF is cut off") from e


def _parsed(data: bytes) -> tuple[Gif, list[tuple[bytes, int, bool]]]:
    at = 13

    def colours(flags: int) -> np.ndarray | None:
        nonlocal at
        if not flags & 0x80:
            return None
        n = 3 << (flags & 7) + 1
        at += n
        if at > len(data):
            raise IndexError
        return np.frombuffer(data, np.uint8, n, at - n).reshape(-1, 3)

    def sub_blocks() -> bytes:
        nonlocal at
        parts = []
        while n := data[at]:
            parts.append(data[at + 1 : at + 1 + n])
            at += 1 + n
        at += 1
        return b"".join(parts)

    width, height, flags, background, _ = struct.unpack_from("<HHBBB", data, 6)
    gif, streams = Gif(width, height, colours(flags), background), []
    control = {}
    while (kind := data[at]) != 0x3B:
        at += 1
        if kind == 0x21:
            label = data[at]
            at += 1
            body = sub_blocks()
            if label == 0xF9 and len(body) >= 4:
                control = {"disposal": body[0] >> 2 & 7, "delay": body[1] | body[2] << 8, "transparent": body[3] if body[0] & 1 else None}
        elif kind == 0x2C:
            x, y, w, h, flags = struct.unpack_from("<HHHHB", data, at)
            at += 9
            palette = colours(flags)
            bits = data[at]
            at += 1
            if not 2 <= bits <= 8:
                raise ValueError(f"code size {bits}")
            streams.append((sub_blocks(), bits, bool(flags & 0x40)))
            gif.frames.append(Frame(np.empty((h, w), np.uint8), palette, x, y, **control))
            control = {}
        else:
            raise ValueError(f"unknown block {kind:#x}")
    return gif, streams


def rendered(gif: Gif) -> Iterator[tuple[int, np.ndarray]]:
    """Delay and RGBA canvas of each frame, under its disposal and transparency."""
    canvas = np.zeros((gif.height, gif.width, 4), np.uint8)
    for f in gif.frames:
        palette = f.palette if f.palette is not None else gif.palette
        if palette is None:
            palette = np.repeat(np.arange(256, dtype=np.uint8)[:, None], 3, axis=1)
        h, w = max(0, min(f.samples.shape[0], gif.height - f.y)), max(0, min(f.samples.shape[1], gif.width - f.x))
        part = f.samples[:h, :w]
        area = (slice(f.y, f.y + h), slice(f.x, f.x + w))
        before = canvas.copy() if f.disposal == 3 else None
        rgba = np.full((h, w, 4), 255, np.uint8)
        rgba[..., :3] = palette[np.minimum(part, len(palette) - 1)]
        shown = np.ones((h, w), bool) if f.transparent is None else part != f.transparent
        canvas[area][shown] = rgba[shown]
        yield f.delay, canvas.copy()
        if f.disposal == 2:
            canvas[area] = 0
        elif f.disposal == 3:
            canvas = before


def histogram(canvas: np.ndarray, bins: int = BINS) -> np.ndarray:
    """Counts of the opaque pixels by red, green and blue level."""
    opaque = canvas[canvas[..., 3] > 0]
    return np.concatenate([np.bincount(opaque[:, c] // (256 // bins), minlength=bins) for c in range(3)])


def histograms(gif: Gif, bins: int = BINS) -> Iterator[np.ndarray]:
    """``histogram`` of what is seen at each frame. Where no frame has a palette of its own the canvas is rendered as palette
    places, -1 where nothing is, which is a quarter of the work."""
    if any(f.palette is not None for f in gif.frames):
        yield from (histogram(canvas, bins) for _, canvas in rendered(gif))
        return
    palette = gif.palette if gif.palette is not None else GREYS
    colour = palette[np.minimum(np.arange(256), len(palette) - 1)] // (256 // bins)
    canvas = np.full((gif.height, gif.width), -1, np.int16)
    for f in gif.frames:
        part = f.samples[: max(0, gif.height - f.y), : max(0, gif.width - f.x)]
        area = canvas[f.y : f.y + part.shape[0], f.x : f.x + part.shape[1]]
        before = area.copy() if f.disposal == 3 else None
        np.copyto(area, part, where=True if f.transparent is None else part != f.transparent)
        n = np.bincount(canvas.ravel() + 1, minlength=257)[1:]
        yield np.concatenate([np.bincount(colour[:, c], weights=n, minlength=bins) for c in range(3)]).astype(np.int64)
        if f.disposal == 2:
            area[:] = -1
        elif f.disposal == 3:
            area[:] = before


GREYS = np.repeat(np.arange(256, dtype=np.uint8)[:, None], 3, axis=1)


def stored(payloads: list[bytes]) -> list[bytes]:
    """GIFs that hold the payloads, positive multiples of 64 bytes, as samples of frames 64 wide. Zero bytes are transparent,
    and the frames are kept, cleared and put back in turn."""
    gifs = []
    for payload in payloads:
        rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
        frames = [Frame(rows[i : i + FRAME_ROWS], delay=10, disposal=1 + i // FRAME_ROWS % 3, transparent=0) for i in range(0, len(rows), FRAME_ROWS)]
        gifs.append(Gif(WIDTH, min(len(rows), FRAME_ROWS), GREYS, 0, frames))
    return encode_all(gifs)


def store(payload: bytes) -> bytes:
    """One payload's GIF."""
    return stored([payload])[0]


def load(media: bytes) -> bytes:
    """The payload of ``store``'s file."""
    return b"".join(f.samples.tobytes() for f in decode(media).frames)


MEDIA = "doc_id long, n_bytes long, media binary"


def media_column(docs: DataFrame) -> DataFrame:
    """doc_id, the text's UTF-8 length, and a GIF that holds the text, filled up with zero bytes."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch).cast(pa.large_binary())
            for a, b in slices(texts, SLICE):
                raw = texts.slice(a, b - a).to_pylist()
                once = list(dict.fromkeys(raw))  # equal texts have equal files
                files = dict(zip(once, stored([x + bytes(-len(x) % WIDTH if x else WIDTH) for x in once]), strict=True))
                media = [files[x] for x in raw]
                yield pa.record_batch({"doc_id": batch.column("doc_id").slice(a, b - a), "n_bytes": pa.array(map(len, raw), pa.int64()), "media": pa.array(media, pa.binary())})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(write, MEDIA)


def opened(batch: pa.RecordBatch) -> Iterator[tuple[int | None, int, bytes, Gif]]:
    """The three columns of each row, the last one media, and its GIF; equal files of a slice are decoded once."""
    for a, b in slices(batch.column(2).cast(pa.large_binary()), SLICE):
        ids, sizes, files = (batch.column(i).slice(a, b - a).to_pylist() for i in range(3))
        once = list(dict.fromkeys(files))
        gifs = dict(zip(once, decode_all(once), strict=True))
        yield from ((*r, gifs[r[2]]) for r in zip(ids, sizes, files, strict=True))


FRAMES = "doc_id long, frame int, delay int, x int, y int, width int, height int, disposal int, samples binary, histogram array<long>"


def frames(media: DataFrame) -> DataFrame:
    """A row for each timed frame of a media column: its place, samples and the histogram of what is then seen."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in FRAMES.split(", ")]
        types = [pa.int64(), *[pa.int32()] * 7, pa.binary(), pa.list_(pa.int64())]
        for batch in batches:
            for doc, _, data, gif in opened(batch.select(["doc_id", "doc_id", "media"])):
                rows = [(doc, k, f.delay, f.x, f.y, f.samples.shape[1], f.samples.shape[0], f.disposal, f.samples.tobytes(), seen) for k, (f, seen) in enumerate(zip(gif.frames, histograms(gif), strict=True))]
                if rows:
                    yield pa.record_batch([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return media.select("doc_id", "media").mapInArrow(read, FRAMES)


DIGESTS = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, seen string"


def digests(media: DataFrame) -> DataFrame:
    """What the stored files hold, decoded again: the feature is the histogram of all samples' grey levels; seen is that of the
    pixels seen, over all frames as they are rendered with their disposal and transparency."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            known: dict[bytes, tuple] = {}  # equal files of a batch are read once
            for doc, n, data, gif in opened(batch.select(["doc_id", "n_bytes", "media"])):
                if data not in known:
                    payload = b"".join(f.samples.tobytes() for f in gif.frames)
                    levels = np.bincount(np.frombuffer(payload, np.uint8) // (256 // BINS), minlength=BINS)
                    seen = sum(histograms(gif))[:BINS]
                    known[data] = (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(data), hashlib.sha256(data).hexdigest(), *(",".join(map(str, x.tolist())) for x in (levels, seen)))
                rows.append((doc, n, *known[data]))
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
            columns = zip(*rows, strict=True) if rows else [()] * len(types)
            yield pa.record_batch([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=[x.split()[0] for x in DIGESTS.split(", ")])

    return media.mapInArrow(read, DIGESTS)
