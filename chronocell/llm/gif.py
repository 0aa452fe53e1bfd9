"""GIF: LZW streams, palettes, disposal and transparency, frames as rows.

The reader takes any GIF of version 87a or 89a: global and local palettes, interlacing,
frame rectangles, delays, transparent colours and the four disposal methods.  The writer
makes single-rectangle frames with full LZW compression; with a palette of 256 it stores any
bytes losslessly, a pixel a byte.  Stored samples and shown pixels differ: what is shown is
composed from the frames so far.

Frames are composed one after the other, so a long animation holds its samples and one canvas.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronocell.sources.scratch import Scratch

#: Bytes of pixels after which rows are passed on.
HELD_BYTES = 16 << 20
#: Formats' fixed values.
HEADERS = (b"GIF87a", b"GIF89a")
EXTENSION, IMAGE, TRAILER, GRAPHIC_CONTROL = 0x21, 0x2C, 0x3B, 0xF9
MOST_CODES = 4096
#: Bytes of a decoded stream that are copied at once.
PIECE = 1 << 16
INTERLACED = ((0, 8), (4, 8), (2, 4), (1, 2))


class BadGif(ValueError):
    """The bytes are no whole GIF."""


@dataclass
class Frame:
    """A frame as stored: its rectangle of palette indices, and how it is shown."""

    left: int
    top: int
    pixels: np.ndarray
    palette: np.ndarray
    delay_cs: int
    disposal: int
    transparent: int | None


def _widths(bits: int, count: int) -> np.ndarray:
    """Bits of each of ``count`` codes after a clear code; the table grows by one from the second on."""
    size = np.minimum((1 << bits) + 2 + np.maximum(np.arange(count) - 1, 0), MOST_CODES - 1)
    return np.maximum(bits + 1, np.frexp(size.astype(np.float64))[1]).astype(np.int64)


@cache
def _layout(bits: int, full: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Of ``MOST_CODES`` codes after a clear code, or with the table ``full``: where their bits are among 16 a code, and how many bits there are up to each."""
    widths = np.full(MOST_CODES, 12) if full else _widths(bits, MOST_CODES)
    return np.flatnonzero(np.arange(16) < widths[:, None]), np.cumsum(widths)


def lzw_encode(data: bytes, bits: int) -> bytes:
    """The LZW stream of ``data`` (values under ``2**bits``), codes packed low bit first."""
    clear, end = 1 << bits, (1 << bits) + 1
    codes: list[int] = []
    add, rest = codes.append, iter(data)
    prefix = next(rest, -1)
    more = prefix >= 0
    while more:
        # One table, from a clear code until it is full or the data ends: for each value, the codes that it follows.
        table: list[dict[int, int]] = [{} for _ in range(clear)]
        new = end + 1
        for value in rest:
            follows = table[value]
            code = follows.get(prefix)
            if code is None:
                add(prefix)
                follows[prefix] = new
                new += 1
                prefix = value
                if new == MOST_CODES:
                    add(clear)
                    break
            else:
                prefix = code
        else:
            add(prefix)
            more = False
    add(end)
    # A table's codes have their widths by their places, the clear code that ends it included.
    code = np.array(codes, dtype="<u2")
    (places, ends), turn = _layout(bits), MOST_CODES - clear - 1
    parts = [np.unpackbits(np.array([clear], "<u2").view(np.uint8), bitorder="little")[: bits + 1]]
    for k in range(0, len(code), turn):
        part = code[k : k + turn]
        parts.append(np.unpackbits(part.view(np.uint8), bitorder="little")[places[: ends[len(part) - 1]]])
    return np.packbits(np.concatenate(parts), bitorder="little").tobytes()


#: What a run of codes stands for: bytes, where each code's begin among them, and how many it has.
Run = tuple[np.ndarray, np.ndarray, np.ndarray]


def _expanded(codes: np.ndarray, clear: int, table: Run | None) -> Run:
    """What ``codes`` stand for: those after a clear code, or those that find ``table`` full, after its bytes.

    Entry k of a table is what its k-th code stands for and the next byte of the output, so every
    code is a literal or a copy of earlier output.  Copies are followed to their literals by doubling.
    """
    literal, here = codes < clear, np.arange(len(codes))
    source = np.where(literal, here, codes - clear - 2)
    if table is None:
        if (source >= here + literal).any():
            raise BadGif("a code that is not in the table")
        known, lengths, up = np.empty(0, np.uint8), (~literal).astype(np.intp), source
        while ((further := up[up]) != up).any():
            lengths, up = lengths + lengths[up], further
        lengths += 1
        ends = np.cumsum(lengths)
        starts = ends - lengths
        shifts = starts[source] - starts
    else:
        known, begins, counts = table
        source[literal] = 0
        lengths = np.where(literal, 1, counts[source] + 1)
        ends = len(known) + np.cumsum(lengths)
        starts = ends - lengths
        shifts = np.where(literal, 0, begins[source] - starts)
    out = np.empty(ends[-1], np.uint8)
    out[: len(known)] = known
    first = 0
    while first < len(codes):
        base = starts[first]
        last = max(first + 1, int(np.searchsorted(ends, base + PIECE, "right")))
        some, piece = slice(first, last), out[base : ends[last - 1]]
        own = np.arange(len(piece))
        back = own + np.repeat(shifts[some], lengths[some])
        piece[starts[some][literal[some]] - base] = codes[some][literal[some]]
        if base:
            # What lies before this piece is known by now.
            far = back < 0
            piece[far] = out[base + back[far]]
            back[far] = own[far]
        while ((further := back[back]) != back).any():
            back = further
        piece[:] = piece[back]
        first = last
    return out, starts, lengths


def lzw_decode(stream: bytes, bits: int, most: int) -> bytes:
    """Up to ``most`` values of an LZW stream; a stream that ends early or is broken raises."""
    if not 1 <= bits <= 8:
        raise BadGif("code size")
    clear, end = 1 << bits, (1 << bits) + 1
    raw, total, at, made = np.frombuffer(stream, np.uint8), len(stream) * 8, 0, 0
    out: list[np.ndarray] = []
    table: Run | None = None
    while made < most:
        if table is None and int.from_bytes(stream[at >> 3 : (at >> 3) + 3], "little") >> (at & 7) & (2 << bits) - 1 == clear:
            at += bits + 1
            continue
        # Widths are known up to the next clear code, so all codes up to it, or until the table is full, are cut out at once.
        places, ends = _layout(bits, table is not None)
        count = min(int(np.searchsorted(ends, total - at, "right")), most - made + 2, MOST_CODES if table else MOST_CODES - clear - 1)
        if count < 1:
            raise BadGif("the stream ends early")
        size = int(ends[count - 1])
        spread = np.zeros(16 * count, np.uint8)
        spread[places[:size]] = np.unpackbits(raw[at >> 3 : at + size + 7 >> 3], bitorder="little")[at & 7 : (at & 7) + size]
        codes = np.packbits(spread, bitorder="little").view("<u2").astype(np.intp)
        stops = np.flatnonzero((codes == clear) | (codes == end))
        stop = int(stops[0]) if len(stops) else count
        run = _expanded(codes[:stop], clear, table) if stop else None
        if run:
            out.append(run[0][len(table[0]) if table else 0 :])
            made += len(out[-1])
        if stop == count:
            at, table = at + size, table or run
        elif codes[stop] == end:
            break
        else:
            at, table = at + int(ends[stop]), None
    data = b"".join(out)
    if len(data) < most:
        raise BadGif("too few pixels")
    return data[:most]


def _blocks(data: bytes) -> bytes:
    return b"".join(bytes([len(data[k : k + 255])]) + data[k : k + 255] for k in range(0, len(data), 255)) + b"\0"


def write_gif(frames: list[np.ndarray], palette: np.ndarray, delays_cs: list[int] | None = None, disposal: int | list[int] = 1, transparent: int | None = None, offsets: list[tuple[int, int]] | None = None, size: tuple[int, int] | None = None) -> bytes:
    """An animated GIF of index frames (2-D ``uint8``) under one palette; ``disposal`` is one for all or one each."""
    bits = max(1, (len(palette) - 1).bit_length())
    offsets = offsets or [(0, 0)] * len(frames)
    height = size[1] if size else max((f.shape[0] + y for f, (_, y) in zip(frames, offsets, strict=True)), default=0)
    width = size[0] if size else max((f.shape[1] + x for f, (x, _) in zip(frames, offsets, strict=True)), default=0)
    colours = np.zeros((1 << bits, 3), dtype=np.uint8)
    colours[: len(palette)] = palette
    out = [HEADERS[1], struct.pack("<HHBBB", width, height, 0x80 | 0x70 | (bits - 1), 0, 0), colours.tobytes()]
    for k, frame in enumerate(frames):
        flags = (disposal if isinstance(disposal, int) else disposal[k]) << 2 | (transparent is not None)
        out.append(struct.pack("<BBBBHBB", EXTENSION, GRAPHIC_CONTROL, 4, flags, delays_cs[k] if delays_cs else 4, transparent or 0, 0))
        out.append(struct.pack("<BHHHHB", IMAGE, *offsets[k], frame.shape[1], frame.shape[0], 0))
        out.append(bytes([max(2, bits)]) + _blocks(lzw_encode(frame.tobytes(), max(2, bits))))
    return b"".join([*out, bytes([TRAILER])])


def read_gif(data: bytes) -> tuple[int, int, list[Frame]]:
    """Width, height and stored frames; ``BadGif`` for anything that is not a whole GIF."""
    try:
        return _read_gif(data)
    except (struct.error, IndexError) as e:
        raise BadGif("the file ends early") from e


def _read_gif(data: bytes) -> tuple[int, int, list[Frame]]:
    if data[:6] not in HEADERS:
        raise BadGif("header")
    width, height, flags, _, _ = struct.unpack_from("<HHBBB", data, 6)
    at, shared = 13, None

    def palette(flags: int) -> np.ndarray:
        nonlocal at
        n = 3 << (flags & 7) + 1
        if len(data) < at + n:
            raise BadGif("palette")
        at += n
        return np.frombuffer(data, np.uint8, n, at - n).reshape(-1, 3)

    def blocks() -> bytes:
        nonlocal at
        parts = []
        while data[at]:
            if at + 1 + data[at] > len(data):
                raise BadGif("block")
            parts.append(data[at + 1 : at + 1 + data[at]])
            at += 1 + data[at]
        at += 1
        return b"".join(parts)

    if flags & 0x80:
        shared = palette(flags)
    frames: list[Frame] = []
    delay, disposal, clear_colour = 0, 0, None
    while True:
        kind = data[at]
        at += 1
        if kind == TRAILER:
            return width, height, frames
        if kind == EXTENSION:
            label = data[at]
            at += 1
            body = blocks()
            if label == GRAPHIC_CONTROL:
                packed, delay, index = struct.unpack_from("<BHB", body)
                disposal, clear_colour = packed >> 2 & 7, index if packed & 1 else None
        elif kind == IMAGE:
            left, top, w, h, packed = struct.unpack_from("<HHHHB", data, at)
            at += 9
            own = palette(packed) if packed & 0x80 else shared
            if own is None:
                raise BadGif("no palette")
            bits = data[at]
            at += 1
            pixels = np.frombuffer(lzw_decode(blocks(), bits, w * h), np.uint8).reshape(h, w) if w * h else np.zeros((h, w), np.uint8)
            if packed & 0x40:
                order = np.concatenate([np.arange(a, h, step) for a, step in INTERLACED])
                straight = np.empty_like(pixels)
                straight[order] = pixels
                pixels = straight
            frames.append(Frame(left, top, pixels, own, delay, disposal, clear_colour))
            delay, disposal, clear_colour = 0, 0, None
        else:
            raise BadGif("block kind")


def composed(width: int, height: int, frames: list[Frame]) -> Iterator[tuple[int, np.ndarray]]:
    """``start_cs, canvas`` of each frame as shown: RGBA, transparent where nothing is drawn."""
    canvas = np.zeros((height, width), dtype="<u4")  # red in the low byte, alpha in the high one
    start = 0
    for f in frames:
        before = canvas.copy() if f.disposal == 3 else None
        h, w = max(0, min(f.pixels.shape[0], height - f.top)), max(0, min(f.pixels.shape[1], width - f.left))
        index = f.pixels[:h, :w]
        table = np.zeros((256, 4), dtype=np.uint8)
        table[: len(f.palette), :3] = f.palette
        table[: len(f.palette), 3] = 255
        area = canvas[f.top : f.top + h, f.left : f.left + w]
        np.copyto(area, table.view("<u4")[:, 0][index], where=True if f.transparent is None else index != f.transparent)
        yield start, canvas.copy().view(np.uint8).reshape(height, width, 4)
        start += f.delay_cs
        if f.disposal == 2:
            area[...] = 0
        elif before is not None:
            canvas = before


def histogram(canvas: np.ndarray) -> list[int]:
    """Drawn pixels by colour, two bits a channel: 64 counts, red first."""
    pixel = canvas.view("<u4").ravel()
    place = (pixel >> 6 & 3) << 4 | (pixel >> 14 & 3) << 2 | pixel >> 22 & 3
    return np.bincount(place[pixel >> 24 > 0], minlength=64).tolist()


@dataclass
class Shown:
    """A frame in its place in time: what is stored of it, and the canvas as shown with its ``histogram``."""

    place: int
    start_cs: int
    stored: Frame
    canvas: np.ndarray
    colours: list[int]


def shown_frames(data: bytes) -> Iterator[Shown]:
    """The frames of a GIF in order, composed; ``BadGif`` before the first for one that is not whole."""
    width, height, frames = read_gif(data)
    for k, (stored, (start, canvas)) in enumerate(zip(frames, composed(width, height, frames), strict=True)):
        yield Shown(k, start, stored, canvas, histogram(canvas))


FRAMES = "media_id long, frame int, start_cs int, delay_cs int, width int, height int, samples binary, pixels binary, colours array<int>, error string"
FRAMES_ARROW = pa.schema([("media_id", pa.int64()), ("frame", pa.int32()), ("start_cs", pa.int32()), ("delay_cs", pa.int32()), ("width", pa.int32()), ("height", pa.int32()), ("samples", pa.binary()), ("pixels", pa.binary()), ("colours", pa.list_(pa.int32())), ("error", pa.string())])


def decode_frames(media: DataFrame, id_col: str = "media_id", gif_col: str = "gif") -> DataFrame:
    """A row a shown frame: its time, canvas size, ``samples``, ``pixels`` and ``colours``, a histogram of 64 counts.

    ``samples`` are the palette indices as stored, ``pixels`` the canvas as shown, row by row, four
    bytes a pixel: red, green, blue and 255, or 0 where nothing is drawn.

    A GIF without frames, a null one and one that cannot be read give one row with ``frame`` null;
    ``error`` says why (``null`` where there is just no frame).  Other columns are ignored;
    repeated rows repeat; an empty table gives none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, held = [], 0
            for key, gif in zip(batch.column("media_id").to_pylist(), batch.column("gif"), strict=True):
                blank, first = dict.fromkeys(FRAMES_ARROW.names) | {"media_id": key}, len(rows)
                found = False
                try:
                    for f in shown_frames(gif.as_py()) if gif.is_valid else ():
                        found = True
                        pixels, samples = f.canvas.tobytes(), f.stored.pixels.tobytes()
                        height, width = f.canvas.shape[:2]
                        rows.append({"media_id": key, "frame": f.place, "start_cs": f.start_cs, "delay_cs": f.stored.delay_cs, "width": width, "height": height, "samples": samples, "pixels": pixels, "colours": f.colours, "error": None})
                        held += len(pixels) + len(samples)
                        if held > HELD_BYTES:
                            yield pa.RecordBatch.from_pylist(rows, schema=FRAMES_ARROW)
                            rows, held, first = [], 0, 0
                    if not found:
                        size = struct.unpack_from("<HH", gif.as_py(), 6) if gif.is_valid else (None, None)
                        rows.append(blank | {"width": size[0], "height": size[1]})
                except BadGif as e:
                    rows[first:] = [blank | {"error": str(e)}]
            yield pa.RecordBatch.from_pylist(rows, schema=FRAMES_ARROW)

    return media.select(F.col(id_col).cast("long").alias("media_id"), F.col(gif_col).alias("gif")).mapInArrow(run, FRAMES)


#: The stored form of a payload: 24 pixels a row, units of 24 rows, up to 16 units a frame.
SIDE, UNIT, FRAME_UNITS = 24, 576, 16
#: Its filler, which is not drawn, and the disposals that its frames take in turn: leave, clear, bring back.
FILLER, DISPOSALS = 255, (1, 2, 3)


@cache
def payload_palette() -> np.ndarray:
    """256 distinct colours: three bits of red and green, two of blue."""
    k = np.arange(256)
    return np.stack([(k >> 5) * 36, (k >> 2 & 7) * 36, (k & 3) * 85], axis=1).astype(np.uint8)


def store_payload(data: bytes) -> bytes:
    """``data`` padded with ``FILLER`` to whole units, as an animated GIF: a frame lasts as many hundredths as it has units."""
    padded = data + bytes([FILLER]) * (-len(data) % UNIT if data else UNIT)
    step = UNIT * FRAME_UNITS
    frames = [np.frombuffer(padded[k : k + step], np.uint8).reshape(-1, SIDE) for k in range(0, len(padded), step)]
    turns = [DISPOSALS[k % len(DISPOSALS)] for k in range(len(frames))]
    return write_gif(frames, payload_palette(), [f.size // UNIT for f in frames], turns, FILLER)


def payload_media(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, gif``: every whole text's bytes as a GIF.

    Null and empty texts have 0 bytes and one filled frame.  Rows that repeat have a row each, equal
    texts equal files; a null id stays null; other columns are ignored; an empty table gives an
    empty result.  A very long text is one file of as many frames as it needs, in memory at once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, sizes, gifs, held = [], [], [], 0
            for key, value in zip(batch.column("doc_id"), batch.column("text"), strict=True):
                data = (value.as_py() or "").encode("utf-8", "surrogatepass")
                keys.append(key.as_py())
                sizes.append(len(data))
                gifs.append(store_payload(data))
                held += len(gifs[-1])
                if held > HELD_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(sizes, pa.int64()), pa.array(gifs, pa.binary())], names=["doc_id", "n_bytes", "gif"])
                    keys, sizes, gifs, held = [], [], [], 0
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(sizes, pa.int64()), pa.array(gifs, pa.binary())], names=["doc_id", "n_bytes", "gif"])

    return documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_bytes long, gif binary")


def payload_features(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stores every whole text's bytes as a GIF in a media table, reads the table back and describes it.

    ``doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256,
    feature, n_frames, duration_cs``.  The payload is what the frames' samples say.  ``feature``
    is the canvas, the number and time of frames, and how many pixels are shown in each colour
    bucket for how long, over all composed frames: a pixel that stays on while later frames are
    shown counts for theirs.

    A null text is an empty one; equal texts have equal values; repeated rows repeat; very long
    texts are many frames; a null id stays; other columns are ignored; an empty table gives none.
    """
    names = ["payload_bytes", "payload_sha256", "tail_crc32", "feature", "n_frames", "duration_cs"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
    media = Scratch(documents.sparkSession, "gif").keep(payload_media(documents, id_col, text_col), "media")

    def describe(gif: bytes) -> tuple:
        digest, tail, size, count, time = hashlib.sha256(), b"", 0, 0, 0
        weight, canvas = np.zeros(64, dtype=np.int64), (0, 0)
        for f in shown_frames(gif):
            samples = f.stored.pixels.tobytes()
            digest.update(samples)
            tail, size, count, time = (tail + samples[-32:])[-32:], size + len(samples), count + 1, time + f.stored.delay_cs
            weight += np.array(f.colours) * f.stored.delay_cs
            canvas = f.canvas.shape
        feature = f"{canvas[1]}x{canvas[0]};{count}f;{time}cs;" + ",".join(f"{k}:{c}" for k, c in enumerate(weight.tolist()) if c)
        return size, digest.hexdigest(), zlib.crc32(tail), feature, count, time

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [describe(v.as_py()) for v in batch.column("gif")]
            columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
            kept = [batch.column(c) for c in ("doc_id", "n_bytes", "media_bytes", "media_sha256")]
            yield pa.RecordBatch.from_arrays([*kept, *columns], names=["doc_id", "n_bytes", "media_bytes", "media_sha256", *names])

    schema = "doc_id long, n_bytes long, media_bytes long, media_sha256 string, " + ", ".join(f"{n} {'string' if k == pa.string() else 'long'}" for n, k in zip(names, kinds, strict=True))
    stored = media.select("doc_id", "n_bytes", F.octet_length("gif").cast("long").alias("media_bytes"), F.sha2("gif", 256).alias("media_sha256"), "gif")
    out = stored.mapInArrow(run, schema)
    return out.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_frames", "duration_cs")
