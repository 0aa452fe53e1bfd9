import hashlib
import random
import sys
import zlib

import numpy as np
import pytest

from chronocell.llm.gif import BadGif, composed, decode_frames, lzw_decode, lzw_encode, payload_features, payload_palette, read_gif, store_payload, write_gif


@pytest.mark.parametrize("bits", [2, 4, 8])
def test_lzw_round_trip(bits):
    rng = random.Random(bits)
    for n in [0, 1, 2, 5, 250, 600, 4000, 30_000]:
        for spread in (1, 3, 1 << bits):
            data = bytes(rng.randrange(min(spread, 1 << bits)) for _ in range(n))
            assert lzw_decode(lzw_encode(data, bits), bits, n) == data


def test_known_stream():
    # The 10 x 10 sample image of the format's common description: 4 colours, code size 2.
    stream = bytes.fromhex("8c2d99872a1cdc33a00275ec95faa8de608c04914c01")
    rows = ["1111122222"] * 3 + ["1110000222"] * 2 + ["2220000111"] * 2 + ["2222211111"] * 3
    assert lzw_decode(stream, 2, 100) == bytes(int(c) for c in "".join(rows))


def test_disposal_transparency_and_time():
    palette = np.array([[0, 0, 0], [255, 0, 0], [0, 255, 0], [0, 0, 255]], np.uint8)
    full = np.full((4, 4), 1, np.uint8)
    spot = np.array([[2, 0], [0, 2]], np.uint8)
    for disposal, corner in ((1, (0, 255, 0)), (2, None), (3, (255, 0, 0))):
        first = write_gif([full], palette, [7])
        later = write_gif([spot, np.full((1, 1), 3, np.uint8)], palette, [5, 6], disposal, 0, [(1, 1), (0, 0)], (4, 4))
        w, h, frames = read_gif(first[:-1] + later[6 + 7 + 12 :])
        shown = list(composed(w, h, frames))
        assert [s for s, _ in shown] == [0, 7, 12]
        assert tuple(shown[1][1][1, 1][:3]) == (0, 255, 0) and tuple(shown[1][1][1, 2][:3]) == (255, 0, 0)
        pixel = shown[2][1][1, 1]
        assert (tuple(pixel[:3]) if pixel[3] else None) == corner
        assert tuple(shown[2][1][0, 0][:3]) == (0, 0, 255)


def test_interlaced_rows_and_local_palette():
    rows = np.arange(11, dtype=np.uint8)[:, None].repeat(3, 1)
    order = [*range(0, 11, 8), *range(4, 11, 8), *range(2, 11, 4), *range(1, 11, 2)]
    data = bytearray(write_gif([rows[order]], np.arange(48, dtype=np.uint8).reshape(16, 3)))
    image = data.index(b"\x2c", 13 + 48)
    data[image + 9] |= 0x40
    assert (read_gif(bytes(data))[2][0].pixels == rows).all()
    data[image + 9] |= 0x83
    data[image + 10 : image + 10] = bytes(range(100, 148))
    assert read_gif(bytes(data))[2][0].palette[0].tolist() == [100, 101, 102]


def test_broken_files_are_reported(spark):
    good = store_payload(b"abc" * 400)
    for cut in (0, 3, 10, 200, len(good) // 2, len(good) - 1):
        with pytest.raises(BadGif):
            read_gif(good[:cut])
    rows = [(1, good, "a"), (2, good[:900], "b"), (3, None, "c"), (None, b"", "d"), (1, good, "a")]
    got = decode_frames(spark.createDataFrame(rows, "media_id long, gif binary, frame string")).collect()
    assert sorted((r["media_id"] or 0, r["frame"] is None, r["error"] is None) for r in got) == [(0, True, False), (1, False, True), (1, False, True), (2, True, False), (3, True, True)]
    assert sum(next(r for r in got if r["media_id"] == 1)["colours"]) == 1200  # the filler is not drawn


def plain_lzw(data):
    """The stream of values under 256, string by string and bit by bit."""
    bits, codes, table, have = [], [], {bytes([k]): k for k in range(256)}, b""

    def put(code, width):
        bits.extend(code >> k & 1 for k in range(width))

    size, width = 258, 9
    put(256, 9)
    for value in data:
        longer = have + bytes([value])
        if longer in table:
            have = longer
            continue
        put(table[have], width)
        table[longer] = size
        size += 1
        have = bytes([value])
        if size == 4096:
            put(256, 12)
            table, size, width = {bytes([k]): k for k in range(256)}, 258, 9
        elif size > 1 << width:
            width += 1
    put(table[have], width)
    # The reader has made one entry more by then.
    put(257, width + (size + 1 > 1 << width and width < 12 and size > 258))
    bits += [0] * (-len(bits) % 8)
    return bytes(sum(b << k for k, b in enumerate(bits[at : at + 8])) for at in range(0, len(bits), 8))


def plain_gif(padded):
    rows = min(len(padded) // 24, 384)
    out = b"GIF89a" + bytes([24, 0, rows & 255, rows >> 8, 0xF7, 0, 0])
    out += b"".join(bytes([(k >> 5) * 36, (k >> 2 & 7) * 36, (k & 3) * 85]) for k in range(256))
    for k, at in enumerate(range(0, len(padded), 24 * 384)):
        part = padded[at : at + 24 * 384]
        stream, height = plain_lzw(part), len(part) // 24
        out += bytes([0x21, 0xF9, 4, (1, 2, 3)[k % 3] << 2 | 1, len(part) // 576, 0, 255, 0])
        out += bytes([0x2C, 0, 0, 0, 0, 24, 0, height & 255, height >> 8, 0, 8])
        out += b"".join(bytes([len(stream[j : j + 255])]) + stream[j : j + 255] for j in range(0, len(stream), 255)) + b"\0"
    return out + b";"


def plain_feature(padded):
    """Pixel by pixel: what each place shows while each frame is on."""
    rows, counts, shown, time, n = min(len(padded) // 24, 384), {}, {}, 0, 0
    for k, at in enumerate(range(0, len(padded), 24 * 384)):
        part, before = padded[at : at + 24 * 384], dict(shown)
        lasts = len(part) // 576
        for place, value in enumerate(part):
            if value != 255:
                shown[place] = value
        for value in shown.values():
            bucket = ((value >> 5) * 36 >> 6) * 16 + ((value >> 2 & 7) * 36 >> 6) * 4 + ((value & 3) * 85 >> 6)
            counts[bucket] = counts.get(bucket, 0) + lasts
        if k % 3 == 1:
            for place in range(len(part)):
                shown.pop(place, None)
        elif k % 3 == 2:
            shown = before
        time, n = time + lasts, n + 1
    return f"24x{rows};{n}f;{time}cs;" + ",".join(f"{k}:{counts[k]}" for k in sorted(counts))


def test_payloads(spark):
    assert len({tuple(c) for c in payload_palette().tolist()}) == 256
    rng = random.Random(9)
    texts = [None, "", "é" * 288, "x" * 577, "long " * 9000, "x" * 577, "".join(rng.choice("abcdefgh ÄÖ€\n") for _ in range(40_000)), "".join(chr(rng.randrange(32, 50_000)) for _ in range(9_000))]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, n_bytes int")
    got = {r["doc_id"]: r for r in payload_features(df).collect()}
    for i, t in enumerate(texts):
        data = (t or "").encode()
        padded = data + b"\xff" * (576 if not data else -len(data) % 576)
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"]) == (len(data), len(padded))
        assert r["payload_sha256"] == hashlib.sha256(padded).hexdigest() and r["tail_crc32"] == zlib.crc32(padded[-32:])
        media = plain_gif(padded)
        assert (r["media_bytes"], r["media_sha256"]) == (len(media), hashlib.sha256(media).hexdigest())
        assert r["feature"] == plain_feature(padded)
    assert got[3][1:] == got[5][1:]
    assert payload_features(df.limit(0)).count() == 0


def test_frames_keep_their_pixels(spark):
    palette = np.array([[0, 0, 0], [255, 0, 0], [0, 255, 0], [0, 0, 255]], np.uint8)
    gif = write_gif([np.full((2, 2), 2, np.uint8), np.full((1, 1), 3, np.uint8)], palette, [5, 6], 2, 0, [(1, 1), (0, 0)], (3, 4))
    got = decode_frames(spark.createDataFrame([(1, gif)], "media_id long, gif binary")).orderBy("frame").collect()
    assert [(r["start_cs"], r["width"], r["height"]) for r in got] == [(0, 3, 4), (5, 3, 4)]
    first, second = (np.frombuffer(r["pixels"], np.uint8).reshape(4, 3, 4) for r in got)
    assert (first[1:3, 1:3] == [0, 255, 0, 255]).all() and first[..., 3].sum() == 4 * 255
    assert second[0, 0].tolist() == [0, 0, 255, 255] and second[..., 3].sum() == 255


def lines_run(work):
    """How many lines of Python ``work`` runs."""
    count = 0

    def trace(frame, event, arg):
        nonlocal count
        count += event == "line"
        return trace

    before = sys.gettrace()
    sys.settrace(trace)
    try:
        work()
    finally:
        sys.settrace(before)
    return count


def test_reading_runs_no_python_for_each_code():
    rng = random.Random(4)
    words = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(2, 9))) for _ in range(400)]
    text = " ".join(rng.choice(words) for _ in range(3000)).encode()
    media = store_payload(text)
    assert lines_run(lambda: read_gif(media)) < len(text) / 10


def never_cleared(data):
    """A stream of values under 256 that has no clear code: its table stays as it is once full."""
    table, codes, have = {bytes([k]): k for k in range(256)}, [], b""
    for value in data:
        longer = have + bytes([value])
        if longer not in table:
            codes.append(table[have])
            if len(table) < 4096 - 2:
                table[longer] = len(table) + 2
            longer = bytes([value])
        have = longer
    codes += [table[have], 257]
    bits = "".join(f"{c:0{max(9, min(257 + max(k, 1), 4095).bit_length())}b}"[::-1] for k, c in enumerate(codes))
    return bytes(int(bits[k : k + 8][::-1], 2) for k in range(0, len(bits), 8))


def test_full_tables_and_long_copies():
    rng = random.Random(6)
    for data in (rng.randbytes(30_000), bytes(rng.choice(b"abcd") for _ in range(60_000)), bytes(9_000_000), b"ab" * 2_000_000 + rng.randbytes(9)):
        stream = lzw_encode(data, 8)
        assert lzw_decode(stream, 8, len(data)) == data and lzw_decode(stream, 8, 70_001 % len(data)) == data[: 70_001 % len(data)]
        stream = never_cleared(data) if len(data) < 100_000 else stream
        assert lzw_decode(stream, 8, len(data)) == data
        with pytest.raises(BadGif):
            lzw_decode(stream[: len(stream) // 2], 8, len(data))
        with pytest.raises(BadGif):
            lzw_decode(stream, 8, len(data) + 1)
    assert lzw_decode(lzw_encode(bytes(99), 1), 1, 99) == bytes(99)
    with pytest.raises(BadGif, match="not in the table"):
        lzw_decode((256 | 65 << 9 | 300 << 18).to_bytes(4, "little"), 8, 3)
