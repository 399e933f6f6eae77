"""Media columns: AVI motion-JPEG.

Writer: a payload is cut into gray frames, 64 samples wide and 64 lines high (the last may be lower), each stored as a
lossless JPEG (process SOF3, predictor 1) in a RIFF AVI file with an ``idx1`` index. The Huffman table gives difference
category c a code of 9 - c bits, so a code with its c extra bits always takes 9 bits: frames of this table are coded and
decoded by array operations. Decoding of any other table of the same process goes bit by bit.

Reader: parses the RIFF index (or walks the ``movi`` list where there is none), decodes the intra frames, and detects shots
where the histogram difference of neighbouring frames exceeds an adaptive threshold; each shot is a timed clip. Frames of other
writers may be baseline JPEGs (SOF0, 8 bits, one or three components, restart intervals); their luma is decoded.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

WIDTH = HEIGHT = 64
FPS = 25
#: Histogram bins, and the threshold of a cut: mean + SIGMAS * deviation of the last WINDOW differences, FLOOR at least.
BINS, WINDOW, SIGMAS, FLOOR = 32, 8, 3.0, 0.35
#: Code lengths 1 to 9 have one code each; the shortest is category 8's.
LENGTHS, VALUES = bytes([1] * 9 + [0] * 7), bytes(range(8, -1, -1))


def _code_table() -> np.ndarray:
    """The 9 bits of each difference, -255 to 255."""
    out = np.zeros(511, dtype=np.uint16)
    for d in range(-255, 256):
        c = abs(d).bit_length()
        code = (1 << (9 - c)) - 2  # 8 - c ones and a zero
        out[d + 255] = code << c | (d if d > 0 else d + (1 << c) - 1 if c else 0)
    return out


_CODE = _code_table()
_DIFF = np.zeros(512, dtype=np.int16)
_DIFF[_CODE] = np.arange(-255, 256)


def _jpeg_head(height: int) -> bytes:
    dht = b"\xff\xc4" + struct.pack(">HB", 2 + 1 + 16 + len(VALUES), 0) + LENGTHS + VALUES
    sof = b"\xff\xc3" + struct.pack(">HBHHBBBB", 11, 8, height, WIDTH, 1, 1, 0x11, 0)
    return b"\xff\xd8" + dht + sof + b"\xff\xda" + struct.pack(">HBBBBBB", 8, 1, 1, 0, 1, 0, 0)


_HEADS = {h: _jpeg_head(h) for h in range(1, HEIGHT + 1)}


def encode_frames(samples: np.ndarray) -> list[bytes]:
    """Lossless JPEGs of uint8 samples (a positive multiple of WIDTH), HEIGHT lines each."""
    lines = samples.reshape(-1, WIDTH).astype(np.int16)
    diff = np.empty_like(lines)
    diff[:, 1:] = lines[:, 1:] - lines[:, :-1]
    diff[1:, 0] = lines[1:, 0] - lines[:-1, 0]
    diff[::HEIGHT, 0] = lines[::HEIGHT, 0] - 128
    codes = _CODE[diff.ravel() + 255].astype(">u2")
    bits = np.unpackbits(codes.view(np.uint8)).reshape(-1, 16)[:, 7:]
    packed, row = np.packbits(bits).tobytes(), WIDTH * 9 // 8
    frames = []
    for top in range(0, len(lines), HEIGHT):
        height = min(HEIGHT, len(lines) - top)
        frames.append(_HEADS[height] + packed[top * row : (top + height) * row].replace(b"\xff", b"\xff\x00") + b"\xff\xd9")
    return frames


def _slow_diffs(data: bytes, lengths: bytes, values: bytes, n: int) -> np.ndarray:
    """Differences by any Huffman table, bit by bit."""
    table, code, k = {}, 0, 0
    for size, many in enumerate(lengths, 1):
        for _ in range(many):
            table[size, code] = values[k]
            code, k = code + 1, k + 1
        code <<= 1
    out, at, bits = np.empty(n, dtype=np.int32), 0, np.unpackbits(np.frombuffer(data, dtype=np.uint8)).tolist()
    for i in range(n):
        code = size = 0
        while (size, code) not in table:
            code, at, size = code << 1 | bits[at], at + 1, size + 1
            if size > 16:
                raise ValueError("not a code of the table")
        c, code = table[size, code], 0
        for b in bits[at : at + c]:
            code = code << 1 | b
        at += c
        out[i] = code if c == 0 or code >> (c - 1) else code - (1 << c) + 1
    return out


class _Bits:
    """Bits of an entropy-coded segment, and the symbols of Huffman tables by a lookup of 16 bits."""

    def __init__(self, data: bytes):
        self.data, self.at, self.held, self.n = data, 0, 0, 0

    def peek(self, k: int) -> int:
        while self.n < k:
            self.held = self.held << 8 | (self.data[self.at] if self.at < len(self.data) else 0xFF)
            self.at, self.n = self.at + 1, self.n + 8
        return self.held >> (self.n - k) & ((1 << k) - 1)

    def take(self, k: int) -> int:
        value = self.peek(k) if k else 0
        self.n -= k
        self.held &= (1 << self.n) - 1
        return value

    def signed(self, k: int) -> int:
        value = self.take(k)
        return value if k == 0 or value >> (k - 1) else value - (1 << k) + 1

    def symbol(self, table: list[tuple[int, int]]) -> int:
        size, value = table[self.peek(16)]
        if not size:
            raise ValueError("not a code of the table")
        self.take(size)
        return value


def _lookup(lengths: bytes, values: bytes) -> list[tuple[int, int]]:
    """(length, symbol) of the code that each 16 bits begin with; length 0 for none."""
    out, code, k = [(0, 0)] * 65536, 0, 0
    for size, many in enumerate(lengths, 1):
        for _ in range(many):
            first = code << (16 - size)
            out[first : first + (1 << (16 - size))] = [(size, values[k])] * (1 << (16 - size))
            code, k = code + 1, k + 1
        code <<= 1
    return out


def _zigzag() -> list[int]:
    """Places of the coefficients of a block, by diagonals of alternating direction."""
    return [y * 8 + x for y, x in sorted(((y, x) for y in range(8) for x in range(8)), key=lambda p: (sum(p), p[0] if sum(p) % 2 else p[1]))]


_ORDER = np.array(_zigzag())
_COS = np.array([[(2**-0.5 if u == 0 else 1.0) / 2 * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)])


def _luma(scan: bytes, parts: list[tuple[int, int, int, int]], chosen: dict, tables: dict, quant: dict, height: int, width: int, every: int) -> np.ndarray:
    """The first component of a baseline scan. parts: (id, horizontal, vertical sampling, quantiser); every: MCUs of a restart interval."""
    wide, high = (max(p[i] for p in parts) for i in (1, 2))
    if len(parts) == 1:
        wide = high = 1
        parts = [(parts[0][0], 1, 1, parts[0][3])]
    across, down = -(-width // (8 * wide)), -(-height // (8 * high))
    _, h0, v0, q0 = parts[0]
    blocks = np.zeros((down * v0, across * h0, 64))
    pieces = re.split(rb"\xff[\xd0-\xd7]", scan)
    piece, bits, last = 0, _Bits(pieces[0].replace(b"\xff\x00", b"\xff")), [0] * len(parts)
    for mcu in range(across * down):
        if every and mcu and mcu % every == 0:
            piece += 1
            bits, last = _Bits(pieces[piece].replace(b"\xff\x00", b"\xff")), [0] * len(parts)
        for c, (ident, h, v, _) in enumerate(parts):
            dc, ac = (tables[kind, chosen[ident][kind]] for kind in (0, 1))
            for b in range(h * v):
                block = [0] * 64
                last[c] += bits.signed(bits.symbol(dc))
                block[0], k = last[c], 1
                while k < 64:
                    symbol = bits.symbol(ac)
                    run, size = symbol >> 4, symbol & 15
                    if not size:
                        if run < 15:
                            break
                        k += 16
                        continue
                    k += run
                    if k > 63:
                        raise ValueError("more than 64 coefficients")
                    block[k] = bits.signed(size)
                    k += 1
                if c == 0:
                    blocks[mcu // across * v + b // h, mcu % across * h + b % h] = block
    grid = np.zeros_like(blocks)
    grid[..., _ORDER] = blocks * quant[q0]
    samples = np.einsum("yx,ijyu,uv->ijxv", _COS, grid.reshape(*blocks.shape[:2], 8, 8), _COS, optimize=True) + 128
    plane = samples.transpose(0, 2, 1, 3).reshape(blocks.shape[0] * 8, -1)
    rows, cols = (-(-height * v0 // high), -(-width * h0 // wide))
    return np.clip(np.rint(plane[:rows, :cols]), 0, 255).astype(np.uint8)


def decode_frame(jpeg: bytes) -> np.ndarray:
    """The samples (lines x width, uint8) of a one-component lossless JPEG with predictor 1, or the luma of a baseline JPEG.

    Baseline frames must bring their Huffman tables. Other processes raise a ValueError.
    """
    if jpeg[:2] != b"\xff\xd8":
        raise ValueError("no start of image")
    at, height, width, process, every = 2, 0, 0, 0, 0
    huffman: dict[tuple[int, int], tuple[bytes, bytes]] = {}
    quant: dict[int, np.ndarray] = {}
    parts: list[tuple[int, int, int, int]] = []
    while True:
        mark, size = struct.unpack_from(">HH", jpeg, at)
        body = jpeg[at + 4 : at + 2 + size]
        at += 2 + size
        if mark == 0xFFC4:
            while body:
                n = sum(body[1:17])
                huffman[body[0] >> 4, body[0] & 15] = (body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif mark == 0xFFDB:
            while body:
                n = 128 if body[0] >> 4 else 64
                quant[body[0] & 15] = np.frombuffer(body[1 : 1 + n], dtype=">u2" if n == 128 else np.uint8).astype(np.float64)
                body = body[1 + n :]
        elif mark == 0xFFDD:
            (every,) = struct.unpack(">H", body[:2])
        elif mark in (0xFFC0, 0xFFC3):
            process, (depth, height, width, n) = mark, struct.unpack_from(">BHHB", body)
            parts = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
            if depth != 8 or (mark == 0xFFC3 and n != 1):
                raise ValueError("8 bits, and one component of a lossless frame, are supported")
        elif 0xFFC0 <= mark <= 0xFFCF and mark != 0xFFC8:
            raise ValueError(f"unsupported process {mark:#x}")
        elif mark == 0xFFDA:
            break
    scan = jpeg[at : jpeg.rindex(b"\xff\xd9")]
    chosen = {body[1 + 2 * i]: (body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(body[0])}
    if process == 0xFFC0:
        if body[0] != len(parts):
            raise ValueError("one scan is supported")
        return _luma(scan, parts, chosen, {k: _lookup(*v) for k, v in huffman.items()}, quant, height, width, every)
    if process != 0xFFC3 or body[-3] != 1:
        raise ValueError("predictor 1 is supported")
    (lengths, values), n = huffman[0, chosen[parts[0][0]][0]], height * width
    data = scan.replace(b"\xff\x00", b"\xff")
    if height < 1 or width < 1:
        raise ValueError("a frame without samples")
    if lengths == LENGTHS and values == VALUES:
        if len(data) * 8 < 9 * n:
            raise ValueError("the frame's data end early")
        bits = np.unpackbits(np.frombuffer(data, dtype=np.uint8))[: 9 * n].reshape(-1, 9)
        wide = np.zeros((n, 16), dtype=np.uint8)
        wide[:, 7:] = bits
        diff = _DIFF[np.packbits(wide).view(">u2")]
    else:
        diff = _slow_diffs(data, lengths, values, n)
    grid = diff.reshape(height, width).astype(np.int32)
    grid[:, 0] = np.cumsum(grid[:, 0]) + 128
    return (np.cumsum(grid, axis=1) & 0xFF).astype(np.uint8)


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)


def write_avi(payload: bytes) -> bytes:
    """An AVI file that holds ``payload`` (its length a positive multiple of 64) sample for sample."""
    frames = encode_frames(np.frombuffer(payload, dtype=np.uint8))
    most = max(map(len, frames))
    avih = struct.pack("<14I", 1_000_000 // FPS, most * FPS, 0, 0x10, len(frames), 0, 1, most, WIDTH, HEIGHT, 0, 0, 0, 0)
    strh = b"vidsMJPG" + struct.pack("<IHHIIIIIIII4H", 0, 0, 0, 0, 1, FPS, 0, len(frames), most, 0xFFFFFFFF, 0, 0, 0, WIDTH, HEIGHT)
    strf = struct.pack("<IiiHH4sIiiII", 40, WIDTH, HEIGHT, 1, 8, b"MJPG", WIDTH * HEIGHT, 0, 0, 256, 0)
    hdrl = b"hdrl" + _chunk(b"avih", avih) + _chunk(b"LIST", b"strl" + _chunk(b"strh", strh) + _chunk(b"strf", strf))
    movi, index, at = [], [], 4
    for f in frames:
        movi.append(_chunk(b"00dc", f))
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(f)))
        at += len(movi[-1])
    body = b"AVI " + _chunk(b"LIST", hdrl) + _chunk(b"LIST", b"movi" + b"".join(movi)) + _chunk(b"idx1", b"".join(index))
    return _chunk(b"RIFF", body)


def read_avi(media: bytes) -> tuple[list[bytes], float]:
    """The video chunks of an AVI file, by its index where it has one, and its frames per second."""
    if media[:4] != b"RIFF" or media[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    at, movi, index, fps = 12, None, b"", float(FPS)
    while at + 8 <= len(media):
        name, size = struct.unpack_from("<4sI", media, at)
        kind = media[at + 8 : at + 12]
        if name == b"LIST" and kind == b"movi":
            movi = (at + 8, at + 8 + size)
        elif name == b"LIST" and kind == b"hdrl" and media[at + 12 : at + 16] == b"avih":
            (micro,) = struct.unpack_from("<I", media, at + 20)
            fps = 1e6 / micro if micro else fps
        elif name == b"idx1":
            index = media[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    if movi is None:
        return [], fps
    frames = []
    if index:
        for name, _, where, size in struct.iter_unpack("<4sIII", index):
            if name[2:] in (b"dc", b"db"):
                start = movi[0] + where + 8  # offsets count from the list's name
                if start + size > len(media):
                    raise ValueError("the file ends inside a frame")
                frames.append(media[start : start + size])
        return frames, fps
    at = movi[0] + 4
    while at + 8 <= movi[1]:
        name, size = struct.unpack_from("<4sI", media, at)
        if name[2:] in (b"dc", b"db"):
            if at + 8 + size > len(media):
                raise ValueError("the file ends inside a frame")
            frames.append(media[at + 8 : at + 8 + size])
        at += 8 + size + (size & 1)
    return frames, fps


def histogram(frame: np.ndarray) -> np.ndarray:
    """Shares of a frame's samples in BINS bins."""
    return np.bincount(frame.ravel() >> 3, minlength=BINS) / max(frame.size, 1)


def cuts(hists: list[np.ndarray], fps: float) -> list[dict]:
    """Clips between cuts: shot, first_frame, last_frame, start_s, end_s, peak (its cut's difference, 0 for the first)."""
    if not hists:
        return []
    diffs = np.abs(np.diff(np.stack(hists), axis=0)).sum(axis=1) / 2
    found = [(0, 0.0)]
    for i, d in enumerate(diffs):
        past = diffs[max(0, i - WINDOW) : i]
        if d > max(FLOOR, (past.mean() + SIGMAS * past.std()) if len(past) else 0.0):
            found.append((i + 1, float(d)))
    ends = [c for c, _ in found[1:]] + [len(hists)]
    return [{"shot": k, "first_frame": a, "last_frame": b - 1, "start_s": a / fps, "end_s": b / fps, "peak": p} for k, ((a, p), b) in enumerate(zip(found, ends))]


def shots(frames: list[np.ndarray], fps: float) -> list[dict]:
    """The clips of decoded frames."""
    return cuts([histogram(f) for f in frames], fps)


def payload_of(text: str | None) -> tuple[int, bytes]:
    """Length in UTF-8 bytes, and the bytes filled with zeros up to a positive multiple of 64."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw + bytes(-len(raw) % 64 or 64 * (not raw))


#: Bytes of media that a batch of rows holds before it is sent on.
BATCH = 64 << 20


def _batches(rows: Iterable[tuple], size: Callable[[tuple], int], kinds: dict[str, pa.DataType]) -> Iterator[pa.RecordBatch]:
    """Rows as batches of about BATCH bytes."""
    held, n = [], 0
    for row in rows:
        held.append(row)
        n += size(row) + 64
        if n >= BATCH:
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in held], k) for i, k in enumerate(kinds.values())], names=list(kinds))
            held, n = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in held], k) for i, k in enumerate(kinds.values())], names=list(kinds))


def _with_id(batches: Iterator[pa.RecordBatch], make: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]) -> Iterator[pa.RecordBatch]:
    """What ``make`` yields for each batch, beside the first column of the same rows."""
    for batch in batches:
        at = 0
        for made in make(batch):
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, made.num_rows), *made.columns], names=["id", *made.schema.names])
            at += made.num_rows


def pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Texts as media: id, n_bytes and media (binary). A null or empty text is one line of zeros.

    Rows are independent: repeated ones have equal media, ids may be null, no other column is read. A text must leave room for
    its media in a row: they take 1.13 to 1.2 times its bytes and up to 2 GB.
    """

    def write(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rows = ((n, write_avi(payload)) for n, payload in (payload_of(t.as_py()) for t in batch.column(1)))
        return _batches(rows, lambda r: len(r[1]), {"n_bytes": pa.int64(), "media": pa.binary()})

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text_col).mapInArrow(lambda batches: _with_id(batches, write), f"id {kind}, n_bytes bigint, media binary").withColumnRenamed("id", id_col)


CLIPS = "array<struct<shot:int,first_frame:int,last_frame:int,start_s:double,end_s:double,peak:double>>"
_CLIP = pa.list_(pa.struct([("shot", pa.int32()), ("first_frame", pa.int32()), ("last_frame", pa.int32()), ("start_s", pa.float64()), ("end_s", pa.float64()), ("peak", pa.float64())]))


def features(blob: bytes | None) -> tuple:
    """(payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, frames, clips, error) of media.

    Null media have nulls throughout. What can't be read (no AVI file, a cut or unknown frame) has an error, its size and its
    hash, and null for the rest; so has a file without frames.
    """
    if blob is None:
        return (None,) * 8
    stored = (len(blob), hashlib.sha256(blob).hexdigest())
    try:
        chunks, fps = read_avi(blob)
        if not chunks:
            raise ValueError("no frames")
        digest, tail, n, hists = hashlib.sha256(), b"", 0, []
        for chunk in chunks:  # one decoded frame at a time
            frame = decode_frame(chunk)
            data = frame.tobytes()
            digest.update(data)
            tail, n = (tail + data)[-64:], n + len(data)
            hists.append(histogram(frame))
        return (n, digest.hexdigest(), zlib.crc32(tail), *stored, len(chunks), cuts(hists, fps), None)
    except (ValueError, IndexError, KeyError, struct.error, OverflowError, ZeroDivisionError) as e:
        return (None, None, None, *stored, None, None, f"{type(e).__name__}: {e}"[:200])


def analyse(media: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Read media columns (n_bytes, media): id, n_bytes and the features of each row. ``F.inline("clips")`` yields the timed clip rows."""
    kinds = {"n_bytes": pa.int64(), "payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "media_bytes": pa.int64(), "media_sha256": pa.string(), "frames": pa.int64(), "clips": _CLIP, "error": pa.string()}

    def read(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rows = ((n.as_py(), *features(blob.as_py())) for n, blob in zip(batch.column(1), batch.column(2)))
        return _batches(rows, lambda r: 48 * len(r[7] or ()), kinds)

    kind = media.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, frames bigint, clips {CLIPS}, error string"
    return media.select(id_col, "n_bytes", "media").mapInArrow(lambda batches: _with_id(batches, read), schema).withColumnRenamed("id", id_col)


def op6(docs: DataFrame) -> DataFrame:
    """Contract columns of the media query, and the clips' times (start-end in seconds, comma-joined)."""
    from pyspark.sql import functions as F

    ends = F.array_join(F.transform("clips", lambda c: c["last_frame"].cast("string")), ",")
    times = F.array_join(F.transform("clips", lambda c: F.format_string("%.2f-%.2f", c["start_s"], c["end_s"])), ",")
    return analyse(pack(docs)).select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256",
        F.concat(F.lit("frames="), F.col("frames").cast("string"), F.lit(";shots="), F.size("clips").cast("string"), F.lit(";ends="), ends).alias("feature"),
        times.alias("clip_times"), "error",
    )
