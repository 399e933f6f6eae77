"""Binary files: EPUB members, GIF and PNG images, PDF properties, document types."""

from __future__ import annotations

import io
import struct
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import dims


def epub_members(files: DataFrame) -> DataFrame:
    """From (path, content) of Spark's binary source to (url, member, content): one logical file for each member, ``path:member``."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    book = zipfile.ZipFile(io.BytesIO(blob or b""))
                except zipfile.BadZipFile:
                    continue
                for name in book.namelist():
                    if not name.endswith("/"):
                        yield pa.RecordBatch.from_arrays([pa.array([f"{path}:{name}"]), pa.array([name]), pa.array([book.read(name)], pa.binary())], names=["url", "member", "content"])

    return files.select("path", "content").mapInArrow(scan, "url string, member string, content binary")


def image_details(blob: bytes | None) -> dict | None:
    """media_type, width, height, image_size, frames, loops and frame_delays (seconds) of a GIF, PNG or JPEG; null for other data and cut files.

    A GIF without a loop block plays once; a loop count of 0, for ever, is 9999.
    """
    if not blob:
        return None
    if blob[:8] == b"\x89PNG\r\n\x1a\n" and len(blob) >= 24:
        width, height = struct.unpack(">II", blob[16:24])
        return {"media_type": "image/png", "width": width, "height": height, "image_size": len(blob), "frames": 1, "loops": 1, "frame_delays": []}
    if blob[:2] == b"\xff\xd8":
        at = 2
        while at + 9 <= len(blob) and blob[at] == 0xFF:
            mark, size = struct.unpack_from(">BH", blob, at + 1)
            if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):  # a frame's header
                height, width = struct.unpack_from(">HH", blob, at + 5)
                return {"media_type": "image/jpeg", "width": width, "height": height, "image_size": len(blob), "frames": 1, "loops": 1, "frame_delays": []}
            at += 2 + size
        return None
    if blob[:4] != b"GIF8" or len(blob) < 13:
        return None
    width, height, flags = struct.unpack("<HHB", blob[6:11])
    at, loops, delays, frames, delay = 13 + (3 << (flags & 7) + 1 if flags & 0x80 else 0), 1, [], 0, 0.0

    def blocks(i: int) -> tuple[bytes, int]:
        data = b""
        while i < len(blob) and blob[i]:
            data += blob[i + 1 : i + 1 + blob[i]]
            i += 1 + blob[i]
        return data, i + 1

    while at < len(blob) and blob[at] != 0x3B:
        if blob[at] == 0x21:
            kind = blob[at + 1]
            data, at = blocks(at + 2)
            if kind == 0xF9 and len(data) >= 4:
                delay = struct.unpack("<H", data[1:3])[0] / 100
            elif kind == 0xFF and data[:11] == b"NETSCAPE2.0" and len(data) >= 14:
                loops = struct.unpack("<H", data[12:14])[0] or 9999
        elif blob[at] == 0x2C:
            local = blob[at + 9]
            _, at = blocks(at + 10 + (3 << (local & 7) + 1 if local & 0x80 else 0) + 1)
            frames += 1
            delays.append(delay)
        else:
            break
    return {"media_type": "image/gif", "width": width, "height": height, "image_size": len(blob), "frames": frames, "loops": loops, "frame_delays": delays}


def _details(blob: bytes | None) -> dict | None:
    try:
        return image_details(blob)
    except (IndexError, struct.error):  # the file ends early
        return None


def images(files: DataFrame) -> DataFrame:
    """path and the details of every image."""
    kind = pa.struct([("media_type", pa.string()), ("width", pa.int32()), ("height", pa.int32()), ("image_size", pa.int64()), ("frames", pa.int32()), ("loops", pa.int32()), ("frame_delays", pa.list_(pa.float64()))])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([_details(b) for b in batch.column(1).to_pylist()], kind)], names=["path", "d"])

    made = files.select("path", "content").mapInArrow(scan, "path string, d struct<media_type:string,width:int,height:int,image_size:bigint,frames:int,loops:int,frame_delays:array<double>>")
    return made.where("d is not null").select("path", "d.*")


def doctype(html: Column) -> Column:
    """HTML version by the document type; without one, transitional HTML 4.01, or frameset where there is a frameset."""
    public = F.regexp_extract(html, r"(?is)<!DOCTYPE\s+html\s+PUBLIC\s+[\"']([^\"']+)[\"']", 1)
    known = F.create_map(*[F.lit(x) for pair in dims.DOCTYPES.items() for x in pair])[public]
    default = F.when(html.rlike(r"(?i)<frameset"), "HTML 4.01 Frameset").otherwise("HTML 4.01 Transitional")
    return F.coalesce(F.when(public != "", F.coalesce(known, F.lit("unknown"))), F.when(html.rlike(r"(?i)<!DOCTYPE\s+html\s*>"), "HTML5"), default)


def charset(header: Column, html: Column) -> Column:
    """From the content type's header, else from the page's meta elements."""
    pattern = r"(?i)charset\s*=\s*[\"']?([A-Za-z0-9_.:-]+)"
    return F.lower(F.coalesce(F.nullif(F.regexp_extract(header, pattern, 1), F.lit("")), F.regexp_extract(html, r"(?i)<meta[^>]*charset\s*=\s*[\"']?([A-Za-z0-9_.:-]+)", 1)))
