"""Image files: walks a file's own structure to see whether it is whole, and how large the image is. Pixels are not kept."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Pixels of an image at most, by default: images beyond that are refused before anything is unpacked.
MAX_PIXELS = 178_956_970
#: The endings that files of a format have.
ENDINGS = {
    "png": ("png", "apng"),
    "jpeg": ("jpg", "jpeg", "jpe", "jfif"),
    "gif": ("gif",),
    "bmp": ("bmp", "dib"),
    "webp": ("webp",),
}
#: Fixed values of PNG: channels of a colour type, and the bit depths that it may have.
_PNG_COLOURS = {0: (1, (1, 2, 4, 8, 16)), 2: (3, (8, 16)), 3: (1, (1, 2, 4, 8)), 4: (2, (8, 16)), 6: (4, (8, 16))}
#: Fixed values of PNG: first column, first row and their steps in the seven passes of an interlaced image.
_PNG_PASSES = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2))


class Broken(ValueError):
    """The file is not what its first bytes say."""


def _take(data: bytes, at: int, size: int) -> bytes:
    if at + size > len(data):
        raise Broken("the file ends early")
    return data[at : at + size]


def _checked_size(width: int, height: int, most: int) -> tuple[int, int]:
    if width <= 0 or height <= 0:
        raise Broken("the image has no size")
    if width * height > most:
        raise Broken(f"the image has more than {most} pixels")
    return width, height


def _png(data: bytes, most: int) -> tuple[int, int]:
    at, size, seen = 8, None, []
    unpack, unpacked, expected = zlib.decompressobj(), 0, 0
    while True:
        length, kind = struct.unpack(">I4s", _take(data, at, 8))
        body = _take(data, at + 8, length)
        (told,) = struct.unpack(">I", _take(data, at + 8 + length, 4))
        if zlib.crc32(body, zlib.crc32(kind)) != told:
            raise Broken(f"the checksum of {kind.decode('latin-1')} is wrong")
        if size is None:
            if kind != b"IHDR" or length != 13:
                raise Broken("the header is not first")
            width, height, depth, colour, packing, filters, interlaced = struct.unpack(">IIBBBBB", body)
            size = _checked_size(width, height, most)
            if colour not in _PNG_COLOURS or depth not in _PNG_COLOURS[colour][1] or packing or filters or interlaced > 1:
                raise Broken("the header is wrong")
            line = lambda w: (w * depth * _PNG_COLOURS[colour][0] + 7) // 8 + 1
            passes = [(-(-(width - x) // dx), -(-(height - y) // dy)) for x, y, dx, dy in (_PNG_PASSES if interlaced else ((0, 0, 1, 1),))]
            expected = sum(line(w) * h for w, h in passes if w > 0 and h > 0)
        elif kind == b"IHDR":
            raise Broken("there are two headers")
        elif kind == b"IDAT":
            if b"IDAT" in seen and seen[-1] != b"IDAT":
                raise Broken("the image data is interrupted")
            if colour == 3 and b"PLTE" not in seen:
                raise Broken("the palette is missing")
            rest = body
            while rest and unpacked < expected and not unpack.eof:
                try:
                    unpacked += len(unpack.decompress(rest, 1 << 16))
                except zlib.error:
                    raise Broken("the image data does not unpack") from None
                rest = unpack.unconsumed_tail
        seen.append(kind)
        at += 12 + length
        if kind == b"IEND":
            break
    if b"IDAT" not in seen or unpacked < expected:
        raise Broken("image data is missing")
    return size


def _jpeg(data: bytes, most: int) -> tuple[int, int]:
    at, size, scans = 2, None, 0
    while True:
        if _take(data, at, 1) != b"\xff":
            raise Broken("a segment does not begin with a marker")
        while _take(data, at, 1) == b"\xff":
            at += 1
        marker = data[at]
        at += 1
        if marker == 0xD9:
            break
        if marker == 0x01 or 0xD0 <= marker <= 0xD8:
            continue
        (length,) = struct.unpack(">H", _take(data, at, 2))
        body = _take(data, at, length)
        if length < 2:
            raise Broken("a segment has no length")
        if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            if length < 8:
                raise Broken("the frame header is short")
            _, height, width, parts = struct.unpack(">BHHB", body[2:8])
            if length != 8 + 3 * parts or not parts:
                raise Broken("the frame header is wrong")
            size = _checked_size(width, height, most)
        at += length
        if marker == 0xDA:
            if size is None:
                raise Broken("a scan comes before the frame header")
            scans += 1
            # Coded data runs up to the next marker; a byte FF inside it is followed by 00, and restart marks belong to it.
            while True:
                at = data.find(b"\xff", at)
                if at < 0 or at + 1 >= len(data):
                    raise Broken("the file ends early")
                if data[at + 1] not in (0, 0xFF, *range(0xD0, 0xD8)):
                    break
                at += 1 if data[at + 1] == 0xFF else 2
    if not scans:
        raise Broken("image data is missing")
    return size


def _gif(data: bytes, most: int) -> tuple[int, int]:
    if data[3:6] not in (b"87a", b"89a"):
        raise Broken("the version is not known")
    width, height, flags = struct.unpack("<HHB", _take(data, 6, 5))
    size = _checked_size(width, height, most)
    at, images = 13 + (3 << ((flags & 7) + 1) if flags & 0x80 else 0), 0
    _take(data, 0, at)

    def blocks(at: int) -> int:
        while n := _take(data, at, 1)[0]:
            _take(data, at + 1, n)
            at += 1 + n
        return at + 1

    while (kind := _take(data, at, 1)) != b";":
        if kind == b"!":
            at = blocks(at + 2)
        elif kind == b",":
            _, _, w, h, flags = struct.unpack("<HHHHB", _take(data, at + 1, 9))
            _checked_size(w, h, most)
            at += 10 + (3 << ((flags & 7) + 1) if flags & 0x80 else 0)
            if not 2 <= _take(data, at, 1)[0] <= 8 or not _take(data, at + 1, 1)[0]:
                raise Broken("image data is missing")
            at, images = blocks(at + 1), images + 1
        else:
            raise Broken("a block is of no known kind")
    if not images:
        raise Broken("image data is missing")
    return size


def _bmp(data: bytes, most: int) -> tuple[int, int]:
    start, head = struct.unpack("<II", _take(data, 10, 8))
    if head == 12:
        width, height, planes, bits = struct.unpack("<HHHH", _take(data, 18, 8))
        packing = 0
    elif head >= 40:
        width, height, planes, bits, packing = struct.unpack("<iiHHI", _take(data, 18, 16))
    else:
        raise Broken("the header is wrong")
    size = _checked_size(width, abs(height), most)
    if planes != 1 or bits not in (1, 4, 8, 16, 24, 32):
        raise Broken("the header is wrong")
    if packing in (0, 3):
        _take(data, start, ((width * bits + 31) // 32) * 4 * abs(height))
    else:
        _take(data, start, 1)
    return size


def _webp(data: bytes, most: int) -> tuple[int, int]:
    (length,) = struct.unpack("<I", _take(data, 4, 4))
    _take(data, 8, length)
    at, end, size, images = 12, 8 + length, None, 0
    while at + 8 <= end:
        kind, n = struct.unpack("<4sI", _take(data, at, 8))
        body = _take(data, at + 8, n)
        if kind == b"VP8X" and n >= 10:
            size = size or tuple(1 + int.from_bytes(body[k : k + 3], "little") for k in (4, 7))
        elif kind == b"VP8L" and n >= 5 and body[0] == 0x2F:
            bits, images = int.from_bytes(body[1:5], "little"), images + 1
            size = size or (1 + (bits & 0x3FFF), 1 + (bits >> 14 & 0x3FFF))
        elif kind == b"VP8 " and n >= 10 and body[3:6] == b"\x9d\x01\x2a":
            w, h = struct.unpack("<HH", body[6:10])
            size, images = size or (w & 0x3FFF, h & 0x3FFF), images + 1
        elif kind == b"ANMF":
            images += 1
        at += 8 + n + n % 2
    if size is None or not images:
        raise Broken("image data is missing")
    return _checked_size(*size, most)


def _kind(data: bytes) -> tuple[str, Callable[[bytes, int], tuple[int, int]]] | None:
    if data[:8] == b"\x89PNG\r\n\x1a\n":
        return "png", _png
    if data[:3] == b"\xff\xd8\xff":
        return "jpeg", _jpeg
    if data[:3] == b"GIF":
        return "gif", _gif
    if data[:2] == b"BM":
        return "bmp", _bmp
    if data[:4] == b"RIFF" and data[8:12] == b"WEBP":
        return "webp", _webp
    return None


def inspect(data: bytes | None, name: str | None = None, max_pixels: int = MAX_PIXELS, max_bytes: int | None = None) -> dict:
    """``format``, ``width``, ``height`` and ``problem``, which is None for an image that is whole.

    PNG: every chunk and its checksum, one header, and image data that unpacks to all of its lines. JPEG: all segments, the frame
    header, the coded data up to the end mark. GIF: all blocks up to the trailer, with an image. BMP and WebP: the
    headers, and all the data that they announce. What follows the end is ignored. With a ``name``, its ending must be one of an image.
    """
    found = {"format": None, "width": None, "height": None, "problem": None}
    if not data:
        return found | {"problem": "the file is empty"}
    if name is not None and name.rpartition(".")[2].lower() not in {e for es in ENDINGS.values() for e in es}:
        return found | {"problem": "the name is not that of an image"}
    if max_bytes is not None and len(data) > max_bytes:
        return found | {"problem": f"the file has more than {max_bytes} bytes"}
    if (kind := _kind(data)) is None:
        return found | {"problem": "the file is no image of a known format"}
    found["format"] = kind[0]
    try:
        found["width"], found["height"] = kind[1](data, max_pixels)
    except Broken as e:
        found["problem"] = str(e)
    return found


IMAGE = T.StructType([T.StructField("format", T.StringType()), T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType()), T.StructField("problem", T.StringType())])


def decoded(files: DataFrame, content: str = "content", name: str | None = None, max_pixels: int = MAX_PIXELS, max_bytes: int | None = None, out: str = "image") -> DataFrame:
    """Adds struct<format, width, height, problem> of every file; see ``inspect``. One file at a time is read; no shuffle.

    Null and empty content is a problem of its own. A column of the added name is replaced; all others pass as they are.
    """
    files = files.drop(out)
    at, named = files.columns.index(content), files.columns.index(name) if name else None
    kind = pa.struct([("format", pa.string()), ("width", pa.int32()), ("height", pa.int32()), ("problem", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column(named).to_pylist() if named is not None else [None] * batch.num_rows
            found = [inspect(data.as_py(), (n or "") if named is not None else None, max_pixels, max_bytes) for data, n in zip(batch.column(at), names)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, kind)], names=[*batch.schema.names, out])

    return files.mapInArrow(run, T.StructType([*files.schema.fields, T.StructField(out, IMAGE)]))
