"""Image files as arrays (height, width, bands) of uint8 or uint16: TIFF, PNG and BMP in numpy.

Files are read and written by strips of lines, so that no more than a strip need be held decoded.
"""

from __future__ import annotations

import itertools
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np

#: lines of a written strip, where they are not too wide
STRIP = 64
#: most bytes of a written strip of several lines
STRIP_BYTES = 4 << 20


class FormatError(ValueError):
    """The file is of a kind that is not supported."""


def _kind(data: bytes | memoryview) -> str:
    if bytes(data[:4]) in (b"II*\0", b"MM\0*"):
        return "tiff"
    if bytes(data[:8]) == b"\x89PNG\r\n\x1a\n":
        return "png"
    if bytes(data[:2]) == b"BM":
        return "bmp"
    raise FormatError("not a TIFF, PNG or BMP file")


def shape(data: bytes | memoryview) -> tuple[tuple[int, int, int], np.dtype]:
    """Height, width and bands, and the kind of samples, from the file's head alone."""
    head = _READERS[_kind(data)][0](data)
    return (head["height"], head["width"], head["bands"]), np.dtype(head["dtype"])


def lines(data: bytes | memoryview, first: int = 0, last: int | None = None, most: int = STRIP) -> Iterator[np.ndarray]:
    """The lines from ``first`` up to ``last`` in order, at most ``most`` of them at a time."""
    find, read = _READERS[_kind(data)]
    head = find(data)
    last = head["height"] if last is None else min(last, head["height"])
    if first < last:
        for part in read(data, head, first, last):
            for y in range(0, len(part), most):
                yield part[y : y + most]


def decode(data: bytes | memoryview) -> np.ndarray:
    size, dtype = shape(data)
    out, y = np.empty(size, dtype), 0
    for part in lines(data):
        out[y : y + len(part)] = part
        y += len(part)
    return out


def strip_lines(width: int, bands: int, size: int = 1) -> int:
    """How many lines a written strip has."""
    return max(1, min(STRIP, STRIP_BYTES // max(1, width * bands * size)))


def encode(image: np.ndarray, kind: str) -> bytes:
    kind = "tiff" if kind == "tif" else kind
    image = np.ascontiguousarray(image if image.ndim == 3 else image[:, :, None])
    each = strip_lines(*image.shape[1:], image.dtype.itemsize)
    starts = range(0, len(image), each)
    strips = [encode_strip(image[y : y + each], kind, y + each >= len(image)) for y in starts]
    order = strip_order(kind, len(strips))
    frame = Frame(kind, *image.shape, image.dtype, each, {i: s[1:] for i, s in enumerate(strips)})
    return b"".join([frame.head(), *(strips[i][0] for i in order), frame.tail()])


def strip_order(kind: str, strips: int) -> range:
    """The strips as they follow each other in the file."""
    return range(strips - 1, -1, -1) if kind == "bmp" else range(strips)


def encode_strip(image: np.ndarray, kind: str, end: bool) -> tuple[bytes, int, int]:
    """The file's bytes for some lines, how many they are, and what else their frame has to know; ``end`` for the last lines."""
    if kind not in _WRITERS:
        raise FormatError(f"no writer for {kind}")
    return _WRITERS[kind](image, end)


class Frame:
    """What stands before and behind the strips of one file.

    ``known`` are length and check of each strip.
    """

    def __init__(self, kind: str, height: int, width: int, bands: int, dtype: np.dtype, each: int, known: dict[int, tuple[int, int]]):
        self.kind, self.height, self.width, self.bands, self.dtype, self.each, self.known = kind, height, width, bands, np.dtype(dtype), each, known

    def head(self) -> bytes:
        return _FRAMES[self.kind][0](self)

    def tail(self) -> bytes:
        return _FRAMES[self.kind][1](self)


# ---------------------------------------------------------------- TIFF


def _packbits(data: bytes) -> bytes:
    out, i = bytearray(), 0
    while i < len(data):
        n = data[i]
        if n < 128:
            out += data[i + 1 : i + 2 + n]
            i += 2 + n
        elif n > 128:
            out += data[i + 1 : i + 2] * (257 - n)
            i += 2
        else:
            i += 1
    return bytes(out)


def _lzw(data: bytes) -> bytes:
    """TIFF's LZW: codes of 9 to 12 bits, most significant bit first, 256 clears and 257 ends."""
    out = bytearray()
    table: list[bytes] = []
    width, held, bits, last = 9, 0, 0, b""
    for byte in data:
        held, bits = held << 8 | byte, bits + 8
        while bits >= width:
            bits -= width
            code = held >> bits
            held &= (1 << bits) - 1
            if code == 257:
                return bytes(out)
            if code == 256:
                table, width, last = [bytes([i]) for i in range(256)] + [b"", b""], 9, b""
                continue
            entry = table[code] if code < len(table) else last + last[:1]
            out += entry
            if last:
                table.append(last + entry[:1])
            last = entry
            width = 9 if len(table) < 511 else 10 if len(table) < 1023 else 11 if len(table) < 2047 else 12
    return bytes(out)


_UNPACK = {1: bytes, 8: zlib.decompress, 32946: zlib.decompress, 32773: _packbits, 5: _lzw}


def _tiff_head(data: bytes | memoryview) -> dict:
    order = "<" if bytes(data[:2]) == b"II" else ">"
    at = struct.unpack_from(order + "I", data, 4)[0]
    kinds = {1: "B", 2: "B", 3: "H", 4: "I", 16: "Q"}
    tags: dict[int, tuple] = {}
    for k in range(struct.unpack_from(order + "H", data, at)[0]):
        tag, kind, n = struct.unpack_from(order + "HHI", data, at + 2 + 12 * k)
        if kind not in kinds:
            continue
        form = f"{order}{n}{kinds[kind]}"
        where = at + 10 + 12 * k
        if struct.calcsize(form) > 4:
            where = struct.unpack_from(order + "I", data, where)[0]
        tags[tag] = struct.unpack_from(form, data, where)
    one = lambda tag, default: tags.get(tag, (default,))[0]
    depth = set(tags.get(258, (1,)))
    if depth not in ({8}, {16}) or one(339, 1) != 1 or 322 in tags:
        raise FormatError("only TIFF strips of unsigned 8 or 16 bit samples are supported")
    if one(259, 1) not in _UNPACK:
        raise FormatError(f"TIFF compression {one(259, 1)} is not supported")
    stored = np.dtype(np.uint8 if depth == {8} else order + "u2")
    return {"height": one(257, 0), "width": one(256, 0), "bands": one(277, 1), "dtype": stored.newbyteorder("="), "tags": tags, "stored": stored}


def _tiff_lines(data: bytes | memoryview, head: dict, first: int, last: int) -> Iterator[np.ndarray]:
    tags, height, width, bands, dtype = (head[k] for k in ("tags", "height", "width", "bands", "dtype"))
    one = lambda tag, default: tags.get(tag, (default,))[0]
    planes, inner = (bands, 1) if one(284, 1) == 2 else (1, bands)
    each = min(one(278, height), height)
    count = -(-height // each) if each else 0
    unpack, places = _UNPACK[one(259, 1)], list(zip(tags[273], tags[279], strict=True))

    def strip(k: int) -> np.ndarray:
        a, n = places[k]
        flat = np.frombuffer(unpack(bytes(data[a : a + n])), head["stored"])
        if one(317, 1) == 2:
            return np.cumsum(flat[: len(flat) // (width * inner) * width * inner].reshape(-1, width, inner), axis=1, dtype=dtype).reshape(-1)
        return flat

    if count * planes != len(places):  # no lines for each strip are told, or wrong ones: all strips in a row
        flat = np.concatenate([strip(k) for k in range(len(places))])[: planes * height * width * inner].astype(dtype)
        shaped = flat.reshape(planes, height, width, inner)
        yield (np.moveaxis(shaped[..., 0], 0, -1) if planes > 1 else shaped[0])[first:last]
        return
    for k in range(first // each, -(-last // each)):
        n = min(each, height - k * each)
        parts = [strip(p * count + k)[: n * width * inner].astype(dtype).reshape(n, width, inner) for p in range(planes)]
        part = np.concatenate(parts, axis=2) if planes > 1 else parts[0]
        yield part[max(0, first - k * each) : last - k * each]


def _tiff_strip(image: np.ndarray, end: bool) -> tuple[bytes, int, int]:
    packed = zlib.compress(image.astype(image.dtype.newbyteorder("<")).tobytes(), 6)
    return packed, len(packed), 0


def _tiff_frame(frame: Frame) -> tuple[int, bytes]:
    """Where the directory begins, and what stands behind the strips; three or four bands of 8 bits count as RGB."""
    lengths = [frame.known[i][0] for i in range(len(frame.known))]
    offsets, head, extra = [], 8, b""
    for n in lengths:
        offsets.append(head)
        head += n

    def entry(tag: int, kind: str, values: list[int]) -> bytes:
        nonlocal extra
        packed = struct.pack(f"<{len(values)}{kind}", *values)
        if len(packed) > 4:
            place, extra = head + len(extra), extra + packed + b"\0" * (len(packed) % 2)
            packed = struct.pack("<I", place)
        return struct.pack("<HHI", tag, {"H": 3, "I": 4}[kind], len(values)) + packed.ljust(4, b"\0")

    bands = frame.bands
    entries = [
        entry(256, "I", [frame.width]), entry(257, "I", [frame.height]), entry(258, "H", [frame.dtype.itemsize * 8] * bands), entry(259, "H", [8]), entry(262, "H", [2 if bands in (3, 4) else 1]),
        entry(273, "I", offsets), entry(277, "H", [bands]), entry(278, "I", [frame.each]), entry(279, "I", lengths), entry(284, "H", [1]),
    ]
    more = bands - (3 if bands in (3, 4) else 1)
    if more > 0:
        entries.append(entry(338, "H", [0] * more))
    return head + len(extra), extra + struct.pack("<H", len(entries)) + b"".join(entries) + b"\0\0\0\0"


def _tiff_start(frame: Frame) -> bytes:
    return b"II*\0" + struct.pack("<I", _tiff_frame(frame)[0])


def _tiff_end(frame: Frame) -> bytes:
    return _tiff_frame(frame)[1]


# ---------------------------------------------------------------- PNG


def _png_head(data: bytes | memoryview) -> dict:
    at, parts, palette = 8, [], None
    while at < len(data):
        n, kind = struct.unpack_from(">I4s", data, at)
        if kind == b"IHDR":
            width, height, depth, colour, _, _, interlace = struct.unpack_from(">IIBBBBB", data, at + 8)
        elif kind == b"PLTE":
            palette = np.frombuffer(data, np.uint8, n, at + 8).reshape(-1, 3)
        elif kind == b"IDAT":
            parts.append((at + 8, n))
        at += 12 + n
    if depth not in (8, 16) or interlace:
        raise FormatError("only PNG files of 8 or 16 bits without interlacing are supported")
    stored = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[colour]
    return {"height": height, "width": width, "bands": 3 if colour == 3 else stored, "dtype": np.uint8 if depth == 8 else np.uint16, "stored": stored, "depth": depth, "palette": palette if colour == 3 else None, "parts": parts}


def _png_raw(data: bytes | memoryview, head: dict, line: int, last: int) -> Iterator[np.ndarray]:
    """Filtered lines up to ``last``, some at a time: the stream is unpacked from its beginning, but never held whole."""
    stream, held, left = zlib.decompressobj(), bytearray(), last
    want = strip_lines(line, 1) * line
    pieces = (bytes(data[a : min(a + (1 << 16), at + n)]) for at, n in head["parts"] for a in range(at, at + n, 1 << 16))
    for piece in itertools.chain(pieces, [b""]):  # the last one for what the stream still holds back
        more = True
        while more and not stream.eof:
            held += stream.decompress(piece, want)
            piece = stream.unconsumed_tail
            more = bool(piece)
            count = min(left, len(held) // line)
            if count:
                yield np.frombuffer(bytes(held[: count * line]), np.uint8).reshape(count, line)
                del held[: count * line]
                left -= count
            if not left and last < head["height"]:
                return
    if left or not stream.eof:
        raise FormatError("the PNG file ends early")


def _png_lines(data: bytes | memoryview, head: dict, first: int, last: int) -> Iterator[np.ndarray]:
    width, depth, bands = head["width"], head["depth"], head["stored"]
    step, line = bands * depth // 8, width * bands * depth // 8
    above, done = np.zeros(line, np.uint8), 0
    for raw in _png_raw(data, head, line + 1, last):
        out = np.zeros((len(raw), line), np.uint8)
        for y in range(len(raw)):
            kind, row = raw[y, 0], raw[y, 1:].copy()
            if kind == 1:
                row = np.cumsum(row.reshape(-1, step), axis=0, dtype=np.uint8).reshape(-1)
            elif kind == 2:
                row += above
            elif kind in (3, 4):
                # each pixel hangs on the one before: a walk along the line, all of a pixel's bytes at once
                cells, up = row.reshape(-1, step).astype(np.int32), above.reshape(-1, step).astype(np.int32)
                left = corner = np.zeros(step, np.int32)
                for x in range(len(cells)):
                    if kind == 3:
                        guess = (left + up[x]) // 2
                    else:
                        p = left + up[x] - corner
                        a, b, c = abs(p - left), abs(p - up[x]), abs(p - corner)
                        guess = np.where((a <= b) & (a <= c), left, np.where(b <= c, up[x], corner))
                    corner = up[x]
                    left = cells[x] = (cells[x] + guess) & 255
                row = cells.astype(np.uint8).reshape(-1)
            out[y] = above = row
        part = out[max(0, first - done) :]
        done += len(out)
        if len(part):
            image = part.reshape(-1, width, bands) if depth == 8 else part.view(">u2").astype(np.uint16).reshape(-1, width, bands)
            yield image if head["palette"] is None else head["palette"][image[:, :, 0]]


def _png_chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def _png_strip(image: np.ndarray, end: bool) -> tuple[bytes, int, int]:
    """A chunk of its own, whose part of the deflated stream refers to nothing before it."""
    lines = image.astype(image.dtype.newbyteorder(">")).reshape(len(image), -1).view(np.uint8)
    raw = np.concatenate([np.zeros((len(image), 1), np.uint8), lines], axis=1).tobytes()
    packer = zlib.compressobj(6, zlib.DEFLATED, -15)
    chunk = _png_chunk(b"IDAT", packer.compress(raw) + packer.flush(zlib.Z_FINISH if end else zlib.Z_FULL_FLUSH))
    return chunk, len(chunk), zlib.adler32(raw)


def _adler(sums: Iterable[tuple[int, int]]) -> int:
    """Adler-32 of joined texts from each one's own and its length."""
    low, high = 1, 0
    for check, n in sums:
        high = (high + (check >> 16) + n * (low - 1)) % 65521
        low = (low + (check & 65535) - 1) % 65521
    return high << 16 | low


def _png_start(frame: Frame) -> bytes:
    if frame.bands > 4:
        raise FormatError("PNG holds at most four bands")
    head = struct.pack(">IIBBBBB", frame.width, frame.height, frame.dtype.itemsize * 8, {1: 0, 2: 4, 3: 2, 4: 6}[frame.bands], 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + _png_chunk(b"IHDR", head) + _png_chunk(b"IDAT", b"\x78\x9c")


def _png_end(frame: Frame) -> bytes:
    line = 1 + frame.width * frame.bands * frame.dtype.itemsize
    check = _adler((frame.known[i][1], min(frame.each, frame.height - i * frame.each) * line) for i in range(len(frame.known)))
    return _png_chunk(b"IDAT", struct.pack(">I", check)) + _png_chunk(b"IEND", b"")


# ---------------------------------------------------------------- BMP


def _bmp_head(data: bytes | memoryview) -> dict:
    start, size, width, height, _, depth, packing = struct.unpack_from("<IIiiHHI", data, 10)
    if depth not in (8, 24, 32) or packing not in (0, 3):
        raise FormatError("only BMP files of 8, 24 or 32 bits without compression are supported")
    palette = np.frombuffer(data, np.uint8, 1024, 14 + size).reshape(256, 4)[:, 2::-1] if depth == 8 and start >= 14 + size + 1024 else None
    return {"height": abs(height), "width": width, "bands": 3 if depth > 8 or palette is not None else 1, "dtype": np.uint8, "start": start, "depth": depth, "palette": palette, "upward": height >= 0}


def _bmp_lines(data: bytes | memoryview, head: dict, first: int, last: int) -> Iterator[np.ndarray]:
    width, size, palette = head["width"], head["depth"] // 8, head["palette"]
    line = (width * size + 3) // 4 * 4
    each = strip_lines(width, size)
    for y in range(first, last, each):
        n = min(each, last - y)
        at = head["height"] - y - n if head["upward"] else y
        rows = np.frombuffer(data, np.uint8, line * n, head["start"] + at * line).reshape(n, line)[:, : width * size].reshape(n, width, size)
        rows = rows[::-1] if head["upward"] else rows
        if size > 1:
            rows = rows[:, :, 2::-1]
        elif palette is not None:
            rows = palette[rows[:, :, 0]]
        yield np.ascontiguousarray(rows)


def _bmp_strip(image: np.ndarray, end: bool) -> tuple[bytes, int, int]:
    height, _, bands = image.shape
    if image.dtype != np.uint8 or bands not in (1, 3):
        raise FormatError("BMP holds one or three bands of 8 bits")
    rgb = np.repeat(image, 3, axis=2) if bands == 1 else image
    rows = rgb[::-1, :, ::-1].reshape(height, -1)
    packed = np.pad(rows, ((0, 0), (0, -rows.shape[1] % 4))).tobytes()
    return packed, len(packed), 0


def _bmp_start(frame: Frame) -> bytes:
    size = frame.height * ((frame.width * 3 + 3) // 4 * 4)
    return struct.pack("<2sIHHIIiiHHIIiiII", b"BM", 54 + size, 0, 0, 54, 40, frame.width, frame.height, 1, 24, 0, size, 2835, 2835, 0, 0)


def _bmp_end(frame: Frame) -> bytes:
    return b""


_READERS = {"tiff": (_tiff_head, _tiff_lines), "png": (_png_head, _png_lines), "bmp": (_bmp_head, _bmp_lines)}
_WRITERS = {"tiff": _tiff_strip, "png": _png_strip, "bmp": _bmp_strip}
_FRAMES = {"tiff": (_tiff_start, _tiff_end), "png": (_png_start, _png_end), "bmp": (_bmp_start, _bmp_end)}
