"""Container files: a header with schema and codec, then blocks of rows, each closed by the file's sync marker.

Files are reached through Arrow's file systems, so a path may be local or a URI that they know.
A file is split by byte ranges: a block belongs to the range in which the marker before it begins.
"""

from __future__ import annotations

import bz2
import fnmatch
import io
import lzma
import os
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow.fs as pafs

from quillrow import wire
from quillrow.errors import ContainerError
from quillrow.schema import BYTES, Field, Map, Record, Schema, parse, render

# Fixed values of the format.
MAGIC = b"Obj\x01"
SCHEMA_KEY, CODEC_KEY = "avro.schema", "avro.codec"
SYNC_SIZE = 16
SUFFIX = ".avro"
#: Level of the zstandard codec when writing.
ZSTD_LEVEL = 3


def _zstd_compress(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=ZSTD_LEVEL).compress(data)


def _zstd_decompress(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompressobj().decompress(data)


def _deflate(data: bytes) -> bytes:
    c = zlib.compressobj(zlib.Z_DEFAULT_COMPRESSION, zlib.DEFLATED, -15)
    return c.compress(data) + c.flush()


_COMPRESS: dict[str, Callable[[bytes], bytes]] = {
    "null": bytes,
    "deflate": _deflate,
    "bzip2": bz2.compress,
    "xz": lambda data: lzma.compress(data, format=lzma.FORMAT_XZ),
    "zstandard": _zstd_compress,
}
_DECOMPRESS: dict[str, Callable[[bytes], bytes]] = {
    "null": bytes,
    "deflate": lambda data: zlib.decompress(data, -15),
    "bzip2": bz2.decompress,
    "xz": lzma.decompress,
    "zstandard": _zstd_decompress,
}
#: Other names that are understood.
_ALIASES = {"zstd": "zstandard", "none": "null", "uncompressed": "null", "": "null"}


def codec_name(name: str | None) -> str:
    """The format's name of a codec. Unknown ones raise, on reading as on writing."""
    found = (name or "null").lower()
    found = _ALIASES.get(found, found)
    if found not in _COMPRESS:
        raise ContainerError(f"codec {name!r} is not supported; there are {', '.join(_COMPRESS)}")
    return found


def compress(codec: str, data: bytes) -> bytes:
    return _COMPRESS[codec_name(codec)](data)


def decompress(codec: str, data: bytes) -> bytes:
    try:
        return _DECOMPRESS[codec_name(codec)](data)
    except ContainerError:
        raise
    except Exception as error:
        raise ContainerError(f"a block cannot be decompressed: {error}") from None


@dataclass(frozen=True)
class Header:
    schema_json: str
    codec: str
    sync: bytes
    #: Position of the first block.
    size: int

    @property
    def schema(self) -> Schema:
        return parse(self.schema_json)

    @property
    def record(self) -> Record:
        """The rows' schema; a file of values that are no records has a field named value."""
        found = self.schema
        return found if isinstance(found, Record) else Record("row", (Field("value", found),))


_META = Map(BYTES)
_read_meta, _write_meta = wire.decoder(_META), wire.encoder(_META)


def header_bytes(schema: Schema, codec: str, sync: bytes) -> bytes:
    meta = [(SCHEMA_KEY, render(schema).encode())]
    if codec_name(codec) != "null":
        meta.append((CODEC_KEY, codec_name(codec).encode()))
    return MAGIC + _write_meta(meta) + sync


def read_header(file) -> Header:
    """Of a seekable binary file. The magic and the presence of a schema are checked."""
    file.seek(0)
    data, want = b"", 1 << 14
    while True:
        more = file.read(want)
        data += more
        if data[:4] != MAGIC:
            raise ContainerError("no container: the first bytes are not its mark")
        try:
            pairs, pos = _read_meta(data, 4, len(data))
            if pos + SYNC_SIZE > len(data):
                raise ValueError("unexpected end of data")
            break
        except ValueError as error:
            if not more:
                raise ContainerError(f"the header is damaged: {error}") from None
            want *= 2
    meta = dict(pairs)
    if SCHEMA_KEY not in meta:
        raise ContainerError("the header has no schema")
    return Header(meta[SCHEMA_KEY].decode(), codec_name(meta.get(CODEC_KEY, b"null").decode()), data[pos : pos + SYNC_SIZE], pos + SYNC_SIZE)


@dataclass(frozen=True)
class Block:
    """offset: where the block begins; rows it holds; size: bytes of its data as stored; data: None if only headers are read."""

    offset: int
    rows: int
    size: int
    data: bytes | None


def _find(file, needle: bytes, start: int, end: int) -> int:
    """Position of needle at or after start, beginning before end; -1 if there is none."""
    step, at, kept = 1 << 20, start, b""
    file.seek(start)
    while at - len(kept) < end:
        piece = file.read(step)
        if not piece:
            return -1
        window = kept + piece
        found = window.find(needle)
        if found >= 0:
            found += at - len(kept)
            return found if found < end else -1
        kept = window[-(len(needle) - 1) :]
        at += len(piece)
    return -1


def blocks(file, header: Header, start: int = 0, end: int | None = None, with_data: bool = True) -> Iterator[Block]:
    """The blocks of the byte range [start, end). Each block's marker is checked."""
    file.seek(0, os.SEEK_END)
    total = file.tell()
    end = total if end is None else end
    mark = header.size - SYNC_SIZE if start <= header.size - SYNC_SIZE else _find(file, header.sync, start, end)
    if mark < 0:
        return
    pos = mark + SYNC_SIZE
    while pos < total and pos - SYNC_SIZE < end:
        file.seek(pos)
        head = file.read(20)
        try:
            rows, at = wire._number(head, 0, len(head))
            size, at = wire._number(head, at, len(head))
        except ValueError as error:
            raise ContainerError(f"the block at {pos} is damaged: {error}") from None
        rows, size = wire.unzigzag(rows), wire.unzigzag(size)
        if rows < 0 or size < 0 or pos + at + size + SYNC_SIZE > total:
            raise ContainerError(f"the block at {pos} is damaged or cut off")
        file.seek(pos + at)
        data = file.read(size) if with_data else None
        file.seek(pos + at + size)
        if file.read(SYNC_SIZE) != header.sync:
            raise ContainerError(f"the block at {pos} is not followed by the sync marker")
        yield Block(pos, rows, size, data)
        pos += at + size + SYNC_SIZE


class Writer:
    """Writes one container to a binary file."""

    def __init__(self, file, record: Schema, codec: str = "null", block_bytes: int = 1 << 18, sync: bytes | None = None):
        self.file, self.codec, self.block_bytes = file, codec_name(codec), block_bytes
        self.sync = sync or os.urandom(SYNC_SIZE)
        self.pending: list[bytes] = []
        #: Bytes held; rows and blocks written; rows pending beyond one for each piece.
        self.held = self.rows = self.blocks = self.more = 0
        file.write(header_bytes(record, self.codec, self.sync))

    def add(self, rows: list[bytes]) -> None:
        for row in rows:
            self.pending.append(row)
            self.held += len(row)
            if self.held >= self.block_bytes:
                self.end_block()

    def add_encoded(self, data: memoryview, ends: np.ndarray) -> None:
        """Rows that stand behind one another. A block ends with the row that fills it, as with ``add``."""
        row = begin = 0
        while row < len(ends):
            fills = int(np.searchsorted(ends, begin + self.block_bytes - self.held))
            to = min(fills + 1, len(ends))
            end = int(ends[to - 1])
            self.pending.append(bytes(data[begin:end]))
            self.more += to - row - 1
            self.held += end - begin
            row, begin = to, end
            if self.held >= self.block_bytes:
                self.end_block()

    def end_block(self) -> None:
        if not self.pending:
            return
        data, rows = compress(self.codec, b"".join(self.pending)), len(self.pending) + self.more
        self.file.write(wire.varint(2 * rows) + wire.varint(2 * len(data)) + data + self.sync)
        self.rows += rows
        self.blocks += 1
        self.pending, self.held, self.more = [], 0, 0


def write_bytes(record: Schema, rows: list, codec: str = "null", block_bytes: int = 1 << 18) -> bytes:
    """A container in memory, of host values."""
    out, encode = io.BytesIO(), wire.encoder(record)
    writer = Writer(out, record, codec, block_bytes)
    writer.add([encode(wire.host_value(record, x)) for x in rows])
    writer.end_block()
    return out.getvalue()


def read_bytes(data: bytes) -> tuple[Record, list[dict]]:
    """Schema and rows, as physical values, of a container in memory."""
    file = io.BytesIO(data)
    header = read_header(file)
    record = header.record
    read, names, out = wire.columns_decoder(record, [f.name for f in record.fields]), [f.name for f in record.fields], []
    for b in blocks(file, header):
        plain = decompress(header.codec, b.data)
        columns, _ = read(plain, 0, len(plain), b.rows)
        out += [dict(zip(names, row, strict=True)) for row in zip(*columns, strict=True)] if names else [{}] * b.rows
    return record, out


# -- paths --------------------------------------------------------------------------------------


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    """Arrow's file system of a path or URI, and the path in it."""
    if "://" not in path and not path.startswith("file:"):
        return pafs.LocalFileSystem(), os.path.abspath(path)
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return pafs.FileSystem.from_uri(path)


def list_files(path: str) -> list[tuple[str, int]]:
    """(path, size) of the data files at a path: a file, a folder (also nested), or a pattern in the last part."""
    fs, root = filesystem(path)
    folder, _, last = root.rpartition("/")
    if any(c in last for c in "*?["):
        found = fs.get_file_info(pafs.FileSelector(folder))
        files = [f for f in found if f.type == pafs.FileType.File and fnmatch.fnmatch(f.base_name, last)]
    else:
        info = fs.get_file_info(root)
        if info.type == pafs.FileType.NotFound:
            raise ContainerError(f"there is no {path}")
        files = [info] if info.type == pafs.FileType.File else [f for f in fs.get_file_info(pafs.FileSelector(root, recursive=True)) if f.type == pafs.FileType.File]
    hidden = lambda p: any(part.startswith(("_", ".")) for part in p.removeprefix(root).split("/"))
    return sorted((f.path, f.size) for f in files if f.size and not hidden(f.path))


