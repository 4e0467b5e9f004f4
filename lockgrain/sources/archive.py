"""Package archives: integrity checks in the JVM, and a bounded reader that never writes to disk."""

from __future__ import annotations

import io
import tarfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Most entries, bytes when expanded, expansion ratio, and bytes of a header's extension.
MAX_ENTRIES, MAX_BYTES, MAX_RATIO, MAX_META = 10_000, 250 << 20, 100, 64 << 10
#: Bytes of files that are handed on together.
FLUSH = 4 << 20
FILES = "artifact string, path string, size long, content binary, rejected string"


def integrity_tokens(integrity: Column) -> Column:
    """Hex digests of the tokens; null if any token is no canonical ``sha512-`` with 64 bytes in base64."""
    tokens = F.filter(F.split(F.trim(integrity), r"\s+"), lambda t: t != "")
    body = lambda t: F.substring(t, 8, 1 << 20)
    canonical = lambda t: t.rlike(r"^sha512-[A-Za-z0-9+/]{85}[AQgw]==$")
    return F.when((F.size(tokens) > 0) & F.forall(tokens, canonical), F.transform(tokens, lambda t: F.lower(F.hex(F.unbase64(body(t))))))


def verified(artifacts: DataFrame, content: str = "content", integrity: str = "integrity") -> DataFrame:
    """Add ``issue``: null, malformed-integrity or integrity-mismatch.  Any token that fits is enough."""
    want = integrity_tokens(F.col(integrity))
    fits = F.array_contains(want, F.sha2(F.col(content), 512))
    return artifacts.withColumn("issue", F.when(F.col(integrity).isNull() | want.isNull(), "malformed-integrity").when(~fits, "integrity-mismatch"))


def unsafe(name: str) -> str | None:
    """Why a path must not be read, or None."""
    if "\0" in name or "\\" in name or name.startswith("/") or (len(name) > 1 and name[1] == ":"):
        return "unsafe-path"
    parts = name.rstrip("/").split("/")
    if any(p in ("", ".", "..") for p in parts):
        return "unsafe-path"
    return None if parts[0] == "package" else "invalid-layout"


class _Expanded(io.RawIOBase):
    """Unzipped bytes as a stream; ValueError beyond the caps, which are checked while reading."""

    def __init__(self, data: bytes, max_bytes: int, ratio: int):
        self.data, self.at, self.out, self.rest = data, 0, 0, b""
        self.most, self.why = min(max_bytes, max(1, len(data)) * ratio), "expanded-size" if max_bytes <= max(1, len(data)) * ratio else "expansion-ratio"
        self.unzip = zlib.decompressobj(31)

    def readable(self) -> bool:
        return True

    def readinto(self, buffer) -> int:
        while not self.rest:
            given = self.unzip.unconsumed_tail or self.data[self.at : self.at + (1 << 16)]
            if not self.unzip.unconsumed_tail:
                self.at += len(given)
            if not given or self.unzip.eof:
                if not self.unzip.eof:
                    raise ValueError("invalid-archive")
                return 0
            self.rest = self.unzip.decompress(given, 1 << 20)
            self.out += len(self.rest)
            if self.out > self.most:
                raise ValueError(self.why)
        n = min(len(buffer), len(self.rest))
        buffer[:n], self.rest = self.rest[:n], self.rest[n:]
        return n


def _members(data: bytes, max_bytes: int, ratio: int) -> Iterator[tuple[tarfile.TarFile, tarfile.TarInfo]]:
    stream = io.BufferedReader(_Expanded(data, max_bytes, ratio), 1 << 16)
    try:
        with tarfile.open(fileobj=stream, mode="r|") as tar:
            for m in tar:
                yield tar, m
            while stream.read(1 << 16):  # the caps hold for what follows the last member too
                pass
    except (tarfile.TarError, zlib.error, EOFError, UnicodeError) as e:
        raise ValueError("invalid-archive") from e


def preflight(data: bytes, max_entries: int = MAX_ENTRIES, max_bytes: int = MAX_BYTES, ratio: int = MAX_RATIO) -> dict[str, int]:
    """For each regular file's path (without its first part) the number of its last entry; ValueError with a reason if
    any entry is not allowed.  Nothing is held but names.
    """
    found: dict[str, int] = {}
    why, n = None, 0
    for n, (_, m) in enumerate(_members(data, max_bytes, ratio), 1):
        fault = "link-entry" if m.issym() or m.islnk() else None if m.isreg() or m.isdir() else "entry-type"
        fault = fault or unsafe(m.name) or ("meta-size" if sum(len(k) + len(v) for k, v in m.pax_headers.items()) > MAX_META else None)
        why = why or fault
        if m.isreg() and "/" in m.name:
            found[m.name.split("/", 1)[1]] = n
    if n > max_entries:
        raise ValueError("entry-count")
    if why:
        raise ValueError(why)
    return found


def contents(data: bytes, only: str | None = None, max_entries: int = MAX_ENTRIES, max_bytes: int = MAX_BYTES, ratio: int = MAX_RATIO) -> Iterator[tuple[str, bytes]]:
    """(path, bytes) one after the other, in the archive's order, after all entries were found to be allowed.

    With ``only``, just that path is read.
    """
    found = preflight(data, max_entries, max_bytes, ratio)
    for n, (tar, m) in enumerate(_members(data, max_bytes, ratio), 1):
        path = m.name.partition("/")[2]
        if m.isreg() and found.get(path) == n and only in (None, path):
            yield path, tar.extractfile(m).read()


def entries(data: bytes, only: str | None = None, max_entries: int = MAX_ENTRIES, max_bytes: int = MAX_BYTES, ratio: int = MAX_RATIO) -> list[tuple[str, bytes]]:
    """The same by path, all at once."""
    return sorted(contents(data, only, max_entries, max_bytes, ratio))


def files(artifacts: DataFrame, id_col: str = "artifact", content: str = "content", only: str | None = None, max_entries: int = MAX_ENTRIES, max_bytes: int = MAX_BYTES, ratio: int = MAX_RATIO) -> DataFrame:
    """One row a regular file, or one with ``rejected`` for an archive that is not allowed.  Null contents give no row."""

    names = ["artifact", "path", "size", "content", "rejected"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for key, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if not data.is_valid:
                    continue
                try:
                    for path, body in contents(data.as_py(), only, max_entries, max_bytes, ratio):
                        yield key, path, len(body), body, None
                except ValueError as e:
                    yield key, None, None, None, str(e)

    def batch_of(held: list[tuple]) -> pa.RecordBatch:
        types = (pa.string(), pa.string(), pa.int64(), pa.binary(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for row in rows(batches):
            held.append(row)
            size += row[2] or 0
            if size > FLUSH or len(held) >= 1000:
                yield batch_of(held)
                held, size = [], 0
        if held:
            yield batch_of(held)

    return artifacts.select(F.col(id_col).cast("string"), content).mapInArrow(run, FILES)
