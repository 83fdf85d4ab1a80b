"""Web archives (WARC): the records of the archives listed in a manifest.

Reading an archive is the one thing no Spark reader does, so each task streams the archives, or ranges of archives, of its
rows and hands the records on in Arrow batches. Nothing is held but the current record and the batch being filled.
"""

from __future__ import annotations

import io
import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyarrow import ArrowInvalid
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tidemark.session import materialise

SCHEMA = "source string, target_uri string, payload string, failure string"
COLUMNS = ["source", "target_uri", "payload", "failure"]
SPLIT_BYTES = 64 << 20
_BATCH_BYTES = 16 << 20
_CHUNK = 1 << 16
_EDGE = 64  # bytes that must begin to unpack for a place to look like the start of a record

# Schemes that are read without a Hadoop file system; form of an object store address; first bytes of a gzip
# member; first bytes of a record.
_FILE_SCHEME, _STORE_SCHEME = "file:", "s3:/"
_STORE_URI = re.compile(r"^s3://([^/]+)/(.+)")
_MEMBER, _RECORD = b"\x1f\x8b\x08", b"WARC/"


def _open(uri: str):
    """Seekable byte stream of an archive in a local folder or a public store; of another scheme by Arrow's file systems."""
    from pyarrow import fs

    if uri.startswith(_FILE_SCHEME):
        return fs.LocalFileSystem().open_input_file(re.sub(r"^file:/*", "/", uri))
    if uri.startswith(_STORE_SCHEME):
        bucket_key = _STORE_URI.match(uri)
        if bucket_key is None:
            raise ValueError(f"not an object address: {uri}")
        return fs.S3FileSystem(anonymous=True).open_input_file("/".join(bucket_key.groups()))
    if "://" not in uri:
        raise LookupError(f"no scheme: {uri}")
    system, path = fs.FileSystem.from_uri(uri)  # hdfs:, gs:, abfs: ..; unknown ones raise
    return system.open_input_file(path)


class _Plain:
    """Lines and bytes of an archive that is not packed. ``place`` is where the last line began."""

    def __init__(self, raw, start: int):
        raw.seek(start)
        self._stream, self._at, self.place = io.BufferedReader(raw), start, start

    def readline(self) -> bytes:
        self.place = self._at
        line = self._stream.readline()
        self._at += len(line)
        return line

    def read(self, size: int) -> bytes:
        data = self._stream.read(size)
        self._at += len(data)
        return data


class _Members:
    """Lines and bytes of an archive of gzip members in any grouping. ``place`` is where the member begins whose first byte
    the last line began with; None if that line began within a member."""

    def __init__(self, raw, start: int):
        raw.seek(start)
        self._raw, self._packed, self._at = raw, b"", start
        self._member, self._begin = None, start
        self._data, self._used, self._first = b"", 0, False
        self.place: int | None = start

    def _more(self) -> bool:
        """The next bytes of one member; False at the end of the archive."""
        self._first = False
        while True:
            if not self._packed:
                self._packed = self._raw.read(_CHUNK)
                if not self._packed and self._member is None:
                    return False
                if not self._packed:
                    raise EOFError("archive ends inside a member")
            if self._member is None:
                padding = len(self._packed) - len(self._packed.lstrip(b"\0"))
                self._packed, self._at = self._packed[padding:], self._at + padding
                if not self._packed:
                    continue
                self._member, self._begin, self._first = zlib.decompressobj(zlib.MAX_WBITS | 16), self._at, True
            data = self._member.decompress(self._packed, _CHUNK)
            left = self._member.unused_data if self._member.eof else self._member.unconsumed_tail
            self._at += len(self._packed) - len(left)
            self._packed = left
            if self._member.eof:
                self._member = None
            if data:
                self._data, self._used = data, 0
                return True

    def readline(self) -> bytes:
        parts = []
        while True:
            if self._used == len(self._data) and not self._more():
                return b"".join(parts)
            if not parts:
                self.place = self._begin if self._first and self._used == 0 else None
            end = self._data.find(b"\n", self._used) + 1 or len(self._data)
            parts.append(self._data[self._used : end])
            self._used = end
            if parts[-1].endswith(b"\n"):
                return b"".join(parts)

    def read(self, size: int) -> bytes:
        parts = []
        while size > 0 and (self._used < len(self._data) or self._more()):
            parts.append(self._data[self._used : self._used + size])
            self._used += len(parts[-1])
            size -= len(parts[-1])
        return b"".join(parts)


def _header_block(stream) -> dict[str, str]:
    """``name: value`` lines up to a blank one, names in lower case."""
    headers: dict[str, str] = {}
    for line in iter(stream.readline, b""):
        text = line.decode("utf-8", "replace").strip()
        if not text:
            break
        name, _, value = text.partition(":")
        headers[name.strip().lower()] = value.strip()
    return headers


def _unchunk(body: bytes) -> bytes:
    """Body of a chunked transfer; one that is not in chunks is left as it is."""
    stream, parts = io.BytesIO(body), []
    while True:
        size = stream.readline().split(b";")[0].strip()
        if not re.fullmatch(rb"[0-9a-fA-F]+", size):
            return b"".join(parts) if parts else body
        length = int(size, 16)
        if length == 0:
            return b"".join(parts)
        parts.append(stream.read(length))
        stream.readline()


def _content(headers: dict[str, str], block: bytes) -> bytes:
    """Payload of a record: what follows the HTTP header, unchunked and unzipped, if there is one."""
    if not headers.get("content-type", "").startswith("application/http"):
        return block
    stream = io.BytesIO(block)
    stream.readline()
    http = _header_block(stream)
    body = stream.read()
    if "chunked" in http.get("transfer-encoding", "").lower():
        body = _unchunk(body)
    if http.get("content-encoding", "").lower() in ("gzip", "x-gzip", "deflate"):
        try:
            body = zlib.decompress(body, zlib.MAX_WBITS | 32)
        except zlib.error:
            pass  # labelled as packed, but is not
    return body


def _is_packed(raw) -> bool:
    raw.seek(0)
    return raw.read(2) == _MEMBER[:2]


def _blocks(raw, start: int = 0, end: int | None = None) -> Iterator[tuple[int | None, dict[str, str] | None, bytes]]:
    """(place, headers, block) of the records from ``start`` on, up to the first that begins at or after ``end`` in a place
    where reading can begin; that place, or the place after the last record, comes last, with None as headers."""
    stream = _Members(raw, start) if _is_packed(raw) else _Plain(raw, start)
    for line in iter(stream.readline, b""):
        if not line.strip():
            continue
        place = stream.place
        if end is not None and place is not None and place >= end:
            yield place, None, b""
            return
        if not line.startswith(_RECORD):
            raise ValueError("no record where one should start")
        headers = _header_block(stream)
        length = int(headers["content-length"])
        block = stream.read(length)
        if len(block) < length:
            raise EOFError("archive ends inside a record")
        yield place, headers, block
    yield raw.size(), None, b""


def _archive_rows(uri: str, start: int = 0, end: int | None = None) -> Iterator[tuple]:
    try:
        raw = _open(uri)
    except (ArrowInvalid, LookupError):  # no file system for it
        yield uri, None, None, "skipped"
        return
    except Exception:
        yield uri, None, None, "segment"
        return
    with raw:
        yield from _rows_of(uri, raw, start, end)


def _rows_of(uri: str, raw, start: int = 0, end: int | None = None) -> Iterator[tuple]:
    """(target URI, payload) of each record that has a target, or a failure."""
    try:
        for _, headers, block in _blocks(raw, start, end):
            if headers is None or "warc-target-uri" not in headers:
                continue
            target = headers["warc-target-uri"].strip("<>")
            try:
                yield uri, target, _content(headers, block).decode("utf-8"), None
            except UnicodeDecodeError:
                yield uri, target, None, "record"
    except Exception:  # whatever is wrong with an archive must not end the job: it is counted instead
        yield uri, None, None, "segment"


def _batched(rows: Iterator[tuple]) -> Iterator[pd.DataFrame]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[2] or "")
        if size >= _BATCH_BYTES:
            yield pd.DataFrame(held, columns=COLUMNS)
            held, size = [], 0
    yield pd.DataFrame(held, columns=COLUMNS)


def _scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    return _batched(row for batch in batches for uri in batch["uri"] for row in _archive_rows(uri))


def _scan_ranges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    each = ((uri, int(a), int(b) if b >= 0 else None) for batch in batches for uri, a, b in zip(batch["uri"], batch["start"], batch["end"]))
    return _batched(row for uri, start, end in each for row in _archive_rows(uri, start, end))


def scan_archives(manifest: DataFrame, split_bytes: int | None = None) -> DataFrame:
    """(source, target_uri, payload, failure): all records, and a row for each failure.

    ``failure`` is NULL for good records, ``record`` for a payload that is no UTF-8, ``segment`` for an archive that
    could not be opened or read to its end (the records before the damage are kept), ``skipped`` for an address of a
    scheme without a file system. For those, read the bytes through Spark: ``scan_archive_files``.

    An archive is read by one task, or with ``split_bytes`` by a task for each range of about so many bytes, with the same
    rows: see ``archive_ranges``.
    """
    if split_bytes is None:
        return manifest.select("uri").mapInPandas(_scan, SCHEMA)
    return scan_ranges(archive_ranges(manifest, split_bytes))


def scan_ranges(ranges: DataFrame) -> DataFrame:
    """Like ``scan_archives`` for the ranges that ``archive_ranges`` gives: a range is read by one task, and what cannot be
    opened or read is a failure of the range."""
    spread = ranges.repartition(max(1, ranges.count()), "uri", "start")
    return spread.select("uri", "start", F.coalesce("end", F.lit(-1)).alias("end")).mapInPandas(_scan_ranges, SCHEMA)


def _likely_start(raw, start: int, end: int) -> int | None:
    """The first place from ``start`` on, and before ``end``, that looks like the start of a record."""
    packed = _is_packed(raw)
    mark = _MEMBER if packed else _RECORD
    at, held = start, b""
    while at < end:
        raw.seek(at + len(held))
        more = raw.read(_CHUNK)
        held += more
        found = held.find(mark)
        while found >= 0 and at + found < end:
            raw.seek(at + found)
            head = raw.read(4 * _EDGE)
            try:
                plain = zlib.decompressobj(zlib.MAX_WBITS | 16).decompress(head, _EDGE) if packed else head
                if plain.startswith(_RECORD):
                    return at + found
            except zlib.error:
                pass
            found = held.find(mark, found + 1)
        if not more:
            return None
        keep = len(mark) - 1
        at, held = at + max(0, len(held) - keep), held[-keep:]
    return None


def _traced(uri: str, start: int, end: int, known: bool) -> tuple[int, int]:
    """(first, next) of a range: where its first record begins, and where the first record after it does; -1 for a range
    without a likely start, or one that cannot be read to its end. Reading from a likely start that breaks off goes on at the
    next one, for what looked like a record was part of a page."""
    reached = start - 1
    while True:
        with _open(uri) as raw:
            first = start if known else _likely_start(raw, reached + 1, end)
            if first is None:
                return -1, -1
            reached = first
            try:
                for place, _, _ in _blocks(raw, first, end):
                    reached = reached if place is None else place
                return first, reached
            except Exception:  # the scan of this range gives the failure
                if known:
                    return first, -1


def _trace(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        traced = [_traced(u, int(a), int(b), bool(k)) for u, a, b, k in zip(batch["uri"], batch["start"], batch["end"], batch["known"])]
        yield batch.assign(first=[f for f, _ in traced], next=[n for _, n in traced])


def _cut(split_bytes: int):
    """Archives -> ranges of this size; what cannot be opened is one range, so that its scan gives the failure."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for number, uri in zip(batch["number"], batch["uri"]):
                try:
                    with _open(uri) as raw:
                        size = raw.size()
                except Exception:
                    size = 0
                if size <= split_bytes:
                    rows.append((number, uri, 0, -1, True))
                else:
                    rows.extend((number, uri, at, min(size, at + split_bytes), at == 0) for at in range(0, size, split_bytes))
            yield pd.DataFrame(rows, columns=["number", "uri", "start", "end", "known"])

    return cut


def _chained(ranges: pd.DataFrame) -> pd.DataFrame:
    """The ranges of one archive -> those with records, from where to where. A range is right if it begins where the one
    before it says that the next record is, and all before it are right. One that begins elsewhere is to be traced again from
    there (``known``); so are later ones, from where the trace so far says that they begin: reading that begins in a wrong
    place mostly comes upon the right records soon, so that what it says of its end holds."""
    rows, at, sure = [], 0, True
    for number, uri, start, end, first, next_ in ranges.sort_values("start")[["number", "uri", "start", "end", "first", "next"]].itertuples(index=False):
        if at is None and first >= 0:
            at = first  # what was before it is unknown, so it stays as it is
        if at is None or at >= end:
            continue  # the record before it goes on beyond this range
        if first != at:
            rows.append((number, uri, at, end, True, False))
            sure = False
        elif sure:
            rows.append((number, uri, at, end, True, True))
            if next_ < 0:
                break  # damaged: nothing after it is read
        at = next_ if next_ >= 0 else None
    return pd.DataFrame(rows, columns=["number", "uri", "start", "end", "known", "right"])


def archive_ranges(manifest: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """(uri, start, end): ranges of about ``split_bytes`` that hold whole records, for ``scan_ranges``; can be kept for later
    scans of the same archives. ``end`` is NULL for an archive in one range.

    A packed archive does not say where its members begin, and what looks like the start of one can be part of a page. So all
    ranges are traced at once, each from its first likely start, to the first record after it. The first range begins where
    the archive does; a range is right if it begins where the one before it ends. Those that are not are traced again, all at
    once, from where the one before them ends by the last trace, until all are right: mostly a few rounds, whatever the number
    of ranges. A range begins only with a record that begins a member; an archive of one member
    stays in one range. After damage nothing is read, as by ``scan_archives``. An address that occurs twice is read twice.
    """
    numbered = materialise(manifest.select("uri").withColumn("number", F.monotonically_increasing_id()), "manifest")
    layout = "number long, uri string, start long, end long, known boolean"
    pieces = materialise(numbered.mapInPandas(_cut(split_bytes), layout), "pieces")
    whole = pieces.where("end < 0").select("uri", "start", F.lit(None).cast("long").alias("end"))
    traced_layout = f"{layout}, first long, next long"

    def trace(ranges: DataFrame) -> DataFrame:
        spread = ranges.repartition(max(1, ranges.count()), "number", "start")
        return materialise(spread.mapInPandas(_trace, traced_layout), "traced")

    traced = trace(pieces.where("end >= 0"))
    while True:
        # a few numbers for each range of an archive
        chained = materialise(traced.groupBy("number").applyInPandas(_chained, f"{layout}, right boolean"), "chained")
        wrong = chained.where(~F.col("right"))
        if wrong.isEmpty():
            break
        again = trace(wrong.select("number", "uri", "start", "end", "known"))
        # the range is known by its end, which does not move
        others = traced.join(wrong.select("number", "end"), ["number", "end"], "left_anti")
        traced = materialise(others.unionByName(again), "traced")
    return whole.union(chained.select("uri", "start", "end"))


def _scan_bytes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    from pyarrow import BufferReader

    for batch in batches:
        for uri, content in zip(batch["path"], batch["content"]):
            yield pd.DataFrame(list(_rows_of(uri, BufferReader(content))), columns=COLUMNS)


def scan_archive_files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Like ``scan_archives`` for archives that Spark opens itself, of any scheme that it has a file system for. An archive
    is a row, so it must fit into a task's memory (and be below two gigabytes)."""
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(_scan_bytes, SCHEMA)


def scan_warc(manifest: DataFrame, split_bytes: int | None = None) -> DataFrame:
    """(source, target_uri, payload) of the good records."""
    return scan_archives(manifest, split_bytes).filter(F.col("failure").isNull()).drop("failure")


def observed_scan(manifest: DataFrame) -> tuple[DataFrame, Observation]:
    """Like ``scan_warc``, with counters ``failed_segments`` and ``failed_records`` that fill as the rows are used."""
    watched, counters = observed(scan_archives(manifest))
    return watched.filter(F.col("failure").isNull()).drop("failure"), counters


def observed(scan: DataFrame) -> tuple[DataFrame, Observation]:
    """A scan with its failures counted as its rows are used."""
    counters = Observation("archive scan")
    return scan.observe(
        counters,
        F.count_if(F.col("failure") == "segment").alias("failed_segments"),
        F.count_if(F.col("failure") == "record").alias("failed_records"),
        F.count_if(F.col("failure") == "skipped").alias("skipped_archives"),
    ), counters
