"""WARC archives: a writer of one gzip member a record, and a reader that salvages damaged files.

The reader checks every record (member checksum, version line, lengths, payload digest). After a
failed check it looks for the next byte at which a valid member or version line begins, goes on there,
and logs the bytes between as a quarantined gap. The same goes on inside members of many records, whole
ones and what can be unpacked of damaged ones.
"""

from __future__ import annotations

import hashlib
import os
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import quote, unquote, urlparse

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_path, small_arrow_batches, text_or_empty

VERSION = b"WARC/1.1\r\n"
#: Payloads below this size are never revisits.
LEAST_SHARED_BYTES = 100
#: Raw bytes after which the writer begins another file.
FILE_BYTES = 8 << 20
#: Bytes that the headers of one record may have.
HEADER_BYTES = 64 << 10
_PIECE, _FIRST_PIECE = 16 << 10, 1 << 10
_SAFE = "".join(map(chr, range(0x21, 0x7F))).replace("%", "")
_EPOCH = "1970-01-01T00:00:00Z"
_VERSION_LINE, _ZERO, _BLANK_LINE = re.compile(rb"WARC/\d\.\d\r?\n"), re.compile(rb"\0"), re.compile(rb"\r\n\r\n")
#: Magic, method and flags (the upper three are reserved) of a gzip member.
_MEMBER_START = re.compile(rb"\x1f\x8b\x08[\x00-\x1f]")

FOUND = "path string, at long, inner long, page_id string, url string, record_type string, payload_bytes long, payload_digest string, refers_to string, payload binary, gap_start long, gap_end long, reason string"


@dataclass
class Record:
    """A record that passed all checks; ``at`` is where its member or itself begins in the file, ``inner`` where it begins in the member's content."""

    at: int
    headers: dict[str, str]
    payload: bytes
    inner: int = 0


@dataclass
class Gap:
    """Bytes that belong to no valid record: of the file or, with ``member``, of the content of the member that begins there."""

    start: int
    end: int
    reason: str
    member: int | None = None


@dataclass
class Salvage:
    records: list[Record] = field(default_factory=list)
    gaps: list[Gap] = field(default_factory=list)


class Damaged(ValueError):
    """A record that fails a check."""


class _Next:
    """The next place of a pattern, for questions that mostly move forward: the bytes between are searched once."""

    def __init__(self, data: bytes, pattern: re.Pattern[bytes]):
        self._data, self._search = data, pattern.search
        self._asked, self._found = 0, -1

    def at(self, place: int) -> int:
        if place >= len(self._data):
            return len(self._data)
        if not self._asked <= place <= self._found:
            hit = self._search(self._data, place)
            self._asked, self._found = place, hit.start() if hit else len(self._data)
        return self._found


def encode_record(headers: dict[str, str], block: bytes) -> bytes:
    """The plain bytes of one record."""
    lines = "".join(f"{k}: {v}\r\n" for k, v in (headers | {"Content-Length": str(len(block))}).items())
    return VERSION + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


def member(record: bytes, level: int = 3) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(record) + packer.flush()


def parse_record(data: bytes, at: int = 0, blank: _Next | None = None) -> tuple[dict[str, str], bytes, int]:
    """Headers, block and end of the plain record at ``at``; Damaged if a check fails."""
    line = _VERSION_LINE.match(data, at)
    if not line:
        raise Damaged("no version line")
    end = (blank or _Next(data, _BLANK_LINE)).at(line.end() - 2)
    if end > min(line.end() + HEADER_BYTES, len(data) - 4):
        raise Damaged("headers do not end")
    headers: dict[str, str] = {}
    for raw in data[line.end() : end].split(b"\r\n"):
        name, colon, value = raw.partition(b":")
        if not colon:
            raise Damaged("not a header line")
        headers[name.decode("utf-8", "replace").strip().lower()] = value.decode("utf-8", "replace").strip()
    if not headers.get("content-length", "").isdigit():
        raise Damaged("no content length")
    start = end + 4
    stop = start + int(headers["content-length"])
    if data[stop : stop + 4] != b"\r\n\r\n":
        raise Damaged("block does not end where its length says")
    block = data[start:stop]
    digest = headers.get("warc-block-digest", "")
    if digest.startswith("sha256:") and hashlib.sha256(block).hexdigest() != digest[7:]:
        raise Damaged("block digest differs")
    return headers, block, stop + 4


class _Reader:
    """One archive, or the content of a member of it."""

    def __init__(self, data: bytes, member: int | None = None, sure: bool = False):
        self.data, self.member, self.sure = data, member, sure
        self.lines, self.members, self.zeros, self.blank = (_Next(data, p) for p in (_VERSION_LINE, _MEMBER_START, _ZERO, _BLANK_LINE))

    def _next_start(self, at: int) -> int:
        """Where the next member or version line may begin, or the end."""
        line = self.lines.at(at)
        return line if self.member is not None else min(line, self.members.at(at))

    def _has_member_header(self, at: int) -> bool:
        """Whether a gzip header stands there whose names end somewhere, with a first block of a kind that exists behind it."""
        data, flags, place = self.data, self.data[at + 3], at + 10
        if flags & 4:
            place += 2 + int.from_bytes(data[place : place + 2], "little")
        for bit in (8, 16):
            if flags & bit:
                place = self.zeros.at(place) + 1
        place += flags & 2
        if place >= len(data):
            return False
        kind = data[place] >> 1 & 3
        stored = int.from_bytes(data[place + 1 : place + 3], "little") ^ int.from_bytes(data[place + 3 : place + 5], "little")
        return kind in (1, 2) or (kind == 0 and stored == 0xFFFF)

    def _unpack(self, at: int) -> tuple[bytes, int, str]:
        """What can be unpacked of the member at ``at``, where it ends, and what is wrong with it ('' if nothing)."""
        unpacker, parts, fed = zlib.decompressobj(31), [], at
        # In pieces: what is handed over beyond the member's end is copied.
        while not unpacker.eof and fed < len(self.data):
            size = _PIECE if fed > at else _FIRST_PIECE
            before = unpacker.copy() if fed > at else None
            try:
                parts.append(unpacker.decompress(self.data[fed : fed + size]))
            except zlib.error as e:
                before = before or zlib.decompressobj(31)
                try:  # what comes before the fault in this piece
                    for k in range(fed, min(fed + size, len(self.data))):
                        parts.append(before.decompress(self.data[k : k + 1]))
                except zlib.error:
                    pass
                return b"".join(parts), fed, f"member: {e}"
            fed += size
        return b"".join(parts), min(fed, len(self.data)) - len(unpacker.unused_data), "" if unpacker.eof else "member is cut off"

    def _read_at(self, at: int, out: Salvage) -> int:
        """Add what begins at ``at`` and return where it ends."""
        if self.member is not None or not _MEMBER_START.match(self.data, at):
            headers, block, end = parse_record(self.data, at, self.blank)
            if self.sure and "warc-block-digest" not in headers:
                raise Damaged("no digest in a damaged member")
            out.records.append(Record(at if self.member is None else self.member, headers, block, 0 if self.member is None else at))
            return end
        if not self._has_member_header(at):
            raise Damaged("no member header")
        content, end, wrong = self._unpack(at)
        # Of bytes that no checksum vouches for only records with a digest of their own count.
        inside = _Reader(content, at, bool(wrong) and wrong != "member is cut off").salvage()
        out.records += inside.records
        if wrong:
            raise Damaged(wrong)
        if not inside.records:
            out.gaps.append(Gap(at, end, "member without a valid record"))
        else:
            out.gaps += inside.gaps
        return end

    def salvage(self) -> Salvage:
        out, at, bad, reason = Salvage(), 0, -1, ""
        while at < len(self.data):
            gaps = len(out.gaps)
            try:
                end = self._read_at(at, out)
            except Damaged as e:
                if bad < 0:
                    bad, reason = at, str(e)
                at = self._next_start(at + 1)
                continue
            if bad >= 0:
                out.gaps.insert(gaps, Gap(bad, at, reason, self.member))
                bad = -1
            at = end
        if bad >= 0:
            out.gaps.append(Gap(bad, len(self.data), reason, self.member))
        return out


def salvage(data: bytes) -> Salvage:
    """All valid records of one archive and the gaps between them. Empty input has neither.

    A damaged member is a gap of the file; records that can be got out of it are kept nevertheless.
    """
    return _Reader(data).salvage()


# ---- writing ---------------------------------------------------------------------------------------------------------


def _put(folder: str, name: str, data: bytes) -> str:
    """Store a file in the shared folder as a whole: written beside its place, then renamed."""
    url = urlparse(folder)
    if url.scheme in ("", "file"):
        top = unquote(url.path)
        os.makedirs(top, exist_ok=True)
        beside = f"{top}/.{name}.{os.getpid()}"
        with open(beside, "wb") as f:
            f.write(data)
        os.replace(beside, f"{top}/{name}")
    else:
        from pyarrow import fs

        store, top = fs.FileSystem.from_uri(folder)
        store.create_dir(top, recursive=True)
        beside = f"{top}/.{name}.{os.getpid()}"
        with store.open_output_stream(beside) as f:
            f.write(data)
        store.move(beside, f"{top}/{name}")
    return f"{folder}/{name}"


def _urn(page_id: str | None) -> str:
    """A page's id as a header value, with what a header cannot hold (and %) as %XX."""
    return f"<urn:page:{quote(str(page_id), safe=_SAFE)}>"


def _page_record(page_id: str | None, url: str | None, digest: str, refers_to: str | None, revisit: bool, payload: bytes, size: int) -> bytes:
    headers = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": "<urn:no-page>" if page_id is None else _urn(page_id),
        "WARC-Date": _EPOCH,
        "WARC-Target-URI": re.sub(r"[\r\n]+", " ", url or ""),
        "Content-Type": "text/html; charset=utf-8",
        "WARC-Payload-Digest": f"sha256:{digest}",
        "WARC-Payload-Length": str(size),
    }
    if revisit:
        headers |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": _urn(refers_to)}
    block = b"" if revisit else payload
    headers["WARC-Block-Digest"] = f"sha256:{hashlib.sha256(block).hexdigest()}"
    return encode_record(headers, block)


def write_pages(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html", file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write one record per page below ``folder``; returns the files: path, n_records, n_bytes.

    Of pages with equal payloads of at least 100 bytes the one with the smallest page_id is a response and
    the others revisit it. Null html is an empty payload, a null page_id sorts behind all others, and
    repeated rows of the smallest page_id are responses each. An empty table writes no file. File names
    follow from the partition, and a file appears as a whole, so a task that runs again replaces its own.
    """
    small_arrow_batches(pages.sparkSession, 2000, "16m")
    body = text_or_empty(html).cast("binary")
    rows = pages.select(
        F.col(page_id).cast("string").alias("id"), F.col(page_id).alias("order"), F.col(url).cast("string").alias("url"), body.alias("payload"),
        F.sha2(body, 256).alias("digest"), F.octet_length(text_or_empty(html)).cast("long").alias("size"),
    )
    first = rows.filter(F.col("size") >= LEAST_SHARED_BYTES).groupBy("digest").agg(F.min("order").alias("first"), F.count("*").alias("n"))
    shared = first.filter("n > 1").select("digest", F.col("first").cast("string").alias("first"))
    # Adaptive execution splits a payload that very many pages share.
    typed = rows.join(shared, "digest", "left")
    revisit = (F.col("first").isNotNull() & (F.col("id").isNull() | (F.col("id") != F.col("first")))).alias("revisit")
    plan = typed.select("id", "url", "digest", "size", revisit, F.col("first"), F.when(revisit, F.lit(b"")).otherwise(F.col("payload")).alias("payload"))
    ordered = plan.sortWithinPartitions("digest", "id", "url")

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part, parts, raw, n, count = TaskContext.get().partitionId(), [], 0, 0, 0

        def close() -> pd.DataFrame:
            nonlocal parts, raw, n, count
            data = b"".join(parts)
            done = pd.DataFrame({"path": [_put(folder, f"pages-{part:06d}-{n:05d}.warc.gz", data)], "n_records": [count], "n_bytes": [len(data)]})
            parts, raw, count, n = [], 0, 0, n + 1
            return done

        for pdf in batches:
            for r in pdf.itertuples(index=False):
                record = _page_record(r.id, r.url, r.digest, r.first, bool(r.revisit), bytes(r.payload), int(r.size))
                parts.append(member(record))
                raw, count = raw + len(record), count + 1
                if raw >= file_bytes:
                    yield close()
        if parts:
            yield close()

    return ordered.mapInPandas(write, "path string, n_records long, n_bytes long")


# ---- reading ---------------------------------------------------------------------------------------------------------


def _page(urn: str | None) -> str | None:
    found = re.fullmatch(r"<urn:page:(.*)>", urn or "", re.S)
    return unquote(found[1]) if found else None


def read_archives(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """Records and gaps of all archives below ``folder``.

    A row of a record has ``page_id`` (and the rest), a row of a gap has ``gap_start``, ``gap_end`` and
    ``reason``; ``at`` is the record's or its member's place in the file and ``inner`` the record's in the
    member's content, where a gap that has ``at`` lies too. Archives larger than 2 GB are not read (no binary value is that large); the writer closes
    its files long before. Without ``payloads`` that column is null.
    """
    small_arrow_batches(spark, 1, "16m")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc*").load(folder).select("path", "content")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in FOUND.split(", ")]
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                found, rows = salvage(bytes(content)), []
                for r in found.records:
                    h = r.headers
                    revisit = h.get("warc-type") == "revisit"
                    digest = h.get("warc-payload-digest", "").removeprefix("sha256:") if revisit else hashlib.sha256(r.payload).hexdigest()
                    size = int(h.get("warc-payload-length", 0)) if revisit else len(r.payload)
                    rows.append((path, r.at, r.inner, _page(h.get("warc-record-id")), h.get("warc-target-uri"), h.get("warc-type"), size, digest,
                                 _page(h.get("warc-refers-to")), r.payload if payloads else None, None, None, None))
                rows += [(path, g.member, None, None, None, None, None, None, None, None, g.start, g.end, g.reason) for g in found.gaps]
                out = pd.DataFrame(rows, columns=names)
                for c in ("at", "inner", "payload_bytes", "gap_start", "gap_end"):
                    out[c] = out[c].astype("Int64")
                yield out

    return files.mapInPandas(read, FOUND)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pages`` written to archives and read back: a row per page. Null html is an empty payload, repeated rows of the
    smallest page_id are responses each, and an empty table gives none."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    folder = fresh_path(spark, "warc")
    kind = pages.schema["page_id"].dataType
    written = write_pages(pages, folder).agg(F.coalesce(F.sum("n_records"), F.lit(0)).alias("n")).first()
    columns = (F.col("page_id").cast(kind), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind))
    if not written["n"]:
        return spark.createDataFrame([], FOUND).select(*columns)
    return read_archives(spark, folder, payloads=False).filter("gap_start is null").select(*columns)


QUERIES = {"op4_warc": op4_warc}
ORACLES = {
    "op4_warc": f"""
WITH p AS (
  SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (
  SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= {LEAST_SHARED_BYTES} GROUP BY 1
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)
"""
}
