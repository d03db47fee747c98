"""WARC records in ZIP archives: written by tasks into the shared folder, read back by ranges without extraction.

Any archive whose WARC files are stored members can be read, whatever its members are called: by its CDXJ indexes, compressed
or not, or, for WARC files that no index names, by running over their records.
"""

from __future__ import annotations

import datetime
import hashlib
import io
import itertools
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loreforge.llm.common import join_counted, new_path, partitions_for, read_table, stored, text_bytes

# ---------------------------------------------------------------- ZIP directory

#: Signatures and fixed sizes of the ZIP format.
_EOCD, _EOCD64, _LOCATOR64, _CENTRAL, _LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"


class RangeFile:
    """A file of any filesystem that pyarrow opens, read by offset and length only."""

    def __init__(self, uri: str):
        fs, path = pafs.FileSystem.from_uri(uri)
        self._f = fs.open_input_file(path)
        self.size = self._f.size()

    def read(self, offset: int, length: int) -> bytes:
        out = self._f.read_at(length, offset)
        if len(out) != length:
            raise ValueError(f"wanted {length} bytes at {offset}, got {len(out)}")
        return out

    def close(self) -> None:
        self._f.close()


def zip_members(f) -> dict[str, dict]:
    """name -> header (offset of the local header), size, stored size, method, crc; from the central or ZIP64 directory."""
    tail_at = max(0, f.size - 22 - 65535)
    tail = f.read(tail_at, f.size - tail_at)
    k = tail.rfind(_EOCD)
    if k < 0:
        raise ValueError("no end of central directory")
    n, size, at = struct.unpack("<HII", tail[k + 10 : k + 20])
    if n == 0xFFFF or size == 0xFFFFFFFF or at == 0xFFFFFFFF:
        where = tail_at + k - 20
        loc = f.read(where, 20)
        if loc[:4] != _LOCATOR64:
            raise ValueError("no ZIP64 locator")
        end = f.read(struct.unpack("<Q", loc[8:16])[0], 56)
        if end[:4] != _EOCD64:
            raise ValueError("no ZIP64 end of central directory")
        n, size, at = struct.unpack("<QQQ", end[32:56])
    raw, pos, out = f.read(at, size), 0, {}
    for _ in range(n):
        if raw[pos : pos + 4] != _CENTRAL:
            raise ValueError("bad central directory entry")
        flags, method = struct.unpack("<HH", raw[pos + 8 : pos + 12])
        crc, packed, full, n_name, n_extra, n_note = struct.unpack("<IIIHHH", raw[pos + 16 : pos + 34])
        header = struct.unpack("<I", raw[pos + 42 : pos + 46])[0]
        name = raw[pos + 46 : pos + 46 + n_name].decode("utf-8" if flags & 0x800 else "cp437")
        extra, e = raw[pos + 46 + n_name : pos + 46 + n_name + n_extra], 0
        while e + 4 <= len(extra):
            kind, length = struct.unpack("<HH", extra[e : e + 4])
            if kind == 1:  # ZIP64: the values that don't fit, in this order
                body, b = extra[e + 4 : e + 4 + length], 0
                wide = []
                for v in (full, packed, header):
                    if v == 0xFFFFFFFF:
                        v = struct.unpack("<Q", body[b : b + 8])[0]
                        b += 8
                    wide.append(v)
                full, packed, header = wide
            e += 4 + length
        out[name] = {"header": header, "size": full, "packed": packed, "method": method, "crc": crc}
        pos += 46 + n_name + n_extra + n_note
    return out


def member_offset(f, member: dict) -> int:
    """Where the bytes of a stored member begin."""
    if member["method"] != 0:
        raise ValueError("the member is compressed as a whole, so records in it can't be read by range")
    head = f.read(member["header"], 30)
    if head[:4] != _LOCAL:
        raise ValueError("bad local header")
    n_name, n_extra = struct.unpack("<HH", head[26:30])
    return member["header"] + 30 + n_name + n_extra


# ---------------------------------------------------------------- records


PAGE = "urn:page:"  # record ids of pages that this module writes


def _gzip(raw: bytes, level: int = 3) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def _record(kind: str, ident: str, date: str, content_type: str, body: bytes, more: list[str]) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{ident}>", f"WARC-Date: {date}", f"Content-Type: {content_type}", *more, f"Content-Length: {len(body)}"]
    return _gzip("\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n")


def warcinfo(date: str) -> bytes:
    return _record("warcinfo", f"urn:uuid:{uuid.uuid4()}", date, "application/warc-fields", b"software: loreforge\r\nformat: WARC File Format 1.1\r\n", [])


def warc_record(page_id, url: str | None, payload: bytes, digest: str, refers_to, date: str) -> bytes:
    """One record as a gzip member: a response with its payload, or a revisit with the HTTP head alone."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    more = [f"WARC-Target-URI: {json.dumps(url or '')[1:-1]}", f"WARC-Payload-Digest: sha256:{digest}"]
    if refers_to is not None:
        more += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{PAGE}{json.dumps(refers_to)}>"]
    kind, body = ("response", head + payload) if refers_to is None else ("revisit", head)
    return _record(kind, PAGE + json.dumps(page_id), date, "application/http;msgtype=response", body, more)


def _page_of(ident: str | None):
    ident = (ident or "").strip("<>")
    return json.loads(ident[len(PAGE) :]) if ident.startswith(PAGE) else None


def parse_record(raw: bytes) -> dict:
    """A record (gzip member or plain): header fields, the HTTP body's length, and the payload (null for a revisit).

    The length is that of the body; of a revisit it is what its HTTP head says, null where it says nothing. The digest is the
    body's SHA-256, or what the header of a revisit tells, bare where it is a SHA-256.
    """
    if raw[:2] == b"\x1f\x8b":
        raw = zlib.decompress(raw, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode("utf-8", "replace").split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    body = rest[: int(fields["content-length"])]
    kind = fields["warc-type"]
    http, payload = b"", body
    if body.startswith(b"HTTP/") and fields.get("content-type", "").startswith("application/http"):
        http, _, payload = body.partition(b"\r\n\r\n")
    said = next((int(x.partition(b":")[2]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")), None)
    told = fields.get("warc-payload-digest", "")
    out = {"record_type": kind, "record_id": fields["warc-record-id"].strip("<>"), "url": fields.get("warc-target-uri"), "date": fields.get("warc-date")}
    out |= {"page_id": _page_of(fields["warc-record-id"]), "refers_to": _page_of(fields.get("warc-refers-to")), "payload": None, "length": said, "digest": told.removeprefix("sha256:")}
    if kind != "revisit":
        out |= {"payload": payload, "length": len(payload), "digest": hashlib.sha256(payload).hexdigest()}
        if said is not None and kind == "response" and told.startswith("sha256:") and (said != len(payload) or told[7:].lower() != out["digest"]):
            raise ValueError("a damaged record")
    return out


def gzip_spans(f, at: int, end: int, piece: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """(offset, length) of each gzip member from `at` to `end`, read in pieces."""
    begin, z = at, zlib.decompressobj(31)
    while at < end:
        data = f.read(at, min(piece, end - at))
        at += len(data)
        while data:
            z.decompress(data)
            if not z.eof:
                break
            data = z.unused_data
            stop = at - len(data)
            yield begin, stop - begin
            begin, z = stop, zlib.decompressobj(31)


def plain_spans(f, at: int, end: int, head: int = 1 << 16) -> Iterator[tuple[int, int]]:
    """(offset, length) of each record of a WARC file that isn't compressed."""
    while at < end:
        raw = f.read(at, min(head, end - at))
        k = raw.find(b"\r\n\r\n")
        if not raw.startswith(b"WARC/") or k < 0:
            raise ValueError(f"no WARC record at {at}")
        n = next(int(x.partition(b":")[2]) for x in raw[:k].split(b"\r\n") if x.lower().startswith(b"content-length:"))
        yield at, k + 4 + n + 4
        at += k + 4 + n + 4


def index_lines(f, at: int, size: int, packed: bool, piece: int = 1 << 20) -> Iterator[tuple[bytes, int]]:
    """Lines of a stored index, read in pieces; members of a compressed one follow one another. With each the CRC of what was read."""
    z, rest, crc, done = zlib.decompressobj(31) if packed else None, b"", 0, 0
    while done < size:
        data = f.read(at + done, min(piece, size - done))
        done += len(data)
        crc = zlib.crc32(data, crc)
        text = b"" if packed else data
        while packed and data:
            text += z.decompress(data)
            data = z.unused_data
            if z.eof:
                z = zlib.decompressobj(31)
        lines = (rest + text).split(b"\n")
        rest = lines.pop()
        yield from ((x, crc) for x in lines if x.strip())
    if rest.strip():
        yield rest, crc


def cdxj_entry(line: bytes) -> dict | None:
    """The JSON part of a line `key timestamp {...}` or of a line of JSON alone; null for other lines."""
    k = line.find(b"{")
    if k < 0 or line.startswith(b"!"):
        return None
    x = json.loads(line[k:])
    return x if "offset" in x and "length" in x else None


def archive_records(f, path: str = "") -> Iterator[tuple[int, int]]:
    """(offset, length) of the records of an archive's stored WARC files: those that its indexes name, and all of files that none names."""
    members = zip_members(f)
    warcs = {n: m for n, m in members.items() if n.lower().endswith((".warc", ".warc.gz"))}
    base = {n: member_offset(f, m) for n, m in warcs.items()}
    by_file = {n.rsplit("/", 1)[-1]: n for n in warcs}
    known: set[str] = set()
    for n, m in members.items():
        if not n.lower().endswith((".cdx", ".cdxj", ".cdx.gz", ".cdxj.gz", ".jsonl")) or m["method"] != 0 or n.startswith("pages/"):
            continue
        at, crc = member_offset(f, m), 0
        for line, crc in index_lines(f, at, m["size"], n.lower().endswith(".gz")):
            x = cdxj_entry(line)
            if x is None:
                continue
            name = str(x.get("filename", "")).rsplit("/", 1)[-1]
            w = by_file.get(name) or (next(iter(warcs)) if len(warcs) == 1 else None)
            if w is None:
                raise ValueError(f"{path}: the index names {name}, which isn't in the archive")
            known.add(w)
            yield base[w] + int(x["offset"]), int(x["length"])
        if known and crc != m["crc"]:
            raise ValueError(f"{path}: the index {n} is damaged")
    for n, m in warcs.items():
        if n not in known:
            spans = gzip_spans if n.lower().endswith(".gz") else plain_spans
            yield from spans(f, base[n], base[n] + m["size"])


# ---------------------------------------------------------------- operators


def plan_records(pages: DataFrame, min_bytes: int = 100) -> DataFrame:
    """page_id, url, html, digest, refers_to: of equal payloads of at least min_bytes, the smallest page_id is kept.

    Null html is an empty payload. Rows that repeat the smallest page_id are all responses; null page_ids count as
    larger than any other, and are responses where there is no other.
    """
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), "url", "html",
        F.sha2(F.coalesce(F.col("html"), F.lit("")), 256).alias("digest"),
        F.coalesce(F.octet_length("html"), F.lit(0)).alias("n"),
    )
    first = rows.where(F.col("n") >= min_bytes).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("c"))
    first = first.where("c > 1 and first is not null")
    joined = join_counted(rows, stored(first, "payloads-repeated"), ["digest"], "c", "left")
    other = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return joined.select("page_id", "url", "html", "digest", F.when(other, F.col("first")).alias("refers_to"))


def write_archives(records: DataFrame, folder: str, bytes_each: int = 64 << 20) -> DataFrame:
    """One ZIP archive or more for each partition, of stored members: archive/data.warc.gz and its index indexes/index.cdx.gz; returns (path, records)."""
    date = datetime.datetime.now(datetime.UTC).strftime("%Y-%m-%dT%H:%M:%SZ")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = pafs.FileSystem.from_uri(folder)
        fs.create_dir(path, recursive=True)
        done, data, index = [], io.BytesIO(), []

        def close():
            # a task that is run again writes other files; only those that its result names are read
            name = f"{uuid.uuid4().hex}.wacz"
            stamp = "".join(c for c in date if c.isdigit())
            lines = sorted(f"{url or '-'} {stamp} ".replace("\n", "%0A").encode() + json.dumps(x).encode() for url, x in index)
            with fs.open_output_stream(f"{path}/{name}") as f, zipfile.ZipFile(f, "w", zipfile.ZIP_STORED) as z:
                z.writestr("archive/data.warc.gz", data.getbuffer())
                z.writestr("indexes/index.cdx.gz", _gzip(b"\n".join(lines) + b"\n"))
            done.append((f"{folder}/{name}", len(index)))
            data.seek(0)
            data.truncate()
            index.clear()

        for b in batches:
            c = b.to_pydict()
            payloads = text_bytes(b.column("html"))
            for pid, url, payload, digest, ref in zip(c["page_id"], c["url"], payloads, c["digest"], c["refers_to"], strict=True):
                if not index:
                    data.write(warcinfo(date))
                rec = warc_record(pid, url, payload, digest, ref, date)
                key = json.dumps(url or "-")[1:-1].replace("{", "%7B").replace(" ", "%20")
                index.append((key, {"filename": "data.warc.gz", "offset": str(data.tell()), "length": str(len(rec)), "digest": f"sha256:{digest}"}))
                data.write(rec)
                if data.tell() >= bytes_each:
                    close()
        if index:
            close()
        yield pa.RecordBatch.from_pydict({"path": pa.array([p for p, _ in done], pa.string()), "records": pa.array([n for _, n in done], pa.int64())})

    return stored(records.select("page_id", "url", "html", "digest", "refers_to").mapInArrow(write, "path string, records long"), "warc-archives")


def read_index(archives: DataFrame) -> DataFrame:
    """path, offset and length (in the archive file) of each record of the archives (path), see archive_records."""

    def read(batches):
        for b in batches:
            for path in b.column("path").to_pylist():
                f = RangeFile(path)
                spans = archive_records(f, path)
                while rows := list(itertools.islice(spans, 10_000)):
                    yield pa.RecordBatch.from_pydict({"path": [path] * len(rows), "offset": pa.array([x for x, _ in rows], pa.int64()), "length": pa.array([n for _, n in rows], pa.int64())})
                f.close()

    return archives.mapInArrow(read, "path string, offset long, length long")


_RECORDS = "page_id long, record_id string, url string, date string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read_records(index: DataFrame, kinds: tuple[str, ...] = ("response", "revisit", "resource")) -> DataFrame:
    """_RECORDS: the records of these kinds. page_id and refers_to are null for records of other writers; digests that a record tells as SHA-256 are checked."""

    def read(batches):
        path, f = None, None
        for b in batches:
            c = b.to_pydict()
            out = []
            for p, offset, length in zip(c["path"], c["offset"], c["length"], strict=True):
                if p != path:
                    if f:
                        f.close()
                    path, f = p, RangeFile(p)
                try:
                    r = parse_record(f.read(offset, length))
                except (ValueError, zlib.error) as e:
                    raise ValueError(f"{p}: record at {offset}: {e}") from e
                if r["record_type"] in kinds:
                    out.append(r)
                if len(out) >= 500:
                    yield _batch(out)
                    out = []
            if out:
                yield _batch(out)

    return index.mapInArrow(read, _RECORDS)


def _batch(rows: list[dict]) -> pa.RecordBatch:
    col = lambda k, t: pa.array([r[k] for r in rows], t)
    texts = {k: col(k, pa.string()) for k in ("record_id", "url", "date", "record_type")}
    cols = {"payload": col("payload", pa.binary()), "payload_bytes": col("length", pa.int64()), "payload_digest": col("digest", pa.string()), "page_id": col("page_id", pa.int64()), "refers_to": col("refers_to", pa.int64())}
    return pa.RecordBatch.from_pydict({n: (texts | cols)[n] for n in (x.split()[0] for x in _RECORDS.split(", "))})


def archive_round_trip(pages: DataFrame) -> DataFrame:
    """Writes a record for each row of pages and reads all back: see plan_records for nulls, repeats and ties.

    Every row gives one record, so an empty table gives none. Other columns are left out.
    """
    spark = pages.sparkSession
    folder = new_path(spark, "warc")
    archives = write_archives(plan_records(pages), folder)
    index = read_index(archives).repartition(partitions_for(spark, 0))
    return read_records(index)


def op9_warc(spark, sf_dir) -> DataFrame:
    out = archive_round_trip(read_table(spark, sf_dir, "pages"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP9_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h) AS n, sha256(h) AS s FROM p),
f AS (SELECT page_id, n, s, min(page_id) OVER (PARTITION BY s) AS first FROM d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, s AS payload_digest,
       CASE WHEN n >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND page_id <> first THEN first END AS refers_to
FROM f
"""
