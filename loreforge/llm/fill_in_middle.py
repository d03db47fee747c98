"""Fill-in-middle over seekable compressed frames.

A text is stored as independent zstandard frames with the numbers of units, code points and bytes before each. A cut decompresses
the one frame that it falls in; digests stream the frames in order. Nothing holds a whole text uncompressed.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loreforge.llm.common import read_table, stored, text_bytes

#: Uncompressed bytes of a frame; percent of documents that stay plain and, of the others, that are suffix-first.
FRAME, PLAIN, SPM = 1 << 16, 10, 20
#: The markers.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"

_FRAME = "array<struct<units: bigint, chars: bigint, bytes: bigint, letter: boolean, data: binary>>"
_FRAMES = f"doc_id long, n long, n_chars long, n_bytes long, marked boolean, frames {_FRAME}"
_OUTPUTS = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, output array<struct<bytes: bigint, data: binary>>"
_FRAME_TYPE = pa.list_(pa.struct([("units", pa.int64()), ("chars", pa.int64()), ("bytes", pa.int64()), ("letter", pa.bool_()), ("data", pa.binary())]))
_OUTPUT_TYPE = pa.list_(pa.struct([("bytes", pa.int64()), ("data", pa.binary())]))


def unit_starts(buf: np.ndarray, letter_before: bool) -> tuple[np.ndarray, bool]:
    """Where units start: at the first letter of a run of A-Z and a-z, and at every other code point. Also: is the last byte a letter."""
    letter = ((buf | 0x20) - np.uint8(0x61)) < 26
    before = np.empty_like(letter)
    before[:1] = letter_before
    before[1:] = letter[:-1]
    starts = (letter & ~before) | (~letter & ((buf & 0xC0) != 0x80))
    return starts, bool(letter[-1]) if len(buf) else letter_before


def pieces_of(text: bytes, size: int = FRAME) -> Iterator[bytes]:
    """The text in pieces of about `size` bytes that end with a code point."""
    at = 0
    while at < len(text):
        end = min(len(text), at + size)
        while end < len(text) and (text[end] & 0xC0) == 0x80:
            end += 1
        yield text[at:end]
        at = end


def frames_of(text: bytes, compress: Callable[[bytes], bytes], size: int = FRAME) -> tuple[list[dict], int, int]:
    """Frames, units and code points of a text."""
    out, units, chars, at, letter = [], 0, 0, 0, False
    for piece in pieces_of(text, size):
        buf = np.frombuffer(piece, dtype=np.uint8)
        starts, last = unit_starts(buf, letter)
        out.append({"units": units, "chars": chars, "bytes": at, "letter": letter, "data": compress(piece)})
        units += int(np.count_nonzero(starts))
        chars += int(np.count_nonzero((buf & 0xC0) != 0x80))
        at, letter = at + len(piece), last
    return out, units, chars


class Frames:
    """Read access to compressed frames; the last one opened is kept."""

    def __init__(self, frames: list[dict], decompress: Callable[[bytes], bytes]):
        self.frames, self.starts, self._decompress = frames, [f["bytes"] for f in frames], decompress
        self._at, self._data = -1, b""

    def open(self, i: int) -> bytes:
        if i != self._at:
            self._at, self._data = i, self._decompress(self.frames[i]["data"])
        return self._data

    def read(self, lo: int = 0, hi: int | None = None) -> Iterator[bytes]:
        """The bytes lo to hi (None: to the end), a frame at a time."""
        i = bisect_right(self.starts, lo) - 1
        while 0 <= i < len(self.frames) and (hi is None or self.starts[i] < hi):
            data, start = self.open(i), self.starts[i]
            part = data[max(lo - start, 0) : None if hi is None else hi - start]
            if part:
                yield part
            i += 1

    def cut(self, unit: int) -> tuple[int, int] | None:
        """(bytes, code points) before the unit of this number; None if there are no so many units."""
        i = bisect_right([f["units"] for f in self.frames], unit) - 1
        if i < 0:
            return None
        f = self.frames[i]
        buf = np.frombuffer(self.open(i), dtype=np.uint8)
        at = np.flatnonzero(unit_starts(buf, f["letter"])[0])
        k = unit - f["units"]
        if k >= len(at):
            return None
        return f["bytes"] + int(at[k]), f["chars"] + int(np.count_nonzero((buf[: at[k]] & 0xC0) != 0x80))

    def find(self, marker: bytes, lo: int) -> int:
        """First place of the marker from `lo` on; -1 if there is none. Places over a frame's end are found."""
        tail, at = b"", lo
        for part in self.read(lo):
            k = (tail + part).find(marker)
            if k >= 0:
                return at - len(tail) + k
            at += len(part)
            tail = (tail + part)[-(len(marker) - 1) :]
        return -1


def text_frames(docs: DataFrame, size: int = FRAME, level: int = 3) -> DataFrame:
    """doc_id, n (units), n_chars, n_bytes, marked (a marker stands in the text) and frames of each document; null texts are empty."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compress = zstandard.ZstdCompressor(level=level).compress
        for b in batches:
            texts = text_bytes(b.column("text"))
            made = [frames_of(t, compress, size) for t in texts]
            yield pa.record_batch(
                {
                    "doc_id": b.column("doc_id"),
                    "n": pa.array([m[1] for m in made], pa.int64()),
                    "n_chars": pa.array([m[2] for m in made], pa.int64()),
                    "n_bytes": pa.array([len(t) for t in texts], pa.int64()),
                    "marked": pa.array([any(m in t for m in (PREFIX, SUFFIX, MIDDLE)) for t in texts], pa.bool_()),
                    "frames": pa.array([m[0] for m in made], _FRAME_TYPE),
                }
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _FRAMES)


def draws(doc_id: int | None, seed: int = 1) -> list[int]:
    """Four unsigned 32-bit numbers of a document; a null id is the empty string."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(digest[4 * i : 4 * i + 4], "big") for i in range(4)]


def plan_of(doc_id: int | None, n: int, n_bytes: int, n_chars: int, marked: bool, frames: Frames, seed: int = 1) -> tuple[str, int | None, int | None, list[bytes | tuple[int, int]]]:
    """form, code points of prefix and middle, and the output as markers and ranges of the text's bytes."""
    h = draws(doc_id, seed)
    if not n or marked or h[2] % 100 >= 100 - PLAIN:
        return "plain", None, None, [(0, n_bytes)]
    first, second = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    (p, p_chars), (m, m_chars) = (frames.cut(k) or (n_bytes, n_chars) for k in (first, second))
    prefix, middle, suffix = (0, p), (p, m), (m, n_bytes)
    if h[3] % 100 < SPM:
        return "spm", p_chars, m_chars - p_chars, [SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle]
    return "psm", p_chars, m_chars - p_chars, [PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle]


def _stream(frames: Frames, parts: list[bytes | tuple[int, int]]) -> Iterator[bytes]:
    for x in parts:
        if isinstance(x, bytes):
            yield x
        elif x[0] < x[1]:
            yield from frames.read(*x)


def _regroup(stream: Iterable[bytes], compress: Callable[[bytes], bytes], digest, size: int) -> list[dict]:
    """The stream in frames of `size` bytes, its bytes added to the digest."""
    out, held, at = [], bytearray(), 0
    for part in stream:
        digest.update(part)
        held += part
        while len(held) >= size:
            out.append({"bytes": at, "data": compress(bytes(held[:size]))})
            at += size
            del held[:size]
    if held:
        out.append({"bytes": at, "data": compress(bytes(held))})
    return out


def fill_in_middle(frames: DataFrame, seed: int = 1, size: int = FRAME, level: int = 1) -> DataFrame:
    """The transformed text of each document in frames of text_frames(): doc_id, n, form, prefix_chars, middle_chars, output_sha256, output.

    Texts that are empty or hold a marker, and a tenth of all, stay plain. `output` is a list of compressed frames with the bytes
    before each; output_texts() makes strings of them.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compress, decompress = zstandard.ZstdCompressor(level=level).compress, zstandard.ZstdDecompressor().decompress
        for b in batches:
            rows = []
            for i in range(b.num_rows):
                r = {c: b.column(c)[i].as_py() for c in ("doc_id", "n", "n_bytes", "n_chars", "marked", "frames")}
                own = Frames(r["frames"], decompress)
                form, prefix, middle, parts = plan_of(r["doc_id"], r["n"], r["n_bytes"], r["n_chars"], r["marked"], own, seed)
                digest = hashlib.sha256()
                out = _regroup(_stream(own, parts), compress, digest, size)
                rows.append((r["doc_id"], r["n"], form, prefix, middle, digest.hexdigest(), out))
            yield _batch(rows)

    return frames.mapInArrow(run, _OUTPUTS)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"doc_id": pa.int64(), "n": pa.int64(), "form": pa.string(), "prefix_chars": pa.int64(), "middle_chars": pa.int64(), "output_sha256": pa.string(), "output": _OUTPUT_TYPE}
    return pa.record_batch({c: pa.array([r[k] for r in rows], t) for k, (c, t) in enumerate(kinds.items())})


def original(form: str, output: Frames) -> Iterator[bytes]:
    """The text that an output was made of, read from the output alone."""
    if form == "plain":
        yield from output.read()
        return
    second, third = (SUFFIX, MIDDLE) if form == "psm" else (PREFIX, MIDDLE)
    a = output.find(second, 3)
    b = output.find(third, a + 3)
    one, two, rest = (3, a), (a + 3, b), (b + 3, None)
    prefix, middle, suffix = (one, rest, two) if form == "psm" else (two, rest, one)
    for lo, hi in (prefix, middle, suffix):
        if hi is None or lo < hi:
            yield from output.read(lo, hi)


def restored_digests(outputs: DataFrame) -> DataFrame:
    """Rows of fill_in_middle() with restored_sha256, the digest of the text rebuilt from output and form, instead of the output."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decompress = zstandard.ZstdDecompressor().decompress
        for b in batches:
            digests = []
            for form, out in zip(b.column("form").to_pylist(), b.column("output")):
                digest = hashlib.sha256()
                for part in original(form, Frames(out.as_py(), decompress)):
                    digest.update(part)
                digests.append(digest.hexdigest())
            keep = ("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256")
            yield pa.record_batch({c: b.column(c) for c in keep} | {"restored_sha256": pa.array(digests, pa.string())})

    return outputs.mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string")


def output_texts(outputs: DataFrame) -> DataFrame:
    """doc_id, form and output as a string."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decompress = zstandard.ZstdDecompressor().decompress
        for b in batches:
            texts = [b"".join(Frames(o.as_py(), decompress).read()).decode() for o in b.column("output")]
            yield pa.record_batch({"doc_id": b.column("doc_id"), "form": b.column("form"), "output": pa.array(texts, pa.string())})

    return outputs.mapInArrow(run, "doc_id long, form string, output string")


def fim_documents(docs: DataFrame, seed: int = 1) -> DataFrame:
    """Forms, cuts and digests of all documents, in the order of text_frames(), fill_in_middle() and restored_digests().

    A unit is a run of A-Z and a-z or any other code point. Null texts are empty (plain), a null doc_id is hashed as the
    empty string, repeated rows count each, an empty table gives no rows. Other columns are left out.
    """
    return restored_digests(fill_in_middle(stored(text_frames(docs), "frames", codec="none"), seed))


def op13_fill_in_middle(spark, sf_dir) -> DataFrame:
    return fim_documents(read_table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (SELECT doc_id, t, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') AS units, list_transform([1, 9, 17, 25], lambda i: CAST('0x' || substr(h, i, 8) AS BIGINT)) AS r FROM d),
c AS (SELECT doc_id, t, units, len(units) AS n, least(r[1] % (len(units) + 1), r[2] % (len(units) + 1)) AS a, greatest(r[1] % (len(units) + 1), r[2] % (len(units) + 1)) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR r[3] % 100 >= 90 THEN 'plain' WHEN r[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT doc_id, t, n, form, coalesce(array_to_string(units[1:a], ''), '') AS prefix, coalesce(array_to_string(units[a + 1:b], ''), '') AS middle, coalesce(array_to_string(units[b + 1:n], ''), '') AS suffix FROM c)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(t) AS restored_sha256 FROM p"""
