"""Substring search without a scan of the texts: positional postings of three-character grams, intersected."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loreforge.functions.text import col

#: Characters of a gram; a code point has 21 bits, so three are told apart by one number.
GRAM, BITS = 3, 21
#: Stands between fields of a text: no query holds it, so no match goes over it.
FIELD = "\u0000"


def grams_of(text: str) -> np.ndarray:
    """The number of the gram at each place of the text."""
    x = np.frombuffer(text.encode("utf-32-le"), dtype="<u4").astype(np.int64)
    n = max(0, len(x) - GRAM + 1)
    return (x[:n] << 2 * BITS) | (x[1 : n + 1] << BITS) | x[2 : n + 2]


#: Characters of a segment: texts that are indexed together, by one task and in memory.
SEGMENT = 2 << 20
#: In place of a gram: the row that tells a segment's texts.
TEXTS = -1


def _sorted_places(codes: np.ndarray, grams: np.ndarray) -> np.ndarray:
    """Places of the grams by gram, those of one in order."""
    letters = np.zeros(1 << BITS, dtype=bool)
    letters[codes] = True
    n = int(letters.sum())
    if n**GRAM >= 1 << 32:
        return np.argsort(grams, kind="stable")
    code = (np.cumsum(letters, dtype=np.uint32) - np.uint32(1))[codes]  # the same order in 32 bits, of which 16 are sorted at once
    number = (code[: len(grams)] * np.uint32(n) + code[1 : len(grams) + 1]) * np.uint32(n) + code[2 : len(grams) + 2]
    order = np.argsort(number.astype(np.uint16), kind="stable")
    return order[np.argsort((number >> np.uint32(16)).astype(np.uint16)[order], kind="stable")]


def _packed(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the numbers, seven bits in each and the lowest first, and where each number begins."""
    sizes = np.ones(len(numbers), dtype=np.int64)
    for bits in range(7, int(numbers.max(initial=0)).bit_length(), 7):
        sizes += numbers >= 1 << bits
    at = np.r_[0, np.cumsum(sizes)]
    out = np.empty(at[-1], dtype=np.uint8)
    for k in range(int(sizes.max(initial=0))):
        more = sizes > k
        out[at[:-1][more] + k] = (numbers[more] >> 7 * k) & 127 | np.where(sizes[more] > k + 1, 128, 0)
    return out, at


def _unpacked(packed: bytes) -> np.ndarray:
    b = np.frombuffer(packed, np.uint8)
    last = np.flatnonzero(b < 128)
    if not len(last):
        return np.empty(0, np.int64)
    starts = np.r_[0, last[:-1] + 1]
    k = np.arange(len(b)) - np.repeat(starts, np.diff(np.r_[starts, len(b)]))
    return np.add.reduceat((b & 127).astype(np.int64) << 7 * k, starts)


def _segment(texts: list[str], keys: dict[str, pa.Array], number: int) -> pa.RecordBatch:
    """A row for each different gram of the texts with its places in them, one after another, as packed gaps; before these, one with their keys and lengths."""
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), dtype="<u4")
    x = codes.astype(np.int64)
    grams = (x[:-2] << 2 * BITS) | (x[1:-1] << BITS) | x[2:]
    inside = np.ones(len(grams), dtype=bool)
    ends = np.cumsum(lengths)
    for back in range(1, GRAM):  # places too near the end of their text
        at = (ends - back)[lengths >= back]
        inside[at[at < len(grams)]] = False
    order = _sorted_places(codes, grams) if len(grams) else np.empty(0, np.int64)
    order = order[inside[order]]
    found = grams[order]
    cuts = np.flatnonzero(np.r_[True, found[1:] != found[:-1]]) if len(found) else np.empty(0, np.int64)
    gaps = np.diff(order, prepend=0)
    gaps[cuts] = order[cuts]
    places, at = _packed(np.r_[lengths, gaps])
    offsets = np.r_[0, at[len(texts) + np.r_[cuts, len(gaps)]]].astype("<i4")
    n = len(cuts) + 1
    return pa.record_batch({
        "gram": pa.array(np.r_[TEXTS, found[cuts]]),
        "segment": pa.array(np.full(n, number)),
        "places": pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(places)]),
        **{k: pa.ListArray.from_arrays(pa.array(np.r_[0, np.full(n, len(texts))].astype(np.int32)), v) for k, v in keys.items()},
    })


def build_text_index(rows: DataFrame, key: list[str], text: Column | str, path: str, parts: int | None = None) -> DataFrame:
    """Writes the index of the texts to a folder and reads it back: (gram, segment, places, key columns).

    A task indexes its own texts, SEGMENT characters or so at a time, so nothing is shuffled: a segment has a row for each different
    gram, in order, with the gaps between its places in a byte or two each. Pages of the files hold few grams, and a search reads
    those of its own. With `parts` the texts are dealt to as many tasks first.
    """
    names = [f"k{i}" for i in range(len(key))]
    given = rows.select(*[F.col(k).alias(n) for k, n in zip(key, names)], F.coalesce(col(text), F.lit("")).alias("t"))
    given = given.repartition(parts) if parts else given
    kinds = [given.schema[n].dataType.simpleString() for n in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        texts, keys, size = [], [], 0

        def out() -> pa.RecordBatch:
            return _segment(texts, {n: pa.concat_arrays([k.column(n) for k in keys]) for n in names}, number)

        for b in batches:
            first = 0
            for i, t in enumerate(b.column("t").to_pylist(), 1):
                texts.append(t)
                size += len(t)
                if size >= SEGMENT or i == b.num_rows:
                    keys.append(b.slice(first, i - first))
                    first = i
                if size >= SEGMENT:
                    yield out()
                    texts, keys, size, number = [], [], 0, number + 1
        if texts:
            yield out()

    schema = ", ".join(["gram long, segment long, places binary", *(f"{n} array<{t}>" for n, t in zip(names, kinds))])
    index = given.mapInArrow(run, schema).select("gram", "segment", "places", *[F.col(n).alias(k) for k, n in zip(key, names)])
    index.write.mode("overwrite").option("compression", "zstd").option("parquet.page.row.count.limit", 500).parquet(path)
    return rows.sparkSession.read.parquet(path)


def find_texts(index: DataFrame, key: list[str], query: str) -> DataFrame:
    """Keys of the texts that hold the query, once each: those in which all its grams stand at places that fit. No text is read.

    The query has three characters or more.
    """
    if len(query) < GRAM:
        raise ValueError(f"an index of grams of {GRAM} characters doesn't tell texts with shorter strings")
    at: dict[int, list[int]] = {}
    for i, g in enumerate(grams_of(query).tolist()):
        at.setdefault(g, []).append(i)
    names = [f"k{i}" for i in range(len(key))]
    rows = index.where(F.col("gram").isin([TEXTS, *at])).select("gram", "segment", "places", *[F.col(k).alias(n) for k, n in zip(key, names)])
    kinds = ", ".join(f"{n} {index.schema[k].dataType.elementType.simpleString()}" for n, k in zip(names, key))

    def run(segment: pa.Table) -> pa.Table:
        grams = segment.column("gram").to_pylist()
        place = {g: i for i, g in enumerate(grams)}
        lists = segment.column("places")
        starts = None
        if at.keys() <= place.keys():
            for g in sorted(at, key=lambda g: len(lists[place[g]].as_buffer())):  # the rarest first
                places = np.cumsum(_unpacked(lists[place[g]].as_buffer()))
                for i in at[g]:
                    starts = places - i if starts is None else starts[np.isin(starts, places - i, assume_unique=True)]
        ends = np.cumsum(_unpacked(lists[place[TEXTS]].as_buffer()))
        found = np.unique(np.searchsorted(ends, starts if starts is not None else np.empty(0, np.int64), side="right"))
        of = segment.slice(place[TEXTS], 1)
        return pa.table({n: pa.chunked_array([of.column(n).combine_chunks().flatten()]).take(pa.array(found, pa.int64())) for n in names})

    found = rows.groupBy("segment").applyInArrow(run, kinds)
    return found.select(*[F.col(n).alias(k) for n, k in zip(names, key)]).distinct()
