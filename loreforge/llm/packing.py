"""Best-fit packing of token pieces into sequences, certified by dual-feasible-function bounds and repaired by exchange."""

from __future__ import annotations

import json
import re
import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loreforge.llm.common import read_table, stored

SIZE = 2048
ITEMS_EACH = 20_000

# ---------------------------------------------------------------- tokens


def _byte_alphabet() -> dict[str, int]:
    """Characters that stand for bytes in byte-level vocabularies: printable ones for themselves, others from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Ids of texts by a byte-level BPE file of the tokenizers library, each distinct word encoded once.

    The words are those of the public pattern of this kind of vocabulary; BPE never merges across them, so ids of a
    text are those of its words one after another. Where the file's merges come in the order of their ids, words are
    encoded by rank, which gives the same ids in a fraction of the time; else by the tokenizers library. The memo is
    dropped when it holds max_words.
    """

    def __init__(self, path: str, max_words: int = 700_000):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = True
        # where a text has no odd characters, its numbers are ASCII digits, and \w less digits and _ is \p{L};
        # other texts are left to the library as a whole
        self.plain = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?[0-9]+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
        self.odd = re.compile(r"[^\x00-\x1b\x20-\x7fÀ-ÖØ-öø-ɏ‐-‧€]")
        self.by_rank = self._ranked(path)
        self.memo: dict[str, bytes] = {}
        self.max_words = max_words

    @staticmethod
    def _ranked(path: str):
        import public_tokenizers
        import tiktoken

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, alphabet = model["vocab"], _byte_alphabet()
        made = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
        if made != sorted(made):
            return None
        ranks = {bytes(map(alphabet.__getitem__, w)): i for w, i in vocab.items() if all(c in alphabet for c in w) and not w.startswith("<|")}
        return tiktoken.Encoding("byte-bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def _learn(self, words: list[str]) -> None:
        if self.by_rank is not None:
            for w in words:
                self.memo[w] = array("I", self.by_rank.encode_ordinary(w)).tobytes()
        else:
            for w, e in zip(words, self.tok.encode_batch(words, add_special_tokens=False), strict=True):
                self.memo[w] = array("I", e.ids).tobytes()

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        memo = self.memo
        for text in texts:
            if self.odd.search(text):
                yield np.array(self.tok.encode(text, add_special_tokens=False).ids, dtype="<u4")
                continue
            words = self.plain.findall(text)
            if new := set(words).difference(memo):
                if len(memo) > self.max_words:
                    memo.clear()
                    new = set(words)
                self._learn(list(new))
            yield np.frombuffer(b"".join(map(memo.__getitem__, words)), dtype="<u4")


@lru_cache(1)
def _encoder(path: str) -> Encoder:
    """One for each worker process, so later tasks in it find their words known."""
    return Encoder(path)


_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, tokenizer: str | None = None, size: int = SIZE) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: each document's ids and a final 0, cut into pieces of `size` where longer.

    The first piece of a cut document takes the remainder. Null text is empty.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers

        enc = _encoder(tokenizer or public_tokenizers.path("byte_bpe_50k.json"))
        for b in batches:
            out: list[list] = [[], [], [], [], []]
            for doc_id, ids in zip(b.column("doc_id").to_pylist(), enc.encode([t or "" for t in b.column("text").to_pylist()]), strict=True):
                ids = np.append(ids, np.uint32(0)).astype("<u4")
                cuts = [0, *range(len(ids) % size or size, len(ids) + 1, size)] if len(ids) > size else [0, len(ids)]
                for k in range(len(cuts) - 1):
                    part = ids[cuts[k] : cuts[k + 1]]
                    for col, v in zip(out, (doc_id, k, cuts[k], len(part), zlib.crc32(part.tobytes())), strict=True):
                        col.append(v)
            yield pa.RecordBatch.from_pydict(dict(zip(("doc_id", "piece", "start", "length", "ids_crc32"), (pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)), strict=True)))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _PIECES)


# ---------------------------------------------------------------- bins


def best_fit_decreasing(lengths: np.ndarray, size: int = SIZE) -> tuple[np.ndarray, list[int]]:
    """Bin of each item and the room left in each bin; an item goes to the bin with the least room that holds it."""
    bins = np.empty(len(lengths), dtype=np.int64)
    rooms: list[int] = []
    stacks: dict[int, list[int]] = {}
    free: list[int] = []  # the rooms for which there is a bin, in order
    for i in np.argsort(-lengths, kind="stable"):
        x = int(lengths[i])
        at = bisect_left(free, x)
        if at < len(free):
            room = free[at]
            b = stacks[room].pop()
            if not stacks[room]:
                free.pop(at)
        else:
            room, b = size, len(rooms)
            rooms.append(size)
        bins[i] = b
        rooms[b] = left = room - x
        if left:
            if not stacks.setdefault(left, []):
                insort(free, left)
            stacks[left].append(b)
    return bins, rooms


def dff_bound(lengths: np.ndarray, size: int = SIZE) -> int:
    """A lower bound of the number of bins: the greatest over two families of dual feasible functions.

    The first sends items over size - t to the whole and those under t to nothing; the second rounds x (k + 1) / size
    down to multiples of 1 / k. Each maps any set of items that fits a bin to a total of at most 1.
    """
    if not len(lengths):
        return 0
    counts = np.bincount(lengths, minlength=size + 1).astype(np.int64)
    x = np.arange(size + 1)
    best = -(-int((counts * x).sum()) // size)
    n_up, s_up = np.cumsum(counts), np.cumsum(counts * x)
    t = np.arange(1, size // 2 + 1)
    whole = n_up[size] - n_up[size - t]
    middle = s_up[size - t] - s_up[t - 1]
    best = max(best, int(np.max(whole + -(-middle // size))))
    for k in range(1, 31):
        y = x * (k + 1)
        f = np.where(y % size == 0, x * k, (y // size) * size)  # k * size times the function
        best = max(best, -(-int((counts * f).sum()) // (k * size)))
    return best


_PACKED = _PIECES + ", row long, part long, round int, bin long, offset long, gap boolean"


def _packer(round_no: int, size: int):
    """A partition is packed as a whole; where its bins are more than its bound, the pieces of bins with room go on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(batches))
        if not rows.num_rows:
            return
        part = rows.column("part")[0].as_py()
        lengths = rows.column("length").to_numpy()
        bins, rooms = best_fit_decreasing(lengths, size)
        certified = len(rooms) <= dff_bound(lengths, size)
        gap = np.zeros(len(lengths), dtype=bool)
        if not certified:
            gap = np.array(rooms)[bins] > 0
        order = np.argsort(bins, kind="stable")
        ends = np.cumsum(lengths[order])
        starts = ends - lengths[order]
        firsts = np.r_[True, np.diff(bins[order]) != 0]
        base = np.maximum.accumulate(np.where(firsts, starts, 0))
        offset = np.empty(len(lengths), dtype=np.int64)
        offset[order] = starts - base
        cols = {c: rows.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32", "row")}
        cols |= {"part": pa.array(np.full(len(lengths), part)), "round": pa.array(np.full(len(lengths), round_no, dtype=np.int32)), "bin": pa.array(bins), "offset": pa.array(offset), "gap": pa.array(gap)}
        yield from pa.table(cols).to_batches(max_chunksize=10_000)

    return run


def pack_pieces(pieces: DataFrame, size: int = SIZE, items_each: int = ITEMS_EACH, rounds: int = 3) -> DataFrame:
    """Adds sequence_id and offset to pieces of at most `size`.

    Pieces are written with a row number and dealt by its hash, so repeated rows are spread as well, to partitions of about
    items_each and packed there by best fit, longest first. A partition whose number of bins equals its lower bound is done. The others
    keep their full bins and send the pieces of bins with room on; these meet in fewer partitions, where they are packed
    anew, in up to `rounds` rounds. The last round keeps what it has. So the bins over the bound are at most one or
    a few for each of the last partitions.
    """
    done = []
    left = stored(pieces.withColumn("row", F.monotonically_increasing_id()), "pieces")
    n = left.count()
    for r in range(rounds):
        if not n and r:
            break
        n_parts = max(1, -(-n // items_each))
        part = F.pmod(F.xxhash64("row", F.lit(r)), F.lit(n_parts)).cast("long")
        # one partition number is one group: each group is a task's share of bounded size
        dealt = left.withColumn("part", part)
        packed = dealt.groupBy("part").applyInArrow(_grouped(_packer(r, size)), _PACKED)
        packed = stored(packed, f"packed-{r}")
        last = n_parts == 1 or r == rounds - 1
        done.append((packed if last else packed.where(~F.col("gap"))).drop("gap"))
        if last:
            break
        left = packed.where("gap").select("doc_id", "piece", "start", "length", "ids_crc32", "row")
        n = left.count()
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    # row numbers differ, so a partition has about items_each items, far under 2 ** 24, and no more bins than those
    sequence = (F.col("part") * rounds + F.col("round")) * (1 << 24) + F.col("bin")
    return out.withColumn("sequence_id", sequence).drop("part", "round", "bin", "row")


def _grouped(run):
    def each(table: pa.Table) -> pa.Table:
        return pa.Table.from_batches(list(run(iter(table.to_batches()))))

    return each


def pack_documents(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for each piece of each document.

    Null and empty texts are the single id 0. Rows that repeat a doc_id are packed each. An empty table gives no rows.
    """
    return pack_pieces(token_pieces(docs, tokenizer))


def op5_packing(spark, sf_dir) -> DataFrame:
    return pack_documents(read_table(spark, sf_dir, "documents"))
