"""Benchmark decontamination: rare n-gram seeds join passages to test items, Smith-Waterman alignment scores them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loreforge.llm.common import ALNUM, free_name, gram_hashes, join_counted, read_table, stored, word_batches

GRAM = 4
MATCH, MISMATCH, GAP = 2, -1, -1
#: Bits of the filter through which grams of the documents go before they are joined: 64 for each seed, from 8 KB to 8 MB.
#: Beyond that more grams that are no seeds pass, which the join drops.
LEAST_BITS, MOST_BITS = 16, 26
REGION_WORDS = 1 << 16  # words of a document that go on together at most, or four test items' length

# ---------------------------------------------------------------- alignment


def smith_waterman(item: np.ndarray, words: np.ndarray) -> tuple[int, int]:
    """Best local score of two word sequences, and the end (exclusive) of the aligned part of `words`."""
    n = len(words)
    ramp = np.arange(n, dtype=np.int64) * -GAP
    h = np.zeros(n, dtype=np.int64)
    best, end = 0, 0
    for w in item:
        diagonal = np.r_[0, h[:-1]] + np.where(words == w, MATCH, MISMATCH)
        t = np.maximum(np.maximum(diagonal, h + GAP), 0)
        h = np.maximum.accumulate(t + ramp) - ramp  # gaps along the text, of any length
        k = int(np.argmax(h))
        if h[k] > best:
            best, end = int(h[k]), k + 1
    return best, end


def align(item: np.ndarray, words: np.ndarray) -> tuple[int, int, int]:
    """Score, start and end of the best local alignment within `words`."""
    score, end = smith_waterman(item, words)
    back = smith_waterman(item[::-1], words[:end][::-1])[1] if score else 0
    return score, end - back, end


def least_score(length: int, ratio: float) -> float:
    """What an item of this length must reach: `ratio` of a full match, and of short items eight words or four fifths."""
    return max(ratio * MATCH * length, min(8 * MATCH, 0.8 * MATCH * length))


# ---------------------------------------------------------------- seeds


def _lower(col) -> list[bytes]:
    return [(t or "").lower().encode() for t in col.to_pylist()]


def _item_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Test items of GRAM words or more, with the hashes of their words."""
    for b in batches:
        ids = b.column("item_id").to_pylist()
        out: dict[str, list] = {"item_id": [], "length": [], "words": []}
        for lo, _, _, _, h, first in word_batches(_lower(b.column("text")), ALNUM):
            for k in range(len(first) - 1):
                w = h[first[k] : first[k + 1]]
                if len(w) >= GRAM:
                    for c, v in zip(out.values(), (ids[lo + k], len(w), w.astype("<u8").tobytes()), strict=True):
                        c.append(v)
        yield pa.RecordBatch.from_pydict({"item_id": pa.array(out["item_id"], pa.int64()), "length": pa.array(out["length"], pa.int64()), "words": pa.array(out["words"], pa.binary())})


def class_of(length: int) -> int:
    """Items are of the class k whose length_of(k) is the first that isn't under theirs."""
    k = 0
    while length_of(k) < length:
        k += 1
    return k


def length_of(k: int) -> int:
    return 32 << 2 * k


def _seed_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for item, w in zip(b.column("item").to_pylist(), b.column("words").to_pylist(), strict=True):
            g = gram_hashes(np.frombuffer(w, dtype="<u8"), GRAM)
            yield pa.RecordBatch.from_pydict({"item": pa.array([item] * len(g), pa.int64()), "seed": pa.array(g.view(np.int64)), "pos": pa.array(np.arange(len(g))), "class": pa.array(np.full(len(g), class_of(len(g) + GRAM - 1), dtype=np.int32))})


class SeedFilter:
    """Which grams may be seeds: a bit array with three bits for each seed."""

    def __init__(self, bits: int, chunks: dict[int, bytes]):
        self.bits = bits
        self.array = np.zeros(1 << max(0, bits - 3), dtype=np.uint8)
        for k, c in chunks.items():
            self.array[k * len(c) : (k + 1) * len(c)] = np.frombuffer(c, dtype=np.uint8)

    @staticmethod
    def places(bits: int) -> list[int]:
        """By how many bits a hash is moved to the right for each of its three places."""
        return [64 - bits, (64 - bits) // 2, 0]

    def may_hold(self, grams: np.ndarray) -> np.ndarray:
        """Numbers of the grams all of whose bits are set."""
        at = np.arange(len(grams))
        for shift in self.places(self.bits):
            p = ((grams[at] >> np.uint64(shift)) & np.uint64((1 << self.bits) - 1)).astype(np.int64)
            at = at[(self.array[p >> 3] >> (p & 7).astype(np.uint8) & 1).astype(bool)]
        return at


def seed_filter(seeds: DataFrame, spare: int = 0) -> SeedFilter:
    """As sparse as 64 bits a seed, or `spare` doublings more. Built in executors in chunks of 64 KB; what the driver gets is bounded by MOST_BITS."""
    n = seeds.count()
    bits = min(MOST_BITS, max(LEAST_BITS, (64 * n).bit_length() + spare))
    width = min(bits, 19)
    places = F.array(*[F.shiftrightunsigned("seed", s).bitwiseAND((1 << bits) - 1) for s in SeedFilter.places(bits)])
    p = seeds.select(F.explode(places).alias("p")).select(F.shiftright("p", width).alias("chunk"), F.col("p").bitwiseAND((1 << width) - 1).alias("p")).distinct()

    def fold(table: pa.Table) -> pa.Table:
        b = np.zeros(1 << (width - 3), dtype=np.uint8)
        at = table.column("p").to_numpy()
        np.bitwise_or.at(b, at >> 3, np.left_shift(1, at & 7).astype(np.uint8))
        return pa.table({"chunk": table.column("chunk").slice(0, 1), "b": pa.array([b.tobytes()], pa.binary())})

    return SeedFilter(bits, {r["chunk"]: r["b"] for r in p.groupBy("chunk").applyInArrow(fold, "chunk long, b binary").collect()})


def _document_grams(texts: list[bytes]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For groups of texts: number of the first, words, first words of the texts, grams (0 where one would go over a text's end)."""
    for lo, _, _, _, h, first in word_batches(texts, ALNUM):
        g = gram_hashes(h, GRAM)
        for k in range(1, GRAM):  # places less than GRAM words before a text's end
            at = first[1:-1] - k
            g[at[(at >= 0) & (at < len(g))]] = 0
        yield lo, h, first, g


def _count_rows(known: SeedFilter):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hits = [g[known.may_hold(g)] for _, _, _, g in _document_grams(_lower(b.column("text")))]
            seed, n = np.unique(np.concatenate(hits) if hits else np.empty(0, np.uint64), return_counts=True)
            yield pa.RecordBatch.from_pydict({"seed": pa.array(seed.view(np.int64)), "n": pa.array(n)})

    return run


# ---------------------------------------------------------------- passages

_REGIONS = "doc_id long, h1 long, h2 long, row long, start long, words binary, hits array<struct<seed: bigint, at: bigint>>"


def _region_rows(classes: list[tuple[SeedFilter, int]]):
    """Stretches of documents around grams that may be rare seeds, as wide as the longest item that has the seed needs.

    classes: filters of the seeds of items up to a length, and that length. Each class has its own stretches, so a long item doesn't
    widen those of others.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = [b.column(c).to_pylist() for c in ("doc_id", "h1", "h2", "row")]
            rows: list[tuple] = []
            for lo, h, first, g, known, longest in ((*d, *c) for d in _document_grams(_lower(b.column("text"))) for c in classes):
                reach = longest + longest // 4 + 2
                most = max(REGION_WORDS, 4 * reach)
                at = known.may_hold(g)
                owner = np.searchsorted(first, at, side="right") - 1
                i = 0
                while i < len(at):
                    k, j = owner[i], i + 1
                    a, z = first[k], first[k + 1]
                    begin = max(a, at[i] - reach)
                    while j < len(at) and owner[j] == k and at[j] - reach <= at[j - 1] + reach and at[j] + reach - begin <= most:
                        j += 1
                    end = min(z, at[j - 1] + reach)
                    hits = [{"seed": s, "at": p} for s, p in zip(g[at[i:j]].view(np.int64).tolist(), (at[i:j] - begin).tolist(), strict=True)]
                    rows.append((*(c[lo + k] for c in ids), int(begin - a), h[begin:end].astype("<u8").tobytes(), hits))
                    i = j
            cols = list(zip(*rows, strict=True)) if rows else [()] * 7
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.struct([("seed", pa.int64()), ("at", pa.int64())])))
            yield pa.RecordBatch.from_pydict({n: pa.array(c, t) for n, c, t in zip(("doc_id", "h1", "h2", "row", "start", "words", "hits"), cols, kinds, strict=True)})

    return run


def best_passage(item: np.ndarray, words: np.ndarray, begins: list[int]) -> tuple[int, int, int, int]:
    """Score, start, end and seeds of the best alignment of an item, in stretches around the places at which seeds let it begin."""
    pad, best, i = len(item) // 4 + 2, (0, 0, 0, 0), 0
    begins = sorted(begins)
    while i < len(begins):
        lo, hi, j = begins[i] - pad, begins[i] + len(item) + pad, i + 1
        while j < len(begins) and begins[j] - pad <= hi:
            hi = begins[j] + len(item) + pad
            j += 1
        lo = max(0, lo)
        score, a, b = align(item, words[lo:hi])
        if score > best[0]:
            best = (score, lo + a, lo + b, j - i)
        i = j
    return best


_MATCHES = "doc_id long, h1 long, h2 long, row long, item long, item_id long, score double, first_word long, end_word long, n_seeds long"


def _match_rows(ratio: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for r in zip(*(b.column(c).to_pylist() for c in ("doc_id", "h1", "h2", "row", "item", "item_id", "start", "words", "item_words", "begins")), strict=True):
                words, item = (np.frombuffer(w, dtype="<u8") for w in r[7:9])
                score, a, z, n = best_passage(item, words, r[9])
                if score >= least_score(len(item), ratio):
                    rows.append((*r[:6], score / (MATCH * len(item)), r[6] + a, r[6] + z, n))
            cols = list(zip(*rows, strict=True)) if rows else [()] * 10
            names = [x.split()[0] for x in _MATCHES.split(", ")]
            yield pa.RecordBatch.from_pydict({n: pa.array(c, pa.float64() if n == "score" else pa.int64()) for n, c in zip(names, cols, strict=True)})

    return run


# ---------------------------------------------------------------- operator


def _matches(docs: DataFrame, benchmark: DataFrame, ratio: float, rare_share: float, least_seeds: int) -> DataFrame:
    """_MATCHES: see find_contamination; h1 and h2 are hashes of the text, row is a number of the document's row."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").mapInArrow(_item_rows, "item_id long, length long, words binary")
    items = stored(rows.withColumn("item", F.monotonically_increasing_id()), "test-items")
    seeds = stored(items.select("item", "words").mapInArrow(_seed_rows, "item long, seed long, pos long, class int"), "test-seeds")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2"))

    # how often each seed stands in the documents, and of each item the seeds that are rarest there
    counts = docs.select("text").mapInArrow(_count_rows(seed_filter(seeds)), "seed long, n long").groupBy("seed").agg(F.sum("n").alias("n"))
    shared = seeds.groupBy("seed").agg(F.count("*").alias("k"))
    counts = stored(shared.join(counts.hint("merge"), "seed", "left").select("seed", F.coalesce("n", F.lit(0)).alias("n"), "k"), "seed-counts")
    ranked = join_counted(seeds, counts, ["seed"], "k").withColumn("rank", F.row_number().over(W.partitionBy("item").orderBy(F.col("n") + F.col("k"), "pos")))
    ranked = ranked.withColumn("size", F.count("*").over(W.partitionBy("item")))
    rare = ranked.where(F.col("rank") <= F.greatest(F.ceil(rare_share * F.col("size")), F.lit(least_seeds)))
    rare = stored(rare.groupBy("seed").agg(F.max("n").alias("n"), F.max("class").alias("class"), F.collect_list(F.struct("item", "pos")).alias("places")), "seeds-rare")

    kinds = sorted(r[0] for r in rare.select("class").distinct().collect())  # powers of four up to the longest item
    # a gram that isn't a seed costs a stretch, so filters of longer items are sparser
    classes = [(seed_filter(rare.where(F.col("class") == k).select("seed"), 2 * k), length_of(k)) for k in kinds]
    found = docs.withColumn("row", F.monotonically_increasing_id()).mapInArrow(_region_rows(classes), _REGIONS)
    regions = stored(found.withColumn("region", F.monotonically_increasing_id()), "passages")
    hits = join_counted(regions.select("region", F.explode("hits").alias("x")).select("region", "x.*"), rare.drop("class"), ["seed"], "n")
    hits = hits.select("region", "at", F.explode("places").alias("p")).groupBy("region", "p.item").agg(F.collect_set(F.col("at") - F.col("p.pos")).alias("begins"))
    hits = stored(hits, "passages-seeded")
    per_item = hits.groupBy("item").agg(F.count("*").alias("k"))
    wanted = stored(items.join(per_item.hint("merge"), "item").select("item", "item_id", F.col("words").alias("item_words"), "k"), "items-seeded")
    pairs = join_counted(hits, wanted, ["item"], "k").drop("k")
    scored = regions.drop("hits").join(pairs.hint("merge"), "region").mapInArrow(_match_rows(ratio), _MATCHES)
    best = F.max_by(F.struct("score", "first_word", "end_word", "n_seeds"), F.struct("score", -F.col("first_word"))).alias("b")
    return scored.groupBy("doc_id", "h1", "h2", "row", "item", "item_id").agg(best).select("doc_id", "h1", "h2", "row", "item", "item_id", "b.*")


def find_contamination(docs: DataFrame, benchmark: DataFrame, ratio: float = 0.5, rare_share: float = 0.75, least_seeds: int = 8) -> DataFrame:
    """(doc_id, item_id, score, first_word, end_word, n_seeds): passages of documents that align with test items.

    Words are lower-cased runs of letters, digits and all that isn't ASCII. An item's seeds are its four-word grams; the
    rare_share of them that is rarest over all documents and items (least_seeds at least) is joined to the documents' grams.
    Around the seeds the text is aligned word by word; score is the best alignment's over that of a full copy, and at
    least `ratio` (items of under 16 words must reach more). One row for each document and item, the best passage; all its
    words count from 0. Items of under four words have no seeds and match nothing, nor do null or empty texts. Rows that
    repeat a document or an item repeat its matches; a null doc_id stays null. Empty tables give no rows.
    """
    return _matches(docs, benchmark, ratio, rare_share, least_seeds).select("doc_id", "item_id", "score", "first_word", "end_word", "n_seeds")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, ratio: float = 0.5, rare_share: float = 0.75, least_seeds: int = 8) -> DataFrame:
    """The rows of docs without those in whose text a test item is found, with all their columns.

    Rows are judged by their texts, whatever their doc_id.
    """
    hit = stored(_matches(docs, benchmark, ratio, rare_share, least_seeds).select("h1", "h2").distinct(), "contaminated")
    a, b = free_name("h1", docs.columns), free_name("h2", docs.columns)
    keyed = docs.withColumns({a: F.xxhash64("text"), b: F.xxhash64(F.lit(1), "text")})
    hit = hit.withColumnsRenamed({"h1": a, "h2": b})
    # 16 bytes a row: up to 200,000 rows go to all tasks, more meet by shuffle
    hit = F.broadcast(hit) if hit.count() <= 200_000 else hit.hint("merge")
    return keyed.join(hit, [a, b], "left_anti").select(*docs.columns)


def op2_decontamination(spark, sf_dir) -> DataFrame:
    return find_contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
