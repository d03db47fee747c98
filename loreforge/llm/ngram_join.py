"""Exact n-gram Jaccard self-join: universe partitions and the pigeonhole principle find candidates, sets verify them.

Sets r and s with |r| <= |s| and Jaccard of at least 0.75 differ in at most (|r| + |s|) / 7 <= |r| / 3 shingles. All
shingles are hashed to m segments, m by band of sizes; so r and s agree in all but that many segments. A document gives a
signature for each segment it has shingles in, up to a cut that grows with its size, so that it has half as many again as
it may differ in: the rest of them are the same in its partner, which gives them too if its cut isn't lower. So a pair must
share a number of signatures that its sizes tell, which leaves few false candidates. Signatures that very many sets have are set aside: a set that has enough
others finds all its partners through those. Those that haven't are cut anew with one segment for each shingle
(`_undecided`). A segment's allocation is 1 (its subset), 0 (left out: it costs too many candidates) or 2 (its subset and
each one-deletion neighbour, which also finds segments that differ by one). Documents whose segments happen to be too few give all of them, and their first shingles by hash besides.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loreforge.llm.common import SPACED, discard, free_name, gram_hashes, join_counted, mix, partitions_for, read_table, stored, text_bytes, word_batches
from loreforge.llm.components import components

WORDS = 5
BAND = 3  # ratio of the sizes of a band
CLASSES, CELLS = 256, 16  # segments share cost estimates by number modulo CLASSES; CELLS counters for each
SPARSE = 63  # the band number of single-shingle signatures
SLACK = 1.5
LOW = 28  # bits of each of the two numbers of a set's units
OFTEN = 12  # a signature of more sets is set aside
_K = [np.uint64(x) for x in (0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]

# ---------------------------------------------------------------- sets


def shingle_sets(texts: list[bytes], n: int = WORDS) -> Iterator[tuple[int, list[np.ndarray]]]:
    """For groups of texts: number of the first, and the sorted distinct shingles of each."""
    for lo, _, _, _, words, first in word_batches(texts, SPACED, lower=True):
        out = []
        for k in range(len(first) - 1):
            w = words[first[k] : first[k + 1]]
            g = np.sort(gram_hashes(w, n) if len(w) >= n else gram_hashes(w, len(w)) if len(w) else w)
            out.append(g[np.r_[True, g[1:] != g[:-1]]] if len(g) else g)
        yield lo, out


def set_ids(sets: list[np.ndarray]) -> np.ndarray:
    """A 64-bit identity of each set; 0 for the empty one."""
    out = np.zeros(len(sets), dtype=np.uint64)
    for i, s in enumerate(sets):
        if len(s):
            out[i] = mix(np.array([mix(s ^ _K[0]).sum(dtype=np.uint64) + np.uint64(len(s))], dtype=np.uint64))[0]
    return out


# ---------------------------------------------------------------- bands and allocation


def band_of(size: int) -> int:
    b = 0
    while BAND ** (b + 1) <= size:
        b += 1
    return b


def bands_of(size: int) -> list[tuple[int, int]]:
    """Bands in which a set of this size gives signatures, with the number of segments it may differ in.

    In its own band its partner may be larger (size / 3); in the band below it is always the larger one (2 size / 7).
    """
    b = band_of(size)
    out = [(b, size // 3)]
    if b and 3 * size <= 4 * (BAND**b - 1):
        out.append((b - 1, 2 * size // 7))
    return out


def _needed(size: int) -> float:
    return SLACK * size / 3 + 2


@lru_cache(None)
def segments(band: int) -> int:
    """Enough segments that a set at the band's upper end has shingles in more of them than it may differ in."""
    top = BAND ** (band + 1)
    m = int(_needed(top))
    while m * (1 - math.exp(-top / m)) < _needed(top):
        m = m * 21 // 20 + 1
    return m


@lru_cache(100_000)
def cut(band: int, size: int) -> int:
    """Segments below this number give a set's signatures; it doesn't fall with the size within a band."""
    m = segments(band)
    return min(m, math.ceil(_needed(size) / (1 - math.exp(-size / m))))


def least_cut(band: int, size: int) -> int:
    """The cut of the smallest partner that a set can have in the band."""
    return cut(band, min(size, max(BAND**band, -(-3 * size // 4))))


def allocate(cells: dict[int, int], hot: float = 8.0, most: float = 0.25) -> dict[int, np.ndarray]:
    """For each band the allocation of its classes of segments, from counts of hashed subsets (cell -> documents).

    The cost of a class is the number of pairs that agree in it: the second moment of its subsets' counts, estimated
    from CELLS counters. Classes that cost over `hot` times the median are left out, the costliest share `most` at
    most, and as many of the cheapest get one-deletion neighbours instead.
    """
    table = np.zeros((SPARSE, CLASSES, CELLS))
    for cell, n in cells.items():
        table[cell // (CLASSES * CELLS), cell // CELLS % CLASSES, cell % CELLS] = n
    out = {}
    for band in range(SPARSE):
        t = table[band, : min(CLASSES, segments(band))] if band < 30 and table[band].any() else None
        if t is None:
            continue
        n = t.sum(axis=1)
        cost = np.maximum(0, ((t**2).sum(axis=1) - n**2 / CELLS) * CELLS / (CELLS - 1)) + n
        order = np.argsort(cost, kind="stable")
        over = int(min((cost > hot * np.median(cost)).sum(), most * len(order)))
        alloc = np.ones(len(order), dtype=np.int64)
        if over:
            alloc[order[-over:]] = 0
            alloc[order[:over]] = 2
        out[band] = alloc
    return out


# ---------------------------------------------------------------- signatures


class _Band:
    """Shingles of a batch's sets in the segments of one band."""

    def __init__(self, band: int, sets: list[np.ndarray], docs: list[int]):
        self.band, m = band, segments(band)
        u = np.concatenate([sets[i] for i in docs])
        d = np.repeat(np.arange(len(docs)), [len(sets[i]) for i in docs])
        seg = (mix(u ^ _K[1]) >> np.uint64(11)) % np.uint64(m)
        key = d * m + seg.astype(np.int64)
        order = np.argsort(key, kind="stable")
        key = key[order]
        self.firsts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        self.tokens = mix(u[order] ^ _K[2])
        self.sums = np.add.reduceat(self.tokens, self.firsts)
        self.counts = np.diff(np.r_[self.firsts, len(key)])
        self.doc, self.seg = key[self.firsts] // m, key[self.firsts] % m

    def signatures(self, alloc: np.ndarray, cuts: np.ndarray, least: np.ndarray, may: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, signature) and each document's units: what its segments count, 0 where that is too little to be sure of a match.

        Units hold two numbers: what the segments below the set's own cut count and, LOW bits further down, those below
        the least cut of a partner.
        """
        a = alloc[self.seg % len(alloc)]
        in_cut = self.seg < cuts[self.doc]
        useful = in_cut & (a > 0) & (self.counts >= a)
        have = np.bincount(self.doc[useful], weights=a[useful], minlength=len(cuts))
        low = useful & (self.seg < least[self.doc])
        low = np.bincount(self.doc[low], weights=a[low], minlength=len(cuts)).astype(np.int64)
        sparse = have <= may
        give = (in_cut | sparse[self.doc]) & (a > 0)
        salt = (self.seg.astype(np.uint64) + np.uint64(self.band << 40)) * _K[3]
        docs, sigs = [self.doc[give]], [mix(self.sums[give] + salt[give])]
        for i in np.flatnonzero(give & (a == 2) & (self.counts > 1)):
            t = self.tokens[self.firsts[i] : self.firsts[i] + self.counts[i]]
            docs.append(np.full(len(t), self.doc[i]))
            sigs.append(mix(self.sums[i] - t + salt[i]))
        return np.concatenate(docs), np.concatenate(sigs), np.where(sparse, 0, (have.astype(np.int64) << LOW) + low)


def batch_signatures(sets: list[np.ndarray], alloc: dict[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(number of the set, 64-bit signature, band, units) of all sets; units: what the set's segments in the band count."""
    by_band: dict[int, list[tuple[int, int, int, int]]] = {}
    for i, s in enumerate(sets):
        if len(s):
            for b, may in bands_of(len(s)):
                by_band.setdefault(b, []).append((i, cut(b, len(s)), least_cut(b, len(s)), may))
    out: list[tuple] = []
    few: set[int] = set()
    for b, members in by_band.items():
        nums = np.array([x[0] for x in members])
        d, g, units = _Band(b, sets, nums.tolist()).signatures(
            alloc.get(b, np.ones(1, dtype=np.int64)), *(np.array([x[k] for x in members]) for k in (1, 2, 3))
        )
        out.append((nums[d], g, np.full(len(d), b), units[d]))
        few.update(nums[units == 0].tolist())
    for i in few:  # two sets that both have too few segments share one of their first shingles by hash
        first = np.sort(mix(sets[i] ^ _K[1]))[: len(sets[i]) // 4 + 1]
        n = len(first)
        out.append((np.full(n, i), mix(first + np.uint64((SPARSE << 40) * int(_K[3]) & (1 << 64) - 1)), np.full(n, SPARSE), np.zeros(n, dtype=np.int64)))
    if not out:
        return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    d, g, b, u = (np.concatenate(c) for c in zip(*out, strict=True))
    return d, g, b, u


# ---------------------------------------------------------------- passes over the documents

_FIRST = "doc_id long, key long, node long, n_shingles long, cell int, weight long"


def _distinct_new(ids: np.ndarray, seen: set) -> list[int]:
    out = []
    for i, x in enumerate(ids.tolist()):
        if x and x not in seen:
            seen.add(x)
            out.append(i)
    return out


def _inventory(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each document, and the task's counts of hashed subsets by band, class and cell."""
    cells = np.zeros(SPARSE * CLASSES * CELLS, dtype=np.int64)

    def rows(n, **cols):
        types = {"doc_id": pa.int64(), "key": pa.int64(), "node": pa.int64(), "n_shingles": pa.int64(), "cell": pa.int32(), "weight": pa.int64()}
        return pa.RecordBatch.from_pydict({k: cols.get(k, pa.nulls(n, t)) for k, t in types.items()})

    for b in batches:
        texts = text_bytes(b.column("text"))
        nodes, sizes, seen = [], [], set()
        for _, sets in shingle_sets(texts):
            ids = set_ids(sets)
            nodes.append(ids)
            sizes.append(np.array([len(s) for s in sets], dtype=np.int64))
            by_band: dict[int, list[int]] = {}
            for i in _distinct_new(ids, seen):
                for band, _ in bands_of(len(sets[i])):
                    by_band.setdefault(band, []).append(i)
            for band, docs in by_band.items():
                x = _Band(band, sets, docs)
                flat = (band * CLASSES + x.seg % CLASSES) * CELLS + (mix(x.sums) >> np.uint64(60)).astype(np.int64)
                cells += np.bincount(flat, minlength=len(cells))
        node = np.concatenate(nodes) if nodes else np.empty(0, dtype=np.uint64)
        size = np.concatenate(sizes) if sizes else np.empty(0, dtype=np.int64)
        yield rows(len(texts), doc_id=b.column("doc_id"), key=b.column("key"), node=pa.array(node.view(np.int64), mask=node == 0), n_shingles=pa.array(size))
    at = np.flatnonzero(cells)
    yield rows(len(at), cell=pa.array(at.astype(np.int32)), weight=pa.array(cells[at]))


_PACKED = "bucket int, band int, nodes binary, counts binary, units binary, sigs binary"


def _signature_rows(alloc: dict[int, np.ndarray], n_buckets: int, flush: int = 800_000):
    """A row for each batch, bucket and band: sets, their numbers of signatures and units, and the signatures' low six bytes."""

    def pack(parts: list[tuple]) -> pa.RecordBatch:
        node, s, band, units = (np.concatenate(c) for c in zip(*parts, strict=True))
        bucket = ((s >> np.uint64(40)) % np.uint64(n_buckets)).astype(np.int64)
        group = bucket * 64 + band
        order = np.lexsort((node, group))
        node, s, group, units = node[order], s[order], group[order], units[order]
        cuts = np.r_[0, np.flatnonzero(np.diff(group)) + 1, len(group)]
        out: dict[str, list] = {k: [] for k in ("bucket", "band", "nodes", "counts", "units", "sigs")}
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            f = np.flatnonzero(np.r_[True, node[lo + 1 : hi] != node[lo : hi - 1]])
            out["bucket"].append(int(group[lo]) // 64)
            out["band"].append(int(group[lo]) % 64)
            out["nodes"].append(node[lo:hi][f].tobytes())
            out["counts"].append(np.diff(np.r_[f, hi - lo]).astype("<u4").tobytes())
            out["units"].append(units[lo:hi][f].astype("<u8").tobytes())
            # the bucket has the rest of what tells signatures apart
            out["sigs"].append(np.ascontiguousarray(s[lo:hi].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes())
        return pa.RecordBatch.from_pydict({k: pa.array(v, pa.int32() if k in ("bucket", "band") else pa.binary()) for k, v in out.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0
        for b in batches:
            seen: set = set()
            for _, sets in shingle_sets(text_bytes(b.column("text"))):
                node = set_ids(sets)
                keep = _distinct_new(node, seen)
                d, *rest = batch_signatures([sets[i] for i in keep], alloc)
                parts.append((node[keep][d], *rest))
                size += len(d)
                if size >= flush:
                    yield pack(parts)
                    parts, size = [], 0
        if size:
            yield pack(parts)

    return run


def _unpack(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signature with its bucket mixed in, set, and band and units in one number."""
    raw = np.frombuffer(row["sigs"], dtype=np.uint8).reshape(-1, 6)
    wide = np.zeros((len(raw), 8), dtype=np.uint8)
    wide[:, :6] = raw
    wide = wide.view("<u8") ^ mix(np.array([row["bucket"] + 1], dtype=np.uint64))
    n = np.frombuffer(row["counts"], dtype="<u4")
    meta = np.frombuffer(row["units"], dtype="<u8").astype(np.int64) + (row["band"] << 2 * LOW)
    return wide.ravel(), np.repeat(np.frombuffer(row["nodes"], dtype=np.uint64), n), np.repeat(meta, n)


_RUNS = "run long, node long, band int, units int, low int"


def _runs(batches: Iterator[pa.RecordBatch], chunk: int = 300_000) -> Iterator[pa.RecordBatch]:
    """(run, node, band, units, low) for each signature that two sets or more have.

    Signatures come in chunks. Of a signature only its first set is kept, so memory grows with the distinct ones; more
    sets of it are given on at once.
    """
    held = [np.empty(0, np.uint64), np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, bool)]

    def take(parts):
        k = len(held[0])
        s, n, meta = (np.concatenate([held[i], *(p[i] for p in parts)]) for i in range(3))
        old = np.r_[held[3], np.zeros(len(s) - k, bool)]
        fresh = np.r_[np.zeros(k, bool), np.ones(len(s) - k, bool)]
        order = np.lexsort((n, fresh, s))
        s, n, meta, old = s[order], n[order], meta[order], old[order]
        first = np.r_[True, s[1:] != s[:-1]]
        group = np.cumsum(first) - 1
        other = n != n[first][group]
        repeat = np.r_[False, (s[1:] == s[:-1]) & (n[1:] == n[:-1])]  # the same set again
        give = other & ~repeat
        many = np.bincount(group, weights=give) > 0
        out = give | (first & many[group] & ~old)
        held[:] = [s[first], n[first], meta[first], old[first] | many]
        return pa.RecordBatch.from_pydict({"run": pa.array(s[out].view(np.int64)), "node": pa.array(n[out].view(np.int64)), "band": pa.array((meta[out] >> 2 * LOW).astype(np.int32)), "units": pa.array((meta[out] >> LOW & (1 << LOW) - 1).astype(np.int32)), "low": pa.array((meta[out] & (1 << LOW) - 1).astype(np.int32))})

    parts, size = [], 0
    for b in batches:
        for k in range(b.num_rows):
            parts.append(_unpack(b.slice(k, 1).to_pylist()[0]))
            size += len(parts[-1][0])
            if size >= chunk:
                yield take(parts)
                parts, size = [], 0
    if parts:
        yield take(parts)


def _set_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        want = b.column("node").to_pylist()
        for lo, sets in shingle_sets(text_bytes(b.column("text"))):
            ids = set_ids(sets).view(np.int64)
            ok = [i for i in range(len(sets)) if ids[i] == want[lo + i]]
            yield pa.RecordBatch.from_pydict({"node": pa.array(ids[ok]), "shingles": pa.array([sets[i].tobytes() for i in ok], pa.binary())})


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keep = []
        for x, y in zip(b.column("sa"), b.column("sb"), strict=True):
            x, y = np.frombuffer(x.as_buffer(), dtype=np.uint64), np.frombuffer(y.as_buffer(), dtype=np.uint64)
            common = len(x) + len(y) - len(np.unique(np.concatenate([x, y])))
            keep.append(100 * common >= 75 * (len(x) + len(y) - common))
        yield pa.RecordBatch.from_pydict({"a": b.column("a"), "b": b.column("b"), "linked": pa.array(keep, pa.bool_())})


# ---------------------------------------------------------------- join


def _check(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, linked) for pairs of nodes."""
    a, b = sets.withColumnsRenamed({"node": "a", "shingles": "sa"}), sets.withColumnsRenamed({"node": "b", "shingles": "sb"})
    joined = pairs.join(a.hint("merge"), "a").join(b.hint("merge"), "b").select("a", "b", "sa", "sb")
    return stored(joined.mapInArrow(_verify, "a long, b long, linked boolean"), "verified")


def _candidates(runs: DataFrame, sizes: DataFrame, twos: bool, often: int) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) of sets that share enough signatures, and the sets (node) that need frequent signatures.

    Of its units u in a band a set may lose (|a| + |b|) / 7 to differences and its frequent signatures; where more are left,
    a partner shares at least those with it (half of them, if segments with one-deletion neighbours count twice). That
    holds for units in segments of which the partner gives signatures too: all (`left`) with partners that aren't smaller or
    that give all segments (no units), those below the least possible cut of a partner (`low`) with any. A set is unsure if none
    are left with its largest partner, or of `low` with a smaller one: it may have to meet other unsure sets in frequent signatures.
    """
    weight = 2 if twos else 1
    frequent = runs.groupBy("run").agg(F.count("*").alias("c")).where(F.col("c") > often).select("run")
    frequent = stored(frequent, "runs-frequent")
    often_rows = stored(runs.join(frequent.hint("merge"), "run"), "rows-frequent")
    lost = often_rows.groupBy("node", "band").agg((F.count("*") * weight).alias("lost"))
    who = runs.groupBy("node", "band").agg(F.max("units").alias("units"), F.max("low").alias("low")).join(lost.hint("merge"), ["node", "band"], "left").join(sizes.hint("merge"), "node")
    rest = lambda c: F.when(F.col("units") > 0, F.greatest(F.lit(0), F.col(c) - F.coalesce("lost", F.lit(0)))).otherwise(0)
    who = who.select("node", "band", "size", (F.col("units") == 0).alias("all"), rest("units").alias("left"), rest("low").alias("low"))
    # a set of the band above is always the larger one of its pairs
    upper = F.lit(False)
    for k in range(SPARSE):
        if BAND**k > 1 << 40:
            break
        upper = upper | ((F.col("band") == k) & (F.col("size") >= BAND ** (k + 1)))
    most = F.when(upper, F.floor(F.col("size") * 2 / 7)).otherwise(F.floor(F.col("size") / 3))
    who = stored(who.withColumn("unsure", (F.col("left") <= most) | (F.col("low") <= F.floor(F.col("size") * 2 / 7)) | (F.col("band") == SPARSE)), "sets-known")

    rare = runs.join(frequent.hint("merge"), "run", "left_anti").groupBy("run").agg(F.min("band").alias("band"), F.array_sort(F.collect_set("node")).alias("nodes"))
    pairs = F.flatten(F.transform("nodes", lambda x, i: F.transform(F.slice("nodes", i + 2, F.size("nodes")), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    shared = rare.select("band", F.explode(pairs).alias("p")).groupBy("band", "p.a", "p.b").agg(F.count("*").alias("shared"))
    side = lambda x: who.select(F.col("node").alias(x), "band", F.col("size").alias(f"size_{x}"), *(F.col(c).alias(f"{c}_{x}") for c in ("left", "low", "all")))
    both = shared.join(side("a").hint("merge"), ["a", "band"]).join(side("b").hint("merge"), ["b", "band"])
    differ = F.floor((F.col("size_a") + F.col("size_b")) / 7)
    near = F.greatest("size_a", "size_b") * 3 <= F.least("size_a", "size_b") * 4
    left = F.greatest("low_a", "low_b", F.expr("if(size_a <= size_b or all_b, left_a, 0)"), F.expr("if(size_b <= size_a or all_a, left_b, 0)"))
    enough = F.greatest(F.lit(1), F.ceil((left - differ) / weight))
    return both.where(near & (F.col("shared") >= enough)).select("a", "b").distinct(), often_rows.join(who.where("unsure").select("node", "band").hint("merge"), ["node", "band"], "left_semi").select("node").distinct()


def _shingle_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        parts = [np.frombuffer(x.as_buffer(), dtype=np.int64) for x in b.column("shingles")]
        node = np.repeat(np.array(b.column("node").to_pylist(), dtype=np.int64), [len(x) for x in parts])
        run = np.concatenate(parts) if parts else np.empty(0, dtype=np.int64)
        for lo in range(0, len(run), 100_000):
            yield pa.RecordBatch.from_pydict({"run": pa.array(run[lo : lo + 100_000]), "node": pa.array(node[lo : lo + 100_000])})


RARE, FREQUENT, CLASS = 0, 1, 2
_PREFIXES = "run long, node long, rest int, kind int, pos int, n int"


def _prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A set's first quarter of shingles and one more, rare ones first; of sets that reach frequent ones, their class too."""
    for b in batches:
        out: list[tuple[np.ndarray, int, int, int, int, int]] = []
        nodes = b.column("node").to_pylist()
        for node, x, f in zip(nodes, b.column("shingles"), b.column("own"), strict=True):
            u = np.frombuffer(x.as_buffer(), dtype=np.uint64)
            own = f.values.field("run").to_numpy().view(np.uint64) if f.is_valid else np.empty(0, np.uint64)
            rare, k = np.setdiff1d(u, own, assume_unique=True), len(u) // 4 + 1
            out.append((np.sort(rare)[:k], node, len(rare), RARE, 0, len(u)))
            if len(rare) < k:
                out.append((own[: k - len(rare)], node, len(rare), FREQUENT, len(rare), len(u)))
                out.append((mix(np.array([mix(own ^ _K[2]).sum(dtype=np.uint64)], dtype=np.uint64)), node, len(rare), CLASS, 0, len(u)))
        n = [len(x[0]) for x in out]
        run = np.concatenate([x[0] for x in out]).view(np.int64) if out else np.empty(0, np.int64)
        node, *rest = (np.repeat(np.array([x[i] for x in out], dtype=np.int64), n) for i in range(1, 6))
        rest[2] = rest[2] + np.concatenate([np.arange(k) for k in n] or [rest[2]])
        ints = {c: pa.array(x.astype(np.int32)) for c, x in zip(("rest", "kind", "pos", "n"), rest, strict=True)}
        yield pa.RecordBatch.from_pydict({"run": pa.array(run), "node": pa.array(node)} | ints)


def _undecided(sets: DataFrame, unsure: DataFrame, often: int) -> DataFrame:
    """(run, node, rest, kind, pos, n) of sets that segments leave unsure: the universe is cut anew, one segment for each shingle.

    Two linked sets share a shingle of their first quarters and one more, in an order that has the rare shingles first. So
    sets that have that many rare ones find their partners through those. Two others that share no rare shingle have at
    least three quarters frequent ones each (`rest`: the number of rare ones); their class is the set of those. `pos` is the shingle's place in that order, `n` the
    set's size: from the first shingle that two sets share on, each must have as many left as they have to share.
    """
    sets = stored(sets.join(unsure.hint("merge"), "node", "left_semi"), "sets-unsure")
    rows = sets.mapInArrow(_shingle_rows, "run long, node long")
    frequent = stored(rows.groupBy("run").agg(F.count("*").alias("c")).where(F.col("c") > often), "shingles-frequent")
    own = rows.join(frequent.hint("merge"), "run").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("c", "run"))).alias("own"))
    return stored(sets.join(own.hint("merge"), "node", "left").mapInArrow(_prefixes, _PREFIXES), "prefixes")


def _pairs_of(runs: DataFrame) -> DataFrame:
    """All pairs (a, b) of the few sets of each run."""
    nodes = runs.groupBy("run").agg(F.array_sort(F.collect_set("node")).alias("nodes"))
    pairs = F.flatten(F.transform("nodes", lambda x, i: F.transform(F.slice("nodes", i + 2, F.size("nodes")), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    return nodes.where(F.size("nodes") > 1).select(F.explode(pairs).alias("p")).select("p.a", "p.b").distinct()


def _links(docs: DataFrame, inventory: DataFrame, pairs: DataFrame, unsure: DataFrame, often: int, max_star_rounds: int = 1) -> DataFrame:
    """Edges (a, b) between sets that are linked, enough that their components are those of all links.

    Candidate pairs are compared. Of the sets of a class (equal frequent shingles), the one with the fewest rare ones is
    linked to each set that any other is linked to without sharing a rare shingle; so the others are compared with it alone,
    and sets of other classes need not be compared with more than it. Sets of a frequent shingle are compared with one
    leader; where some are then in different components, with another, and in the end with the classes' leaders of other
    components whose sizes are near enough. Pairs within a component add nothing. So a group of near copies costs about one comparison for each of them.
    """
    needed = unsure.unionByName(pairs.select(F.col("a").alias("node"))).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    rep = inventory.groupBy("node").agg(F.min("key").alias("key")).join(needed.hint("merge"), "node")
    sets = docs.join(rep.hint("merge"), "key").select("node", "text").mapInArrow(_set_rows, "node long, shingles binary")
    if inventory.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").limit(1).count():
        sets = sets.groupBy("node").agg(F.first("shingles").alias("shingles"))  # rows that repeat a doc_id repeat its set
    sets = stored(sets, "sets")

    def star(members: DataFrame, leader) -> DataFrame:
        lead = stored(members.groupBy("run").agg(leader.alias("l"), F.count("*").alias("n_run")), "leaders")
        p = join_counted(members.select("run", "node"), lead, ["run"], "n_run").where("node <> l")
        return p.select(F.least("node", "l").alias("a"), F.greatest("node", "l").alias("b")).distinct()

    fewest = F.min_by("node", F.struct("rest", "node"))
    prefixes = _undecided(sets, unsure, often)
    common = prefixes.where(F.col("kind") != RARE)
    checked = _check(pairs.unionByName(_pairs_of(prefixes.where(F.col("kind") == RARE))).unionByName(star(common, fewest)).distinct(), sets)
    leaders = prefixes.where(F.col("kind") == CLASS).groupBy("run").agg(fewest.alias("node")).select("node", F.lit(True).alias("leads")).distinct()
    members = prefixes.where(F.col("kind") == FREQUENT).select("run", "node", "pos", "n")
    degree = stored(members.groupBy("node").agg(F.count("*").alias("degree")), "degrees")
    members = stored(members.join(leaders.hint("merge"), "node", "left").select("run", "node", "pos", "n", F.coalesce("leads", F.lit(False)).alias("leads")), "frequent")
    for r in range(max_star_rounds + 1):
        comp = components(checked.where("linked").select("a", "b"))
        at = members.drop("c").join(comp.hint("merge"), "node", "left").withColumn("c", F.coalesce("component", "node")).drop("component")
        at = stored(at, "runs-at")
        open_runs = at.groupBy("run").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count("*").alias("n_run")).where("lo <> hi and n_run > 2").select("run", "n_run")
        members = stored(join_counted(at, stored(open_runs, "runs-open"), ["run"], "n_run").select("run", "node", "pos", "n", "leads", "c"), "open-runs")
        # sets whose sizes allow a link are in bands of sizes side by side
        sized = members.withColumn("band", F.floor(F.log(F.col("n").cast("double")) / math.log(4 / 3) + 1e-9))
        each = sized.groupBy("run", "band").agg(F.count("*").alias("k"), F.sum(F.col("leads").cast("long")).alias("l"))
        near_band = each.select("run", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).alias("band"), F.col("l").alias("l_near"))
        total = each.join(near_band.groupBy("run", "band").agg(F.sum("l_near").alias("l_near")).hint("merge"), ["run", "band"]).agg(F.sum(F.col("k") * F.col("l_near")).alias("p"), F.sum("k").alias("n")).collect()[0]
        if not total["p"]:
            break
        last = r == max_star_rounds or total["p"] <= 8 * total["n"]
        if last:
            x = sized.select("run", "band", F.col("node").alias("x"), F.col("c").alias("cx"), F.col("pos").alias("px"), F.col("n").alias("nx"))
            y = sized.where("leads").select("run", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).alias("band"), F.col("node").alias("y"), F.col("c").alias("cy"), F.col("pos").alias("py"), F.col("n").alias("ny"))
            near = "cx <> cy and 7 * least(nx - px, ny - py) >= 3 * (nx + ny)"
            more = x.join(y.hint("merge"), ["run", "band"]).where(near).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        else:
            ranked = members.join(degree.hint("merge"), "node")
            # in later rounds another of the frequent ones leads
            more = star(ranked, F.max_by("node", F.struct("degree", "node") if not r else F.struct(F.col("degree") * F.pmod(F.xxhash64("node", F.lit(r)), F.lit(97)), "node")))
        more = more.join(checked.select("a", "b").hint("merge"), ["a", "b"], "left_anti")
        checked = stored(checked.unionByName(_check(more, sets)), "verified-all")
        if last:
            break
    return checked.where("linked").select("a", "b")


def grouped_documents(docs: DataFrame, sigs_each: int = 600_000, often: int = OFTEN) -> DataFrame:
    """doc_id, key, n_shingles and first for each row of docs: see join_documents.

    key is a hash of doc_id and text. first is null for empty sets; else it holds doc_id and key of the row that stands for
    the group: that of the smallest doc_id (a null one only where there is no other), of the smallest key among equals.
    """
    spark = docs.sparkSession
    doc_id = F.col("doc_id").cast("long")
    rows = docs.select(doc_id.alias("doc_id"), F.xxhash64(doc_id, "text").alias("key"), "text")
    first = stored(rows.mapInArrow(_inventory, _FIRST), "sets-inventory")
    cells = first.where("cell is not null").groupBy("cell").agg(F.sum("weight").alias("w"))
    # bounded by SPARSE * CLASSES * CELLS rows, whatever the input
    alloc = allocate({r["cell"]: r["w"] for r in cells.collect()})
    inventory = first.where("n_shingles is not null").select("doc_id", "key", "node", "n_shingles")
    total = inventory.agg(F.sum("n_shingles")).collect()[0][0] or 0
    n_buckets = min(1 << 24, partitions_for(spark, total // 2, sigs_each))
    packed = rows.select("text").mapInArrow(_signature_rows(alloc, n_buckets), _PACKED)
    runs = stored(packed.repartition(n_buckets, "bucket").mapInArrow(_runs, _RUNS), "runs")
    known = inventory.where("node is not null")
    # copies meet at their set's node, so everything from here on has one row for each different set
    smallest = F.min(F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "key")).alias("first")
    nodes = stored(known.groupBy("node").agg(F.first("n_shingles").alias("size"), F.count("*").alias("n_rows"), smallest), "sets-nodes")
    pairs, unsure = _candidates(runs, nodes.select("node", "size"), any((a == 2).any() for a in alloc.values()), often)
    pairs, unsure = stored(pairs, "pairs"), stored(unsure, "unsure")
    discard(runs)
    comp = components(_links(rows.select("key", "text"), known.select("node", "key"), pairs, unsure, often))
    nodes = nodes.join(comp.hint("merge"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    nodes = stored(nodes, "nodes-components")
    groups = stored(nodes.groupBy("component").agg(F.min("first").alias("first"), F.count("*").alias("n_nodes")), "groups")
    nodes = stored(join_counted(nodes.select("node", "n_rows", "component"), groups, ["component"], "n_nodes").select("node", "n_rows", "first"), "nodes-groups")
    out = join_counted(known, nodes, ["node"], "n_rows").select("doc_id", "key", "n_shingles", F.struct("first.doc_id", "first.key").alias("first"))
    empty = inventory.where("node is null").select("doc_id", "key", "n_shingles", F.lit(None).cast("struct<doc_id: bigint, key: bigint>").alias("first"))
    return out.unionByName(empty)


def join_documents(docs: DataFrame, sigs_each: int = 600_000, often: int = OFTEN) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of docs, by links of Jaccard similarity 0.75 or more.

    Words are runs of anything but ASCII white space, A-Z lower-cased; sets are of distinct five-word shingles, a shorter
    text being one shingle. Null, empty and blank texts have empty sets and no links. Equal sets are one node, so copies
    cost nothing in pairs. Rows that repeat a doc_id are rows of their own; a null doc_id takes part, but is smallest
    only where there is no other. Empty tables give no rows; other columns are left out.
    """
    return grouped_documents(docs, sigs_each, often).select("doc_id", "n_shingles", F.coalesce("first.doc_id", "doc_id").alias("component_id"))


def one_of_each_group(docs: DataFrame) -> DataFrame:
    """The rows of docs that stand for their group, one for each, with all their columns.

    That is the row of the group's smallest doc_id, a null one only where there is no other. Rows are told apart by doc_id
    and text, so a row isn't dropped for another's doc_id; rows that are equal in both are one group and one of them
    stays. Rows without words are groups of their own and all stay.
    """
    groups = stored(grouped_documents(docs).where("first is not null"), "groups-rows")
    stands = (F.col("key") == F.col("first.key")) & F.col("doc_id").eqNullSafe(F.col("first.doc_id"))
    doc, key = free_name("doc", docs.columns), free_name("key", docs.columns)
    doc_id = F.col("doc_id").cast("long")
    keyed = docs.withColumn(key, F.xxhash64(doc_id, "text"))
    others = groups.where(~stands).select(F.col("doc_id").alias(doc), F.col("key").alias(key)).distinct()
    out = keyed.join(others.hint("merge"), (keyed[key] == others[key]) & doc_id.eqNullSafe(others[doc]), "left_anti")
    twice = stored(groups.where(stands).groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select(F.col("key").alias(key)), "groups-repeated")
    if twice.limit(1).count():
        single = out.join(twice.hint("merge"), key, "left_anti").select(*docs.columns, key)
        out = single.unionByName(out.join(twice.hint("merge"), key, "left_semi").select(*docs.columns, key).dropDuplicates([key]))
    return out.select(*docs.columns)


def op10_ngram_join(spark, sf_dir) -> DataFrame:
    return join_documents(read_table(spark, sf_dir, "documents"))
