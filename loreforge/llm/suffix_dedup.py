"""Exact removal of repeated 200-byte strings by range-partitioned suffix sorting.

Sorting every suffix would shuffle many times the input, so suffixes are first grouped at anchors. In each window of
WINDOW bytes the least GRAM-byte string by hash is its anchor; equal windows have equal anchors at equal places. An
anchor owns the run of windows that have it, so each window is judged once. Only anchors whose string stands elsewhere can
own repeated windows. Where all occurrences of an anchor's string have the same owned text, all their windows are repeated.
The rest are sorted: their contexts are range-partitioned by the leading bytes of the suffix that begins at the anchor (Spark
samples the splitters), so a bucket is a range of suffixes. Each bucket sorts the windows of its contexts by multikey
quicksort, eight bytes at a time. A string of more contexts than a bucket should hold goes over several buckets: its windows
are compared across their boundaries, by digests.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loreforge.llm.common import _RANDOM, _power, discard, free_name, groups_of, join_counted, mix, partitions_for, read_table, stored, text_bytes

WINDOW, GRAM = 200, 48
LEAD = 16  # leading bytes of a suffix by which it is dealt
PIECE = 1 << 19  # a longer text is anchored in pieces; it must be under 1 << 20
_POS = np.uint64((1 << 20) - 1)

# ---------------------------------------------------------------- anchors


def _gram_values(buf: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the GRAM bytes from each position."""
    pw, inv = _power(len(buf) + 1)
    p = np.zeros(len(buf) + 1, dtype=np.uint64)
    np.cumsum(_RANDOM[buf] * pw[: len(buf)], out=p[1:])
    n = len(buf) - GRAM + 1
    return mix((p[GRAM:] - p[:n]) * inv[:n])


def anchors(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First owned window, number of owned windows and anchor of each run, from the gram values of one text."""
    v = (values & ~_POS) | np.arange(len(values), dtype=np.uint64)  # of equal grams the leftmost counts
    width, m = 1, v
    span = WINDOW - GRAM + 1
    while width * 2 <= span:
        m = np.minimum(m[: len(m) - width], m[width:])
        width *= 2
    rest = span - width
    if rest:
        m = np.minimum(m[: len(m) - rest], m[rest:])
    owner = (m & _POS).astype(np.int64)
    first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
    return first, np.diff(np.r_[first, len(owner)]), owner[first]


#: A document's key: two hashes of its id and text.
_DOC = "struct<a: bigint, b: bigint>"
_OCC = f"doc {_DOC}, a int, n short, off short, gram long, ctx long"


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    digest = xxhash.xxh3_64_intdigest
    for b in batches:
        docs = b.column("doc")
        texts = text_bytes(b.column("text"))
        cols: list[list] = [[], [], [], [], []]
        ctx: list[int] = []

        def flush():
            doc, a, n, off, gram = (np.concatenate(c) for c in cols)
            out = pa.RecordBatch.from_pydict({"doc": docs.take(pa.array(doc)), "a": pa.array(a.astype(np.int32)), "n": pa.array(n.astype(np.int16)), "off": pa.array(off.astype(np.int16)), "gram": pa.array(gram.view(np.int64)), "ctx": pa.array(np.array(ctx, dtype=np.uint64).view(np.int64))})
            for c in cols:
                c.clear()
            ctx.clear()
            return out

        for lo, hi in groups_of(texts, PIECE):
            for i in range(lo, hi):
                t = texts[i]
                for at in range(0, max(0, len(t) - WINDOW + 1), PIECE):
                    piece = t[at : at + PIECE + WINDOW - 1]
                    if len(piece) < WINDOW:
                        continue
                    values = _gram_values(np.frombuffer(piece, dtype=np.uint8))
                    first, n, p = anchors(values)
                    for c, v in zip(cols, (np.full(len(first), i), first + at, n, p - first, mix(values[p] ^ np.uint64(0xD6E8FEB86659FD93))), strict=True):
                        c.append(v)
                    ctx.extend([digest(piece[s:e]) for s, e in zip(first.tolist(), (first + n + (WINDOW - 1)).tolist(), strict=True)])
            if len(ctx) > 50_000:
                yield flush()
        if ctx:
            yield flush()


# ---------------------------------------------------------------- contexts


def _context_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = text_bytes(b.column("text"))
        out: dict[str, list] = {k: [] for k in ("gram", "ctx", "off", "n", "copies", "k", "lead", "body")}
        size = 0
        for t, marks in zip(texts, b.column("marks").to_pylist(), strict=True):
            for m in marks:
                for k in ("gram", "ctx", "off", "n", "copies", "k"):
                    out[k].append(m[k])
                at = m["a"] + m["off"]
                out["lead"].append(t[at : at + LEAD])
                out["body"].append(t[m["a"] : m["a"] + m["n"] + WINDOW - 1])
                size += m["n"] + WINDOW
            if size > 4 << 20:
                yield _contexts(out)
                out, size = {k: [] for k in out}, 0
        if size:
            yield _contexts(out)


_CONTEXTS = "gram long, ctx long, off short, n short, copies long, k long, lead binary, body binary"


def _contexts(c: dict[str, list]) -> pa.RecordBatch:
    t = {"gram": pa.int64(), "ctx": pa.int64(), "off": pa.int16(), "n": pa.int16(), "copies": pa.int64(), "k": pa.int64(), "lead": pa.binary(), "body": pa.binary()}
    return pa.RecordBatch.from_pydict({k: pa.array(c[k], t[k]) for k in t})


def multikey_sort(buf: np.ndarray, starts: np.ndarray, key: np.ndarray, length: int = WINDOW) -> np.ndarray:
    """Which of the strings of `length` bytes from starts have an equal one with the same key.

    Strings of a group that differ in their next eight bytes are parted and each part goes on with the bytes after; a
    string alone in its group is done. The outer bytes come first, as the middle ones, around the anchor, are equal.
    """
    words = np.lib.stride_tricks.as_strided(np.concatenate([buf, np.zeros(8, np.uint8)]), shape=(len(buf) + 1, 8), strides=(1, 1))
    depths = [d for k in range((length // 8 + 1) // 2) for d in dict.fromkeys((8 * k, length - 8 * (k + 1)))]
    order = np.argsort(key, kind="stable")
    group = key[order]

    def pairs(order, group):
        new = np.r_[True, group[1:] != group[:-1]]
        alone = new & np.r_[new[1:], True]
        keep = ~alone
        return order[keep], (np.cumsum(new) - 1)[keep]

    order, group = pairs(order, group)
    for d in depths:
        if not len(order):
            break
        w = np.ascontiguousarray(words[starts[order] + d]).view(">u8").ravel()
        new = np.r_[True, group[1:] != group[:-1]]
        lead = np.maximum.accumulate(np.where(new, np.arange(len(group)), 0))
        mixed_groups = np.zeros(group[-1] + 1, dtype=bool)
        mixed_groups[group[w != w[lead]]] = True
        part = mixed_groups[group]
        if not part.any():
            continue
        # only groups that differ here are sorted; the others keep their place
        o, g, x = order[part], group[part], w[part].astype(np.uint64)
        s = np.lexsort((x, g))
        o, g, x = o[s], g[s], x[s]
        sub = np.cumsum(np.r_[True, (g[1:] != g[:-1]) | (x[1:] != x[:-1])]) - 1
        o, sub = pairs(o, sub)
        rest_o, rest_g = order[~part], group[~part]
        top = (rest_g[-1] + 1) if len(rest_g) else 0
        order, group = np.concatenate([rest_o, o]), np.concatenate([rest_g, sub + top])
    out = np.zeros(len(starts), dtype=bool)
    out[order] = True
    return out


def repeated_windows(gram: np.ndarray, ctx: np.ndarray, off: np.ndarray, n: np.ndarray, copies: np.ndarray, bodies: list[bytes]):
    """(row of the context, first and last + 1 repeated window) of contexts; each anchor's contexts are all given."""
    _, keep = np.unique(np.stack([gram, ctx], axis=1), axis=0, return_index=True)
    keep = np.sort(keep)
    at = np.cumsum([0, *(len(bodies[i]) for i in keep)])[:-1]
    buf = np.frombuffer(b"".join(bodies[i] for i in keep), dtype=np.uint8)
    n_k = n[keep].astype(np.int64)
    row = np.repeat(np.arange(len(keep)), n_k)
    j = np.arange(len(row)) - np.repeat(np.cumsum(n_k) - n_k, n_k)
    _, g = np.unique(gram[keep], return_inverse=True)
    key = g[row] * 256 + (off[keep].astype(np.int64)[row] - j)
    hit = multikey_sort(buf, at[row] + j, key) | (copies[keep] > 1)[row]
    edge = np.r_[True, row[1:] != row[:-1]] if len(row) else np.empty(0, bool)
    before = np.r_[False, hit[:-1]] & ~edge
    after = np.r_[hit[1:], False] & ~np.r_[edge[1:], True] if len(row) else hit
    first, last = np.flatnonzero(hit & ~before), np.flatnonzero(hit & ~after)
    return keep[row[first]], j[first], j[last] + 1


_JUDGED = "gram long, ctx long, j0 int, j1 int, d int, copies long, h binary"


def _rows(gram, ctx, j0, j1, d=None, copies=None, h=None) -> pa.RecordBatch:
    n = len(gram)
    col = lambda v, t: pa.nulls(n, t) if v is None else pa.array(v, t)
    return pa.RecordBatch.from_pydict({"gram": col(gram, pa.int64()), "ctx": col(ctx, pa.int64()), "j0": col(j0, pa.int32()), "j1": col(j1, pa.int32()), "d": col(d, pa.int32()), "copies": col(copies, pa.int64()), "h": col(h, pa.binary())})


def _bucket(batches: Iterator[pa.RecordBatch], flush: int = 6 << 20) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by leading bytes and gram; whole grams are sorted together, some megabytes of contexts at a time.

    Gives repeated windows j0 to j1 - 1 of contexts; of grams that go over several buckets (`wide`) the windows j0 with their
    digest h, place d against the anchor and copies.
    """

    def inner(t: pa.Table) -> Iterator[pa.RecordBatch]:
        gram, ctx = t.column("gram").to_numpy(), t.column("ctx").to_numpy()
        row, j0, j1 = repeated_windows(gram, ctx, t.column("off").to_numpy(), t.column("n").to_numpy(), t.column("copies").to_numpy(), t.column("body").to_pylist())
        yield _rows(gram[row], ctx[row], j0.astype(np.int32), j1.astype(np.int32))

    def edge(t: pa.Table) -> Iterator[pa.RecordBatch]:
        for r in t.select(["gram", "ctx", "off", "n", "copies", "body"]).to_pylist():
            n = r["n"]
            j = range(n)
            yield _rows([r["gram"]] * n, [r["ctx"]] * n, j, None, [r["off"] - x for x in j], [r["copies"]] * n, [xxhash.xxh3_128_digest(r["body"][x : x + WINDOW]) for x in j])

    held: list[pa.Table] = []
    size = 0
    for b in batches:
        t = pa.Table.from_batches([b])
        wide = t.column("wide").to_numpy()
        yield from edge(t.filter(pa.array(wide)))
        t = t.filter(pa.array(~wide))
        if not t.num_rows:
            continue
        held.append(t)
        size += t.nbytes
        if size >= flush:
            t = pa.concat_tables(held)
            g = t.column("gram").to_numpy()
            k = int(np.flatnonzero(g == g[-1])[0])  # the last gram may go on
            if k:
                yield from inner(t.slice(0, k))
            held = [t.slice(k)]
            size = held[0].nbytes if k else 0
    if held:
        yield from inner(pa.concat_tables(held))


# ---------------------------------------------------------------- operator


def repeated_runs(docs: DataFrame, bucket_bytes: int = 12 << 20, most_contexts: int = 20_000) -> DataFrame:
    """(doc, a, n): windows a to a + n - 1 of documents (doc, text) that also start elsewhere."""
    spark = docs.sparkSession
    occ = stored(docs.mapInArrow(_anchor_rows, _OCC), "anchors")
    stats = occ.groupBy("gram").agg(F.count("*").alias("c"), (F.min("ctx") != F.max("ctx")).alias("mixed")).where("c > 1")
    stats = stored(stats, "anchors-counted")
    cand = stored(join_counted(occ, stats, ["gram"], "c").drop("c"), "anchors-repeated")
    discard(occ)
    solid = cand.where("not mixed").select("doc", "a", "n")

    mixed = cand.where("mixed").drop("mixed")
    reps = mixed.groupBy("gram", "ctx").agg(F.count("*").alias("copies"), F.min(F.struct("doc", "a", "n", "off")).alias("r"))
    reps = stored(reps.select("gram", "ctx", "copies", "r.*"), "contexts-chosen")
    per_gram = stored(reps.groupBy("gram").agg(F.count("*").alias("k")), "contexts-counted")
    marks = join_counted(reps, per_gram, ["gram"], "k").groupBy("doc").agg(F.collect_list(F.struct("a", "n", "off", "gram", "ctx", "copies", "k")).alias("marks"), F.max("copies").alias("rows"))
    bodies = join_counted(docs, stored(marks, "contexts-marked"), ["doc"], "rows").select("text", "marks").mapInArrow(_context_rows, _CONTEXTS)
    bodies = stored(bodies, "contexts")
    n_parts = partitions_for(spark, reps.count() * 300, bucket_bytes)
    wide = F.col("k") > most_contexts
    dealt = bodies.withColumns({"wide": wide, "part": F.when(wide, F.col("ctx")).otherwise(0)}).drop("k")
    dealt = dealt.repartitionByRange(n_parts, "lead", "gram", "part").sortWithinPartitions("lead", "gram", "part")
    judged = stored(dealt.mapInArrow(_bucket, _JUDGED), "buckets-judged")
    # across boundaries: rows that repeat a context are one
    edge = judged.where("h is not null").select("gram", "ctx", "j0", "d", "copies", "h").distinct()
    twice = edge.groupBy("gram", "d", "h").agg(F.sum("copies").alias("c")).where("c > 1").drop("c")
    edge = edge.join(twice.hint("merge"), ["gram", "d", "h"]).select("gram", "ctx", "j0", (F.col("j0") + 1).alias("j1"))
    hits = judged.where("h is null").select("gram", "ctx", "j0", "j1").unionByName(edge)
    hits = hits.groupBy("gram", "ctx").agg(F.collect_set(F.struct("j0", "j1")).alias("runs"))
    hits = stored(reps.select("gram", "ctx", "copies").join(hits.hint("merge"), ["gram", "ctx"]), "windows-repeated")
    found = join_counted(mixed, hits, ["gram", "ctx"], "copies").select("doc", "a", F.explode("runs").alias("j")).select("doc", "a", "j.*")
    return solid.unionByName(found.select("doc", (F.col("a") + F.col("j0")).alias("a"), (F.col("j1") - F.col("j0")).cast("short").alias("n")))


def _covered(n_bytes: int, runs: list[dict]) -> list[tuple[int, int]]:
    """Maximal removed spans [from, to)."""
    spans: list[tuple[int, int]] = []
    for a, n in sorted((r["a"], r["n"]) for r in runs):
        end = a + n - 1 + WINDOW
        if spans and a <= spans[-1][1]:
            spans[-1] = (spans[-1][0], max(end, spans[-1][1]))
        else:
            spans.append((a, end))
    return spans


def _kept(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    out, at = [], 0
    for a, b in spans:
        out.append(text[at:a])
        at = b
    return b"".join([*out, text[at:]])


def _with_runs(docs: DataFrame, list_name: str, bucket_bytes: int = 12 << 20, most_contexts: int = 20_000) -> DataFrame:
    """docs with the list of each row's runs (or null) in a new column.

    Rows are told apart by two 64-bit hashes of id and text. Equal rows have the same runs, which are listed once; the number of
    times that they were found counts the rows, so copies of a row stay where they are in the join if they are many.
    """
    doc = free_name("run_doc", docs.columns)
    key = F.struct(F.xxhash64("doc_id", "text").alias("a"), F.xxhash64(F.lit("second"), "text", "doc_id").alias("b"))
    keyed = docs.withColumn(doc, key)
    runs = repeated_runs(keyed.select(F.col(doc).alias("doc"), "text"), bucket_bytes, most_contexts)
    once = runs.groupBy("doc", "a", "n").agg(F.count("*").alias("rows"))
    lists = once.groupBy(F.col("doc").alias(doc)).agg(F.collect_list(F.struct("a", "n")).alias(list_name), F.max("rows").alias(f"{doc}_rows"))
    lists = stored(lists, "runs-listed")
    return join_counted(keyed, lists, [doc], f"{doc}_rows", "left").drop(doc, f"{doc}_rows")


def removal_report(docs: DataFrame, bucket_bytes: int = 12 << 20, most_contexts: int = 20_000) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for each row of docs.

    Texts are judged as UTF-8 bytes on the input as it is; null is empty. Rows that repeat a text of WINDOW bytes or more
    are removed as a whole, all of them. Texts under WINDOW bytes lose nothing. An empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for t, runs in zip(text_bytes(b.column("text")), b.column("runs").to_pylist(), strict=True):
                spans = _covered(len(t), runs or [])
                out.append((len(t), sum(y - x for x, y in spans), len(spans), hashlib.sha256(_kept(t, spans)).hexdigest()))
            n, r, s, h = zip(*out, strict=True) if out else ((), (), (), ())
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "n_bytes": pa.array(n, pa.int64()), "n_removed": pa.array(r, pa.int64()), "n_spans": pa.array(s, pa.int64()), "kept_sha256": pa.array(h, pa.string())})

    rows = _with_runs(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "runs", bucket_bytes, most_contexts)
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """docs with repeated strings cut out of text (and n_chars counted anew, where there is such a column).

    A character that a cut leaves in part goes as well. Null texts stay null; a text of which nothing is left is ''. Other
    columns stay as they are, whatever their names; equal rows are cut alike.
    """
    names = docs.columns
    list_name = free_name("runs", names)
    rows = _with_runs(docs.select(*names), list_name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col, new = b.column("text"), []
            for t, runs in zip(col.to_pylist(), b.column(list_name).to_pylist(), strict=True):
                if runs:
                    raw = t.encode()
                    t = _kept(raw, _covered(len(raw), runs)).decode("utf-8", "ignore")
                new.append(t)
            yield pa.RecordBatch.from_pydict({c: pa.array(new, pa.string()) if c == "text" else b.column(c) for c in names})

    out = rows.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in names else out


def op4_suffix_dedup(spark, sf_dir) -> DataFrame:
    return removal_report(read_table(spark, sf_dir, "documents"))
