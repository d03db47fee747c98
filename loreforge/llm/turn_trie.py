"""Conversation prefix trie: adaptive radix trees over fixed-width big-endian turn ids.

A turn's id is the first 16 bytes of the SHA-256 of its role and text, so texts aren't shuffled. A conversation is the byte
string of its turns' ids. Equal conversations are one key with a count. Keys are dealt by range; each range builds
a radix tree, and only the byte depths at which a turn ends become nodes. A node of a range whose keys neither begin nor end
the range is whole. The nodes on the paths of a range's first and last key go on to a merge with the neighbouring ranges,
some dozens at a time, until one stretch is left.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loreforge.llm.common import join_counted, partitions_for, read_table, stored

#: Bytes of a turn's id; fixed value: white space of words.
WIDTH = 16
WORD = r"[^\x20\x09-\x0D]+"
#: Items of a piece of a long run, neighbouring ranges merged by a task, bytes of keys in a range.
PIECE, FAN, RANGE_BYTES = 1 << 16, 64, 8 << 20

# ---------------------------------------------------------------- the tree


class Node:
    """A node of an adaptive radix tree: a compressed path, maybe a value, and children in one of four layouts.

    Layouts of 4 and 16 hold sorted bytes beside their children, that of 48 an index of 256 places into them, that of 256 a place
    for each byte. A layout that is full grows into the next.
    """

    __slots__ = ("prefix", "value", "layout", "index", "kids")

    def __init__(self, prefix: bytes = b"", value: int | None = None):
        self.prefix, self.value, self.layout, self.index, self.kids = prefix, value, 4, bytearray(), []

    def get(self, byte: int) -> Node | None:
        if self.layout == 256:
            return self.kids[byte]
        if self.layout == 48:
            k = self.index[byte]
            return self.kids[k - 1] if k else None
        k = self.index.find(byte)
        return self.kids[k] if k >= 0 else None

    def add(self, byte: int, child: Node) -> None:
        if self.layout != 256 and len(self.kids) == self.layout:
            self._grow()
        if self.layout == 256:
            self.kids[byte] = child
        elif self.layout == 48:
            self.kids.append(child)
            self.index[byte] = len(self.kids)
        else:
            k = 0
            while k < len(self.index) and self.index[k] < byte:
                k += 1
            self.index.insert(k, byte)
            self.kids.insert(k, child)

    def _grow(self) -> None:
        if self.layout == 4:
            self.layout = 16
        elif self.layout == 16:
            places = bytearray(256)
            for k, byte in enumerate(self.index):
                places[byte] = k + 1
            self.layout, self.index = 48, places
        else:
            kids: list[Node | None] = [None] * 256
            for byte, k in enumerate(self.index):
                if k:
                    kids[byte] = self.kids[k - 1]
            self.layout, self.index, self.kids = 256, bytearray(), kids

    def children(self) -> Iterator[Node]:
        """In the order of their bytes."""
        if self.layout == 48:
            return (self.kids[k - 1] for k in self.index if k)
        return (c for c in self.kids if c is not None)

    def split(self, at: int) -> None:
        """Cuts the compressed path: what follows `at` bytes of it goes to a new child."""
        low = Node(self.prefix[at + 1 :], self.value)
        low.layout, low.index, low.kids = self.layout, self.index, self.kids
        byte = self.prefix[at]
        self.prefix, self.value, self.layout, self.index, self.kids = self.prefix[:at], None, 4, bytearray(), []
        self.add(byte, low)


def _common(a: bytes, b: bytes) -> int:
    """Length of the common prefix of two strings, by halving."""
    lo, hi = 0, min(len(a), len(b))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid - 1
    return lo


def insert(root: Node, key: bytes, value: int) -> None:
    """Puts a value at a key that isn't there yet."""
    node, at = root, 0
    while True:
        if node.prefix and not key.startswith(node.prefix, at):
            node.split(_common(node.prefix, key[at : at + len(node.prefix)]))
        at += len(node.prefix)
        if at == len(key):
            node.value = value
            return
        child = node.get(key[at])
        if child is None:
            node.add(key[at], Node(key[at + 1 :], value))
            return
        node, at = child, at + 1


class _Sum:
    """What is known of the keys below a byte depth: members, least member, first and last key, closed nodes under the next turn."""

    __slots__ = ("n", "conv", "lo", "hi", "kids", "n_kids", "leaves", "saved")

    def __init__(self):
        self.n, self.conv, self.lo, self.hi, self.kids, self.n_kids, self.leaves, self.saved = 0, None, None, None, [], 0, 0, 0

    def add_key(self, i: int, n: int, conv: int) -> None:
        self.n += n
        self.conv = conv if self.conv is None else min(self.conv, conv)
        self.lo = i if self.lo is None else min(self.lo, i)
        self.hi = i if self.hi is None else max(self.hi, i)

    def add(self, o: _Sum) -> None:
        self.n += o.n
        self.conv = o.conv if self.conv is None else min(self.conv, o.conv)
        self.lo = o.lo if self.lo is None else min(self.lo, o.lo)
        self.hi = o.hi if self.hi is None else max(self.hi, o.hi)
        self.kids = self.kids + o.kids if len(self.kids) < len(o.kids) else self.kids.__iadd__(o.kids)
        self.n_kids += o.n_kids
        self.leaves += o.leaves
        self.saved += o.saved


def node_id(parent: bytes, turn: bytes) -> bytes:
    return hashlib.blake2b(parent + turn, digest_size=WIDTH).digest()


ROOT_ID = bytes(WIDTH)

#: A node: its key (conv_id, depth), its parent's conv_id or (while that is open) the parent's id, its figures; id of nodes that were open once.
_NODE = "conv_id long, depth long, parent_conv_id long, parent_id binary, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, id binary"
_FIELDS = ("conv_id", "depth", "parent_conv_id", "parent_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256", "id")
#: The same with the words of the node's last text, its range, and whether it lies on the path of the range's first and last key.
_OPEN = _NODE + ", words long, part long, first boolean, last boolean, open boolean"
_OPEN_FIELDS = (*_FIELDS, "words", "part", "first", "last", "open")
NONE = hashlib.sha256(b"").hexdigest()


def trie_nodes(keys: list[bytes], words: list[bytes], n: list[int], convs: list[int], ends: list[str], part: int) -> Iterator[list]:
    """Rows (_OPEN_FIELDS) of the turn-aligned nodes of sorted, different keys."""
    root = Node()
    for i, key in enumerate(keys):
        insert(root, key, i)
    last = len(keys) - 1
    path_ids: dict[tuple[bool, int], bytes] = {}  # of the first (True) and the last key, by depth
    for first, key in ((True, keys[0]), (False, keys[last])):
        path_ids[first, 0] = ROOT_ID
        for d in range(len(key) // WIDTH):
            path_ids[first, d + 1] = node_id(path_ids[first, d], key[d * WIDTH : (d + 1) * WIDTH])
    # (node, parent's byte depth, own byte depth, children still to visit, sum); depth first without recursion
    stack = [(root, -1, len(root.prefix), root.children(), _Sum())]
    while stack:
        node, up, at, rest, total = stack[-1]
        child = next(rest, None)
        if child is not None:
            stack.append((child, at, at + 1 + len(child.prefix), child.children(), _Sum()))
            continue
        stack.pop()
        if node.value is not None:
            total.add_key(node.value, n[node.value], convs[node.value])
        for t in range(at - at % WIDTH, up, -WIDTH):
            d = t // WIDTH
            end = ends[node.value] if t == at and node.value is not None else NONE
            w = int(np.frombuffer(words[total.lo], dtype="<i8", count=1, offset=8 * (d - 1))[0]) if d else 0
            first, final = total.lo == 0, total.hi == last
            if first or final:
                ident = path_ids[first, d]
                for k in total.kids:
                    k[3] = ident
                    yield k
                parent = path_ids[first, d - 1] if d else None
                yield [total.conv, d, None, parent, total.n, total.n_kids, total.leaves, total.saved, end, ident, w, part, first, final, True]
                total.kids, total.n_kids, total.leaves, total.saved = [], 0, 0, 0
                continue
            for k in total.kids:
                k[2] = total.conv
                yield k
            total.leaves += not total.n_kids
            total.saved += (total.n - 1) * w
            row = [total.conv, d, None, None, total.n, total.n_kids, total.leaves, total.saved, end, None, w, part, False, False, False]
            total.kids, total.n_kids = [row], 1
        if stack:
            stack[-1][4].add(total)


def close_stretch(opened: list[dict], last_round: bool) -> Iterator[list]:
    """Rows of the open nodes of neighbouring ranges: those that are whole now are closed, the others stay open.

    A node stays open if it is on the path of the stretch's first or last key. Rows of a node in several ranges are one.
    """
    if not opened:
        return
    lo, hi = min(r["part"] for r in opened), max(r["part"] for r in opened)
    nodes: dict[bytes, dict] = {}
    for r in opened:
        x = nodes.setdefault(r["id"], r | {"n_convs": 0, "n_children": 0, "n_leaves": 0, "saved_tokens": 0, "first": False, "last": False, "below": []})
        for c in ("n_convs", "n_children", "n_leaves", "saved_tokens"):
            x[c] += r[c]
        x["conv_id"] = min(x["conv_id"], r["conv_id"])
        x["ends_sha256"] = r["ends_sha256"] if x["ends_sha256"] == NONE else x["ends_sha256"]
        x["first"] |= r["part"] == lo and r["first"]
        x["last"] |= r["part"] == hi and r["last"]
    for x in sorted(nodes.values(), key=lambda x: -x["depth"]):
        still = (x["first"] or x["last"]) and not last_round
        if not still:
            x["n_leaves"] += not x["n_children"]
            x["saved_tokens"] += (x["n_convs"] - 1) * x["words"]
            if x["depth"]:
                up = nodes[x["parent_id"]]
                up["n_children"] += 1
                up["n_leaves"] += x["n_leaves"]
                up["saved_tokens"] += x["saved_tokens"]
        x["open"], x["part"] = still, lo
    for x in nodes.values():
        if not x["open"]:
            up = nodes.get(x["parent_id"])
            if up is not None and not up["open"]:
                x["parent_conv_id"], x["parent_id"] = up["conv_id"], None
        yield [x[c] for c in _OPEN_FIELDS]


# ---------------------------------------------------------------- in Spark

_KINDS = {"conv_id": pa.int64(), "ends_sha256": pa.string(), "id": pa.binary(), "parent_id": pa.binary(), "first": pa.bool_(), "last": pa.bool_(), "open": pa.bool_()}


def _batches(rows: Iterable[list], each: int = 20_000) -> Iterator[pa.RecordBatch]:
    held: list[list] = []

    def batch() -> pa.RecordBatch:
        return pa.record_batch({c: pa.array([r[k] for r in held], _KINDS.get(c, pa.int64())) for k, c in enumerate(_OPEN_FIELDS)})

    for r in rows:
        held.append(r)
        if len(held) == each:
            yield batch()
            held = []
    if held:
        yield batch()


def _runs(batches: Iterable[pa.RecordBatch], key: str) -> Iterator[tuple[object, list[dict]]]:
    """Runs of at most PIECE rows of equal key, in the order of the rows."""
    at, held = None, []
    for b in batches:
        for r in b.to_pylist():
            if held and (r[key] != at or len(held) == PIECE):
                yield at, held
                held = []
            at = r[key]
            held.append(r)
    if held:
        yield at, held


def _turn_pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Turns of a conversation that are neighbours in a range, in a row."""
    part, kinds = TaskContext.get().partitionId(), {"conv": pa.int64(), "part": pa.int64(), "seq": pa.int64(), "ids": pa.binary(), "words": pa.binary()}
    rows: list[tuple] = []
    for seq, (conv, run) in enumerate(_runs(batches, "conv")):
        rows.append((conv, part, seq, b"".join(r["id"] for r in run), np.array([r["words"] for r in run], dtype="<i8").tobytes()))
        if len(rows) == 5_000:
            yield pa.record_batch({c: pa.array([r[k] for r in rows], t) for k, (c, t) in enumerate(kinds.items())})
            rows = []
    if rows:
        yield pa.record_batch({c: pa.array([r[k] for r in rows], t) for k, (c, t) in enumerate(kinds.items())})


def _joined_turns(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of a conversation, which stand one after another, as one row."""
    conv, ids, words, rows = None, [], [], []

    def out() -> pa.RecordBatch:
        return pa.record_batch({"conv": pa.array([r[0] for r in rows], pa.int64()), "ids": pa.array([r[1] for r in rows], pa.binary()), "words": pa.array([r[2] for r in rows], pa.binary())})

    for b in batches:
        for r in b.to_pylist():
            if ids and r["conv"] != conv:
                rows.append((conv, b"".join(ids), b"".join(words)))
                ids, words = [], []
                if len(rows) == 5_000:
                    yield out()
                    rows = []
            conv = r["conv"]
            ids.append(r["ids"])
            words.append(r["words"])
    if ids:
        rows.append((conv, b"".join(ids), b"".join(words)))
    if rows:
        yield out()


def turn_rows(conversations: DataFrame) -> DataFrame:
    """conv, turn, id, words of each row; role and text that are null are empty; rows without a conv_id are of no conversation."""
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    # the role's length keeps its end and the text's start apart
    digest = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)
    rows = conversations.where("conv_id is not null")
    return rows.select(F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"), F.unhex(F.substring(digest, 1, 2 * WIDTH)).alias("id"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"))


def conversation_keys(turns: DataFrame, parts: int) -> DataFrame:
    """conv, ids, words: all turns of a conversation in order (by turn, null first, then by id).

    Turns are dealt by range and joined to pieces there, so a conversation with a large share of all rows is a few rows before it
    becomes one: its ids, 16 bytes a turn, and its numbers of words, 8.
    """
    dealt = turns.repartitionByRange(parts, "conv", "turn", "id").sortWithinPartitions("conv", "turn", "id")
    pieces = stored(dealt.mapInArrow(_turn_pieces, "conv long, part long, seq long, ids binary, words binary"), "turn-pieces")
    whole = pieces.repartition(parts, "conv").sortWithinPartitions("conv", "part", "seq")
    return stored(whole.mapInArrow(_joined_turns, "conv long, ids binary, words binary"), "conversations")


def rebuilt(convs: DataFrame, every: int = 20, heads: int = 4) -> DataFrame:
    """conv, key, words after the first h turns are taken from the conversation whose number is a multiple of `every`; h = crc32(conv) % heads."""
    base = convs.where(F.col("conv") % every == 0)
    most = heads - 1
    base = base.select(F.col("conv").alias("base"), F.expr(f"substring(ids, 1, {WIDTH * most})").alias("head"), F.expr(f"substring(words, 1, {8 * most})").alias("head_words"))
    h = F.crc32(F.col("conv").cast("string").cast("binary")) % heads
    rows = convs.withColumns({"base": F.col("conv") - F.col("conv") % every, "h": h.cast("int")}).join(base.hint("merge"), "base", "left")
    key = f"concat(coalesce(substring(head, 1, {WIDTH} * h), X''), substring(ids, {WIDTH} * h + 1))"
    words = "concat(coalesce(substring(head_words, 1, 8 * h), X''), substring(words, 8 * h + 1))"
    return rows.select("conv", F.expr(key).alias("key"), F.expr(words).alias("words"))


_PIECES = {"key": pa.binary(), "words": pa.binary(), "conv": pa.int64(), "n": pa.int64(), "ids": pa.string()}
_KEYS = {"key": pa.binary(), "words": pa.binary(), "conv": pa.int64(), "n": pa.int64(), "ends": pa.string()}


def _member_pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members of a key that are neighbours in a range: their number, the least, and all ids joined."""
    rows: list[tuple] = []
    for key, run in _runs(batches, "key"):
        rows.append((key, run[0]["words"], run[0]["conv"], len(run), ",".join(str(r["conv"]) for r in run)))
        if len(rows) == 2_000:
            yield pa.record_batch({c: pa.array([r[k] for r in rows], t) for k, (c, t) in enumerate(_PIECES.items())})
            rows = []
    if rows:
        yield pa.record_batch({c: pa.array([r[k] for r in rows], t) for k, (c, t) in enumerate(_PIECES.items())})


def _member_digests(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each key: its pieces, in order, stream through SHA-256."""
    now, digest, rows = None, None, []

    def out() -> pa.RecordBatch:
        return pa.record_batch({c: pa.array([r[k] for r in rows], t) for k, (c, t) in enumerate(_KEYS.items())})

    for b in batches:
        for r in b.to_pylist():
            if now is not None and r["key"] == now["key"]:
                digest.update(b"," + r["ids"].encode())
                now["n"] += r["n"]
                continue
            if now is not None:
                rows.append((now["key"], now["words"], now["conv"], now["n"], digest.hexdigest()))
                if len(rows) == 5_000:
                    yield out()
                    rows = []
            now, digest = r, hashlib.sha256(r["ids"].encode())
    if now is not None:
        rows.append((now["key"], now["words"], now["conv"], now["n"], digest.hexdigest()))
    if rows:
        yield out()


def distinct_keys(keys: DataFrame, parts: int) -> DataFrame:
    """key, words, conv (least member), n (members), ends (digest of the members' ids in order): one row for each different key.

    The members of a key are dealt by range and joined to pieces, so a key with a large share of all conversations is a few rows
    when its digest is made. That digest is a sequence by its nature: one task streams a key's pieces.
    """
    dealt = keys.repartitionByRange(parts, "key", "conv").sortWithinPartitions("key", "conv")
    kinds = "key binary, words binary, conv long, n long"
    pieces = stored(dealt.mapInArrow(_member_pieces, f"{kinds}, ids string"), "key-pieces")
    one = pieces.repartition(parts, "key").sortWithinPartitions("key", "conv")
    return stored(one.mapInArrow(_member_digests, f"{kinds}, ends string"), "keys")


def _tries(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cols: dict[str, list] = {c: [] for c in ("key", "words", "n", "conv", "ends")}
    for b in batches:
        for c, values in cols.items():
            values += b.column(c).to_pylist()
    if cols["key"]:
        yield from _batches(trie_nodes(cols["key"], cols["words"], cols["n"], cols["conv"], cols["ends"], TaskContext.get().partitionId()))


def _closing(last_round: bool):
    def run(table: pa.Table) -> pa.Table:
        made = list(_batches(close_stretch(table.drop_columns(["stretch"]).to_pylist(), last_round)))
        return pa.Table.from_batches(made)

    return run


def prefix_trie(keys: DataFrame, range_bytes: int = RANGE_BYTES, fan: int = FAN) -> DataFrame:
    """Nodes of the trie of distinct_keys(): conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    spark = keys.sparkSession
    n_bytes = keys.agg(F.coalesce(F.sum(F.length("key") + F.length("words") + 64), F.lit(0))).collect()[0][0]
    parts = partitions_for(spark, n_bytes, range_bytes)
    dealt = keys.repartitionByRange(parts, "key").sortWithinPartitions("key")
    made = stored(dealt.mapInArrow(_tries, _OPEN), "trie-nodes")
    done, opened = [made.where("not open")], made.where("open")
    n = opened.agg(F.coalesce(F.max("part"), F.lit(0))).collect()[0][0] + 1
    width = 1
    while True:
        width *= fan
        last_round = width >= n
        stretches = opened.withColumn("stretch", F.floor(F.col("part") / width).cast("long"))
        merged = stored(stretches.groupBy("stretch").applyInArrow(_closing(last_round), _OPEN), "trie-merged")
        done.append(merged.where("not open"))
        opened = merged.where("open")
        if last_round:
            break
    rows = done[0].select(*_FIELDS)
    for d in done[1:]:
        rows = rows.unionByName(d.select(*_FIELDS))
    # parents that were open when their children closed
    late = stored(rows.where("id is not null").select(F.col("id").alias("parent_id"), F.col("conv_id").alias("late_conv"), "n_children"), "trie-parents")
    known = rows.where("parent_id is null")
    waiting = rows.where("parent_id is not null")
    found = join_counted(waiting, late.withColumnRenamed("n_children", "late_n"), ["parent_id"], "late_n").withColumn("parent_conv_id", F.col("late_conv"))
    out = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    return known.select(*out).unionByName(found.select(*out))


def conversation_trie(conversations: DataFrame, range_bytes: int = RANGE_BYTES, fan: int = FAN) -> DataFrame:
    """Nodes of the prefix trie of all rebuilt conversations.

    Turns are ordered by turn (null first), those of equal turn by their id. Null roles and texts are empty, repeated rows are
    repeated turns, rows without a conv_id belong to no conversation, an empty table gives no rows. Other columns are
    left out. A conversation's ids and numbers of words (24 bytes a turn) must fit into a row.
    """
    spark = conversations.sparkSession
    turns = stored(turn_rows(conversations), "turns")
    parts = partitions_for(spark, turns.count() * 48)
    keys = stored(rebuilt(conversation_keys(turns, parts)), "rebuilt")
    return prefix_trie(distinct_keys(keys, parts), range_bytes, fan)


def op11_turn_trie(spark, sf_dir) -> DataFrame:
    return conversation_trie(read_table(spark, sf_dir, "conversations"))


_CRC = """(4294967295 - list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: ascii(x)::BIGINT)),
    lambda acc, x: list_reduce(list_prepend(xor(acc, x), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda a, z: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END)))"""

OP11_SQL = f"""
WITH t AS (SELECT conv_id AS c, turn, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS id, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS w FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT c, id, w, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, id) AS i FROM t),
cs AS (SELECT c, c - c % 20 AS base, {_CRC} % 4 AS h FROM (SELECT DISTINCT c FROM o)),
r AS (SELECT cs.c, 0 AS half, o.i, o.id, o.w FROM cs JOIN o ON o.c = cs.base AND o.i <= cs.h UNION ALL SELECT cs.c, 1, o.i, o.id, o.w FROM cs JOIN o ON o.c = cs.c AND o.i > cs.h),
s AS (SELECT cs.c, coalesce(ids, []) AS ids, coalesce(ws, []) AS ws FROM cs LEFT JOIN (SELECT c, list(id ORDER BY half, i) AS ids, list(w ORDER BY half, i) AS ws FROM r GROUP BY c) USING (c)),
m AS (SELECT c, d, len(ids) AS n, sha256(array_to_string(ids[1:d], ',')) AS k, CASE WHEN d > 0 THEN sha256(array_to_string(ids[1:d - 1], ',')) END AS up, CASE WHEN d > 0 THEN ws[d] ELSE 0 END AS w
  FROM (SELECT c, ids, ws, unnest(range(0, len(ids) + 1)) AS d FROM s)),
v AS (SELECT k, d, any_value(up) AS up, any_value(w) AS w, min(c) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE n = d), '')) AS ends_sha256 FROM m GROUP BY k, d),
kids AS (SELECT up, d - 1 AS d, count(*) AS n_children FROM v WHERE d > 0 GROUP BY ALL),
f AS (SELECT v.*, coalesce(n_children, 0) AS n_children FROM v LEFT JOIN kids ON kids.up = v.k AND kids.d = v.d),
sub AS (SELECT m.k, m.d, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((n_convs - 1) * f.w) AS saved_tokens FROM f JOIN m ON m.c = f.conv_id AND m.d <= f.d GROUP BY ALL)
SELECT f.conv_id, f.d::BIGINT AS depth, p.conv_id AS parent_conv_id, f.n_convs, f.n_children, n_leaves::BIGINT AS n_leaves, saved_tokens::BIGINT AS saved_tokens, f.ends_sha256
FROM f JOIN sub USING (k, d) LEFT JOIN v p ON p.k = f.up AND p.d = f.d - 1"""
