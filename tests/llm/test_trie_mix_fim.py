"""Prefix trie, mixing and fill-in-middle against plain versions, on odd rows."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from helpers import documents, hard_texts, sentence

from loreforge.llm import fill_in_middle as fim
from loreforge.llm import mixing
from loreforge.llm import turn_trie as tt

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TURNS = "conv_id long, turn long, role string, text string, conv string, id string, key string, words string, part string"


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


# ---------------------------------------------------------------- prefix trie


def brute_trie(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append(((turn is not None, turn or 0, sha(f"{len(role)}:{role}{text}")[:32]), (role, text)))
    turns = {c: [t for _, t in sorted(v)] for c, v in own.items()}
    built = {}
    for c, t in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - c % 20 if c >= 0 else c + (-c) % 20
        built[c] = tuple(turns.get(base, [])[:h] + t[h:])
    members = defaultdict(list)
    for c, seq in built.items():
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
    kids = defaultdict(list)
    for node in members:
        if node:
            kids[node[:-1]].append(node)

    def below(node):
        yield node
        for k in kids[node]:
            yield from below(k)

    out = []
    for node, convs in members.items():
        sub = list(below(node))
        saved = sum((len(members[x]) - 1) * (len(WORD.findall(x[-1][1])) if x else 0) for x in sub)
        ends = ",".join(str(c) for c in sorted(convs) if len(built[c]) == len(node))
        out.append((min(convs), len(node), min(members[node[:-1]]) if node else None, len(convs), len(kids[node]), sum(not kids[x] for x in sub), saved, sha(ends)))
    return sorted(out, key=str)


def conversations(seed):
    rng = random.Random(seed)
    texts = ["hello there", "", None, "a b c", "same words  same", "x y", "long " * 50]
    rows = []
    for c in range(0, 130):
        if c % 7 == 3:
            continue  # bases that are absent, too
        rows += [(c, t, rng.choice(["user", "assistant", None, ""]), rng.choice(texts)) for t in range(rng.choice([1, 2, 3, 5, 8]))]
    rows += [(c, t, "user", "hot") for c in range(200, 260) for t in range(4)]  # many equal ones
    rows += [(300, t, "user", f"turn {t}") for t in range(300)] + [(301, t, "user", f"turn {t}") for t in range(299)]
    rows += [(5, None, "user", "null turn"), (5, 0, "user", "hello there"), (5, 0, "user", "hello there"), (None, 1, "user", "no conversation"), (400, None, None, None), (-7, 0, "user", "negative")]
    return rows


@pytest.mark.parametrize("range_bytes,fan", [(8 << 20, 64), (600, 2), (200, 3)])
def test_trie_equals_plain_version(spark, range_bytes, fan):
    rows = conversations(range_bytes)
    df = spark.createDataFrame([(*r, "a", "b", "c", "d", "e") for r in rows], TURNS).repartition(5)
    got = sorted((tuple(r) for r in tt.conversation_trie(df, range_bytes, fan).collect()), key=str)
    assert got == brute_trie(rows)


def test_trie_of_nothing(spark):
    assert tt.conversation_trie(spark.createDataFrame([], TURNS)).collect() == []


def test_radix_tree_layouts_and_paths():
    """Nodes grow from 4 to 256 children, long paths are one node, values stay where they are."""
    rng = random.Random(5)
    keys = {bytes(rng.randrange(256) for _ in range(2)) + bytes(rng.randrange(3) for _ in range(rng.randrange(0, 40))) for _ in range(3000)}
    keys |= {k[: len(k) // 2] for k in list(keys)[:500]} | {b""}
    root, keys = tt.Node(), sorted(keys)
    for i in rng.sample(range(len(keys)), len(keys)):
        tt.insert(root, keys[i], i)

    def walk(node, at):
        here = at + node.prefix
        if node.value is not None:
            yield here, node.value
        layouts.add(node.layout)
        count = len([c for c in node.kids if c is not None])
        assert count <= node.layout and (count > {4: 0, 16: 4, 48: 16, 256: 48}[node.layout] or node.layout == 4)
        assert node.value is not None or count > 1 or not here
        for byte in range(256):
            child = node.get(byte)
            if child is not None:
                yield from walk(child, here + bytes([byte]))

    layouts = set()
    assert list(walk(root, b"")) == [(k, i) for i, k in enumerate(keys)]
    assert layouts == {4, 16, 48, 256}


# ---------------------------------------------------------------- mixing


def brute_targets(sizes, weights=(5, 2, 1), epochs=3):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, clamped = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in clamped]
        over = [s for s in free if left * w[s] / sum(w[x] for x in free) > epochs * sizes[s]]
        if not over:
            return {s: clamped[s] if s in clamped else left * w[s] / sum(w[x] for x in free) for s in names}
        clamped |= {s: epochs * sizes[s] for s in over}
        left -= sum(epochs * sizes[s] for s in over)


@pytest.mark.parametrize("case", ["mixed", "hot", "empty texts"])
def test_mix_gives_targets(spark, case):
    rng = random.Random(7)
    rows = [(i, None if rng.random() < 0.05 else sentence(rng, rng.randrange(1, 60)), "en", rng.choice(["a", "b", "é", "Z", None, "tiny"][: 5 + (i % 40 == 0)]), 0) for i in range(400)]
    if case == "hot":
        rows += [(1000 + i, "w " * 30, "en", "hot", 0) for i in range(900)]
    if case == "empty texts":
        rows = [(i, None if i % 2 else " ", "en", "a" if i % 3 else None, 0) for i in range(9)]
    rows += [(None, "one two", None, None, 0), (None, "one two", None, None, 0), (3, rows[3][1], "en", rows[3][3], 0)] if case != "empty texts" else []
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, size int").repartition(4)
    got = mixing.mix_sources(df).collect()
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix_sources(df.repartition(3)).collect()))
    sizes = defaultdict(int)
    for _, t, _, s, _ in rows:
        sizes[s] += len(WORD.findall(t or ""))
    targets = brute_targets(sizes)
    assert len(got) == len(rows)
    for s in sizes:
        assert any(abs(r["target"] - targets[s]) < 1e-6 and r["source_size"] == sizes[s] for r in got)
    for r in got:
        assert r["taken"] == r["whole"] * r["size"] + r["extra"] <= 3 * r["size"]
    assert abs(sum(r["taken"] for r in got) - sum(sizes.values())) <= len(sizes)
    by = defaultdict(int)
    for r in got:
        by[r["target"]] += r["taken"]
    want = defaultdict(int)
    for s, t in targets.items():
        want[min(by, key=lambda x: abs(x - t))] += t
    assert all(abs(by[t] - want[t]) <= len(sizes) for t in by)


def test_mixture_repeats_texts(spark):
    rng = random.Random(9)
    rows = [(i, " " + sentence(rng, rng.randrange(1, 30)) + "\n", "big" if i % 10 else "small", "x") for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, repetition string")
    mix = {r["doc_id"]: r for r in mixing.mix_sources(df).collect()}
    texts = defaultdict(list)
    for r in mixing.mixture(df).collect():
        assert r["repetition"] == "x"
        texts[r["doc_id"]].append((r["_repetition"], r["text"]))
    for i, text, *_ in rows:
        assert sum(len(WORD.findall(t)) for _, t in texts[i]) == mix[i]["taken"]
        assert all(text.startswith(t) for _, t in texts[i]) and [k for k, _ in sorted(texts[i])] == list(range(len(texts[i])))


def test_mix_of_nothing(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mix_sources(df).collect() == [] and mixing.mixture(df).collect() == []


# ---------------------------------------------------------------- fill-in-middle


def brute_fim(doc_id, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    assert "".join(units) == text
    hexes = sha(f"1:{'' if doc_id is None else doc_id}")
    h = [int(hexes[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return (doc_id, n, "plain", None, None, sha(text), sha(text))
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    form = "spm" if h[3] % 100 < 20 else "psm"
    out = f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"
    return (doc_id, n, form, len(p), len(m), sha(out), sha(text))


@pytest.mark.parametrize("size", [7, 64, fim.FRAME])
def test_fim_equals_plain_version(spark, size):
    rows = hard_texts(3) + [(200 + i, t) for i, t in enumerate(["<P>", "a<S", "x<M>y", "<", "P><S", "日本語abc語", "é" * 200, "A", "\n\n", "<<P", "z" * 500 + "é<M"])]
    df = documents(spark, rows)
    out = fim.fill_in_middle(fim.text_frames(df, size), size=size)
    got = sorted(map(str, (tuple(r) for r in fim.restored_digests(out).collect())))
    assert got == sorted(str(brute_fim(*r)) for r in rows)
    texts = sorted(sha(r["output"]) for r in fim.output_texts(out).collect())
    assert texts == sorted(brute_fim(*r)[5] for r in rows)


def test_fim_of_nothing(spark):
    assert fim.fim_documents(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_markers_over_frame_ends():
    frames = fim.Frames([{"bytes": 0, "data": b"ab<"}, {"bytes": 3, "data": b"M"}, {"bytes": 4, "data": b">c"}], bytes)
    assert frames.find(b"<M>", 0) == 2 and frames.find(b"<M>", 3) == -1 and b"".join(frames.read(1, 5)) == b"b<M>"
