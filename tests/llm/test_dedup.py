"""n-gram Jaccard join and repeated-string removal against brute force."""

import hashlib
from collections import Counter

from helpers import documents, hard_texts, sentence

from loreforge.llm import ngram_join, suffix_dedup
from loreforge.llm.components import components


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute_components(rows):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            c = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * c >= 75 * (len(sets[i]) + len(sets[j]) - c):
                parent[find(i)] = find(j)
    ids = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            ids[find(i)] = min(d, ids.get(find(i), d))
    return Counter((d, len(sets[i]), ids.get(find(i)) if sets[i] else d) for i, (d, _) in enumerate(rows))


def test_join_equals_brute_force_on_hard_cases(spark):
    rows = hard_texts()
    got = Counter(tuple(r) for r in ngram_join.join_documents(documents(spark, rows)).collect())
    assert got == brute_components(rows)


def test_join_of_near_copies_over_all_sizes_and_hot_words(spark):
    import random

    rng = random.Random(5)
    rows, k = [], 0
    for size in (1, 3, 5, 6, 7, 9, 12, 20, 33, 60, 150, 400):
        for _ in range(3):
            base = sentence(rng, size).split()
            rows.append((k, " ".join(base)))
            for edits in (1, size // 40 + 1, size // 25 + 1):
                w = list(base)
                for _ in range(edits):
                    w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
                k += 1
                rows.append((k, " ".join(w + ["the same tail of words here"] * (size > 100))))
            k += 1
    got = Counter(tuple(r) for r in ngram_join.join_documents(documents(spark, rows)).collect())
    assert got == brute_components(rows)


def test_join_of_texts_cut_short_by_a_quarter(spark):
    import random

    rng = random.Random(23)
    rows = []
    for part, whole in ((60, 80), (61, 80), (180, 240), (182, 240), (540, 720), (545, 720)):  # J of 0.75 to 0.7625
        for _ in range(30):
            words = [f"w{rng.randrange(10**9)}" for _ in range(whole + 4)]
            rows += [(len(rows), " ".join(words)), (len(rows) + 1, " ".join(words[: part + 4]))]
    for often in (1, 12):
        got = Counter(tuple(r) for r in ngram_join.join_documents(documents(spark, rows), often=often).collect())
        assert got == Counter((i, len(shingles(t)), i - i % 2) for i, t in rows)


def test_cuts_do_not_fall_with_the_size():
    for band in range(8):
        sizes = [s for s in range(1, ngram_join.BAND ** (band + 1) * 2) if band in dict(ngram_join.bands_of(s))]
        cuts = [ngram_join.cut(band, s) for s in sizes]
        assert cuts == sorted(cuts) and all(ngram_join.least_cut(band, s) <= c for s, c in zip(sizes, cuts, strict=True))


def test_star_rounds_lose_no_link(spark):
    import random

    rng = random.Random(9)
    base = sentence(rng, 100).split()
    rows = []
    for i in range(30):  # variants near the base and not near each other, in random order
        w = list(base)
        at = (i * 3) % 90
        w[at : at + 5] = [f"v{i}x{j}" for j in range(5)]
        rows.append((rng.randrange(10**6), " ".join(w)))
    rows.append((5, " ".join(base)))
    got = Counter(tuple(r) for r in ngram_join.join_documents(documents(spark, rows)).collect())
    assert got == brute_components(rows)


def test_allocation_leaves_hot_segments_out_and_makes_up_for_them():
    band = 4
    cells = {(band * ngram_join.CLASSES + c) * ngram_join.CELLS + k: 10 for c in range(ngram_join.CLASSES) for k in range(ngram_join.CELLS)}
    cells[(band * ngram_join.CLASSES + 7) * ngram_join.CELLS + 3] = 5000
    alloc = ngram_join.allocate(cells)[band]
    m = len(alloc)
    assert alloc[7 % m] == 0 and (alloc == 2).sum() == (alloc == 0).sum() and alloc.sum() >= m - 1


def test_deletion_neighbours_still_find_all(spark, monkeypatch):
    real = ngram_join.allocate

    def odd(cells, **k):
        out = real(cells, **k)
        for a in out.values():
            a[::5] = 0
            a[1::5] = 2
        return out

    monkeypatch.setattr(ngram_join, "allocate", odd)
    rows = hard_texts(3)
    got = Counter(tuple(r) for r in ngram_join.join_documents(documents(spark, rows)).collect())
    assert got == brute_components(rows)


def test_frequent_signatures_set_aside(spark):
    rows = hard_texts(7)
    shared = sentence(__import__("random").Random(3), 40)
    rows += [(400 + i, sentence(__import__("random").Random(i), 150) + " " + shared) for i in range(20)]
    rows += [(500 + i, rows[-1][1] + f" end{i}") for i in range(20)]
    for often in (2, 5):
        got = Counter(tuple(r) for r in ngram_join.join_documents(documents(spark, rows), often=often).collect())
        assert got == brute_components(rows)


def test_sets_around_common_passages(spark):
    import random

    rng = random.Random(17)
    passages = [sentence(rng, 40) for _ in range(3)]
    passages.append(passages[0] + " " + sentence(rng, 3))  # classes of nearly equal frequent shingles
    rows = []
    for p in passages:
        for extra in [0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 14, 16, 20, 30] * 2:
            front = rng.randrange(extra + 1)
            rows.append((len(rows), " ".join([*(f"a{rng.randrange(10**6)}" for _ in range(front)), p, *(f"b{rng.randrange(10**6)}" for _ in range(extra - front))])))
    rng.shuffle(rows)
    for often in (1, 3, 12):
        got = Counter(tuple(r) for r in ngram_join.join_documents(documents(spark, rows), often=often).collect())
        assert got == brute_components(rows)


def test_one_of_each_group(spark):
    rows = [r for r in hard_texts() if r[0] is not None]
    keep = {c for _, _, c in brute_components(rows)}
    out = ngram_join.one_of_each_group(documents(spark, rows))
    assert sorted(r["doc_id"] for r in out.collect()) == sorted(keep) and out.columns == documents(spark, rows).columns


def test_join_and_removal_of_an_empty_table(spark):
    empty = documents(spark, hard_texts()).limit(0)
    assert ngram_join.join_documents(empty).count() == 0
    assert suffix_dedup.removal_report(empty).count() == 0
    assert suffix_dedup.remove_repeats(empty).count() == 0


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 150)] + [(7, 7)]
    got = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {i: 0 for i in range(41)} | {k: 100 for k in range(100, 150)}


def brute_removal(rows):
    texts = [(d, (t or "").encode()) for d, t in rows]
    count = Counter(t[s : s + 200] for _, t in texts for s in range(len(t) - 199))
    out = Counter()
    for d, t in texts:
        cov = bytearray(len(t))
        for s in range(len(t) - 199):
            if count[t[s : s + 200]] > 1:
                cov[s : s + 200] = b"\x01" * 200
        spans = sum(1 for i in range(len(t)) if cov[i] and (not i or not cov[i - 1]))
        out[(d, len(t), sum(cov), spans, hashlib.sha256(bytes(x for x, c in zip(t, cov, strict=True) if not c)).hexdigest())] += 1
    return out


def passages():
    import random

    rng = random.Random(2)
    shared = sentence(rng, 60)
    rows = hard_texts(4)
    rows += [(200 + i, sentence(rng, 20) + f" {i} " + shared + f" {i} " + sentence(rng, 20)) for i in range(12)]
    rows += [(300, "q" * 199), (301, "q" * 199), (302, "w" * 200), (303, "w" * 200), (304, "é" * 150 + "z"), (305, "é" * 150 + "y"), (306, shared[:150] + "!" + shared[151:400])]
    return rows


def test_removal_equals_brute_force(spark):
    rows = passages()
    got = Counter(tuple(r) for r in suffix_dedup.removal_report(documents(spark, rows)).collect())
    assert got == brute_removal(rows)


def test_removal_across_bucket_boundaries(spark):
    import random

    rng = random.Random(51)
    rows = passages()
    hot = sentence(rng, 30)
    rows += [(500 + i, f"{rng.random()} " * 9 + hot + f" {i % 4} {i % 7}" * 40) for i in range(60)]  # one string in many contexts
    for most in (1, 10):
        got = Counter(tuple(r) for r in suffix_dedup.removal_report(documents(spark, rows), bucket_bytes=300, most_contexts=most).collect())
        assert got == brute_removal(rows)


def test_anchors_cover_each_window_once():
    import numpy as np

    rng = np.random.default_rng(0)
    for n in (200, 201, 350, 5000):
        for low in (2, 250):
            v = suffix_dedup._gram_values(rng.integers(0, low, n).astype(np.uint8))
            first, run, p = suffix_dedup.anchors(v)
            assert run.sum() == n - 199 and (np.cumsum(np.r_[0, run[:-1]]) == first).all()
            assert (p >= first + run - 1).all() and (p - first <= 152).all()


def test_remove_repeats_keeps_columns_and_characters(spark):
    rows = [(304, "é" * 150 + "z"), (305, "é" * 150 + "y"), (306, None), (307, "plain")]
    df = documents(spark, rows)
    out = {r["doc_id"]: r for r in suffix_dedup.remove_repeats(df).collect()}
    assert suffix_dedup.remove_repeats(df).columns == df.columns
    assert out[304]["text"] == "z" and out[306]["text"] is None and out[307]["text"] == "plain" and out[304]["n_chars"] == 1


def test_rows_of_one_id_are_told_apart_by_their_texts(spark):
    import random

    rng = random.Random(6)
    t = [sentence(rng, 50) for _ in range(6)]
    rows = [(1, t[0]), (1, t[1]), (2, t[2]), (None, t[3]), (None, t[4])]
    assert sorted(r["text"] for r in ngram_join.one_of_each_group(documents(spark, rows)).collect()) == sorted(t[:5])
    rows += [(1, t[0]), (0, t[1] + " end"), (None, t[2]), (None, None), (3, ""), (3, ""), (None, t[5]), (None, t[5]), (9, t[5].replace("a", "A"))]
    out = ngram_join.one_of_each_group(documents(spark, rows)).collect()
    want = Counter([(1, t[0]), (0, t[1] + " end"), (2, t[2]), (None, t[3]), (None, t[4]), (None, None), (3, ""), (3, ""), (9, t[5].replace("a", "A"))])
    assert Counter((r["doc_id"], r["text"]) for r in out) == want


def test_leader_rounds_until_few_pairs_are_left(spark):
    """Texts made of frequent passages in many combinations: classes of one hot shingle that aren't linked to each other."""
    import random

    rng = random.Random(77)
    parts = [sentence(rng, 12) for _ in range(9)]
    rows = []
    for i in range(220):
        rows.append((i, " ".join(rng.sample(parts, 5)) + (f" x{i}" if i % 3 else "")))
    got = Counter(tuple(r) for r in ngram_join.join_documents(documents(spark, rows), often=2).collect())
    assert got == brute_components(rows)


def test_removal_of_many_equal_rows_is_listed_once(spark, monkeypatch):
    """2,000 equal rows and rows with columns named like those of the operator: each row's runs are listed once."""
    import random

    rng = random.Random(3)
    text, other = sentence(rng, 60), sentence(rng, 60)
    rows = [(1, text)] * 2000 + [(2, other), (3, "x" + text[:250] + "y" + sentence(rng, 30))]
    df = documents(spark, rows).selectExpr("*", "doc AS _doc", "key AS _runs", "key AS run_doc", "n AS runs")
    lists = suffix_dedup._with_runs(df, "found").where("doc_id = 1").selectExpr("max(size(found)) AS n").collect()[0]["n"]
    assert 0 < lists < 100
    out = suffix_dedup.remove_repeats(df)
    assert out.columns == df.columns
    got = Counter((r["doc_id"], r["text"], r["_doc"], r["_runs"]) for r in out.collect())
    assert got[(1, "", "x", "y")] == 2000 and got[(2, other, "x", "y")] == 1
    report = Counter(tuple(r) for r in suffix_dedup.removal_report(df).collect())
    assert max(report.values()) == 2000 and sum(report.values()) == len(rows)
