"""Quality rules, decontamination, sharding, packing, licences, URL rules, pages and archives."""

import io
import re
import zipfile
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from helpers import documents, hard_texts, sentence

from loreforge.llm import decontaminate, html_wrapper, license_scan, packing, quality, sharding, url_filter, warc_zip

# ---------------------------------------------------------------- quality


def brute_counts(text):
    t = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    grams = defaultdict(list)
    for i in range(len(words) - 7):
        grams[tuple(words[i : i + 8])].append(i)
    rep = {i + k for at in grams.values() if len(at) > 1 for i in at for k in range(8)}
    seen, dup = set(), 0
    for x in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", x):
            dup += x in seen
            seen.add(x)
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), dup, len(rep), n < 20 or 100 * len(rep) > 30 * n


def test_base_counts_equal_brute_force(spark):
    rows = hard_texts() + [(500, "# a *b* $% & |<>" * 9 + "\nx\nx\n \n \nx")]
    got = Counter(tuple(r)[:7] for r in quality.judge_documents(documents(spark, rows)).collect())
    assert got == Counter((d, *brute_counts(t)) for d, t in rows)


def test_outliers_are_rejected_and_plain_texts_kept(spark):
    import random

    rng = random.Random(3)
    rows = [(i, sentence(rng, rng.randrange(25, 400))) for i in range(400)]
    rows += [(1000 + i, " ".join(w + "***$$$" for w in sentence(rng, 80).split())) for i in range(5)]
    df = documents(spark, rows)
    got = {r["doc_id"]: r["kept"] for r in quality.judge_documents(df).collect()}
    assert all(got[i] for i in range(400)) and not any(got[1000 + i] for i in range(5))
    kept = quality.keep_good_documents(df)
    assert sorted(r["doc_id"] for r in kept.collect()) == list(range(400)) and set(kept.columns) == set(df.columns)


def test_mcd_resists_outliers_and_constants():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 4)) * 0.3
    x[:, 3] = 0
    x[:300] += 5
    det, mu, s = quality.fast_mcd(x, np.array([0.09, 0.09, 0.09, quality.TINY**2]))[0]
    assert np.abs(mu).max() < 0.1 and 0.2 < np.sqrt(s[0, 0]) < 0.45 and np.isfinite(det)
    assert quality._chi2_quantile(0.975, 4) == pytest.approx(11.143, abs=0.01)


def mixed_sources(n=150):
    """Two sources with different habits, and texts in each that are odd there and plain in the other."""
    import random

    rng = random.Random(12)

    def text(long_words, k):
        ws = [rng.choice("abcdefghij") * rng.randrange(1, 3) + str(rng.randrange(8)) + ("extended" if long_words and rng.random() < 0.8 else "") for _ in range(k)]
        return " ".join(w + ("." if i % 9 == 8 else "") for i, w in enumerate(ws)).replace(". ", ".\n").title()

    rows = [(i, text(i % 2, rng.randrange(60, 200)), "en", f"s{i % 2}") for i in range(n * 2)]
    rows += [(1000 + i, text(1 - i % 2, 120), "en", f"s{i % 2}") for i in range(6)]
    return rows


def brute_verdicts(rows, tail=1e-6):
    """Distances by plain concentration steps from many starts, for each source by itself."""
    stats = quality.text_statistics([t.encode() for _, t, _, _ in rows])
    g = {k: v.astype(float) for k, v in stats.items()}
    cols = []
    for a, b, more in quality.RATIOS:
        cols.append((g[a] + more * np.sort(g[a] / g[b])[(len(rows) - 1) // 2]) / (g[b] + more))
    x = np.stack([np.log(cols[0]), np.sqrt(cols[1]), np.sqrt(cols[2]), cols[3]], axis=1)
    source = np.array([r[3] for r in rows])
    quart = np.sort(x, axis=0)
    target = np.diag(((quart[int(0.75 * len(x))] - quart[int(0.25 * len(x))]) / 1.349) ** 2)
    rng, far = np.random.default_rng(99), np.zeros(len(x))
    for s in set(source):
        y = x[source == s]
        h = int(np.ceil(0.75 * len(y)))
        best = None
        for _ in range(100):
            sub = y[rng.choice(len(y), 5, replace=False)]
            for _ in range(30):
                c = 0.9 * quality._consistency(0.75) * np.cov(sub.T, bias=True) + 0.1 * target
                d = ((y - sub.mean(0)) @ np.linalg.inv(c) * (y - sub.mean(0))).sum(axis=1)
                sub = y[np.argsort(d)[:h]]
            if best is None or np.linalg.det(c) < best[0]:
                best = (np.linalg.det(c), sub.mean(0), c)
        near = y[[(r - best[1]) @ np.linalg.solve(best[2], r - best[1]) <= quality._chi2_quantile(0.975, 4) for r in y]]
        c = 0.9 * quality._consistency(0.975) * np.cov(near.T, bias=True) + 0.1 * target
        far[source == s] = [(r - near.mean(0)) @ np.linalg.solve(c, r - near.mean(0)) for r in y]
    return far, quality._chi2_quantile(1 - tail, 4)


@pytest.mark.parametrize("block", [20_000, 50])
def test_verdicts_equal_a_brute_force_estimate(spark, monkeypatch, block):
    monkeypatch.setattr(quality, "BLOCK_ROWS", block)  # with small blocks, candidates of several meet in concentration steps
    rows = mixed_sources()
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r["doc_id"]: r for r in quality.judge_documents(df).collect()}
    far, cut = brute_verdicts(rows)
    sure = [(r[0], d) for r, d in zip(rows, far, strict=True) if not 0.6 * cut < d < 1.6 * cut]
    assert len(sure) > 0.97 * len(rows) and all(got[i]["kept"] == (d <= cut) for i, d in sure)
    # plain in the other source, so one fixed cut for all would keep them
    assert not any(got[1000 + i]["kept"] for i in range(6)) and sum(got[i]["kept"] for i in range(300)) >= 297


def test_quality_judges_rows_and_not_ids(spark):
    import random

    rng = random.Random(8)
    good = [(i, sentence(rng, 60)) for i in range(150)]
    bad = " ".join(w + "***$$$" for w in sentence(rng, 80).split())
    rows = good + [(1, bad), (None, bad), (None, "two words"), (None, good[5][1]), (1, good[1][1]), (7, None), (7, "")]
    kept = quality.keep_good_documents(documents(spark, rows)).collect()
    assert Counter((r["doc_id"], r["text"]) for r in kept) == Counter(good + [(None, good[5][1]), (1, good[1][1])])


def test_small_strata_use_the_estimate_of_their_language_or_of_all(spark):
    import random

    rng = random.Random(31)
    bad = lambda: " ".join(w + "%%%" for w in sentence(rng, 80).split())
    rows = [(i, sentence(rng, 60), "en", "big") for i in range(300)] + [(400 + i, sentence(rng, 60), "en", f"small{i}") for i in range(8)] + [(500 + i, sentence(rng, 60), None, None) for i in range(4)]
    rows += [(600, bad(), "en", "small1"), (601, bad(), "xx", "y"), (602, bad(), None, None)]
    got = {r["doc_id"]: r["kept"] for r in quality.judge_documents(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert {i for i, k in got.items() if not k} == {600, 601, 602}


def test_copies_are_not_the_norm(spark):
    import random

    rng = random.Random(41)
    base = sentence(rng, 100).split()
    rows = [(i, sentence(rng, 60), "en", "s") for i in range(200)] + [(1000 + i, " ".join(base), "en", "s") for i in range(400)]
    rows += [(2000 + i, " ".join([*base[:i % 90], f"near{i}", *base[i % 90 :]]), "en", "s") for i in range(200)]
    got = quality.judge_documents(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()
    assert sum(not r["kept"] for r in got) <= 10  # half of the different texts are near copies of one


def test_quality_of_an_empty_table(spark):
    assert quality.judge_documents(documents(spark, hard_texts()).limit(0)).count() == 0


# ---------------------------------------------------------------- decontamination


def plain_smith_waterman(a, b):
    h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
    return max(map(max, h))


def test_alignment_score_equals_the_plain_recurrence():
    rng = np.random.default_rng(1)
    for _ in range(60):
        a, b = rng.integers(0, 5, rng.integers(1, 20)), rng.integers(0, 5, rng.integers(1, 40))
        assert decontaminate.align(a, b)[0] == plain_smith_waterman(a.tolist(), b.tolist())


def test_contamination_finds_edited_copies_and_nothing_else(spark):
    import random

    rng = random.Random(11)
    items = [(i, sentence(rng, rng.randrange(20, 50))) for i in range(20)] + [(90, "too short"), (91, None), (92, "")]
    rows, planted = hard_texts(8), set()
    for k, (i, t) in enumerate(items[:20]):
        w = t.upper().split()
        for _ in range(k % 4):
            w[rng.randrange(len(w))] = "edited"
        rows.append((700 + k, sentence(rng, 60) + ", " + " ".join(w) + ". " + sentence(rng, 60)))
        planted.add((700 + k, i))
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    df = documents(spark, rows)
    got = decontaminate.find_contamination(df, bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == planted and all(0.5 <= r["score"] <= 1 for r in got)
    assert all(55 <= r["first_word"] <= 66 for r in got)
    left = decontaminate.drop_contaminated(df, bench)
    assert left.count() == len(rows) - 20 and left.columns == df.columns
    assert decontaminate.find_contamination(df, bench.limit(0)).count() == 0 and decontaminate.find_contamination(df.limit(0), bench).count() == 0


def test_matches_equal_alignment_of_all_texts_with_all_items(spark, monkeypatch):
    import random

    monkeypatch.setattr(decontaminate, "REGION_WORDS", 64)  # long texts go in many stretches
    rng = random.Random(19)
    items = [(i, sentence(rng, rng.randrange(8, 40))) for i in range(12)] + [(3, sentence(rng, 20)), (None, sentence(rng, 25))]
    rows = []
    for k in range(60):
        ws = sentence(rng, rng.randrange(5, 80)).split()
        for _ in range(rng.randrange(3)):
            t = rng.choice(items)[1].split()
            for _ in range(rng.randrange(9)):  # words changed, put in and left out
                i = rng.randrange(len(t))
                t[i : i + rng.randrange(2)] = rng.choice([[], ["edit"], ["more", "words"]])
            at = rng.randrange(len(ws))
            ws[at:at] = t
        rows.append((k if k % 9 else None, " ".join(ws)))
    rows += [rows[5], (800, None), (801, ""), (802, " ".join(t for _, t in items) * 3)]
    hash_of = lambda t: [w for w in (t or "").lower().split()]
    want = Counter()
    for d, t in rows:
        ws = hash_of(t)
        grams = {tuple(ws[k : k + 4]) for k in range(len(ws) - 3)}
        for i, it in items:
            w = hash_of(it)
            score = plain_smith_waterman(w, ws)
            # what shares no gram at all has no seed
            if score >= decontaminate.least_score(len(w), 0.5) and any(tuple(w[k : k + 4]) in grams for k in range(len(w) - 3)):
                want[(d, i, round(score / 2 / len(w), 9))] += 1
    got = decontaminate.find_contamination(documents(spark, rows), spark.createDataFrame(items, "item_id long, text string"), rare_share=1.0).collect()
    assert Counter((r["doc_id"], r["item_id"], round(r["score"], 9)) for r in got) == want and len(want) > 30


def test_contamination_is_judged_by_rows(spark):
    import random

    rng = random.Random(29)
    item, plain = sentence(rng, 30), [sentence(rng, 50) for _ in range(3)]
    bad = sentence(rng, 20) + " " + item
    rows = [(1, plain[0]), (1, bad), (None, bad), (None, plain[1]), (2, None), (2, bad), (2, plain[2])]
    left = decontaminate.drop_contaminated(documents(spark, rows), spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert Counter((r["doc_id"], r["text"]) for r in left.collect()) == Counter([(1, plain[0]), (None, plain[1]), (2, None), (2, plain[2])])


def test_stretches_of_short_items_stay_short_beside_a_long_item(spark):
    import random

    import pyarrow as pa

    rng = random.Random(31)
    short, long = sentence(rng, 17), sentence(rng, 20_000)
    text = (sentence(rng, 30_000) + " " + short + " " + sentence(rng, 30_000)).lower()
    items = next(decontaminate._item_rows([pa.record_batch({"item_id": [1, 2], "text": [short, long]})]))
    rows = [r for b in decontaminate._seed_rows([pa.record_batch({"item": [1, 2], "words": items.column("words")})]) for r in b.to_pylist()]
    seeds = spark.createDataFrame([(r["seed"], r["class"]) for r in rows], "seed long, class int")
    kinds = sorted({r["class"] for r in rows})
    classes = [(decontaminate.seed_filter(seeds.where(f"class = {k}").select("seed"), 2 * k), decontaminate.length_of(k)) for k in kinds]
    assert kinds[0] == 0 and 20_000 <= decontaminate.length_of(kinds[1]) < 80_000
    doc = pa.record_batch({"doc_id": [1], "text": [text], "h1": [0], "h2": [0], "row": [0]})
    widths = [len(r["words"]) // 8 for b in decontaminate._region_rows(classes[:1])([doc]) for r in b.to_pylist()]
    assert max(widths) < 120
    known = {r["seed"] for r in rows if r["class"] == 0}
    found = [r for b in decontaminate._region_rows(classes)([doc]) for r in b.to_pylist() if {h["seed"] for h in r["hits"]} & known]
    assert found and max(len(r["words"]) // 8 for r in found) < 120


# ---------------------------------------------------------------- sharding


def best_capacity(sizes, n):
    lo, hi = max([0, *sizes]), sum(sizes)
    while lo < hi:
        mid, at, used = (lo + hi) // 2, 0, 1
        for s in sizes:
            if at + s > mid:
                used, at = used + 1, 0
            at += s
        lo, hi = (lo, mid) if used <= n else (mid + 1, hi)
    return lo


def test_shards_are_minimax_contiguous_and_atomic(spark):
    rows = [r for r in hard_texts(6) if r[0] is not None]
    got = sharding.shard_documents(documents(spark, rows), groups_each=7, spans=3).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in rows)
    slots, sums = defaultdict(list), Counter()
    for r in got:
        slots[r["shard"]].append(r["slot"])
        sums[r["shard"]] += r["size"]
        assert r["law"] == "bytes" and r["grown_shard"] is None and 0 <= r["shard"] < 8
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    groups = defaultdict(lambda: [10**9, 0])
    for d, t in rows:
        g = groups[(t is None, t)]
        g[0], g[1] = min(g[0], d), g[1] + len((t or "").encode()) + 1
    sizes = [g[1] for _, g in sorted(groups.items(), key=lambda x: x[1][0])]
    assert max(sums.values()) == best_capacity(sizes, 8)


def test_sharding_of_nulls_and_an_empty_table(spark):
    assert sharding.shard_documents(documents(spark, hard_texts()).limit(0)).count() == 0
    assert sharding.shard_documents(documents(spark, hard_texts())).count() == len(hard_texts())


# ---------------------------------------------------------------- packing


def test_packing_is_a_round_trip_with_few_sequences(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tok.encode_special_tokens = True
    rows = [r for r in hard_texts(2) if r[0] is not None and r[0] != 100] + [(800, "it's <|endoftext|> ２３ ½ x_y  \n\n z"), (801, "\x1c\x85\xa0 a")]
    got = packing.pack_documents(documents(spark, rows)).collect()
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r["doc_id"]].append(r)
        by_seq[r["sequence_id"]].append(r)
    for d, t in rows:
        ids = np.array(tok.encode(t or "", add_special_tokens=False).ids + [0], dtype="<u4")
        ps = sorted(by_doc[d], key=lambda r: r["piece"])
        assert [p["piece"] for p in ps] == list(range(len(ps))) and sum(p["length"] for p in ps) == len(ids)
        at = 0
        for k, p in enumerate(ps):
            assert p["start"] == at and p["ids_crc32"] == zlib.crc32(ids[at : at + p["length"]].tobytes()) and (p["length"] == 2048 or k == 0)
            at += p["length"]
    for rs in by_seq.values():
        rs.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in rs] == np.cumsum([0, *(r["length"] for r in rs)])[:-1].tolist() and sum(r["length"] for r in rs) <= 2048
    assert len(by_seq) == packing.dff_bound(np.array([r["length"] for r in got]))


def test_exchange_rounds_and_bounds(spark):
    rng = np.random.default_rng(4)
    x = rng.integers(300, 1300, 3000)
    pieces = spark.createDataFrame([(int(i), 0, 0, int(n), 0) for i, n in enumerate(x)], packing._PIECES)
    got = packing.pack_pieces(pieces, items_each=250).collect()
    fill = Counter()
    for r in got:
        fill[r["sequence_id"]] += r["length"]
    alone = len(packing.best_fit_decreasing(x)[1])
    assert len(got) == len(x) and max(fill.values()) <= 2048 and packing.dff_bound(x) <= len(fill) <= alone + 12
    for n in (1, 5, 12):
        y = rng.integers(1, 2049, n)
        assert packing.dff_bound(y) <= len(packing.best_fit_decreasing(y)[1])


def test_packing_of_empty_tables_and_repeated_rows(spark):
    assert packing.pack_documents(documents(spark, hard_texts()).limit(0)).count() == 0
    got = packing.pack_documents(documents(spark, [(1, "a b")] * 3 + [(None, None)])).collect()
    assert len(got) == 4 and Counter(r["doc_id"] for r in got) == {1: 3, None: 1}
    assert len({(r["sequence_id"], r["offset"]) for r in got}) == 4


# ---------------------------------------------------------------- licences


def brute_license(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    places, labels = [], set()
    for phrase, label in license_scan.BASE_PHRASES:
        p = phrase.split()
        for i in range(len(words)):
            if words[i : i + len(p)] == p:
                places.append(i)
                labels.add(label)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def brute_method_labels(texts, words_each=8, min_share=0.8):
    """Labels and best share of each text by plain loops over all passages and shifts."""
    import math

    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    words = [split(t) for t in texts]
    df = Counter(w for ws in words for w in set(ws))
    out = []
    for ws in words:
        labels, best = set(), 0.0
        line = " " + " ".join(ws) + " "
        for label, text, phrases in license_scan.PASSAGES:
            tw = split(text)
            idf = {w: math.log((len(texts) + 1) / (df[w] + 0.5)) for w in tw if w not in license_scan.COMMON_WORDS}
            rare = sorted(idf, key=lambda w: (-idf[w], w))[:words_each]
            at = [(i, idf[w], w) for i, w in enumerate(tw) if w in rare]
            cells = defaultdict(dict)
            for pos, w in enumerate(ws):
                for i, x, v in at:
                    if v == w:
                        cells[(0, (pos - i) // 8)][i] = cells[(1, (pos - i + 4) // 8)][i] = x
            share = max((sum(c.values()) for c in cells.values()), default=0) / sum(x for _, x, _ in at)
            if share >= min_share - 1e-9 and all(f" {p} " in line for p in phrases):
                labels.add(label)
                best = max(best, share)
        out.append((labels, best))
    return out


def test_licence_places_equal_brute_force(spark):
    texts = dict((label, text) for label, text, _ in reversed(license_scan.PASSAGES))
    rows = hard_texts() + [
        (900, "The MIT License. mit-license; MIT\nLICENSE mit license"), (901, "cc by, cc by cc by"), (902, "İ GNU General Public License é Apache License"), (903, "submit license"),
        (904, "x " * 50 + texts["mit"].title()), (905, texts["bsd"] + " and more"), (906, "redistribution and use in source"), (907, "MIT LİCENSE; apache l\u0130cense \u212aey"),
    ]
    got = license_scan.scan_licenses(documents(spark, rows)).collect()
    assert Counter(tuple(r)[:6] for r in got) == Counter((d, *brute_license(t)) for d, t in rows)
    found = {r["doc_id"]: r for r in got}
    assert found[904]["labels"] == "mit" and found[905]["labels"] == "bsd" and found[906]["labels"] == "" and found[901]["labels"] == "cc-by"
    assert all(0 <= r["score"] <= 1 for r in got) and found[904]["score"] > 0.8
    assert license_scan.scan_licenses(documents(spark, rows).limit(0)).count() == 0


def test_licences_without_a_base_phrase_are_found(spark):
    """Tagged identifiers, names and parts of licence texts, none of which holds a phrase of the contract."""
    rng = __import__("random").Random(6)
    pad = lambda: sentence(rng, rng.randrange(5, 40))
    rows = [(k, f"plain text number {k}, licensed for software or open source work, clause {k}") for k in range(200)]
    cases = {
        1000: ("// SPDX-License-Identifier: GPL-3.0-or-later", "gpl-3.0"),
        1001: ("# SPDX-License-Identifier: MPL-2.0", "mpl-2.0"),
        1002: ("This package has the BSD 3-Clause license", "bsd-3-clause"),
        1003: ("see the Apache-2.0 license for details", "apache-2.0"),
        1004: ("released by us as GPLv3 license", "gpl-3.0"),
        1005: ("/* SPDX-License-Identifier: BSD-2-Clause */", "bsd-2-clause"),
        1006: ("shall be included in all copies\n * or substantial portions of the Software: the above copyright notice\n * and this permission notice shall be included in all copies\n * or substantial portions of the Software.", "mit"),
        1007: ("The licenses for most software are designed to take away your\nfreedom to share and change it.", "gpl-2.0"),
        1008: ("Distributed under the Mozilla Public License 2.0", "mpl-2.0"),
        1009: ("SPDX-License-Identifier: CC-BY-NC-SA-4.0", "cc-by-nc-sa-4.0"),
    }
    rows += [(d, pad() + "\n" + t + "\n" + pad()) for d, (t, _) in cases.items()]
    got = {r["doc_id"]: r for r in license_scan.scan_licenses(documents(spark, rows)).collect()}
    for d, (_, label) in cases.items():
        assert label in got[d]["labels"].split(","), (d, got[d]["labels"])
        assert got[d]["n_base"] == 0 and got[d]["score"] >= 0.8 or d == 1009
    assert all(got[k]["labels"] == "" and got[k]["score"] == 0 for k in range(200))


def test_files_with_several_licences_equal_brute_force(spark):
    import random

    rng = random.Random(4)
    p = license_scan.PASSAGES
    rows, want = [(k, f"plain text number {k} of this set, for software or a source of work") for k in range(300)], {}
    for n in (1, 2, 3, 4, 5, len(p)):
        for _ in range(12):
            chosen = rng.sample(p, n)
            parts = []
            for label, text, phrases in chosen:
                ws = text.split()
                if rng.random() < 0.3:  # a word put in somewhere, and comment marks
                    ws.insert(rng.randrange(len(ws)), "zzz")
                parts.append("\n * ".join([" ".join(ws[:9]), " ".join(ws[9:])]))
            rows.append((1000 + len(rows), sentence(rng, rng.randrange(60)) + "\n" + "\n and then ".join(parts) + " " + sentence(rng, 5)))
            if "zzz" not in rows[-1][1]:
                want[rows[-1][0]] = {x[0] for x in chosen}
    rows += [(5000, p[5][1] + " " + " ".join(w for x in p for w in sorted(x[1].split()))), (5001, " ".join(x[1] for x in p)), (5001, " ".join(x[1] for x in p))]
    got = license_scan.scan_licenses(documents(spark, rows)).collect()
    base = {d: set(brute_license(t)[4].split(",")) - {""} for d, t in rows}
    brute = brute_method_labels([t for _, t in rows])
    assert Counter((r["doc_id"], r["labels"], r["score"]) for r in got) == Counter((d, ",".join(sorted(base[d] | labels)), 1.0 if base[d] else round(min(1, best), 6)) for (d, _), (labels, best) in zip(rows, brute, strict=True))
    found = {r["doc_id"]: set(r["labels"].split(",")) for r in got}
    assert all(found[d] >= labels for d, labels in want.items()) and found[5001] == {x[0] for x in p}


def test_licence_words_on_the_native_path(spark):
    df = license_scan.scan_licenses(documents(spark, hard_texts()))
    assert not any(x in df._jdf.queryExecution().toString() for x in ("Python", "Arrow", "Pandas"))


# ---------------------------------------------------------------- URLs

URLS = [
    (1, "http://a.b.example.org/es/x"), (2, "https://example.org/en/19?q"), (3, "https://EXAMPLE.org"), (4, "x://y.com/fr/"), (5, "y.com/fr/"), (6, None), (7, ""), (8, "http://notexample.org/es/"),
    (9, "http://com/de/z#f"), (10, "http://a.com/de"), (11, "http://org/"), (12, "http:///p"), (12, "http:///p"), (None, "http://m.example.org/en/1"), (13, "http://q.example.net/a://b"), (14, "h\n://w.org/\n/es"),
]


def brute_rule(url):
    host = path = ""
    if url and "://" in url:
        m = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1], re.S)
        host, path = "".join(c.lower() if "A" <= c <= "Z" else c for c in m[1]), m[2]
    fits = [(len(h + p), h + p, v) for h, p, v in url_filter.BASE_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[1:] if fits else (None, None)))


@pytest.mark.parametrize("limit", [100_000, 0])
def test_url_rules_equal_brute_force(spark, limit):
    pages = spark.createDataFrame([(i, u, "h", "r") for i, u in URLS], "page_id long, url string, host string, rule string")
    rules = spark.createDataFrame(list(url_filter.BASE_RULES) * 2 + [(None, "/", "block")], "host string, path string, verdict string")
    got = url_filter.judge_urls(pages, rules, broadcast_rules=limit, prefix_hex=1).select("page_id", "host", "path", "rule", "verdict").collect()
    assert Counter(map(tuple, got)) == Counter((i, *brute_rule(u)) for i, u in URLS)
    words = spark.createDataFrame([("notexample", "block"), ("net", "allow"), ("b", "block"), (None, "block")], "word string, verdict string")
    got = url_filter.judge_urls(pages, rules, words, broadcast_rules=limit, prefix_hex=1).select("page_id", "host", "path", "rule", "verdict").collect()
    by_word = lambda h: max(((len(w), w, v) for w, v in (("notexample", "block"), ("net", "allow"), ("b", "block")) if w in re.split("[.-]", h)), default=(0, None, None))[2]
    want = [(i, *brute_rule(u)) for i, u in URLS]
    assert Counter(map(tuple, got)) == Counter((i, h, p, r, v if r else by_word(h)) for i, h, p, r, v in want)
    long = spark.createDataFrame([(1, "http://" + "a." * 5000 + "org/x")], "page_id long, url string")
    assert url_filter.judge_urls(long, rules).collect()[0]["rule"] == "org/"
    assert url_filter.judge_urls(pages, rules.limit(0)).where("rule is not null").count() == 0 and url_filter.judge_urls(pages.limit(0), rules).count() == 0


# ---------------------------------------------------------------- pages

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><p>no";</script></head><body>
<header class="site-header"><h2>Site</h2></header><nav><ul>%s</ul></nav><div class="cookie-notice">Cookies!</div><article><h1>Head &amp; tail</h1>%s<form><input value="x">Sign up</form>
<aside>Side</aside><ul><li>one<li>two</ul></article><div class="ad">Buy</div><section id="comments"><p>First!</p></section><footer>&copy; me</footer></body></html>"""


def test_pages_give_their_article(spark):
    paras = ["<p>Some  <b>bold</b>\n text&nbsp;here.<br>next</p>", "<p>Second.", "<p>Third <!-- no --> one.</p>"]
    rows = [(k, f"http://h{k % 2}.org/{k}", PAGE % ("<li><a href='/'>x</a></li>" * (k + 1), "".join(paras[: k % 3 + 1]))) for k in range(9)]
    rows += [(20, None, None), (21, "nohost", ""), (22, "http://h0.org/z", "<p>No article here.</p><div class=menu>m</div>"), (22, "http://h0.org/z", "<p>No article here.</p><div class=menu>m</div>")]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, html string, host string, text string")
    got = {r["page_id"]: r for r in html_wrapper.extract_pages(df).collect()}
    want = ["Some bold text here. next", "Second.", "Third one."]
    for k in range(9):
        assert got[k]["text"] == "\n\n".join(["Head & tail", *want[: k % 3 + 1], "one", "two"]), k
        assert got[k]["n_chars"] == len(got[k]["text"])
    assert got[20]["text"] == got[21]["text"] == "" and got[22]["text"] == "No article here."
    assert html_wrapper.extract_pages(df).count() == len(rows) and html_wrapper.extract_pages(df.limit(0)).count() == 0


def plain_tokens(forms):
    return [{"s": f, "c": 1} | ({"v": {f"t{k}": 1}, "k": 1, "n": 5, "l": 0} if f == "#" else {}) for k, f in enumerate(forms.split())]


def test_wrappers_are_union_free_expressions():
    forms = lambda seq: ["(" + t["s"] + ")?" if t.get("o") else t["s"] for t in seq]
    a = html_wrapper.fold(plain_tokens("ul li # /li li # /li /ul p # p #"))
    assert forms(a) == ["ul", "(li # /li)+", "/ul", "(p #)+"] and a[1]["g"][1]["v"] == {"t2": 1, "t5": 1}
    b = html_wrapper.align(a, html_wrapper.fold(plain_tokens("ul li # /li /ul div.ad # /div p # p #")))
    assert forms(b) == ["ul", "(li # /li)+", "/ul", "(div.ad)?", "(#)?", "(/div)?", "(p #)+"]
    assert b[1]["c"] == 2 and b[1]["g"][1]["v"] == {"t2": 2, "t5": 1}
    long = html_wrapper.fold(plain_tokens(" ".join(["tr " + "td # /td " * 30 + "/tr"] * 3)))
    assert forms(long) == ["(tr (td # /td)+ /tr)+"]


def neutral_page(rng, k, host):
    """No element and no class says what is what; the notice and the menu are the same on all pages of the host, the rest differs."""
    menu = "".join(f"<li><a href='/{host}{i}'>Menu {host} {i}</a></li>" for i in range(3 + k % 4))
    paras = [sentence(rng, rng.randrange(20, 60)) for _ in range(rng.randrange(1, 6))]
    see = "".join(f"<li><a href='/x'>{sentence(rng, 3)}</a></li>" for _ in range(4))
    inner = "".join(f"<p>{p}</p>" for p in paras)
    notice = f"<p>Do not copy the texts of {host}.</p>"
    page = f'<html><body><div class="q1"><ul>{menu}</ul></div><div class="q2"><div class="q3"><h2>Title {k}</h2>{inner}{notice}</div></div><div class="q4"><ul>{see}</ul>By {host}</div></body></html>'
    return page, "\n\n".join([f"Title {k}", *paras])


@pytest.mark.parametrize("branch", [32, 2])
def test_wrapper_alone_tells_main_text_from_template(spark, monkeypatch, branch):
    import random

    monkeypatch.setattr(html_wrapper, "BRANCH", branch)  # with few expressions in a task, a host's meet in a tree
    rng = random.Random(1)
    rows, want = [], {}
    for host in ("a.org", "b.org"):
        for k in range(40 if host == "a.org" else 7):
            page, text = neutral_page(rng, k, host)
            i = len(rows)
            rows.append((i, f"http://{host}/{k}", page))
            want[i] = text
    rows += [(900 + k, "http://a.org/copy", rows[0][2]) for k in range(80)]  # copies of one page don't make it template
    want |= {900 + k: want[0] for k in range(80)}
    got = {r["page_id"]: r["text"] for r in html_wrapper.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == want
    # by itself, a page keeps menu and notice
    assert "Do not copy" in html_wrapper.extract(rows[0][2], {"template": set(), "main": None})


def test_near_copies_of_an_article_are_not_template(spark):
    import random

    rng = random.Random(2)
    paras = [sentence(rng, 30) for _ in range(6)]
    rows = [(k, "http://c.org/x", "<article>" + "".join(f"<p>{p}</p>" for p in [*paras, f"number {k}"]) + "</article>") for k in range(12)]
    got = html_wrapper.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert all(r["text"] == "\n\n".join([*paras, f"number {r['page_id']}"]) for r in got)


def test_pages_of_odd_markup():
    empty = {"template": set(), "main": None}
    deep = "<div>" * 20_000 + "<p>deep</p>" + "</div>" * 20_000
    assert html_wrapper.extract(deep, empty) == "deep" and len(html_wrapper.page_stream(deep)) < 100
    assert html_wrapper.extract('<p>a</p><div class="x>b</div><p>c', empty) == "a\n\nb\n\nc"
    assert html_wrapper.extract("<b <p>1 < 2 &amp; 3</p></div></div>", empty).endswith("1 < 2 & 3")
    assert html_wrapper.extract("<p>x <button>Buy</button> y<br>z</p>", empty) == "x y z"


# ---------------------------------------------------------------- archives


class Bytes:
    def __init__(self, raw):
        self.raw, self.size = raw, len(raw)

    def read(self, offset, length):
        assert 0 <= offset and offset + length <= self.size
        return self.raw[offset : offset + length]


@pytest.mark.parametrize("wide", [False, True])
def test_zip_directories(wide, monkeypatch):
    if wide:  # as if offsets and counts were too large for the plain directory
        monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 10)
        monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 1)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        z.writestr("a/é.bin", b"x" * 500)
        z.writestr("b.bin", b"hello")
        z.writestr("c.txt", b"c" * 99, zipfile.ZIP_DEFLATED)
        z.comment = b"PK about"
    f = Bytes(out.getvalue())
    m = warc_zip.zip_members(f)
    assert f.read(warc_zip.member_offset(f, m["b.bin"]), m["b.bin"]["size"]) == b"hello" and m["a/é.bin"]["size"] == 500
    with pytest.raises(ValueError):
        warc_zip.member_offset(f, m["c.txt"])
    with pytest.raises(ValueError):
        warc_zip.zip_members(Bytes(b"no archive"))


def test_archives_are_a_round_trip(spark):
    import hashlib

    big, small = "é" * 60, "tiny"
    rows = [(5, "u", big), (3, None, big), (9, "u\n", big), (3, "v", big), (1, "w", small), (2, "w", small), (7, "", None), (8, "", ""), (None, "x", big), (11, "x", "a" * 100_000), (None, "q", "b" * 200)]
    df = spark.createDataFrame([(*r, "d") for r in rows], "page_id long, url string, html string, digest string").repartition(3)
    got = warc_zip.archive_round_trip(df).collect()
    want = Counter()
    for i, _, h in rows:
        raw = (h or "").encode()
        first = 3 if h == big else None
        other = first is not None and i != first
        want[(i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if other else "response", first if other else None)] += 1
    assert Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got) == want
    assert {bytes(r["payload"]) for r in got if r["payload"] is not None} == {(h or "").encode() for _, _, h in rows}
    assert warc_zip.archive_round_trip(df.limit(0)).count() == 0


def foreign_record(kind, ident, url, body, more=()):
    head = ["WARC/1.0", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{ident}>", "WARC-Date: 2020-02-02T02:02:02Z", *([f"WARC-Target-URI: {url}"] if url else []), *more, f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


@pytest.mark.parametrize("index", ["cdxj", "gz", "none", "plain"])
def test_archives_of_other_writers(spark, tmp_path, index):
    """Two WARC files of any name, in members of the gzip and zipfile modules; an index by its lines, compressed, or none."""
    import gzip
    import json

    http = ("Content-Type: application/http; msgtype=response",)
    bodies = [b"<p>one</p>", b"", b"x" * 70_000, "é".encode()]
    blobs, lines, want = [], [], Counter()
    for k in range(2):
        raw, at = [], 0
        records = [foreign_record("warcinfo", f"i{k}", None, b"software: other")]
        records += [foreign_record("response", f"r{k}{j}", f"http://o.org/{j}", b"HTTP/1.0 200 OK\r\nServer: y\r\n\r\n" + x, http) for j, x in enumerate(bodies)]
        records += [foreign_record("request", f"q{k}", "http://o.org/q", b"GET / HTTP/1.0\r\n\r\n", ("Content-Type: application/http; msgtype=request",))]
        for j, r in enumerate(records):
            p = r if index == "plain" else gzip.compress(r)
            if 1 <= j <= len(bodies):
                lines.append(f'org,o)/{j} 20200202020202 ' + json.dumps({"url": f"http://o.org/{j}", "offset": str(at), "length": str(len(p)), "filename": f"crawl-{k}.warc.gz"}))
                want[(f"urn:uuid:r{k}{j - 1}", bodies[j - 1])] += 1
            raw.append(p)
            at += len(p)
        blobs.append(b"".join(raw))
    path = tmp_path / "other.wacz"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_STORED) as z:
        z.writestr("datapackage.json", "{}", zipfile.ZIP_DEFLATED)
        z.writestr("pages/pages.jsonl", '{"format": "json-pages-1.0"}\n')
        for k, b in enumerate(blobs):
            z.writestr(f"some/where/crawl-{k}.warc" + ("" if index == "plain" else ".gz"), b)
        text = ("!meta 0 {}\n" + "\n".join(lines)).encode()
        if index == "cdxj":
            z.writestr("indexes/any-name.cdxj", text)
        elif index == "gz":
            z.writestr("indexes/index.cdx.gz", gzip.compress(text[:300]) + gzip.compress(text[300:]))
    archives = spark.createDataFrame([(f"file://{path}",)], "path string")
    got = warc_zip.read_records(warc_zip.read_index(archives)).collect()
    assert Counter((r["record_id"], bytes(r["payload"])) for r in got) == want
    assert all(r["page_id"] is None and r["date"] == "2020-02-02T02:02:02Z" and r["payload_bytes"] == len(r["payload"]) for r in got)


def test_damaged_records_are_errors(spark):
    import hashlib

    good = warc_zip.warc_record(1, "u", b"abc", hashlib.sha256(b"abc").hexdigest(), None, "2020-01-01T00:00:00Z")
    assert warc_zip.parse_record(good)["payload"] == b"abc" and warc_zip.parse_record(warc_zip.warcinfo("2020-01-01T00:00:00Z"))["record_type"] == "warcinfo"
    for bad in (good[:40], warc_zip.warc_record(1, "u", b"abc", "00", None, "2020-01-01T00:00:00Z"), b"nothing"):
        with pytest.raises((ValueError, zlib.error)):
            warc_zip.parse_record(bad)


def test_equal_rows_are_spread_over_packing_partitions(spark):
    """1,000 rows of no id and no text, and some of one text: dealt by row, packed as tightly as others."""
    rows = [(None, None)] * 1000 + [(1, "some words of one text " * 40)] * 300
    pieces = packing.token_pieces(documents(spark, rows))
    got = packing.pack_pieces(pieces, items_each=100).collect()
    assert Counter((r["doc_id"], r["length"]) for r in got)[(None, 1)] == 1000 and len(got) == 1300
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert all(sorted(v)[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(sorted(v), sorted(v)[1:])) and sum(n for _, n in v) <= 2048 for v in by.values())
    total = sum(r["length"] for r in got)
    assert len(by) <= -(-total // 2048) + 20


def _neutral_page(rng, k):
    """A page whose element and class names say nothing: links, a notice on some, a body of differing paragraphs, a foot."""
    links = "".join(f'<div class="c{i}"><a href="#">Link {i}</a></div>' for i in range(6))
    notice = '<div class="n">We changed our terms.</div>' if k % 10 < 6 else '<div class="n">Hello.</div>' if k % 10 == 6 else ""
    paragraphs = [sentence(rng, rng.randrange(5, 30)) for _ in range(rng.randrange(1, 5))]
    body = "".join(f'<div class="p">{p}</div>' for p in paragraphs)
    return f'<html><body><div class="a">{links}</div>{notice}<div class="b">{body}</div><div class="f">All rights reserved.</div></body></html>', paragraphs


def test_template_and_container_equal_brute_force(spark):
    """Texts of a host's pages counted one by one give the same template, and the differing container is the main text."""
    import json
    import random

    rng = random.Random(12)
    made = [_neutral_page(rng, k) for k in range(150)]
    rows = [(k, f"http://{'one' if k % 3 else 'two'}.org/{k}", page) for k, (page, _) in enumerate(made)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(7)
    hosted = df.withColumn("host", html_wrapper.host_of(df["url"]))
    for row in html_wrapper.infer_wrappers(hosted).collect():
        own = [page for _, url, page in rows if f"//{row['host']}/" in url]
        n = Counter()
        for page in own:
            n.update({(e.place.path, html_wrapper.digest(t)) for e in html_wrapper.events(page) if isinstance(e, html_wrapper.Text) and (t := html_wrapper.squeezed(e.text))})
        want = {x for x, c in n.items() if c >= max(html_wrapper.LEAST_PAGES, html_wrapper.SHARE * len(own))}
        assert {(p, d) for p, d in json.loads(row["model"])["template"]} == want and len(want) == 8
    got = {r["page_id"]: r["text"] for r in html_wrapper.extract_pages(df).collect()}
    assert all(got[k] == "\n\n".join(paragraphs) for k, (_, paragraphs) in enumerate(made))


def test_names_within_an_article_drop_only_what_they_say_as_a_whole(spark):
    page = """<body><nav>Menu</nav><article class="post"><h1>Title</h1><section class="related-work">Earlier papers.</section><div id="search-algorithms">Binary search.</div>
      <div class="share-of-costs">Costs.</div><div class="comment-list">A reader.</div><div class="related-posts">More.</div><div class="share-buttons">Tweet</div><div class="ad-box">Buy</div><p>End.</p></article></body>"""
    df = spark.createDataFrame([(1, "http://x.org/1", page)], "page_id long, url string, html string")
    assert html_wrapper.extract_pages(df).collect()[0]["text"] == "Title\n\nEarlier papers.\n\nBinary search.\n\nCosts.\n\nEnd."


def test_frequent_texts_of_a_slot_are_never_driven_out():
    """Whatever the order in which pages meet, a text of half of them is among the counters with at most what they lost missing."""
    import random

    rng = random.Random(3)
    streams = [[{"s": "#", "c": 1, "v": {("t" if k % 2 else f"x{k}"): 1}, "k": 1, "n": 5, "l": 0}] for k in range(2000)]
    for _ in range(3):
        rng.shuffle(streams)
        parts = [[dict(t, v=dict(t["v"])) for t in s] for s in streams]
        while len(parts) > 1:
            parts = [html_wrapper.merged(parts[i : i + 7], 7) for i in range(0, len(parts), 7)]
        t = parts[0][0]
        assert t["v"]["t"] <= 1000 <= t["v"]["t"] + t.get("e", 0) and t.get("e", 0) <= 2000 / html_wrapper.TEXTS and len(t["v"]) <= 2 * html_wrapper.TEXTS


def test_long_repeats_are_folded():
    body = [f"div.k{i}" for i in range(90)] + ["#"] + ["/div"] * 90
    toks = lambda forms: [{"s": f, "c": 1, "v": {"d": 1}, "k": 1, "n": 1, "l": 0} if f == "#" else {"s": f, "c": 1} for f in forms]
    once = html_wrapper.fold(toks(["main", *body, *body, *body]))
    assert len(once) == 2 and once[1]["s"].endswith(")+")
