"""Substring search by positional grams against a scan."""

import random

import numpy as np
import pyarrow as pa
import pytest

from loreforge.operators import packaging, runs, text_search


def test_found_texts_are_those_that_hold_the_query(spark, tmp_path):
    rng = random.Random(1)
    alphabet = ["a", "b", "ab", "aba", "é", "保", "😀", " ", "\n"]
    rows = [(i // 3, i % 3, "".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 60)))) for i in range(200)] + [(90, 0, None), (91, 0, ""), (92, 0, "ab"), (93, 0, "aaaaaa")]
    df = spark.createDataFrame(rows, "doc_id long, part int, t string").repartition(3)
    index = text_search.build_text_index(df, ["doc_id", "part"], "t", f"file://{tmp_path}/index", parts=5)
    for query in ["aba", "abab", "ababa", "aaa", "aaaa", "😀 保", "é\na", "b 保a", "zzz", "abaabaaba"]:
        got = sorted((r["doc_id"], r["part"]) for r in text_search.find_texts(index, ["doc_id", "part"], query).collect())
        assert got == sorted((d, p) for d, p, t in rows if query in (t or "")), query
    with pytest.raises(ValueError):
        text_search.find_texts(index, ["doc_id", "part"], "ab")


def test_pages_and_triggers_are_the_same_with_an_index(spark, tmp_path):
    rng = random.Random(2)
    rows = [(i, 0, " ".join(rng.choice(["one", "two", "three"]) for _ in range(4)), ["Head", rng.choice(["one", "x"])], 5) for i in range(60)]
    chunks = spark.createDataFrame(rows, "doc_id long, chunk_index int, content string, heading_path array<string>, char_count int")
    index = text_search.build_text_index(chunks, ["doc_id", "chunk_index"], runs.searchable(), f"file://{tmp_path}/chunks")
    for query in ("two three", "d > one", "one", "on"):
        assert runs.search_chunks(chunks, query, 2, 5, index=index).collect() == runs.search_chunks(chunks, query, 2, 5).collect()
    entries = spark.createDataFrame([(f"s{i}", r[2].upper(), None if i % 2 else "Three ones") for i, r in enumerate(rows)], "slug string, trigger string, description string")
    index = text_search.build_text_index(entries, ["slug"], packaging.trigger_text(), f"file://{tmp_path}/triggers")
    for query in ("TWO", "three O", "e ones"):
        assert sorted(packaging.registry_find_trigger(entries, query, index).collect()) == sorted(packaging.registry_find_trigger(entries, query).collect())


def test_an_index_has_a_row_for_each_gram_and_segment(spark, tmp_path):
    """What is written grows with the characters of the texts, and nothing is shuffled for it: no row for each gram of each text."""
    rng = random.Random(3)
    rows = [(i, "".join(rng.choice("abc de") for _ in range(300))) for i in range(120)]
    df = spark.createDataFrame(rows, "idx long, t string").coalesce(2)
    index = text_search.build_text_index(df, ["idx"], "t", f"file://{tmp_path}/index")
    grams = {t[k : k + 3] for _, t in rows for k in range(298)}
    assert index.count() <= 2 * (len(grams) + 1)
    assert sorted(r["idx"] for r in text_search.find_texts(index, ["idx"], "abc d").collect()) == [i for i, t in rows if "abc d" in t]


def test_segments_hold_all_places():
    rng = random.Random(4)
    many = [chr(0x4E00 + i) for i in range(3000)]  # too many letters for 32 bits
    for letters in ("ab", "aé保😀", many, "x" * 5):
        texts = ["".join(rng.choice(letters) for _ in range(rng.choice([0, 1, 2, 3, 4, 50, 4000]))) for _ in range(30)]
        got = text_search._segment(texts, {"k0": pa.array(range(30))}, 7)
        want, start = {}, 0
        for t in texts:
            for i, g in enumerate(text_search.grams_of(t).tolist()):
                want.setdefault(g, []).append(start + i)
            start += len(t)
        lists = dict(zip(got.column("gram").to_pylist(), got.column("places").to_pylist()))
        assert text_search._unpacked(lists.pop(text_search.TEXTS)).tolist() == [len(t) for t in texts]
        assert {g: text_search._unpacked(b).cumsum().tolist() for g, b in lists.items()} == want and list(lists) == sorted(want)
    assert text_search._unpacked(text_search._packed(np.array([0, 127, 128, 16383, 16384, 1 << 31, 1 << 40]))[0].tobytes()).tolist() == [0, 127, 128, 16383, 16384, 1 << 31, 1 << 40]
