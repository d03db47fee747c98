"""Merged texts as segments: starts, blocks and files against the text joined by hand."""

import random

import pytest

from loreforge.operators import segments

ROWS = "w string, n long, text string"


def _rows(seed: int = 1):
    rng = random.Random(seed)
    rows = [(rng.choice("aaab"), k, "".join(rng.choice("xyzé\n😀 -") for _ in range(rng.choice([0, 1, 3, 40, 700])))) for k in range(200)]
    return rows + [("a", 7, "tie"), ("a", 7, "tie"), (None, 3, "no key"), ("a", 4, None), ("c", 1, ""), ("d", None, "null order")]


def _wholes(rows):
    out = {}
    for w, _, t in sorted((r for r in rows if r[0] is not None and r[2] is not None), key=lambda r: (r[0], r[1] if r[1] is not None else -1, r[2])):
        out.setdefault(w, []).append(t)
    return {w: segments.RULE.join(ts) for w, ts in out.items()}


def test_each_segment_is_found_at_its_start(spark):
    rows = _rows()
    whole, got = _wholes(rows), segments.text_segments(spark.createDataFrame(rows, ROWS), "w", "n").collect()
    assert len(got) == len(rows) - 2 and len({(r["w"], r["start"]) for r in got}) == len(got)
    assert all(whole[r["w"]][r["start"] : r["start"] + r["length"]] == r["text"] for r in got)
    totals = segments.segment_totals(segments.text_segments(spark.createDataFrame(rows, ROWS), "w", "n"), "w").collect()
    assert {r["w"]: r["chars"] for r in totals} == {w: len(t) for w, t in whole.items()}


@pytest.mark.parametrize("chars", [5, 64, 100_000])
def test_blocks_give_the_whole(spark, chars):
    rows = _rows(chars)
    seg = segments.text_segments(spark.createDataFrame(rows, ROWS), "w", "n")
    got = {(r["w"], r["block"]): r["text"] for r in segments.text_blocks(seg, "w", chars).collect()}
    assert got == {(w, k // chars): t[k : k + chars] for w, t in _wholes(rows).items() for k in range(0, len(t), chars)}


def test_files_give_the_whole(spark, tmp_path):
    rows = _rows(3)
    seg = segments.text_segments(spark.createDataFrame(rows, ROWS), "w", "n")
    done = {r["path"]: r["lines"] for r in segments.write_segments(seg, "w", f"file://{tmp_path}/out").collect()}
    whole = _wholes(rows)
    assert {p.name: p.read_bytes().decode() for p in (tmp_path / "out").iterdir()} == {f"{w}.md": t for w, t in whole.items()} and set(done) == {f"{w}.md" for w in whole}


def test_no_texts_and_other_columns(spark):
    assert segments.text_blocks(segments.text_segments(spark.createDataFrame([], ROWS), "w", "n"), "w").collect() == []
    odd = spark.createDataFrame([("k", 1, "t", 5, "x")], "`key` string, ord long, text string, start long, length string")
    assert segments.text_segments(odd, "key", "ord").collect() == [("k", 1, 0, 1, "t")]
