"""Queries against their SQL in DuckDB on the smallest tables."""

import os
from collections import Counter

import duckdb
import pytest

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: Every SQL is compared by the driver at a larger size; here one or two of each module.
NAMES = ("extract_headings", "clean_markdown", "chunk_markdown", "scored_chunks", "split_sentences", "entity_density", "filter_totals", "hash_dedup_ingest", "uniform_sample", "extract_benefit_items", "log_stats_by_phase", "log_report", "tf_vectors", "validate_skills", "connected_components", "parse_skill_package", "extract_glossary", "stream_resume", "scan_call_log")


def norm(x):
    import datetime

    if x is None or x != x:
        return None
    if isinstance(x, bool):
        return x
    if isinstance(x, (int, float)) or type(x).__name__ == "Decimal":
        return round(float(x), 6)
    return tuple(map(norm, x)) if isinstance(x, list) else x.replace(tzinfo=None) if isinstance(x, datetime.datetime) else x


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, name):
    import __spark_entry__ as entry

    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    rel = con.sql(entry.oracle_sql()[name])
    assert sorted(rel.columns) == cols
    want = Counter(tuple(map(norm, r)) for r in rel.select(*[f'"{c}"' for c in cols]).fetchall())
    assert Counter(tuple(norm(r[c]) for c in cols) for r in df.collect()) == want


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0 and set(entry.oracle_sql()) <= set(entry.queries())


def test_sentences_of_odd_texts_equal_their_sql(spark, tmp_path):
    import random

    import __spark_entry__ as entry

    rng, rows = random.Random(5), [None, "", " ", "\n", "." * 1001, "a" * 2500, " " * 2500, "a" * 301 + " " + "b" * 5000]
    for odd in ("a", "\t\r\n", "\x0b", "\x1c", "\x85", "\xa0　", " ", "​", "。！保", "😀"):
        rows += ["".join(rng.choice(["a", "word", " ", "\n", ". ", "é", *odd, *(f".{c}" for c in odd)]) for _ in range(n)) for n in (5, 900, 2500) for _ in range(3)]
    spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").write.parquet(f"file://{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = con.sql(entry.oracle_sql()["split_sentences"]).select("doc_id, pos, piece").fetchall()
    got = entry.queries()["split_sentences"](spark, f"file://{tmp_path}").select("doc_id", "pos", "piece").collect()
    assert Counter(map(tuple, got)) == Counter(want)
