"""Streams that stop and go on, late records, percentiles by selection, terms of a source."""

import datetime
import random

from pyspark.sql import functions as F

from loreforge.operators import logstats, validate
from loreforge.streaming import streams

DAY = datetime.datetime(2024, 1, 1)


def at(day, hour=12):
    return DAY + datetime.timedelta(days=day, hours=hour)


def test_new_documents_once_over_a_stop(spark, tmp_path):
    folder, out = f"{tmp_path}/in", f"{tmp_path}/out"
    schema = "doc_name string, markdown string"
    long = "# Head\n\n" + "必须 some words here. " * 40

    def arrive(rows):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(folder)
        known = spark.createDataFrame([("registered",)], "t string").select(F.sha2("t", 256).alias("hash"))
        q = streams.stream_new_documents(spark.readStream.schema(schema).parquet(folder), f"{out}/chunks", f"{out}/state", known)
        q.awaitTermination()
        return sorted((r["doc_name"], r["hash"]) for r in spark.read.parquet(f"{out}/chunks").select("doc_name", "hash").distinct().collect())

    first = arrive([("a", long), ("b", "short text"), ("k", "registered")])
    assert [d for d, _ in first] == ["a", "b"]
    second = arrive([("c", long), ("d", "another"), ("e", "another"), ("k2", "registered")])
    assert [d for d, _ in second][:2] == ["a", "b"] and len(second) == 3 and second[2][0] in "de"
    assert arrive([("f", "another")]) == second  # state outlives the stop


def test_late_calls_within_and_beyond_the_delay(spark, tmp_path):
    folder, out = f"{tmp_path}/in", f"{tmp_path}/out"
    schema = "ts timestamp, phase string, tokens long, latency_ms long"

    def arrive(rows):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(folder)
        streams.write_log_stats(spark.readStream.schema(schema).parquet(folder), f"{out}/stats", f"{out}/state", "2 days").awaitTermination()
        return {(r["day"], r["phase"]): r["calls"] for r in spark.read.schema("day timestamp, phase string, calls long").parquet(f"{out}/stats").collect()}

    assert arrive([(at(0), "p", 1, 10), (at(1), "p", 1, 10)]) == {}  # no window has passed
    got = arrive([(at(0, 1), "p", 1, 20), (at(5), "p", 1, 10)])  # late within the delay
    assert got == {(at(0, 0), "p"): 2, (at(1, 0), "p"): 1}
    got = arrive([(at(0), "p", 1, 10), (at(4), "p", 1, 10), (at(20), "q", 1, 10)])  # beyond the delay; within
    assert got == {(at(0, 0), "p"): 2, (at(1, 0), "p"): 1, (at(4, 0), "p"): 1, (at(5, 0), "p"): 1}


def test_percentiles_by_selection(spark):
    rng = random.Random(2)
    rows = [("hot", rng.choice([7, 7, 7, rng.randrange(10**12)])) for _ in range(3000)] + [("one", 5), ("same", 3), ("same", 3), ("null", None), (None, 4), (None, 9), ("neg", -5), ("neg", 2**60), ("neg", 0)]
    rows += [("wide", 3**k) for k in range(39)]
    df = spark.createDataFrame(rows, "phase string, latency_ms long").repartition(3)
    want = {}
    for p in {p for p, _ in rows}:
        v = sorted(x for q, x in rows if q == p and x is not None)
        want[p] = (v[len(v) // 2], v[min(int(len(v) * 0.95), len(v) - 1)]) if v else (None, None)
    for ranges in (2, 1024):
        got = {r["phase"]: (r["p50"], r["p95"]) for r in logstats.latency_percentiles(df, ranges=ranges).collect()}
        assert got == want
    floats = df.where("latency_ms is not null").withColumn("latency_ms", F.col("latency_ms") / 7)
    got = {r["phase"]: r["p50"] for r in logstats.latency_percentiles(floats).collect()}
    assert got == {p: v[0] / 7 for p, v in want.items() if v[0] is not None}
    assert logstats.latency_percentiles(df.limit(0)).collect() == []


def test_terms_are_found_as_in_the_whole_source(spark):
    rng = random.Random(4)
    parts = ["Table", "tables", "unTABLEd", "保险", "保险合同", "合同条款说明", "K", "İstanbul", "kelvin", "x1y2", "word", "sword", "é", " ", ". ", "_", "12"]
    rows = [(i, "".join(rng.choice(parts) for _ in range(30)), "".join(rng.choice(parts) for _ in range(60))) for i in range(200)] + [(900, "some words here", None), (901, None, "text"), (902, "", "")]
    df = spark.createDataFrame(rows, "id int, body string, source_text string")
    got = validate.hallucination_check(df).withColumn("want", F.size(F.filter(validate.key_terms("body"), lambda t: ~F.contains(F.lower("source_text"), t))))
    out = got.select("id", "n_terms", "n_missing", "want", "suspicious").collect()
    assert all(r["n_missing"] == r["want"] for r in out if r["id"] < 900) and any(r["n_missing"] for r in out) and any(r["n_terms"] > r["n_missing"] for r in out)
    assert not any(r["suspicious"] for r in out if r["id"] >= 900)
