"""The stages one after another on a small corpus with planted cases."""

import random
from collections import defaultdict

from helpers import documents


WORDS = ["alpha", "beta", "gamma", "delta", "omega", "rivière", "straße", "niño", "lorem", "ipsum", "dolor", "amet", "kilo", "mega", "pico"]


def sentence(rng, n):
    """Words of a small vocabulary, so that texts repeat some as prose does."""
    return " ".join(rng.choice(WORDS) + str(rng.randrange(6)) for _ in range(n))


def test_stages_act_in_order(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(21)
    plain = [(i, sentence(rng, rng.randrange(40, 200))) for i in range(150)]
    item = sentence(rng, 30)
    shared = sentence(rng, 70)
    planted = [(300, plain[3][1]), (301, plain[4][1] + " tail"), (302, sentence(rng, 40) + " " + item + " " + sentence(rng, 40)), (303, "too short")]
    planted += [(310 + k, sentence(rng, 60) + f" {k} " + shared + f" {k} " + sentence(rng, 60)) for k in range(3)]
    documents(spark, plain + planted).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, ids = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if k < 4:
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{k}.parquet")
        docs = spark.read.parquet(f"{tmp_path}/{k}.parquet")
        ids[name] = {r["doc_id"] for r in docs.select("doc_id").collect()}
        if name == "suffix_array_dedup":
            texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    all_ids = {i for i, _ in plain + planted}
    assert all_ids - ids["quality_rules"] == {303}
    assert ids["quality_rules"] - ids["ngram_jaccard_join"] == {300, 301}
    assert all(shared not in texts[310 + k] and len(texts[310 + k]) > 400 for k in range(3)) and texts[0] == plain[0][1]
    assert ids["suffix_array_dedup"] - ids["benchmark_decontamination"] == {302}
    assert ids["best_fit_packing"] == ids["benchmark_decontamination"]
    last = defaultdict(int)
    for r in docs.collect():
        last[r["sequence_id"]] += r["length"]
    assert max(last.values()) <= 2048
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == docs.count()


def test_stages_handle_odd_rows(spark, tmp_path):
    """Nulls, empty and long texts, repeated rows and ids, columns that stages use themselves: each stage keeps rows apart."""
    import corpus_pipeline

    rng = random.Random(33)
    item = sentence(rng, 20)  # under 200 bytes, or it would be cut out as a repeat
    plain = [(i, sentence(rng, rng.randrange(40, 120))) for i in range(130)]
    odd = [(None, sentence(rng, 50)), (None, sentence(rng, 50)), (1, sentence(rng, 50)), (1, plain[1][1]), (None, None), (5, ""), (6, " \n "), (None, "two words")]
    odd += [(700, sentence(rng, 6000)), (1, sentence(rng, 30) + " " + item), (None, item + " " + sentence(rng, 30))]
    documents(spark, plain + odd).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None), (None, "a b")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, want = spark.read.parquet(f"{tmp_path}/documents.parquet"), None
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == columns
        out.write.parquet(f"{tmp_path}/o{k}.parquet")
        docs = spark.read.parquet(f"{tmp_path}/o{k}.parquet")
        got = sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["text"] or "") for r in docs.collect())
        if name == "quality_rules":
            want = sorted((i is not None, i or 0, t) for i, t in plain + odd if t and len(t.split()) >= 20)
        if name == "ngram_jaccard_join":
            want.remove((True, 1, plain[1][1]))  # the repeated row
        if name == "benchmark_decontamination":
            want = [x for x in want if item not in x[2]]
        assert [x[:2] for x in got] == [x[:2] for x in want], name
        if name != "suffix_array_dedup" and k < 2:
            assert got == want
    packed = corpus_pipeline.run(spark, str(tmp_path))
    assert packed.select("doc_id").distinct().count() == len({x[:2] for x in want if x[0]}) + 1


def test_stages_of_empty_tables(spark, tmp_path):
    import corpus_pipeline

    documents(spark, [(1, "x")]).limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
