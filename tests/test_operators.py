"""Operators on small inputs, against plain Python where the result isn't evident."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loreforge.operators import chunking, classify, density, glossary, graph, logstats, markdown, packaging, requests, runs, similarity, validate


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "t string").select(expr(F.col("t")).alias("r")).collect()[0]["r"]


def chunks(spark, text, **k):
    df = spark.createDataFrame([(1, "book", text)], "doc_id long, doc_name string, markdown string")
    return chunking.chunk_markdown(df, **k).orderBy("chunk_index").collect()


def test_clean_markdown_drops_noise(spark):
    text = "# A\n\n 12 \n\n---\nbody\n\n\n\n\n## References\n\n[1] x\n\n### Inner\nkept\n"
    assert one(spark, text, markdown.clean_markdown) == "# A\n\nbody\n\n### Inner\nkept"
    assert one(spark, "", markdown.clean_markdown) == "" and one(spark, " \n\n", markdown.clean_markdown) == ""


def test_heading_paths(spark):
    df = spark.createDataFrame([(1, "# a\nx\n### b\n## c\n#### d\n# e\n#nope # no")], "doc_id long, markdown string")
    rows = markdown.heading_path(df).orderBy("pos").collect()
    assert [r["heading_path"] for r in rows] == [["a"], ["a", "b"], ["a", "c"], ["a", "c", "d"], ["e"]]
    assert [r["start_pos"] for r in rows] == [0, 6, 12, 17, 24] and rows[-1]["end_pos"] == 38


def test_strategies(spark):
    books = "".join(f"## H{i}\n\n{'word ' * 80}\n\n" for i in range(6))
    got = chunks(spark, books)
    assert {r["strategy"] for r in got} == {"heading_ast"} and [r["chunk_index"] for r in got] == list(range(6))
    assert got[2]["heading_path"] == ["H2"] and got[2]["context"] == "文档：《book》 | 章节：H2"
    assert chunks(spark, "para one. " * 30 + "\n\n" + "para two. " * 30)[0]["strategy"] == "paragraph"
    wall = chunks(spark, "sentence here. " * 500)
    assert wall[0]["strategy"] == "sliding_window" and all(r["char_count"] <= 3000 for r in wall) and len(wall) > 2
    turns = chunks(spark, "\n".join(f"Turn {i}\n" + "talk " * 60 for i in range(4)))
    assert len(turns) == 4 and turns[0]["strategy"] == "conversation_turn"
    assert chunks(spark, "") == [] and chunks(spark, "\n \n") == []


def test_short_chunks_merge_and_long_ones_split(spark):
    text = "".join(f"## H{i}\n\n{'w ' * (10 if i % 2 else 150)}\n\n" for i in range(6)) + "## Big\n\n" + "A long one. " * 600
    got = chunks(spark, text)
    assert "## H1" in got[0]["content"] and got[0]["heading_path"] == ["H0"]
    # one pass: the heading and the long paragraph after it are parted, and the paragraph isn't cut again
    assert [r["heading_path"] for r in got[-2:]] == [["Big"], ["Big"]] and got[-2]["content"] == "## Big"
    assert "".join("".join(r["content"].split()) for r in got) == "".join(text.split())


def test_no_letters_are_lost_without_sentence_ends(spark):
    got = chunks(spark, "x" * 10000)
    assert "".join(r["content"] for r in got) == "x" * 10000


def test_html_keeps_br_and_drops_scripts(spark):
    html = "<body><h2 class=a>T <i>x</i></h2><script>var a='<p>';</script><p>one<br>two <b>bold</b> &amp;lt;</p><ul><li>i</ul><img src=a></body>"
    assert one(spark, html, markdown.html_to_markdown) == "## T x\n\none\ntwo **bold** &lt;\n\n- i"


def test_density_and_filter(spark):
    df = spark.createDataFrame([(1, "nothing at all to say here or there"), (2, "必须 be done"), (3, "because x = 5 KB then y ≥ 3.5 ms (see this)\n- a\n| b | c |")], "id int, content string")
    r = {x["id"]: x for x in density.filter_chunks(df).collect()}
    assert not r[1]["keep"] and r[2]["keep"] and r[2]["has_anchor"] and r[3]["score_a"] == 5
    assert one(spark, "1.2.3 a1 4 v5", lambda c: F.regexp_count(c, F.lit("(?U)" + density.NUMBER))) == 3


def test_frontmatter_and_validation(spark):
    raw = '---\nname: 123\ntrigger: "go"\nprerequisites:\n  - a\n  - "b"\nname: last\n---\n# Do\n1. kubernetes cluster restart nodes'
    df = spark.createDataFrame([(1, raw, "kubernetes cluster restart nodes"), (2, raw, "nothing alike"), (3, "---\ntrigger: x\n---\n", None), (4, "```yaml\nname: y\nconfidence: high\n```\nbody text", ""), (5, "", "")], "id int, raw_text string, source_text string")
    r = {x["id"]: x for x in validate.validate_skills(df).collect()}
    assert r[1]["status"] == "pass" and r[1]["name"] == "last" and r[1]["prerequisites"] == ["a", "b"] and r[1]["domain"] == "general"
    assert r[2]["status"] == "fail_hallucination" and r[3]["status"] == "pass" and r[5]["status"] == "fail_incomplete"
    assert r[4]["trigger"] == validate.DEFAULT_TRIGGER and r[4]["confidence"] == 0.5


def test_answers_are_cut_between_skills_only(spark):
    text = "---\nname: a\ntrigger: t\n---\nbody a\n\n---\nname: b\ntrigger: u\n---\nbody b\n---\n"
    df = spark.createDataFrame([(1, text), (2, "plain one\n---\nplain two"), (3, "EMPTY_BLOCK")], "id int, output_clean string")
    got = [(r["id"], r["raw_text"]) for r in requests.split_candidates(df).orderBy("id", "pos").collect()]
    assert got == [(1, "---\nname: a\ntrigger: t\n---\nbody a"), (1, "---\nname: b\ntrigger: u\n---\nbody b"), (2, "plain one"), (2, "plain two")]


def test_slugs(spark):
    assert one(spark, "  Héllo World!! ", validate.slugify) == "h-llo-world" and one(spark, "!!", validate.slugify) == "unnamed"
    assert one(spark, "A_b  c.d", validate.kebab_slug) == "a-b-cd" and one(spark, "..", validate.kebab_slug) == "unnamed-skill"


def test_greedy_clusters_equal_the_sequential_loop(spark):
    rng = random.Random(4)
    n, pairs = 60, set()
    for _ in range(90):
        a, b = rng.sample(range(60), 2)
        pairs.add((min(a, b), max(a, b)))
    lead = {}
    for i in range(n):
        if i not in lead:
            lead[i] = i
            for j in range(i + 1, n):
                if j not in lead and (i, j) in pairs:
                    lead[j] = i
    items = spark.range(n).withColumnRenamed("id", "idx")
    got = similarity.greedy_clusters(items, spark.createDataFrame(list(pairs), "i long, j long")).collect()
    assert {r["idx"]: r["cluster_id"] for r in got} == lead


def test_cosine_pairs_equal_brute_force(spark):
    rng = random.Random(2)
    words = [f"w{k}" for k in range(25)]
    texts = [(i, " ".join(rng.choice(words) for _ in range(12))) for i in range(40)]
    texts += [(100 + i, texts[i][1] + " w1") for i in range(10)] + [(200, texts[0][1])]
    df = spark.createDataFrame(texts, "idx long, text string")
    found = similarity.cosine_pairs(similarity.tf_vectors(df, similarity.build_vocab(df)), 0.8).collect()
    assert [(r["i"], r["j"]) for r in found if r["copy"]] == [(0, 200)]  # 200 stands for itself nowhere else
    got = {(r["i"], r["j"]) for r in found}
    vec = {i: np.array([t.split().count(w) for w in words], float) for i, t in texts}
    vec = {i: v / np.linalg.norm(v) for i, v in vec.items()}
    full = {(i, j) for i in vec for j in vec if i < j and vec[i] @ vec[j] >= 0.8}
    assert got == {(i, j) for i, j in full if j != 200 or i == 0} and (100, 200) in full


def test_nearest_vectors(spark):
    rng = np.random.default_rng(0)
    m = rng.normal(size=(50, 8))
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], "vec_id long, embedding array<float>").repartition(5)
    q = df.where("vec_id < 7").withColumnRenamed("vec_id", "query_id")
    got = {}
    for r in similarity.vector_top_k(q, df, 3, block=4).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    assert got == {i: np.argsort(-(u[i] @ u.T))[:3].tolist() for i in range(7)}


def test_pagerank_and_components(spark):
    edges = [("a", "b", 1.0), ("b", "c", 0.5), ("a", "c", 0.5), ("d", "e", 1.0), ("c", "a", 1.0)]
    names = ["a", "b", "c", "d", "e", "f"]
    e = spark.createDataFrame([(s, d, "r", w) for s, d, w in edges], "src string, dst string, relation string, weight double")
    n = spark.createDataFrame([(x,) for x in names], "name string")
    m = np.zeros((6, 6))
    for s, d, w in edges:
        m[names.index(d), names.index(s)] += w
    out = m.sum(axis=0)
    rank = np.full(6, 1 / 6)
    for _ in range(20):
        rank = 0.15 / 6 + 0.85 * (m @ np.where(out > 0, rank / np.where(out > 0, out, 1), 0) + rank[out == 0].sum() / 6)
    got = {r["name"]: r["rank"] for r in graph.pagerank(n, e).collect()}
    assert [got[x] for x in names] == pytest.approx(rank.tolist(), abs=1e-12)
    comp = graph.connected_components(e).orderBy("rank", "member").collect()
    assert [(r["rank"], r["size"], r["component"], r["member"]) for r in comp] == [(1, 3, "a", "a"), (1, 3, "a", "b"), (1, 3, "a", "c"), (2, 2, "d", "d"), (2, 2, "d", "e")]
    assert graph.component_labels(e.limit(0)).count() == 0


def test_percentiles_are_order_statistics(spark):
    df = spark.createDataFrame([("a", v) for v in (1, 2, 3, 4)] + [("b", v) for v in range(100)] + [("b", 99)], "phase string, latency_ms long")
    got = {r["phase"]: (r["p50"], r["p95"]) for r in logstats.latency_percentiles(df).collect()}
    assert got == {"a": (3, 4), "b": (50, 95)}


def test_sampling(spark):
    df = spark.range(0, 103)
    assert [r["id"] for r in runs.uniform_sample(df, 10, ["id"]).orderBy("id").collect()] == [i * 103 // 10 for i in range(10)]
    assert runs.uniform_sample(df, 200, ["id"]).count() == 103
    assert [r["id"] for r in runs.stride_recommend(df, ["id"]).orderBy("id").collect()] == [0, 20, 40, 60, 80]


def test_files_and_types(spark):
    df = spark.createDataFrame([("x/目录.zip",), ("健康告知.xlsx",), ("a.csv",), ("b.doc",), ("c.b.PDF",), ("noext",)], "path string")
    got = [(r["l"], r["f"]) for r in df.select(classify.classify_file_level("path").alias("l"), classify.detect_format("path").alias("f")).collect()]
    assert got == [("list", None), ("rule", "excel"), ("schema", "excel"), ("clause", "docx"), ("clause", "pdf"), ("unknown", None)]
    s = spark.createDataFrame([("n", "流程 步骤 操作", "数据"), ("n", "", "1. go"), ("n", "", "a → b"), ("n", "", "")], "name string, trigger string, body string")
    assert [r["sku_type"] for r in classify.classify_sku(s).collect()] == ["procedural", "procedural", "relational", "factual"]


def test_package_round_trip(spark):
    s = spark.createDataFrame([(1, "My Skill", "When. ", "技术·开发", "procedural", 0.85, "body", ["a", "b"], "ch1", "ctx", "raw", 3), (2, "my skill", "later", "x", "factual", 0.85, "b2", [], "", "", "", 0)],
        "idx long, name string, trigger string, domain string, sku_type string, confidence double, body string, prerequisites array<string>, source_ref string, source_context string, raw_text string, source_chunk_index int")
    files = packaging.write_skill_packages(s)
    assert files.count() == 2
    e = packaging.parse_skill_package(files.where("path like '%SKILL.md'").select(F.col("slug").alias("dir"), "text")).collect()[0]
    assert (e["slug"], e["domain"], e["skill_type"], e["trigger"], e["confidence"]) == ("my-skill", "技术·开发", "操作指南 (procedural)", "When.", 0.85)


def test_glossary(spark):
    s = spark.createDataFrame([(0, "s0", "熔断机制（过载时自动断开的保护）", None), (1, "s1", "熔断机制(short one)。缓存是指临时保存数据的地方。", "")], "idx long, name string, body string, raw_text string")
    got = {r["term"]: r for r in glossary.extract_glossary(glossary.glossary_mentions(s)).collect()}
    assert got["熔断机制"]["frequency"] == 2 and got["熔断机制"]["definition"] == "过载时自动断开的保护" and got["熔断机制"]["source_skills"] == ["s0", "s1"]
    assert "缓存" in got


def test_greedy_clusters_decide_the_whole_of_a_long_chain(spark):
    from loreforge.operators.similarity import greedy_clusters

    items = spark.range(104).withColumnRenamed("id", "idx").coalesce(1)
    pairs = spark.range(103).selectExpr("id as i", "id + 1 as j").coalesce(1)
    assert dict(greedy_clusters(items, pairs).collect()) == {k: k - k % 2 for k in range(104)}


def _by_hand(n, pairs):
    own = {}
    for k in range(n):
        led = [i for i, j in pairs if j == k and own[i] == i]
        own[k] = min(led, default=k)
    return own


@pytest.mark.parametrize("rows_each", [10_000, 150, 40])
def test_greedy_clusters_are_the_same_for_all_ranges(spark, rows_each):
    rng = random.Random(rows_each)
    pairs = {tuple(sorted(rng.sample(range(120), 2))) for _ in range(160)}
    items = spark.range(120).withColumnRenamed("id", "idx")
    strange = list(pairs) + [(5, 500), (300, 301)]  # of items that aren't there
    got = similarity.greedy_clusters(items, spark.createDataFrame(strange, "i long, j long"), rows_each=rows_each)
    assert dict(got.collect()) == _by_hand(120, pairs)


def test_greedy_clusters_settle_a_chain_of_100_000_in_rounds_of_ranges(spark):
    n = 100_000
    ids, edges = spark.range(n), spark.range(n - 1).selectExpr("id as small", "id + 1 as big")
    state, rounds = similarity._leaders(ids, edges, 50_000)
    assert rounds < 20 and state.where("leads").count() == n / 2 and state.where("leads <> (id % 2 = 0)").count() == 0


def test_greedy_clusters_of_nothing_and_of_pairs_the_wrong_way(spark):
    none = spark.createDataFrame([], "i long, j long")
    assert similarity.greedy_clusters(spark.range(0).withColumnRenamed("id", "idx"), none).collect() == []
    with pytest.raises(ValueError):
        similarity.greedy_clusters(spark.range(3).withColumnRenamed("id", "idx"), spark.createDataFrame([(2, 1)], "i long, j long"))


def test_repeated_documents_are_numbered_by_themselves(spark):
    text = "sentence here. " * 500
    df = spark.createDataFrame([(1, "a", text), (1, "a", text), (2, "a", "sentence there. " * 500)], "doc_id long, doc_name string, markdown string")
    out = chunking.chunk_markdown(df)
    numbers = [r["chunk_index"] for r in out.collect()]
    n = len(numbers) // 3
    assert sorted(numbers) == sorted(list(range(n)) * 3)
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()  # a document's chunks never leave its row


def test_windows_may_overlap(spark):
    text = "".join(f"Sentence number {i} is here. " for i in range(400))
    plain = one(spark, text, lambda t: chunking.chunk_sliding_window(t, 1000))
    over = one(spark, text, lambda t: chunking.chunk_sliding_window(t, 1000, 0.2))
    assert "".join(plain).replace(" ", "") == text.replace(" ", "") and all(len(p) <= 1000 for p in plain + over)
    at = [text.index(p) for p in over]
    ends = [a + len(p) for a, p in zip(at, over, strict=True)]
    assert all(150 < e - a <= 201 for a, e in zip(at[1:], ends, strict=False)) and ends[-1] >= len(text) - 1
    assert one(spark, "short", lambda t: chunking.chunk_sliding_window(t, 1000, 0.2)) == ["short"]


def test_marks_inside_texts_cut_nothing(spark):
    turn = "Turn 1\n" + "a\u0001b " * 80
    assert one(spark, turn + "\n" + turn, chunking.chunk_conversation_turns) == [turn.strip()] * 2
    assert one(spark, "# A\u0001x\ny\n## B", markdown.headings)[0]["title"] == "A\u0001x"
    assert one(spark, "p\u0001q\n# H\nz", markdown.clean_markdown) == "p\u0001q\n# H\nz"


@pytest.mark.parametrize("threshold", [0.5, 0.88])
def test_cosine_pairs_equal_all_products(spark, threshold):
    rng = np.random.default_rng(3)
    rows, dense = [], np.zeros((120, 40))
    for i in range(120):
        base = rng.integers(0, 12) if i % 2 else i
        seed = np.random.default_rng(base)
        terms = seed.choice(40, size=8, replace=False)
        weights = seed.integers(1, 5, 8) + (rng.integers(0, 2, 8) if i % 3 else 0)
        dense[i, terms] = weights / np.linalg.norm(weights)
        rows += [(i, int(t), float(dense[i, t])) for t in terms]
    got = {(r["i"], r["j"]): r["similarity"] for r in similarity.cosine_pairs(spark.createDataFrame(rows, "idx long, term_id int, weight double"), threshold).collect()}
    same = [min(j for j in range(120) if np.allclose(dense[i], dense[j])) for i in range(120)]
    # pairs of the vectors that stand for equal ones, and each copy with the one that stands for it
    want = {(i, j) for i in range(120) for j in range(i + 1, 120) if dense[i] @ dense[j] >= threshold and same[i] == i and same[j] in (j, i)}
    assert set(got) == want and len(want) > 50 and all(abs(s - dense[i] @ dense[j]) < 1e-9 for (i, j), s in got.items())


def test_nearest_vectors_over_blocks_equal_brute_force(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(90, 6)).astype(np.float32)
    x[50] = x[3]
    df = spark.createDataFrame([(i, [float(v) for v in x[i]], f"n{i % 70}") for i in range(90)] + [(500, [1.0] * 6, None)], "vec_id long, embedding array<float>, name string")
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    s = np.round(u @ u.T, 4)
    order = [sorted(range(90), key=lambda j: (-s[i, j], j))[:4] for i in range(90)]
    vectors = df.where("vec_id < 90")
    got = {}
    for r in similarity.vector_top_k(vectors.withColumnRenamed("vec_id", "query_id"), vectors, 4, block=20).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = r["vec_id"]
    assert [[got[i][k] for k in range(1, 5)] for i in range(90)] == order
    want = {}
    for i in range(90):
        for j in order[i]:
            a, b = sorted((f"n{i % 70}", f"n{j % 70}"))
            if a != b and s[i, j] >= 0.6:
                want[a, b] = max(want.get((a, b), 0), s[i, j])
    rows = similarity.vector_duplicates(df, 0.6, 4).collect()
    assert {(r["name_a"], r["name_b"]): r["score"] for r in rows} == pytest.approx(want) and [r["score"] for r in rows] == sorted((r["score"] for r in rows), reverse=True)
    assert similarity.vector_top_k(vectors.limit(0).withColumnRenamed("vec_id", "query_id"), vectors).count() == 0


def test_reports_have_lines_for_all_parts(spark):
    calls = spark.createDataFrame([("p", "v1", 1000, 2000, 5, 10, "pass"), ("p", "v2", 1, 1, 0, 30, "fail_format")], "phase string, prompt_version string, input_tokens long, output_tokens long, think_tokens long, latency_ms long, validation_result string")
    rows = logstats.log_report(logstats.log_stats_by_phase(calls), logstats.log_stats_by_version(calls), logstats.log_totals(calls)).collect()
    assert [(r["section"], r["key"]) for r in rows] == [("1 total", "calls"), ("1 total", "cost"), ("1 total", "tokens"), ("2 phase", "p"), ("3 version", "v1"), ("3 version", "v2")]
    assert rows[3]["line"].startswith("| p | 2 | 1,001 | 2,001 | 5 | 20ms | 30ms | 50% |") and rows[4]["line"] == "| v1 | 1 | 10ms | 100% | ¥0.018 |"
    r = spark.createDataFrame([("a", True, None, 3, "pdf", 7, 1.5), ("b", False, "e" * 99, 0, "txt", 0, 0.0)], "doc_name string, ok boolean, error string, n_skills int, format string, n_chunks int, elapsed double")
    lines = {(x["section"], x["name"]): x["line"] for x in logstats.batch_report(r).collect()}
    assert lines["2 done", "a"] == "| a | pdf | 7 | 3 | 1.5s |" and lines["3 failed", "b"] == f"| b | {'e' * 80} |" and lines["1 summary", "results"] == "成功：1，失败：1"
    sample = spark.createDataFrame([(1,), (2,)], "chunk long")
    results = spark.createDataFrame([(1, "x", "t", "pass"), (1, "y", "t", "fail"), (9, "z", "t", "pass")], "chunk long, name string, trigger string, status string")
    rows = {x["chunk"]: x for x in runs.sample_check_report(sample, results, ["chunk"]).collect()}
    assert [tuple(s) for s in rows[1]["skills"]] == [("x", "t", "pass"), ("y", "t", "fail")] and rows[2]["skills"] is None and rows[None]["pass_rate"] == 50.0


def test_components_of_a_long_path_settle(spark):
    edges = spark.createDataFrame([(f"n{i:03}", f"n{i + 1:03}") for i in range(150)], "src string, dst string")
    assert {r["component"] for r in graph.component_labels(edges).collect()} == {"n000"}


def test_grids_are_dealt_once(spark):
    """Rows, headers and items of cells come by one shuffle of the cells by sheet, and headers don't shuffle them again."""
    from loreforge.operators import runs

    cells = spark.createDataFrame([("s", 0, 0, " 某某保险产品 "), ("s", 2, 0, "项目"), ("s", 2, 1, "限额"), ("s", 3, 0, " "), ("s", 5, 0, "a"), ("s", 5, 1, " 7 "), (None, 1, 0, "x")], "sheet string, row_no int, col_no int, value string")
    rows = runs.grid_rows(cells, ["sheet"])
    assert sorted(map(tuple, rows.collect())) == [("s", 0, 0, "某某保险产品"), ("s", 1, 0, "项目"), ("s", 1, 1, "限额"), ("s", 2, 0, "a"), ("s", 2, 1, "7")]
    head = runs.detect_header_row(rows, ["sheet"])
    assert [r["name"] for r in runs.extract_benefit_items(rows, head, ["sheet"]).collect()] == ["a"]
    assert head._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


def test_terms_and_definitions_come_by_one_pass(spark):
    """As by a pass for each group; texts with the marks of the one pass and terms at the limits of their length too."""
    from pyspark.sql import functions as F

    from loreforge.functions.text import strip
    from loreforge.operators import glossary

    texts = ["免赔额是指每次赔付之前由自己承担的部分。", "abcdefghijklmnopqrst 称为 one two three", "等待期 ，即合同生效之后的一段时间", "a, 即b, 亦称 nothing at all；", "保单(合同双方签署的文件)x保额（每年赔付的最高限额）", "保费是指是指称为\x01定义为\x02abc。def。\n", "word, word 指的是a。b。c $1 \\ d\n", "", None]
    texts += ["".join(x) for x in zip(texts[:7], texts[1:8])] + ["一二三四五六七八九十一二三四五六七, 也就是 12345。"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    plain = [F.arrays_zip(*[F.transform(F.regexp_extract_all(F.coalesce("t", F.lit("")), F.lit("(?Ud)" + p), g), strip).alias(n) for g, n in ((1, "term"), (2, "definition"))]) for p in glossary.PATTERNS]
    out = df.select(glossary.mentions("t").alias("got"), F.concat(*plain).alias("want"))
    rows = out.collect()
    assert all([tuple(x) for x in r["got"]] == [tuple(x) for x in r["want"]] for r in rows) and sum(len(r["got"]) for r in rows) > 15
    assert df.select(glossary.mentions("t"))._jdf.queryExecution().optimizedPlan().toString().count("$1") >= len(glossary.PATTERNS)


def test_texts_are_searched_once_and_only_where_needed(spark):
    """F16, F19: the gates and quicker patterns find what the plain ones do, and what no gate lets through isn't searched."""
    import random

    from pyspark.sql import functions as F

    from loreforge.functions import text
    from loreforge.operators import density, markdown

    rng = random.Random(1)
    rows = [("".join(rng.choice("abzABZ__.. 019é漢=$\\α∑|#-\n\t()\u3000\x85") for _ in range(rng.randint(0, 40))),) for _ in range(5000)]
    rows += [(c,) for c in density.FORMULA_SIGNS] + [("\\" + x,) for x in density.FORMULA_COMMANDS] + [(chr(i) + "a b" + chr(i),) for i in range(1, 0x3100)] + [(None,)]
    c = F.col("c")
    n = lambda p: F.regexp_count(c, F.lit("(?Ud)" + p))
    any_of = lambda ps: F.greatest(*[F.contains(c, F.lit(p)) for p in ps])
    kind = r"(?Us)\A\s*(?:\d+\.\s|[-*+] |[^|]*\|[^|]*\||```|#)"
    share = F.size(F.filter(F.split(c, "\n"), lambda x: x.rlike(kind))) / F.size(F.split(c, "\n"))
    pairs = {
        "strip": (text.strip(c), F.regexp_replace(c, r"(?U)\A\s+|\s+\z", "")),
        "identifiers": (n(density._IDENTIFIER), n(density.IDENTIFIER)),
        "numbers": (n(density._NUMBER), n(density.NUMBER)),
        "formulas": (density._count_if(c.rlike(density._FORMULA_PARTS), c, density.FORMULA), F.coalesce(n(density.FORMULA), F.lit(0))),
        "names": (density._count_if(c.rlike(density._NAME_LIKE), c, density.IDENTIFIER), F.coalesce(n(density.IDENTIFIER), F.lit(0))),
        "lines": (density.struct_density(c), F.least(share, F.lit(1.0))),
        "hits": (text.hits(c, ("漢", "a漢", "zA")), sum((F.contains(c, F.lit(p)).cast("int") for p in ("漢", "a漢", "zA")), F.lit(0))),
        "any": (text.has_any(c, ("漢α", "漢1", "zA")), any_of(("漢α", "漢1", "zA"))),
    }
    df = spark.createDataFrame(rows, "c string").repartition(4)
    wrong = df.select(*[F.sum((~a.eqNullSafe(b)).cast("int")).alias(k) for k, (a, b) in pairs.items()]).collect()[0].asDict()
    assert wrong == dict.fromkeys(pairs, 0)
    # of what a text holds no Chinese character for, no Chinese phrase is looked for; patterns of white space don't run over whole texts
    plan = lambda x: df.select(x.alias("x"))._jdf.queryExecution().optimizedPlan().toString()
    assert "CASE WHEN NOT RLIKE" in plan(text.hits(c, ("漢", "字"))) and "regexp_replace" not in plan(text.strip(c))
    assert plan(markdown.clean_markdown(c)).count(markdown._PAGE_NUMBER) == 1


def test_candidates_are_cut_once(spark):
    """an answer is cut at its headers once, and a text is trimmed without a pattern; the plain expressions give the same."""
    import random

    from pyspark.sql import functions as F

    from loreforge.operators import requests, validate

    rng = random.Random(2)
    parts = ["Alpha", "xy", "步骤一二", "1. ", "\n", "\n---\n", "---\nname: a\n", " ", "\u3000", "é"]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 30)))) for i in range(3000)] + [(-1, None)]
    df = spark.createDataFrame(rows, "id long, body string").repartition(4)
    trim = lambda c: F.regexp_replace(c, r"(?U)\A\s+|\s+\z", "")
    t = F.concat(F.lit("\n"), trim("body"))
    pieces = F.split(t, r"(?<=\n)(?=---[ \t]*\n\s*[A-Za-z_][\w-]*\s*:)")
    plain = F.when(F.size(pieces) > 1, pieces).otherwise(F.split(t, r"\n---[ \t]*(?=\n|\z)"))
    tidy = F.filter(F.transform(plain, lambda p: F.regexp_replace(trim(p), r"(?s)\n---\s*\z", "")), lambda p: p != "")
    want = df.select("id", F.posexplode(tidy).alias("pos", "raw_text"))
    cut = requests.split_candidates(df, "body")
    assert sorted(map(tuple, cut.select("id", "pos", "raw_text").collect())) == sorted(map(tuple, want.collect()))
    plan = validate.parse_frontmatter(cut)._jdf.queryExecution().optimizedPlan().toString()
    assert r"\A\s+|\s+\z" not in plan


def test_only_texts_of_clusters_of_two_are_merged(spark):
    from loreforge.operators import requests

    skills = spark.range(30).selectExpr("id as idx", "concat('n', id) as name", "if(id = 4, null, 'src') as source_context", "concat('b', id) as body")
    clusters = spark.range(28).selectExpr("id as idx", "if(id < 20, id - id % 2, id) as cluster_id")
    out = requests.cluster_merge_request(skills, clusters)
    got = {r["cluster_id"]: (r["members"], r["user_prompt"]) for r in out.collect()}
    src = lambda i: "" if i == 4 else "src"
    assert got == {i: (2, "\n\n".join(f"### {k}. n{j}\n> {src(j)}\n\nb{j}" for k, j in ((1, i), (2, i + 1)))) for i in range(0, 20, 2)}
    plan, depth = out._jdf.queryExecution().optimizedPlan().toString().splitlines(), lambda x: len(x) - len(x.lstrip(" :+-"))
    windows = [i for i, x in enumerate(plan) if x.lstrip(" :+-").startswith("Window")]
    assert windows
    for i in windows:  # nothing below a window reads a text
        below = next((k for k in range(i + 1, len(plan)) if depth(plan[k]) <= depth(plan[i])), len(plan))
        assert not any("body" in x for x in plan[i:below])
