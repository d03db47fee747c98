"""Queries of file sources, sinks and streams: their files are written by Spark from the given tables first."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from loreforge.operators import packaging, requests, runs, segments, similarity, text_search, validate
from loreforge.operators.chunking import rechunk as rechunk_files
from loreforge.operators.density import filter_chunks
from loreforge.plans import fixtures as fx
from loreforge.plans.records import PKG_SQL
from loreforge.plans.registry import SQL, query, table
from loreforge.session import shared_dir
from loreforge.plans.texts import CHUNK_DENSITY_SQL, CHUNKS_SQL, DENSITY_SQL, EN_ANCHORS, HEADINGS_SQL, PACK_SQL, S, _documents
from loreforge.sources import files
from loreforge.streaming import streams


def _folder(spark, name: str) -> str:
    """A new folder in the shared one."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


@query("SELECT 'lang=' || lang || '/source=' || source AS folder, 'txt' AS format, count(DISTINCT doc_id % 1) AS files FROM documents GROUP BY ALL")
def scan_documents(spark, sf_dir):
    out = _folder(spark, "texts")
    d = table(spark, sf_dir, "documents").select("lang", "source", "text")
    d.repartition("lang", "source").write.partitionBy("lang", "source").text(out)  # one file in each folder
    d.select(F.lit("x").alias("value")).limit(1).write.text(f"{out}/lang=zz/source=none", compression="gzip")  # no document by its suffix
    found = files.scan_documents(spark, out)
    return found.groupBy(F.regexp_extract("path", "(lang=[^/]*/source=[^/]*)/", 1).alias("folder"), "format").agg(F.count("*").alias("files"))


@query("SELECT lang, sum(length(text) + 1)::BIGINT AS chars FROM documents GROUP BY lang")
def load_text_documents(spark, sf_dir):
    out = _folder(spark, "texts")
    table(spark, sf_dir, "documents").select("lang", "text").write.partitionBy("lang").text(out)
    rows = files.load_text_documents(spark, out)
    return rows.groupBy(F.regexp_extract("source_path", "lang=([^/]*)", 1).alias("lang")).agg(F.sum(F.length("markdown")).alias("chars"))


@query("WITH" + fx.CALLS_SQL + r""" SELECT 'all' AS day, phase, count(*) AS calls, sum(input_tokens)::BIGINT AS input_tokens, sum(latency_ms)::BIGINT AS latency_ms FROM calls GROUP BY phase
UNION ALL SELECT '2024-01-05', phase, count(*), sum(input_tokens)::BIGINT, sum(latency_ms)::BIGINT FROM calls WHERE strftime(ts, '%Y-%m-%d') = '2024-01-05' GROUP BY phase""")
def scan_call_log(spark, sf_dir):
    """A file for each day, with broken and empty lines among the records; all days are read, and one."""
    out = _folder(spark, "log")
    c = fx.calls(spark, sf_dir)
    good = F.to_json(F.struct("phase", "prompt_version", "input_tokens", "output_tokens", "think_tokens", "latency_ms", "validation_result"))
    rows = c.select(F.concat(F.date_format("ts", "yyyy-MM-dd"), F.lit(".jsonl")).alias("path"), "event_id", F.explode(F.array(good, F.when(F.col("event_id") % 2 == 0, "").otherwise("{broken"))).alias("line"))
    files.write_named_files(rows, out, "event_id").write.format("noop").mode("overwrite").save()
    sums = lambda rows, day: rows.groupBy(F.lit(day).alias("day"), "phase").agg(F.count("*").alias("calls"), F.sum("input_tokens").alias("input_tokens"), F.sum("latency_ms").alias("latency_ms"))
    return sums(files.scan_call_log(spark, out), "all").unionByName(sums(files.scan_call_log(spark, out, "2024-01-05"), "2024-01-05"))


@query("WITH" + PKG_SQL + " SELECT slug, trim(domain) AS domain, " + S('"trigger"') + " AS \"trigger\" FROM bs")
def scan_skill_packages(spark, sf_dir):
    s = fx.skills(spark, sf_dir).withColumn("sku_id", validate.slugify("name"))
    texts = packaging.write_skill_packages(s).where(F.col("path").endswith("/SKILL.md"))
    out = _folder(spark, "packages")
    files.write_named_files(texts.select(F.concat("slug", F.lit("/SKILL.md")).alias("path"), F.col("text").alias("line"), F.lit(0).alias("n")), out, "n").write.format("noop").mode("overwrite").save()
    return packaging.parse_skill_package(files.scan_skill_packages(spark, out)).select("slug", "domain", "trigger")


@query("WITH" + CHUNKS_SQL + " SELECT doc_id, chunk_index, content FROM chunks WHERE chunk_index < 1")
def load_chunks(spark, sf_dir):
    from loreforge.operators.chunking import chunk_markdown

    out = _folder(spark, "chunks")
    chunks = chunk_markdown(_documents(spark, sf_dir)).select(F.lit("w").alias("workflow_id"), "doc_id", F.col("chunk_index").cast("bigint").alias("chunk_index"), "content")
    packaging.save_chunks(chunks, out)
    saved = spark.read.parquet(out)
    return packaging.load_chunks(saved, saved.where("chunk_index < 1").select("doc_id", "chunk_index")).select("doc_id", "chunk_index", "content")


@query("WITH" + CHUNKS_SQL + " SELECT doc_id % 5 AS workflow_id, count(*) AS n FROM chunks GROUP BY 1")
def save_chunks(spark, sf_dir):
    from loreforge.operators.chunking import chunk_markdown

    out = _folder(spark, "chunks")
    packaging.save_chunks(chunk_markdown(_documents(spark, sf_dir)).select((F.col("doc_id") % 5).alias("workflow_id"), "doc_id", "content"), out)
    return spark.read.parquet(out).groupBy(F.col("workflow_id").cast("bigint").alias("workflow_id")).agg(F.count("*").alias("n"))


@query("WITH" + fx.SKILLS_SQL + " SELECT idx, name, domain FROM skills")
def load_skills(spark, sf_dir):
    out = _folder(spark, "skills")
    fx.skills(spark, sf_dir).select("idx", "name", "domain").write.parquet(out)
    return packaging.load_skills(spark.read.parquet(out))


@query("SELECT vec_id AS sku_id, 'v' || CAST(vec_id AS VARCHAR) AS name, len(embedding) AS dims FROM embeddings")
def write_skill_vectors(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    s = e.select(F.col("vec_id").alias("sku_id"), F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("name"), F.lit("t").alias("trigger"), F.lit("d").alias("domain"), F.lit("factual").alias("sku_type"))
    out = similarity.write_skill_vectors(s, e.select(F.col("vec_id").alias("sku_id"), "embedding"), _folder(spark, "vectors"))
    return out.select("sku_id", "name", F.size("embedding").cast("bigint").alias("dims"))


@query("WITH" + fx.PARAGRAPHS_SQL + ", pp AS (SELECT doc_id, CASE WHEN length(markdown) < 6000 THEN [markdown] ELSE string_split(markdown, E'\\n\\n') END AS parts FROM paras)," + PACK_SQL.format(src="pp", max=5000, extra=0) + " SELECT doc_id, CAST(i - 1 AS INTEGER) AS segment, piece AS user_prompt FROM pk")
def build_cleanup_requests(spark, sf_dir):
    return requests.build_cleanup_requests(fx.paragraph_texts(spark, sf_dir))


@query("WITH" + fx.PARAGRAPHS_SQL + ", pp AS (SELECT doc_id, CASE WHEN length(markdown) <= 4000 THEN [markdown] ELSE string_split(markdown, E'\\n\\n') END AS parts FROM paras)," + PACK_SQL.format(src="pp", max=4000, extra=2) + " SELECT doc_id, CAST(i - 1 AS INTEGER) AS segment, piece AS user_prompt FROM pk")
def build_chunk_requests(spark, sf_dir):
    return requests.build_chunk_requests(fx.paragraph_texts(spark, sf_dir))


@query("WITH" + fx.BOOKS_SQL + "," + HEADINGS_SQL.format(src="books") + r""",
t AS (SELECT book_id, string_agg(repeat('  ', level - 1) || '- ' || title, E'\n' ORDER BY pos) AS toc FROM heads GROUP BY book_id)
SELECT book_id, 'do' AS system_prompt, E'## 目录结构\n\n' || toc || E'\n\n## 前言摘要\n\n' || CASE WHEN length(markdown) > 6000 THEN substr(markdown, 1, 6000) || E'\n\n[...]' ELSE markdown END AS user_prompt
FROM books JOIN t USING (book_id) WHERE NOT starts_with(book_id, 'src1')""")
def build_schema_requests(spark, sf_dir):
    b = fx.books(spark, sf_dir)
    return requests.build_schema_requests(b, b.where(F.col("book_id").startswith("src1")), "do", "book_id")


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment || ', x' ELSE 'general' END AS domains FROM customer")
def schema_constraint(spark, sf_dir):
    d = F.when(F.col("c_custkey") % 2 == 0, F.array("c_mktsegment", F.lit("x"))).otherwise(F.array().cast("array<string>"))
    out = table(spark, sf_dir, "customer").select("c_custkey", requests.schema_constraint(d).alias("t"))
    return out.select("c_custkey", F.regexp_extract("t", "从以下领域中选择：(.*?)>", 1).alias("domains"))


@query("WITH" + CHUNKS_SQL + "," + DENSITY_SQL.replace("SELECT doc_id, text AS t, lower(text) AS lo FROM documents", "SELECT doc_id, chunk_index, content AS t, lower(content) AS lo FROM chunks").replace("(SELECT doc_id, t", "(SELECT doc_id, chunk_index, t").replace("'that the', 'of the', ' is '", "'必须'") + " SELECT doc_id, chunk_index, CAST(score AS INTEGER) AS score_a FROM d5 WHERE score > 2")
def rechunk(spark, sf_dir):
    d = _documents(spark, sf_dir)
    clean = F.when(F.col("doc_id") % 2 == 0, F.col("markdown"))
    rows = d.select("doc_id", "doc_name", clean.alias("clean_text"), F.when(F.col("doc_id") % 2 == 0, "raw").otherwise(F.col("markdown")).alias("raw_text"))
    return rechunk_files(rows).select("doc_id", F.col("chunk_index").cast("bigint").alias("chunk_index"), "score_a")


MERGED_SQL = r"""WITH w AS (SELECT source AS workflow_id, string_agg(text, E'\n\n---\n\n' ORDER BY doc_id) AS t FROM documents WHERE source IS NOT NULL AND text IS NOT NULL GROUP BY 1)"""


def _whole_sources(spark, sf_dir):
    """Each source as one text: the largest is longer than a row can be, where the table is."""
    return segments.text_segments(table(spark, sf_dir, "documents"), "source", "doc_id")


@query(r"""SELECT source AS workflow_id, doc_id, CAST(coalesce(sum(length(text) + 7) OVER (PARTITION BY source ORDER BY doc_id, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "start", length(text) AS length
FROM documents WHERE source IS NOT NULL AND text IS NOT NULL""")
def merged_text_segments(spark, sf_dir):
    return _whole_sources(spark, sf_dir).select(F.col("source").alias("workflow_id"), "doc_id", "start", "length")


@query("SELECT source AS workflow_id, count(*) AS segments, sum(length(text) + 7) - 7 AS chars FROM documents WHERE source IS NOT NULL AND text IS NOT NULL GROUP BY 1")
def merged_text_totals(spark, sf_dir):
    return segments.segment_totals(_whole_sources(spark, sf_dir), "source").withColumnRenamed("source", "workflow_id")


@query(MERGED_SQL + " SELECT workflow_id, b AS block, md5(substr(t, b * 10000 + 1, 10000)) AS text_md5 FROM (SELECT *, unnest(range((length(t) + 9999) // 10000)) AS b FROM w)")
def merged_text_blocks(spark, sf_dir):
    blocks = segments.text_blocks(_whole_sources(spark, sf_dir), "source", 10_000)
    return blocks.select(F.col("source").alias("workflow_id"), "block", F.md5("text").alias("text_md5"))


@query(r"""SELECT source || '-' || CAST(doc_id // 1000 AS VARCHAR) || '.md' AS name, count(*) AS segments, octet_length(encode(string_agg(text, E'\n\n---\n\n' ORDER BY doc_id))) AS bytes
FROM documents WHERE source IS NOT NULL AND text IS NOT NULL GROUP BY 1""")
def merged_text_files(spark, sf_dir):
    """Workflows of a thousand files each, written as one file and read back."""
    d = table(spark, sf_dir, "documents")
    d = d.select(F.concat("source", F.lit("-"), F.floor(F.col("doc_id") / 1000).cast("string")).alias("workflow_id"), "doc_id", "text")
    out = _folder(spark, "merged")
    done = segments.write_segments(segments.text_segments(d, "workflow_id", "doc_id"), "workflow_id", out)
    found = spark.read.format("binaryFile").load(out).select(F.regexp_extract("path", "[^/]*$", 0).alias("path"), F.col("length").alias("bytes"))
    return done.join(found.hint("merge"), "path").select(F.col("path").alias("name"), F.col("lines").alias("segments"), "bytes")


@query(SQL["search_chunks"])
def search_chunks_indexed(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.lit(0).alias("chunk_index"), F.col("text").alias("content"), F.array("source").alias("heading_path"), F.length("text").cast("bigint").alias("char_count"))
    index = text_search.build_text_index(d, ["doc_id", "chunk_index"], runs.searchable(), _folder(spark, "index"))
    return runs.search_chunks(d, "tion", page=2, index=index)


@query(SQL["registry_find_trigger"])
def registry_find_trigger_indexed(spark, sf_dir):
    e = fx.skills(spark, sf_dir).select("idx", "trigger", F.col("source_ref").alias("description"))
    index = text_search.build_text_index(e, ["idx"], packaging.trigger_text(), _folder(spark, "index"))
    return packaging.registry_find_trigger(e, "TION", index, "idx").select("idx")


@query(r"""WITH f AS (SELECT DISTINCT 'prompt' || CAST(p_size AS VARCHAR) AS n, 'v' || CAST(p_partkey % 5 AS VARCHAR) AS v FROM part)
SELECT n AS prompt_name, array_to_string(list_sort(list(v)), ',') AS versions FROM f GROUP BY n""")
def scan_prompt_catalog(spark, sf_dir):
    out = _folder(spark, "prompts")
    part = table(spark, sf_dir, "part")
    stems = part.select(F.concat(F.lit("prompt"), F.col("p_size").cast("string"), F.lit("_v"), (F.col("p_partkey") % 5).cast("string")).alias("stem")).distinct()

    files.write_named_files(stems.select(F.concat("stem", F.lit(".md")).alias("path"), F.lit("Prompt {x}").alias("line"), F.lit(0).alias("n")), out, "n").write.format("noop").mode("overwrite").save()
    return files.scan_prompt_catalog(spark, out).select("prompt_name", F.array_join("versions", ",").alias("versions"))


@query("WITH" + CHUNKS_SQL + "," + CHUNK_DENSITY_SQL + r"""
SELECT hash, chunk_index, CAST(score AS INTEGER) AS score_a, score > 2 OR anchor AS keep FROM d5 JOIN (SELECT min(doc_id) AS doc_id, sha256(text) AS hash FROM documents GROUP BY text) USING (doc_id)
WHERE hash NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 10 = 3)""")
def stream_new_documents(spark, sf_dir):
    """Documents arrive in two parts, with a stop between; texts registered before are left out, others count once."""
    folder, out = _folder(spark, "arrivals"), _folder(spark, "stream")
    docs = _documents(spark, sf_dir)
    known = docs.where("doc_id % 10 = 3").select(F.sha2("markdown", 256).alias("hash"))
    docs.where("doc_id % 3 = 0").write.parquet(folder)
    run = lambda: streams.stream_new_documents(spark.readStream.schema(docs.schema).parquet(folder), f"{out}/chunks", f"{out}/state", known, anchors=EN_ANCHORS).awaitTermination()
    run()
    docs.where("doc_id % 3 <> 0").write.mode("append").parquet(folder)
    run()
    return spark.read.parquet(f"{out}/chunks").select("hash", F.col("chunk_index").cast("bigint").alias("chunk_index"), "score_a", "keep")


@query("WITH" + DENSITY_SQL + " SELECT doc_id, CAST(score AS INTEGER) AS score_a FROM d5")
def stream_resume(spark, sf_dir):
    folder, out = _folder(spark, "chunks"), _folder(spark, "stream")
    chunks = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("content"))
    chunks.where("doc_id % 2 = 0").write.parquet(folder)
    stream = spark.readStream.schema(chunks.schema).parquet(folder)
    run = lambda: streams.stream_resume(stream, lambda df: filter_chunks(df), f"{out}/done", f"{out}/state").awaitTermination()
    run()
    chunks.where("doc_id % 2 = 1").write.mode("append").parquet(folder)
    run()  # goes on with what isn't done
    return spark.read.parquet(f"{out}/done").select("doc_id", "score_a")


@query("WITH" + fx.CALLS_SQL + r""", a AS (SELECT *, greatest(0, least(2, date_diff('day', TIMESTAMP '2024-01-01', ts) // 10)) + CASE WHEN event_id % 7 = 0 THEN 1 ELSE 0 END AS arrival, date_trunc('day', ts)::TIMESTAMP AS day FROM calls),
m AS (SELECT arrival, max(max(ts)) OVER (ORDER BY arrival) - INTERVAL 2 DAY AS mark FROM a GROUP BY arrival),
ok AS (SELECT a.* FROM a LEFT JOIN m ON m.arrival = a.arrival - 1 WHERE m.mark IS NULL OR day + INTERVAL 1 DAY > m.mark)
SELECT day, phase, count(*) AS calls, sum(input_tokens)::BIGINT AS tokens, round(avg(latency_ms), 6) AS avg_latency_ms FROM ok WHERE day + INTERVAL 1 DAY <= (SELECT max(mark) FROM m) GROUP BY ALL""")
def stream_log_stats(spark, sf_dir):
    """Calls arrive in four parts, a seventh of them late; the query is stopped after each part and goes on from its checkpoint."""
    folder, out = _folder(spark, "calls"), _folder(spark, "stream")
    late = F.when(F.col("event_id") % 7 == 0, 1).otherwise(0)
    part = F.greatest(F.lit(0), F.least(F.lit(2), F.floor(F.date_diff("ts", F.lit("2024-01-01")) / 10))) + late
    rows = fx.calls(spark, sf_dir).select(F.col("ts").cast("timestamp").alias("ts"), "phase", F.col("input_tokens").alias("tokens"), "latency_ms", part.alias("arrival"))
    for k in range(4):
        rows.where(F.col("arrival") == k).drop("arrival").write.mode("append").parquet(folder)
        calls = spark.readStream.schema(rows.drop("arrival").schema).parquet(folder)
        streams.write_log_stats(calls, f"{out}/stats", f"{out}/state", "2 days").awaitTermination()
    done = spark.read.parquet(f"{out}/stats")
    return done.withColumns({"avg_latency_ms": F.round("avg_latency_ms", 6), "day": F.col("day").cast("timestamp_ntz")})
