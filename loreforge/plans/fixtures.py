"""Inputs that queries derive from the tables, as DataFrames and as the same SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loreforge.functions.text import ordered_join
from loreforge.plans.registry import table

# ---- books: up to 50 documents or so of a source under headings
BOOKS_SQL = r"""
books AS (
  SELECT source || '-' || CAST(doc_id // 1000 AS VARCHAR) AS book_id,
         '# ' || source || E'\n\n' || string_agg('## Doc ' || doc_id || E'\n\n' || text, E'\n\n' ORDER BY doc_id) AS markdown
  FROM documents GROUP BY source, doc_id // 1000)"""


def books(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").withColumn("shelf", F.floor(F.col("doc_id") / 1000))
    part = F.concat(F.lit("## Doc "), F.col("doc_id").cast("string"), F.lit("\n\n"), F.col("text"))
    out = d.withColumn("part", part).groupBy("source", "shelf").agg(ordered_join("part", ["doc_id"], "\n\n").alias("body"))
    book = F.concat("source", F.lit("-"), F.col("shelf").cast("string"))
    return out.select(book.alias("book_id"), F.concat(F.lit("# "), F.col("source"), F.lit("\n\n"), F.col("body")).alias("markdown"))


# ---- noisy books: with page numbers, rules and a reference section
NOISE = "\n 12 \n\n-----\n\n\n\n\n## References\n\n[1] Nobody.\n\n### Deep\n\n- 7 -\nkept\n\n## Acknowledgments\n\nthanks\n"
NOISY_SQL = BOOKS_SQL + r""",
noisy AS (SELECT book_id, markdown || E'\n 12 \n\n-----\n\n\n\n\n## References\n\n[1] Nobody.\n\n### Deep\n\n- 7 -\nkept\n\n## Acknowledgments\n\nthanks\n' AS markdown FROM books)"""


def noisy_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    return books(spark, sf_dir).withColumn("markdown", F.concat("markdown", F.lit(NOISE)))


# ---- dialogues
DIALOGUES_SQL = r"""
dialogues AS (
  SELECT conv_id, string_agg('Turn ' || turn || E'\n' || text, E'\n' ORDER BY turn) AS markdown FROM conversations GROUP BY conv_id)"""


def dialogues(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    part = F.concat(F.lit("Turn "), F.col("turn").cast("string"), F.lit("\n"), F.col("text"))
    return c.withColumn("part", part).groupBy("conv_id").agg(ordered_join("part", ["turn"], "\n").alias("markdown"))


# ---- paragraphs: the sentences of a document as paragraphs
PARAGRAPHS_SQL = r"""
paras AS (SELECT doc_id, regexp_replace(text, '\. ', E'.\n\n', 'g') AS markdown FROM documents)"""


def paragraph_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.regexp_replace("text", r"\. ", ".\n\n").alias("markdown"))


# ---- skills: a record for each document
DOMAINS = ("insurance", "技术·开发", "Legal ", "claims", "misc")
TYPES = ("factual", "procedural", "relational")
SKILLS_SQL = r"""
skills AS (
  SELECT doc_id AS idx, 'Skill ' || lang || ' ' || CAST(doc_id % 97 AS VARCHAR) AS name,
         replace(left(text, 60), E'\n', ' ') AS "trigger",
         ['insurance', '技术·开发', 'Legal ', 'claims', 'misc'][CAST(doc_id % 5 AS INTEGER) + 1] AS domain,
         ['factual', 'procedural', 'relational'][CAST(doc_id % 3 AS INTEGER) + 1] AS sku_type,
         (doc_id % 11) / 10.0 AS confidence, text AS body,
         CASE WHEN doc_id % 4 = 0 THEN ['Skill en ' || CAST(doc_id % 13 AS VARCHAR), 'base-line'] ELSE CAST([] AS VARCHAR[]) END AS prerequisites,
         'ch ' || CAST(doc_id % 7 AS VARCHAR) AS source_ref, source AS source_context, text AS raw_text, doc_id % 5 AS source_chunk_index
  FROM documents)"""


def skills(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (i % len(values) + 1).cast("int"))
    needs = F.when(i % 4 == 0, F.array(F.concat(F.lit("Skill en "), (i % 13).cast("string")), F.lit("base-line"))).otherwise(F.array().cast("array<string>"))
    return table(spark, sf_dir, "documents").select(
        i.alias("idx"), F.concat(F.lit("Skill "), "lang", F.lit(" "), (i % 97).cast("string")).alias("name"),
        F.regexp_replace(F.substring("text", 1, 60), "\n", " ").alias("trigger"), pick(DOMAINS).alias("domain"), pick(TYPES).alias("sku_type"),
        ((i % 11) / 10.0).alias("confidence"), F.col("text").alias("body"), needs.alias("prerequisites"),
        F.concat(F.lit("ch "), (i % 7).cast("string")).alias("source_ref"), F.col("source").alias("source_context"), F.col("text").alias("raw_text"), (i % 5).alias("source_chunk_index"),
    )


# ---- calls: a log record for each event
CALLS_SQL = r"""
calls AS (
  SELECT event_id, ts, event_type AS phase, 'v0.' || CAST(user_id % 3 AS VARCHAR) AS prompt_version,
         CAST(floor(value * 100) AS BIGINT) AS latency_ms, CAST(json_extract_string(props, '$.k') AS BIGINT) AS input_tokens,
         2 * CAST(json_extract_string(props, '$.k') AS BIGINT) AS output_tokens, CAST(json_extract_string(props, '$.k') AS BIGINT) % 3 AS think_tokens,
         ['pass', 'pass', 'fail_format', 'pending'][CAST(event_id % 4 AS INTEGER) + 1] AS validation_result
  FROM events)"""


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("bigint")
    status = F.element_at(F.array(*map(F.lit, ("pass", "pass", "fail_format", "pending"))), (F.col("event_id") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "events").select(
        "event_id", "ts", F.col("event_type").alias("phase"), F.concat(F.lit("v0."), (F.col("user_id") % 3).cast("string")).alias("prompt_version"),
        F.floor(F.col("value") * 100).alias("latency_ms"), k.alias("input_tokens"), (k * 2).alias("output_tokens"), (k % 3).alias("think_tokens"), status.alias("validation_result"),
    )


# ---- cells: a sheet for each order, a title row, a header row and its lines
CELLS_SQL = r"""
lines AS (SELECT l_orderkey AS sheet, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS n, l_partkey, l_quantity, l_returnflag FROM lineitem),
cells AS (
  SELECT DISTINCT sheet, 0 AS row_no, 0 AS col_no, '某某保险产品 ' || CAST(sheet AS VARCHAR) AS value FROM lines
  UNION ALL SELECT DISTINCT sheet, 1, c.col_no, c.value FROM lines, (VALUES (0, ' 保障项目 '), (1, '年限额'), (2, '备注'), (3, '说明')) AS c(col_no, value)
  UNION ALL SELECT sheet, CAST(n + 2 AS INTEGER), 0, CASE WHEN l_partkey % 7 = 0 THEN NULL ELSE 'part|' || CAST(l_partkey AS VARCHAR) END FROM lines
  UNION ALL SELECT sheet, CAST(n + 2 AS INTEGER), 1, CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) FROM lines
  UNION ALL SELECT sheet, CAST(n + 2 AS INTEGER), 2, l_returnflag FROM lines
  UNION ALL SELECT sheet, CAST(n + 2 AS INTEGER), 3, CASE WHEN l_partkey % 2 = 0 THEN '' ELSE ' x ' END FROM lines)"""


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("sheet"), (F.row_number().over(w) + 2).cast("int").alias("row_no"), "l_partkey", "l_quantity", "l_returnflag")
    s = F.struct
    top = [s(F.lit(0).alias("row_no"), F.lit(0).alias("col_no"), F.concat(F.lit("某某保险产品 "), F.col("sheet").cast("string")).alias("value"))]
    top += [s(F.lit(1).alias("row_no"), F.lit(c).alias("col_no"), F.lit(v).alias("value")) for c, v in ((0, " 保障项目 "), (1, "年限额"), (2, "备注"), (3, "说明"))]
    part = F.when(F.col("l_partkey") % 7 != 0, F.concat(F.lit("part|"), F.col("l_partkey").cast("string")))
    body = [part, F.col("l_quantity").cast("bigint").cast("string"), F.col("l_returnflag"), F.when(F.col("l_partkey") % 2 == 0, "").otherwise(" x ")]
    below = F.array(*[s("row_no", F.lit(c).alias("col_no"), v.alias("value")) for c, v in enumerate(body)])
    first = F.when(F.col("row_no") == 3, F.concat(F.array(*top), below)).otherwise(below)  # a sheet's first line brings its title and header
    return rows.select("sheet", F.explode(first).alias("c")).select("sheet", "c.*")


# ---- answers: skill texts of a model for each document
ANSWERS_SQL = r"""
answers AS (
  SELECT doc_id, text AS source_text,
    CASE WHEN doc_id % 7 = 0 THEN 'nothing here: EMPTY_BLOCK' ELSE
      E'<think> plan ' || CAST(doc_id AS VARCHAR) || E' </think>\n---\nname: skill-' || CAST(doc_id AS VARCHAR) || E'\ntrigger: "when ' || lang || E'"\n' ||
      CASE WHEN doc_id % 3 = 0 THEN E'domain: tech\nconfidence: 0.' || CAST(doc_id % 10 AS VARCHAR) || E'\n' ELSE '' END ||
      E'prerequisites:\n  - first\n  - "second"\n---\n1. ' || replace(text, E'\n', ' ') ||
      CASE WHEN doc_id % 5 = 0 THEN ' zyxwvu qponmlk jihgfed wvutsrq ponmlkj ihgfedc vutsrqp onmlkji utsrqpo nmlkjih tsrqpon mlkjihg srqponm lkjihgf rqponml kjihgfe qqqqzzzz wwwwzzzz eeeezzzz rrrrzzzz ttttzzzz yyyyzzzz uuuuzzzz iiiizzzz oooozzzz ppppzzzz aaaazzzz sssszzzz ddddzzzz ffffzzzz ggggzzzz hhhhzzzz jjjjzzzz kkkkzzzz llllzzzz xxxxzzzz ccccvvvv vvvvbbbb bbbbnnnn nnnnmmmm mmmmqqqq' ELSE '' END ||
      CASE WHEN doc_id % 2 = 0 THEN E'\n---\nname: other ' || CAST(doc_id AS VARCHAR) || E'\ntrigger: any\n---\nno steps' ELSE '' END
    END AS output_raw
  FROM documents)"""
FOREIGN = " zyxwvu qponmlk jihgfed wvutsrq ponmlkj ihgfedc vutsrqp onmlkji utsrqpo nmlkjih tsrqpon mlkjihg srqponm lkjihgf rqponml kjihgfe qqqqzzzz wwwwzzzz eeeezzzz rrrrzzzz ttttzzzz yyyyzzzz uuuuzzzz iiiizzzz oooozzzz ppppzzzz aaaazzzz sssszzzz ddddzzzz ffffzzzz ggggzzzz hhhhzzzz jjjjzzzz kkkkzzzz llllzzzz xxxxzzzz ccccvvvv vvvvbbbb bbbbnnnn nnnnmmmm mmmmqqqq"


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    n, lit = i.cast("string"), F.lit
    text = F.concat(
        lit("<think> plan "), n, lit(" </think>\n---\nname: skill-"), n, lit('\ntrigger: "when '), F.col("lang"), lit('"\n'),
        F.when(i % 3 == 0, F.concat(lit("domain: tech\nconfidence: 0."), (i % 10).cast("string"), lit("\n"))).otherwise(""),
        lit('prerequisites:\n  - first\n  - "second"\n---\n1. '), F.regexp_replace("text", "\n", " "),
        F.when(i % 5 == 0, FOREIGN).otherwise(""),
        F.when(i % 2 == 0, F.concat(lit("\n---\nname: other "), n, lit("\ntrigger: any\n---\nno steps"))).otherwise(""),
    )
    return table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("source_text"), F.when(i % 7 == 0, "nothing here: EMPTY_BLOCK").otherwise(text).alias("output_raw"))


# ---- Chinese terms in the texts, so that patterns and keywords match as they are shipped
CHINESE = (
    (" the ", " 保额（每年赔付的最高限额） "), (" of ", " 流程与步骤 "), (" and ", " 数据，数量 "), (" that ", " 层级关系 "),
    (" with ", " 免赔额是指每次赔付之前由自己承担的部分。 "), (" for ", " 等待期，即合同生效之后的一段时间。 "), (" be ", " 保单(合同双方签署的文件) "),
)
CHINESE_SQL = r"""
zh AS (SELECT doc_id, source, """ + "".join("replace(" for _ in CHINESE) + r"regexp_replace(text, '[^\x00-\x7F]', 'e', 'g')" + "".join(f", '{a}', '{b}')" for a, b in CHINESE) + " AS text FROM documents)"


def chinese(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.regexp_replace("text", r"[^\x00-\x7F]", "e")
    for a, b in CHINESE:
        t = F.replace(t, F.lit(a), F.lit(b))
    return table(spark, sf_dir, "documents").select("doc_id", "source", t.alias("text"))
