"""Parsing and validation of skill records in model answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loreforge.functions.text import col, let, strip

#: Words of answers that say nothing of their source.
CN_STOP = (
    "执行步骤", "输出格式", "格式要求", "输出格式要求", "前置条件", "触发条件", "判断条件", "操作步骤", "注意事项", "具体步骤",
    "排查步骤", "解决方案", "处理方法", "诊断步骤", "核心步骤", "检查项目", "原因分析", "结果输出", "结论建议", "适用场景",
    "原因为", "如适用", "事件详情", "配置项", "存在状态", "匹配情况", "检查上游", "列出调度", "资源使用", "解决办法",
)
EN_STOP = (
    "this", "that", "with", "from", "your", "have", "will", "when", "null", "true", "false", "none", "else", "step", "then", "each",
    "following", "output", "input", "check", "verify", "ensure", "execute", "confirm", "should", "must", "below", "above",
    "format", "result", "trigger", "domain", "skill", "prerequisites",
)
DEFAULT_TRIGGER = "通用知识查询"
W_NAME, W_TRIGGER, W_STEPS = "name 字段缺失，从正文第一行推断", "trigger 字段缺失，使用默认值", "正文中未发现编号的执行步骤"
_FENCED = r"(?s)```ya?ml\s*\n(.*?)\n```\s*\n(.*)"
_HEADED = r"(?s)\A---\s*\n(.*?)\n---\s*\n(.*)\z"
_KV = r"(?Ud)^(\w[\w-]*)\s*:\s*(.*)$"


def _unquoted(c: Column) -> Column:
    return F.btrim(F.btrim(strip(c), F.lit('"')), F.lit("'"))


def parse_frontmatter(answers: DataFrame, text: str = "raw_text") -> DataFrame:
    """Adds fields (map of strings), lists (map of string arrays) and body.

    The header stands between --- lines at the start, or in a yaml fence; else there are no fields and all is body. A key
    without a value opens a list; `- item` lines go to the key before them. Values stay strings.
    """
    # the stripped text and its kind as columns of their own: each is used several times below
    answers = answers.withColumn("_t", strip(text)).withColumn("_headed", F.col("_t").rlike(_HEADED))
    t, headed = F.col("_t"), F.col("_headed")
    head = F.when(headed, F.regexp_extract(t, _HEADED, 1)).when(F.col(text).rlike(_FENCED), F.regexp_extract(text, _FENCED, 1)).otherwise("")
    body = F.when(headed, F.regexp_extract(t, _HEADED, 2)).when(F.col(text).rlike(_FENCED), F.regexp_extract(text, _FENCED, 2)).otherwise(t)
    kind = "array<struct<key: string, value: string, items: array<string>>>"

    def step(acc, line):
        last = F.try_element_at(acc, F.lit(-1))
        item = _unquoted(F.regexp_replace(strip(line), r"\A-+", ""))
        with_item = F.concat(
            F.slice(acc, 1, F.size(acc) - 1),
            F.array(F.struct(last["key"].alias("key"), F.lit(None).cast("string").alias("value"), F.concat(F.when(last["value"].isNull(), last["items"]).otherwise(F.array().cast("array<string>")), F.array(item)).alias("items"))),
        ).cast(kind)
        value = _unquoted(F.regexp_extract(line, _KV, 2))
        pair = F.struct(F.regexp_extract(line, _KV, 1).alias("key"), F.nullif(value, F.lit("")).alias("value"), F.array().cast("array<string>").alias("items"))
        return F.when(line.rlike(_KV), F.concat(acc, F.array(pair)).cast(kind)).when(strip(line).startswith("-") & (F.size(acc) > 0), with_item).otherwise(acc)

    rows = F.aggregate(F.split(head, "\n"), F.array().cast(kind), step)
    # of repeated keys the last one counts
    latest = let(rows, lambda kv: F.filter(kv, lambda r, i: ~F.exists(F.slice(kv, i + 2, F.size(kv)), lambda x: x["key"] == r["key"])))
    df = answers.withColumn("_kv", latest)
    values = F.map_from_entries(F.transform(F.filter("_kv", lambda r: r["value"].isNotNull()), lambda r: F.struct(r["key"], r["value"])))
    lists = F.map_from_entries(F.transform(F.filter("_kv", lambda r: r["value"].isNull()), lambda r: F.struct(r["key"], r["items"])))
    return df.withColumns({"fields": values, "lists": lists, "body": strip(body)}).drop("_kv", "_t", "_headed")


def infer_missing_fields(parsed: DataFrame) -> DataFrame:
    """Adds name, trigger and inferred (warnings): a missing name comes from the body's first line, a missing trigger is a default; both need a body."""
    has = lambda k: F.array_contains(F.concat(F.map_keys("fields"), F.map_keys("lists")), k)
    first = strip(F.regexp_replace(F.substring_index("body", "\n", 1), r"\A[# ]+|[# ]+\z", ""))
    slug = F.left(F.lower(F.regexp_replace(F.regexp_replace(first, r"[^a-zA-Z0-9一-鿿]+", "-"), r"\A-+|-+\z", "")), F.lit(50))
    body = F.col("body") != ""
    name = F.when(has("name"), F.coalesce(F.try_element_at("fields", F.lit("name")), F.lit(""))).when(body, slug)
    trigger = F.when(has("trigger"), F.coalesce(F.try_element_at("fields", F.lit("trigger")), F.lit(""))).when(body, DEFAULT_TRIGGER)
    notes = F.array_compact(F.array(F.when(~has("name") & body, W_NAME), F.when(~has("trigger") & body, W_TRIGGER)))
    return parsed.withColumns({"name": name, "trigger": trigger, "inferred": notes})


def collect_warnings(parsed: DataFrame) -> DataFrame:
    """Adds noted: missing domain and source_ref, and a body without numbered steps."""
    has = lambda k: F.array_contains(F.concat(F.map_keys("fields"), F.map_keys("lists")), k)
    notes = [F.when(~has(k), f"建议字段 {k} 缺失") for k in ("domain", "source_ref")]
    return parsed.withColumn("noted", F.array_compact(F.array(*notes, F.when(~F.col("body").rlike(r"[1-9]\."), W_STEPS))))


def key_terms(body: Column | str) -> Column:
    """Distinct Chinese runs of three or more and lower-cased English words of four or more letters, without stop words."""
    body = col(body)
    cn = F.array_except(F.regexp_extract_all(body, F.lit(r"([一-鿿]{3,})"), 1), F.array(*map(F.lit, CN_STOP)))
    en = F.array_except(F.transform(F.regexp_extract_all(body, F.lit(r"([A-Za-z]{4,})"), 1), F.lower), F.array(*map(F.lit, EN_STOP)))
    return F.array_union(cn, en)


def hallucination_check(skills: DataFrame, body: str = "body", source: str = "source_text", most: float = 0.4) -> DataFrame:
    """Adds n_terms, n_missing and suspicious: three terms or more, over `most` of which the source lacks. A null source isn't checked."""
    # A term is letters alone or Chinese alone, so it stands in the source only within a run of such. The runs, each once, decide most
    # terms as a hashed set; the others are searched in the runs, which are far fewer than the text's words.
    runs = F.array_distinct(F.regexp_extract_all(F.lower(source), F.lit(r"([a-z]{4,}|[一-鿿]{3,})"), 1))
    df = skills.select("*", F.explode(F.array(F.struct(key_terms(body).alias("terms"), runs.alias("runs")))).alias("_x"))
    df = df.withColumn("_y", F.explode(F.array(F.struct(F.array_except("_x.terms", "_x.runs").alias("rest"), F.array_join("_x.runs", " ").alias("hay")))))
    missing = F.filter("_y.rest", lambda t: ~F.contains(F.col("_y.hay"), t))
    df = df.withColumns({"n_terms": F.size("_x.terms"), "n_missing": F.size(missing)}).drop("_x", "_y")
    suspicious = (F.col("n_terms") >= 3) & (F.col("n_missing") / F.greatest(F.col("n_terms"), F.lit(1)) > most)
    return df.withColumn("suspicious", F.coalesce(suspicious & F.col(source).isNotNull() & (F.col(source) != ""), F.lit(False)))


def validate_skills(raw: DataFrame, text: str = "raw_text", source: str = "source_text") -> DataFrame:
    """Records with status pass, fail_incomplete or fail_hallucination, and their warnings.

    Missing: domain general, confidence 0.5 (unreadable ones too), no prerequisites. Without a name or trigger a record is
    incomplete.
    """
    p = hallucination_check(collect_warnings(infer_missing_fields(parse_frontmatter(raw, text))), "body", source)
    field = lambda k, d: F.coalesce(F.try_element_at("fields", F.lit(k)), F.lit(d))
    single = F.try_element_at("fields", F.lit("prerequisites"))
    prerequisites = F.when(single.isNotNull(), F.array(single)).otherwise(F.coalesce(F.try_element_at("lists", F.lit("prerequisites")), F.array().cast("array<string>")))
    incomplete = F.col("name").isNull() | F.col("trigger").isNull()
    missing = F.concat(F.lit("必填字段缺失："), F.array_join(F.array_compact(F.array(F.when(F.col("name").isNull(), "name"), F.when(F.col("trigger").isNull(), "trigger"))), ", "))
    guess = F.when(F.col("suspicious"), F.format_string("疑似幻觉：%d/%d 术语未在原文中出现", "n_missing", "n_terms"))
    out = p.withColumns(
        {
            "domain": field("domain", "general"),
            "source_ref": field("source_ref", ""),
            "confidence": F.coalesce(F.try_element_at("fields", F.lit("confidence")).try_cast("double"), F.lit(0.5)),
            "prerequisites": prerequisites,
            "status": F.when(incomplete, "fail_incomplete").when(F.col("suspicious"), "fail_hallucination").otherwise("pass"),
            "warnings": F.when(incomplete, F.array(missing)).otherwise(F.concat("inferred", "noted", F.array_compact(F.array(guess)))),
            "name": F.coalesce("name", F.lit("")),
            "trigger": F.coalesce("trigger", F.lit("")),
        }
    )
    return out.drop("fields", "lists", "inferred", "noted", "n_terms", "n_missing", "suspicious")


def attach_source_text(raw: DataFrame, chunks: DataFrame, key: list[str], content: str = "content") -> DataFrame:
    """Each raw skill gets the content of its own chunk."""
    return raw.join(chunks.select(*key, F.col(content).alias("source_text")).hint("merge"), key, "left")


def slugify(c: Column | str) -> Column:
    """Runs of anything but ASCII letters, digits and Chinese become dashes; 60 characters; `unnamed` if nothing is left."""
    s = F.lower(F.btrim(F.regexp_replace(col(c), r"[^a-zA-Z0-9一-鿿]+", "-"), F.lit("-")))
    return F.coalesce(F.nullif(F.left(s, F.lit(60)), F.lit("")), F.lit("unnamed"))


def kebab_slug(c: Column | str) -> Column:
    """Without punctuation; blanks and underscores become dashes; 60 characters; `unnamed-skill` if nothing is left."""
    s = F.regexp_replace(F.regexp_replace(col(c), r"(?U)[^\w\s一-鿿-]", ""), r"(?U)[\s_]+", "-")
    return F.coalesce(F.nullif(F.left(F.lower(F.btrim(s, F.lit("-"))), F.lit(60)), F.lit("")), F.lit("unnamed-skill"))
