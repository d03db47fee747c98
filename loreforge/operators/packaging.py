"""Routed packages of skills: sheets, skill texts, indexes, manifests; and the registry that reads them back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loreforge.functions.text import col, strip
from loreforge.operators.graph import cut_label
from loreforge.operators.text_search import FIELD, GRAM, find_texts
from loreforge.operators.validate import kebab_slug

#: Labels of the record types and of the metadata table's rows.
TYPE_LABELS = {"factual": "事实查询", "procedural": "操作指南", "relational": "关系推理"}
OTHER_LABEL = "通用"
M_DOMAIN, M_TYPE, M_CONFIDENCE, M_NEEDS, M_SOURCE = "领域", "类型", "置信度", "前置条件", "来源"
NONE, EMPTY_BODY = "无", "（内容待补充）"


def percent(c: Column | str) -> Column:
    return F.concat(F.format_string("%.0f", F.bround(col(c) * 100, 0)), F.lit("%"))


def route_by_type(skills: DataFrame) -> DataFrame:
    """(sku_type, n, place, link, trigger, domain, confidence): routes of each type by domain, triggers cut at 40 characters."""
    counts = skills.groupBy("sku_type").agg(F.count("*").alias("n"))
    link = F.concat(F.lit("["), F.col("name"), F.lit("](./skus/"), F.col("sku_type"), F.lit("/"), F.col("sku_id"), F.lit("/header.md)"))
    rows = skills.select("sku_type", "idx", link.alias("link"), cut_label(F.col("trigger"), 40).alias("trigger"), "domain", percent("confidence").alias("confidence"))
    return rows.join(F.broadcast(counts), "sku_type").select("sku_type", "n", "domain", "idx", "link", "trigger", "confidence")  # one row for each type


def domain_levels(domain: Column | str) -> tuple[Column, Column]:
    d = col(domain)
    top = F.substring_index(d, "·", 1)
    return top, F.when(F.contains(d, F.lit("·")), F.substr(d, F.length(top) + 2)).otherwise("")


def route_by_domain(skills: DataFrame) -> DataFrame:
    """(level1, level2, n): skills of each first level (level2 null) and of each second level under it ('' for none)."""
    top, sub = domain_levels("domain")
    return skills.select(top.alias("level1"), sub.alias("level2")).rollup("level1", "level2").agg(F.count("*").alias("n"), F.grouping("level1").alias("g")).where("g = 0").drop("g")


def write_skill_sheets(skills: DataFrame, path: str | None = None) -> DataFrame:
    """(sku_type, path, text): a header and a content sheet for each skill; written as Parquet by type where a path is given."""
    folder = F.concat_ws("/", "sku_type", "sku_id")
    header = F.concat_ws(
        "\n", F.lit("---"), F.concat(F.lit("name: "), "name"), F.concat(F.lit("sku_id: "), "sku_id"), F.concat(F.lit("trigger: "), "trigger"), F.concat(F.lit("domain: "), "domain"),
        F.concat(F.lit("sku_type: "), "sku_type"), F.concat(F.lit("confidence: "), percent("confidence")), F.lit("---"),
    )
    sheets = F.array(
        F.struct(F.concat(folder, F.lit("/header.md")).alias("path"), header.alias("text")),
        F.struct(F.concat(folder, F.lit("/content.md")).alias("path"), F.concat(F.lit("# "), "name", F.lit("\n\n"), F.coalesce("body", F.lit(""))).alias("text")),
    )
    out = skills.select("sku_type", F.explode(sheets).alias("s")).select("sku_type", "s.path", "s.text")
    if path:
        out.write.mode("overwrite").partitionBy("sku_type").parquet(path)
    return out


def type_label(kind: Column | str) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in TYPE_LABELS.items() for x in kv]), col(kind)), F.lit(OTHER_LABEL))


def skill_text(slug: Column | str = "slug") -> Column:
    """A skill's package text: header with slug and description, sections, metadata table."""
    trigger = F.coalesce("trigger", F.lit(""))
    description = F.when(trigger != "", F.regexp_replace(trigger, "[。.]+\\z", "")).otherwise(F.col("name"))
    needs = F.when(F.size("prerequisites") > 0, F.array_join("prerequisites", ", ")).otherwise(NONE)
    body = F.when(F.coalesce("body", F.lit("")) != "", strip("body")).otherwise(EMPTY_BODY)
    row = lambda name, value: F.concat(F.lit(f"| {name} | "), value, F.lit(" |"))
    return F.concat(
        F.lit("---\nname: "), col(slug), F.lit("\ndescription: "), description, F.lit("\n---\n\n# "), F.col("name"),
        F.lit("\n\n## When to Use\n\n"), trigger, F.lit("\n\n## Core Logic\n\n"), body, F.lit("\n\n## Metadata\n\n| 属性 | 值 |\n|------|-----|\n"),
        F.concat_ws("\n", row(M_DOMAIN, F.col("domain")), row(M_TYPE, F.concat(type_label("sku_type"), F.lit(" ("), "sku_type", F.lit(")"))), row(M_CONFIDENCE, percent("confidence")), row(M_NEEDS, needs), row(M_SOURCE, F.coalesce("source_ref", F.lit("")))),
        F.lit("\n"),
    )


def write_skill_packages(skills: DataFrame, path: str | None = None) -> DataFrame:
    """(slug, path, text): the package text and the source reference of each slug's best skill."""
    from loreforge.operators.similarity import best_per_slug

    best = best_per_slug(skills.withColumn("slug", kebab_slug("name")))
    source = F.concat(F.lit("# "), F.col("name"), F.lit(" — 参考资料\n\n> 来源 chunk #"), F.col("source_chunk_index").cast("string"), F.lit("\n> 上下文: "), F.coalesce("source_context", F.lit("")), F.lit("\n\n---\n\n"), F.coalesce("raw_text", F.lit("")), F.lit("\n"))
    files = F.array(F.struct(F.concat("slug", F.lit("/SKILL.md")).alias("path"), skill_text().alias("text")), F.struct(F.concat("slug", F.lit("/references/source.md")).alias("path"), source.alias("text")))
    out = best.select("slug", F.explode(files).alias("f")).select("slug", "f.path", "f.text")
    if path:
        out.write.mode("overwrite").parquet(path)
    return out


def domain_index(skills: DataFrame) -> DataFrame:
    """(domain, n, place, line): index lines of each domain by skill name, triggers cut at 50 characters."""
    w = W.partitionBy("domain").orderBy("name", "idx")
    n = F.count("*").over(W.partitionBy("domain"))
    line = F.concat(F.lit("| ["), F.col("name"), F.lit("](./"), kebab_slug("name"), F.lit("/SKILL.md) | "), cut_label(F.col("trigger"), 50), F.lit(" | "), F.col("sku_type"), F.lit(" | "), percent("confidence"), F.lit(" |"))
    return skills.select("domain", n.alias("n"), F.row_number().over(w).alias("place"), line.alias("line"))


def package_manifest(skills: DataFrame) -> DataFrame:
    """One row: total_skills, domains (sorted), counts of the three types."""
    return skills.agg(
        F.count("*").alias("total_skills"), F.sort_array(F.collect_set("domain")).alias("domains"),
        *[F.count_if(F.col("sku_type") == t).alias(t) for t in TYPE_LABELS],
    )


def manifest_entries(skills: DataFrame) -> DataFrame:
    """The manifest's skill list, a JSON row for each: it grows with the skills, so it is a table beside the one-row summary."""
    entry = F.struct(kebab_slug("name").alias("slug"), "name", "domain", F.col("sku_type").alias("type"), "trigger", "confidence")
    return skills.select("idx", F.to_json(entry).alias("entry"))


# ---------------------------------------------------------------- registry


def section(text: Column | str, heading: str) -> Column:
    return strip(F.regexp_extract(col(text), rf"(?ms)^##\s+{heading}\s*\n(.*?)(?=^##\s|\z)", 1))


def parse_skill_package(files: DataFrame, text: str = "text") -> DataFrame:
    """Registry entries from package texts (dir, text): slug, name, description, domain, skill_type, trigger, confidence."""
    head = F.regexp_extract(text, r"(?s)\A---\s*\n(.*?)\n---", 1)
    field = lambda k: F.regexp_replace(strip(F.regexp_extract(head, rf"(?m)^\s*{k}\s*:(.*)$", 1)), "\\A[\"']+|[\"']+\\z", "")
    meta = section(text, "Metadata")
    cell = lambda name: strip(F.regexp_extract(meta, rf"(?m)^[^|\n]*\|[^|\n]*{name}[^|\n]*\|([^|\n]*)", 1))
    when = section(text, "When to Use")
    name = F.coalesce(F.nullif(field("name"), F.lit("")), F.regexp_extract("dir", "([^/]*)$", 1))
    return files.select(
        name.alias("slug"), name.alias("name"), field("description").alias("description"), cell(M_DOMAIN).alias("domain"), cell(M_TYPE).alias("skill_type"),
        F.when(when != "", when).otherwise(field("description")).alias("trigger"), F.col("dir").alias("skill_dir"),
        F.coalesce(F.regexp_replace(cell(M_CONFIDENCE), "%+\\z", "").try_cast("double") / 100, F.lit(0.0)).alias("confidence"),
    )


def registry_upsert(entries: DataFrame, seq: str = "load_seq") -> DataFrame:
    """One entry for each slug, the one loaded last."""
    fields = [c for c in entries.columns if c != "slug"]
    return entries.groupBy("slug").agg(F.max_by(F.struct(*fields), seq).alias("r")).select("slug", "r.*")


def trigger_text() -> Column:
    """What registry_find_trigger() looks into, as one text for build_text_index()."""
    return F.lower(F.concat(F.coalesce("trigger", F.lit("")), F.lit(FIELD), F.coalesce("description", F.lit(""))))


def registry_find_trigger(entries: DataFrame, query: str, index: DataFrame | None = None, key: str = "slug") -> DataFrame:
    """Entries whose trigger or description holds the query, whatever the case; with an index of trigger_text() by key no other entry is read."""
    if index is not None and len(query) >= GRAM:
        return entries.join(find_texts(index, [key], query.lower()).hint("shuffle_hash"), key, "left_semi")
    q = F.lit(query.lower())
    return entries.where(F.contains(F.lower("trigger"), q) | F.contains(F.lower("description"), q))


def registry_find_domain(entries: DataFrame, prefix: str) -> DataFrame:
    return entries.where(F.col("domain").startswith(prefix))


def registry_manifest(entries: DataFrame) -> DataFrame:
    """One row: total and the sorted domains that aren't empty."""
    return entries.agg(F.count("*").alias("total"), F.sort_array(F.collect_set(F.nullif("domain", F.lit("")))).alias("domains"))


# ---------------------------------------------------------------- tables of a workflow


def save_chunks(chunks: DataFrame, path: str) -> None:
    chunks.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("workflow_id").parquet(path)


def save_skills(skills: DataFrame, start: int, order: list[str], path: str | None = None) -> DataFrame:
    """Adds idx from start on, in the given order within each workflow, and appends."""
    out = skills.withColumn("idx", F.row_number().over(W.partitionBy("workflow_id").orderBy(*order)) - 1 + start)
    if path:
        out.write.mode("append").partitionBy("workflow_id").parquet(path)
    return out


def load_chunks(chunks: DataFrame, wanted: DataFrame | None = None, key: tuple[str, ...] = ("doc_id", "chunk_index")) -> DataFrame:
    return chunks if wanted is None else chunks.join(wanted, list(key), "left_semi")


def load_skills(skills: DataFrame, order: str = "idx") -> DataFrame:
    return skills.orderBy(order)
