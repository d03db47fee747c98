"""Rule classification of skills, files and domains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loreforge.functions.text import col, count_matches, has_any

# ---- fixed values: keywords of the three record types
FACTUAL = "档案|简历|生卒|籍贯|出生|家族|官职|品级|俸禄|收支|账目|银两|数据|数量|人口|产量|价格|地理|位置|建筑|结构|布局|面积|距离|设定|背景|世界观|历史|年表|时间线|大事记|物品|器物|武器|装备|规格|材质"
PROCEDURAL = r"流程|步骤|操作|程序|方法|策略|战术|技巧|如何|怎样|应对|处理|执行|部署|实施|决策|判断|选择|权衡|博弈|谈判|IF.*THEN|前置条件|触发条件|预期结果|第[一二三四五六七八九十]步|Step\s*\d"
RELATIONAL = "关系|派系|阵营|联盟|对立|从属|标签|分类|层级|等级|体系|谱系|术语|定义|概念|词汇|名词解释|网络|图谱|依赖|影响链|因果链"
# ---- fixed values: keywords of file levels, in order of priority
FILE_LEVELS = (
    ("schema", ("保障利益", "利益表", "保障计划", "保障方案", "产品费率")),
    ("rule", ("健康告知", "投保须知", "责任免除", "免除事项", "重要提示", "特别约定")),
    ("list", ("清单", "名录", "名单", "医院列表", "机构列表", "目录")),
    ("auxiliary", ("QA", "问答", "计划书", "保单样本", "电子保单", "服务手册", "增值服务")),
    ("clause", ("条款", "保险合同", "主险", "附加险", "附约")),
)
SHEET_SUFFIXES = (".xlsx", ".xls", ".csv")
CLAUSE_SUFFIXES = (".pdf", ".docx", ".doc")
#: Suffixes and formats of documents.
FORMATS = {
    ".pdf": "pdf", ".txt": "txt", ".text": "txt", ".md": "txt", ".markdown": "txt", ".epub": "epub",
    ".docx": "docx", ".doc": "docx", ".xlsx": "excel", ".xls": "excel", ".csv": "excel",
}
#: Domain names and what they are normalised to.
DOMAIN_SYNONYMS = {
    "保险": "保险", "insurance": "保险", "保障": "保险",
    "理赔": "保险·理赔", "赔付": "保险·理赔", "claims": "保险·理赔",
    "核保": "保险·核保", "承保": "保险·核保", "underwriting": "保险·核保",
    "法律": "法律", "法规": "法律", "legal": "法律", "法务": "法律",
    "合同": "法律·合同", "contract": "法律·合同", "条款": "法律·合同",
    "技术": "技术", "technology": "技术", "tech": "技术",
    "开发": "技术·开发", "编程": "技术·开发", "programming": "技术·开发",
    "运维": "技术·运维", "devops": "技术·运维", "ops": "技术·运维",
    "医学": "医学", "medical": "医学", "临床": "医学·临床",
    "药学": "医学·药学", "pharmacy": "医学·药学",
    "金融": "金融", "finance": "金融", "财务": "金融",
    "投资": "金融·投资", "investment": "金融·投资",
}
# ---- end of fixed values


def suffix(path: Column | str) -> Column:
    """Lower-cased suffix of the last path part, with its dot; '' where there is none."""
    return F.lower(F.regexp_extract(col(path), r"[^/.][^/]*?(\.[^./]+)$", 1))


def stem(path: Column | str) -> Column:
    name = F.regexp_extract(col(path), r"([^/]*)$", 1)
    return F.when(name.rlike(r"^.+\.[^.]+$"), F.regexp_extract(name, r"^(.+)\.[^.]+$", 1)).otherwise(name)


def detect_format(path: Column | str) -> Column:
    """Format by suffix; null for unknown suffixes."""
    table = F.create_map(*[F.lit(x) for kv in FORMATS.items() for x in kv])
    return F.try_element_at(table, suffix(path))


def classify_file_level(path: Column | str, levels=FILE_LEVELS) -> Column:
    """First level with a keyword in the stem; else sheets are schema, documents clause, others unknown."""
    low, suf = F.lower(stem(path)), suffix(path)
    out = None
    for level, keywords in levels:
        hit = has_any(low, [k.lower() for k in keywords])
        out = F.when(hit, level) if out is None else out.when(hit, level)
    return out.when(suf.isin(*SHEET_SUFFIXES), "schema").when(suf.isin(*CLAUSE_SUFFIXES), "clause").otherwise("unknown")


def sku_rule_scores(skills: DataFrame, patterns=(FACTUAL, PROCEDURAL, RELATIONAL)) -> DataFrame:
    """Adds factual, procedural and relational: matches of each type's keywords in name, trigger and 500 characters of body."""
    text = F.concat_ws(" ", F.coalesce("name", F.lit("")), F.coalesce("trigger", F.lit("")), F.substring(F.coalesce("body", F.lit("")), 1, 500))
    names = ("factual", "procedural", "relational")
    return skills.withColumns({n: count_matches(text, "(?iUd)" + p) for n, p in zip(names, patterns, strict=True)})


def classify_sku(skills: DataFrame, patterns=(FACTUAL, PROCEDURAL, RELATIONAL)) -> DataFrame:
    """Adds sku_type: the leading type with 2 matches or more; else by numbered steps, by arrows, else factual."""
    s = sku_rule_scores(skills, patterns)
    types = ("factual", "procedural", "relational")
    ranked = F.array_sort(F.array(*[-F.col(t) for t in types]))
    top, second = -ranked[0], -ranked[1]
    leader = F.when(F.col("factual") == top, "factual").when(F.col("procedural") == top, "procedural").otherwise("relational")
    body = F.lower(F.coalesce("body", F.lit("")))
    kind = (
        F.when((top >= 2) & (top - second >= 1), leader)
        .when(body.rlike(r"[1-9]\."), "procedural")
        .when(has_any(body, ("→", "->", "关系")), "relational")
        .otherwise("factual")
    )
    return s.withColumn("sku_type", kind).drop(*types)


def sku_stats(skills: DataFrame) -> DataFrame:
    return skills.groupBy("sku_type").agg(F.count("*").alias("n"))


def normalize_domain(domain: Column | str, synonyms: dict[str, str] = DOMAIN_SYNONYMS) -> Column:
    """The synonym of the trimmed lower-cased domain; others stay as they are."""
    table = F.create_map(*[F.lit(x) for kv in synonyms.items() for x in kv])
    key = F.regexp_replace(F.lower(col(domain)), r"(?U)\A\s+|\s+\z", "")
    return F.coalesce(F.try_element_at(table, key), col(domain))


def domain_tag_map(skills: DataFrame, synonyms: dict[str, str] = DOMAIN_SYNONYMS) -> DataFrame:
    """(domain, normalized) where they differ."""
    return skills.select("domain", normalize_domain("domain", synonyms).alias("normalized")).distinct().where("domain <> normalized")
