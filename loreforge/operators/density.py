"""Information density of text chunks and the filters built on it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loreforge.functions.text import col, count_matches, has_any, hits

# ---- fixed values: word lists and patterns that decide scores
CONNECTORS = (
    "因为", "所以", "导致", "如果", "则", "否则", "当", "那么",
    "然而", "但是", "因此", "虽然", "尽管", "由于", "基于",
    "前提", "假设", "推论", "结论", "证明", "反之",
    "because", "therefore", "if", "then", "else", "however",
    "although", "since", "thus", "hence", "implies", "given that",
)
LOW_VALUE = ("简介", "概述", "背景", "历史", "发展", "演变", "致谢", "感谢", "参考文献", "附录", "前言", "序言", "导言")
ANCHORS = (
    "仅适用于", "限于", "以下场景", "在此条件下", "适用范围", "前提条件", "前提假设",
    "定义为", "指的是", "是指", "称为", "简称", "术语", "概念", "含义",
    "必须", "禁止", "不得", "要求", "强制", "注意", "警告", "重要",
)
CONDITION_WORDS, THEN_WORDS = ("如果", "若", "当", "假设", "假如"), ("则", "就", "那么", "应该", "需要")
CAUSAL_WORDS = ("因为", "由于", "因此", "导致", "引起", "造成", "使得", "so that", "due to", "leads to")
FORMULA_SIGNS, FORMULA_COMMANDS = "=≈≤≥±∑∏∫√∞αβγδε", ("frac", "sum", "int")
NUMBER = r"(?<!\w)\d+(?:\.\d+)?(?!\w)"
UNIT = r"\d+\s*(?:KB|MB|GB|TB|ms|秒|分钟|小时|天|%|元|万|亿|次|个|条|px|em|rem|kg|km|cm|mm|℃|°C|rpm|Hz|kHz|MHz|GHz|Mbps|Gbps)"
IDENTIFIER = r"[a-zA-Z_]\w*(?:\.\w+)+|[a-z]+[A-Z]\w+|[A-Z]{2,}\w*"
PARENTHETICAL = r"（[^）]{2,20}）|\([^)]{2,20}\)"
# ---- end of fixed values
CONDITION = f"(?:{'|'.join(CONDITION_WORDS)}).{{2,40}}(?:{'|'.join(THEN_WORDS)})"
CAUSAL = f"(?:{'|'.join(CAUSAL_WORDS)})"
FORMULA = "|".join([f"[{FORMULA_SIGNS}]", *(r"\\" + x for x in FORMULA_COMMANDS), r"\$\$.+?\$\$"])

_U = "(?Ud)"
#: What a text must hold for a pattern to match anywhere: cheap to test, and most texts have none of it.
_DIGIT, _NAME_LIKE = r"(?U)\d", r"[A-Z.](?:(?<=[a-zA-Z][A-Z])|(?<=\.)\S)"
_FORMULA_PARTS = r"[=±$\\α-ε∏-≥]"  # ranges: a class of single signs is tried sign by sign
_MARK = r"[|#`]|[-*+] "
#: The same matches as NUMBER and IDENTIFIER in less time. Every match of an identifier ends where its word ends, so an alternative
#: that fails on a word's letter fails on the next one too, and no part that gave way would let it match.
_NUMBER = r"(?=\d)" + NUMBER
_IDENTIFIER = r"(?<![a-zA-Z_])[a-zA-Z_]\w*+(?:\.\w+)++|(?<![a-z])[a-z]++[A-Z]\w++|(?<![A-Z])[A-Z]{2,}+\w*+"


def _count_if(needed: Column, c: Column, pattern: str) -> Column:
    return F.when(needed, count_matches(c, _U + pattern)).otherwise(0)


def logic_density(c: Column | str) -> Column:
    """Distinct connectors (2), condition patterns (5) and causal patterns (4) for each word; at most 1."""
    c = col(c)
    low = F.lower(c)
    raw = hits(low, CONNECTORS) * 2 + _count_if(has_any(low, CONDITION_WORDS), c, CONDITION) * 5 + _count_if(has_any(low, CAUSAL_WORDS), low, CAUSAL) * 4
    return F.least(raw / F.greatest(count_matches(c, r"(?U)\S+"), F.lit(1)), F.lit(1.0))


def entity_density(c: Column | str) -> Column:
    """Numbers (2), units (3), formula signs (5), identifiers (2) and parentheticals (3) for each ten characters; at most 1."""
    c = col(c)
    digits = F.when(c.rlike(_DIGIT), count_matches(c, _U + _NUMBER) * 2 + count_matches(c, _U + UNIT) * 3).otherwise(0)
    names = _count_if(c.rlike(_NAME_LIKE), c, _IDENTIFIER) * 2
    asides = _count_if(F.contains(c, F.lit("(")) | F.contains(c, F.lit("（")), c, PARENTHETICAL) * 3
    raw = digits + _count_if(c.rlike(_FORMULA_PARTS), c, FORMULA) * 5 + names + asides
    return F.least(raw / (F.greatest(F.length(c), F.lit(1)) / 10), F.lit(1.0))


def struct_density(c: Column | str) -> Column:
    """Share of list, table, fence and heading lines, and 0.08 for each pair of fences; at most 1."""
    c = col(c)
    lines = F.split(c, "\n")
    kind = r"(?Us)\A\s*(?:\d+\.\s|[-*+] |[^|]*\|[^|]*\||```|#)"
    share = F.when(~(c.rlike(_DIGIT) | c.rlike(_MARK)), 0.0).otherwise(F.size(F.filter(lines, lambda x: x.rlike(kind))) / F.size(lines))
    return F.least(share + F.floor(count_matches(c, "```") / 2) * 0.08, F.lit(1.0))


def value(c: Column | str, low_value=LOW_VALUE) -> Column:
    """Weighted densities less 0.08 for each low-value word present."""
    c = col(c)
    return logic_density(c) * 0.4 + entity_density(c) * 0.3 + struct_density(c) * 0.3 - hits(F.lower(c), low_value) * 0.08


def value_score(c: Column | str, low_value=LOW_VALUE) -> Column:
    """1 to 5 by value()."""
    return score_level(value(c, low_value))


def score_level(x: Column) -> Column:
    """1 and one more for each step reached: a sum, in which generated code computes x once."""
    reached = [F.coalesce(x >= step, F.lit(False)).cast("int") for step in (0.05, 0.12, 0.22, 0.35)]
    return sum(reached, F.lit(1))


def has_anchor(c: Column | str, anchors=ANCHORS) -> Column:
    return has_any(c, anchors)


def is_table_heavy(c: Column | str) -> Column:
    """More than half of the lines begin with a pipe."""
    lines = F.split(col(c), "\n")
    return F.size(F.filter(lines, lambda x: x.rlike(r"(?U)\A\s*\|"))) > F.size(lines) * 0.5


def filter_chunks(chunks: DataFrame, content: str = "content", anchors=ANCHORS) -> DataFrame:
    """Adds score_a, has_anchor, keep and reason; a chunk is dropped where the score is 2 or less and it has no anchor."""
    # a column of its own: within a lambda the patterns would run outside generated code
    scored = chunks.withColumn("_value", value(content)).withColumns({"score_a": score_level(F.col("_value")), "has_anchor": has_anchor(content, anchors)}).drop("_value")
    low = F.col("score_a") <= 2
    reason = (
        F.when(low & ~F.col("has_anchor"), F.format_string("低信息密度（评分 %d/5）且无上下文锚点", "score_a"))
        .when(low, F.format_string("保留为上下文锚点（评分 %d/5 但含作用域/定义）", "score_a"))
        .otherwise(F.format_string("高价值内容（评分 %d/5）", "score_a"))
    )
    return scored.withColumns({"keep": ~low | F.col("has_anchor"), "reason": reason})


def filter_totals(filtered: DataFrame, *keys: str) -> DataFrame:
    return filtered.groupBy(*keys).agg(
        F.count("*").alias("total"), F.count_if("keep").alias("kept_count"), F.count_if(~F.col("keep")).alias("dropped_count")
    )


def apply_llm_verdicts(chunks: DataFrame, verdicts: DataFrame, key: list[str], threshold: int = 2) -> DataFrame:
    """Joins a model's answers (`answer`, JSON with score, has_anchor, reason) and decides; an unreadable answer keeps its chunk.

    Unreadable or missing: score 3, no anchor, null reason.
    """
    parsed = F.from_json("answer", "score INT, has_anchor BOOLEAN, reason STRING")
    v = verdicts.select(*key, parsed.alias("v"))
    out = chunks.join(v.hint("merge"), key, "left").withColumns(
        {
            "score": F.coalesce(F.col("v.score"), F.lit(3)),
            "has_anchor": F.coalesce(F.col("v.has_anchor"), F.lit(False)),
            "reason": F.when(F.col("v.score").isNotNull(), F.col("v.reason")),
        }
    )
    return out.drop("v").withColumn("keep", (F.col("score") > threshold) | F.col("has_anchor"))
