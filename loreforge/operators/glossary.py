"""Glossary: term and definition pairs of skills, merged and reported."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loreforge.functions.text import col, strip

#: Patterns of definitions; group 1 is the term, group 2 the definition.
PATTERNS = (
    r"([一-鿿]{2,10})（([^）]{4,60})）",
    r"([一-鿿]{2,10})\(([^)]{4,60})\)",
    r"([一-鿿A-Za-z]{2,15})\s*(?:是指|指的是|定义为|称为|简称)\s*(.{5,80}?)(?:[。；\n]|$)",
    r"([一-鿿A-Za-z]{2,15})\s*(?:，|,)\s*(?:即|也就是|亦称)\s*(.{5,60}?)(?:[。；\n]|$)",
)
#: The same matches with fewer steps: an English word is left at once where neither a Chinese letter nor a comma follows it.
_FASTER = {
    PATTERNS[2]: r"(?=[A-Za-z]*+\s*+[一-鿿])" + PATTERNS[2],
    PATTERNS[3]: r"([一-鿿A-Za-z]{2,15}+)\s*+(?:，|,)\s*(?:即|也就是|亦称)\s*(.{5,60}?)(?:[。；\n]|$)",
}


def mentions(text: Column | str, patterns=PATTERNS) -> Column:
    """Array of (term, definition), pattern by pattern."""
    t = F.coalesce(col(text), F.lit(""))
    marked = F.contains(t, F.lit("\x01")) | F.contains(t, F.lit("\x02"))
    parts = []
    for p in patterns:
        p = "(?Ud)" + _FASTER.get(p, p)
        twice = F.arrays_zip(F.transform(F.regexp_extract_all(t, F.lit(p), 1), strip).alias("term"), F.transform(F.regexp_extract_all(t, F.lit(p), 2), strip).alias("definition"))
        # one pass gives both groups, between marks; a text that holds such marks itself takes two
        pieces = F.filter(F.split(F.regexp_replace(t, p, "\x01$1\x02$2\x01"), "\x01"), lambda x, i: i % 2 == 1)
        both = F.transform(pieces, lambda x: F.struct(strip(F.substring_index(x, "\x02", 1)).alias("term"), strip(F.substring_index(x, "\x02", -1)).alias("definition")))
        parts.append(F.when(marked, twice).otherwise(both))
    return F.concat(*parts)


def glossary_mentions(skills: DataFrame, texts: tuple[str, ...] = ("body", "raw_text"), idx: str = "idx", patterns=PATTERNS) -> DataFrame:
    """(idx, name, pos, term, definition) over the texts of each skill, in order."""
    rows = F.concat(*[mentions(t, patterns) for t in texts])
    return skills.select(idx, "name", F.posexplode(rows).alias("pos", "m")).select(idx, "name", "pos", "m.term", "m.definition")


def extract_glossary(mentioned: DataFrame, min_frequency: int = 1, idx: str = "idx") -> DataFrame:
    """(term, definition, frequency, source_skills) by lower-cased term: first spelling, longest definition, sources in order."""
    at = F.struct(idx, "pos")
    key = strip(F.lower("term"))
    # sources first by name, so a term of very many mentions gathers each name once
    by_name = mentioned.groupBy(key.alias("key"), "name").agg(
        F.count("*").alias("n"), F.min(at).alias("at"), F.min_by("term", at).alias("term"),
        F.max_by("definition", F.struct(F.length("definition"), -F.col(idx), -F.col("pos"))).alias("definition"), F.max(F.struct(F.length("definition").alias("n"), (-F.col(idx)).alias("i"), (-F.col("pos")).alias("p"))).alias("d"),
    )
    out = by_name.groupBy("key").agg(
        F.min_by("term", "at").alias("term"), F.max_by("definition", "d").alias("definition"), F.sum("n").alias("frequency"),
        F.transform(F.array_sort(F.collect_list(F.struct("at", "name"))), lambda x: x["name"]).alias("source_skills"),
    )
    return out.where(F.col("frequency") >= min_frequency).drop("key")


def glossary_report(glossary: DataFrame) -> DataFrame:
    """A Markdown line for each term, ordered by frequency and term: (frequency, term, line)."""
    s = F.col("source_skills")
    sources = F.concat(F.array_join(F.slice(s, 1, 3), ", "), F.when(F.size(s) > 3, F.format_string(" 等%d个", F.size(s))).otherwise(""))
    line = F.concat(F.lit("| "), F.concat_ws(" | ", "term", "definition", F.col("frequency").cast("string"), sources), F.lit(" |"))
    return glossary.select("frequency", "term", line.alias("line")).orderBy(F.desc("frequency"), "term")


