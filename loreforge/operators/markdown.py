"""Markdown structure: cleaning, headings, paths, outlines, HTML and tables to Markdown."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loreforge.functions.text import col, let, ordered_join, split_before, strip

#: Titles of sections that are noise.
NOISE_SECTIONS = ("参考文献", "references", "bibliography", "致谢", "acknowledgments", "acknowledgements")
_PAGE_NUMBER = r"(?Udm)^\s*-?\s*\d+\s*-?\s*$"
_RULE = r"(?Udm)^[-─━═]{3,}\s*$"
_HEADING = r"(?Udm)^(#{1,6})\s+(.+)$"


def headings(text: Column | str) -> Column:
    """Array of (level, title, start_pos, end_pos) of the heading lines; a heading ends where the next one begins."""
    text = col(text)
    # the text before each heading line and the line itself: pieces of the text cut in front of heading lines
    pieces = split_before(text, r"(?Udm)^#{1,6}\s+.")
    kind = "struct<at: int, rows: array<struct<level: int, title: string, start_pos: int, end_pos: int>>>"
    zero = F.struct(F.lit(0).alias("at"), F.array().alias("rows")).cast(kind)
    marked = F.transform(pieces, lambda p: F.struct(F.length(p).alias("n"), F.regexp_extract(p, _HEADING, 0).alias("line")))

    def step(acc, p):
        level = F.length(F.regexp_extract(p["line"], "^(#*)", 1))
        end = acc["at"] + p["n"]
        row = F.struct(level.alias("level"), strip(F.substr(p["line"], level + 1)).alias("title"), acc["at"].alias("start_pos"), end.alias("end_pos"))
        return F.struct(end.alias("at"), F.when(p["line"] != "", F.concat(acc["rows"], F.array(row))).otherwise(acc["rows"]).alias("rows")).cast(kind)

    # most texts have no mark at all
    return F.when(~F.contains(text, F.lit("#")), zero["rows"]).otherwise(F.aggregate(marked, zero, step)["rows"])


def extract_headings(docs: DataFrame, text: str = "markdown") -> DataFrame:
    """A row for each heading: pos, level, title, start_pos, end_pos beside the document's other columns."""
    return docs.select("*", F.posexplode(headings(text)).alias("pos", "h")).select(*[c for c in docs.columns if c != text], "pos", "h.*")


def paths(heads: Column) -> Column:
    """For each heading of an array its path of titles from the root: on level l, headings of l and deeper end."""
    kind = "struct<stack: array<struct<level: int, title: string>>, out: array<array<string>>>"
    start = F.struct(F.array().cast("array<struct<level: int, title: string>>").alias("stack"), F.array().cast("array<array<string>>").alias("out")).cast(kind)

    def step(acc, h):
        stack = F.concat(F.filter(acc["stack"], lambda s: s["level"] < h["level"]), F.array(F.struct(h["level"].alias("level"), h["title"].alias("title"))))
        return F.struct(stack.alias("stack"), F.concat(acc["out"], F.array(F.transform(stack, lambda s: s["title"]))).alias("out"))

    return F.aggregate(heads, start, step)["out"]


def heading_path(docs: DataFrame, text: str = "markdown") -> DataFrame:
    """Rows of extract_headings with heading_path."""
    h = docs.withColumn("_h", headings(text)).withColumn("_p", paths(F.col("_h")))
    rows = h.select("*", F.posexplode(F.arrays_zip("_h", "_p")).alias("pos", "z"))
    return rows.select(*[c for c in docs.columns if c != text], "pos", "z._h.*", F.col("z._p").alias("heading_path"))


def build_context(doc_name: Column | str, path: Column | str) -> Column:
    """`文档：《name》`, and ` | 章节：a > b` where there is a path."""
    head = F.concat(F.lit("文档：《"), col(doc_name), F.lit("》"))
    return F.when(F.size(col(path)) > 0, F.concat(head, F.lit(" | 章节："), F.array_join(col(path), " > "))).otherwise(head)


def clean_markdown(text: Column | str, noise=NOISE_SECTIONS) -> Column:
    """Without page-number lines, rule lines and noise sections (each to the next heading of any level); at most one blank line."""
    plain = F.regexp_replace(F.regexp_replace(col(text), _PAGE_NUMBER, ""), _RULE, "")

    def noisy(p):
        return let(F.lower(F.regexp_extract(p, _HEADING, 2)), lambda title: reduce(or_, (F.contains(title, F.lit(k)) for k in noise), F.lit(False)))

    def kept(t):
        pieces = split_before(t, r"(?Udm)^#{1,6}\s+.")
        return F.when(~F.contains(t, F.lit("#")), t).otherwise(F.array_join(F.filter(pieces, lambda p: ~noisy(p)), ""))

    return strip(F.regexp_replace(let(plain, kept), r"\n{3,}", "\n\n"))


def toc_and_preface(docs: DataFrame, text: str = "markdown", preface_chars: int = 6000) -> DataFrame:
    """Adds toc (indented bullets of the headings) and preface (the first characters, with an ellipsis mark where cut)."""
    h = headings(text)
    bullets = F.transform(h, lambda x: F.concat(F.repeat(F.lit("  "), x["level"] - 1), F.lit("- "), x["title"]))
    t = F.col(text)
    preface = F.when(F.length(t) > preface_chars, F.concat(F.substring(t, 1, preface_chars), F.lit("\n\n[...]"))).otherwise(t)
    return docs.withColumns({"toc": F.array_join(bullets, "\n"), "preface": preface})


#: References that are decoded; the ampersand comes last.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&hellip;", "…"), ("&mdash;", "—"), ("&ndash;", "–"), ("&amp;", "&"))


def html_to_markdown(html: Column | str, drop_raw: bool = True) -> Column:
    """Headings, bold, italics, paragraphs, items and breaks to Markdown; other tags go, references are decoded.

    drop_raw leaves out script and style bodies and comments.
    """
    t = F.regexp_replace(col(html), "[\u0001\u0002]", " ")  # not allowed in HTML; they mark headings below
    if drop_raw:
        t = F.regexp_replace(t, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", "")
    for n in range(1, 7):
        parts = F.split(F.regexp_replace(t, rf"(?is)<h{n}\b[^>]*>(.*?)</h{n}\s*>", "\u0001\u0002$1\u0001"), "\u0001")
        t = F.array_join(
            F.transform(parts, lambda p: F.when(p.startswith("\u0002"), F.concat(F.lit("\n\n" + "#" * n + " "), strip(F.regexp_replace(F.substr(p, F.lit(2)), "<[^>]+>", "")), F.lit("\n\n"))).otherwise(p)), ""
        )
    for pattern, by in (
        (r"(?is)<(strong|b)\b[^>]*>(.*?)</\1\s*>", "**$2**"),
        (r"(?is)<(em|i)\b[^>]*>(.*?)</\1\s*>", "*$2*"),
        (r"(?i)<p\b[^>]*>", "\n\n"), (r"(?i)</p\s*>", "\n\n"), (r"(?i)<li\b[^>]*>", "\n- "), (r"(?i)<br\s*/?>", "\n"), (r"<[^>]+>", ""),
    ):
        t = F.regexp_replace(t, pattern, by)
    for ref, ch in ENTITIES:
        t = F.replace(t, F.lit(ref), F.lit(ch))
    return strip(F.regexp_replace(t, r"\n{3,}", "\n\n"))


def merge_chapters(chapters: DataFrame, book: str, pos: str, markdown: str = "markdown") -> DataFrame:
    """(book, markdown): chapters that aren't blank, in order, with a rule between them."""
    rows = chapters.where(strip(markdown) != "")
    return rows.groupBy(book).agg(ordered_join(markdown, [pos], "\n\n---\n\n").alias("markdown"))


def grid_to_markdown_table(cells: DataFrame, key: list[str], title: str | None = None) -> DataFrame:
    """(key, markdown) from cells (key, row_no, col_no, value): a Markdown table for each key.

    Pipes in values become `│`, newlines blanks, nulls ''; rows without any value are skipped, short ones padded to the
    widest; the first row left is the header. With a title column, `## title` stands above.
    """
    value = strip(F.regexp_replace(F.replace(F.coalesce("value", F.lit("")), F.lit("|"), F.lit("│")), "\n", " "))
    rows = cells.groupBy(*key, "row_no").agg(
        F.array_sort(F.collect_list(F.struct("col_no", value.alias("v")))).alias("c"), F.max(F.col("value").isNotNull()).alias("any"), F.max("col_no").alias("last")
    ).where("any")
    width = F.max("last")
    tables = rows.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("row_no", "c"))).alias("rows"), width.alias("last"))

    def line(row, last):
        vs = F.transform(F.sequence(F.lit(0), last), lambda i: F.coalesce(F.element_at(F.concat(F.transform(F.filter(row["c"], lambda x: x["col_no"] == i), lambda x: x["v"]), F.array(F.lit(""))), 1)))
        return F.concat(F.lit("| "), F.array_join(vs, " | "), F.lit(" |"))

    last = F.col("last")
    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), last + 1), " | "), F.lit(" |"))
    lines = F.transform("rows", lambda r: line(r, last))
    md = let(lines, lambda x: F.array_join(F.concat(F.slice(x, 1, 1), F.array(rule), F.slice(x, 2, F.size(x))), "\n"))
    if title:
        md = F.concat(F.lit("## "), F.col(title), F.lit("\n\n"), md)
    return tables.select(*key, md.alias("markdown"))
