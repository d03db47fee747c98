"""Chunking of Markdown texts: by headings, paragraphs, sentences or dialogue turns. All of it stays within a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loreforge.functions.text import SPACE, col, count_matches, let, ordered_join, split_before, strip
from loreforge.operators.density import filter_chunks
from loreforge.operators.markdown import build_context, clean_markdown, headings, paths

#: Sizes in characters and the marks of dialogue turns.
MAX_CHARS, MIN_CHARS, WINDOW_CHARS, TARGET_CHARS, LEAST_HEADINGS = 4000, 200, 3000, 1500, 5
TURN = r"(?imUd)^(?:Turn\s+\d+|#{1,3}\s*(?:Turn|Round|轮次)\s*\d+|(?:👤|🧑|🤖|💬)\s*(?:User|Assistant|用户|助手))"
_BLANK = r"(?U)\n\s*\n"
_STRINGS = "array<string>"
_CHUNK = "array<struct<content: string, path: array<string>>>"


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with a column computed once for each row: later expressions that refer to it several times don't repeat it."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def not_blank(texts: Column, space: str = SPACE) -> Column:
    return F.filter(F.transform(texts, lambda t: F.btrim(t, F.lit(space))), lambda t: t != "")


def pack(parts: Column, limit: Column | int, extra: int = 0, sep: str = "\n\n") -> Column:
    """Greedy packing in order: a new group where the next part would bring the group over the limit; each part costs its length and extra."""
    kind = "struct<starts: array<int>, n: int, i: int>"
    zero = F.struct(F.array().cast("array<int>").alias("starts"), F.lit(0).alias("n"), F.lit(1).alias("i")).cast(kind)
    limit = F.lit(limit) if isinstance(limit, int) else limit

    def step(acc, part):
        cost = F.length(part) + extra
        new = (acc["i"] == 1) | (acc["n"] + cost > limit)
        return F.struct(
            F.when(new, F.concat(acc["starts"], F.array(acc["i"]))).otherwise(acc["starts"]).alias("starts"),
            F.when(new, cost).otherwise(acc["n"] + cost).alias("n"),
            (acc["i"] + 1).alias("i"),
        ).cast(kind)

    def cut(p, starts):
        ends = F.concat(F.slice(starts, 2, F.size(starts)), F.array(F.size(p) + 1))
        return F.transform(F.arrays_zip(starts.alias("a"), ends.alias("b")), lambda z: F.array_join(F.slice(p, z["a"], z["b"] - z["a"]), sep))

    # only where groups begin is carried along; the texts are cut from it afterwards
    whole = lambda p: F.when(F.size(p) > 0, let(F.aggregate(p, zero, step)["starts"], lambda starts: cut(p, starts))).otherwise(F.array().cast(_STRINGS))
    return let(parts, whole)


def paragraphs(text: Column) -> Column:
    return not_blank(F.split(text, _BLANK))


def split_sentences(text: Column | str, max_chars: int, overlap: int = 0, space: str = SPACE) -> Column:
    """Pieces of at most max_chars: cut after the last sentence end of the window if past 30 % of it, else at the last blank past 30 %, else hard.

    With an overlap each piece but the first begins as many characters earlier, and windows are that much shorter. `space` has the
    characters that count as white space, of which a sentence end takes those after it and a piece has none at its ends. No piece is empty.
    """
    whole, max_chars = max_chars, max_chars - overlap
    kind = "struct<pos: int, cuts: array<int>>"
    zero = F.struct(F.lit(0).alias("pos"), F.array().cast("array<int>").alias("cuts")).cast(kind)
    least = max_chars * 0.3

    def move(w):
        end = F.greatest(F.length(F.regexp_extract(w, f"(?s)^.*[。！？.!?][{space}]*", 0)), F.length(F.regexp_extract(w, r"(?s)^.*\n", 0)))
        blank = F.length(w) - F.length(F.substring_index(w, " ", -1)) - 1
        return let(end, lambda e: F.when(e > least, e).when(blank > least, blank).otherwise(F.lit(max_chars)))

    def cuts_of(t):
        n = F.length(t)

        def step(acc, _):
            to = F.when(acc["pos"] + max_chars >= n, n).otherwise(acc["pos"] + let(F.substr(t, acc["pos"] + 1, F.lit(max_chars)), move))
            return F.when(acc["pos"] >= n, acc).otherwise(let(to, lambda x: F.struct(x.alias("pos"), F.concat(acc["cuts"], F.array(x)).alias("cuts")).cast(kind)))

        # each cut moves on by 30 % of the window at least
        return F.aggregate(F.sequence(F.lit(0), F.ceil(n / least).cast("int")), zero, step)["cuts"]

    def pieces(t, cuts):
        begins = F.concat(F.array(F.lit(0)), F.slice(cuts, 1, F.size(cuts) - 1))
        if overlap:
            begins = F.transform(begins, lambda a: F.greatest(a - overlap, F.lit(0)))
        return not_blank(F.transform(F.arrays_zip(begins.alias("a"), cuts.alias("b")), lambda z: F.substr(t, z["a"] + 1, z["b"] - z["a"])), space)

    return let(col(text), lambda t: F.when(t == "", F.array().cast(_STRINGS)).when(F.length(t) <= whole, F.array(t)).otherwise(let(cuts_of(t), lambda cuts: pieces(t, cuts))))


def chunk_sliding_window(text: Column | str, window: int = WINDOW_CHARS, overlap_ratio: float = 0.0) -> Column:
    """Windows cut at sentence ends; each repeats overlap_ratio of a window from the one before."""
    return not_blank(split_sentences(text, window, int(window * overlap_ratio)))


def chunk_by_paragraphs(text: Column | str, max_chars: int = MAX_CHARS) -> Column:
    return pack(paragraphs(col(text)), max_chars)


def pack_segments(text: Column | str, max_chars: int = MAX_CHARS) -> Column:
    text = col(text)
    return F.when(F.length(text) <= max_chars, F.array(text)).otherwise(pack(F.split(text, "\n\n"), max_chars, 2))


def pack_cleanup_segments(text: Column | str, whole: int = 6000, max_chars: int = 5000) -> Column:
    text = col(text)
    return F.when(F.length(text) < whole, F.array(text)).otherwise(pack(F.split(text, "\n\n"), max_chars))


def chunk_conversation_turns(text: Column | str, min_chars: int = MIN_CHARS) -> Column:
    """Pieces between turn marks, what stands before the first mark too; those under min_chars are left out."""
    pieces = split_before(col(text), TURN)
    return F.filter(F.transform(pieces, strip), lambda t: F.length(t) >= min_chars)


def auto_split_level(text: Column | str, heads: Column | None = None, target: int = TARGET_CHARS) -> Column:
    """Of levels 2 to 6 with two boundaries or more, the one whose mean chunk is nearest the target; the lower on ties; else 2."""
    text = col(text)

    def best(h):
        upto = lambda k: F.size(F.filter(h, lambda x: x["level"] <= k))
        n = [upto(k) for k in range(2, 7)]
        options = F.array(*[F.when(c >= 2, F.struct(F.abs(F.length(text) / c - target).alias("x"), F.lit(k).alias("level"))) for k, c in zip(range(2, 7), n, strict=True)])
        return F.coalesce(F.array_min(options)["level"], F.lit(2))

    return let(headings(text) if heads is None else heads, best)


def chunk_by_headings(text: Column, heads: Column, level: Column | int, min_chars: int = MIN_CHARS) -> Column:
    """Chunks (content, path) from each heading of the level or above to the next; a preamble of min_chars or more comes first."""
    level = F.lit(level) if isinstance(level, int) else level

    def cut(marks):
        next_starts = F.concat(F.transform(F.slice(marks, 2, F.size(marks)), lambda r: r["start"]), F.array(F.length(text)))
        body = F.transform(
            F.arrays_zip(marks.alias("m"), next_starts.alias("to")),
            lambda z: F.struct(strip(F.substr(text, z["m"]["start"] + 1, z["to"] - z["m"]["start"])).alias("content"), z["m"]["path"].alias("path")),
        )
        preamble = strip(F.substr(text, F.lit(1), F.try_element_at(marks, F.lit(1))["start"]))
        first = F.array(F.struct(preamble.alias("content"), F.array().cast(_STRINGS).alias("path")))
        return F.concat(F.filter(first, lambda c: F.length(c["content"]) >= min_chars), F.filter(body, lambda c: c["content"] != "")).cast(_CHUNK)

    def chosen(rows):
        near = F.filter(rows, lambda r: r["level"] <= level)
        return let(F.when(F.exists(rows, lambda r: r["level"] <= level), near).otherwise(rows), cut)

    def rows_of(h):
        rows = F.transform(F.arrays_zip(h.alias("h"), paths(h).alias("p")), lambda z: F.struct(z["h"]["level"].alias("level"), z["h"]["start_pos"].alias("start"), z["p"].alias("path")))
        return F.when(F.size(h) > 0, let(rows, chosen)).otherwise(F.array().cast(_CHUNK))

    return let(heads, rows_of)


def _plain(texts: Column) -> Column:
    return F.transform(texts, lambda t: F.struct(t.alias("content"), F.array().cast(_STRINGS).alias("path"))).cast(_CHUNK)


def merge_short(chunks: Column, min_chars: int = MIN_CHARS) -> Column:
    """Chunks under min_chars go to the end of the one before; the first one never does."""

    def merged(c, at):
        ends = F.concat(F.slice(at, 2, F.size(at)), F.array(F.size(c) + 1))
        return F.transform(
            F.arrays_zip(at.alias("a"), ends.alias("b")),
            lambda z: F.struct(
                F.array_join(F.transform(F.slice(c, z["a"], z["b"] - z["a"]), lambda x: x["content"]), "\n\n").alias("content"),
                F.element_at(c, z["a"])["path"].alias("path"),
            ),
        )

    def starts(c):
        return F.filter(F.transform(c, lambda x, i: F.when((i == 0) | (F.length(x["content"]) >= min_chars), i + 1)), lambda i: i.isNotNull())

    return let(chunks, lambda c: F.when(F.size(c) > 0, let(starts(c), lambda at: merged(c, at))).otherwise(c))


def chunk_strategy(docs: DataFrame, text: str = "markdown") -> DataFrame:
    """Adds strategy and total_chars."""
    t = F.col(text)
    return docs.withColumns(
        {
            "strategy": F.when(strip(t) == "", "empty")
            .when(count_matches(t, TURN) >= 3, "conversation_turn")
            .when(F.size(headings(t)) >= LEAST_HEADINGS, "heading_ast")
            .when(t.rlike(_BLANK), "paragraph")
            .otherwise("sliding_window"),
            "total_chars": F.when(strip(t) == "", 0).otherwise(F.length(t)),
        }
    )


def oversized_parts(content: Column, path: Column, max_chars: int = MAX_CHARS) -> Column:
    """Chunks (content, path) of one chunk: itself up to max_chars, else cut once at inner headings, else paragraphs, else sentences."""
    same = lambda texts: F.transform(texts, lambda t: F.struct(t.alias("content"), path.alias("path"))).cast(_CHUNK)
    inner = lambda h: F.transform(chunk_by_headings(content, h, 6), lambda x: F.struct(x["content"].alias("content"), F.concat(path, x["path"]).alias("path"))).cast(_CHUNK)
    flat = lambda ps: F.when(F.size(ps) >= 2, same(pack(ps, max_chars))).otherwise(same(split_sentences(content, max_chars)))
    cut = let(headings(content), lambda h: F.when(F.size(h) >= 2, inner(h)).otherwise(let(paragraphs(content), flat)))
    return F.when(F.length(content) <= max_chars, same(F.array(content))).otherwise(cut)


def split_oversized_chunks(chunks: DataFrame, max_chars: int = MAX_CHARS, content: str = "content") -> DataFrame:
    """Rows of chunks (content, heading_path) with those over max_chars cut once: at inner headings, else paragraphs, else sentences.

    Adds sub, the place within the row it comes from.
    """
    parts = oversized_parts(F.col(content), F.col("heading_path"), max_chars)
    rows = chunks.select(*[x for x in chunks.columns if x not in (content, "heading_path")], F.posexplode(parts).alias("sub", "_p"))
    return rows.select("*", F.col("_p.content").alias(content), F.col("_p.path").alias("heading_path")).drop("_p")


def chunk_markdown(docs: DataFrame, text: str = "markdown", doc_name: str = "doc_name", clean: bool = True, split_level: int = 0, max_chars: int = MAX_CHARS, min_chars: int = MIN_CHARS, overlap_ratio: float = 0.0) -> DataFrame:
    """A row for each chunk: the document's other columns, strategy, total_chars, chunk_index, content, context, heading_path, char_count.

    Strategies: dialogue turns (three marks or more, and a turn long enough), headings (five or more), paragraphs (a blank line),
    else windows cut at sentence ends. Short chunks are merged but for turns, and long ones cut once. Blank documents give
    no rows. A document's chunks are numbered within its row, so rows that repeat a document have numbers of their own.
    """
    if clean:
        docs = once(docs, "_t", clean_markdown(text)).drop(text).withColumnRenamed("_t", text).select(*docs.columns)
    rows = once(docs, "_h", headings(F.col(text)))
    t, heads = F.col(text), F.col("_h")
    is_turn = count_matches(t, TURN) >= 3
    rows = once(rows, "_turns", F.when(is_turn, chunk_conversation_turns(t, min_chars)).otherwise(F.array().cast(_STRINGS)))
    strategy = (
        F.when(F.size("_turns") > 0, "conversation_turn").when(F.size("_h") >= LEAST_HEADINGS, "heading_ast").when(t.rlike(_BLANK), "paragraph").otherwise("sliding_window")
    )
    rows = once(rows.where(strip(t) != ""), "strategy", strategy).withColumn("total_chars", F.length(t))
    level = F.lit(split_level) if split_level else auto_split_level(t, heads)
    first = (
        F.when(F.col("strategy") == "conversation_turn", _plain(F.col("_turns")))
        .when(F.col("strategy") == "heading_ast", chunk_by_headings(t, heads, level, min_chars))
        .when(F.col("strategy") == "paragraph", _plain(chunk_by_paragraphs(t, max_chars)))
        .otherwise(_plain(chunk_sliding_window(t, overlap_ratio=overlap_ratio)))
    )
    rows = once(rows, "_f", first)
    rows = once(rows, "_c", F.when(F.col("strategy") == "conversation_turn", F.col("_f")).otherwise(merge_short(F.col("_f"), min_chars)))
    keep = [c for c in docs.columns if c != text]
    pieces = F.flatten(F.transform("_c", lambda x: oversized_parts(x["content"], x["path"], max_chars)))
    out = rows.select(*keep, "strategy", "total_chars", F.posexplode(pieces).alias("chunk_index", "_x"))
    out = out.select(*keep, "strategy", "total_chars", "chunk_index", F.col("_x.content").alias("content"), F.col("_x.path").alias("heading_path"))
    out = out.withColumns({"context": build_context(F.col(doc_name), F.col("heading_path")), "char_count": F.length("content")})
    return out.select(*keep, "strategy", "total_chars", "chunk_index", "content", "context", "heading_path", "char_count")


def reindex_chunks(chunks: DataFrame, doc: list[str], order: list[str]) -> DataFrame:
    """Adds chunk_index: 0, 1, ... within each document."""
    from pyspark.sql import Window as W

    return chunks.withColumn("chunk_index", F.row_number().over(W.partitionBy(*doc).orderBy(*order)) - 1)


def merge_short_chunks(chunks: DataFrame, doc: str, index: str = "chunk_index", content: str = "content", min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc, index, content) with chunks under min_chars joined to the one before them."""
    from pyspark.sql import Window as W

    w = W.partitionBy(doc).orderBy(index)
    lead = (F.length(content) >= min_chars) | (F.row_number().over(w) == 1)
    grouped = chunks.withColumn("_lead", lead.cast("int")).withColumn("_g", F.sum("_lead").over(w))
    return grouped.groupBy(doc, "_g").agg(F.min(index).alias(index), ordered_join(content, [index], "\n\n").alias(content)).drop("_g")


def rechunk(files: DataFrame, doc_name: str = "doc_name", **sizes) -> DataFrame:
    """Kept chunks of the clean text, or of the raw text where there is none."""
    text = files.withColumn("markdown", F.coalesce("clean_text", "raw_text")).drop("clean_text", "raw_text")
    return filter_chunks(chunk_markdown(text, "markdown", doc_name, **sizes)).where("keep").drop("keep")
