"""Licence scan with DataFrame functions only: a positional index of rare licence words, aligned, then verified."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loreforge.llm.common import read_table, stored
from loreforge.llm.license_texts import COMMON_WORDS, PASSAGES

#: Phrases of the contract and their labels.
BASE_PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_MARGIN = 64  # words that are kept around the first and last licence word of a file
SLACK = 4  # words by which parts of a passage may be shifted against each other


def passage_words(text: str) -> list[str]:
    return [w for w in re.split(SEPARATORS, text.lower()) if w]


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case. Full lower-casing is faster, and differs in letters of words only by what isn't ASCII, but for two characters."""
    text = F.coalesce(text, F.lit(""))
    plain = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(F.contains(text, F.lit("K")) | F.contains(text, F.lit("İ")), plain).otherwise(F.lower(text))


def _starts(phrase: str) -> Column:
    """Places (in `ws`) at which the phrase's words stand one after another."""
    p = phrase.split()
    want = F.array(*map(F.lit, p))
    return F.filter("at", lambda i: (F.get("ws", i) == p[0]) & (F.slice("ws", i + 1, len(p)) == want))


def licence_words(docs: DataFrame, vocabulary: list[str]) -> DataFrame:
    """One pass over the texts: row (a number), doc_id, the base columns, hits (pos, word) and around.

    hits are the places of vocabulary words; around holds the words from the first to the last of them and _MARGIN more
    on both sides, for files with two different ones at least.
    """
    index_words = [w for w in vocabulary if w not in COMMON_WORDS]
    looked_up = sorted({*index_words, *(p.split()[0] for p, _ in BASE_PHRASES)})
    rows = docs.select("doc_id", F.split(lower_ascii(F.col("text")), SEPARATORS).alias("ws"))
    # separators at the ends leave an empty word there
    lead = (F.get("ws", F.lit(0)) == "").cast("int")
    tail = ((F.size("ws") > 1) & (F.get("ws", F.size("ws") - 1) == "")).cast("int")
    rows = rows.select("doc_id", "ws", lead.alias("lead"), tail.alias("tail"), F.array_compact(F.transform("ws", lambda w, i: F.when(w.isin(looked_up), i))).alias("at"))
    rows = rows.select("*", *[_starts(p).alias(f"b{k}") for k, (p, _) in enumerate(BASE_PHRASES)])
    every = F.concat(*[F.col(f"b{k}") for k in range(len(BASE_PHRASES))])
    hits = F.transform("at", lambda i: F.struct((i - F.col("lead")).alias("pos"), F.get("ws", i).alias("word")))
    rows = rows.select(
        "*", every.alias("every"), F.filter(hits, lambda h: h["word"].isin(index_words)).alias("hits"),
    )
    first = F.greatest(F.lit(0), F.array_min(F.col("hits.pos")) + F.col("lead") - _MARGIN)
    last = F.array_max(F.col("hits.pos")) + F.col("lead") + _MARGIN
    around = F.concat(F.lit(" "), F.array_join(F.slice("ws", first + 1, last - first + 1), " "), F.lit(" "))
    labels = F.array(*[F.when(F.size(f"b{k}") > 0, label) for k, (_, label) in enumerate(BASE_PHRASES)])
    return rows.select(
        F.monotonically_increasing_id().alias("row"), "doc_id",
        (F.size("ws") - F.col("lead") - F.col("tail")).cast("long").alias("n_words"),
        F.size("every").cast("long").alias("n_base"),
        (F.array_min("every") - F.col("lead")).cast("long").alias("first_word"),
        (F.array_max("every") - F.col("lead")).cast("long").alias("last_word"),
        F.array_sort(F.array_compact(labels)).alias("base"),
        "hits",
        F.when(F.size(F.array_distinct("hits.word")) > 1, around).alias("around"),
    )


def _postings(passages, counts: dict[str, int], n_docs: int, words_each: int) -> list[tuple]:
    """(word, passage number, place in it, share of the passage's weight) of each passage's words of highest IDF."""
    out = []
    for t, (_, text, _) in enumerate(passages):
        ws = passage_words(text)
        idf = {w: math.log((n_docs + 1) / (counts.get(w, 0) + 0.5)) for w in ws if w not in COMMON_WORDS}
        rare = set(sorted(idf, key=lambda w: (-idf[w], w))[:words_each])
        weight = sum(idf[w] for w in ws if w in rare)
        out += [(w, t, i, idf[w] / weight) for i, w in enumerate(ws) if w in rare]
    return out


def _fixed(spark, rows: list[Column]) -> DataFrame:
    """A table of as many rows as there are passages, or a few for each."""
    return spark.range(1).select(F.inline(F.array(*rows)))


def scan_licenses(docs: DataFrame, passages=PASSAGES, words_each: int = 8, min_share: float = 0.8) -> DataFrame:
    """Licences of each document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Inverse document frequencies of the passages' words come from all documents. A passage is represented by its
    words_each words of highest IDF and their places. All such words that a file has are looked up; postings of a passage
    whose places in file and passage differ alike, up to SLACK words, are summed by weight, each once. Where they hold
    min_share of the passage's weight and its mandatory phrases stand in the file, the passage's label is given. score: 1
    with a base phrase, else the best share of a label found, else 0. Null and empty texts have no words; their labels are
    ''. Repeated rows are rows of their own, an empty table gives none; other columns are left out.
    """
    spark = docs.sparkSession
    vocabulary = sorted({w for _, text, _ in passages for w in passage_words(text)})
    rows = stored(licence_words(docs.select("doc_id", "text"), vocabulary), "licence-words")

    # counts of a fixed vocabulary: a few hundred rows
    n_docs = rows.count()
    counted = rows.select(F.explode(F.array_distinct("hits.word")).alias("word")).groupBy("word").count().collect()
    postings = _postings(passages, {r["word"]: r["count"] for r in counted}, n_docs, words_each)
    lit = F.lit
    index = _fixed(spark, [F.struct(lit(w).alias("word"), lit(t).alias("t"), lit(i).alias("tpos"), lit(x).alias("share")) for w, t, i, x in postings])
    checks = _fixed(spark, [F.struct(lit(t).alias("t"), lit(label).alias("label"), F.array(*[lit(f" {p} ") for p in phrases]).alias("phrases")) for t, (label, _, phrases) in enumerate(passages)])

    found = rows.where("around is not null").select("row", F.explode("hits").alias("h")).select("row", "h.pos", "h.word")
    found = found.join(F.broadcast(index), "word").withColumn("shift", F.col("pos") - F.col("tpos"))
    # shifts that differ by up to SLACK fall into one cell of the one or the other grid
    cells = F.array(*[F.struct(lit(g).alias("grid"), F.floor((F.col("shift") + g * SLACK) / (2 * SLACK)).alias("cell")) for g in (0, 1)])
    found = found.select("row", "t", "tpos", "share", F.explode(cells).alias("c")).select("row", "t", "c.grid", "c.cell", "tpos", "share").distinct()
    aligned = found.groupBy("row", "t", "grid", "cell").agg(F.sum("share").alias("share")).where(F.col("share") >= min_share - 1e-9)
    aligned = aligned.groupBy("row", "t").agg(F.max("share").alias("share")).join(F.broadcast(checks), "t")
    texts = rows.where("around is not null").select("row", "around")
    proven = aligned.join(texts.hint("merge"), "row").where(F.forall("phrases", lambda p: F.contains(F.col("around"), p)))
    proven = proven.groupBy("row").agg(F.collect_set("label").alias("found"), F.max("share").alias("share"))

    out = rows.drop("hits", "around").join(proven.hint("merge"), "row", "left")
    both = F.array_sort(F.array_union("base", F.coalesce("found", F.array().cast("array<string>"))))
    score = F.when(F.size("base") > 0, 1.0).otherwise(F.least(F.lit(1.0), F.round(F.coalesce("share", F.lit(0.0)), 6)))
    return out.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join("base", ",").alias("base_labels"), F.array_join(both, ",").alias("labels"), score.alias("score"),
    )


def op7_license_scan(spark, sf_dir) -> DataFrame:
    return scan_licenses(read_table(spark, sf_dir, "documents"))
