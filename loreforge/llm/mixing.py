"""Mixing sources to target weights: capped water-filling, then seeded whole and fractional repetitions.

DataFrame functions only: no Python workers take part.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loreforge.llm.common import attach, free_name, numbered, read_table, stored, sums_before

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Between the end of a word and the white space after it.
WORD_END = r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])"
#: Weights of the sources in code-point order, repeating; epochs that a source gives at most.
WEIGHTS, EPOCHS = (5, 2, 1), 3


def water_level(sources: DataFrame, total: int) -> tuple[int, int]:
    """(num, den): a source of weight w gets min(cap, w * num / den), which together is the total (or all caps, if they are less).

    `sources` has whole numbers `cap` and `weight`. Each round clamps the sources whose share is above their cap and
    deals what is left by weight among the others, until none is above. A round is one aggregation; the driver gets four
    numbers. Whole numbers throughout, so reruns and other engines agree to the last digit.
    """
    wide = "decimal(38,0)"
    weights = int(sources.agg(F.coalesce(F.sum("weight"), F.lit(0))).collect()[0][0])
    num, den, clamped = total, weights, 0
    while den:
        above = F.col("cap").cast("decimal(20,0)") * F.lit(den).cast("decimal(17,0)") < F.col("weight").cast("decimal(17,0)") * F.lit(num).cast("decimal(20,0)")
        r = sources.agg(F.count_if(above).alias("n"), F.sum(F.when(above, F.col("cap").cast(wide))).alias("cap"), F.sum(F.when(above, F.col("weight").cast(wide))).alias("weight")).collect()[0]
        if r["n"] == clamped:
            break
        num, den, clamped = total - int(r["cap"]), weights - int(r["weight"]), r["n"]
    return num, den


def source_targets(rows: DataFrame, key: str, size: str, weights: Sequence[int] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """(key, source_size, target, whole, rest): words that a source has and is to give; times that all of it is taken, and words beyond.

    The sources share the sum of all sizes by weight, which goes by their place in the order of `key`.
    """
    sources = stored(rows.groupBy(key).agg(F.sum(size).cast("long").alias("source_size")), "mix-sources")
    sources = numbered(sources, [], [key], "place")
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    sources = stored(sources.select(key, "source_size", weight.cast("long").alias("weight"), (F.col("source_size") * epochs).alias("cap")), "mix-weights")
    total = int(sources.agg(F.coalesce(F.sum("source_size"), F.lit(0))).collect()[0][0])
    num, den = water_level(sources, total)
    share = (F.col("weight").cast("decimal(17,0)") * F.lit(num).cast("decimal(20,0)")).cast("double") / F.lit(float(den or 1))
    target = F.least(F.col("cap").cast("double"), share) if den else F.col("cap").cast("double")
    whole = F.when(F.col("source_size") > 0, F.floor(target / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    out = sources.select(key, "source_size", target.alias("target"), whole.alias("whole"))
    return out.withColumn("rest", (F.floor(F.col("target") + 0.5) - F.col("whole") * F.col("source_size")).cast("long"))


def mix_sources(docs: DataFrame, weights: Sequence[int] = WEIGHTS, epochs: int = EPOCHS, seed: str = "mix", carry: Sequence[str] = ()) -> DataFrame:
    """doc_id, size, source_size, target, whole, extra, taken for each document.

    Each document is taken `whole` times, as its source's target tells. What a source is still to give goes to its documents in
    the order of their seeded hash: each gives its words once more, the last of them only its first `extra` ones. So a
    source gives its target to half a word, and no document more than `epochs` times its size. Documents of equal
    doc_id are ordered by size. A null text is of size 0, a null source is the last source, an empty table gives no rows.
    Other columns than those in `carry` are left out.
    """
    place = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 16)
    # "0" stands before all sources and "1" for none, so that the key is never null and none comes last
    key = F.coalesce(F.concat(F.lit("0"), F.col("source").cast("string")), F.lit("1"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), key.alias("mix_key"), place.alias("mix_place"), *carry)
    rows = stored(rows, "mix-rows")
    targets = source_targets(rows, "mix_key", "size", weights, epochs)
    rows = sums_before(rows, ["mix_key"], ["mix_place", "doc_id", "size"], "size", "mix_before")
    rows = attach(rows, targets, "mix_key")
    extra = F.least(F.col("size"), F.greatest(F.lit(0), F.col("rest") - F.col("mix_before"))).cast("long")
    out = rows.withColumn("extra", extra)
    return out.select("doc_id", "size", "source_size", "target", "whole", "extra", (F.col("whole") * F.col("size") + F.col("extra")).alias("taken"), *carry)


def mixture(docs: DataFrame, weights: Sequence[int] = WEIGHTS, epochs: int = EPOCHS, seed: str = "mix") -> DataFrame:
    """The mix itself: the documents' columns and `repetition`, a row for each time that a document is taken.

    The last repetition of a document of which only a part is taken ends after its first `extra` words.
    """
    row, whole, extra, size, rep = (free_name(n, docs.columns) for n in ("row", "whole", "extra", "size", "repetition"))
    docs_rows = stored(docs.withColumn(row, F.monotonically_increasing_id()), "mix-documents")
    mix = mix_sources(docs_rows, weights, epochs, seed, carry=[row]).select(F.col(row), F.col("whole").alias(whole), F.col("extra").alias(extra), F.col("size").alias(size))
    both = docs_rows.join(mix.hint("merge"), row)
    times = F.col(whole) + (F.col(extra) > 0).cast("long")
    # F.sequence of 0 to -1 would run backwards
    out = both.where(times > 0).withColumn(rep, F.explode(F.sequence(F.lit(0).cast("long"), times - 1)))
    cut = (F.col(rep) == F.col(whole)) & (F.col(extra) < F.col(size))
    text = F.when(cut, F.array_join(F.slice(F.split("text", WORD_END), F.lit(1), F.col(extra).cast("int")), "")).otherwise(F.col("text"))
    return out.withColumn("text", text).select(*docs.columns, F.col(rep).alias(rep))


def op12_mixing(spark, sf_dir) -> DataFrame:
    return mix_sources(read_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "whole", "extra")


OP12_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    substr(sha256('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 16) AS place FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS k FROM d GROUP BY source),
w AS (SELECT *, CASE k % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, 3 * source_size AS cap FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY cap / weight, k) AS i FROM w),
f AS (SELECT *, sum(source_size) OVER () - sum(cap) OVER (ORDER BY i) + cap AS num, sum(weight) OVER () - sum(weight) OVER (ORDER BY i) + weight AS den FROM o),
lv AS (SELECT min(i) AS i FROM f WHERE cap * den >= weight * num),
level AS (SELECT f.i, f.num, f.den FROM f JOIN lv ON f.i = lv.i),
t AS (SELECT o.source, o.source_size, CASE WHEN o.i < level.i THEN CAST(cap AS DOUBLE) ELSE least(CAST(cap AS DOUBLE), CAST(weight * num AS DOUBLE) / CAST(den AS DOUBLE)) END AS target FROM o, level),
g AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM t),
r AS (SELECT d.doc_id, d.size, g.source_size, g.target, g.whole, (floor(g.target + 0.5)::BIGINT - g.whole * g.source_size) AS rest,
    coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY place, doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target, whole, least(size, greatest(0, rest - before))::BIGINT AS extra,
  (whole * size + least(size, greatest(0, rest - before)))::BIGINT AS taken FROM r"""
