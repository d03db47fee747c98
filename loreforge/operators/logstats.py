"""Statistics of model calls and of pipeline runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loreforge.functions.tables import join_one, stored

#: Price of a million input and output tokens.
INPUT_PRICE, OUTPUT_PRICE = 2, 8


def cost(tokens_in: Column, tokens_out: Column) -> Column:
    return tokens_in * INPUT_PRICE / 1_000_000 + tokens_out * OUTPUT_PRICE / 1_000_000


def _sums(calls: DataFrame, key: str, failed: Column) -> DataFrame:
    return calls.groupBy(key).agg(
        F.count("*").alias("calls"),
        *[F.sum(c).alias(c) for c in ("input_tokens", "output_tokens", "think_tokens")],
        F.avg("latency_ms").alias("avg_latency_ms"),
        F.count_if(F.col("validation_result") == "pass").alias("pass_count"),
        F.count_if(failed).alias("fail_count"),
        F.count_if(F.col("validation_result") == "pending").alias("pending_count"),
    ).withColumns(
        {
            "pass_rate": F.when(F.col("pass_count") + F.col("fail_count") > 0, F.col("pass_count") / (F.col("pass_count") + F.col("fail_count"))).otherwise(0.0),
            "cost": cost(F.col("input_tokens"), F.col("output_tokens")),
        }
    )


def log_stats_by_phase(calls: DataFrame) -> DataFrame:
    """Counts, tokens, mean latency, p50, p95, results and cost of each phase; results that start with fail are failures."""
    return _sums(calls, "phase", F.col("validation_result").startswith("fail")).join(latency_percentiles(calls, "phase"), "phase")


def log_stats_by_version(calls: DataFrame) -> DataFrame:
    return _sums(calls, "prompt_version", F.col("validation_result").startswith("fail")).drop("pending_count")


#: Places of the percentiles among n sorted values, from 0.
PLACES = {"p50": lambda n: F.floor(n / 2), "p95": lambda n: F.least(F.floor(n * 0.95), n - 1)}


def latency_percentiles(calls: DataFrame, key: str = "phase", value: str = "latency_ms", ranges: int = 1024) -> DataFrame:
    """(key, p50, p95): the values at places n // 2 and min(int(0.95 n), n - 1) of the sorted ones; null values don't count.

    By selection: the span from the least to the greatest value is cut into ranges, whose rows are counted, and only the range
    that holds the place is opened in the next round, until it holds one value. A key's rows in a shuffle are its ranges, so no task
    holds its rows or different values. Rounds go with the logarithm of the span: two or three for latencies.
    """
    name = F.coalesce(F.concat(F.lit("="), F.col(key).cast("string")), F.lit("-"))  # a key that isn't null
    rows = stored(calls.select(name.alias("k"), F.col(key).alias("shown"), F.col(value).alias("v")), "latencies")
    spans = rows.groupBy("k").agg(F.min("shown").alias("shown"), F.count("v").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    q = F.array(*[F.struct(F.lit(i).alias("which"), place(F.col("n")).cast("long").alias("place"), "lo", "hi") for i, place in enumerate(PLACES.values())])
    state = stored(spans.select("k", "shown", "n", q.alias("q")), "percentiles")
    rows, span = rows.where("v is not null").select("k", "v"), F.col("q.hi") - F.col("q.lo")
    while state.where(F.exists("q", lambda x: x["lo"] < x["hi"])).limit(1).count():
        asked = join_one(rows, state.select("k", "n", "q"), "k", "n")
        inside = asked.select("k", "v", F.explode(F.filter("q", lambda x: (x["lo"] < x["hi"]) & F.col("v").between(x["lo"], x["hi"]))).alias("q"))
        r = F.least(F.floor((F.col("v") - F.col("q.lo")).cast("double") * ranges / span.cast("double")), F.lit(ranges - 1))
        counted = inside.groupBy("k", "q.which", r.alias("r")).agg(F.first("q.place").alias("place"), F.count("*").alias("c"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        upto = counted.withColumn("end", F.sum("c").over(W.partitionBy("k", "which").orderBy("r")))
        opened = upto.where((F.col("end") - F.col("c") <= F.col("place")) & (F.col("place") < F.col("end")))
        opened = opened.groupBy("k").agg(F.collect_list(F.struct("which", (F.col("place") - F.col("end") + F.col("c")).alias("place"), "lo", "hi")).alias("new"))
        merged = state.join(opened.hint("merge"), "k", "left")
        rest = F.filter("q", lambda x: ~F.exists(F.coalesce("new", F.array()), lambda y: y["which"] == x["which"]))
        state = stored(merged.select("k", "shown", "n", F.array_sort(F.concat(rest, F.coalesce("new", F.array()))).alias("q")), "percentiles")
    return state.select(F.col("shown").alias(key), *[F.col("q")[i]["lo"].alias(p) for i, p in enumerate(PLACES)])


def log_totals(calls: DataFrame) -> DataFrame:
    sums = calls.agg(F.count("*").alias("calls"), F.sum("input_tokens").alias("i"), F.sum("output_tokens").alias("o"))
    return sums.select("calls", (F.col("i") + F.col("o")).alias("tokens"), cost(F.col("i"), F.col("o")).alias("cost"))


def log_report(by_phase: DataFrame, by_version: DataFrame | None = None, totals: DataFrame | None = None) -> DataFrame:
    """Markdown lines (section, key, line): totals, then a line for each phase and for each prompt version, by key."""
    n = lambda c: F.format_number(c, 0)
    line = lambda *cells: F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line")
    mean, rate = F.concat(F.format_string("%.0f", "avg_latency_ms"), F.lit("ms")), F.concat(F.format_string("%.0f", F.col("pass_rate") * 100), F.lit("%"))
    price = F.concat(F.lit("¥"), F.format_string("%.3f", "cost"))
    calls = F.col("calls").cast("string")
    out = by_phase.select(F.lit("2 phase").alias("section"), F.col("phase").alias("key"), line(F.col("phase"), calls, n("input_tokens"), n("output_tokens"), n("think_tokens"), mean, F.concat(F.col("p95").cast("string"), F.lit("ms")), rate, price))
    if by_version is not None:
        out = out.unionByName(by_version.select(F.lit("3 version").alias("section"), F.col("prompt_version").alias("key"), line(F.col("prompt_version"), calls, mean, rate, price)))
    if totals is not None:
        texts = F.array(
            F.struct(F.lit("calls").alias("key"), F.concat(F.lit("总调用数："), calls).alias("line")),
            F.struct(F.lit("tokens").alias("key"), F.concat(F.lit("总 Token 消耗："), n("tokens")).alias("line")),
            F.struct(F.lit("cost").alias("key"), F.concat(F.lit("预估成本：¥"), F.format_string("%.2f", "cost")).alias("line")),
        )
        out = out.unionByName(totals.select(F.lit("1 total").alias("section"), F.inline(texts)))
    return out.orderBy("section", "key")


def batch_report(runs: DataFrame) -> DataFrame:
    """Lines (section, name, line): counts of documents, successes, failures and skills; a line for each document that succeeded and for each that failed.

    Errors are cut to 80 characters.
    """
    sums = runs.agg(F.count("*").alias("d"), F.count_if("ok").alias("s"), F.count_if(~F.col("ok")).alias("f"), F.coalesce(F.sum(F.when(F.col("ok"), F.col("n_skills"))), F.lit(0)).alias("k"))
    texts = F.array(
        F.struct(F.lit("documents").alias("name"), F.concat(F.lit("文档总数："), F.col("d").cast("string")).alias("line")),
        F.struct(F.lit("results").alias("name"), F.concat(F.lit("成功："), F.col("s").cast("string"), F.lit("，失败："), F.col("f").cast("string")).alias("line")),
        F.struct(F.lit("skills").alias("name"), F.concat(F.lit("生成 Skill 总数："), F.col("k").cast("string")).alias("line")),
    )
    line = lambda *cells: F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line")
    done = runs.where("ok").select(F.lit("2 done").alias("section"), F.col("doc_name").alias("name"), line("doc_name", "format", F.col("n_chunks").cast("string"), F.col("n_skills").cast("string"), F.format_string("%.1fs", "elapsed")))
    failed = runs.where(~F.col("ok")).select(F.lit("3 failed").alias("section"), F.col("doc_name").alias("name"), line("doc_name", F.left(F.coalesce("error", F.lit("")), F.lit(80))))
    return sums.select(F.lit("1 summary").alias("section"), F.inline(texts)).unionByName(done).unionByName(failed)


TYPES = ("factual", "procedural", "relational")


def pipeline_counters(doc: str, typed: DataFrame | None = None, **stages: DataFrame) -> DataFrame:
    """(doc, one count for each stage table, one for each type of the skills in typed): rows of each document, 0 where it has none."""
    out = None
    counts = {name: df.groupBy(doc).agg(F.count("*").alias(name)) for name, df in stages.items()}
    names = list(stages)
    if typed is not None:
        counts["typed"] = typed.groupBy(doc).agg(*[F.count_if(F.col("sku_type") == t).alias(t) for t in TYPES])
        names += TYPES
    for n in counts.values():
        out = n if out is None else out.join(n.hint("merge"), doc, "full")
    return out.select(doc, *[F.coalesce(c, F.lit(0)).alias(c) for c in names])
