"""Ingest, run state, sampling and incremental work on chunk tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loreforge.functions.text import ordered_join
from loreforge.operators.similarity import stored
from loreforge.operators.text_search import FIELD, GRAM, find_texts


# ---------------------------------------------------------------- ingest


def hash_dedup_ingest(arrivals: DataFrame, registry: DataFrame | None = None, content: str = "content", order: str = "arrival") -> DataFrame:
    """Adds hash and status: `saved` for the first arrival of a content that isn't registered (hash), else `skipped`."""
    rows = arrivals.withColumn("hash", F.sha2(content, 256))
    first = rows.groupBy("hash").agg(F.min(order).alias("_first"))
    if registry is not None:
        first = first.join(registry.select("hash"), "hash", "left_anti")
    rows = rows.join(first, "hash", "left")
    return rows.withColumn("status", F.when(F.col(order) == F.col("_first"), "saved").otherwise("skipped")).drop("_first")


def unregister_file(registry: DataFrame, filename: str) -> DataFrame:
    return registry.where(F.col("filename") != filename)


def cascade_delete_file(tables: dict[str, DataFrame], gone: DataFrame, key: tuple[str, ...] = ("workflow_id", "filename")) -> dict[str, DataFrame]:
    """Each table without the rows of the files in gone."""
    return {name: df.join(gone.select(*key), list(key), "left_anti") for name, df in tables.items()}


def merge_processed_texts(files: DataFrame, order: str = "ord") -> DataFrame:
    """(workflow_id, doc_name, text): finished files joined in order; the first one names the document."""
    done = files.where("status = 'done'")
    return done.groupBy("workflow_id").agg(F.min_by("doc_name", order).alias("doc_name"), ordered_join("text", [order], "\n\n---\n\n").alias("text"))


def file_progress_latest(events: DataFrame, fields: list[str], key: str = "filename", ts: str = "updated_at") -> DataFrame:
    """For each file the last value of each field that isn't null, and the latest time."""
    return events.groupBy(key).agg(*[F.max_by(f, F.when(F.col(f).isNotNull(), F.col(ts))).alias(f) for f in fields], F.max(ts).alias(ts))


def all_files_done(progress: DataFrame) -> DataFrame:
    return progress.groupBy("workflow_id").agg(F.bool_and(F.col("status").isin("done", "error")).alias("all_done"))


def upload_listing(files: DataFrame, progress: DataFrame, texts: DataFrame) -> DataFrame:
    """Files by name with status (default pending), message, and characters of the text where there is one."""
    out = files.join(progress, "filename", "left").join(texts.select("filename", "text"), "filename", "left")
    return out.select("filename", "size", F.coalesce("status", F.lit("pending")).alias("status"), F.coalesce("message", F.lit("")).alias("message"),
                      F.coalesce(F.length("text"), F.lit(0)).alias("chars"), F.col("text").isNotNull().alias("has_text")).orderBy("filename")


def meta_upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    """Workflow metadata: new names, documents, formats and paths win where they aren't empty; creation time stays; counts are the new ones."""
    o, n = old.alias("o"), new.alias("n")
    rows = o.join(n, F.col("o.workflow_id") == F.col("n.workflow_id"), "full")
    pick = lambda c: F.coalesce(F.nullif(F.col(f"n.{c}"), F.lit("")), F.col(f"o.{c}")).alias(c)
    return rows.select(
        F.coalesce("n.workflow_id", "o.workflow_id").alias("workflow_id"), *[pick(c) for c in ("name", "doc_name", "format", "path")],
        F.coalesce("o.created_at", "n.created_at").alias("created_at"), F.coalesce("n.chunk_count", "o.chunk_count").alias("chunk_count"),
    )


# ---------------------------------------------------------------- sampling and search


def place(df: DataFrame, order: list[str], out: str = "_k") -> DataFrame:
    """Adds the row's place in the order, from 0, by ranges: each partition is numbered on its own and moved by the rows before it."""
    dealt = stored(df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()), "places")
    before = dealt.groupBy("_p").agg(F.count("*").alias("n"))
    before = before.select("_p", F.coalesce(F.sum("n").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_b"))
    inside = F.row_number().over(W.partitionBy("_p").orderBy(*order)) - 1
    rows = dealt.withColumn(out, inside).join(F.broadcast(before), "_p")  # a row for each partition
    return rows.withColumn(out, F.col(out) + F.col("_b")).drop("_p", "_b")


def uniform_sample(df: DataFrame, n: int, order: list[str]) -> DataFrame:
    """All rows where there are n or fewer, else those at int(i * total / n) for i under n."""
    rows = place(df, order)
    total = df.count()
    if total <= n:
        return df
    # the k-th row is taken if some i has floor(i * total / n) = k
    i = F.ceil(F.col("_k") * n / F.lit(total))
    return rows.where((i < n) & (F.floor(i * F.lit(total) / n) == F.col("_k"))).drop("_k")


def random_sample(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """n rows without replacement, by a seeded hash of the key."""
    return df.orderBy(F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}"))), key).limit(n)


def stride_recommend(df: DataFrame, order: list[str], n: int = 5) -> DataFrame:
    """Every max(total // n, 1)-th row, the first n of them."""
    step = max(df.count() // n, 1)
    return place(df, order).where((F.col("_k") % step == 0) & (F.col("_k") < step * n)).drop("_k")


def searchable(content: str = "content", headings: str = "heading_path") -> Column:
    """What search_chunks() looks into, as one text for build_text_index()."""
    return F.concat(F.coalesce(content, F.lit("")), F.lit(FIELD), F.coalesce(F.array_join(headings, " > "), F.lit("")))


def search_chunks(chunks: DataFrame, query: str, page: int = 1, size: int = 20, order: list[str] | None = None, index: DataFrame | None = None) -> DataFrame:
    """A page of the chunks whose content or heading path holds the query, with a preview and the total of matches.

    With an index of searchable() whose keys are `order` only the chunks that match are read; shorter queries than a gram scan.
    """
    order = order or ["doc_id", "chunk_index"]
    row = [*order, F.substring("content", 1, 100).alias("preview"), "char_count"]
    if index is not None and len(query) >= GRAM:  # no text is sent on, as only their beginnings are shown
        found = chunks.select(*row).join(find_texts(index, order, query).hint("shuffle_hash"), order, "left_semi")
    else:
        found = chunks.where(F.contains("content", F.lit(query)) | F.contains(F.array_join("heading_path", " > "), F.lit(query))).select(*row)
    total = found.agg(F.count("*").alias("total"))
    rows = found.orderBy(*order).offset((page - 1) * size).limit(size)
    return rows.crossJoin(F.broadcast(total)).select(*order, "preview", "char_count", "total")  # total is one row


# ---------------------------------------------------------------- run state


def pending_chunks(chunks: DataFrame, done: DataFrame, key: list[str]) -> DataFrame:
    return chunks.join(done.select(*key), key, "left_anti")


def mark_chunks_done(done: DataFrame, more: DataFrame, key: list[str]) -> DataFrame:
    return done.select(*key).unionByName(more.select(*key)).distinct()


def execution_batches(pending: DataFrame, order: list[str], size: int = 5, workflow: str = "workflow_id") -> DataFrame:
    """Adds batch_no: groups of `size` in order within a workflow."""
    return pending.withColumn("batch_no", F.floor((F.row_number().over(W.partitionBy(workflow).orderBy(*order)) - 1) / size))


def run_progress(batches: DataFrame, totals: DataFrame, workflow: str = "workflow_id") -> DataFrame:
    """(completed, total, raw, passed, elapsed, remaining) of each workflow; remaining from the mean time of a chunk in this run."""
    sums = batches.groupBy(workflow).agg(*[F.sum(c).alias(c) for c in ("completed", "raw", "passed", "elapsed")])
    left = F.col("total") - F.col("completed")
    return sums.join(totals, workflow).withColumn("remaining", left / F.greatest(F.col("completed"), F.lit(1)) * F.col("elapsed"))


def workflow_listing(meta: DataFrame, skills: DataFrame, status: DataFrame) -> DataFrame:
    """Workflows by creation time, latest first, with skill counts and status; rows without metadata fall out."""
    n = skills.groupBy("workflow_id").agg(F.count("*").alias("skill_count"))
    out = meta.join(n, "workflow_id", "left").join(status, "workflow_id", "left")
    return out.withColumn("skill_count", F.coalesce("skill_count", F.lit(0))).orderBy(F.desc("created_at"), "workflow_id")


def workflow_state(chunks: DataFrame, done: DataFrame, skills: DataFrame, previews: int = 10) -> DataFrame:
    """(workflow_id, total, done, pending, skill_count, first skill names) of each workflow."""
    t = chunks.groupBy("workflow_id").agg(F.count("*").alias("total"))
    d = done.groupBy("workflow_id").agg(F.count("*").alias("done"))
    w = W.partitionBy("workflow_id").orderBy("idx")
    first = skills.withColumn("k", F.row_number().over(w)).where(F.col("k") <= previews).groupBy("workflow_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "name"))), lambda x: x["name"]).alias("previews"))
    n = skills.groupBy("workflow_id").agg(F.count("*").alias("skill_count"))
    out = t.join(d, "workflow_id", "left").join(n, "workflow_id", "left").join(first, "workflow_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return out.select("workflow_id", "total", zero("done").alias("done"), (F.col("total") - zero("done")).alias("pending"), zero("skill_count").alias("skill_count"), "previews")


def tune_history(changes: DataFrame, workflow: str = "workflow_id", ts: str = "ts") -> DataFrame:
    """Adds version: 1, 2, ... of each workflow by time."""
    return changes.withColumn("version", F.row_number().over(W.partitionBy(workflow).orderBy(*([ts] if isinstance(ts, str) else ts))))


def active_hint(workflows: DataFrame, history: DataFrame, workflow: str = "workflow_id") -> DataFrame:
    last = history.groupBy(workflow).agg(F.max_by("hint", "version").alias("hint"))
    return workflows.select(workflow).join(last, workflow, "left").withColumn("hint", F.coalesce("hint", F.lit("")))


def sample_check_report(sample: DataFrame, results: DataFrame, key: list[str]) -> DataFrame:
    """For each sampled chunk its skills (name, trigger, status), how many passed and failed, and their pass rate in % to one decimal.

    The total is a row of nulls with no skills.
    """
    ok = F.col("status") == "pass"
    n = sample.select(*key).join(results.hint("merge"), key, "left").withColumns({"p": F.coalesce(ok.cast("int"), F.lit(0)), "r": F.col("status").isNotNull().cast("int")})
    out = n.rollup(*key).agg(F.sum("p").alias("passed"), (F.sum("r") - F.sum("p")).alias("failed"), F.grouping_id().alias("g"))
    out = out.where(F.col("g").isin(0, 2 ** len(key) - 1)).drop("g")
    shown = results.join(sample.select(*key).hint("merge"), key, "left_semi").groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("name", "trigger", "status"))).alias("skills"))
    out = out.join(shown.hint("merge"), key, "left")
    return out.withColumn("pass_rate", F.when(F.col("passed") + F.col("failed") > 0, F.round(100 * F.col("passed") / (F.col("passed") + F.col("failed")), 1)).otherwise(0.0))


# ---------------------------------------------------------------- cell grids

#: Header keywords in order, and the field each names.
HEADER_KEYWORDS = (
    ("保障责任", "name"), ("责任名称", "name"), ("保障项目", "name"), ("项目", "name"),
    ("保险金额", "limit"), ("保额", "limit"), ("限额", "limit"), ("年限额", "limit"),
    ("免赔额", "deductible"), ("免赔", "deductible"), ("赔付比例", "ratio"), ("给付比例", "ratio"), ("报销比例", "ratio"),
    ("等待期", "waiting_period"), ("保障范围", "scope"), ("说明", "note"), ("备注", "note"),
)
FIELDS = ("name", "limit", "deductible", "ratio", "waiting_period", "scope", "note")
PRODUCT_WORDS = ("保险", "产品")


def grid_rows(cells: DataFrame, sheet: list[str]) -> DataFrame:
    """Cells (sheet, row_no, col_no, value) trimmed, rows without any value dropped, rows numbered anew from 0; one shuffle by sheet."""
    value = F.coalesce("value", F.lit(""))
    value = F.when(value.rlike(r"(?U)\A\s|\s\z"), F.regexp_replace(value, r"(?U)\A\s+|\s+\z", "")).otherwise(value)
    known = cells.dropna(subset=[*sheet, "row_no"]).withColumn("value", value)
    # the last row with a value up to this one, all cells of this one included, is this one; so both windows go by sheet
    filled = F.max(F.when(F.col("value") != "", F.col("row_no"))).over(W.partitionBy(*sheet).orderBy("row_no"))
    rows = known.withColumn("_filled", filled == F.col("row_no")).where("_filled").drop("_filled")
    return rows.withColumn("row_no", F.dense_rank().over(W.partitionBy(*sheet).orderBy("row_no")) - 1)


def header_field(value: Column, keywords=HEADER_KEYWORDS) -> Column:
    out = None
    for word, field in keywords:
        hit = F.contains(value, F.lit(word))
        out = F.when(hit, field) if out is None else out.when(hit, field)
    return out


def detect_header_row(rows: DataFrame, sheet: list[str], keywords=HEADER_KEYWORDS, first: int = 10) -> DataFrame:
    """(sheet, header_row, col_no, field): the first of the leading rows that maps a name, and its mapped cells."""
    mapped = rows.where(F.col("row_no") < first).withColumn("field", header_field(F.col("value"), keywords)).where("field is not null")
    head = F.min(F.when(F.col("field") == "name", F.col("row_no"))).over(W.partitionBy(*sheet))
    return mapped.withColumn("header_row", head).where("row_no = header_row").select(*sheet, "header_row", "col_no", "field")


def extract_benefit_items(rows: DataFrame, header: DataFrame, sheet: list[str], fields=FIELDS) -> DataFrame:
    """A record for each row below the header with a name; where two columns map one field the later one counts."""
    # by sheet alone, as the cells are dealt: a header has a few cells
    heads = header.withColumnRenamed("col_no", "_col").hint("merge")
    below = rows.where("value <> '' and value <> 'None'").join(heads, sheet).where("col_no = _col and row_no > header_row")
    items = below.groupBy(*sheet, "row_no").pivot("field", list(fields)).agg(F.max_by("value", "col_no"))
    return items.where("name is not null")


def find_product_name(rows: DataFrame, header: DataFrame, sheet: list[str], words=PRODUCT_WORDS) -> DataFrame:
    """(sheet, product_name): the first cell above the header of over 5 characters with one of the words; '' if none."""
    heads = header.select(*sheet, "header_row").distinct()
    hit = F.lit(False)
    for w in words:
        hit = hit | F.contains("value", F.lit(w))
    named = rows.join(heads.hint("merge"), sheet).where((F.col("row_no") < F.col("header_row")) & (F.length("value") > 5) & hit)
    found = named.groupBy(*sheet).agg(F.min_by("value", F.struct("row_no", "col_no")).alias("product_name"))
    return heads.join(found.hint("merge"), sheet, "left").select(*sheet, F.coalesce("product_name", F.lit("")).alias("product_name"))
