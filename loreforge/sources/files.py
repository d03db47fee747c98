"""File scans: documents, texts, call logs, skill packages, prompt catalogues."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loreforge.operators.classify import detect_format, stem

#: Suffixes that a scan takes.
DOCUMENT_GLOB = "*.{pdf,txt,text,md,markdown,epub,PDF,TXT,MD}"
LOG_SCHEMA = (
    "run_id STRING, phase STRING, prompt_version STRING, system_prompt STRING, user_prompt STRING, output_raw STRING, output_clean STRING, think_content STRING, "
    "input_tokens BIGINT, output_tokens BIGINT, think_tokens BIGINT, latency_ms BIGINT, model STRING, validation_result STRING, human_label STRING, timestamp STRING"
)


def write_named_files(lines: DataFrame, folder: str, order: str, path: str = "path", line: str = "line", between: str | None = None) -> DataFrame:
    """Writes each path's lines, in order, to a file of that name below the folder; (path, lines) of what was written.

    Spark's writers choose names; logs of a day (`2024-01-05.jsonl`) and packages (`slug/SKILL.md`) have theirs. A file is
    written by one task, line by line, and anew if the task runs again. With `between` the rows are texts with that in between
    and nothing at the end; a file may then be larger than a row can be.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.fs as pafs

        fs, root = pafs.FileSystem.from_uri(folder)
        name, out, done = None, None, []
        for b in batches:
            for p, text in zip(b.column("p").to_pylist(), b.column("t").to_pylist()):
                if p != name:
                    if out is not None:
                        out.close()
                    fs.create_dir(f"{root}/{p}".rsplit("/", 1)[0], recursive=True)
                    name, out = p, fs.open_output_stream(f"{root}/{p}")
                    done.append([p, 0])
                out.write((text + "\n" if between is None else between + text if done[-1][1] else text).encode())
                done[-1][1] += 1
        if out is not None:
            out.close()
        yield pa.record_batch({"path": pa.array([d[0] for d in done], pa.string()), "lines": pa.array([d[1] for d in done], pa.int64())})

    rows = lines.select(F.col(path).alias("p"), F.coalesce(line, F.lit("")).alias("t"), F.col(order).alias("o")).where("p is not null")
    return rows.repartition("p").sortWithinPartitions("p", "o").select("p", "t").mapInArrow(write, "path string, lines long")


def scan_documents(spark: SparkSession, folder: str, recursive: bool = True) -> DataFrame:
    """(path, format) of document files, sorted; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).option("pathGlobFilter", DOCUMENT_GLOB).load(folder)
    return files.select("path").distinct().select("path", detect_format("path").alias("format")).orderBy("path")


def load_text_documents(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_name, source_path, format, markdown): each text file as one value."""
    rows = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{txt,text,md,markdown}").text(folder, wholetext=True)
    path = F.col("_metadata.file_path")
    return rows.select(stem(path).alias("doc_name"), path.alias("source_path"), F.lit("txt").alias("format"), F.col("value").alias("markdown"))


def scan_call_log(spark: SparkSession, folder: str, day: str | None = None) -> DataFrame:
    """Log records of all days or one; lines that aren't JSON objects are left out, missing fields have defaults."""
    rows = spark.read.schema(LOG_SCHEMA).option("mode", "DROPMALFORMED").option("pathGlobFilter", f"{day or '*'}.jsonl").json(folder)
    numbers = {c: F.coalesce(c, F.lit(0)) for c in ("input_tokens", "output_tokens", "think_tokens", "latency_ms")}
    return rows.where("phase is not null or run_id is not null").withColumns(numbers | {"validation_result": F.coalesce("validation_result", F.lit("pending")), "phase": F.coalesce("phase", F.lit("unknown")), "prompt_version": F.coalesce("prompt_version", F.lit("unknown"))})


def scan_skill_packages(spark: SparkSession, folder: str) -> DataFrame:
    """(dir, text) of SKILL.md files at any depth."""
    rows = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "SKILL.md").text(folder, wholetext=True)
    return rows.select(F.regexp_replace(F.col("_metadata.file_path"), "/[^/]*$", "").alias("dir"), F.col("value").alias("text"))


def prompt_catalog(files: DataFrame, path: str = "path") -> DataFrame:
    """(prompt_name, versions): sorted versions of each name, from stems `name_version`."""
    parts = files.select(stem(path).alias("stem")).where(F.contains("stem", F.lit("_")))
    return parts.select(F.regexp_extract("stem", r"^(.*)_([^_]*)$", 1).alias("prompt_name"), F.regexp_extract("stem", r"^(.*)_([^_]*)$", 2).alias("version")).groupBy("prompt_name").agg(
        F.array_sort(F.collect_set("version")).alias("versions")
    )


def scan_prompt_catalog(spark: SparkSession, folder: str) -> DataFrame:
    return prompt_catalog(spark.read.format("binaryFile").option("pathGlobFilter", "*.md").load(folder).select("path"))
