"""Files in and out: text folders, folder scans, reports, indexes, datasets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TEXT_KINDS = ["txt", "md"]
KINDS = ["txt", "md", "pdf"]


def _with_kind(df: DataFrame, path: str = "path") -> DataFrame:
    name = F.element_at(F.split(path, "/"), -1)
    return df.withColumn("filename", F.url_decode(F.replace(name, F.lit("+"), F.lit("%2B")))).withColumn("file_type", F.lower(F.regexp_extract("filename", r"\.([^.]+)$", 1)))


def read_text_documents(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """path, filename, file_type, modified_at, size, text: one row per .txt or .md file."""
    raw = spark.read.text(path, wholetext=True, recursiveFileLookup=recursive, pathGlobFilter="*.{txt,md,TXT,MD}")
    meta = raw.select("_metadata.file_path", "_metadata.file_modification_time", "_metadata.file_size", F.col("value").alias("text"))
    named = meta.toDF("path", "modified_at", "size", "text")
    return _with_kind(named).select("path", "filename", "file_type", "modified_at", "size", "text")


def list_files(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """path, filename, file_type, modified_at, size without reading contents."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(path)
    return _with_kind(raw.select("path", F.col("modificationTime").alias("modified_at"), F.col("length").alias("size")))


def scan_folder(files: DataFrame, documents: DataFrame) -> DataFrame:
    """kb_id, filename, action of files of a known kind: skipped (not newer and completed), updated (known) or imported.

    ``files``: kb_id, filename, file_type, modified_at; ``documents``: kb_id, filename, status, modified_at.
    """
    own = files.where(F.col("file_type").isin(KINDS))
    known = documents.select("kb_id", "filename", F.col("status").alias("old_status"), F.col("modified_at").alias("stored_at"))
    joined = own.join(known, ["kb_id", "filename"], "left")
    same = (F.col("modified_at") <= F.col("stored_at")) & (F.col("old_status") == "completed")
    return joined.withColumn("action", F.when(same, "skipped").when(F.col("old_status").isNotNull(), "updated").otherwise("imported"))


def scan_counts(scanned: DataFrame) -> DataFrame:
    count = lambda a: F.count_if(F.col("action") == a).alias(a)
    return scanned.groupBy("kb_id").agg(F.count(F.lit(1)).alias("scanned"), count("imported"), count("updated"), count("skipped"))


def html_to_text(pages: DataFrame, column: str = "html") -> DataFrame:
    """Tags taken out, nothing else."""
    return pages.withColumn("text", F.regexp_replace(column, "<[^>]+>", ""))


REPORT = "dataset_version string, config map<string,string>, aggregate map<string,double>, samples array<struct<id:string,kb_id:string,q_type:string,question:string,context_recall:double,context_precision:double>>"


def load_eval_report(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(runs, samples) of report files: aggregates as a map, and one row per sample."""
    raw = spark.read.schema(REPORT).json(path, multiLine=True).withColumn("run", F.sha2(F.to_json(F.struct("*")), 256))
    return raw.select("run", "dataset_version", "config", "aggregate"), raw.select("run", "dataset_version", F.explode("samples").alias("s")).select("run", "dataset_version", "s.*")


def write_index(path: str, chunks: DataFrame, vectors: DataFrame, postings: DataFrame, triples: DataFrame) -> None:
    """The chunk table with its three indexes, by kb; a write replaces the partitions of the kbs it has, and no others."""
    for name, df in (("chunks", chunks), ("vectors", vectors), ("postings", postings), ("triples", triples)):
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("kb_id").parquet(f"{path}/{name}")


def export_eval_dataset(samples: DataFrame, path: str) -> None:
    """Samples as JSON lines by kb, with the number of samples of each kb and type beside them."""
    samples.write.mode("overwrite").partitionBy("kb_id").json(f"{path}/samples")
    samples.groupBy("kb_id", "q_type").agg(F.count(F.lit(1)).alias("n")).coalesce(1).write.mode("overwrite").json(f"{path}/meta")
