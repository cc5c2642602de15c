"""Readers and writers for ratings, series, traces, page changes, documents and results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import DataStreamWriter

from freshness.operators.docs import extract_documents
from freshness.operators.ordered import columns, names
from freshness.operators.windows import latest_per_key

RATING_SCHEMA = "user_id INT, movie_id INT, rating DOUBLE, timestamp LONG"
TAG_SCHEMA = "user_id INT, movie_id INT, tag STRING, timestamp LONG"
MOVIE_SCHEMA = "movie_id INT, title STRING, genres STRING"
TRACE_SCHEMA = "timestamp LONG, key STRING, min_cpu DOUBLE, max_cpu DOUBLE, avg_cpu DOUBLE"
CHANGE_SCHEMA = (
    "revid LONG, old_revid LONG, title STRING, pageid LONG, user STRING, userid LONG, comment STRING, timestamp STRING"
)
QUESTION_SCHEMA = "question STRING, answer STRING, doc_id LONG, datetime STRING, revid LONG, old_revid LONG"


def read_ratings(spark: SparkSession, path, sep: str = ",", header: bool = False, schema: str = RATING_SCHEMA) -> DataFrame:
    """Rating files separated by comma, tab or '::'."""
    return spark.read.schema(schema).csv(path, sep=sep, header=header)


def read_side_tables(spark: SparkSession, tags: str, movies: str) -> tuple[DataFrame, DataFrame]:
    """Tags and movie titles."""
    return (
        spark.read.schema(TAG_SCHEMA).csv(tags, header=True),
        spark.read.schema(MOVIE_SCHEMA).csv(movies, header=True),
    )


def read_keyed_dir(spark: SparkSession, glob: str, pattern: str, schema: str, header: bool = True) -> DataFrame:
    """Files of one key each; the key is the first group of `pattern` in the file name."""
    rows = spark.read.schema(schema).csv(glob, header=header)
    return rows.withColumn("key_id", F.regexp_extract(F.input_file_name(), pattern, 1))


def read_trace_shards(spark: SparkSession, glob: str, schema: str = TRACE_SCHEMA) -> DataFrame:
    """Headerless trace shards."""
    return spark.read.schema(schema).csv(glob)


def scan_keys(df: DataFrame, key: str, cols, keys) -> DataFrame:
    """Only the wanted columns and keys; a list is pushed to the scan, a table is a semi join."""
    wanted = df.select(key, *[c for c in names(cols) if c != key])
    return wanted.join(keys, key, "left_semi") if isinstance(keys, DataFrame) else wanted.where(F.col(key).isin(list(keys)))


def top_keys_scan(df: DataFrame, key: str, n: int) -> DataFrame:
    """Rows of the n keys with most rows; ties go to the lower key."""
    top = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).orderBy(F.desc("_n"), key).limit(n)
    return df.join(top.select(key), key, "left_semi")


def distinct_keys_and_times(df: DataFrame, key: str, ts: str, n: int) -> tuple[DataFrame, DataFrame]:
    """The first n keys, and all times in order."""
    return df.select(key).distinct().orderBy(key).limit(n), df.select(ts).distinct().orderBy(ts)


def read_change_files(spark: SparkSession, path: str, schema: str = CHANGE_SCHEMA) -> DataFrame:
    """Files that each hold a JSON array of page changes."""
    return spark.read.schema(schema).json(path, multiLine=True)


def read_questions(spark: SparkSession, path: str, schema: str = QUESTION_SCHEMA) -> DataFrame:
    """Questions from TSV with positional columns."""
    return spark.read.schema(schema).csv(path, sep="\t")


def read_document_markup(spark: SparkSession, path: str) -> DataFrame:
    """Documents from `<doc>` markup files.

    Files are cut at the closing tag, so a large file is read by many tasks.
    """
    parts = spark.read.text(path, lineSep="</doc>")
    return extract_documents(parts.select(F.concat("value", F.lit("</doc>")).alias("value")))


def kafka_json_source(spark: SparkSession, servers: str, topic: str, schema: str | T.StructType) -> DataFrame:
    """A JSON topic from the earliest offset. Needs the Kafka connector package on the cluster."""
    raw = (
        spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic)
        .option("startingOffsets", "earliest").load()
    )
    return parse_json_records(raw, schema)


def parse_json_records(raw: DataFrame, schema: str | T.StructType, value: str = "value") -> DataFrame:
    """Message bytes to columns."""
    return raw.select(F.from_json(F.col(value).cast("string"), schema).alias("_r")).select("_r.*")


def write_replay(df: DataFrame, order, path: str, files: int, parts: int = 1) -> None:
    """Rows in order over `files` x `parts` Parquet files whose modification times follow the order.

    The file stream source takes files by modification time, so a replay sees
    them in this order. With `parts` files a trigger it has `files` batches, each read and written by `parts` tasks.
    """
    order = columns(order)
    df.repartitionByRange(files * parts, *order).sortWithinPartitions(*order).write.parquet(path)
    _stamp_in_order(df.sparkSession, path)


def write_steps(df: DataFrame, step: str, order, path: str) -> None:
    """Rows in one Parquet file for each value of `step` (a whole number from 0), to be replayed one step at a time; no step is cut."""
    numbered = df.withColumn("_folder", F.lpad(F.col(step).cast("string"), 12, "0"))
    numbered.repartition("_folder").sortWithinPartitions("_folder", *columns(order)).write.partitionBy("_folder").parquet(path)
    _stamp_in_order(df.sparkSession, path)


def _stamp_in_order(spark: SparkSession, path: str) -> None:
    """Give the data files under `path` modification times a second apart, in the order of their names."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    folder = jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(conf)
    found, listed = [], fs.listFiles(folder, True)
    while listed.hasNext():
        file = listed.next().getPath()
        if file.getName().startswith("part-"):
            found.append(file.toString())
    start = fs.getFileStatus(folder).getModificationTime() - len(found) * 1000
    for i, part in enumerate(sorted(found)):
        fs.setTimes(jvm.org.apache.hadoop.fs.Path(part), start + i * 1000, -1)


def replay_source(spark: SparkSession, path: str, schema, per_trigger: int = 1) -> DataFrame:
    """Stored events as a stream, `per_trigger` files at a time, oldest first."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).option("latestFirst", False).parquet(path)


def feature_log_sink(stream: DataFrame, path: str, checkpoint: str, fmt: str = "parquet") -> DataStreamWriter:
    """Append every new feature version to files."""
    return stream.writeStream.format(fmt).outputMode("append").option("path", path).option("checkpointLocation", checkpoint)


def results_sink(df: DataFrame, path: str, by=("policy", "updates")) -> None:
    """Results of a run, one folder per parameter set."""
    df.write.mode("append").partitionBy(*by).parquet(path)


def qa_files_sink(df: DataFrame, path: str, by=("ts", "doc_id")) -> None:
    """Questions and passages as TSV, one folder per time and document."""
    df.write.mode("append").partitionBy(*by).csv(path, sep="\t")


def lookup_feature(versions: DataFrame, key: str, value, order) -> DataFrame:
    """The current feature of one key; the key filter reaches the scan."""
    return latest_per_key(versions.where(F.col(key) == value), key, order)


def scan_features(versions: DataFrame, key: str, order) -> DataFrame:
    """The current feature of every key."""
    return latest_per_key(versions, key, order)


def console_or_memory_sink(stream: DataFrame, name: str | None = None, mode: str = "append") -> DataStreamWriter:
    """Print a stream, or with a name keep it as an in-memory table. For looking at small results only."""
    writer = stream.writeStream.outputMode(mode)
    return writer.format("memory").queryName(name) if name else writer.format("console").option("truncate", False)
