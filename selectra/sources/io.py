"""Sources and sinks: events, call logs, run manifests, snapshots, text corpora, baselines."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from functools import reduce

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from selectra.sources.scratch import prefix_sums

EVENT_SCHEMA = "name string, payload map<string,string>, timestamp double, run_id string, generation int"
MANIFEST_SCHEMA = "run_id string, started string, finished string, config map<string,string>, metrics map<string,double>, event_counts map<string,long>, fitness_history array<double>"


def event_rows(raw: DataFrame, name: str, ts: str, payload: str, key: str) -> DataFrame:
    """Typed envelope (event_id, name, ts, payload map) from raw columns; a payload that is no JSON object is null."""
    return raw.select(F.col(key).alias("event_id"), F.col(name).alias("name"), F.col(ts).alias("ts"), F.from_json(payload, "map<string,string>").alias("payload"))


def read_events(spark: SparkSession, path: str, streaming: bool = False, schema: str = EVENT_SCHEMA) -> DataFrame:
    """JSON-lines events with their time as a timestamp."""
    reader = spark.readStream if streaming else spark.read
    return reader.schema(schema).json(path).withColumn("ts", F.timestamp_seconds("timestamp"))


def call_log_rows(calls: DataFrame, prompt: str = "prompt", response: str = "response") -> DataFrame:
    """What the log may hold: hashes and a 200-character preview, never the prompt."""
    keep = [c for c in calls.columns if c not in (prompt, response)]
    return calls.select(*keep, F.sha2(prompt, 256).alias("prompt_hash"), F.sha2(response, 256).alias("response_hash"), F.substring(response, 1, 200).alias("preview"))


def append_log(calls: DataFrame, path: str) -> None:
    call_log_rows(calls).write.mode("append").json(path)


def read_run_manifests(spark: SparkSession, glob: str, schema: str = MANIFEST_SCHEMA) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(glob)


def manifest_metrics(manifests: DataFrame) -> DataFrame:
    return manifests.select("run_id", F.explode("metrics").alias("metric", "value"))


def explode_history(manifests: DataFrame, history: str = "fitness_history", by: str = "run_id") -> DataFrame:
    """(run, generation, value) of the history arrays; a run without history has one row of nulls."""
    return manifests.select(by, F.posexplode_outer(history).alias("generation", "value"))


def explode_lineage(graphs: DataFrame, nodes: str = "nodes") -> tuple[DataFrame, DataFrame]:
    """Node rows and edges (parent_id, child_id) from a map id -> struct with parent_ids."""
    rows = graphs.select(F.explode(nodes).alias("id", "node")).select("id", "node.*")
    return rows.drop("parent_ids"), rows.select(F.explode("parent_ids").alias("parent_id"), F.col("id").alias("child_id"))


def write_run_bundle(tables: Mapping[str, DataFrame], path: str, run_id: str) -> None:
    """Each table below path/<name>/run_id=<run>; writing a run again replaces it."""
    for name, table in tables.items():
        rows = table.withColumn("run_id", F.lit(run_id))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(f"{path}/{name}")


def write_run_bundles(tables: Mapping[str, DataFrame], path: str, run: str = "run_id") -> None:
    """Each table below path/<name>/<run>=...: the bundles of all runs in its rows, in one job a table. Runs written again are replaced."""
    for name, table in tables.items():
        table.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(run).parquet(f"{path}/{name}")


def snapshot_write(df: DataFrame, path: str, run_id: str, generation: int) -> None:
    rows = df.withColumn("run_id", F.lit(run_id)).withColumn("generation", F.lit(generation))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("run_id", "generation").parquet(path)


def snapshot_read(spark: SparkSession, path: str, run_id: str, generation: int | None = None) -> DataFrame:
    """A generation of a run, the newest by default; other partitions are pruned."""
    rows = spark.read.parquet(path).filter(F.col("run_id") == run_id)
    if generation is None:
        generation = rows.agg(F.max("generation")).first()[0]
    return rows.filter(F.col("generation") == generation)


def snapshot_restore(spark: SparkSession, path: str, json_path: str, schema: str, run_id: str, generation: int | None = None) -> DataFrame:
    """A generation of a run from the columnar snapshots at ``path`` or the JSON ones at ``json_path``, whichever has the newest; columnar ones win a tie.

    Either may be missing. ``schema`` is that of the rows, without run_id and generation.
    """
    hadoop, found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path, []
    full = f"{schema}, run_id string, generation int"
    for place, reader in ((path, spark.read.schema(full).parquet), (json_path, spark.read.schema(full).json)):
        if hadoop(place).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop(place)):
            rows = reader(place).filter(F.col("run_id") == run_id)
            newest = (rows if generation is None else rows.filter(F.col("generation") == generation)).agg(F.max("generation")).first()[0]
            if newest is not None:
                found.append((newest, rows.filter(F.col("generation") == newest)))
    if not found:
        raise FileNotFoundError(f"no snapshot of {run_id} in {path} or {json_path}")
    return max(found, key=lambda x: x[0])[1]


def convert_snapshots(spark: SparkSession, src: str, dst: str, schema: str, overwrite: bool = False) -> None:
    """JSON to compressed parquet; an existing target stays unless overwrite is set."""
    spark.read.schema(schema).json(src).write.mode("overwrite" if overwrite else "ignore").option("compression", "zstd").parquet(dst)


def list_snapshots(spark: SparkSession, path: str, glob: str = "*", sort_by: str = "time") -> DataFrame:
    """file, size and mtime of the files, newest, largest or last by name first; contents are not read."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    rows = rows.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))
    rows = rows.withColumn("generation", F.nullif(F.regexp_extract("file", r"([0-9]+)[^0-9]*$", 1), F.lit("")).try_cast("long"))
    first = {"time": F.desc("mtime"), "generation": F.desc_nulls_last("generation"), "size": F.desc("size")}[sort_by]
    return rows.orderBy(first, "file")


def retention_plan(files: DataFrame, keep_last: int, oldest: Column, ts: str = "mtime", key: str = "file") -> DataFrame:
    """Rows to delete: beyond the newest ``keep_last``, or older than ``oldest``. Only the newest rows are sorted out, by top-n."""
    newest = files.orderBy(F.desc(ts), F.desc(key)).limit(keep_last).select(key).withColumn("_new", F.lit(True))
    rows = files.join(newest, key, "left")
    return rows.filter(F.col("_new").isNull() | (F.col(ts) < oldest)).drop("_new")


def write_corpus(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> None:
    """A file below ``path`` for each row, named after its key, with the text and a line feed; a null text is marked in the name.

    Tasks write the files by pyarrow's file systems: Spark's writer opens a task's file for each row and starts a process for its permissions.
    A task that is run again writes the same names.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))
        home, n = f"{root}/{TaskContext.get().partitionId()}", 0
        store.create_dir(home, recursive=True)
        for batch in batches:
            for name, value in zip(batch.column(0), batch.column(1), strict=True):
                value = value.as_py()
                with store.open_output_stream(f"{home}/{n}-{'null' if value is None else 'text'}-{key}={name.as_py()}.txt") as out:
                    out.write(((value or "") + "\n").encode())
                n += 1
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})

    docs.select(key, text).mapInArrow(write, "n long").agg(F.sum("n")).collect()


def read_corpus(spark: SparkSession, root: str, extensions: Sequence[str] = ("txt",), max_files: int | None = None) -> DataFrame:
    """(path, text) of all files below ``root`` with one of the extensions, in path order; unreadable files are left out (``unreadable_files`` tells which)."""
    glob = "*.{" + ",".join(extensions) + "}" if len(extensions) > 1 else f"*.{extensions[0]}"
    rows = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).option("ignoreCorruptFiles", True).option("ignoreMissingFiles", True).text(root, wholetext=True)
    rows = rows.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    return rows if max_files is None else rows.orderBy("path").limit(max_files)


def unreadable_files(spark: SparkSession, root: str, extensions: Sequence[str] = ("txt",)) -> DataFrame:
    """(path, length) of the files that ``read_corpus`` leaves out since they can't be read or decompressed. Listing reads no contents."""
    glob = "*.{" + ",".join(extensions) + "}" if len(extensions) > 1 else f"*.{extensions[0]}"
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    listed = listed.select(F.col("_metadata.file_path").alias("path"), "length").filter("length > 0")
    return listed.join(read_corpus(spark, root, extensions).select("path"), "path", "left_anti")


#: What stands between two sources of a merged text.
RULE = "\n\n---\n\n"


def merge_sources(parts: Sequence[DataFrame] | DataFrame, by: Sequence[str] = (), name: str = "name", text: str = "text", order: str = "ord") -> DataFrame:
    """The merged text of each group as pieces: name, order, piece, its start in the merged text, and the sources of the group.

    A piece is a source with its [name] header, behind a rule unless it is the first; a group's pieces in order of start are
    its text. A group may be larger than a string can be: pieces are placed by the lengths before them, and no task gathers them.
    """
    rows = parts if isinstance(parts, DataFrame) else reduce(DataFrame.unionByName, parts)
    body = F.concat(F.lit(RULE + "["), F.col(name).cast("string"), F.lit("]\n"), F.coalesce(F.col(text), F.lit("")))
    sized = rows.select(*by, *dict.fromkeys([name, order]), F.char_length(body).cast("long").alias("_len"), body.alias("_body"))
    placed = prefix_sums(sized, by, [F.col(order), F.col(name)], {"_start": F.col("_len")}, {"n_sources": F.lit(1).cast("long")})
    head = F.col("_start") == 0
    piece = F.when(head, F.substring("_body", len(RULE) + 1, 2**31 - 1)).otherwise(F.col("_body"))
    start = F.when(head, F.lit(0)).otherwise(F.col("_start") - len(RULE))
    return placed.select(*by, *dict.fromkeys([name, order]), piece.alias("piece"), start.cast("long").alias("start"), "n_sources")


def merged_texts(pieces: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One string a group from ``merge_sources``: for groups that fit one string."""
    return pieces.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "piece"))), lambda p: p["piece"]), "").alias("text"), F.max("n_sources").alias("n_sources"))
