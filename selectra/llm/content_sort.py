"""Exact de-duplication by content sort.

Sampled splitters (Spark's range partitioner) deal the rows by the leading bytes
of the text, then a hash of the whole text, then the id. Splitters therefore stay
short however long the texts are, and a group of copies too large for one task is
split over several, since the id is part of the splitter. Each partition is sorted
externally by (leading bytes, hash, full text, id), which places equal texts next
to each other; every neighbour is then compared in full. A run of equal texts that
crosses a partition border is stitched by grouping the at most two border texts of
each partition, again on the full text.

Defined cases: null text counts as empty; null ids lose against any id; rows that
share id and text count as copies, of which one stays; an empty table gives an
empty result. Other columns may have any name; ``copies`` returns only its own
columns and ``without_copies`` returns the input's columns unchanged.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from selectra.llm.common import written

PREFIX_CHARS = 24


def _sorted(df: DataFrame, largest: bool) -> DataFrame:
    """Expects columns _text and _id first; the row that should stay comes first in each run."""
    keyed = df.withColumns({"_prefix": F.substring("_text", 1, PREFIX_CHARS), "_hash": F.xxhash64("_text")})
    by_id = F.col("_id").desc_nulls_last() if largest else F.col("_id").asc_nulls_last()
    dealt = keyed.repartitionByRange("_prefix", "_hash", by_id)
    return dealt.sortWithinPartitions("_prefix", "_hash", "_text", by_id).drop("_prefix", "_hash")


def _starts(text: pa.Array, last: pa.Scalar | None) -> list[bool]:
    """True where a row's text differs from its predecessor's; ``last`` is the text before the batch."""
    inner = pc.not_equal(text.slice(1), text.slice(0, len(text) - 1)).to_pylist()
    return [last is None or last != text[0], *inner]


def _mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number the runs of equal texts; the border texts of the partition follow as edge rows."""
    part, run, last = TaskContext.get().partitionId(), -1, None
    first = digest = None
    for batch in batches:
        if not batch.num_rows:
            continue
        text = batch.column(0)
        runs, leads, digests = [], [], []
        for k, start in enumerate(_starts(text, last)):
            if start:
                run += 1
                digest = hashlib.sha256(text[k].as_py().encode()).hexdigest()
            runs.append(run)
            leads.append(start)
            digests.append(digest)
        first, last = text[0] if first is None else first, text[len(text) - 1]
        n = len(runs)
        yield pa.RecordBatch.from_arrays(
            [batch.column(1), pa.array([part] * n, pa.int32()), pa.array(runs, pa.int64()), pa.array(leads), pa.array(digests, pa.string()), pa.nulls(n, pa.string())],
            ["_id", "_part", "_run", "_lead", "_digest", "_edge"],
        )
    if last is not None:
        edges = {0: first.as_py(), run: last.as_py()}
        n = len(edges)
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(n, batch.column(1).type), pa.array([part] * n, pa.int32()), pa.array(list(edges), pa.int64()), pa.array([False] * n), pa.nulls(n, pa.string()), pa.array(list(edges.values()), pa.string())],
            ["_id", "_part", "_run", "_lead", "_digest", "_edge"],
        )


def copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", normalise: Column | None = None, keep: str = "smallest") -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    ``normalise`` is the text to compare (default: the text itself); ``keep`` is
    "smallest" or "largest" and names the id of each group that stays.
    """
    text = F.coalesce(F.col(text_col) if normalise is None else normalise, F.lit(""))
    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(text.alias("_text"), F.col(id_col).alias("_id"))
    marked = written(_sorted(rows, keep == "largest").mapInArrow(_mark, f"_id {kind}, _part int, _run long, _lead boolean, _digest string, _edge string"), "runs")
    runs = marked.filter(F.col("_edge").isNull()).drop("_edge")
    # At most two rows a partition, so small enough to broadcast: runs with the same border text are one group, led by the earliest.
    member = F.struct("_part", "_run")
    edges = marked.filter(F.col("_edge").isNotNull()).groupBy("_edge").agg(F.collect_set(member).alias("all"), F.min(member).alias("group"))
    edges = edges.select(F.explode("all").alias("at"), "group").select("at._part", "at._run", "group")
    placed = runs.join(F.broadcast(edges), ["_part", "_run"], "left").withColumn("_group", F.coalesce("group", member))
    placed = placed.withColumn("_kept", F.col("_lead") & (F.col("_group") == member))
    # Written, so that adaptive execution sees two plain shuffles and splits the rows of a hot group.
    groups = written(placed.groupBy("_group").agg(F.count(F.lit(1)).alias("group_size"), F.max_by("_id", "_kept").alias("keep_id")), "groups")
    return placed.join(groups, "_group").select(F.col("_id").alias(id_col), "keep_id", "group_size", F.col("_kept").alias("kept"), F.col("_digest").alias("text_sha256"))


def _lead_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first row of every run, with the partition and whether the run touches a border."""
    part, last, held, run = TaskContext.get().partitionId(), None, None, -1

    def out(batch: pa.RecordBatch, run: int, edge: bool) -> pa.RecordBatch:
        n = batch.num_rows
        more = [pa.array([part] * n, pa.int32()), pa.array([run] * n, pa.int64()), pa.array([edge] * n)]
        return pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, "_part", "_run", "_border"])

    for batch in batches:
        if not batch.num_rows:
            continue
        text = batch.column(0)
        leads = batch.filter(pa.array(_starts(text, last)))
        last = text[len(text) - 1]
        if leads.num_rows:
            if held is not None:
                yield out(held, run, run == 0)
            if leads.num_rows > 1:
                at = int(run < 0)
                if at:
                    yield out(leads.slice(0, 1), 0, True)
                if leads.num_rows - 1 > at:
                    yield out(leads.slice(at, leads.num_rows - 1 - at), 1, False)
            run = 0 if run < 0 and leads.num_rows == 1 else 1
            held = leads.slice(leads.num_rows - 1)
    if held is not None:
        yield out(held, run, True)


def without_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", normalise: Column | None = None, keep: str = "smallest") -> DataFrame:
    """The rows of ``df`` that stay, all columns unchanged; see ``copies``."""
    text = F.coalesce(F.col(text_col) if normalise is None else normalise, F.lit(""))
    rows = df.select(text.alias("_text"), F.col(id_col).alias("_id"), F.struct(*[df[c] for c in df.columns]).alias("_row"))
    schema = rows.schema.add("_part", "integer").add("_run", "long").add("_border", "boolean")
    leads = written(_sorted(rows, keep == "largest").mapInArrow(_lead_rows, schema), "leads")
    # Border rows, at most two a partition: of those with equal texts the earliest stays.
    border = leads.filter("_border").groupBy("_text").agg(F.min_by("_row", F.struct("_part", "_run")).alias("_row"))
    return leads.filter("NOT _border").select("_row.*").unionByName(border.select("_row.*"))
