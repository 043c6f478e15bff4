"""Structured Streaming operators over event and call logs.

Time is event time. Streams carry a watermark (10 minutes by default); rows later
than that are dropped by windowed, de-duplicating and folding operators; folds count
them (``late_rows``), for the others Spark's progress does. Keyed state expires after ``STATE_TTL`` of event time
without rows of its key.

A ``Fold`` takes the rows of a key in the order of their times, however the input is cut
into batches: rows wait in the key's state until the watermark has passed them, so that
none can come in between any more. Rows without a time count as late. When a bounded
input ends, ``Fold.rest`` folds what still waits in the checkpoint. A fold over numbered steps
without times lets a row wait for the step before it.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterable, Iterator, Mapping
from dataclasses import dataclass
from operator import itemgetter

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from selectra.sources.scratch import scratch_path

WATERMARK = "10 minutes"
#: Milliseconds without rows after which the state of a key is dropped.
STATE_TTL = 400 * 24 * 3600 * 1000
#: A fold keeps the state of its keys in so many buckets, each handled by one call a batch.
BUCKETS = 256
#: Rows of a slice in which ``run_fold`` hands a table to a stream: so many wait in the state at a time.
SLICE_ROWS = 2_000_000
NAN = float("nan")


def late_rows(spark: SparkSession, checkpoint: str) -> DataFrame:
    """Per key of a fold the rows dropped as later than the watermark, from the state in the query's checkpoint."""
    held = spark.read.format("statestore").load(checkpoint).select("value.groupState.*")
    by = held.columns[0]
    return held.select(F.explode(F.arrays_zip(F.col(by).alias("by"), F.col("_late").alias("late"))).alias("_row")).select(F.col("_row.by").alias(by), "_row.late")


def stream_event_counts(stream: DataFrame, window: str | None = None, name: str = "name", ts: str = "ts", watermark: str = WATERMARK) -> DataFrame:
    """Live counts per name, in event-time windows if given."""
    if window is None:
        return stream.groupBy(name).agg(F.count(F.lit(1)).alias("n"))
    rows = stream.withWatermark(ts, watermark).groupBy(F.window(ts, window), name).agg(F.count(F.lit(1)).alias("n"))
    return rows.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), name, "n")


def stream_generation_metrics(stream: DataFrame, event: str = "GenerationCompleted", name: str = "name", payload: str = "payload") -> DataFrame:
    """Dashboard rows of one kind of event; values that do not parse become defaults."""
    field = lambda key, kind, default: F.coalesce(F.try_element_at(F.col(payload), F.lit(key)).try_cast(kind), F.lit(default).cast(kind)).alias(key)
    rows = stream.filter(F.col(name) == event)
    keep = [c for c in rows.columns if c not in (payload, name)]
    return rows.select(*keep, field("best_score", "double", 0.0), field("diversity", "double", 0.0), field("pareto_size", "int", 0))


def stream_group_scores(stream: DataFrame, event: str = "GenerationCompleted", name: str = "name", payload: str = "payload", key: str = "island_scores") -> DataFrame:
    """Dashboard rows of the groups in one kind of event: a row (group, best) for each entry of the payload's JSON object ``key``.

    Group numbers or scores that do not parse leave no row; neither do events without the object.
    """
    rows = stream.filter(F.col(name) == event)
    keep = [c for c in rows.columns if c not in (payload, name)]
    scores = F.from_json(F.try_element_at(F.col(payload), F.lit(key)), "map<string,string>")
    rows = rows.select(*keep, F.explode(scores).alias("_group", "_best"))
    rows = rows.select(*keep, F.col("_group").try_cast("int").alias("group"), F.col("_best").try_cast("double").alias("best"))
    return rows.filter(F.col("group").isNotNull() & F.col("best").isNotNull())


def stream_fanout(stream: DataFrame, handlers: dict[str, Callable[[DataFrame, int], None]], errors: str):
    """A foreachBatch writer that gives every handler each batch; a failing handler leaves a row in ``errors`` and stops no other."""

    def each(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        failed = []
        for name, handler in handlers.items():
            try:
                handler(batch, batch_id)
            except Exception as error:  # noqa: BLE001  one handler's failure is the others' non-event
                failed.append((name, batch_id, str(error)[:500]))
        batch.unpersist()
        if failed:
            batch.sparkSession.createDataFrame(failed, "handler string, batch_id long, error string").write.mode("append").parquet(errors)

    return stream.writeStream.foreachBatch(each)


def _folded(step: Callable, names: list[str], held: dict, start: tuple, rows: list[tuple]) -> list[tuple]:
    """The output of rows (key, *names) in their order; the values of their keys in ``held`` are replaced."""
    found = []
    for key, *row in rows:
        value, out = step(held.get(key, start), dict(zip(names, row, strict=True)))
        held[key] = value
        found.append((key, *out))
    return found


def _listed(names: list[str], rows: pd.DataFrame) -> list[tuple]:
    columns = [[None if x is None or x != x else x for x in rows[n].tolist()] for n in names]
    return list(zip(*columns, strict=True))


def _keys(bucket: int, keys: Iterable) -> list:
    """One object for all keys that are not a number, and none in the bucket of nulls."""
    return [None if bucket < 0 else NAN if x != x else x for x in keys]


def _heads(ddl: str) -> list[str]:
    return [c.strip().split()[0] for c in ddl.split(",")]


@dataclass(frozen=True)
class Fold:
    """Keyed ordered fold: ``step(state, row) -> (state, output values)`` for each row in the order of (time, ``seq``).

    ``columns`` maps the names that ``step`` reads to (type, expression); ``time`` is the event time as microseconds there.
    Without ``ts`` the order is ``seq`` alone, whose numbers follow on each other from ``first``.
    """

    by: str
    seq: str
    columns: Mapping[str, tuple[str, Column]]
    output: str
    state: str
    start: tuple
    step: Callable[[tuple, dict], tuple[tuple, tuple]]
    ts: str | None = None
    first: int = 0

    @property
    def names(self) -> list[str]:
        return ["time", "seq", *self.columns]

    def _rows(self, df: DataFrame) -> DataFrame:
        """The key, the time in microseconds, the sequence number (null: -1) and what the step reads."""
        time = F.unix_micros(self.ts) if self.ts else F.lit(0)
        return df.select(self.by, *([F.col(self.ts).alias("_at")] if self.ts else []), time.cast("long").alias("time"), F.coalesce(F.col(self.seq).cast("long"), F.lit(-1)).alias("seq"), *[c.cast(kind).alias(n) for n, (kind, c) in self.columns.items()])

    def _schema(self, df: DataFrame) -> str:
        return f"`{self.by}` {df.schema[self.by].dataType.simpleString()}, {self.output}"

    def batch(self, df: DataFrame) -> DataFrame:
        """The fold of a whole table; rows without a time stay out."""
        step, start, names, out = self.step, self.start, self.names, [self.by, *_heads(self.output)]

        def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
            rows = sorted(_listed(names, rows[rows["time"].notna()]), key=lambda r: r[:2])
            return pd.DataFrame(_folded(step, names, {}, start, [(key[0], *r) for r in rows]), columns=out)

        return self._rows(df).groupBy(self.by).applyInPandas(run, self._schema(df))

    def stream(self, df: DataFrame, watermark: str = WATERMARK) -> DataFrame:
        """Rows leave in order, once the watermark has passed them or, without times, once the step before is there.

        Keys are dealt to BUCKETS by their digests. A call handles the rows of a bucket in one order; its state has a list
        entry for each key and for each row that waits.
        """
        by, step, start, timed, first, names, out = self.by, self.step, self.start, self.ts is not None, self.first, self.names, [self.by, *_heads(self.output)]
        kinds = {"time": "long", "seq": "long"} | {n: kind for n, (kind, _) in self.columns.items()}
        values = [f"_value_{c.strip().replace(' ', ' array<', 1)}>" for c in self.state.split(",")]
        state = ", ".join([f"`{by}` array<{df.schema[by].dataType.simpleString()}>", *values, "_late array<long>", "_newest array<long>", "_due array<long>", "_wait_key array<int>", *[f"_wait_{n} array<{kind}>" for n, kind in kinds.items()]])
        n_value = len(start)

        def run(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterable[pd.DataFrame]:
            got = held.get if held.exists else [()] * (5 + n_value + len(kinds))
            keys = _keys(key[0], got[0])
            value = dict(zip(keys, zip(*got[1:1 + n_value], strict=True), strict=True))
            about = {k: list(x) for k, x in zip(keys, zip(*got[1 + n_value:4 + n_value], strict=True), strict=True)}
            waiting = [(keys[k], *row) for k, row in zip(got[4 + n_value], zip(*got[5 + n_value:], strict=True), strict=True)]
            passed, touched = held.getCurrentWatermarkMs() * 1000 if timed else None, set()
            if not held.hasTimedOut:
                for rows in batches:
                    for k, row in zip(_keys(key[0], rows[by].tolist()), _listed(names, rows), strict=True):
                        mine = about.setdefault(k, [0, 0, first])
                        if row[0] is not None and row[0] > mine[1]:
                            mine[1] = int(row[0])
                        if row[0] is not None and row[0] >= passed if timed else row[1] >= mine[2]:
                            waiting.append((k, *row))
                        else:
                            mine[0] += 1
                    touched.update(about if len(about) == 1 else _keys(key[0], rows[by].unique().tolist()))
            waiting.sort(key=itemgetter(1, 2))
            if timed:
                n_ready = bisect_left(waiting, passed, key=itemgetter(1))
                ready, waiting = waiting[:n_ready], waiting[n_ready:]
            else:
                ready, rest = [], []
                for row in waiting:
                    mine = about[row[0]]
                    if row[2] in (mine[2], mine[2] - 1):
                        mine[2] = row[2] + 1
                        ready.append(row)
                    else:
                        rest.append(row)
                waiting = rest
            found = _folded(step, names, value, start, ready)
            idle = about.keys() - {r[0] for r in waiting}
            if timed:
                gone = {k for k in idle - touched if passed >= about[k][1] + STATE_TTL * 1000}
                about, idle = {k: x for k, x in about.items() if k not in gone}, idle - gone
            if not about:
                held.remove()
            else:
                at = {k: i for i, k in enumerate(about)}
                # Times and numbers come as floats where a column has nulls.
                owner, *columns = zip(*waiting, strict=True) if waiting else [()] * (1 + len(kinds))
                columns = [[x if x is None or kind != "long" else int(x) for x in c] for c, kind in zip(columns, kinds.values(), strict=True)]
                held.update((list(about), *map(list, zip(*[value.get(k, start) for k in about], strict=True)), *map(list, zip(*about.values(), strict=True)), [at[k] for k in owner], *columns))
                if timed:
                    # The watermark must pass the first row that waits; a timeout must lie ahead of it.
                    due = [int(waiting[0][1]) // 1000] if waiting else []
                    due += [min(about[k][1] for k in idle) // 1000 + STATE_TTL] if idle else []
                    held.setTimeoutTimestamp(max(passed // 1000, min(due)) + 1)
            yield pd.DataFrame(found, columns=out)

        bucket = F.when(F.col(by).isNull(), -1).otherwise(F.pmod(F.xxhash64(by), F.lit(BUCKETS))).cast("int")
        rows = self._rows(df.withWatermark(self.ts, watermark) if self.ts else df).withColumn("_bucket", bucket)
        return rows.groupBy("_bucket").applyInPandasWithState(run, self._schema(df), state, "append", GroupStateTimeout.EventTimeTimeout if self.ts else GroupStateTimeout.NoTimeout)

    def rest(self, spark: SparkSession, checkpoint: str) -> DataFrame:
        """The output of the rows that still wait in the state of a query that has ended."""
        held = spark.read.format("statestore").load(checkpoint).select(F.col("key._bucket").alias("_bucket"), "value.groupState.*")
        step, start, by, names, out, value = self.step, self.start, self.by, self.names, [self.by, *_heads(self.output)], [f"_value_{c}" for c in _heads(self.state)]
        kind = held.schema[by].dataType.elementType.simpleString()

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for rows in batches:
                for row in rows.to_dict("records"):
                    keys = _keys(row["_bucket"], row[by].tolist())
                    now = dict(zip(keys, zip(*[row[c] for c in value], strict=True), strict=True))
                    waiting = _listed(names, pd.DataFrame({n: row[f"_wait_{n}"] for n in names}))
                    waiting = sorted(((keys[k], *r) for k, r in zip(row["_wait_key"], waiting, strict=True)), key=itemgetter(1, 2))
                    yield pd.DataFrame(_folded(step, names, now, start, waiting), columns=out)

        return held.mapInPandas(run, f"`{by}` {kind}, {self.output}")


def control_fold(by: str = "run_id", command: str = "command", ts: str = "ts", seq: str = "event_id") -> Fold:
    """State after each command: pause and resume switch, stop is final."""

    def step(value: tuple, row: dict):
        now = value[0]
        if now != "stopped":
            now = {"pause": "paused", "resume": "running", "stop": "stopped"}.get(row["command"], now)
        return (now,), (int(row["seq"]), row["command"], now)

    return Fold(by, seq, {"command": ("string", F.col(command))}, f"{seq} long, {command} string, state string", "state string", ("running",), step, ts)


def stream_control_state(stream: DataFrame, by: str = "run_id", command: str = "command", ts: str = "ts", seq: str = "event_id") -> DataFrame:
    return control_fold(by, command, ts, seq).stream(stream)


def drain_fold(by: str = "run_id", command: str = "command", ts: str = "ts", seq: str = "event_id", drain: str = "drain") -> Fold:
    """The queue of commands of each key: a ``drain`` row takes all commands since the one before, in order; ``drained`` is null for
    other rows and empty where nothing waits. Commands that no drain takes stay in the key's state."""

    def step(value: tuple, row: dict):
        queue = list(value[0])
        if row["command"] == drain:
            return ([],), (int(row["seq"]), queue)
        return ([*queue, row["command"]],), (int(row["seq"]), None)

    return Fold(by, seq, {"command": ("string", F.col(command))}, f"{seq} long, drained array<string>", "queue array<string>", ([],), step, ts)


def stream_drain(stream: DataFrame, by: str = "run_id", command: str = "command", ts: str = "ts", seq: str = "event_id", drain: str = "drain") -> DataFrame:
    return drain_fold(by, command, ts, seq, drain).stream(stream)


def circuit_fold(by: str = "backend", ok: str = "ok", ts: str = "ts", seq: str = "call_id", fails: int = 5, cooldown: float = 30.0) -> Fold:
    """Breaker state after each call: open after consecutive failures, half-open after the cooldown of event time, closed by a success. A null ``ok`` is a failure."""

    def step(value: tuple, row: dict):
        streak, opened, state = value
        at = row["time"] / 1e6
        if state == "open" and at - opened >= cooldown:
            state = "half_open"
        if row["ok"]:
            streak, state = 0, "closed"
        else:
            streak += 1
            if state == "half_open" or streak >= fails:
                opened, state = (at if state != "open" else opened), "open"
        return (streak, opened, state), (int(row["seq"]), streak, state)

    return Fold(by, seq, {"ok": ("boolean", F.coalesce(F.col(ok), F.lit(False)))}, f"{seq} long, streak long, state string", "streak long, opened double, state string", (0, 0.0, "closed"), step, ts)


def stream_circuit(stream: DataFrame, by: str = "backend", ok: str = "ok", ts: str = "ts", seq: str = "call_id", fails: int = 5, cooldown: float = 30.0) -> DataFrame:
    return circuit_fold(by, ok, ts, seq, fails, cooldown).stream(stream)


def budget_fold(per_generation: int, total: int, by: str = "run_id", generation: str = "generation", ts: str = "ts", seq: str = "call_id") -> Fold:
    """Calls so far in the generation and in all, and whether one exceeds its budget (0: none). Generations come in order in each run; a null one is -1."""

    def step(value: tuple, row: dict):
        now, used, everything = value
        used = used + 1 if row["generation"] == now else 1
        everything += 1
        over = bool(per_generation and used > per_generation or total and everything > total)
        return (int(row["generation"]), used, everything), (int(row["seq"]), used, everything, over)

    columns = {"generation": ("long", F.coalesce(F.col(generation).cast("long"), F.lit(-1)))}
    return Fold(by, seq, columns, f"{seq} long, used long, total long, over boolean", "generation long, used long, total long", (-(2**62), 0, 0), step, ts)


def stream_budget(stream: DataFrame, per_generation: int, total: int, by: str = "run_id", generation: str = "generation", ts: str = "ts", seq: str = "call_id") -> DataFrame:
    return budget_fold(per_generation, total, by, generation, ts, seq).stream(stream)


def plateau_fold(by: str = "run_id", i: str = "i", v: str = "v", patience: int = 15, delta: float = 0.001, first: int = 0) -> Fold:
    """The plateau monitor over steps numbered from ``first``; a null value is no gain."""

    def step(value: tuple, row: dict):
        best, waited, some = value
        x = row["v"]
        if x is not None and (not some or (x - best) / max(abs(best), 1e-12) > delta):
            best, waited, some = float(x), 0, True
        else:
            waited += 1
        return (best, waited, some), (int(row["seq"]), best, waited, waited >= patience)

    return Fold(by, i, {"v": ("double", F.col(v))}, f"{i} long, accepted double, waited long, converged boolean", "best double, waited long, some boolean", (0.0, 0, False), step, first=first)


def stream_plateau(stream: DataFrame, by: str = "run_id", i: str = "i", v: str = "v", patience: int = 15, delta: float = 0.001, first: int = 0) -> DataFrame:
    return plateau_fold(by, i, v, patience, delta, first).stream(stream)


def stream_last_n(stream: DataFrame, n: int, by: str = "name", ts: str = "ts", seq: str = "event_id", watermark: str = WATERMARK) -> DataFrame:
    """After each batch the newest n event ids of every key it touched, newest first; the state holds no more than n. Rows without a time stay out."""
    kind = stream.schema[by].dataType.simpleString()

    def run(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterable[pd.DataFrame]:
        if held.hasTimedOut:
            held.remove()
            return
        ids, times = held.get if held.exists else ([], [])
        rows = list(zip(times, ids, strict=True))
        for batch in batches:  # never more than n rows and one batch
            batch = batch[batch["time"].notna()]
            rows = sorted([*rows, *((int(t), int(k)) for t, k in zip(batch["time"], batch[seq], strict=True))], reverse=True)[:n]
        held.update(([k for _, k in rows], [t for t, _ in rows]))
        held.setTimeoutTimestamp(max(rows[0][0] // 1000 if rows else 0, held.getCurrentWatermarkMs()) + STATE_TTL)
        yield pd.DataFrame({by: [key[0]], "newest": [[k for _, k in rows]]})

    out, state = f"`{by}` {kind}, newest array<long>", "ids array<long>, times array<long>"
    rows = stream.withWatermark(ts, watermark).select(by, ts, F.unix_micros(ts).alias("time"), F.coalesce(F.col(seq).cast("long"), F.lit(-1)).alias(seq))
    return rows.groupBy(by).applyInPandasWithState(run, out, state, "update", GroupStateTimeout.EventTimeTimeout)


def stream_dedupe(stream: DataFrame, key: str, ts: str = "ts", watermark: str = WATERMARK) -> DataFrame:
    return stream.withWatermark(ts, watermark).dropDuplicatesWithinWatermark([key])


def table_stream(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A parquet table as a stream of its files."""
    schema = spark.read.parquet(f"{sf_dir}/{table}.parquet").schema
    glob = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{table}.parquet")
    folder = glob.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(glob).isDirectory()
    reader = spark.readStream.schema(schema)
    return reader.parquet(f"{sf_dir}/{table}.parquet") if folder else reader.option("pathGlobFilter", f"{table}.parquet").parquet(sf_dir)


def run_fold(fold: Fold, df: DataFrame, slices: int = 3, skew: int = 300) -> DataFrame:
    """A fold over a table that arrives slice by slice in files, each a run of the stream with one checkpoint, and the rest at the end.

    Slices follow the times, but rows come up to ``skew`` seconds late, over the borders of slices too (without times: in the order of a digest).
    There are ``slices`` of them, or as many as leave about SLICE_ROWS in each, so that what waits in the state doesn't grow with
    the table. All are written at once; each is moved to the stream in its turn.
    """
    spark = df.sparkSession
    staged, source, out, state = (scratch_path(spark, name) for name in ("staged", "source", "stream", "checkpoint"))
    digest = F.pmod(F.xxhash64(fold.by, fold.seq), F.lit(max(1, skew)))
    late = F.unix_seconds(fold.ts) + digest if fold.ts else digest
    share = max(slices, -(-df.count() // SLICE_ROWS))
    borders = df.select(late.alias("at")).agg(F.percentile_approx("at", [k / share for k in range(1, share)], 10_000)).first()[0] if share > 1 else None
    mine = F.size(F.filter(F.array(*map(F.lit, sorted(set(borders)))), lambda x: x < late)) if borders else F.lit(0)
    df.withColumn("_slice", F.coalesce(mine, F.lit(0))).withColumn("_slice", F.greatest("_slice", F.lit(0))).write.partitionBy("_slice").parquet(staged)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    files = path(staged).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for k in range(share):
        if files.exists(path(f"{staged}/_slice={k}")):
            files.mkdirs(path(source))
            if not files.rename(path(f"{staged}/_slice={k}"), path(f"{source}/slice{k}")):
                raise OSError(f"slice {k} could not be moved from {staged} to {source}")
        elif k:
            continue
        else:
            df.limit(0).write.parquet(f"{source}/slice0")
        stream = fold.stream(spark.readStream.schema(df.schema).option("recursiveFileLookup", True).parquet(source))
        query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
        query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out).unionByName(fold.rest(spark, state))


def run_once(stream: DataFrame, mode: str = "append", partitions: int | None = None) -> DataFrame:
    """Run a stream over what is there and read its output table: all rows, or those of the last batch in complete mode."""
    spark = stream.sparkSession
    out, state = scratch_path(spark, "stream"), scratch_path(spark, "checkpoint")

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("_batch", F.lit(batch_id)).write.mode("append").parquet(out)

    query = stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", state).trigger(availableNow=True).start()
    query.awaitTermination()
    rows = spark.read.schema(stream.schema.add("_batch", "long")).parquet(out)
    if mode == "complete":
        rows = rows.filter(F.col("_batch") == rows.agg(F.max("_batch")).first()[0])
    return rows.drop("_batch")
