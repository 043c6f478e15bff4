"""Ordered quality gates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from selectra.operators.stats import Invariant, invariant_score

PASS, FAIL, RETRY = "PASS", "FAIL", "RETRYABLE_FAIL"
#: A gate: name and a status column (PASS, FAIL or RETRYABLE_FAIL).
Gate = tuple[str, Column]


def gate(name: str, passes: Column, retryable: bool = False) -> Gate:
    """A gate from a condition; a null condition fails."""
    return (name, F.when(F.coalesce(passes, F.lit(False)), PASS).otherwise(RETRY if retryable else FAIL))


def run_gates(df: DataFrame, gates: Sequence[Gate]) -> DataFrame:
    """Adds stages (those executed, in order) and decision: promote, reject or retry.

    Cheap gates should come first; a later gate is not evaluated where an earlier one failed.
    """
    status: list[Column] = []
    failed = F.lit(False)
    for _, test in gates:
        status.append(F.when(~failed, test))
        failed = failed | (F.coalesce(status[-1], F.lit(PASS)) != PASS)
    stages = F.array_compact(F.array(*[F.when(s.isNotNull(), F.struct(F.lit(name).alias("name"), s.alias("status"))) for (name, _), s in zip(gates, status, strict=True)]))
    out = df.withColumn("stages", stages)
    last = F.element_at("stages", -1)["status"] if gates else F.lit(PASS)
    return out.withColumn("decision", F.when(last == FAIL, "reject").when(last == RETRY, "retry").otherwise("promote"))


def insert_gate(gates: Sequence[Gate], after: str, new: Gate, enabled: bool = True) -> list[Gate]:
    """The gates with ``new`` behind the one named, or at the end if there is none."""
    if not enabled:
        return list(gates)
    names = [name for name, _ in gates]
    at = names.index(after) + 1 if after in names else len(gates)
    return [*gates[:at], new, *gates[at:]]


def validation_gate(df: DataFrame, invariants: Sequence[Invariant], name: str = "validation") -> tuple[DataFrame, Gate]:
    """Adds the invariant columns and gives the gate that needs all hard invariants."""
    return invariant_score(df, invariants), gate(name, F.col("invariants_hold"))


def retry_rejected(traces: DataFrame, gates: Sequence[Gate], parents: DataFrame, key: str, parent: str, payload: str) -> DataFrame:
    """Run the retry rows once more; those that fail again take their parent's payload and the reason retry_rejected."""
    kept = [c for c in traces.columns if c not in ("stages", "decision")]
    again = run_gates(traces.filter("decision = 'retry'").select(*kept), gates)
    again = again.withColumn("decision", F.when(F.col("decision") == "promote", "promote").otherwise("retry_rejected"))
    rows = traces.filter("decision <> 'retry'").unionByName(again)
    up = parents.select(F.col(key).alias(parent), F.col(payload).alias("_parent_payload"))
    out = rows.join(up, parent, "left")
    return out.withColumn(payload, F.when(F.col("decision") == "retry_rejected", F.coalesce("_parent_payload", payload)).otherwise(F.col(payload))).drop("_parent_payload")


def promotion_package(correct: DataFrame, equivalent: DataFrame, bench: DataFrame, key: str) -> DataFrame:
    """promotable = correct, equivalent and benchmarked without error; the inputs bring one row per key."""
    out = correct.join(equivalent, key, "left").join(bench, key, "left")
    ok = F.coalesce(F.col("all_passed"), F.lit(False)) & F.coalesce(F.col("equivalent"), F.lit(False)) & F.col("p50").isNotNull()
    return out.withColumn("promotable", ok)
