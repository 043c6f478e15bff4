"""Column expressions over text: keys, screening rules, tags, notes and context."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# Severities in rising order.
SEVERITY = ["none", "low", "medium", "high", "critical"]
# Profiles under which warnings block.
STRICT = ("hotfix", "release")
# Fixed values: (level, pattern, label) rules for program text; critical rules block, info rules never do.
CODE_RULES = [
    ("critical", r"(?i)\bexec\s*\(", "exec call"),
    ("critical", r"(?i)\beval\s*\(", "eval call"),
    ("critical", r"(?i)\bos\.system\s*\(", "os.system call"),
    ("critical", r"(?i)\bos\.popen\s*\(", "os.popen call"),
    ("critical", r"(?i)\bsubprocess\.call\s*\(", "subprocess.call"),
    ("critical", r"(?i)\bsubprocess\.run\s*\(", "subprocess.run"),
    ("critical", r"(?i)\bsys\.exit\s*\(", "sys.exit call"),
    ("critical", r"(?i)\b__import__\s*\(", "__import__ call"),
    ("critical", r"(?i)\bimportlib\.import_module\s*\(", "import_module call"),
    ("critical", r"(?i)\bopen\s*\(.*['\"]w+", "open for writing"),
    ("critical", r"(?i)\bdelete\s+os\.", "delete os"),
    ("critical", r"(?i)\bremove\s+os\.", "remove os"),
    ("critical", r"(?i)\bshutil\.rmtree\s*\(", "rmtree call"),
    ("warning", r"(?i)\bassert\b", "assert statement"),
    ("warning", r"\braise\s+Exception\b", "generic Exception"),
    ("warning", r"\bexcept\s*:\s*$", "bare except"),
    ("warning", r"\bexcept\s*\(\s*\):", "bare except tuple"),
    ("warning", r"\bTODO\b", "TODO comment"),
    ("warning", r"\bFIXME\b", "FIXME comment"),
    ("warning", r"\bHACK\b", "HACK comment"),
    ("warning", r"\b# type:\s*ignore\b", "type: ignore comment"),
    ("warning", r"\bpass\b\s*$", "empty pass statement"),
    ("warning", r"\bprint\s*\(", "print statement"),
    ("info", r"\bglobal\s+\w+", "global keyword usage"),
    ("info", r"\b__dict__", "__dict__ access"),
    ("info", r"\bglobals\(\)", "globals() call"),
    ("info", r"\btime\.sleep\s*\(", "time.sleep call"),
    ("info", r"\binput\s*\(", "input() call"),
]
#: Rules of the same form for prose.
PROSE_RULES = [
    ("critical", r"[0-9]{16}", "card-like number"),
    ("critical", r"(?i)(secret|password|api[_-]?key)", "secret"),
    ("warning", r"[A-Za-z0-9._-]+@[A-Za-z0-9.-]+\.[a-z]+", "address"),
    ("warning", r"(?i)licen[sc]ed? under", "licence line"),
    ("info", r"[#*$%&|<>]{3}", "symbol run"),
    ("info", r"https?://", "link"),
]
# Fixed values: (pattern, tag) families.
TAG_RULES = [(r"(?i)(cache|memo)", "caching"), (r"\b(sum|map|filter|zip)\b", "functional"), (r"(?i)bit|<<|>>", "bits")]


def content_key(cols: Sequence[Column], salt: str | None = None, length: int = 64) -> Column:
    """SHA-256 of the parts joined by a bar, or of ``salt:text``; cut to ``length`` hex digits."""
    text = F.concat_ws("|", *[c.cast("string") for c in cols])
    return F.substring(F.sha2(text if salt is None else F.concat(F.lit(f"{salt}:"), text), 256), 1, length)


def canonical_key(text: Column) -> Column:
    """Key that ignores case, white space, numbers and names: numbers become 0 and words x."""
    flat = F.trim(F.regexp_replace(F.lower(text), r"[ \t\r\n]+", " "))
    return F.sha2(F.regexp_replace(F.regexp_replace(flat, r"[0-9]+", "0"), r"[a-z_]+", "x"), 256)


def screen_text(df: DataFrame, text: str, profile: str = "balanced", rules: Sequence[tuple[str, str, str]] = tuple(CODE_RULES)) -> DataFrame:
    """Adds issues (rule order), blocked and severity."""
    col = F.coalesce(F.col(text), F.lit(""))
    hit = {k: F.rlike(col, F.lit(pattern)) for k, (_, pattern, _) in enumerate(rules)}
    issues = F.array_compact(F.array(*[F.when(hit[k], F.lit(f"{level}: {label}")) for k, (level, _, label) in enumerate(rules)]))
    any_of = lambda level: F.exists(F.col("issues"), lambda x: F.startswith(x, F.lit(f"{level}:")))
    strict = profile in STRICT
    out = df.withColumn("issues", issues)
    blocked = any_of("critical") | (any_of("warning") if strict else F.lit(False))
    severity = F.when(any_of("critical"), "critical").when(any_of("warning"), "high" if strict else "low").otherwise("none")
    return out.withColumn("blocked", blocked).withColumn("severity", severity)


def basic_checks(df: DataFrame, text: str, max_lines: int = 500) -> DataFrame:
    """Adds basic_issue, basic_blocked and basic_severity: empty is critical, too many lines high."""
    body = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"^[ \t\r\n]+|[ \t\r\n]+$", "")
    lines = F.size(F.split(body, "\n"))
    issue = F.when(body == "", F.lit("empty text")).when(lines > max_lines, F.concat(F.lit(f"text exceeds {max_lines} lines ("), lines.cast("string"), F.lit(" lines)")))
    severity = F.when(body == "", "critical").when(lines > max_lines, "high").otherwise("none")
    return df.withColumn("basic_issue", issue).withColumn("basic_severity", severity).withColumn("basic_blocked", F.col("basic_severity") != "none")


def severity_rank(col: Column) -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in SEVERITY]), col).cast("int")


def rollup_report(checks: DataFrame, by: Sequence[str], order: str = "check_no") -> DataFrame:
    """One row per key from rows (by, order, blocked, issues, severity)."""
    rolled = checks.groupBy(*by).agg(
        F.max("blocked").alias("blocked"),
        F.array_sort(F.collect_list(F.struct(order, "issues"))).alias("_parts"),
        F.max(severity_rank(F.col("severity"))).alias("_rank"),
    )
    severity = F.element_at(F.array(*[F.lit(s) for s in SEVERITY]), F.col("_rank"))
    return rolled.select(*by, "blocked", F.flatten("_parts.issues").alias("issues"), severity.alias("severity"))


def triage(df: DataFrame, rules: Sequence[tuple[Column, str]], skip: tuple[Column, str] | None = None) -> DataFrame:
    """Adds reasons and recommendation: deep without reasons, skip if the skip rule holds, else fast."""
    all_rules = [*rules, *([skip] if skip else [])]
    reasons = F.array_compact(F.array(*[F.when(test, F.lit(reason)) for test, reason in all_rules]))
    out = df.withColumn("reasons", reasons)
    first = F.when(F.coalesce(skip[0], F.lit(False)), "skip") if skip else F.when(F.lit(False), "skip")
    return out.withColumn("recommendation", first.when(F.size("reasons") == 0, "deep").otherwise("fast"))


def line_diff_stats(pairs: DataFrame, before: str, after: str) -> DataFrame:
    """Distinct lines added and removed, as sets."""
    a, b = F.split(F.col(before), "\n"), F.split(F.col(after), "\n")
    out = pairs.withColumn("added", F.size(F.array_except(b, a))).withColumn("removed", F.size(F.array_except(a, b)))
    return out.withColumn("net", F.col("added") - F.col("removed"))


def _middle(a: Sequence[int], b: Sequence[int]) -> tuple[int, int, int, int]:
    """The middle run of equal lines (from x, y to u, v) of a shortest edit script, searched from both ends at once."""
    n, m = len(a), len(b)
    skew, ahead, back = n - m, {1: 0}, {1: 0}
    for d in range((n + m + 1) // 2 + 1):
        for far, near, turned in ((ahead, back, False), (back, ahead, True)):
            for k in range(-d, d + 1, 2):
                x = far[k + 1] if k == -d or k != d and far[k - 1] < far[k + 1] else far[k - 1] + 1
                start = x
                while x < n and x - k < m and (a[-1 - x] == b[-1 - x + k] if turned else a[x] == b[x - k]):
                    x += 1
                far[k] = x
                meets = near.get(skew - k) if abs(skew - k) <= (d if turned else d - 1) else None
                if meets is not None and (skew % 2 == 0) == turned and x + meets >= n:
                    return (n - x, m - x + k, n - start, m - start + k) if turned else (start, start - k, x, x - k)
    raise AssertionError("two sequences always have a script")


def edit_script(a: Sequence[int], b: Sequence[int]) -> list[tuple[int, int, int, int]]:
    """A shortest edit script in memory that follows the lengths: a[i:j] gives way to b[k:l], in order."""
    same, todo = [(len(a), len(b))], [(0, len(a), 0, len(b))]
    while todo:
        i, j, k, l = todo.pop()
        while i < j and k < l and a[i] == b[k]:
            same.append((i, k))
            i, k = i + 1, k + 1
        while i < j and k < l and a[j - 1] == b[l - 1]:
            j, l = j - 1, l - 1
            same.append((j, l))
        if i < j and k < l:
            x, y, u, v = _middle(a[i:j], b[k:l])
            same += zip(range(i + x, i + u), range(k + y, k + v), strict=True)
            todo += [(i, i + x, k, k + y), (i + u, j, k + v, l)]
    hunks, i, k = [], 0, 0
    for x, y in sorted(same):
        if (i, k) != (x, y):
            hunks.append((i, x, k, y))
        i, k = x + 1, y + 1
    return hunks


def line_diff(pairs: DataFrame, before: str, after: str) -> DataFrame:
    """Adds the shortest edit script over lines: hunks (at, removed, added), where ``at`` counts lines of the first text from 0, and the lines added and removed.

    Null texts have no lines; an empty text is one empty line.
    """
    names = [c for c in pairs.columns if c not in ("hunks", "n_added", "n_removed")]
    rows = pairs.select(*names)
    schema = StructType(rows.schema.fields + StructType.fromDDL("hunks array<struct<at:int,removed:array<string>,added:array<string>>>, n_added int, n_removed int").fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("at", pa.int32()), ("removed", pa.list_(pa.string())), ("added", pa.list_(pa.string()))]))
        for batch in batches:
            found = []
            for one, two in zip(batch.column(names.index(before)).to_pylist(), batch.column(names.index(after)).to_pylist(), strict=True):
                a, b = ([] if t is None else t.split("\n") for t in (one, two))
                number: dict[str, int] = {}
                coded = [[number.setdefault(x, len(number)) for x in side] for side in (a, b)]
                found.append([{"at": i, "removed": a[i:j], "added": b[k:l]} for i, j, k, l in edit_script(*coded)])
            counts = [pa.array([sum(len(h[side]) for h in hunks) for hunks in found], pa.int32()) for side in ("added", "removed")]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, kind), *counts], schema.names)

    return rows.mapInArrow(run, schema)


def change_notes(pairs: DataFrame, before: str, after: str, keyword: str = "cache", token: str = "return") -> DataFrame:
    """Notes on a fifth fewer lines, a new keyword and more of a token; a fallback note without any."""
    a, b = F.col(before), F.col(after)
    lines = lambda c: F.size(F.split(c, "\n"))
    notes = F.array_compact(F.array(
        F.when(lines(b) < lines(a) * 0.8, F.concat(F.lit("reduction: "), lines(a).cast("string"), F.lit(" -> "), lines(b).cast("string"), F.lit(" lines"))),
        F.when(F.contains(F.lower(b), F.lit(keyword)) & ~F.contains(F.lower(a), F.lit(keyword)), F.lit(f"added {keyword}")),
        F.when(F.regexp_count(b, F.lit(token)) > F.regexp_count(a, F.lit(token)), F.lit(f"more {token}")),
    ))
    return pairs.withColumn("notes", F.when(F.size(notes) == 0, F.array(F.lit("not analysed"))).otherwise(notes))


def pattern_tags(df: DataFrame, text: str, rules: Sequence[tuple[str, str]] = tuple(TAG_RULES), out: str = "tags") -> DataFrame:
    return df.withColumn(out, F.array_compact(F.array(*[F.when(F.rlike(F.col(text), F.lit(p)), F.lit(t)) for p, t in rules])))


def compose_context(df: DataFrame, sections: Sequence[tuple[str, str, int | None]], fallback: str = "[empty document]", out: str = "context") -> DataFrame:
    """Non-empty sections (header, column, most characters) joined by blank lines."""
    parts = []
    for header, name, most in sections:
        body = F.col(name).cast("string")
        cut = body if most is None else F.substring(body, 1, most)
        parts.append(F.when(F.trim(F.coalesce(body, F.lit(""))) != "", F.concat(F.lit(f"[{header}]\n"), cut)))
    joined = F.concat_ws("\n\n", *parts)
    return df.withColumn(out, F.when(joined == "", F.lit(fallback)).otherwise(joined))


def tokens(text: Column) -> Column:
    """Lower-case tokens between white space, empty ones dropped."""
    return F.filter(F.split(F.lower(text), r"[ \t\r\n]+"), lambda t: t != "")


def counted(text: Column, features: Mapping[str, str]) -> dict[str, Column]:
    """Occurrences of each pattern, by name."""
    return {name: F.regexp_count(text, F.lit(pattern)) for name, pattern in features.items()}
