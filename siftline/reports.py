"""Tables as text: metric comparisons, lint findings, failures, run summaries. All rows are shown, so a report is as long as its table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

def text_table(rows: Sequence[dict], columns: Sequence[str] | None = None) -> str:
    """Aligned columns; no rows give an empty text."""
    if not rows:
        return ""
    columns = list(columns or rows[0])
    cells = [columns] + [["" if r[c] is None else f"{r[c]:.4f}" if isinstance(r[c], float) else str(r[c]) for c in columns] for r in rows]
    widths = [max(len(r[i]) for r in cells) for i in range(len(columns))]
    return "\n".join("  ".join(x.ljust(w) for x, w in zip(r, widths)).rstrip() for r in cells)


def markdown(rows: Sequence[dict], columns: Sequence[str] | None = None) -> str:
    if not rows:
        return ""
    columns = list(columns or rows[0])
    lines = ["| " + " | ".join(columns) + " |", "|" + "---|" * len(columns)]
    return "\n".join(lines + ["| " + " | ".join("" if r[c] is None else str(r[c]) for c in columns) + " |" for r in rows])


def collect(df: DataFrame, order: Sequence[str] = ()) -> list[dict]:
    """All rows; they come to the driver partition by partition."""
    return [r.asDict(recursive=True) for r in (df.orderBy(*order) if order else df).toLocalIterator()]


def lint_text(found: DataFrame) -> tuple[str, int]:
    """All findings' counts and all findings; and the number of errors."""
    counts = {(r.severity, r.rule): r["count"] for r in found.groupBy("severity", "rule").count().collect()}
    errors = sum(n for (s, _), n in counts.items() if s == "error")
    shown = collect(found, ("severity", "line", "rule"))
    lines = [f"{s.upper():7} {rule}: {n}" for (s, rule), n in sorted(counts.items())]
    lines += [f"{r['severity'].upper():7} line {r['line']}: {r['rule']} {r['detail'] or ''}".rstrip() for r in shown]
    warnings = sum(counts.values()) - errors
    return "\n".join([*lines, f"{errors} errors, {warnings} warnings"]), errors


def charts(summary: DataFrame, sizes: DataFrame) -> DataFrame:
    """The data of two charts, accuracy by catalog size and by input tokens: ``(condition, n_shown, tokens, accuracy)``."""
    return summary.join(sizes, "condition", "left").selectExpr("condition", "n as n_shown", "mean_input_tokens as tokens", "accuracy")
