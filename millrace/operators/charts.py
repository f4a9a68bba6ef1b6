"""Rule-planned charts: which to draw, and the aggregated tables behind them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators.overview import bar_counts, lookup_column
from millrace.operators.stats import boxes, correlation_free_scatter, group_means, histogram


@dataclass(frozen=True)
class Chart:
    kind: str
    x: str
    y: str | None = None


def planned_charts(df: DataFrame, structural: list[tuple[str, str]], distinct: dict[str, int], covered: set[str] = frozenset()) -> list[Chart]:
    """The default charts; of a lookup table (each category once) the bars show its first number, whatever the number of categories."""
    charts = default_charts(structural, distinct, covered)
    drawn = {c.x for c in charts}
    for name, kind in structural:
        if name not in covered and name not in drawn and kind in ("categorical", "text", "identifier") and distinct.get(name, 0) <= 50 and lookup_column(df, name):
            charts.append(Chart("bar", name))
    return charts


def default_charts(structural: list[tuple[str, str]], distinct: dict[str, int], covered: set[str] = frozenset()) -> list[Chart]:
    """Pie up to 12 levels, bar up to 20, histogram for numbers, for columns that no chart covers yet."""
    out = []
    for name, kind in structural:
        if name in covered:
            continue
        if kind == "categorical" and distinct.get(name, 0) <= 20:
            out.append(Chart("pie" if distinct[name] <= 12 else "bar", name))
        elif kind == "numeric":
            out.append(Chart("histogram", name))
    return out


def chart_data(df: DataFrame, chart: Chart) -> DataFrame:
    """The chart's aggregated rows; values themselves never leave the cluster."""
    if chart.kind in {"bar", "pie"}:
        if chart.y:
            return group_means(df, F.col(chart.x), chart.y).orderBy("x")
        return bar_counts(df, chart.x)
    if chart.kind == "line":
        if chart.y:
            return group_means(df, F.col(chart.x), chart.y).orderBy("x")
        return df.where(F.col(chart.x).isNotNull()).groupBy(F.col(chart.x).alias("x")).agg(F.count(F.lit(1)).alias("n")).orderBy("x")
    if chart.kind == "histogram":
        return histogram(df, chart.x, 30)
    if chart.kind == "box":
        return boxes(df, chart.x, chart.y)
    if chart.kind == "scatter":
        return correlation_free_scatter(df, chart.x, chart.y)
    raise ValueError(f"no chart of kind {chart.kind}")
