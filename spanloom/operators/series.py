"""Event-time cumulative series as DataFrame operators.

A sample at time t covers every event up to t, from the start of the range. A leaf is kept
as *sparse steps*: one row per (labels, bucket) that changes, made by one partial+final hash
aggregation. Dense samples appear only in the result. ``sum``, ``avg`` and ``count`` over
series work on the steps, so their cost does not grow with series x samples.

NULL stands for "no number" throughout; exports print it as NaN.
"""

from __future__ import annotations

import re
import time
from dataclasses import dataclass, replace
from datetime import datetime
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions.times import parse_instant, parse_step
from .aggregates import SUCCESS
from . import rollup as R
from .families import FAMILIES, LABEL_NAMES, Family
from .filters import first_rows, in_range

MAX_POINTS = 10_000
MAX_LOOKBACK_US = 366 * 24 * 3600 * 1_000_000
MAX_SERIES = 4_096
MAX_VALUES = 2_000_000

_BUCKET = "bucket"


class SeriesError(ValueError):
    """A request outside the supported operators or bounds."""


@dataclass(frozen=True)
class Grid:
    """Sample times start, start+step, … (``points`` of them), in microseconds."""

    start_us: int
    step_us: int
    points: int

    @property
    def end_us(self) -> int:
        return self.start_us + self.step_us * (self.points - 1)

    # Events that count: the range of an instant query ends at its only sample.
    lookback_us: int | None = None

    @property
    def first_us(self) -> int:
        return self.start_us if self.lookback_us is None else self.start_us - self.lookback_us


def range_grid(
    start: datetime | str | float | None = None,
    end: datetime | str | float | None = None,
    step: str | float | None = None,
) -> Grid:
    """Samples of a range query; the end is snapped down to the last sample."""
    now = int(time.time() * 1_000_000)
    hi = now if end is None else parse_instant(end)
    lo = max(now - 86_400_000_000, 0) if start is None else parse_instant(start)
    if hi < lo:
        raise SeriesError("end must be after or equal to start")
    if hi - lo > MAX_LOOKBACK_US:
        raise SeriesError("range cannot exceed 366 days")
    width = parse_step(step, lo, hi)
    points = (hi - lo) // width + 1
    if points > MAX_POINTS:
        raise SeriesError(f"range must contain between 1 and {MAX_POINTS} points")
    return Grid(lo, width, points)


def instant_grid(at: datetime | str | float | None = None, lookback_us: int | None = None) -> Grid:
    """The one sample of an instant query; it covers all events up to then, or those of the last ``lookback_us``."""
    t = int(time.time() * 1_000_000) if at is None else parse_instant(at)
    lookback = t if lookback_us is None else min(t, lookback_us)
    return Grid(t, max(lookback, 1_000_000), 1, lookback_us=lookback)


# ---------------------------------------------------------------- matchers

_PLAIN_ALTERNATIVES = re.compile(r"[\w:/@ -]+(\.[\w:/@ -]+)*(\|[\w:/@ -]+(\.[\w:/@ -]+)*)*")


@dataclass(frozen=True)
class Matcher:
    label: str
    op: str  # = != =~ !~
    value: str


def eq(label: str, value: str) -> Matcher:
    return Matcher(label, "=", value)


def ne(label: str, value: str) -> Matcher:
    return Matcher(label, "!=", value)


def matches(label: str, pattern: str) -> Matcher:
    return Matcher(label, "=~", pattern)


def not_matches(label: str, pattern: str) -> Matcher:
    return Matcher(label, "!~", pattern)


def _test(matcher: Matcher, column: Column, default: str | None) -> Column:
    """Test of one matcher on the raw column, in a shape the Parquet reader can use if any."""
    full = column if default is None else F.coalesce(column, F.lit(default))
    if matcher.op in ("=~", "!~"):
        try:
            re.compile(matcher.value)
        except re.error as exc:
            raise SeriesError(f"invalid regex for {matcher.label}") from exc
        # Whole-value match, as rlike alone would also accept a part.
        test = full.rlike(r"\A(?:" + matcher.value + r")\z")
        return test if matcher.op == "=~" else ~test
    if matcher.op == "!=":
        return full != matcher.value
    if matcher.op != "=":
        raise SeriesError(f"unsupported matcher: {matcher.op}")
    if default is not None and matcher.value == default:
        return column.isNull() | (column == default)
    return column == matcher.value


def _check_labels(family: Family, matchers: tuple[Matcher, ...]) -> None:
    for matcher in matchers:
        if matcher.label != "__name__" and matcher.label not in family.labels:
            raise SeriesError(f"metric {family.name} does not expose label {matcher.label}")


# ---------------------------------------------------------------- leaf rows


def _source_rows(family: Family, tables: dict[str, DataFrame], grid: Grid) -> DataFrame:
    """Rows of the family with observed_at, its labels' columns, and a weight of 1 row or more."""
    events = tables["events"]
    if family.source == "events":
        return _within(events, grid).withColumn("weight", F.lit(1))
    if family.source == "conflicts":
        # Counted per event before the join, so one heavily replayed id is one row in it.
        per_event = tables["conflicts"].groupBy("event_id").agg(F.count("*").alias("weight"))
        return _within(events, grid).select("event_id", "observed_at").join(per_event, "event_id")
    outcomes = tables["outcomes"].select(
        "event_id", "kind", "status", "evidence_source", "correlation_basis"
    )
    place = _within(events, grid).select(
        "event_id", "observed_at", "project_id", "repository", "branch"
    )
    return place.join(outcomes, "event_id").withColumn("weight", F.lit(1))


def _within(events: DataFrame, grid: Grid) -> DataFrame:
    return in_range(events, _iso(grid.first_us), _iso(grid.end_us))


def _iso(us: int) -> datetime:
    from datetime import timedelta, timezone

    return datetime(1970, 1, 1, tzinfo=timezone.utc) + timedelta(microseconds=us)


def _bucket(grid: Grid) -> Column:
    """Index of the first sample at or after the event; 1 ms of slack at a boundary."""
    if grid.points == 1:
        return F.lit(0)
    offset = F.unix_micros("observed_at") - F.lit(grid.start_us)
    index = F.floor((offset + F.lit(grid.step_us - 1000)) / F.lit(grid.step_us))
    return F.least(F.greatest(index, F.lit(0)), F.lit(grid.points - 1)).cast("int")


@dataclass(frozen=True)
class Leaf:
    family: Family
    tables: dict[str, DataFrame]
    matchers: tuple[Matcher, ...]
    grid: Grid

    @property
    def linear(self) -> bool:
        """Whether a sample is a running total (not a quotient of two)."""
        return self.family.aggregate in ("count", "sum", "flag")

    @property
    def stored(self) -> bool:
        """Whether stored minutes (``rollup`` among the tables) answer this leaf; else it reads events."""
        g = self.grid
        return "rollup" in self.tables and R.answers(self.family, g.start_us, g.step_us, g.first_us, g.points)

    def rows(self) -> DataFrame:
        family, columns = self.family, self.family.label_columns
        if self.stored:
            df = R.within(self.tables["rollup"], self.grid.first_us, self.grid.end_us)
        else:
            df = _source_rows(family, self.tables, self.grid)
        for matcher in self.matchers:
            if matcher.label == "__name__":
                df = df.where(_test(matcher, F.lit(family.name), None))
            else:
                name, default = columns[matcher.label]
                df = df.where(_test(matcher, F.col(name), default))
        if family.only is not None and not (self.stored and family.only[1] == (True,)):
            name, values = family.only
            df = df.where(F.col(name).isin(*values))
        return df

    def steps(self, by: tuple[str, ...] | None = None) -> DataFrame:
        """(labels…, bucket, num, den) of every change, grouped by ``by`` (default: all labels)."""
        labels = self.family.labels if by is None else by
        columns = self.family.label_columns
        keys = [
            F.coalesce(F.col(columns[l][0]), F.lit(columns[l][1])).alias(l) for l in labels
        ]
        if self.stored:
            g = self.grid
            num, den, keep = R.measure(self.family)
            df = self.rows().groupBy(*keys, R.sample(g.start_us, g.step_us, g.points).alias(_BUCKET)).agg(
                num.cast("double").alias("num"), den.cast("double").alias("den"), keep.alias("keep"))
            return df.where("keep").drop("keep")
        num, den, keep = self._measure()
        df = self.rows().groupBy(*keys, _bucket(self.grid).alias(_BUCKET)).agg(
            num.cast("double").alias("num"), den.cast("double").alias("den")
        )
        return df if keep is None else df.where(keep)

    def _measure(self) -> tuple[Column, Column, Column | None]:
        kind = self.family.aggregate
        if kind == "count":
            return F.sum("weight"), F.sum("weight"), None
        if kind == "flag":
            return F.count(F.when(F.col(self.family.value), True)), F.count("*"), None
        if kind == "ratio":
            return F.count(F.when(F.col("status").isin(*SUCCESS), True)), F.count("*"), None
        if kind in ("sum", "avg"):
            value = self.family.value
            return F.sum(value), F.count(value), F.col("den") > 0
        raise SeriesError(f"metric {self.family.name} has unsupported aggregate")


# ---------------------------------------------------------------- series sets


def _running(by: tuple[str, ...]):
    part = [F.col(l) for l in by] or [F.lit(0)]
    return Window.partitionBy(*part).orderBy(_BUCKET)


def _fill(steps: DataFrame, labels: tuple[str, ...], grid: Grid, before: Column, value: Column) -> DataFrame:
    """Carry each step's ``value`` forward to every sample until the next step.

    ``value`` is evaluated over the running window of its series, which holds at most
    ``points`` rows; samples before the first step take ``before``.
    """
    w = _running(labels)
    rows = steps.select(
        *labels,
        F.col(_BUCKET).alias("at"),
        value.alias("value"),
        F.when(F.lag(_BUCKET).over(w).isNull(), 0).otherwise(F.col(_BUCKET)).alias("lo"),
        (F.coalesce(F.lead(_BUCKET).over(w), F.lit(grid.points)) - 1).alias("hi"),
    )
    spread = rows.select(*labels, "at", "value", F.explode(F.sequence("lo", "hi")).alias(_BUCKET))
    return spread.select(
        *labels, _BUCKET, F.when(F.col(_BUCKET) < F.col("at"), before).otherwise(F.col("value")).alias("value")
    )


@dataclass(frozen=True)
class SeriesSet:
    """Long frame (labels…, bucket, value) with one row per series and sample."""

    labels: tuple[str, ...]
    grid: Grid
    dense: DataFrame | None = None
    leaf: Leaf | None = None

    # ---- frames

    @cached_property
    def frame(self) -> DataFrame:
        if self.dense is not None:
            return self.dense
        return self._dense_leaf(self.leaf.steps())

    def _dense_leaf(self, steps: DataFrame) -> DataFrame:
        w = _running(self.labels).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        if self.leaf.linear:
            return _fill(steps, self.labels, self.grid, F.lit(0.0), F.sum("num").over(w))
        value = F.sum("num").over(w) / F.sum("den").over(w)
        return _fill(steps, self.labels, self.grid, F.lit(None).cast("double"), value)

    def matrix(self, name: str | None = None) -> DataFrame:
        """Range result: labels…, sample time and value. ``name`` adds a metric name column."""
        at = (F.lit(self.grid.start_us) + F.col(_BUCKET) * F.lit(self.grid.step_us)).cast("bigint")
        extra = [] if name is None else [F.lit(name).alias("metric")]
        return self.frame.select(*extra, *self.labels, at.alias("sample_us"), "value")

    def packed(self) -> DataFrame:
        """One row per series with its samples in time order (at most ``points`` of them)."""
        pairs = F.array_sort(F.collect_list(F.struct(_BUCKET, "value")))
        at = lambda p: (F.lit(self.grid.start_us) + p[_BUCKET] * F.lit(self.grid.step_us)).cast("bigint")
        return (
            self.frame.groupBy(*self.labels).agg(pairs.alias("pairs"))
            .select(*self.labels, F.transform("pairs", lambda p: F.struct(
                at(p).alias("sample_us"), p["value"].alias("value"))).alias("samples"))
        )

    def vector(self) -> DataFrame:
        """Instant result: the last sample of each series."""
        last = self.frame.where(F.col(_BUCKET) == self.grid.points - 1)
        return last.select(*self.labels, F.lit(self.grid.end_us).alias("sample_us"), "value")

    # ---- aggregation over series

    def agg(self, function: str, by: tuple[str, ...] = ()) -> "SeriesSet":
        by = tuple(label for label in by if label in self.labels)
        if function not in ("sum", "avg", "max", "count"):
            raise SeriesError(f"unsupported aggregate: {function}")
        if self.leaf is not None:
            steps = self._grouped_steps(function, by)
            if steps is not None:
                return steps
        value = {"sum": F.sum, "avg": F.avg, "max": F.max, "count": F.count}[function]("value")
        dense = self.frame.groupBy(*by, _BUCKET).agg(value.cast("double").alias("value"))
        return SeriesSet(by, self.grid, dense=dense)

    def _grouped_steps(self, function: str, by: tuple[str, ...]) -> "SeriesSet | None":
        """The aggregate straight from steps, or None when only dense samples will do."""
        leaf, grid = self.leaf, self.grid
        w = _running(by).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        zero = F.lit(0.0)
        if leaf.linear and function == "sum":
            # Running totals add up: group by the wanted labels right away.
            dense = _fill(leaf.steps(by), by, grid, zero, F.sum("num").over(w))
            return SeriesSet(by, grid, dense=dense)
        if leaf.linear and function in ("avg", "count"):
            # Such a series has a number at every sample, so the number of series is constant.
            per_series = leaf.steps().groupBy(*self.labels).agg(F.min(_BUCKET).alias("first"))
            width = per_series.groupBy(*by).agg(F.count("*").cast("double").alias("n"))
            if function == "count":
                dense = width.select(
                    *by, F.explode(F.sequence(F.lit(0), F.lit(grid.points - 1))).alias(_BUCKET),
                    F.col("n").alias("value"),
                )
                if not by:
                    dense = dense.where(F.col("value") > 0)
                return SeriesSet(by, grid, dense=dense)
            total = _fill(leaf.steps(by), by, grid, zero, F.sum("num").over(w))
            if by:
                dense = total.join(width, list(by)).select(*by, _BUCKET, (F.col("value") / F.col("n")).alias("value"))
            else:
                n = width.select("n").scalar()
                dense = total.select(_BUCKET, (F.col("value") / n).alias("value"))
            return SeriesSet(by, grid, dense=dense)
        if function == "max":
            if not leaf.linear:
                return None
            # Totals never fall, so the largest total reached so far is the largest now.
            own = _running(self.labels).rowsBetween(Window.unboundedPreceding, Window.currentRow)
            reached = leaf.steps().select(*by, _BUCKET, F.sum("num").over(own).alias("num"))
            peaks = reached.groupBy(*by, _BUCKET).agg(F.max("num").alias("num"))
            dense = _fill(peaks, by, grid, zero, F.max("num").over(w))
            return SeriesSet(by, grid, dense=dense)
        # Quotient series: add up the changes of each series, and count those that have begun.
        own = _running(self.labels)
        upto = own.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        level = leaf.steps().select(
            *self.labels, _BUCKET, (F.sum("num").over(upto) / F.sum("den").over(upto)).alias("level")
        )
        change = level.select(
            *by, _BUCKET,
            (F.col("level") - F.coalesce(F.lag("level").over(own), zero)).alias("change"),
            F.when(F.lag(_BUCKET).over(own).isNull(), 1).otherwise(0).alias("began"),
        )
        sums = change.groupBy(*by, _BUCKET).agg(
            F.sum("change").alias("num"), F.sum("began").cast("double").alias("den")
        )
        nothing = F.lit(None).cast("double")
        if function == "sum":
            dense = _fill(sums, by, grid, nothing, F.sum("num").over(w))
        elif function == "avg":
            dense = _fill(sums, by, grid, nothing, F.sum("num").over(w) / F.sum("den").over(w))
        else:
            dense = _fill(sums, by, grid, zero, F.sum("den").over(w))
        return SeriesSet(by, grid, dense=dense)

    def sum(self, *by: str) -> "SeriesSet":
        return self.agg("sum", by)

    def avg(self, *by: str) -> "SeriesSet":
        return self.agg("avg", by)

    def max(self, *by: str) -> "SeriesSet":
        return self.agg("max", by)

    def count(self, *by: str) -> "SeriesSet":
        return self.agg("count", by)

    # ---- ranking, arithmetic, fallback

    def topk(self, k: int) -> "SeriesSet":
        """The k series with the largest last sample; ties by labels, missing numbers last."""
        if isinstance(k, bool) or not isinstance(k, int) or not 1 <= k <= 500:
            raise SeriesError("topk limit must be between 1 and 500")
        ranking = [F.desc_nulls_last("last"), *[F.asc(l) for l in sorted(self.labels)]]
        if self.leaf is not None:
            # Rank totals before any sample is filled in; both uses share one shuffle.
            steps = self.leaf.steps()
            last = F.sum("num") if self.leaf.linear else F.sum("num") / F.sum("den")
            best = steps.groupBy(*self.labels).agg(last.alias("last")).orderBy(*ranking).limit(k)
            kept = _keep(steps, best, self.labels)
            return replace(self, dense=self._dense_leaf(kept), leaf=None)
        best = (
            self.frame.where(F.col(_BUCKET) == self.grid.points - 1)
            .withColumnRenamed("value", "last").orderBy(*ranking).limit(k)
        )
        return replace(self, dense=_keep(self.frame, best, self.labels), leaf=None)

    def divide(self, divisor: "SeriesSet") -> "SeriesSet":
        """Quotient of equally labelled series; NULL where the divisor is 0 or a side is missing."""
        if set(self.labels) != set(divisor.labels):
            # Label sets that differ never match.
            empty = self.frame.where(F.lit(False))
            return SeriesSet(self.labels, self.grid, dense=empty)
        right = divisor.frame.withColumnRenamed("value", "bottom")
        joined = self.frame.join(right, [*self.labels, _BUCKET])
        value = F.try_divide("value", "bottom").alias("value")
        return SeriesSet(self.labels, self.grid, dense=joined.select(*self.labels, _BUCKET, value))

    def or_else(self, fallback: "SeriesSet") -> "SeriesSet":
        """This set if it has any series, else the whole ``fallback``."""
        labels = (*self.labels, *[l for l in fallback.labels if l not in self.labels])
        other = fallback.frame.where(~self.frame.exists())
        dense = self.frame.unionByName(other, allowMissingColumns=True)
        return SeriesSet(labels, self.grid, dense=dense.select(*labels, _BUCKET, "value"))

    def check_caps(self, max_series: int = MAX_SERIES, max_values: int = MAX_VALUES) -> "SeriesSet":
        """Raise when the result has more series or values than allowed (runs a bounded count)."""
        allowed = min(max_series, max_values // self.grid.points)
        last = self.frame.where(F.col(_BUCKET) == self.grid.points - 1)
        if last.limit(allowed + 1).count() > allowed:
            raise SeriesError(f"result exceeds {allowed} series of {self.grid.points} samples")
        return self


def _keep(df: DataFrame, best: DataFrame, labels: tuple[str, ...]) -> DataFrame:
    """Rows of the ranked series. ``best`` holds at most 500 rows, so it may be broadcast."""
    if not labels:
        return df
    return df.join(F.broadcast(best.select(*labels)), list(labels), "left_semi")


# ---------------------------------------------------------------- entry points


def series(
    family: str, tables: dict[str, DataFrame], grid: Grid, *matchers: Matcher,
) -> SeriesSet:
    """The series of one family under matchers, for a range or an instant grid."""
    definition = FAMILIES.get(family)
    if definition is None:
        raise SeriesError(f"unsupported metric: {family}")
    _check_labels(definition, matchers)
    return SeriesSet(
        definition.labels, grid, leaf=Leaf(definition, tables, tuple(matchers), grid)
    )


def range_matrix(
    family: str, tables: dict[str, DataFrame], start, end, step=None, *matchers: Matcher,
) -> DataFrame:
    return series(family, tables, range_grid(start, end, step), *matchers).matrix()


def instant_vector(family: str, tables: dict[str, DataFrame], at, *matchers: Matcher) -> DataFrame:
    return series(family, tables, instant_grid(at), *matchers).vector()


def zero_vector(spark: SparkSession, grid: Grid) -> SeriesSet:
    """One unlabelled series of zeros."""
    frame = spark.range(grid.points).select(
        F.col("id").cast("int").alias(_BUCKET), F.lit(0.0).alias("value")
    )
    return SeriesSet((), grid, dense=frame)


def scalar_query(spark: SparkSession, text: str, at) -> DataFrame:
    """A numeric literal at an instant, as one row."""
    if re.fullmatch(r"[+-]?(?:\d+(?:\.\d*)?|\.\d+)", text.strip()) is None:
        raise SeriesError(f"not a numeric literal: {text}")
    return spark.range(1).select(
        F.lit(instant_grid(at).end_us).alias("sample_us"), F.lit(float(text)).alias("value")
    )


def label_values(
    label: str, tables: dict[str, DataFrame], start, end, families: list[str] | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Distinct values of a label in the range; with a limit the first in order."""
    if label not in LABEL_NAMES or label == "__name__":
        raise SeriesError(f"unsupported label: {label}")
    grid = range_grid(start, end, max((parse_instant(end) - parse_instant(start)) / 1e6, 1.0))
    grid = replace(grid, points=1, start_us=parse_instant(end), lookback_us=parse_instant(end) - parse_instant(start))
    found: DataFrame | None = None
    seen: set = set()
    for name in families if families is not None else FAMILIES:
        family = FAMILIES.get(name)
        if family is None or label not in family.labels:
            continue
        # Families that read the same rows have the same values; scan those once.
        signature = (family.source, family.only)
        if signature in seen:
            continue
        seen.add(signature)
        column, default = family.label_columns[label]
        values = Leaf(family, tables, (), grid).rows().select(
            F.coalesce(F.col(column), F.lit(default)).alias("value")
        ).distinct()
        found = values if found is None else found.unionByName(values)
    if found is None:
        raise SeriesError(f"no family exposes label {label}")
    return first_rows(found.distinct(), limit, "value")


def series_list(
    tables: dict[str, DataFrame], start, end, *selectors: tuple[str, tuple[Matcher, ...]],
) -> DataFrame:
    """Distinct label sets of the selected families, with their metric name."""
    if not 1 <= len(selectors) <= 64:
        raise SeriesError("give between 1 and 64 selectors")
    lo, hi = parse_instant(start), parse_instant(end)
    if hi < lo or hi - lo > MAX_LOOKBACK_US:
        raise SeriesError("range must run forward and not exceed 366 days")
    grid = Grid(hi, max(hi - lo, 1_000_000), 1, lookback_us=hi - lo)
    out: DataFrame | None = None
    for name, matchers in selectors:
        leaf = series(name, tables, grid, *matchers)
        rows = leaf.leaf.steps().select(F.lit(name).alias("metric"), *leaf.labels)
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out.distinct()


def label_names(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(n,) for n in LABEL_NAMES], "label string")


def family_metadata(spark: SparkSession) -> DataFrame:
    rows = [(n, "gauge", "Event-time aggregate", "") for n in sorted(FAMILIES)]
    return spark.createDataFrame(rows, "name string, type string, help string, unit string")
