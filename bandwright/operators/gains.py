"""Gains tables: score bands fixed on a baseline and counted on other samples."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bandwright.functions.banding import edges_below, edges_below_array, snap_up
from bandwright.functions.columns import finite, is_fractional, join_back, percent_text, share
from bandwright.operators.panel import with_in_time_total
from bandwright.operators.quantiles import exact_quantiles
from bandwright.operators.screening import cut_range, tally

DOMAIN = (0, 1000)
# Edges are compared with whole scores; interpolation noise is cut off first.
EDGE_DIGITS = 9


@dataclass(frozen=True)
class Segment:
    """A named subset of rows; a null condition is not a member."""

    name: str
    condition: Column


def gains_table(
    df: DataFrame,
    target: str,
    scores: Mapping[str, str] | Sequence[str],
    sample: str = "sample",
    baseline: str = "dev",
    q: int = 10,
    segments: Sequence[Segment] = (),
    in_time_total: bool = False,
    zero_in_first: bool = False,
) -> DataFrame:
    """Quantile gains tables for every (segment, score, sample) in one job.

    The edges of a (segment, score) are the q-quantiles of its own `baseline`
    rows, with 0 and 1000 as outer edges; equal edges merge. A row falls in band
    lo < score <= hi. Rows outside all bands (score 0 unless `zero_in_first`,
    beyond 1000, missing) are counted in one row with a null band, and every
    band is listed even when empty.

    Quantiles are those of the raw scores; only their outer edges are replaced, so
    that scores beyond the domain still move the inner edges they should.

    Rows are reduced to a histogram over (segment memberships, sample, score)
    before anything is repeated per segment or sample. Whole scores give one point
    per different score; fractional ones are snapped to the exact edges first.
    """
    named = dict(scores) if isinstance(scores, Mapping) else {s: s for s in scores}
    segments = list(segments)
    flags = [f"__in{i}" for i in range(len(segments))]
    columns = {n: f"__s{i}" for i, n in enumerate(named)}
    raw = any(is_fractional(df, c) for c in named.values())
    flagged = df.select(
        F.col(sample).alias("sample"), F.col(target).alias("__y"),
        *[F.coalesce(s.condition, F.lit(False)).alias(f) for s, f in zip(segments, flags)],
        *[finite(named[n]).alias(c) for n, c in columns.items()],
    )
    steps = [i / q for i in range(q + 1)]
    if raw:
        edges = _quantile_edges(flagged, columns, segments, flags, baseline, steps)
        for name, column in columns.items():
            cuts = {e for r in edges if r[1] == name for e in r[2]}
            flagged = flagged.withColumn(column, _in_domain(column))
            flagged = snap_up(flagged, column, [DOMAIN[0] - 1, *DOMAIN, *cuts])
            flagged = flagged.withColumn(column, F.least(F.col(column), F.lit(DOMAIN[1] + 1.0)))
        hist = _per_segment(_histogram(flagged, columns, flags), segments, flags)
        edge_frame = df.sparkSession.createDataFrame(
            edges, "segment string, score_name string, edges array<double>"
        )
    else:
        hist = _per_segment(_histogram(flagged, columns, flags), segments, flags)
        # Conditional, not filtered: a filter would reach the scan and the histogram
        # would be built twice.
        based = F.when(F.col("sample") == baseline, F.col("x"))
        probs = F.array(*[F.lit(p) for p in steps])
        edge_frame = hist.groupBy("segment", "score_name").agg(
            F.coalesce(
                _domain_edges(F.percentile(based, probs, F.col("n"))),
                F.array(*[F.lit(float(d)) for d in DOMAIN]),
            ).alias("edges")
        )
    if in_time_total:
        hist = with_in_time_total(hist)
    table = _gains(hist, edge_frame, zero_in_first)
    return table if segments else table.drop("segment")


def _in_domain(column: str) -> Column:
    """The score, with everything below 0 as -1 and beyond 1000 as 1001."""
    x = F.col(column)
    low, high = DOMAIN
    return F.when(x < low, low - 1.0).when(x > high, high + 1.0).otherwise(x)


def _histogram(flagged: DataFrame, columns: Mapping[str, str], flags: Sequence[str]) -> DataFrame:
    """(sample, memberships, score_name, x, good, bad, n)."""
    pairs = [
        F.struct(F.lit(n).alias("score_name"), F.col(c).alias("x")) for n, c in columns.items()
    ]
    long = flagged.select("sample", *flags, "__y", F.inline(F.array(*pairs)))
    return tally(long.groupBy("sample", *flags, "score_name", "x"), "__y")


def _per_segment(hist: DataFrame, segments: Sequence[Segment], flags: Sequence[str]) -> DataFrame:
    """Repeat histogram rows for the overall table and each segment they belong to."""
    members = F.array(
        F.lit("all"), *[F.when(F.col(f), F.lit(s.name)) for s, f in zip(segments, flags)]
    )
    repeated = hist.withColumn("segment", F.explode(F.filter(members, lambda m: m.isNotNull())))
    return repeated.drop(*flags)


def _quantile_edges(flagged, columns, segments, flags, baseline, steps):
    """Edges per (segment, score): report-sized, used to snap raw scores.

    One conditional column per pair, so a single pass serves every segment.
    """
    members = {"all": F.lit(True)} | {s.name: F.col(f) for s, f in zip(segments, flags)}
    pairs = {(s, n): f"__q{i}" for i, (s, n) in enumerate(product(members, columns))}
    wide = flagged.filter(F.col("sample") == baseline).select(
        *[F.when(members[s], F.col(columns[n])).alias(c) for (s, n), c in pairs.items()]
    )
    found = exact_quantiles(wide, list(pairs.values()), steps)
    edges = {
        r["variable"]: r["edges"]
        for r in found.select("variable", _domain_edges(F.col("quantiles")).alias("edges")).collect()
    }
    plain = [float(d) for d in DOMAIN]
    return [(s, n, edges.get(c) or plain) for (s, n), c in pairs.items()]


def _domain_edges(quantiles: Column) -> Column:
    """Inner quantiles inside the score domain, with its ends as outer edges, ascending."""
    low, high = (F.lit(float(d)) for d in DOMAIN)
    inner = F.slice(quantiles, 2, F.greatest(F.size(quantiles) - 2, F.lit(0)))
    inner = F.transform(inner, lambda e: F.round(e, EDGE_DIGITS))
    inner = F.filter(inner, lambda e: (e > low) & (e < high))
    return F.array_sort(F.array_distinct(F.concat(F.array(low), inner, F.array(high))))


def _gains(hist: DataFrame, edges: DataFrame, zero_in_first: bool) -> DataFrame:
    keys = ["segment", "score_name", "sample"]
    below = edges_below_array(F.col("x"), F.col("edges"))
    band = F.when((below >= 1) & (below < F.size("edges")), below)
    if zero_in_first:
        band = F.when(F.col("x") == DOMAIN[0], F.lit(1)).otherwise(band)
    joined = join_back(hist, edges, ["segment", "score_name"]).withColumn("band", band)
    counted = joined.groupBy(*keys, "edges", "band").agg(*_sums())
    rows = _every_band(counted, [*keys, "edges"], F.size("edges") - 1)
    # One table is a dozen rows.
    order = Window.partitionBy(*keys).orderBy("band").rowsBetween(Window.unboundedPreceding, 0)
    banded = F.col("band").isNotNull()

    def running(name: str) -> Column:
        return F.when(banded, F.sum(F.when(banded, F.col(name))).over(order))

    total = F.col("good") + F.col("bad")
    out = rows.select(
        *keys, "band", _range_text().alias("range"), "good", "bad", total.alias("total"),
        share(F.col("good"), F.col("all_good")).alias("pct_good"),
        share(F.col("bad"), F.col("all_bad")).alias("pct_bad"),
        share(total, F.col("all_good") + F.col("all_bad")).alias("pct_total"),
        share(running("good"), F.col("all_good")).alias("cum_good"),
        share(running("bad"), F.col("all_bad")).alias("cum_bad"),
    )
    return out.withColumn("ks", F.bround(F.col("cum_bad") - F.col("cum_good"), 4) * 100)


def _sums() -> list[Column]:
    return [F.sum(c).alias(c) for c in ("good", "bad", "n")]


def _every_band(counted: DataFrame, keys: Sequence[str], bands: Column) -> DataFrame:
    """One row per band 1..`bands`, plus the null band if present, with table totals."""
    # A table has at most bands + 1 cells.
    tables = counted.groupBy(*keys).agg(
        F.collect_list(F.struct("band", "good", "bad", "n")).alias("cells"),
        *[F.sum(c).alias(f"all_{c}") for c in ("good", "bad", "n")],
    )
    unbanded = F.filter(F.transform("cells", lambda c: c["band"]), lambda b: b.isNull())
    listed = tables.withColumn("band", F.explode(F.concat(F.sequence(F.lit(1), bands), unbanded)))
    cell = F.get(F.filter("cells", lambda c: c["band"].eqNullSafe(F.col("band"))), F.lit(0))
    zero = F.lit(0).cast("bigint")
    return listed.select(
        *keys, "band", *[F.coalesce(cell[c], zero).alias(c) for c in ("good", "bad", "n")],
        "all_good", "all_bad", "all_n",
    )


def _range_text() -> Column:
    low, high = (F.lit(str(d)) for d in DOMAIN)
    b, edges = F.col("band"), F.col("edges")
    lo = F.when(b == 1, low).otherwise(F.round(F.get(edges, b - 1), 2).cast("string"))
    hi = F.when(b == F.size(edges) - 1, high).otherwise(F.round(F.get(edges, b), 2).cast("string"))
    return F.when(b.isNotNull(), F.concat(F.lit("("), lo, F.lit("-"), hi, F.lit(")")))


def formatted(table: DataFrame) -> DataFrame:
    """The report form: shares as percent text (presentation only)."""
    shares = [c for c in ("pct_good", "pct_bad", "pct_total", "cum_good", "cum_bad") if c in table.columns]
    return table.withColumns({c: percent_text(F.col(c)) for c in shares})


def max_ks(table: DataFrame) -> DataFrame:
    """Largest signed KS per table."""
    keys = [c for c in ("segment", "score_name", "sample") if c in table.columns]
    return table.groupBy(*keys).agg(F.max("ks").alias("max_ks"))


def banded_gains(
    baseline: DataFrame,
    df: DataFrame,
    column: str,
    target: str | None,
    by: Sequence[str] = (),
    cohort: str = "",
    model_id: str = "",
    q: int | None = None,
    edges: Sequence[float] | None = None,
    domain: tuple[float, float] | None = DOMAIN,
) -> DataFrame:
    """Equal-width (`q`, from `baseline`) or given `edges`, counted on `df`.

    A value on the lower edge of the first band (0) belongs to it. Without a
    target only totals are counted and the good and bad columns are 0. The rows
    carry cohort, model and variable tags.
    """
    if (q is None) == (edges is None):
        raise ValueError("give either q or edges")
    if edges is None:
        x = finite(column)
        low, high = baseline.agg(F.min(x), F.max(x)).first()
        if low is None:
            raise ValueError(f"{column} has no value in the baseline")
        edges = cut_range(low, high, q)
    cuts = [float(e) for e in edges]
    if domain is not None:
        cuts[0], cuts[-1] = float(domain[0]), float(domain[1])
    x = finite(column)
    below = edges_below(x, cuts)
    band = F.when((x == 0) & F.lit(cuts[0] == 0), 1).when((below >= 1) & (below < len(cuts)), below)
    grouped = df.withColumn("band", band).groupBy(*by, "band")
    if target:
        counted = tally(grouped, target)
    else:
        zero = F.lit(0).cast("bigint")
        counted = grouped.agg(F.count(F.lit(1)).alias("n")).withColumns({"good": zero, "bad": zero})
    rows = _every_band(counted, by, F.lit(len(cuts) - 1))
    text = F.array(*[F.lit(str(c)) for c in cuts])
    label = F.concat(
        F.lit("("), F.get(text, F.col("band") - 1), F.lit("-"), F.get(text, F.col("band")), F.lit(")")
    )
    total = F.col("good") + F.col("bad") if target else F.col("n")
    all_total = F.col("all_good") + F.col("all_bad") if target else F.col("all_n")
    return rows.select(
        *by, F.lit(cohort).alias("cohort"), F.lit(model_id).alias("model_id"),
        F.lit(column).alias("variable"), "band", label.alias("range"),
        "good", "bad", total.alias("total"),
        (share(F.col("good"), F.col("all_good")) if target else F.lit(0.0)).alias("pct_good"),
        (share(F.col("bad"), F.col("all_bad")) if target else F.lit(0.0)).alias("pct_bad"),
        share(total, all_total).alias("pct_total"),
    )
