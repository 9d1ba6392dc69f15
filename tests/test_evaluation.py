from __future__ import annotations

import random

import numpy as np
import pytest
from oracle_check import compare, connect
from pyspark.sql import functions as F

from bandwright.operators import gains, monitoring, ranking
from bandwright.plans import catalogue
from bandwright.plans.oracles import SQL


@pytest.fixture(scope="module")
def scored(spark):
    dice = random.Random(11)
    data = []
    for i in range(3_000):
        x = dice.randint(0, 1000)
        data.append((i, ["dev", "val", "oot"][i % 3], x, x / 7.0, int(dice.random() < 0.6 - x / 2500)))
    return spark.createDataFrame(data, "id int, sample string, score int, raw double, y int").cache()


def brute_auc(pairs):
    good = np.array([s for s, y in pairs if y == 0])
    bad = np.array([s for s, y in pairs if y == 1])
    return ((bad[:, None] > good).sum() + 0.5 * (bad[:, None] == good).sum()) / (len(good) * len(bad))


@pytest.mark.parametrize("column", ["score", "raw", "long"])
@pytest.mark.parametrize("rows", [250_000, 100])
def test_auc_matches_all_pairs(scored, column, rows, monkeypatch):
    monkeypatch.setattr(ranking, "RANGE_ROWS", rows)
    scored = scored.withColumn("long", F.col("score").cast("bigint") * 10**15)
    out = {r["sample"]: r for r in ranking.auc_gini(scored, "y", [column], ["sample"]).collect()}
    for sample in ("dev", "val", "oot"):
        pairs = [(r[column], r["y"]) for r in scored.filter(F.col("sample") == sample).collect()]
        assert out[sample]["auc"] == pytest.approx(brute_auc(pairs))
        assert out[sample]["gini"] == pytest.approx(2 * out[sample]["auc"] - 1)


def test_auc_of_the_reversed_score_is_the_complement(scored):
    both = scored.withColumn("rev", -F.col("score"))
    out = {r["score_name"]: r["auc"] for r in ranking.auc_gini(both, "y", ["score", "rev"]).collect()}
    assert out["score"] + out["rev"] == pytest.approx(1.0)


def test_ranges_do_not_change_running_totals(scored, monkeypatch):
    plain = ranking.ks_curve(scored, "y", ["score"]).collect()
    monkeypatch.setattr(ranking, "RANGE_WIDTH", 10)
    narrow = ranking.ks_curve(scored, "y", ["score"]).collect()
    assert sorted(plain) == sorted(narrow)


def test_curves_end_at_one_and_ks_is_their_largest_gap(scored):
    curve = ranking.ks_curve(scored, "y", ["score"])
    last = curve.orderBy(F.desc("threshold")).first()
    assert last["cum_good"] == 1.0 and last["cum_bad"] == 1.0
    stat = ranking.ks_two_sample(scored, "y", ["score"]).first()
    assert stat["ks"] == pytest.approx(curve.agg(F.max(F.abs("difference"))).first()[0])
    assert 0 <= stat["p_value"] <= 1
    roc = ranking.roc_points(scored, "y", ["score"])
    ends = roc.agg(F.min("fpr"), F.max("fpr"), F.max("tpr")).first()
    assert tuple(ends) == (0.0, 1.0, 1.0)


def test_missing_scores_and_targets_are_left_out(spark):
    df = spark.createDataFrame([(1.0, 0), (2.0, 1), (None, 1), (float("nan"), 0), (5.0, None)], "s double, y int")
    row = ranking.auc_gini(df, "y", ["s"]).first()
    assert (row["good"], row["bad"], row["auc"]) == (1, 1, 1.0)


def brute_gains(rows, base, zero):
    """rows, base: lists of (x, y) and x."""
    inner = [round(e, 9) for e in np.quantile(base, [i / 10 for i in range(1, 10)])]
    edges = sorted({0.0, 1000.0, *[e for e in inner if 0 < e < 1000]})
    out = {}
    for x, y in rows:
        band = 1 if zero and x == 0 else None
        if x is not None and band is None:
            band = next((k for k in range(1, len(edges)) if edges[k - 1] < x <= edges[k]), None)
        g, b = out.get(band, (0, 0))
        out[band] = (g + (y == 0), b + (y == 1))
    return edges, out


@pytest.mark.parametrize("column", ["score", "raw"])
@pytest.mark.parametrize("zero", [False, True])
def test_gains_match_a_row_loop(scored, column, zero):
    table = gains.gains_table(scored, "y", [column], zero_in_first=zero).collect()
    base = [r[column] for r in scored.filter("sample = 'dev'").collect()]
    for sample in ("dev", "val", "oot"):
        rows = [(r[column], r["y"]) for r in scored.filter(F.col("sample") == sample).collect()]
        edges, want = brute_gains(rows, base, zero)
        got = {r["band"]: (r["good"], r["bad"]) for r in table if r["sample"] == sample}
        assert {b for b in got if b} == set(range(1, len(edges)))
        assert {b: v for b, v in got.items() if v != (0, 0)} == want
        last = max((r for r in table if r["sample"] == sample and r["band"]), key=lambda r: r["band"])
        if None not in want:
            assert last["cum_good"] == pytest.approx(1.0) and last["cum_bad"] == pytest.approx(1.0)
        assert all(-100 <= r["ks"] <= 100 for r in table if r["ks"] is not None)


def test_gains_with_ties_gaps_and_outsiders(spark):
    dev = [("dev", x, x % 2) for x in [0, 0, 0, 0, 5, 5, 5, 900, 900, 1000]]
    val = [("val", x, 1) for x in (0, -3, 1500, None, 7)]
    df = spark.createDataFrame(dev + val, "sample string, s int, y int")
    out = gains.gains_table(df, "y", ["s"]).filter("sample = 'val'").collect()
    assert {r["band"]: r["total"] for r in out if r["total"]} == {None: 4, 2: 1} or {
        r["band"]: r["total"] for r in out if r["total"]
    } == {None: 4, 3: 1}
    assert sum(r["total"] for r in out) == 5
    bands = [r for r in out if r["band"] is not None]
    assert bands[0]["range"].startswith("(0-") and any(r["range"].endswith("-1000)") for r in bands)
    raw = df.withColumn("s", F.col("s").cast("double"))
    again = gains.gains_table(raw, "y", ["s"]).filter("sample = 'val'").collect()
    assert sorted(map(str, out)) == sorted(map(str, again))


def test_segments_use_their_own_edges_on_both_paths(scored):
    parts = [gains.Segment("low", F.col("score") <= 300), gains.Segment("high", F.col("score") > 300)]
    for column in ("score", "raw"):
        table = gains.gains_table(scored, "y", [column], segments=parts, in_time_total=True)
        assert table.select("segment", "sample").distinct().count() == 12
        one = gains.gains_table(scored.filter("score <= 300"), "y", [column])
        same = table.filter("segment = 'low' and sample <> 'tot'").select(*one.columns)
        assert one.exceptAll(same).count() == 0 and same.exceptAll(one).count() == 0
        sums = {
            (r["segment"], r["sample"]): r["n"]
            for r in table.groupBy("segment", "sample").agg(F.sum("total").alias("n")).collect()
        }
        assert sums[("all", "tot")] == sums[("all", "dev")] + sums[("all", "val")]
        assert sums[("low", "oot")] + sums[("high", "oot")] == sums[("all", "oot")]


def test_banded_gains_with_and_without_target(spark):
    df = spark.createDataFrame([(0.0, 0), (10.0, 1), (10.5, 1), (100.0, 0), (2000.0, 0), (None, 1)], "x double, y int")
    out = {r["band"]: r for r in gains.banded_gains(df, df, "x", "y", edges=[0, 10, 50, 1000]).collect()}
    assert {b: (r["good"], r["bad"]) for b, r in out.items()} == {1: (1, 1), 2: (0, 1), 3: (1, 0), None: (1, 1)}
    assert out[1]["range"] == "(0.0-10.0)" and out[2]["pct_bad"] == pytest.approx(1 / 3)
    bare = {r["band"]: r for r in gains.banded_gains(df, df, "x", None, edges=[0, 10, 50, 1000]).collect()}
    assert bare[1]["total"] == 2 and bare[1]["good"] == 0 and bare[1]["pct_total"] == pytest.approx(2 / 6)
    wide = gains.banded_gains(df, df, "x", "y", q=4, domain=None)
    assert wide.filter("band is not null").count() == 4 and wide.agg(F.sum("total")).first()[0] == 6


def test_report_form(scored):
    table = gains.gains_table(scored, "y", ["score"])
    text = gains.formatted(table).filter("band = 1").first()
    assert text["pct_good"].endswith("%")
    assert gains.max_ks(table).count() == 3


def test_stability_index(spark):
    df = spark.createDataFrame(
        [("base", "a")] * 60 + [("base", "b")] * 40 + [("same", "a")] * 6 + [("same", "b")] * 4
        + [("moved", "a")] * 5 + [("moved", "c")] * 5,
        "cohort string, cls string",
    )
    dist = monitoring.class_distribution(df, "cohort", ["cls"])
    psi = {r["cohort"]: r["psi"] for r in monitoring.stability_index(dist, "cohort", "base").collect()}
    e = monitoring.EPSILON
    want = (0.5 - 0.6) * np.log(0.5 / 0.6) + (e - 0.4) * np.log(e / 0.4) + (0.5 - e) * np.log(0.5 / e)
    assert psi["same"] == pytest.approx(0) and psi["moved"] == pytest.approx(want) and set(psi) == {"same", "moved"}


def test_append_fills_absent_columns(spark):
    a = spark.createDataFrame([("x", "1", 5)], "cls string, safra string, extra int")
    b = spark.createDataFrame([("2",)], "safra string")
    out = monitoring.append_frames(a, b, ["cls", "safra"])
    assert sorted(map(tuple, out.collect()), key=str) == [("x", "1"), (None, "2")] or out.count() == 2


@pytest.mark.parametrize("kind", ["int", "double"])
def test_scores_beyond_the_domain_move_the_inner_edges(spark, kind):
    """Quantiles of the raw scores; only the outer edges are the domain's."""
    scores = [*range(100, 701, 100), 990, 1500, 2000]
    rows = [("dev", i % 2, s) for i, s in enumerate(scores)]
    df = spark.createDataFrame(rows, "sample string, bad int, score int")
    df = df.withColumn("score", F.col("score").cast(kind))
    found = gains.gains_table(df, "bad", ["score"]).where("band is not null").orderBy("band").collect()
    raw = np.quantile(scores, [i / 10 for i in range(1, 10)])
    inner = [round(float(e), 2) for e in raw if 0 < e < 1000]
    assert [r["range"].strip("()").split("-")[0] for r in found][1:] == [str(e) for e in inner]


def _distribution(spark, path):
    return sorted(map(tuple, monitoring.recorded_distribution(spark, path, "safra").collect()))


def test_counts_by_month_equal_counts_of_all_rows(spark, tmp_path):
    rows = [(m, c, d) for i in range(60) for m, c, d in [(f"2001-0{i % 3 + 1}", "ab"[i % 2], None if i % 5 == 0 else f"v{i % 4}")]]
    df = spark.createDataFrame([*rows, (None, "a", "v1")], "safra string, one string, two string")
    path = str(tmp_path / "counts")
    for month in ("2001-01", "2001-02", "2001-03"):
        monitoring.record_counts(df.filter(F.col("safra") == month), path, month, "safra", ["one", "two"])
    whole = monitoring.class_distribution(df, "safra", ["one", "two"])
    assert _distribution(spark, path) == sorted(map(tuple, whole.collect()))
    found = monitoring.stability_index(monitoring.recorded_distribution(spark, path, "safra"), "safra", "2001-01")
    wanted = monitoring.stability_index(whole, "safra", "2001-01")
    assert {r[:2]: r[2] for r in map(tuple, found.collect())} == pytest.approx({r[:2]: r[2] for r in map(tuple, wanted.collect())})


def test_a_repeated_batch_is_replaced_and_a_late_one_is_added(spark, tmp_path):
    path, kinds = str(tmp_path / "counts"), "safra string, cls string"
    first = spark.createDataFrame([("2001-01", "a"), ("2001-01", "b"), ("2001-02", "a")], kinds)
    again = spark.createDataFrame([("2001-01", "a")], kinds)
    late = spark.createDataFrame([("2001-01", "b"), ("2001-01", "c")], kinds)
    monitoring.record_counts(first, path, "one", "safra", ["cls"])
    monitoring.record_counts(first, path, "one", "safra", ["cls"])
    assert [r[2:4] for r in _distribution(spark, path)] == [("a", 1), ("b", 1), ("a", 1)]
    # The second form of a batch has no row of 2001-02, so that cohort goes with the first one.
    monitoring.record_counts(again, path, "one", "safra", ["cls"])
    monitoring.record_counts(late, path, "late", "safra", ["cls"])
    assert [(r[0], *r[2:4]) for r in _distribution(spark, path)] == [("2001-01", v, 1) for v in "abc"]
    monitoring.record_counts(late.limit(0), path, "late", "safra", ["cls"])
    monitoring.record_counts(again.limit(0), path, "one", "safra", ["cls"])
    assert _distribution(spark, path) == []
    with pytest.raises(ValueError, match="batch"):
        monitoring.record_counts(late, path, "a/b", "safra", ["cls"])


def test_a_month_reads_its_own_orders(spark, folder):
    from bandwright.plans.frames import panel as orders

    month = orders(spark, folder, True, ("2001-03-01", "2001-04-01"))
    days = {r[0][:7] for r in month.select("referenced_at").collect()}
    assert days == {"2001-03"}
    assert "LessThan(o_orderdate" in month._jdf.queryExecution().executedPlan().toString()


def test_months_come_from_one_pass(spark, folder, monkeypatch):
    made, assemble = [], catalogue._production

    def production(spark, folder, days=None):
        made.append(days)
        return assemble(spark, folder, days)

    monkeypatch.setattr(catalogue, "_production", production)
    out = catalogue.psi_by_month(spark, folder)
    assert made == [(catalogue.START, "2002-01-01")]
    assert compare(out, connect(folder), SQL["psi_by_month"]) is None
