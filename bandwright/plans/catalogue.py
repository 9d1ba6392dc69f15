"""The registered queries: every operator over the given tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bandwright.functions import presets
from bandwright.functions.banding import Groups, with_classes
from bandwright.functions.columns import INF
from bandwright.functions.text import group_by_dictionary, keep_listed, with_first_contained
from bandwright.operators import (
    allrelevant, attribution, cleaning, encoding, gains, models, monitoring, panel, profile,
    ranking, screening, search, shares,
)
from bandwright.plans import flows, fullbase
from bandwright.plans.frames import (
    BOOK, CATEGORICAL, FEATURES, cards, doc_panel, modelling, monitored, table,
)
from bandwright.plans.frames import panel as order_panel
from bandwright.sources.model_store import load_newest, save_run
from bandwright.sources.session import scratch_path, written
from bandwright.sources.tables import read_table, write_parquet

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}

SCORES = ["score_a", "score_b"]
AMOUNTS = ["am_tot_a", "am_tot_n", "am_tot_r", "score_a", "score_b"]


def query(fn: Query) -> Query:
    REGISTRY[fn.__name__.rstrip("_")] = fn
    return fn


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to fixed digits (and no negative zero) for comparison."""
    doubles = [f.name for f in df.schema if isinstance(f.dataType, T.DoubleType)]
    return df.withColumns({c: F.round(c, digits) + F.lit(0.0) for c in doubles})


# --- population -----------------------------------------------------------------------------


@query
def panel_assembly(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(modelling(spark, folder))


@query
def dedup_lookup_join(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("first_line"),
        F.col("l_partkey").alias("part_id"), F.col("l_suppkey").alias("supp_id"),
        F.col("l_extendedprice").alias("price"),
    )
    orders = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("order_id"), F.col("o_orderstatus").alias("status")
    )
    lookup = panel.Satellite(lines, ("order_id",))
    return flows.population(
        orders, [], [("no line", F.col("first_line").isNull())], lookup=lookup,
        lookup_order=["first_line", "part_id", "supp_id", "price"],
    )


LOG_KEYS = ["order_id", "consumer_id", "referenced_at"]


START = "2001-02-01"


def _production(spark: SparkSession, folder: str, days: tuple[str, str] | None = None) -> DataFrame:
    """Production variables of the last year joined with their score log on three keys."""
    year = monitored(spark, folder, days).filter(F.col("ref_portfolio") == "2001")
    # The log has none of the book's columns, so it comes from the panel alone.
    scored = order_panel(spark, folder, dated=True, days=days).filter(F.col("ref_portfolio") == "2001")
    log = scored.filter(F.col("score_a") % 7 != 0).select(*LOG_KEYS, F.col("score_a").alias("score"))
    return monitoring.production_frame(
        year, log, LOG_KEYS, "score", "referenced_at", START,
        presets.monitoring_classes("score", "others"),
    )


@query
def hot_key_star(spark: SparkSession, folder: str) -> DataFrame:
    """Lines with satellites on three and on four keys; one key holds a third of the rows, others lack a part."""
    hot, line = F.col("l_orderkey") % 3 == 0, F.col("l_orderkey")
    lines = table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part_id"),
        F.when(hot, F.lit(1).cast("bigint")).when(line % 11 != 0, F.col("l_suppkey")).alias("consumer_id"),
        F.when(hot, "1995").otherwise(F.year("l_shipdate").cast("string")).alias("ref_portfolio"),
        F.when(hot, "N").otherwise(F.col("l_returnflag")).alias("flag_consumer"),
        F.when(hot, "F").otherwise(F.col("l_linestatus")).alias("cpf"), F.col("l_quantity").alias("quantity"),
    )
    star = list(presets.STAR_KEYS)
    three = lines.groupBy(*star).agg(F.count(F.lit(1)).alias("lines"), F.max("quantity").alias("most"))
    four = lines.groupBy(*star, "cpf").agg(F.count(F.lit(1)).alias("lines_cpf"), F.min("part_id").alias("first_part"))
    return panel.star_assembly(
        lines,
        [panel.Satellite(three, tuple(star), salt="auto"), panel.Satellite(four, (*star, "cpf"), salt="auto")],
    )


@query
def score_log_join(spark: SparkSession, folder: str) -> DataFrame:
    """The joined rows with their cohort and all fifteen classes."""
    return _production(spark, folder).select(*LOG_KEYS, "score", "safra", *CLASSES)


@query
def exclusion_waterfall(spark: SparkSession, folder: str) -> DataFrame:
    docs = doc_panel(spark, folder).withColumn(
        "score", F.least(F.floor(F.col("n_chars") / 400), F.lit(999))
    )
    scoped = panel.out_of_scope(docs, "n_chars", "quality", months=10_000)
    rules = panel.study_exclusions(
        F.col("toxic") == 1, ["score"], "quality", F.col("lang") == "de", "n_chars", (1_000, 6_000),
        ("01. Bad at origin", "02. Score = 0", "03. No hit", "04. No performance", "05. Inactive",
         "06. Size out of range"),
    )
    return panel.counts(panel.exclude(scoped, rules, "reason"), ["reason"])


@query
def production_exclusion(spark: SparkSession, folder: str) -> DataFrame:
    rules = panel.production_exclusions(
        "score_b", presets.SCORE_CUT, "score_a", (18, 900), ("01. Score <= 360", "02. Out of range")
    )
    marked = panel.exclude(order_panel(spark, folder), rules, "reason")
    return panel.counts(marked, ["reason"]).withColumn("kept", F.col("reason").isNull().cast("int"))


@query
def lookup_check(spark: SparkSession, folder: str) -> DataFrame:
    return (
        order_panel(spark, folder)
        .filter(
            (F.col("ref_portfolio") == "1996") & (F.col("segment") == "BUILDING")
            & (F.col("priority") == "1-URGENT") & F.col("region").isin("ASIA", "EUROPE")
            & (F.col("score_b") >= 500)
        )
        .select("order_id", "score_a", "score_b")
    )


@query
def catalog_scan(spark: SparkSession, folder: str) -> DataFrame:
    """The orders read by name from the session's catalog."""
    table(spark, folder, "orders").createOrReplaceTempView("bandwright_orders")
    orders = read_table(spark, "bandwright_orders", ["o_orderkey", "o_orderstatus", "o_totalprice"])
    return orders.filter(F.col("o_orderstatus") == "P")


@query
def split_samples(spark: SparkSession, folder: str) -> DataFrame:
    return order_panel(spark, folder).groupBy("sample").agg(
        F.count(F.lit(1)).alias("n"), F.sum("bad").alias("bad")
    )


@query
def latest_attributes(spark: SparkSession, folder: str) -> DataFrame:
    known = cards(spark, folder).filter(F.col("user_id").isNotNull() & F.col("ts").isNotNull())
    return panel.latest_per_key(known, ["user_id"], "ts", ["event_type", "value"])


@query
def latest_counts(spark: SparkSession, folder: str) -> DataFrame:
    return panel.counts(latest_attributes(spark, folder), ["event_type"])


# --- normalisation --------------------------------------------------------------------------


@query
def normalise_text(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages").select(
        F.lit("pages").alias("origin"), F.regexp_extract("url", r"://(?:[a-z]+\.)*([a-z]+)\.[a-z]+/", 1).alias("domain"),
        F.col("html").alias("body"),
    )
    docs = table(spark, folder, "documents").select(
        F.lit("documents").alias("origin"), F.regexp_extract("text", r"@([A-Za-z0-9-]+)\.", 1).alias("domain"),
        F.col("text").alias("body"),
    )
    branded = with_first_contained(pages.unionByName(docs), "body", "brand")
    marked = branded.select(
        "origin", keep_listed(F.col("domain"), (*presets.EMAIL_DOMAINS, "example", "mail2")).alias("domain_group"),
        "brand",
    )
    return marked.groupBy("origin", "domain_group", "brand").agg(F.count(F.lit(1)).alias("n"))


TYPE_GROUPS = {"small": ("small", "economy"), "large": ("large", "promo")}
NATION_GROUPS = {
    "north": ("NATION_0", "NATION_1", "NATION_2", "NATION_3", "NATION_4"),
    "south": ("NATION_5", "NATION_6", "NATION_7"),
}


@query
def dictionary_group(spark: SparkSession, folder: str) -> DataFrame:
    parts = group_by_dictionary(
        table(spark, folder, "part"), "p_type", "group", TYPE_GROUPS, presets.ISSUER_DEFAULT,
        presets.ISSUER_NULL,
    ).select(F.lit("part").alias("variable"), "group")
    customer = table(spark, folder, "customer").select(F.col("c_nationkey").alias("n_nationkey"))
    nations = panel.star_assembly(
        customer, [panel.Satellite(table(spark, folder, "nation"), ("n_nationkey",), ("n_name",))]
    )
    grouped = with_classes(nations, [Groups("n_name", "group", NATION_GROUPS)])
    both = parts.unionByName(grouped.select(F.lit("nation").alias("variable"), "group"))
    return both.groupBy("variable", "group").agg(F.count(F.lit(1)).alias("n"))


@query
def clean_numeric(spark: SparkSession, folder: str) -> DataFrame:
    raw = modelling(spark, folder).select(
        "order_id", "am_avg_a", "am_min_r", F.col("am_tot_n").alias("zero_am_tot_n"),
        F.when(F.col("score_b") == 0, F.lit(INF)).otherwise(F.col("score_a") / F.col("score_b")).alias("ratio"),
        F.substring("priority", 1, 1).alias("priority_code"), F.substring("segment", 1, 1).alias("not_a_number"),
    )
    cast = cleaning.to_double(raw, ["priority_code", "not_a_number"])
    zeroed = cleaning.fill_numeric_zero(cast, ["zero_am_tot_n"])
    filled = cleaning.fill_numeric_mean(
        zeroed, ["am_avg_a", "am_min_r", "ratio", "priority_code", "not_a_number"]
    )
    return rounded(filled)


@query
def clean_categorical(spark: SparkSession, folder: str) -> DataFrame:
    raw = doc_panel(spark, folder).select(
        "doc_id", "lang", (F.col("toxic") == 1).alias("toxic_flag"),
        F.col("quality").cast("string").alias("quality_text"),
    )
    return cleaning.fill_categorical(raw)


@query
def median_mode_impute(spark: SparkSession, folder: str) -> DataFrame:
    """Median of a numeric and most frequent of a text column in place of nulls."""
    rows = modelling(spark, folder).select(
        "order_id", "am_avg_a", F.nullif("segment", F.lit("BUILDING")).alias("segment")
    )
    imputer = encoding.MedianImputer(inputCols=["am_avg_a"], outputCols=["am_avg_a_filled"])
    filled = imputer.fit(rows).transform(rows)
    common = encoding.mode_values(rows, ["segment"])["segment"]
    return rounded(filled.select("order_id", F.col("am_avg_a_filled").alias("am_avg_a"), "segment").fillna({"segment": common}))


CLASSES = [spec.output for spec in presets.monitoring_classes("score_a")]


@query
def class_bands(spark: SparkSession, folder: str) -> DataFrame:
    marked = with_classes(monitored(spark, folder), presets.monitoring_classes("score_a"))
    return shares.class_cube(marked, "ref_portfolio", CLASSES)


@query
def integer_score(spark: SparkSession, folder: str) -> DataFrame:
    p = (F.col("c_acctbal") + 1000) / 11_000
    scored = table(spark, folder, "customer").select(
        cleaning.to_integer_score(p).alias("score"), F.lit("m1").alias("model_id")
    )
    return scored.groupBy("score", "model_id").agg(F.count(F.lit(1)).alias("n"))


# --- profiles -------------------------------------------------------------------------------


@query
def sparse_profile(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(profile.sparse_profile(modelling(spark, folder), threshold=0.2))


@query
def drop_sparse(spark: SparkSession, folder: str) -> DataFrame:
    """Columns left after the computed drop, with their non-null counts."""
    kept = profile.drop_sparse(modelling(spark, folder), 0.2, keep=["order_id"])
    counted = kept.agg(*[F.count(c).alias(c) for c in kept.columns])
    lines = [F.struct(F.lit(c).alias("variable"), F.col(c).alias("filled")) for c in kept.columns]
    return counted.select(F.inline(F.array(*lines)))


@query
def cohort_share(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(shares.cohort_shares(order_panel(spark, folder), "ref_portfolio", CATEGORICAL))


@query
def cohort_share_wide(spark: SparkSession, folder: str) -> DataFrame:
    long = shares.cohort_shares(order_panel(spark, folder), "ref_portfolio", ["segment"])
    return rounded(shares.wide_shares(long, "ref_portfolio", "segment"))


@query
def numeric_summary(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(profile.numeric_summary(written(modelling(spark, folder).select("sample", "ref_portfolio", *AMOUNTS)), AMOUNTS, ["sample"]), 4)


@query
def boxplot_stats(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(profile.boxplot_stats(written(modelling(spark, folder).select("sample", "ref_portfolio", *AMOUNTS)), AMOUNTS, ["ref_portfolio"]), 4)


@query
def filtered_median(spark: SparkSession, folder: str) -> DataFrame:
    below = (F.col("score_b") <= presets.SCORE_CUT) & (F.col("sample") == "dev")
    return rounded(profile.filtered_median(order_panel(spark, folder), "score_a", below))


# --- screening ------------------------------------------------------------------------------


_devs: dict[tuple[str, str], DataFrame] = {}


def _dev(spark: SparkSession, folder: str) -> DataFrame:
    """Development rows, written once per application for all screening queries to read."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _devs:
        _devs[key] = written(modelling(spark, folder).filter(F.col("sample") == "dev"), "dev")
    return _devs[key]


@query
def point_biserial(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(screening.point_biserial_stats(_dev(spark, folder), "bad", FEATURES))


@query
def point_biserial_decision(spark: SparkSession, folder: str) -> DataFrame:
    return screening.point_biserial(_dev(spark, folder), "bad", FEATURES).select("variable", "result")


@query
def chi_square(spark: SparkSession, folder: str) -> DataFrame:
    dev = order_panel(spark, folder).filter(F.col("sample") == "dev")
    two = dev.withColumn("high", F.when(F.col("score_a") > 400, "yes").otherwise("no"))
    first = screening.chi_square(two, "bad", [*CATEGORICAL, "ref_portfolio", "high"])
    docs = screening.chi_square(doc_panel(spark, folder), "toxic", ["lang", "source"])
    both = first.unionByName(docs)
    return rounded(both.select("variable", "chi2", F.col("dof").cast("bigint"), "evaluable", "result"))


@query
def woe_table(spark: SparkSession, folder: str) -> DataFrame:
    dev = order_panel(spark, folder).filter(F.col("sample") == "dev")
    first = screening.woe_table(dev, "bad", CATEGORICAL)
    docs = screening.woe_table(doc_panel(spark, folder), "toxic", ["lang", "quality"])
    return rounded(first.unionByName(docs))


@query
def woe_table_null_level(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(screening.woe_table(doc_panel(spark, folder), "toxic", ["lang", "quality"], True))


@query
def iv_categorical(spark: SparkSession, folder: str) -> DataFrame:
    dev = order_panel(spark, folder).filter(F.col("sample") == "dev")
    return rounded(screening.information_value(screening.woe_table(dev, "bad", CATEGORICAL)))


@query
def iv_numeric(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(
        screening.information_value(screening.banded_woe_table(_dev(spark, folder), "bad", FEATURES))
    )


@query
def correlation_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(screening.correlation_pairs(_dev(spark, folder), FEATURES))


RULES = {"least_iv": 0.002, "exclude_names": ["am_min_r"], "include_names": ["score_a"]}


@query
def select_features(spark: SparkSession, folder: str) -> DataFrame:
    """The rules that SQL can state; `select_with_models` adds the search and a model's table."""
    return flows.screen(_dev(spark, folder), "bad", FEATURES, CATEGORICAL, ["order_id"], **RULES)


_searches: dict[tuple[str, str], DataFrame] = {}


def _relevant(spark: SparkSession, folder: str) -> DataFrame:
    """The all-relevant search's table; found once per application."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _searches:
        found = allrelevant.all_relevant(_dev(spark, folder), "bad", FEATURES, CATEGORICAL, ["order_id"])
        _searches[key] = written(found, "relevant")
    return _searches[key]


@query
def select_with_models(spark: SparkSession, folder: str) -> DataFrame:
    """All rules: the all-relevant search's decisions and the chosen model's importances of these tables."""
    return flows.screen(
        _dev(spark, folder), "bad", FEATURES, CATEGORICAL, ["order_id"], relevant=_relevant(spark, folder),
        importance=models.importances(_chosen(spark, folder)), **RULES,
    )


@query
def screening_rounds(spark: SparkSession, folder: str) -> DataFrame:
    """The screening repeated on what is left, each round with a forest's importances of its own."""
    dev = _dev(spark, folder)
    coded = models.coded(dev, "bad", FEATURES, CATEGORICAL, models.QUICK_FOREST.balanced)

    def importances(numeric, categorical) -> DataFrame:
        return models.importances(models.fit_coded(coded, "bad", numeric, categorical, models.QUICK_FOREST))

    return flows.rounds(dev, "bad", FEATURES, CATEGORICAL, ["order_id"], importances, **RULES)


@query
def boruta(spark: SparkSession, folder: str) -> DataFrame:
    return _relevant(spark, folder)


@query
def woe_encode(spark: SparkSession, folder: str) -> DataFrame:
    rows = order_panel(spark, folder).select(
        "order_id", "sample", "bad", F.nullif("segment", F.lit("BUILDING")).alias("segment"), "priority"
    )
    encoder = encoding.WoeEncoder(
        inputCols=["segment", "priority"], outputCols=["segment_woe", "priority_woe"], labelCol="bad"
    )
    model = encoder.fit(rows.filter(F.col("sample") == "dev"))
    return rounded(model.transform(rows).select("order_id", "segment_woe", "priority_woe"))


@query
def woe_encode_join(spark: SparkSession, folder: str) -> DataFrame:
    """The join form, for columns of any number of levels (here the customer)."""
    rows = order_panel(spark, folder).select("order_id", "sample", "bad", "consumer_id")
    dev = rows.filter(F.col("sample") == "dev")
    levels = written(encoding.woe_levels(dev, "bad", ["consumer_id"]), "levels")
    coded = encoding.encode_by_join(rows, levels, ["consumer_id"])
    return rounded(coded.select("order_id", "consumer_id_woe"))


@query
def class_weights(spark: SparkSession, folder: str) -> DataFrame:
    dev = order_panel(spark, folder).filter(F.col("sample") == "dev")
    return rounded(encoding.class_weights(dev, "bad"))


# --- models ---------------------------------------------------------------------------------

FINALISTS = [models.QUICK_FOREST, *models.FINALISTS]
_stores: dict[tuple[str, str], tuple[str, set[str]]] = {}


def _kept(spark: SparkSession, folder: str) -> DataFrame:
    return modelling(spark, folder).persist(StorageLevel.MEMORY_AND_DISK)


def _report(found: Callable[[], DataFrame], used: DataFrame) -> DataFrame:
    """A report-sized result; its cached input is released whether it succeeds or not."""
    try:
        rows = found()
        local = rows.collect()
        return rows.sparkSession.createDataFrame(local, rows.schema)
    finally:
        used.unpersist()


def _store(
    spark: SparkSession, folder: str, wanted: Sequence[models.Candidate] = FINALISTS, table: DataFrame | None = None,
) -> str:
    """Where the finalists of these tables are saved; each is fitted once per application, when first wanted.

    `table`: the modelling frame where it is written already, which is then not assembled again.
    """
    key = (spark.sparkContext.applicationId, folder)
    store, saved = _stores.setdefault(key, (scratch_path(spark, "models"), set()))
    missing = [c for c in wanted if c.name not in saved]
    if missing:
        kept = _kept(spark, folder) if table is None else table
        try:
            dev = kept.filter(F.col("sample") == "dev")
            for name, model in models.fit_all(dev, "bad", FEATURES, CATEGORICAL, missing).items():
                save_run(spark, model, store, name)
                saved.add(name)
        finally:
            if table is None:
                kept.unpersist()
    return store


def _chosen(spark: SparkSession, folder: str, table: DataFrame | None = None):
    return load_newest(spark, _store(spark, folder, [models.CHOSEN], table), models.CHOSEN.name)


@query
def fit_compare(spark: SparkSession, folder: str) -> DataFrame:
    store = _store(spark, folder)
    fitted = {c.name: load_newest(spark, store, c.name) for c in FINALISTS}
    df = _kept(spark, folder)
    return _report(lambda: rounded(models.compare(df, fitted, "bad", FEATURES)), df)


@query
def tuned_compare(spark: SparkSession, folder: str) -> DataFrame:
    """The winners of the forest and first boosting searches."""
    df = _kept(spark, folder)

    def found() -> DataFrame:
        dev = df.filter(F.col("sample") == "dev")
        fitted = models.fit_all(dev, "bad", FEATURES, CATEGORICAL, models.TUNED)
        return rounded(models.compare(df, fitted, "bad", FEATURES))

    return _report(found, df)


@query
def feature_ablation(spark: SparkSession, folder: str) -> DataFrame:
    df = _kept(spark, folder)
    sets = {
        "internal": (["score_a", *BOOK], CATEGORICAL),
        "internal_and_bureau": (["score_a", "score_b", *BOOK], CATEGORICAL),
    }
    return _report(lambda: rounded(models.ablation(df, "bad", sets)), df)


@query
def search_trials(spark: SparkSession, folder: str) -> DataFrame:
    """The forests' search over both feature sets; every trial is fitted on all labelled rows."""
    sets = {
        "internal": (["score_a", *BOOK], CATEGORICAL),
        "internal_and_bureau": (FEATURES, CATEGORICAL),
    }
    df = written(modelling(spark, folder), "modelling")
    return search.halving(df, "bad", sets, ["rf"], ["order_id"], rungs=1, parallel=4)


@query
def importance(spark: SparkSession, folder: str) -> DataFrame:
    return models.importances(_chosen(spark, folder))


@query
def attribution_(spark: SparkSession, folder: str) -> DataFrame:
    model = _chosen(spark, folder)
    explained = attribution.attributions(
        modelling(spark, folder).filter(F.col("sample") == "dev"), model, FEATURES, ["order_id"]
    )
    return attribution.mean_absolute(explained, attribution.input_names(model))


@query
def reload_parity(spark: SparkSession, folder: str) -> DataFrame:
    df = _kept(spark, folder)
    store = scratch_path(spark, "models")
    return _report(
        lambda: flows.reload_check(df, _chosen(spark, folder), store, "order_score", FEATURES), df
    )


@query
def score_population(spark: SparkSession, folder: str) -> DataFrame:
    # The assembled table is written, as the study does, then scored.
    df = written(modelling(spark, folder), "modelling")
    model = _chosen(spark, folder, df)
    rules = [("01. Out of range", (F.col("score_b") < 18) | (F.col("score_b") > 900))]
    base = panel.exclude(df, rules, "exclusao")
    keep = ["order_id", "consumer_id", "ref_portfolio", "sample", "bad", "exclusao"]
    path = scratch_path(spark, "scored")
    return flows.score_population(base, model, FEATURES, keep, path=path, cohort="ref_portfolio")


_base_models: dict[tuple[str, str], tuple[str, DataFrame]] = {}


def _base_model(spark: SparkSession, folder: str):
    """The chosen model fitted on the eligible rows of the full base, and this base; made once per application."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _base_models:
        contract = fullbase.STUDY
        base = written(fullbase.study_base(spark, folder), "base")
        model = models.fit(
            base.filter(F.col("exclusao") == "others"), contract.target, contract.numeric, contract.categorical,
            models.CHOSEN)
        store = scratch_path(spark, "models")
        save_run(spark, model, store, "base")
        _base_models[key] = store, base
    store, base = _base_models[key]
    return load_newest(spark, store, "base"), base


@query
def full_base_scoring(spark: SparkSession, folder: str) -> DataFrame:
    """The raw tables assembled, excluded, prepared, scored and written by cohort; read back by table name.

    The history is written first, from the base that the model was fitted on; the newest cohort then comes
    in with a later run, which reads its raw rows and also writes its predecessor anew. `scored` tells that
    the score lies in its range.
    """
    model, base = _base_model(spark, folder)
    name, path = f"full_base_{uuid.uuid4().hex}", scratch_path(spark, "full_base")
    history = base.filter(F.col("ref_portfolio").isin("1995", "1996", "1997", "1998", "1999", "2000"))
    for ready in (history, fullbase.study_base(spark, folder, ["2000", "2001"])):
        found = fullbase.write_cohorts(fullbase.scored(ready, model), name, path, "ref_portfolio")
    score = F.col("score_cs_carteira")
    return rounded(found.withColumn("scored", score.between(0, 1000)).drop("score_cs_carteira"), 4)


# --- evaluation -----------------------------------------------------------------------------


@query
def auc_gini(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(ranking.auc_gini(order_panel(spark, folder), "bad", SCORES, ["sample"], bad_is_low=True))


@query
def auc_gini_fractional(spark: SparkSession, folder: str) -> DataFrame:
    named = {"mean_price": "am_avg_a", "score_a": "score_a"}
    return rounded(ranking.auc_gini(modelling(spark, folder), "bad", named, ["sample"]))


@query
def roc_points(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(ranking.roc_points(order_panel(spark, folder), "bad", SCORES, ["sample"]))


@query
def ks_two_sample(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(ranking.ks_statistic(order_panel(spark, folder), "bad", SCORES, ["sample"]))


@query
def ks_p_value(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(ranking.ks_two_sample(order_panel(spark, folder), "bad", SCORES, ["sample"]))


@query
def ks_curve(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(ranking.ks_curve(order_panel(spark, folder), "bad", SCORES, ["sample"]))


def gains_scores(df: DataFrame) -> DataFrame:
    """A third score next to the two given ones."""
    return df.withColumn("score_c", F.floor((F.col("score_a") + F.col("score_b")) / 2).cast("int"))


THREE = [*SCORES, "score_c"]


@query
def gains_table(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(gains.gains_table(order_panel(spark, folder), "bad", ["score_a"]))


@query
def gains_by_sample(spark: SparkSession, folder: str) -> DataFrame:
    df = gains_scores(order_panel(spark, folder))
    return rounded(gains.gains_table(df, "bad", THREE, in_time_total=True))


@query
def gains_zero_first(spark: SparkSession, folder: str) -> DataFrame:
    df = order_panel(spark, folder)
    return rounded(gains.gains_table(df, "bad", ["score_b"], zero_in_first=True))


@query
def gains_fractional(spark: SparkSession, folder: str) -> DataFrame:
    """Raw (not truncated) scores: the mean line price in hundreds."""
    raw = modelling(spark, folder).select("sample", "bad", (F.col("am_avg_n") / 100).alias("raw"))
    df = written(raw)
    return rounded(gains.gains_table(df, "bad", ["raw"], in_time_total=True))


@query
def gains_banded(spark: SparkSession, folder: str) -> DataFrame:
    df = order_panel(spark, folder)
    dev = df.filter(F.col("sample") == "dev")
    wide = gains.banded_gains(dev, df, "score_b", "bad", ["sample"], "2001", "m1", q=10)
    given = gains.banded_gains(
        dev, df, "score_a", "bad", ["sample"], "2001", "m1", edges=[0, 100, 250, 500, 1000]
    )
    untargeted = gains.banded_gains(
        dev, df, "score_a", None, ["sample"], "2001", "m0", edges=[0, 300, 600, 1000]
    )
    out = wide.unionByName(given).unionByName(untargeted)
    return rounded(out)


def study_segments() -> list[gains.Segment]:
    """Four two-way studies: card, bureau score, age and payments."""
    no_pay = F.col("ct_tot_r").isNull() | (F.col("ct_tot_r") == 0)
    return [
        gains.Segment("without_a", F.col("ct_tot_a") == 0),
        gains.Segment("with_a", F.col("ct_tot_a") != 0),
        gains.Segment("score_b_to_360", F.col("score_b") <= presets.SCORE_CUT),
        gains.Segment("score_b_over_360", F.col("score_b") > presets.SCORE_CUT),
        gains.Segment("lines_n_to_1", F.col("ct_tot_n") <= 1),
        gains.Segment("lines_n_over_1", F.col("ct_tot_n") > 1),
        gains.Segment("no_r", no_pay),
        gains.Segment("with_r", ~no_pay),
    ]


@query
def segment_gains(spark: SparkSession, folder: str) -> DataFrame:
    df = gains_scores(modelling(spark, folder))
    return rounded(
        gains.gains_table(df, "bad", THREE, segments=study_segments(), in_time_total=True)
    )


# --- monitoring -----------------------------------------------------------------------------

def _baseline(spark: SparkSession, folder: str) -> DataFrame:
    """The scored panel without production exclusions, with cohort label and classes."""
    rules = panel.production_exclusions(
        "score_b", presets.SCORE_CUT, "score_a", (18, 900), ("01. Score <= 360", "02. Out of range")
    )
    return monitoring.baseline_frame(
        monitored(spark, folder), rules, presets.monitoring_classes("score_a"), "ref_portfolio", "2001"
    )


def _drift(spark: SparkSession, folder: str):
    return flows.drift_report(_baseline(spark, folder), _production(spark, folder), CLASSES, "safra", "Baseline")


@query
def append_distribution(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(_drift(spark, folder)["distribution"])


@query
def psi(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(_drift(spark, folder)["psi"])


@query
def psi_by_month(spark: SparkSession, folder: str) -> DataFrame:
    """The index from a table of counts to which every month adds its own.

    The months' rows are assembled in one pass and written by month; each month then reads its own.
    """
    path, rows = scratch_path(spark, "class_counts"), scratch_path(spark, "production")
    flows.drift_update(_baseline(spark, folder), path, "baseline", CLASSES, "safra")
    production = _production(spark, folder, (START, "2002-01-01")).select(*CLASSES, "safra")
    write_parquet(production, rows, ["safra"])
    kept = spark.read.schema(production.schema).parquet(rows)
    for month in sorted(row[0] for row in kept.select("safra").distinct().collect()):
        flows.drift_update(kept.filter(F.col("safra") == month), path, month, CLASSES, "safra")
    return rounded(flows.drift_so_far(spark, path, "safra", "Baseline")["psi"])


@query
def baseline_classes(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(monitoring.class_distribution(_baseline(spark, folder), "safra", CLASSES))
