"""Study frames over the given tables (see FIXTURES.md, section C)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bandwright.operators.panel import Satellite, sample_of, star_assembly
from bandwright.sources.tables import read_parquet

OOT = "2001"
FLAGS = {"a": "A", "n": "N", "r": "R"}
BOOK = [f"{kind}_{flag}" for flag in FLAGS for kind in ("am_min", "am_max", "am_tot", "am_avg", "ct_tot")]
CATEGORICAL = ["segment", "priority", "region"]
FEATURES = ["score_a", "score_b", *BOOK]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return read_parquet(spark, f"{folder}/{name}.parquet")


Days = tuple[str, str] | None


def _orders(spark: SparkSession, folder: str, days: Days) -> DataFrame:
    """Orders, or those from the first of two days to before the second; the scan prunes by them."""
    orders = table(spark, folder, "orders")
    if days is None:
        return orders
    first, end = (F.lit(day).cast("timestamp_ntz") for day in days)
    return orders.filter((F.col("o_orderdate") >= first) & (F.col("o_orderdate") < end))


def panel(spark: SparkSession, folder: str, dated: bool = False, days: Days = None) -> DataFrame:
    """One row per order: the customer panel with cohort, sample, target and scores, and
    if `dated` with the day."""
    orders = _orders(spark, folder, days).select(
        F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("consumer_id"),
        F.year("o_orderdate").cast("string").alias("ref_portfolio"),
        F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("bad"),
        F.floor(F.col("o_totalprice") / 500).cast("int").alias("score_a"),
        F.col("o_orderpriority").alias("priority"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("referenced_at"),
    )
    customer = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("consumer_id"), F.col("c_nationkey").alias("nation_id"),
        F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"),
    )
    nation = table(spark, folder, "nation").select(
        F.col("n_nationkey").alias("nation_id"), F.col("n_regionkey").alias("region_id")
    )
    region = table(spark, folder, "region").select(
        F.col("r_regionkey").alias("region_id"), F.col("r_name").alias("region")
    )
    joined = star_assembly(
        orders,
        [
            Satellite(customer, ("consumer_id",)), Satellite(nation, ("nation_id",)),
            Satellite(region, ("region_id",)),
        ],
    )
    return joined.select(
        "order_id", "consumer_id", "ref_portfolio",
        sample_of("order_id", "ref_portfolio", OOT).alias("sample"), "bad", "score_a",
        F.floor((F.col("balance") + 1000) / 11).cast("int").alias("score_b"),
        "segment", "priority", "region", *(["referenced_at"] if dated else []),
    )


def book(spark: SparkSession, folder: str, days: Days = None) -> DataFrame:
    """Transaction book per order: min, max, total, mean and count by return flag."""
    lines = table(spark, folder, "lineitem")
    if days is not None:
        lines = lines.join(_orders(spark, folder, days), F.col("l_orderkey") == F.col("o_orderkey"), "left_semi")
    price = F.col("l_extendedprice")
    aggregates = []
    for flag, value in FLAGS.items():
        x = F.when(F.col("l_returnflag") == value, price)
        aggregates += [
            F.min(x).alias(f"am_min_{flag}"), F.max(x).alias(f"am_max_{flag}"),
            F.sum(x).alias(f"am_tot_{flag}"), F.avg(x).alias(f"am_avg_{flag}"),
            F.count(x).alias(f"ct_tot_{flag}"),
        ]
    # Dealt by order before they are summed: a line's three columns are less than an order's fifteen sums,
    # and a task sums the orders of one partition, not those of a whole file split and of a partition.
    dealt = lines.select(F.col("l_orderkey").alias("order_id"), "l_returnflag", "l_extendedprice").repartition("order_id")
    return dealt.groupBy("order_id").agg(*aggregates)


def modelling(spark: SparkSession, folder: str, dated: bool = False, days: Days = None) -> DataFrame:
    """Panel with the book's features."""
    return star_assembly(panel(spark, folder, dated, days), [Satellite(book(spark, folder, days), ("order_id",))])


STATES = ("AC", "PA", "BA", "CE", "MG", "RJ", "SP", "PR", "RS", "DF")
ISSUERS = ("nubank", "itau", "nu pagamentos sa", "vazio", "santander", "bradesco", "Outros", "banco original")
BRANDS = ("samsung", "motorola", "iphone", "nokia", "xiaomi", "lg", "asus")
MAILS = ("gmail", "hotmail", "uol", "outlook", "yahoo", "Outros/Erro")


def monitored(spark: SparkSession, folder: str, days: Days = None) -> DataFrame:
    """The modelling frame with the inputs of the fifteen monitoring classes.

    Amounts, counts and scores are the book's and the panel's; what the tables lack
    (age, tenure, states, brands) is derived from the keys.
    """
    df = modelling(spark, folder, dated=True, days=days)

    def picked(values: tuple[str, ...], key: str):
        return F.array(*map(F.lit, values))[(F.col(key) % len(values)).cast("int")]

    return df.withColumns(
        {
            "HSPA": F.col("score_b"), "idade_em_anos": (F.col("consumer_id") % 85 + 12).cast("int"),
            "ddd_state": picked(STATES, "consumer_id"), "tempo_registro_em_meses": F.col("consumer_id") % 50,
            "days_since_last_transaction": F.when(F.col("order_id") % 9 != 0, F.col("order_id") % 800),
            "agrupamento_instituicao_cartao_ref": picked(ISSUERS, "order_id"),
            "am_max_pay_12m_trx": F.col("am_max_a") / 500, "modelo_celular_ref": picked(BRANDS, "order_id"),
            "mental_accounting_score": F.col("score_b") % 101, "peer_effect_score": F.col("score_a") % 101,
            "email_ajuste": picked(MAILS, "consumer_id"), "am_max_recp2p_12m_trx": F.col("am_max_n") / 500,
            "qtde_emissores_distintos": F.col("ct_tot_r"), "am_max_payp2pbal_12m_trx": F.col("am_max_r") / 500,
        }
    )


def doc_panel(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with nullable outcome columns."""
    docs = table(spark, folder, "documents").select("doc_id", "lang", "source", "n_chars")
    return star_assembly(docs, [Satellite(table(spark, folder, "labels"), ("doc_id",))])


def cards(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select("user_id", "ts", "event_type", "value")
