from __future__ import annotations

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bandwright.functions import presets
from bandwright.functions.banding import with_classes
from bandwright.functions.text import group_by_dictionary, keep_listed, with_first_contained
from bandwright.operators import panel, skew


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=str)


def test_star_assembly_keeps_base_rows_and_fills_nulls(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "id int, c string")
    right = spark.createDataFrame([(1, 10, 7)], "id int, x int, unused int")
    out = panel.star_assembly(base, [panel.Satellite(right, ("id",), ("x",))])
    assert out.columns == ["id", "c", "x"]
    assert rows(out, "id", "x") == [(1, 10), (2, None), (2, None)]


def test_salted_join_equals_plain_join(spark):
    base = spark.range(2_000).select(F.when(F.col("id") % 3 == 0, F.col("id")).otherwise(1).alias("k"), "id")
    right = spark.range(1_000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("x"))
    plain = panel.star_assembly(base, [panel.Satellite(right, ("k",))])
    salted = panel.star_assembly(base, [panel.Satellite(right, ("k",), salt=8)])
    assert plain.exceptAll(salted).count() == 0 and salted.count() == 2_000


def test_first_and_latest_per_key(spark):
    df = spark.createDataFrame(
        [("k", 2, "late"), ("k", 1, "b"), ("k", 1, "a"), ("other", 5, None)], "key string, at int, v string"
    )
    assert rows(panel.first_per_key(df, ["key"], ["at"]), "key", "v") == [("k", "a"), ("other", None)]
    assert rows(panel.latest_per_key(df, ["key"], "at", ["v"]), "key", "v") == [("k", "late"), ("other", None)]


def test_waterfall_partitions_the_input_and_nulls_fall_through(spark):
    df = spark.createDataFrame(
        [(1, 5, 0, "false", 30), (0, 0, 0, "false", 30), (0, 1, 0, "false", 30), (0, None, None, "false", 30),
         (0, None, 1, "true", 30), (0, 500, 1, "false", 17), (0, 500, 1, "false", 91), (0, 500, 1, None, None)],
        "origin int, score int, target int, inactive string, age int",
    )
    rules = panel.study_exclusions(
        F.col("origin") == 1, ["score"], "target", F.col("inactive") == "true", "age",
        presets.AGE_RANGE, [f"0{i}" for i in range(1, 7)],
    )
    marked = panel.exclude(df, rules, "reason")
    got = [r["reason"] for r in marked.collect()]
    assert got == ["01", "02", "03", "04", "05", "06", "06", None]
    assert panel.eligible(marked, "reason").count() == 1
    assert sum(r["n"] for r in panel.counts(marked, ["reason"]).collect()) == 8


def test_scope_keeps_unknown(spark):
    df = spark.createDataFrame([(3, 1), (2, 1), (None, 5), (9, None)], "tenure int, paid int")
    assert rows(panel.out_of_scope(df, "tenure", "paid"), "tenure", "paid") == [(2, 1), (9, None), (None, 5)]


def test_samples_do_not_move_with_partitioning(spark):
    df = spark.range(5_000).withColumn("cohort", F.when(F.col("id") % 5 == 0, "2020-04").when(F.col("id") % 7 > 0, "2020-03"))
    pick = panel.sample_of("id", "cohort", "2020-04").alias("sample")
    one = df.coalesce(1).select("id", "cohort", pick)
    many = df.repartition(16).select("id", "cohort", pick)
    assert one.exceptAll(many).count() == 0
    # null cohorts are in-time
    assert one.filter("cohort is null and sample = 'oot'").count() == 0
    share = one.filter("sample = 'dev'").count() / one.filter("sample <> 'oot'").count()
    assert 0.77 < share < 0.83


def test_in_time_total(spark):
    df = spark.createDataFrame([("dev", 1), ("val", 2), ("oot", 3)], "sample string, n int")
    assert rows(panel.with_in_time_total(df), "sample", "n") == [("dev", 1), ("oot", 3), ("tot", 1), ("tot", 2), ("val", 2)]


def test_text_rules(spark):
    df = spark.createDataFrame([("GMAIL", "Samsung LG x"), (None, None), ("corp", "algo")], "domain string, device string")
    got = with_first_contained(df, "device", "brand").select(keep_listed(F.col("domain")), "brand").collect()
    assert [tuple(r) for r in got] == [("gmail", "samsung"), ("Outros/Erro", "outros"), ("Outros/Erro", "lg")]


def test_issuer_dictionary(spark):
    names = ["HSBC", "banco csf s/a", "n/a", None, "unheard of", "Chase"]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "id int, issuer string")
    got = group_by_dictionary(df, "issuer", "grp").orderBy("id").collect()
    assert [r["grp"] for r in got] == [
        "bradesco", "banco carrefour", "vazio", "vazio", "Outros", "bancos e fin. internacionais"
    ]


def test_class_bands_at_their_edges(spark):
    columns = "score int, age int, months double, days int, pay double, mental double, issuers int, state string"
    data = [
        (280, 17, None, None, None, None, None, "SP"), (281, 18, 0.0, 0, 0.0, 0.0, 0, "MG"),
        (1000, 90, 1.5, 10, 10.0, 10.0, 1, None), (1001, 91, 36.5, 721, 100.5, 50.5, 2, "DF"),
        (None, None, -1.0, -1, -0.5, -1.0, -1, "BA"),
    ]
    specs = [
        presets.score_bands("score", "a"), presets.age_bands("age", "b"), presets.tenure_bands("months", "c"),
        presets.recency_bands("days", "d"), presets.money_bands("pay", "e"), presets.index_bands("mental", "f", 10),
        presets.issuer_count_bands("issuers", "g"), presets.region_groups("state", "h"),
        presets.region_groups("state", "i", "others"),
    ]
    out = with_classes(spark.createDataFrame(data, columns), specs).select(*"abcdefghi").collect()
    assert [tuple(r) for r in out] == [
        ("01. 0 - 280", "99. Idade < 18 ou > 90", "01. Relacionamento <= 1 mês", "01. 0 dias", "01. R$ 0", "01. 0", "01. Qtde = 0", "SP", "SP"),
        ("02. 281 - 413", "01. 18 - 20", "01. Relacionamento <= 1 mês", "01. 0 dias", "01. R$ 0", "01. 0", "01. Qtde = 0", "Sudeste -SP", "Sudeste -SP"),
        ("10. 896 - 1000", "07. 51 - 90", "02. 1 < Relacionamento <= 3 meses", "02. 1 - 10 dias", "02. R$ 0 - 10", "02. 0 - 10", "02. Qtde = 1", None, "others"),
        ("99. Outros", "99. Idade < 18 ou > 90", "07. Relacionamento > 36 meses", "08. >= 721 dias", "05. > R$ 100", "04. > 50", "03. Qtde >= 2", "Centro-Oeste", "Centro-Oeste"),
        ("99. Outros", "999. Outros", "99. Outros", "99. Outros", "99. Outros", "99. Outros", "99. Outros", "Nordeste", "Nordeste"),
    ]


def test_all_fifteen_classes_resolve(spark):
    specs = presets.monitoring_classes("score")
    text = {"ddd_state", "agrupamento_instituicao_cartao_ref", "modelo_celular_ref", "email_ajuste"}
    df = spark.range(1).select(
        *[F.lit(None).cast("string" if s.column in text else "double").alias(s.column) for s in specs]
    )
    out = with_classes(df, specs).first()
    assert len(specs) == 15 and out["classe_instituicao_cartao"] == "vazio" and out["classe_idade"] == "999. Outros"


def _lots(df, lot="__lot"):
    return {r[0]: r[1] for r in df.groupBy(lot).count().collect()}


def test_heavy_keys_are_found_and_spread(spark):
    base = spark.range(9_000, numPartitions=6).select(
        F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 10 != 1, F.col("id")).alias("k"), F.lit("x").alias("c"))
    heavy = skew.find_heavy(base, ["k"], [T.LongType()], tasks=12)
    expected = spark.range(1).select(F.xxhash64(F.lit(7).cast("bigint"))).first()[0]
    assert list(heavy.copies) == [expected] and 4 <= heavy.copies[expected] <= 5 and heavy.null_lots == 1
    lots = _lots(skew.dealt(base.filter("k = 7"), ["k"], [T.LongType()], heavy))
    # All these rows are equal; the input partition in the hash deals them apart all the same.
    assert len(lots) > 1 and sum(lots.values()) == 3_001
    finer = skew.find_heavy(base, ["k"], [T.LongType()], tasks=60)
    assert finer.null_lots > 1
    empty = _lots(skew.dealt(base.filter("k is null"), ["k"], [T.LongType()], finer))
    assert len(empty) > 1 and set(empty) <= set(range(finer.null_lots))
    assert skew.find_heavy(base.limit(0), ["k"], [T.LongType()]) == skew.Heavy({})


@pytest.mark.parametrize("kind", ["int", "bigint", "string", "double"])
def test_automatic_salt_equals_plain_join(spark, kind):
    base = spark.range(4_000).select(
        F.when(F.col("id") % 2 == 0, 5).when(F.col("id") % 5 != 1, F.col("id") % 50).alias("a"),
        F.when(F.col("id") % 2 == 0, F.lit("hot")).when(F.col("id") % 7 != 0, (F.col("id") % 3).cast("string")).alias("b"), "id")
    # A repeated key on the right multiplies rows, as in any join.
    right = spark.range(60).select(F.col("id").cast(kind).alias("a"), F.lit("hot").alias("b"), F.col("id").alias("x"))
    right = right.unionByName(right.filter("x = 5")).unionByName(right.select(F.lit(None).cast(kind).alias("a"), "b", "x"))
    other = spark.range(3).select(F.lit(5).cast(kind).alias("a"), F.col("id").cast("string").alias("b"), F.col("id").alias("y"))
    wanted = base.join(right, ["a", "b"], "left").join(other, ["a", "b"], "left")
    found = panel.star_assembly(base, [panel.Satellite(s, ("a", "b"), salt="auto") for s in (right, other)])
    assert found.columns == wanted.columns
    assert wanted.exceptAll(found).count() == 0 and found.count() == wanted.count()
    # Kinds whose hashes could differ for equal keys aren't spread.
    spread = "__lot" in found._jdf.queryExecution().optimizedPlan().toString()
    assert spread == (kind in ("int", "bigint"))


def test_even_keys_are_joined_as_they_are(spark):
    base = spark.range(1_000).withColumnRenamed("id", "k")
    found = panel.star_assembly(base, [panel.Satellite(base.withColumn("x", F.col("k")), ("k",), salt="auto")])
    assert "__lot" not in found._jdf.queryExecution().optimizedPlan().toString() and found.count() == 1_000
