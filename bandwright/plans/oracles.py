"""DuckDB twins of the registered queries, written over the raw tables."""

from __future__ import annotations

from bandwright.functions import presets
from bandwright.plans import fullbase

BUCKET = "('0x' || substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 8))::BIGINT % 100"

PANEL = f"""panel AS (
  SELECT o_orderkey AS order_id, o_custkey AS consumer_id,
    CAST(year(o_orderdate) AS VARCHAR) AS ref_portfolio,
    CASE WHEN year(o_orderdate) = 2001 THEN 'oot' WHEN {BUCKET} < 80 THEN 'dev' ELSE 'val' END AS sample,
    CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS bad,
    CAST(floor(o_totalprice / 500) AS INTEGER) AS score_a,
    CAST(floor((c_acctbal + 1000) / 11) AS INTEGER) AS score_b,
    c_mktsegment AS segment, o_orderpriority AS priority, r_name AS region
  FROM orders LEFT JOIN customer ON o_custkey = c_custkey
  LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey)"""

FLAGS = {"a": "A", "n": "N", "r": "R"}
PRICE = {
    f: f"CASE WHEN l_returnflag = '{v}' THEN l_extendedprice END" for f, v in FLAGS.items()
}
BOOK_COLUMNS = [f"{k}_{f}" for f in FLAGS for k in ("am_min", "am_max", "am_tot", "am_avg", "ct_tot")]
BOOK = (
    "book AS (SELECT l_orderkey AS order_id, "
    + ", ".join(
        f"min({x}) AS am_min_{f}, max({x}) AS am_max_{f}, sum({x}) AS am_tot_{f}, "
        f"avg({x}) AS am_avg_{f}, count({x}) AS ct_tot_{f}"
        for f, x in PRICE.items()
    )
    + " FROM lineitem GROUP BY l_orderkey)"
)
MODELLING = (
    PANEL + ",\n" + BOOK + ",\nmodelling AS (SELECT panel.*, "
    + ", ".join(BOOK_COLUMNS)
    + " FROM panel LEFT JOIN book USING (order_id))"
)
DEV = MODELLING + ",\ndev AS (SELECT * FROM modelling WHERE sample = 'dev')"
PANEL_DEV = PANEL + ",\ndev AS (SELECT * FROM panel WHERE sample = 'dev')"
DOCS = """docs AS (SELECT d.doc_id, lang, source, n_chars, quality, toxic
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""
FEATURES = ["score_a", "score_b", *BOOK_COLUMNS]
CATEGORICAL = ["segment", "priority", "region"]
AMOUNTS = ["am_tot_a", "am_tot_n", "am_tot_r", "score_a", "score_b"]


def r(expression: str, digits: int = 6) -> str:
    return f"round({expression}, {digits}) + 0.0::DOUBLE"


def union(parts: list[str]) -> str:
    return "\nUNION ALL\n".join(parts)


def long(source: str, columns: list[str], keep: str, kind: str = "VARCHAR", name: str = "variable", value: str = "value") -> str:
    """Unpivot by UNION ALL."""
    lead = keep + ", " if keep else ""
    return union(
        [f"SELECT {lead}'{c}' AS {name}, CAST({c} AS {kind}) AS {value} FROM {source}" for c in columns]
    )


SQL: dict[str, str] = {}

# --- population -----------------------------------------------------------------------------

SQL["panel_assembly"] = (
    "WITH " + MODELLING + " SELECT order_id, consumer_id, ref_portfolio, sample, bad, score_a, score_b, "
    "segment, priority, region, "
    + ", ".join(f"{c}" if c.startswith("ct") else f"{r(c)} AS {c}" for c in BOOK_COLUMNS)
    + " FROM modelling"
)
SQL["dedup_lookup_join"] = """
SELECT o_orderkey AS order_id, o_orderstatus AS status, first_line, part_id, supp_id, price,
  CASE WHEN first_line IS NULL THEN 'no line' END AS exclusao
FROM orders LEFT JOIN (
  SELECT l_orderkey, l_linenumber AS first_line, l_partkey AS part_id, l_suppkey AS supp_id,
    l_extendedprice AS price,
    row_number() OVER (PARTITION BY l_orderkey
      ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS rn
  FROM lineitem) f ON o_orderkey = l_orderkey AND rn = 1"""
SQL["exclusion_waterfall"] = f"""
WITH {DOCS}, scored AS (
  SELECT *, least(CAST(floor(n_chars / 400) AS BIGINT), 999) AS score FROM docs
  WHERE NOT coalesce(n_chars >= 10000 AND quality >= 1, false))
SELECT CASE WHEN toxic = 1 THEN '01. Bad at origin' WHEN score = 0 THEN '02. Score = 0'
    WHEN score = 1 THEN '03. No hit' WHEN quality IS NULL THEN '04. No performance'
    WHEN lang = 'de' THEN '05. Inactive' WHEN n_chars < 1000 OR n_chars > 6000 THEN '06. Size out of range'
  END AS reason, count(*) AS n
FROM scored GROUP BY 1"""
PRODUCTION = """CASE WHEN score_b <= 360 THEN '01. Score <= 360'
  WHEN score_a < 18 OR score_a > 900 THEN '02. Out of range' END"""
SQL["production_exclusion"] = f"""
WITH {PANEL}, m AS (SELECT {PRODUCTION} AS reason FROM panel)
SELECT reason, count(*) AS n, CAST(reason IS NULL AS INTEGER) AS kept FROM m GROUP BY reason"""
SQL["lookup_check"] = f"""
WITH {PANEL} SELECT order_id, score_a, score_b FROM panel
WHERE ref_portfolio = '1996' AND segment = 'BUILDING' AND priority = '1-URGENT'
  AND region IN ('ASIA', 'EUROPE') AND score_b >= 500"""
SQL["split_samples"] = f"""
WITH {PANEL} SELECT sample, count(*) AS n, CAST(sum(bad) AS BIGINT) AS bad FROM panel GROUP BY sample"""
LATEST = """latest AS (SELECT user_id, event_type, value FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_type DESC, value DESC) AS rn
  FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL) WHERE rn = 1)"""
SQL["latest_attributes"] = f"WITH {LATEST} SELECT * FROM latest"
SQL["latest_counts"] = f"WITH {LATEST} SELECT event_type, count(*) AS n FROM latest GROUP BY event_type"

# --- normalisation --------------------------------------------------------------------------

_domains = ", ".join(f"'{d}'" for d in (*presets.EMAIL_DOMAINS, "example", "mail2"))
_brands = " ".join(f"WHEN contains(lower(body), '{b}') THEN '{b}'" for b in presets.DEVICE_BRANDS)
SQL["normalise_text"] = rf"""
WITH t AS (
  SELECT 'pages' AS origin, regexp_extract(url, '://(?:[a-z]+\.)*([a-z]+)\.[a-z]+/', 1) AS domain, html AS body FROM pages
  UNION ALL
  SELECT 'documents', regexp_extract(text, '@([A-Za-z0-9-]+)\.', 1), text FROM documents)
SELECT origin, CASE WHEN lower(domain) IN ({_domains}) THEN lower(domain) ELSE 'Outros/Erro' END AS domain_group,
  CASE {_brands} ELSE 'outros' END AS brand, count(*) AS n
FROM t GROUP BY 1, 2, 3"""
SQL["dictionary_group"] = """
WITH g AS (
  SELECT 'part' AS variable, CASE WHEN p_type IS NULL THEN 'vazio'
      WHEN lower(p_type) IN ('small', 'economy') THEN 'small'
      WHEN lower(p_type) IN ('large', 'promo') THEN 'large' ELSE 'Outros' END AS "group" FROM part
  UNION ALL
  SELECT 'nation', CASE WHEN n_name IN ('NATION_0', 'NATION_1', 'NATION_2', 'NATION_3', 'NATION_4') THEN 'north'
      WHEN n_name IN ('NATION_5', 'NATION_6', 'NATION_7') THEN 'south' ELSE n_name END
  FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey)
SELECT variable, "group", count(*) AS n FROM g GROUP BY 1, 2"""
SQL["clean_numeric"] = f"""
WITH {MODELLING}, raw AS (
  SELECT order_id, am_avg_a, am_min_r, am_tot_n,
    CASE WHEN score_b <> 0 THEN score_a::DOUBLE / score_b END AS ratio,
    try_cast(substr(priority, 1, 1) AS DOUBLE) AS priority_code,
    try_cast(substr(segment, 1, 1) AS DOUBLE) AS not_a_number FROM modelling),
means AS (SELECT avg(am_avg_a) AS a, avg(am_min_r) AS b, avg(ratio) AS c, avg(priority_code) AS d FROM raw)
SELECT order_id, {r('coalesce(am_avg_a, a)')} AS am_avg_a, {r('coalesce(am_min_r, b)')} AS am_min_r,
  {r('coalesce(am_tot_n, 0)')} AS zero_am_tot_n, {r('coalesce(ratio, c)')} AS ratio,
  {r('coalesce(priority_code, d)')} AS priority_code, coalesce(not_a_number, 0)::DOUBLE AS not_a_number
FROM raw, means"""
SQL["clean_categorical"] = f"""
WITH {DOCS} SELECT doc_id, coalesce(lang, 'others') AS lang,
  CASE WHEN toxic = 1 THEN 'True' WHEN toxic IS NULL THEN 'others' ELSE 'False' END AS toxic_flag,
  coalesce(CAST(quality AS VARCHAR), 'others') AS quality_text FROM docs"""
SQL["median_mode_impute"] = f"""
WITH {MODELLING}, raw AS (SELECT order_id, am_avg_a, nullif(segment, 'BUILDING') AS segment FROM modelling),
mid AS (SELECT quantile_cont(am_avg_a, 0.5) AS m FROM raw),
top AS (SELECT segment AS s FROM raw WHERE segment IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
SELECT order_id, {r('coalesce(am_avg_a, m)')} AS am_avg_a, coalesce(segment, s) AS segment FROM raw, mid, top"""


def band_case(x: str, uppers, labels, other: str, points=None, low=None, closed=True, outside=None, null=None) -> str:
    """The same bands written with explicit lower bounds."""
    outside = other if outside is None else outside
    whens = [f"WHEN {x} IS NULL THEN '{other if null is None else null}'"]
    whens += [f"WHEN {x} = {v} THEN '{label}'" for v, label in (points or {}).items()]
    below = low
    for upper, label in zip(uppers, labels):
        tests = []
        if below is not None:
            tests.append(f"{x} {'>=' if below is low and closed and low is not None else '>'} {below}")
        if upper is not None:
            tests.append(f"{x} <= {upper}")
        whens.append(f"WHEN {' AND '.join(tests)} THEN '{label}'")
        below = upper
    return f"CASE {' '.join(whens)} ELSE '{outside}' END"


_P = presets
def group_case(x: str, groups: dict[str, tuple[str, ...]], default: str | None, null: str | None = None) -> str:
    """Lists of exact values; without a default a value passes through."""
    whens = [f"WHEN {x} IS NULL THEN {'NULL' if (null or default) is None else chr(39) + (null or default) + chr(39)}"]
    for label, values in groups.items():
        listed = ", ".join(f"'{v}'" for v in values)
        whens.append(f"WHEN {x} IN ({listed}) THEN '{label}'")
    return f"CASE {' '.join(whens)} ELSE {x if default is None else chr(39) + default + chr(39)} END"


def _money(x: str) -> str:
    return band_case(x, _P.MONEY_UPPERS, _P.MONEY_LABELS, _P.OTHER, {0: "01. R$ 0"}, 0, False, None, "01. R$ 0")


def _index(x: str, first: int) -> str:
    labels = (f"02. 0 - {first}", f"03. {first} - 50", "04. > 50")
    return band_case(x, (first, 50, None), labels, _P.OTHER, {0: "01. 0"}, 0, False, None, "01. 0")


_BANKS = {
    "caixa": ("caixa economica federal",), "bradesco": ("bradesco",), "nubank": ("nu pagamentos sa",),
    "itau": ("itau",), "santander": ("santander",), "banco do brasil": ("banco do brasil",),
    "banco original": ("banco original",), "vazio": ("vazio", "Outros"),
}


def classes(score: str, null_state: str | None = None) -> dict[str, str]:
    """The fifteen monitoring classes over `monitored`."""
    kept = lambda x, values: group_case(x, {v: (v,) for v in values}, "Outros")
    return {
        "classe_score": band_case(score, _P.MODEL_SCORE_UPPERS, _P.MODEL_SCORE_LABELS, _P.OTHER),
        "classe_HSPA": band_case("HSPA", _P.BUREAU_SCORE_UPPERS, _P.BUREAU_SCORE_LABELS, _P.OTHER),
        "classe_idade": band_case(
            "idade_em_anos", _P.AGE_UPPERS, _P.AGE_LABELS, "999. Outros", None, 18, True, "99. Idade < 18 ou > 90"
        ),
        "classe_ddd_state": group_case("ddd_state", _P.STATE_REGIONS, None, null_state),
        "classe_tempo_relacionamento": band_case(
            "tempo_registro_em_meses", _P.TENURE_UPPERS, _P.TENURE_LABELS, _P.OTHER, None, 0, True, None,
            _P.TENURE_LABELS[0],
        ),
        "classe_last_transaction": band_case(
            "days_since_last_transaction", _P.RECENCY_UPPERS, _P.RECENCY_LABELS, _P.OTHER, {0: "01. 0 dias"}, 0,
            False, None, "01. 0 dias",
        ),
        "classe_instituicao_cartao": group_case("agrupamento_instituicao_cartao_ref", _BANKS, "outras ifs", "vazio"),
        "classe_am_max_pay_12m_trx": _money("am_max_pay_12m_trx"),
        "classe_modelo_celular": kept("modelo_celular_ref", ("samsung", "motorola", "iphone", "xiaomi", "lg")),
        "classe_mental_accounting_score": _index("mental_accounting_score", 10),
        "classe_peer_effect_score": _index("peer_effect_score", 20),
        "classe_email_ajuste": kept("email_ajuste", ("gmail", "hotmail", "outlook", "yahoo")),
        "classe_am_max_recp2p_12m_trx": _money("am_max_recp2p_12m_trx"),
        "classe_emissores_distintos": band_case(
            "qtde_emissores_distintos", (None,), ("03. Qtde >= 2",), _P.OTHER, {0: "01. Qtde = 0", 1: "02. Qtde = 1"},
            1, False, None, "01. Qtde = 0",
        ),
        "classe_am_max_payp2pbal_12m_trx": _money("am_max_payp2pbal_12m_trx"),
    }


def _picked(values: tuple[str, ...], key: str) -> str:
    listed = ", ".join(f"'{v}'" for v in values)
    return f"([{listed}])[{key} % {len(values)} + 1]"


MONITORED = MODELLING + f""",
monitored AS (SELECT modelling.*, strftime(o_orderdate, '%Y-%m-%d') AS referenced_at, score_b AS HSPA,
  consumer_id % 85 + 12 AS idade_em_anos,
  {_picked(("AC", "PA", "BA", "CE", "MG", "RJ", "SP", "PR", "RS", "DF"), "consumer_id")} AS ddd_state,
  consumer_id % 50 AS tempo_registro_em_meses,
  CASE WHEN order_id % 9 <> 0 THEN order_id % 800 END AS days_since_last_transaction,
  {_picked(("nubank", "itau", "nu pagamentos sa", "vazio", "santander", "bradesco", "Outros", "banco original"), "order_id")}
    AS agrupamento_instituicao_cartao_ref,
  am_max_a / 500 AS am_max_pay_12m_trx,
  {_picked(("samsung", "motorola", "iphone", "nokia", "xiaomi", "lg", "asus"), "order_id")} AS modelo_celular_ref,
  score_b % 101 AS mental_accounting_score, score_a % 101 AS peer_effect_score,
  {_picked(("gmail", "hotmail", "uol", "outlook", "yahoo", "Outros/Erro"), "consumer_id")} AS email_ajuste,
  am_max_n / 500 AS am_max_recp2p_12m_trx, ct_tot_r AS qtde_emissores_distintos,
  am_max_r / 500 AS am_max_payp2pbal_12m_trx
  FROM modelling JOIN orders ON o_orderkey = order_id)"""


def _marked(found: dict[str, str]) -> str:
    return ", ".join(f"{case} AS {name}" for name, case in found.items())


CLASSES = classes("score_a")
SQL["class_bands"] = f"""
WITH {MONITORED}, marked AS (SELECT ref_portfolio, {_marked(CLASSES)} FROM monitored),
l AS ({long('marked', list(CLASSES), 'ref_portfolio', value='class')})
SELECT ref_portfolio, variable, class, count(*) AS n FROM l GROUP BY ALL"""
PRODUCED = f"""produced AS (SELECT order_id, consumer_id, referenced_at, score_a AS score,
    substr(referenced_at, 1, 7) AS safra, {_marked(classes('score_a', 'others'))}
  FROM monitored WHERE ref_portfolio = '2001' AND score_a % 7 <> 0 AND score_a > 1 AND referenced_at >= '2001-02-01')"""
SQL["score_log_join"] = f"WITH {MONITORED}, {PRODUCED} SELECT * FROM produced"
SQL["integer_score"] = """
SELECT CAST(trunc(((c_acctbal + 1000) / 11000) * 1000) AS INTEGER) AS score, 'm1' AS model_id, count(*) AS n
FROM customer GROUP BY 1"""

# --- profiles -------------------------------------------------------------------------------

_text = {"ref_portfolio", "sample", "segment", "priority", "region"}
_all = ["order_id", "consumer_id", "ref_portfolio", "sample", "bad", "score_a", "score_b", "segment",
        "priority", "region", *BOOK_COLUMNS]
_profile = union(
    [
        f"SELECT '{c}' AS variable, count(*) AS rows, count(*) FILTER (WHERE {c} IS NULL) AS missing, "
        + ("NULL::BIGINT" if c in _text else f"count(*) FILTER (WHERE {c} = 0)")
        + " AS zeros FROM modelling"
        for c in _all
    ]
)
SPARSE = f"""prof AS (SELECT variable, rows, CAST(missing AS BIGINT) AS missing, CAST(zeros AS BIGINT) AS zeros,
  (missing + coalesce(zeros, 0))::DOUBLE / rows AS share FROM ({_profile}))"""
SQL["sparse_profile"] = f"""
WITH {MODELLING}, {SPARSE}
SELECT variable, rows, missing, zeros, {r('share')} AS share, share > 0.2 AS "drop" FROM prof"""
SQL["drop_sparse"] = f"""
WITH {MODELLING}, {SPARSE}
SELECT variable, rows - missing AS filled FROM prof WHERE share <= 0.2 OR variable = 'order_id'"""
SHARES = f"""l AS ({long('panel', CATEGORICAL, 'ref_portfolio')}),
tally AS (SELECT ref_portfolio, variable, value, count(*) AS n FROM l
  WHERE ref_portfolio IS NOT NULL AND value IS NOT NULL GROUP BY ALL),
shares AS (SELECT *, n * 100.0::DOUBLE / sum(n) OVER (PARTITION BY ref_portfolio, variable) AS pct FROM tally)"""
SQL["cohort_share"] = f"""
WITH {PANEL}, {SHARES} SELECT ref_portfolio, variable, value, n, {r('pct')} AS pct FROM shares"""
SQL["cohort_share_wide"] = f"WITH {PANEL}, {SHARES} SELECT ref_portfolio, " + ", ".join(
    f"max(CASE WHEN value = '{v}' THEN {r('pct')} END) AS {v}"
    for v in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
) + " FROM shares WHERE variable = 'segment' GROUP BY ref_portfolio"
SQL["numeric_summary"] = f"""
WITH {MODELLING}, l AS ({long('modelling', AMOUNTS, 'sample', 'DOUBLE')})
SELECT sample, variable, count(value) AS n, {r('avg(value)', 4)} AS mean, {r('stddev_samp(value)', 4)} AS std,
  {r('min(value)', 4)} AS min, {r('quantile_cont(value, 0.25)', 4)} AS q1,
  {r('quantile_cont(value, 0.5)', 4)} AS median, {r('quantile_cont(value, 0.75)', 4)} AS q3,
  {r('max(value)', 4)} AS max
FROM l GROUP BY sample, variable"""
SQL["boxplot_stats"] = f"""
WITH {MODELLING}, l AS ({long('modelling', AMOUNTS, 'ref_portfolio', 'DOUBLE')}),
b AS (SELECT ref_portfolio, variable, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS q2,
  quantile_cont(value, 0.75) AS q3 FROM l GROUP BY ALL),
j AS (SELECT l.*, q1, q2, q3, value BETWEEN q1 - (q3 - q1) * 1.5::DOUBLE AND q3 + (q3 - q1) * 1.5::DOUBLE AS ok
  FROM l JOIN b USING (ref_portfolio, variable) WHERE value IS NOT NULL)
SELECT ref_portfolio, variable, count(*) AS n, {r('any_value(q1)', 4)} AS q1, {r('any_value(q2)', 4)} AS median,
  {r('any_value(q3)', 4)} AS q3, {r('min(CASE WHEN ok THEN value END)', 4)} AS whisker_low,
  {r('max(CASE WHEN ok THEN value END)', 4)} AS whisker_high, CAST(count(*) FILTER (WHERE NOT ok) AS BIGINT) AS outliers
FROM j GROUP BY ref_portfolio, variable"""
SQL["filtered_median"] = f"""
WITH {PANEL} SELECT 'score_a' AS variable, {r('quantile_cont(score_a::DOUBLE, 0.5)')} AS median, count(score_a) AS n
FROM panel WHERE score_b <= 360 AND sample = 'dev'"""

# --- screening ------------------------------------------------------------------------------

_corr = union(
    [
        f"""SELECT '{c}' AS variable, count(*) AS n, corr(coalesce({c}, m)::DOUBLE, bad::DOUBLE) AS r
FROM dev, (SELECT quantile_cont({c}::DOUBLE, 0.5) AS m FROM dev)"""
        for c in FEATURES
    ]
)
BISERIAL = f"""pb AS (SELECT variable, n, r, r * sqrt((n - 2) / (1 - r * r)) AS t FROM ({_corr}))"""
# |t| beyond which p <= 0.05, as a series in 1/dof (dof is in the thousands)
T_CRITICAL = "(1.959963984540054 + 2.372271221 / (n - 2) + 2.8224985 / ((n - 2) * (n - 2)))"
SQL["point_biserial"] = f"WITH {DEV}, {BISERIAL} SELECT variable, n, {r('r')} AS r, {r('t')} AS t FROM pb"
SQL["point_biserial_decision"] = f"""
WITH {DEV}, {BISERIAL} SELECT variable,
  CASE WHEN abs(t) >= {T_CRITICAL} THEN 'Reject H0' ELSE 'Accept H0' END AS result FROM pb"""

# chi-square values beyond which p <= 0.05, by degrees of freedom 1..20
CHI_CRITICAL = (
    3.841459, 5.991465, 7.814728, 9.487729, 11.070498, 12.591587, 14.067140, 15.507313, 16.918978,
    18.307038, 19.675138, 21.026070, 22.362032, 23.684791, 24.995790, 26.296228, 27.587112,
    28.869299, 30.143527, 31.410433,
)


def chi_square(source: str, columns: list[str], target: str) -> str:
    return f"""SELECT variable, CASE WHEN evaluable THEN chi2 END AS chi2, dof, evaluable,
  CASE WHEN evaluable AND chi2 >= ([{', '.join(map(str, CHI_CRITICAL))}])[dof] THEN 'Reject H0'
    ELSE 'Accept H0' END AS result
FROM (SELECT variable, sum(cell) AS chi2, any_value(levels) - 1 AS dof, min(least(g, b)) >= 5 AS evaluable FROM (
  SELECT *, pow(abs(g - eg) - y * least(0.5::DOUBLE, abs(g - eg)), 2) / eg
    + pow(abs(b - eb) - y * least(0.5::DOUBLE, abs(b - eb)), 2) / eb AS cell FROM (
    SELECT *, (g + b) * ag::DOUBLE / (ag + ab) AS eg, (g + b) * ab::DOUBLE / (ag + ab) AS eb,
      CASE WHEN levels = 2 THEN 1 ELSE 0 END AS y FROM (
      SELECT *, sum(g) OVER w AS ag, sum(b) OVER w AS ab, count(*) OVER w AS levels FROM (
        SELECT variable, value, count(*) FILTER (WHERE {target} = 0) AS g, count(*) FILTER (WHERE {target} = 1) AS b
        FROM ({long(source, columns, target)}) WHERE value IS NOT NULL AND {target} IS NOT NULL
        GROUP BY variable, value) WINDOW w AS (PARTITION BY variable)))) GROUP BY variable)"""


SQL["chi_square"] = f"""
WITH {PANEL_DEV}, two AS (SELECT *, CASE WHEN score_a > 400 THEN 'yes' ELSE 'no' END AS high FROM dev), {DOCS}
SELECT variable, {r('chi2')} AS chi2, CAST(dof AS BIGINT) AS dof, evaluable, result FROM (
{chi_square('two', [*CATEGORICAL, 'ref_portfolio', 'high'], 'bad')}
UNION ALL {chi_square('docs', ['lang', 'source'], 'toxic')})"""


def woe(source: str, columns: list[str], target: str, null_level: bool = False) -> str:
    value = "coalesce(value, 'null')" if null_level else "value"
    good = "sum(g) OVER w" if null_level else (
        "sum(n) OVER w - sum(CASE WHEN value IS NOT NULL THEN b ELSE 0 END) OVER w"
    )
    bad = "sum(b) OVER w" if null_level else "sum(CASE WHEN value IS NOT NULL THEN b ELSE 0 END) OVER w"
    return f"""SELECT variable, value, g AS good, b AS bad, dg AS dist_good, db AS dist_bad,
  CASE WHEN g > 0 AND b > 0 THEN ln(dg / db) ELSE 0 END AS woe,
  CASE WHEN g > 0 AND b > 0 THEN ln(dg / db) * (dg - db) ELSE 0 END AS iv
FROM (SELECT *, g / tg::DOUBLE AS dg, b / tb::DOUBLE AS db FROM (
  SELECT *, {good} AS tg, {bad} AS tb FROM (
    SELECT variable, {value} AS value, count(*) FILTER (WHERE {target} = 0) AS g, count(*) FILTER (WHERE {target} = 1) AS b, count(*) AS n
    FROM ({long(source, columns, target)}) GROUP BY 1, 2) WINDOW w AS (PARTITION BY variable)))
WHERE value IS NOT NULL"""


def woe_rounded(body: str, key: str = "value") -> str:
    return f"""SELECT variable, {key}, CAST(good AS BIGINT) AS good, CAST(bad AS BIGINT) AS bad,
  {r('dist_good')} AS dist_good, {r('dist_bad')} AS dist_bad, {r('woe')} AS woe, {r('iv')} AS iv FROM ({body})"""


SQL["woe_table"] = f"WITH {PANEL_DEV}, {DOCS} " + woe_rounded(
    woe("dev", CATEGORICAL, "bad") + " UNION ALL " + woe("docs", ["lang", "quality"], "toxic")
)
SQL["woe_table_null_level"] = f"WITH {DOCS} " + woe_rounded(woe("docs", ["lang", "quality"], "toxic", True))
SQL["iv_categorical"] = f"""
WITH {PANEL_DEV} SELECT variable, {r('sum(iv)')} AS iv FROM ({woe('dev', CATEGORICAL, 'bad')}) GROUP BY variable"""
_inner = " + ".join(f"(value > lo + {i} * ((hi - lo) / 10))::INT" for i in range(1, 10))
NUMERIC_IV = f"""banded AS (
  SELECT variable, 1 + {_inner} AS band, bad FROM (
    SELECT *, min(value) OVER (PARTITION BY variable) AS lo, max(value) OVER (PARTITION BY variable) AS hi
    FROM ({long('dev', FEATURES, 'bad', 'DOUBLE')}) WHERE value IS NOT NULL)),
cells AS (SELECT variable, band, count(*) FILTER (WHERE bad = 0) AS g, count(*) FILTER (WHERE bad = 1) AS b FROM banded GROUP BY ALL),
dists AS (SELECT *, g / (sum(g) OVER w)::DOUBLE AS dg, b / (sum(b) OVER w)::DOUBLE AS db FROM cells
  WINDOW w AS (PARTITION BY variable)),
iv_num AS (SELECT variable, sum(CASE WHEN g > 0 AND b > 0 THEN ln(dg / db) * (dg - db) ELSE 0 END) AS iv
  FROM dists GROUP BY variable)"""
SQL["iv_numeric"] = f"WITH {DEV}, {NUMERIC_IV} SELECT variable, {r('iv')} AS iv FROM iv_num"
_pairs = union(
    [
        f"SELECT '{a}' AS col_a, '{b}' AS col_b, abs(corr(coalesce({a}, 0)::DOUBLE, coalesce({b}, 0)::DOUBLE)) AS abs_r FROM dev"
        for i, a in enumerate(FEATURES)
        for b in FEATURES[i + 1 :]
    ]
)
SQL["correlation_pairs"] = f"WITH {DEV} SELECT col_a, col_b, {r('abs_r')} AS abs_r FROM ({_pairs})"
_missing = union(
    [
        f"SELECT '{c}' AS variable, (count(*) FILTER (WHERE {c} IS NULL)"
        + ("" if c in CATEGORICAL else f" + count(*) FILTER (WHERE {c} = 0)")
        + ")::DOUBLE / count(*) AS share FROM dev"
        for c in [*FEATURES, *CATEGORICAL]
    ]
)
SQL["select_features"] = f"""
WITH {DEV}, {BISERIAL}, {NUMERIC_IV},
chi AS ({chi_square('dev', CATEGORICAL, 'bad')}),
iv AS (SELECT * FROM iv_num UNION ALL
  SELECT variable, sum(iv) AS iv FROM ({woe('dev', CATEGORICAL, 'bad')}) GROUP BY variable),
cp AS ({_pairs}),
found AS (
  SELECT variable, 'sparse' AS reason FROM ({_missing}) WHERE share > 0.95
  UNION ALL SELECT variable, 'point_biserial' FROM pb WHERE abs(t) < {T_CRITICAL}
  UNION ALL SELECT variable, 'chi_square' FROM chi WHERE result = 'Accept H0'
  UNION ALL SELECT variable, 'low_iv' FROM iv WHERE iv < 0.002
  UNION ALL SELECT * FROM (SELECT DISTINCT CASE WHEN a.iv < b.iv THEN col_a WHEN b.iv < a.iv THEN col_b
      ELSE greatest(col_a, col_b) END AS variable, 'correlated' AS reason
    FROM cp JOIN iv a ON a.variable = col_a JOIN iv b ON b.variable = col_b WHERE abs_r > 0.8)
  UNION ALL SELECT 'am_min_r', 'excluded')
SELECT variable, reason FROM found WHERE variable <> 'score_a'"""


def smoothed(source: str, column: str) -> str:
    return f"""(SELECT {column} AS level, ln((b + 1) / (tb + 2.0::DOUBLE)) - ln((g + 1) / (tg + 2.0::DOUBLE)) AS w FROM (
  SELECT *, sum(g) OVER () AS tg, sum(b) OVER () AS tb FROM (
    SELECT {column}, count(*) FILTER (WHERE bad = 0) AS g, count(*) FILTER (WHERE bad = 1) AS b FROM {source} GROUP BY 1)))"""


SQL["woe_encode"] = f"""
WITH {PANEL}, raw AS (SELECT *, nullif(segment, 'BUILDING') AS seg FROM panel),
top AS (SELECT seg AS s FROM raw WHERE seg IS NOT NULL AND sample = 'dev' GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
filled AS (SELECT order_id, sample, bad, priority, coalesce(seg, s) AS seg FROM raw, top),
fd AS (SELECT * FROM filled WHERE sample = 'dev')
SELECT order_id, {r('coalesce(a.w, 0)')} AS segment_woe, {r('coalesce(b.w, 0)')} AS priority_woe
FROM filled LEFT JOIN {smoothed('fd', 'seg')} a ON seg = a.level
LEFT JOIN {smoothed('fd', 'priority')} b ON priority = b.level"""
SQL["woe_encode_join"] = f"""
WITH {PANEL_DEV} SELECT order_id, {r('coalesce(w, 0)')} AS consumer_id_woe
FROM panel LEFT JOIN {smoothed('dev', 'consumer_id')} ON consumer_id = level"""
SQL["class_weights"] = f"""
WITH {PANEL_DEV} SELECT bad, count(*) AS n, {r('sum(count(*)) OVER () / (2.0::DOUBLE * count(*))')} AS weight
FROM dev GROUP BY bad"""

# --- evaluation -----------------------------------------------------------------------------


def histogram(source: str, scores: dict[str, str]) -> str:
    """Running totals per (sample, score)."""
    rows = union(
        [
            f"SELECT sample, bad, '{n}' AS score_name, {c} AS score FROM {source} WHERE {c} IS NOT NULL"
            for n, c in scores.items()
        ]
    )
    return f"""h AS (SELECT sample, score_name, score, count(*) FILTER (WHERE bad = 0) AS g, count(*) FILTER (WHERE bad = 1) AS b
  FROM ({rows}) GROUP BY ALL),
c AS (SELECT *, sum(g) OVER w AS gu, sum(b) OVER w AS bu, sum(g) OVER k AS ag, sum(b) OVER k AS ab FROM h
  WINDOW w AS (PARTITION BY sample, score_name ORDER BY score ROWS UNBOUNDED PRECEDING),
    k AS (PARTITION BY sample, score_name))"""


BOTH = {"score_a": "score_a", "score_b": "score_b"}


def auc(source: str, scores: dict[str, str], low: bool) -> str:
    value = "sum(b * (gu - g + g / 2.0::DOUBLE)) / (sum(g)::DOUBLE * sum(b))"
    value = f"1 - {value}" if low else value
    return f"""{histogram(source, scores)}
SELECT sample, score_name, good, bad, {r('auc')} AS auc, {r('2 * (auc - 0.5::DOUBLE)')} AS gini FROM (
  SELECT sample, score_name, CAST(sum(g) AS BIGINT) AS good, CAST(sum(b) AS BIGINT) AS bad, {value} AS auc
  FROM c GROUP BY 1, 2)"""


SQL["auc_gini"] = f"WITH {PANEL}, {auc('panel', BOTH, True)}"
SQL["auc_gini_fractional"] = (
    f"WITH {MODELLING}, {auc('modelling', {'mean_price': 'am_avg_a', 'score_a': 'score_a::DOUBLE'}, False)}"
)
SQL["roc_points"] = f"""
WITH {PANEL}, {histogram('panel', BOTH)}
SELECT sample, score_name, CAST(score AS INTEGER) AS threshold, {r('(ag - gu + g) / ag::DOUBLE')} AS fpr,
  {r('(ab - bu + b) / ab::DOUBLE')} AS tpr FROM c
UNION ALL SELECT DISTINCT sample, score_name, NULL::INTEGER, 0.0::DOUBLE, 0.0::DOUBLE FROM c"""
SQL["ks_two_sample"] = f"""
WITH {PANEL}, {histogram('panel', BOTH)}
SELECT sample, score_name, CAST(sum(g) AS BIGINT) AS good, CAST(sum(b) AS BIGINT) AS bad,
  {r('max(abs(gu / ag::DOUBLE - bu / ab::DOUBLE))')} AS ks FROM c GROUP BY 1, 2"""
# Asymptotic tail: twice the alternating series, whose terms beyond 100 are 0 in double precision.
SQL["ks_p_value"] = f"""
WITH {PANEL}, {histogram('panel', BOTH)},
d AS (SELECT sample, score_name, CAST(sum(g) AS BIGINT) AS good, CAST(sum(b) AS BIGINT) AS bad,
    max(abs(gu / ag::DOUBLE - bu / ab::DOUBLE)) AS ks FROM c GROUP BY 1, 2),
z AS (SELECT *, ks * sqrt(good * bad / (good + bad)::DOUBLE) AS z FROM d)
SELECT sample, score_name, good, bad, {r('ks')} AS ks, {r("""CASE WHEN z < 0.2 THEN 1.0::DOUBLE ELSE least(greatest(
  2 * list_sum(list_transform(range(1, 101), lambda k: (CASE WHEN k % 2 = 1 THEN 1 ELSE -1 END) * exp(-2 * (k * z) ** 2))),
  0), 1) END""")} AS p_value FROM z"""
SQL["ks_curve"] = f"""
WITH {PANEL}, {histogram('panel', BOTH)}
SELECT sample, score_name, CAST(score AS INTEGER) AS threshold, {r('gu / ag::DOUBLE')} AS cum_good,
  {r('bu / ab::DOUBLE')} AS cum_bad, {r('bu / ab::DOUBLE - gu / ag::DOUBLE')} AS difference FROM c"""

SCORE_C = "CAST(floor((score_a + score_b) / 2) AS INTEGER)"
DECILES = "[0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]"


def gains(source: str, scores: dict[str, str], segments: dict[str, str] | None = None, total: bool = False, zero: bool = False) -> str:
    groups = {"all": "TRUE", **(segments or {})}
    rows = union(
        [
            f"""SELECT '{s}' AS segment, '{n}' AS score_name, sample, bad, ({c})::DOUBLE AS x FROM {source} WHERE {cond}"""
            for s, cond in groups.items()
            for n, c in scores.items()
        ]
    )
    tot = (
        "UNION ALL SELECT segment, score_name, 'tot' AS sample, bad, x FROM r0 WHERE sample IN ('dev', 'val')"
        if total
        else ""
    )
    zero_case = "WHEN x = 0 THEN 1" if zero else ""
    lo = "CASE WHEN band = 1 THEN '0' ELSE round(edges[band], 2)::VARCHAR END"
    hi = "CASE WHEN band = len(edges) - 1 THEN '1000' ELSE round(edges[band + 1], 2)::VARCHAR END"
    lead = "segment, " if segments else ""
    return f"""r0 AS ({rows}),
r1 AS (SELECT * FROM r0 {tot}),
e AS (SELECT segment, score_name, list_sort(list_distinct(list_concat([0.0::DOUBLE], list_filter(
    list_transform(quantile_cont(x, {DECILES}), lambda q: round(q, 9)), lambda q: q > 0 AND q < 1000),
    [1000.0::DOUBLE]))) AS edges
  FROM r0 WHERE sample = 'dev' AND x IS NOT NULL GROUP BY ALL),
m AS (SELECT r1.*, edges, len(list_filter(edges, lambda q: q < x)) AS below FROM r1 JOIN e USING (segment, score_name)),
bd AS (SELECT *, CASE {zero_case} WHEN below BETWEEN 1 AND len(edges) - 1 AND x IS NOT NULL THEN below END AS band FROM m),
cnt AS (SELECT segment, score_name, sample, band, count(*) FILTER (WHERE bad = 0) AS g, count(*) FILTER (WHERE bad = 1) AS b FROM bd GROUP BY ALL),
tt AS (SELECT segment, score_name, sample, sum(g) AS ag, sum(b) AS ab FROM cnt GROUP BY ALL),
sk AS (SELECT segment, score_name, sample, edges, ag, ab, unnest(range(1, len(edges))) AS band
    FROM tt JOIN e USING (segment, score_name)
  UNION ALL SELECT cnt.segment, cnt.score_name, cnt.sample, edges, ag, ab, NULL FROM cnt
    JOIN tt ON cnt.segment = tt.segment AND cnt.score_name = tt.score_name AND cnt.sample = tt.sample
    JOIN e ON cnt.segment = e.segment AND cnt.score_name = e.score_name WHERE cnt.band IS NULL),
f AS (SELECT sk.*, coalesce(g, 0) AS good, coalesce(b, 0) AS bad FROM sk LEFT JOIN cnt
  ON sk.segment = cnt.segment AND sk.score_name = cnt.score_name AND sk.sample = cnt.sample
    AND sk.band IS NOT DISTINCT FROM cnt.band),
w AS (SELECT *, CASE WHEN band IS NOT NULL THEN sum(CASE WHEN band IS NOT NULL THEN good END) OVER o / ag::DOUBLE END AS cg,
    CASE WHEN band IS NOT NULL THEN sum(CASE WHEN band IS NOT NULL THEN bad END) OVER o / ab::DOUBLE END AS cb
  FROM f WINDOW o AS (PARTITION BY segment, score_name, sample ORDER BY band NULLS FIRST ROWS UNBOUNDED PRECEDING))
SELECT {lead}score_name, sample, CAST(band AS INTEGER) AS band,
  CASE WHEN band IS NOT NULL THEN '(' || {lo} || '-' || {hi} || ')' END AS "range",
  CAST(good AS BIGINT) AS good, CAST(bad AS BIGINT) AS bad, CAST(good + bad AS BIGINT) AS total,
  {r('good / ag::DOUBLE')} AS pct_good, {r('bad / ab::DOUBLE')} AS pct_bad,
  {r('(good + bad) / (ag + ab)::DOUBLE')} AS pct_total, {r('cg')} AS cum_good, {r('cb')} AS cum_bad,
  {r('round_even(cb - cg, 4) * 100')} AS ks FROM w"""


ONE = {"score_a": "score_a"}
THREE = {"score_a": "score_a", "score_b": "score_b", "score_c": SCORE_C}
SQL["gains_table"] = f"WITH {PANEL}, {gains('panel', ONE)}"
SQL["gains_by_sample"] = f"WITH {PANEL}, {gains('panel', THREE, total=True)}"
SQL["gains_zero_first"] = f"WITH {PANEL}, {gains('panel', {'score_b': 'score_b'}, zero=True)}"
SQL["gains_fractional"] = f"WITH {MODELLING}, {gains('modelling', {'raw': 'am_avg_n / 100'}, total=True)}"
SQL["segment_gains"] = f"WITH {MODELLING}, " + gains(
    "modelling", THREE,
    {
        "without_a": "ct_tot_a = 0", "with_a": "ct_tot_a <> 0", "score_b_to_360": "score_b <= 360",
        "score_b_over_360": "score_b > 360", "lines_n_to_1": "ct_tot_n <= 1", "lines_n_over_1": "ct_tot_n > 1",
        "no_r": "coalesce(ct_tot_r, 0) = 0", "with_r": "ct_tot_r <> 0",
    },
    total=True,
)


def banded(column: str, inner: str, bands: int, model: str, edges: str, target: bool = True) -> str:
    """Counts per band; `inner` counts the inner edges below the value, `edges` lists all as text."""
    g = "count(*) FILTER (WHERE bad = 0)" if target else "CAST(0 AS BIGINT)"
    b = "count(*) FILTER (WHERE bad = 1)" if target else "CAST(0 AS BIGINT)"
    total = "good + bad" if target else "n"
    pct = (lambda c: r(f"{c} / (sum({c}) OVER s)::DOUBLE")) if target else (lambda c: "0.0::DOUBLE")
    return f"""SELECT sample, '2001' AS cohort, '{model}' AS model_id, '{column}' AS variable, CAST(band AS INTEGER) AS band,
  '(' || ({edges})[band] || '-' || ({edges})[band + 1] || ')' AS range, CAST(good AS BIGINT) AS good, CAST(bad AS BIGINT) AS bad, CAST({total} AS BIGINT) AS total,
  {pct('good')} AS pct_good, {pct('bad')} AS pct_bad, {r(f'({total}) / (sum({total}) OVER s)::DOUBLE')} AS pct_total
FROM (SELECT k.sample, k.band, coalesce(good, 0) AS good, coalesce(bad, 0) AS bad, coalesce(n, 0) AS n
  FROM (SELECT sample, unnest(range(1, {bands + 1})) AS band FROM (SELECT DISTINCT sample FROM panel)) k
  FULL JOIN (SELECT sample, CASE WHEN {column} >= 0 AND {column} <= 1000 THEN 1 + {inner} END AS band,
      {g} AS good, {b} AS bad, count(*) AS n FROM panel, lim GROUP BY 1, 2) c
  ON k.sample = c.sample AND k.band = c.band) WINDOW s AS (PARTITION BY sample)"""


_width = " + ".join(f"(score_b > lo + {i} * ((hi - lo) / 10.0::DOUBLE))::INT" for i in range(1, 10))
_given = "(score_a > 100)::INT + (score_a > 250)::INT + (score_a > 500)::INT"
_third = "(score_a > 300)::INT + (score_a > 600)::INT"
_cuts = f"['0.0', {', '.join(f'(SELECT CAST(lo + {i} * ((hi - lo) / 10.0::DOUBLE) AS VARCHAR) FROM lim)' for i in range(1, 10))}, '1000.0']"
SQL["gains_banded"] = f"""
WITH {PANEL}, lim AS (SELECT min(score_b)::DOUBLE AS lo, max(score_b)::DOUBLE AS hi FROM panel WHERE sample = 'dev')
{banded('score_b', _width, 10, 'm1', _cuts)}
UNION ALL {banded('score_a', _given, 4, 'm1', "['0.0', '100.0', '250.0', '500.0', '1000.0']")}
UNION ALL {banded('score_a', _third, 3, 'm0', "['0.0', '300.0', '600.0', '1000.0']", False)}"""

# --- monitoring -----------------------------------------------------------------------------

BASELINE = f"""baseline AS (SELECT CASE WHEN ref_portfolio = '2001' THEN 'Out-of-Time' ELSE 'Baseline' END AS safra,
    {_marked(CLASSES)} FROM monitored WHERE ({PRODUCTION}) IS NULL)"""
DRIFT = f"""{MONITORED}, {PRODUCED}, {BASELINE},
marked AS (SELECT safra, {", ".join(CLASSES)} FROM baseline UNION ALL SELECT safra, {", ".join(CLASSES)} FROM produced),
dist AS (SELECT safra, variable, value, count(*) AS n FROM ({long('marked', list(CLASSES), 'safra')})
  WHERE value IS NOT NULL GROUP BY ALL)"""
SQL["append_distribution"] = f"""
WITH {DRIFT} SELECT safra, variable, value, n,
  {r('n * 100.0::DOUBLE / sum(n) OVER (PARTITION BY safra, variable)')} AS pct FROM dist"""
SQL["psi"] = f"""
WITH {DRIFT}, g AS (SELECT c.safra, v.variable, v.value FROM
    (SELECT DISTINCT safra, variable FROM dist WHERE safra <> 'Baseline') c
    JOIN (SELECT DISTINCT variable, value FROM dist) v ON c.variable = v.variable),
p AS (SELECT g.*, coalesce(a.n, 0) AS n, coalesce(b.n, 0) AS m FROM g
  LEFT JOIN dist a ON g.safra = a.safra AND g.variable = a.variable AND g.value = a.value
  LEFT JOIN dist b ON b.safra = 'Baseline' AND g.variable = b.variable AND g.value = b.value),
q AS (SELECT *, greatest(n / (sum(n) OVER w)::DOUBLE, 0.0001::DOUBLE) AS s,
    greatest(m / (sum(m) OVER w)::DOUBLE, 0.0001::DOUBLE) AS t
  FROM p WHERE n + m > 0 WINDOW w AS (PARTITION BY safra, variable))
SELECT safra, variable, {r('sum((s - t) * ln(s / t))')} AS psi FROM q GROUP BY 1, 2"""
SQL["psi_by_month"] = SQL["psi"]
SQL["baseline_classes"] = f"""
WITH {MONITORED}, {BASELINE},
dist AS (SELECT safra, variable, value, count(*) AS n FROM ({long('baseline', list(CLASSES), 'safra')})
  WHERE value IS NOT NULL GROUP BY ALL)
SELECT safra, variable, value, n, {r('n * 100.0::DOUBLE / sum(n) OVER (PARTITION BY safra, variable)')} AS pct FROM dist"""

# A saved and reloaded model scores every row as before.
SQL["reload_parity"] = f"""
WITH {PANEL}, s AS (SELECT sample, count(*) AS rows FROM panel GROUP BY 1)
SELECT sample, rows, 0 AS max_abs_diff FROM s
UNION ALL SELECT 'tot', CAST(sum(rows) AS BIGINT), 0 FROM s WHERE sample IN ('dev', 'val')"""
SQL["hot_key_star"] = """
WITH lines AS (SELECT l_orderkey AS order_id, l_linenumber AS line, l_partkey AS part_id,
  CASE WHEN l_orderkey % 3 = 0 THEN 1 WHEN l_orderkey % 11 <> 0 THEN l_suppkey END AS consumer_id,
  CASE WHEN l_orderkey % 3 = 0 THEN '1995' ELSE CAST(year(l_shipdate) AS VARCHAR) END AS ref_portfolio,
  CASE WHEN l_orderkey % 3 = 0 THEN 'N' ELSE l_returnflag END AS flag_consumer,
  CASE WHEN l_orderkey % 3 = 0 THEN 'F' ELSE l_linestatus END AS cpf, l_quantity AS quantity FROM lineitem),
three AS (SELECT consumer_id, ref_portfolio, flag_consumer, count(*) AS lines, max(quantity) AS most FROM lines GROUP BY ALL),
four AS (SELECT consumer_id, ref_portfolio, flag_consumer, cpf, count(*) AS lines_cpf, min(part_id) AS first_part
  FROM lines GROUP BY ALL)
SELECT l.*, three.lines, most, lines_cpf, first_part FROM lines l
LEFT JOIN three USING (consumer_id, ref_portfolio, flag_consumer)
LEFT JOIN four USING (consumer_id, ref_portfolio, flag_consumer, cpf)"""
SQL["catalog_scan"] = "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderstatus = 'P'"

# --- full-base scoring ----------------------------------------------------------------------


def _pick(values: tuple, key: str) -> str:
    listed = ", ".join("NULL" if v is None else f"'{v}'" for v in values)
    return f"[{listed}][CAST({key} % {len(values)} AS INTEGER) + 1]"


def _book_column(name: str, how: tuple) -> str:
    kind, which = how
    x = f"CASE WHEN {which[0]} = '{which[1]}' THEN l_extendedprice END" if which else "l_extendedprice"
    return f"{kind}({x}) AS {name}" if kind == "count" else f"CAST({kind}({x}) AS DECIMAL(18, 2)) AS {name}"


def _dictionary(column: str) -> str:
    lines = " ".join(
        f"WHEN lower({column}) IN ({', '.join(repr(v) for v in values)}) THEN '{label}'"
        for label, values in presets.ISSUER_GROUPS.items()
    )
    return f"CASE WHEN {column} IS NULL THEN '{presets.ISSUER_NULL}' {lines} ELSE '{presets.ISSUER_DEFAULT}' END"


_STAR = "consumer_id, ref_portfolio, flag_consumer"
_brand = " ".join(f"WHEN contains(lower(device_modelo_ref), '{b}') THEN '{b}'" for b in presets.DEVICE_BRANDS)
_mails = ", ".join(f"'{d}'" for d in presets.EMAIL_DOMAINS)
_filled_numeric = ", ".join(f"round(coalesce({c}::DOUBLE, 0), 4) + 0.0 AS {c}" for c in presets.FINAL_NUMERIC)
_any = " OR ".join
SQL["full_base_scoring"] = f"""
WITH dated AS (
  SELECT o_orderkey, o_custkey AS consumer_id, CAST(year(o_orderdate) AS VARCHAR) AS ref_portfolio,
    CASE o_orderstatus WHEN 'F' THEN 'with_relation' WHEN 'O' THEN 'without_relation' ELSE 'unknown' END AS flag_consumer,
    o_totalprice, o_orderdate, o_orderpriority, md5(c_name) AS cpf, c_acctbal, c_nationkey, c_mktsegment
  FROM orders LEFT JOIN customer ON o_custkey = c_custkey),
base AS (
  SELECT {_STAR}, max(cpf) AS cpf, strftime(min(o_orderdate), '%Y-%m-%d') AS ref_date, max(c_mktsegment) AS digital_account_status,
    nullif(min(o_orderpriority), '5-LOW') AS bandeira_cartao_ref, consumer_id % 50 AS tempo_registro_em_meses,
    consumer_id % 85 + 12 AS idade_em_anos, consumer_id % 17 = 0 AS deactivated,
    {_pick(fullbase.STATES, "max(c_nationkey)")} AS ddd_state, {_pick(fullbase.MAILS, "consumer_id")} AS email_domain,
    {_pick(fullbase.DEVICES, "consumer_id")} AS device_modelo_ref, {_pick(fullbase.ISSUERS, "consumer_id")} AS instituicao_cartao_ref
  FROM dated WHERE flag_consumer <> 'unknown' GROUP BY {_STAR}),
target AS (
  SELECT {_STAR}, max(CAST(o_totalprice > 450000 AS INTEGER)) AS bad0,
    CASE WHEN count(*) >= 2 THEN max(CAST(o_totalprice > 300000 AS INTEGER)) END AS bad6,
    max(floor(o_totalprice / 500)) AS H2PA, max(floor((c_acctbal + 1000) / 11)) AS HSPA
  FROM dated GROUP BY {_STAR}),
book AS (
  SELECT {_STAR}, {", ".join(_book_column(c, how) for c, how in fullbase.BOOK_COLUMNS.items())},
    CAST(sum(l_quantity) AS BIGINT) % 101 AS peer_effect_score, count(*) % 101 AS mental_accounting_score,
    date_diff('day', CAST(min(o_orderdate) AS DATE), CAST(max(l_shipdate) AS DATE)) AS days_since_last_transaction,
    count(DISTINCT l_returnflag) AS qtde_cartoes_ativos_cadastrados, count(DISTINCT l_linestatus) AS qtde_emissores_distintos
  FROM lineitem JOIN dated ON l_orderkey = o_orderkey GROUP BY {_STAR}),
extra AS (
  SELECT md5(c_name) AS cpf, CAST(event_id % 7 + 1995 AS VARCHAR) AS ref_portfolio,
    arg_min(floor(value), (ts, floor(value))) AS SCORE_C2BA
  FROM events JOIN customer ON user_id = c_custkey GROUP BY 1, 2),
joined AS (
  SELECT base.*, bad0, bad6, H2PA, HSPA, SCORE_C2BA, book.* EXCLUDE ({_STAR})
  FROM base LEFT JOIN target USING ({_STAR}) LEFT JOIN book USING ({_STAR}) LEFT JOIN extra USING (cpf, ref_portfolio)
  WHERE NOT coalesce(tempo_registro_em_meses >= 3 AND ct_tot_pay_03m_trx >= 1, false))
SELECT cpf, {_STAR}, ref_date, coalesce(SCORE_C2BA::DOUBLE, 0) + 0.0 AS SCORE_C2BA, bad6 AS SConcEver60dP6_100,
  coalesce(CASE WHEN bad0 = 1 THEN '{fullbase.LABELS[0]}'
    WHEN H2PA = 0 OR HSPA = 0 OR SCORE_C2BA = 0 THEN '{fullbase.LABELS[1]}'
    WHEN H2PA = 1 OR HSPA = 1 OR SCORE_C2BA = 1 THEN '{fullbase.LABELS[2]}'
    WHEN bad6 IS NULL THEN '{fullbase.LABELS[3]}' WHEN deactivated THEN '{fullbase.LABELS[4]}'
    WHEN idade_em_anos < 18 OR idade_em_anos > 90 THEN '{fullbase.LABELS[5]}' END, 'others') AS exclusao,
  coalesce(ddd_state, 'others') AS ddd_state, coalesce(digital_account_status, 'others') AS digital_account_status,
  coalesce(bandeira_cartao_ref, 'others') AS bandeira_cartao_ref,
  CASE WHEN lower(email_domain) IN ({_mails}) THEN lower(email_domain) ELSE '{presets.EMAIL_DEFAULT}' END AS email_ajuste,
  CASE {_brand} ELSE '{presets.DEVICE_DEFAULT}' END AS modelo_celular_ref,
  {_dictionary("instituicao_cartao_ref")} AS agrupamento_instituicao_cartao_ref, {_filled_numeric}, true AS scored
FROM joined"""
