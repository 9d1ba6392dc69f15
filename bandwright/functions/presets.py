"""Fixed values of the credit study: word lists, band labels and parameters.

These are contracts of the reports (labels are compared as text), so they are
stated plainly and in their natural order.
"""

from __future__ import annotations

from bandwright.functions.banding import Bands, Groups

# --- fixed values: e-mail domains kept as they are, and the label of the rest
EMAIL_DOMAINS = (
    "gmail", "hotmail", "yahoo", "outlook", "icloud", "live", "uol", "terra", "msn", "globo",
)
EMAIL_DEFAULT = "Outros/Erro"

# --- fixed values: device brands in matching order, and the label of the rest
DEVICE_BRANDS = (
    "samsung", "motorola", "iphone", "xiaomi", "lg", "asus", "lenovo", "tcl", "positivo",
    "multilaser", "ipad", "quantum", "sony", "nokia", "huawei", "oneplus",
)
DEVICE_DEFAULT = "outros"

# --- fixed values: card issuers by group; the first group naming an issuer wins
ISSUER_GROUPS = {
    "bradesco": (
        "bradesco", "ibibank", "hsbc", "leader", "hsbc bank brasil s.a.  banco multiplo",
        "banco bankpar s.a.",
    ),
    "banco carrefour": ("banco csf s/a", "bco carrefour"),
    "itau": (
        "itau", "citibank", "citi", "banco citibank, s.a.", "unibanco", "redecard, s.a.",
        "citicard (991)",
    ),
    "santander": ("santander", "santanderserfin", "santander rio"),
    "banco do brasil": ("banco do brasil", "bancodobrasil", "banco do brasil s.a."),
    "fintechs": ("hub pagamentos s.a.", "credz"),
    "financeiras": (
        "avista sa credito financiamento e investimento", "portoseg cfi", "midway",
        "midway s.a. - credito, financiamento e investimento",
        "realize credito financiamento e investimento sa",
        "portoseg s.a. credito financiamento e investimento", "renner",
        "pernambucanas financiadora s a - cfi",
        "cred-system administradora de cartoes de credito ltda",
        "caruana s.a. - sociedade de credito, financiamento e investimento",
        "crefisa sa credito financiamento e investimentos", "sicredi", "omni", "cetelem",
        "bv financeira", "unik", "calcard", "credifar",
        "fortbrasil administradora de cartoes de credito sa", "uniprime norte do parana",
        "airfox servicos e intermediacoes ltda", "dmcard cartoes de credito s.a.", "caruana",
    ),
    "bancos e fin. internacionais": (
        "bank of america", "abn amro bank", "capital one bank", "credit one", "capital one",
        "la banque postale", "allied irish banks plc", "barclays bank plc",
        "keybank national association", "u.s. bank, n.a.", "royal bank of canada",
        "bank of ireland", "bank simpanan nasional", "u.s. bank n.a. nd", "usbank",
        "wells fargo bank nevada, n.a.", "bank hapoalim", "confidence",
        "poste italiane s.p.a. (banca posta)", "american express", "galicia", "americanexpress",
        "caisse nationale des caisses depargne (cnce)",
        "caja de ahorros y monte piedad de segovia (caja segovia)", "aval card, s.a. de c.v.",
        "barclaycard", "davivienda", "high plains", "suntrust", "halifax", "bnp paribas",
        "travelex card services limited", "chase", "wells fargo", "cibc",
    ),
    "peq.bancos nac. privados": (
        "banco cooperativo do brasil s/a", "banco csf s/a", "banco votorantim s/a",
        "banco cetelem s.a", "banco pan sa", "banco cooperativo sicredi sa", "banco bmg s/a",
        "banco c6 sa", "banco agibank s.a.", "bancoob", "banco triangulo s/a", "banco cbss sa",
        "banco daycoval s.a.", "banco rodobens s.a.", "banco safra s/a", "banco triangulo",
        "banco bs2 s.a.", "banco rendimento s.a.", "novo banco continental s.a. - banco multiplo",
        "pottencial", "panamericano", "bco bonsucesso", "bmb", "safra", "rendimento",
        "votorantim", "cbss", "bco. ind.brasil", "bco industrial",
    ),
    "solucoes de pagamento": (
        "pagseguro internet ltda", "acesso solucoes de pagamento s.a.",
        "super pagamentos e administracao de meios eletronicos ltda", "pagseguro",
        "edenred solucoes de pagamentos hyla s.a.", "brasil pre",
        "acg administradora de cartoes sa", "cdt(conductor)",
        "qui! card brasil solucoes de pagamento s.a.", "paypal",
    ),
    "bancos estatais": (
        "banestes", "banco do estado do rio grande do sul s.a. (banrisul s.a.)", "banrisul",
        "brb", "banco de brasilia s.a.", "bnb", "banco do estado do para s.a.",
    ),
    "vazio": ("n/a",),
    "nu pagamentos sa": ("nu pagamentos sa",),
    "caixa economica federal": ("caixa economica federal",),
    "banco inter s.a.": ("banco inter s.a.",),
    "banco original": ("banco original",),
}
ISSUER_NULL = "vazio"
ISSUER_DEFAULT = "Outros"

# --- fixed values: states by region; other states pass through
STATE_REGIONS = {
    "Noroeste": ("RO", "AC", "AM", "RR"),
    "Norte": ("PA", "AP", "TO", "MA"),
    "Nordeste": ("PI", "CE", "RN", "PB", "PE", "AL", "SE", "BA"),
    "Sudeste -SP": ("MG", "ES", "RJ"),
    "Sul": ("PR", "SC", "RS"),
    "Centro-Oeste": ("MS", "MT", "GO", "DF"),
}

# --- fixed values: band edges and labels of the monitoring classes
MODEL_SCORE_UPPERS = (280, 413, 501, 589, 674, 741, 794, 841, 895, 1000)
MODEL_SCORE_LABELS = (
    "01. 0 - 280", "02. 281 - 413", "03. 414 - 501", "04. 502 - 589", "05. 590 - 674",
    "06. 675 - 741", "07. 742 - 794", "08. 795 - 841", "09. 842 - 895", "10. 896 - 1000",
)
BUREAU_SCORE_UPPERS = (431, 517, 587, 653, 710, 765, 829, 898, 940, 1000)
BUREAU_SCORE_LABELS = (
    "01. 0 - 431", "02. 432 - 517", "03. 518 - 587", "04. 588 - 653", "05. 654 - 710",
    "06. 711 - 765", "07. 766 - 829", "08. 830 - 898", "09. 899 - 940", "10. 941 - 1000",
)
AGE_UPPERS = (20, 25, 30, 35, 40, 50, 90)
AGE_LABELS = (
    "01. 18 - 20", "02. 21 - 25", "03. 26 - 30", "04. 31 - 35", "05. 36 - 40", "06. 41 - 50",
    "07. 51 - 90",
)
TENURE_UPPERS = (1, 3, 6, 12, 24, 36, None)
TENURE_LABELS = (
    "01. Relacionamento <= 1 mês",
    "02. 1 < Relacionamento <= 3 meses",
    "03. 3 < Relacionamento <= 6 meses",
    "04. 6 < Relacionamento <= 12 meses",
    "05. 12 < Relacionamento <= 24 meses",
    "06. 24 < Relacionamento <= 36 meses",
    "07. Relacionamento > 36 meses",
)
RECENCY_UPPERS = (10, 30, 60, 180, 360, 720, None)
RECENCY_LABELS = (
    "02. 1 - 10 dias", "03. 11 - 30 dias", "04. 31 - 60 dias", "05. 61 - 180 dias",
    "06. 181 - 360 dias", "07. 361 - 720 dias", "08. >= 721 dias",
)
MONEY_UPPERS = (10, 50, 100, None)
MONEY_LABELS = ("02. R$ 0 - 10", "03. R$ 10 - 50", "04. R$ 50 - 100", "05. > R$ 100")
OTHER = "99. Outros"


def score_bands(column: str, output: str) -> Bands:
    return Bands(column, output, MODEL_SCORE_UPPERS, MODEL_SCORE_LABELS, OTHER)


def bureau_bands(column: str, output: str) -> Bands:
    return Bands(column, output, BUREAU_SCORE_UPPERS, BUREAU_SCORE_LABELS, OTHER)


def age_bands(column: str, output: str) -> Bands:
    return Bands(
        column, output, AGE_UPPERS, AGE_LABELS, "999. Outros", low=18,
        outside="99. Idade < 18 ou > 90",
    )


def tenure_bands(column: str, output: str) -> Bands:
    return Bands(
        column, output, TENURE_UPPERS, TENURE_LABELS, OTHER, low=0, null_label=TENURE_LABELS[0]
    )


def recency_bands(column: str, output: str) -> Bands:
    zero = "01. 0 dias"
    return Bands(
        column, output, RECENCY_UPPERS, RECENCY_LABELS, OTHER, points={0: zero}, low=0,
        low_closed=False, null_label=zero,
    )


def money_bands(column: str, output: str) -> Bands:
    zero = "01. R$ 0"
    return Bands(
        column, output, MONEY_UPPERS, MONEY_LABELS, OTHER, points={0: zero}, low=0,
        low_closed=False, null_label=zero,
    )


def index_bands(column: str, output: str, first: int) -> Bands:
    """Behavioural index: zero, up to `first`, up to 50, above."""
    zero = "01. 0"
    return Bands(
        column, output, (first, 50, None), (f"02. 0 - {first}", f"03. {first} - 50", "04. > 50"),
        OTHER, points={0: zero}, low=0, low_closed=False, null_label=zero,
    )


def issuer_count_bands(column: str, output: str) -> Bands:
    none = "01. Qtde = 0"
    return Bands(
        column, output, (None,), ("03. Qtde >= 2",), OTHER, points={0: none, 1: "02. Qtde = 1"},
        low=1, low_closed=False, null_label=none,
    )


def region_groups(column: str, output: str, null_label: str | None = None) -> Groups:
    """States to regions; baseline frames keep a null state, production says 'others'."""
    return Groups(column, output, STATE_REGIONS, default=None, null_label=null_label)


def issuer_class(column: str, output: str) -> Groups:
    return Groups(
        column, output,
        {
            "caixa": ("caixa economica federal",),
            "bradesco": ("bradesco",),
            "nubank": ("nu pagamentos sa",),
            "itau": ("itau",),
            "santander": ("santander",),
            "banco do brasil": ("banco do brasil",),
            "banco original": ("banco original",),
            "vazio": ("vazio", "Outros"),
        },
        default="outras ifs", null_label="vazio",
    )


def kept_values(column: str, output: str, values: tuple[str, ...]) -> Groups:
    return Groups(column, output, {v: (v,) for v in values}, default="Outros")


def monitoring_classes(score: str, null_state: str | None = None) -> list[Bands | Groups]:
    """The fifteen class columns, for the baseline or the production frame alike."""
    return [
        score_bands(score, "classe_score"),
        bureau_bands("HSPA", "classe_HSPA"),
        age_bands("idade_em_anos", "classe_idade"),
        region_groups("ddd_state", "classe_ddd_state", null_state),
        tenure_bands("tempo_registro_em_meses", "classe_tempo_relacionamento"),
        recency_bands("days_since_last_transaction", "classe_last_transaction"),
        issuer_class("agrupamento_instituicao_cartao_ref", "classe_instituicao_cartao"),
        money_bands("am_max_pay_12m_trx", "classe_am_max_pay_12m_trx"),
        kept_values(
            "modelo_celular_ref", "classe_modelo_celular",
            ("samsung", "motorola", "iphone", "xiaomi", "lg"),
        ),
        index_bands("mental_accounting_score", "classe_mental_accounting_score", 10),
        index_bands("peer_effect_score", "classe_peer_effect_score", 20),
        kept_values(
            "email_ajuste", "classe_email_ajuste", ("gmail", "hotmail", "outlook", "yahoo")
        ),
        money_bands("am_max_recp2p_12m_trx", "classe_am_max_recp2p_12m_trx"),
        issuer_count_bands("qtde_emissores_distintos", "classe_emissores_distintos"),
        money_bands("am_max_payp2pbal_12m_trx", "classe_am_max_payp2pbal_12m_trx"),
    ]


# --- fixed values: inputs of the final model
FINAL_CATEGORICAL = (
    "ddd_state", "digital_account_status", "bandeira_cartao_ref", "email_ajuste",
    "modelo_celular_ref", "agrupamento_instituicao_cartao_ref",
)
FINAL_NUMERIC = (
    "days_since_last_transaction", "idade_em_anos", "tempo_registro_em_meses",
    "qtde_cartoes_ativos_cadastrados", "qtde_emissores_distintos", "HSPA", "peer_effect_score",
    "mental_accounting_score", "am_max_pay_12m_trx", "ct_min_paypav_12m_trx",
    "ct_tot_payp2pcred_12m_trx", "am_tot_payp2pbal_06m_trx", "am_max_payp2pbal_12m_trx",
    "am_min_paypavcred_06m_trx", "am_tot_paypavcred_12m_trx", "am_tot_paypavbal_06m_trx",
    "am_tot_paypavmix_12m_trx", "am_max_paypavgood_12m_trx", "am_max_recp2p_12m_trx",
)

# --- fixed values: keys, cohort and target of the study, and the exclusion cuts
STAR_KEYS = ("consumer_id", "ref_portfolio", "flag_consumer")
OUT_OF_TIME = "2020-04"
AGE_RANGE = (18, 90)
SCORE_CUT = 360
SEED = 123
DEV_PERCENT = 80
