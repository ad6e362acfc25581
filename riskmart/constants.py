"""Fixed values shared by the whole library.

Everything in this module is data, not logic: sentinel codes, column names and
category lists that must stay exactly as they are for results to be comparable
across feature-mart builds.
"""

# --- missing-value algebra ---------------------------------------------------
NOT_APPLICABLE = -1          # also the value of a left-join miss
NOT_DETERMINED = -2
NOT_INFORMED = -3
UNKNOWN = -4                 # missing in the source
RAW_NULL = -999              # raw-layer numeric null
DELTA_UNDEFINED = -9999      # score difference that cannot be computed
WRITE_OFF_NULL = -444444.0

NOT_APPLICABLE_TEXT = "NAO SE APLICA"
NOT_DETERMINED_TEXT = "NAO DETERMINADO"
NOT_DECLARED_TEXT = "NAO DECLARADO"
NOT_INFORMED_TEXT = "NAO INFORMADO"
UNKNOWN_TEXT = "DESCONHECIDO"

OPEN_START = "1900-01-01"
OPEN_END = "9999-12-31"
JOB_DATE_NULL = "9999-01-01"
BIRTH_DATE_NULL = "1000-01-01"
BENEFIT_VINTAGE_NULL = 190001

STAMP_MASK = "ddMMMyyyy:HH:mm:ss"
DAY_MASK = "dd/MM/yyyy"
VINTAGE_MASK = "yyyyMM"

# --- keys, target, split -----------------------------------------------------
ID = "ID_UNICO"
CUSTOMER = "NUM_CPF"
VINTAGE = "SAFRA"
CUTOFF = "DATA_CORTE_SAFRA"
TARGET = "FPD"
CONTROL = "GRUPO_CONTROLE"
INSTALLED = "FLAG_INSTALACAO"
OOT_FLAG = "Flag_OOT"
CONTROL_MARKS = ["ZZ", "ZX"]
OOT_VINTAGES = [202502, 202503]
BENCHMARK_KS = 33.1
COLLINEAR_LIMIT = 0.85
SEED = 42

NOT_FEATURES = [
    "NUM_CPF", "ID_UNICO", "SAFRA", "FPD", "FLAG_INSTALACAO", "GRUPO_CONTROLE",
    "PROD", "flag_mig2", "Flag_OOT", "flag_oot",
]

# step number -> (report name, table key)
STEPS = {
    1: ("Score 1", "score_01"),
    2: ("Score 1 + Score 2", "score_02"),
    3: ("Scores + Telco", "plus_telco"),
    4: ("Scores + Telco + Cadastral", "plus_cadastral"),
    5: ("Scores + Telco + Cadastral + Recarga", "plus_recarga"),
    6: ("Scores + Telco + Cadastral + Recarga + Pagamento", "plus_pagamento"),
}

# folder name -> table key
FOLDER_TABLES = {
    "score_01": "score_01",
    "score_02": "score_02",
    "plus_score_02": "score_02",
    "plus_telco": "plus_telco",
    "plus_cadastro": "plus_cadastral",
    "plus_cadastral": "plus_cadastral",
    "plus_recarga": "plus_recarga",
    "plus_pagamento": "plus_pagamento",
    "abt_final": "plus_pagamento",
}

# --- category lists ----------------------------------------------------------
TOP_CARDS = ["UB", "WT", "PY", "I8", "UD", "IW", "UC", "FW", "FV", "G6", "AX", "I4",
             "OR", "IC", "IB", "PZ", "IA", "N9", "UE"]
TOP_ORIGINS = ["NaoSeAplica", "Rec.Online", "AtivPromocao", "ChipPre+R$30", "ForcaZB2"]
TRADITIONAL_BANKS = ["104", "341", "237", "033", "001", "1044", "1043", "1045", "041",
                     "077", "748", "756", "1041", "1040", "1046"]
FINTECH_BANKS = ["MPG", "212", "NXT"]
CREDIT_ALLOCATIONS = ["PYM", "DESCONHECIDO", "CRT", "CRTW"]
PAYMENT_FORMS = {"10": "ONLINE", "14": "ARRECADACAO_BANCARIA", "12": "DEBITO_DIRETO",
                 "15": "ACORDO_PAGAMENTO"}
DAY_PARTS = ["MADRUGADA", "MANHA", "TARDE", "NOITE"]
STATES = ["AC", "AL", "AM", "AP", "BA", "CE", "DF", "ES", "GO", "MA", "MG", "MS", "MT",
          "PA", "PB", "PE", "PI", "PR", "RJ", "RN", "RO", "RR", "RS", "SC", "SE", "SP", "TO"]
PRODUCTS = ["CMV", "NET", "DTH"]
MIGRATIONS = {"MIG_Aquisicao": "Aquisição", "MIG_PRE": "PRE", "MIG_FLEX": "FLEX",
              "SEM_MIGRACAO": "SEM_MIGRACAO"}
TAX_STATUSES = ["REGULAR", "PENDENTE DE REGULARIZACAO", "SEM_STATUS", "SUSPENSA",
                "TITULAR FALECIDO", "CANCELADA"]
PENSION_GROUPS = {
    "FLG_INSS_APOSENTADORIA_PERMANENTE": [41, 42, 32],
    "FLG_INSS_PENSAO_MORTE": [21],
    "FLG_INSS_BENEFICIO_TEMPORARIO": [31, 91, 80],
    "FLG_INSS_ASSISTENCIAL_BPC_LOAS": [87, 88],
}

# ordered (label, pattern) lists: the first match wins
CHANNEL_PATTERNS = [
    ("BANCOS TRADICIONAL",
     r"(?i)CEF/Banco|CEF/C\.Bancario|Bradesco|Banco do Brasil|Santander|Itau|Banrisul|Tribanco"),
    ("FINTECH OU CARTEIRA DIGITAL",
     r"(?i)Mercado Pago|Banco Inter|Recarga Pay|CPay|Claro Pay"),
    ("VAREJO FÍSICO / DINHEIRO VIVO",
     r"(?i)Lotericas|\[RD\]|Lojas Claro"),
    ("GATEWAYS / CAMPANHAS",
     r"(?i)Epay|M4U|Bemobi|DBR|RV\s|Tendencia|PagSeguro|Log Express|Rede ?flex|Card\s|RCA\s"
     r"|CONEKTA|Globell|POS-|Get Net|Diga|REDE/|Telecom Net|QIWI|MULTILINK|LOG\s"),
]
PLAN_PATTERNS = [
    ("PRE-PAGO CORE", r"(?i)PREZAO"),
    ("PLANO CONTROLE", r"(?i)CONTROLE|CONT\d"),
    ("PRE-PAGO REGIONAL/CAMPANHA", r"(?i)JONAVA|ZB\d"),
    ("PRE-PAGO LEGADO", r"(?i)TODA HORA|TH\s|FALA MAIS|FMB|RECARREGUE"),
]

# (inclusive upper bound, value)
SOS_FEES = [(0, 0.0), (3, 1.0), (5, 2.0), (10, 3.5), (15, 5.0), (20, 6.0)]
SOS_FEE_ABOVE = 7.0
INTEREST_TIERS = [(0, "SEM_JUROS"), (1.10, "INSIGNIFICANTE"), (5.00, "MODERADO"),
                  (50.00, "ALTO")]
INTEREST_ABOVE = "MUITO_ALTO"

MONEY_CEILING = 9999999.0
VAR_90_ANOMALY = 14000
STRESS_CUTS = [10, 15, 20, 30, 40, 50, 75, 80, 90, 100]
GRID = {"max_depth": [3, 5, 7], "learning_rate": [0.01, 0.05, 0.1],
        "n_estimators": [100, 200, 300], "subsample": [0.8, 1.0]}
