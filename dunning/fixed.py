"""These must equal the reference's values for right results.

They are listed here together, in the reference's own order, and every module
imports them from here.
"""

import datetime as dt

# Portfolio codes the operator can pick.
PORTFOLIOS = (517, 518, 519)

# Registrations: status code of inactive debtors.
INACTIVE = "INA"

# Phones: status preference, best first (an unlisted or null status gets
# position 0 and sorts before all of them); statuses that are reachable
# without looking at the note; note fragments that mark an unknown or wrong
# number; six equal consecutive digits; minimum length in bytes; mask letter;
# number of phone columns.
STATUS_PREFERENCE = (2, 4, 5, 6, 1, 0)
GOOD_PHONE_STATUS = (2, 4, 5, 6, 1)
BAD_NOTE_FRAGMENTS = ("%Descon%", "%incorret%")
REPEATED_DIGITS = r"([0-9])\1{5}"
MIN_PHONE_BYTES = 8
MASK = "%X%"
PHONE_SLOTS = 7

# Contact history: system user id, right-party-contact marker, windows.
SYSTEM_USER = "999"
RIGHT_PARTY = "CPC"
RECENT_DAYS = 30
INTAKE_MONTHS = 2
PERIOD_START = dt.time(0, 0, 0)
PERIOD_END = dt.time(23, 59, 59)

# Agreements: cutoff date, status groups, labels and the fallback label,
# instalment labels.
AGREEMENTS_SINCE = dt.date(2025, 7, 1)
STATUS_OPEN = ("P", "A")
STATUS_SETTLED = ("P", "G", "A")
STATUS_KNOWN = ("P", "G", "A", "Q", "E")
STATUS_BROKEN = ("Q", "E")
AGREEMENT_LABELS = (
    ("A", "Em Acordo"),
    ("E", "Exceção Rejeitada"),
    ("G", "Pago"),
    ("Q", "Quebrado"),
    ("P", "Em Promessa"),
)
AGREEMENT_LABEL_OTHER = "Sem Dados"
LUMP_SUM = "AVISTA"
INSTALMENTS = "PARCELADO"

# Instalments: marker of a down payment.
DOWN_PAYMENT = "ENTRADA"

# Output text: date format, list separator, brand-model and year joiners.
DATE_TEXT = "dd-MM-yyyy"
LIST_SEPARATOR = " || "
PAIR_JOINER = " - "
YEAR_JOINER = "/"

# Output columns of the three contact-list reports, spelled as the reference names them
# (users read these headers); the phone columns stand after Portfolio.
CONTACT_LIST_HEAD = ("cod_cad", "nome", "cpf", "BindingID", "DataNascimento", "Portfolio")
CONTACT_LIST_TAIL = (
    "MarcaModelo", "placa", "cor", "AnoFabModelo", "QtdGarantiasUnicas", "Contratos", "TipoProduto",
    "UltimoValorAcordado", "TipoAcordo", "DataCriacaoGecobi", "StatusUltimoAcordo",
)
AGREEMENT_COLUMNS = CONTACT_LIST_TAIL[-4:]
AGREEMENT_VALUE, AGREEMENT_KIND, AGREEMENT_CREATED, AGREEMENT_STATUS = AGREEMENT_COLUMNS

# Columns that the reference's agreement blocks select.
LATEST_BY_PORTFOLIO_COLUMNS = ("nmcont", "cod_cli", "cod_aco", "data_cad", "vlr_aco", "qtd_p_aco", "staco")
LATEST_COLUMNS = ("nmcont", "cod_aco", "data_aco", "data_cad", "vlr_aco", "qtd_p_aco", "staco")

# Largest debts: rows kept.
TOP = 50

# Output files: column width rule, money keywords and decimals.
MIN_WIDTH = 10
MAX_WIDTH = 60
WIDTH_PAD = 2
MONEY_KEYWORDS = ("valor", "vlr", "divida", "acordo", "parc", "commission", "collected", "goal")
MONEY_DECIMALS = 2
