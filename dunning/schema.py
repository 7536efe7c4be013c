"""Explicit StructTypes of the eight input tables (all columns nullable)."""

from pyspark.sql import types as T

MONEY = T.DecimalType(18, 2)


def _schema(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


CADASTROS = _schema(
    ("cod_cad", T.LongType()),
    ("nomecli", T.StringType()),
    ("cpfcnpj", T.StringType()),
    ("email", T.StringType()),
    ("nmcont", T.StringType()),
    ("cod_cli", T.IntegerType()),
    ("stcli", T.StringType()),
    ("infoad", T.StringType()),
    ("nascto", T.DateType()),
    ("data_cad", T.DateType()),
    ("data_arq", T.DateType()),
)

FONES = _schema(
    ("cod_cad", T.LongType()),
    ("dddfone", T.StringType()),
    ("telefone", T.StringType()),
    ("status", T.IntegerType()),
    ("obs", T.StringType()),
)

ACORDOS = _schema(
    ("cod_aco", T.LongType()),
    ("nmcont", T.StringType()),
    ("cod_cli", T.IntegerType()),
    ("data_cad", T.DateType()),
    ("data_aco", T.DateType()),
    ("vlr_aco", MONEY),
    ("qtd_p_aco", T.IntegerType()),
    ("staco", T.StringType()),
)

RECEBER = _schema(
    ("nmcont", T.StringType()),
    ("cod_cli", T.IntegerType()),
    ("fat_parc", T.StringType()),
    ("vlrparc", MONEY),
)

REC_COMP = _schema(
    ("nmcont", T.StringType()),
    ("cod_cli", T.IntegerType()),
    ("int_2", T.IntegerType()),
    ("char_5", T.StringType()),
)

BENS = _schema(
    ("nmcont", T.StringType()),
    ("cod_cli", T.IntegerType()),
    ("marca", T.StringType()),
    ("modelo", T.StringType()),
    ("placa", T.StringType()),
    ("cor", T.StringType()),
    ("anofab", T.IntegerType()),
    ("anomodelo", T.IntegerType()),
    ("chassi", T.StringType()),
)

# hist_tb.cod_cli holds a registration id (a cod_cad), not a portfolio code.
HIST = _schema(
    ("cod_hist", T.LongType()),
    ("cod_cli", T.LongType()),
    ("data_at", T.TimestampNTZType()),
    ("ocorr", T.StringType()),
    ("cod_usu", T.StringType()),
)

STCOB = _schema(
    ("st", T.StringType()),
    ("bsc", T.StringType()),
)

# Columns that only the fixture has; a real table may lack them.
OPTIONAL = ("cod_hist",)

SCHEMAS = {
    "cadastros_tb": CADASTROS,
    "fones_tb": FONES,
    "acordos_tb": ACORDOS,
    "receber_tb": RECEBER,
    "rec_comp_tb": REC_COMP,
    "bens_tb": BENS,
    "hist_tb": HIST,
    "stcob_tb": STCOB,
}
