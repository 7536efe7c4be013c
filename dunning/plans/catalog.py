"""Blocks, sources, helpers and parameter variants exposed as queries.

Each entry maps a name to ``fn(tables, params) -> DataFrame`` with the column
names the reference's CTE (or helper) would produce.
"""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dunning.fixed import LATEST_BY_PORTFOLIO_COLUMNS, LATEST_COLUMNS
from dunning.functions import scalars as S
from dunning.params import ReportParams
from dunning.plans import blocks as B
from dunning.plans import reports as R
from dunning.session import shared_folder
from dunning.sinks.files import display_widths, money_formatted, write_report
from dunning.sources.tables import Tables

Query = Callable[[Tables, ReportParams], DataFrame]


# ------------------------------------------------------------------ sources
def _scan(attr: str) -> Query:
    return lambda t, p: getattr(t, attr)


# ------------------------------------------------------------------- blocks
def b01(t: Tables, p: ReportParams) -> DataFrame:
    return B.b01_latest_agreement_by_portfolio(t, p).select(*LATEST_BY_PORTFOLIO_COLUMNS)


def b02(t: Tables, p: ReportParams) -> DataFrame:
    return B.b02_latest_agreement(t, p).select(*LATEST_COLUMNS)


def b03(t: Tables, p: ReportParams) -> DataFrame:
    return B.b03_settled_contracts(B.b02_latest_agreement(t, p))


def b04(t: Tables, p: ReportParams) -> DataFrame:
    return B.b04_agreement_status(B.b02_latest_agreement(t, p))


def b05(t: Tables, p: ReportParams) -> DataFrame:
    return B.b05_contract_values(t, p).select("nmcont", "cod_cli", "Contratos", "TipoProduto")


def b06(t: Tables, p: ReportParams) -> DataFrame:
    return B.b06_collateral_summary(t, p)


def _quality_phones(t: Tables, p: ReportParams) -> DataFrame:
    regs = B.registrations(t, p).select("cod_cad")
    return B.b07_ranked_phones(t, p, quality=True).join(regs, "cod_cad", "left_semi")


def b07(t: Tables, p: ReportParams) -> DataFrame:
    """Ranked phones of active registrations, one row per distinct phone."""
    return _quality_phones(t, p).select("cod_cad", "num", "telefones")


def b09(t: Tables, p: ReportParams) -> DataFrame:
    return B.b09_phone_pivot(_quality_phones(t, p), p)


def b11(t: Tables, p: ReportParams) -> DataFrame:
    return B.b11_no_classified_contact(t, p).select("cod_cad", "nmcont", "cod_cli")


def b12(t: Tables, p: ReportParams) -> DataFrame:
    return B.b12_broken_contracts(B.b02_latest_agreement(t, p))


def b13(t: Tables, p: ReportParams) -> DataFrame:
    return B.b13_last_contact(t, p, cpc_only=True)


def b13_any(t: Tables, p: ReportParams) -> DataFrame:
    return B.b13_last_contact(t, p, cpc_only=False)


# ------------------------------------------------------------------ helpers
def h01(t: Tables, p: ReportParams) -> DataFrame:
    """Parse money typed in four styles (plain, R$ Brazilian, Brazilian,
    thousands without decimals) back to a number."""
    v = F.col("vlr_aco")
    br = F.translate(F.format_number(v, 2), ",.", ".,")
    thousands = F.translate(F.format_number(F.floor(v), 0), ",.", ".,")
    style = F.col("cod_aco") % 4
    text = (
        F.when(style == 0, v.cast("string"))
        .when(style == 1, F.concat(F.lit("R$ "), br))
        .when(style == 2, br)
        .otherwise(thousands)
    )
    return t.acordos.select("cod_aco", text.alias("texto")).select(
        "cod_aco", "texto", S.money_from_text("texto", scale=3).alias("valor")
    )


def h02(t: Tables, p: ReportParams) -> DataFrame:
    """Check date text typed as YYYY-MM-DD: shape and real calendar date."""
    style = F.col("cod_hist") % 3
    text = (
        F.when(style == 0, F.date_format("data_at", "yyyy-MM-dd"))
        .when(style == 1, F.date_format("data_at", "yyyy-dd-MM"))
        .otherwise(F.date_format("data_at", "dd/MM/yyyy"))
    )
    return t.hist.select("cod_hist", text.alias("texto")).select(
        "cod_hist", "texto", S.ymd_shape("texto").alias("formato_ok"), S.ymd_date("texto").alias("data")
    )


def h03(t: Tables, p: ReportParams) -> DataFrame:
    return display_widths(R.r04_agreements_open(t, p))


def h04(t: Tables, p: ReportParams) -> DataFrame:
    return money_formatted(R.r04_agreements_open(t, p))


def h03_contact_list(t: Tables, p: ReportParams) -> DataFrame:
    """Widths of a 24-column report as its export shows it (money as text)."""
    return display_widths(money_formatted(R.r09_broken_rejected(t, p)))


# -------------------------------------------------------- parameter variants
def r07_min_ignored(t: Tables, p: ReportParams) -> DataFrame:
    """The contract minimum belongs to the broken report alone."""
    return R.r07_recent(t, p.with_(min_contract_total=Decimal("1500000")))


def r08_min_ignored(t: Tables, p: ReportParams) -> DataFrame:
    return R.r08_never_contacted(t, p.with_(min_contract_total=Decimal("1500000")))


def r05_all_time(t: Tables, p: ReportParams) -> DataFrame:
    """Right-party contact report without period bounds."""
    return R.r05_cpc_period(t, p.with_(start=None, end=None))


def r09_tagged(t: Tables, p: ReportParams) -> DataFrame:
    """Broken report with the portfolio-tag filter and contract minimum."""
    return R.r09_broken_rejected(
        t, p.with_(infoad=("BUILDING", "AUTOMOBILE", "MACHINERY"), min_contract_total=Decimal("1500000"))
    )


def r11_no_minimum(t: Tables, p: ReportParams) -> DataFrame:
    """Largest-debts report over all registrations (no minimum)."""
    return R.r11_largest_debts(t, p.with_(min_total=None))


def s10(t: Tables, p: ReportParams) -> DataFrame:
    """A report as the sink wrote it, read back, with the row count the sink gave (H05)."""
    df = R.r11_largest_debts(t, p)
    spark = df.sparkSession
    path = posixpath.join(shared_folder(spark), f"report-{uuid.uuid4().hex}")
    rows = write_report(df, path)
    return spark.read.parquet(path).withColumn("linhas", F.lit(rows).cast("long"))


EXTRA: dict[str, Query] = {
    "s01_cadastros": _scan("cadastros"),
    "s02_fones": _scan("fones"),
    "s03_acordos": _scan("acordos"),
    "s04_hist": _scan("hist"),
    "s06_receber": _scan("receber"),
    "s07_rec_comp": _scan("rec_comp"),
    "s08_bens": _scan("bens"),
    "s10_report_written": s10,
    "b01_latest_agreement_by_portfolio": b01,
    "b02_latest_agreement": b02,
    "b03_settled_contracts": b03,
    "b04_agreement_status": b04,
    "b05_contract_values": b05,
    "b06_collateral_summary": b06,
    "b07_ranked_phones": b07,
    "b09_phone_pivot": b09,
    "b11_no_classified_contact": b11,
    "b12_broken_contracts": b12,
    "b13_last_contact": b13,
    "b13_last_contact_any": b13_any,
    "h01_parse_money": h01,
    "h02_valid_date": h02,
    "h03_display_width": h03,
    "h03_display_width_contact_list": h03_contact_list,
    "h04_money_format": h04,
    "r05_cpc_period_all_time": r05_all_time,
    "r07_recent_min_ignored": r07_min_ignored,
    "r08_never_contacted_min_ignored": r08_min_ignored,
    "r09_broken_rejected_tagged": r09_tagged,
    "r11_largest_debts_no_minimum": r11_no_minimum,
}
