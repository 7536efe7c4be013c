"""Scalar column expressions and driver-side value parsers.

Everything returning a ``Column`` is a built-in Spark expression, so it stays
inside whole-stage codegen.
"""

from __future__ import annotations

import datetime as dt
import re
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from dunning.fixed import (
    AGREEMENT_LABEL_OTHER,
    AGREEMENT_LABELS,
    DATE_TEXT,
    INSTALMENTS,
    LUMP_SUM,
    STATUS_PREFERENCE,
)

def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def field_rank(status, values=STATUS_PREFERENCE) -> Column:
    """1-based position of ``status`` in ``values``; 0 when absent or null."""
    arr = F.array(*[F.lit(v) for v in values])
    return F.coalesce(F.array_position(arr, _c(status)), F.lit(0)).cast("int")


def date_text(d) -> Column:
    """Date as ``dd-MM-yyyy`` text (null stays null)."""
    return F.date_format(_c(d), DATE_TEXT)


def lump_or_instalments(qtd) -> Column:
    """Two-way label: exactly one instalment is AVISTA, anything else
    (including null and 0) is PARCELADO."""
    return F.when(_c(qtd) == 1, F.lit(LUMP_SUM)).otherwise(F.lit(INSTALMENTS))


def lump_or_instalments_strict(qtd) -> Column:
    """Three-way label: 1 -> AVISTA, more than 1 -> PARCELADO, else null."""
    q = _c(qtd)
    return F.when(q == 1, F.lit(LUMP_SUM)).when(q > 1, F.lit(INSTALMENTS))


def agreement_label(staco) -> Column:
    """Status code to label; unknown or null codes map to 'Sem Dados'."""
    s = _c(staco)
    expr = None
    for code, label in AGREEMENT_LABELS:
        expr = F.when(s == code, F.lit(label)) if expr is None else expr.when(s == code, F.lit(label))
    return expr.otherwise(F.lit(AGREEMENT_LABEL_OTHER))


def concat_text(*cols) -> Column:
    """CONCAT with null propagation; non-string inputs are cast to text."""
    return F.concat(*[_c(c).cast("string") for c in cols])


# ---------------------------------------------------------------- H01 / H02
_YMD = re.compile(r"[0-9]{4}-[0-9]{2}-[0-9]{2}")


def parse_ymd(text: str) -> dt.date:
    """Driver-side check of an operator-typed date: shape YYYY-MM-DD and a
    real calendar date (the shape-only check would accept 2025-13-45)."""
    if text is None or not _YMD.fullmatch(text.strip()):
        raise ValueError("invalid date, use YYYY-MM-DD")
    try:
        return dt.date.fromisoformat(text.strip())
    except ValueError as exc:
        raise ValueError(f"invalid date: {text!r}") from exc


# Money text, as a grammar. Both styles may start with the currency and a sign, and digits
# may be spaced. A comma marks the Brazilian style: dots group, the comma starts the
# decimals. Without a comma a single dot starts the decimals.
_MONEY_HEAD = r"^\s*(?:R\$)?\s*([+-]?)\s*"
BRAZILIAN_MONEY = _MONEY_HEAD + r"([0-9 .]*),([0-9 ]*)$"
PLAIN_MONEY = _MONEY_HEAD + r"([0-9 ]*)(?:\.([0-9 ]*))?$"


def parse_money_text(text: str | None) -> Decimal:
    """Amount of an operator-typed text in either style of the money grammar."""
    for style in (BRAZILIAN_MONEY, PLAIN_MONEY):
        found = re.match(style, (text or "").rstrip())
        if found is None:
            continue
        sign, whole, part = found[1], re.sub(r"[ .]", "", found[2]), (found[3] or "").replace(" ", "")
        if whole or part:
            return Decimal(f"{sign}{whole or 0}.{part or 0}")
    raise ValueError(f"not an amount: {text!r} (write 2500, 2500.75 or R$ 2.500,75)")


def money_from_text(text, scale: int = 2) -> Column:
    """Column form of the money grammar: null when the text is not an amount."""
    t = F.regexp_replace(_c(text), r"\s+$", "")

    def amount(style: str) -> Column:
        sign, whole, part = (F.regexp_replace(F.regexp_extract(t, style, k), "[ .]", "") for k in (1, 2, 3))
        number = F.concat(sign, F.when(whole == "", "0").otherwise(whole), F.lit("."), F.when(part == "", "0").otherwise(part))
        return F.when((whole != "") | (part != ""), number.try_cast(f"decimal(38,{scale})"))

    return F.when(t.rlike(BRAZILIAN_MONEY), amount(BRAZILIAN_MONEY)).when(t.rlike(PLAIN_MONEY), amount(PLAIN_MONEY))


def ymd_shape(text) -> Column:
    """True when the text has the shape YYYY-MM-DD (whole string)."""
    return _c(text).rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}\z")


def ymd_date(text) -> Column:
    """The calendar date of a YYYY-MM-DD text, null when impossible."""
    t = _c(text)
    return F.when(ymd_shape(t), F.try_to_date(t, "yyyy-MM-dd"))
