"""Report parameters, validated on the driver before any plan is built."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, replace
from decimal import Decimal

from dunning.fixed import AGREEMENTS_SINCE, PHONE_SLOTS, TOP
from dunning.functions.scalars import parse_money_text, parse_ymd


@dataclass(frozen=True)
class ReportParams:
    """Typed values for every template slot of the reports.

    portfolios          codes of the selected portfolios (``cod_cli``); at least one
    as_of               the report clock as wall time; ``None`` means now
    zone                time zone of that "now"; ``None`` means the session's (the zone in
                        which the history's event times are written)
    agreements_since    agreements created on or after this date are considered
    phone_slots         phones kept per registration (drives filter and pivot width)
    start, end          optional inclusive bounds of the right-party-contact report
    min_total           minimum debt of the largest-debts report
    top                 rows kept by the largest-debts report
    infoad              optional portfolio-tag filter of the broken-agreements report
    min_contract_total  optional HAVING of the contract-values block (broken report)
    hist_ref_col        column of ``hist_tb`` that holds the registration id in the
                        right-party-contact report
    """

    portfolios: tuple[int, ...]
    as_of: dt.datetime | None = None
    agreements_since: dt.date = AGREEMENTS_SINCE
    phone_slots: int = PHONE_SLOTS
    start: dt.date | None = None
    end: dt.date | None = None
    min_total: Decimal | None = None
    top: int = TOP
    infoad: tuple[str, ...] | None = None
    min_contract_total: Decimal | None = None
    hist_ref_col: str = "cod_cli"
    zone: str | None = None

    def __post_init__(self) -> None:
        ports = tuple(int(p) for p in (self.portfolios or ()))
        if not ports:
            raise ValueError("select at least one portfolio")
        object.__setattr__(self, "portfolios", ports)
        if self.phone_slots < 1:
            raise ValueError("phone_slots must be positive")
        if self.top < 1:
            raise ValueError("top must be positive")
        if self.start is not None and self.end is not None and self.start > self.end:
            raise ValueError("start is after end")
        if self.infoad is not None:
            object.__setattr__(self, "infoad", tuple(self.infoad))

    @classmethod
    def from_text(
        cls,
        portfolios,
        start: str | None = None,
        end: str | None = None,
        min_total: str | None = None,
        **kw,
    ) -> "ReportParams":
        """Build from operator-typed text: dates as YYYY-MM-DD, money as
        ``2500``, ``2500.75``, ``2.500,75`` or ``R$ 2.500,75``."""
        s = parse_ymd(start) if start and start.strip() else None
        e = parse_ymd(end) if end and end.strip() else None
        m = parse_money_text(min_total) if min_total is not None else None
        return cls(portfolios=tuple(portfolios), start=s, end=e, min_total=m, **kw)

    def with_(self, **changes) -> "ReportParams":
        return replace(self, **changes)


# Fixed values of the test fixture (FIXTURES.md §3).
FIXTURE_PARAMS = ReportParams(
    portfolios=(517, 518),
    as_of=dt.datetime(2025, 10, 1, 12, 0, 0),
    agreements_since=dt.date(2025, 7, 1),
    phone_slots=7,
    start=dt.date(2025, 8, 15),
    end=dt.date(2025, 8, 20),
    min_total=Decimal("1000000"),
    top=50,
)
