"""Properties of the reports on the sf0.01 fixture."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from dunning.functions import predicates as P
from dunning.params import FIXTURE_PARAMS
from dunning.plans import blocks as B
from dunning.plans.reports import REPORTS
from dunning.sources.tables import from_fixture
from tests.conftest import SMALL


@pytest.fixture(scope="module")
def tables(spark):
    return from_fixture(spark, SMALL)


def run(tables, key, **changes):
    return REPORTS[key].build(tables, FIXTURE_PARAMS.with_(**changes))


@pytest.mark.parametrize("key", ["r03_phones_top7", "r07_recent", "r08_never_contacted", "r09_broken_rejected"])
def test_phone_slots_fill_left_to_right(tables, key):
    df = run(tables, key)
    gap = None
    for k in range(1, 7):
        cond = F.col(f"Telefone{k}").isNull() & F.col(f"Telefone{k + 1}").isNotNull()
        gap = cond if gap is None else gap | cond
    assert df.where(gap | F.col("Telefone1").isNull()).count() == 0


def test_one_open_agreement_per_contract_and_portfolio(tables):
    df = run(tables, "r04_agreements_open")
    assert df.count() == df.select("nmcont", "cod_cli").distinct().count()
    assert df.where(~F.col("staco").isin("P", "A")).count() == 0


def test_largest_debts_top_and_order(tables):
    rows = run(tables, "r11_largest_debts").collect()
    assert len(rows) == 50
    totals = [r.ValorTotalDivida for r in rows]
    assert totals == sorted(totals, reverse=True) and min(totals) >= FIXTURE_PARAMS.min_total


def test_no_history_excludes_recent_human_events(tables):
    df = run(tables, "r06_no_history_30d")
    recent = tables.hist.where((F.col("data_at") >= P.days_before(FIXTURE_PARAMS.as_of)) & P.human_user("cod_usu"))
    assert df.join(recent, df.cod_cad == recent.cod_cli, "left_semi").count() == 0
    assert df.count() > 0


def test_contact_lists_only_show_broken_or_missing_agreements(tables):
    for key in ("r07_recent", "r08_never_contacted", "r09_broken_rejected"):
        labels = {r[0] for r in run(tables, key).select("StatusUltimoAcordo").distinct().collect()}
        assert labels <= {"Quebrado", "Exceção Rejeitada", None}, key


def test_broken_report_is_within_broken_contracts(tables):
    df = run(tables, "r09_broken_rejected")
    broken = B.b12_broken_contracts(B.b02_latest_agreement(tables, FIXTURE_PARAMS))
    regs = tables.cadastros.select("cod_cad", "nmcont")
    outside = df.join(regs, "cod_cad").join(broken, "nmcont", "left_anti")
    assert outside.count() == 0 and df.count() > 0
    assert df.where(F.col("StatusUltimoAcordo").isNull()).count() == 0


@pytest.mark.parametrize("key", ["r01_email", "r03_phones_top7", "r05_cpc_period", "r06_no_history_30d", "r10_collateral"])
def test_single_portfolio_reports_union_to_the_pair(tables, key):
    both = run(tables, key)
    a = run(tables, key, portfolios=(517,))
    b = run(tables, key, portfolios=(518,))
    assert both.count() > 0
    assert both.exceptAll(a.unionAll(b)).count() == 0 and a.unionAll(b).exceptAll(both).count() == 0


def test_contact_lists_hold_no_settled_contract(tables):
    settled = B.b03_settled_contracts(B.b02_latest_agreement(tables, FIXTURE_PARAMS))
    regs = tables.cadastros.select("cod_cad", "nmcont")
    for key in ("r07_recent", "r08_never_contacted", "r09_broken_rejected"):
        df = run(tables, key).join(regs, "cod_cad")
        assert df.count() > 0 and df.join(settled, "nmcont", "left_semi").count() == 0, key
