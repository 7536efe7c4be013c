"""Hand-written micro-frames for the semantic decisions of SURVEY §7.4."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

import pytest

from dunning.functions import scalars as S
from dunning.params import ReportParams
from dunning.plans import blocks as B
from dunning.plans import reports as R

D = dt.date
TS = dt.datetime
AS_OF = TS(2025, 10, 1, 12, 0, 0)
P = ReportParams(portfolios=(517,), as_of=AS_OF)


def cad(cod, stcli="ATI", nmcont=None, cod_cli=517, data_cad=D(2025, 9, 1), data_arq=None, infoad="SEG", nascto=None):
    nmcont = nmcont if nmcont is not None else f"CT{cod}"
    data_arq = data_arq if data_arq is not None else data_cad
    return (cod, f"N{cod}", f"{cod or 0:011d}", f"n{cod}@x", nmcont, cod_cli, stcli, infoad, nascto, data_cad, data_arq)


def phone(cod, tel, status=2, obs="Contato ok", ddd="11"):
    return (cod, ddd, tel, status, obs)


def contract(nmcont, cod_cli=517, fat="1/1", vlr="10.00", int_2=7, char_5="CDC"):
    """One complement row and one eligible instalment for a contract."""
    return (nmcont, cod_cli, int_2, char_5), (nmcont, cod_cli, fat, Decimal(vlr))


# ------------------------------------------------------------ registrations
def test_null_and_inactive_status_are_dropped(make_tables):
    t = make_tables(cadastros=[cad(1, "ATI"), cad(2, None), cad(3, "INA"), cad(4, "ina")])
    got = sorted(r.cpfcnpj for r in R.r01_email(t, P).collect())
    # 'ina' differs from 'INA' under exact code comparison
    assert got == [f"{1:011d}", f"{4:011d}"]


def test_empty_portfolio_selection_is_an_error():
    with pytest.raises(ValueError):
        ReportParams(portfolios=())


# ------------------------------------------------------------------- phones
def test_unlisted_and_null_status_rank_first(make_tables):
    t = make_tables(
        cadastros=[cad(1)],
        fones=[
            phone(1, "912345604", status=4),
            phone(1, "912345602", status=2),
            phone(1, "912345608", status=8),
            phone(1, "912345600", status=None),
        ],
    )
    (row,) = R.r03_phones_top7(t, P).collect()
    assert row.Telefone1 == "11912345600" and row.StatusTelefone1 is None
    assert [row.Telefone2, row.Telefone3, row.Telefone4] == ["11912345608", "11912345602", "11912345604"]
    assert row.Telefone5 is None


def test_phone_quality_filters(make_tables):
    t = make_tables(
        cadastros=[cad(1)],
        fones=[
            phone(1, "912345601", status=3, obs="desconhecido"),  # note says unknown (any case)
            phone(1, "912345602", status=3, obs=None),  # unlisted status, no note
            phone(1, "9X1234563"),  # masked
            phone(1, "911111193"),  # six equal digits (ddd 11 + 1111)
            phone(1, "12", ddd="1"),  # shorter than 8 bytes
            phone(1, None),  # null phone
            phone(1, "912345607", status=2, obs="DESCONHECIDO"),  # listed status wins
            phone(1, "912345608", status=7, obs="Numero INCORRETO"),  # wrong number
            phone(1, "912345609", status=7, obs=""),  # unlisted status, harmless note
        ],
    )
    (row,) = R.r03_phones_top7(t, P).collect()
    phones = [row[f"Telefone{k}"] for k in range(1, 8)]
    assert phones == ["11912345609", "11912345607", None, None, None, None, None]


def test_r03_keeps_duplicate_phones_contact_lists_do_not(make_tables):
    comp, inst = contract("CT1")
    t = make_tables(
        cadastros=[cad(1, data_cad=D(2025, 9, 15))],
        fones=[phone(1, "912345601"), phone(1, "912345601"), phone(1, "912345602", status=4)],
        rec_comp=[comp],
        receber=[inst],
    )
    (r3,) = R.r03_phones_top7(t, P).collect()
    assert [r3.Telefone1, r3.Telefone2, r3.Telefone3] == ["11912345601", "11912345601", "11912345602"]
    (r7,) = R.r07_recent(t, P).collect()
    assert [r7.Telefone1, r7.Telefone2, r7.Telefone3] == ["11912345601", "11912345602", None]
    assert r7.BindingID == 7 and r7.Contratos == "1/1" and r7.TipoProduto == "CDC"


def test_phone_slots_parameter_drives_filter_and_pivot(make_tables):
    t = make_tables(cadastros=[cad(1)], fones=[phone(1, f"91234560{i}", status=2) for i in range(5)])
    df = R.r03_phones_top7(t, P.with_(phone_slots=3))
    assert [c for c in df.columns if c.startswith("Telefone")] == ["Telefone1", "Telefone2", "Telefone3"]
    (row,) = df.collect()
    assert row.Telefone3 == "11912345602"


# ----------------------------------------------------------------- NOT IN
def _recent(cod_cli, hours_ago=1, user="5"):
    return (1, cod_cli, AS_OF - dt.timedelta(hours=hours_ago), "click", user)


def test_not_in_with_empty_list_keeps_everything(make_tables):
    t = make_tables(cadastros=[cad(1), cad(None)], hist=[_recent(1, hours_ago=24 * 40)])
    got = sorted((r.cod_cad is None, r.cod_cad) for r in R.r06_no_history_30d(t, P).collect())
    assert got == [(False, 1), (True, None)]


def test_not_in_drops_null_keys_when_list_is_not_empty(make_tables):
    t = make_tables(cadastros=[cad(1), cad(2), cad(None)], hist=[_recent(1)])
    assert [r.cod_cad for r in R.r06_no_history_30d(t, P).collect()] == [2]


def test_not_in_with_a_null_in_the_list_returns_nothing(make_tables):
    t = make_tables(cadastros=[cad(1), cad(2)], hist=[_recent(1), _recent(None)])
    assert R.r06_no_history_30d(t, P).count() == 0


def test_system_and_null_users_do_not_count_as_history(make_tables):
    t = make_tables(cadastros=[cad(1), cad(2), cad(3)], hist=[_recent(1, user="999"), _recent(2, user=None), _recent(3)])
    assert sorted(r.cod_cad for r in R.r06_no_history_30d(t, P).collect()) == [1, 2]


def test_rolling_window_to_the_second(make_tables):
    edge = AS_OF - dt.timedelta(days=30)
    t = make_tables(
        cadastros=[cad(1), cad(2)],
        hist=[(1, 1, edge, "click", "5"), (2, 2, edge - dt.timedelta(seconds=1), "click", "5")],
    )
    assert [r.cod_cad for r in R.r06_no_history_30d(t, P).collect()] == [2]


# ------------------------------------------------------- period / calendar
def test_period_end_is_inclusive_to_the_second(make_tables):
    p = P.with_(start=D(2025, 8, 15), end=D(2025, 8, 20))
    t = make_tables(
        cadastros=[cad(1), cad(2), cad(3)],
        hist=[
            (1, 1, TS(2025, 8, 20, 23, 59, 59), "click", "5"),
            (2, 2, TS(2025, 8, 20, 23, 59, 59, 500000), "click", "5"),
            (3, 3, TS(2025, 8, 14, 23, 59, 59), "click", "5"),
        ],
        stcob=[("click", "CPC")],
    )
    assert [r.cod_cad for r in R.r05_cpc_period(t, p).collect()] == [1]
    assert sorted(r.cod_cad for r in R.r05_cpc_period(t, p.with_(start=None, end=None)).collect()) == [1, 2, 3]


def test_cpc_match_is_case_insensitive_contains(make_tables):
    t = make_tables(
        cadastros=[cad(1), cad(2)],
        hist=[(1, 1, TS(2025, 8, 16), "a", "5"), (2, 2, TS(2025, 8, 16), "b", "5")],
        stcob=[("a", "cpc promessa"), ("b", "sistema")],
    )
    assert [r.cod_cad for r in R.r05_cpc_period(t, P).collect()] == [1]


def test_recent_intake_clamps_at_month_end(make_tables):
    p = P.with_(as_of=TS(2025, 4, 30, 9, 0, 0))
    comp1, inst1 = contract("CT1")
    comp2, inst2 = contract("CT2")
    t = make_tables(
        cadastros=[cad(1, data_cad=D(2025, 2, 28)), cad(2, data_cad=D(2025, 2, 27))],
        fones=[phone(1, "912345601"), phone(2, "912345602")],
        rec_comp=[comp1, comp2],
        receber=[inst1, inst2],
    )
    assert [r.cod_cad for r in R.r07_recent(t, p).collect()] == [1]


def test_recent_intake_requires_file_date_equal(make_tables):
    comp, inst = contract("CT1")
    t = make_tables(
        cadastros=[cad(1, data_cad=D(2025, 9, 1), data_arq=D(2025, 8, 31))],
        fones=[phone(1, "912345601")],
        rec_comp=[comp],
        receber=[inst],
    )
    assert R.r07_recent(t, P).count() == 0


# ------------------------------------------------------------ never contacted
def test_only_classified_human_contacts_count(make_tables):
    rows = [cad(i) for i in (1, 2, 3, 4)]
    comps = [contract(f"CT{i}") for i in (1, 2, 3, 4)]
    recent = TS(2025, 9, 20)
    t = make_tables(
        cadastros=rows,
        fones=[phone(i, f"91234560{i}") for i in (1, 2, 3, 4)],
        rec_comp=[c for c, _ in comps],
        receber=[r for _, r in comps],
        hist=[
            (1, 1, recent, "view", "5"),  # bsc 'sistema' is non-null: counts
            (2, 2, recent, "signup", "5"),  # bsc null: does not count
            (3, 3, recent, "error", "5"),  # no lookup row: does not count
            (4, 4, TS(2025, 8, 31, 23, 0, 0), "view", "5"),  # before midnight 30 days ago
        ],
        stcob=[("view", "sistema"), ("signup", None)],
    )
    assert sorted(r.cod_cad for r in R.r08_never_contacted(t, P).collect()) == [2, 3, 4]


# --------------------------------------------------------------- agreements
def aco(cod, nmcont, staco, qtd=1, cod_cli=517, data_cad=D(2025, 8, 1), vlr="100.00"):
    return (cod, nmcont, cod_cli, data_cad, data_cad, Decimal(vlr), qtd, staco)


def test_latest_agreement_decides_before_status(make_tables):
    t = make_tables(
        acordos=[
            aco(1, "CT1", "P"),
            aco(2, "CT1", "Q"),  # newer: CT1 is not open
            aco(3, "CT2", "A", qtd=None),
            aco(4, "CT3", "P", data_cad=D(2025, 6, 30)),  # before the cutoff
            aco(5, "CT4", "P", cod_cli=518),  # other portfolio
        ]
    )
    rows = R.r04_agreements_open(t, P).collect()
    assert [(r.nmcont, r.TipoAcordo, r.DataCriacaoGecobi) for r in rows] == [("CT2", "PARCELADO", "01-08-2025")]


def test_instalment_labels_two_and_three_way(make_tables):
    t = make_tables(acordos=[aco(1, "C1", "Q", qtd=1), aco(2, "C2", "Q", qtd=0), aco(3, "C3", "E", qtd=None), aco(4, "C4", "X", qtd=3)])
    latest = B.b02_latest_agreement(t, P)
    got = {r.nmcont: (r.TipoAcordo, r.StatusUltimoAcordo) for r in B.b04_agreement_status(latest).collect()}
    assert got == {"C1": ("AVISTA", "Quebrado"), "C2": (None, "Quebrado"), "C3": (None, "Exceção Rejeitada")}


def test_settled_contracts_leave_the_contact_lists(make_tables):
    c1, i1 = contract("CT1")
    c2, i2 = contract("CT2")
    t = make_tables(
        cadastros=[cad(1), cad(2)],
        fones=[phone(1, "912345601"), phone(2, "912345602")],
        rec_comp=[c1, c2],
        receber=[i1, i2],
        acordos=[aco(1, "CT1", "G"), aco(2, "CT2", "E")],
    )
    rows = R.r09_broken_rejected(t, P).collect()
    assert [(r.cod_cad, r.StatusUltimoAcordo) for r in rows] == [(2, "Exceção Rejeitada")]
    assert [r.cod_cad for r in R.r08_never_contacted(t, P).collect()] == [2]


def test_null_contract_in_settled_list_empties_contract_values(make_tables):
    c1, i1 = contract("CT1")
    t = make_tables(rec_comp=[c1], receber=[i1], acordos=[aco(1, None, "P")])
    assert B.b05_contract_values(t, P).count() == 0


def test_down_payments_and_null_instalments_are_not_contract_values(make_tables):
    t = make_tables(
        rec_comp=[("CT1", 517, 1, "B"), ("CT1", 517, 5, "A"), ("CT2", 517, 1, None)],
        receber=[
            ("CT1", 517, "ENTRADA 9/1", Decimal("1")),
            ("CT1", 517, "entrada 9/2", Decimal("1")),
            ("CT1", 517, "9/3", Decimal("1")),
            ("CT1", 517, "9/3", Decimal("1")),
            ("CT1", 517, "10/1", Decimal("1")),
            ("CT2", 517, None, Decimal("1")),
        ],
    )
    rows = B.b05_contract_values(t, P).collect()
    assert [(r.nmcont, r.Contratos, r.TipoProduto, r.BindingID) for r in rows] == [("CT1", "10/1 || 9/3", "A || B", 5)]


# ------------------------------------------------------------------- assets
def bem(nmcont, marca, modelo, placa, chassi, cor="PRETO", cod_cli=517):
    return (nmcont, cod_cli, marca, modelo, placa, cor, 2020, 2021, chassi)


def test_collateral_lists_and_counts(make_tables):
    t = make_tables(
        cadastros=[cad(1), cad(2, nmcont="CT1"), cad(3)],
        bens=[
            bem("CT1", "B", "x", "P2", "C1"),
            bem("CT1", "A", "y", "P1", "C2"),
            bem("CT1", "A", "y", "P1", "C2"),
            bem("CT1", "A", None, None, None),
            bem("CT3", "A", None, "P9", None),
        ],
    )
    rows = {r.cod_cad: r for r in R.r10_collateral(t, P).collect()}
    # registrations sharing a contract each get the whole summary
    for k in (1, 2):
        assert (rows[k].QtdGarantiasUnicas, rows[k].MarcaModelo, rows[k].Placas) == (2, "A - y || B - x", "P1 || P2")
    assert (rows[3].QtdGarantiasUnicas, rows[3].MarcaModelo, rows[3].Placas) == (0, None, "P9")


def test_asset_pick_is_deterministic(make_tables):
    t = make_tables(bens=[bem("CT1", "B", "x", "P2", "C1"), bem("CT1", "A", "y", "P1", None)])
    (row,) = B.b06_collateral_summary(t, P).collect()
    # nulls first: the row with a null chassi is picked; one distinct chassi
    assert (row.MarcaModelo, row.placa, row.AnoFabModelo, row.QtdGarantiasUnicas) == ("A - y", "P1", "2020/2021", 1)


# --------------------------------------------------------------- top debts
def test_largest_debts_ties_break_by_registration(make_tables):
    regs = [cad(k, nmcont=f"CT{k}") for k in (5, 3, 4, 9)]
    inst = [(f"CT{k}", 517, f"{k}/1", Decimal("100.00")) for k in (5, 3, 4)] + [("CT9", 517, "9/1", Decimal("50.00"))]
    inst.append(("CT9", 517, "9/1", Decimal("60.00")))
    t = make_tables(cadastros=regs, receber=inst)
    rows = R.r11_largest_debts(t, P.with_(top=3, min_total=None)).collect()
    assert [(r.cod_cad, r.QtdContratos, r.ValorTotalDivida) for r in rows] == [
        (9, 1, Decimal("110.00")),
        (3, 1, Decimal("100.00")),
        (4, 1, Decimal("100.00")),
    ]
    rows = R.r11_largest_debts(t, P.with_(min_total=Decimal("105"))).collect()
    assert [r.cod_cad for r in rows] == [9]


# ------------------------------------------------------------ text helpers
@pytest.mark.parametrize(
    "text,value",
    [
        ("7", "7"),
        ("82.25", "82.25"),
        ("3.750", "3.750"),  # no comma: a single dot starts the decimals
        ("3.750,", "3750"),
        ("R$ 48.006,1", "48006.1"),
        ("  R$12.345.678,90 ", "12345678.90"),
        ("- 12 500,5", "-12500.5"),
        (",5", "0.5"),
        (".5", "0.5"),
    ],
)
def test_money_text(spark, text, value):
    assert S.parse_money_text(text) == Decimal(value)
    (row,) = spark.createDataFrame([(text,)], "t string").select(S.money_from_text("t", scale=3).alias("v")).collect()
    assert row.v == Decimal(value)


@pytest.mark.parametrize("text", ["", "   ", "abc", "1,2,3", "1.2.3", "R$", ",", ".", "1e5", "٣", None])
def test_money_text_rejects(spark, text):
    with pytest.raises(ValueError):
        S.parse_money_text(text)
    (row,) = spark.createDataFrame([(text,)], "t string").select(S.money_from_text("t").alias("v")).collect()
    assert row.v is None


def test_date_text(spark):
    assert S.parse_ymd("2025-02-28") == D(2025, 2, 28)
    for bad in ("2025-13-45", "2025-02-30", "25-01-01", "2025/01/01", "2025-01-01x"):
        with pytest.raises(ValueError):
            S.parse_ymd(bad)
    df = spark.createDataFrame([("2025-02-28",), ("2025-13-45",), ("2025-1-1",), ("2025-01-01\n",)], "t string")
    got = [(r.ok, r.d) for r in df.select(S.ymd_shape("t").alias("ok"), S.ymd_date("t").alias("d")).collect()]
    assert got == [(True, D(2025, 2, 28)), (True, None), (False, None), (False, None)]


def test_params_from_text():
    p = ReportParams.from_text([517], start="2025-08-15", end="", min_total="R$ 1.000,00")
    assert (p.start, p.end, p.min_total) == (D(2025, 8, 15), None, Decimal("1000.00"))
    with pytest.raises(ValueError):
        ReportParams.from_text([517], start="2025-08-20", end="2025-08-15")


def test_settled_agreement_without_contract_empties_the_contact_lists(make_tables):
    c1, i1 = contract("CT1")
    base = dict(
        cadastros=[cad(1)],
        fones=[phone(1, "912345601")],
        rec_comp=[c1],
        receber=[i1],
    )
    t = make_tables(**base, acordos=[aco(1, "CT1", "Q"), aco(2, None, "Q")])
    assert R.r08_never_contacted(t, P).count() == 1 and R.r09_broken_rejected(t, P).count() == 1
    t = make_tables(**base, acordos=[aco(1, "CT1", "Q"), aco(2, None, "A")])
    assert R.r08_never_contacted(t, P).count() == 0 and R.r09_broken_rejected(t, P).count() == 0
    # an older settled agreement without contract does not count: the latest one decides
    t = make_tables(**base, acordos=[aco(1, "CT1", "Q"), aco(2, None, "A"), aco(3, None, "E")])
    assert R.r08_never_contacted(t, P).count() == 1


def test_history_reference_column_is_a_parameter(make_tables):
    t = make_tables(
        cadastros=[cad(1), cad(2)],
        hist=[(2, 1, TS(2025, 8, 16), "click", "5")],  # cod_hist 2, cod_cli 1
        stcob=[("click", "CPC")],
    )
    assert [r.cod_cad for r in R.r05_cpc_period(t, P).collect()] == [1]
    assert [r.cod_cad for r in R.r05_cpc_period(t, P.with_(hist_ref_col="cod_hist")).collect()] == [2]


def test_last_contact_always_reads_cod_cli(make_tables):
    t = make_tables(
        cadastros=[cad(1), cad(2)],
        hist=[(2, 1, TS(2025, 8, 16), "click", "5"), (1, 2, TS(2025, 8, 17), "view", "5")],
        stcob=[("click", "CPC"), ("view", "sistema")],
    )
    p = P.with_(hist_ref_col="cod_hist")
    assert {r.nmcont for r in B.b13_last_contact(t, p).collect()} == {"CT1"}
    assert {r.nmcont for r in B.b13_last_contact(t, p, cpc_only=False).collect()} == {"CT1", "CT2"}


def test_contract_minimum_belongs_to_the_broken_report(make_tables):
    c1, i1 = contract("CT1")
    t = make_tables(cadastros=[cad(1, data_cad=D(2025, 9, 15))], fones=[phone(1, "912345601")], rec_comp=[c1], receber=[i1], acordos=[aco(1, "CT1", "Q")])
    p = P.with_(min_contract_total=Decimal("1000"))
    counts = [f(t, p).count() for f in (R.r07_recent, R.r08_never_contacted, R.r09_broken_rejected)]
    assert counts == [1, 1, 0] and B.b05_contract_values(t, p).count() == 1


def test_repeated_registration_rows(make_tables):
    """Reports that the reference groups give one row; phones of R03 fill as many slots as there are rows."""
    c1, i1 = contract("CT1", vlr="10.00")
    t = make_tables(
        cadastros=[cad(1, data_cad=D(2025, 9, 15))] * 2,
        fones=[phone(1, "912345601"), phone(1, "912345602", status=4)],
        rec_comp=[c1],
        receber=[i1],
        bens=[bem("CT1", "A", "y", "P1", "C2")],
        hist=[(1, 1, TS(2025, 8, 16), "click", "5")],
        stcob=[("click", "CPC")],
    )
    (r3,) = R.r03_phones_top7(t, P).collect()
    assert [r3[f"Telefone{k}"] for k in range(1, 6)] == ["11912345601", "11912345601", "11912345602", "11912345602", None]
    for report in (R.r05_cpc_period, R.r07_recent, R.r08_never_contacted, R.r10_collateral):
        assert report(t, P).count() == 1, report.__name__
    (debt,) = R.r11_largest_debts(t, P).collect()
    assert (debt.QtdContratos, debt.ValorTotalDivida) == (1, Decimal("20.00"))
    assert R.r01_email(t, P).count() == 2


def test_default_clock_is_wall_time_in_its_zone(spark, make_tables):
    """Without as_of, "now" is read in the session's or the given zone, and the session's zone stays."""
    from zoneinfo import ZoneInfo

    before = spark.conf.get("spark.sql.session.timeZone")
    for session, zone in (("Asia/Tokyo", None), ("UTC", "America/Sao_Paulo"), ("Asia/Tokyo", "UTC")):
        spark.conf.set("spark.sql.session.timeZone", session)
        try:
            now = TS.now(ZoneInfo(zone or session)).replace(tzinfo=None)
            inside, outside = now - dt.timedelta(days=30, minutes=-10), now - dt.timedelta(days=30, minutes=10)
            t = make_tables(cadastros=[cad(1), cad(2)], hist=[(1, 1, inside, "click", "5"), (2, 2, outside, "click", "5")])
            got = [r.cod_cad for r in R.r06_no_history_30d(t, ReportParams(portfolios=(517,), zone=zone)).collect()]
            assert got == [2], (session, zone)
            assert spark.conf.get("spark.sql.session.timeZone") == session
        finally:
            spark.conf.set("spark.sql.session.timeZone", before)


def test_configure_leaves_the_time_zone_alone(spark):
    from dunning.session import DEFAULTS

    assert "spark.sql.session.timeZone" not in DEFAULTS
