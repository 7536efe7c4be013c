"""Shared building blocks of the reports (the reference's CTEs).

Each block is a function of the input tables and the parameters that returns
a lazy DataFrame. Blocks that are keyed by contract or registration aggregate
their (large) source table first, with map-side partial aggregation, and only
then join: no block joins two many-row-per-key tables to each other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dunning.fixed import (
    AGREEMENT_CREATED,
    AGREEMENT_KIND,
    AGREEMENT_STATUS,
    AGREEMENT_VALUE,
    DOWN_PAYMENT,
    PAIR_JOINER,
    RIGHT_PARTY,
    YEAR_JOINER,
)
from dunning.functions import predicates as P
from dunning.functions import scalars as S
from dunning.operators.antijoin import anti_join, not_in
from dunning.operators.keyset import may_be_among
from dunning.operators.lists import ordered_lists
from dunning.operators.ranking import latest_per_key, pivot_slots, top_n_per_key
from dunning.params import ReportParams
from dunning.sources.tables import Tables

CONTRACT = ["nmcont", "cod_cli"]


# ------------------------------------------------------------ registrations
def registrations(t: Tables, p: ReportParams) -> DataFrame:
    """Active registrations of the selected portfolios."""
    return t.cadastros.where(P.in_portfolios("cod_cli", p.portfolios) & P.active("stcli"))


# --------------------------------------------------------------- agreements
def _agreements_since(t: Tables, p: ReportParams) -> DataFrame:
    return t.acordos.where(
        P.in_portfolios("cod_cli", p.portfolios) & (F.col("data_cad") >= F.lit(p.agreements_since))
    )


def b01_latest_agreement_by_portfolio(t: Tables, p: ReportParams) -> DataFrame:
    """Latest agreement (highest cod_aco) per (nmcont, cod_cli) since the cutoff."""
    return latest_per_key(_agreements_since(t, p), CONTRACT, [F.col("cod_aco").desc()])


def b02_latest_agreement(t: Tables, p: ReportParams) -> DataFrame:
    """Latest agreement per nmcont across the selected portfolios."""
    return latest_per_key(_agreements_since(t, p), ["nmcont"], [F.col("cod_aco").desc()])


def b03_settled_contracts(latest: DataFrame) -> DataFrame:
    """Contracts whose latest agreement is promised, paid or open."""
    return latest.where(P.settled()).select("nmcont")


def listable_contracts(t: Tables, p: ReportParams, regs: DataFrame, broken: bool = False) -> DataFrame:
    """Contracts of the registrations ``regs`` whose latest agreement (per nmcont only) is broken, or else not settled, with it.

    The latter is the reference's ``NOT IN``. A null contract never joins a registration, so the only null effect
    left is global: a settled agreement with a null contract empties the report.
    """
    names = {"staco": "a_staco", "vlr_aco": "a_vlr", "qtd_p_aco": "a_qtd", "data_cad": "a_data_cad"}
    latest = b02_latest_agreement(t, p).select("nmcont", *[F.col(c).alias(a) for c, a in names.items()])
    side = regs.where("nmcont IS NOT NULL").select(*CONTRACT).distinct()
    if broken:
        side = side.join(latest.where(P.broken("a_staco")), "nmcont")
    else:
        side = side.join(latest, "nmcont", "left").where(~P.settled("a_staco"))
    return side.where(~settled_list_has_null(t, p))


def agreement_columns(staco: str, vlr: str, qtd: str, data_cad: str) -> list[Column]:
    """The four agreement columns of a labelled latest agreement; null where the status has no label."""
    values = {
        AGREEMENT_VALUE: F.col(vlr),
        AGREEMENT_KIND: S.lump_or_instalments_strict(qtd),
        AGREEMENT_CREATED: S.date_text(data_cad),
        AGREEMENT_STATUS: S.agreement_label(staco),
    }
    return [F.when(P.known(staco), v).alias(name) for name, v in values.items()]


def b04_agreement_status(latest: DataFrame) -> DataFrame:
    """Labelled latest agreement per nmcont (known statuses only)."""
    return latest.where(P.known()).select("nmcont", *agreement_columns("staco", "vlr_aco", "qtd_p_aco", "data_cad"), "staco")


def b12_broken_contracts(latest: DataFrame) -> DataFrame:
    """Contracts whose latest agreement is broken or rejected."""
    return latest.where(P.broken()).select("nmcont")


# ---------------------------------------------------------------- contracts
def _among(df: DataFrame, among: Column | None) -> DataFrame:
    """Rows whose contract may be wanted (``operators.keyset.may_be_among``)."""
    return df if among is None else df.where(among)


def contract_complements(t: Tables, p: ReportParams, among: Column | None = None) -> DataFrame:
    """Per contract: product types, BindingID (max int_2) and row count."""
    kinds = (
        _among(t.rec_comp.where(P.in_portfolios("cod_cli", p.portfolios)), among)
        .groupBy(*CONTRACT, "char_5")
        .agg(F.max("int_2").alias("int_2"), F.count(F.lit(1)).alias("n"))
    )
    return ordered_lists(kinds, CONTRACT, ["char_5"], "char_5", "TipoProduto", also={"BindingID": (F.max, "int_2"), "n_comp": (F.sum, "n")})


def eligible_instalments(t: Tables, p: ReportParams, among: Column | None = None) -> DataFrame:
    """One row per contract and instalment id that is no down payment, with its total.

    A null ``fat_parc`` fails the NOT LIKE and is dropped, as in the reference. The
    hash aggregate is keyed by the id too, so a hot contract's instalments are spread.
    """
    wanted = P.in_portfolios("cod_cli", p.portfolios) & P.not_contains_ci("fat_parc", DOWN_PAYMENT)
    return _among(t.receber.where(wanted), among).groupBy(*CONTRACT, "fat_parc").agg(F.sum("vlrparc").alias("vlr"))


def with_instalment_lists(contracts: DataFrame, t: Tables, p: ReportParams, with_total: bool = False, keys: DataFrame | None = None, among: Column | None = None) -> DataFrame:
    """``contracts`` (one row per contract, with ``n_comp``) that have an eligible instalment, and ``Contratos``.

    The reference joins every complement row to every instalment row of the
    contract and then takes DISTINCT lists; both lists only depend on the two
    sides separately, so each side is reduced on its own first. ``ValorTotal``, which the optional
    minimum is for, is ``SUM(vlrparc)`` over that join, i.e. complement rows x instalment total.
    Instalments of contracts that ``keys`` (by default ``contracts``) lacks leave at the join before any list, and those
    that ``among`` rules out at their scan.
    """
    instalments = (contracts if keys is None else keys).select(*CONTRACT).join(eligible_instalments(t, p, among), CONTRACT)
    total = {"vlr_total": (F.sum, "vlr")} if with_total else None
    out = contracts.join(ordered_lists(instalments, CONTRACT, ["fat_parc"], "fat_parc", "Contratos", also=total), CONTRACT)
    if with_total:
        out = out.withColumn("ValorTotal", F.col("n_comp") * F.col("vlr_total")).drop("vlr_total")
    return out.drop("n_comp")


def with_contract_facts(contracts: DataFrame, t: Tables, p: ReportParams, with_total: bool = False, few: bool = False) -> DataFrame:
    """``contracts`` (one row per contract) that have complements and eligible instalments, with these, their lists and their asset.

    Where they are ``few`` of all, complements, assets and instalments of any other contract leave at their scans;
    else at the joins, instalments before any list.
    """
    keys = contracts.select(*CONTRACT)
    among = may_be_among(keys, CONTRACT) if few else None
    facts = contracts.join(contract_complements(t, p, among), CONTRACT).join(b06_collateral_summary(t, p, among), CONTRACT, "left")
    return with_instalment_lists(facts, t, p, with_total, keys, among)


def b05_contract_values(t: Tables, p: ReportParams, latest: DataFrame | None = None) -> DataFrame:
    """Lists per contract, without contracts whose latest agreement is settled
    (``nmcont NOT IN (settled)``, null-aware); these leave before their lists are made."""
    latest = latest if latest is not None else b02_latest_agreement(t, p)
    kept = not_in(contract_complements(t, p), "nmcont", b03_settled_contracts(latest), "nmcont")
    return with_instalment_lists(kept, t, p).select(*CONTRACT, "Contratos", "TipoProduto", "BindingID")


def settled_list_has_null(t: Tables, p: ReportParams) -> Column:
    """True when the settled-contracts list holds a null contract, i.e. the
    latest agreement without a contract number is promised, paid or open.

    Only agreements with a null nmcont are read (one group), so this scalar
    costs a filtered scan, not another window over all agreements.
    """
    nulls = _agreements_since(t, p).where(F.col("nmcont").isNull())
    last = nulls.select(F.max_by("staco", "cod_aco").alias("staco"))
    return last.select(P.settled()).scalar()


# ------------------------------------------------------------------- assets
def b06_collateral_summary(t: Tables, p: ReportParams, among: Column | None = None) -> DataFrame:
    """Per contract: one asset row and the count of distinct chassis, from one scan.

    The reference takes the non-grouped columns from an arbitrary row; here
    the row is the least (chassi, placa, marca, modelo, cor, anofab,
    anomodelo), nulls first, so the result is deterministic. A contract's least row is that of its
    least chassis, so the least row per (contract, chassis), which spreads a hot contract, gives both.
    """
    assets = _among(t.bens.where(P.in_portfolios("cod_cli", p.portfolios)), among)
    rest = ["placa", "marca", "modelo", "cor", "anofab", "anomodelo"]
    per_chassis = assets.groupBy(*CONTRACT, "chassi").agg(F.min(F.struct(*rest)).alias("row"))
    per_contract = per_chassis.groupBy(*CONTRACT).agg(
        F.min(F.struct("chassi", "row")).alias("least"), F.count("chassi").alias("QtdGarantiasUnicas")
    )
    return per_contract.select(*CONTRACT, "least.row.*", "QtdGarantiasUnicas").select(
        *CONTRACT,
        S.concat_text("marca", F.lit(PAIR_JOINER), "modelo").alias("MarcaModelo"),
        "placa",
        "cor",
        S.concat_text("anofab", F.lit(YEAR_JOINER), "anomodelo").alias("AnoFabModelo"),
        "QtdGarantiasUnicas",
    )


# ------------------------------------------------------------------- phones
def phone_order():
    """Best phone first: FIELD(status, 2,4,5,6,1,0), then status; the
    remaining keys only break ties between otherwise equal rows."""
    return [
        S.field_rank("status").asc(),
        F.col("status").asc_nulls_first(),
        F.col("dddfone").asc_nulls_first(),
        F.col("telefone").asc_nulls_first(),
    ]


def b07_ranked_phones(t: Tables, p: ReportParams, quality: bool = True) -> DataFrame:
    """Deduplicated phones ranked per registration, best first, top N kept.

    quality=True adds the status/note, length and mask filters (broken and
    never-contacted reports); the recent-intake report only drops runs of six
    equal digits. Rows equal on (dddfone, telefone, status) count once: a hash
    aggregate on them removes repeats on the map side and spreads a hot
    registration's phones before they are numbered.
    """
    phone = S.concat_text("dddfone", "telefone")
    cond = P.no_repeated_digits(phone)
    if quality:
        cond = cond & P.phone_quality("status", "obs") & P.min_phone_length(phone) & P.not_masked(phone)
    f = t.fones.where(cond).select("cod_cad", "dddfone", "telefone", "status").distinct()
    ranked = top_n_per_key(f, "cod_cad", phone_order(), p.phone_slots, rank_col="num")
    return ranked.select("cod_cad", "num", phone.alias("telefones"), "status")


def b09_phone_pivot(ranked: DataFrame, p: ReportParams) -> DataFrame:
    """One row per registration with Telefone1..N."""
    return pivot_slots(ranked, ["cod_cad"], "num", "telefones", p.phone_slots, "Telefone")


# ------------------------------------------------------------------ history
def history(t: Tables, lower=None, upper=None) -> DataFrame:
    """Contact events with ``lower <= data_at <= upper`` (either optional).

    When the table is known to be stored by event day (``Tables.hist_day``), the
    matching day filters are added too, so only the folders inside the window are read:
    Spark cannot derive them from the timestamp predicate by itself.
    """
    h = t.hist
    for bound, inside in ((lower, lambda a, b: a >= b), (upper, lambda a, b: a <= b)):
        if bound is not None:
            h = h.where(inside(F.col("data_at"), bound))
            if t.hist_day is not None:
                h = h.where(inside(F.col(t.hist_day), F.to_date(bound)))
    return h


def _lookup(t: Tables, cond) -> DataFrame:
    """Occurrence codes matching ``cond``, for a semi join (existence only, so
    repeated codes need no dedup). The planner broadcasts them by their measured size."""
    return t.stcob.where(cond).select(F.col("st").alias("ocorr"))


def classified_recent_contacts(t: Tables, p: ReportParams) -> DataFrame:
    """Registration ids with a human, classified event since midnight 30 days ago.

    An event is classified when its code has a lookup row with a non-null class
    (the reference's condition on the class is true for every text), so a semi
    join with those codes is enough. Events meet the lookup as one row per registration and code.
    """
    h = history(t, lower=P.midnight_days_before(p.as_of, zone=p.zone)).where(P.human_user("cod_usu"))
    seen = h.select(F.col("cod_cli").alias("cod_cad"), "ocorr").distinct()
    return seen.join(_lookup(t, F.col("bsc").isNotNull()), "ocorr", "left_semi").select("cod_cad")


def b11_no_classified_contact(t: Tables, p: ReportParams, base: DataFrame | None = None) -> DataFrame:
    """Registrations with no classified human contact in the last 30 days.

    The reference's NOT IN is correlated on the registration id, which removes
    the null trap: a plain anti join.
    """
    base = base if base is not None else registrations(t, p)
    return anti_join(base, "cod_cad", classified_recent_contacts(t, p), "cod_cad")


def last_event_per_registration(t: Tables, p: ReportParams, cpc_only: bool, bounded: bool = False, ref: str = "cod_cli") -> DataFrame:
    """MAX(data_at) per registration id (history column ``ref``) over events whose code
    has a lookup row (optionally a right-party-contact row, optionally within start/end).

    Aggregated per registration and code before any join, so a registration with very many
    events is reduced map-side to one row per code and task, and the few-valued code is never
    a shuffle key of events, whether or not the size of the lookup is known.
    """
    h = history(t, P.period_start(p.start), P.period_end(p.end)) if bounded else t.hist
    codes = _lookup(t, P.contains_ci("bsc", RIGHT_PARTY) if cpc_only else F.lit(True))
    last = h.groupBy(F.col(ref).alias("cod_cad"), "ocorr").agg(F.max("data_at").alias("data_at"))
    return last.join(codes, "ocorr", "left_semi").groupBy("cod_cad").agg(F.max("data_at").alias("dt_ultimo_cpc"))


def b13_last_contact(t: Tables, p: ReportParams, cpc_only: bool = True) -> DataFrame:
    """Last (right-party) contact per contract of active registrations.

    Computed by the reference inside the large reports but never projected;
    offered as a block on its own. It always reads ``cod_cli`` as the registration id.
    """
    last = last_event_per_registration(t, p, cpc_only)
    regs = registrations(t, p).select("cod_cad", "nmcont")
    return regs.join(last, "cod_cad").groupBy("nmcont").agg(F.max("dt_ultimo_cpc").alias("dt_ultimo_cpc"))
