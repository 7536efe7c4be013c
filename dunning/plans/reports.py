"""The eleven reports, composed from the blocks.

Every function takes the input tables and the parameters and returns a lazy
DataFrame; the caller decides the action (write, count, show).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dunning.fixed import (
    AGREEMENT_COLUMNS,
    AGREEMENT_CREATED,
    AGREEMENT_KIND,
    AGREEMENT_VALUE,
    CONTACT_LIST_HEAD,
    CONTACT_LIST_TAIL,
    PAIR_JOINER,
)
from dunning.functions import predicates as P
from dunning.functions import scalars as S
from dunning.operators.antijoin import not_in
from dunning.operators.lists import ordered_lists
from dunning.operators.ranking import pivot_slots, top_n_per_key
from dunning.params import ReportParams
from dunning.plans import blocks as B
from dunning.sources.tables import Tables

CONTRACT = B.CONTRACT


def identity():
    """cod_cad, nome, cpf, nmcont: the public names of the registration."""
    return ["cod_cad", F.col("nomecli").alias("nome"), F.col("cpfcnpj").alias("cpf"), "nmcont"]


def r01_email(t: Tables, p: ReportParams) -> DataFrame:
    """Name, tax id and e-mail of active registrations (no dedup)."""
    return B.registrations(t, p).select("nomecli", "cpfcnpj", "email")


def r02_name_taxid(t: Tables, p: ReportParams) -> DataFrame:
    """Name and tax id of active registrations (no dedup)."""
    return B.registrations(t, p).select("nomecli", "cpfcnpj")


def r03_phones_top7(t: Tables, p: ReportParams) -> DataFrame:
    """Best dialable phones per active registration, pivoted to columns,
    with status and note of the best phone. Phones are not deduplicated.

    Phones are ranked per registration before the join with registrations:
    the registration filters keep or drop whole groups, so the numbering is
    the same, and the top-N limit runs map-side before the shuffle. A registration
    row that is there m times gives one output row in which each phone fills m slots,
    as joining first would.
    """
    phone = S.concat_text("dddfone", "telefone")
    f = t.fones.where(P.phone_quality("status", "obs") & P.dialable(phone)).select(
        "cod_cad", "dddfone", "telefone", "status", "obs", phone.alias("telefone_txt")
    )
    order = B.phone_order() + [F.col("obs").asc_nulls_first()]
    ranked = top_n_per_key(f, "cod_cad", order, p.phone_slots, rank_col="num")
    extra = {"StatusTelefone1": (1, "status"), "ObsTelefone1": (1, "obs")}
    pivot = pivot_slots(ranked, ["cod_cad"], "num", "telefone_txt", p.phone_slots, "Telefone", extra)
    regs = B.registrations(t, p).select(*identity(), "cod_cli", F.col("infoad").alias("portfolio"))
    out = regs.groupBy(*regs.columns).agg(F.count(F.lit(1)).alias("m")).join(pivot, "cod_cad")
    slots = F.array(*[F.col(f"Telefone{k}") for k in range(1, p.phone_slots + 1)])
    filled = {f"Telefone{k}": F.when(F.col("m") == 1, F.col(f"Telefone{k}")).otherwise(F.element_at(slots, F.ceil(F.lit(k) / F.col("m")).cast("int"))) for k in range(1, p.phone_slots + 1)}
    return out.select(*[filled[c].alias(c) if c in filled else c for c in out.columns if c != "m"])


def r04_agreements_open(t: Tables, p: ReportParams) -> DataFrame:
    """Latest agreement per (contract, portfolio) since the cutoff, when it is
    promised or open; newest first."""
    latest = B.b01_latest_agreement_by_portfolio(t, p)
    return (
        latest.where(P.is_open())
        .select(
            "nmcont",
            "cod_cli",
            "cod_aco",
            S.date_text("data_cad").alias(AGREEMENT_CREATED),
            F.col("vlr_aco").alias(AGREEMENT_VALUE),
            "qtd_p_aco",
            S.lump_or_instalments("qtd_p_aco").alias(AGREEMENT_KIND),
            "staco",
        )
        .orderBy(F.col("cod_aco").desc())
    )


def r05_cpc_period(t: Tables, p: ReportParams) -> DataFrame:
    """Last right-party contact per active registration, optionally within
    inclusive start/end dates."""
    last = B.last_event_per_registration(t, p, cpc_only=True, bounded=True, ref=p.hist_ref_col)
    regs = B.registrations(t, p).select(*identity()).distinct()
    return regs.join(last, "cod_cad").select("cod_cad", "nome", "cpf", "nmcont", "dt_ultimo_cpc")


def r06_no_history_30d(t: Tables, p: ReportParams) -> DataFrame:
    """Active registrations with no human event in the last 30 days (to the
    second). The reference's NOT IN is uncorrelated, so a null id in recent
    history empties the report, exactly as SQL does."""
    recent = B.history(t, lower=P.days_before(p.as_of, zone=p.zone)).where(P.human_user("cod_usu"))
    regs = B.registrations(t, p)
    kept = not_in(regs, "cod_cad", recent, "cod_cli")
    return kept.select(*identity(), "cod_cli", F.col("infoad").alias("portfolio"))


def _contracts(t: Tables, p: ReportParams, kind: str, regs: DataFrame) -> DataFrame:
    """One row per contract that may be listed: latest agreement, complements, assets, instalment ids.

    The contracts that can be listed come first: those of the registrations ``regs`` whose latest
    agreement is broken for R09, and not settled otherwise. What else is said of them is read for these
    contracts alone, or taken from facts that several reports share. Recent intake and broken agreements are few of all
    contracts; those without contact are not, so no filter goes down to their scans.
    """
    minimum = p.min_contract_total if kind == "broken" else None
    side = B.listable_contracts(t, p, regs, kind == "broken")
    if t.contract_facts is not None:
        side = side.join(t.contract_facts, CONTRACT)
    else:
        side = B.with_contract_facts(side, t, p, minimum is not None, few=kind != "never")
    if minimum is not None:
        side = side.where(F.col("ValorTotal") >= F.lit(minimum))
    known = [c for c in CONTACT_LIST_TAIL if c not in AGREEMENT_COLUMNS]
    return side.select(*CONTRACT, "BindingID", *known, *B.agreement_columns("a_staco", "a_vlr", "a_qtd", "a_data_cad"))


def _contact_list(t: Tables, p: ReportParams, kind: str) -> DataFrame:
    """Shared assembly of R07 (recent), R08 (never contacted), R09 (broken).

    Everything known per contract is put into one row first; the registrations
    with their phones meet it last. That join stands at the top, between two
    exchanges, so a contract shared by very many registrations is split at run time.
    """
    cad = B.registrations(t, p)
    if kind == "recent":
        cad = cad.where((F.col("data_cad") == F.col("data_arq")) & P.recent_intake("data_cad", p.as_of, zone=p.zone))
    if kind == "broken" and p.infoad:
        cad = cad.where(F.col("infoad").isin(list(p.infoad)))
    contracts = _contracts(t, p, kind, cad)  # for R08 before its anti join: history is read once
    if kind == "never":
        cad = B.b11_no_classified_contact(t, p, cad)
    cad = cad.select(
        *identity(),
        "cod_cli",
        S.date_text("nascto").alias("DataNascimento"),
        F.col("infoad").alias("Portfolio"),
    ).distinct()

    phones = B.b09_phone_pivot(B.b07_ranked_phones(t, p, quality=(kind != "recent")), p)
    regs = cad.join(phones, "cod_cad").where("nmcont IS NOT NULL")
    out = regs.join(contracts.repartition(*CONTRACT), CONTRACT)
    slots = [f"Telefone{k}" for k in range(1, p.phone_slots + 1)]
    return out.select(*CONTACT_LIST_HEAD, *slots, *CONTACT_LIST_TAIL)


def r07_recent(t: Tables, p: ReportParams) -> DataFrame:
    """Registrations loaded in the last two months on their file date."""
    return _contact_list(t, p, "recent")


def r08_never_contacted(t: Tables, p: ReportParams) -> DataFrame:
    """Registrations with dialable phones and no classified human contact
    since midnight 30 days ago."""
    return _contact_list(t, p, "never")


def r09_broken_rejected(t: Tables, p: ReportParams) -> DataFrame:
    """Contracts whose latest agreement is broken or rejected."""
    return _contact_list(t, p, "broken")


def r10_collateral(t: Tables, p: ReportParams) -> DataFrame:
    """Distinct chassis count, brand-model list and plate list per active
    registration, most assets first.

    Every asset gives a chassis, a brand-model pair and a plate; a hash aggregate on (contract, kind, value)
    removes repeats and spreads a hot contract. Chassis are only counted. Pairs are listed by (brand, model), and a text that
    several pairs give stands at the first of them. The contracts' summaries meet the
    registrations last; registrations that share a contract each get its full summary, as in the reference.
    """
    assets = t.bens.where(P.in_portfolios("cod_cli", p.portfolios) & F.col("nmcont").isNotNull())
    pair = S.concat_text("marca", F.lit(PAIR_JOINER), "modelo")
    none = F.lit(None).cast("string")
    kinds = [("chassi", F.col("chassi"), none, none), ("MarcaModelo", pair, F.col("marca"), F.col("modelo")), ("Placas", F.col("placa"), none, none)]
    value = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("value"), a.alias("a"), b.alias("b")) for k, v, a, b in kinds]))
    distinct = assets.select(*CONTRACT, value.alias("v")).select(*CONTRACT, "v.*").where("kind = 'chassi' OR value IS NOT NULL")
    distinct = distinct.groupBy(*distinct.columns).agg(F.count(F.lit(1)).alias("n"))

    def only(kind: str) -> DataFrame:
        """Rows of a kind; the count keeps the filter above the aggregate, so that all kinds read one exchange of one scan."""
        return distinct.where((F.col("kind") == kind) | (F.col("n") < 0)).drop("n")

    counts = only("chassi").groupBy(*CONTRACT).agg(F.count("value").alias("QtdGarantiasUnicas"))
    first_pair = only("MarcaModelo").groupBy(*CONTRACT, "kind", "value").agg(F.min(F.struct("a", "b")).alias("place"))
    listed = only("Placas").unionByName(first_pair.select(*CONTRACT, "kind", "value", "place.*"))
    lists = ordered_lists(listed, [*CONTRACT, "kind"], ["a", "b", "value"], "value", "list")
    rows = counts.withColumns({"kind": F.lit("chassi"), "list": F.lit(None).cast("string")}).unionByName(lists.withColumn("QtdGarantiasUnicas", F.lit(None).cast("long")))
    per_contract = rows.groupBy(*CONTRACT).agg(
        F.max("QtdGarantiasUnicas").alias("QtdGarantiasUnicas"), *[F.max(F.when(F.col("kind") == k, F.col("list"))).alias(k) for k in ("MarcaModelo", "Placas")]
    )
    regs = B.registrations(t, p).select(*identity(), "cod_cli").distinct()
    return (
        regs.join(per_contract.repartition(*CONTRACT), CONTRACT)
        .select("cod_cad", "nome", "cpf", "nmcont", "cod_cli", "QtdGarantiasUnicas", "MarcaModelo", "Placas")
        .orderBy(F.col("QtdGarantiasUnicas").desc(), F.col("cod_cad").asc())
    )


def r11_largest_debts(t: Tables, p: ReportParams) -> DataFrame:
    """Total debt and distinct instalment count per active registration,
    optional minimum total, largest ``top`` first (ties by cod_cad).

    Instalments are summed per contract first; equal registration rows become one
    with their number, by which the total is multiplied, as the reference's
    join would. The join stands last, between two exchanges, so a contract shared
    by very many registrations is split at run time.
    """
    by_id = (
        t.receber.where(P.in_portfolios("cod_cli", p.portfolios) & F.col("nmcont").isNotNull())
        .groupBy(*CONTRACT, "fat_parc")
        .agg(F.sum("vlrparc").alias("vlr"))
    )
    per_contract = by_id.groupBy(*CONTRACT).agg(F.count("fat_parc").alias("QtdContratos"), F.sum("vlr").alias("total"))
    regs = B.registrations(t, p).select("cod_cad", "nomecli", "cpfcnpj", *CONTRACT)
    regs = regs.groupBy(*regs.columns).agg(F.count(F.lit(1)).alias("m"))
    out = regs.join(per_contract.repartition(*CONTRACT), CONTRACT).select(
        "cod_cad",
        "nomecli",
        "cpfcnpj",
        *CONTRACT,
        "QtdContratos",
        (F.col("total") * F.col("m")).cast("decimal(38,2)").alias("ValorTotalDivida"),
    )
    if p.min_total is not None:
        out = out.where(F.col("ValorTotalDivida") >= F.lit(p.min_total))
    return out.orderBy(F.col("ValorTotalDivida").desc(), F.col("cod_cad").asc()).limit(p.top)


@dataclass(frozen=True)
class Report:
    key: str
    label: str
    build: Callable[[Tables, ReportParams], DataFrame]
    default_name: str


REPORTS: dict[str, Report] = {
    r.key: r
    for r in [
        Report("r01_email", "E-mail list", r01_email, "email"),
        Report("r02_name_taxid", "Name and tax id", r02_name_taxid, "name_taxid"),
        Report("r03_phones_top7", "Phones, best contact", r03_phones_top7, "phones_best_contact"),
        Report("r04_agreements_open", "Open agreements P/A", r04_agreements_open, "agreements_open"),
        Report("r05_cpc_period", "Right-party contact in period", r05_cpc_period, "cpc_period"),
        Report("r06_no_history_30d", "No history in 30 days", r06_no_history_30d, "no_history_30d"),
        Report("r07_recent", "Recent intake", r07_recent, "recent"),
        Report("r08_never_contacted", "Never contacted", r08_never_contacted, "never_contacted"),
        Report("r09_broken_rejected", "Broken / rejected agreements", r09_broken_rejected, "broken_rejected"),
        Report("r10_collateral", "Collateral", r10_collateral, "collateral"),
        Report("r11_largest_debts", "Largest debts", r11_largest_debts, "largest_debts"),
    ]
}

