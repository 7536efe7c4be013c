"""Several contact lists in one run: what they say of contracts is worked out once.

R07, R08 and R09 each need the complements, assets and instalment lists of the contracts they
list. Run together, these are made for every contract that any of them can list, written to a shared folder
(which also cuts the lineage) and read by each report.
"""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Collection
from dataclasses import replace

from dunning.params import ReportParams
from dunning.plans import blocks as B
from dunning.sources.tables import Tables

CONTACT_LISTS = frozenset(("r07_recent", "r08_never_contacted", "r09_broken_rejected"))


def with_shared_facts(t: Tables, p: ReportParams, reports: Collection[str], folder: str) -> Tables:
    """``t`` with the contract facts stored under ``folder``, if at least two of the reports read them.

    Broken agreements are not settled ones, so the contracts that are not settled cover all three reports.
    """
    if len(CONTACT_LISTS.intersection(reports)) < 2:
        return t
    contracts = B.listable_contracts(t, p, B.registrations(t, p)).select(*B.CONTRACT)
    at = posixpath.join(folder, f"contract-facts-{uuid.uuid4().hex}")
    B.with_contract_facts(contracts, t, p, with_total=True).write.parquet(at)
    return replace(t, contract_facts=t.cadastros.sparkSession.read.parquet(at))
