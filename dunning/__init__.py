"""Receivables and debtor-contact reporting on Spark.

Eight flat tables (registrations, phones, agreements, contact history,
occurrence codes, instalments, contract complements, collateral assets)
feed eleven parameterised reports. Every report is a lazy DataFrame built
from small blocks; nothing is collected on the driver.
"""

from dunning.params import ReportParams
from dunning.sources.tables import Tables

__all__ = ["ReportParams", "Tables"]
