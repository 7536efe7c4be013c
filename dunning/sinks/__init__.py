"""Report sinks and output profiling."""

from dunning.sinks.files import display_widths, money_formatted, write_report

__all__ = ["display_widths", "money_formatted", "write_report"]
