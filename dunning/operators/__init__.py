"""Reusable DataFrame operators the reports are composed from."""

from dunning.operators.antijoin import not_in
from dunning.operators.keyset import may_be_among
from dunning.operators.lists import ordered_lists
from dunning.operators.ranking import latest_per_key, pivot_slots, top_n_per_key

__all__ = [
    "latest_per_key",
    "may_be_among",
    "not_in",
    "ordered_lists",
    "pivot_slots",
    "top_n_per_key",
]
