"""Physical-plan building blocks shared by the operators.

Every operator that needs an order inside a key goes through
:func:`ordered_scan`; every lookup goes through :func:`lookup_join`.  Both stay
balanced when one key holds a large share of the rows.
"""

from quire.plans.joins import lookup_join, rule_table
from quire.plans.lineage import cut, cut_laid
from quire.plans.quantile import grouped_median
from quire.plans.scan import (
    COUNT,
    hot_keys,
    lag1,
    last_seen,
    last_seen_before,
    lead1,
    next_seen_after,
    ordered_scan,
    rank_in,
    running_min,
    running_sum,
)

__all__ = [
    "COUNT", "cut", "cut_laid", "grouped_median", "hot_keys", "lag1", "last_seen", "last_seen_before",
    "lead1", "lookup_join", "next_seen_after", "ordered_scan", "rank_in", "rule_table",
    "running_min", "running_sum",
]
