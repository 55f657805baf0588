"""Column functions shared by the operators, all JVM-side built-ins."""

from liftlens.functions.columns import (
    band,
    count_label,
    ctr_percent,
    ctr_percent_safe,
    in_window,
    percent_label,
    user_id,
)
from liftlens.functions.labels import number_text, two_digits
from liftlens.functions.stats import (
    erfc,
    pearson,
    two_sided_p_value,
    two_proportion_z,
    verdict,
)

__all__ = [
    "band",
    "count_label",
    "ctr_percent",
    "ctr_percent_safe",
    "in_window",
    "number_text",
    "percent_label",
    "two_digits",
    "user_id",
    "erfc",
    "pearson",
    "two_sided_p_value",
    "two_proportion_z",
    "verdict",
]
