"""Before/after periods of a natural experiment."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class PeriodSpec:
    """Dates up to ``pre_end`` are 'pre', dates from ``onset_start`` are 'onset'.

    The days between belong to neither; ``excluded`` days (known logging gaps)
    are left out everywhere.  ``pre_start``, if set, shortens the pre period.
    """

    # The published study's dates and labels.
    pre_end: date = date(2020, 3, 12)
    onset_start: date = date(2020, 3, 16)
    excluded: tuple[date, ...] = field(default=(date(2020, 2, 27),))
    pre_start: date | None = None
    pre_label: str = "Pre-COVID"
    transition_label: str = "Transition"
    onset_label: str = "COVID onset"

    def kept(self, day: Column) -> Column:
        """Rows not on an excluded day."""
        return ~day.isin(list(self.excluded)) if self.excluded else F.lit(True)

    def label(self, day: Column, with_transition: bool = False) -> Column:
        is_pre = day <= F.lit(self.pre_end)
        if self.pre_start is not None:
            is_pre = is_pre & (day >= F.lit(self.pre_start))
        out = F.when(is_pre, self.pre_label).when(day >= F.lit(self.onset_start), self.onset_label)
        if with_transition:
            between = (day > F.lit(self.pre_end)) & (day < F.lit(self.onset_start))
            out = out.when(between, self.transition_label)
        return out

    def with_labels(self, pre: str, onset: str) -> "PeriodSpec":
        return replace(self, pre_label=pre, onset_label=onset)


# The category comparison starts its pre period after a relabeling of products.
CATEGORY_PERIODS = PeriodSpec(
    pre_start=date(2020, 1, 1),
    pre_label="Pre-COVID (Jan–Mar 12)",
    onset_label="COVID onset (Mar 16–Apr 30)",
)

# Lengths in days of the two published periods.
PRE_DAYS = 163
ONSET_DAYS = 46
