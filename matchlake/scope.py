"""Row scope shared by every query: who and what is counted, as Column predicates for the scan."""
from __future__ import annotations

from dataclasses import dataclass, replace
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, functions as F

from .functions.classify import event_family


def range_bounds(value: str | None, today: date) -> tuple[date, date] | None:
    """Closed day interval for all/today/yesterday/week/month or one ISO day; anything else is an error."""
    if not value or value == "all":
        return None
    if value == "today":
        return today, today
    if value == "yesterday":
        return today - timedelta(days=1), today - timedelta(days=1)
    if value == "week":
        return today - timedelta(days=today.isoweekday() - 1), today
    if value == "month":
        return date(today.year, today.month, 1), today
    day = date.fromisoformat(value)
    return day, day


def range_filter(value: str | None, today: date) -> Column:
    bounds = range_bounds(value, today)
    if bounds is None:
        return F.lit(True)
    return F.col("play_day").between(F.lit(bounds[0]), F.lit(bounds[1]))


@dataclass(frozen=True)
class Scope:
    event: str | None = None
    family: str | None = None
    deck: str | None = None
    deck_id: str | None = None
    mode: str | None = None
    range: str = "all"
    today: date | None = None
    exclude_abnormal: bool = True
    exclude_bot: bool = True

    def selection(self) -> Column:
        """Everything but the two exclusion flags. Event beats family; deck and deck id intersect."""
        cond = F.lit(True)
        if self.event:
            cond = cond & (F.col("event_key") == self.event)
        elif self.family:
            cond = cond & F.col("event_key").isNotNull() & (event_family("event_key") == self.family)
        if self.deck:
            cond = cond & (F.col("my_deck_tag") == self.deck)
        if self.deck_id:
            cond = cond & (F.col("my_deck_id") == self.deck_id)
        if self.mode:
            cond = cond & (F.col("match_mode") == self.mode)
        if self.range and self.range != "all":
            if self.today is None:
                raise ValueError("a range needs an explicit today")
            cond = cond & range_filter(self.range, self.today)
        return cond

    def visible(self) -> Column:
        cond = F.lit(True)
        if self.exclude_abnormal:
            cond = cond & (F.col("is_abnormal") == 0)
        if self.exclude_bot:
            cond = cond & (F.col("is_bot") == 0)
        return cond

    def hidden(self) -> Column:
        """Rows only the flags remove (none when nothing is excluded)."""
        if not (self.exclude_abnormal or self.exclude_bot):
            return F.lit(False)
        return (F.col("is_abnormal") == 1) | (F.col("is_bot") == 1)

    def apply(self, matches: DataFrame) -> DataFrame:
        return matches.filter(self.selection() & self.visible())

    def decided(self, matches: DataFrame) -> DataFrame:
        return self.apply(matches).filter(F.col("my_result").isNotNull())

    def upstream(self) -> "Scope":
        """The same scope without deck choice (option lists must not narrow themselves)."""
        return replace(self, deck=None, deck_id=None)
