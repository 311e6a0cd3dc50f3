"""Dead-key budgets and exit codes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from keyfathom.config import ConfigError, Output


@dataclass(frozen=True)
class Budget:
    """At most ``count`` dead keys, or at most the share ``ratio`` of all; exactly one is set."""

    count: int | None = 0
    ratio: float | None = None

    @property
    def is_set(self) -> bool:
        return self.ratio is not None or self.count != 0

    def exceeded(self, dead: int, total: int) -> bool:
        if self.ratio is None:
            return dead > (self.count or 0)
        return total > 0 and dead / total > self.ratio


def resolve(cli_count: int | None, cli_ratio: float | None, output: Output) -> Budget:
    """Any command-line value replaces the configured pair as a whole; both forms at once are an error."""
    count, ratio = (cli_count, cli_ratio) if cli_count is not None or cli_ratio is not None else (output.max_dead, output.max_dead_ratio)
    if count is not None and ratio is not None:
        raise ConfigError("max_dead and max_dead_ratio exclude each other")
    if ratio is not None:
        if not 0 <= ratio <= 1:
            raise ConfigError("max_dead_ratio must lie between 0 and 1")
        return Budget(None, ratio)
    return Budget(count or 0)


def exit_code(dead: int, total: int, blind: int, fail_on: str, budget: Budget) -> int:
    if fail_on == "never":
        return 0
    return int(budget.exceeded(dead, total) or fail_on == "dead-or-blind" and blind > 0)


def exceeded_column(budget: Budget, dead: Column, total: Column) -> Column:
    """``Budget.exceeded`` over columns of a summary."""
    if budget.ratio is None:
        return dead > (budget.count or 0)
    return (total > 0) & (dead / F.nullif(total, F.lit(0)) > budget.ratio)


def exit_code_column(budget: Budget, dead: Column, total: Column, blind: Column, fail_on: Column) -> Column:
    """``exit_code`` over columns of a summary."""
    over = exceeded_column(budget, dead, total) | (fail_on == "dead-or-blind") & (blind > 0)
    return F.when((fail_on != "never") & over, 1).otherwise(0)
