"""Results of a job that are planned when they are asked for."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator, Mapping

from pyspark.sql import DataFrame


class Outputs(Mapping):
    """Name -> table. A table is planned once, at its first look-up; what only others need is not written for it."""

    def __init__(self, **plans: Callable[[], DataFrame]):
        self._plans = {name: functools.cache(plan) for name, plan in plans.items()}

    def __getitem__(self, name: str) -> DataFrame:
        return self._plans[name]()

    def __iter__(self) -> Iterator[str]:
        return iter(self._plans)

    def __len__(self) -> int:
        return len(self._plans)
