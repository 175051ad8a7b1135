"""The two policies every answer passes: a minimum group size and a budget a column."""

from __future__ import annotations

from collections.abc import Iterable

DEFAULT_K, LEAST_K, QUERIES_PER_COLUMN = 5, 3, 12


def check_k(k: object) -> str | None:
    """Why ``k`` can't be a minimum group size, or None."""
    if not isinstance(k, int) or isinstance(k, bool):
        return "the minimum group size is a whole number"
    return f"the minimum group size is at least {LEAST_K}" if k < LEAST_K else None


def withheld(k: int) -> str:
    return f"1 to {k - 1} rows match, fewer than the minimum group of {k}; the number is withheld"


class Budget:
    """Questions asked of each column. A charge covers all its columns or none."""

    def __init__(self, limit: int = QUERIES_PER_COLUMN):
        self.limit, self.used = max(1, int(limit)), {}

    def left(self, columns: Iterable[str]) -> int:
        return min((max(0, self.limit - self.used.get(c, 0)) for c in columns), default=self.limit)

    def spent(self, columns: Iterable[str]) -> list[str]:
        return [c for c in dict.fromkeys(columns) if self.used.get(c, 0) >= self.limit]

    def charge(self, columns: Iterable[str]) -> list[str]:
        """Take one question from each column; the columns without any left, if some have none."""
        own = list(dict.fromkeys(columns))
        if not (spent := self.spent(own)):
            for c in own:
                self.used[c] = self.used.get(c, 0) + 1
        return spent

    def exhausted(self) -> list[str]:
        return [c for c, n in self.used.items() if n >= self.limit]
