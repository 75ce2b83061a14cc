"""Sports analytics as Spark tables: shots, results, goals added, salaries, golf cards."""

from courtside.session import session

__all__ = ["session"]
