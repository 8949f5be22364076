"""Argument checks that run on the driver before a plan is built."""

from dockside.schema import DIMENSIONS, MARKETS


def validate_dimension(name: str) -> str:
    if name not in DIMENSIONS:
        raise ValueError(f"cannot group by {name!r}; known dimensions: {sorted(DIMENSIONS)}")
    return name


def validate_market(name: str | None, allowed=MARKETS) -> str | None:
    """None or an empty name means all markets."""
    if not name:
        return None
    if name not in allowed:
        raise ValueError(f"unknown market {name!r}; known markets: {sorted(allowed)}")
    return name


def clamp_limit(n, default=10, top=20) -> int:
    """Rows in a ranked report: ``default`` when unset or 0, at most ``top``."""
    n = int(n or default)
    if n < 0:
        raise ValueError("limit must not be negative")
    return min(n, top)


def at_least_one(k) -> int:
    k = int(k)
    if k < 1:
        raise ValueError("k must be at least 1")
    return k


def clamp_k(k=4, top=10) -> int:
    """Hits per query of a search tool: at most ``top``, at least one."""
    return min(at_least_one(k), top)
