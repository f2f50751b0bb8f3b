"""The engine's operators as runnable queries over the driver's tables."""


def load():
    """(queries, SQL) with every module registered."""
    from registry import describe, models, prep, survival, wide  # noqa: F401
    from registry.core import QUERIES, SQL

    return QUERIES, SQL
