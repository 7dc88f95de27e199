"""All registered queries, by module."""

from importlib import import_module

MODULES = [
    "structure_queries",
    "journal_queries",
    "outcome_queries",
    "signal_queries",
    "join_queries",
    "label_queries",
    "market_queries",
    "portfolio_queries",
    "validation_queries",
    "model_queries",
    "source_queries",
    "stream_queries",
]


def load():
    """(queries, sql) of every catalog module."""
    from tapeline.catalog import registry

    for module in MODULES:
        import_module(f"tapeline.catalog.{module}")
    return registry.QUERIES, registry.SQL
