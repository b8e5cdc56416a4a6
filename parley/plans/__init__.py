"""Query plans over the driver's tables: derived views, the query catalogue and its oracles."""


def load_all() -> None:
    """Import every module that registers queries."""
    from parley.plans import documents, extraction, roundtrips, scalar, tables  # noqa: F401
