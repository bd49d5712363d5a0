"""Views, registered queries and their SQL."""


def load_catalog():
    """The catalogue with all queries registered."""
    from batchloom.plans import (  # noqa: F401
        catalog, columns, flows, listings, operations, processing, reports, transfers,
    )

    return catalog
