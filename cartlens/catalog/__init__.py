"""Every query the engine registers, with its SQL twin where one exists."""

from importlib import import_module

MODULES = ["quality", "features", "overview", "clusters", "baskets", "business", "exchange", "analyses"]


def load_catalog():
    from cartlens.catalog import registry

    for name in MODULES:
        import_module(f"cartlens.catalog.{name}")
    return registry.QUERIES, registry.SQL
