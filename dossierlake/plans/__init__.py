"""Registered queries.  load() imports every plan module and gives the registry."""

from importlib import import_module
from types import ModuleType

MODULES = ("dashboards", "bus", "governance", "ingest", "documents", "audit", "streams", "outputs")


def load() -> ModuleType:
    for name in MODULES:
        import_module(f"{__name__}.{name}")
    return import_module(f"{__name__}.registry")
