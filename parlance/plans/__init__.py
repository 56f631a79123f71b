"""All registered queries; importing the modules registers them."""

import importlib

MODULES = ["sources", "scalars", "filters", "joins", "sequences", "rates", "catalogue", "metrics",
           "texts", "vectors", "sampling", "models"]


def load():
    from parlance.plans import registry
    for m in MODULES:
        try:
            importlib.import_module(f"parlance.plans.{m}")
        except ModuleNotFoundError as e:
            if e.name != f"parlance.plans.{m}":
                raise
    return registry
