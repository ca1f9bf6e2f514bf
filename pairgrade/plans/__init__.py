"""Registered queries, bound to the test tables."""


def load_all() -> None:
    """Import every module that registers queries."""
    import importlib
    import pkgutil

    for m in pkgutil.iter_modules(__path__):
        if m.name.startswith("q_"):
            importlib.import_module(f"{__name__}.{m.name}")
