"""Named queries over the test tables, with their SQL twins."""

from importlib import import_module

MODULES = ("profiling", "rules", "cleaning", "findings", "files", "series", "nearby", "learning")


def load_all() -> None:
    """Import every query module once; importing registers its queries."""
    for name in MODULES:
        import_module(f"{__name__}.{name}")
