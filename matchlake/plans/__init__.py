"""Named queries over the test tables: one module per topic, all registered in ``catalog``."""
from importlib import import_module

MODULES = ("overview", "decks", "sequences", "compare", "identity", "facts", "merge", "logs", "imports", "streaming")


def load_all():
    for name in MODULES:
        import_module(f"{__name__}.{name}")
    from .catalog import ORACLES, QUERIES
    return QUERIES, ORACLES
