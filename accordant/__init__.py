"""A Spark-native data reconciliation engine: what differs between two tables, and why."""

from importlib import import_module

_HOMES = {
    "ColumnOptions": "functions.compare", "DuplicateStrategy": "types", "Evidence": "types", "MismatchType": "types", "ReconConfig": "plans.config", "Reconciliation": "plans.reconcile",
    "ReconciliationResult": "plans.result", "RecordMismatch": "plans.result", "Severity": "types", "Status": "types", "load_config": "plans.config", "reconcile": "plans.reconcile",
}
__all__ = sorted(_HOMES)


def __getattr__(name: str):
    # looked up when first used: Python workers import this package for their functions only
    if name in _HOMES:
        return getattr(import_module(f"accordant.{_HOMES[name]}"), name)
    raise AttributeError(name)
