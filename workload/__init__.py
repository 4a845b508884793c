"""Check queries: views over the given tables, each operator run on them, and the SQL to compare with."""

from workload import formats, intake, inventory, jobs, ledger, parts, reconcile, reports, storage, streams  # noqa: F401
from workload.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
