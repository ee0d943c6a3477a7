"""Whole jobs: dataset export, reports, table upkeep and the registered queries."""
