"""The registry of queries over the driver's tables, each with DuckDB SQL where SQL can express it."""

from panelforge.plans import catalog, catalog_decisions, catalog_models  # noqa: F401  they register with the first
