"""Sources and sinks of the catalog."""

from .catalog import catalog_from_tables, load_table, read_catalog, read_silver, write_catalog
from .schema import CATALOG_SCHEMA, EXPECTED_COLUMNS, check_columns, schema_json, schema_report, schema_rows

__all__ = [
    "CATALOG_SCHEMA",
    "EXPECTED_COLUMNS",
    "catalog_from_tables",
    "check_columns",
    "load_table",
    "read_catalog",
    "read_silver",
    "schema_json",
    "schema_report",
    "schema_rows",
    "write_catalog",
]
