"""Inputs: domain-table bindings over the driver data, and readers."""

from binsight.sources.bindings import Tables, bind_driver_tables, binding_sql  # noqa: F401
from binsight.sources.readers import from_catalog, from_jdbc, from_parquet  # noqa: F401
