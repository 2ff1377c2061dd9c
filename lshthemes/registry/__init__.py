"""Every operator as a query on a folder of tables, and the SQL that must give the same rows."""

from lshthemes.registry.oracle import oracle_sql
from lshthemes.registry.queries import queries

__all__ = ["oracle_sql", "queries"]
