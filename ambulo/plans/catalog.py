"""All queries of the library, by name, with the SQL that gives the same rows."""

from . import analysis, kernels, preparing, reports, sleep, subjects, summary, variants

QUERIES: dict = {**subjects.QUERIES, **preparing.QUERIES, **sleep.QUERIES, **summary.QUERIES, **reports.QUERIES, **analysis.QUERIES, **kernels.QUERIES, **variants.QUERIES}
ORACLE_SQL: dict = {**subjects.ORACLE_SQL, **preparing.ORACLE_SQL, **sleep.ORACLE_SQL, **summary.ORACLE_SQL, **reports.ORACLE_SQL, **analysis.ORACLE_SQL, **kernels.ORACLE_SQL, **variants.ORACLE_SQL}
