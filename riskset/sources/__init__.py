from riskset.sources.tables import read_cohort, read_table, write_table  # noqa: F401
