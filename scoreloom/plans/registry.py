"""All registered audit queries and their SQL twins."""

from scoreloom.plans import audits, catalogue, fits, panels

assert audits.query is fits.query is panels.query is catalogue.query  # importing the modules adds their queries
QUERIES, ORACLE_SQL = catalogue.QUERIES, catalogue.ORACLE_SQL
