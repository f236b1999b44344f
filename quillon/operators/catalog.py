"""All registered queries: name -> (spark, sf_dir) -> DataFrame, and the SQL that checks each."""

from . import relational, scalar, special

QUERIES: dict = relational.QUERIES | scalar.QUERIES | special.QUERIES
ORACLES: dict = relational.ORACLES | scalar.ORACLES | special.ORACLES
