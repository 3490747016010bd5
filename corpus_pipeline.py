"""The corpus pipeline over documents: STAGES, run(spark, sf_dir) and ORACLE_SQL. The stages stand with their operators."""

from granary.llm.pipeline import ORACLE_SQL, STAGES, run  # noqa: F401
