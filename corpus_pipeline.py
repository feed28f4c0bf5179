"""From raw documents to token ids: the stages of stratalens.llm.pipeline."""

from stratalens.llm.pipeline import COLUMNS, ORACLE_SQL, STAGES, run

__all__ = ["COLUMNS", "ORACLE_SQL", "STAGES", "run"]
