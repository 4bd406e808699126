"""The corpus pipeline: its stages in order, and a run of all of them over `documents`."""

from urlatlas.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
