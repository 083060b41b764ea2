"""The corpus pipeline, as ``flowgrain.llm`` defines it: stages over the documents, and their run."""

from flowgrain.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
