"""A corpus pipeline: documents in, packed sequences out. Its stages are in ``barquet.llm.pipeline``."""

from barquet.llm.pipeline import BITS, ORACLE_SQL, RADIUS, SHINGLE, SIMILARITY, STAGES, run

__all__ = ["BITS", "ORACLE_SQL", "RADIUS", "SHINGLE", "SIMILARITY", "STAGES", "run"]
