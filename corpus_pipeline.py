"""The corpus pipeline of the training-data operators, for callers that look for it here."""

from __future__ import annotations

from basalt.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
