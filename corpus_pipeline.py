"""The corpus pipeline: ``STAGES``, ``run`` and ``ORACLE_SQL``; see ``routelab.llm.pipeline``."""

from routelab.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["STAGES", "run", "ORACLE_SQL"]
