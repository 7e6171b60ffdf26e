"""Every query of the engine's own operators, once their modules are read."""

from . import engine_queries, rate_queries, report_queries, source_queries, text_queries  # noqa: F401
from .registry import ORACLE, QUERIES  # noqa: F401
