"""All registered queries with their SQL."""

from __future__ import annotations

from . import q_analyses, q_passk, q_relational, q_sources, q_stats, q_text  # noqa: F401
from .registry import ORACLE_SQL, QUERIES  # noqa: F401
