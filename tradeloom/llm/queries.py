"""The registered queries: each applies its operator to the whole intended table."""

from __future__ import annotations

from tradeloom.llm.common import ORACLES, QUERIES

# isort: off
from tradeloom.llm import query_chat  # noqa: F401
from tradeloom.llm import query_toxicity  # noqa: F401
from tradeloom.llm import query_urls  # noqa: F401
from tradeloom.llm import query_lines  # noqa: F401
from tradeloom.llm import query_quality  # noqa: F401
from tradeloom.llm import query_mixing  # noqa: F401
from tradeloom.llm import query_nearest  # noqa: F401
from tradeloom.llm import query_secrets  # noqa: F401
from tradeloom.llm import query_similar  # noqa: F401
from tradeloom.llm import query_benchmark  # noqa: F401
from tradeloom.llm import query_structure  # noqa: F401
from tradeloom.llm import query_whitening  # noqa: F401
from tradeloom.llm import query_language  # noqa: F401

__all__ = ["ORACLES", "QUERIES"]
