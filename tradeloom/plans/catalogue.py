"""All registered queries. The order of imports is the order of the SQL building blocks."""

# isort: off
from tradeloom.plans import blocks  # noqa: F401
from tradeloom.plans import analysis  # noqa: F401
from tradeloom.plans import views  # noqa: F401
from tradeloom.plans import cross  # noqa: F401
from tradeloom.plans import access  # noqa: F401
from tradeloom.plans import streams  # noqa: F401
from tradeloom.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
