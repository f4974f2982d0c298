"""All registered queries of the library, by importing the modules that register them."""

from .operators import candidates, cost, drift, models, profile, querylog, report, select  # noqa: F401
from .plans import planlog  # noqa: F401
from .registry import QUERIES, SQL
from .sources import files  # noqa: F401
from .sources.twins import with_frames
from .streaming import rounds  # noqa: F401

__all__ = ["QUERIES", "oracle"]


def oracle() -> dict[str, str]:
    return {name: with_frames(sql) for name, sql in SQL.items()}
