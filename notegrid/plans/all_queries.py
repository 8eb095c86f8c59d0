"""Every query of the core."""

from notegrid.plans import orphan_queries, wiki_queries  # noqa: F401
from notegrid.plans.registry import QUERIES, SQL  # noqa: F401

FLAGSHIP = "most_linked"
