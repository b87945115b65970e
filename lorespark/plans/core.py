"""All queries outside the llm package."""

from lorespark.plans import cypher, graphs, hybrid, ingest, overview, pages, retrieval, snapshots  # noqa: F401
from lorespark.plans.registry import ORACLES, QUERIES  # noqa: F401

FLAGSHIP = "hybrid_search"
