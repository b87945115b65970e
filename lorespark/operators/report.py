"""A Markdown report of a graph from small results of its analytics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorespark.operators import graphs


def graph_report(nodes: DataFrame, edges: DataFrame, membership: DataFrame, limit: int = 10) -> str:
    """Six sections; only bounded top lists reach the driver. A section without rows says so."""
    gods = graphs.god_nodes(nodes, edges, limit)
    groups = graphs.community_summary(nodes, membership).orderBy(F.desc("members"), "community_id").limit(limit)
    share = graphs.coverage(nodes, edges).first()
    sections = {
        "Most connected": [f"- {r.name} ({r.path}): {r.degree}" for r in gods.orderBy(F.desc("degree"), "id").collect()],
        "Communities": [f"- {r.community_id}: {r.members} nodes ({', '.join(r.top_terms or ())})" for r in groups.collect()],
        "Surprising connections": [f"- {r.id}: {r.from_plane} to {r.to_plane} ({r.confidence})" for r in graphs.surprising(nodes, edges, limit).collect()],
        "Coverage": [f"{share.described} of {share.total} code nodes are described ({share.ratio:.1%})."] if share.total else [],
        "Ambiguous edges": [f"- {r.id}" for r in edges.where("confidence = 'ambiguous'").select("id").orderBy("id").limit(5 * limit).collect()],
        "Questions": [f"- {r.question}" for r in graphs.questions(gods, groups).collect()],
    }
    return "# Graph report\n" + "".join(f"\n## {title}\n\n" + ("\n".join(lines) if lines else "Nothing found.") + "\n" for title, lines in sections.items())
