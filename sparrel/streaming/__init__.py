"""Plans over unbounded inputs.

The algebra has no streaming operator of its own. Scan, Filter and Project are stateless, so
``compile_plan`` accepts streaming frames registered in a Catalog; ``require_streamable``
rejects the plans that Structured Streaming cannot run without state.
"""

from sparrel.plans.algebra import Cross, Filter, Project, Query, Scan, Sort


def require_streamable(query: Query) -> None:
    """Raise ValueError when the plan holds an operator that needs all of its input."""
    node = query.root
    while not isinstance(node, Scan):
        if isinstance(node, (Cross, Sort)):
            raise ValueError(f"{type(node).__name__} needs a bounded input")
        assert isinstance(node, (Filter, Project))
        node = node.underlying
