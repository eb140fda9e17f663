"""Connected components by alternating large-star and small-star joins, as the core has them."""

from loomstone.operators.components import connected_components

__all__ = ["connected_components"]
