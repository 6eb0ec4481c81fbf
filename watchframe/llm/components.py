"""Connected components, as the whole library uses them."""

from ..helpers.components import connected_components

__all__ = ["connected_components"]
