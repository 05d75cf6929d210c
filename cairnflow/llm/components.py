"""Connected components of a table of links (u, v): see ``plans.iterate``.

Self-links and nulls are ignored; without links the result is empty.
"""

from ..plans.iterate import connected_components

__all__ = ["connected_components"]
