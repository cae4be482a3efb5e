"""All registered queries: importing the modules registers them."""

from . import editorial_queries, helper_queries, set_queries, star_queries, story_queries, text_queries  # noqa: F401
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
