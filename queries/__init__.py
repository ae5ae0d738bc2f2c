"""Named queries over the given tables, each with its SQL counterpart where SQL can express it."""

from queries.base import REGISTRY
from queries import (  # noqa: F401  (importing registers the queries)
    articles,
    composite,
    evaluation,
    feeds,
    serving,
    series,
    streams,
    tables,
    text,
)

__all__ = ["REGISTRY"]
