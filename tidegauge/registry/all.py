"""Import of every registry module, in reading order."""

from tidegauge.registry import cleaning, models, schemas, scoring, studies  # noqa: F401
from tidegauge.registry.base import QUERIES, SQL  # noqa: F401
