"""All registered queries and their SQL."""

from . import data_queries, metric_queries, prompt_queries, result_queries  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
