"""All registered queries and their checking SQL."""
from feedloom.plans import documents, polling, reading, streams, texts  # noqa: F401
from feedloom.plans.registry import ORACLES, QUERIES  # noqa: F401
