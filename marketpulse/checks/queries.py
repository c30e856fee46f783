"""All registered queries, in the order of the survey's sections."""

from marketpulse.checks import q_ingest, q_scopes, q_metrics, q_groups, q_boards, q_jobs  # noqa: F401
from marketpulse.checks.registry import REGISTRY

__all__ = ["REGISTRY"]
