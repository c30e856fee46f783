"""marketpulse: group strength, attribution and intraday analytics on Spark.

Every operator takes and returns Spark DataFrames in the canonical schemas of
``marketpulse.schemas`` and stays lazy, apart from the sinks and
``marketpulse.staging.stage``.
"""

__all__ = ["schemas", "session", "staging"]
