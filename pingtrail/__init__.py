"""Wildlife radio-telemetry analytics as lazy PySpark DataFrame transformations."""

from pingtrail.session import build_session, checkpointed

__all__ = ["build_session", "checkpointed"]
