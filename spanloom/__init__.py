"""spanloom: telemetry analytics for AI-assisted development, as Spark jobs."""

from .session import build_session, checkpoint_root, configure

__all__ = ["build_session", "checkpoint_root", "configure"]
