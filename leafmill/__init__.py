"""Leafmill: document dataflow and analytics on PySpark."""

from leafmill.session import get_session

__all__ = ["get_session"]
