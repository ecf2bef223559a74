"""Fairness audits of binary classifiers as Spark DataFrame jobs."""

from evenhand.frame import AuditFrame

__all__ = ["AuditFrame"]
