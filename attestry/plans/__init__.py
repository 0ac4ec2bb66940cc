"""Registered queries over the given tables; importing the package registers them all."""

from attestry.plans import access, compliance, corpus, metrics, retrieval, sources, text

__all__ = ["access", "compliance", "corpus", "metrics", "retrieval", "sources", "text"]
