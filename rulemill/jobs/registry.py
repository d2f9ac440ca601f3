"""Queries of the library and their SQL, by name."""

from __future__ import annotations

from rulemill.jobs import audits, catalogue, chats, corpus, questions

QUERIES = {f.__name__: f for group in (corpus, catalogue, questions, chats, audits) for f in group.QUERIES}
ORACLES = {name: sql for group in (corpus, catalogue, questions, chats, audits) for name, sql in group.ORACLES.items()}
