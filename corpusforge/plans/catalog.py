"""All queries outside the subpackage llm, by name, with their SQL."""

from __future__ import annotations

from corpusforge.plans import names, rejects, text, tokens

QUERIES = {**text.QUERIES, **tokens.QUERIES, **names.QUERIES, **rejects.QUERIES}
ORACLES = {**text.ORACLES, **tokens.ORACLES, **names.ORACLES, **rejects.ORACLES}
