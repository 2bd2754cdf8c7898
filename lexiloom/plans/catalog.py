"""All registered queries."""

from __future__ import annotations

from . import quality, resolution, streams, study, texts, workflow

QUERIES = {**quality.QUERIES, **texts.QUERIES, **resolution.QUERIES, **workflow.QUERIES, **study.QUERIES, **streams.QUERIES}
