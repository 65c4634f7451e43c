"""All named queries of the core, gathered from the modules beside this one."""

from __future__ import annotations

from . import attribution, corpus, linkage, openset, relational, rewrites, sessions, streams  # noqa: F401  (they register their queries)
from .registry import ORACLES, QUERIES  # noqa: F401

FLAGSHIP = "nn_top1"
