"""The queries of this subpackage and their SQL, as ``__spark_entry__`` registers them."""

from __future__ import annotations

from . import bpe, decontamination, fingerprints, jaccard, lm_scoring, secrets, sharding, substrings, toxicity, warc

_MODULES = (lm_scoring, fingerprints, substrings, jaccard, toxicity, decontamination, bpe, warc, sharding, secrets)

QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
ORACLES = {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
