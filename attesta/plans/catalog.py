"""Importing this module registers every query."""

from attesta.plans import (  # noqa: F401
    q_canon, q_cards, q_corpus, q_fingerprints, q_governance, q_imports, q_patches, q_phrases, q_reference, q_text, q_versions, q_work)
from attesta.plans.registry import ORACLES, QUERIES  # noqa: F401
