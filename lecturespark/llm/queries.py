"""All registered queries of this subpackage."""

from . import decontaminate, embedding_dedup, filter_audit, hard_negatives, language, language_model, line_dedup, mixing, near_dedup, secrets, suffix_dedup, tokens, url_filter  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
