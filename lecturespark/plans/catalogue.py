"""All registered queries."""

from . import inputs, q_segments, q_align, q_slides, q_catalog, q_admission, q_messages, q_policy, q_streaming  # noqa: F401, I001
from .registry import ORACLES, QUERIES, load  # noqa: F401
