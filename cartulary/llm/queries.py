"""All queries of this subpackage."""

from cartulary.llm import (  # noqa: F401
    q_bpe,
    q_chat,
    q_exact,
    q_fingerprints,
    q_html,
    q_lines,
    q_mixing,
    q_near,
    q_shards,
    q_toxicity,
    q_tries,
    q_urls,
    q_whitening,
)
from cartulary.llm.registry import QUERIES  # noqa: F401
