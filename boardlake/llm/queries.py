"""All registered queries of this package."""

from boardlake.llm import (  # noqa: F401  (registers queries)
    edits, embedding_dedup, jaccard, mixing, packing, phrases, pieces, pii, quality, search, token_files, toxicity, url_filter,
)
from boardlake.llm.base import ORACLE, QUERIES  # noqa: F401
