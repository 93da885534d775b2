"""All registered document queries."""

from twinloom.llm import (  # noqa: F401
    decontamination,
    exact_dedup,
    importance,
    language_id,
    language_model,
    license_scan,
    ngram_join,
    packing,
    periodic,
    quality,
    sharding,
    suffix_dedup,
    url_filter,
)
from twinloom.llm.registry import QUERIES, SQL  # noqa: F401
