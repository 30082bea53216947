"""All queries of this folder; importing it registers them."""

import corpus_pipeline
from vigilog.llm import (  # noqa: F401
    audit,
    bpe,
    leaks,
    likelihood,
    lines,
    nearest,
    neardup,
    quality,
    ranked,
    spans,
    substrings,
    toxicity,
    wordbpe,
)
from vigilog.llm.common import QUERIES, SQL  # noqa: F401

QUERIES["pipeline"] = corpus_pipeline.run
if corpus_pipeline.ORACLE_SQL:
    SQL["pipeline"] = corpus_pipeline.ORACLE_SQL
