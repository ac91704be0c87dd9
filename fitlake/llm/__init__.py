"""Operators for training-data corpora (see README).  Nothing outside this
package imports it; `__spark_entry__.py` adds its queries if it is there."""

from fitlake.llm import (best_fit, decontaminate, html_text, lexical_search, licenses, line_dedup, lm_scoring,
                         ngram_join, packing, pii, quality, secrets, variants)  # noqa: F401
from fitlake.llm.base import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
