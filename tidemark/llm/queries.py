"""Queries of the corpus operators by name, and DuckDB SQL where SQL can express them."""

from __future__ import annotations

from tidemark.llm.decontaminate import op7_decontaminate
from tidemark.llm.html_text import op2_html_text
from tidemark.llm.jaccard_join import ORACLE as JACCARD_SQL
from tidemark.llm.jaccard_join import op9_jaccard_join
from tidemark.llm.mixture import ORACLE as MIXTURE_SQL
from tidemark.llm.mixture import op4_mixture
from tidemark.llm.pii import op5_pii
from tidemark.llm.quality_rules import ORACLE as QUALITY_SQL
from tidemark.llm.quality_rules import op8_quality_rules
from tidemark.llm.shards import op6_shards
from tidemark.llm.substring_dedup import ORACLE as SUBSTRING_SQL
from tidemark.llm.substring_dedup import op3_substring_dedup
from tidemark.llm.token_count import op1_token_count
from tidemark.llm.warc import ORACLE as WARC_SQL
from tidemark.llm.warc import op10_warc

QUERIES = {
    "op1_token_count": op1_token_count,
    "op2_html_text": op2_html_text,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_mixture": op4_mixture,
    "op5_pii": op5_pii,
    "op6_shards": op6_shards,
    "op7_decontaminate": op7_decontaminate,
    "op8_quality_rules": op8_quality_rules,
    "op9_jaccard_join": op9_jaccard_join,
    "op10_warc": op10_warc,
}
ORACLE: dict[str, str] = {"op3_substring_dedup": SUBSTRING_SQL, "op4_mixture": MIXTURE_SQL, "op8_quality_rules": QUALITY_SQL, "op9_jaccard_join": JACCARD_SQL, "op10_warc": WARC_SQL}
