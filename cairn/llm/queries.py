"""Registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from .decontam import op1_decontamination
from .exact_dedup import OP6_SQL, op6_exact_dedup
from .html_text import op2_html_text
from .langid import op3_language_id
from .line_dedup import OP8_SQL, op8_line_dedup
from .mixing import OP9_SQL, op9_mixing
from .secrets import op4_secrets
from .simhash import op10_simhash
from .token_counts import op7_token_counts
from .warc import OP5_SQL, op5_warc_fixity

QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_html_text": op2_html_text,
    "op3_language_id": op3_language_id,
    "op4_secrets": op4_secrets,
    "op5_warc_fixity": op5_warc_fixity,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_token_counts": op7_token_counts,
    "op8_line_dedup": op8_line_dedup,
    "op9_mixing": op9_mixing,
    "op10_simhash": op10_simhash,
}

SQL = {
    "op5_warc_fixity": OP5_SQL,
    "op6_exact_dedup": OP6_SQL,
    "op8_line_dedup": OP8_SQL,
    "op9_mixing": OP9_SQL,
}
