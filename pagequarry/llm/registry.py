"""The queries of this subpackage by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pagequarry.llm import op1_quality, op2_ogg, op3_dac, op4_urlfilter, op5_lines, op6_jaccard, op7_lattice, op8_packing, op9_toxicity, op10_decontaminate

QUERIES: dict[str, Callable] = {
    "op1_quality_classifier": op1_quality.query,
    "op2_ogg_media": op2_ogg.query,
    "op3_token_dac": op3_dac.query,
    "op4_url_filter": op4_urlfilter.query,
    "op5_line_dedup": op5_lines.query,
    "op6_jaccard_join": op6_jaccard.query,
    "op7_lattice_lm": op7_lattice.query,
    "op8_curve_packing": op8_packing.query,
    "op9_toxicity": op9_toxicity.query,
    "op10_decontamination": op10_decontaminate.query,
}
ORACLE_SQL: dict[str, str] = {
    "op2_ogg_media": op2_ogg.SQL,
    "op4_url_filter": op4_urlfilter.SQL,
    "op5_line_dedup": op5_lines.SQL,
    "op6_jaccard_join": op6_jaccard.SQL,
}
