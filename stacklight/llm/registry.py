"""The subpackage's queries, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from stacklight.llm import ann, bpe, licences, line_dedup, oph, packing, quality, simhash, span_dedup, suffix_dedup

QUERIES = {
    "op1_simhash": simhash.op1_simhash,
    "op2_ann": ann.op2_ann,
    "op3_fingerprints": oph.op3_fingerprints,
    "op4_line_dedup": line_dedup.op4_line_dedup,
    "op5_quality": quality.op5_quality,
    "op6_licences": licences.op6_licences,
    "op7_bpe": bpe.op7_bpe,
    "op8_packing": packing.op8_packing,
    "op9_span_dedup": span_dedup.op9_span_dedup,
    "op10_suffix_dedup": suffix_dedup.op10_suffix_dedup,
}
ORACLES = {"op4_line_dedup": line_dedup.ORACLE}
