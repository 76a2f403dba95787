"""The queries of this subpackage by name, and their SQL where SQL can express them."""

from __future__ import annotations

from . import alignment, bpe, collocations, decontamination, exact_dedup, html_text, ppm, sharding, simhash, token_output, tool_calls, toxicity, warc

QUERIES = {
    "op1_decontamination": decontamination.op1_decontamination,
    "op2_token_output": token_output.op2_token_output,
    "op3_exact_dedup": exact_dedup.op3_exact_dedup,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_simhash": simhash.op5_simhash,
    "op6_tool_calls": tool_calls.op6_tool_calls,
    "tool_calls_derived": tool_calls.tool_calls_derived,
    "op7_html_text": html_text.op7_html_text,
    "op8_lm_scoring": ppm.op8_lm_scoring,
    "op9_sharding": sharding.op9_sharding,
    "op10_bpe": bpe.op10_bpe,
    "op11_collocations": collocations.op11_collocations,
    "op12_warc": warc.op12_warc,
    "op13_alignment": alignment.op13_alignment,
}

ORACLE_SQL = {
    "op1_decontamination": decontamination.ORACLE,
    "op3_exact_dedup": exact_dedup.ORACLE,
    "tool_calls_derived": tool_calls.DERIVED_ORACLE,
    "op11_collocations": collocations.ORACLE,
    "op12_warc": warc.ORACLE,
}
