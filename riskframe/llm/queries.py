"""Registered queries of this subpackage and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from riskframe.llm.licenses import op3_licenses
from riskframe.llm.lines import OP11_SQL, op11_lines
from riskframe.llm.lm import op6_lm_scores
from riskframe.llm.mixing import op5_mixing
from riskframe.llm.neighbours import OP1_SQL, op1_neighbours
from riskframe.llm.pieces import op2_pieces
from riskframe.llm.runs import op12_runs
from riskframe.llm.sharding import op8_sharding
from riskframe.llm.simhash import op7_simhash
from riskframe.llm.sketches import op9_sketches
from riskframe.llm.spelling import op13_spelling
from riskframe.llm.toxicity import op10_toxicity
from riskframe.llm.warc import OP4_SQL, op4_revisits

QUERIES = {
    "op1_neighbours": op1_neighbours,
    "op2_pieces": op2_pieces,
    "op3_licenses": op3_licenses,
    "op4_revisits": op4_revisits,
    "op5_mixing": op5_mixing,
    "op6_lm_scores": op6_lm_scores,
    "op7_simhash": op7_simhash,
    "op8_sharding": op8_sharding,
    "op9_sketches": op9_sketches,
    "op10_toxicity": op10_toxicity,
    "op11_lines": op11_lines,
    "op12_runs": op12_runs,
    "op13_spelling": op13_spelling,
}

ORACLE: dict[str, str] = {
    "op1_neighbours": OP1_SQL,
    "op4_revisits": OP4_SQL,
    "op11_lines": OP11_SQL,
}
