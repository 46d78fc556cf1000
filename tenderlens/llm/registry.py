"""Queries of this package and their SQL: ``name -> f(spark, sf_dir) -> DataFrame``."""

from __future__ import annotations

from tenderlens.llm.context_tree import op13_context_tree
from tenderlens.llm.itq import op3_itq
from tenderlens.llm.language_mix import op10_language_mix
from tenderlens.llm.line_dedup import OP5_SQL, op5_line_dedup
from tenderlens.llm.merkle import OP12_SQL, op12_merkle
from tenderlens.llm.packing import op1_packing
from tenderlens.llm.rank_bpe import op9_bpe
from tenderlens.llm.rotated_codes import op2_rotated_codes
from tenderlens.llm.secret_scan import op6_secret_scan
from tenderlens.llm.sharding import op4_sharding
from tenderlens.llm.token_files import op7_token_files
from tenderlens.llm.weighted_minhash import op8_weighted_minhash
from tenderlens.llm.whitening import op11_whitening

QUERIES = {f.__name__: f for f in (
    op1_packing, op2_rotated_codes, op3_itq, op4_sharding, op5_line_dedup, op6_secret_scan, op7_token_files, op8_weighted_minhash,
    op9_bpe, op10_language_mix, op11_whitening, op12_merkle, op13_context_tree,
)}
ORACLES = {"op5_line_dedup": OP5_SQL, "op12_merkle": OP12_SQL}
