"""The queries of this package and their SQL twins."""

from __future__ import annotations

import corpus_pipeline
from lineweave.llm import bpe, chat, collocations, decontaminate, line_dedup, packing, quality, repair, sampling, secrets, simhash, topk, url_rules

QUERIES = {
    "op1_line_dedup": line_dedup.op1_line_dedup,
    "op2_quality": quality.op2_quality,
    "op3_url_rules": url_rules.op3_url_rules,
    "op4_simhash": simhash.op4_simhash,
    "op5_chat": chat.op5_chat,
    "op6_packing": packing.op6_packing,
    "op7_topk": topk.op7_topk,
    "op8_secrets": secrets.op8_secrets,
    "op9_bpe": bpe.op9_bpe,
    "op10_fingerprint": sampling.op10_fingerprint,
    "op11_decontaminate": decontaminate.op11_decontaminate,
    "op12_collocations": collocations.op12_collocations,
    "op13_repair": repair.op13_repair,
    "pipeline": corpus_pipeline.run,
}
ORACLES = {
    "op1_line_dedup": line_dedup.ORACLE,
    "op3_url_rules": url_rules.ORACLE,
    "op5_chat": chat.ORACLE,
    "op7_topk": topk.ORACLE,
    "op11_decontaminate": decontaminate.ORACLE,
    "op12_collocations": collocations.ORACLE,
    "op13_repair": repair.ORACLE,
}
