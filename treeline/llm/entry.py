"""The subpackage's registered queries and their SQL."""

from __future__ import annotations

from . import alignment, embeddings, exact_dedup, lexical, licenses, lm, near_dedup, packing, pieces, quality, repeats, sharding, warc

QUERIES = {
    "op1_embedding_near_dedup": embeddings.op1_embedding_near_dedup,
    "op2_sentencepiece": pieces.op2_sentencepiece,
    "op3_exact_dedup": exact_dedup.op3_exact_dedup,
    "op4_sharding": sharding.op4_sharding,
    "op5_lm_scoring": lm.op5_lm_scoring,
    "op6_quality": quality.op6_quality,
    "op7_minhash_near_dedup": near_dedup.op7_minhash_near_dedup,
    "op8_suffix_dedup": repeats.op8_suffix_dedup,
    "op9_warc": warc.op9_warc,
    "op10_packing": packing.op10_packing,
    "op11_alignment": alignment.op11_alignment,
    "op12_lexical_search": lexical.op12_lexical_search,
    "op13_license_scan": licenses.op13_license_scan,
}
ORACLES = {
    "op3_exact_dedup": exact_dedup.SQL,
    "op4_sharding": sharding.SQL,
    "op9_warc": warc.SQL,
    "op12_lexical_search": lexical.SQL,
    "op13_license_scan": licenses.SQL,
}
