"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from manyways.llm import alignment, counts, divergence, language, likelihood, media, mixing, neardup, neighbours, packing, quality, repeats, secrets

QUERIES = {
    "op1_quality": quality.op1_quality,
    "op10_repeats": repeats.op10_repeats,
    "op11_divergence": divergence.op11_divergence,
    "op12_tokens": counts.op12_tokens,
    "op13_alignment": alignment.op13_alignment,
    "op2_packing": packing.op2_packing,
    "op3_mixing": mixing.op3_mixing,
    "op4_neardup": neardup.op4_neardup,
    "op5_secrets": secrets.op5_secrets,
    "op6_language": language.op6_language,
    "op7_likelihood": likelihood.op7_likelihood,
    "op8_media": media.op8_media,
    "op9_neighbours": neighbours.op9_neighbours,
}
SQL = {"op3_mixing": mixing.OP3_SQL, "op11_divergence": divergence.OP11_SQL}
