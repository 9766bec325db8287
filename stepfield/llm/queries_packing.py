"""op6: all documents packed into sequences of 2048 tokens."""

from __future__ import annotations

from stepfield.llm.base import query, table
from stepfield.llm.packing import pack


@query("op6_best_fit_packing")
def op6_best_fit_packing(spark, sf):
    import public_tokenizers

    return pack(table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
