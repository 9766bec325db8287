"""op3: all conversations formatted, and read back."""

from __future__ import annotations

from stepfield.llm.base import query, table
from stepfield.llm.chat_format import digests


@query("op3_chat_format")
def op3_chat_format(spark, sf):
    import public_tokenizers

    rows = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    hard = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", hard), (-7, 1, "assistant", hard)], rows.schema)
    return digests(rows.unionByName(more), public_tokenizers.path("byte_bpe_50k.json"))
