"""op4: near-duplicate documents by SimHash."""

from __future__ import annotations

from stepfield.llm.base import query, table
from stepfield.llm.simhash import near_duplicates


@query("op4_simhash_near")
def op4_simhash_near(spark, sf):
    return near_duplicates(table(spark, sf, "documents")).drop("sig")
