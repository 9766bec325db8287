"""op7 and op10: learned classifiers over every whole text."""

from __future__ import annotations

from stepfield.llm import language, quality
from stepfield.llm.base import query, table


@query("op7_language_codes")
def op7_language_codes(spark, sf):
    docs = table(spark, sf, "documents")
    return language.predict(docs, language.learn(docs))


@query("op10_quality_bytes")
def op10_quality_bytes(spark, sf):
    docs = table(spark, sf, "documents")
    return quality.score(docs, quality.learn(docs, table(spark, sf, "labels")))
