"""All queries of the folder; importing the modules fills the registry."""

from stepfield.llm.base import QUERIES, SQL
from stepfield.llm import queries_chat, queries_corpus, queries_models, queries_packing, queries_phrase, queries_repeats, queries_simhash, queries_url, queries_vectors  # noqa: F401

__all__ = ["QUERIES", "SQL"]
