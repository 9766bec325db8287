"""op5: documents against benchmark passages."""

from __future__ import annotations

from stepfield.llm.base import lower_ascii_sql, query, table
from stepfield.llm.phrase_index import contamination

_WORDS = r"regexp_extract_all({}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

SQL5 = f"""WITH d AS (SELECT doc_id, coalesce({_WORDS.format(lower_ascii_sql("text"))}, []) AS w FROM documents),
b AS (SELECT item_id, coalesce({_WORDS.format(lower_ascii_sql("text"))}, []) AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(13, len(w)) AS n, w[i:i + least(13, len(w)) - 1] AS p
  FROM (SELECT *, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS i FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM win),
places AS (SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS i, w FROM d, lens WHERE len(w) >= n),
hits AS (SELECT doc_id, i, p.n, item_id FROM places p JOIN win ON win.n = p.n AND win.p = p.w[i:i + p.n - 1]),
hit_words AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS pos FROM hits) GROUP BY 1),
ids AS (SELECT doc_id, list_sort(list(DISTINCT item_id::VARCHAR)) AS items FROM hits GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(len(items), 0)::BIGINT AS n_items,
  sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit_words USING (doc_id) LEFT JOIN ids USING (doc_id)"""


@query("op5_decontaminate", SQL5)
def op5_decontaminate(spark, sf):
    return contamination(table(spark, sf, "documents"), table(spark, sf, "benchmark")).drop("sig")
