"""op8 and op9: text repeated from documents with smaller ids, by words and by bytes.

Over bytes SQL takes minutes on whole tables, so op9 has none; a test compares it to brute force.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from stepfield.llm.base import query, table
from stepfield.llm.longest_previous import kept_bytes
from stepfield.llm.suffix_tree import kept_words


SQL8 = r"""WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
source AS (SELECT h, min(doc_id) AS m FROM win GROUP BY h),
starts AS (SELECT DISTINCT doc_id, i AS p, i FROM win JOIN source USING (h) WHERE doc_id > m),
mark AS (SELECT doc_id, p, word, coalesce(max(i) OVER (PARTITION BY doc_id ORDER BY p) > p - 50, false) AS gone
  FROM (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d) LEFT JOIN starts USING (doc_id, p)),
out AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY p) FILTER (NOT gone) AS t FROM mark GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN out USING (doc_id)"""

@query("op8_suffix_trees", SQL8)
def op8_suffix_trees(spark, sf):
    out = kept_words(table(spark, sf, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query("op9_longest_previous")
def op9_longest_previous(spark, sf):
    out = kept_bytes(table(spark, sf, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
