"""op11, op12 and op13: sources against each other, spelling variants, exact copies."""

from __future__ import annotations

from stepfield.llm.base import lower_ascii_sql, query, table
from stepfield.llm.cuckoo import exact_duplicates
from stepfield.llm.spimi import divergence
from stepfield.llm.variants import spelling_variants

_TERMS = r"regexp_extract_all({}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')"
_SHARE = "(1 + 1000000000::HUGEINT * ({} + 1) // ({} + v))"


def _pull(p: str, q: str) -> str:
    return f"(({p} - {q}) * ({p} - {q}) // {q})"


SQL11 = f"""WITH d AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source, {_TERMS.format(lower_ascii_sql("coalesce(text, '')"))} AS w FROM documents),
occ AS (SELECT row, lang, source, unnest(w) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM occ GROUP BY ALL HAVING count(DISTINCT row) >= 3),
langs AS (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang),
own AS (SELECT o.lang, source, o.term, count(*) AS n FROM occ o JOIN kept k ON k.lang = o.lang AND k.term = o.term GROUP BY ALL),
groups AS (SELECT lang, source, coalesce(g.total, 0) AS total FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN (SELECT lang, source, sum(n) AS total FROM own GROUP BY ALL) g USING (lang, source)),
shares AS (SELECT g.lang, g.source, k.term, coalesce(o.n, 0) AS n, {_SHARE.format("coalesce(o.n, 0)", "g.total")} AS p, {_SHARE.format("k.n", "l.total")} AS q
  FROM groups g JOIN langs l ON l.lang = g.lang JOIN kept k ON k.lang = g.lang LEFT JOIN own o ON o.lang = g.lang AND o.source = g.source AND o.term = k.term),
met AS (SELECT a.lang, a.source, b.source AS item, sum({_pull("a.p", "b.p")}) AS value FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(m.value, 0) AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN met m ON m.lang = a.lang AND m.source = a.source AND m.item = b.source),
terms AS (SELECT lang, source, term AS item, {_pull("p", "q")} AS value FROM shares WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM
  (SELECT lang, source, 'pair' AS part, item, value FROM pairs UNION ALL SELECT lang, source, 'term', item, value FROM terms))
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 200"""


@query("op11_source_divergence", SQL11)
def op11_source_divergence(spark, sf):
    return divergence(table(spark, sf, "documents"))


# crc32 by its table of 256 values (from the polynomial) over the bytes of UTF-8.
SQL12 = r"""WITH crc AS (SELECT list(list_reduce([i::BIGINT, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS tab FROM range(256) t(i)),
runs AS (SELECT doc_id, run, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(LOWER_TEXT, '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM documents) WHERE length(run) >= 6 GROUP BY ALL),
bytes AS (SELECT run, n, flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || run, ''), lambda c: CASE WHEN ord(c) < 128 THEN [ord(c)::BIGINT] ELSE [192 + ord(c) // 64, 128 + ord(c) % 64]::BIGINT[] END)) AS b FROM runs),
hashed AS (SELECT run, n, xor(list_reduce(list_prepend(4294967295::BIGINT, b), lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1])), 4294967295) AS h FROM bytes, crc),
spelt AS (SELECT CASE WHEN h % 199 = 0 THEN left(run, h % length(run)) || substring(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed),
words AS (SELECT word, sum(n)::BIGINT AS n FROM spelt WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
cut AS (SELECT word, n, i, left(word, i) || substring(word, i + 2) AS less FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)),
near AS (SELECT DISTINCT a.word, b.word AS other, b.n FROM cut a JOIN words b ON a.less = b.word
  UNION SELECT b.word, a.word, a.n FROM cut a JOIN words b ON a.less = b.word
  UNION SELECT a.word, b.word, b.n FROM cut a JOIN cut b ON a.i = b.i AND a.less = b.less AND a.word <> b.word),
best AS (SELECT word, count(*) AS n_near, max(n) AS most, arg_min(other, {'n': -n, 'w': other}) AS other FROM near GROUP BY word),
forms AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN most >= 5 * w.n THEN b.other END AS form, CASE WHEN most >= 5 * w.n THEN most END AS form_n FROM words w LEFT JOIN best b ON b.word = w.word),
chain AS (WITH RECURSIVE c AS (SELECT word, word AS root, form AS next FROM forms UNION ALL SELECT c.word, f.word, f.form FROM c JOIN forms f ON f.word = c.next) SELECT word, root FROM c WHERE next IS NULL)
SELECT f.word, f.form, root, n, n_near::BIGINT AS n_near, form_n::BIGINT AS form_n FROM forms f JOIN chain ON chain.word = f.word""".replace("LOWER_TEXT", lower_ascii_sql("text"))


@query("op12_spelling_variants", SQL12)
def op12_spelling_variants(spark, sf):
    return spelling_variants(table(spark, sf, "documents"))


SQL13 = f"""SELECT doc_id, max(doc_id) OVER own AS keep_id, count(*) OVER own AS group_size,
  row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, {lower_ascii_sql("coalesce(text, '')")} AS t FROM documents) WINDOW own AS (PARTITION BY t)"""


@query("op13_cuckoo_dedup", SQL13)
def op13_cuckoo_dedup(spark, sf):
    return exact_duplicates(table(spark, sf, "documents"))
