"""op2: every page's url judged by rules, then by its host's reputation."""

from __future__ import annotations

from pyspark.sql import functions as F

from stepfield.llm import url_reputation as u
from stepfield.llm.base import lower_ascii_sql, query, table

RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
         ("block", "net", "/es/"), ("block", "net", "/fr/")]

_REST = "CASE WHEN contains(url, '://') THEN substring(url, strpos(url, '://') + 3) ELSE '' END"
_TWO = ", ".join(f"'{s}'" for s in u.TWO_LABEL_SUFFIXES)


def _fits(host: str, path: str) -> str:
    return f"(host = '{host}' OR suffix(host, '.{host}')) AND prefix(path, '{path}')"


def _case(value: int) -> str:
    best = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    return "CASE " + " ".join(f"WHEN {_fits(h, p)} THEN '{(h + p, a)[value]}'" for a, h, p in best) + " END"


def _kappa(level: str, name: str) -> str:
    return f"""{name} AS (SELECT coalesce(greatest({u.LOOSE}, least({u.TIGHT}, CASE WHEN b > 1e-9 THEN m * (1 - m) / b - 1 ELSE {u.TIGHT} END)), {u.LOOSE}) AS {name}
  FROM (SELECT max(mu) AS m, sum(n * pow(k / n - mu, 2)) / sum(n) - max(mu) * (1 - max(mu)) * count(*) / sum(n) AS b FROM {level}, total))"""


SQL2 = f"""WITH parsed AS (SELECT page_id, {lower_ascii_sql("regexp_extract(rest, '^[^/?#]*')")} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM (SELECT page_id, coalesce({_REST}, '') AS rest FROM pages)),
named AS (SELECT *, string_split(host, '.') AS p FROM parsed),
doms AS (SELECT *, array_to_string(p[-2:], '.') IN ({_TWO}) AS long FROM named),
own AS (SELECT page_id, host, path, CASE WHEN long THEN array_to_string(p[-3:], '.') ELSE array_to_string(p[-2:], '.') END AS dom,
  CASE WHEN long THEN array_to_string(p[-2:], '.') ELSE p[-1] END AS suf FROM doms),
hosts AS (SELECT host, dom, suf, count(*) AS n, sum(CASE WHEN quality = 1 AND coalesce(toxic, 0) = 0 THEN 1 ELSE 0 END) AS k
  FROM own JOIN labels ON doc_id = page_id WHERE quality IS NOT NULL GROUP BY ALL),
domains AS (SELECT dom, suf, sum(n) AS n, sum(k) AS k FROM hosts GROUP BY ALL),
suffixes AS (SELECT suf, sum(n) AS n, sum(k) AS k FROM domains GROUP BY ALL),
total AS (SELECT coalesce(sum(k) / sum(n), 0.5) AS mu FROM suffixes),
{_kappa("suffixes", "ks")}, {_kappa("domains", "kd")}, {_kappa("hosts", "kh")},
a AS (SELECT own.*, (ks * mu + coalesce(s.k, 0)) / (ks + coalesce(s.n, 0)) AS ms FROM own LEFT JOIN suffixes s USING (suf), total, ks),
b AS (SELECT a.*, (kd * ms + coalesce(d.k, 0)) / (kd + coalesce(d.n, 0)) AS md FROM a LEFT JOIN domains d USING (dom), kd),
c AS (SELECT b.*, (kh * md + coalesce(h.k, 0)) / (kh + coalesce(h.n, 0)) AS mh, kh + coalesce(h.n, 0) AS w FROM b LEFT JOIN hosts h USING (host), kh)
SELECT page_id, host, path, {_case(0)} AS rule,
  coalesce({_case(1)}, CASE WHEN mh - {u.Z} * sqrt(mh * (1 - mh) / (w + 1)) >= {u.LEAST_GOOD} THEN 'allow' ELSE 'block' END) AS verdict FROM c"""


@query("op2_url_reputation", SQL2)
def op2_url_reputation(spark, sf):
    pages, labels = table(spark, sf, "pages"), table(spark, sf, "labels")
    seen = labels.filter(F.col("quality").isNotNull()).select(
        F.col("doc_id").alias("page_id"), ((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)).alias("good"))
    outcomes = u.with_host(pages.select("page_id", "url")).select("page_id", "host").join(seen, "page_id")
    return u.judge(pages, outcomes, RULES, ["page_id"])
