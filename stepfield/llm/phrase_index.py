"""Benchmark decontamination by a positional inverted index of the training corpus (DataFrame functions only).

The index holds the postings (term, document, position) of the test terms that may anchor a phrase. A phrase
is looked up from its rarest terms: their postings, each moved back by the term's offset in the phrase, must
meet at the same start. What is left is compared with the text word by word.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lower-cased. A null or wordless text has no
words. Documents are told apart by doc_id and a hash of the text, so rows that share an id (or have none) are
judged each by its own text and all come back. An empty benchmark hits nothing; a null item_id hits words but
is not counted or listed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepfield.llm.base import UPPER, keyed, stored
from stepfield.session import cut_lineage

#: Words of a window; of the terms of a window so many may become anchors, and so many are intersected.
WINDOW, ANCHORS, INTERSECTED = 13, 4, 2
#: The prefilter's bits, whatever the size of the benchmark; more terms only let more words through to the join.
FILTER_BITS = 1 << 20

_GAPS = "".join(map(chr, [*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))


def words(text: Column) -> Column:
    """The words in order; one pass that maps all gaps to spaces, then a plain split (much faster than a pattern)."""
    plain = F.translate(text, UPPER + _GAPS, UPPER.lower() + " " * len(_GAPS))
    return F.coalesce(F.array_remove(F.split(plain, " "), ""), F.array().cast("array<string>"))


def windows(items: DataFrame, n: int = WINDOW) -> DataFrame:
    """item_id, phrase, len, terms: each run of n words of an item, or the whole of a shorter one."""
    own = items.select("item_id", words(F.col("text")).alias("w")).filter(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - n + 1))
    own = own.select("item_id", "w", F.explode(starts).alias("at")).select("item_id", F.slice("w", F.col("at"), n).alias("terms"))
    return own.select("item_id", F.concat_ws(" ", "terms").alias("phrase"), F.size("terms").alias("len"), "terms").distinct()


def anchor_terms(phrases: DataFrame, anchors: int = ANCHORS) -> DataFrame:
    """phrase, len, term, off: of each distinct phrase the terms that are rarest among the phrases, longer words first."""
    every = phrases.select("phrase", "len", F.posexplode("terms").alias("off", "term"))
    seen = every.groupBy("term").agg(F.count(F.lit(1)).alias("seen"))
    order = Window.partitionBy("phrase").orderBy("seen", F.desc(F.length("term")), "off")
    return every.join(seen, "term").withColumn("r", F.row_number().over(order)).filter(F.col("r") <= anchors).drop("r", "seen")


def _bit(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(FILTER_BITS)).cast("int")


def term_filter(terms: DataFrame) -> Column | None:
    """A test on ``term`` that all ``terms`` pass and few others: a bit table of fixed size, made by Spark.

    At most FILTER_BITS / 64 longs come to the driver. None if there are no terms.
    """
    bit = _bit(F.col("term"))
    cells = terms.select((bit / 64).cast("int").alias("cell"), F.call_function("shiftleft", F.lit(1).cast("long"), bit % 64).alias("mask"))
    rows = {r[0]: r[1] for r in cells.groupBy("cell").agg(F.bit_or("mask")).collect()}
    if not rows:
        return None
    full = F.lit([rows.get(i, 0) for i in range(FILTER_BITS // 64)]).cast("array<bigint>")
    return F.bit_get(F.get(full, F.shiftright(bit, 6)), bit % 64) == 1


def build_index(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """Postings term, doc_id, sig, pos of ``terms`` (distinct), in one pass over the texts."""
    passes = term_filter(terms)
    every = keyed(docs).select("doc_id", "sig", F.posexplode(words(F.col("text"))).alias("pos", "term"))
    return every.filter(F.lit(False) if passes is None else passes).join(terms.select("term").distinct(), "term")


def candidates(index: DataFrame, anchors: DataFrame, intersected: int = INTERSECTED) -> DataFrame:
    """doc_id, sig, start, len where the postings of a phrase's rarest terms meet, each moved back by its offset.

    How rare a term is comes from the whole index. Each phrase starts from its rarest term and needs the
    next ones at their places.
    """
    freq = index.groupBy("term").agg(F.count(F.lit(1)).alias("freq"))
    order = Window.partitionBy("phrase").orderBy("freq", "off")
    # A term that the corpus doesn't have leaves its phrase without any place.
    ranked = anchors.join(freq, "term", "left").na.fill(0, ["freq"]).withColumn("r", F.row_number().over(order))
    ranked = ranked.filter(F.col("r") <= intersected)
    absent = Window.partitionBy("phrase")
    ranked = ranked.withColumn("least", F.min("freq").over(absent)).filter(F.col("least") > 0)
    pair = ranked.groupBy("phrase", "len").agg(
        F.min(F.when(F.col("r") == 1, F.struct("term", "off"))).alias("a"), F.min(F.when(F.col("r") == 2, F.struct("term", "off"))).alias("b"))
    # Neighbouring phrases share their rarest terms: each (term, offset) pair of places is looked up once.
    pair = pair.select("len", F.col("a.term").alias("term"), F.col("a.off").alias("off"), F.col("b.term").alias("next_term"),
                       (F.col("b.off") - F.col("a.off")).alias("gap")).distinct()
    first = index.join(pair, "term").select("doc_id", "sig", (F.col("pos") - F.col("off")).alias("start"), "len", "next_term",
                                            (F.col("pos") + F.col("gap")).alias("next_pos")).filter("start >= 0")
    alone = first.filter(F.col("next_term").isNull())
    other = index.select(F.col("term").alias("next_term"), F.col("doc_id").alias("d"), F.col("sig").alias("s"), F.col("pos").alias("next_pos"))
    met = first.join(other, (first.next_term == other.next_term) & (first.next_pos == other.next_pos) & (first.sig == other.s)
                     & first.doc_id.eqNullSafe(other.d), "left_semi")
    return met.unionByName(alone).select("doc_id", "sig", "start", "len").distinct()


def phrase_matches(docs: DataFrame, items: DataFrame, n: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """All documents (doc_id, sig, n_words), and where phrases of items occur (doc_id, sig, start, len, item_id)."""
    own = cut_lineage(windows(items, n))
    anchors = cut_lineage(anchor_terms(own.select("phrase", "len", "terms").distinct()))
    index = stored(docs.sparkSession, build_index(docs, anchors.select("term").distinct()), "postings")
    # The places of a document are at most its words; they come back to its text in one row.
    places = candidates(index, anchors).groupBy("doc_id", "sig").agg(F.collect_list(F.struct("start", "len")).alias("at"))
    places = places.withColumnsRenamed({"doc_id": "d", "sig": "s"})
    text = keyed(docs)
    met = text.join(places, (text.sig == places.s) & text.doc_id.eqNullSafe(places.d), "left").select(
        "doc_id", "sig", "at", words(F.col("text")).alias("w"))
    found = F.transform("at", lambda p: F.struct(p["start"].alias("start"), p["len"].alias("len"),
                                                 F.concat_ws(" ", F.slice("w", p["start"] + 1, p["len"])).alias("phrase")))
    met = cut_lineage(met.select("doc_id", "sig", F.size("w").cast("long").alias("n_words"), found.alias("found")))
    places = met.select("doc_id", "sig", F.explode("found").alias("f")).select("doc_id", "sig", "f.*").distinct()
    hits = places.join(own.select("phrase", "len", "item_id"), ["phrase", "len"]).select("doc_id", "sig", "start", "len", "item_id")
    return met.select("doc_id", "sig", "n_words"), hits


def proximity_matches(docs: DataFrame, items: DataFrame, within: int) -> DataFrame:
    """item_id, doc_id, sig, pos, other: places where the two rarest of an item's terms that occur stand at most ``within`` words apart.

    Positions are cut into cells of ``within`` words; a posting meets those of its own cell and the two beside
    it, so no document's postings are paired in full.
    """
    own = items.select("item_id", words(F.col("text")).alias("w")).filter(F.size("w") > 0)
    every = cut_lineage(own.select("item_id", F.explode(F.array_distinct("w")).alias("term")))
    index = stored(docs.sparkSession, build_index(docs, every.select("term").distinct()), "postings")
    freq = index.groupBy("term").agg(F.count(F.lit(1)).alias("freq"))
    order = Window.partitionBy("item_id").orderBy("freq", "term")
    # Terms that no document has can't stand near others; the rank is one of those that the documents have.
    rare = every.join(freq, "term").withColumn("r", F.row_number().over(order)).filter("r <= 2")
    cell = F.floor(F.col("pos") / within)
    a = index.join(rare.filter("r = 1").select("item_id", "term"), "term").select(
        "item_id", "doc_id", "sig", "pos", F.explode(F.array(cell - 1, cell, cell + 1)).alias("cell"))
    b = index.join(rare.filter("r = 2").select(F.col("item_id").alias("i"), "term"), "term").select(
        "i", F.col("doc_id").alias("d"), F.col("sig").alias("s"), F.col("pos").alias("other"), cell.alias("c"))
    return a.join(b, a.item_id.eqNullSafe(b.i) & (a.sig == b.s) & (a.cell == b.c) & a.doc_id.eqNullSafe(b.d)).filter(
        F.abs(F.col("pos") - F.col("other")) <= within).select("item_id", "doc_id", "sig", "pos", "other").distinct()


def contamination(docs: DataFrame, items: DataFrame, n: int = WINDOW) -> DataFrame:
    """doc_id, sig, n_words, n_hit, n_items, items_sha256, contaminated of every document row."""
    every, hits = phrase_matches(docs, items, n)
    spans = hits.select("doc_id", "sig", "start", (F.col("start") + F.col("len")).alias("end")).distinct()
    before = Window.partitionBy("doc_id", "sig").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumn("till", F.coalesce(F.max("end").over(before), F.lit(0)))
    hit = spans.groupBy("doc_id", "sig").agg(
        F.sum(F.greatest(F.lit(0), F.col("end") - F.greatest("start", "till"))).cast("long").alias("n_hit"))
    ids = hits.filter(F.col("item_id").isNotNull()).select("doc_id", "sig", F.col("item_id").cast("string").alias("item")).distinct()
    ids = ids.groupBy("doc_id", "sig").agg(F.array_sort(F.collect_list("item")).alias("items"))
    hit = hit.withColumnsRenamed({"doc_id": "d", "sig": "s"})
    ids = ids.withColumnsRenamed({"doc_id": "d2", "sig": "s2"})
    out = every.join(hit, (every.sig == hit.s) & every.doc_id.eqNullSafe(hit.d), "left")
    out = out.join(ids, (out.sig == ids.s2) & out.doc_id.eqNullSafe(ids.d2), "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    items = F.coalesce("items", F.array().cast("array<string>"))
    return out.select("doc_id", "sig", "n_words", n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"),
                      F.sha2(F.concat_ws(",", items), 256).alias("items_sha256"),
                      ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"))
