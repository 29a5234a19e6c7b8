"""Benchmark decontamination over a distributed positional inverted index.

Windows of benchmark items are phrases. One pass over the documents counts the
benchmark's terms; every phrase is then looked up by its rarest terms, so the
index holds postings (term, document, position) of those terms alone, clustered
by term. A phrase's posting lists, shifted by the term's offset in the phrase,
are intersected from the rarest list on; the survivors are compared with the
document's words. Frequent terms never need their lists unless a phrase has
nothing rarer, and a long list is spread by document. DataFrame functions only.

Defined cases: null or empty text has no words and no hit; null item text gives
no window; a null item_id counts as the item with id ''; equal rows are equally
judged; an item repeated in the benchmark counts once; all matches count, so ties need no order; a text of any
length is split whole, in one task; without documents there are no rows, without items no hits. Other columns are carried along.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.arrays import let
from tidemark.llm.shared import ascii_words, broadcast_if_small, carried, stored, text_key, upto

WINDOW = 10
RAREST = 3
TERM_BYTES = 600
"""Generous size of one broadcast row of terms or phrases."""


def phrases(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """phrase, terms, items: the distinct windows of ``window`` consecutive words; a shorter item is one window."""
    words = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), ascii_words("text").alias("w"))
    starts = upto(F.size("w") - F.least(F.size("w"), F.lit(window)) + F.when(F.size("w") > 0, 1).otherwise(0))
    cut = words.select("item", F.explode(F.transform(starts, lambda i: F.slice("w", i + 1, window))).alias("terms"))
    return cut.groupBy(F.array_join("terms", " ").alias("phrase"), "terms").agg(F.sort_array(F.collect_set("item")).alias("items"))


def term_counts(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """term, postings: how often each given term stands in the documents."""
    found = docs.select(F.explode(ascii_words("text")).alias("term")).join(terms, "term", "left_semi")
    return found.groupBy("term").agg(F.count(F.lit(1)).alias("postings"))


def plan_lookups(windows: DataFrame, counts: DataFrame, rarest: int = RAREST) -> DataFrame:
    """Adds ``anchors``: the (term, off) of each phrase's rarest terms, rarest first. Phrases with an absent term are dropped."""
    each = windows.select("phrase", F.posexplode("terms").alias("off", "term"))
    ranked = each.join(counts, "term", "left").groupBy("phrase").agg(
        F.sort_array(F.collect_list(F.struct(F.coalesce("postings", F.lit(0)).alias("postings"), "term", "off"))).alias("ranked")
    )
    alive = ranked.where(F.col("ranked")[0]["postings"] > 0)
    anchors = F.transform(F.slice("ranked", 1, rarest), lambda x: F.struct(x["term"].alias("term"), x["off"].alias("off")))
    return windows.join(alive.select("phrase", anchors.alias("anchors")), "phrase")


def build_index(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """Postings (term, doc_id, key, pos) of the given terms, clustered by term and stored.

    Range partitioning by term and document keeps a term's list together and
    still splits a list that is too long for one task.
    """
    spread = docs.select("doc_id", text_key("text").alias("key"), F.posexplode(ascii_words("text")).alias("pos", "term"))
    lists = spread.join(terms, "term", "left_semi").select("term", "doc_id", "key", "pos")
    return stored(lists.distinct().repartitionByRange("term", "key").sortWithinPartitions("term", "key", "pos"), "postings")


def phrase_candidates(index: DataFrame, lookups: DataFrame, n_lookups: int, rarest: int = RAREST) -> DataFrame:
    """doc_id, key, start, phrase, items: places where the shifted lists of all anchors meet."""
    keyed = lookups.select("phrase", "items", "anchors", F.col("anchors")[0]["term"].alias("term"), F.col("anchors")[0]["off"].alias("off"))
    found = (
        index.join(broadcast_if_small(keyed, n_lookups, TERM_BYTES), "term")
        .select("doc_id", "key", (F.col("pos") - F.col("off")).alias("start"), "phrase", "items", "anchors")
        .where("start >= 0")
    )
    for k in range(1, rarest):  # phrases of fewer terms meet their first list again
        anchor = F.col("anchors")[F.least(F.lit(k), F.size("anchors") - 1)]
        found = found.withColumns({"term": anchor["term"], "pos": F.col("start") + anchor["off"]})
        found = found.join(index.drop("doc_id"), ["key", "term", "pos"], "left_semi").drop("term", "pos")
    return found


def covered(spans: Column) -> Column:
    """Positions under any of the (start, length) spans."""
    merged = F.aggregate(
        F.array_sort(spans),
        F.struct(F.lit(0).alias("total"), F.lit(0).alias("end")),
        lambda acc, s: F.struct(
            (acc["total"] + F.greatest(s["start"] + s["length"] - F.greatest(acc["end"], s["start"]), F.lit(0))).alias("total"),
            F.greatest(acc["end"], s["start"] + s["length"]).alias("end"),
        ),
    )
    return merged["total"]


def exact_matches(docs: DataFrame, candidates: DataFrame) -> DataFrame:
    """Every document with n_words, and ``matches``: the (start, length, phrase, items) that its words confirm."""
    per_doc = candidates.groupBy(F.col("doc_id").alias("_id"), F.col("key").alias("_key")).agg(
        F.collect_set(F.struct("start", "phrase", "items")).alias("places")
    )
    rows = docs.withColumn("_h", text_key("text"))
    joined = rows.join(per_doc, rows["doc_id"].eqNullSafe(per_doc["_id"]) & (rows["_h"] == per_doc["_key"]), "left")

    def confirm(w: Column) -> Column:
        sized = F.transform(
            F.coalesce("places", F.array().cast("array<struct<start:int,phrase:string,items:array<string>>>")),
            lambda p: F.struct(p["start"].alias("start"), (F.size(F.split(p["phrase"], " "))).alias("length"), p["phrase"].alias("phrase"), p["items"].alias("items")),
        )
        real = F.filter(sized, lambda p: F.array_join(F.slice(w, p["start"] + 1, p["length"]), " ") == p["phrase"])
        return F.struct(F.size(w).cast("long").alias("n_words"), real.alias("matches"))

    return joined.withColumn("_found", let(ascii_words("text"), confirm)).select(
        *docs.columns, F.col("_found")["n_words"].alias("n_words"), F.col("_found")["matches"].alias("matches")
    )


def near_matches(index: DataFrame, lookups: DataFrame, n_lookups: int, slack: int = 10) -> DataFrame:
    """Proximity matches (doc_id, key, phrase, start): the two rarest terms lie within ``slack`` words of their distance in the phrase.

    Shifted positions are cut into cells of ``slack`` words; the second list is
    entered in the neighbouring cells too, so the join is on equal cells.
    """
    two = lookups.where(F.size("anchors") > 1)
    ends = [
        index.join(
            broadcast_if_small(two.select("phrase", F.col("anchors")[k]["term"].alias("term"), F.col("anchors")[k]["off"].alias("off")), n_lookups, TERM_BYTES),
            "term",
        ).select("doc_id", "key", "phrase", (F.col("pos") - F.col("off")).alias(f"at{k}"))
        for k in (0, 1)
    ]
    cell = F.floor(F.col("at1") / slack)
    near = ends[1].withColumn("cell", F.explode(F.array(cell - 1, cell, cell + 1))).drop("doc_id")
    met = ends[0].withColumn("cell", F.floor(F.col("at0") / slack)).join(near, ["key", "phrase", "cell"])
    return met.where(F.abs(F.col("at0") - F.col("at1")) <= slack).groupBy("doc_id", "key", "phrase").agg(F.min("at0").alias("start"))


def lookup_index(docs: DataFrame, items: DataFrame, window: int = WINDOW, rarest: int = RAREST) -> tuple[DataFrame, DataFrame, int]:
    """Index of the documents, the planned phrases and how many they are."""
    windows = stored(phrases(items, window), "phrases")
    terms = windows.select(F.explode("terms").alias("term")).distinct()
    counts = stored(term_counts(docs, broadcast_if_small(terms, terms.count(), TERM_BYTES)), "terms")
    lookups = stored(plan_lookups(windows, counts, rarest), "lookups")
    anchors = lookups.select(F.explode("anchors").alias("a")).select(F.col("a")["term"].alias("term")).distinct()
    return build_index(docs, broadcast_if_small(anchors, anchors.count(), TERM_BYTES)), lookups, lookups.count()


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, rarest: int = RAREST) -> DataFrame:
    """All columns of ``docs`` plus n_words, matches, n_hit (words under a match), hit_items (sorted ids)."""
    index, lookups, n = lookup_index(docs, items, window, rarest)
    inner, finish = carried(docs, "doc_id", "text")
    found = exact_matches(inner, phrase_candidates(index, lookups, n, rarest))
    spans = F.array_distinct(F.transform("matches", lambda m: F.struct(m["start"].alias("start"), m["length"].alias("length"))))
    ids = F.sort_array(F.array_distinct(F.flatten(F.transform("matches", lambda m: m["items"]))))
    return finish(found.withColumns({"n_hit": covered(spans).cast("long"), "hit_items": ids}), "n_words", "matches", "n_hit", "hit_items")
