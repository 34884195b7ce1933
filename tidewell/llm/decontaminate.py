"""Benchmark decontamination with a distributed positional inverted index.

Built from DataFrame functions alone. The index stores a posting (document,
term, position) for each training token whose term the queries can use. A
query window is found from its two rarest terms: their postings, each moved
back by the term's offset, meet on a diagonal (document position minus item
position). Only on those diagonals the other terms' postings are looked up,
and runs of consecutive matches that are long enough are exact phrase matches.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import ascii_lower, staged

#: What ends a word, before lower-casing.
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: A side is broadcast while it has no more rows than this (of at most some 50 bytes each).
BROADCAST_ROWS = 200_000
#: Words longer than this many bytes take part in no broadcast: the bound on a row.
BROADCAST_TERM_BYTES = 200


def _words(text: Column) -> Column:
    """The words between two empty strings; without words just those two."""
    return F.split(F.concat(F.lit(" "), F.coalesce(text, F.lit("")), F.lit(" ")), GAP)


def _small(df: DataFrame, rows: int) -> DataFrame:
    """``df``, to be broadcast if its counted rows allow it."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


@dataclass
class PositionalIndex:
    """``postings``: d, th (together the document), tid, pos.
    ``documents``: doc_id, d, th, n_words, one row for each input row.
    ``terms``: term, tid. ``n_terms``: how many."""

    postings: DataFrame
    documents: DataFrame
    terms: DataFrame
    n_terms: int


def build_index(docs: DataFrame, terms: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> PositionalIndex:
    """Index the positions of ``terms`` (a column ``term``) in all of ``docs``.

    Null text has no words. A document is its id and a hash of its text, so
    rows that repeat both share postings, and rows that share an id alone do
    not. Null ids are documents as well. Each posting is held once, however
    many rows repeat its document.
    """
    listed = staged(terms.select("term").where("term is not null").distinct().select("term", F.monotonically_increasing_id().alias("tid")), "terms")
    n_terms, longest = listed.agg(F.count("*"), F.max(F.octet_length("term"))).first()
    text = docs[f"`{text_col}`"]
    rows = docs.select(docs[f"`{id_col}`"].cast("long").alias("doc_id"), F.xxhash64(docs[f"`{id_col}`"].isNull(), text).alias("th"), _words(text).alias("words"))
    rows = rows.select("doc_id", "th", (F.size("words") - 2).alias("n_words"), F.posexplode("words").alias("pos", "word"))
    rows = rows.where("word <> '' or pos = 0").withColumn("term", ascii_lower(F.col("word")))
    small = n_terms <= BROADCAST_ROWS and (longest or 0) <= BROADCAST_TERM_BYTES
    found = rows.join(F.broadcast(listed) if small else listed, "term", "left").where("tid is not null or pos = 0")
    found = found.select("doc_id", F.coalesce("doc_id", F.lit(0)).alias("d"), "th", "tid", F.when(F.col("tid").isNull(), F.col("n_words")).otherwise(F.col("pos") - 1).cast("int").alias("pos"))
    stored = staged(found, "postings")
    postings = stored.where("tid is not null").select("d", "th", "tid", "pos")
    again = staged(stored.where("tid is null").groupBy("d", "th").count().where("count > 1").select("d", "th"), "repeated")
    n_again = again.count()
    if n_again:
        once = postings.join(_small(again, n_again), ["d", "th"], "left_semi").distinct()
        postings = staged(postings.join(_small(again, n_again), ["d", "th"], "left_anti").unionByName(once), "distinct-postings")
    return PositionalIndex(
        postings,
        stored.where("tid is null").select("doc_id", "d", "th", F.col("pos").cast("long").alias("n_words")),
        listed,
        n_terms,
    )


def item_words(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(ik, item_id, n, j, term) for each word of each item; ik tells rows apart whatever their ids."""
    keyed = items.select(F.monotonically_increasing_id().alias("ik"), items[f"`{id_col}`"].alias("item_id"), _words(items[f"`{text_col}`"]).alias("words"))
    rows = keyed.select("ik", "item_id", (F.size("words") - 2).alias("n"), F.posexplode("words").alias("pos", "word")).where("word <> ''")
    return staged(rows.select("ik", "item_id", "n", (F.col("pos") - 1).alias("j"), ascii_lower(F.col("word")).alias("term")), "item-words")


def _known(index: PositionalIndex, words: DataFrame) -> DataFrame:
    """``words`` with the id of each term and how often the corpus holds it."""
    counts = index.postings.groupBy("tid").agg(F.count("*").alias("cnt"))
    return staged(words.join(index.terms, "term").join(counts, "tid", "left").select("ik", "item_id", "n", "j", "tid", F.coalesce("cnt", F.lit(0)).alias("cnt")), "item-terms")


def _anchors(terms: DataFrame, width: int) -> DataFrame:
    """The two rarest terms of each window, one row for each term; windows with the same two are one."""
    need = F.least(F.lit(width), F.col("n"))
    frame = Window.partitionBy("ik").orderBy("j").rowsBetween(0, width - 1)
    windows = terms.withColumn("c", F.sort_array(F.collect_list(F.struct("cnt", "j", "tid")).over(frame))).where(F.col("j") <= F.col("n") - need)
    rare = windows.select("ik", "j", need.alias("need"), F.slice("c", 1, 2).alias("r")).where("r[0].cnt > 0")
    pairs = rare.groupBy("ik", "r").agg(F.min("j").alias("lo"), F.max(F.col("j") + F.col("need") - 1).alias("hi"), F.first("need").alias("need"))
    numbered = pairs.select(F.monotonically_increasing_id().alias("q"), "ik", "lo", "hi", "r")
    return numbered.select("q", "ik", "lo", "hi", F.size("r").alias("wanted"), F.explode("r").alias("t")).select("q", "ik", "lo", "hi", "wanted", F.col("t.j").alias("tj"), F.col("t.tid").alias("tid"))


def phrase_matches(index: PositionalIndex, words: DataFrame, width: int = 10) -> DataFrame:
    """(d, th, item_id, first, last): each maximal run of document words that windows of an item cover.

    A window is ``width`` consecutive words of an item (all of a shorter
    one). Two rows of one document may overlap if items or diagonals differ.
    """
    terms = _known(index, words)
    anchors = staged(_anchors(terms, width), "anchors")
    n_anchors = anchors.count()
    lists = index.postings.join(_small(anchors, n_anchors), "tid")
    met = lists.groupBy("q", "ik", "lo", "hi", "wanted", "d", "th", (F.col("pos") - F.col("tj")).alias("diag")).agg(F.count("*").alias("m")).where("m = wanted")
    near = staged(met.groupBy("ik", "d", "th", "diag").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")), "candidates")
    held = near.select("d", "th").distinct()
    n_held = held.count()
    asked = near.select("ik", "d", "th", "diag", F.explode(F.sequence("lo", "hi")).alias("j")).join(_small(terms.select("ik", "j", "n", "item_id", "tid"), terms.count()), ["ik", "j"])
    own = index.postings.join(_small(held, n_held), ["d", "th"], "left_semi")
    same = asked.withColumn("pos", F.col("diag") + F.col("j")).join(own, ["d", "th", "pos", "tid"])
    line = Window.partitionBy("ik", "d", "th", "diag").orderBy("j")
    runs = same.withColumn("run", F.col("j") - F.row_number().over(line)).groupBy("ik", "d", "th", "diag", "run")
    spans = runs.agg(F.count("*").alias("len"), F.min("pos").alias("first"), F.max("pos").alias("last"), F.first("n").alias("n"), F.first("item_id").alias("item_id"))
    return spans.where(F.col("len") >= F.least(F.lit(width), F.col("n"))).select("d", "th", "item_id", "first", "last")


def proximity_matches(index: PositionalIndex, words: DataFrame, within: int) -> DataFrame:
    """(d, th, item_id, pos): occurrences of an item's rarest term with all its other
    distinct terms no further than ``within`` positions away, in any order."""
    terms = _known(index, words).groupBy("ik", "item_id", "tid", "cnt").agg(F.min("j").alias("j"))
    terms = staged(terms, "near-terms")
    whole = terms.groupBy("ik").agg(F.count("*").alias("k"), F.min(F.struct("cnt", "j", "tid")).alias("r"))
    total = words.groupBy("ik").agg(F.count_distinct("term").alias("all"))
    lead = whole.join(total, "ik").where("k = all").select("ik", "k", F.col("r.tid").alias("tid"))
    step = max(1, within)
    at = index.postings.join(lead, "tid").select("ik", "k", "d", "th", F.col("pos").alias("at"))
    at = at.withColumn("bucket", F.explode(F.sequence((F.floor(F.col("at") / step) - 1).cast("int"), (F.floor(F.col("at") / step) + 1).cast("int"))))
    others = index.postings.withColumn("bucket", F.floor(F.col("pos") / step).cast("int"))
    near = at.join(others, ["d", "th", "bucket"]).where(F.abs(F.col("pos") - F.col("at")) <= within).join(terms.select("ik", "item_id", "tid"), ["ik", "tid"])
    full = near.groupBy("ik", "item_id", "k", "d", "th", "at").agg(F.count_distinct("tid").alias("got")).where("got = k")
    return full.select("d", "th", "item_id", F.col("at").alias("pos"))


def contamination(docs: DataFrame, items: DataFrame, width: int = 10, id_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated, d, th) for each row of ``docs``.

    n_hit counts document words inside any occurrence of a window of an item.
    items_sha256 is over the sorted, comma-joined ids of the items with such a
    window. Null or wordless texts and items match nothing; an item with a null
    id hits words but is not listed; repeated items count once by id. Empty
    tables on either side give no hits. Only the named columns are read.
    """
    words = item_words(items, item_col, text_col)
    index = build_index(docs, words.select("term"), id_col, text_col)
    spans = staged(phrase_matches(index, words, width), "spans")
    before = F.max("last").over(Window.partitionBy("d", "th").orderBy("first", "last").rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.greatest(F.lit(0), F.col("last") - F.greatest(F.col("first") - 1, F.coalesce("before", F.lit(-1))))
    hit = spans.select("d", "th", "first", "last").distinct().withColumn("before", before).groupBy("d", "th").agg(F.sum(fresh).cast("long").alias("n_hit"))
    listed = spans.groupBy("d", "th").agg(F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("ids"))
    hit = hit.join(listed, ["d", "th"])
    out = index.documents.join(hit, ["d", "th"], "left")
    ids = F.coalesce("ids", F.array().cast("array<string>"))
    return out.select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.size(ids).cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ",").cast("binary"), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
        "d",
        "th",
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, width: int = 10, id_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold no window of any item, all columns as they are."""
    found = contamination(docs, items, width, id_col, item_col, text_col).where("contaminated").select(F.col("d").alias("__d"), F.col("th").alias("__th"))
    found = staged(found.distinct(), "contaminated")
    own = [F.coalesce(docs[f"`{id_col}`"].cast("long"), F.lit(0)) == F.col("__d"), F.xxhash64(docs[f"`{id_col}`"].isNull(), docs[f"`{text_col}`"]) == F.col("__th")]
    return docs.join(_small(found, found.count()), own[0] & own[1], "left_anti")
