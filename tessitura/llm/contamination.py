"""Benchmark passages inside documents, by a prefix-filtered join of word shingles.

Every benchmark item is cut into windows of 13 consecutive words; an item of fewer words, but not none, is one
window. A window inside a document needs all of its shingles (three words each) there, so one of them suffices
as its prefix: the rarest, by occurrences counted over all documents. Documents meet windows on that shingle; the
shingle's place inside the window bounds the window's start and end in the document, and the words of the document
there must equal the window's words.

Words are maximal runs of a-z, 0-9 and non-ASCII characters after A-Z are lowered. Both passes over the documents
explode word positions and join them at once, so only matches leave a task. The benchmark side is broadcast while
its counted rows stay within ``BROADCAST_ROWS``; beyond, positions are shuffled by shingle and candidates meet their
document again for the comparison, with the same rows as result.

Defined results: null and wordless texts have no words, no hits and are not contaminated; rows that repeat an id and
a text get equal results; items without words or without an id are left out, equal passages of several items count
for each; empty tables give no rows or no hits. Columns other than ids and texts are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessitura.llm.common import ascii_lower, keep

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same words before A-Z are lowered; enough to count them.
ANY_CASE_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WINDOW = 13
SHINGLE = 3
BROADCAST_ROWS = 200_000


def words_of(text: Column) -> Column:
    """Words of a text in order."""
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def _shingles(words: str, width: int) -> Column:
    """Hash of the ``width`` words from each position on; those at the end hold fewer and fail the length bound."""
    return F.transform(F.col(words), lambda w, i: F.xxhash64(w, *(F.get(F.col(words), i + k) for k in range(1, width))))


def item_windows(benchmark: DataFrame) -> DataFrame:
    """``item_id, window``, an array of words."""
    items = benchmark.select("item_id", words_of(F.col("text")).alias("words")).filter("item_id IS NOT NULL AND size(words) > 0")
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - (WINDOW - 1), F.lit(1)))
    return items.select("item_id", "words", F.explode(starts).alias("start")).select("item_id", F.slice("words", F.col("start"), WINDOW).alias("window")).distinct()


def _positions(docs: DataFrame, width: int, *more: str) -> DataFrame:
    """``doc_id, text_key, n_words, position, shingle`` of every word of every document."""
    return (
        docs.select("doc_id", F.xxhash64("text").alias("text_key"), words_of(F.col("text")).alias("words"))
        .select("doc_id", "text_key", "words", F.size("words").alias("n_words"), F.posexplode(_shingles("words", width)).alias("position", "shingle"))
        .select("doc_id", "text_key", "n_words", *more, "position", "shingle")
    )


def occurrences(docs: DataFrame, windows: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``doc_id, text_key, start, window`` of every window of ``windows(window)`` inside every document."""
    width = F.least(F.size("window"), F.lit(SHINGLE))
    offsets = F.sequence(F.lit(0), F.size("window") - width)
    parts = keep(
        windows.select("window", width.alias("width"), F.explode(offsets).alias("offset")).select(
            "window", "width", "offset", F.xxhash64(*(F.get("window", F.col("offset") + k) for k in range(SHINGLE))).alias("shingle")
        ),
        "window-shingles",
    )
    small = parts.count() <= broadcast_rows
    side = (lambda frame: F.broadcast(frame)) if small else (lambda frame: frame)
    found: DataFrame | None = None
    for own in (r["width"] for r in parts.select("width").distinct().collect()):
        mine = parts.filter(F.col("width") == own)
        frequency = _positions(docs, own).join(side(mine.select("shingle").distinct()), "shingle").groupBy("shingle").agg(F.count(F.lit(1)).alias("frequency"))
        rarest = keep(
            mine.join(frequency, "shingle").groupBy("window").agg(F.min(F.struct("frequency", "offset", "shingle")).alias("r"), F.count(F.lit(1)).alias("present"))
            .filter(F.col("present") == F.size("window") - own + 1)
            .select("window", F.col("r.offset").alias("offset"), F.col("r.shingle").alias("shingle")),
            "prefixes",
        )
        start = F.col("position") - F.col("offset")
        bounded = (start >= 0) & (start + F.size("window") <= F.col("n_words"))
        same = F.slice("words", F.col("start") + 1, F.size("window")) == F.col("window")
        meet = _positions(docs, own, *(["words"] if small else [])).join(side(rarest), "shingle").filter(bounded)
        if small:
            here = meet.withColumn("start", start).filter(same)
        else:
            whole = docs.select(F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_key"), words_of(F.col("text")).alias("words")).dropDuplicates(["_id", "_key"])
            places = meet.select("doc_id", "text_key", start.alias("start"), "window").distinct()
            here = places.join(whole, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key"))).filter(same)
        here = here.select("doc_id", "text_key", "start", "window")
        found = here if found is None else found.unionByName(here)
    if found is None:
        found = _positions(docs, 1).filter("false").select("doc_id", "text_key", F.col("position").alias("start"), F.array(F.lit("")).alias("window"))
    return found


def contamination(docs: DataFrame, benchmark: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated`` of every row, with the text's key."""
    docs = docs.select("doc_id", "text")
    items = keep(item_windows(benchmark.select("item_id", "text")), "windows")
    found = keep(occurrences(docs, items.select("window").distinct(), broadcast_rows).distinct(), "occurrences")
    end = F.col("start") + F.size("window")
    before = Window.partitionBy("doc_id", "text_key").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    spans = found.select("doc_id", "text_key", "start", end.alias("end")).distinct()
    fresh = F.greatest(F.col("end") - F.greatest("start", F.coalesce(F.max("end").over(before), F.lit(0))), F.lit(0))
    hits = spans.select("doc_id", "text_key", fresh.alias("fresh")).groupBy("doc_id", "text_key").agg(F.sum("fresh").alias("n_hit"))
    named = found.join(items, "window").select("doc_id", "text_key", F.col("item_id").cast("string").alias("item")).distinct()
    listed = named.groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_set("item")).alias("items"))
    by_doc = hits.join(listed.withColumnsRenamed({"doc_id": "_id", "text_key": "_key"}), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key"))).select(
        F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), "n_hit", "items"
    )
    sizes = docs.select("doc_id", F.xxhash64("text").alias("text_key"), F.regexp_count(F.coalesce("text", F.lit("")), F.lit(ANY_CASE_WORD)).cast("long").alias("n_words"))
    joined = sizes.join(by_doc, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key")), "left")
    n_hit, names = F.coalesce("n_hit", F.lit(0)).cast("long"), F.coalesce("items", F.array().cast("array<string>"))
    return joined.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size(names).cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ","), 256).alias("items_sha256"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
        "text_key",
    )


def without_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that are not contaminated, with all their columns."""
    bad = contamination(docs, benchmark).filter("contaminated").select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).distinct()
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["_id"]) & (F.xxhash64(docs["text"]) == bad["_key"]), "left_anti")
