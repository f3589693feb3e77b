"""Operator 5: benchmark decontamination with a positional inverted index. DataFrame functions only.

Benchmark items are cut into windows of consecutive words. The corpus frequency
of every benchmark word is counted over all documents, and each window is looked
up by its rarest words. One scan of the documents stores the postings (word,
document, position) of those words. A posting of the rarest word, less the word's
offset, is the only place where a window can start; the list of the next rarest
word, adjusted by its offset, is intersected with it (LISTS lists in all). The few
places left are compared in full with the document's words, a row per document.
Proximity search pairs the postings of the two rarest words.

Words and document keys are broadcast only while they are few (a checked count);
beyond that they are joined by a shuffle, which adaptive execution splits when a
word is frequent.

Defined results: a null or word-free text has no words and is clean; an item
without words has no window; repeated rows each give a row; items that repeat
count one by one; of equally rare words the smaller one counts as rarer; texts of
any length are read whole, and a row holds one document's words and candidates;
an empty table gives no row; other columns of the inputs are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinsight.llm.common import ascii_lower, written

NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Rows of the benchmark's words or windows up to which they are broadcast.
BROADCAST_ROWS = 100_000
#: Lists that are intersected before places are compared in full.
LISTS = 2


def words_of(text: Column) -> Column:
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), NOT_WORD, -1), lambda w: w != "")


def held(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def item_windows(items: DataFrame, length: int, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """window (array of words), item_id: one row per item and different window."""
    words = items.select(F.col(id_col).cast("string").alias("item_id"), words_of(F.col(text_col)).alias("w")).where(F.size("w") > 0)
    cut = F.when(F.size("w") < length, F.array("w")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - length + 1, F.lit(1))), lambda i: F.slice("w", i, length)))
    return words.select("item_id", F.explode(F.array_distinct(cut)).alias("window")).distinct()


def corpus_counts(docs: DataFrame, vocabulary: DataFrame, text_col: str = "text") -> DataFrame:
    """word, total: occurrences of the vocabulary's words in all documents."""
    n = vocabulary.count()
    spread = docs.select(F.explode(words_of(F.col(text_col))).alias("word"))
    return spread.join(held(vocabulary, n), "word").groupBy("word").agg(F.count("*").alias("total"))


def anchored(windows: DataFrame, counts: DataFrame, ranks: int = 1) -> DataFrame:
    """window_id, window, word, offset, rank: each window's rarest words, by their first offsets; windows with a word that the corpus lacks go."""
    spread = windows.select("window_id", "window", F.explode(F.array_distinct("window")).alias("word")).withColumn("offset", F.array_position("window", F.col("word")).cast("int") - 1)
    counted = spread.join(counts, "word", "left")
    by_window = Window.partitionBy("window_id")
    ranked = counted.withColumn("rank", F.row_number().over(by_window.orderBy("total", "word", "offset"))).withColumn("lacking", F.max(F.col("total").isNull()).over(by_window))
    return ranked.where(~F.col("lacking") & (F.col("rank") <= ranks)).select("window_id", "window", "word", "offset", "rank")


def postings(keyed: DataFrame, anchors: DataFrame) -> DataFrame:
    """The index: word, doc_id, content, position of every occurrence of the anchors' words. keyed: doc_id, content, text."""
    words = written(anchors.select("word").distinct(), "index-words")
    place = keyed.select("doc_id", "content", F.posexplode(words_of(F.col("text"))).alias("position", "word"))
    return written(place.join(held(words, words.count()), "word").select("word", "doc_id", "content", "position"), "postings")


def phrase_matches(keyed: DataFrame, anchors: DataFrame, index: DataFrame) -> DataFrame:
    """doc_id, content, start, length, window_id of every occurrence of a window."""
    rarest = anchors.where("rank = 1")
    start = F.col("position") - F.col("offset")
    places = index.join(held(rarest, rarest.count()), "word").where(start >= 0).select("doc_id", "content", start.alias("start"), "window_id").distinct()
    for rank in range(2, LISTS + 1):
        # where the next word must stand; windows of fewer different words pass
        due = places.join(anchors.where(F.col("rank") == rank).select("window_id", F.col("word").alias("due_word"), "offset"), "window_id", "left").withColumn("due", F.col("start") + F.col("offset"))
        stands = index.select(F.col("word").alias("due_word"), F.col("doc_id").alias("i_doc"), F.col("content").alias("i_content"), F.col("position").alias("due"))
        same = (F.col("i_content") == F.col("content")) & F.col("i_doc").eqNullSafe(F.col("doc_id"))
        met = due.where("due_word IS NOT NULL").alias("l").join(stands.alias("r"), (F.col("l.due_word") == F.col("r.due_word")) & (F.col("l.due") == F.col("r.due")) & same, "left_semi")
        places = met.unionByName(due.where("due_word IS NULL")).select("doc_id", "content", "start", "window_id")
    places = written(places, "places")
    texts = anchors.where("rank = 1").select("window_id", "window")
    listed = places.join(texts, "window_id").groupBy(F.col("doc_id").alias("p_doc"), F.col("content").alias("p_content")).agg(F.collect_list(F.struct("start", "window_id", "window")).alias("places"))
    keys = written(places.select(F.col("doc_id").alias("k_doc"), F.col("content").alias("k_content")).distinct(), "place-keys")
    some = keyed.join(held(keys, keys.count()), F.col("doc_id").eqNullSafe(F.col("k_doc")) & (F.col("content") == F.col("k_content")), "left_semi")
    joined = some.join(listed, F.col("doc_id").eqNullSafe(F.col("p_doc")) & (F.col("content") == F.col("p_content"))).withColumn("words", words_of(F.col("text")))
    whole = F.filter("places", lambda x: F.slice("words", x["start"] + 1, F.size(x["window"])) == x["window"])
    return joined.select("doc_id", "content", F.explode(whole).alias("m")).select("doc_id", "content", "m.start", F.size("m.window").alias("length"), "m.window_id")


def proximity_matches(docs: DataFrame, items: DataFrame, slop: int = 20, length: int = 10) -> DataFrame:
    """doc_id, item_id of documents in which a window's two rarest words lie within `slop` words of each other."""
    keyed = with_content(docs)
    windows, counts = prepared(keyed, items, length)
    two = anchored(windows, counts, ranks=2)
    listed = postings(keyed, two).join(two.select("window_id", "word", "rank").distinct(), "word")
    # equal or neighbouring stretches of slop words, then the exact distance
    first = listed.where("rank = 1").select("doc_id", "content", "window_id", F.col("position").alias("p"), F.explode(F.array(*[F.floor(F.col("position") / slop) + d for d in (-1, 0, 1)])).alias("stretch"))
    second = listed.where("rank = 2").select("doc_id", "content", "window_id", F.col("position").alias("q"), F.floor(F.col("position") / slop).alias("stretch"))
    near = first.join(second, ["doc_id", "content", "window_id", "stretch"]).where(F.abs(F.col("p") - F.col("q")) <= slop)
    return near.select("doc_id", "window_id").distinct().join(windows.select("window_id", F.explode("items").alias("item_id")), "window_id").select("doc_id", "item_id").distinct()


def with_content(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("content"))


def prepared(keyed: DataFrame, items: DataFrame, length: int) -> tuple[DataFrame, DataFrame]:
    """The different windows with their items, and the counts of their words."""
    windows = item_windows(items, length).groupBy("window").agg(F.collect_set("item_id").alias("items"))
    windows = written(windows.withColumn("window_id", F.monotonically_increasing_id()), "windows")
    vocabulary = windows.select(F.explode("window").alias("word")).distinct()
    return windows, written(corpus_counts(keyed, vocabulary), "word-counts")


def decontaminate(docs: DataFrame, items: DataFrame, length: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, content (hash of its text), n_words, n_hit, n_items, items_sha256, contaminated."""
    keyed = with_content(docs, id_col, text_col)
    windows, counts = prepared(keyed, items, length)
    anchors = written(anchored(windows, counts, LISTS), "anchors")
    found = written(phrase_matches(keyed, anchors, postings(keyed, anchors)).distinct(), "phrase-matches")
    key = ["doc_id", "content"]
    end = F.col("start") + F.col("length")
    # overlapping occurrences count once: what each adds beyond the furthest end before it
    earlier = Window.partitionBy(*key).orderBy("start", "length", "window_id").rowsBetween(Window.unboundedPreceding, -1)
    adds = F.greatest(end - F.greatest("start", F.coalesce(F.max(end).over(earlier), F.lit(0))), F.lit(0))
    hits = found.withColumn("adds", adds).groupBy(*key).agg(F.sum("adds").alias("n_hit"))
    by_item = found.select(*key, "window_id").distinct().join(windows.select("window_id", F.explode("items").alias("item_id")), "window_id").select(*key, "item_id").distinct()
    met = by_item.groupBy(*key).agg(F.count("*").alias("n_items"), F.sha2(F.array_join(F.sort_array(F.collect_list("item_id")), ","), 256).alias("items_sha256"))
    dirty = hits.join(met, (hits.doc_id.eqNullSafe(met.doc_id)) & (hits.content == met.content)).select(hits.doc_id.alias("d_id"), hits.content.alias("d_content"), "n_hit", "n_items", "items_sha256")
    sized = keyed.select("doc_id", "content", F.size(words_of(F.col("text"))).cast("long").alias("n_words"))
    told = sized.join(dirty, F.col("doc_id").eqNullSafe(F.col("d_id")) & (F.col("content") == F.col("d_content")), "left")
    return told.select(
        "doc_id", "content", "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, length: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, with all their columns, that share no window with the benchmark."""
    dirty = decontaminate(docs, items, length, id_col, text_col).where("contaminated").select(F.col("doc_id").alias("_id"), F.col("content").alias("_content")).distinct()
    return docs.join(dirty, F.col(id_col).eqNullSafe(F.col("_id")) & (F.xxhash64(text_col) == F.col("_content")), "left_anti")
