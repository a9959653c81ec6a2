"""Passages of benchmark items in documents, by a prefix-filtered set join.

A window of item words occurs in a document only if all its shingles of two words do, so it is
enough to look for one of them, its prefix: the one that the fewest documents have. Document
positions with such a shingle carry the words around them to the join; there the place of the
shingle in the window says where the window would begin and end, and only what fits into the
document is compared word by word.

Up to a fixed number of item shingles are looked for as constants, which saves most of the work of putting
document shingles together. More of them stay a table, with which the shingles of all documents are joined.
Either way documents are passed over twice, to count and to find, however many items there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemart.llm.tables import ascii_lower, stored

WINDOW = 10
#: Up to so many shingles of items pass through the driver and are looked for as constants.
CONSTANTS = 20_000
_OTHER = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), _OTHER), lambda w: w != "")


def item_windows(items: DataFrame, size: int = WINDOW) -> DataFrame:
    """``item_id``, ``window`` (array) of every item: ``size`` consecutive words, or all of a shorter one."""
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - size + 1))
    windows = F.transform(starts, lambda i: F.slice(F.col("w"), i, size))
    return (items.select("item_id", words_of(F.col("text")).alias("w")).where(F.size("w") > 0)
            .select("item_id", F.explode(windows).alias("window")).distinct())


def _shingle(words: Column, at: Column) -> Column:
    """Two words from a place on, or the last word alone."""
    return F.concat_ws(" ", F.slice(words, at, 2))


def _places(words: Column, found) -> Column:
    """Places, counted from 1, of a word array for which ``found`` holds."""
    return F.when(F.size(words) > 0, F.filter(F.sequence(F.lit(1), F.size(words)), found)).otherwise(
        F.array().cast("array<int>"))


def _let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once, however often ``body`` uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _few(tokens: DataFrame) -> list[str] | None:
    """The tokens in order if they are few enough to be constants, else None."""
    found = [r.token for r in tokens.select("token").distinct().limit(CONSTANTS + 1).collect()]
    return sorted(found) if len(found) <= CONSTANTS else None


def _every_token(words: Column, alone: bool) -> Column:
    """Place and shingle of every place of a document; with ``alone`` the word at a place as well."""
    def entries(i: Column) -> Column:
        pair = F.struct(i.alias("place"), _shingle(words, i).alias("token"))
        return F.array(pair, F.struct(i.alias("place"), F.element_at(words, i).alias("token"))) if alone else F.array(pair)
    return F.flatten(F.transform(_places(words, lambda i: F.lit(True)), entries))


def _has(words: Column, at: Column, wanted: list[str], alone: list[str]) -> Column:
    """Whether a wanted shingle begins at a place; its first word is looked up before it is put together."""
    firsts = sorted({w.split(" ")[0] for w in wanted})
    word = F.element_at(words, at)
    hit = word.isin(firsts) & _shingle(words, at).isin(wanted)
    return hit | word.isin(alone) if alone else hit


def prefixes(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """``window``, ``token``, ``at``: the shingle of each window that the fewest documents have, and its place.

    A window of one word has that word. Documents are counted over the whole table; ties go to the
    smaller shingle.
    """
    each = windows.select("window").distinct()
    count = F.greatest(F.lit(1), F.size("window") - 1)
    shingles = each.select("window", F.posexplode(F.transform(
        F.sequence(F.lit(1), count), lambda i: _shingle(F.col("window"), i))).alias("at", "token"))
    tokens = shingles.where(F.size("window") > 1).select("token").distinct()
    constants = _few(tokens)
    words = words_of(F.col("text"))
    if constants is None:
        of_docs = docs.select(F.explode(_let(words, lambda w: F.array_distinct(
            F.transform(_every_token(w, False), lambda e: e["token"])))).alias("token")).join(stored(tokens, "tokens"), "token", "left_semi")
    else:
        of_docs = docs.select(F.explode(_let(words, _counter(constants))).alias("token"))
    rare = F.row_number().over(Window.partitionBy("window").orderBy("docs", "token", "at"))
    if constants != []:
        seen = of_docs.groupBy("token").agg(F.count(F.lit(1)).alias("docs"))
        ranked = shingles.join(seen, "token", "left").fillna(0, ["docs"])
    else:
        ranked = shingles.withColumn("docs", F.lit(0))
    return (ranked.withColumn("rank", rare).where("rank = 1")
            .select("window", "token", (F.col("at") + 1).alias("at")))


def _counter(pairs: list[str]):
    """The wanted shingles of a document, each once."""
    return lambda w: F.array_distinct(F.transform(
        _places(w, lambda i: _has(w, i, pairs, [])), lambda i: _shingle(w, i)))


def _entries(words: Column, places: Column, size: int) -> Column:
    """The number of words, and for each place the words around it.

    A first entry without a place stands for the document itself.
    """
    def entry(i: Column) -> Column:
        first = F.greatest(F.lit(1), i - size + 2)
        return F.struct(i.alias("place"), first.alias("first"), F.slice(words, first, 2 * size).alias("near"))
    own = F.array(F.struct(F.lit(0).alias("place"), F.lit(0).alias("first"), F.array().cast("array<string>").alias("near")))
    return F.struct(F.size(words).cast("long").alias("n_words"), F.concat(own, F.transform(places, entry)).alias("found"))


def _found(docs: DataFrame, tokens: DataFrame, size: int) -> DataFrame:
    """``doc_id``, ``text_hash``, ``n_words`` and ``place``, ``first``, ``near`` of each place of a token in a document."""
    words, own = words_of(F.col("text")), docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    constants = _few(tokens)
    if constants is not None:
        pairs, alone = [t for t in constants if " " in t], [t for t in constants if " " not in t]
        found = own.withColumn("f", _let(words, lambda w: _entries(w, _places(w, lambda i: _has(w, i, pairs, alone)), size)))
    else:
        tokens = stored(tokens.select("token").distinct(), "tokens")
        every = own.select("doc_id", "text_hash", F.inline(_let(words, lambda w: _every_token(w, True))))
        # A document's places are as many as its words at most.
        places = (every.join(tokens, "token", "left_semi").groupBy("doc_id", "text_hash").agg(F.collect_set("place").alias("places"))
                  .withColumnsRenamed({"doc_id": "_id", "text_hash": "_hash"}))
        found = own.join(places, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash")), "left").withColumn(
            "f", _let(words, lambda w: _entries(w, F.coalesce("places", F.array().cast("array<int>")), size)))
    return found.select("doc_id", "text_hash", "f.n_words", F.inline("f.found"))


def contamination(docs: DataFrame, items: DataFrame, size: int = WINDOW) -> DataFrame:
    """Per row: ``doc_id``, ``text_hash``, ``n_words``, ``n_hit``, ``n_items``, ``items_sha256``, ``contaminated``.

    A NULL or empty text has no words and is clean; so is everything if there are no items. Items
    without words have no windows; items without id hit words but are not counted. Repeated rows
    are repeated in the result.
    """
    windows = stored(item_windows(items, size), "windows")
    chosen = stored(prefixes(docs, windows), "prefixes")
    places = _found(docs, chosen, size)

    # The shingle at a place, and its first word for windows of one word.
    at_place = F.col("place") - F.col("first") + 1
    keys = F.when(F.col("place") > 0, F.array_distinct(F.array(
        _shingle(F.col("near"), at_place), F.try_element_at("near", at_place)))).otherwise(F.array(F.lit("")))
    keyed = places.withColumn("token", F.explode(keys))
    # Stored, so that its size decides whether it is broadcast.
    window = stored(chosen.join(windows, "window").select(
        "token", "at", "window", F.size("window").alias("size"), "item_id"), "item-windows")
    start = F.col("place") - F.col("at") + 1
    fits = (start >= 1) & (start + F.col("size") - 1 <= F.col("n_words"))
    same = F.slice("near", F.greatest(F.lit(1), start - F.col("first") + 1), F.col("size")) == F.col("window")
    met = keyed.join(window, "token", "left").withColumn("hit", F.coalesce(fits & same, F.lit(False)))
    by_row = met.groupBy("doc_id", "text_hash", "n_words").agg(
        F.count(F.when(F.col("place") == 0, 1)).alias("copies"),
        F.collect_set(F.when(F.col("hit"), F.struct(start.alias("start"), "size"))).alias("spans"),
        F.collect_set(F.when(F.col("hit"), F.col("item_id").cast("string"))).alias("items"))
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("hit"))

    def grow(acc: Column, span: Column) -> Column:
        end = span["start"] + span["size"] - 1
        new = F.greatest(F.lit(0), end - F.greatest(acc["end"], span["start"] - 1))
        return F.struct(F.greatest(acc["end"], end).alias("end"), (acc["hit"] + new).alias("hit"))

    n_hit = F.aggregate(F.array_sort("spans"), zero, grow)["hit"]
    return (by_row.select("doc_id", "text_hash", "n_words", n_hit.alias("n_hit"),
                          F.size("items").cast("long").alias("n_items"),
                          F.sha2(F.concat_ws(",", F.array_sort("items")), 256).alias("items_sha256"),
                          F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
            .drop("col").withColumn("contaminated", F.col("n_hit") > 0))


def drop_contaminated(docs: DataFrame, items: DataFrame, size: int = WINDOW) -> DataFrame:
    """The documents without a benchmark passage, all columns kept; repeated rows go together."""
    dirty = (contamination(docs, items, size).where("contaminated")
             .select(F.col("doc_id").alias("_dirty_id"), F.col("text_hash").alias("_dirty_hash")).distinct())
    return docs.join(dirty, docs["doc_id"].eqNullSafe(F.col("_dirty_id"))
                     & (F.xxhash64(docs["text"]) == F.col("_dirty_hash")), "left_anti")
