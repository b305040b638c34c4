"""Benchmark decontamination as a prefix-filtered set join, in DataFrame operations alone.

An item is cut into windows of ``window`` consecutive words (one window, if it has fewer). A window's shingles are its
word pairs (the word, for a window of one). Shingles are ordered by rarity, counted over all documents. As a window has
to be contained whole, its necessary prefix is one shingle: the rarest. Documents meet the windows on that shingle; the
length bound (the document is as long as the window at least) and the positional bound (the window, laid so that the
shingles coincide, lies within the document) come before the exact comparison of all words of the window.

Windows, their shingles and their items are counted first, with their bytes. Up to ``max_broadcast`` rows each and
``MAX_BYTES`` they are broadcast, and documents are searched where they are. Beyond that, documents send the hash and the
place of each shingle that a bitmap of fixed size lets pass, without words; only those that have a candidate meet their
words again for the exact comparison.

Defined results: a null text has no words; an item without words has no windows; a null item_id is left out of the
item list. Repeated rows each get their result; an empty table gives an empty result, and an empty benchmark no hits.
Columns beside the named ones are not read, and stay in remove() whatever their names are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import Scratch, ascii_lower, need, new_names
from cairn.llm.groups import sieve

WINDOW = 10
MAX_BROADCAST = 200_000
MAX_BYTES = 32 << 20  # of the windows' words
_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), _BREAK), "")


def _key(docs: DataFrame, key: str, text: str) -> list[Column]:
    """Rows of one id but different texts are told apart; equal rows share their result."""
    return [docs[key].alias("__id"), F.xxhash64(docs[text]).alias("__text")]


def _positions(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Each word with its place and its text's words. The outer form keeps the optimiser from splitting texts twice."""
    split = docs.select(*_key(docs, key, text), words(docs[text]).alias("words"))
    return split.select("__id", "__text", "words", F.posexplode_outer("words").alias("at", "word"))


def windows_of(items: DataFrame, window: int, key: str, text: str) -> DataFrame:
    """window_id, window (its words) and item for each window of each item."""
    split = items.select(items[key].alias("item"), words(items[text]).alias("words")).where(F.size("words") > 0)
    cut = split.withColumn("begin", F.explode(F.sequence(F.lit(0), F.greatest(F.size("words") - window, F.lit(0)))))
    return cut.select("item", F.slice("words", F.col("begin") + 1, F.lit(window)).alias("window")).select(F.sha2(F.array_join("window", " "), 256).alias("window_id"), "window", "item").distinct()


def _pair(word: Column, following: Column) -> Column:
    return F.xxhash64(word, following)


def _single(word: Column) -> Column:
    return F.xxhash64(word, F.lit(1))


def _fits(windows: DataFrame, shingles: DataFrame, max_broadcast: int) -> bool:
    """Whether windows with their items, and shingles, may be broadcast: each of the frames is small enough."""
    rows, size = windows.agg(F.count(F.lit(1)), F.sum(F.octet_length(F.array_join("window", " ")))).first()
    return max(rows, shingles.count()) <= max_broadcast and (size or 0) <= MAX_BYTES


def _places(docs: DataFrame, key: str, text: str, single: bool) -> DataFrame:
    """The hash and place of each shingle of each document, without its words."""
    split = docs.select(*_key(docs, key, text), words(docs[text]).alias("words")).where(F.size("words") > 0)
    pair = F.transform(F.sequence(F.lit(0), F.size("words") - 1), lambda i: _pair(F.get("words", i), F.coalesce(F.get("words", i + 1), F.lit(""))))
    shingles = F.transform("words", _single) if single else pair
    return split.select("__id", "__text", F.size("words").alias("n_words"), F.posexplode(shingles).alias("at", "shingle"))


def _hits_by_broadcast(docs: DataFrame, key: str, text: str, windows: DataFrame, shingles: DataFrame, scratch: Scratch) -> DataFrame:
    pairs = _positions(docs, key, text).withColumn("shingle", _pair(F.col("word"), F.coalesce(F.get("words", F.col("at") + 1), F.lit(""))))
    counted = pairs.join(F.broadcast(shingles.where("not single").select("shingle").distinct()), "shingle").groupBy("shingle").agg(F.count(F.lit(1)).alias("n"))
    prefix = _prefixes(shingles.where("not single"), scratch.table(counted, "rarity"), scratch).join(windows, "window_id")

    def verified(candidates: DataFrame) -> DataFrame:
        begin = F.col("at") - F.col("off")
        bounded = candidates.where((F.size("words") >= F.size("window")) & (begin >= 0) & (begin + F.size("window") <= F.size("words")))
        return bounded.where(F.slice("words", begin + 1, F.size("window")) == F.col("window")).select("__id", "__text", begin.alias("begin"), (begin + F.size("window")).alias("end"), "window_id")

    hits = verified(pairs.join(F.broadcast(prefix), "shingle"))
    single = windows.where(F.size("window") == 1).select("window_id", "window", F.lit(0).alias("off"), F.get("window", F.lit(0)).alias("word"))
    if not single.isEmpty():
        hits = hits.unionByName(verified(_positions(docs, key, text).join(F.broadcast(single), "word")))
    return hits


def _hits_by_shuffle(docs: DataFrame, key: str, text: str, windows: DataFrame, shingles: DataFrame, scratch: Scratch) -> DataFrame:
    candidates = None
    for single in (False, True):
        own = shingles.where(F.col("single") == single)
        if own.isEmpty():
            continue
        asked = sieve(own, ["shingle"], scratch, f"sieve{single}")
        places = asked(_places(docs, key, text, single), "maybe", "shingle").where("maybe").drop("maybe")
        counted = places.groupBy("shingle").agg(F.count(F.lit(1)).alias("n")).join(own.select("shingle").distinct(), "shingle")
        prefix = _prefixes(own, scratch.table(counted, f"rarity{single}"), scratch, f"prefix{single}")
        begin = F.col("at") - F.col("off")
        bounded = places.join(prefix, "shingle").where((begin >= 0) & (begin + F.col("size") <= F.col("n_words")))
        found = bounded.select("__id", "__text", begin.alias("begin"), "window_id")
        candidates = found if candidates is None else candidates.unionByName(found)
    if candidates is None:
        return windows.select(F.lit(None).cast(docs.schema[key].dataType).alias("__id"), F.lit(0).cast("long").alias("__text"), F.lit(0).alias("begin"), F.lit(0).alias("end"), "window_id").limit(0)
    candidates = scratch.table(candidates.join(windows, "window_id").groupBy("__id", "__text").agg(F.collect_set(F.struct("begin", "window_id", "window")).alias("held")), "candidates").withColumnsRenamed({"__id": "__i", "__text": "__t"})
    texts = docs.select(*_key(docs, key, text), words(docs[text]).alias("words"))
    met = texts.join(candidates, texts["__id"].eqNullSafe(candidates["__i"]) & (texts["__text"] == candidates["__t"]))
    right = F.filter("held", lambda c: F.slice("words", c["begin"] + 1, F.size(c["window"])) == c["window"])
    hit = met.select("__id", "__text", F.explode(right).alias("hit"))
    return hit.select("__id", "__text", "hit.begin", (F.col("hit.begin") + F.size("hit.window")).alias("end"), "hit.window_id")


def _prefixes(shingles: DataFrame, rarity: DataFrame, scratch: Scratch, name: str = "prefix") -> DataFrame:
    """The rarest shingle of each window. A window with a shingle that no document has can't occur."""
    ranked = shingles.join(rarity, "shingle", "left").groupBy("window_id").agg(F.min_by(F.struct("off", "shingle", "size"), F.struct(F.coalesce("n", F.lit(0)), "shingle", "off")).alias("best"), F.min(F.coalesce("n", F.lit(0))).alias("n"))
    return scratch.table(ranked.where("n > 0").select("window_id", "best.*"), name)


def mark(docs: DataFrame, items: DataFrame, window: int = WINDOW, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """id and text hash of each contaminated document (__id, __text), with n_hit and its items in order."""
    need(docs, key, text)
    need(items, item_key, item_text)
    scratch = Scratch(docs.sparkSession, "decontaminate")
    found = scratch.table(windows_of(items, window, item_key, item_text), "windows")
    distinct = scratch.table(found.select("window_id", "window").distinct(), "distinct_windows")
    last = F.greatest(F.size("window") - 1, F.lit(1))
    shingles = distinct.select("window_id", "window", F.size("window").alias("size"), F.posexplode(F.sequence(F.lit(1), last)).alias("off", "next"))
    shingle = F.when(F.col("size") == 1, _single(F.get("window", F.lit(0)))).otherwise(_pair(F.get("window", F.col("off")), F.get("window", F.col("next"))))
    shingles = scratch.table(shingles.select("window_id", "size", "off", shingle.alias("shingle"), (F.col("size") == 1).alias("single")), "shingles")
    small = _fits(found, shingles, max_broadcast)
    hits = (_hits_by_broadcast if small else _hits_by_shuffle)(docs, key, text, distinct, shingles, scratch)
    hint = F.broadcast if small else lambda df: df
    of_item = hits.join(hint(found.select("window_id", "item")), "window_id")
    spans = F.array_sort(F.collect_set(F.struct("begin", "end")))
    covered = F.aggregate(spans, F.struct(F.lit(0).alias("n"), F.lit(0).alias("upto")), lambda a, s: F.struct((a["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(a["upto"], s["begin"]))).alias("n"), F.greatest(a["upto"], s["end"]).alias("upto")))
    return of_item.groupBy("__id", "__text").agg(covered["n"].cast("long").alias("n_hit"), F.array_sort(F.collect_set(F.col("item").cast("string"))).alias("items"))


def report(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """n_words, n_hit, items and contaminated for every row."""
    base = docs.select(*_key(docs, key, text), docs[key].alias(key), F.size(words(docs[text])).cast("long").alias("n_words"))
    marked = mark(docs, items, key=key, text=text, **options).select(F.col("__id").alias("__i"), F.col("__text").alias("__t"), "n_hit", "items")
    both = base.join(marked, base["__id"].eqNullSafe(marked["__i"]) & (base["__text"] == marked["__t"]), "left")
    hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return both.select(key, "n_words", hit.alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), (hit > 0).alias("contaminated"))


def remove(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows without any window of an item."""
    k, t, i, h = new_names(docs, "k", "t", "id", "hash")
    marked = mark(docs, items, key=key, text=text, **options).select("__id", "__text").toDF(i, h)
    keyed = docs.withColumns({k: docs[key], t: F.xxhash64(docs[text])})
    return keyed.join(marked, keyed[k].eqNullSafe(marked[i]) & (keyed[t] == marked[h]), "left_anti").select(*docs.columns)
