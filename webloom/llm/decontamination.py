"""Benchmark decontamination: a positional inverted index of training tokens, intersected from the rarest test terms (DataFrame operations only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_stash, stash

#: Words of a window, terms of it whose lists are intersected, and how far a term may stand from its place in a proximity match.
WIDTH, RAREST, SLOP = 10, 3, 3
#: Largest tables of terms and of document keys that are broadcast; beyond it they are joined by a shuffle.
BROADCAST_BYTES = 4 << 20

#: What stands between words, once A-Z count as their lower-case letters.
_BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _split(text: Column) -> Column:
    """Words as they are written; the first and the last may be empty."""
    return F.split(F.coalesce(text, F.lit("")), _BETWEEN, -1)


def _low(word: Column) -> Column:
    """A-Z lower-cased, and nothing else: lower() only where a word is ASCII."""
    return F.when(F.octet_length(word) == F.char_length(word), F.lower(word)).otherwise(F.translate(word, _UPPER, _LOWER))


def _n_words(words: Column) -> Column:
    return F.greatest(F.lit(0), F.size(words) - (F.element_at(words, 1) == "").cast("int") - (F.element_at(words, -1) == "").cast("int")).cast("long")


def _small(df: DataFrame, row_bytes: int) -> DataFrame:
    """df, to be broadcast if a count shows that it is small."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df


def _marks(phrase: Column) -> list[Column]:
    """128 bits that stand for a phrase."""
    return [F.xxhash64(phrase), F.xxhash64(F.reverse(phrase))]


def test_windows(items: DataFrame, width: int = WIDTH, id_col: str = "item_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Distinct windows of the test texts, and the sets of items that share a window.

    Windows: h1, h2 (of the words), len, set_id, terms (hashes by offset). Sets: set_id, items.
    """
    words = F.filter(F.transform(_split(F.col(text_col)), _low), lambda w: w != "")
    whole = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), words.alias("w")).where("size(w) > 0")
    cut = F.when(F.size("w") < width, F.array("w")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - width + 1, F.lit(1))), lambda i: F.slice("w", i, width)))
    each = whole.select("item", F.explode(cut).alias("w")).groupBy("w").agg(F.array_sort(F.collect_set("item")).alias("items"))
    each = stash(each.select(*[c.alias(n) for c, n in zip(_marks(F.array_join("w", " ")), ("h1", "h2"), strict=True)], F.size("w").alias("len"), F.xxhash64("items").alias("set_id"), "items", F.transform("w", lambda x: F.xxhash64(x)).alias("terms")), "leak-windows")
    return each.drop("items"), each.select("set_id", "items").dropDuplicates(["set_id"])


def _tokens(docs: DataFrame, *keep: str, longest: int) -> DataFrame:
    """A row a word: hash and place, beside the columns to keep."""
    each = docs.select(*keep, F.posexplode(_split(F.col("text"))).alias("pos", "word")).where(F.octet_length("word").between(1, longest))
    return each.select(*keep, "pos", F.xxhash64(_low(F.col("word"))).alias("term"))


def anchor_groups(windows: DataFrame, counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """For every window its rarest terms; windows with the same ones at the same distances make a group.

    Groups: group, n_lists, nth, term, delta (places after the rarest one). Members: group, list of windows (first: place
    of the rarest term in the window). A window with a term that no document has is left out.
    """
    own = windows.select("h1", "h2", F.posexplode("terms").alias("offset", "term")).groupBy("h1", "h2", "term").agg(F.min("offset").alias("offset"))
    known = own.join(counts, "term", "left")
    nth = F.row_number().over(Window.partitionBy("h1", "h2").orderBy(F.coalesce("n", F.lit(0)), "term"))
    rare = known.withColumn("nth", nth).where(F.col("nth") <= RAREST).groupBy("h1", "h2").agg(F.array_sort(F.collect_list(F.struct("nth", "term", "offset"))).alias("rare"), F.min(F.coalesce("n", F.lit(0))).alias("least"))
    rare = rare.where("least > 0").withColumn("first", F.col("rare")[0]["offset"]).withColumn("lists", F.transform("rare", lambda x: F.struct(x["nth"].alias("nth"), x["term"].alias("term"), (x["offset"] - F.col("first")).alias("delta"))))
    keyed = windows.join(rare.select("h1", "h2", "first", "lists"), ["h1", "h2"]).withColumn("group", F.xxhash64("lists"))
    groups = keyed.dropDuplicates(["group"]).select("group", F.size("lists").alias("n_lists"), F.inline("lists"))
    members = keyed.groupBy("group").agg(F.collect_list(F.struct("first", "len", "h1", "h2", "set_id")).alias("members"))
    return groups, members


def build_index(docs: DataFrame, terms: DataFrame, longest: int) -> DataFrame:
    """Positional inverted index of the given terms: term, doc_id, text_key and the places of the term in the document.

    A document is its id and its text's hash, so equal rows are one entry.
    """
    found = _tokens(docs, "doc_id", "text_key", longest=longest).join(_small(terms, 16), "term")
    return found.groupBy("term", "doc_id", "text_key").agg(F.collect_set("pos").alias("places"))


def intersect(index: DataFrame, groups: DataFrame, slop: int = SLOP) -> DataFrame:
    """Per group and document: places at which all its lists, adjusted by their offsets, meet (exact), or nearly (near).

    A near place is one of the rarest term around which every other term stands within ``slop`` words of where it should.
    """
    shifted = index.join(_small(groups, 40), "term").select("group", "n_lists", "doc_id", "text_key", "nth", F.transform("places", lambda p: p - F.col("delta")).alias("at"))
    met = shifted.groupBy("group", "doc_id", "text_key").agg(F.first("n_lists").alias("n_lists"), F.array_sort(F.collect_list(F.struct("nth", "at"))).alias("lists")).where("size(lists) = n_lists")
    rarest, others = F.col("lists")[0]["at"], F.slice("lists", 2, RAREST)
    around = lambda at: F.flatten(F.transform(at, lambda p: F.sequence(p - slop, p + slop)))
    exact = F.aggregate(others, rarest, lambda kept, x: F.array_intersect(kept, x["at"]))
    near = F.aggregate(others, rarest, lambda kept, x: F.array_intersect(kept, around(x["at"])))
    return met.select("group", "doc_id", "text_key", exact.alias("exact"), near.alias("near")).where("size(near) > 0")


def find_matches(docs: DataFrame, items: DataFrame, width: int = WIDTH, slop: int = SLOP) -> tuple[DataFrame, DataFrame]:
    """Exact phrase and proximity matches of test windows in documents (doc_id, text), and the sets of items.

    Matches, one row a document and text that has any: doc_id, text_key, spans (start word and length of each exact
    match, of words from 0 on, or from 1 where the text begins with something else), sets (set_ids of the windows that
    occur) and near_sets (of those that occur or nearly do).
    """
    windows, sets = test_windows(items, width)
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("text_key"))
    terms = windows.select(F.explode("terms").alias("term")).distinct()
    longest = items.select(F.coalesce(F.max(F.octet_length("text")), F.lit(0))).first()[0]
    counts = stash(_tokens(docs, longest=longest).join(_small(terms, 16), "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("n")), "leak-counts")
    groups, members = (stash(df, f"leak-{n}") for df, n in zip(anchor_groups(windows, counts), ("groups", "members"), strict=True))
    index = stash(build_index(docs, groups.select("term").distinct(), longest), "leak-index")
    met = intersect(index, groups, slop).join(members, "group")
    spread = lambda at, m: F.transform(at, lambda p: F.struct((p - m["first"]).alias("start"), m["len"].alias("len"), m["h1"].alias("h1"), m["h2"].alias("h2"), m["set_id"].alias("set_id")))
    met = met.select("doc_id", "text_key", F.flatten(F.transform("members", lambda m: spread(F.col("exact"), m))).alias("places"), F.transform("members", lambda m: m["set_id"]).alias("near"))
    found = stash(met.groupBy("doc_id", "text_key").agg(F.flatten(F.collect_list("places")).alias("places"), F.array_distinct(F.flatten(F.collect_list("near"))).alias("near_sets")), "leak-found")
    drop_stash(index)
    # what the rarest terms have brought up is compared as a whole, with the document's own words
    keys = found.withColumnsRenamed({"doc_id": "_doc", "text_key": "_key"})
    texts = docs.join(_small(found.select(F.col("doc_id").alias("_doc"), F.col("text_key").alias("_key")), 24), F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("text_key") == F.col("_key")), "left_semi").dropDuplicates(["doc_id", "text_key"])
    both = texts.join(keys, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("text_key") == F.col("_key"))).select("doc_id", "text_key", F.transform(_split(F.col("text")), _low).alias("words"), "places", "near_sets")

    def same(p: Column) -> Column:
        phrase = F.array_join(F.slice("words", p["start"] + 1, p["len"]), " ")
        marks = _marks(phrase)
        return (p["start"] >= 0) & (marks[0] == p["h1"]) & (marks[1] == p["h2"])

    held = both.withColumn("held", F.filter("places", same))
    out = held.select("doc_id", "text_key", F.array_distinct(F.transform("held", lambda p: F.struct(p["start"].alias("start"), p["len"].alias("len")))).alias("spans"), F.array_sort(F.array_distinct(F.transform("held", lambda p: p["set_id"]))).alias("sets"), "near_sets")
    matches = stash(out, "leak-matches")
    drop_stash(found, groups, members, counts)
    return matches, sets


def decontaminate(docs: DataFrame, items: DataFrame, width: int = WIDTH, slop: int = SLOP) -> DataFrame:
    """Which documents hold windows of test items, how many of their words are inside one, and of which items.

    Words are what stands between ASCII characters other than letters and digits, A-Z as a-z. A window is ``width``
    consecutive words of an item, or all words of a shorter one. Document words are counted once per distinct term of the
    test; for every window the lists of its RAREST rarest terms are intersected, adjusted by their offsets,
    and what they bring up is compared with the document's words.

    Null or empty texts have no words. Rows with null or repeated ids are judged by their own texts; equal rows have equal
    results. Items of one id count once, with null as an id of its own, written as an empty string. Empty tables give an
    empty result or clean documents; columns other than doc_id, item_id and text are ignored.

    Returns doc_id, n_words, n_hit, n_items, items_sha256 (of their ids, sorted as strings), contaminated, n_near (items
    of which a window occurs, or has its rarest terms within ``slop`` words of their places).
    """
    matches, sets = find_matches(docs, items, width, slop)
    ends = F.array_sort("spans")
    start = {"upto": F.lit(0), "n": F.lit(0).cast("long")}
    covered = F.aggregate(
        ends,
        F.struct(*[v.alias(k) for k, v in start.items()]),
        lambda a, s: F.struct(F.greatest(a["upto"], s["start"] + s["len"]).alias("upto"), (a["n"] + F.greatest(F.lit(0), s["start"] + s["len"] - F.greatest(a["upto"], s["start"]))).alias("n")),
        lambda a: a["n"],
    )
    hit = matches.select("doc_id", "text_key", covered.alias("n_hit"), F.xxhash64("sets").alias("sets_key"), "sets", F.array_sort("near_sets").alias("near_sets")).withColumn("near_key", F.xxhash64("near_sets"))
    # documents with the same sets of items have the same items: each list is made once
    kinds = hit.select(F.col("sets_key").alias("kind"), F.col("sets").alias("of")).union(hit.select("near_key", "near_sets")).dropDuplicates(["kind"])
    listed = kinds.select("kind", F.explode("of").alias("set_id")).join(sets, "set_id").select("kind", F.explode("items").alias("item")).distinct().groupBy("kind").agg(F.array_sort(F.collect_list("item")).alias("items"))
    listed = listed.select("kind", F.size("items").cast("long").alias("n"), F.sha2(F.array_join("items", ","), 256).alias("sha"))
    hit = hit.join(listed.select(F.col("kind").alias("sets_key"), F.col("n").alias("n_items"), F.col("sha").alias("items_sha256")), "sets_key", "left").join(listed.select(F.col("kind").alias("near_key"), F.col("n").alias("n_near")), "near_key", "left")
    hit = hit.select(F.col("doc_id").alias("_doc"), F.col("text_key").alias("_key"), "n_hit", "n_items", "items_sha256", "n_near")
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_key"), _n_words(_split(F.col("text"))).alias("n_words"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long"))
    out = rows.join(hit, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("text_key") == F.col("_key")), "left")
    return out.select("doc_id", "n_words", zero("n_hit").alias("n_hit"), zero("n_items").alias("n_items"), F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), (zero("n_hit") > 0).alias("contaminated"), zero("n_near").alias("n_near"))


def op11_decontamination(spark, sf_dir: str) -> DataFrame:
    """All documents against all benchmark items, by windows of ten words."""
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return decontaminate(docs, items).drop("n_near")


OP11_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM benchmark),
t AS (SELECT DISTINCT item, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS phrase, least(10, len(w)) AS n FROM (SELECT item, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM b WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT n FROM t),
p AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS phrase FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM w, lengths WHERE len(w) >= n)),
h AS (SELECT DISTINCT doc_id, i, n, phrase FROM p SEMI JOIN t USING (phrase, n)),
c AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM h) GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS sha FROM (SELECT DISTINCT doc_id, item FROM h JOIN t USING (phrase, n)) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(sha, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN c USING (doc_id) LEFT JOIN i USING (doc_id)
"""
