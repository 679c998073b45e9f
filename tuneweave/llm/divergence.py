"""Document quality rules with a distribution-divergence verdict, from
DataFrame functions only.

Base counts: words, characters in words, symbols, repeated lines, words in
repeated five-word windows. Verdict: Jensen-Shannon distance between a document's
histogram of character classes, and of common words, and the reference of its
language; each is used only from a minimum length on.

Defined results: a null text is empty (no words, so it fails); a text of unknown
(null) language is compared with every reference and judged by the nearest; where
its language has no reference, or there is none at all, the base rule decides; repeated rows get the
same row each; an empty table gives no rows. Only ``doc_id``, ``text`` and
``lang`` are read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import GAP_CHARS, WORD, words

SYMBOLS = "#*$%&|<>"
WINDOW = 5
#: Word and character counts below which a histogram says too little.
MIN_WORDS, MIN_CHARS = 50, 200
#: A document fails if a distance (square root of the divergence in bits) is above
#: limit + noise / sqrt(length): short histograms stray further by chance alone.
MAX_CLASS, CLASS_NOISE = 0.18, 2.0
MAX_COMMON, COMMON_NOISE = 0.14, 1.0
#: A language's references need so many visible characters, and so many words,
#: whatever its share of the documents; a common word has at least this share of
#: its language's words, so that a language has at most 100.
REFERENCE_CHARS, REFERENCE_WORDS, MIN_COMMON = 5_000, 1_000, 0.01
#: Small letters and white space, most of any prose; the classes counted in what
#: is left of a text without them; then come small letters and all the rest, such
#: as letters without case.
PROSE = r"[\p{Ll}\x20\x09-\x0D]+"
CLASSES = (r"\p{Lu}", r"\p{N}", "[#*$%&|<>]", r"[.,;:!?'\"()\-]")


def _windows(w: Column) -> Column:
    """A hash for each five-word window, by its first word."""
    hashes = F.transform(w, lambda x, i: F.xxhash64(x, *[F.get(w, i + k) for k in range(1, WINDOW)]))
    return F.slice(hashes, 1, F.greatest(F.size(w) - (WINDOW - 1), F.lit(0)))


def base_counts(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the base counts and ``base_failed``; ``keep`` names columns to carry."""
    t = F.col("text")
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(WORD))
    at = F.col("at")
    df = (docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"), *keep)
          .withColumn("w", words(t)).withColumn("h", _windows(F.col("w")))
          .withColumn("lines", lines)
          # Windows sorted by (hash, place): those equal to a neighbour are kept,
          # and each covers its words up to the next one kept. Most texts repeat
          # no window, and need no sorting.
          .withColumn("distinct_h", F.size(F.array_distinct("h")))
          .withColumn("placed", F.when(F.col("distinct_h") < F.size("h"), F.array_sort(
              F.transform("h", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))
          .withColumn("at", F.array_sort(F.transform(F.filter(F.transform("placed", lambda s, j: F.struct(
              s["i"].alias("i"),
              (F.coalesce(F.get("placed", j - 1)["h"] == s["h"], F.lit(False))
               | F.coalesce(F.get("placed", j + 1)["h"] == s["h"], F.lit(False))).alias("twice"))),
              lambda s: s["twice"]), lambda s: s["i"])))
          .withColumn("n_words", F.size("w").cast("long"))
          .withColumn("word_chars", F.length(F.array_join("w", "")).cast("long"))
          .withColumn("rest", F.regexp_replace(t, PROSE, ""))
          .withColumn("n_symbols", F.regexp_count("rest", F.lit(f"[{SYMBOLS}]")).cast("long"))
          .withColumn("n_dup_lines", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"))
          .withColumn("n_repeat_words", F.coalesce(F.aggregate(
              F.transform(at, lambda p, j: F.least(F.lit(WINDOW), F.coalesce(F.get(at, j + 1) - p, F.lit(WINDOW)))),
              F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long")))
    df = df.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))
    return df.drop("h", "lines", "distinct_h", "placed", "at")


def _class_counts(rest: Column, visible: Column) -> Column:
    """Characters of each class, of small letters, and of none of these, as an
    array whose sum is ``visible``, the number of characters in words; ``rest`` is
    the text without PROSE."""
    counts = [F.regexp_count(rest, F.lit(c)).cast("long") for c in CLASSES]
    return F.array(*counts, visible - F.length(rest), F.length(rest) - reduce(lambda a, b: a + b, counts))


def references(docs: DataFrame) -> DataFrame:
    """lang and ``ref`` of each language long enough: shares of character classes
    (null if it has too few characters), its common words, and their shares and
    that of all other words (null if it has too few words)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    known = docs.filter(F.col("lang").isNotNull()).select("lang", text.alias("text"))
    # each text is cut into words once; the totals come from the counted words
    counts = materialize(known.select("lang", F.explode(words(F.lower("text"))).alias("w"))
                         .groupBy("lang", "w").agg(F.count(F.lit(1)).alias("n")), "divergence-words")
    totals = counts.groupBy("lang").agg(F.sum("n").alias("words"))
    rest = known.select("lang", F.regexp_replace("text", PROSE, "").alias("rest"),
                        F.length(F.translate("text", GAP_CHARS, "")).cast("long").alias("visible"))
    classes = rest.select("lang", "visible", _class_counts(F.col("rest"), F.col("visible")).alias("c"))
    sums = [F.sum(F.col("c")[i]) for i in range(len(CLASSES) + 2)]
    classes = classes.groupBy("lang").agg(F.sum("visible").alias("visible"), F.array(*sums).alias("c"))
    per_lang = (classes.join(totals, "lang", "left").withColumn("words", F.coalesce("words", F.lit(0)))
                .filter((F.col("visible") >= REFERENCE_CHARS) | (F.col("words") >= REFERENCE_WORDS)))
    per_lang = materialize(per_lang, "divergence-languages")
    common = (counts.join(per_lang.filter(F.col("words") >= REFERENCE_WORDS).select("lang", "words"), "lang")
              .filter(F.col("n") >= F.col("words") * MIN_COMMON)
              .groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("w", (F.col("n") / F.col("words")).alias("p")))).alias("common")))
    none = F.array().cast("array<struct<w:string,p:double>>")
    listed = per_lang.join(common, "lang", "left").withColumn("common", F.coalesce("common", none))
    shares = F.transform("common", lambda x: x["p"])
    others = F.greatest(F.lit(0.0), 1.0 - F.aggregate(shares, F.lit(0.0), lambda a, x: a + x))
    return materialize(listed.select("lang", F.struct(
        F.when(F.col("visible") >= REFERENCE_CHARS, F.transform("c", lambda x: x / F.col("visible"))).alias("classes"),
        F.transform("common", lambda x: x["w"]).alias("words"),
        F.when(F.col("words") >= REFERENCE_WORDS, F.concat(shares, F.array(others))).alias("shares")).alias("ref")),
        "divergence-references")


def _distance(counts: Column, total: Column, ref: Column) -> Column:
    """Jensen-Shannon distance in [0, 1] of counts over total from shares; null
    where there are no shares."""
    def part(c, q):
        p = c / total
        m = (p + q) / 2
        mine = F.when(p > 0, p * F.log2(p / m)).otherwise(0.0)
        theirs = F.when(q > 0, q * F.log2(q / m)).otherwise(0.0)
        return (mine + theirs) / 2
    return F.when(ref.isNotNull(), F.sqrt(F.greatest(
        F.aggregate(F.zip_with(counts, ref, part), F.lit(0.0), lambda a, x: a + x), F.lit(0.0))))


def quality_rules(docs: DataFrame, max_class: float = MAX_CLASS, max_common: float = MAX_COMMON) -> DataFrame:
    """doc_id, base counts, base_failed, the two distances and ``kept``."""
    refs = references(docs)
    every = refs.agg(F.collect_list("ref")).scalar()
    none = F.array().cast(f"array<{refs.schema['ref'].dataType.simpleString()}>")
    # only the columns read, so that no other column can clash with a reference's
    df = (base_counts(docs.select("doc_id", "text", "lang").join(refs, "lang", "left"), ("lang", "ref"))
          .withColumn("classes", _class_counts(F.col("rest"), F.col("word_chars")))
          .withColumn("own", F.when(F.col("lang").isNull(), every).when(F.col("ref").isNotNull(), F.array("ref")).otherwise(none))
          .withColumn("own_words", F.array_distinct(F.flatten(F.transform("own", lambda r: r["words"]))))
          .withColumn("common", F.filter(F.transform("w", F.lower), lambda x: F.array_contains(F.col("own_words"), x))))
    common, n_words, chars = F.col("common"), F.col("n_words"), F.col("word_chars")

    def word_counts(r):
        each = F.transform(r["words"], lambda w: (F.size(common) - F.size(F.array_remove(common, w))).cast("long"))
        # the counts, and what they leave of all words; bound, so that they are counted once
        return F.transform(F.array(each), lambda e: F.concat(
            e, F.array(n_words - F.aggregate(e, F.lit(0).cast("long"), lambda a, x: a + x))))[0]

    def nearest(of):
        return F.coalesce(F.array_min(F.transform("own", of)), F.lit(0.0))

    df = (df.withColumn("class_distance", nearest(
        lambda r: _distance(F.col("classes"), F.greatest(chars, F.lit(1)), r["classes"])))
        .withColumn("common_distance", nearest(
            lambda r: _distance(word_counts(r), F.greatest(n_words, F.lit(1)), r["shares"]))))
    odd = (((chars >= MIN_CHARS) & (F.col("class_distance") > max_class + CLASS_NOISE / F.sqrt(chars)))
           | ((n_words >= MIN_WORDS) & (F.col("common_distance") > max_common + COMMON_NOISE / F.sqrt(n_words))))
    return df.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                     (~F.col("base_failed") & ~odd).alias("kept"), "class_distance", "common_distance")
