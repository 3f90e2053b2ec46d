"""TF-IDF over n-grams in long form: (key, term, weight). Nothing dense; only a vocabulary of up to SMALL terms is at the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.text import ngrams as grams_of
from tessera.functions.text import tokens
from tessera.session import settled

SMALL = 10_000  # terms that may be written into an expression
COMMON = 200_000  # words that are sent along to leave out n-grams that cannot be chosen


def stopwords(extra: list[str], base: list[str] | None = None) -> list[str]:
    """The union of the extra words and a base list (a language's stop words, as the caller has them), in lower case."""
    return sorted({w.lower() for w in [*extra, *(base or [])]})


def word_tokens(c: Column) -> Column:
    """Lower-case runs of two or more word characters: the token pattern of the normalised form."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"(?U)\b\w\w+\b"), 0)


def _words(docs: DataFrame, text: str, stop: list[str], form: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """docs' columns `keep` with __words, the tokens that are no stop words."""
    if form in ("share", "plain"):
        return docs.select(*keep, tokens(F.col(text), stop, form == "plain").alias("__words"))
    kept = F.filter(word_tokens(F.col(text)), lambda t: ~t.isin(stop)) if stop else word_tokens(F.col(text))
    return docs.select(*keep, kept.alias("__words"))


def _among(words: Column, names: list[str]) -> Column:
    """The words with null for what is not among names, so that n-grams of neighbours stay such."""
    return F.transform(words, lambda w: F.when(w.isin(names), w))


def fit(docs: DataFrame, text: str, max_features: int = 5000, ngrams=(1, 2), stop: list[str] | None = None, form: str = "share") -> DataFrame:
    """(term, df, idf, idx): the max_features terms in most documents, ties by term; idf = ln((1 + N) / (1 + df)) + 1.

    Words are counted first. A longer n-gram is in no more documents than any of its words, so those with a word
    below the max_features-th word cannot be chosen and never reach a shuffle; the result is the same.
    """
    low, high = ngrams
    words = settled(_words(docs, text, stop or [], form), "words")
    total = words.agg(F.count(F.lit(1)).alias("__n"))
    count = lambda terms: terms.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    single = settled(count(words.select(F.explode(F.array_distinct("__words")).alias("term"))), "word-counts")
    parts = [single] if low == 1 else []
    if high > 1:
        pairs = lambda w: words.select(F.explode(F.array_distinct(grams_of(w, max(2, low), high))).alias("term"))
        more = pairs(F.col("__words"))
        if max_features > 0 and low == 1:
            best = single.orderBy(F.desc("df")).limit(max_features).agg(F.count(F.lit(1)).alias("n"), F.min("df").alias("cut")).first()
            common = single.where(F.col("df") >= (best["cut"] if best["n"] == max_features else 0)).select("term")
            few = [r[0] for r in common.limit(SMALL + 1).collect()] if best["n"] == max_features else []
            if 0 < len(few) <= SMALL:
                more = pairs(_among(F.col("__words"), few))
            elif few and common.count() <= COMMON:
                for k in range(high):  # a missing part of a shorter n-gram is no word to look for
                    part = F.get(F.split("term", " "), F.lit(k))
                    more = more.withColumn("__part", part).join(F.broadcast(common.withColumnRenamed("term", "__part")).withColumn("__in", F.lit(True)), "__part", "left")
                    more = more.where("__in or __part is null").select("term")
        parts.append(count(more))
    counted = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    if max_features > 0:
        best = counted.orderBy(F.desc("df"), "term").limit(max_features)
        ranked = best.withColumn("idx", (F.row_number().over(W.orderBy(F.desc("df"), "term")) - 1).cast("long"))
    else:  # the whole vocabulary: places by range, not by one task
        ordered = settled(counted.repartitionByRange(F.desc("df"), "term").sortWithinPartitions(F.desc("df"), "term").withColumn("__part", F.spark_partition_id()), "vocabulary")
        before = ordered.groupBy("__part").count().withColumn("__base", F.coalesce(F.sum("count").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
        own = F.row_number().over(W.partitionBy("__part").orderBy(F.desc("df"), "term"))
        ranked = ordered.join(F.broadcast(before.select("__part", "__base")), "__part").withColumn("idx", F.col("__base") + own - 1)  # before: one row a partition
    return ranked.join(F.broadcast(total)).select("term", "df", (F.ln((1 + F.col("__n")) / (1 + F.col("df"))) + 1).alias("idf"), "idx")  # total: one row


def transform(docs: DataFrame, text: str, key: str, vocabulary: DataFrame, ngrams=(1, 2), stop: list[str] | None = None, form: str = "share") -> DataFrame:
    """(key, term, weight). form "share": the term's share of the document's known terms, times idf.

    form "l2": the term's count times idf, over the root of their squares in the document.
    """
    all_terms = _words(docs, text, stop or [], form, (key,)).select(key, F.explode(grams_of(F.col("__words"), *ngrams)).alias("term"))
    counts = all_terms.join(vocabulary.select("term", "idf"), "term").groupBy(key, "term").agg(F.count(F.lit(1)).alias("n"), F.first("idf").alias("idf"))
    own = W.partitionBy(key)
    if form == "l2":
        raw = F.col("n") * F.col("idf")
        return counts.withColumn("weight", raw / F.sqrt(F.sum(raw * raw).over(own))).select(key, "term", "weight")
    return counts.withColumn("weight", F.col("n") / F.sum("n").over(own) * F.col("idf")).select(key, "term", "weight")


def _few_sums(docs: DataFrame, text: str, key: str, vocabulary: DataFrame, ngrams=(1, 2), stop: list[str] | None = None, form: str = "share") -> DataFrame | None:
    """(term, s): transform's weights summed, each document by itself and no pair of document and term shuffled.

    None where that doesn't hold: a large vocabulary, a key of several rows, or the normalised form.
    """
    if form == "l2":
        return None
    idf = {r["term"]: r["idf"] for r in vocabulary.select("term", "idf").limit(SMALL + 1).collect()}
    if not 0 < len(idf) <= SMALL or not docs.groupBy(key).count().where("count > 1").isEmpty():
        return None
    words = _among(F.col("__words"), sorted({w for t in idf for w in [t, *t.split(" ")]}))
    known = _words(docs, text, stop or [], form).select(F.filter(grams_of(words, *ngrams), lambda t: t.isin(list(idf))).alias("__terms"))
    each = known.select(F.size("__terms").alias("__of"), F.explode("__terms").alias("term"))
    found = each.groupBy("term").agg(F.sum(1 / F.col("__of")).alias("__share"))
    sent = docs.sparkSession.createDataFrame(list(idf.items()), "term string, idf double")
    return found.join(F.broadcast(sent), "term").select("term", (F.col("__share") * F.col("idf")).alias("s"))  # sent: SMALL rows at most


def top_terms(docs: DataFrame, text: str, key: str, vocabulary: DataFrame, top: int = 20, **options) -> DataFrame:
    """Terms by mean weight over all the documents, those without the term among them."""
    total = docs.agg(F.count(F.lit(1)).alias("__n"))
    sums = _few_sums(docs, text, key, vocabulary, **options)
    if sums is None:
        sums = transform(docs, text, key, vocabulary, **options).groupBy("term").agg(F.sum("weight").alias("s"))
    mean = sums.join(F.broadcast(total))  # total: one row
    return mean.select("term", (F.col("s") / F.col("__n")).alias("mean_weight")).where("mean_weight > 0").orderBy(F.desc("mean_weight"), "term").limit(top)
