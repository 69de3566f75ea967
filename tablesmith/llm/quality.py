"""Quality rules: hashed n-gram log-likelihood ratio against a trusted target.

Two multinomials over hashed one- and two-word features are estimated: the raw
one from all documents, the target one from trusted documents (labelled good and not
toxic). The score of a document is the mean over its features of
log(target / raw). Documents under the threshold, and those that fail the base
rules, are rejected. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablesmith.llm.shared import BLANK, col, fresh

#: Hash buckets of the feature space; the weights of all buckets are one row of this many longs.
BUCKETS = 16_384
#: Labelled rows that the target is fitted on, at most; the first by the hash of their id.
TRUSTED_ROWS = 20_000
#: Added to a bucket's target count and to the count that the raw share would give it, so that rare buckets weigh little.
SMOOTH = 10.0
#: Lowest mean log-likelihood ratio of a kept document, in millionths.
THRESHOLD = -90_000


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    """Words of a text: what stands between blanks. Null and blank texts have none."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, BLANK))


def repeated_words(hashes: Column, size: int = 5) -> Column:
    """Words that lie in a window of ``size`` words found twice or more in the text, the first time included."""
    n = F.size(hashes)
    windows = F.when(n >= size, F.transform(
        F.sequence(F.lit(0), F.greatest(n - size, F.lit(0))),
        lambda i: F.xxhash64(*[F.get(hashes, i + j) for j in range(size)])))

    def covered(ws: Column) -> Column:
        by_hash = F.sort_array(F.transform(ws, lambda w, i: F.struct(w.alias("w"), i.alias("i"))))
        again = let(by_hash, lambda s: F.filter(F.transform(s, lambda x, k: F.when(
            (F.get(s, k - 1)["w"] == x["w"]) | (F.get(s, k + 1)["w"] == x["w"]), x["i"])), lambda x: x.isNotNull()))
        # From each flagged window to the next one, but no further than its end.
        return let(F.sort_array(again), lambda p: F.aggregate(
            F.transform(p, lambda x, k: F.least(F.lit(size), F.coalesce(F.get(p, k + 1) - x, F.lit(size)))),
            F.lit(0), lambda a, x: a + x))

    return let(F.coalesce(windows, F.array().cast("array<bigint>")), lambda ws: F.when(
        F.size(F.array_distinct(ws)) == F.size(ws), F.lit(0)).otherwise(covered(ws)))


def features(hashes: Column, buckets: int) -> Column:
    """Buckets of all words and of all pairs of neighbours."""
    ones = F.transform(hashes, lambda h: F.pmod(h, F.lit(buckets)).cast("int"))
    twos = F.transform(hashes, lambda h, i: F.pmod(F.xxhash64(h, F.get(hashes, i + 1)), F.lit(buckets)).cast("int"))
    return F.concat(ones, F.slice(twos, 1, F.greatest(F.size(hashes) - 1, F.lit(0))))


def trusted_ids(labels: DataFrame, most: int = TRUSTED_ROWS) -> DataFrame:
    """Ids of documents that every label row calls good and not toxic: at most ``most``, chosen by hash."""
    per_doc = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.min("quality").alias("quality"), F.max(F.coalesce(F.col("toxic"), F.lit(0))).alias("toxic"))
    good = per_doc.where("quality = 1 AND toxic = 0").select("doc_id")
    return good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def weights(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """One row: an array with each bucket's log(target / raw) in millionths.

    Counts are summed where the documents are read, so one row per bucket and task is shuffled.
    """
    trusted = trusted_ids(labels).withColumn("trusted", F.lit(1))
    # Bounded by TRUSTED_ROWS, so the broadcast has a fixed size.
    flagged = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(trusted), "doc_id", "left")
    hashes = F.transform(words_of(F.col("text")), lambda w: F.xxhash64(w))
    counts = flagged.select("trusted", F.explode(let(hashes, lambda h: features(h, buckets))).alias("bucket")).groupBy(
        "bucket").agg(F.count("*").alias("raw"), F.count("trusted").alias("target"))
    every = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    filled = every.join(counts, "bucket", "left").na.fill(0, ["raw", "target"])
    lists = filled.agg(
        F.sum("raw").alias("all_raw"), F.sum("target").alias("all_target"),
        F.sort_array(F.collect_list(F.struct("bucket", "raw", "target"))).alias("b"))
    expected = lambda x: x["raw"] * F.col("all_target") / F.col("all_raw")
    ratio = F.transform("b", lambda x: F.round(1e6 * F.log((x["target"] + SMOOTH) / (expected(x) + SMOOTH))).cast("long"))
    # Without trusted text there is no target, and every document scores 0.
    none = F.transform("b", lambda x: F.lit(0).cast("long"))
    return lists.select(F.when(F.col("all_target") > 0, ratio).otherwise(none).alias("weights"))


def measure(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, threshold: int = THRESHOLD) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score (millionths) and kept.

    Every whole text is measured. Null and empty texts have no words, fail the base rules and are
    rejected. Repeated rows are measured each; clashing names of the input get the new
    columns an underscore. An empty table gives no rows.
    """
    text, w, m = fresh(docs, "measured_text", "weights", "measured")
    out = fresh(docs, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "kept")
    body = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(body, "\n"), lambda x: F.btrim(x, F.lit(" \t\n\x0b\x0c\r")) != "")
    table = weights(docs, labels, buckets)
    scored = docs.withColumn(w, table.scalar())

    def from_hashes(words: Column, hashes: Column) -> Column:
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.char_length(F.array_join(words, "")).cast("long").alias("word_chars"),
            repeated_words(hashes).cast("long").alias("n_repeat_words"),
            F.aggregate(features(hashes, buckets), F.lit(0).cast("long"),
                        lambda a, b: a + F.get(col(w), b)).alias("total"))

    measured = let(words_of(F.col("text")), lambda ws: let(
        F.transform(ws, lambda x: F.xxhash64(x)), lambda hs: from_hashes(ws, hs)))
    scored = scored.select(
        *[col(c) for c in docs.columns], measured.alias(m),
        (F.octet_length(body) - F.octet_length(F.regexp_replace(body, r"[#*$%&|<>]", ""))).cast("long").alias(text),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias(out[3]))
    got = lambda f: col(m)[f]
    n = got("n_words")
    failed = (n < 10) | (100 * got("n_repeat_words") > 20 * n)
    score = F.when(n > 0, F.expr(f"`{m}`.total div (2 * `{m}`.n_words - 1)")).otherwise(F.lit(0).cast("long"))
    return scored.select(
        *[col(c) for c in docs.columns], n.alias(out[0]), got("word_chars").alias(out[1]), col(text).alias(out[2]),
        col(out[3]), got("n_repeat_words").alias(out[4]), failed.alias(out[5]), score.alias(out[6]),
        (~failed & (score >= threshold)).alias(out[7]))


def keep(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that pass, with the columns they came with.

    The filter names a number that each row is given after it is measured, so the optimizer leaves the filter there and does not
    repeat the measuring in it.
    """
    kept, row = fresh(docs, "kept", "measured_row")
    measured = measure(docs, labels).withColumn(row, F.monotonically_increasing_id())
    return measured.where(col(kept) & (col(row) >= 0)).select(*[col(c) for c in docs.columns])
