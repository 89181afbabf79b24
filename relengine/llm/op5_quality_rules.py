"""Quality rules, with DataFrame operations only: counts of words, symbols and repeats, then a log-likelihood ratio of hashed n-grams.

The ratio compares two multinomials over hashed n-grams: that of a trusted target (documents that
labels call good) and that of the raw corpus (all documents). An n-gram's weight is the log of its
share in the target over its share in the corpus. PRIOR n-grams of the corpus's own shares are added
to the target, so few labels give weights near 0, and none give 0: what labels don't show is no
reason to reject. A document's score is the mean weight of its n-grams, so length doesn't matter. It
stays if the score is THRESHOLD or more. N-grams are a word, a word and the next one (or the end),
and the last two characters of a word, each hashed to one of BUCKETS buckets.

The corpus counts cover every document and the target all trusted ones; both are summed in each
partition before the shuffle. Trusted documents are found by a semi-join on the key: the keys are
sent to all tasks if they are SENT_BYTES or less, else rows move by key. The result is the same. The
BUCKETS weights go through the driver into the plan as a constant, whose size depends on nothing else.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from relengine.llm.common import table, words

#: Hash buckets of n-grams, a power of two.
BUCKETS = 1 << 14
#: N-grams that are added to the target, by the shares that the corpus has of BUCKETS buckets.
PRIOR = 8 * BUCKETS
#: Bytes of trusted keys that are sent to all tasks at most.
SENT_BYTES = 16 << 20
#: Least mean weight of a document that stays. Clean text has about 0, symbols or capitals at every word below -1.
THRESHOLD = -0.2
#: Words of a window whose repeats are counted, and least words of a document.
WINDOW, LEAST_WORDS = 5, 10
SYMBOLS = r"[#*$%&|<>]"


def _grams(x: Column, after: Column, buckets: int) -> list[Column]:
    """The buckets of the three n-grams of a word and the one after it, which is null at the end."""
    mask = lambda h: h.bitwiseAND(buckets - 1).cast("int")
    return [mask(F.xxhash64(x)), mask(F.xxhash64(x, after)), mask(F.xxhash64(F.substring(x, -2, 2), F.lit(1)))]


def _counts(docs: DataFrame, text: str, buckets: int, name: str) -> DataFrame:
    """b and how many n-grams of all rows have this bucket."""
    w = docs.select(words(F.col(text)).alias("w")).select("w", F.posexplode("w").alias("i", "x"))
    grams = w.select(F.explode(F.array(*_grams(F.col("x"), F.get("w", F.col("i") + 1), buckets))).alias("b"))
    return grams.groupBy("b").agg(F.count(F.lit(1)).alias(name))


def weights(docs: DataFrame, trusted: DataFrame, text: str = "text", key: str = "doc_id", buckets: int = BUCKETS, prior: int | None = None) -> list[float]:
    """The weight of each bucket. trusted: keys of rows that labels call good; null keys are nobody's.

    prior: n-grams that are added to the target by the corpus's shares; with no trusted row all
    weights are 0. By default it is PRIOR for BUCKETS buckets, which it was measured for; for another
    number of buckets it is 0, which stands for one added to each bucket of the target.
    """
    if prior is None:
        prior = PRIOR if buckets == BUCKETS else 0
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    keys = trusted.select(F.col(key).alias("_key")).filter("_key is not null").distinct()
    size = keys.agg(F.sum(F.octet_length(F.col("_key").cast("string")) + 8)).first()[0] or 0
    good = rows.join(F.broadcast(keys) if size <= SENT_BYTES else keys, "_key", "left_semi")
    counts = _counts(rows, "_text", buckets, "n").join(_counts(good, "_text", buckets, "g"), "b", "left")
    n_of, g_of = [0] * buckets, [0] * buckets
    for r in counts.collect():  # BUCKETS rows at most
        n_of[r["b"]], g_of[r["b"]] = r["n"], r["g"] or 0
    n, g = sum(n_of), sum(g_of)
    out = []
    for own, seen in zip(n_of, g_of, strict=True):
        share = (own + 1) / (n + buckets)
        target = (seen + prior * share) / (g + prior) if prior else (seen + 1) / (g + buckets)
        out.append(math.log(target) - math.log(share))
    return out


def quality_columns(docs: DataFrame, log_ratio: list[float], text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs with the columns of the rules added: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score and kept.

    A null text has no words and fails the base rules, as an empty one does. Every row is judged
    alone: repeated rows and ties get the same verdict. Columns of these names are replaced. A
    score of a text without words is 0. Filters on the new columns stay above the steps that make
    them.
    """
    own = F.coalesce(F.col(text), F.lit(""))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "kept"]
    docs = docs.drop(*names)
    kept = [F.col(f"`{c}`") for c in docs.columns]
    lines = F.filter(F.split(own, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    constant = F.expr("cast(split('" + ",".join(map(repr, log_ratio)) + "', ',') as array<double>)")
    w, n = F.col("__rules_w"), F.size("__rules_w")
    parts = docs.select(*kept, words(F.col(text)).alias("__rules_w"), lines.alias("__rules_lines"), F.regexp_count(own, F.lit(SYMBOLS)).cast("long").alias("n_symbols"))
    of_word = lambda x, i: sum((F.get(constant, b) for b in _grams(x, F.get(w, i + 1), len(log_ratio))), F.lit(0.0))
    window = lambda i: [F.get(w, i + k) for k in range(WINDOW)]
    starts = F.sequence(F.lit(0), n - WINDOW)
    hashed = parts.select(
        *kept,
        "__rules_w",
        "n_symbols",
        n.cast("long").alias("n_words"),
        F.char_length(F.array_join("__rules_w", "")).cast("long").alias("word_chars"),
        (F.size("__rules_lines") - F.size(F.array_distinct("__rules_lines"))).cast("long").alias("n_dup_lines"),
        F.when(n >= WINDOW, F.transform(starts, lambda i: F.xxhash64(*window(i)))).alias("__rules_h"),
        F.when(n > 0, F.aggregate(F.transform(w, of_word), F.lit(0.0), lambda a, b: a + b) / (3 * n)).otherwise(0.0).alias("score"),
    )
    # Equal windows have equal hashes; where two hashes are equal, the windows themselves are sorted.
    some = F.size(F.array_distinct("__rules_h")) < F.size("__rules_h")
    ordered = F.sort_array(F.transform(starts, lambda i: F.struct(F.concat_ws(" ", *window(i)).alias("w"), i.alias("at"))))
    scored = [F.col(c) for c in ("n_symbols", "n_words", "word_chars", "n_dup_lines", "score")]
    sorted_ = hashed.select(*kept, *scored, F.when(some, ordered).alias("__rules_s"))
    s = F.col("__rules_s")
    again = F.filter(s, lambda x, j: (F.get(s, j + 1)["w"] == x["w"]) | ((j > 0) & (F.get(s, j - 1)["w"] == x["w"])))
    places = sorted_.select(*kept, *scored, F.sort_array(F.transform(again, lambda x: x["at"])).alias("__rules_p"))
    p = F.col("__rules_p")
    # A place covers WINDOW words, or those up to the next place.
    covered = F.aggregate(F.sequence(F.lit(0), F.size(p) - 1), F.lit(0), lambda a, j: a + F.least(F.lit(WINDOW), F.get(p, j + 1) - F.get(p, j)))
    repeats = F.when(F.size(p) > 0, covered).otherwise(0).cast("long")
    counted = places.select(*kept, *scored, repeats.alias("n_repeat_words"))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    facts = F.struct("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), "score", (~failed & (F.col("score") >= threshold)).alias("kept"))
    # A filter that were pushed below these steps would compute all of them again for each word. None
    # is pushed below a projection that isn't deterministic, and none of the new columns goes without it.
    held = counted.select(*kept, F.when(F.spark_partition_id() >= 0, facts).alias("__rules"))
    return held.select(*kept, *(F.col(f"__rules.{c}").alias(c) for c in names))


def trusted_keys(labels: DataFrame) -> DataFrame:
    """The keys that labels call good."""
    return labels.filter("quality = 1").select("doc_id")


def quality_filter(docs: DataFrame, trusted: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of docs, all columns, that the rules keep; trusted has keys, in a column of the same name. Null and empty texts go, repeated rows stay or go together."""
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_doc"), F.col(text).alias("_text"))
    return quality_columns(packed, weights(docs, trusted, text, key), "_text").filter("kept").select("_doc.*")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, the counts, base_failed, score and kept of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = quality_columns(docs, weights(docs, trusted_keys(table(spark, sf_dir, "labels"))))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")
