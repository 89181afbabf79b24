"""Exact deduplication by deterministic block naming, with DataFrame operations only.

Each text, its white space normalised, is cut into blocks of a fixed number of bytes. The distinct
blocks of the corpus are sorted, and a block's place among them is its name: an integer that no
other block has. Documents are then sequences of names; adjacent pairs of names are sorted and
named in the same way, which halves the sequences, until each document has one name. Documents
of the same length took the same number of rounds, so (length, name) is the same for two of them
exactly if all bytes are.

What moves. The text of a block is shuffled once, and once only for all its copies in a partition,
to be sorted. Names go back to documents by a 64-bit fingerprint of the block, which never decides
anything: if several blocks share a fingerprint, their names are joined by the blocks themselves.
Groups are counted by partial aggregation, so that a hot group costs one row for each partition.
Names and groups go back to documents by joins in which hot keys (a share of all rows that only a
bounded number of keys can have) are sent to all tasks and do not move a row.

Names are places in sorted partitions: (number of the partition, row in it). Both are the same
when a lost task is run again, and they are read from a table that is written once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from relengine.llm.common import SPACE, durable, join_by_size, table

#: Bytes of a block.
BLOCK = 16 << 10
#: Stands where a sequence of odd length has no second name to pair; no name is negative and even smaller.
NONE = -(1 << 62)


def normalised(text: Column) -> Column:
    """The text with each run of white space replaced by one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def _blocks(raw: Column, size: int) -> Column:
    count = F.greatest(F.lit(1), F.ceil(F.octet_length(raw) / F.lit(size))).cast("int")
    return F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.substring(raw, i * size + 1, F.lit(size)))


def _named(rows: DataFrame, *by: str) -> DataFrame:
    """The distinct rows with their names, which follow the order of these columns, and in `copies` how many rows there were of each."""
    distinct = rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("copies"))
    return distinct.sortWithinPartitions(*by).withColumn("name", F.monotonically_increasing_id())


def exact_groups(docs: DataFrame, text: str = "text", key: str = "doc_id", block: int = BLOCK, fingerprint=F.xxhash64) -> DataFrame:
    """One row for each row of docs: key, keep_id, group_size, kept, text_sha256 and twin.

    A group is of all rows whose normalised texts are equal; of it the row with the smallest key
    stays (a null key comes after all others; of rows that share the smallest key one stays), and
    keep_id is its key. text_sha256 is of the normalised text in UTF-8. twin is true for a row
    that goes although it has the key of the one that stays. Null and empty texts are equal; a text of
    white space only is one space, and not equal to them. Other columns don't matter.
    """
    raw = normalised(F.col(text)).cast("binary")
    fp = lambda x: fingerprint(x).cast("long")
    base = docs.select(F.col(key).alias("_key"), raw.alias("raw"))
    pieces = base.select(F.explode(_blocks(F.col("raw"), block)).alias("block")).select(fp(F.col("block")).alias("fp"), "block")
    names = durable(_named(pieces, "block").select("fp", "name", "copies"), "op3-blocks")
    clash = names.groupBy("fp").agg(F.count("*").alias("n")).filter("n > 1").select("fp")
    base = base.select(F.monotonically_increasing_id().alias("_row"), "*")
    clear = clash.isEmpty()
    if not clear:  # texts are looked at again: their rows must keep their numbers
        base = durable(base, "op3-texts")
    sequence = F.transform(_blocks(F.col("raw"), block), fp).alias("fps")
    known = durable(base.select("_row", "_key", F.octet_length("raw").alias("n_bytes"), F.sha2("raw", 256).alias("text_sha256"), sequence), "op3-documents")
    found = known.select("_row", F.posexplode("fps").alias("pos", "fp"))
    facts = known.agg(F.max(F.size("fps")), F.sum(F.size("fps")), F.count(F.lit(1))).first()
    longest, total, n_rows = facts[0] or 1, facts[1] or 0, facts[2]
    level = join_by_size(found, names, ["fp"], "copies", total).select("_row", "pos", "name") if clear else _names_of_clashes(base, found, names, clash, block, fp)
    single = level.join(known.filter(F.size("fps") == 1).select("_row"), "_row", "left_semi") if longest > 1 else level
    done = [single.select("_row", "name")]
    if longest > 1:
        several = level.join(known.filter(F.size("fps") > 1).select("_row"), "_row", "left_semi")
        while longest > 1:
            pairs = several.groupBy("_row", F.expr("pos div 2").alias("pos")).agg(
                F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("a"),
                F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(NONE)).alias("b"),
            )
            pairs = durable(pairs, "op3-pairs")
            fresh = durable(_named(pairs.select("a", "b"), "a", "b"), "op3-names")
            several = join_by_size(pairs, fresh, ["a", "b"], "copies", total).select("_row", "pos", "name")
            longest = (longest + 1) // 2
        done.append(several.select("_row", "name"))
    one = known.select("_row", "_key", "n_bytes", "text_sha256").join(done[0] if len(done) == 1 else done[0].union(done[1]), "_row")
    one = durable(one, "op3-named")
    # One place for the key's type and order: nulls last, then the key, then the row.
    place = F.struct(F.col("_key").isNull().alias("no"), F.col("_key").alias("key"), F.col("_row").alias("row"))
    groups = one.groupBy("n_bytes", "name").agg(F.min(place).alias("keep"), F.count("*").alias("group_size"))
    return join_by_size(one, durable(groups, "op3-sizes"), ["n_bytes", "name"], "group_size", n_rows).select(
        F.col("_key").alias(key),
        F.col("keep.key").alias("keep_id"),
        "group_size",
        (F.col("_row") == F.col("keep.row")).alias("kept"),
        "text_sha256",
        (F.col("_key").eqNullSafe(F.col("keep.key")) & (F.col("_row") != F.col("keep.row"))).alias("twin"),
    )


def _names_of_clashes(base: DataFrame, found: DataFrame, names: DataFrame, clash: DataFrame, block: int, fp) -> DataFrame:
    """Names where several blocks share a fingerprint: these blocks are joined by all their bytes, the others by fingerprint."""
    clash = durable(clash, "op3-clashes")
    plain = found.join(names.join(clash, "fp", "left_anti"), "fp").select("_row", "pos", "name")
    whole = base.select("_row", F.posexplode(_blocks(F.col("raw"), block)).alias("pos", "block"))
    whole = durable(whole.withColumn("fp", fp(F.col("block"))).join(clash, "fp", "left_semi"), "op3-whole")
    own = durable(_named(whole.select("block"), "block").select("block", (-1 - F.col("name")).alias("name")), "op3-whole-names")
    return plain.union(whole.join(own, "block").select("_row", "pos", "name"))


def exact_dedup(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of docs, all columns, without those that exact_groups drops. Rows are told apart by key and text; of rows that share both, one stays."""
    groups = exact_groups(docs, text, key)
    groups = durable(groups.select(key, "kept", "twin", "text_sha256"), "op3-groups")
    sha = F.sha2(normalised(F.col(text)).cast("binary"), 256)
    if groups.filter("twin").isEmpty():
        gone = groups.filter("not kept").select(F.col(key).alias("_key"), F.col("text_sha256").alias("_sha"))
        return docs.join(gone, docs[key].eqNullSafe(gone["_key"]) & (sha == gone["_sha"]), "left_anti")
    # Some kept row has a twin of the same key and text: keep one of them, whichever other columns it has.
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_doc"), F.col(key).alias("_key"), sha.alias("_sha"))
    kept = groups.filter("kept").select(F.col(key).alias("_k"), F.col("text_sha256").alias("_s"))
    once = packed.join(kept, F.col("_key").eqNullSafe(F.col("_k")) & (F.col("_sha") == F.col("_s")), "left_semi")
    return once.dropDuplicates(["_key", "_sha"]).select("_doc.*")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return exact_groups(docs).drop("twin")


ORACLE = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(n.t) AS text_sha256 FROM n JOIN g ON n.t = g.t
"""
