"""Mixing sources to target weights by Pareto order sampling, with DataFrame operations only.

Sources share a number of words by weight; a source's target stops at REPEAT times its size, and
what it leaves is shared by the others, by weight, until none is above (water filling, solved in
one pass over the sources in the order in which they fill up).

A document's expected copies are its preference times its source's rate, REPEAT at most; the rate is
such that the expected words of a source are its target. Whole copies are certain. For the fraction
p, documents are ranked by random odds over inclusion odds, u/(1-u) over p/(1-p), and taken in that
order as long as their words fit into what the target leaves: a sample of unequal probabilities and
of fixed size in words. Documents that were passed over and are small enough for the rest are ranked
in the same way, ROUNDS times in all, so a long document at the end of the first round doesn't leave
the target far off.

Nothing but a row for each source leaves the counting: words are summed for each source and rank
bucket, with partial sums before the shuffle, the bucket in which the target is reached is found
from these sums, and only its documents are put in order. Whether a document is taken then
follows from its own key and size and its source's row; texts are not shuffled. u is a hash of the
key, so reruns agree. Targets and rates are of one row for each source, which one task puts in
order: millions of sources are a few hundred MB there, which it may spill.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from relengine.llm.common import durable, free, table

WEIGHTS = (5, 2, 1)
#: Most copies of a document, and most times a source's size that its target is.
REPEAT = 3
ROUNDS = 3
#: Buckets of ranks for each source.
RANKS = 1 << 14
WORD = r"[^\x20\x09-\x0D]+"
#: The query and the pipeline prefer texts of at least this many words: shorter ones count half.
SHORT = 50

Preference = Column | Callable[[Column], Column] | None


def by_length(size: Column) -> Column:
    """The preference of a text of so many words."""
    return F.when(size < SHORT, 0.5).otherwise(1.0)


def size_of(text: Column) -> Column:
    """The number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = 1.0, source: str = "source", repeat: int = REPEAT) -> DataFrame:
    """source, source_size, target of each source: `share` of all words, shared by weight; sources by code point, null last, weigh as `weights` say, repeating."""
    sums = sizes.groupBy(source).agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col(source).isNull(), source)
    weight = F.get(F.array(*map(F.lit, weights)), (F.row_number().over(by_name) - 1) % len(weights)).cast("double")
    rows = sums.select(source, "source_size", weight.alias("weight"), (F.col("source_size") * repeat).cast("double").alias("cap"))
    every = Window.partitionBy(F.lit(0))
    fills = every.orderBy(F.col("cap") / F.col("weight"), F.col(source).isNull(), source)
    rows = rows.select(
        "*",
        (F.sum("source_size").over(every) * share - (F.sum("cap").over(fills.rowsBetween(Window.unboundedPreceding, 0)) - F.col("cap"))).alias("left_words"),
        F.sum("weight").over(fills.rowsBetween(0, Window.unboundedFollowing)).alias("left_weight"),
    )
    level = F.col("left_words") / F.col("left_weight")
    rows = rows.withColumn("level", F.min(F.when(level * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), level.alias("level")))).over(every)["level"])
    return rows.select(source, "source_size", F.least("cap", F.coalesce(F.col("level") * F.col("weight"), F.col("cap"))).alias("target"))


def _rank(key: Column, expected: Column, seed: str) -> tuple[Column, Column]:
    """Random odds over inclusion odds, as a number from 0 to 1, and its bucket. expected: copies, of which the fraction is drawn."""
    text = F.concat(F.lit(seed + ":"), F.coalesce(key.cast("string"), F.lit("")))
    u = (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    p = expected - F.floor(expected)
    rank = u * (1 - p) / (u * (1 - p) + p * (1 - u))
    return rank, F.floor(rank * RANKS).cast("int")


def _decided(rows: DataFrame, rounds: int) -> Column:
    """Whether the sample takes a row, by the rounds that its source's row knows so far."""
    taken = F.lit(False)
    place = F.struct("rank", "key")
    for k in range(rounds):
        below = (F.col("bucket") < F.col(f"bucket_{k}")) | ((F.col("bucket") == F.col(f"bucket_{k}")) & (place <= F.col(f"last_{k}")))
        taken = taken | ((F.col("size") <= F.col(f"fits_{k}")) & F.coalesce(below, F.lit(False)))
    return taken


def _rates(sizes: DataFrame, goal: DataFrame, repeat: int) -> DataFrame:
    """goal with each source's rate: the sum of size * least(repeat, rate * preference) is the target.

    Documents of high preference reach `repeat` first; what they leave is shared by the others.
    Rates only rise, and each pass puts at least one more preference of a source at its limit or
    leaves that source's rate as it is.
    """
    wanted = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("preference")).alias("wished"))
    plan = durable(goal.join(wanted, goal["source"].eqNullSafe(wanted["source"])).select(goal["source"], "source_size", "target", F.coalesce(F.try_divide("target", "wished"), F.lit(0.0)).alias("rate")), "op2-plan")
    while True:
        rows = sizes.join(plan.select(F.col("source").alias("_source"), "rate"), F.col("source").eqNullSafe(F.col("_source")))
        full = F.col("rate") * F.col("preference") >= repeat
        sums = rows.groupBy("source").agg(
            F.sum(F.when(full, F.col("size") * float(repeat)).otherwise(0.0)).alias("full_words"),
            F.sum(F.when(~full, F.col("size") * F.col("preference")).otherwise(0.0)).alias("wished"),
        )
        rate = F.when((F.col("full_words") > 0) & (F.col("wished") > 0), (F.col("target") - F.col("full_words")) / F.col("wished")).otherwise(F.col("rate"))
        after = durable(plan.join(sums, plan["source"].eqNullSafe(sums["source"])).select(plan["source"], "source_size", "target", F.greatest("rate", rate).alias("rate"), (rate > F.col("rate")).alias("rose")), "op2-plan")
        free(plan)
        plan = after
        if plan.filter("rose").isEmpty():
            return plan.drop("rose")


def mix_plan(sizes: DataFrame, goal: DataFrame, seed: str = "mix", rounds: int = ROUNDS, repeat: int = REPEAT) -> DataFrame:
    """A row for each source: its target, certain copies, and for each round what fits and the last place taken.

    sizes: key, source, size (long) and preference (double, not below 0). goal: what targets() gives.
    """
    plan = _rates(sizes, goal, repeat)
    rows = _ranked(sizes, plan, seed, repeat)
    certain = rows.groupBy("source").agg(F.sum(F.col("certain") * F.col("size")).alias("given"))
    plan = plan.join(certain, plan["source"].eqNullSafe(certain["source"])).select(plan["*"], F.greatest(F.lit(0.0), F.col("target") - F.col("given")).alias("fits_0"))
    for k in range(rounds):
        plan = durable(plan, "op2-plan")
        if k:
            taken = _ranked(sizes, plan, seed, repeat).filter(_decided(sizes, k)).groupBy("source").agg(F.sum("size").alias("drawn"))
            plan = plan.join(taken, plan["source"].eqNullSafe(taken["source"]), "left").select(plan["*"], (F.col("fits_0") - F.coalesce("drawn", F.lit(0))).alias(f"fits_{k}"))
            plan = durable(plan, "op2-plan")
        open_ = _ranked(sizes, plan, seed, repeat).filter(_drawable(repeat) & (F.col("size") <= F.col(f"fits_{k}")) & ~_decided(sizes, k))
        sums = open_.groupBy("source", "bucket").agg(F.sum("size").alias("words"), F.first(f"fits_{k}").alias("fits"))
        upto = F.sum("words").over(Window.partitionBy("source").orderBy("bucket"))
        over = sums.withColumn("upto", upto).filter("upto > fits").groupBy("source").agg(F.min(F.struct("bucket", (F.col("upto") - F.col("words")).alias("before"))).alias("at"))
        at = plan.join(over, plan["source"].eqNullSafe(over["source"]), "left").select(plan["*"], F.coalesce("at.bucket", F.lit(RANKS)).alias(f"bucket_{k}"), F.coalesce("at.before", F.lit(0)).alias("before"))
        at = durable(at, "op2-plan")
        edge = _ranked(sizes, at, seed, repeat).filter(_drawable(repeat) & (F.col("size") <= F.col(f"fits_{k}")) & ~_decided(sizes, k) & (F.col("bucket") == F.col(f"bucket_{k}")))
        run = F.col("before") + F.sum("size").over(Window.partitionBy("source").orderBy("rank", "key"))
        last = edge.withColumn("run", run).filter(F.col("run") <= F.col(f"fits_{k}")).groupBy("source").agg(F.max(F.struct("rank", "key")).alias(f"last_{k}"))
        plan = at.join(last, at["source"].eqNullSafe(last["source"]), "left").select(at["*"], f"last_{k}").drop("before")
    return durable(plan, "op2-plan")


def _drawable(repeat: int) -> Column:
    """Whether a document may have another copy than the certain ones."""
    return (F.col("expected") < repeat) & (F.col("preference") > 0)


def _ranked(sizes: DataFrame, plan: DataFrame, seed: str, repeat: int) -> DataFrame:
    """sizes with their sources' rows, expected and certain copies, rank and bucket."""
    rows = sizes.join(plan.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    rows = rows.withColumn("expected", F.least(F.lit(float(repeat)), F.col("rate") * F.col("preference")))
    rank, bucket = _rank(F.col("key"), F.col("expected"), seed)
    return rows.withColumn("certain", F.floor("expected").cast("int")).withColumn("rank", rank).withColumn("bucket", bucket)


def _mixed(docs: DataFrame, text: str, key: str, source: str, preference: Preference, weights: Sequence[int], share: float, seed: str, repeat: int, size: Column | None) -> DataFrame:
    """Each row of docs as a struct _doc, with size, source_size, target and copies."""
    liked = F.lit(1.0) if preference is None else preference if isinstance(preference, Column) else preference(F.col("size"))
    liked = F.greatest(F.lit(0.0), F.coalesce(F.nanvl(liked.cast("double"), F.lit(1.0)), F.lit(1.0)))
    # A preference that is a column may use any column of docs, so it is looked at before they are packed.
    early = [liked.alias("preference")] if isinstance(preference, Column) else []
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_doc"), F.col(key).alias("key"), F.col(source).alias("source"), (size_of(F.col(text)) if size is None else size.cast("long")).alias("size"), *early)
    packed = packed if early else packed.withColumn("preference", liked)
    sizes = durable(packed.drop("_doc"), "op2-sizes")
    plan = mix_plan(sizes, targets(sizes, weights, share, repeat=repeat), seed, repeat=repeat)
    free(sizes)
    rows = _ranked(packed, plan, seed, repeat)
    drawn = (_drawable(repeat) & _decided(rows, ROUNDS)).cast("int")
    return rows.select("_doc", "size", "source_size", "target", (F.col("certain") + drawn).alias("copies"))


def mix(docs: DataFrame, text: str = "text", key: str = "doc_id", source: str = "source", preference: Preference = None, weights: Sequence[int] = WEIGHTS, share: float = 1.0, seed: str = "mix", repeat: int = REPEAT, size: Column | None = None) -> DataFrame:
    """docs with size, source_size, target and copies: how often the mix takes each document. Columns of these names are replaced.

    A null text has size 0, and a source of size 0 the target 0. Rows of the same key and source
    and size rank alike: the sample takes all of them or none. A null source is a source; a null
    key is a key. preference, a column or a function of the size, makes a document's copies more or
    fewer than its source's others': null and NaN count as 1, with 0 or less there is no copy; no
    document has more than `repeat`. size stands for the number of words of the text,
    where that is known already: then docs need no text.
    """
    found = _mixed(docs, text, key, source, preference, weights, share, seed, repeat, size)
    new = ["size", "source_size", "target", "copies"]
    return found.select(*(F.col("_doc")[c].alias(c) for c in docs.columns if c not in new), *new)


def mixed(docs: DataFrame, text: str = "text", key: str = "doc_id", source: str = "source", preference: Preference = None, weights: Sequence[int] = WEIGHTS, share: float = 1.0, seed: str = "mix", repeat: int = REPEAT, size: Column | None = None) -> DataFrame:
    """The rows that the mix takes, each as often as it takes them, with the columns of docs."""
    found = _mixed(docs, text, key, source, preference, weights, share, seed, repeat, size)
    return found.select("_doc", F.explode(F.array_repeat(F.lit(1), F.col("copies"))).alias("_copy")).select("_doc.*")


def op2_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken and copies of every document; texts of less than SHORT words are preferred half as much as others."""
    # Texts are counted and left behind: the decision needs key, source and size.
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", size_of(F.col("text")).alias("words"))
    found = mix(docs, size=F.col("words"), preference=by_length)
    return found.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def _oracle() -> str:
    rounds = ""
    for k in range(ROUNDS):
        before = " + ".join(f"coalesce(t{i}, 0)" for i in range(k)) or "0"
        rounds += f"""
f{k} AS (SELECT *, rest - sum(size * ({before})) OVER (PARTITION BY source) AS fits{k}, ({before}) = 0 AS open{k} FROM {f"r{k - 1}" if k else "r"}),
r{k} AS (SELECT *, CASE WHEN expected < {REPEAT} AND open{k} AND size <= fits{k} AND
  sum(CASE WHEN open{k} AND size <= fits{k} THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY rank, doc_id) <= fits{k} THEN 1 ELSE 0 END AS t{k} FROM f{k}),"""
    return rf"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3) + 1]::DOUBLE AS weight FROM d GROUP BY source),
c AS (SELECT *, (source_size * {REPEAT})::DOUBLE AS cap FROM s),
l AS (SELECT *, (sum(source_size) OVER ())::DOUBLE - (sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS UNBOUNDED PRECEDING) - cap) AS left_words,
  sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS left_weight FROM c),
v AS (SELECT left_words / left_weight AS level FROM l WHERE left_words / left_weight * weight <= cap ORDER BY cap / weight LIMIT 1),
g AS (SELECT source, source_size, least(cap, coalesce((SELECT level FROM v) * weight, cap)) AS target FROM c),
o AS (SELECT *, CASE WHEN size < {SHORT} THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS liked FROM d),
w AS (SELECT source, sum(size * liked) AS wished, sum(CASE WHEN liked = 1 THEN size * {REPEAT}.0::DOUBLE ELSE 0 END) AS full_words, sum(CASE WHEN liked < 1 THEN size * liked ELSE 0 END) AS rest_wished FROM o GROUP BY source),
h AS (SELECT g.*, CASE WHEN wished = 0 THEN 0 WHEN target / wished >= {REPEAT} AND full_words > 0 AND rest_wished > 0 THEN greatest(target / wished, (target - full_words) / rest_wished) ELSE target / wished END AS rate
  FROM g JOIN w ON g.source IS NOT DISTINCT FROM w.source),
e AS (SELECT o.*, source_size, target, least({REPEAT}.0::DOUBLE, rate * liked) AS expected,
  (('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE AS u
  FROM o JOIN h ON o.source IS NOT DISTINCT FROM h.source),
p AS (SELECT *, floor(expected) AS certain, expected - floor(expected) AS p FROM e),
q AS (SELECT *, u * (1 - p) / (u * (1 - p) + p * (1 - u)) AS rank FROM p),
r AS (SELECT *, greatest(0, target - sum(certain * size) OVER (PARTITION BY source)) AS rest FROM q),{rounds}
z AS (SELECT *, (certain + {" + ".join(f"t{k}" for k in range(ROUNDS))})::BIGINT AS copies FROM r{ROUNDS - 1})
SELECT doc_id, size, source_size, target, (copies * size)::BIGINT AS taken, copies::INTEGER AS copies FROM z
"""


ORACLE = _oracle()
