"""Operators 2 and 5 against plain versions."""

import math
import random
import re
from collections import Counter, defaultdict

import pytest
import xxhash

from relengine.llm.op2_mix import mix, mixed, targets
from relengine.llm.op5_quality_rules import quality_columns, quality_filter, weights

SPLIT = r"[^\x20\x09-\x0D]+"


def plain_targets(sizes, cycle=(5, 2, 1), repeat=3):
    names = sorted(sizes, key=lambda x: (x is None, x or ""))
    weight = {s: cycle[i % len(cycle)] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in capped]
        left = total - sum(capped.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > repeat * sizes[s]]
        if not over:
            return {**capped, **share}
        capped |= {s: repeat * sizes[s] for s in over}


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 100, "c": 100}, {"a": 1, "b": 1000, "c": 5, None: 50}, {"a": 0, "b": 10}, {"x": 7}, {"a": 3, "b": 2, "c": 900, "d": 20, "e": 1}])
def test_targets(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, size long")
    got = {r.source: r.target for r in targets(df).collect()}
    want = plain_targets(sizes)
    assert got.keys() == want.keys() and all(math.isclose(got[s], want[s], rel_tol=1e-9, abs_tol=1e-9) for s in want)


def test_mix(docs, rows):
    got = {r.doc_id: r for r in mix(docs).collect()}
    assert len(got) == len(rows)
    size = {d: len(re.findall(SPLIT, t or "")) for d, t, *_ in rows}
    sums, taken, largest = Counter(), Counter(), defaultdict(int)
    for d, _, _, s in rows:
        sums[s] += size[d]
    want = plain_targets(dict(sums))
    for d, t, _, s in rows:
        r = got[d]
        assert r["size"] == size[d] and r.source_size == sums[s] and math.isclose(r.target, want[s], rel_tol=1e-9)
        assert 0 <= r.copies <= 3 and abs(r.copies - want[s] / sums[s]) < 1
        taken[s] += r.copies * size[d]
        largest[s] = max(largest[s], size[d])
    for s in sums:
        # What is left over is less than what the smallest documents would fill, and never too much.
        assert want[s] - 0.6 * largest[s] <= taken[s] <= want[s] + 1e-6
    again = {r.doc_id: r.copies for r in mix(docs.repartition(5)).collect()}
    assert again == {d: r.copies for d, r in got.items()}
    out = mixed(docs)
    assert out.columns == docs.columns and Counter(r.doc_id for r in out.collect()) == Counter({d: r.copies for d, r in got.items() if r.copies})


def test_preference(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(i, "a b c d", "s" if i % 2 else "t") for i in range(200)], "doc_id long, text string, source string")
    got = mix(df, preference=F.when(F.col("doc_id") < 100, 3.0).otherwise(1.0)).collect()
    first, rest = (sum(r.copies for r in got if (r.doc_id < 100) is x) for x in (True, False))
    assert first > 1.5 * rest and sum(r.copies for r in got) >= 196


def test_unequal_probabilities(spark):
    """Copies follow the preference: expected ones are met on average, and what the limit of 3 cuts off others get."""
    from pyspark.sql import functions as F

    df = spark.range(3000).selectExpr("id AS doc_id", "'a b c d e' AS text", "if(id % 3 = 0, 's', 't') AS source")
    liked = F.when(F.col("doc_id") % 10 == 0, 8.0).when(F.col("doc_id") % 10 < 5, 1.0).otherwise(0.25)
    mean = {}
    for seed in ("a", "b", "c"):
        for r in mix(df, preference=liked, seed=seed).groupBy("source", (F.col("doc_id") % 10).alias("k")).agg(F.avg("copies").alias("m")).collect():
            mean.setdefault((r.source, 8.0 if r.k == 0 else 1.0 if r.k < 5 else 0.25), []).append(r.m)
    for s, size in (("s", 1000), ("t", 2000)):
        n = {8.0: size // 10, 1.0: 4 * size // 10, 0.25: 5 * size // 10}
        copies, rate = plain_targets({"s": 1000, "t": 2000})[s], None
        full: set = set()
        while True:
            rate = (copies - 3 * sum(n[p] for p in full)) / sum(n[p] * p for p in n if p not in full)
            more = {p for p in n if p not in full and rate * p >= 3}
            if not more:
                break
            full |= more
        for p in n:
            assert abs(sum(mean[s, p]) / len(mean[s, p]) - min(3, rate * p)) < 0.06 + 2e-2 * rate


def test_odd_preferences(spark):
    from pyspark.sql import functions as F

    df = spark.range(60).selectExpr("id AS doc_id", "'a b c' AS text", "'s' AS source", "CASE id % 5 WHEN 0 THEN NULL WHEN 1 THEN 0D WHEN 2 THEN -1D WHEN 3 THEN double('NaN') ELSE 1D END AS liked")
    got = mix(df, preference=F.col("liked")).collect()
    assert all(r.copies == 0 for r in got if r.doc_id % 5 in (1, 2)) and sum(r.copies for r in got) == 60
    assert sum(r.copies for r in mix(df, preference=F.lit(0.0)).collect()) == 0


def test_inclusion_does_not_follow_the_length(spark):
    """With one preference, short and long documents are taken equally often, though rounds are filled up with what fits."""
    from pyspark.sql import functions as F

    df = spark.range(2000).selectExpr("id AS doc_id", "CAST(if(id % 2 = 0, 10, 300) AS long) AS words", "if(id % 4 < 2, 's', 't') AS source")
    found = []
    for seed in ("a", "b", "c", "d"):
        got = mix(df, text="doc_id", size=F.col("words"), seed=seed).groupBy("size").agg(F.avg(F.col("copies") / (F.col("target") / F.col("source_size"))).alias("m")).collect()
        found.append({r["size"]: r.m for r in got})
    assert all(abs(sum(x[k] for x in found) / len(found) - 1) < 0.03 for k in (10, 300))


def test_mix_odd(odd, none):
    assert mix(odd).count() == 6 and mixed(odd).columns == odd.columns
    assert mix(none).count() == 0 and mixed(none).count() == 0


def test_mix_no_words(spark):
    """A source of only null, empty and white texts has the target 0, and the others share all words. Texts of size 0 always fit, as in the SQL."""
    rows = [(0, None, "a"), (1, "", "a"), (2, " \t\n ", "a"), *((i, "w " * 10, "b" if i % 2 else "c") for i in range(3, 23))]
    for some in (rows, rows[:3]):
        got = mix(spark.createDataFrame(some, "doc_id long, text string, source string")).collect()
        assert len(got) == len(some)
        assert all((r["size"], r.source_size, r.target, r.copies) == (0, 0, 0.0, 1) for r in got if r.source == "a")
        want = plain_targets({s: sum(len((t or "").split()) for _, t, x in some if x == s) for _, _, s in some})
        for s in want:
            assert all(math.isclose(r.target, want[s]) for r in got if r.source == s)
            assert want[s] - 10 < sum(r.copies * r["size"] for r in got if r.source == s) <= want[s] + 1e-6


def plain_rules(text):
    own = re.findall(SPLIT, text or "")
    n = len(own)
    windows = Counter(tuple(own[i : i + 5]) for i in range(n - 4))
    hit = {j for i in range(n - 4) if windows[tuple(own[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if re.search(SPLIT, x)]
    return n, sum(map(len, own)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit), n < 10 or 100 * len(hit) > 20 * n


def grams(text, buckets):
    own = re.findall(SPLIT, text or "")

    def h(x, seed=42):
        return xxhash.xxh64(x.encode(), seed=seed).intdigest()

    for a, b in zip(own, [*own[1:], None], strict=False):
        yield h(a) % buckets
        yield (h(b, h(a)) if b is not None else h(a)) % buckets
        # Spark hashes an int as its four bytes.
        yield xxhash.xxh64((1).to_bytes(4, "little"), seed=h(a[-2:])).intdigest() % buckets


def test_rules(spark, rows):
    line = "the same five words again\n"
    more = [(1000, line * 8, "en", "s"), (1001, "a b c d e f g h i j\n" + line + "k\n" + line, "en", "s"), (1002, "x | y | z * # $ % & < > w v", "en", "s"), (1003, "a a a a a a b b b b b b", "en", "s")]
    every = rows + more
    docs = spark.createDataFrame(every, "doc_id long, text string, lang string, source string")
    good = spark.createDataFrame([(d,) for d in range(0, 100, 2)], "doc_id long")
    log_ratio = weights(docs, good, buckets=256)
    target, raw = Counter(), Counter()
    for d, t, *_ in every:
        own = list(grams(t, 256))
        raw.update(own)
        if d < 100 and d % 2 == 0:
            target.update(own)
    want = [math.log((target[b] + 1) / (target.total() + 256)) - math.log((raw[b] + 1) / (raw.total() + 256)) for b in range(256)]
    assert all(math.isclose(a, b, rel_tol=1e-12, abs_tol=1e-12) for a, b in zip(log_ratio, want, strict=True))
    for r in quality_columns(docs, log_ratio, threshold=0.0).collect():
        plain = plain_rules(r.text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == plain, r.doc_id
        own = list(grams(r.text, 256))
        score = sum(want[b] for b in own) / len(own) if own else 0.0
        assert math.isclose(r.score, score, rel_tol=1e-9, abs_tol=1e-12) and r.kept == (not plain[-1] and r.score >= 0.0)


def test_rules_odd(spark, odd, none):
    keys = odd.select("doc_id")
    assert quality_filter(odd, keys).columns == odd.columns and quality_columns(odd, [0.0] * 4).count() == 6
    assert quality_filter(none, keys).count() == 0 and quality_filter(odd, keys.limit(0)).count() >= 0


@pytest.mark.parametrize("sent", [16 << 20, 0])
def test_every_trusted_row_counts(spark, monkeypatch, sent):
    """No trusted row is left out, however many there are, whether their keys are sent or rows move."""
    monkeypatch.setattr("relengine.llm.op5_quality_rules.SENT_BYTES", sent)
    rows = [(i, f"common w{i % 7}") for i in range(30_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    every = weights(docs, docs.select("doc_id"), buckets=64)
    assert all(abs(w) < 1e-3 for w in every)
    # One row of the trusted ones is of another kind: its word counts as one.
    odd = spark.createDataFrame([*rows, (30_000, "strange")], "doc_id long, text string")
    with_, without = (weights(odd, odd.filter(f"doc_id < {n}").select("doc_id"), buckets=1 << 14) for n in (30_001, 30_000))
    assert max(a - b for a, b in zip(with_, without, strict=True)) > math.log(1.9)


def test_filters_stay_above(spark, rows):
    """A caller's filter on any new column ends, and keeps what it should."""
    docs = spark.createDataFrame(rows * 3, "doc_id long, text string, lang string, source string")
    found = quality_columns(docs, [0.01 * (i % 5 - 2) for i in range(1 << 14)])
    every = found.collect()
    for test in ("kept", "not base_failed", "score > 0", "n_repeat_words > 0", "n_words > 50 and n_symbols = 0"):
        got = found.filter(test)
        want = sum(bool(eval(test.replace("not ", "not r.") if test.startswith("not") else "r." + test.replace(" = ", " == ").replace("and n", "and r.n"))) for r in every)
        assert got.select("doc_id").count() == want
        assert got.count() == want


def test_other_column_names(spark):
    df = spark.createDataFrame([(i, " ".join(f"w{i * j % 17}{j}" for j in range(40)), i) for i in range(30)] + [(99, None, 1)], "id long, body string, _text int")
    kept = quality_filter(df, df.select("id"), text="body", key="id")
    assert kept.columns == df.columns and kept.count() == 30


@pytest.mark.parametrize("n_trusted", [0, 20, 75])
def test_few_labels(spark, n_trusted):
    """Clean texts of four languages stay, however few labels there are; with enough of them junk goes."""
    rng = random.Random(3)
    rows = []
    for i in range(400):
        own = ["abcde", "fghij", "klmno", "pqrst"][(i % 20 > 10) + (i % 20 > 15) + (i % 20 > 18)]
        rows.append((i, " ".join("".join(rng.choices(own, k=rng.randint(1, 4))) for _ in range(300))))
    junk = [(1000 + i, " ".join("#*$%&|<>"[rng.randrange(8)] + str(rng.randrange(50)) for _ in range(300))) for i in range(40)]
    docs = spark.createDataFrame(rows + junk, "doc_id long, text string")
    trusted = spark.createDataFrame([(d,) for d in rng.sample(range(400), n_trusted)], "doc_id long")
    kept = {r.doc_id for r in quality_filter(docs, trusted).collect()}
    assert kept >= {d for d, _ in rows}
    if n_trusted == 75:
        assert not kept & {d for d, _ in junk}
    if not n_trusted:
        assert all(abs(w) < 1e-9 for w in weights(docs, trusted))
