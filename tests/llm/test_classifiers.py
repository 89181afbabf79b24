"""Operators 4 and 7: held-out accuracy on small corpora, and odd input."""

import random

import numpy as np
import pyarrow as pa

from relengine.llm import op4_quality_classifier as quality
from relengine.llm import op7_language_id as language
from relengine.llm.labelled import sample, spread_parts, text_blocks


def texts(seed, n):
    rng = random.Random(seed)
    alphabets = {"aa": "abcdefgh", "bb": "éèàçoiu", "cc": "ñóíxyzk"}
    out = []
    for i in range(n):
        lang = list(alphabets)[i % 3]
        own = ["".join(rng.choices(alphabets[lang], k=rng.randint(2, 7))) for _ in range(rng.randint(5, 80))]
        bad = i % 4 == 0
        out.append((" ".join(w + "***" if bad else w for w in own), lang, int(not bad)))
    return out


def test_quality():
    numbers, bias = quality.train([(t, y) for t, _, y in texts(1, 300)], epochs=4)
    held = texts(2, 200)
    p = quality.score_texts(pa.array([t for t, *_ in held]), numbers, bias)
    assert np.mean((p >= 0.3) == [y for *_, y in held]) > 0.97 and p.min() >= 0 and p.max() <= 1


def test_scores_depend_on_the_text_alone():
    numbers, bias = quality.train([(t, y) for t, _, y in texts(1, 60)], epochs=1)
    own = [t for t, *_ in texts(3, 20)]
    alone = [quality.score_texts(pa.array([t]), numbers, bias)[0] for t in own]
    assert np.allclose(quality.score_texts(pa.array(own), numbers, bias), alone)


def test_blocks():
    long_ = " ".join(["wörd"] * 1000)
    got = list(text_blocks(pa.array([long_, None, "", "tail\t."]), most=512))
    assert sum(int((points != 32).sum()) for points, *_ in got) == 4005 and len(got) >= 5
    assert {int(o) for *_, owners in got for o in owners} == {0, 3}
    assert list(text_blocks(pa.array([None, ""], pa.string()))) == []


def test_features():
    """Words, pairs of words and the n-grams of each word with its two marks, and nothing across words or texts."""

    def found(*texts):
        ((points, starts, _),) = text_blocks(pa.array(texts))
        ids, piece = quality.features(points, starts)
        return [sorted(ids[piece == i].tolist()) for i in range(len(texts))]

    # "<é>" has one n-gram of 3; "<abc>" three of 3, two of 4, one of 5.
    assert [len(x) for x in found("é", "abc", "é abc", "abc abc")] == [1 + 1, 6 + 1, 2 + 7 + 1, 14 + 1]
    alone, joined = found("é", "abc"), found("é abc")
    assert set(alone[0]) | set(alone[1]) < set(joined[0]) and found("abc", "é") == alone[::-1]
    repeated = set(found("xy xy")[0]) & set(found("abc abc")[0])
    assert len(repeated) == 1


def test_gradient():
    """One step moves each vector against the gradient of the loss: along its share of the document."""
    rows = [("aa bb aa", 1), ("cc dd", 0)]
    quiet = [quality.score_texts(pa.array([t]), *quality.train(rows, epochs=1, rate=r))[0] for t in ("aa bb aa",) for r in (0.0, 1.0, 10.0)]
    assert quiet[0] < quiet[1] < quiet[2]


def test_long_texts_are_learned_from(spark):
    """No labelled row is left out for its length, and labels without a document take no place in the sample."""
    long_ = " ".join(f"w{i}" for i in range(30_000))
    docs = spark.createDataFrame([(i, long_ if i % 2 else f"short {i}") for i in range(20)] + [(50, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)] + [(i, 1) for i in range(50, 400)], "doc_id long, quality int")
    got = sample(labels, docs, "quality", most=20)
    assert len(got) == 20 and sum(y for _, y in got) == 10
    for text, y in got:
        assert len(text) <= (32 << 10) + 8 and (not y or ("w0 " in text and "w29999" in text and "w15" in text))
    (r,) = spark.createDataFrame([("abcdefghij" * 10,)], "t string").select(spread_parts(__import__("pyspark").sql.functions.col("t"), 16, 8).alias("p")).collect()
    assert len(r.p.split(" ")) == 8 and all(len(x) == 2 for x in r.p.split(" "))


def test_language():
    network = language.train([(t, y) for t, y, _ in texts(1, 200)], epochs=4)
    held = texts(2, 150)
    named, score = language.identify(pa.array([t for t, *_ in held]), network, network.pairs())
    assert np.mean(np.array(named) == [y for _, y, _ in held]) > 0.97 and score.min() > 0 and score.max() <= 1
    named, score = language.identify(pa.array([None, "", " 12 ??", "abc " * 20_000]), network, network.pairs())
    assert named == ["und", "und", "und", "aa"] and score[:3].tolist() == [0, 0, 0]


def test_pairs_are_the_filters():
    network = language.train([(t, y) for t, y, _ in texts(1, 30)], epochs=1)
    w = language.windows_of(b"some bytes of a text " * 20)
    pooled = np.concatenate([sum(t[k][w[:, k : k + language.WINDOW - n + 1].astype(int)] for k in range(n)).max(1) for n, t in zip(language.WIDTHS, network.tables, strict=True)], 1)
    z = np.maximum(pooled + network.shift, 0) @ network.out + network.bias
    p = np.exp(z - z.max(1, keepdims=True))
    assert np.allclose(network.probabilities(w, network.pairs()), p / p.sum(1, keepdims=True), atol=1e-5)


def test_on_tables(spark, docs, rows, odd, none):
    labels = spark.createDataFrame([(i, i % 2) for i in range(100)] + [(None, 1), (3, None)], "doc_id long, quality int")
    got = sample(labels, docs, "quality", most=40)
    assert len(got) == 40 and got == sample(labels, docs.repartition(2), "quality", most=40)
    numbers, bias = quality.train(got, epochs=1)
    scores = quality.quality_scores(docs, numbers, bias).collect()
    assert len(scores) == len(rows) and all(0 <= r.score <= 1 for r in scores)
    network = language.train(sample(docs, docs, "lang", most=60), epochs=1)
    assert language.languages(docs, network).filter("lang_pred NOT IN ('en', 'de', 'und')").count() == 0
    for df, n in ((odd, 6), (none, 0)):
        assert quality.quality_scores(df, *quality.train([])).count() == n
        assert language.languages(df, language.train([])).filter("lang_pred = 'und' AND score = 0").count() == n
