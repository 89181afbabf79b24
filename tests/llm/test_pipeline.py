"""The pipeline against a plain version of its stages, on small tables."""

import hashlib
import re
from collections import Counter

import pytest

import corpus_pipeline
from relengine.llm.op2_mix import SHORT
from relengine.llm.op5_quality_rules import quality_columns, trusted_keys, weights
from relengine.llm.op6_bpe import coder
from relengine.llm.registry import ORACLE_SQL, QUERIES
from relengine.llm.vocabulary import default_path

from .conftest import SCHEMA, corpus
from .test_dedup import plain_components, plain_groups
from .test_mix_and_rules import SPLIT, plain_targets


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    to = str(tmp_path_factory.mktemp("tables"))
    rows = corpus(9, 90)
    spark.createDataFrame(rows, SCHEMA).selectExpr("*", "cast(length(text) as long) AS n_chars").write.parquet(f"{to}/documents.parquet")
    spark.createDataFrame([(i, int(i % 5 != 0), 0) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{to}/labels.parquet")
    return to


def test_stages(spark, folder, monkeypatch):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    verdicts = quality_columns(docs, weights(docs, trusted_keys(labels))).collect()
    rows = [(r.doc_id, r.text, r.lang, r.source) for r in verdicts if r.kept]
    assert 20 < len(rows) < 90
    keep = plain_groups(rows)
    rows = [r for r in rows if keep[r[0]][2]]
    near = plain_components(rows)
    rows = [r for r in rows if near[r[0]][1] == r[0]]
    text = {d: t for d, t, *_ in rows}

    # run() itself, with a look at what each stage returns.
    columns = []
    watched = [(n, lambda *a, f=f: columns.append((df := f(*a)).columns) or df) for n, f in corpus_pipeline.STAGES]
    monkeypatch.setattr(corpus_pipeline, "STAGES", watched)
    got = corpus_pipeline.run(spark, folder).collect()
    assert columns[:-1] == [docs.columns] * 4
    copies = Counter(r.doc_id for r in got)
    assert copies.keys() <= text.keys() and max(copies.values()) <= 3
    sizes = Counter()
    for _, t, _, s in rows:
        sizes[s] += len(re.findall(SPLIT, t))
    goal, source = plain_targets(dict(sizes)), {d: s for d, _, _, s in rows}
    # Copies are within one of the expected ones, whose words add up to the target of the source.
    own = {d: len(re.findall(SPLIT, text[d])) for d in text}
    for s in sizes:
        liked = {d: 0.5 if own[d] < SHORT else 1.0 for d in text if source[d] == s}
        rate = goal[s] / sum(own[d] * p for d, p in liked.items())
        if rate >= 3 and any(p < 1 for p in liked.values()):
            full = sum(3 * own[d] for d, p in liked.items() if p == 1)
            rate = max(rate, (goal[s] - full) / sum(own[d] * p for d, p in liked.items() if p < 1))
        assert all(abs(copies[d] - min(3, rate * p)) < 1 + 1e-9 for d, p in liked.items())
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(default_path())
    for r in got:
        ids = library.encode(text[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text[r.doc_id].encode()).hexdigest()


def test_registered():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES) == list(range(1, 11)) and ORACLE_SQL.keys() <= QUERIES.keys()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "exact_copies", "near_copies", "mixing", "bpe"]
    assert coder(default_path()) is coder(default_path())


ODD = "doc_id long, text string, lang string, source string, n_chars long, kept int, size string, _key string, _gone string"


@pytest.mark.parametrize("rows", [
    [],
    [(None, None, None, None, None, None, None, None, None)] * 3,
    [(None, "w" + " word".join(map(str, range(60))), None, None, None, 1, "x", "k", "g")] * 2 + [(7, "w" + " word".join(map(str, range(60))), "en", "s", 1, 0, "y", None, None)] * 2 + [(8, "", None, "t", None, None, None, None, None)],
])
def test_odd_tables(spark, tmp_path, rows):
    """Empty tables, nulls in every column, repeated rows and columns of names that operators use: stages end and keep the columns."""
    spark.createDataFrame(rows, ODD).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns
    got = [r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()]
    assert got == [] if len(rows) < 4 else len(got) >= 1 and set(got) <= {7, None}
