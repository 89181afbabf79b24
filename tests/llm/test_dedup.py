"""Operators 3 and 9 against plain versions."""

import hashlib
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from relengine.llm.components import connected_components
from relengine.llm.op3_exact_dedup import exact_dedup, exact_groups
from relengine.llm.op9_jaccard_join import near_dedup, similar_components


def plain_groups(rows):
    groups = defaultdict(list)
    for d, t, *_ in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(d)
    return {d: (min(g), len(g), d == min(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for d in g}


@pytest.mark.parametrize("block, hot", [(16, 1_000), (16, 1), (16 << 10, 2)])
def test_exact(docs, rows, block, hot, monkeypatch):
    monkeypatch.setattr("relengine.llm.common.HOT_ROWS", hot)
    monkeypatch.setattr("relengine.llm.common.HOT_SHARE", 1_000)
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_groups(docs, block=block).collect()}
    assert got == plain_groups(rows)


def test_exact_when_fingerprints_clash(docs, rows):
    few = lambda x: F.pmod(F.xxhash64(x), F.lit(5))
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_groups(docs, block=1000, fingerprint=few).collect()}
    assert got == plain_groups(rows)


def test_exact_rows(docs, rows, odd, none):
    want = sorted(d for d, x in plain_groups(rows).items() if x[2])
    kept = exact_dedup(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == want
    assert exact_dedup(odd).columns == odd.columns
    assert sorted(((r.doc_id or 0), r.text or "") for r in exact_dedup(odd).collect()) == [(1, "a b c d e f g h i j k l"), (1, "z"), (2, "")]
    assert exact_dedup(none).count() == 0 and exact_groups(none).count() == 0


def shingles(text):
    own = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(own[i : i + 5]) for i in range(len(own) - 4)} if len(own) >= 5 else {tuple(own)} if own else set()


def plain_components(rows):
    sets = {d: shingles(t) for d, t, *_ in rows}
    root = {d: d for d in sets}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(s), find(d)) for d, s in sets.items()}


def test_near(docs, rows):
    want = plain_components(rows)
    assert len({c for _, c in want.values()}) < len(rows) - 20
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in similar_components(docs).collect()} == want


def test_near_chain_and_hot_group(spark):
    """A chain of texts of which only neighbours link, and many near copies around one text."""
    base = [f"w{i}" for i in range(60)]
    rows = [(100 + k, " ".join(base[k : k + 50])) for k in range(0, 10, 2)]
    hot = [f"h{i}" for i in range(80)]
    rows += [(200 + k, " ".join([*hot[:k], f"new{k}", *hot[k + 1 :]])) for k in range(60)]
    rows += [(300 + k, " ".join([*hot[:40], *(f"other{k}_{i}" for i in range(40))])) for k in range(40)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in similar_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    assert got == plain_components(rows)


def test_near_rows(docs, rows, odd, none):
    want = sorted(d for d, (n, c) in plain_components(rows).items() if d == c)
    kept = near_dedup(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == want
    found = sorted(((r.doc_id or 0), r.n_shingles, r.component_id or 0) for r in similar_components(odd).collect())
    # Rows of key 1 are one document; the row of a null key has the same set and so its id.
    assert found == [(0, 0, 0), (0, 8, 1), (1, 1, 1), (1, 8, 1), (1, 8, 1), (2, 0, 2)]
    # The row of a null key goes as a copy of those of key 1, which are one row twice.
    left = near_dedup(odd)
    assert left.columns == odd.columns and sorted((r.doc_id or 0, r.text or "") for r in left.collect()) == [(0, ""), (1, "a b c d e f g h i j k l"), (1, "a b c d e f g h i j k l"), (1, "z"), (2, "")]
    assert near_dedup(none).count() == 0 and similar_components(none).count() == 0


def test_near_rows_of_one_key(spark):
    """Of near copies without a key, or of one key, one row stays."""
    base = [f"w{i}" for i in range(60)]
    rows = [(None, " ".join([*base[:k], "x", *base[k + 1 :]])) for k in (10, 59)] + [(5, " ".join(f"v{i}" for i in range(60 + k))) for k in range(3)] + [(5, "else")]
    got = near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, (r.text or "")[:1]) for r in got) == [(0, "w"), (5, "e"), (5, "v")]


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 160)] + [(7, 7), (3, 2), (2, 3), (None, 5)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{k: 100 for k in range(100, 160)}}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def template_corpus(n=60, seed=8):
    """Texts that share about 85 per cent of their shingles, too little to link, and some near copies of these that do."""
    rng = random.Random(seed)
    shared = [f"t{i}" for i in range(170)]
    rows = []
    for i in range(n):
        own = [f"o{i}_{rng.randrange(10**6)}" for _ in range(30)]
        rows.append((len(rows), " ".join(shared + own)))
        if i % 6 == 0:
            rows.append((len(rows), " ".join([*shared, *own[:-2], "x", "y"])))
        if i % 10 == 0:
            rows.append((len(rows), " ".join([*shared[:-20], *own])))
    rng.shuffle(rows)
    return [(i, t, None, None) for i, (_, t) in enumerate(rows)]


@pytest.mark.parametrize("run", [2_000, 7])
def test_a_template_that_many_texts_share(spark, monkeypatch, run):
    """No link is lost where runs are long and cut into blocks, and the shared passage gives no pairs of its own."""
    from relengine.llm import op9_jaccard_join as op9

    monkeypatch.setattr(op9, "RUN", run)
    rows = template_corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in op9.similar_components(docs).collect()}
    assert got == plain_components(rows) and 60 <= len({c for _, c in got.values()}) < len(rows)
    found, members = op9.similar_pairs(docs)
    assert plain_links(rows) == linked_rows(found, members)


def plain_links(rows, threshold=80):
    sets = {d: x for d, t, *_ in rows for x in [shingles(t)] if x}
    keys = sorted(sets)
    return {(a, b) for i, a in enumerate(keys) for b in keys[i + 1 :] if 100 * len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b])}


def linked_rows(found, members):
    """Pairs of keys: those of one class, and those of classes that are linked."""
    of = {}
    for r in members.collect():
        if r["class"] is not None:
            of.setdefault(r["class"], []).append(r.doc_id)
    pairs = {(a, b) for own in of.values() for a in own for b in own if a < b}
    links = [(r.a, r.b) for r in found.collect()]
    assert len(links) == len(set(links))
    return pairs | {tuple(sorted((x, y))) for a, b in links for x in of[a] for y in of[b]}


def test_all_links(docs, rows):
    from relengine.llm.op9_jaccard_join import similar_pairs

    found, members = similar_pairs(docs)
    assert linked_rows(found, members) == plain_links(rows) and members.count() == len(rows)
