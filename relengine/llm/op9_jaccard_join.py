"""A similarity self-join on word shingles, by rare-first prefix filtering.

Documents link if 100 * |intersection| >= THRESHOLD * |union| of their sets of shingles, which stand
as 64-bit hashes. The join returns the components of all links, or the links themselves, and is
exact up to collisions of these hashes.

1. Documents with equal sets form classes; only classes are joined. A class is named by a 64-bit
   digest of its set; a second digest checks that no two sets share a name (else the seed changes).
2. Shingles are ordered by how often the corpus has them, rarest first, and by hash. Frequencies
   are sums of hashed counters over all documents, whose number follows the size of the corpus
   between fixed bounds; the order only has to be the same everywhere, it needn't be exact.
3. Two sets that link share a shingle of their first n - ceil(t n) + 1 ones. These prefixes are
   sorted by (shingle, size, class) over range partitions, so a frequent shingle spreads over many
   partitions, and what has no neighbour of a fitting size goes at once (length filter).
4. A run is all classes of one shingle. First each meets ROUNDS leaders of its run only: classes
   of which other texts share most of the prefix. Verified links give components. Then all pairs
   of a run that lie in different components follow, by the length and positional filters,
   skipping pairs that share the shingle before as well, which another run pairs. The smaller set of
   a pair needs a shorter prefix, n - ceil(2t / (1 + t) n) + 1, so a passage that many sets share,
   but not enough to link, is in no such prefix and its run has no pairs. A long run is cut into
   blocks of about RUN classes that meet the run in tasks of their own. No pair within a component
   is emitted, and no link between components is lost: the components are exact.
5. A pair is verified once. The suffix filter bounds the overlap by the sizes of the parts into
   which fixed values cut both sets, from short signatures. Only the sets that are left are made
   again from the texts, sent and intersected.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from relengine.llm.common import durable, free, slices, table
from relengine.llm.components import connected_components

#: Words of a shingle, and the least similarity in per cent.
SHINGLE, THRESHOLD = 5, 80
#: Hashed counters of shingles, as powers of two, at least and at most (int32, in each worker), and in a row of them.
COUNTERS, CHUNK = (21, 24), 1 << 16
#: Bits of the maps that tell which sets are wanted.
MARKS = 24
#: Classes of a block of a long run.
RUN = 2_000
#: Bytes of text that are hashed together.
BLOCK = 2 << 20
#: Parts of the range of hashes that the suffix filter counts in.
PARTS = 128
#: Rounds in which the classes of a run meet one or two of them before all pairs do.
ROUNDS = 3

_ODD = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD1342543DE82EF95)
_BYTES = (np.arange(1, 257, dtype=np.uint64) * np.uint64(0xBF58476D1CE4E5B9)) ^ np.uint64(0x94D049BB133111EB)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOWER[9:14] = 32


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_sets(texts: list[str | None], seed: int = 0, width: int = SHINGLE) -> Iterator[np.ndarray]:
    """The hashes of the distinct shingles of each text, ascending. A-Z are lower-cased; fewer words than `width` are one shingle; no words, none."""
    at = 0
    while at < len(texts):
        upto, size, raws = at, 0, []
        while upto < len(texts) and (not raws or size < BLOCK):
            raws.append((texts[upto] or "").encode())
            size += len(raws[-1])
            upto += 1
        raw = _LOWER[np.frombuffer(b" " + b" ".join(raws) + b" ", np.uint8)]
        solid = raw != 32
        edges = np.flatnonzero(solid[1:] != solid[:-1]) + 1
        begin, end = edges[::2], edges[1::2]
        if not len(begin):
            yield from (np.empty(0, np.uint64) for _ in raws)
            at = upto
            continue
        lens = end - begin
        heads = np.cumsum(lens) - lens
        place = np.arange(int(lens.sum())) - np.repeat(heads, lens)
        powers = np.cumprod(np.full(int(lens.max()), _STEP, np.uint64))
        words = _mix(np.add.reduceat(_BYTES[raw[solid]] * powers[place], heads) + np.uint64(seed))
        starts = 1 + np.cumsum([0] + [len(r) + 1 for r in raws[:-1]])
        first = np.append(np.searchsorted(begin, starts), len(begin))
        places = _mix(np.arange(1, 2 * width + 1, dtype=np.uint64)) | np.uint64(1)
        joined = np.zeros(max(0, len(words) - width + 1), np.uint64)
        for k in range(width):
            joined += words[k : k + len(joined)] * places[k]
        joined = _mix(joined)
        for i in range(len(raws)):
            a, b = first[i], first[i + 1]
            if b - a >= width:
                own = np.sort(joined[a : b - width + 1])
                keep = np.ones(len(own), bool)
                keep[1:] = own[1:] != own[:-1]
                yield own[keep]
            elif b > a:
                some = words[a:b] * places[width : width + b - a]
                yield _mix(some.sum(dtype=np.uint64, keepdims=True) + np.uint64(b - a))
            else:
                yield np.empty(0, np.uint64)
        at = upto


def set_names(own: np.ndarray) -> tuple[int, int]:
    """Two digests of a set, as signed 64-bit integers; the first is its class's name."""
    with np.errstate(over="ignore"):
        n = np.uint64(len(own))
        a = _mix(np.array([_mix(own * _ODD).sum(dtype=np.uint64) + n], np.uint64))
        b = _mix(np.array([_mix(own ^ _STEP).sum(dtype=np.uint64) * np.uint64(3) + n], np.uint64))
    return int(a.view(np.int64)[0]), int(b.view(np.int64)[0])


def signature(own: np.ndarray) -> bytes:
    """How many elements lie in each of PARTS parts of the range of hashes; 255 stands for that many or more."""
    return np.minimum(np.bincount((own >> np.uint64(64 - PARTS.bit_length() + 1)).astype(np.int64), minlength=PARTS), 255).astype(np.uint8).tobytes()


def _counters_for(docs: DataFrame) -> int:
    """The counters that a corpus of this size needs, as a power of two: about one for each 32 shingles, within bounds. A shingle begins at each word, of six bytes or so."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return min(max(COUNTERS[0], (total // 192).bit_length()), COUNTERS[1])


def _first_scan(docs: DataFrame, seed: int, power: int) -> DataFrame:
    """For each document its number of shingles and its set's names; for each partition its counters, packed, in rows of their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = np.zeros(1 << power, np.int32)
        empty = True
        for batch in slices(batches):
            keys, sizes, a, b, held, marks = batch.column("key"), [], [], [], [], []
            for own in shingle_sets(batch.column("text").to_pylist(), seed):
                sizes.append(len(own))
                x, y = set_names(own)
                a.append(x)
                b.append(y)
                held.append(own)
                marks.append(signature(own))
            every = np.concatenate(held)
            np.add.at(counters, (every >> np.uint64(64 - power)).astype(np.int64), 1)
            empty = False
            none = pa.nulls(len(sizes), pa.int32()), pa.nulls(len(sizes), pa.binary())
            yield pa.RecordBatch.from_arrays([keys, pa.array(sizes, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(marks, pa.binary()), *none], names=["key", "n", "node", "check", "sig", "chunk", "counters"])
        if not empty:
            nulls = {"key": keys.type, "n": pa.int64(), "node": pa.int64(), "check": pa.int64(), "sig": pa.binary()}
            for k, packed in _packed(counters):
                yield pa.RecordBatch.from_pydict({c: pa.nulls(1, t) for c, t in nulls.items()} | {"chunk": pa.array([k], pa.int32()), "counters": pa.array([packed], pa.binary())})

    kind = docs.schema["key"].dataType.simpleString()
    return docs.mapInArrow(run, f"key {kind}, n long, node long, check long, sig binary, chunk int, counters binary")


def _packed(counters: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """The chunks that hold anything."""
    for k in range(len(counters) // CHUNK):
        own = counters[k * CHUNK : (k + 1) * CHUNK]
        if own.any():
            yield k, zlib.compress(own.astype("<i4").tobytes(), 1)


def _frequencies(scanned: DataFrame, power: int) -> np.ndarray:
    """For each of 2 ** power counters the logarithm of all partitions' sum, in 2 ** -18 steps: less than 2 ** 24, and as exact as the sum however large that is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, packed in zip(batch.column("chunk").to_pylist(), batch.column("counters").to_pylist(), strict=True):
                own = np.frombuffer(zlib.decompress(packed), "<i4").astype(np.int64)
                sums[k] = sums[k] + own if k in sums else own
        for k, total in sums.items():
            steps = (np.log2(total + 1) * (1 << 18)).astype("<u4")
            yield pa.RecordBatch.from_pydict({"chunk": pa.array([k], pa.int32()), "counters": pa.array([zlib.compress(steps.tobytes(), 1)], pa.binary())})

    n = max(1, (1 << power) // CHUNK)
    rows = scanned.filter("chunk is not null").select("chunk", "counters").repartition(n, "chunk").mapInArrow(run, "chunk int, counters binary")
    out = np.zeros(1 << power, np.uint32)
    for r in rows.toLocalIterator():
        out[r["chunk"] * CHUNK : (r["chunk"] + 1) * CHUNK] = np.frombuffer(zlib.decompress(r["counters"]), "<u4")
    return out


def _prefixes(docs: DataFrame, frequencies, seed: int, threshold: int) -> DataFrame:
    """A row for each shingle of each document's prefix: token, n (size of the set), node, pos. A set that a task has met already is left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[int] = set()
        counts = frequencies.value
        shift = np.uint64(65 - len(counts).bit_length())
        for batch in slices(batches):
            tokens, sizes, nodes, lens = [], [], [], []
            for own in shingle_sets(batch.column("text").to_pylist(), seed):
                n = len(own)
                node = set_names(own)[0]
                if not n or node in met:
                    continue
                if len(met) > 1_000_000:
                    met.clear()
                met.add(node)
                order = counts[(own >> shift).astype(np.int64)].astype(np.uint64) << np.uint64(40) | own >> np.uint64(24)
                # own is ascending, and a stable order keeps ties that way.
                own = own[np.argsort(order, kind="stable")[: n - -(-threshold * n // 100) + 1]]
                tokens.append(own)
                sizes.append(n)
                nodes.append(node)
                lens.append(len(own))
            if tokens:
                every = np.concatenate(tokens).view(np.int64)
                place = np.arange(len(every)) - np.repeat(np.cumsum(lens) - lens, lens)
                yield pa.RecordBatch.from_arrays([pa.array(every), pa.array(np.repeat(sizes, lens).astype(np.int32)), pa.array(np.repeat(np.array(nodes, np.int64), lens)), pa.array(place.astype(np.int32))], names=["token", "n", "node", "pos"])

    return docs.select("text").mapInArrow(run, "token long, n int, node long, pos int")


def _runs(prefixes: DataFrame, threshold: int) -> DataFrame:
    """The rows of prefixes that have a neighbour of the same token and a fitting size, and those at the edge of a partition, which may have."""
    n = int(prefixes.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, kept = None, True  # the last row so far; the first of a partition stays
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            token, size, node = (rows.column(c).to_numpy() for c in ("token", "n", "node"))
            # The same set may come from several tasks: one row of it stays.
            lead = np.ones(len(token), bool)
            lead[1:] = (token[1:] != token[:-1]) | (node[1:] != node[:-1])
            rows, token, size = rows.filter(pa.array(lead)), token[lead], size[lead].astype(np.int64)
            fits = (token[1:] == token[:-1]) & (100 * size[:-1] >= threshold * size[1:])
            keep = np.zeros(len(token), bool)
            keep[1:] |= fits
            keep[:-1] |= fits
            keep[0] |= kept
            held, kept = rows.slice(len(token) - 1), bool(keep[-1])
            yield rows.slice(0, len(token) - 1).filter(pa.array(keep[:-1]))
        if held is not None:
            yield held

    ranged = prefixes.repartitionByRange(n, "token", "n", "node").sortWithinPartitions("token", "n", "node")
    return ranged.mapInArrow(run, prefixes.schema)


def _marked(nodes: DataFrame) -> np.ndarray:
    """A bit map of fixed size in which every node's bit is set, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << MARKS - 3, np.uint8)
        for batch in batches:
            at = batch.column("node").to_numpy() & ((1 << MARKS) - 1)
            np.bitwise_or.at(bits, at >> 3, (1 << (at & 7)).astype(np.uint8))
        if bits.any():
            yield pa.RecordBatch.from_pydict({"bits": pa.array([zlib.compress(bits.tobytes(), 1)], pa.binary())})

    # Maps are joined in a few tasks, then on the driver one by one.
    def union(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << MARKS - 3, np.uint8)
        for batch in batches:
            for packed in batch.column("bits").to_pylist():
                bits |= np.frombuffer(zlib.decompress(packed), np.uint8)
        if bits.any():
            yield pa.RecordBatch.from_pydict({"bits": pa.array([zlib.compress(bits.tobytes(), 1)], pa.binary())})

    out = np.zeros(1 << MARKS - 3, np.uint8)
    for r in nodes.select("node").mapInArrow(run, "bits binary").repartition(8).mapInArrow(union, "bits binary").toLocalIterator():
        out |= np.frombuffer(zlib.decompress(r["bits"]), np.uint8)
    return out


def _sets(docs: DataFrame, nodes: DataFrame, seed: int) -> DataFrame:
    """node and set (its hashes, ascending, 8 bytes each) of at least these classes. A bit map keeps most others from being sent; what it lets through joins with nothing."""
    wanted = docs.sparkSession.sparkContext.broadcast(_marked(nodes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, met = wanted.value, set()
        for batch in slices(batches):
            found, sets = [], []
            for own in shingle_sets(batch.column("text").to_pylist(), seed):
                node = set_names(own)[0]
                bit = node & ((1 << MARKS) - 1)
                if len(own) and bits[bit >> 3] >> (bit & 7) & 1 and node not in met:
                    if len(met) > 1_000_000:
                        met.clear()
                    met.add(node)
                    found.append(node)
                    sets.append(own.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(sets, pa.binary())], names=["node", "set"])

    rows = docs.select("text").mapInArrow(run, "node long, set binary")
    return rows.groupBy("node").agg(F.first("set").alias("set"))


def links(x: np.ndarray, y: np.ndarray, threshold: int = THRESHOLD) -> bool:
    """Whether two sets link."""
    need = -(-threshold * (len(x) + len(y)) // (100 + threshold))
    if need > min(len(x), len(y)):
        return False
    at = np.searchsorted(x, y)
    at[at == len(x)] = 0
    return int((x[at] == y).sum()) >= need


def _suffix_filter(pairs: DataFrame, classes: DataFrame, threshold: int) -> DataFrame:
    """The pairs whose overlap may be large enough: an element of both sets is in the same part of the range in both."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, PARTS).astype(np.int64) for c in ("x", "y"))
            # Full counters bound nothing.
            x, y = (np.where(s == 255, 1 << 40, s) for s in (x, y))
            need = -(-threshold * (batch.column("nx").to_numpy() + batch.column("ny").to_numpy()) // (100 + threshold))
            ok = np.minimum(x, y).sum(1) >= need
            yield batch.select(["a", "b"]).filter(pa.array(ok))

    with_b = pairs.join(classes.select(F.col("node").alias("b"), F.col("sig").alias("y"), F.col("n").alias("ny")), "b")
    both = with_b.join(classes.select(F.col("node").alias("a"), F.col("sig").alias("x"), F.col("n").alias("nx")), "a")
    return both.select("a", "b", "x", "y", "nx", "ny").mapInArrow(run, "a long, b long")


def _verified(pairs: DataFrame, docs: DataFrame, seed: int, threshold: int) -> DataFrame:
    """The pairs a, b that link."""
    if pairs.isEmpty():
        return pairs
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    sets = _sets(docs, nodes, seed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "y"):
            ok = [links(np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8"), threshold) for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    # The set of b, of which there are many different ones, travels to the one of a.
    with_b = pairs.join(sets.select(F.col("node").alias("b"), F.col("set").alias("y")), "b")
    both = with_b.join(sets.select(F.col("node").alias("a"), F.col("set").alias("x")), "a")
    return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _may_overlap(n1: Column, pos1: Column, n2: Column, pos2: Column, threshold: int) -> Column:
    """Length and positional filters of two sets whose first common shingle is at these places."""
    fits = 100 * F.least(n1, n2) >= threshold * F.greatest(n1, n2)
    return fits & ((100 + threshold) * F.least(n1 - pos1, n2 - pos2) >= threshold * (n1 + n2))


def _leaders(runs: DataFrame, threshold: int) -> DataFrame:
    """Pairs a < b of each class of a run with a few of the run's: the best by share, and ROUNDS - 1 others that a hash picks among the good ones. Each pair once."""
    best = [F.max(F.struct("share", F.xxhash64(F.lit(k), "node"), "node", "n")).alias(f"m{k}") for k in range(ROUNDS)]
    found = runs.groupBy("token").agg(F.count("*").alias("c"), *best).filter("c > 1")
    found = found.select("token", F.explode(F.array_distinct(F.array(*(F.struct(F.col(f"m{k}.node").alias("node"), F.col(f"m{k}.n").alias("n")) for k in range(ROUNDS))))).alias("m"))
    pairs = runs.join(found, "token").filter(F.col("node") != F.col("m.node"))
    pairs = pairs.filter(_may_overlap(F.col("n"), F.lit(0), F.col("m.n"), F.lit(0), threshold))
    return pairs.select(F.least("node", "m.node").alias("a"), F.greatest("node", "m.node").alias("b")).distinct()


def _pairs_of_runs(runs: DataFrame, roots: DataFrame | None, threshold: int) -> DataFrame:
    """Pairs a < b of all classes of a run that may link, each once: those of different components, or all if there are no roots."""
    placed = runs.select("token", "n", "node", "pos")
    if roots is None:
        placed = placed.withColumn("root", F.col("node"))
    else:
        placed = placed.join(roots, "node", "left").select("token", "n", "node", "pos", F.coalesce("root", "node").alias("root"))
        mixed = placed.groupBy("token").agg(F.min("root").alias("r1"), F.max("root").alias("r2")).filter("r1 <> r2").select("token")
        placed = placed.join(mixed, "token", "left_semi")
    placed = durable(placed, "op9-mixed")
    sizes = placed.groupBy("token", "root").agg(F.count("*").alias("c"))
    # The run's blocks, and its largest component, whose members meet the others only.
    facts = sizes.groupBy("token").agg(F.max(F.struct("c", "root")).alias("m"), F.sum("c").alias("all")).select("token", F.col("m.root").alias("largest"), F.ceil(F.col("all") / RUN).cast("int").alias("blocks"))
    before = F.lag("token").over(Window.partitionBy("node").orderBy("pos"))
    cross = durable(placed.withColumn("before", before).join(facts, "token"), "op9-cross")
    free(placed)
    block = F.pmod(F.xxhash64("node", "token"), F.col("blocks")).cast("int").alias("block")
    own = F.col("root") == F.col("largest")
    # The smaller set of a pair (of equal ones that of the smaller name) has the shingle in its short prefix.
    short = F.col("pos") <= F.col("n") - F.ceil(2 * threshold * F.col("n") / (100 + threshold))
    columns = ("n", "node", "pos", "root", "before")
    x = cross.filter(short).select("token", block, own.alias("own"), *(F.col(c).alias(c + "1") for c in columns))
    y = cross.select("token", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), own.alias("own"), *(F.col(c).alias(c + "2") for c in columns))
    met = (
        (F.struct("n1", "node1") < F.struct("n2", "node2"))
        & (F.col("root1") != F.col("root2"))
        & _may_overlap(F.col("n1"), F.col("pos1"), F.col("n2"), F.col("pos2"), threshold)
        & (~F.col("before1").eqNullSafe(F.col("before2")) | F.col("before1").isNull())
    )
    meet = lambda p, q: p.drop("own").join(q.drop("own"), ["token", "block"]).filter(met)
    found = meet(x.filter("not own"), y).union(meet(x.filter("own"), y.filter("not own")))
    return found.select(F.least("node1", "node2").alias("a"), F.greatest("node1", "node2").alias("b")).distinct()


def _classes(docs: DataFrame, seed: int) -> tuple[DataFrame, DataFrame, np.ndarray, int]:
    """What the first scan finds: documents, classes and frequencies, and its seed; with another seed if two sets share a name."""
    power = _counters_for(docs)
    while True:
        scanned = durable(_first_scan(docs, seed, power), "op9-documents")
        known = scanned.filter("chunk is null").select("key", "n", "node", "check", "sig")
        classes = known.filter("n > 0").groupBy("node").agg(F.min("key").alias("least"), F.min("check").alias("c1"), F.max("check").alias("c2"), F.first("n").alias("n"), F.first("sig").alias("sig"))
        classes = durable(classes, "op9-classes")
        if classes.filter("c1 <> c2").isEmpty():
            frequencies = _frequencies(scanned, power)
            return known, classes, frequencies, seed
        free(scanned, classes)
        seed += 1


def similar_pairs(docs: DataFrame, text: str = "text", key: str = "doc_id", threshold: int = THRESHOLD, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """All links between classes, and what class each row is of.

    The first result has a and b, the names of two classes of different sets that link, each pair
    once; the second key, n_shingles and class of every row of docs. Rows of one class have equal
    sets and are linked with each other; a row without words has no class (null) and no links.
    """
    docs = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    known, classes, counts, seed = _classes(docs, seed)
    frequencies = docs.sparkSession.sparkContext.broadcast(counts)
    runs = durable(_runs(_prefixes(docs, frequencies, seed, threshold), threshold), "op9-runs")
    near = durable(_suffix_filter(_pairs_of_runs(runs, None, threshold), classes, threshold), "op9-rest")
    found = durable(_verified(near, docs, seed, threshold), "op9-links")
    free(runs, near)
    return found, known.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("node")).alias("class"))


def similar_components(docs: DataFrame, text: str = "text", key: str = "doc_id", threshold: int = THRESHOLD, seed: int = 0) -> DataFrame:
    """key, n_shingles and component_id of every row of docs; docs is read five times, once for its size alone.

    component_id is the least key that links reach from the row's, its own included. Null and
    empty texts and texts of white space have no shingles and no links. Rows of the same key are
    one document: what links to one of them is connected with all. A null key comes after all
    others, so a component's id is null only if it has no other key. Other columns don't matter.
    """
    docs = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    known, classes, counts, seed = _classes(docs, seed)
    frequencies = docs.sparkSession.sparkContext.broadcast(counts)
    prefixes = durable(_runs(_prefixes(docs, frequencies, seed, threshold), threshold), "op9-runs")

    # A class that shares much of its prefix is a good one to meet first.
    prefix = F.col("n") - F.ceil(F.col("n") * threshold / 100) + 1
    share = prefixes.groupBy("node").agg((10 * F.count("*") / F.first(prefix)).cast("int").alias("share"))
    runs = durable(prefixes.join(share, "node"), "op9-runs")
    free(prefixes)
    frequencies.destroy()
    pairs = durable(_suffix_filter(_leaders(runs, threshold), classes, threshold), "op9-leaders")
    first = durable(_verified(pairs, docs, seed, threshold), "op9-links")
    roots = durable(connected_components(first), "op9-roots")

    rest = _pairs_of_runs(runs, roots, threshold).join(pairs, ["a", "b"], "left_anti")
    last = durable(_suffix_filter(rest, classes, threshold), "op9-rest")
    second = durable(_verified(last, docs, seed, threshold), "op9-links")
    free(runs, roots, pairs, last)

    # Components of all links, and of rows that share a key.
    every = first.union(second)
    shared = known.filter("n > 0 and key is not null").select("key", "node").distinct()
    several = shared.groupBy("key").agg(F.min("node").alias("a"), F.max("node").alias("z")).filter("a <> z").select("key", "a")
    every = every.union(shared.join(several, "key").filter("node <> a").select("a", F.col("node").alias("b")))
    final = durable(connected_components(every), "op9-roots")
    of_class = classes.join(final, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "least")
    ids = of_class.groupBy("root").agg(F.min("least").alias("component_id"))
    placed_ids = durable(of_class.join(ids, "root").select("node", "component_id"), "op9-ids")
    free(first, second, final, classes)
    out = known.join(placed_ids, "node", "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("key"))
    return out.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"))


def near_dedup(docs: DataFrame, text: str = "text", key: str = "doc_id", threshold: int = THRESHOLD) -> DataFrame:
    """The rows of docs, all columns, of which each component keeps the one of the smallest key.

    Rows are told apart by key and text: a null key comes after all others, and of rows that share
    a key the one stays whose text has the smaller hash. Rows that share both stay or go together.
    """
    identity = F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("key"), F.xxhash64(F.col(text)).alias("hash"))
    found = similar_components(docs.select(identity.alias("id"), F.col(text).alias("text")), "text", "id", threshold)
    gone = durable(found.filter("id <> component_id").select(F.col("id.key").alias("_gone"), F.col("id.hash").alias("_hash")).distinct(), "op9-gone")
    return docs.join(gone, docs[key].eqNullSafe(gone["_gone"]) & (F.xxhash64(docs[text]) == gone["_hash"]), "left_anti")


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles and component_id of every document."""
    return similar_components(table(spark, sf_dir, "documents").select("doc_id", "text"))
