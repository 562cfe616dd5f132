"""Near copies by the share of five-word shingles two texts have in common, 0.8 or more (Jaccard).

SimHash comes first: texts whose fingerprints (``simhash``) are linked are compared by their whole sets, and those that
are similar are connected. Fingerprints don't reach all pairs: at 0.8 they are some ten bits apart, and unrelated texts often
not much further. So what they have not connected is found by prefixes: in any fixed order of all shingles, two texts that share so much
also share one of the first shingles of each, about a fifth of it. Shingles are ordered by their hash, common ones last;
which are common is taken from a sample, and only the effort depends on it. What shares a shingle of its prefixes and
is not too different in size and in a sketch, which can only rule out, is compared by the whole sets, first each text with
one other, and then what that has not connected.

Where more than ``CROWD`` texts share a shingle, all are compared with one of them, and then only those that are not
similar to it with the others. Distances (one less the similarity) obey the triangle inequality, so pairs whose
distances to that one differ by more than the limit are left out, and no group is compared all with all for being large. Where only what is connected
is asked for (``connecting_links``), no pairs are made inside of groups at all.

Words are those of ``simhash``; a text of fewer words than a shingle is one shingle. Null texts count as empty, and
texts without words are equal. Texts and shingles are told apart by 64-bit hashes. Rows are decided one by one: repeated
and null ids are rows of their own. An empty table gives an empty result.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from strandline.llm import simhash
from strandline.llm.common import components, drop_rows, text_or_empty
from strandline.llm.sharding import column_arrays, shard_count, slices
from strandline.operators.ordering import broadcast_if_small
from strandline.sources.shared import stored

WIDTH = 5
#: The similarity as a fraction, 4 / 5, so that bounds are whole numbers.
PART, WHOLE = 4, 5
#: Texts with one shingle in common that are still compared pair by pair.
CROWD = 200
#: Text for one bucket of shingles: what its task holds is a fifth of their hashes, several times over.
BUCKET_BYTES = 2 << 20
#: A shingle is common if so many texts of the sample, one in ``SAMPLE``, have it; the most frequent ones are listed.
SAMPLE, COMMON, MAX_COMMON = 16, 4, 500_000

_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9], np.uint64)


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """The sorted distinct hashes."""
    words = (text or "").encode().translate(_LOWER).split()
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words))], np.uint64)
    known = {word: xxhash.xxh64_intdigest(word) for word in set(words)}
    hashes = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    n = len(words) - width + 1
    keys = hashes[:n]
    for i in range(1, width):
        keys = keys * _MULTIPLIERS[0] + hashes[i : i + n]
        keys = (keys ^ (keys >> np.uint64(29))) * _MULTIPLIERS[1]
        keys ^= keys >> np.uint64(32)
    return np.unique(keys)


def _few_at_once(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """Batches of a few texts: the sets of long ones take several times their room."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def prefix(keys: np.ndarray, common: np.ndarray) -> np.ndarray:
    """The first shingles in order, one of which every similar text has among its own first ones."""
    size = len(keys) + 1 - (PART * len(keys) + WHOLE - 1) // WHOLE
    if len(common):
        at = np.minimum(np.searchsorted(common, keys), len(common) - 1)
        keys = keys[np.argsort(common[at] == keys, kind="stable")]
    return keys[:size]


def _texts(documents: DataFrame) -> DataFrame:
    return documents.select(F.xxhash64(text_or_empty()).alias("node"), text_or_empty().alias("text"))


def common_shingles(texts: DataFrame) -> np.ndarray:
    """Sorted; those that many texts have, by a sample."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _few_at_once(batches):
            found = [shingles(text) for text in batch["text"].to_pylist()]
            keys, counts = np.unique(np.concatenate([np.empty(0, np.uint64), *found]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts)], ["key", "n"])

    sample = texts.filter(F.pmod("node", F.lit(SAMPLE)) == 0).mapInArrow(count, "key bigint, n bigint")
    often = sample.groupBy("key").agg(F.sum("n").alias("n")).filter(F.col("n") >= COMMON)
    rows = often.orderBy(F.desc("n"), "key").limit(MAX_COMMON).select("key").toArrow()
    return np.sort(rows["key"].to_numpy().view(np.uint64))


def _send(common: np.ndarray, buckets: int):
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _few_at_once(batches):
            sets = [shingles(text) for text in batch["text"].to_pylist()]
            first = [prefix(keys, common) for keys in sets]
            keys = np.concatenate([np.empty(0, np.uint64), *first])
            order = np.argsort(keys, kind="stable")
            keys, lengths = keys[order], [len(p) for p in first]
            nodes = np.repeat(batch["node"].to_numpy(), lengths)[order]
            sizes = np.repeat(np.array([len(s) for s in sets], np.uint32), lengths)[order]
            rows = [
                (bucket, keys[a:b].tobytes(), nodes[a:b].tobytes(), sizes[a:b].tobytes())
                for bucket, a, b in slices(keys, buckets)
            ]
            columns = list(zip(*rows)) or [()] * 4
            kinds = (pa.int32(), pa.binary(), pa.binary(), pa.binary())
            arrays = [pa.array(column, kind) for column, kind in zip(columns, kinds)]
            yield pa.RecordBatch.from_arrays(arrays, ["bucket", "keys", "nodes", "sizes"])

    return send


def _meet(crowd: int):
    """Pairs (a, b) with key null, and for a crowded shingle a row (a, least of its texts, key) for every text."""

    def meet(table: pa.Table) -> pa.Table:
        keys = np.concatenate(column_arrays(table, "keys", np.uint64))
        nodes = np.concatenate(column_arrays(table, "nodes", np.int64))
        sizes = np.concatenate(column_arrays(table, "sizes", np.uint32)).astype(np.int64)
        order = np.lexsort((nodes, sizes, keys))
        keys, nodes, sizes = keys[order], nodes[order], sizes[order]
        new = np.r_[True, (keys[1:] != keys[:-1]) | (nodes[1:] != nodes[:-1])]
        keys, nodes, sizes = keys[new], nodes[new], sizes[new]
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        ends = np.r_[starts[1:], len(keys)]
        pairs, crowds = [np.empty((0, 2), np.int64)], []
        for s, e in zip(starts[ends - starts > 1].tolist(), ends[ends - starts > 1].tolist()):
            if e - s > crowd:
                crowds.append((nodes[s:e], np.full(e - s, nodes[s:e].min()), np.full(e - s, keys[s]).view(np.int64)))
                continue
            a, b = np.triu_indices(e - s, 1)
            near = PART * sizes[s + b] <= WHOLE * sizes[s + a]
            pairs.append(np.sort(np.stack([nodes[s + a[near]], nodes[s + b[near]]], 1), axis=1))
        pairs = np.unique(np.concatenate(pairs), axis=0)
        out = [pa.table({"a": pairs[:, 0], "b": pairs[:, 1], "key": pa.nulls(len(pairs), pa.int64())})]
        out += [pa.table({"a": a, "b": b, "key": key}) for a, b, key in crowds]
        return pa.concat_tables(out)

    return meet


def sketch(keys: np.ndarray) -> np.ndarray:
    """512 bits: the parity of the number of shingles with each remainder. Sets differ in as many shingles at least."""
    counts = np.bincount((keys % np.uint64(512)).astype(np.int64), minlength=512)
    return np.packbits((counts & 1).astype(np.uint8))


def fine_sketch(keys: np.ndarray) -> np.ndarray:
    """The same with two bits or more for every shingle. Its halves xor-ed are the sketch of half the width."""
    bits = 1 << max(9, (2 * len(keys) - 1).bit_length())
    counts = np.bincount((keys % np.uint64(bits)).astype(np.int64), minlength=bits)
    return np.packbits((counts & 1).astype(np.uint8))


def apart(a: np.ndarray, b: np.ndarray) -> int:
    """Bits in which two sketches differ, in the width of the narrower one."""
    while len(a) != len(b):
        a, b = (a, b) if len(a) > len(b) else (b, a)
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    return int(np.bitwise_count(a ^ b).sum(dtype=np.int64))


def sketches(texts: DataFrame) -> DataFrame:
    """(node, size, sketch) of every text."""

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _few_at_once(batches):
            sets = [shingles(text) for text in batch["text"].to_pylist()]
            drawn = pa.array([sketch(keys).tobytes() for keys in sets], pa.binary())
            sizes = pa.array([len(keys) for keys in sets], pa.int32())
            yield pa.RecordBatch.from_arrays([batch["node"], sizes, drawn], ["node", "size", "sketch"])

    return texts.mapInArrow(draw, "node bigint, size int, sketch binary").dropDuplicates(["node"])


def possible(drawn: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sketches don't rule out that they are similar; no similar pair is left out."""

    def hold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch[n].to_pylist()), np.uint64).reshape(-1, 8) for n in ("sketch_a", "sketch_b"))
            apart = np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64)
            both = batch["size_a"].to_numpy().astype(np.int64) + batch["size_b"].to_numpy()
            near = pa.array((WHOLE + PART) * apart <= (WHOLE - PART) * both)
            yield pa.RecordBatch.from_arrays([batch["a"], batch["b"]], ["a", "b"]).filter(near)

    sides = pairs.join(drawn.toDF("a", "size_a", "sketch_a"), "a").join(drawn.toDF("b", "size_b", "sketch_b"), "b")
    return sides.mapInArrow(hold, "a bigint, b bigint")


def finely_possible(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """What is left of stored pairs by the sketches that lie beside the sets: they grow with the texts."""

    def hold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, other = (column_arrays(pa.table(batch), name, np.uint8) for name in ("sketch_a", "sketch_b"))
            both = batch["size_a"].to_numpy().astype(np.int64) + batch["size_b"].to_numpy()
            found = np.fromiter(map(apart, own, other), np.int64, len(own))
            near = pa.array((WHOLE + PART) * found <= (WHOLE - PART) * both)
            yield pa.RecordBatch.from_arrays([batch["a"], batch["b"]], ["a", "b"]).filter(near)

    drawn = sets.select("node", "size", "sketch")
    sides = drawn.toDF("a", "size_a", "sketch_a").join(broadcast_if_small(pairs), "a")
    return sides.join(drawn.toDF("b", "size_b", "sketch_b"), "b").mapInArrow(hold, "a bigint, b bigint")


def shingle_sets(texts: DataFrame, nodes: DataFrame, whole: bool = True) -> DataFrame:
    """(node, size, sketch, keys): the sets of the texts of (node), each once, as bytes, and their fine sketches.

    Without ``whole`` there are no ``keys``, thirty times the size of a sketch.
    """
    names = ["node", "size", "sketch", "keys"][: 4 if whole else 3]

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _few_at_once(batches, 100):
            found = [shingles(text) for text in batch["text"].to_pylist()]
            drawn = [pa.array([f(x).tobytes() for x in found], pa.binary()) for f in (fine_sketch, np.asarray)[: len(names) - 2]]
            sizes = pa.array(list(map(len, found)), pa.int32())
            yield pa.RecordBatch.from_arrays([batch["node"], sizes, *drawn], names)

    wanted = broadcast_if_small(stored(nodes.distinct(), "wanted"))
    found = texts.join(wanted, "node", "left_semi").dropDuplicates(["node"])
    found = found.mapInArrow(sets, "node bigint, size int, sketch binary" + ", keys binary" * whole)
    return stored(found, "shingle-sets")


def similarities(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, shared, either) for stored (a, b): the number of shingles that both texts have, and that either has.

    The pairs, two numbers each, go to the sets; then the two sets of a pair meet.
    """

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _few_at_once(batches, 100):
            own, other = (column_arrays(pa.table(batch), name, np.uint64) for name in ("keys_a", "keys_b"))
            shared = [len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(own, other)]
            either = [len(x) + len(y) - n for x, y, n in zip(own, other, shared)]
            arrays = [batch["a"], batch["b"], pa.array(shared, pa.int64()), pa.array(either, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, ["a", "b", "shared", "either"])

    few, sets = broadcast_if_small(pairs), sets.select("node", "keys")
    with_a = sets.toDF("a", "keys_a").join(few, "a")
    with_b = sets.toDF("b", "keys_b").join(few.select(F.col("a").alias("of"), "b"), "b")
    both = with_a.join(with_b, (with_a["a"] == with_b["of"]) & (with_a["b"] == with_b["b"]))
    both = both.select(with_a["a"], with_a["b"], "keys_a", "keys_b")
    return both.mapInArrow(compare, "a bigint, b bigint, shared bigint, either bigint")


def _alike() -> Column:
    return F.col("shared") * WHOLE >= F.col("either") * PART


def fingerprint_links(texts: DataFrame) -> DataFrame:
    """(a, b): similar texts among those whose SimHash fingerprints are equal or linked.

    Texts of one fingerprint are compared with the least of them, and the least ones of linked fingerprints with each other.
    """
    prints = simhash.fingerprints(texts.withColumnRenamed("node", "doc_id")).select(F.col("doc_id").alias("node"), "print")
    prints = stored(prints.dropDuplicates(["node"]), "fingerprints")
    least = stored(prints.groupBy("print").agg(F.min("node").alias("least")), "least-of-fingerprints")
    same = prints.join(least, "print").select(F.col("least").alias("a"), F.col("node").alias("b"))
    sides = [least.toDF(f"print_{end}", f"node_{end}") for end in ("a", "b")]
    linked = simhash.print_links(least.select("print")).toDF("print_a", "print_b").join(sides[0], "print_a").join(sides[1], "print_b")
    linked = linked.select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b"))
    pairs = stored(same.filter("a != b").unionByName(linked).distinct(), "fingerprint-pairs")
    sets = shingle_sets(texts, pairs.select(F.explode(F.array("a", "b")).alias("node")))
    pairs = stored(finely_possible(sets, pairs), "fingerprint-near")
    return similarities(sets, pairs).filter(_alike()).select("a", "b")


def _shared(table: pa.Table) -> pa.Table:
    """A row for each text of a shingle that several texts have, with the least of these; pairs come later."""
    keys = np.concatenate(column_arrays(table, "keys", np.uint64))
    nodes = np.concatenate(column_arrays(table, "nodes", np.int64))
    sizes = np.concatenate(column_arrays(table, "sizes", np.uint32)).astype(np.int32)
    order = np.lexsort((nodes, keys))
    keys, nodes, sizes = keys[order], nodes[order], sizes[order]
    new = np.r_[True, (keys[1:] != keys[:-1]) | (nodes[1:] != nodes[:-1])]
    keys, nodes, sizes = keys[new], nodes[new], sizes[new]
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    times = np.diff(np.r_[starts, len(keys)])
    first, first_size, texts = (np.repeat(x, times) for x in (nodes[starts], sizes[starts], times))
    columns = {"key": keys.view(np.int64), "node": nodes, "size": sizes, "first": first, "first_size": first_size, "texts": texts}
    return pa.table(columns).filter(pa.array(texts > 1))


def _sizes_near(size: str, other: str) -> Column:
    return PART * F.greatest(size, other) <= WHOLE * F.least(size, other)


def _with_bits(rows: DataFrame, drawn: DataFrame) -> DataFrame:
    """Rows of (node, size) with the words of their sketches in columns, so that a join can count bits before it makes a row."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = np.frombuffer(b"".join(batch["sketch"].to_pylist()), np.int64).reshape(-1, len(_BITS))
            columns = [pa.array(np.ascontiguousarray(column)) for column in bits.T]
            yield pa.RecordBatch.from_arrays([batch["node"], *columns], ["node", *_BITS])

    words = drawn.mapInArrow(split, "node bigint, " + ", ".join(f"{name} bigint" for name in _BITS))
    return rows.join(words, "node")


_BITS = [f"bits_{n}" for n in range(8)]


def _between_groups(met: DataFrame, drawn: DataFrame, links: DataFrame, done: DataFrame) -> DataFrame:
    """(node, other, other_group, apart): texts of a shingle that may be similar, are not ``done`` and not connected by links.

    A row comes once a shingle. In a shingle the texts outside its largest group meet all others.
    """
    groups = broadcast_if_small(stored(components(stored(links, "connected"), "a", "b"), "groups"))
    rows = met.join(groups, "node", "left").withColumn("group", F.coalesce("component", "node")).select("key", "node", "size", "group")
    sizes = rows.groupBy("key", "group").agg(F.count("*").alias("n")).groupBy("key")
    mixed = sizes.agg(F.count("*").alias("groups"), F.max(F.struct("n", "group"))["group"].alias("largest")).filter("groups > 1")
    rows = stored(_with_bits(rows.join(mixed.select("key", "largest"), "key"), drawn), "met-between-groups")
    others = rows.drop("largest").toDF(*[f"other_{name}" for name in rows.columns if name != "largest"])
    apart = sum((F.bit_count(F.col(name).bitwiseXOR(F.col(f"other_{name}"))) for name in _BITS), F.lit(0))
    once = (F.col("other_group") == F.col("largest")) | (F.col("node") < F.col("other_node"))
    near = _sizes_near("size", "other_size") & ((WHOLE + PART) * apart <= (WHOLE - PART) * (F.col("size") + F.col("other_size")))
    found = rows.filter("group != largest").join(others, (F.col("key") == F.col("other_key")) & (F.col("group") != F.col("other_group")) & once & near)
    found = found.select("node", F.col("other_node").alias("other"), "other_group", apart.alias("apart"))
    known = broadcast_if_small(done.select("a", "b"))
    return found.join(known, (F.least("node", "other") == F.col("a")) & (F.greatest("node", "other") == F.col("b")), "left_anti")


def _compared(texts: DataFrame, pairs: DataFrame, fine: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """``similarities`` of the pairs that their fine sketches don't rule out, and these with those drawn before.

    Sets are made only for the pairs that are left: long texts meet many others that the narrow sketches can't tell apart.
    """
    pairs = stored(pairs.distinct(), "near-pairs")
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node"))
    drawn = shingle_sets(texts, nodes if fine is None else nodes.join(fine.select("node"), "node", "left_anti"), whole=False)
    fine = drawn if fine is None else fine.unionByName(drawn)
    pairs = stored(finely_possible(fine, pairs), "nearer-pairs")
    sets = shingle_sets(texts, pairs.select(F.explode(F.array("a", "b")).alias("node")))
    return stored(similarities(sets, pairs), "similarities"), fine


def connecting_links(texts: DataFrame, met: DataFrame, drawn: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Similar pairs (a, b) that, with the stored ``known`` ones, connect what all similar ones do.

    ``met``: the stored rows of ``_shared``. Texts of a shingle are compared with the least of them. What that connects
    needs no further look; then a text is compared with the most alike, by their sketches, of each other group that it meets,
    and at last all pairs that are left between groups. So of k near copies some k pairs are made, not k * k.
    """
    firsts = met.filter((F.col("node") != F.col("first")) & _sizes_near("size", "first_size"))
    firsts = firsts.select(F.col("first").alias("a"), F.col("node").alias("b")).distinct()
    done, fine = _compared(texts, possible(drawn, firsts))
    met = met.filter("texts > 2").select("key", "node", "size")  # two have been compared
    for last in (False, True):
        links = done.filter(_alike()).select("a", "b")
        pairs = _between_groups(met, drawn, links if known is None else links.unionByName(known), done)
        if not last:
            pairs = pairs.groupBy("node", "other_group").agg(F.min(F.struct("apart", "other"))["other"].alias("other"))
        pairs = pairs.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b"))
        more, fine = _compared(texts, pairs, fine)
        done = done.unionByName(more)
    return done.filter(_alike()).select("a", "b")


def similar_links(
    texts: DataFrame, crowd: int = CROWD, connecting: bool = False, known: DataFrame | None = None
) -> DataFrame:
    """(a, b): pairs of (node, text) that are similar; all pairs but in crowds, where fewer connect the same texts.

    With ``connecting`` fewer pairs are made everywhere, and those found connect the same texts, together with the stored
    links that are ``known`` already.
    """
    buckets, common = shard_count(texts, BUCKET_BYTES), common_shingles(texts)
    sent = texts.mapInArrow(_send(common, buckets), "bucket int, keys binary, nodes binary, sizes binary").groupBy("bucket")
    drawn = stored(sketches(texts), "sketches")
    if connecting:
        met = sent.applyInArrow(_shared, "key bigint, node bigint, size int, first bigint, first_size int, texts bigint")
        return connecting_links(texts, stored(met, "met"), drawn, known)
    met = stored(sent.applyInArrow(_meet(crowd), "a bigint, b bigint, key bigint"), "met")
    crowds = met.filter("key is not null")
    ends = F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    near = stored(possible(drawn, met.filter("key is null").select("a", "b").distinct()), "near-pairs")
    if crowds.isEmpty():
        sets = shingle_sets(texts, near.select(F.explode(F.array("a", "b")).alias("node")))
        near = stored(finely_possible(sets, near), "nearer-pairs")
        return similarities(sets, near).filter(_alike()).select("a", "b")
    firsts = stored(crowds.filter("a != b").select(*ends).distinct(), "first-of-crowds")
    sets = shingle_sets(texts, near.unionByName(firsts).select(F.explode(F.array("a", "b")).alias("node")))
    with_firsts = stored(similarities(sets, firsts), "similarities")
    links = with_firsts.filter(_alike()).select("a", "b")
    # The first of a crowd is the least of its texts, so it is always a of its pairs.
    placed = crowds.select(F.col("a").alias("node"), F.col("b").alias("first"), "key").join(
        with_firsts.select(F.col("a").alias("first"), F.col("b").alias("node"), (1 - F.col("shared") / F.col("either")).alias("far"), _alike().alias("near")),
        ["first", "node"],
        "left",
    )
    members = placed.filter("node != first").select("key", "node", "far", "near")
    others = members.select("key", F.col("node").alias("other"), F.col("far").alias("other_far"))
    within = F.abs(F.col("far") - F.col("other_far")) <= 1 - PART / WHOLE + 1e-9
    rest = members.filter("not near").join(others, "key").filter(within & (F.col("node") != F.col("other")))
    rest = rest.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()
    rest = near.unionByName(possible(drawn, rest)).distinct().join(firsts, ["a", "b"], "left_anti")
    rest = stored(finely_possible(sets, stored(rest, "met-in-crowds")), "crowd-pairs")
    return links.unionByName(similarities(sets, rest).filter(_alike()).select("a", "b"))


def keep_one_of_similar(documents: DataFrame, crowd: int = CROWD) -> DataFrame:
    """Of all documents that links connect, the row with the smallest ``doc_id``, nulls first, with all columns."""
    texts = _texts(documents)
    known = stored(fingerprint_links(texts), "similar-fingerprints")
    links = stored(similar_links(texts, crowd, connecting=True, known=known), "similar")
    groups = components(links.unionByName(known), "a", "b")
    rows = documents.select("doc_id", F.xxhash64(text_or_empty()).alias("node")).join(groups, "node", "left")
    rows = stored(rows.select("doc_id", "node", F.coalesce("component", "node").alias("component")), "similar-rows")
    best = rows.groupBy("component").agg(F.min(F.struct("doc_id", "node")).alias("best"))
    lost = rows.join(best, "component").filter(
        ~(F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("node") == F.col("best.node")))
    )
    return drop_rows(documents, F.xxhash64(text_or_empty()), lost.select("doc_id", F.col("node").alias("mark")))
