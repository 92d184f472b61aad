"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints within ``radius`` bits of each other have a common variant within half the radius of both.
So every distinct fingerprint emits all its variants within ``radius // 2`` bits (2,081 of 64 bits for radius
4), variants are shuffled, and fingerprints that meet in a variant are verified and linked.

The shuffle is keyed on the first ``b`` bits of the variant. A fingerprint is sent once to every block that its
ball reaches and the variants inside a block are made there, not carried through the shuffle; ``b`` follows
the number of fingerprints so that a block always holds about ``BLOCK_VARIANTS`` variants. Members of one
variant are linked in a star to the smallest (any two are within the radius, so no connection is lost and no
group is expanded into pairs); distances are verified for odd radii too.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import split_join
from graphloom.operators.contraction import connected_components
from graphloom.runtime import discard, is_empty, materialize

BLOCK_VARIANTS = 4_000_000
#: Bytes of text whose words are held at once, and shingle hashes whose bits are counted at once.
PIECE, COUNT = 1 << 22, 1 << 16
#: Rounds of heads at most, and pairs for each member of a bucket that are few enough to be compared at once.
ROUNDS, FEW = 6, 4


def pieces(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, piece by piece; a piece ends at white space."""
    start, n = 0, len(text)
    while start < n:
        end = start + PIECE
        while end < n and text[end] not in b" \t\n\r\x0b\x0c":
            end += 1
        yield text[start:end].split()
        start = end


def remixed(h: np.ndarray, band: int) -> np.ndarray:
    """The hashes for a band: band 0 keeps them, the others are bijections of them."""
    if band:
        h = (h ^ np.uint64(band * 0x9E3779B97F4A7C15 % 2**64)) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        h = h ^ (h >> np.uint64(32))
    return h


def shingle_hashes(text: str | None, shingle: int, seed: int) -> Iterator[np.ndarray]:
    """The XXH64 of all word shingles, at most ``COUNT`` at once; a text of fewer words is one shingle."""
    some, tail, words = False, [], []
    digest = xxhash.xxh64_intdigest
    for piece in pieces((text or "").encode("utf-8", "surrogatepass").lower()):
        words = tail + piece
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        if len(words) >= shingle:
            line, starts, stops = b" ".join(words), [0, *ends[:-shingle].tolist()], (ends[shingle - 1 :] - 1).tolist()
            for i in range(0, len(stops), COUNT):
                yield np.array([digest(line[a:b], seed) for a, b in zip(starts[i : i + COUNT], stops[i : i + COUNT], strict=True)], "<u8")
            some = True
            tail = words[-(shingle - 1) :] if shingle > 1 else []
        else:
            tail = words
    if not some and words:
        yield np.array([digest(b" ".join(words), seed)], "<u8")


def fingerprint(text: str | None, shingle: int = 4, seed: int = 42, bands: int = 1) -> np.ndarray:
    """For each band, the majority bits of the XXH64 of all word shingles; 0 for a text without words."""
    ones, total = np.zeros((bands, 64), np.int64), 0
    for h in shingle_hashes(text, shingle, seed):
        for band in range(bands):
            bits = remixed(h, band).view(np.uint8).reshape(-1, 8)
            ones[band] += np.unpackbits(bits, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        total += len(h)
    return np.packbits(ones * 2 > total, axis=1, bitorder="little").view("<u8").ravel()


def shingle_set(text: str | None, shingle: int, seed: int) -> np.ndarray:
    """The different shingle hashes, sorted."""
    return np.unique(np.concatenate([*shingle_hashes(text, shingle, seed), np.empty(0, np.uint64)]))


def band_keys(s: np.ndarray, bands: int, rows: int, seed: int) -> np.ndarray:
    """A key for each band: the hash of ``rows`` minima of the set, each under another bijection. None for an empty set."""
    if not len(s):
        return np.empty(0, np.int64)
    rng = np.random.default_rng([seed, bands, rows])
    scale = rng.integers(0, 2**64, bands * rows, np.uint64) | np.uint64(1)
    low = np.full(bands * rows, 2**64 - 1, np.uint64)
    for i in range(0, len(s), 512):
        np.minimum(low, (s[i : i + 512, None] * scale).min(axis=0), out=low)
    keys = np.arange(bands, dtype=np.uint64)
    for column in low.reshape(bands, rows).T:
        keys = remixed(keys ^ column, 1)
    return keys.view(np.int64)


def fingerprints(docs: DataFrame, shingle: int = 4, seed: int = 42, bands: int = 1) -> DataFrame:
    """``docs(doc_id, text)`` → ``doc_id, fps`` (one signed bigint for each band), row by row."""
    kind = docs.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat = np.concatenate([fingerprint(t, shingle, seed, bands) for t in b.column(1).to_pylist()] or [np.empty(0, np.uint64)])
            fps = pa.ListArray.from_arrays(np.arange(0, len(flat) + 1, bands, dtype=np.int32), pa.array(flat.view(np.int64)))
            yield pa.RecordBatch.from_arrays([b.column(0), fps], ["doc_id", "fps"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind.simpleString()}, fps array<bigint>")


def masks(bits: int, most: int) -> np.ndarray:
    """All 64-bit masks of at most ``most`` ones among the lowest ``bits`` bits."""
    out = [sum(1 << i for i in c) for k in range(most + 1) for c in combinations(range(bits), k)]
    return np.array(out, np.uint64)


def meet(block: int, fps: np.ndarray, prefix_bits: int, radius: int) -> np.ndarray:
    """Star links (smallest, member) of the fingerprints that share a variant inside the block."""
    half, low = radius // 2 + radius % 2, 64 - prefix_bits
    fps = np.unique(fps)
    off = np.bitwise_count((fps >> np.uint64(low)) ^ np.uint64(block)) if prefix_bits else np.zeros(len(fps), np.uint8)
    keep = np.uint64((1 << low) - 1)
    variants, owners = [], []
    for d in range(half + 1):
        own = np.flatnonzero(off == d)
        if len(own):
            m = masks(low, half - d)
            variants.append(((fps[own] & keep)[:, None] ^ m[None, :]).ravel())
            owners.append(np.repeat(own.astype(np.int32), len(m)))
    if not variants:
        return np.empty((0, 2), np.uint64)
    v, o = np.concatenate(variants), np.concatenate(owners)
    s = np.sort(v)
    shared = s[1:][s[1:] == s[:-1]]
    if not len(shared):
        return np.empty((0, 2), np.uint64)
    slot = lambda x: (x * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(42)
    seen = np.zeros(1 << 22, bool)
    seen[slot(shared)] = True
    pick = seen[slot(v)]
    v, o = v[pick], o[pick]
    order = np.lexsort((o, v))
    v, o = v[order], o[order]
    first = np.maximum.accumulate(np.where(np.r_[True, v[1:] != v[:-1]], np.arange(len(v)), 0))
    pair = np.unique(np.stack([o[first], o], 1)[o[first] != o], axis=0)
    links = np.stack([fps[pair[:, 0]], fps[pair[:, 1]]], 1) if len(pair) else np.empty((0, 2), np.uint64)
    return links[np.bitwise_count(links[:, 0] ^ links[:, 1]) <= radius]


def links(distinct: DataFrame, radius: int = 4) -> DataFrame:
    """``distinct(band, fp)`` (written, no repeats) → ``band, src, dst``: links that connect all pairs within the radius."""
    if radius % 2:
        raise ValueError("the radius has two equal halves")
    ball, largest = len(masks(64, radius // 2)), distinct.groupBy("band").count().agg(F.max("count")).first()[0] or 0
    prefix_bits = max(8, (largest * ball // BLOCK_VARIANTS).bit_length())
    reach, low = masks(prefix_bits, radius // 2), 64 - prefix_bits

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = b.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
            bands = b.column(0).to_numpy(zero_copy_only=False).astype(np.uint64) << np.uint64(prefix_bits)
            blocks = (((fps >> np.uint64(low)) | bands)[:, None] ^ reach[None, :]).ravel()
            order = np.argsort(blocks, kind="stable")
            blocks, own = blocks[order], fps[order // len(reach)]
            cuts = np.flatnonzero(np.r_[True, blocks[1:] != blocks[:-1]]) if len(blocks) else np.empty(0, int)
            packed = [x.tobytes() for x in np.split(own, cuts[1:])] if len(cuts) else []
            yield pa.RecordBatch.from_arrays([pa.array(blocks[cuts].astype(np.int64)), pa.array(packed, pa.binary())], ["block", "fps"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for key, packed in zip(b.column(0), b.column(1), strict=True):
                band, block = divmod(key.as_py(), 1 << prefix_bits)
                x = meet(block, np.frombuffer(b"".join(packed.as_py()), np.uint64), prefix_bits, radius).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), band)), pa.array(np.ascontiguousarray(x[:, 0])), pa.array(np.ascontiguousarray(x[:, 1]))], ["band", "src", "dst"])

    sent = distinct.select("band", "fp").mapInArrow(send, "block bigint, fps binary")
    return sent.groupBy("block").agg(F.collect_list("fps").alias("fps")).mapInArrow(verify, "band bigint, src bigint, dst bigint").distinct()


def in_balls(classes: DataFrame, radius: int) -> DataFrame:
    """``classes(band, fp, ...)`` of one band, written, no fingerprint twice, with ``label``: the group that ball hashing puts it in."""
    labels = connected_components(links(classes, radius).select("src", "dst"))
    return classes.drop("band").join(labels.withColumnRenamed("id", "fp"), "fp", "left").withColumn("label", F.coalesce("component", "fp")).drop("component")


def near_duplicates(docs: DataFrame, radius: int = 4, shingle: int = 4, seed: int = 42) -> DataFrame:
    """``doc_id, fp, component_id`` for every row of ``docs``.

    ``component_id`` is the smallest ``doc_id`` reachable over links of at most ``radius`` differing bits; rows
    with equal fingerprints are linked. Null, empty and blank texts have fingerprint 0 and are linked like any
    other; a null id stays null and never names a component that has another id. Only ``doc_id`` and
    ``text`` are read, other columns may have any name.
    """
    fps = materialize(fingerprints(docs, shingle, seed).select("doc_id", F.col("fps")[0].alias("fp")), "fingerprints")
    classes = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id")).select(F.lit(0).cast("long").alias("band"), "fp", "first_id"), "classes")
    named = in_balls(classes, radius)
    smallest = named.groupBy("label").agg(F.min("first_id").alias("component_id"))
    of_fp = materialize(named.join(smallest, "label").select("fp", "component_id"), "components")
    return fps.join(of_fp, "fp").select("doc_id", "fp", "component_id")


def most_bits(similarity: float, bits: int) -> int:
    """Differing bits that shingle sets of this similarity (shared over all) are expected to have."""
    cosine = 2 * similarity / (1 + similarity)
    return int(bits * math.acos(cosine) / math.pi)


#: Words of a shingle and seed of the fingerprints that ball hashing groups, as in ``near_duplicates``.
FP_SHINGLE, FP_SEED = 4, 42


def sketches(docs: DataFrame, shingle: int, seed: int, bands: int, rows: int) -> DataFrame:
    """``doc_id, k_text, digest, n, keys, fp``, row by row: the digest and size of the shingle set, its band keys and the fingerprint."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            digests, sizes, keys, fps = [], [], [], []
            for t in b.column(2).to_pylist():
                fps.append(fingerprint(t, FP_SHINGLE, FP_SEED).view(np.int64)[0])
                s = shingle_set(t, shingle, seed)
                digests.append(xxhash.xxh3_128_digest(s.tobytes()))
                sizes.append(len(s))
                keys.append(band_keys(s, bands, rows, seed))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(fps, pa.int64())], ["doc_id", "k_text", "digest", "n", "keys", "fp"])

    return docs.select("doc_id", F.xxhash64("text").alias("k_text"), "text").mapInArrow(run, f"doc_id {kind}, k_text bigint, digest binary, n bigint, keys array<bigint>, fp bigint")


def shingle_sets(docs: DataFrame, wanted: DataFrame, shingle: int, seed: int) -> DataFrame:
    """``cid, s`` (the shingle set) for ``wanted(cid, doc_id, k_text)``; rows that are equal count once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingle_set(t, shingle, seed).view(np.int64) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.list_(pa.int64()))], ["cid", "s"])

    w = wanted.select("cid", F.col("doc_id").alias("w_id"), F.col("k_text").alias("w_text"))
    texts = docs.select("doc_id", F.xxhash64("text").alias("k_text"), "text")
    found = texts.join(w, F.col("doc_id").eqNullSafe(F.col("w_id")) & (F.col("k_text") == F.col("w_text"))).select("cid", "text")
    return found.mapInArrow(run, "cid bigint, s array<bigint>").dropDuplicates(["cid"])


def similar(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those of ``pairs(x, n_x, y, n_y)`` whose shingle sets have this Jaccard similarity, as ``src, dst``."""
    fit = pairs.where(F.least("n_x", "n_y") >= F.greatest("n_x", "n_y") * similarity - 1e-6).distinct()
    left, right = (sets.select(F.col("cid").alias(k), F.col("s").alias(f"s_{k}")) for k in ("x", "y"))
    common = F.size(F.array_intersect("s_x", "s_y"))
    return fit.join(left, "x").join(right, "y").where(common / (F.col("n_x") + F.col("n_y") - common) >= similarity).select(F.col("x").alias("src"), F.col("y").alias("dst"))


def ball_keys(seen: DataFrame, classes: DataFrame, radius: int) -> DataFrame:
    """``cid, n, key`` for the sets ``classes(digest, cid, n)`` of the sketches ``seen``: the ball groups of their rows' fingerprints."""
    of_set = materialize(seen.select("digest", "fp").distinct(), "fps")
    fps = materialize(of_set.groupBy("fp").agg(F.count(F.lit(1)).alias("times")).select(F.lit(0).cast("long").alias("band"), "fp", "times"), "fp_classes")
    balls = materialize(in_balls(fps, radius), "balls")
    held = split_join(of_set, balls, ["fp"], "inner", "times", of_set.count())
    # hashed: a label is a fingerprint and must not be taken for a band key
    keys = held.select("digest", F.xxhash64(F.lit("ball"), "label").alias("key")).distinct()
    return classes.select("digest", "cid", "n").join(keys, "digest").select("cid", "n", "key")


def labelled(docs: DataFrame, similarity: float, bands: int, rows: int, shingle: int, seed: int, radius: int) -> tuple[DataFrame, DataFrame]:
    """The sketch of every row, and ``digest, first, label`` for each different shingle set: its first row and its group.

    Sets whose fingerprints ball hashing groups, and sets that share a band key, are candidates; a candidate pair is linked if
    its exact Jaccard similarity suffices.
    """
    seen = materialize(sketches(docs, shingle, seed, bands, rows), "sketches")
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "k_text")
    classes = seen.groupBy("digest").agg(F.min(first).alias("first"), F.first("n").alias("n"), F.first("keys").alias("keys"))
    classes = materialize(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
    in_band = classes.select("cid", "n", F.explode("keys").alias("key")).unionByName(ball_keys(seen, classes, radius))
    in_band = materialize(in_band, "keys")
    shared = in_band.groupBy("key").agg(F.count(F.lit(1)).alias("sharing")).where("sharing > 1").select("key")
    members = materialize(in_band.join(shared, "key"), "members")
    met = members.select("cid").distinct()
    wanted = classes.join(met, "cid").select("cid", "first.doc_id", "first.k_text")
    sets = materialize(shingle_sets(docs, wanted, shingle, seed), "sets")
    labels = linked(members, sets, similarity)
    named = classes.join(labels.withColumnRenamed("id", "cid"), "cid", "left")
    return seen, materialize(named.select("digest", "first", F.coalesce("component", "cid").alias("label")), "labels")


def across(rows: DataFrame) -> DataFrame:
    """``x, n_x, y, n_y``: pairs of ``rows(key, cid, n, comp)`` of one key and different components.

    One side leaves out the largest component of the key, so the rows that the join looks at are at most twice the pairs: a
    large group that is already linked costs nothing.
    """
    sizes = rows.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("size"))
    largest = sizes.groupBy("key").agg(F.max(F.struct("size", "comp"))["comp"].alias("large"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
    here = rows.join(largest.select("key", "large"), "key")
    x = here.where("comp <> large").select("key", F.col("cid").alias("x"), F.col("n").alias("n_x"), F.col("comp").alias("comp_x"))
    y = here.select("key", F.col("cid").alias("y"), F.col("n").alias("n_y"), F.col("comp").alias("comp_y"), (F.col("comp") == F.col("large")).alias("in_large"))
    return x.join(y, "key").where("comp_x <> comp_y and (in_large or x < y)").select("x", "n_x", "y", "n_y")


def by_rarity(rows: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """``key, cid, n, comp`` for ``rows(cid, n, comp)``: each set's rarest shingles as keys.

    Of n shingles the first n - ceil(similarity * n) + 1 by rarity are keys: two sets of the similarity share one of them,
    whatever the order, so no pair is lost.
    """
    words = materialize(sets.join(rows, "cid").select("cid", "n", "comp", F.explode("s").alias("w")), "shingles")
    often = words.groupBy("w").agg(F.count(F.lit(1)).alias("times"))
    ranked = split_join(words, often.where("times > 1"), ["w"], "inner", "times", words.count())
    # shingles of one set alone come first and are no keys; those left are ranked after them
    per = ranked.groupBy("cid", "n", "comp").agg(F.sort_array(F.collect_list(F.struct("times", "w"))).alias("held"))
    first = F.col("n") - F.ceil(F.col("n") * F.lit(similarity) - 1e-6) + 1 - (F.col("n") - F.size("held"))
    return per.where(first > 0).select("cid", "n", "comp", F.explode(F.slice("held", F.lit(1), first.cast("int"))).alias("h")).select(F.col("h.w").alias("key"), "cid", "n", "comp")


def linked(members: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """``id, component`` over the links between ``members(key, cid, n)`` of one bucket.

    A round compares one head of each bucket with the members of other components, then the head leaves: whoever
    a rejected head left over is compared with the next. Members of one component need no comparison. Once the pairs
    left are at most ``FEW`` for each member that there was, they are compared; sets that so many pairs are left for after
    ``ROUNDS`` meet in their rarest shingles instead, which loses no pair. So no pair that met is passed over and a group
    of copies is never expanded.
    """
    edges = labels = None
    rest, most = members, 0
    for done in range(ROUNDS + 1):
        here = rest.withColumn("comp", F.col("cid")) if labels is None else rest.join(labels.withColumnRenamed("id", "cid"), "cid", "left").withColumn("comp", F.coalesce("component", "cid")).drop("component")
        parts = here.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("size"), F.min("cid").alias("head"))
        keys = parts.groupBy("key").agg(F.min(F.struct("size", "comp", "head")).alias("h"), F.sum("size").alias("all"), F.sum(F.col("size") * F.col("size")).alias("inside"), F.count(F.lit(1)).alias("parts"))
        keys = keys.where("parts > 1").select("key", F.col("h.comp").alias("head_comp"), F.col("h.head").alias("head"), "all", ((F.col("all") * F.col("all") - F.col("inside")) / 2).alias("pairs"))
        keys = materialize(keys, "buckets")
        rows, pairs = keys.agg(F.coalesce(F.sum("all"), F.lit(0)), F.coalesce(F.sum("pairs"), F.lit(0))).first()
        if not rows:
            break
        most = most or FEW * rows
        here = materialize(here.join(keys.select("key", "head", "head_comp"), "key"), "here")
        last = done == ROUNDS or pairs <= most
        if pairs <= most:
            todo = across(here.select("key", "cid", "n", "comp"))
        elif last:
            todo = across(materialize(by_rarity(here.select("cid", "n", "comp").distinct(), sets, similarity), "rarest"))
        else:
            heads = here.where("cid = head").select("key", F.col("cid").alias("x"), F.col("n").alias("n_x"))
            todo = here.where("comp <> head_comp").select("key", F.col("cid").alias("y"), F.col("n").alias("n_y")).join(heads, "key")
        new = materialize(similar(todo.select("x", "n_x", "y", "n_y"), sets, similarity), "near")
        edges = new if edges is None else edges.unionAll(new)
        labels = materialize(connected_components(edges), "linked")
        if last:
            break
        rest = here.where("cid <> head").select("key", "cid", "n")
    return labels if labels is not None else members.select(F.col("cid").alias("id"), F.col("cid").alias("component")).limit(0)


def near_copies(docs: DataFrame, similarity: float = 0.8, bands: int = 32, rows: int = 10, shingle: int = 5, seed: int = 42, radius: int = 4) -> DataFrame:
    """``doc_id, component_id`` for every row of ``docs``: groups of texts that share ``similarity`` of their shingles.

    Texts whose fingerprints ball hashing groups, as in ``near_duplicates``, meet. One fingerprint of 64 bits finds pairs at the
    similarity too rarely. So the shingle sets also have ``bands`` keys of ``rows`` minima each: a pair of Jaccard similarity s
    meets there with chance 1 - (1 - s ** rows) ** bands (0.973 at 0.8). Of texts that met either way the exact similarity of
    the sets decides. Rows are treated as in ``near_duplicates``.
    """
    seen, classes = labelled(docs, similarity, bands, rows, shingle, seed, radius)
    smallest = classes.groupBy("label").agg(F.min("first.doc_id").alias("component_id"))
    of_set = materialize(classes.join(smallest, "label").select("digest", "component_id"), "components")
    return seen.select("doc_id", "digest").join(of_set, "digest").select("doc_id", "component_id")


def drop_near_duplicates(docs: DataFrame, similarity: float = 0.8, bands: int = 32, rows: int = 10, shingle: int = 5, seed: int = 42, radius: int = 4) -> DataFrame:
    """One document of each group of near copies: the row with the smallest id, then the smallest hash of its text.

    Exactly one row of every group stays, whatever ids are null or repeated; a row with a null id only if no row
    of its group has an id. Texts without words (null, empty, blank) are a group; very long ones are read whole; an empty
    table gives no rows. Columns and their order stay, whatever their names.
    """
    seen, classes = labelled(docs, similarity, bands, rows, shingle, seed, radius)
    first = classes.groupBy("label").agg(F.min("first").alias("first")).select(F.col("first.doc_id").alias("loom_id"), F.col("first.k_text").alias("loom_text"))
    same = F.col("doc_id").eqNullSafe(F.col("loom_id")) & (F.col("k_text") == F.col("loom_text"))
    first = materialize(seen.join(first, same).groupBy("loom_id", "loom_text").agg(F.count(F.lit(1)).alias("loom_rows")), "kept")
    d = docs.alias("d")
    own_text = F.col("d.doc_id").eqNullSafe(F.col("f.loom_id")) & (F.xxhash64("d.text") == F.col("f.loom_text"))
    kept = d.join(first.where("loom_rows = 1").alias("f"), own_text, "left_semi")
    again = materialize(first.where("loom_rows > 1"), "again")
    if is_empty(again):
        discard(again)
        return kept
    return kept.unionByName(d.join(again.alias("f"), own_text, "left_semi").dropDuplicates(["doc_id", "text"]))
