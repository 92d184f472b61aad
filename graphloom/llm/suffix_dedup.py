"""Suffix-array dedup: every byte that a repeated string of ``length`` bytes covers is removed.

Sorting all suffixes of a corpus is cut down to the suffixes that can matter. In each string of ``length``
bytes the ``GRAM``-byte substring with the smallest hash is its anchor; equal strings have equal anchors at equal
offsets. So starts are grouped by anchor, anchors that occur once are done, and what is left is a context: the
bytes of all strings that share one occurrence of an anchor. Equal contexts are one entry with a count (the
starts of an entry that occurs twice all repeat). Contexts that share an anchor but differ go into a suffix
array, built batch by batch in two stages: suffixes smaller than their successor are sorted directly, the others
are induced from them by scanning the buckets of first bytes from small to large. Neighbours whose common prefix
reaches ``length`` repeat each other.

An anchor with more than ``HOT`` different contexts (the edge of a passage that very many documents share) is
cut into chunks of about that many, each sorted like the others. Across the chunks, each sends one record for
each different string (a 128-bit digest, and the start if the chunk has only one), packed by digest; strings that
two chunks have repeat. So no task ever holds all contexts of an anchor, and a string comes once from each chunk.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import row_key, split_join, text_or_empty
from graphloom.runtime import discard, materialize

LENGTH, GRAM, HOT = 400, 64, 1000
#: Bytes of a text that are hashed at once, and bytes of context that are sorted at once.
PIECE, BATCH = 1 << 22, 1 << 17
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
AT = np.uint64((1 << 28) - 1)


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base)
    out[:1] = 1
    return np.multiply.accumulate(out)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """The minimum of each ``w`` consecutive values."""
    n = len(x)
    padded = np.full(-(-n // w) * w, np.iinfo(x.dtype).max, x.dtype)
    padded[:n] = x
    blocks = padded.reshape(-1, w)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - w + 1], left[w - 1 : n])


class Anchors:
    """``(gram hash, first start, last start)`` of each anchor of a text, in order; starts of a text are dealt out without gaps."""

    def __init__(self, length: int = LENGTH, gram: int = GRAM) -> None:
        self.length, self.gram, self.up, self.down = length, gram, powers(BASE, 1), powers(INVERSE, 1)

    def of(self, b: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        starts, parts = len(b) - self.length + 1, []
        for s in range(0, max(starts, 0), PIECE):
            parts.append(self.piece(b[s : min(len(b), s + PIECE + self.length - 1)], s))
        if not parts:
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True))

    def piece(self, b: bytes, at: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n, k = len(b), self.gram
        if len(self.up) < n:
            self.up, self.down = powers(BASE, 2 * n), powers(INVERSE, 2 * n)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((np.frombuffer(b, np.uint8).astype(np.uint64) + np.uint64(1)) * self.up[:n], out=sums[1:])
        h = (sums[k:] - sums[:-k]) * self.down[: n - k + 1]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
        best = sliding_min((h & ~AT) | np.arange(len(h), dtype=np.uint64), self.length - k + 1)
        first = np.flatnonzero(np.r_[True, best[1:] != best[:-1]])
        q = (best[first] & AT).astype(np.int64)
        return h[q].view(np.int64), first + at, np.r_[first[1:] - 1, len(best) - 1] + at


def words_at(text: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The eight bytes at each position, as numbers."""
    view = np.lib.stride_tricks.sliding_window_view(text, 8)
    return np.ascontiguousarray(view[at]).view("<u8").ravel()


def suffix_array(raw: bytes, wanted: np.ndarray, depth: int) -> np.ndarray:
    """Positions in ``wanted`` (closed under stepping right from a larger-than-successor one), by their first ``depth`` bytes.

    ``raw`` ends with a 0 byte and then 255s, which are not wanted except as the end of a chain.
    """
    t = np.frombuffer(raw, np.uint8)
    small = smaller_than_next(t)
    direct = np.flatnonzero(wanted & small)
    order = np.array(sorted(direct.tolist(), key=lambda p: raw[p : p + depth]), np.int64)
    first = t[order] if len(order) else np.empty(0, np.uint8)
    cuts = np.searchsorted(first, np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    out = []

    def induce(entries: np.ndarray, c: int) -> np.ndarray:
        """Send the larger-than-successor predecessors to their buckets; return those of bucket ``c`` itself."""
        pred = entries[entries > 0] - 1
        pred = pred[wanted[pred] & ~small[pred]]
        chars = t[pred]
        by = np.argsort(chars, kind="stable")
        pred, chars = pred[by], chars[by]
        if not len(chars):
            return pred
        edge = np.flatnonzero(np.r_[True, chars[1:] != chars[:-1]])
        same = pred[:0]
        for a, b in zip(edge, [*edge[1:], len(chars)], strict=True):
            if chars[a] == c:
                same = pred[a:b]
            else:
                waiting[chars[a]].append(pred[a:b])
        return same

    for c in range(256):
        entries = np.concatenate(waiting[c]) if waiting[c] else order[:0]
        while len(entries):
            out.append(entries)
            entries = induce(entries, c)
        own = order[cuts[c] : cuts[c + 1]]
        if len(own):
            out.append(own)
            induce(own, c)
    return np.concatenate(out) if out else order


def smaller_than_next(t: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the next one: by the first byte that differs from its successor."""
    n = len(t)
    at = np.where(np.r_[t[:-1] != t[1:], True], np.arange(n), n - 1)
    at = np.minimum.accumulate(at[::-1])[::-1]
    nxt = np.minimum(at + 1, n - 1)
    return t[at] < t[nxt]


def common_prefixes(t: np.ndarray, sa: np.ndarray, breaks: np.ndarray, most: int) -> np.ndarray:
    """Length of the common prefix of each entry with the one before it (0 for the first), at most ``most``.

    In text order a prefix shrinks by one from a position to the next while both sides step together over equal bytes, so
    bytes are only compared where that chain breaks, past a byte that differs, and at ``breaks``. A length is exact unless bytes equal up to
    ``most`` were found at the break before it; it is then short by no more than the distance to that break.
    """
    before = np.full(len(t), -1, np.int64)
    before[sa[1:]] = sa[:-1]
    pos = np.sort(sa)
    phi = before[pos]
    chained = np.r_[False, (pos[1:] == pos[:-1] + 1) & (phi[1:] == phi[:-1] + 1) & (phi[:-1] >= 0)]
    chained[1:] &= t[pos[:-1]] == t[phi[:-1]]
    chained &= ~np.isin(pos, breaks)
    heads = np.flatnonzero(~chained)
    a, b = pos[heads], phi[heads]
    lcp, live = np.zeros(len(heads), np.int64), np.flatnonzero(b >= 0)
    for d in range(0, most, 8):
        if not len(live):
            break
        x, y = a[live] + d, b[live] + d
        inside = np.maximum(x, y) + 8 <= len(t)
        live, x, y = live[inside], x[inside], y[inside]
        diff = words_at(t, x) ^ words_at(t, y)
        low = diff & (~diff + np.uint64(1))
        lcp[live] = d + np.where(diff == 0, 8, np.log2(np.maximum(low, 1).astype(float)).astype(np.int64) // 8)
        live = live[diff == 0]
    head = np.maximum.accumulate(np.where(chained, 0, np.arange(len(pos))))
    full = np.empty(len(t), np.int64)
    at = np.zeros(len(pos), np.int64)
    at[heads] = lcp
    full[pos] = np.maximum(at[head] - (np.arange(len(pos)) - head), 0)
    return full[sa]


def repeated_starts(contexts: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """For each context, which of its starts begin a string of ``length`` bytes that begins elsewhere in the contexts too."""
    return strings_of(contexts, length)[0]


def strings_of(contexts: list[bytes], length: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The marks of ``repeated_starts``, and for each different string of ``length`` bytes ``(context, start, repeats)``."""
    raw = b"".join(contexts) + b"\x00" + b"\xff" * (length + 8)
    t = np.frombuffer(raw, np.uint8)
    sizes = np.array([len(c) for c in contexts])
    offsets = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
    starts = np.zeros(len(raw), bool)
    for o, n in zip(offsets, sizes, strict=True):
        starts[o : o + n - length + 1] = True
    small = smaller_than_next(t)
    wanted = starts.copy()
    edge = np.flatnonzero(starts & ~np.r_[starts[1:], False] & ~small)
    while len(edge):  # step right until each chain ends in a suffix that is sorted directly
        edge = edge + 1
        edge = edge[~wanted[edge]]
        wanted[edge] = True
        edge = edge[~small[edge]]
    sa = suffix_array(raw, wanted, length)
    lcp = common_prefixes(t, sa, offsets, int(sizes.max()) + length + 8)
    group = np.cumsum(lcp < length) - 1
    real = starts[sa]
    many = np.bincount(group, weights=real) >= 2
    marked = np.zeros(len(raw), bool)
    marked[sa] = many[group] & real
    marks = [marked[o : o + n - length + 1] for o, n in zip(offsets, sizes, strict=True)]
    _, one = np.unique(group[real], return_index=True)
    at = sa[real][one]
    owner = np.searchsorted(offsets, at, side="right") - 1
    return marks, np.stack([owner, at - offsets[owner], marked[at]], 1)


def runs(marks: np.ndarray) -> list[tuple[int, int]]:
    """The runs of true values: first, last."""
    edge = np.flatnonzero(np.diff(np.r_[0, marks.astype(np.int8), 0]))
    return list(zip(edge[::2].tolist(), (edge[1::2] - 1).tolist(), strict=True))


def utf8(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def anchors(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """``k_id, k_text, g, a, b`` from ``docs(k_id, k_text, text)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = Anchors(length, gram)
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                found = [find.of(utf8(t)) for t in batch.column(2).to_pylist()]
                rows = np.repeat(np.arange(len(found)), [len(x[0]) for x in found])
                g, a, b = (np.concatenate(x) for x in zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), batch.column(1).take(pa.array(rows)), pa.array(g), pa.array(a), pa.array(b)], ["k_id", "k_text", "g", "a", "b"])

    return docs.mapInArrow(run, "k_id string, k_text bigint, g bigint, a bigint, b bigint")


def cut(docs: DataFrame, length: int) -> DataFrame:
    """``k_id, k_text, g, a, digest, context`` from ``docs(k_id, k_text, text, found)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 128):
                rows = []
                for k_id, k_text, text, found in zip(*(c.to_pylist() for c in whole.slice(at, 128).columns), strict=True):
                    b = utf8(text)
                    rows += [(k_id, k_text, x["g"], x["a"], hashlib.md5(c := b[x["a"] : x["b"] + length]).digest(), c) for x in found]
                kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], ["k_id", "k_text", "g", "a", "digest", "context"])

    return docs.mapInArrow(run, "k_id string, k_text bigint, g bigint, a bigint, digest binary, context binary")


RECORD = np.dtype([("d0", "<u8"), ("d1", "<u8"), ("cid", "<i8"), ("s", "<i8")])


def packed(contexts: list[tuple[int, bytes]], strings: np.ndarray, length: int, buckets: int) -> list[tuple[int, bytes]]:
    """Records of the strings of ``contexts(cid, bytes)``, packed by a bucket of their digest; ``s`` is -1 for one that repeats."""
    digests = b"".join(hashlib.md5(contexts[i][1][s : s + length]).digest() for i, s, _ in strings.tolist())
    out = np.empty(len(strings), RECORD)
    d = np.frombuffer(digests, "<u8").reshape(-1, 2)
    out["d0"], out["d1"] = d[:, 0], d[:, 1]
    out["cid"] = np.array([c for c, _ in contexts], np.int64)[strings[:, 0]]
    out["s"] = np.where(strings[:, 2] > 0, -1, strings[:, 1])
    bucket = (out["d0"] % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    out, bucket = out[order], bucket[order]
    cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    return [(int(bucket[c]), x.tobytes()) for c, x in zip(cuts, np.split(out, cuts[1:]), strict=True)]


def sort_contexts(entries: DataFrame, length: int, buckets: int) -> DataFrame:
    """``cid, lo, hi`` (runs of repeated starts) and ``bucket, records`` (of strings to be met with other chunks).

    ``entries(g, chunk, hot, cid, context)`` has each ``(g, chunk)`` in one partition, sorted.
    """
    names, kinds = ["cid", "lo", "hi", "bucket", "records"], (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())

    def solve(batch: list[tuple]) -> pa.RecordBatch:
        marks, strings = strings_of([x[4] for x in batch], length)
        rows = [(x[3], lo, hi, None, None) for x, m in zip(batch, marks, strict=True) for lo, hi in runs(m)]
        hot = np.array([x[2] for x in batch])
        if hot.any():
            rows += [(None, None, None, *r) for r in packed([(x[3], x[4]) for x in batch], strings[hot[strings[:, 0]]], length, buckets)]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batch, size = [], 0
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if size > BATCH and row[:2] != batch[-1][:2]:
                    yield solve(batch)
                    batch, size = [], 0
                batch.append(row)
                size += len(row[4])
        if batch:
            yield solve(batch)

    laid = entries.select("g", "chunk", "hot", "cid", "context").repartition("g", "chunk").sortWithinPartitions("g", "chunk")
    return laid.mapInArrow(run, "cid bigint, lo bigint, hi bigint, bucket bigint, records binary")


def meet_chunks(records: DataFrame) -> DataFrame:
    """``cid, lo, hi``: starts whose string another chunk has too, from ``records(bucket, records)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for parts in b.column(1):
                x = np.frombuffer(b"".join(parts.as_py()), RECORD)
                x = x[np.lexsort((x["d1"], x["d0"]))]
                same = (x["d0"][1:] == x["d0"][:-1]) & (x["d1"][1:] == x["d1"][:-1])
                x = x[(np.r_[False, same] | np.r_[same, False]) & (x["s"] >= 0)]
                s = pa.array(x["s"])
                yield pa.RecordBatch.from_arrays([pa.array(x["cid"]), s, s], ["cid", "lo", "hi"])

    return records.groupBy("bucket").agg(F.collect_list("records").alias("parts")).mapInArrow(run, "cid bigint, lo bigint, hi bigint")


def deduplicate(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept`` (binary) for every row of ``docs``.

    Null is like an empty text. Texts of fewer than ``length`` bytes lose nothing. Equal rows repeat each other.
    Strings are judged on the input, whole texts are used, very long ones piece by piece; matches end with the text. Only
    ``doc_id`` and ``text`` are read, so other columns may have any name. An empty table gives no rows.

    Anchors, contexts and copies that a large part of all rows share are joined by broadcast (``split_join``), so no
    task gets more than a small share of the rows for one of them.
    """
    keyed = docs.select("doc_id", *row_key(F.col("doc_id"), text_or_empty(F.col("text"))), text_or_empty(F.col("text")).alias("text"))
    found = materialize(anchors(keyed.select("k_id", "k_text", "text"), length, gram), "anchors")
    twice = materialize(found.groupBy("g").agg(F.count(F.lit(1)).alias("times")).where("times > 1"), "twice")
    own = split_join(found, twice, ["g"], "left_semi", "times", found.count())
    lists = materialize(own.groupBy("k_id", "k_text").agg(F.collect_set(F.struct("g", "a", "b")).alias("found")), "lists")
    discard(found, twice)
    some = materialize(keyed.join(lists, ["k_id", "k_text"]).select("doc_id", "k_id", "k_text", "text", "found"), "suspects")
    pieces = materialize(cut(some.select("k_id", "k_text", "text", "found"), length), "contexts")
    total = pieces.count()
    classes = materialize(pieces.groupBy("g", "digest").agg(F.count(F.lit(1)).alias("times")), "classes")
    open_ = classes.groupBy("g").agg(F.count(F.lit(1)).alias("different"), F.min("times").alias("least"), F.sum("times").alias("rows"))
    open_ = materialize(open_.where("different > 1 and least = 1").select("g", "different", "rows"), "open")
    entries = split_join(pieces, open_, ["g"], "inner", "rows", total).groupBy("g", "digest").agg(F.first("context").alias("context"), F.first("different").alias("different"))
    chunks = F.ceil(F.col("different") / HOT)
    entries = entries.select("g", "digest", "context", F.pmod(F.xxhash64("digest"), chunks).alias("chunk"), (chunks > 1).alias("hot"), F.monotonically_increasing_id().alias("cid"))
    entries = materialize(entries, "entries")
    buckets = max(16, entries.where("hot").count() // 1000)
    ordered = materialize(sort_contexts(entries, length, buckets), "sorted")
    runs_ = ordered.where("cid is not null").select("cid", "lo", "hi").unionByName(meet_chunks(ordered.where("bucket is not null").select("bucket", "records")))
    # a context that occurs twice repeats as a whole; of the others the runs do
    marks = runs_.join(entries.select("cid", "g", "digest"), "cid").groupBy("g", "digest").agg(F.collect_list(F.struct("lo", "hi")).alias("runs"))
    all_runs = F.array().cast("array<struct<lo:bigint,hi:bigint>>")
    solved = classes.where("times > 1").select("g", "digest", all_runs.alias("runs"), "times")
    solved = solved.unionByName(marks.join(classes.where("times = 1"), ["g", "digest"]).select("g", "digest", "runs", "times"))
    solved = materialize(solved, "solved")
    at = pieces.select("k_id", "k_text", "g", "digest", "a", F.octet_length("context").alias("size"))
    both = split_join(at, solved, ["g", "digest"], "inner", "times", total)
    whole = F.array(F.struct(F.col("a").alias("x"), (F.col("a") + F.col("size")).alias("y")))
    some_runs = F.transform("runs", lambda r: F.struct((F.col("a") + r["lo"]).alias("x"), (F.col("a") + r["hi"] + length).alias("y")))
    both = both.select("k_id", "k_text", F.explode(F.when(F.col("times") > 1, whole).otherwise(some_runs)).alias("span"))
    spans = materialize(both.groupBy("k_id", "k_text").agg(F.array_sort(F.collect_set("span")).alias("spans")), "spans")
    discard(pieces, classes, open_, entries, ordered, solved)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 128):
                rows = []
                for doc_id, text, spans in zip(*(c.to_pylist() for c in whole.slice(at, 128).columns), strict=True):
                    b, kept, end, n = utf8(text), [], 0, 0
                    for s in spans or ():
                        if s["x"] > end or not n:
                            kept.append(b[end : s["x"]])
                            n += 1
                        end = max(end, s["y"])
                    left = b"".join([*kept, b[end:]])
                    rows.append((doc_id, len(b), len(b) - len(left), n, left))
                kinds = (whole.schema.field(0).type, pa.int64(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    schema = f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary"
    changed = some.join(spans, ["k_id", "k_text"], "left").select("doc_id", "text", "spans").mapInArrow(run, schema)
    rest = keyed.join(lists.select("k_id", "k_text"), ["k_id", "k_text"], "left_anti")
    n = F.octet_length("text").cast("long")
    return changed.unionByName(rest.select("doc_id", n.alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.col("text").cast("binary").alias("kept")))
