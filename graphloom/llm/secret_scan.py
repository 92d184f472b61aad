"""Secret scans by token efficiency.

A tokenizer's vocabulary holds the frequent strings of ordinary text and code, so ordinary words take few
tokens for their characters and random strings take many. A long run of key characters whose characters per
token stay below ``MOST`` is reported, unless it is a digest of a known length, a UUID or a plain number. Three
patterns (assignments, access keys, long hexadecimal runs) are always reported; spans found by efficiency are
added where they overlap none of these.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how this vocabulary's tokenizer splits a text before it merges bytes.
SPLIT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters per token below which a run counts as random, and characters that are encoded at once.
MOST, PIECE = 2.2, 1 << 16

KINDS = ("assign", "access", "hex", "random")
WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}+")
#: Runs of key characters, dots inside them too, and their parts between dots.
RUN = re.compile(r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z0-9+/_=.-]{20})[A-Za-z0-9+/_=-]++(?:\.++[A-Za-z0-9+/_=-]++)*+")
PART = re.compile(r"[A-Za-z0-9+/_=-]+")
SHORTEST = 20
#: Digests (MD5, SHA-1, SHA-224, SHA-256, SHA-384, SHA-512) by their hexadecimal length, and UUIDs.
DIGEST = re.compile(r"(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128})\Z", re.IGNORECASE)
UUID = re.compile(r"[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}\Z", re.IGNORECASE)
#: What stands before the run of a data URI.
DATA = re.compile(r"data:[A-Za-z0-9.+/-]*(?:;[A-Za-z0-9=._-]*)*;base64,\Z", re.IGNORECASE)
HAS_LETTER = re.compile("[A-Za-z]")


def ranks_from(path: str = VOCABULARY) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class Scanner:
    def __init__(self, ranks: dict[bytes, int], most: float = MOST) -> None:
        import tiktoken

        self.encode = tiktoken.Encoding("scan", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.most = most

    def base(self, text: str) -> list[tuple[int, int, int]]:
        """``(start, kind, end)`` of the three patterns, sorted."""
        raw = text.encode("utf-8", "surrogatepass").lower()
        found = []
        if any(w in raw for w in WORDS):
            found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
        if b"akia" in raw:
            found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
        found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
        return sorted(found)

    def is_random(self, run: str) -> bool:
        return len(run) < self.most * sum(len(self.encode(run[i : i + PIECE])) for i in range(0, len(run), PIECE))

    def random(self, text: str) -> Iterator[tuple[int, int, int]]:
        """Runs that are random as a whole, and of the others the parts between dots that are."""
        for m in RUN.finditer(text):
            if m.end() - m.start() < SHORTEST or DATA.search(text, max(0, m.start() - 100), m.start()):
                continue
            parts = [p.span() for p in PART.finditer(text, m.start(), m.end())]
            if len(parts) > 1 and HAS_LETTER.search(m.group()) and not any(known(text[a:b]) for a, b in parts) and self.is_random(m.group()):
                yield m.start(), 3, m.end()
                continue
            for a, b in parts:
                if b - a >= SHORTEST and HAS_LETTER.search(text, a, b) and not known(text[a:b]) and self.is_random(text[a:b]):
                    yield a, 3, b

    def spans(self, text: str | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
        """The base spans, and all spans."""
        text = text or ""
        base = self.base(text)
        more = [x for x in self.random(text) if all(x[2] <= b[0] or b[2] <= x[0] for b in base)]
        return base, sorted(base + more)


def known(run: str) -> bool:
    """Whether a run is a digest of a known length or a UUID."""
    return bool(DIGEST.match(run) or UUID.match(run))


def listed(spans: list[tuple[int, int, int]], kinds: tuple[str, ...] = KINDS) -> str:
    return ",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in spans)


def scan(docs: DataFrame, vocabulary: str = VOCABULARY, most: float = MOST) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans`` for every row of ``docs``.

    The counts and the digest are of the base patterns; ``spans`` lists all spans as ``kind:start:end`` in code
    points, by start, then kind. Null is like an empty text: no spans. The vocabulary is read by the driver and
    broadcast (under 2 MB), so executors need no file. Runs of any length are judged, each as a whole; encoded
    data stands out only after ``DATA`` (a data URI) and is left to the base patterns. Equal rows have equal spans; an
    empty table gives no rows. Only ``doc_id`` and ``text`` are read, so other columns may have any name.
    """
    sent = docs.sparkSession.sparkContext.broadcast(ranks_from(vocabulary))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(sent.value, most)
        for b in batches:
            rows = [scanner.spans(t) for t in b.column(1).to_pylist()]
            counts = [pa.array([sum(x[1] == k for x in base) for base, _ in rows], pa.int64()) for k in range(3)]
            digests = pa.array([hashlib.sha256(listed(base).encode()).hexdigest() for base, _ in rows], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), *counts, digests, pa.array([listed(spans) for _, spans in rows], pa.string())], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string")
