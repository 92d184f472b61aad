"""Personal data by a semi-Markov conditional random field over whole spans.

Around characters that personal data is made of, a text is cut into tokens. Every segment of up to ``LONGEST``
tokens that could be an entity is a candidate for each type, scored by features of the whole span (digit count,
grouping, checksum, separators, domain form, the words before it). A dynamic program over segment ends chooses
boundaries and types jointly; the weights maximise the conditional likelihood of generated, labelled sentences
(forward-backward, gradient ascent) and are trained once per process from a fixed seed.

Four patterns are always reported. What the field adds are spans in other spellings (a phone number without a
plus sign, an address with ``(at)``, a card number with dots, ...), where they overlap no pattern's span.
"""

from __future__ import annotations

import functools
import hashlib
import math
import random
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

KINDS = ("email", "ip", "card", "phone")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGITS = re.compile(r"[0-9]")
#: What the field looks at: whole runs of digits and what may stand between them, and both sides of an at sign, however it is written.
NUMBERS = re.compile(r"[+(]*[0-9](?:[0-9+().\[\]/\-]|\s|dot)*+")
AT = re.compile(r"@|\((?:at|AT)\)|\[(?:at|AT)\]|(?<=\s)(?:at|AT)(?=\s[A-Za-z0-9-]+\s(?:dot|DOT)\s)")
HOST = re.compile(r"\s?[A-Za-z0-9-]+(?:(?:\.|\s(?:dot|DOT)\s|\s?[(\[](?:dot|DOT)[)\]]\s?)[A-Za-z]{2,})+")
TOKEN = re.compile(r"[A-Za-z]+|[0-9]+|\s|[^A-Za-z0-9\s]")
#: Tokens of an entity at most (a local part has 64 characters at most, a number 19 digits), its digits if it is a number.
LONGEST, MOST_DIGITS = 128, 19
#: Words that announce a type.
CUES = {"email": ("mail", "email", "contact", "write"), "ip": ("ip", "host", "server", "address"), "card": ("card", "visa", "credit", "payment"), "phone": ("phone", "tel", "call", "mobile", "fax")}


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(d * 2 - 9 * (d > 4) for d in map(int, even))) % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost, non-overlapping: for each at sign in turn, the local part back to the last match, then the domain."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and LOCAL_END.match(text, start - 1):
            start -= 1
        m = DOMAIN.match(text, at) if start < at else None
        if m:
            out.append((start, m.end()))
            last = m.end()
        else:
            last = max(last, at + 1)
        at = text.find("@", last)
    return out


def base(text: str) -> list[tuple[int, int, int]]:
    """``(kind, start, end)`` of the four patterns."""
    out = [(0, a, b) for a, b in emails(text)] if "@" in text else []
    if DIGITS.search(text):
        out += [(1, m.start(), m.end()) for m in IP.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or "0") <= 255 for x in m.group().split("."))]
        for m in CARD.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append((2, m.start(), m.end()))
        out += [(3, m.start(), m.end()) for m in PHONE.finditer(text) if 8 <= sum(map(str.isdigit, m.group())) <= 15] if "+" in text else []
    return out


def shape(segment: str, before: str, after: str) -> dict[int, dict[str, float]]:
    """Features of a candidate by the types it could be; none if it could be no entity."""
    digits = re.sub("[^0-9]", "", segment)
    n, out = len(digits), {}
    edge = (before[-1:].isalnum() or before[-1:] in set("._-/#@=:")) and bool(before)
    tail = after[:1].isalnum() or (after[:1] in set("-/@:=_") and after[1:2].isalnum())
    common = {"edge": float(edge), "tail": float(bool(tail)), "bias": 1.0}
    cue = set(re.findall("[a-z]+", before.lower()))
    for kind, words in enumerate(CUES.values()):
        own = dict(common, cue=float(bool(cue & set(words))))
        if kind == 0:
            m = re.fullmatch(r"[A-Za-z0-9._%+-]+(@|\s?[(\[](?:at|AT)[)\]]\s?|\s(?:at|AT)\s)[A-Za-z0-9-]+((?:\.|\s(?:dot|DOT)\s|\s?[(\[](?:dot|DOT)[)\]]\s?)[A-Za-z]{2,})+", segment)
            if m:
                out[kind] = own | {"plain": float(m[1] == "@"), "words": float(m[1] != "@")}
        elif kind == 1:
            m = re.fullmatch(r"[0-9]{1,3}(?:(\.|\s?[\[(](?:\.|dot)[\])]\s?)[0-9]{1,3}){3}", segment)
            if m:
                parts = re.findall("[0-9]+", segment)
                out[kind] = own | {"range": float(all(int(x) <= 255 for x in parts)), "zeros": float(any(len(x) > 1 and x[0] == "0" for x in parts))}
        elif kind == 2:
            if 13 <= n <= 19 and re.fullmatch(r"[0-9](?:[\s.\-/]?[0-9])+", segment):
                groups = tuple(map(len, re.findall("[0-9]+", segment)))
                out[kind] = own | {"luhn": float(luhn(digits)), "fails": float(not luhn(digits)), "fours": float(groups[:3] == (4, 4, 4) or groups == (4, 6, 5)), "solid": float(len(groups) == 1), "odd": float(len(groups) > 5)}
        elif 7 <= n <= 15 and re.fullmatch(r"(?:\+|00)?\(?[0-9](?:[\s().\-/]{0,2}[0-9])+", segment):
            groups = tuple(map(len, re.findall("[0-9]+", segment)))
            seps = set(re.sub("[0-9]", "", segment))
            out[kind] = own | {"national": float(groups in ((3, 3, 4), (1, 3, 3, 4), (2, 3, 3, 4))), "brackets": float("(" in seps and ")" in seps), "plus": float(segment[0] == "+"), "solid": float(len(groups) == 1), "groups": float(3 <= len(groups) <= 5), "dots": float(seps == {"."}), "date": float(groups in ((4, 2, 2), (2, 2, 4)))}
    return out


NAMES = [f"{kind}:{f}" for kind, fs in enumerate((("plain", "words"), ("range", "zeros"), ("luhn", "fails", "fours", "solid", "odd"), ("national", "brackets", "plus", "solid", "groups", "dots", "date"))) for f in ("bias", "edge", "tail", "cue", *fs)]
PLACE = {name: i for i, name in enumerate(NAMES)}


def segments(text: str, toks: list[tuple[int, int]]) -> Iterator[tuple[int, int, int, dict[str, float]]]:
    """``(first, last + 1, kind, features)`` of the segments of a window that could be entities, by their first token."""
    digits = list(accumulate((b - a if text[a] in "0123456789" else 0 for a, b in toks), initial=0))
    ats = [k for k, (a, b) in enumerate(toks) if text[a:b] in ("@", "at", "AT")]
    for i, (a, _) in enumerate(toks):
        if not (text[a].isascii() and text[a].isalnum() or text[a] in "+("):
            continue
        k = bisect_right(ats, i)
        last = ats[k] if k < len(ats) else len(toks)
        before = text[max(0, a - 24) : a]
        for j in range(i + 1, min(len(toks), i + LONGEST) + 1):
            if j <= last and (digits[j] - digits[i] > MOST_DIGITS or text[toks[j - 1][0]].isalpha() and text[toks[j - 1][0] : toks[j - 1][1]] != "dot"):
                if last - i >= LONGEST or last == len(toks):
                    break  # no number any more, and no address
                continue
            b = toks[j - 1][1]
            n = digits[j] - digits[i]
            if text[b - 1].isascii() and text[b - 1].isalnum() and (j > last or n >= 7 or n >= 4 and j - i >= 7):
                for kind, fs in shape(text[a:b], before, text[b : b + 4]).items():
                    yield i, j, kind, fs


def candidates(text: str, start: int, end: int) -> tuple[list[tuple[int, int]], list[tuple[int, int, int, np.ndarray]]]:
    """Tokens of a window, and its segments with their features as vectors."""
    toks = [m.span() for m in TOKEN.finditer(text, start, end)]
    out = []
    for i, j, kind, fs in segments(text, toks):
        x = np.zeros(len(NAMES))
        for f, v in fs.items():
            x[PLACE[f"{kind}:{f}"]] = v
        out.append((i, j, kind, x))
    return toks, out


def lattice(segs: list[tuple]) -> tuple[int, list[tuple[int, int]]]:
    """The places where segments start or end, as numbers without gaps: how many there are, and both ends of each segment."""
    place = {at: k for k, at in enumerate(sorted({s[0] for s in segs} | {s[1] for s in segs}))}
    return len(place), [(place[s[0]], place[s[1]]) for s in segs]


def log_add(a: float, b: float) -> float:
    return max(a, b) + math.log1p(math.exp(-abs(a - b)))


def marginals(places: int, ends: list[tuple[int, int]], scores: np.ndarray) -> tuple[np.ndarray, float]:
    """Probability of each segment of a lattice under the field, and the log partition function."""
    to, start = [[] for _ in range(places)], [[] for _ in range(places)]
    s = scores.tolist()
    for k, (i, j) in enumerate(ends):
        to[j].append((i, s[k]))
        start[i].append((j, s[k]))
    fore, back = [0.0] * places, [0.0] * places
    for j in range(1, places):
        fore[j] = fore[j - 1]
        for i, x in to[j]:
            fore[j] = log_add(fore[j], fore[i] + x)
    for i in range(places - 2, -1, -1):
        back[i] = back[i + 1]
        for j, x in start[i]:
            back[i] = log_add(back[i], back[j] + x)
    total = fore[-1] if places else 0.0
    return np.array([math.exp(fore[i] + x + back[j] - total) for (i, j), x in zip(ends, s, strict=True)]), total


def decode(n: int, scored: Iterable[tuple[int, int, int, float]]) -> list[tuple[int, int, int]]:
    """The best segmentation of ``n`` tokens, ``(first, last + 1, kind)`` of its entities; segments come by their first token."""
    best, via = [0.0] * (n + 1), [None] * (n + 1)
    at = 0
    for i, j, kind, s in scored:
        while at < i:
            at += 1
            if best[at - 1] >= best[at]:
                best[at], via[at] = best[at - 1], None
        if best[i] + s > best[j]:
            best[j], via[j] = best[i] + s, (i, j, kind)
    while at < n:
        at += 1
        if best[at - 1] >= best[at]:
            best[at], via[at] = best[at - 1], None
    out, j = [], n
    while j > 0:
        if via[j] is None:
            j -= 1
        else:
            out.append(via[j])
            j = via[j][0]
    return out[::-1]


def sentence(rng: random.Random) -> tuple[str, tuple[int, int, int] | None]:
    """A generated sentence and its entity ``(kind, start, end)``, or one without any."""
    d = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    w = lambda: "".join(rng.choice("aeiounrstlmdk") for _ in range(rng.randint(2, 8)))
    kind, sep = rng.randrange(8), rng.choice(" -.")
    if kind == 0:
        at, dot = rng.choice([("@", "."), ("@", "."), (" (at) ", "."), ("(at)", "."), (" at ", " dot "), ("[at]", "[dot]")])
        value = f"{w()}{rng.choice(['', '.' + w(), d(2)])}{at}{w()}{dot}{rng.choice(['com', 'org', 'net', 'de', 'fr'])}"
    elif kind == 1:
        value = rng.choice([".", ".", "[.]", "(.)"]).join(str(rng.randrange(256)) for _ in range(4))
    elif kind == 2:
        body = rng.choice("3456") + d(14)
        body += next(c for c in "0123456789" if luhn(body + c))
        value = rng.choice([body, sep.join(body[i : i + 4] for i in range(0, 16, 4))])
    elif kind == 3:
        a, b, c = d(3), d(3), d(4)
        value = rng.choice([f"+{rng.randint(1, 99)} ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}{rng.choice('-. ')}{b}-{c}", f"{a}.{b}.{c}", f"00{rng.randint(30, 49)} {a} {b} {c}"])
    else:
        value = rng.choice([d(rng.randint(1, 6)), d(16), d(12), f"{d(4)}-{d(2)}-{d(2)}", f"{d(1)}.{d(1)}.{d(1)}", f"{rng.randint(256, 999)}.{d(3)}.{d(3)}.{d(3)}", hashlib.md5(d(9).encode()).hexdigest(), f"{d(3)}/{d(4)}/{d(5)}", f"{d(10)}", f"{w()}-{d(7)}-{d(3)}", f"v{d(1)}.{d(2)}.{d(1)}.{d(1)}", f"{w()} at {w()}", f"{d(8)} {d(8)} {d(4)}"])
    cue = rng.choice(list(CUES.values())[kind]) + rng.choice([" ", ": "]) if kind < 4 and rng.random() < 0.3 else w() + " "
    head = f"{w()} {w()} {cue}"
    return f"{head}{value} {w()} {w()}{rng.choice(['', '.'])}", (kind, len(head), len(head) + len(value)) if kind < 4 else None


@functools.lru_cache(maxsize=1)
def trained(sentences: int = 600, rounds: int = 40, rate: float = 2.0, ridge: float = 1e-3) -> tuple[float, ...]:
    """Weights by gradient ascent on the conditional log likelihood of generated sentences."""
    rng, data = random.Random(20), []
    for _ in range(sentences):
        text, truth = sentence(rng)
        toks, segs = candidates(text, 0, len(text))
        gold = [k for k, (i, j, kind, _) in enumerate(segs) if truth == (kind, toks[i][0], toks[j - 1][1])]
        if segs and (truth is None or gold):
            data.append((*lattice(segs), np.array([s[3] for s in segs]), gold))
    weights = np.zeros(len(NAMES))
    for _ in range(rounds):
        grad = -ridge * weights
        for places, ends, x, gold in data:
            p, _ = marginals(places, ends, x @ weights)
            p[gold] -= 1
            grad -= p @ x / len(data)
        weights = weights + rate * grad * 10
    return tuple(weights.tolist())


def windows(text: str) -> list[list[int]]:
    """Where entities can be, ``[start, end]``: whole runs, so that none is cut; runs that overlap are one."""
    out = []
    if DIGITS.search(text):
        for m in NUMBERS.finditer(text):
            digits = sum(map(str.isdigit, m.group()))
            if digits >= 7 or digits >= 4 and (m.group().count(".") >= 3 or m.group().count("dot") >= 3):
                out.append([m.start(), m.end()])
    for m in AT.finditer(text):
        a = end = m.start() - 1 if m.start() and text[m.start() - 1].isspace() else m.start()
        while a > 0 and LOCAL_END.match(text, a - 1):
            a -= 1
        host = HOST.match(text, m.end()) if a < end else None
        if host:
            out.append([a, host.end()])
    out.sort()
    merged = []
    for a, b in out:
        if merged and a < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    return merged


def added(text: str, found: list[tuple[int, int, int]], weights: dict[str, float]) -> list[tuple[int, int, int]]:
    """``(kind, start, end)`` that the field finds beside the spans in ``found``, which no candidate overlaps."""
    taken = sorted((a, b) for _, a, b in found)
    starts, reach = [a for a, _ in taken], list(accumulate((b for _, b in taken), max))
    out = []
    for a, b in windows(text):
        toks = [m.span() for m in TOKEN.finditer(text, a, b)]

        def scored(toks=toks) -> Iterator[tuple[int, int, int, float]]:
            for i, j, kind, fs in segments(text, toks):
                k = bisect_left(starts, toks[j - 1][1])
                if not k or reach[k - 1] <= toks[i][0]:
                    yield i, j, kind, sum(v * weights[f"{kind}:{f}"] for f, v in fs.items())

        out += [(kind, toks[i][0], toks[j - 1][1]) for i, j, kind in decode(len(toks), scored())]
    return out


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


def find(docs: DataFrame) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans`` for every row of ``docs``.

    The counts and the digest are of the patterns; ``spans`` lists all spans as ``kind:start:end`` in code points,
    by kind, then start. Null is like an empty text: no spans. Texts of any length are read whole, and entities are
    looked for in whole runs, so none is cut. Equal texts have equal spans; an empty table gives no rows. Only ``doc_id``
    and ``text`` are read, so other columns may have any name.
    """
    weights = dict(zip(NAMES, trained(), strict=True))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bases, alls = [], []
            for text in b.column(1).to_pylist():
                own = base(text or "")
                bases.append(own)
                alls.append(listed(own + added(text or "", own, weights)))
            counts = [pa.array([sum(x[0] == k for x in own) for own in bases], pa.int64()) for k in range(4)]
            digests = pa.array([hashlib.sha256(listed(own).encode()).hexdigest() for own in bases], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), *counts, digests, pa.array(alls, pa.string())], ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string")
