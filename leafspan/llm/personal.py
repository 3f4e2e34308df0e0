"""Personal data: fixed patterns, and a semi-Markov conditional random field over whole spans that adds what they miss.

The field scores candidate segments of a text region by features of the whole span (digits, groups, separators, checksum, words
before it) and a dynamic programme picks boundaries and types together; an entity has a bounded number of tokens. It is fitted
by gradient ascent on the likelihood of regions of a bounded sample. Their labels are the spans of the patterns, and each region is
also seen rewritten (no plus sign, other separators, a spelt-out at sign), which teaches the field the forms that patterns miss.
"""

from __future__ import annotations

import math
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafspan.llm.common import as_bytes, query, slices, table

KINDS = ("email", "ip", "card", "phone")

# Fixed patterns of the base spans.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
# The same without trying every start within a run: from its later characters nothing matches that does not from the first.
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_HOST = re.compile(r"[A-Za-z0-9-]++(\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")

# Rows that the field is fitted on: about so many, and at most so many regions of them.
SAMPLE_ROWS = 4_000
SAMPLE_REGIONS = 300
MAX_TOKENS = 16  # of an entity
REACH = 40  # characters of a region around what may belong to an entity
MARGIN = 2.0  # by how much a span's score must exceed that of no entity

_DIGITS = re.compile(r"[0-9]")
_TOKEN = re.compile(r"[0-9]+|[^\W\d_]+|[^\w\s]|_")
_SEED = re.compile(r"[0-9]{2,}|@|[(\[]\s?at\s?[)\]]", re.IGNORECASE)
_AT = ("(at)", "[at]", "( at )", "[ at ]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Leftmost non-overlapping matches of each kind that pass its check; a failing match is not tried again."""
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    at, free = text.find("@"), 0
    while at >= 0:
        # The local part is what stands before the sign, back to the last sign or address; all of it matches, or none.
        before = text[free:at]
        start = len(before.rstrip(_LOCAL)) + free
        host = _HOST.match(text, at + 1) if start < at else None
        if host:
            found["email"].append((start, host.end()))
        free = host.end() if host else at + 1
        at = text.find("@", free)
    if _DIGITS.search(text):
        found["ip"] = [m.span() for m in _IP.finditer(text) if all(_at_most_255(p) for p in m.group().split("."))]
        for m in CARD.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                found["card"].append(m.span())
        if "+" in text:
            found["phone"] = [m.span() for m in PHONE.finditer(text) if 9 <= sum(c in "0123456789" for c in m.group()) <= 15]
    return found


def _at_most_255(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def regions(text: str) -> list[tuple[int, int]]:
    """Parts of a text that may hold an entity: digits and at signs with their surroundings, cut at white space."""
    out: list[tuple[int, int]] = []
    for m in _SEED.finditer(text):
        start, end = max(0, m.start() - REACH), min(len(text), m.end() + REACH)
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], end)
        else:
            out.append((start, end))
    return out


def tokens(text: str, start: int, end: int) -> list[tuple[int, int]]:
    return [m.span() for m in _TOKEN.finditer(text, start, end)]


def features(text: str, start: int, end: int) -> tuple[str, dict[str, float]] | None:
    """Type that a span could have and its whole-span features; none for a span that can be no entity."""
    span = text[start:end]
    if (start and text[start - 1].isalnum() and span[0].isalnum()) or (end < len(text) and text[end].isalnum() and span[-1].isalnum()):
        return None
    before = re.findall(r"[^\W\d_]+", text[max(0, start - 24) : start].lower())
    cue = before[-1] if before else ""
    if "@" in span or any(a in span.lower() for a in _AT):
        flat = re.sub(r"\s*[(\[]\s?at\s?[)\]]\s*", "@", span.lower())
        flat = re.sub(r"\s*[(\[]\s?dot\s?[)\]]\s*", ".", flat)
        local, _, host = flat.partition("@")
        if not local or not host or "@" in host or re.search(r"\s", flat) or not (local[0].isalnum() and host[-1].isalnum()):
            return None
        labels = host.split(".")
        return "email", {
            "plain": float(flat == span.lower()), "dots": min(3, len(labels) - 1), "no_dot": float(len(labels) == 1),
            "ending": float(labels[-1].isalpha() and 2 <= len(labels[-1]) <= 8), "clean": float(bool(re.fullmatch(r"[\w.%+-]+@[\w.-]+", flat))),
            "cue": float(cue in ("email", "mail", "contact")), "bias": 1.0,
        }
    if re.search(r"[^0-9\s().+/-]", span) or not (span[0] in "+(" or span[0].isdigit()) or not span[-1].isdigit() or "\n" in span:
        return None
    digits = re.sub(r"\D", "", span)
    groups, separators = re.findall(r"[0-9]+", span), set(re.findall(r"[^0-9]", span))
    if len(groups) == 4 and separators == {"."}:
        good = all(_at_most_255(g) for g in groups)
        return "ip", {"good": float(good), "bad": float(not good), "wide": float(any(len(g) > 3 for g in groups)), "bias": 1.0}
    if 13 <= len(digits) <= 19 and "+" not in span and "(" not in span:
        even = len({len(g) for g in groups[:-1]}) <= 1
        return "card", {"luhn": float(luhn(digits)), "fails": float(not luhn(digits)), "even": float(even), "single": float(len(groups) == 1), "separators": float(len(separators)), "bias": 1.0}
    if 7 <= len(digits) <= 15:
        return "phone", {
            "plus": float(span[0] == "+"), "paren": float(bool(re.search(r"\([0-9]{2,4}\)", span))), "open": float(span.count("(") != span.count(")")),
            "groups": float(min(5, len(groups))), "single": float(len(groups) == 1), "ten": float(len(digits) in (10, 11)),
            "last_four": float(len(groups[-1]) == 4), "short_group": float(any(len(g) < 3 for g in groups[1:])),
            "separators": float(len(separators - set("+()"))), "double": float(bool(re.search(r"[^0-9)+]{2}", span))),
            "cue": float(cue in ("phone", "tel", "call", "fax", "mobile")), "bias": 1.0,
        }
    return None


@dataclass
class Segment:
    first: int
    last: int
    kind: str
    score: float
    features: dict[str, float]


def candidates(text: str, spans: list[tuple[int, int]], weights: dict[str, float]) -> list[Segment]:
    """Scored candidate segments of a region, each of at most ``MAX_TOKENS`` tokens."""
    out = []
    for i, (start, _) in enumerate(spans):
        if not (text[start] in "+([" or text[start].isalnum()):
            continue
        for j in range(i, min(len(spans), i + MAX_TOKENS)):
            end = spans[j][1]
            if j > i and spans[j][0] - spans[j - 1][1] > 2:
                break
            if text[end - 1].isalnum() and (found := features(text, start, end)):
                kind, values = found
                named = {f"{kind}:{k}": v for k, v in values.items()}
                out.append(Segment(i, j, kind, sum(weights.get(k, 0.0) * v for k, v in named.items()), named))
    return out


def best_segments(length: int, segments: list[Segment]) -> list[Segment]:
    """The highest-scoring set of disjoint segments; tokens outside have no score."""
    ending: dict[int, list[Segment]] = {}
    for s in segments:
        ending.setdefault(s.last, []).append(s)
    best, back = [0.0] * (length + 1), [None] * (length + 1)
    for i in range(length):
        best[i + 1] = best[i]
        for s in ending.get(i, ()):
            if s.score > MARGIN and best[s.first] + s.score > best[i + 1]:
                best[i + 1], back[i + 1] = best[s.first] + s.score, s
    out, at = [], length
    while at:
        if back[at] is None:
            at -= 1
        else:
            out.append(back[at])
            at = back[at].first
    return out[::-1]


def marginals(length: int, segments: list[Segment]) -> list[float]:
    """Probability of each segment under the field, by forward and backward sums."""
    starting: dict[int, list[Segment]] = {}
    ending: dict[int, list[Segment]] = {}
    for s in segments:
        starting.setdefault(s.first, []).append(s)
        ending.setdefault(s.last, []).append(s)
    forward, backward = [0.0] * (length + 1), [0.0] * (length + 1)
    for i in range(length):
        forward[i + 1] = _log_sum([forward[i], *(forward[s.first] + s.score for s in ending.get(i, ()))])
    for i in range(length - 1, -1, -1):
        backward[i] = _log_sum([backward[i + 1], *(backward[s.last + 1] + s.score for s in starting.get(i, ()))])
    return [math.exp(min(0.0, forward[s.first] + s.score + backward[s.last + 1] - forward[length])) for s in segments]


def _log_sum(values: list[float]) -> float:
    top = max(values)
    return top + math.log(sum(math.exp(v - top) for v in values))


def rewrites(text: str, kind: str, span: tuple[int, int]) -> list[str]:
    """A base span in forms that the patterns do not match."""
    old = text[span[0] : span[1]]
    if kind == "email":
        local, _, host = old.partition("@")
        return [f"{local} [at] {host}", f"{local} (at) {host.replace('.', ' (dot) ')}"]
    if kind == "card":
        digits = re.sub(r"\D", "", old)
        return [".".join(digits[i : i + 4] for i in range(0, len(digits), 4)), "  ".join(digits[i : i + 4] for i in range(0, len(digits), 4))]
    if kind == "phone":
        bare = re.sub(r"^\+[0-9]+[ .-]?", "", old)
        numbers = re.findall(r"[0-9]+", bare)
        return [bare, "-".join(numbers), ".".join(numbers)] if len(numbers) > 1 else []
    return []


def fit(samples: list[str], epochs: int = 12, seed: int = 5) -> dict[str, float]:
    """Weights from regions' texts; the patterns label them, as they are and rewritten."""
    labelled: list[tuple[str, set[tuple[int, int]]]] = []
    for text in samples:
        spans = [(k, s) for k, found in base_spans(text).items() for s in found]
        labelled.append((text, {s for _, s in spans}))
        for kind, span in spans:
            for new in rewrites(text, kind, span):
                shift = len(new) - (span[1] - span[0])
                moved = {s if s[1] <= span[0] else (s[0] + shift, s[1] + shift) for _, s in spans if s[1] <= span[0] or s[0] >= span[1]}
                labelled.append((text[: span[0]] + new + text[span[1] :], moved | {(span[0], span[0] + len(new))}))
    weights: dict[str, float] = {}
    order = random.Random(seed)
    prepared = [(t, tokens(t, 0, len(t)), gold) for t, gold in labelled]
    known = [(len(spans), candidates(t, spans, {}), t, spans, gold) for t, spans, gold in prepared]
    known = [k for k in known if k[1]]
    for epoch in range(epochs):
        rate = 0.5 / (1 + 0.3 * epoch)
        order.shuffle(known)
        for length, segments, _, spans, gold in known:
            for s in segments:
                s.score = sum(weights.get(k, 0.0) * v for k, v in s.features.items())
            for s, p in zip(segments, marginals(length, segments)):
                wrong = float((spans[s.first][0], spans[s.last][1]) in gold) - p
                for k, v in s.features.items():
                    weights[k] = weights.get(k, 0.0) * (1 - 1e-4 * rate) + rate * wrong * v
    return weights


def added_spans(text: str, weights: dict[str, float], base: dict[str, list[tuple[int, int]]]) -> list[tuple[str, int, int]]:
    """Spans of the field that touch no base span."""
    taken = [s for found in base.values() for s in found]
    out = []
    for start, end in regions(text):
        spans = tokens(text, start, end)
        for s in best_segments(len(spans), candidates(text, spans, weights)):
            a, b = spans[s.first][0], spans[s.last][1]
            if all(b <= x or a >= y for x, y in taken):
                out.append((s.kind, a, b))
    return out


def learn(docs: DataFrame, text_col: str = "text") -> dict[str, float]:
    """Fit the field on regions of a bounded sample of documents, picked by a hash of their text."""
    rows = docs.select(F.col(text_col).cast("string").alias("text")).where(F.col("text").isNotNull())
    total = rows.count()
    if not total:
        return {}
    share = min(1.0, SAMPLE_ROWS / total)
    picked = rows.where(F.pmod(F.xxhash64("text", F.lit(11)), F.lit(1_000_000_007)) < int(share * 1_000_000_007))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = []
            for data in as_bytes(batch):
                text = data.decode()
                # A region ends where its text is cut, so its length is bounded too.
                found += [text[a : min(b, a + 20 * REACH)] for a, b in regions(text)]
            yield pa.RecordBatch.from_pydict({"region": pa.array(found, pa.string())})

    sample = picked.mapInArrow(run, "region string").distinct().orderBy(F.xxhash64("region")).limit(SAMPLE_REGIONS).collect()
    return fit([r["region"] for r in sample])


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id`` and ``base`` and ``spans``, arrays of kind, start and end in code points.

    ``base`` are the patterns' spans, ``spans`` those and the field's, in the order of kinds and then of start. Null counts as an
    empty text, whole texts are read, repeated rows are searched each, an empty table gives no rows, other columns are not
    looked at. Entities of more than ``MAX_TOKENS`` tokens are only found by the patterns.
    """
    weights = learn(docs, text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    number = {k: i for i, k in enumerate(KINDS)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            base, spans = [], []
            for data in as_bytes(batch):
                text = data.decode()
                found = base_spans(text)
                own = [(k, a, b) for k in KINDS for a, b in found[k]]
                every = sorted(own + added_spans(text, weights, found), key=lambda s: (number[s[0]], s[1]))
                base.append([{"kind": k, "start": a, "end": b} for k, a, b in own])
                spans.append([{"kind": k, "start": a, "end": b} for k, a, b in every])
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "base": pa.array(base, kind), "spans": pa.array(spans, kind)})

    span = "array<struct<kind:string,start:long,end:long>>"
    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, base {span}, spans {span}")


def joined(column: str):
    """Spans as ``kind:start:end``, comma-joined."""
    return F.concat_ws(",", F.transform(column, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


@query("op4_personal_data")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    found = find(table(spark, folder, "documents"))
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [F.size(F.array_remove(F.transform(kinds, lambda x: x != F.lit(k)), True)).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select(
        "doc_id", *counts, F.sha2(joined("base").cast("binary"), 256).alias("base_sha256"), joined("spans").alias("spans"),
        (F.size("spans") - F.size("base")).cast("long").alias("n_added"),
    )
