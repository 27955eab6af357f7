"""Personal data by fixed patterns and a semi-Markov conditional random field.

The patterns give the base spans. The field scores whole candidate spans - digit
groups, checksums, separators, surroundings - and a dynamic programme over a
region's atoms, with entities of bounded length, chooses boundaries and kinds
together. It is trained here, by likelihood, on a bounded sample: the base spans
found there, the same spans written evasively ("name [at] host [dot] com"), and
the regions around them without any. Its spans are added where no base span lies.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from math import exp, log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
#: The fit reads at most so many documents, and so many regions with and without base spans.
SAMPLE_DOCS, SAMPLE_REGIONS = 800, 160
MAX_ATOMS, MAX_CHARS = 26, 80
#: A span is added when the best path holds it and its posterior is at least this.
MIN_POSTERIOR = 0.7

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Walks from one @ to the next, so that a long run of letters costs no more than its length."""
    last, at = 0, text.find("@")
    while at >= 0:
        domain = DOMAIN.match(text, at + 1)
        start = at
        while domain and start > last and text[start - 1] in LOCAL:
            start -= 1
        if start < at:
            last = domain.end()
            yield start, last
            at = text.find("@", last)
        else:
            at = text.find("@", at + 1)


def octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or (len(part) == 3 and part <= "255")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the fixed patterns, by kind, then start; no pattern backtracks over a long run."""
    found = [(0, s, e) for s, e in emails(text)]
    found += [(1, m.start(), m.end()) for m in IP.finditer(text) if all(map(octet, m.groups()))]
    for m in CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            found.append((2, m.start(), m.end()))
    for m in PHONE.finditer(text):
        phone = m.group().rstrip(" ().-")
        if len(phone) >= 4 and 8 <= sum(c.isdigit() for c in phone) <= 15:
            found.append((3, m.start(), m.start() + len(phone)))
    return found


TRIGGER = re.compile(r"[0-9]+|@|[\[(] ?at ?[\])]")
ATOM = re.compile(r"[^\W\d_]+|[0-9]+|\s+|.", re.S)


def regions(text: str) -> Iterator[tuple[int, int]]:
    """Stretches of text around digits and at-signs; what lies outside holds no candidate."""
    start = end = -1
    for m in TRIGGER.finditer(text):
        if end < 0 or m.start() > end:
            if end >= 0:
                yield start, end
            start = max(0, end, m.start() - 32)
            # An entity is not cut: a region begins at a gap between words, if one is near.
            while start > max(0, end, m.start() - MAX_CHARS) and not text[start - 1].isspace():
                start -= 1
        end = min(len(text), m.end() + 40)
    if end >= 0:
        yield start, end


class Region:
    """Atoms of a stretch of text and the candidate segments over them."""

    def __init__(self, text: str, start: int, end: int):
        self.text, self.start = text, start
        self.bounds = [start]
        self.bounds += [m.end() for m in ATOM.finditer(text, start, end)]
        self.segments: list[tuple[int, int]] = []
        heads = [text[b] for b in self.bounds[:-1]]
        useful = [bool(c.isdigit() or c in "@") for c in heads]
        ahead = [0]
        for u in useful:
            ahead.append(ahead[-1] + u)
        n = len(heads)
        for i in range(n):
            if not (heads[i].isalnum() or heads[i] in "+("):
                continue
            if i and heads[i].isalnum() and text[self.bounds[i] - 1].isalnum():
                continue  # inside a word
            for j in range(i + 1, min(n, i + MAX_ATOMS) + 1):
                if self.bounds[j] - self.bounds[i] > MAX_CHARS or "\n" in text[self.bounds[j - 1] : self.bounds[j]]:
                    break
                if self.bounds[j] - self.bounds[i] < 7 or not heads[j - 1].isalnum() or (j < n and heads[j].isalnum()):
                    continue
                bracketed = "at]" in text[self.bounds[i] : self.bounds[j]] or "at)" in text[self.bounds[i] : self.bounds[j]]
                if ahead[j] > ahead[i] or bracketed:
                    self.segments.append((i, j))

    def features(self, i: int, j: int) -> list[str]:
        """What the whole span looks like, and what stands around it."""
        text, a, b = self.text, self.bounds[i], self.bounds[j]
        span = text[a:b]
        shape = re.sub(r"[^\W\d_]+", "a", re.sub(r"[0-9]+", "d", span))
        groups = re.findall(r"[0-9]+", span)
        digits = sum(map(len, groups))
        letters = sum(c.isalpha() for c in span)
        separators = set(re.sub(r"[^\W_]", "", span))
        out = [
            "bias",
            f"shape={shape[:32]}",
            f"digits={min(digits, 24)}",
            f"groups={','.join(str(len(g)) for g in groups[:6])}",
            f"letters={min(letters, 3)}",
            f"spaces={min(span.count(' '), 4)}",
            f"ends={self.kind(span[0])}{self.kind(span[-1])}",
            f"left={self.kind(text[a - 1]) if a else '^'}",
            f"right={self.kind(text[b]) if b < len(text) else '$'}",
            f"separators={''.join(sorted(separators))[:8]}",
        ]
        mailish = re.fullmatch(
            r"[\w.%+-]+ ?(?:@|[\[(] ?at ?[\])]) ?[A-Za-z0-9-]+(?: ?(?:\.|[\[(] ?dot ?[\])]) ?[A-Za-z0-9-]+)+", span
        )
        if mailish:
            out.append("mailish")
        if len(groups) == 4 and not letters and re.fullmatch(r"[0-9]+(?:(?:\.|\[\.\]|\(\.\))[0-9]+){3}", span):
            out.append("octets" if all(map(octet, groups)) else "no-octets")
        if not letters and 16 <= digits <= 19:
            out.append("luhn" if luhn("".join(groups)) else "no-luhn")
        if not letters and re.fullmatch(r"(?:\+?[0-9]{1,3}[ .-]?)?\([0-9]{2,4}\)[ .-]?[0-9]{3,4}[ .-][0-9]{3,4}", span):
            out.append("dialled")
        return out

    @staticmethod
    def kind(c: str) -> str:
        return "d" if c.isdigit() else "a" if c.isalpha() else "_" if c.isspace() else c


def log_sums(region: Region, best: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward and backward log sums at each atom boundary; an atom outside entities scores 0."""
    n = len(region.bounds) - 1
    ending: list[list[int]] = [[] for _ in range(n + 1)]
    beginning: list[list[int]] = [[] for _ in range(n + 1)]
    for k, (i, j) in enumerate(region.segments):
        ending[j].append(k)
        beginning[i].append(k)
    score = best.tolist()
    forward, backward = [0.0] * (n + 1), [0.0] * (n + 1)
    for j in range(1, n + 1):
        terms = [forward[j - 1], *[forward[region.segments[k][0]] + score[k] for k in ending[j]]]
        top = max(terms)
        forward[j] = top + log(sum(exp(t - top) for t in terms)) if len(terms) > 1 else top
    for i in range(n - 1, -1, -1):
        terms = [backward[i + 1], *[backward[region.segments[k][1]] + score[k] for k in beginning[i]]]
        top = max(terms)
        backward[i] = top + log(sum(exp(t - top) for t in terms)) if len(terms) > 1 else top
    return np.asarray(forward), np.asarray(backward)


def fit_weights(examples: list[tuple[Region, dict[tuple[int, int], int]]], rounds: int = 50, ridge: float = 0.005) -> dict[str, list[float]]:
    """Maximum likelihood by AdaGrad steps; one weight per feature and kind."""
    names: dict[str, int] = {}
    flat: list[int] = []
    cuts = [0]
    gold: list[int] = []
    owners = []
    for region, spans in examples:
        owners.append((len(cuts) - 1, len(cuts) - 1 + len(region.segments)))
        for i, j in region.segments:
            flat += [names.setdefault(f, len(names)) for f in region.features(i, j)]
            cuts.append(len(flat))
            gold.append(spans.get((i, j), -1))
    if not flat:
        return {}
    index, starts, gold_kind = np.asarray(flat), np.asarray(cuts[:-1]), np.asarray(gold)
    segment_of = np.repeat(np.arange(len(starts)), np.diff(cuts))
    weight = np.zeros((len(names), len(KINDS)))
    square = np.full_like(weight, 1e-6)
    target = np.zeros((len(starts), len(KINDS)))
    target[np.flatnonzero(gold_kind >= 0), gold_kind[gold_kind >= 0]] = 1
    for _ in range(rounds):
        score = np.add.reduceat(weight[index], starts, axis=0)
        best = np.logaddexp.reduce(score, axis=1)
        expected = np.zeros_like(score)
        for (region, _spans), (a, b) in zip(examples, owners, strict=True):
            if a == b:
                continue
            forward, backward = log_sums(region, best[a:b])
            i, j = np.asarray(region.segments).T
            inside = forward[i] + backward[j] - forward[-1]
            expected[a:b] = np.exp(inside[:, None] + score[a:b])
        grad = np.zeros_like(weight)
        np.add.at(grad, index, (target - expected)[segment_of])
        grad -= ridge * weight
        square += grad * grad
        weight += 0.5 * grad / np.sqrt(square)
    return {f: weight[k].round(6).tolist() for f, k in names.items()}


def decode(region: Region, weights: dict[str, list[float]]) -> list[tuple[int, int, int]]:
    """The best segmentation's entities with a posterior of at least MIN_POSTERIOR."""
    if not region.segments or not weights:
        return []
    zero = np.zeros(len(KINDS))
    score = np.asarray([sum((np.asarray(weights[f]) for f in region.features(i, j) if f in weights), zero) for i, j in region.segments])
    top, kind = score.max(axis=1), score.argmax(axis=1)
    n = len(region.bounds) - 1
    ending: list[list[int]] = [[] for _ in range(n + 1)]
    for k, (_i, j) in enumerate(region.segments):
        ending[j].append(k)
    value, back = np.zeros(n + 1), np.full(n + 1, -1)
    for j in range(1, n + 1):
        value[j] = value[j - 1]
        for k in ending[j]:
            v = value[region.segments[k][0]] + top[k]
            if v > value[j]:
                value[j], back[j] = v, k
    forward, backward = log_sums(region, np.logaddexp.reduce(score, axis=1))
    found, j = [], n
    while j > 0:
        if back[j] < 0:
            j -= 1
            continue
        k = back[j]
        i, end = region.segments[k]
        if np.exp(forward[i] + backward[end] - forward[-1] + top[k]) >= MIN_POSTERIOR:
            found.append((int(kind[k]), region.bounds[i], region.bounds[end]))
        j = i
    return found


def all_spans(text: str, weights: dict[str, list[float]]) -> list[tuple[int, int, int, bool]]:
    """(kind, start, end, base) by kind, then start: the base spans, and the field's where no base span lies."""
    base = base_spans(text)
    found = [(k, s, e, True) for k, s, e in base]
    taken = sorted((s, e) for _, s, e in base)
    free = iter(taken)
    low = next(free, None)
    for a, b in regions(text):
        while low is not None and low[1] <= a:
            low = next(free, None)
        added = decode(Region(text, a, b), weights)
        if added:
            near = [x for x in taken if x[0] < b and x[1] > a]
            found += [(k, s, e, False) for k, s, e in added if all(e <= x or s >= y for x, y in near)]
    return sorted(found)


def evasive(text: str, kind: int) -> list[str]:
    """Other ways to write a span of a kind."""
    if kind == 0:
        local, _, host = text.partition("@")
        return [f"{local} [at] {host}", f"{local} [at] {host.replace('.', ' [dot] ')}", f"{local} (at) {host.replace('.', ' (dot) ')}", f"{local}[at]{host}"]
    if kind == 1:
        return [text.replace(".", "[.]"), text.replace(".", "(.)")]
    if kind == 3:
        plain = re.sub(r"^\+[0-9]+ ", "", text)
        return [plain] if plain.startswith("(") else []
    return []


def training_examples(texts: list[str]) -> list[tuple[Region, dict[tuple[int, int], int]]]:
    """Regions of the sample with their base spans, their evasive twins, and regions without any span."""

    def labelled(text: str, start: int, end: int, spans: list[tuple[int, int, int]]) -> tuple[Region, dict[tuple[int, int], int]]:
        region = Region(text, start, end)
        at = {b: i for i, b in enumerate(region.bounds)}
        return region, {(at[s], at[e]): k for k, s, e in spans if s in at and e in at}

    positive, negative, per_kind = [], [], dict.fromkeys(range(len(KINDS)), 0)
    for text in texts:
        spans = base_spans(text)
        for a, b in regions(text):
            inside = [x for x in spans if x[1] >= a and x[2] <= b]
            if not inside:
                if len(negative) < SAMPLE_REGIONS:
                    negative.append(labelled(text, a, b, []))
                continue
            wanted = [x for x in inside if per_kind[x[0]] < SAMPLE_REGIONS // len(KINDS)]
            if not wanted or b - a > 20 * MAX_CHARS:
                continue
            positive.append(labelled(text, a, b, inside))
            for k, s, e in wanted:
                per_kind[k] += 1
                for other in evasive(text[s:e], k):
                    grown = len(other) - (e - s)
                    piece = text[a:s] + other + text[e:b]
                    # The spans behind the rewritten one move with it.
                    moved = [(j, p - a + grown * (p >= e), q - a + grown * (q >= e)) for j, p, q in inside]
                    positive.append(labelled(piece, 0, len(piece), moved))
    return positive + negative


def fit(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> dict[str, list[float]]:
    """Weights of the field from a bounded sample: the SAMPLE_DOCS first ids, by hash, whose text has digits or an at-sign."""
    likely = docs.where(F.col(text).rlike("[0-9]|@") & F.col(doc_id).isNotNull())
    first = likely.select(doc_id).distinct().orderBy(F.xxhash64(doc_id), doc_id).limit(SAMPLE_DOCS)
    # Of rows that repeat an id the least text, so that the bound holds for rows as well.
    rows = likely.where(F.octet_length(text) <= 1 << 16).join(F.broadcast(first), doc_id).groupBy(doc_id).agg(F.min(text)).collect()
    return fit_weights(training_examples([r[1] for r in sorted(rows, key=lambda r: (r[0], r[1] or "")) if r[1]]))


def span_column(text: Column, weights: dict[str, list[float]]) -> Column:
    """array<struct<kind, start, end, base>> over code points, end exclusive, by kind as listed, then start."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))

    @F.arrow_udf("array<struct<kind:string,start:bigint,end:bigint,base:boolean>>")
    def spans(column: pa.Array) -> pa.Array:
        rows = [
            [{"kind": KINDS[k], "start": s, "end": e, "base": b} for k, s, e, b in all_spans(t or "", weights)] for t in column.to_pylist()
        ]
        return pa.array(rows, kind)

    return spans.asNondeterministic()(text)


def find_personal_data(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Every input row with pii, the spans of its whole text.

    Null and empty texts have none; equal rows get equal spans; with no document
    to learn from only the base spans are found. A column named pii is replaced,
    all others pass through.
    """
    weights = fit(docs, text, doc_id)
    rest = [F.col(f"`{c}`") for c in docs.columns if c.lower() != "pii"]
    return docs.select(*rest, span_column(F.col(text), weights).alias("pii"))


def digest_columns(spans: Column) -> dict[str, Column]:
    """Counts of the base spans by kind, their digest, and all spans as text."""

    def joined(of: Column) -> Column:
        return F.concat_ws(",", F.transform(of, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))))

    base = F.filter(spans, lambda x: x["base"])

    def counted(kind: str) -> Column:
        return F.size(F.filter(base, lambda x: x["kind"] == kind)).cast("long")

    counts = {f"n_{kind}": counted(kind) for kind in KINDS}
    return counts | {"base_sha256": F.sha2(joined(base).cast("binary"), 256), "spans": joined(spans)}
