"""Operator 5, personal data by patterns and a semi-Markov conditional random field.

Patterns give the base spans. The field scores whole candidate segments: features of a span (its digit groups, checksum,
separators, brackets, sign, domain, what stands before and after it) are weighted by type, types that follow each other
are weighted too, and a dynamic program over tokens, with segments of bounded length, chooses boundaries and types
jointly. Weights are trained by maximum likelihood on the texts of a bounded sample, each as it is, by its base spans,
and with these disguised: signs dropped, other separators and groups, one label as domain. So the field learns what no
pattern matches; what it finds beside the base spans is added, and base spans stay.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import cut, portions, table, tidy

#: In the order in which spans of one start are listed.
KINDS = ("email", "ip", "card", "phone")
#: Bound of the training sample: documents with a digit or an at sign, those of the least hash of doc_id.
TRAIN_DOCS = 800
#: Tokens in the longest segment.
LONGEST = 24
STEPS, RATE, PENALTY = 60, 0.5, 1e-3
#: How often each training text is shown with its entities disguised.
VARIANTS = 2
#: A segment is added only if its probability under the field is so high. On entities disguised in texts that were held
#: out (half of those at sf0.1), all were found at 0.5 and none beside them; at 0.9 eight in a hundred were missed.
SURE = 0.5

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_HAS = re.compile(r"[0-9@]")
_TOKEN = re.compile(r"[0-9]+|[A-Za-z]+|.", re.S)
_WORD = re.compile(r"\S+")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        v = int(d) * (1 + k % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def _emails(text: str):
    """Leftmost matches of local@domain, found from the at signs, so that long runs cost no second look."""
    end, at = 0, text.find("@")
    while at >= 0:
        found = _DOMAIN.match(text, at + 1) if at >= end else None
        if found:
            start = at
            while start > end and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                yield start, found.end()
                end = found.end()
        at = text.find("@", at + 1)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the pattern matches that pass their checks, by start, then kind."""
    if not _HAS.search(text):
        return []
    out = [(a, b, 0) for a, b in _emails(text)]
    for m in _IP.finditer(text):
        parts = (p.lstrip("0") for p in m[0].split("."))
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in parts):
            out.append((*m.span(), 1))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((*m.span(), 2))
    for m in _PHONE.finditer(text):
        if 9 <= sum(map(str.isdigit, m[0])) <= 15:
            out.append((*m.span(), 3))
    return [(a, b, KINDS[k]) for a, b, k in sorted(out, key=lambda s: (s[0], s[2]))]


def zones(text: str):
    """(start, end) of runs of neighbouring words that hold a digit or an at sign, where all segments lie."""
    start = end = None
    for m in _WORD.finditer(text):
        if not _HAS.search(m[0]):
            continue
        if start is not None and m.start() == end + 1:
            end = m.end()
            continue
        if start is not None:
            yield start, end
        start, end = m.span()
    if start is not None:
        yield start, end


def _shape(segment: str, before: str, after: str, word: str) -> list[str]:
    """Features of a whole span."""
    groups = re.findall(r"[0-9]+", segment)
    digits = "".join(groups)
    marks = "".join(sorted(set(re.sub(r"[0-9A-Za-z]+", "", segment))))
    out = ["bias", f"marks={marks}", f"digits={len(digits) if len(digits) < 20 else 20}", f"before={_kind(before)}", f"after={_kind(after)}", f"open={segment[0] if not segment[0].isalnum() else _kind(segment[0])}"]
    if word.isalpha():
        out.append(f"word={word[-12:].lower()}")
    if "@" in segment:
        local, _, domain = segment.partition("@")
        labels = domain.split(".")
        out += [f"labels={min(len(labels), 4)}", f"top={'alpha' if labels[-1].isalpha() else 'other'}", f"local={'some' if local else 'none'}", f"gaps={'..' in segment or segment.endswith('.')}"]
    else:
        out += [f"groups={'-'.join(str(min(len(g), 9)) for g in groups[:7])}", f"letters={any(c.isalpha() for c in segment)}"]
        if 12 <= len(digits) <= 19:
            out.append(f"luhn={luhn(digits)}")
        if len(groups) == 4:
            out.append(f"octets={all(len(g) <= 3 and int(g) <= 255 for g in groups)}")
    return out


def _kind(c: str) -> str:
    return "edge" if not c else "space" if c.isspace() else "digit" if c.isdigit() else "letter" if c.isalpha() else c


def candidates(text: str, lo: int, hi: int) -> tuple[list[int], list[tuple[int, int, list[str]]]]:
    """Token starts of a zone (and its end), and the segments (token, token after, features) that may be entities."""
    at = [lo + m.start() for m in _TOKEN.finditer(text[lo:hi])] + [hi]
    near = max(0, lo - 40)
    gap = max(text.rfind(" ", near, max(near, lo - 1)), text.rfind("\n", near, max(near, lo - 1)))
    word = text[max(gap + 1, near) : lo].strip()
    out = []
    for i in range(len(at) - 1):
        first = text[at[i]]
        if not (first.isalnum() or first in "+("):
            continue
        signs = digits = 0
        for j in range(i + 1, min(len(at) - 1, i + LONGEST) + 1):
            token = text[at[j - 1] : at[j]]
            c = token[0]
            if c == "@":
                signs += 1
            elif c in "0123456789":
                digits += len(token)
            elif not (c.isascii() and c.isalpha() or c in "._%+- ()/"):
                break
            if signs > 1 or digits > 24:
                break
            if token[-1].isascii() and token[-1].isalnum():
                segment = text[at[i] : at[j]]
                mail = signs == 1 and " " not in segment
                if mail or digits >= 4 and not signs and not any(x.isalpha() for x in segment):
                    out.append((i, j, _shape(segment, text[at[i] - 1] if at[i] else "", text[at[j]] if at[j] < len(text) else "", word)))
    return at, out


class Field:
    """Weights of (kind, feature) and of kinds that follow each other."""

    def __init__(self, weights: dict[tuple, float]):
        self.weights = weights

    def arcs(self, n: int, segments: list[tuple[int, int, list[str]]]) -> list[list[tuple[int, int, float]]]:
        """For each token end the (start, label, score) of segments that end there; label 0 is a token outside."""
        into: list[list] = [[] for _ in range(n + 1)]
        for j in range(1, n + 1):
            into[j].append((j - 1, 0, 0.0))
        get = self.weights.get
        for i, j, found in segments:
            for k, kind in enumerate(KINDS, 1):
                into[j].append((i, k, sum(get((kind, f), 0.0) for f in found)))
        return into

    def step(self) -> list[list[float]]:
        names = ("out", *KINDS)
        return [[self.weights.get((a, b), 0.0) for b in names] for a in names]

    def sums(self, n: int, into) -> tuple[float, dict[tuple[int, int, int], float], np.ndarray]:
        """Log partition function, probabilities of the segments, expected numbers of label pairs."""
        step, size = self.step(), len(KINDS) + 1
        low = -1e30
        ahead = [[low] * size for _ in range(n + 1)]
        ahead[0][0] = 0.0
        for j in range(1, n + 1):
            terms: list[list[float]] = [[] for _ in range(size)]
            for i, k, score in into[j]:
                terms[k] += [ahead[i][p] + step[p][k] + score for p in range(size) if ahead[i][p] > low]
            ahead[j] = [_lse(t) if t else low for t in terms]
        total = _lse([v for v in ahead[n] if v > low])
        behind = [[low] * size for _ in range(n + 1)]
        behind[n] = [0.0] * size
        chances, pairs = {}, np.zeros((size, size))
        waiting: list[list[list[float]]] = [[[] for _ in range(size)] for _ in range(n + 1)]
        for j in range(n, 0, -1):
            if j < n:
                behind[j] = [_lse(t) if t else low for t in waiting[j]]
            for i, k, score in into[j]:
                if behind[j][k] <= low:
                    continue
                chance = 0.0
                for p in range(size):
                    if ahead[i][p] > low:
                        own = math.exp(min(0.0, ahead[i][p] + step[p][k] + score + behind[j][k] - total))
                        chance += own
                        pairs[p, k] += own
                    waiting[i][p].append(step[p][k] + score + behind[j][k])
                chances[i, j, k] = chance
        return total, chances, pairs

    def best(self, n: int, into) -> list[tuple[int, int, int]]:
        """The best segmentation's entities (start, end, label)."""
        step, size = self.step(), len(KINDS) + 1
        top = [[-math.inf] * size for _ in range(n + 1)]
        back: list[list] = [[None] * size for _ in range(n + 1)]
        top[0][0] = 0.0
        for j in range(1, n + 1):
            for i, k, score in into[j]:
                for p in range(size):
                    v = top[i][p] + step[p][k] + score
                    if v > top[j][k]:
                        top[j][k], back[j][k] = v, (i, p)
        out, j, k = [], n, max(range(size), key=lambda q: top[n][q])
        while j:
            i, p = back[j][k]
            if k:
                out.append((i, j, k))
            j, k = i, p
        return out[::-1]


def _lse(values: list[float]) -> float:
    top = max(values)
    return top + math.log(sum(math.exp(v - top) for v in values))


class Lattices:
    """Many zones' segments as arrays, over which all forward and backward sums run side by side, token by token."""

    def __init__(self, examples: list[tuple[int, list[tuple[int, int, list[str]]], list[tuple[int, int, int]]]]):
        self.features: dict[str, int] = {}
        sizes = np.array([n for n, _, _ in examples], np.int64)
        self.first = np.concatenate([[0], np.cumsum(sizes + 1)])[:-1]  # node of each zone's first token
        self.last = self.first + sizes
        self.nodes, self.longest = int((sizes + 1).sum()), int(sizes.max(initial=0))
        rows, counts, flat, gold = [], [], [], []
        self.pairs = np.zeros((len(KINDS) + 1, len(KINDS) + 1))
        for b, (n, segments, known) in enumerate(examples):
            marked = {(i, j): k for i, j, k in known}
            for i, j, found in segments:
                rows.append((b, i, j))
                counts.append(len(found))
                flat += [self.features.setdefault(f, len(self.features)) for f in found]
                gold.append(marked.get((i, j), 0))
            path, at = [0], 0
            for i, j, k in known:
                path += [0] * (i - at) + [k]
                at = j
            path += [0] * (n - at)
            np.add.at(self.pairs, (path[:-1], path[1:]), 1)
        self.rows = np.array(rows, np.int64).reshape(-1, 3)
        self.zone = self.rows[:, 0]
        self.source, self.target = self.first[self.zone] + self.rows[:, 1], self.first[self.zone] + self.rows[:, 2]
        self.flat, self.starts = np.array(flat, np.int64), np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
        self.owner = np.repeat(np.arange(len(rows)), counts)
        self.gold = np.zeros((len(rows), len(KINDS)))
        held = np.array(gold, np.int64)
        self.gold[np.flatnonzero(held), held[held > 0] - 1] = 1
        #: Segments that end, and those that start, at each token, by node; and the nodes there.
        self.ending, self.starting = self._groups(2, self.target), self._groups(1, self.source)
        self.at = [self.first[sizes >= t] + t for t in range(self.longest + 1)]

    def _groups(self, column: int, node: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        order = np.lexsort((node, self.rows[:, column]))
        cuts = np.searchsorted(self.rows[order, column], np.arange(self.longest + 2))
        out = []
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            own = order[lo:hi]
            nodes, begins = np.unique(node[own], return_index=True)
            out.append((own, nodes, begins))
        return out

    def scores(self, weights: np.ndarray) -> np.ndarray:
        """Score of each segment as each kind; weights: features by kinds."""
        out = np.zeros((len(self.rows), len(KINDS)))
        np.add.at(out, self.owner, weights[self.flat])
        return out

    def expected(self, weights: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Probability of each segment as each kind, and expected numbers of label pairs."""
        low = -1e30
        score = self.scores(weights)
        ahead, behind = np.full((self.nodes, len(step)), low), np.full((self.nodes, len(step)), low)
        ahead[self.first, 0], behind[self.last] = 0.0, 0.0
        lse = lambda x, axis: np.logaddexp.reduce(x, axis=axis)
        for t in range(1, self.longest + 1):
            v = self.at[t]
            ahead[v, 0] = lse(ahead[v - 1] + step[:, 0], 1)
            own, nodes, begins = self.ending[t]
            if len(own):
                came = lse(ahead[self.source[own]][:, :, None] + step[None, :, 1:], 1) + score[own]
                ahead[nodes, 1:] = np.logaddexp.reduceat(came, begins, axis=0)
        for t in range(self.longest - 1, -1, -1):
            v = self.at[t][self.at[t] < self.last[np.searchsorted(self.first, self.at[t], "right") - 1]]
            behind[v] = step[:, 0] + behind[v + 1, :1]
            own, nodes, begins = self.starting[t]
            if len(own):
                goes = lse(step[None, :, 1:] + (score[own] + behind[self.target[own], 1:])[:, None, :], 2)
                behind[nodes] = np.logaddexp(behind[nodes], np.logaddexp.reduceat(goes, begins, axis=0))
        total = lse(ahead[self.last], 1)
        each = np.exp(np.minimum(ahead[self.source][:, :, None] + step[None, :, 1:] + (score + behind[self.target, 1:] - total[self.zone][:, None])[:, None, :], 0))
        pairs = np.zeros_like(step)
        pairs[:, 1:] = each.sum(axis=0)
        inner = np.setdiff1d(np.arange(self.nodes), self.first)
        zone = np.searchsorted(self.first, inner, "right") - 1
        pairs[:, 0] = np.exp(np.minimum(ahead[inner - 1] + step[:, 0] + (behind[inner, 0] - total[zone])[:, None], 0)).sum(axis=0)
        return each.sum(axis=1), pairs


def train(examples: list[tuple[int, list[tuple[int, int, list[str]]], list[tuple[int, int, int]]]]) -> Field:
    """Maximum likelihood with an L2 penalty by AdaGrad; examples are (tokens, segments, gold entities) of zones."""
    names = ("out", *KINDS)
    if not examples:
        return Field({})
    held = Lattices(examples)
    weights, step = np.zeros((len(held.features), len(KINDS))), np.zeros((len(names), len(names)))
    seen_w, seen_s = np.full_like(weights, 1e-8), np.full_like(step, 1e-8)
    for _ in range(STEPS):
        chances, pairs = held.expected(weights, step)
        slope = np.zeros_like(weights)
        np.add.at(slope, held.flat, (held.gold - chances)[held.owner])
        for value, seen, g in ((weights, seen_w, slope), (step, seen_s, held.pairs - pairs)):
            g = g / len(examples) - PENALTY * value
            seen += g * g
            value += RATE * g / np.sqrt(seen)
    found = {(kind, f): float(weights[i, k]) for f, i in held.features.items() for k, kind in enumerate(KINDS)}
    return Field(found | {(a, b): float(step[p, k]) for p, a in enumerate(names) for k, b in enumerate(names)})


def variant(kind: str, segment: str, draw: int) -> str:
    """The same entity as people write it where no pattern has it: without the sign, with other separators or groups."""
    digits = re.sub(r"[^0-9]", "", segment)
    if kind == "phone":
        lead, rest = digits[:-7], digits[-7:]
        forms = (f"{lead[:-3]} ({lead[-3:]}) {rest[:3]}-{rest[3:]}", f"({lead[-3:]}) {rest[:3]}-{rest[3:]}", f"{lead}.{rest[:3]}.{rest[3:]}", f"{lead}-{rest[:3]}-{rest[3:]}", f"00{lead} {rest[:3]} {rest[3:]}", f"{lead} {rest[:3]} {rest[3:]}")
        return forms[draw % len(forms)].strip()
    if kind == "card":
        parts = [digits[i : i + 4] for i in range(0, len(digits), 4)]
        return (".", "/", "_")[draw % 3].join(parts)
    if kind == "ip":
        return ("-", "_", "/")[draw % 3].join(segment.split("."))
    local, _, domain = segment.partition("@")
    return (f"{local}@{domain.rsplit('.', 1)[0].replace('.', '-')}", f"{local}@{domain.replace('.', '_')}")[draw % 2]


def disguised(text: str, salt: int = 0) -> tuple[str, list[tuple[int, int, str]]]:
    """The text with its base spans (of overlapping ones the first) written as variants, and where these are."""
    parts, spans, at, size = [], [], 0, 0
    for a, b, kind in base_spans(text):
        if a < at:
            continue
        shown = variant(kind, text[a:b], zlib.crc32(f"{salt}:{a}:{text[a:b]}".encode()))
        parts += [text[at:a], shown]
        size += a - at
        spans.append((size, size + len(shown), kind))
        size += len(shown)
        at = b
    return "".join(parts) + text[at:], spans


def _gold(at: list[int], spans: list[tuple[int, int, str]]) -> list[tuple[int, int, int]]:
    """Base spans of a zone as token segments; of overlapping ones the earlier, then the longer."""
    place = {p: t for t, p in enumerate(at)}
    out, end = [], 0
    for a, b, kind in sorted(spans, key=lambda s: (s[0], -s[1])):
        if a in place and b in place and place[a] >= end and place[b] - place[a] <= LONGEST:
            out.append((place[a], place[b], KINDS.index(kind) + 1))
            end = place[b]
    return out


def blocks(at: list[int], segments: list[tuple[int, int, list[str]]]):
    """A zone in parts (token starts and end, segments) that are solved apart: each ends with a token in no segment.

    Such a token is outside in every segmentation, so what comes after it does not depend on what was before.
    """
    n, start, k = len(at) - 1, 0, 0
    reach = 0  # first token behind the segments so far
    for t in range(n):
        while k < len(segments) and segments[k][0] <= t:
            reach = max(reach, segments[k][1])
            k += 1
        if t >= reach:
            if k > first_of(segments, start):
                own = segments[first_of(segments, start) : k]
                yield at[start : t + 2], [(i - start, j - start, f) for i, j, f in own]
            start = t + 1
    own = segments[first_of(segments, start) :]
    if own:
        yield at[start:], [(i - start, j - start, f) for i, j, f in own]


def first_of(segments: list[tuple[int, int, list[str]]], token: int) -> int:
    """Number of the first segment, in order of their starts, that starts at a token or later."""
    return bisect_left(segments, token, key=lambda s: s[0])


def examples_of(text: str, spans: list[tuple[int, int, str]]):
    """Training examples (tokens, segments, gold entities) of a text and its entities, one for each block of its zones."""
    waiting, k = [], 0
    for lo, hi in zones(text):
        while k < len(spans) and spans[k][0] < hi:
            waiting.append(spans[k])
            k += 1
        waiting = [s for s in waiting if s[1] > lo]
        inside = [s for s in waiting if lo <= s[0] and s[1] <= hi]
        for at, segments in blocks(*candidates(text, lo, hi)):
            usable = {(i, j) for i, j, _ in segments}
            own = inside[bisect_left(inside, at[0], key=lambda s: s[0]) : bisect_left(inside, at[-1], key=lambda s: s[0])]
            yield len(at) - 1, segments, [g for g in _gold(at, own) if g[:2] in usable]


def lessons(text: str):
    """Examples of a text as it is, by its base spans, and of the text with these spans disguised."""
    yield from examples_of(text, base_spans(text))
    for salt in range(VARIANTS):
        yield from examples_of(*disguised(text, salt))


def fit(docs: DataFrame, rows: int = TRAIN_DOCS) -> Field:
    """The field, trained on the base spans of at most `rows` documents, plain and disguised; without any, one that adds
    nothing.

    Of several texts under one doc_id the least is learnt from; null doc_ids are not.
    """
    marked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(F.col("text").rlike("[0-9@]"))
    ids = marked.select("doc_id").where("doc_id IS NOT NULL").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    some = marked.join(F.broadcast(cut(ids)), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"))

    def run(batches):
        import pickle

        for batch in portions(batches):
            found = [pickle.dumps(list(lessons(t.as_py()))) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.binary())], ["doc_id", "found"])

    import pickle

    kept = some.mapInArrow(tidy(run), "doc_id long, found binary").orderBy("doc_id").collect()
    return train([e for r in kept for e in pickle.loads(r["found"])])


def added_spans(text: str, field: Field, base: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """What the field finds beside the base spans (by start), which are fixed: no other segment may overlap them."""
    out, waiting, k = [], [], 0
    for lo, hi in zones(text):
        while k < len(base) and base[k][0] < hi:
            waiting.append(base[k])
            k += 1
        waiting = [s for s in waiting if s[1] > lo]
        at, segments = candidates(text, lo, hi)
        # Base spans that begin before b, less those that end at or before a, overlap a to b.
        starts, ends = [s[0] for s in waiting], sorted(s[1] for s in waiting)
        free = [s for s in segments if bisect_left(starts, at[s[1]]) == bisect_right(ends, at[s[0]])]
        for own, some in blocks(at, free):
            n = len(own) - 1
            into = field.arcs(n, some)
            chosen = field.best(n, into)
            if chosen:
                chances = field.sums(n, into)[1]
                out += [(own[i], own[j], KINDS[k - 1]) for i, j, k in chosen if chances.get((i, j, k), 0) >= SURE]
    return out


def listed(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1])))


def find_personal_data(docs: DataFrame, field: Field) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, n_added, n_spans, spans (all) of every text.

    Offsets are code points, end exclusive. Null and empty texts have no spans; repeated rows and null doc_ids are
    rows like any other; doc_ids are cast to long; other columns are not read; an empty table gives an empty result.
    Texts are read whole, in time that grows with their length; no segment of the field has more than LONGEST tokens or
    digits, so longer runs of digits are left to the patterns.
    """
    sent = docs.sparkSession.sparkContext.broadcast(field)  # features of TRAIN_DOCS documents
    names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "n_added", "n_spans", "spans"]
    schema = StructType([StructField(n, StringType() if n in ("base_sha256", "spans") else LongType()) for n in names])

    def run(batches):
        for batch in portions(batches):
            rows = []
            for t in batch.column("text"):
                text = t.as_py() or ""
                base = base_spans(text)
                more = added_spans(text, sent.value, base) if _HAS.search(text) else []
                counts = [sum(k == kind for _, _, kind in base) for k in KINDS]
                rows.append((*counts, hashlib.sha256(listed(base).encode()).hexdigest(), len(more), len(base) + len(more), listed(base + more)))
            cols = list(zip(*rows, strict=True)) or [[]] * 8
            kinds = [*[pa.int64()] * 4, pa.string(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(tidy(run), schema)


def op5_semi_markov(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return find_personal_data(docs, fit(docs))
