"""Operator 9, SentencePiece encoding and decoding: n-best segmentations by A-star over the piece lattice.

The vocabulary is a public SentencePiece model file, whose merge ranks are read as Zipf log-probabilities of the
pieces. A forward Viterbi pass over the lattice of a span gives the best score of every prefix; that is the exact cost
still to come for a hypothesis that grows backward from the end, so A-star pops complete segmentations in order of
score. No piece reaches across a space mark that follows another character, so a text is a chain of spans between
such marks: of each distinct span the Viterbi pass alone gives the best segmentation and, from what is left behind
along its path, the score of the second best; and the n best of the chain follow from the few spans (n - 1 at most)
whose second choices cost least. Only in those the A-star search runs, over their whole lattice: in the other spans no
second choice is part of the n best.
"""

from __future__ import annotations

import gc
import heapq
import zlib
from functools import lru_cache
from itertools import chain, count, groupby, pairwise

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, IntegerType, LongType, StructField, StructType

from .common import portions, table, tidy

SPACE = "\u2581"
N_BEST = 4
#: Distinct spans that a worker remembers in each of two generations, and the longest of them.
SPANS_KEPT, SPAN_CHARS = 50_000, 64
#: Bytes of text whose spans are solved together: the more, the more spans of one length are searched side by side; and
#: those of which the results, some ten times as large, are made and handed over together.
PORTION, HANDED = 2 << 20, 1 << 18
#: Runs of letters and of other characters, with the marks before them; what joins the two.
RUNS = regex.compile(r"\u2581*[\p{L}\p{M}]+|\u2581*[^\p{L}\p{M}\u2581]+|\u2581+")
JOINED = regex.compile(r"[\p{L}\p{M}][^\p{L}\p{M}]|[^\p{L}\p{M}\u2581][\p{L}\p{M}]")
#: Spans up to so many characters are searched side by side, so many at once, over pieces of up to TABLE_CHARS.
TABLE_SPAN, SIDE_BY_SIDE, TABLE_CHARS = 24, 2048, 24
INF = float("inf")
NO_PIECE = 0, None
_FACTOR, _TOP = np.uint64(0x9E3779B97F4A7C15), np.uint64(48)


class _Kept:
    """What was found for short spans; the older half goes when both generations are full."""

    def __init__(self):
        self.new, self.old = {}, {}

    def get(self, span):
        return self.new.get(span) or self.old.get(span)

    def put_all(self, pairs) -> None:
        if len(self.new) >= SPANS_KEPT:
            self.new, self.old = {}, self.new
        self.new.update(pairs)


def _prefixes(spans: list[str]) -> np.ndarray:
    """For spans of one length a column each with the hashes of their beginnings, the empty one first."""
    size = len(spans[0])
    codes = np.frombuffer("".join(spans).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(spans), size).T.astype(np.uint64, order="C")
    out = np.zeros((size + 1, len(spans)), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(size):
            out[j + 1] = out[j] * _FACTOR + (codes[j] + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
    return out


def _packed(ids) -> bytes:
    return np.array(ids, "<u4").tobytes()


class Pieces:
    """Pieces of a model file with additive scores: -log(rank + 2) - log(ln size), Zipf's law over merge ranks.

    Characters that no piece covers fall to byte pieces, which score as the last rank for each byte. Ids are packed as
    little-endian 32-bit integers.
    """

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        names: dict[str, tuple[float, bytes]] = {}
        self.bytes, self.shown = {}, []
        for i in range(size):
            name = model.id_to_piece(i)
            if model.is_byte(i):
                b = int(name[3:5], 16)
                self.bytes[b] = _packed([i])
                self.shown.append(bytes([b]).decode("utf-8", "surrogateescape"))
                continue
            self.shown.append(name.replace(SPACE, " "))
            if not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                rank = -model.get_score(i) if model.get_score(i) > -1e8 else size
                names[name] = -float(np.log(rank + 2) + np.log(np.log(size))), _packed([i])
        self.by_byte = -float(np.log(size + 2) + np.log(np.log(size)))
        #: Pieces with (score, id); and by character the length of the longest piece that begins, and that ends, with it,
        #: and the piece that is this character alone, or None. Tries of dictionaries would take 25 MB more of each worker.
        self.names, self.ahead, self.back = names, {}, {}
        for name in names:
            for lengths, c in ((self.ahead, name[0]), (self.back, name[-1])):
                lengths[c] = max(lengths.get(c, (0,))[0], len(name)), names.get(c)
        self.apart = not any(JOINED.search(name) for name in names)
        #: For each length the hashes of the pieces, sorted, with their scores and ids; and which leading bits there are.
        self.tables = {}
        for k in range(1, min(TABLE_CHARS, max(map(len, names))) + 1):
            some = [name for name in names if len(name) == k]
            if not some:
                continue
            hashes = _prefixes(some)[-1]
            order = np.argsort(hashes)
            hashes = hashes[order]
            if (hashes[1:] == hashes[:-1]).any():
                raise ValueError("pieces of one hash")
            held = np.zeros(1 << 16, bool)
            held[hashes >> _TOP] = True
            self.tables[k] = hashes, np.array([names[x][0] for x in some])[order], np.frombuffer(b"".join([names[x][1] for x in some]), "<u4").astype(np.int64)[order], held
        self.forget()
        gc.freeze()  # the vocabulary stays: collections need not look at it

    def forget(self) -> None:
        self.kept, self.more = _Kept(), _Kept()

    def forward(self, span: str) -> tuple[list[float], list[int]]:
        """Viterbi: the best score of every prefix, and where the last piece of it begins."""
        size, get, reach = len(span), self.names.get, self.ahead.get
        best, last = [-INF] * (size + 1), [0] * (size + 1)
        best[0] = 0.0
        for i, top in enumerate(best):
            if i == size:
                return best, last
            longest, single = reach(span[i], NO_PIECE)
            for j in range(i + 1, min(size, i + longest) + 1):
                found = get(span[i:j])
                if found:
                    score = top + found[0]
                    if score > best[j]:
                        best[j], last[j] = score, i
            if not single:
                score = top + self.by_byte * len(span[i].encode("utf-8", "replace"))
                if score > best[i + 1]:
                    best[i + 1], last[i + 1] = score, i

    def arcs(self, span: str, at: int) -> list[tuple[int, float, bytes]]:
        """The pieces (start, score, ids) that end at a position of a span, the shortest first."""
        get, out = self.names.get, []
        for i in range(at - 1, max(0, at - self.back.get(span[at - 1], NO_PIECE)[0]) - 1, -1):
            found = get(span[i:at])
            if found:
                out.append((i, *found))
        if not out or out[0][0] != at - 1:
            raw = span[at - 1].encode("utf-8", "replace")
            out.insert(0, (at - 1, self.by_byte * len(raw), b"".join(self.bytes[b] for b in raw)))
        return out

    def n_best(self, span: str, n: int) -> list[tuple[float, bytes]]:
        """The n best segmentations (score, ids) of a span, best first.

        Among equal hypotheses the one that has come furthest goes first; as n hypotheses through a position are enough
        for the n best, later ones are left.
        """
        best, _ = self.forward(span)
        order, out, popped = count(), [], [0] * len(best)
        heap = [(-best[-1], len(span), next(order), 0.0, None)]
        while heap and len(out) < n:
            _, at, _, done, tail = heapq.heappop(heap)
            if popped[at] >= n:
                continue
            popped[at] += 1
            if not at:
                ids = []
                while tail:
                    ids.append(tail[0])
                    tail = tail[1]
                out.append((done, b"".join(ids)))
                continue
            for i, score, ids in self.arcs(span, at):
                heapq.heappush(heap, (-(best[i] + done + score), i, next(order), done + score, (ids, tail)))
        return out

    def first(self, span: str) -> tuple[float, float, bytes]:
        """Best score, how much less the second best has, and the best ids: A-star up to its first pop.

        Until then the hypothesis with the best bound is the one that follows the Viterbi pass's pieces back. The
        others are left on the open list, whose bounds are exact, so its top is the second best's score.
        """
        best, last = self.forward(span)
        at, done, top, ids = len(span), 0.0, -INF, []
        while at:
            for i, score, piece in self.arcs(span, at):
                if i == last[at]:
                    chosen = score, piece
                elif best[i] + score + done > top:
                    top = best[i] + score + done
            done += chosen[0]
            ids.append(chosen[1])
            at = last[at]
        return best[-1], best[-1] - top, b"".join(reversed(ids))

    def first_of_many(self, spans: list[str]) -> list[tuple[float, float, bytes] | None]:
        """`first` of spans of one length, side by side: pass and search run over all of them at once.

        None where a character is no piece or the vocabulary has longer pieces; those are left to `first`.
        """
        size, many = len(spans[0]), len(spans)
        longest = min(size, max(self.tables))
        codes = _prefixes(spans)
        # By length and end of a piece, spans side by side in memory; most parts of spans are no pieces.
        score, ids, ends = np.full((longest + 1, size + 1, many), -INF), np.zeros((longest + 1, size + 1, many), np.int32), {}
        for k in range(1, longest + 1):
            if k not in self.tables:
                continue
            hashes, scores, numbers, held = self.tables[k]
            with np.errstate(over="ignore"):
                part = (codes[k:] - codes[:-k] * _FACTOR**k).ravel()
            maybe = np.flatnonzero(held[part >> _TOP])
            some = part[maybe]
            at = np.minimum(np.searchsorted(hashes, some), len(hashes) - 1)
            hit = hashes[at] == some
            at, maybe = at[hit], maybe[hit]
            score[k, k:].reshape(-1)[maybe] = scores[at]
            ids[k, k:].reshape(-1)[maybe] = numbers[at]
            for j in np.unique(maybe // many).tolist():
                ends.setdefault(j + k, []).append(k)
        whole = (score[1, 1:] > -INF).all(axis=0)
        best, last, behind = np.zeros((size + 1, many)), np.zeros((size + 1, many), np.int64), np.full((size + 1, many), INF)
        for j in range(1, size + 1):
            top, second, chosen = np.full(many, -INF), np.full(many, -INF), np.zeros(many, np.int64)
            for k in reversed(ends.get(j, [])):  # the longest of equals, as in `forward`
                found = best[j - k] + score[k, j]
                better = found > top
                np.maximum(second, np.minimum(top, found), out=second)
                chosen[better] = k
                np.maximum(top, found, out=top)
            with np.errstate(invalid="ignore"):  # where nothing ends
                best[j], last[j], behind[j] = top, chosen, top - second
        # Back along the best path: what comes after a node costs all hypotheses through it the same, so the best one
        # that is left behind there is as far from the best of all as its piece is from the one chosen.
        row = np.arange(many)
        at, gap, path = np.where(whole, size, 0), np.full(many, INF), []
        while at.any():
            chosen = last[at, row]
            np.minimum(gap, np.where(at > 0, behind[at, row], INF), out=gap)
            path.append(np.where(at > 0, ids[chosen, at, row], -1))
            at = at - chosen
        order = np.array(path[::-1]).T.astype("<i4") if path else np.empty((many, 0), "<i4")
        counts = (order >= 0).sum(axis=1).tolist()
        order = order.tobytes()
        width = 4 * len(path)
        each = zip(whole.tolist(), best[-1].tolist(), gap.tolist(), counts, strict=True)
        return [(b, g, order[(r + 1) * width - 4 * c : (r + 1) * width]) if ok else None for r, (ok, b, g, c) in enumerate(each)]

    def _runs(self, span: str) -> list[str]:
        if not self.apart or span[0] == SPACE and span[1:].isalpha():
            return [span]
        if span[-1] in ",.;:!?" and span[0] == SPACE and span[1:-1].isalpha():
            return [span[:-1], span[-1]]
        return RUNS.findall(span)

    def solved(self, spans) -> dict[str, tuple[float, float, bytes]]:
        """`first` of each of some spans (and of their runs), remembered.

        Where no piece joins letters to other characters, runs of either are searched apart. New runs of one length are
        searched side by side.
        """
        new, old, out, fresh = self.kept.new, self.kept.old, {}, []
        for span in spans:
            if span in new:
                out[span] = new[span]
            elif span in old:
                out[span] = old[span]
            else:
                fresh.append(span)
        alone = [s for s in fresh if s[1:].isalpha() and s[0] == SPACE] if self.apart else fresh
        queued = set(alone)
        parted = {s: self._runs(s) for s in fresh if s not in queued}
        for r in chain.from_iterable(parted.values()):
            if r not in queued and r not in out:
                got = new.get(r) or old.get(r)
                if got:
                    out[r] = got
                else:
                    queued.add(r)
        for size, some in groupby(sorted(queued, key=len), len):
            some = list(some)
            for k in range(0, len(some), SIDE_BY_SIDE):
                part = some[k : k + SIDE_BY_SIDE]
                found = self.first_of_many(part) if size <= TABLE_SPAN else [None] * len(part)
                found = [x or self.first(r) for r, x in zip(part, found, strict=True)] if None in found else found
                out.update(zip(part, found, strict=True))
                if size <= SPAN_CHARS:
                    self.kept.put_all(zip(part, found, strict=True))
        for span, runs in parted.items():
            each = [out[r] for r in runs]
            if len(each) > 1:
                out[span] = sum(x[0] for x in each), min(x[1] for x in each), b"".join([x[2] for x in each])
        self.kept.put_all((s, out[s]) for s in parted if len(s) <= SPAN_CHARS)
        return out

    def choices(self, span: str, n: int) -> list[tuple[float, bytes]]:
        """`n_best`, remembered."""
        got = self.more.get((span, n))
        if got is None:
            got = self.n_best(span, n)
            if len(span) <= SPAN_CHARS:
                self.more.put_all([((span, n), got)])
        return got

    def decode(self, ids) -> str:
        """The text of ids: byte pieces are joined to characters, marks are spaces, the first of which was added."""
        return self.joined(ids)[1:]

    def joined(self, ids) -> str:
        """The text of ids with its first mark."""
        ids = np.frombuffer(ids, "<u4").tolist() if isinstance(ids, bytes) else ids
        shown = "".join(map(self.shown.__getitem__, ids))
        return shown if shown.isascii() else shown.encode("utf-8", "surrogateescape").decode("utf-8", "replace")


def spans(text: str) -> list[str]:
    """The text with spaces as marks and one mark before it, cut before every mark that follows another character."""
    parts = text.split(" ")
    if "" not in parts:
        return [SPACE + p for p in parts]
    out, marks = [], SPACE
    for k, p in enumerate(parts):
        if k and not p or not k and not p and len(parts) > 1:
            marks += SPACE  # a run of spaces stays together
            continue
        out.append(marks + p)
        marks = SPACE
    if len(marks) > 1:
        out.append(marks[1:])
    return out


def _chain(known: Pieces, solved: dict, parts: list[str], n: int) -> tuple[list[tuple[float, bytes]], list[tuple[bytes, list[bytes]]]]:
    """The n best segmentations of a chain of spans, best first; and, for each span replaced in them, what by what.

    One among the n best departs from the best in n - 1 spans at most, each of them among the n - 1 whose second
    choice costs least; so only the choices of those are combined.
    """
    found = [solved[p] for p in parts]
    best, gaps, runs = zip(*found, strict=True)
    base = sum(best)
    places: list[int] = []
    for g in sorted(gaps)[: n - 1]:
        if g < INF:
            places.append(gaps.index(g, places[-1] + 1 if places and gaps[places[-1]] == g else 0))
    places.sort()
    # The search may pop another of several best ones first, so the one that stands in the best of all goes by its ids.
    options = {p: known.choices(parts[p], n) for p in places}
    others = {p: [(options[p][0][0] - score, ids) for score, ids in options[p] if ids != runs[p]] for p in places}
    ways: list[tuple[float, dict[int, bytes]]] = [(0.0, {})]
    for p in places:
        more = [(cost + less, {**way, p: ids}) for cost, way in ways for less, ids in others[p]]
        ways = heapq.nsmallest(n, ways + more, key=lambda w: w[0])
    # Between the places all ways are the same.
    edges = [-1, *places, len(parts)]
    fixed = [b"".join(runs[a + 1 : b]) for a, b in pairwise(edges)]
    out = []
    for cost, way in ways:
        own = [way.get(p, runs[p]) for p in places]
        out.append((base - cost, b"".join(chain.from_iterable((*x,) for x in zip(fixed, [*own, b""], strict=True)))))
    return out, [(runs[p], [ids for _, ids in others[p]]) for p in places]


@lru_cache(2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def segmentations(text: str | None, path: str, n: int = N_BEST) -> list[tuple[float, bytes]]:
    """The n best (score, packed ids) of a whole text, best first; one empty segmentation of null and empty texts."""
    known = pieces(path)
    return next(_checked(known, _solved(known, [text]), [text], n))[0]


def _solved(known: Pieces, texts: list[str | None]) -> dict[str, tuple[float, float, bytes]]:
    """`first` of each span of some texts."""
    return known.solved(set(chain.from_iterable(spans(t) for t in texts if t)))


def _checked(known: Pieces, solved: dict, texts: list[str | None], n: int):
    """For each text its segmentations, and whether all decode to it: the best as a whole, others where they differ."""
    for text in texts:
        if not text:
            yield [(0.0, b"")], True
            continue
        found, replaced = _chain(known, solved, spans(text), n)
        yield found, known.decode(found[0][1]) == text and all(known.joined(ids) == shown for own, others in replaced for shown in [known.joined(own)] for ids in others)


def _lists(values, lengths) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32()), values)


def _numbers(parts: list[bytes]) -> pa.ListArray:
    return _lists(pa.array(np.frombuffer(b"".join(parts), "<i4"), pa.int32()), [len(x) // 4 for x in parts])


def encoded(batches, path: str, names: list[str], n: int, ids: bool):
    """Arrow batches with the columns of encode_documents, in order, in batches of about HANDED bytes of text."""
    known = pieces(path)
    gc.disable()  # many objects and no cycles
    try:
        for portion in portions(batches, most=PORTION):
            solved = _solved(known, portion.column("text").to_pylist())
            for batch in portions([portion], most=HANDED):
                each, good = zip(*_checked(known, solved, batch.column("text").to_pylist(), n), strict=True)
                counts = [len(f) for f in each]
                flat = [s for f in each for s in f]
                scores, crcs = pa.array([s for s, _ in flat], pa.float64()), pa.array([zlib.crc32(x) for _, x in flat], pa.int64())
                columns = [
                    pa.array([len(f[0][1]) // 4 for f in each], pa.int64()), pa.array([f[0][0] for f in each], pa.float64()), pa.array(counts, pa.int64()), pa.array([f[0][0] - f[1][0] if len(f) > 1 else None for f in each], pa.float64()),
                    pa.array([zlib.crc32(f[0][1]) for f in each], pa.int64()), pa.array(good, pa.bool_()), _lists(pa.StructArray.from_arrays([scores, crcs], ["score", "ids_crc32"]), counts),
                ]
                if ids:
                    columns += [_numbers([f[0][1] for f in each]), _lists(_numbers([x for _, x in flat]), counts)]
                yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names)
            del solved
    finally:
        gc.enable()
        known.forget()  # the worker may go on to other work


def encode_documents(docs: DataFrame, path: str, n: int = N_BEST, ids: bool = True) -> DataFrame:
    """docs with n_pieces, best_score, n_found, gap (best score less second; null if alone), ids_crc32 and decoded_ok.

    nbest has the score and crc of every segmentation found, best first. ids adds piece_ids, the best segmentation, and
    nbest_ids, all of them. ids_crc32: unsigned, of the best ids as little-endian 32-bit integers. decoded_ok: every
    segmentation decodes to the text.

    Null and empty texts have one empty segmentation, without a gap. Segmentations of equal score stand in the order of
    the search, which is the same each time. Repeated rows get equal results and null doc_ids are no exception. Columns
    of these names are replaced, others pass through. An empty table gives an empty result.
    """
    own = [("n_pieces", LongType()), ("best_score", DoubleType()), ("n_found", LongType()), ("gap", DoubleType()), ("ids_crc32", LongType()), ("decoded_ok", BooleanType()), ("nbest", ArrayType(StructType([StructField("score", DoubleType()), StructField("ids_crc32", LongType())]))), *([("piece_ids", ArrayType(IntegerType())), ("nbest_ids", ArrayType(ArrayType(IntegerType())))] if ids else [])]
    docs = docs.drop(*(name for name, _ in own)).withColumn("text", docs["text"].cast("string"))
    schema = StructType([*docs.schema.fields, *(StructField(name, kind) for name, kind in own)])

    return docs.mapInArrow(tidy(lambda batches: encoded(batches, path, schema.names, n, ids)), schema)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op9_nbest(spark, sf_dir: str) -> DataFrame:
    out = encode_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), default_model(), ids=False)
    return out.drop("text")
