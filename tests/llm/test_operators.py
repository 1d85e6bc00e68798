"""Training-data operators against brute force, on small fixtures with nulls, empty and long texts, ties and repeats."""

import hashlib
import itertools
import re
import time
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from ambulo.llm import fingerprints, linededup, media, mixing, neardup, pii, sentencepieces, sharding, tokenfiles, toxicity

BASE = "the cat sat on the mat and looked at the dog who slept near the fire all day long until night fell"
LONG = " ".join(f"word{i}" for i in range(3000))
ROWS = [
    (0, BASE, "a"), (1, BASE, "a"), (2, BASE + " again", "b"), (3, BASE.upper(), None), (4, "", "a"), (5, None, "b"), (6, LONG, "a"), (7, LONG + " end", "a"),
    (8, "one", "c"), (9, "one", "c"), (10, "x y z", None), (11, "é ü 你好 𐍈 mixed. Text here! And more? Yes.", "b"), (12, "l1\nl2\nl3\nl4\nl5", "b"), (13, "l0\nl1\nl2\nl3\nl9", "a"),
    (14, "l1\nl2\nl3\nl1\nl2\nl3", "a"), (15, "  spaced  out \n text ", "c"), (16, "mail bob.42@mail1.example.com or +1 (269) 555-3296 4524132264652876 now", "a"), (20, BASE.replace("dog", "fox"), "b"),
]


@pytest.fixture(scope="module")
def docs(spark):
    # A clashing column, which operators replace or ignore.
    return spark.createDataFrame([(i, t, s, 9) for i, t, s in ROWS], "doc_id long, text string, source string, size int")


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def rows(df):
    return [r.asDict() for r in df.collect()]


def test_shards_are_even_and_gapless(spark, docs, empty):
    out = rows(sharding.shard_documents(docs, 4, piece_bytes=5000, tolerance=0.05))
    assert len(out) == len(ROWS) and {"size", "shard", "slot"} <= set(out[0])
    total, biggest = sum(r["size"] for r in out), max(r["size"] for r in out)
    by = defaultdict(list)
    for r in out:
        by[r["shard"]].append(r)
    for own in by.values():
        assert sorted(r["slot"] for r in own) == list(range(len(own)))
        assert abs(sum(r["size"] for r in own) - total / 4) <= biggest + 0.1 * total / 4
    where = {r["doc_id"]: r["shard"] for r in out}
    assert where[0] == where[1]
    assert rows(sharding.shard_documents(empty, 4)) == []


def test_splitters_match_the_sorted_order(spark):
    data = [(i * 7919 % 1000, i % 3, 1 + i % 50) for i in range(500)] + [(5, 5, 2000)] * 3
    keys = spark.createDataFrame(data, "_h long, _d long, _size long")
    found, total, _ = sharding.find_splitters(keys, 10)
    groups = defaultdict(int)
    for h, d, s in data:
        groups[h, d] += s
    edges, at = [0], 0
    for k in sorted(groups):
        at += groups[k]
        edges.append(at)
    for i, s in enumerate(found, 1):
        assert abs(s.bytes - total * i / 10) == min(abs(e - total * i / 10) for e in edges)
        assert s.bytes == sum(v for (h, d), v in groups.items() if (h, d) < (s.h, s.d))


def brute_components(data, words_each, percent):
    sets = {}
    for i, t, *_ in data:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        n = min(words_each, len(w))
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if w else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(sets, 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_near_duplicates_equal_brute_force(spark, docs, empty):
    rng = np.random.default_rng(3)
    base = [f"w{k}" for k in range(120)]
    data = list(ROWS)
    for i in range(100, 150):  # a group of copies with edits, in a chain of distances
        words = list(base)
        for k in rng.integers(0, 120, rng.integers(0, 14)):
            words[k] = f"e{rng.integers(0, 40)}"
        data.append((i, " ".join(words), "g"))
    table = spark.createDataFrame([(i, t) for i, t, _ in data], "doc_id long, text string")
    out = rows(neardup.near_duplicates(table, 2, 80))
    want = brute_components(data, 2, 80)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in out} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in out)
    assert rows(neardup.near_duplicates(empty)) == []


def test_signature_estimates_similarity():
    a, b = np.arange(1, 1001, dtype=np.uint64), np.arange(101, 1101, dtype=np.uint64)
    x, y = neardup.pack(neardup.minima([neardup._mix(a), neardup._mix(b)])).view(np.uint64)
    lanes = lambda v: np.array([(int(q) >> s) & 15 for q in v for s in range(0, 64, 4)])
    equal = (lanes(x) == lanes(y)).mean()
    assert abs((equal - 1 / 16) / (1 - 1 / 16) - 900 / 1100) < 0.15


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 101)], "a long, b long")
    out = {r["node"]: r["component"] for r in rows(neardup.connected_components(edges))}
    assert out == {**{i: 1 for i in range(1, 41)}, 100: 100, 101: 100}


def test_media_round_trip(docs, empty):
    out = {r["doc_id"]: r for r in rows(media.media_columns(docs))}
    assert len(out) == len(ROWS)
    for i, t, _ in ROWS:
        raw = (t or "").encode()
        want = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        r = out[i]
        stored = media.encode_png(want)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"]) == (len(raw), len(want), hashlib.sha256(want).hexdigest())
        assert (r["tail_crc32"], r["media_bytes"], r["media_sha256"]) == (zlib.crc32(want[-64:]), len(stored), hashlib.sha256(stored).hexdigest())
        assert media.decode_png(stored) == want and (r["width"], r["height"], r["bits"]) == (64, len(want) // 64, 8)
        assert r["feature"] == media.features(want)
    assert rows(media.media_columns(empty)) == []


def test_shards_are_tar_files(docs, tmp_path):
    import tarfile

    index = rows(media.store_payloads(docs, media.digests(docs), f"file://{tmp_path}/m"))
    names = {}
    for path in (tmp_path / "m").iterdir():
        with tarfile.open(path) as t:
            for m in t.getmembers():
                names[m.name] = t.extractfile(m).read()
    assert len(index) == len({t or "" for _, t, _ in ROWS}) == len(names)
    for r in index:
        with open(r["uri"].removeprefix("file://"), "rb") as f:
            f.seek(r["offset"])
            assert f.read(r["length"]) == names[bytes(r["digest"]).hex() + ".png"]


def test_mix_meets_its_budgets(spark, docs, empty):
    out = rows(mixing.mix_plan(docs))
    by = defaultdict(list)
    for r in out:
        by[r["source"]].append(r)
    sizes = {s: sum(r["size"] for r in own) for s, own in by.items()}
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    target, free, left = {}, set(names), sum(sizes.values())
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * sizes[s]}
        if not over:
            break
        for s in over:
            target[s] = 3 * sizes[s]
            left -= target[s]
        free -= over
    target |= share
    for s, own in by.items():
        assert abs(own[0]["target"] - target[s]) < 1e-6
        assert abs(sum(r["taken"] for r in own) - target[s]) <= 1
        assert all(0 <= r["taken"] <= 3 * r["size"] for r in own)
    assert sorted(map(str, out)) == sorted(map(str, rows(mixing.mix_plan(docs))))
    times = {r["doc_id"]: r["copies"] for r in out}
    mixed = rows(mixing.mix_documents(docs).groupBy("doc_id").count())
    assert {r["doc_id"]: r["count"] for r in mixed} == {i: n for i, n in times.items() if n}
    assert rows(mixing.mix_plan(empty)) == []


def test_personal_data(docs, empty):
    email, ip = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    for x in ["a@b.c@d.e f@g", "x@y@z.com", "@a.b", "a@b..c", "a.b@c.d@e.f.g", ".a@b.c.", "é.x@y.z", "a@b.c" * 3]:
        assert [m.span() for m in email.finditer(x)] == list(pii._emails(x))
    for x in ["1.2.3.4.5 999.1.1.1 01.002.3.4", "1" * 5000 + ".1.1.1", "1..2.3.4 5.6.7.8"]:
        assert [m.span() for m in ip.finditer(x)] == [m.span() for m in pii._IP.finditer(x)]
    assert pii.base_spans("4111-1111-1111-1111 and +1 212 555 0100") == [(0, 19, "card"), (24, 39, "phone")]
    assert pii.base_spans("4111 1111 1111 1112") == []
    text = "write to bob.42@mail1.example.com or +1 (988) 555-2485 or 4111111111111111 at 10.0.0.1 today"
    field = pii.train([e for k in range(40) for t in [text.replace("988", str(200 + k))] for e in pii.examples_of(t, pii.base_spans(t))])
    joined = "x +1 (269) 555-3296 4524132264652876 now"
    found = pii.added_spans(joined, field, pii.base_spans(joined))
    assert {(joined[a:b], k) for a, b, k in found} == {("+1 (269) 555-3296", "phone"), ("4524132264652876", "card")}
    out = {r["doc_id"]: r for r in rows(pii.find_personal_data(docs, field))}
    assert len(out) == len(ROWS) and out[5]["spans"] == out[4]["spans"] == "" and out[16]["n_email"] == 1 and out[16]["n_added"] == 2
    assert out[4]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    assert rows(pii.find_personal_data(empty, pii.fit(empty))) == []


def test_field_sums_match_enumeration():
    field = pii.Field({("card", "f"): 1.0, ("phone", "f"): 0.3, ("out", "card"): -0.5, ("card", "out"): 0.2})
    segments = [(0, 1, ["f"]), (0, 2, ["f"]), (1, 3, ["f"])]
    into, step = field.arcs(3, segments), field.step()

    def paths(at, last, score):
        if at == 3:
            yield score
        for j in range(at + 1, 4):
            for i, k, s in into[j]:
                if i == at:
                    yield from paths(j, k, score + s + step[last][k])

    all_scores = list(paths(0, 0, 0.0))
    total, chances, _ = field.sums(3, into)
    assert abs(total - np.log(np.exp(all_scores).sum())) < 1e-9
    assert abs(sum(c for (i, j, k), c in chances.items() if i <= 1 < j) - 1) < 1e-9


def brute_base(text):
    """Base spans by the contract's patterns, as they stand."""
    patterns = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }
    out = []
    for k, (kind, pattern) in enumerate(patterns.items()):
        for m in re.finditer(pattern, text):
            digits = [int(c) for c in m[0] if c in "0123456789"]
            good = {
                "email": lambda m, d: True, "ip": lambda m, d: all(int(p) <= 255 for p in m[0].split(".")),
                "card": lambda m, d: 12 <= len(d) <= 19 and sum(v if i % 2 == 0 else sum(map(int, str(2 * v))) for i, v in enumerate(reversed(d))) % 10 == 0, "phone": lambda m, d: 9 <= len(d) <= 15,
            }[kind]
            if good(m, digits):
                out.append((m.start(), k, m.end(), kind))
    return [(a, b, kind) for a, _, b, kind in sorted(out)]


def test_base_spans_equal_the_patterns():
    rng = np.random.default_rng(11)
    parts = ["4111 1111 1111 1111", "4524132264652876", "+1 (269) 555-3296", "10.0.0.1", "1.2.3.4.5", "300.1.1.1", "bob@mail.example.com", "a@b.c@d.e", "+", "(", "7", "12", "-", ".", " ", "\n", "x", "é", "@", "٣"]
    for _ in range(3000):
        text = "".join(rng.choice(parts, rng.integers(1, 14)))
        assert pii.base_spans(text) == brute_base(text), text


def test_best_segmentation_and_blocks_match_enumeration():
    rng = np.random.default_rng(12)
    names = ("out", *pii.KINDS)
    for _ in range(60):
        weights = {(k, f): float(rng.normal(0, 2)) for k in pii.KINDS for f in "fgh"} | {(a, b): float(rng.normal()) for a in names for b in names}
        field, n = pii.Field(weights), int(rng.integers(1, 7))
        segments = [(i, j, [str(rng.choice(list("fgh")))]) for i in range(n) for j in range(i + 1, min(n, i + 3) + 1) if rng.random() < 0.4]
        into, step = field.arcs(n, segments), field.step()

        def paths(at, last, score, own, into=into, step=step, n=n):
            if at == n:
                yield score, own
            for j in range(at + 1, n + 1):
                for i, k, s in into[j]:
                    if i == at:
                        yield from paths(j, k, score + s + step[last][k], [*own, (i, j, k)] if k else own)

        found = {tuple(own): score for score, own in paths(0, 0, 0.0, [])}
        top = max(found.values())
        assert abs(found[tuple(field.best(n, into))] - top) < 1e-9
        total, chances, _ = field.sums(n, into)
        parted_best, parted = [], {}
        for own, some in pii.blocks(list(range(n + 1)), segments):
            part = field.arcs(len(own) - 1, some)
            parted_best += [(own[i], own[j], k) for i, j, k in field.best(len(own) - 1, part)]
            parted |= {(own[i], own[j], k): c for (i, j, k), c in field.sums(len(own) - 1, part)[1].items() if k}
        assert abs(found[tuple(parted_best)] - top) < 1e-9
        assert all(abs(c - parted[at]) < 1e-9 for at, c in chances.items() if at[2]) and sum(1 for at in chances if at[2]) == len(parted)


def test_long_texts_with_many_spans_are_linear():
    field = pii.train([e for k in range(20) for t in [f"call +1 ({200 + k}) 555-2485 or mail bob.{k}@mail1.example.com now"] for e in pii.examples_of(t, pii.base_spans(t))])
    text = " and ".join(f"x{k}@mail.example.com 10.0.{k % 256}.1 +1 ({200 + k % 700}) 555-3296" for k in range(7000))
    began = time.perf_counter()
    base = pii.base_spans(text)
    pii.added_spans(text, field, base)
    assert len(base) == 21_000 and time.perf_counter() - began < 30


def parse_fingerprint(mark):
    """Level and the full cells {(table, cell): [count, digests, checksums]} of a fingerprint."""
    level, _, body = mark.partition(":")
    level, cells = int(level), body.split(",")
    assert len(cells) == 3 << level
    return level, {(i >> level, i & (1 << level) - 1): [int(c[:-24], 16), int(c[-24:-8], 16), int(c[-8:], 16)] for i, c in enumerate(cells) if c}


class Sketches:
    """Sketches in plain Python; the hashes of digests are looked up, as Spark computes them."""

    def __init__(self, hashes):
        self.hashes = hashes  # digest -> (hash of table 0, 1, 2, checksum)

    def add(self, cells, key, n, level):
        *places, check = self.hashes[key]
        for t, h in enumerate(places):
            cell = cells.setdefault((t, h & (1 << level) - 1), [0, 0, 0])
            cell[0], cell[1], cell[2] = cell[0] + n, cell[1] ^ key, cell[2] ^ check
            if cell == [0, 0, 0]:
                del cells[t, h & (1 << level) - 1]

    def peel(self, cells, level):
        """Digests and their signs; whether cells are left."""
        cells, out = {k: list(v) for k, v in cells.items()}, {}
        while True:
            pure = next((c for at, c in cells.items() if abs(c[0]) == 1 and c[1] in self.hashes and self.hashes[c[1]][3] == c[2] and self.hashes[c[1]][at[0]] & (1 << level) - 1 == at[1]), None)
            if pure is None:
                return out, bool(cells)
            n, key = pure[0], pure[1]
            out[key] = n
            self.add(cells, key, -n, level)

    def likeness(self, a, b):
        """From two fingerprints alone: subtract at one level, larger ones made from the digests that each gives back."""
        sets = []
        for mark in (a, b):
            level, cells = parse_fingerprint(mark)
            own, left = self.peel(cells, level)
            assert not left and set(own.values()) <= {1}
            sets.append(set(own))
        level = max(parse_fingerprint(a)[0], parse_fingerprint(b)[0])
        while True:
            cells = {}
            for keys, n in zip(sets, (1, -1), strict=True):
                for k in keys:
                    self.add(cells, k, n, level)
            diff, left = self.peel(cells, level)
            if not left:
                return 1 - len(diff) / max(1, len(sets[0]) + len(sets[1]))
            level += 1


def test_likeness_follows_from_the_fingerprints(spark, docs, empty):
    hard = docs.select("doc_id", "text").union(spark.createDataFrame([(-(1 << 63), "least. id."), ((1 << 63) - 1, BASE + ". x"), (None, "no id. at all"), (None, "no id. again"), (2, BASE + " again"), (2, "another. text")], "doc_id long, text string"))
    piece = re.compile(fingerprints.PIECE)
    for table in (docs.select("doc_id", "text"), hard, docs.where("doc_id = 6").select("doc_id", "text")):
        data = [tuple(r) for r in table.collect()]
        order = sorted(data, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
        edits = []
        for k, (i, t) in enumerate(order):
            t, nxt = t or "", order[(k + 1) % len(order)][1] or ""
            half = len(t) // 2
            edits.append((i, t, t[: len(t) - half] + nxt[:half], nxt))
        texts = {x for e in edits for x in e[1:]}
        found = spark.createDataFrame([(p,) for x in texts for p in piece.findall(x)] or [("",)], "p string").distinct().select(F.xxhash64("p").alias("key"))
        hashed = found.select("key", *(F.xxhash64("key", F.lit(t)) for t in range(3)), fingerprints._check(F.col("key"))).collect()
        unsigned = lambda x: x & (1 << 64) - 1
        plain = Sketches({unsigned(r[0]): (*map(unsigned, r[1:4]), r[4]) for r in hashed})
        out = defaultdict(list)
        for r in rows(fingerprints.fingerprint_documents(table)):
            out[r["doc_id"], r["n_chars"], r["edited_sha256"]].append(r)
        mark = {x: None for x in texts}
        for i, t, edited, _ in edits:
            (*_, r) = out[i, len(t), hashlib.sha256(edited.encode()).hexdigest()]
            for x, m in ((t, r["fingerprint"]), (edited, r["edited_fingerprint"])):
                assert mark[x] in (None, m)
                mark[x] = m
        like = lambda a, b: 1.0 if not a and not b else 1 - len(a ^ b) / (len(a) + len(b))
        want = defaultdict(list)
        for i, t, edited, nxt in edits:
            sets = [set(piece.findall(x)) for x in (t, edited, nxt)]
            near = [like(sets[0], s) for s in sets[1:]]
            assert np.allclose(near, [plain.likeness(mark[t], mark[x]) if mark[x] else like(sets[0], set(piece.findall(x))) for x in (edited, nxt)])
            want[i, len(t), hashlib.sha256(edited.encode()).hexdigest()].append((*near, len(sets[0])))
        assert out.keys() == want.keys()
        for k, own in want.items():
            assert np.allclose(sorted(own), sorted((r["near_edited"], r["near_next"], r["n_digests"]) for r in out[k]))
    assert rows(fingerprints.fingerprint_documents(empty)) == []


def test_token_files(docs, empty):
    public = pytest.importorskip("public_tokenizers")
    path = public.path("byte_bpe_50k.json")
    from tokenizers import Tokenizer

    plain, at = Tokenizer.from_file(path), 0
    out = {r["doc_id"]: r for r in rows(tokenfiles.read_token_files(tokenfiles.write_token_files(docs, path)))}
    for i, t, _ in ROWS:
        ids = np.array([*plain.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        assert (out[i]["start"], out[i]["n_tokens"], out[i]["ids_crc32"]) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    enc = tokenfiles.encoder(path)
    assert enc.cuttable
    for x in [" a", "a ", "a  b", "a\n b", " \n x y", "it's  'll", "<|endoftext|> hi", "x　 y z", "naïve, “q” don't", "".join(map(chr, range(1, 600)))]:
        assert enc.encode_batch([x])[0].tolist() == plain.encode(x, add_special_tokens=False).ids
    assert rows(tokenfiles.read_token_files(tokenfiles.write_token_files(empty, path))) == []


@pytest.mark.parametrize("n", [0, 1, 511, 512, 513, 3000])
def test_codes_give_random_access(n):
    ids = np.random.default_rng(n).choice([0, 5, 255, 256, 50_000, 70_000, 1 << 24], n).astype("<u4")
    codes = tokenfiles.Dac(tokenfiles.encode_dac(ids))
    assert (codes.slice(0, n) == ids).all()
    for i in range(0, n, 37):
        assert codes[i] == ids[i] and (codes.slice(i, min(n, i + 50)) == ids[i : i + 50]).all()
    with pytest.raises(IndexError):
        codes[n]


def test_lines_equal_brute_force(docs, empty):
    seen, covered = set(), defaultdict(set)
    for i, t, _ in sorted(ROWS):
        lines = (t or "").split("\n")
        for p in range(len(lines) - 2):
            w = tuple(lines[p : p + 3])
            if w in seen:
                covered[i] |= {p, p + 1, p + 2}
            seen.add(w)
    out = {r["doc_id"]: r for r in rows(linededup.dedup_lines(docs))}
    for i, t, _ in ROWS:
        want = None if t is None else "\n".join(x for p, x in enumerate(t.split("\n")) if p not in covered[i])
        assert out[i]["text"] == want and out[i]["n_removed"] == len(covered[i])
    assert rows(linededup.dedup_lines(empty)) == []


def test_lines_of_two_texts_under_one_id_and_long_texts(spark):
    long = "\n".join(f"line {k % 5000}" for k in range(40_000))
    data = [(1, "a\nb\nc\nd", 7), (1, "p\nq\nr\ns", 8), (2, "a\nb\nc\nz", 9), (None, "a\nb\nc", 1), (3, long, 0), (4, long, 0), (5, "x\ny\nz", 1), (5, "x\ny\nz", 1)]
    table = spark.createDataFrame(data, "doc_id long, text string, _marked int").withColumns({"_covered": F.lit("c"), "_id": F.lit(1), "_key": F.lit(2)})
    out = rows(linededup.dedup_lines(table))
    assert {"_marked", "_covered", "_id", "_key"} <= set(out[0])
    got = sorted((str(r["doc_id"]), r["text"], r["_marked"]) for r in out if r["doc_id"] not in (3, 4))
    assert got == sorted([("1", "", 7)[:1] + ("d", 7), ("1", "p\nq\nr\ns", 8), ("2", "z", 9), ("None", "a\nb\nc", 1), ("5", "x\ny\nz", 1), ("5", "x\ny\nz", 1)])
    by = {r["doc_id"]: r for r in out}
    assert (by[3]["n_removed"], by[4]["n_removed"]) == (35_000, 40_000) and by[3]["text"] == "\n".join(f"line {k}" for k in range(5000)) and by[4]["text"] == ""


def test_segmentations_are_the_n_best(docs, empty):
    pytest.importorskip("public_tokenizers")
    path = sentencepieces.default_model()
    known = sentencepieces.pieces(path)

    def every(span):
        out = []

        def go(j, score):
            if not j:
                out.append(score)
            for i, s, _ in known.arcs(span, j) if j else ():
                go(i, score + s)

        go(len(span), 0.0)
        return sorted(out, reverse=True)

    for text in ["hello", "he is on", "the, cat.", "a\nb", "é你", "x  y", "in in"]:
        want = every(sentencepieces.SPACE + text.replace(" ", sentencepieces.SPACE))[:4]
        got = sentencepieces.segmentations(text, path, 4)
        assert len(got) == len(want) and np.allclose([g[0] for g in got], want) and len({g[1] for g in got}) == len(got)
    words = {r for _, t, _ in ROWS if t for s in sentencepieces.spans(t) for r in known._runs(s)} | {"▁" + w for w in ("unbelievably", "inininin", "zzzz", "Straße")}
    for size in {len(w) for w in words}:
        some = [w for w in words if len(w) == size]
        for w, got in zip(some, known.first_of_many(some), strict=True):
            best, gap, ids = known.first(w)
            assert got is None and any(c not in known.ahead or not known.ahead[c][1] for c in w) or got[2] == ids and np.allclose([got[0]], [best]) and (np.isinf(gap) or abs(got[1] - gap) < 1e-9)
    for _, t, _ in ROWS:
        for _, ids in sentencepieces.segmentations(t, path):
            assert known.decode(ids) == (t or "")
    out = rows(sentencepieces.encode_documents(docs, path))
    assert len(out) == len(ROWS) and all(r["decoded_ok"] for r in out)
    for r in out:
        ids = [np.array(x, "<u4").tobytes() for x in r["nbest_ids"]]
        assert [zlib.crc32(x) for x in ids] == [x["ids_crc32"] for x in r["nbest"]] and r["piece_ids"] == r["nbest_ids"][0] and r["n_pieces"] == len(r["piece_ids"])
    assert rows(sentencepieces.encode_documents(empty, path)) == []


@pytest.mark.parametrize("text", ["ing" * 3200, "a" * 6400, "ab " * 20_000])
def test_ties_do_not_multiply(text):
    pytest.importorskip("public_tokenizers")
    path = sentencepieces.default_model()
    sentencepieces.pieces(path)
    began = time.perf_counter()
    found = sentencepieces.segmentations(text, path)
    assert time.perf_counter() - began < 2 and len(found) == 4 and all(sentencepieces.pieces(path).decode(x) == text for _, x in found)


def test_toxicity_learns_and_holds_out(spark, docs, empty):
    rng = np.random.default_rng(5)
    words = ["river", "stone", "cloud", "green", "table", "seven", "light", "paper"]
    data = [(i, " ".join(rng.choice(words, 30)) + (" you vile grotch" if i % 4 == 0 else ""), int(i % 4 == 0)) for i in range(400)]
    table = spark.createDataFrame([(i, t) for i, t, _ in data] + [(900, ""), (901, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in data], "doc_id long, toxic int")
    model = toxicity.fit(table, labels)
    out = {r["doc_id"]: r for r in rows(toxicity.score_documents(table, model, "score"))}
    held = [(i, y) for i, _, y in data if zlib.crc32(str(i).encode()) % 4 == 2]
    assert held and np.mean([(out[i]["score"] >= 0.3) == bool(y) for i, y in held]) > 0.97
    assert out[900]["score"] == out[901]["score"] < 0.5
    used = [r["doc_id"] for r in rows(labels.where(toxicity.in_training(F.col("doc_id"))))]
    assert all(zlib.crc32(str(i).encode()) % 4 != 2 for i in used)
    assert toxicity.fit(table, labels.where("false")).score("any text") == 0.0
    assert rows(toxicity.score_documents(empty, model)) == []


def test_pipeline_stages_hand_on_documents(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs, d)
        if name != "sentencepiece":
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    assert docs.count() and docs.where("NOT decoded_ok").count() == 0
