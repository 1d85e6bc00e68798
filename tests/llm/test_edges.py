"""Every operator and stage on a table of hard cases: null, repeated and extreme doc_ids, two texts under one doc_id, empty
and very long texts, columns named like their own, and the empty table."""

import hashlib
import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from ambulo.llm import fingerprints, linededup, media, mixing, neardup, pii, sentencepieces, sharding, tokenfiles, toxicity

LEAST, MOST = -(1 << 63), (1 << 63) - 1
CLASH = ("_row", "_id", "_h", "_d", "_size", "_p", "_b", "_text", "_marked", "_covered", "_parts", "_gone", "_key", "_toxicity", "_times", "_n", "_salt", "size", "shard", "component_id", "n_removed")


def long_text(megabytes):
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 10))) for _ in range(3000)]
    parts, size = [], 0
    while size < megabytes << 20:
        parts.append(" ".join(rng.choices(words, k=12)) + ".")
        size += len(parts[-1]) + 1
    return "\n".join(parts)


SAME = "the cat sat on the mat and the dog lay by the fire\nall day long until the night fell\nand the moon rose over the hill"
DATA = [
    (None, SAME, "a"), (None, SAME, "a"), (1, SAME, "a"), (1, SAME, "a"), (1, "another text under the same id, of other words", None), (LEAST, SAME, "b"), (MOST, SAME + " so bright", "b"),
    (5, "", "a"), (6, None, None), (7, "x", "c"), (8, "mail bob@mail.example.com or 10.0.0.1", "c"), (9, long_text(10), "a"),
]


@pytest.fixture(scope="module")
def hard(spark):
    table = spark.createDataFrame([(*r, "en", len(r[1] or "")) for r in DATA], "doc_id long, text string, source string, lang string, n_chars long")
    return table.withColumns({c: F.lit(f"{c}!") for c in CLASH})


def md5(text):
    return None if text is None else hashlib.md5(text.encode()).hexdigest()


def seen(df, *columns):
    """Rows of the columns, with how often each comes; texts by digest."""
    shown = [F.md5("text").alias("text") if c == "text" else F.col(c) for c in columns]
    return Counter(tuple(r) for r in df.select(*shown).collect())


def passed_through(df, but=()):
    names = [c for c in CLASH if c not in but]
    assert set(names) <= set(df.columns)
    assert all(r[c] == f"{c}!" for r in df.select(*names).distinct().collect() for c in names)


WANT = Counter((i, md5(t)) for i, t, _ in DATA)


def test_sharding(hard):
    out = sharding.shard_documents(hard, 3, piece_bytes=1 << 20)
    passed_through(out, ("size", "shard"))
    assert seen(out, "doc_id", "text") == WANT
    for own in Counter((r["shard"], r["slot"]) for r in out.select("shard", "slot").collect()).values():
        assert own == 1
    assert sharding.shard_documents(hard.where("false"), 3).count() == 0


def test_near_duplicates(hard):
    out = neardup.near_duplicates(hard, 2, 80)
    rows = [tuple(r) for r in out.select("doc_id", "component_id", "kept").collect()]
    group = [r for r in rows if r[0] in (1, LEAST, MOST)]
    assert sorted(group, key=str) == sorted([(1, LEAST, False), (1, LEAST, False), (1, 1, True), (LEAST, LEAST, True), (MOST, LEAST, False)], key=str)
    assert all(r[2] for r in rows if r[0] not in (1, MOST)) and rows.count((None, None, True)) == 2
    kept = neardup.keep_one_of_each(hard, 2, 80)
    passed_through(kept)
    assert seen(kept, "doc_id", "text") == WANT - Counter([(1, md5(SAME)), (1, md5(SAME)), (MOST, md5(SAME + " so bright"))])
    assert neardup.near_duplicates(hard.where("false")).count() == 0


def test_media(hard):
    out = media.media_columns(hard)
    pad = lambda t: (t or "").encode().ljust(max(64, -(-len((t or "").encode()) // 64) * 64), b"\0")
    assert seen(out, "doc_id", "payload_sha256") == Counter((i, hashlib.sha256(pad(t)).hexdigest()) for i, t, _ in DATA)
    assert media.media_columns(hard.where("false")).count() == 0


def decode_any_png(data):
    """Width, height and samples of an 8-bit greyscale PNG, with all five row filters."""
    at, packed, size = 8, b"", None
    while at < len(data):
        n = int.from_bytes(data[at : at + 4], "big")
        kind, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + n]
        if kind == b"IHDR":
            size = int.from_bytes(body[:4], "big"), int.from_bytes(body[4:8], "big")
            assert body[8:10] == b"\x08\x00"
        packed += body if kind == b"IDAT" else b""
        at += 12 + n
    width, height = size
    lines, before, out = zlib.decompress(packed), bytearray(width), bytearray()
    for r in range(height):
        kind, raw, own = lines[r * (width + 1)], lines[r * (width + 1) + 1 : (r + 1) * (width + 1)], bytearray(width)
        for k, x in enumerate(raw):
            a, b, c = own[k - 1] if k else 0, before[k], before[k - 1] if k else 0
            near = min((a, b, c), key=lambda v: abs(a + b - c - v))
            own[k] = (x + (0, a, b, (a + b) // 2, near)[kind]) & 255
        out += own
        before = own
    return width, height, bytes(out)


def test_media_files_are_pngs_with_headers_as_the_columns_say(hard):
    small = hard.where("doc_id IS NULL OR doc_id <> 9")
    for r in media.fill_metadata(media.store_payloads(small, media.digests(small))).collect():
        with open(r["uri"].removeprefix("file://"), "rb") as f:
            f.seek(r["offset"])
            width, height, samples = decode_any_png(f.read(r["length"]))
        assert (width, height) == (r["width"], r["height"]) and hashlib.sha256(samples).digest() == bytes(r["digest"])


def test_mix(hard):
    plan = mixing.mix_plan(hard)
    assert seen(plan, "doc_id", "size") == Counter((i, len((t or "").split())) for i, t, _ in DATA)
    out = mixing.mix_documents(hard)
    passed_through(out)
    assert set(seen(out, "doc_id", "text")) <= set(WANT)
    assert mixing.mix_plan(hard.where("false")).count() == 0 == mixing.mix_documents(hard.where("false")).count()


def test_personal_data(hard):
    field = pii.fit(hard)
    out = pii.find_personal_data(hard, field)
    assert seen(out, "doc_id", "n_email", "n_ip") == Counter((i, int(i == 8), int(i == 8)) for i, _, _ in DATA)
    assert pii.find_personal_data(hard.where("false"), field).count() == 0


def test_fingerprints(hard):
    out = fingerprints.fingerprint_documents(hard)
    assert seen(out, "doc_id", "n_chars") == Counter((i, len(t or "")) for i, t, _ in DATA)
    marks = {(r["doc_id"], r["n_chars"], r["fingerprint"]) for r in out.select("doc_id", "n_chars", F.md5("fingerprint").alias("fingerprint")).collect()}
    assert len({m for i, n, m in marks if n == len(SAME)}) == 1 and len({m for i, n, m in marks}) == len({t or '' for _, t, _ in DATA})


def test_token_files(hard):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public.path("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    out = tokenfiles.read_token_files(tokenfiles.write_token_files(hard, path))
    counts = {t: len(plain.encode(t or "", add_special_tokens=False).ids) + 1 for _, t, _ in DATA}
    assert seen(out, "doc_id", "n_tokens") == Counter((i, counts[t]) for i, t, _ in DATA)
    starts = sorted((r["start"], r["n_tokens"]) for r in out.collect())
    assert all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:], strict=False)) and starts[0][0] == 0


def test_lines(hard):
    out = linededup.dedup_lines(hard)
    passed_through(out, ("n_removed",))
    # The window of SAME comes first under the null ids, which are one document.
    gone = {(i, md5(t)) for i, t, _ in DATA if t == SAME and i is not None}
    assert {k[:2] for k in seen(out.where("n_removed > 0 AND text = ''"), "doc_id", "n_removed")} == {(i, 3) for i, _ in gone}
    assert seen(out.where("n_removed = 0"), "doc_id", "text") == Counter({k: v for k, v in WANT.items() if k not in gone})


def test_segmentations(hard):
    pytest.importorskip("public_tokenizers")
    out = sentencepieces.encode_documents(hard, sentencepieces.default_model(), ids=False)
    passed_through(out)
    assert seen(out, "doc_id", "text") == WANT and out.where("NOT decoded_ok").count() == 0
    assert seen(out.where("n_pieces = 0"), "doc_id", "n_found") == Counter([(5, 1), (6, 1)])


def test_toxicity(spark, hard):
    labels = spark.createDataFrame([(1, 1), (1, 0), (7, 0), (8, 0), (None, 1), (9, None), (77, 1)], "doc_id long, toxic int")
    out = toxicity.score_documents(hard, toxicity.fit(hard, labels), "score")
    passed_through(out)
    scores = {tuple(r) for r in out.select(F.md5("text"), "score").collect()}
    assert seen(out, "doc_id", "text") == WANT and len(scores) == len({t for _, t, _ in DATA}) and all(0 <= s <= 1 for _, s in scores)
    passed_through(toxicity.drop_toxic(hard, labels))
    assert toxicity.drop_toxic(hard.where("false"), labels).count() == 0


def test_pipeline_stages(spark, hard, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    pytest.importorskip("public_tokenizers")
    small = hard.where("doc_id IS NULL OR doc_id <> 9").select("doc_id", "text", "lang", "source", "n_chars", "_gone", "_marked", "_toxicity")
    spark.createDataFrame([(1, 0, 0), (7, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for start in (small, small.where("false")):
        docs, before = start, start.count()
        for name, stage in pipeline.STAGES:
            out = stage(spark, docs, str(tmp_path))
            if name != "sentencepiece":
                assert out.columns == docs.columns
            path = f"{tmp_path}/{name}-{before}"
            out.write.parquet(path)
            docs = spark.read.parquet(path)
        assert bool(docs.count()) == bool(before) and docs.where("NOT decoded_ok").count() == 0
