"""Rows carry all that their operators find."""

import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest

from ambulo.llm import sentencepieces


def test_every_segmentation_is_handed_out(spark):
    path = sentencepieces.default_model()
    texts = ["the cat sat on the mat", "", None, "strawberries  and unbelievable things"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in sentencepieces.encode_documents(docs, path).collect():
        want = sentencepieces.segmentations(r["text"], path)
        assert [np.array(x, "<u4").tobytes() for x in r["nbest_ids"]] == [ids for _, ids in want] and len(want) == r["n_found"]
        assert [(x["score"], x["ids_crc32"]) for x in r["nbest"]] == [(s, zlib.crc32(ids)) for s, ids in want]
        assert r["nbest"][0]["ids_crc32"] == r["ids_crc32"] and r["nbest_ids"][0] == r["piece_ids"]
    assert "nbest" in sentencepieces.op9_nbest(spark, "/root/testdata/sf0.001").columns


def test_results_are_handed_over_in_small_batches():
    """One large batch comes back in pieces, with all its rows and the same results as text by text."""
    path = sentencepieces.default_model()
    texts = [f"{k} strawberries and unbelievable things, number {k}; " * 40 for k in range(700)] + [None, ""]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "text": texts})
    names = ["doc_id", "text", "n_pieces", "best_score", "n_found", "gap", "ids_crc32", "decoded_ok", "nbest", "piece_ids", "nbest_ids"]
    got = list(sentencepieces.encoded([batch], path, names, sentencepieces.N_BEST, True))
    assert batch.nbytes > 4 * sentencepieces.HANDED and max(b.column("text").nbytes for b in got) < 1.1 * sentencepieces.HANDED
    assert max(b.nbytes for b in got) < 20 * sentencepieces.HANDED
    rows = [r for b in got for r in b.to_pylist()]
    assert [(r["doc_id"], r["text"]) for r in rows] == list(enumerate(texts))
    for r in rows[::97] + rows[-2:]:
        want = sentencepieces.segmentations(r["text"], path)
        assert [np.array(x, "<u4").tobytes() for x in r["nbest_ids"]] == [ids for _, ids in want] and r["best_score"] == want[0][0]


@pytest.mark.parametrize("text", ["It%%%", "a %%% b", "###", "no $$$ yes $$$", "x,,, y", "It%%% It%%%", "so ### it %%%"])
def test_tied_segmentations_come_once_each(text):
    """Runs of marks have many segmentations of one score; the n best are distinct and among those of the n best scores."""
    path = sentencepieces.default_model()
    known, n = sentencepieces.pieces(path), sentencepieces.N_BEST
    every = []

    def go(span, j, score, ids):
        if not j:
            every.append((score, ids))
        for i, s, own in known.arcs(span, j) if j else ():
            go(span, i, score + s, own + ids)

    span = sentencepieces.SPACE + text.replace(" ", sentencepieces.SPACE)
    go(span, len(span), 0.0, b"")
    got = sentencepieces.segmentations(text, path)
    scores = sorted((s for s, _ in every), reverse=True)[:n]
    assert len({ids for _, ids in got}) == len(got) == len(scores)
    assert np.allclose([s for s, _ in got], scores)
    by_ids = {ids: s for s, ids in every}
    assert all(abs(by_ids[ids] - s) < 1e-9 for s, ids in got)


def test_rows_reach_their_payloads_in_the_shards(spark):
    import hashlib

    from ambulo.llm import media, store

    got, reader = media.op3_tar_shards(spark, "/root/testdata/sf0.001").collect(), store.Reader()
    assert got
    for r in got:
        stored = reader.read(r["uri"], r["offset"], r["length"])
        assert len(stored) == r["media_bytes"] and hashlib.sha256(stored).hexdigest() == r["media_sha256"]
        assert hashlib.sha256(media.decode_png(stored)).hexdigest() == r["payload_sha256"]
    reader.close()


def test_few_parts_of_spans_are_looked_up(monkeypatch):
    """op9_nbest over its CPU budget: all parts of a span were sought by halving, most of which are no pieces."""
    known = sentencepieces.pieces(sentencepieces.default_model())
    words = [sentencepieces.SPACE + w for w in ("unbelieva", "zqxjkvwyp", "Internati", "aaaaaaaaa", "Straßenba")]
    want, asked, search = [known.first(w) for w in words], [], np.searchsorted
    monkeypatch.setattr(np, "searchsorted", lambda a, v, *more: asked.append(np.size(v)) or search(a, v, *more))
    got = known.first_of_many(words)
    size = len(words[0])
    assert sum(asked) < 0.7 * len(words) * size * (size + 1) / 2
    assert [g[2] for g in got if g] == [w[2] for g, w in zip(got, want) if g] and sum(g is not None for g in got) > 3
    assert all(np.isclose(g[0], w[0]) and np.isclose(g[1], w[1]) for g, w in zip(got, want) if g)


def test_the_vocabulary_is_small_in_memory():
    """Every worker has its own: one dictionary of pieces, without a node for each beginning and each end of them."""
    path = sentencepieces.default_model()
    tracemalloc.start()
    try:
        known = sentencepieces.Pieces(path)
        held = tracemalloc.get_traced_memory()[0]
    finally:
        tracemalloc.stop()
    assert held < 25e6
    for span in ("▁unbelievable", "▁Straße", "▁zażółć", "▁\U0001f600x", "▁" + "ab" * 40):
        for at in range(1, len(span) + 1):
            pieces = [(i, *known.names[span[i:at]]) for i in range(at - 1, -1, -1) if span[i:at] in known.names]
            got = known.arcs(span, at)
            assert [x for x in got if x in pieces] == pieces and len(got) - len(pieces) == (span[at - 1] not in known.names)
