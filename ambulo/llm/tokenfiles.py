"""Operator 7, token ids in files of directly addressable codes.

An id is cut into chunks of eight bits. Level one holds the low chunk of every id and a bitmap that says which ids go
on; level two holds the next chunk of those, and so on. A rank directory over each bitmap (ones before every 512 bits)
turns a position in one level into its position in the next, so any token is read with one step a level and no block
is decoded. Documents are range-partitioned by doc_id and written in order.
"""

from __future__ import annotations

import gc
import json
import struct
import zlib
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import store
from .common import cut, table

#: How the byte-level vocabulary writes a space (a fixed value of its format).
SPACE = "\u0120"
MAGIC = b"DAC1"
CHUNK = 8
BLOCK = 512
END_ID = 0
#: Ids in a file, but for one document more.
FILE_IDS = 2_000_000
#: Distinct pieces whose ids a worker remembers, pieces that go to the library as one text, and characters of text
#: that are encoded together.
PIECES_KEPT, JOINED, TOGETHER = 600_000, 10_000, 4_000_000


def encode_dac(ids: np.ndarray) -> bytes:
    """n, levels, then for each level: length, chunks, bitmap, rank directory."""
    levels, rest = [], ids.astype(np.uint32)
    while True:
        more = rest >> CHUNK != 0
        bits = np.packbits(more, bitorder="little")
        padded = np.zeros(-(-len(more) // BLOCK) * BLOCK, bool)
        padded[: len(more)] = more
        ones = padded.reshape(-1, BLOCK).sum(axis=1, dtype=np.int64)
        ranks = np.concatenate([[0], np.cumsum(ones)]).astype("<u8")
        levels.append(struct.pack("<Q", len(rest)) + rest.astype(np.uint8).tobytes() + bits.tobytes() + ranks.tobytes())
        if not more.any():
            return struct.pack("<QI", len(ids), len(levels)) + b"".join(levels)
        rest = rest[more] >> CHUNK


class Dac:
    """Reads ids from bytes that encode_dac made."""

    def __init__(self, data: bytes, at: int = 0):
        self.n, count = struct.unpack_from("<QI", data, at)
        at += 12
        self.levels = []
        for _ in range(count):
            (n,) = struct.unpack_from("<Q", data, at)
            chunks = np.frombuffer(data, np.uint8, n, at + 8)
            bits = np.frombuffer(data, np.uint8, -(-n // 8), at + 8 + n)
            blocks = -(-n // BLOCK) + 1
            ranks = np.frombuffer(data, "<u8", blocks, at + 8 + n + len(bits))
            self.levels.append((chunks, bits, ranks))
            at += 8 + n + len(bits) + 8 * blocks
        self.end = at

    def __getitem__(self, i: int) -> int:
        """One id: in each level its chunk, its bit, and the rank of that bit."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for k, (chunks, bits, ranks) in enumerate(self.levels):
            value |= int(chunks[i]) << (CHUNK * k)
            if not bits[i >> 3] >> (i & 7) & 1:
                break
            start = i // BLOCK
            own = np.unpackbits(bits[start * BLOCK // 8 : (i >> 3) + 1], bitorder="little")[: i - start * BLOCK]
            i = int(ranks[start]) + int(own.sum())
        return value

    def slice(self, lo: int, hi: int) -> np.ndarray:
        """ids lo to hi, touching only their own chunks."""
        out = np.zeros(hi - lo, "<u4")
        where = np.arange(hi - lo)
        for k, (chunks, bits, ranks) in enumerate(self.levels):
            out[where] |= chunks[lo:hi].astype(np.uint32) << np.uint32(CHUNK * k)
            first = lo // BLOCK * BLOCK
            flags = np.unpackbits(bits[first // 8 : -(-hi // 8)], bitorder="little")[: hi - first].astype(bool)
            own = flags[lo - first :]
            lo, where = int(ranks[first // BLOCK]) + int(flags[: lo - first].sum()), where[own]
            hi = lo + len(where)
            if not len(where):
                break
        return out


class Encoder:
    """Encodes whole texts with a byte-level BPE of the tokenizers library, giving it each distinct piece once.

    A single space after a character that is not white space begins a new pre-token, so a text may be encoded in
    pieces that begin at such spaces, in any order: the library encodes new pieces, joined by spaces, as one text, in
    which the tokens that begin with a space begin the pieces. Texts that cannot be cut so (doubled or outer spaces,
    white space before a space, special tokens) are encoded whole; so are all texts if the vocabulary file names
    another normalizer, pre-tokenizer or merging than those for which this holds.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        stated = json.loads(self.tokenizer.to_str())
        splits, merges = stated["pre_tokenizer"] or {}, stated["model"]
        self.cuttable = (
            stated["normalizer"] is None and splits.get("type") == "ByteLevel" and splits.get("use_regex", True) and not splits["add_prefix_space"]
            and merges["type"] == "BPE" and not any(merges.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback"))
        )
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.spaced = np.fromiter(((self.tokenizer.id_to_token(i) or "").startswith(SPACE) for i in range(size)), bool, size)
        self._forget()

    def _forget(self) -> None:
        #: Piece without its space -> its number; ids of piece k: pool[starts[k] : starts[k + 1]].
        self.known: dict[str, int] = {}
        self.pool, self.starts = np.empty(0, "<u4"), np.zeros(1, np.int64)

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, pieces: list[str]) -> None:
        ids = np.concatenate(self._whole([" " + " ".join(pieces[k : k + JOINED]) for k in range(0, len(pieces), JOINED)]))
        begins = np.flatnonzero(self.spaced[ids])
        if len(begins) != len(pieces):
            raise ValueError("a piece begins with no space or holds one")
        self.known.update(zip(pieces, range(len(self.known), len(self.known) + len(pieces)), strict=True))
        self.starts = np.concatenate([self.starts[:-1], len(self.pool) + begins, [len(self.pool) + len(ids)]])
        self.pool = np.concatenate([self.pool, ids])

    def _may_be_cut(self, text: str | None) -> bool:
        return bool(self.cuttable and text) and " " not in (text[0], text[-1]) and "  " not in text and not any(s in text for s in self.special)

    def encode_batch(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids that the tokenizers library gives each whole text."""
        if len(self.known) > PIECES_KEPT:
            self._forget()
        rows = [i for i, t in enumerate(texts) if self._may_be_cut(t)]
        parts = pc.split_pattern(pa.array([texts[i] for i in rows], pa.string()), " ")
        edges, flat = parts.offsets.to_numpy(), parts.values
        first = np.zeros(len(flat), bool)
        first[edges[:-1]] = True
        rest = flat.filter(pa.array(~first)).dictionary_encode()
        edges = edges - np.arange(len(edges))
        pieces, at = rest.dictionary.to_pylist(), rest.indices.to_numpy()
        # Texts of which a piece ends in white space stay whole.
        ends_in_space = pc.utf8_is_space(pc.utf8_slice_codeunits(rest.dictionary, -1)).to_numpy(zero_copy_only=False).astype(bool)
        bad = np.concatenate([[0], np.cumsum(ends_in_space[at])])
        heads = flat.filter(pa.array(first)).to_pylist()
        cut = (bad[edges[1:]] == bad[edges[:-1]]) & ~np.fromiter((h[-1].isspace() for h in heads), bool, len(heads))
        number = np.fromiter(map(self.known.get, pieces, repeat(-1)), np.int64, len(pieces))
        new = np.flatnonzero((number < 0) & ~ends_in_space)
        if len(new):
            number[new] = np.arange(len(self.known), len(self.known) + len(new))
            self._learn([pieces[k] for k in new.tolist()])
        number = np.maximum(number, 0)[at]
        n = np.diff(self.starts)[number] if len(number) else np.empty(0, np.int64)
        ends = np.concatenate([[0], np.cumsum(n)])
        ids = self.pool[np.repeat(self.starts[number] - ends[:-1], n) + np.arange(ends[-1])]
        out: list[np.ndarray | None] = [None] * len(texts)
        for i, head, ok, lo, hi in zip(rows, self._whole(heads), cut.tolist(), ends[edges[:-1]].tolist(), ends[edges[1:]].tolist(), strict=True):
            if ok:
                out[i] = np.concatenate([head, ids[lo:hi]])
        left = [i for i, x in enumerate(out) if x is None]
        for i, x in zip(left, self._whole([texts[i] or "" for i in left]), strict=True):
            out[i] = x
        return out


@lru_cache(2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _portions(batches):
    """Ids and texts of so many rows that their texts have about TOGETHER characters."""
    for batch in batches:
        ids, texts, chars = [], [], 0
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
            ids.append(doc_id)
            texts.append(text.as_py())
            chars += len(texts[-1] or "")
            if chars >= TOGETHER:
                yield ids, texts
                ids, texts, chars = [], [], 0
        yield ids, texts


def _writer(folder: str, path: str):
    def run(batches):
        tokens = encoder(path)
        ids, lengths, runs, size, seq = [], [], [], 0, 0

        def flush():
            nonlocal ids, lengths, runs, size, seq
            names = np.array([i if i is not None else 0 for i in ids], "<i8")
            nulls = np.array([i is None for i in ids], np.uint8)
            head = MAGIC + struct.pack("<Q", len(ids)) + names.tobytes() + nulls.tobytes() + np.array(lengths, "<u8").tobytes()
            uri = store.write(folder, "tokens", head, encode_dac(np.concatenate(runs)))
            row = pa.RecordBatch.from_pydict({"first_doc": pa.array(ids[:1], pa.int64()), "seq": [seq], "uri": [uri], "n_docs": [len(ids)], "n_ids": [size]})
            ids, lengths, runs, size, seq = [], [], [], 0, seq + 1
            return row

        gc.disable()  # many objects and no cycles
        try:
            for some_ids, texts in _portions(batches):
                for doc_id, codes in zip(some_ids, tokens.encode_batch(texts), strict=True):
                    own = np.append(codes, np.uint32(END_ID))
                    ids.append(doc_id)
                    lengths.append(len(own))
                    runs.append(own)
                    size += len(own)
                    if size >= FILE_IDS:
                        yield flush()
            if ids:
                yield flush()
        finally:
            gc.enable()

    return run


def write_token_files(docs: DataFrame, path: str, folder: str | None = None) -> DataFrame:
    """Table of the files, in doc_id order: uri, start (ids in all files before), n_docs, n_ids.

    Each document's ids are those of its whole text (null: empty) and END_ID. Ascending doc_id, nulls first; rows of
    one doc_id stand together, by text. Files of failed attempts are left behind but not listed. An empty table gives
    no files. The window runs over one row for each file.
    """
    spark = docs.sparkSession
    folder = folder or store.new_folder(spark, "tokens")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ranged = docs.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    files = cut(ranged.mapInArrow(_writer(folder, path), "first_doc long, seq long, uri string, n_docs long, n_ids long"))
    before = Window.orderBy(F.col("first_doc").asc_nulls_first(), "seq").rowsBetween(Window.unboundedPreceding, -1)
    return files.select("uri", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("start"), "n_docs", "n_ids")


def read_token_files(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files."""

    def run(batches):
        for batch in batches:
            for uri, start in zip(batch.column("uri").to_pylist(), batch.column("start").to_pylist(), strict=True):
                data = store.read_all(uri)
                (n,) = struct.unpack_from("<Q", data, 4)
                names, nulls = np.frombuffer(data, "<i8", n, 12), np.frombuffer(data, np.uint8, n, 12 + 8 * n)
                lengths = np.frombuffer(data, "<u8", n, 12 + 9 * n).astype(np.int64)
                codes, at = Dac(data, 12 + 17 * n), np.concatenate([[0], np.cumsum(lengths)])
                crcs = [zlib.crc32(codes.slice(lo, hi).tobytes()) for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(names, mask=nulls.astype(bool)), "start": pa.array(start + at[:-1]), "n_tokens": pa.array(lengths), "ids_crc32": pa.array(crcs, pa.int64())})

    spread = files.repartition(4 * files.sparkSession.sparkContext.defaultParallelism)
    return spread.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op7_dac(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return read_token_files(write_token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")))
