"""Operator 13 against its SQL, a plain trie in Python, and hard rows."""

import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import pytest

from ambulo.llm import prefixes


def plain_trie(rows):
    """The nodes by the definition; turns of one number must be told apart by the caller."""
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v)] for c, v in own.items()}
    members = defaultdict(list)
    ends = defaultdict(list)
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        seq = (*own.get(base, [])[:h], *turns[h:])
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
        ends[seq].append(c)
    kids = defaultdict(list)
    for k in members:
        if k:
            kids[k[:-1]].append(k)
    leaves, saved = {}, {}
    for k in sorted(members, key=len, reverse=True):
        leaves[k] = sum(leaves[x] for x in kids[k]) or 1
        saved[k] = sum(saved[x] for x in kids[k]) + (len(members[k]) - 1) * (len(k[-1][1]) if k else 0)
    return sorted((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), len(kids[k]), leaves[k], saved[k], hashlib.sha256(",".join(map(str, sorted(ends[k]))).encode()).hexdigest()) for k, m in members.items())


def got(df):
    rows = df.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()
    return sorted(map(tuple, rows), key=lambda r: (r[0], r[1]))


def made(seed):
    """Families, shared and copied tails, one long conversation, snapshots that grow, and a comb of side branches."""
    rng = random.Random(seed)
    rows = []
    for c in [*range(0, 12), *range(100, 130), 205, 207, 300, 301, 302, -5, -100, -101]:
        for t in range(rng.randint(1, 9)):
            rows.append((c, t, rng.choice(["user", "assistant"]), rng.choice("abc") * rng.randint(0, 2)))
    rows += [(c, t, "user", f"copy {t}") for c in range(1000, 1040) for t in range(7)]
    rows += [(400, t, "user", f"t{t % 7}") for t in range(60)]
    rows += [(c, t, "user", f"s{t}") for c in range(2000, 2025) for t in range(c - 1999)]
    rows += [(c, t, "user", f"comb{t}" if t < c - 2300 else f"side {c}") for c in range(2300, 2325) for t in range(c - 2299)]
    return rows


@pytest.mark.parametrize("seed, chunk, fan, ends", [(1, 4096, 64, 13), (2, 3, 2, 2), (3, 16, 3, 4)])
def test_equals_a_plain_trie(spark, monkeypatch, seed, chunk, fan, ends):
    for name, value in (("CHUNK", chunk), ("FAN", fan), ("ENDS", ends)):
        monkeypatch.setattr(prefixes, name, value)
    rows = made(seed)
    random.Random(seed).shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    want = plain_trie(rows)
    assert got(prefixes.prefix_trie(df)) == sorted(want, key=lambda r: (r[0], r[1]))


def test_query_equals_its_sql(spark):
    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{d}/conversations.parquet'")
    want = con.sql(f"SELECT conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 FROM ({prefixes.OP13_SQL})").fetchall()
    assert want and got(prefixes.op13_prefix_trie(spark, d)) == sorted(want, key=lambda r: (r[0], r[1]))


def test_hard_rows(spark):
    least, most = -(1 << 63), (1 << 63) - 1
    rows = [
        (None, 0, "user", "lost"), (least, None, None, None), (least, 1, "user", "x" * 100_000), (most, 5, None, "é𐍈"), (most, 6, "", "é𐍈"), (7, 0, "user", "only"), (7, 0, "user", "only"),
        (100, None, "user", "a"), (100, 0, "user", "b"), (101, 0, "user", "a"), (101, 1, "user", "b"), (199, 3, "u", "ser"), (199, 4, "us", "er"),
    ]
    df = spark.createDataFrame([(*r, 1, "k") for r in rows], "conv_id long, turn long, role string, text string, depth int, key1 string")
    assert got(prefixes.prefix_trie(df)) == sorted(plain_trie(rows), key=lambda r: (r[0], r[1]))
    assert prefixes.prefix_trie(df.where("false")).count() == 0
