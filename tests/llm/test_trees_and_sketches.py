"""Merkle manifest, conversation trie and bottom-k sketches: against plain versions, SQL, and odd inputs."""

from __future__ import annotations

import random
import zlib
from collections import defaultdict
from hashlib import sha256

import numpy as np
import oracle
import pytest
from pyspark.sql import functions as F

from basalt.llm import merkle, sketches, trie

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string, place int, leaf string, root int, tree int, uid long, digest string"
LONG = "wörd Other tokens, 12 ab. " * 4000


def extended(rows):
    return [(*r, "z", 1, "l", 2, 3, 4, "d") for r in rows]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(1, "The cat sat on the mat.", "en", "b", 23), (1, "The cat sat on the mat.", "en", "b", 23), (2, None, None, None, None), (3, "", "en", "a", 0), (None, "no id here at all", None, "a", 17), (None, None, None, None, None), (5, LONG, "de", "a", len(LONG)), (6, "   ", "", "", 3), (7, "ÉTÉ\u0000 x", "fr", "b", 6), (1, "Another text of one id.", "en", "c", None)]
    return spark.createDataFrame(extended(rows), DOCS)


def H(*parts: str) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def grown(leaves: list[str]) -> list[list[str]]:
    levels = [leaves]
    while len(levels[-1]) > 1:
        now = levels[-1]
        levels.append([H(*now[i : i + 2]) for i in range(0, len(now), 2)])
    return levels


def plain_manifest(rows):
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, more=0: H(*(field(v) for v in (r[0], r[3], r[2], None if r[4] is None else r[4] + more, r[1])))
    first = lambda v: (v is not None, v if v is not None else 0)
    trees = defaultdict(list)
    for r in rows:
        trees[r[2]].append(r)
    names = sorted(trees, key=lambda n: (n is not None, (n or "").encode()))
    levels = {n: grown([leaf(r) for r in sorted(trees[n], key=lambda r: (first(r[0]), leaf(r)))]) for n in names}
    top = grown([levels[n][-1][0] for n in names])
    out = []
    for t, n in enumerate(names):
        for i, r in enumerate(sorted(trees[n], key=lambda r: (first(r[0]), leaf(r)))):
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            now, proof = leaf(r, 1 if hit else 0), []
            for at, tree in ((i, levels[n]), (t, top)):
                for level in tree[:-1]:
                    if at ^ 1 < len(level):
                        proof.append(level[at ^ 1])
                        now = H(proof[-1], now) if at & 1 else H(now, proof[-1])
                    else:
                        now = H(now)
                    at >>= 1
            out.append((r[0], leaf(r), levels[n][-1][0], top[-1][0], H(*proof), now, now == top[-1][0]))
    return out


@pytest.mark.parametrize("levels", [1, 2, 12])
def test_manifest_equals_a_plain_one(spark, levels):
    rows = [(i if i % 9 else None, f"text {i % 30}", None if i % 11 == 0 else f"l{i % 5}", None if i % 4 == 0 else "s", None if i % 6 == 0 else i) for i in range(83)] + [(5, "again", "l0", "s", 5)] * 3
    got = merkle.document_manifest(spark.createDataFrame(extended(rows), DOCS), levels)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, plain_manifest(rows)))


def test_manifest_of_odd_tables(odd):
    rows = [tuple(r)[:5] for r in odd.collect()]
    assert sorted(map(repr, map(tuple, merkle.document_manifest(odd).collect()))) == sorted(map(repr, plain_manifest(rows)))
    assert merkle.document_manifest(odd.limit(0)).count() == 0
    one = merkle.document_manifest(odd.where("doc_id = 5")).first()
    assert one["leaf"] == one["subroot"] == one["root"] and one["proof_sha256"] == sha256(b"").hexdigest() and one["verified"] == (one["folded_root"] == one["root"])


def plain_trie(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            symbol = f"{len(role.encode())}:{role}{text}"
            own[conv].append((turn is not None, turn or 0, __import__("hashlib").md5(symbol.encode()).digest(), role, text))
    own = {c: [(t[3], t[4]) for t in sorted(ts)] for c, ts in own.items()}
    whole = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        whole[c] = own.get(c - int(np.fmod(c, 20)), [])[:h] + ts[h:]
    nodes = defaultdict(list)
    for c, ts in whole.items():
        for d in range(len(ts) + 1):
            nodes[tuple(ts[:d])].append(c)
    kids = defaultdict(set)
    for path in nodes:
        if path:
            kids[path[:-1]].add(path)
    out = []
    for path, members in nodes.items():
        below = [q for q in nodes if q[: len(path)] == path]
        ends = sorted(c for c in members if len(whole[c]) == len(path))
        words = lambda q: len([w for w in __import__("re").split("[\x20\x09-\x0d]+", q[-1][1]) if w]) if q else 0
        out.append((min(members), len(path), min(nodes[path[:-1]]) if path else None, len(members), len(kids[path]), sum(not kids[q] for q in below), sum((len(nodes[q]) - 1) * words(q) for q in below), sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out, key=repr)


def talks(seed, n):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-10, n * 2), n):
        for t in range(rng.choice([1, 1, 2, 3, 4, 6])):
            rows.append((c, t if rng.random() < 0.9 else None, rng.choice(["user", "bot", None]), rng.choice(["hi", "hi there", "", None, "what is it", "ok　x y"])))
    rows += [(c, t, "user", "the same") for c in range(1000, 1000 + n // 3) for t in range(5)]
    return rows + [(None, 1, "user", "lost"), (3, 1, "user", "hi"), (3, 1, "user", "hi")]


@pytest.mark.parametrize("seed,n,block", [(1, 40, 4096), (2, 60, 4), (3, 90, 5), (4, 200, 16)])
def test_trie_equals_a_plain_one(spark, seed, n, block):
    rows = talks(seed, n)
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, depth int, seq string").repartition(3)
    got = trie.conversation_trie(df, block)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain_trie(rows)


def test_trie_of_small_tables(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert trie.conversation_trie(spark.createDataFrame([], schema)).count() == 0
    long = [(7, k, "user", "word " * 2000 if k == 3 else str(k)) for k in range(500)]
    got = {r["depth"]: r for r in trie.conversation_trie(spark.createDataFrame(long, schema)).collect()}
    assert len(got) == 501 - zlib.crc32(b"7") % 4 and got[0]["n_convs"] == 1 and got[0]["saved_tokens"] == 0 and got[0]["n_leaves"] == 1
    assert trie.conversation_trie(spark.createDataFrame([(None, 1, "a", "b")], schema)).count() == 0


def test_sparse_table_reaches(spark):
    rng = np.random.default_rng(3)
    values = rng.integers(0, 4, 77)
    minima = trie.Minima(values)
    start = np.repeat(np.arange(78), 5)
    depth = np.tile(np.arange(5), 78)
    for step in (1, -1):
        want = []
        for s, d in zip(start, depth):
            n, at = 0, s if step > 0 else s - 1
            while 0 <= at < 77 and values[at] >= d:
                n, at = n + 1, at + step
            want.append(n)
        assert minima.reach(start, depth, step).tolist() == want


def plain_groups(rows, percent=85):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for _, text in rows:
        w = (text or "").translate(low).encode().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(i)
    out = []
    for members in groups.values():
        ids = [rows[i][0] for i in members if rows[i][0] is not None]
        for i in members:
            c = min(ids) if ids else None
            out.append((rows[i][0], len(sets[i]), c, rows[i][0] == c))
    return sorted(out, key=repr)


def near_texts(seed, n, words):
    rng = random.Random(seed)
    made = [[f"{rng.choice('abcdefgh')}{rng.randrange(400)}" for _ in range(words)] for _ in range(n)]
    rows = []
    for k, base in enumerate(made):
        for copy in range(rng.choice([1, 1, 2, 6])):
            text = list(base)
            for _ in range(copy * max(1, words // 150)):
                text[rng.randrange(words)] = f"x{rng.randrange(10**6)}"
            rows.append((len(rows) * 3 % 1009, " ".join(text).upper() if copy == 2 else " ".join(text)))
    return rows


@pytest.mark.parametrize("seed,n,words,limit", [(1, 30, 300, 20_000), (2, 25, 40, 20_000), (3, 30, 120, 3), (4, 20, 9, 4)])
def test_sketch_groups_equal_plain_ones(spark, seed, n, words, limit):
    rows = near_texts(seed, n, words)
    got = sketches.near_sets(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), limit=limit)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain_groups(rows)


def test_one_common_passage_and_one_large_group(spark):
    """Documents that share half of their words with all others, and a chain of near copies, under tiny runs."""
    rng = random.Random(5)
    common = [f"c{i}" for i in range(60)]
    rows = [(i, " ".join(common + [f"w{rng.randrange(10**6)}" for _ in range(60)])) for i in range(60)]
    chain = [f"k{i}" for i in range(400)]
    for i in range(60):
        chain = list(chain)
        chain[rng.randrange(400)] = f"z{i}"
        rows.append((1000 + i, " ".join(chain)))
    got = sketches.near_sets(spark.createDataFrame(rows, "doc_id long, text string"), limit=7)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain_groups(rows)


def test_sketches_of_odd_tables(odd):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    got = {tuple(r) for r in sketches.near_sets(odd).collect()}
    assert {(1, 2, 1, True), (2, 0, 2, True), (3, 0, 3, True), (6, 0, 6, True), (7, 1, 7, True), (None, 0, None, True), (None, 1, None, True)} <= got
    assert sketches.near_sets(odd).count() == len(rows) and sketches.near_sets(odd.limit(0)).count() == 0


def test_least_shared_leaves_out_almost_none():
    assert sketches.least_shared(64, 85) == 34 and sketches.least_shared(10, 100) == 10
    rng = np.random.default_rng(1)
    assert (rng.binomial(64, 0.85, 200_000) >= 34).all()


@pytest.mark.parametrize("name,query,sql", [("op11", merkle.op11_merkle, merkle.SQL), ("op12", trie.op12_trie, trie.SQL), ("op13", sketches.op13_minhash, sketches.SQL)])
def test_queries_equal_sql(spark, sf, name, query, sql):
    n, differs = oracle.compare(spark, oracle.connect(sf), query, sql, sf)
    assert n and not differs


def test_manifest_is_tampered_where_it_says(spark, sf):
    got = merkle.op11_merkle(spark, sf)
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    assert got.where(hit & F.col("verified")).isEmpty() and got.where(~hit & ~F.col("verified")).isEmpty() and not got.where(hit).isEmpty()
