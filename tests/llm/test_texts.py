"""Packing, mixing, near copies, language, personal data, fingerprints: against plain versions, and odd inputs."""

from __future__ import annotations

import hashlib
import random
import re
import unicodedata
import zlib
from array import array
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from basalt.llm import fingerprints as fp
from basalt.llm import jaccard, langid, mixing, neardup, packing, pii, simhash
from basalt.llm import pipeline as corpus_pipeline
from basalt.llm.tokens import WordCache

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, bits int, spans int, score string, h int, label int"
LONG = "wörd Other tokens, 12 ab. " * 4000


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, columns with clashing names."""
    rows = [(1, "The cat sat on the mat.", "en", "b", 23), (1, "The cat sat on the mat.", "en", "b", 23), (2, None, None, None, None), (3, "", "en", "a", 0), (None, "no id here at all", None, "a", 17), (5, LONG, "de", "a", len(LONG)), (6, "   ", "", "", 3), (7, "ÉTÉ\u0000 x", "fr", "b", 6)]
    return spark.createDataFrame([(*r, "z", 1, 2, "s", 3, 1) for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def empty(odd):
    return odd.limit(0)


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(packing.default_tokenizer())


def test_word_cache_equals_the_tokenizer(docs):
    t, cache = tokenizer(), WordCache(packing.default_tokenizer(), limit=50)
    texts = [r["text"] for r in docs.limit(40).collect()] + ["İstanbul ΣΑΣ ﬁ don't I'LL 12ab <|endoftext|> a\x1cb a\x85b x", "日本語 ­ soft­hy ǅ ŉ", "é a b"]
    for x in texts:
        assert cache.encode(x) == array("I", t.encode(x, add_special_tokens=False).ids).tobytes()


def test_words_of_plain_texts_are_encoded_once():
    t, cache = tokenizer(), WordCache(packing.default_tokenizer())
    asked, make = [], cache._words._make
    cache._words._make = lambda word: asked.append(word) or make(word)
    for x in ("Thrennish, thrennish. THRENNISH! (thrennish)", "thrennish Ünd ünd, thrennish's"):
        assert cache.encode(x) == array("I", t.encode(x, add_special_tokens=False).ids).tobytes()
    assert asked.count("thrennish") == asked.count("ünd") == 1 and not cache._chunks
    for k in range(0x250):
        for x in (f"a{chr(k)}b 1{chr(k)}", f"'{chr(k)}{chr(k)}"):
            assert cache.encode(x) == array("I", t.encode(x, add_special_tokens=False).ids).tobytes(), hex(k)


def check_packing(rows, wanted):
    """``wanted``: multiset of the id lists of all documents."""
    t = defaultdict(list)
    sequences = defaultdict(list)
    for r in rows:
        t[r["doc_id"]].append((r["start"], bytes(r["ids"]), r["doc_tokens"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"], r["sequence_tokens"], r["sequence_length"]))
        assert len(r["ids"]) == 4 * r["length"] > 0
    for parts in sequences.values():
        at = 0
        for offset, n, _, _ in sorted(parts):
            assert offset == at
            at += n
        assert all(p[2] == at <= 4096 and p[3] == (at if at & (at - 1) == 0 else 4096) for p in parts)
    got = sorted((d, b"".join(x for _, x, _ in sorted(parts))) for d, parts in t.items() if d not in (1, None))
    assert got == sorted((d, x) for d, x in wanted if d not in (1, None))
    assert sum(4 * r["length"] for r in rows) == sum(len(x) for _, x in wanted)
    padding = sum(p[0][3] - p[0][2] for p in sequences.values())
    assert padding == 0


def test_packing_round_trip_and_padding(docs, odd, empty):
    t = tokenizer()
    for df in (docs, odd):
        wanted = [(r["doc_id"], array("I", [*t.encode(r["text"] or "", add_special_tokens=False).ids, 2]).tobytes()) for r in df.collect()]
        check_packing(packing.pack_documents(df, shard_tokens=50_000).collect(), wanted)
    assert packing.pack_documents(empty).count() == 0
    with pytest.raises(ValueError):
        packing.pack_documents(odd, tiers=(300, 4096))


def test_step_groups_are_balanced():
    sizes = [4096] * 40 + [256] * 100
    loads = defaultdict(int)
    for n, g in zip(sizes, packing.balance(sizes, 1 << 15)):
        loads[g] += n
    assert max(loads.values()) - min(loads.values()) <= 256


def test_apportionment_is_by_highest_quotients():
    r = random.Random(1)
    for _ in range(200):
        votes, seats = [r.randint(0, 1000) for _ in range(r.randint(1, 8))], r.randint(0, 60)
        if not sum(votes):
            continue
        plain = [0] * len(votes)
        for _ in range(seats):
            i = max(range(len(votes)), key=lambda i: (votes[i] / (2 * plain[i] + 1), -i))
            plain[i] += 1
        got = mixing.sainte_lague([float(v) for v in votes], seats)
        assert sum(got) == seats
        assert sorted(v / (2 * k - 1) for v, k in zip(votes, got) if k) == sorted(v / (2 * k - 1) for v, k in zip(votes, plain) if k) or got == plain


def plain_targets(sizes, weights):
    goal, capped = {}, set()
    while True:
        left = 1.5 * sum(sizes) - sum(2 * sizes[i] for i in capped)
        w = sum(weights[i] for i in range(len(sizes)) if i not in capped)
        goal = {i: 2.0 * sizes[i] if i in capped else left * weights[i] / w for i in range(len(sizes))}
        over = {i for i in goal if goal[i] > 2 * sizes[i] + 1e-9}
        if not over:
            return [goal[i] for i in range(len(sizes))]
        capped |= over


def test_mixture(docs, odd, empty):
    for df in (docs, odd):
        rows = mixing.mix_sources(df).collect()
        assert len(rows) == df.count() and mixing.mix_sources(df).columns[: len(df.columns)][0] == "doc_id"
        words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
        sizes = defaultdict(int)
        for r in rows:
            assert r["size"] == words(r["text"]) and 0 <= r["taken"] <= 2 * r["size"]
            sizes[r["source"]] += r["size"]
        names = sorted(sizes, key=lambda s: (s is None, s or ""))
        goal = dict(zip(names, plain_targets([sizes[s] for s in names], [(5, 2, 1)[i % 3] for i in range(len(names))])))
        for s in names:
            taken = sum(r["taken"] for r in rows if r["source"] == s)
            assert abs(taken - goal[s]) <= 64 + 0.02 * goal[s]
            assert all(r["source_size"] == sizes[s] and abs(r["target"] - goal[s]) < 1e-6 for r in rows if r["source"] == s)
        assert sorted(r["taken"] for r in rows) == sorted(r["taken"] for r in mixing.mix_sources(df.repartition(3)).collect())
        texts = mixing.mixed_documents(df)
        assert texts.columns == df.columns
        assert sum(words(r["text"]) for r in texts.collect()) == sum(r["taken"] for r in rows)
    assert mixing.mix_sources(empty).count() == 0


def plain_groups(ids, bits):
    near = np.bitwise_count(bits[:, None] ^ bits[None, :]) <= 4
    label = np.arange(len(bits))
    while True:
        new = np.array([label[near[i]].min() for i in range(len(bits))])
        if (new == label).all():
            break
        label = new
    least = {}
    for k, i in zip(label, ids):
        least[k] = min(least.get(k, i), i)
    return [least[k] for k in label]


def test_near_copies_equal_brute_force(docs, odd, empty):
    rows = simhash.near_duplicates(docs).collect()
    assert plain_groups([r["doc_id"] for r in rows], np.array([r["bits"] for r in rows], np.int64).view(np.uint64)) == [r["component_id"] for r in rows]
    got = {r["doc_id"]: (r["bits"], r["component_id"]) for r in simhash.near_duplicates(odd).collect()}
    assert got[2] == got[3] == got[6] == (0, 2) and got[1][1] == 1
    assert simhash.near_duplicates(odd).count() == 8 and simhash.near_duplicates(empty).count() == 0


def test_links_with_and_without_hot_keys(spark):
    rng = np.random.default_rng(3)
    centre = rng.integers(0, 1 << 63, 4)
    bits = sorted({int(c) ^ sum(1 << int(b) for b in rng.choice(63, rng.integers(0, 6), replace=False)) for c in centre for _ in range(150)})
    df = spark.createDataFrame([(b,) for b in bits], "bits long")
    want = plain_groups(bits, np.array(bits, np.int64).view(np.uint64))
    for limit in (20_000, 40):
        root = {r["node"]: r["root"] for r in simhash.components(simhash.near_links(df, limit)).collect()}
        found = defaultdict(list)
        for b in bits:
            found[root.get(b, b)].append(b)
        names = {b: min(own) for own in found.values() for b in own}
        assert [names[b] for b in bits] == want


def test_fuzzy_keys_meet_within_four_bits():
    rng = np.random.default_rng(0)
    u = rng.integers(0, 1 << 64, 400, dtype=np.uint64)
    v = u.copy()
    for i in range(len(v)):
        for b in rng.choice(64, rng.integers(0, 5), replace=False):
            v[i] ^= np.uint64(1) << np.uint64(b)
    sides = []
    for x in (u, v):
        own = defaultdict(dict)
        for row, key, asks in zip(*simhash.fuzzy_keys(x.view(np.int64))):
            own[row][key] = asks
        sides.append(own)
    assert all(any(k in sides[1][i] and 0 in (a, sides[1][i][k]) for k, a in sides[0][i].items()) for i in range(len(u)))


def plain_shingles(text):
    words = re.findall(r"[^ \t-\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain_similar(rows):
    """The smallest id of each row's group, by Jaccard similarity of all pairs."""
    sets = [plain_shingles(t) for _, t in rows]
    label = [i for i, _ in rows]
    linked = [(a, b) for a in range(len(rows)) for b in range(a) if sets[a] == sets[b] or 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]) > 0]
    while any(label[a] != label[b] for a, b in linked):
        for a, b in linked:
            label[a] = label[b] = min(label[a], label[b])
    return dict(zip((i for i, _ in rows), label))


def near_copies():
    """Texts of 30 to 300 words with copies that lack up to a sixth of them in one place or in several."""
    r = random.Random(5)
    rows = []
    for n in (30, 60, 120, 300) * 6:
        words = [f"{r.choice('abcdef')}{r.randrange(4000)}" for _ in range(n)]
        rows.append(words)
        for share in (0.02, 0.05, 0.08, 0.1, 0.12, 0.17):
            at, cut = r.randrange(n), max(1, int(share * n))
            rows.append(words[:at] + words[at + cut :])
            rows.append([w if r.random() > share / 5 else "other" for w in words])
    r.shuffle(rows)
    return [(i, " ".join(w)) for i, w in enumerate(rows)]


def test_similar_documents_equal_brute_force(spark, docs, odd, empty):
    own = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert {r["doc_id"]: r["component_id"] for r in neardup.similar_documents(docs).collect()} == plain_similar(own)
    rows = near_copies()
    rows += [(1000 + i, "one passage that all of these share word for word " * 2 + f"and {i} {i * i} {i + 7}") for i in range(30)] + [(2000, ""), (2001, None), (2002, "Two words"), (2003, "two  WORDS")]
    want, df = plain_similar(rows), spark.createDataFrame(rows, "doc_id long, text string")
    for limit, shuffles, fuzzy in ((20_000, 2, True), (8, 0, True), (8, 2, False)):
        assert {r["doc_id"]: r["component_id"] for r in neardup.similar_documents(df, limit=limit, shuffles=shuffles, fuzzy=fuzzy).collect()} == want
    got = {r["doc_id"]: r["component_id"] for r in neardup.similar_documents(odd).collect()}
    assert got[2] == got[3] == got[6] == 2 and got[1] == 1 and got[None] is None
    assert neardup.similar_documents(odd).count() == 8 and neardup.similar_documents(empty).count() == 0


def test_the_stage_drops_near_copies_beyond_four_bits(spark):
    rows = near_copies()
    want = plain_similar(rows)
    df = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert {r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, df, "").collect()} == set(want.values())


def test_fingerprint_links_alone_draw_copies_together(spark):
    rows = near_copies()
    sets = [jaccard.shingles(t) for _, t in rows]
    bits = [jaccard.majority_bits(s) for s in sets]
    ones = np.array([[int(h) >> b & 1 for b in range(64)] for h in sets[0]]).sum(axis=0) * 2 > len(sets[0])
    assert bits[0] & (2**64 - 1) == sum(1 << b for b in range(64) if ones[b]) and jaccard.majority_bits(sets[0][:0]) == 0


def test_large_runs_pair_only_what_is_apart():
    import pyarrow as pa

    rng = np.random.default_rng(9)
    n = 300
    key, size, own = np.sort(rng.integers(0, 3, n)), rng.integers(90, 111, n), np.arange(n)
    order = np.lexsort((size, key))
    key, size = key[order], size[order]
    root = np.where(rng.random(n) < 0.9, -1, own)
    columns = [*(pa.array(x) for x in (key, size.astype(np.int32), own, root, root != -1, np.ones(n, bool))), pa.array([b"\0" * 128] * n)]
    batch = pa.RecordBatch.from_arrays(columns, names=["key", "size", "digest", "root", "apart", "home", "parity"])
    got = {}
    for small in (2, 1000):
        pairs = [(a, b) for r in jaccard._pairs(0.8, small)(iter([batch.slice(0, 100), batch.slice(100, 150), batch.slice(250)])) for a, b in zip(r["a"].to_pylist(), r["b"].to_pylist())]
        got[small] = set(pairs)
    want = {(i, j) for i in range(n) for j in range(i + 1, n) if key[i] == key[j] and root[i] != root[j] and min(size[i], size[j]) >= 0.8 * max(size[i], size[j]) - 1e-9}
    assert got[2] == got[1000] == want


def test_parities_never_differ_more_than_their_sets():
    rng = np.random.default_rng(6)
    for _ in range(200):
        a = np.unique(rng.integers(0, 1 << 63, rng.integers(1, 400), dtype=np.uint64))
        b = np.unique(np.r_[a[rng.random(len(a)) < rng.random()], rng.integers(0, 1 << 63, rng.integers(0, 200), dtype=np.uint64)])
        p, q = (np.frombuffer(jaccard.parities(x), np.uint64) for x in (a, b))
        assert np.bitwise_count(p ^ q).sum() <= len(np.setxor1d(a, b))


def test_one_row_of_each_group_stays(spark):
    same, other = "one two three four five six seven eight nine ten", "another text that is not like the first one in any way"
    rows = [(5, same, "z"), (5, same, "a"), (5, other, "b"), (7, same + " eleven", "c"), (None, other, "d"), (None, "text without an id of its own", "e"), (9, None, "f"), (8, "", "g"), (3, "plain words that nobody else has used so far", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {tuple(r) for r in neardup.one_of_each(df).collect()}
    assert got == {(5, same, "a"), (5, other, "b"), (None, "text without an id of its own", "e"), (8, "", "g"), (3, "plain words that nobody else has used so far", None)}


def test_language(docs, odd, empty):
    split = docs.withColumn("held", F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1)
    dictionaries = langid.learn(split.where("not held"))
    rows = langid.identify(split.where("held"), dictionaries, ["doc_id", "lang"]).collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in rows]) >= 0.95
    got = {r["doc_id"]: r for r in langid.identify(odd, dictionaries, ["doc_id"]).collect()}
    assert all(got[k]["lang_pred"] == "und" and got[k]["rejected"] and got[k]["score"] == 0 for k in (2, 3, 6))
    assert got[1]["lang_pred"] in {name for name, _ in dictionaries}
    assert langid.learn(empty) == [] and langid.identify(empty, dictionaries, ["doc_id"]).count() == 0
    assert {r["lang_pred"] for r in langid.identify(odd, [], ["doc_id"]).collect()} == {"und"}


PATTERNS = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))


def plain_spans(text):
    out = []
    for k, (kind, pattern) in enumerate(PATTERNS):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            odd_sum = sum(d - 9 if d > 9 else d for d in (int(c) * (1 + i % 2) for i, c in enumerate(digits[::-1])))
            if kind == "ip" and max(map(int, m[0].split("."))) > 255 or kind == "card" and not (14 <= len(digits) <= 19 and odd_sum % 10 == 0) or kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            out.append((m.start(), k, m.end()))
    return sorted(out)


def test_spans_equal_the_patterns():
    r = random.Random(0)
    for _ in range(4000):
        text = "".join(r.choice("ab1.@ -_+(29%") for _ in range(r.randint(1, 60)))
        assert pii.base_spans(text) == plain_spans(text)
    assert pii.base_spans("x 4111 1111 1111 1111 a_b@c.d.e +1 (132) 555-1352 1.2.3.4.5.6.7.8") == plain_spans("x 4111 1111 1111 1111 a_b@c.d.e +1 (132) 555-1352 1.2.3.4.5.6.7.8")


def test_disclosing_terms_are_found_on_both_paths(spark, odd, empty):
    rows = [(i, f"note {i} from zorblax reach {'abcdef'[i] * 4} joe@x.example.com soon {i * 7}") for i in range(6)]
    rows += [(100 + i, f"plain soon note reach from text {i}") for i in range(200)] + [(999, "zorblax alone")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for limit in (200_000, 0):
        assert {r["term"] for r in pii.disclosing_terms(df, limit=limit).collect()} == {"zorblax"}
        got = {r["doc_id"]: r for r in pii.find_personal_data(df, ["doc_id"], limit=limit, remove_at=0.95).collect()}
        assert got[999]["clean_text"] == "<TERM> alone" and [tuple(s) for s in got[999]["spans"]] == [("term", 0, 7)]
        assert got[100]["clean_text"] == rows[6][1] and "joe@" not in got[1]["clean_text"]
    got = {r["doc_id"]: r for r in pii.find_personal_data(odd, ["doc_id"]).collect()}
    assert got[2]["clean_text"] is None and got[2]["spans"] == [] and got[3]["clean_text"] == "" and got[5]["clean_text"] == LONG
    assert pii.find_personal_data(empty, ["doc_id"]).count() == 0


def canonical(text):
    nfc = lambda x: unicodedata.normalize("NFC", x)
    return re.sub(r"\s+", " ", nfc(nfc(text).casefold())).strip()


def plain_digests(rows):
    rows = sorted(rows, key=lambda r: -r[0])
    texts = [t or "" for _, t in rows]
    after = texts[1:] + texts[:1]
    edits = [a[: len(a) - len(a) // 3] + b[: len(a) // 3] for a, b in zip(texts, after)]
    return {i: (len(t), hashlib.sha256(e.encode()).hexdigest(), float(canonical(t) == canonical(e)), float(canonical(t) == canonical(n)), canonical(t)) for (i, _), t, e, n in zip(rows, texts, edits, after)}


def check_digests(df):
    want = plain_digests([(r["doc_id"], r["text"]) for r in df.collect()])
    rows = fp.fingerprints(df).collect()
    names = defaultdict(set)
    for r in rows:
        assert (r["n_chars"], r["edited_sha256"], r["near_edited"], r["near_next"]) == want[r["doc_id"]][:4]
        names[want[r["doc_id"]][4]].add(r["fingerprint"])
    assert len(rows) == len(want) and all(len(n) == 1 for n in names.values()) and len(set.union(*names.values())) == len(names)


def test_fingerprints(spark, docs, odd, empty, monkeypatch):
    check_digests(docs)
    few = spark.createDataFrame([(1, "Straße  É"), (2, "strasse é"), (3, None), (5, ""), (9, "ab"), (12, "AB "), (14, "abc"), (20, "xyz")], "doc_id long, text string")
    check_digests(few)
    assert fp.fingerprints(odd).count() == 8 and fp.fingerprints(empty).count() == 0
    assert fp.fingerprints(few.where("doc_id = 9")).first()["near_next"] == 1.0
    monkeypatch.setattr(fp, "digest", lambda canon: F.concat(F.lit("same"), (F.char_length(canon) % 2).cast("string")))
    check_digests(few)


def test_fingerprints_in_many_ranges(docs, spark):
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    got = {r["doc_id"]: r["next_id"] for r in fp.neighbours(base, F.lit("x"), per_range=7).collect()}
    ids = sorted(got, reverse=True)
    assert got == dict(zip(ids, ids[1:] + ids[:1]))


def test_colliding_digests_of_repeated_and_missing_ids(spark, monkeypatch):
    rows = [(1, "aa"), (1, "bb"), (1, "aa"), (1, "cc"), (None, "dd"), (None, "ee"), (None, "dd"), (2, "ff"), (2, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(fp, "digest", lambda canon: F.concat(F.lit("same"), F.char_length(canon).cast("string")))
    got = fp.fingerprints(df).collect()
    assert len(got) == len(rows) and sorted(r["doc_id"] or 0 for r in got) == sorted(i or 0 for i, _ in rows)
    assert len({r["fingerprint"] for r in got}) == len({t or "" for _, t in rows})
    assert sum(r["near_next"] for r in got) == 2  # of equal texts with one id, both pairs stand side by side
    chained = fp.neighbours(df.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), F.col("text"), per_range=1).collect()
    assert sorted((r["doc_id"] or 0, r["own"]) for r in chained) == sorted((r["next_id"] or 0, r["next_own"]) for r in chained)


def test_places_among_many_bounds(spark):
    bounds = list(range(0, 9000, 3))
    values = [-5, 0, 1, 2, 3, 767, 768, 769, 771, 8996, 8997, 8998, 10**9]
    df = spark.createDataFrame([(v,) for v in values], "v long")
    assert [r[0] for r in df.select(fp._at(bounds, F.col("v"))).collect()] == [sum(b < v for b in bounds) for v in values]


def test_terms_are_cut_alike_on_both_paths(spark):
    rows = [(i, f"note {i} abc½def x²yz ⅷabc zorblax {'abcdef'[i] * 4} joe@x.example.com soon İstanbul {i * 7}") for i in range(6)] + [(100 + i, f"plain soon note {i}") for i in range(200)]
    rows += [(900, "abc½def x²yz ⅷabc zorblax"), (900, "abc½def x²yz ⅷabc zorblax"), (None, "abc½def"), (901, None), (902, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [sorted((r["doc_id"] or 0, r["clean_text"] or "", str(r["spans"])) for r in pii.find_personal_data(df, ["doc_id", "text"], limit=limit, slots=4).collect()) for limit in (200_000, 0)]
    assert got[0] == got[1] and len(got[0]) == len(rows) and any("<TERM>" in t for _, t, _ in got[0])


def test_terms_near_a_span_are_whole_words():
    text = "x" * 30 + " alpha beta joe@x.com gamma " + "y" * 300
    at = text.index("joe@")
    assert pii.terms_near(text, at, at + 9, 5, 20) == ["alpha", "beta", "gamma", "y" * 300]
    assert pii.entities(0, "Joe@X.com") == ["email:joe@x.com", "email~x.com"] and pii.entities(1, "10.2.3.4")[1] == "ip~10.2"


def plain_terms(rows, alpha=1.1, support=3, window=5):
    """Disclosing terms by their definition, for short texts."""
    import math

    held, docs, around = defaultdict(set), defaultdict(set), defaultdict(set)
    for k, (_, text) in enumerate(rows):
        for w in {w.lower() for w in pii._TERM.findall(text or "")}:
            docs[w].add(k)
        near = defaultdict(set)
        for a, kind, b in pii.base_spans(text or ""):
            for e in pii.entities(kind, text[a:b]):
                near[e] |= {w.lower() for w in [*pii._TERM.findall(text[:a])[-window:], *pii._TERM.findall(text[b:])[:window]]}
        for e, own in near.items():
            held[e].add(k)
            for w in own:
                around[e, w].add((k, tuple(sorted(own))))
    out = {}
    for (e, w), seen in around.items():
        info = math.log(len(rows) / len(held[e]))
        share = len(seen) / len(docs[w])
        if len({s for _, s in seen}) >= support and info > 0 and math.log(share * len(rows) / len(held[e])) >= info / alpha:
            out[w] = max(out.get(w, 0), share)
    return out


def test_disclosing_terms_equal_their_definition(spark):
    r = random.Random(4)
    words = [f"word{c}" for c in "abcdefghijklmnopqrst"]
    rows = [(i, " ".join(r.choices(words, k=6)) + (f" {r.choice(['zorblax', 'quux', 'wordc'])} {r.choice(['joe', 'amy'])}@mail{r.randrange(3)}.net " if i % 4 == 0 else " ") + " ".join(r.choices(words, k=4))) for i in range(160)]
    got = {t["term"]: t["share"] for t in pii.disclosing_terms(spark.createDataFrame(rows, "doc_id long, text string"), alpha=3.0).collect()}
    want = plain_terms(rows, alpha=3.0)
    assert got.keys() == want.keys() and len(want) > 0 and all(abs(got[w] - want[w]) < 1e-9 for w in want)


def test_kept_columns_may_be_named_like_added_ones(spark, odd):
    named = odd.withColumns({"lang_pred": F.lit("x"), "rejected": F.lit("x"), "predicted": F.lit("x"), "clean_text": F.lit("x")})
    dictionaries = langid.learn(odd)
    assert langid.identify(named, dictionaries, ["doc_id", "lang_pred", "score", "rejected"]).columns == ["doc_id", "lang_pred", "score", "rejected"]
    assert pii.find_personal_data(named, ["doc_id", "spans", "clean_text"]).columns == ["doc_id", "spans", "clean_text"]
    from basalt.llm import quality, toxicity

    labels = spark.createDataFrame([(1, 1), (3, 0)], "doc_id long, label int")
    for module, score in ((quality, quality.score_quality), (toxicity, toxicity.score_toxicity)):
        rows = score(named, module.fit(odd, labels), ["doc_id", "score", "predicted"])
        assert rows.columns == ["doc_id", "score", "predicted"] and rows.count() == 8


def test_the_sample_of_a_language_is_the_same_in_every_run(spark):
    rows = [(7, f"text number {i} of one id", "en") for i in range(900)] + [(i, "ein anderer text", "de") for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert langid.learn(df.repartition(7), sample_docs=8) == langid.learn(df.repartition(3), sample_docs=8)


def test_short_clean_texts_are_told(spark, docs):
    own = langid.identify(docs.select(F.substring_index("text", " ", 6).alias("text"), "lang"), langid.learn(docs), ["lang"]).where("lang is not null")
    assert own.where("rejected").count() <= 0.2 * own.count()


def test_the_pipeline_takes_odd_inputs(spark, odd):
    columns = list(corpus_pipeline.COLUMNS)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, odd, "").columns == columns
    assert {r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, odd, "").collect()} == {1, 2, None, 5, 7}
    assert corpus_pipeline.remove_personal_data(spark, odd, "").count() == 8
    assert corpus_pipeline.pack(spark, odd, "").agg(F.sum("length")).first()[0] > 8


def test_crc_folds(spark):
    from basalt.llm.common import crc32_mod

    df = spark.createDataFrame([(i,) for i in range(50)], "doc_id long")
    assert [r[0] for r in df.select(crc32_mod("doc_id", 5)).collect()] == [zlib.crc32(str(i).encode()) % 5 for i in range(50)]
