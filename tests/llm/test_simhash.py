"""SimHash groups against brute force over all pairs."""

from __future__ import annotations

import random
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import simhash


def fingerprint(text):
    """A direct reading of the definition, bit by bit."""
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for blank in "\t\n\x0b\x0c\r":
        words = words.replace(blank, " ")
    words = [w for w in words.split(" ") if w]
    shingles = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(prints, distance):
    root = list(range(len(prints)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(prints)):
        for b in range(a):
            if bin(prints[a] ^ prints[b]).count("1") <= distance:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return [find(k) for k in range(len(prints))]


def near_texts():
    rng = random.Random(4)
    base = [[rng.choice("abcdefghij") * rng.randint(1, 4) for _ in range(n)] for n in (3, 40, 120, 200)]
    texts = [None, "", " \n", "A", "a", "a b", "Ä b c d", "ä b c d"]
    for words in base:
        for _ in range(12):
            copy = list(words)
            for _ in range(rng.randint(0, 2)):
                copy[rng.randrange(len(copy))] = rng.choice("klm")
            texts.append(rng.choice((" ", "\t", "  ")).join(copy))
    return texts


def test_near_duplicates_equal_brute_force(documents):
    texts = near_texts()
    prints = [fingerprint(t) for t in texts]
    got = {r["doc_id"]: (r["fp"] % 2**64, r["component_id"]) for r in simhash.near_duplicates(documents(texts)).collect()}
    assert got == {k: (p, c) for k, (p, c) in enumerate(zip(prints, groups(prints, 3), strict=True))}
    assert prints[0] == prints[1] == prints[2] == 0


def test_links_cover_all_distances_up_to_three(spark):
    rng = random.Random(1)
    base = [rng.getrandbits(64) for _ in range(20)]
    prints = {0, 2**64 - 1, 2**63, *base}
    for p in base:
        for n in range(1, 6):
            for _ in range(6):
                prints.add(p ^ sum(1 << b for b in rng.sample(range(64), n)))
    signed = sorted(p - 2**64 if p >= 2**63 else p for p in prints)
    got = {(r["a"], r["b"]) for r in simhash.links(spark.createDataFrame([(p,) for p in signed], "fp bigint")).collect()}
    want = {(a, b) for a in signed for b in signed if a < b and bin((a ^ b) & (2**64 - 1)).count("1") <= 3}
    assert got == want and any(bin((a ^ b) & (2**64 - 1)).count("1") == 3 for a, b in want)


def test_components_follow_long_chains(spark):
    chain = [(k, k + 1) for k in range(100, 160)] + [(7, 900), (900, 8), (1, 1)]
    random.Random(3).shuffle(chain)
    got = {r["node"]: r["root"] for r in simhash.components(spark.createDataFrame(chain, "a bigint, b bigint")).collect()}
    assert got == {k: 100 for k in range(100, 161)} | {7: 7, 8: 7, 900: 7}


def test_odd_rows(spark, odd_documents):
    got = simhash.near_duplicates(odd_documents.withColumnRenamed("lang", "fp")).collect()
    assert len(got) == 8
    assert {r["component_id"] for r in got if r["fp"] == 0} == {1}
    assert [r["component_id"] for r in got if r["doc_id"] is None] == [None]
    kept = sorted((r["doc_id"] or 0) for r in simhash.deduplicated(odd_documents).collect())
    assert kept == [0, 1, 3, 4, 5]
    assert simhash.near_duplicates(odd_documents.limit(0)).count() == 0


def words_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def near_groups(texts, similarity=0.8):
    """Smallest position of each text's group: links by the Jaccard similarity of five-word shingles."""
    lead = list(range(len(texts)))

    def top(k):
        while lead[k] != k:
            k = lead[k]
        return k

    sets = [words_set(t) for t in texts]
    for b in range(len(texts)):
        for a in range(b):
            union = len(sets[a] | sets[b])
            if union == 0 or len(sets[a] & sets[b]) >= similarity * union:
                low, high = sorted((top(a), top(b)))
                lead[high] = low
    return [top(k) for k in range(len(texts))]


def test_near_copies_of_edited_texts(spark, documents):
    rng = random.Random(5)
    texts = []
    for _ in range(40):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(60, 400))]
        texts.append(" ".join(words))
        for share in (0.004, 0.01, 0.015, 0.1, 0.3):
            texts.append(" ".join("x" if rng.random() < share else w for w in words))
    want, docs = near_groups(texts), documents(texts)
    got = {r["doc_id"]: r["root"] for r in simhash.near_copies(docs).collect()}
    pairs = [(a, b) for a in range(len(texts)) for b in range(a) if want[a] == want[b]]
    assert len(pairs) > 100 and np.mean([got[a] == got[b] for a, b in pairs]) > 0.95
    assert all(want[a] == want[b] for a in range(len(texts)) for b in range(a) if got[a] == got[b])


def test_rows_that_share_an_id_are_told_apart(spark):
    words = [" ".join(f"{name}{k}" for k in range(50)) for name in "abc"]
    rows = [(1, words[0], "p"), (1, words[1], "p"), (2, words[2], "p"), (3, words[1].upper(), "p"), (2, words[2], "p"), (None, words[0], "q")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, root string")
    out = simhash.deduplicated(docs.withColumn("digest", F.lit("d")).withColumn("words", F.lit(1)))
    assert out.columns == ["doc_id", "text", "root", "digest", "words"]
    got = sorted((r["doc_id"] or 0, r["text"]) for r in out.collect())
    assert got == [(0, words[0]), (1, words[0]), (1, words[1]), (2, words[2])]


def edited(base, rng, most):
    """``base`` with up to ``most`` words replaced by words of their own."""
    words = list(base)
    for k in rng.sample(range(len(words)), rng.randint(0, most)):
        words[k] = f"x{rng.randrange(10**9)}"
    return " ".join(words)


def test_crowds_equal_brute_force(documents):
    rng = random.Random(6)
    texts = [None, "", "a", "A", "a b"]
    for n in (6, 30, 120, 400):
        base = [f"w{rng.randrange(5000)}" for _ in range(n)]
        texts += [edited(base, rng, n // 20 + 1) for _ in range(30)]
        texts.append(" ".join(base[: n - n // 10]))
    want = near_groups(texts)
    got = {r["doc_id"]: r["root"] for r in simhash.near_copies(documents(texts), crowd=0).collect()}
    assert 5 < len(set(want)) < 0.7 * len(texts)
    assert {(a, b) for a in got for b in got if got[a] == got[b]} == {
        (a, b) for a in range(len(want)) for b in range(len(want)) if want[a] == want[b]
    }


def test_pairs_do_not_grow_with_the_square_of_a_group(documents, monkeypatch):
    rng = random.Random(7)
    base = [f"w{k}" for k in range(150)]
    texts, kept, pairs = [edited(base, rng, 8) for _ in range(500)], simhash.staged, []

    def counted(df):
        out = kept(df)
        if out.columns[:2] == ["a", "b"]:
            pairs.append(out.count())
        return out

    monkeypatch.setattr(simhash, "staged", counted)
    got = {r["doc_id"]: r["root"] for r in simhash.near_copies(documents(texts)).collect()}
    want = near_groups(texts)
    assert np.mean([got[a] == got[b] for a in range(500) for b in range(a) if want[a] == want[b]]) > 0.95
    assert all(want[a] == want[b] for a in range(500) for b in range(a) if got[a] == got[b])
    assert 0 < sum(pairs) < 16 * len(texts)
