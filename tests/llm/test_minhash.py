import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import minhash
from tessera.llm.common import utf8
from tessera.llm.components import connected


def brute(rows, words, percent):
    """Set size and smallest reachable id by comparing all documents that share a shingle."""
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set()
    top = {i: i for i in sets}

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    holds = defaultdict(list)
    for i in sorted(sets):
        for j, n in Counter(j for s in sets[i] for j in holds[s]).items():
            if 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
                a, b = sorted((root(i), root(j)))
                top[b] = a
        for s in sets[i]:
            holds[s].append(i)
    return {i: (len(sets[i]), root(i)) for i in sets}


def found(df, **options):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(df, **options).collect()}


@pytest.mark.parametrize("words,percent", [(3, 85), (5, 80)])
def test_documents_match_brute_force(spark, small, words, percent):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    assert found(docs, words=words, percent=percent) == brute([(r.doc_id, r.text) for r in docs.collect()], words, percent)


def test_a_family_around_the_threshold(spark, monkeypatch):
    """Hundreds of copies, most of them just not similar enough to most others: leaders don't settle it."""
    monkeypatch.setattr(minhash, "BLOCK_SETS", 64)
    rng, rows = random.Random(3), []
    base = [f"w{rng.randrange(400)}" for _ in range(70)]
    for i in range(300):
        b = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 2, 3, 4])):
            b[rng.randrange(len(b))] = f"z{rng.randrange(60)}"
        rows.append((i, " ".join(b)))
    assert found(spark.createDataFrame(rows, "doc_id long, text string"), words=3, percent=85) == brute(rows, 3, 85)


def test_odd_rows(odd, empty):
    got = [(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(odd).collect()]
    assert len(got) == odd.count() and (1, 0, 1, True) in got and (2, 0, 2, True) in got and (3, 0, 3, True) in got
    assert got.count((4, 1, 4, True)) == 2 and (None, 1, None, True) in got and (7, 1, 7, True) in got
    assert minhash.near_duplicates(empty).count() == 0 and minhash.dedup(odd).columns == odd.columns


def test_one_of_each_group_stays(spark):
    df = spark.createDataFrame([(3, "a b c d e f g"), (1, "A b c  d e f g"), (2, "z y x w v u")], "doc_id long, text string")
    assert sorted(r.doc_id for r in minhash.dedup(df).collect()) == [1, 2]


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(2)
    x = rng.integers(0, 1 << 62, 2000).astype(np.uint64)
    a, b = minhash.signature(np.sort(x[:1500]), 512), minhash.signature(np.sort(x[500:]), 512)
    assert abs((a == b).mean() - 0.5) < 0.08


def test_components(spark):
    edges = [(b"%02d" % i, b"%02d" % (i + 1)) for i in range(40) if i != 20] + [(b"05", b"05")]
    got = {r.node: r.label for r in connected(spark.createDataFrame([(bytearray(a), bytearray(b)) for a, b in edges], "a binary, b binary")).collect()}
    assert {bytes(v) for k, v in got.items() if bytes(k) <= b"20"} == {b"00"} and {bytes(v) for k, v in got.items() if bytes(k) > b"20"} == {b"21"}


def test_words_of_any_length_hash_alike_wherever_they_stand(monkeypatch):
    texts = ["aa bb cc", "x" * 700, "bb " + "x" * 700 + " aa", "", None, " cc", "é" * 400 + " bb", "B" * 3000]
    raw = utf8(pa.array(texts))
    whole, at = minhash.word_hashes(*raw)
    monkeypatch.setattr(minhash, "SPAN", 256)
    minhash._powers.cache_clear()
    cut, again = minhash.word_hashes(*raw)
    minhash._powers.cache_clear()
    assert (whole == cut).all() and (at == again).all() and at.tolist() == [0, 3, 4, 7, 7, 7, 8, 10, 11]
    assert whole[3] == whole[4 + 1] and len(set(whole.tolist())) == 6


def test_a_text_of_many_megabytes(spark):
    long = "word one two three four five six seven eight nine " * 200_000 + "end " + "z" * 5_000_000
    df = spark.createDataFrame([(1, long), (2, long.upper()), (3, "word one two")], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in minhash.near_duplicates(df).collect()} == {1: 1, 2: 1, 3: 3}


def test_no_edges(spark):
    none = spark.createDataFrame([], "a binary, b binary")
    assert connected(none).count() == 0
    loops = spark.createDataFrame([(bytearray(b"a"), bytearray(b"a")), (None, bytearray(b"b"))], "a binary, b binary")
    assert connected(loops).count() == 0
