import random
import re

import numpy as np
import pyarrow as pa

from tessera.llm import decontaminate
from tessera.llm.common import utf8

RNG = random.Random(4)
WORDS = ["".join(RNG.choice("abcdefghij") for _ in range(RNG.randrange(2, 9))) for _ in range(500)]


def prose(n):
    return " ".join(RNG.choice(WORDS) for _ in range(n))


def edited(text, n):
    out = list(text)
    for _ in range(n):
        k = RNG.randrange(len(out))
        out[k : k + RNG.choice([0, 1, 1])] = RNG.choice(["x", ""])
    return "".join(out)


def test_exact_and_near_passages_are_found_and_clean_ones_stay(spark):
    items = [(i, prose(30)) for i in range(20)] + [(99, None), (98, "too short")]
    rows = [(i, f"{prose(40)}. {t}! {prose(40)}") for i, t in items[:20]]
    rows += [(100 + i, f"{prose(40)} {edited(t.upper(), 4)} {prose(9)}") for i, t in items[:20]]
    rows += [(200 + i, f"{prose(20)} {' '.join(t.split()[5:])} {prose(20)}") for i, t in items[:20]]
    rows += [(300 + i, prose(200)) for i in range(60)]
    bench, docs = spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: {x.item_id for x in r.found} for r in decontaminate.annotate(docs, bench).collect()}
    for i in range(20):
        assert got[i] == got[100 + i] == {i}
    assert sum(got[200 + i] == {i} for i in range(20)) >= 18 and not any(got[300 + i] for i in range(60))
    blocks = {r.doc_id: {x.item_id for x in r.found} for r in decontaminate.annotate(docs, bench, block_bytes=1500).collect()}
    assert {k: v for k, v in blocks.items()} == got
    long = spark.createDataFrame([r for r in items if r[1] and len(r[1]) > 120], "item_id long, text string")
    assert {r.doc_id: {x.item_id for x in r.found} for r in decontaminate.annotate(docs, long, block_bytes=1500).collect()} == got
    assert {r.doc_id for r in decontaminate.decontaminate(docs, bench).collect()} == {i for i, f in got.items() if not f}


def edit_distance_in(pattern, text):
    """The fewest edits between a pattern and any part of a text."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j - 1] + (p != t), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def test_filter_and_alignment_match_dynamic_programming():
    items = [prose(14)[:72] for _ in range(6)]
    index = decontaminate.build_index(list(range(6)), items)
    texts = [f"{prose(5)} {edited(t, n)} {prose(5)}" for t in items for n in range(0, 9)] + ["", "short"]
    found = {(d, s): e for d, s, e in decontaminate.search(index, *utf8(pa.array(texts)))}
    norm, at = decontaminate.normalise(*utf8(pa.array(texts)))
    for d in range(len(texts)):
        for s in range(len(index.starts)):
            segment = index.text[index.starts[s] : index.starts[s] + index.lengths[s]]
            want = edit_distance_in(segment.tobytes(), norm[at[d] : at[d + 1]].tobytes())
            assert ((d, s) in found) == (want <= index.edits[s]) and found.get((d, s), want) == want


def test_odd_rows(spark, odd, empty):
    bench = spark.createDataFrame([(1, prose(30)), (None, "x"), (2, None)], "item_id long, text string")
    assert decontaminate.decontaminate(odd, bench).count() == odd.count()
    assert decontaminate.annotate(empty, bench).count() == 0
    assert decontaminate.decontaminate(odd, bench.where("1 = 0")).count() == odd.count()


def test_normalising():
    text, at = decontaminate.normalise(*utf8(pa.array([" A,,b É×", "", None, "c--"])))
    assert bytes(text[at[0] : at[1]]).decode().strip() == "a b é×" and np.diff(at).tolist()[1:3] == [0, 0]


def test_parts_are_found_at_every_offset():
    rng = random.Random(9)
    words = ["".join(rng.choice("klmnopqrst") for _ in range(rng.randrange(4, 9))) for _ in range(400)]
    item = [rng.choice(words) for _ in range(45)]
    index = decontaminate.build_index([1], [" ".join(item)])
    parts = [" ".join(item[i : i + n]) for n in (13, 16, 20) for i in range(45 - n + 1)]
    assert min(map(len, parts)) >= 55
    whole = " ".join(item)
    parts += [whole[i : i + 55] for i in range(len(whole) - 54)]
    texts = [f"zz yy xx ww vv uu {p} zz yy xx ww vv uu" for p in parts]
    assert {d for d, _, _ in decontaminate.search(index, *utf8(pa.array(texts)))} == set(range(len(texts)))


def test_short_items_are_found_whole():
    index = decontaminate.build_index([1, 2, 3], ["What is the tallest hill?", "yes", "zebra crossing"])
    texts = ["So: what is the tallest hill", "what is the tallest hillside", "what is the tall hill", "Yes!", "yes it is", "A zebra crossing.", "zebra crossing", "azebra crossing"]
    got = {(d, int(index.items[s])) for d, s, _ in decontaminate.search(index, *utf8(pa.array(texts)))}
    assert got == {(0, 1), (3, 2), (5, 3), (6, 3)}


def test_a_very_long_text_and_a_phrase_that_all_items_share(monkeypatch):
    rng = random.Random(12)
    shared = "the same opening words stand in front of every single item here "
    items = [shared + " ".join(rng.choice(WORDS) for _ in range(20)) for _ in range(150)]
    index = decontaminate.build_index(list(range(150)), items)
    texts = [(shared * 40) + items[7] + " " + shared * 40, " ".join(rng.choice(WORDS) for _ in range(400_000)) + " " + items[9]]
    whole = decontaminate.search(index, *utf8(pa.array(texts)))
    assert {7} <= {int(index.items[s]) for d, s, _ in whole if d == 0} and {9} <= {int(index.items[s]) for d, s, _ in whole if d == 1}
    monkeypatch.setattr(decontaminate, "MAX_PAIRS", 5000)
    assert decontaminate.search(index, *utf8(pa.array(texts))) == whole


def test_query_matches_a_plain_search(spark, small):
    """Items that stand in a text word for word, and no document with less than a few words of one."""
    from tessera.llm.queries import op3_decontaminate

    plain = lambda t: " ".join(re.sub(r"[^0-9a-z\u0080-\U0010ffff]+", " ", (t or "").lower()).split())
    docs = {r.doc_id: plain(r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    items = {r.item_id: plain(r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()}
    got = {(r.doc_id, r.item_id) for r in op3_decontaminate(spark, small).collect()}
    for d, text in docs.items():
        for i, item in items.items():
            parts = [item[k : k + 55] for k in range(len(item) - 54)]
            if any(p in text for p in parts) or item and f" {item} " in f" {text} ":
                assert (d, i) in got
            elif (d, i) in got:
                assert min(edit_distance_in(item[k : k + 48], text) for k in range(0, len(item) - 47, 8)) <= 3
