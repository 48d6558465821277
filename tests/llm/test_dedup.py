import random
import re

import numpy as np

from tessera.llm import line_dedup, span_dedup

PASSAGE = "The first sentence of this passage is here. It goes on for a while with some more words to say. Then a third one comes along and says even more about it. And a fourth to be sure that there are over fifty words in it all told, or nearly."


def brute_lines(rows, n=3):
    """Texts by (id, text), first places by order."""
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        lines = (t or "").split("\n")
        gone = set()
        for k in range(len(lines) - n + 1):
            w = tuple(lines[k : k + n])
            if "".join(x.strip(" ") for x in w):
                if w in seen:
                    gone |= set(range(k, k + n))
                seen.add(w)
        out[i] = t if not gone else "\n".join(x for k, x in enumerate(lines) if k not in gone)
    return out


def test_lines_match_brute_force(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()] + [(-1, "a\nb\nc\nd"), (-2, "x\na\nb\nc\ny"), (-3, "q\nq\nq\nq\nq"), (None, "a\nb\nc")]
    got = line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.text for r in got} == brute_lines(rows)


def test_lines_of_odd_rows(odd, empty):
    got = line_dedup.dedup(odd.withColumnRenamed("kept", "n_lines"))
    assert got.count() == odd.count() and {r.doc_id: r.text for r in got.collect()}[2] is None
    assert line_dedup.dedup(empty).count() == 0


def test_passages_go_but_for_the_first(spark):
    rows = [(1, f"Intro one. {PASSAGE} Outro."), (2, f"Other text.\n{PASSAGE}\nThe end of it."), (3, "Nothing in common with them. Not a word of it at all. So it stays.")]
    got = {r.doc_id: r for r in span_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].text == rows[0][1] and got[3].text == rows[2][1]
    assert got[2].text == "Other text.\nThe end of it." and got[2].n_removed == 5 and [tuple(x) for x in got[2].removed] == [(1, 5)]


def test_spans_match_brute_force(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    seen, want = set(), {}
    for r in sorted(docs.collect(), key=lambda r: r.doc_id):
        units = span_dedup.sentences(r.text or "")
        whole, gone = [u.strip() for u in units], set()
        for i in range(len(units)):
            j = i + 3
            while j <= len(units) and sum(len(u.split()) for u in whole[i:j]) < 25:
                j += 1
            if j <= len(units):
                if tuple(whole[i:j]) in seen:
                    gone |= set(range(i, j))
                seen.add(tuple(whole[i:j]))
        want[r.doc_id] = r.text if not gone else "".join(u for k, u in enumerate(units) if k not in gone)
    assert {r.doc_id: r.text for r in span_dedup.dedup(docs).collect()} == want


def test_sentences_are_the_text():
    for t in (PASSAGE, "a b\n\nc. d! e?  f", "  lead and\ttrail  ", "x" * 5000 + " y." * 50, "no end " * 40):
        assert "".join(span_dedup.sentences(t)) == t
        assert all(len(u.split()) <= span_dedup.UNIT_WORDS for u in span_dedup.sentences(t))


def plain_sentences(text):
    """Sentences by reading the text word by word; none is longer than a unit here."""
    out, now = [], ""
    for word in re.findall(r"\s*\S+\s*", text):
        now += word
        if word.strip()[-1] in ".!?" or "\n" in word[len(word.rstrip()) :]:
            out.append(now)
            now = ""
    return out + [now] if now else out


def test_sentences_match_a_plain_reading():
    rng = random.Random(8)
    for _ in range(300):
        text = "".join(rng.choice(["a", "bc", "de.", "f!", "g?", "3.5", "..", "x.y"]) + rng.choice([" ", "  ", "\n", " \n "]) for _ in range(rng.randrange(1, 40)))
        if all(len(s.split()) <= span_dedup.UNIT_WORDS for s in plain_sentences(text)):
            assert span_dedup.sentences(text) == plain_sentences(text)


def test_scripts_without_spaces(spark):
    rng = random.Random(4)
    han = lambda n: "".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(n))
    passage = "".join(han(12) + "。" for _ in range(6))
    thai = "".join(chr(rng.randrange(0x0E01, 0x0E2F)) for _ in range(120))
    assert len(span_dedup.sentences(passage)) == 6 and "".join(span_dedup.sentences(passage + thai)) == passage + thai
    rows = [(1, han(40) + "。" + passage), (2, han(30) + "。" + passage + han(20)), (3, thai + " " + han(9)), (4, han(30) + "。" + thai)]
    got = {r.doc_id: r.text for r in span_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == rows[0][1] and got[3] == rows[2][1] and passage not in got[2] and len(got[2]) <= 60 and len(got[4]) < len(rows[3][1]) - 60


def test_a_text_of_many_megabytes(spark):
    rng = random.Random(6)
    long = " ".join(f"w{rng.randrange(10**6)}" + "." * (rng.random() < 0.08) for _ in range(1_200_000))
    rows = [(1, long), (2, "At first. " + long[5_000_000:5_000_700] + " At last.")]
    got = {r.doc_id: r.text for r in span_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(long) > 8_000_000 and got[1] == long and len(got[2]) < 450


def test_spans_of_odd_rows(odd, empty):
    got = span_dedup.dedup(odd.withColumnRenamed("kept", "removed")).collect()
    assert len(got) == odd.count() and {r.doc_id: r.text for r in got}[3] == "   \n \t "
    assert span_dedup.dedup(empty).count() == 0


def test_passages_in_unpunctuated_text_go_at_every_offset(spark):
    rng = random.Random(3)
    word = lambda k: f"{k}{rng.randrange(10**6)}"
    passages = [[word("p") for _ in range(n)] for n in (50, 51, 57, 64, 90)] + [["and"] * 50, ["red", "green", "blue"] * 17]
    rows = []
    for k, p in enumerate(passages):
        rows.append((100 * k, " ".join([word("a") for _ in range(40)] + p + [word("b") for _ in range(30)])))
        rows += [(100 * k + 1 + i, " ".join([word("c") for _ in range(20 + i)] + p + [word("d") for _ in range(25)])) for i in range(16)]
    got = {r.doc_id: r.text for r in span_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k, p in enumerate(passages):
        assert got[100 * k] == rows[17 * k][1] or len(set(p)) < 4
        for i in range(16):
            left = got[100 * k + 1 + i].split()
            assert sum(w in set(p) for w in left) <= max(25, len(p) - 25) and sum(w not in set(p) for w in left) == 45 + i


def test_texts_are_cut_only_once(spark, monkeypatch):
    rows = [(1, f"Intro one. {PASSAGE} Outro."), (2, f"Other  text.\n{PASSAGE}\nThe end of it."), (2, f"Other  text.\n{PASSAGE}\nThe end of it."), (3, "Short."), (4, None), (5, " \n"), (None, f"{PASSAGE} {'😀' * 300}. A. B.")]
    docs, passes = spark.createDataFrame(rows, "doc_id long, text string"), []
    plain = type(docs).mapInArrow
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, f, schema: passes.append((self, f)) or plain(self, f, schema))
    span_dedup.dedup(docs)
    table, last = passes[-1]
    batches = table.toArrow().to_batches()
    monkeypatch.setattr(span_dedup, "_SENTENCE", None)  # cutting fails from here on
    got = [r for b in last(iter(batches)) for r in b.to_pylist()]
    left = sorted((r["doc_id"] or 0, r["n_sentences"], r["text"], [(x["start"], x["stop"]) for x in r["removed"]]) for r in got if r["text"] is not None)
    assert left == [(0, 8, rows[6][1], []), (1, 7, "Intro one. Outro.", [(1, 5)]), *[(2, 7, "Other  text.\nThe end of it.", [(1, 5)])] * 2, (3, 1, "Short.", []), (5, 0, " \n", [])]
    assert [(r["n_sentences"], r["n_removed"], r["removed"]) for r in got if r["text"] is None] == [(0, 0, [])]


def test_places_of_sentences_with_odd_space():
    rng = random.Random(9)
    for k in range(400):
        words = [rng.choice(["a", "bcd", "e.", "3.5", "é", "x" * 300] + ["漢字", "。", "ถนน"] * (k % 2)) for _ in range(rng.randrange(90))]
        text = rng.choice(["", " \n "]) + "".join(w + rng.choice([" ", " ", " ", "  ", "\t", "\x1f", "　 ", "\n"][: 3 if k % 3 else 8] + [""] * (k % 2)) for w in words)
        units, stop = span_dedup.sentences(text), span_dedup.ends(text)
        assert "".join(units) == (text if text.strip() else "") and all(u.strip() and len(span_dedup.words_of(u)) <= span_dedup.UNIT_WORDS for u in units)
        assert all(u[-1].isspace() or not v[0].isspace() for u, v in zip(units, units[1:]))
        assert not units or span_dedup.unpacked(span_dedup.packed(stop), len(units)).tolist() == [0, *stop.tolist()]
    for long in (255, 256, 65535, 65536):
        assert span_dedup.unpacked(span_dedup.packed(np.array([1, 1 + long])), 2).tolist() == [0, 1, 1 + long]
