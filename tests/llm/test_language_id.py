import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tessera.llm import language_id
from tessera.llm.common import utf8
from tessera.llm.queries import op1_language_id


def test_held_out_accuracy(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    held = docs.where("pmod(doc_id, 3) = 0")
    model = language_id.fit(docs.where("pmod(doc_id, 3) <> 0"), per_language=50)
    got = language_id.identify(held, model, host_col="source").join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert sum(r.language == r.lang for r in got) / len(got) >= 0.97 and all(r.accepted for r in got)


def test_priors_and_declarations_decide_short_texts(spark):
    word = {"en": "the house and this tree", "fr": "la maison et cet arbre"}
    train = spark.createDataFrame([(i, f"{word[y]} {i}", y) for i in range(40) for y in word], "doc_id long, text string, lang string")
    model = language_id.fit(train)
    rows = [(i, f"{word['fr']} numero", "h.fr") for i in range(30)] + [(100, "zq", "h.fr"), (101, '<html lang="fr-CA">abcd', "x.org"), (102, "12 34", "h.fr")]
    got = {r.doc_id: r for r in language_id.identify(spark.createDataFrame(rows, "doc_id long, text string, host string"), model, host_col="host").collect()}
    assert got[0].language == "fr" and got[101].declared == "fr" and not got[102].accepted and got[102].language == "und"


def pair(spark):
    """A model of two languages that share the word ``on``, and a function that judges (text, host, declared) rows."""
    words = {"aa": "kilo mapu tern vola", "bb": "shen druf yorp wexi"}
    train = spark.createDataFrame([(f"{words[y]} on", y) for y in words for _ in range(3)], "text string, lang string")
    model = language_id.fit(train)

    def judge(rows):
        df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, text string, host string, said string")
        return {r.doc_id: r for r in language_id.identify(df, model, host_col="host", declared=F.col("said")).collect()}

    return words, judge


def test_each_evidence_alone_changes_a_verdict(spark):
    words, judge = pair(spark)
    many = lambda y, host: [(words[y], host, None)] * 40
    even = [*many("aa", "one.zz"), *many("bb", "two.zz")]
    # the text
    got = judge([(words["aa"], None, None), (words["bb"], None, None)])
    assert (got[0].language, got[1].language) == ("aa", "bb")
    # the host, with all else alike
    got = judge([("on", "one.zz", None), ("on", "two.zz", None), *even])
    assert (got[0].language, got[1].language) == ("aa", "bb")
    # the suffix of a host that is seen for the first time
    tops = [(words[y], f"h{i}.{y}", None) for y in words for i in range(40)]
    got = judge([("on", "new.aa", None), ("on", "new.bb", None), *tops])
    assert (got[0].language, got[1].language) == ("aa", "bb")
    # the declaration
    told = [(words[y], f"{y}.zz", y) for y in words for _ in range(40)]
    got = judge([("on", "new.zz", "aa"), ("on", "new.zz", "bb"), *told])
    assert (got[0].language, got[1].language) == ("aa", "bb")


def test_a_text_is_left_out_of_its_own_prior(spark):
    words, judge = pair(spark)
    rows = [(f"{words['aa']} on", "h.aa", None), (f"{words['bb']} on", "h.aa", None), (words["aa"], "i.bb", "bb"), ("on", "h.aa", None), ("12", None, None)]
    got = judge(rows)
    model = language_id.fit(spark.createDataFrame([(f"{words[y]} on", y) for y in words for _ in range(3)], "text string, lang string"))
    bucket, at = language_id.grams(*utf8(pa.array([r[0] for r in rows])))
    like = np.array([model.table[bucket[a:b]].sum(0, dtype=float) * language_id.WEIGHT for a, b in zip(at[:-1], at[1:])])
    unit = lambda x: np.exp(x - x.max()) / np.exp(x - x.max()).sum()
    post, real = np.array([unit(x + [0, 0, -2]) for x in like]), np.diff(at) > 0
    agree = [(post[i, ["aa", "bb"].index(r[2])]) for i, r in enumerate(rows) if r[2]]
    right = (sum(agree) + 4) / (len(agree) + 5)
    for i, (_, host, said) in enumerate(rows):
        others = lambda f: post[[j for j, r in enumerate(rows) if j != i and real[j] and f(r[1] or "")]]  # noqa: B023, E731
        prior = (others(lambda h: True).sum(0) + 1) / (len(others(lambda h: True)) + 3)
        known = {r[1] or "" for j, r in enumerate(rows) if real[j]}
        if (host or "") in known:
            top = (host or "").rpartition(".")[2]
            for match, weight in ((lambda h: h.rpartition(".")[2] == top, 100), (lambda h: h == (host or ""), 20)):  # noqa: B023
                prior = (others(match).sum(0) + weight * prior) / (len(others(match)) + weight)
        told = np.zeros(3) if not said else np.log([right if y == said else (1 - right) / 2 for y in ("aa", "bb", "und")])
        want = unit(like[i] + np.log(prior) + told)
        assert abs(got[i].confidence - (want.max() if real[i] else 0)) < 1e-5
        assert got[i].language == (["aa", "bb", "und"][want.argmax()] if real[i] and want.max() >= 0.5 else "und")


def test_all_labels_short_words_and_long_tags(spark):
    train = spark.createDataFrame([(f"{chr(97 + i // 26) * 3}{chr(97 + i % 26) * 4} word", f"l{i:02}") for i in range(80)], "text string, lang string")
    model = language_id.fit(train)
    assert len(model.languages) == 80
    df = train.where("lang in ('l03', 'l79')").withColumn("doc_id", F.col("lang").substr(2, 2).cast("long"))
    assert {r.doc_id: r.language for r in language_id.identify(df, model).collect()} == {3: "l03", 79: "l79"}
    copies = spark.createDataFrame([("only text there is", "xx")] * 3000 + [("other one", "yy")], "text string, lang string")
    assert language_id.fit(copies).languages == ["xx", "yy"]
    assert np.diff(language_id.grams(*utf8(pa.array(["Re.", "A.", " ", None, "1 2"])))[1]).tolist() == [2, 1, 0, 0, 0]
    tag = f"<html data-x='{'y' * 2000}' lang=fr>"
    assert spark.range(1).select(language_id.declared_in_markup(F.lit(tag))).first()[0] == "fr"
    page = "<p>One</p><script>if (a < b) {}</script><!-- no --><STYLE>p{}</STYLE>two"
    assert spark.range(1).select(language_id.text_of_markup(F.lit(page))).first()[0].split() == ["One", "two"]


def test_query_judges_documents_and_pages(spark, small):
    got = op1_language_id(spark, small).collect()
    said = {r.page_id: r for r in got if r.page_id is not None}
    assert len(said) == 50 and len(got) == 250 and all(r.declared and r.doc_id == -1 - r.page_id for r in said.values())
    assert sum(r.language == r.declared for r in said.values()) >= 45


def test_foreign_texts_are_rejected(spark, small):
    model = language_id.fit(spark.read.parquet(f"{small}/documents.parquet"))
    df = spark.createDataFrame([(1, "Съешь ещё этих мягких французских булок да выпей чаю " * 5), (2, "漢字仮名交じり文" * 20)], "doc_id long, text string")
    assert [r.accepted for r in language_id.identify(df, model).collect()] == [False, False]


def test_odd_rows(spark, odd, empty):
    train = spark.createDataFrame([("word and more words", "en"), ("mot et mots encore", "fr"), (None, "en"), ("x", None)], "text string, lang string")
    model = language_id.fit(train)
    got = language_id.identify(odd, model).collect()
    assert len(got) == odd.count() and not any(r.accepted for r in got if r.doc_id in (1, 2, 3))
    assert language_id.identify(empty, model).count() == 0
    none = language_id.fit(train.where("1 = 0"))
    assert {r.language for r in language_id.identify(odd, none).collect()} == {"und"}


def test_columns_from_addresses(spark):
    row = spark.range(1).select(language_id.suffix_of(F.lit("a.b.DE:80")).alias("a"), language_id.suffix_of(F.lit("src1")).alias("b"), language_id.declared_in_markup(F.lit("<!doctype html><HTML class=x lang='de-AT'>")).alias("c")).first()
    assert tuple(row) == ("de", None, "de")
