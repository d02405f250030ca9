import pytest
from pyspark.sql import functions as F

from docgrid.functions import text as t
from docgrid.operators import similarity


def one(spark, column, value="x"):
    return spark.createDataFrame([(value,)], "x string").select(column.alias("y")).first().y


@pytest.mark.parametrize(
    "function, value, expected",
    [
        (t.classifier_text, "Soil & Water's  edge-1!", "soil water's edge-1"),
        (t.classifier_text, None, "none"),
        (t.ascii_fold, "café – naïve", "cafe  naive"),
        (t.keep_alnum, "a_b[c]-d", "a_b[c] d"),
        (t.plain_dashes, "5° – é x", "5° -   x"),
        (t.name_text, "R&D (North-West), Ltd.", "R&D North-West Ltd"),
        (t.strip_tags, "<b>x</b> y", "x y"),
        (t.html_text, "<style>p{}</style><p>a &amp; b</p><script>var t='</p>'</script> c", "a & b c"),
        (t.expand_contractions, "It's here; they can't and won't", "it is here; they cannot and will not"),
        (t.singular, "weeds and plants", "weed and plant"),
        (t.trailing_number, "page_12", 12),
        (t.trailing_number, "page", None),
        (t.file_stem, "/a/b/table.12.csv", "table.12"),
        (t.number_words, "12 of 1999 x", "twelve of one thousand, nine hundred and ninety-nine x"),
        (t.tokens, "The Quick-brown fox, é a 12 sesquipedalianismus", ["the", "quick", "brown", "fox"]),
        (t.status_of, "There are No Issues", "Resolved"),
        (t.status_of, "Unresolved / R", "Unresolved"),
        (t.status_of, "r", "Resolved"),
        (t.status_of, "pending", "pending"),
    ],
)
def test_scalars(spark, function, value, expected):
    assert one(spark, function(F.col("x")), value) == expected


def test_first_label_and_labels(spark):
    d = [("fish", ["fish", "pike"]), ("soil", ["soils?", "top soil"]), ("none", [])]
    df = spark.createDataFrame([("", "fish in soil"), ("Top soil.", "pike"), ("x", "y"), (None, None)], "a string, b string")
    got = [(r.h.label, r.h.phrase) for r in df.select(t.first_label([F.col("a"), F.col("b")], d).alias("h")).collect()]
    assert got == [("fish", "fish"), ("soil", "soils?"), ("", ""), ("", "")]
    both = [r.h for r in df.select(t.labels(F.col("a"), F.col("b"), {k: v for k, v in d if v}).alias("h")).collect()]
    assert both == [["fish", "soil"], ["soil"], [], []]


def test_split_issues(spark):
    text = "Issue. Sept 17, 2016 - 65-75% vegetation cover seen. More of it. - second point. plain"
    cases = {
        text: ["Issue.", "Sept 17, 2016 - 65-75% vegetation cover seen. More of it.", "Sept 17, 2016  - second point. plain."],
        "one": ["one."],
        "": ["."],
        "Seen 2016-05-02. - a": ["Seen 2016-05-02.", "2016-05-02 2016-05-02  - a."],
        "a. - b.": ["a.", "- b."],
        None: None,
    }
    df = spark.createDataFrame([(k,) for k in cases], "x string")
    assert {r.x: r.y for r in df.select("x", t.split_issues(F.col("x")).alias("y")).collect()} == cases
    assert one(spark, t.first_date(F.col("x")), "on 3 May 2016 and 5/6/17") == "3 May 2016" and one(spark, t.date_count(F.col("x")), "on 3 May 2016 and 5/6/17") == 2


def test_phrases(spark):
    docs = spark.createDataFrame([(i, ["new", "york", "is", "x%d" % (i % 7)]) for i in range(40)], "id int, w array<string>")
    got = {(r.a, r.b) for r in t.bigrams(docs, "id", "w", 5, 0.1).collect()}
    assert ("new", "york") in got
    joined = spark.createDataFrame([(["a", "new", "york", "york"],)], "w array<string>").select(t.join_phrases(F.col("w"), F.array(F.lit("new york"))).alias("j")).first().j
    assert joined == ["a", "new_york", "york"]


def test_pairs_and_curation(spark):
    df = spark.createDataFrame([(1, "abcd"), (2, "abce"), (3, "zz"), (4, None)], "id int, x string")
    assert [tuple(r) for r in similarity.similar_pairs(df, "id", "x", 70, similarity.FUZZY).collect()] == [(1, 2, 75)]
    words = spark.createDataFrame([("a", "p"), ("b", "q"), ("b", "r")], "label string, phrase string")
    got = sorted(tuple(r) for r in t.curate(words, {"a": "b"}, {"c": ["s"]}, {"b": ["r"]}).collect())
    assert got == [("b", "p"), ("b", "q"), ("c", "s")]
    near = t.context_pairs(spark.createDataFrame([(1, ["a", "b", "c"])], "id int, w array<string>"), "id", "w", 1)
    assert sorted((r.word, r.context) for r in near.collect()) == [("a", "b"), ("b", "a"), ("b", "c"), ("c", "b")]


def test_word_vectors_are_trained_by_more_tasks_on_more_words(spark, monkeypatch):
    """The number of tasks goes by the words; no word is lost."""
    import pyspark.ml.feature as ml

    from docgrid.functions import text

    tasks = []
    real = ml.Word2Vec.fit
    monkeypatch.setattr(ml.Word2Vec, "fit", lambda self, df: (tasks.append(self.getNumPartitions()), real(self, df))[1])
    df = spark.createDataFrame([(["soil", "erosion", "slope"] * 4,), (["water", "river", "lake"] * 4,)] * 40 + [([],)], "w array<string>")
    vectors = {}
    for most in (1_000_000, 300):
        monkeypatch.setattr(text, "TRAIN_WORDS", most, raising=False)
        model = text.train_embeddings(df, "w", size=8, window=2, min_count=1, iterations=3)
        vectors[most] = {r.word for r in model.getVectors().collect()}
    assert tasks == [1, 4] and vectors[300] == vectors[1_000_000] == {"soil", "erosion", "slope", "water", "river", "lake"}
