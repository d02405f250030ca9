
from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Words of the domain that say nothing about a topic.
DOMAIN_STOP_WORDS = [
    "issue", "become", "therefore", "monitor", "compare", "observe", "construct", "part", "conduct", "focus", "prior", "manage", "consider", "moderate", "condition", "potential",
    "action", "reassess", "row", "impact", "control", "management", "good", "unique", "introduce", "list", "potentially", "low", "establish", "legislation", "exist", "nvc",
]
STOP_WORDS = ["a", "about", "after", "all", "also", "am", "an", "and", "any", "are", "as", "at", "be", "because", "been", "before", "being", "between", "both", "but", "by", "can", "did", "do", "does", "down", "during", "each", "few", "for", "from", "further", "had", "has", "have", "he", "her", "here", "his", "how", "i", "if", "in", "into", "is", "it", "its", "just", "me", "more", "most", "my", "no", "nor", "not", "now", "of", "off", "on", "once", "only", "or", "other", "our", "out", "over", "own", "same", "she", "should", "so", "some", "such", "than", "that", "the", "their", "them", "then", "there", "these", "they", "this", "those", "through", "to", "too", "under", "until", "up", "very", "was", "we", "were", "what", "when", "where", "which", "while", "who", "why", "will", "with", "you", "your"]
CONTRACTIONS = {"can't": "cannot", "won't": "will not", "n't": " not", "'re": " are", "'ve": " have", "'ll": " will", "'d": " would", "'m": " am", "it's": "it is", "that's": "that is"}
#: Suffixes that the default lemmatiser takes off, and what it puts there.
SUFFIXES = (("ies", "y"), ("sses", "ss"), ("ings", ""), ("ing", ""), ("edly", ""), ("ed", ""), ("s", ""))


def squeeze(c: Column) -> Column:
    """[F3]"""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def no_space(c: Column) -> Column:
    """[F4]"""
    return F.regexp_replace(c, r"\s+", "")


def strip_tags(c: Column) -> Column:
    """[F5]"""
    return F.regexp_replace(c, r"<[^>]+>", "")


def strip_brackets(c: Column) -> Column:
    """[F5]"""
    return F.regexp_replace(c, r"\[[^\]]*\]", "")


def html_text(c: Column) -> Column:
    """Scripts, styles and tags out, the common entities as characters, white space squeezed."""
    c = F.regexp_replace(c, r"(?is)<(script|style)\b.*?</\1>", " ")
    c = F.regexp_replace(c, r"(?s)<[^>]*>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        c = F.replace(c, F.lit(entity), F.lit(char))
    return squeeze(c)


def by_value(change, kind: str):
    """A column function that applies ``change`` to every value that isn't null, in Arrow batches.

    The function is made at each call: workers import this module, and have no session.
    """

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield part.map(lambda x: None if x is None else change(x))

    return F.pandas_udf(run, kind)


def fold(x: str) -> str:
    return unicodedata.normalize("NFKD", x).encode("ascii", "ignore").decode()


def ascii_fold(c: Column) -> Column:
    """Compatibility-decomposed, without what ASCII lacks; null stays null."""
    return by_value(fold, "string")(c)


def keep_alnum(c: Column, digits: bool = True, by: str = " ") -> Column:
    """[F8] All but letters, digits and white space replaced; the range A-z also keeps [ \\ ] ^ _ and backticks, as the source does."""
    return F.regexp_replace(c, r"[^a-zA-z0-9\s]" if digits else r"[^a-zA-z\s]", by)


def no_delimiters(c: Column) -> Column:
    """[F9]"""
    return F.regexp_replace(c, r"(?U)[\W_]", " ")


def classifier_text(c: Column) -> Column:
    """Lower case, other than a-z, 0-9, '-' and apostrophe as a space; null reads 'none'."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit("None"))), r"[^a-z0-9\-']+", " "))


def name_text(c: Column) -> Column:
    """[F11]"""
    return F.trim(F.regexp_replace(c, r"[^a-zA-Z0-9\-&]+", " "))


def plain_dashes(c: Column) -> Column:
    """Dashes as '-', what isn't ASCII (degree sign and closing quotes aside) as a space."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, "[‐–—]", "-"), "[^\\x00-\\x7F°’”]", " "))


def expand_contractions(c: Column) -> Column:
    """[F15]"""
    for short, long in sorted(CONTRACTIONS.items(), key=lambda x: -len(x[0])):
        c = F.regexp_replace(c, f"(?i){re.escape(short)}\\b", long)
    return c


_ONES = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
_TENS = "zero ten twenty thirty forty fifty sixty seventy eighty ninety".split()


def in_words(n: int) -> str:
    """[F16] A whole number as English words."""
    if n < 20:
        return _ONES[n]
    if n < 100:
        return _TENS[n // 10] + ("-" + _ONES[n % 10] if n % 10 else "")
    if n < 1000:
        return _ONES[n // 100] + " hundred" + (" and " + in_words(n % 100) if n % 100 else "")
    for size, name in ((10**9, "billion"), (10**6, "million"), (10**3, "thousand")):
        if n >= size:
            rest = n % size
            return in_words(n // size) + " " + name + ((" and " if rest < 100 else ", ") + in_words(rest) if rest else "")
    raise ValueError(n)


def spelled(x: str) -> str:
    return " ".join(in_words(int(t)) if t.isascii() and t.isdigit() and len(t) < 13 else t for t in x.split(" "))


def number_words(c: Column) -> Column:
    """[F16] Tokens that are numbers as words, others unchanged."""
    return by_value(spelled, "string")(c)


def singular(c: Column) -> Column:
    """[F17]"""
    for many, one in (("weeds", "weed"), ("plants", "plant"), ("fragments", "fragment")):
        c = F.replace(c, F.lit(many), F.lit(one))
    return c


def trailing_number(c: Column) -> Column:
    """[F18]"""
    return F.regexp_extract(c, r"(\d+)$", 1).try_cast("int")


def file_stem(c: Column) -> Column:
    """[F26]"""
    return F.regexp_extract(c, r"([^/\\]+?)(?:\.[^./\\]*)?$", 1)


def megabytes(c: Column) -> Column:
    """[F32] Cut, not rounded, to two places."""
    return F.floor(c / 1048576 * 100) / 100


def status_of(c: Column) -> Column:
    """[F47]"""
    low = F.lower(c)
    return F.when(low.rlike(r"\bno issues\b"), "Resolved").when(low.rlike(r"\b(unresolved|u)\b"), "Unresolved").when(low.rlike(r"\b(resolved|r|no issue)\b"), "Resolved").otherwise(c)


def tokens(c: Column) -> Column:
    """[N4] Lower-case alphabetic tokens of 2 to 15 letters."""
    return F.filter(F.split(F.lower(c), r"[^\p{L}]+"), lambda t: F.length(t).between(2, 15))


def without(words: Column, stop: Sequence[str]) -> Column:
    """[N5, N6] Words that aren't in the list, repeated ones kept."""
    listed = F.array(*map(F.lit, stop))
    return F.filter(words, lambda w: ~F.array_contains(listed, w))


def lemma(word: Column) -> Column:
    """[N7] The word without its ending, by a table of suffixes; a stand-in where no lemmatiser is installed."""
    out = word
    for suffix, by in reversed(SUFFIXES):
        out = F.when(word.endswith(suffix) & (F.length(word) > len(suffix) + 2), F.concat(F.substring(word, F.lit(1), F.length(word) - len(suffix)), F.lit(by))).otherwise(out)
    return out


def normalise_a(c: Column) -> Column:
    """[N1] contractions, ASCII, lower case, marks (digits stay), stop words."""
    return F.array_join(without(F.split(squeeze(keep_alnum(F.lower(ascii_fold(expand_contractions(c))), by="")), " "), STOP_WORDS), " ")


def normalise_b(c: Column) -> Column:
    """[N2] contractions, ASCII, tags, lower case, marks and digits, lemmas, stop words."""
    words = F.split(squeeze(keep_alnum(F.lower(strip_tags(ascii_fold(expand_contractions(c)))), digits=False)), " ")
    return F.array_join(without(F.transform(words, lemma), STOP_WORDS), " ")


def normalise_c(c: Column) -> Column:
    """[N3, F14] tokens: ASCII, lower case, no marks, numbers as words, stop words."""
    words = F.filter(F.transform(F.split(squeeze(F.lower(ascii_fold(c))), " "), lambda w: F.regexp_replace(w, r"[^\w\s]", "")), lambda w: w != "")
    return F.array_join(without(F.split(number_words(F.array_join(words, " ")), " "), STOP_WORDS), " ")


def bigrams(df: DataFrame, key: str, words: str, min_count: int, threshold: float) -> DataFrame:
    """[N8] (a, b, n, score): neighbouring words that go together, score (n - min) V / (n_a n_b)."""
    rows = df.select(key, F.posexplode(words).alias("pos", "a"))
    counts = rows.groupBy("a").count()
    pairs = rows.withColumn("b", F.lead("a").over(Window.partitionBy(key).orderBy("pos"))).where("b is not null").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    size = counts.agg(F.count(F.lit(1)).alias("v"))  # one row
    scored = pairs.where(F.col("n") >= min_count).join(counts.withColumnRenamed("count", "na"), "a").join(counts.select(F.col("a").alias("b"), F.col("count").alias("nb")), "b").join(F.broadcast(size))
    return scored.select("a", "b", "n", ((F.col("n") - min_count) * F.col("v") / (F.col("na") * F.col("nb"))).alias("score")).where(F.col("score") > threshold)


def join_phrases(words: Column, phrases: Column) -> Column:
    """[N8] From the left, two neighbours that are a phrase become one token; ``phrases``: array of 'a b'."""

    def step(out: Column, w: Column) -> Column:
        last = F.try_element_at(out, F.lit(-1))
        fits = F.array_contains(phrases, F.concat(last, F.lit(" "), w))
        return F.when((F.size(out) > 0) & F.coalesce(fits, F.lit(False)), F.concat(F.slice(out, 1, F.size(out) - 1), F.array(F.concat(last, F.lit("_"), w)))).otherwise(F.concat(out, F.array(w)))

    return F.aggregate(words, F.array().cast("array<string>"), step)


def has_word(c: Column, phrase: str) -> Column:
    """The phrase, an expression as the source has it, between word boundaries."""
    return c.rlike(rf"\b{phrase}\b")


def first_label(columns: Sequence[Column], dictionary: Sequence[tuple[str, Sequence[str]]]) -> Column:
    """[X1] struct(label, phrase) of the first hit: by column, then label, then phrase; ('', '') if there is none.

    ``dictionary`` is ordered. One alternation for each label decides; only
    then its phrases are looked at.
    """
    empty = F.struct(F.lit("").alias("label"), F.lit("").alias("phrase"))
    out = empty
    for column in reversed(columns):
        c = classifier_text(column)
        for label, phrases in reversed([x for x in dictionary if x[1]]):
            any_of = r"\b(?:" + "|".join(phrases) + r")\b"
            ladder = F.lit(phrases[-1])
            for p in reversed(phrases[:-1]):
                ladder = F.when(has_word(c, p), p).otherwise(ladder)
            out = F.when(c.rlike(any_of), F.struct(F.lit(label).alias("label"), ladder.alias("phrase"))).otherwise(out)
    return out


def label_counts(c: Column, dictionary: Mapping[str, Sequence[str]]) -> Column:
    """[X4] array<struct(label, n)>: how many phrases of each label the text has, each counted once."""
    zero = F.lit(0)
    return F.array(*[F.struct(F.lit(k).alias("label"), sum((F.when(has_word(c, p), 1).otherwise(0) for p in v), zero).alias("n")) for k, v in dictionary.items()])


def once(value: Column, use) -> Column:
    """``use(value)`` with the value computed once; plain nesting would repeat it at every mention."""
    return F.transform(F.array(value), use)[0]


def labels(first: Column, second: Column | None, dictionary: Mapping[str, Sequence[str]]) -> Column:
    """[X4-X7] Labels with a phrase in the first text; if there are none at all, in the second. One alternation for each label."""
    some = {k: v for k, v in dictionary.items() if v}

    def pick(c: Column) -> Column:
        hits = lambda x: [F.when(x.rlike(r"\b(?:" + "|".join(v) + r")\b"), F.lit(k)) for k, v in some.items()]
        return once(c, lambda x: F.array_compact(F.array(*hits(x)))) if some else F.array().cast("array<string>")

    found = pick(F.coalesce(first, F.lit("")))
    if second is None:
        return found
    return once(found, lambda x: F.when(F.size(x) > 0, x).otherwise(pick(F.coalesce(second, F.lit("")))))


def unclassified(df: DataFrame, label: str, text: str, done: str = "generic") -> DataFrame:
    """[X2] The queue for new keywords: distinct texts of rows without a label, most frequent first; a text that some row labels ``done`` was looked at and is skipped."""
    seen = df.where(F.col(label) == done).select(text).distinct()
    open_ = df.where(F.coalesce(F.col(label), F.lit("")) == "").join(seen, text, "left_anti")
    return open_.groupBy(text).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), text)


def dictionary_to_json(dictionary: DataFrame) -> DataFrame:
    """[X3] (label, phrases) of (label, phrase): a backup, each label's sorted phrases as a JSON list."""
    return dictionary.groupBy("label").agg(F.to_json(F.array_sort(F.collect_set("phrase"))).alias("phrases"))


def dictionary_from_json(backup: DataFrame) -> DataFrame:
    """[X3] The (label, phrase) rows of a backup."""
    return backup.select("label", F.explode(F.from_json("phrases", "array<string>")).alias("phrase"))


def odd_one_out(groups: DataFrame, by: str, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """[N12] (by, key): of each group the vector least like the group's mean of unit vectors; ties by key."""
    unit = lambda c: once(F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, y: s + y * y)), lambda r: F.transform(c, lambda x: x / r))
    rows = groups.select(by, key, unit(F.col(vector).cast("array<double>")).alias("u"))
    mean = rows.select(by, F.posexplode("u").alias("i", "x")).groupBy(by, "i").agg(F.avg("x").alias("m"))
    scored = rows.select(by, key, F.posexplode("u").alias("i", "x")).join(mean, [by, "i"]).groupBy(by, key).agg(F.round(F.sum(F.col("x") * F.col("m")), 9).alias("s"))
    return scored.groupBy(by).agg(F.min(F.struct("s", key)).alias("z")).select(by, F.col(f"z.{key}").alias(key))


#: A full date: ISO, slashed, or with the month's name before or after the day.
_MONTH = r"(?:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)"
DATE = rf"(?i)\b(?:\d{{4}}-\d{{1,2}}-\d{{1,2}}|\d{{1,2}}/\d{{1,2}}/\d{{2,4}}|{_MONTH}\.?\s+\d{{1,2}}(?:st|nd|rd|th)?,?\s+\d{{4}}|\d{{1,2}}\s+{_MONTH}\.?,?\s+\d{{4}})\b"


def first_date(c: Column) -> Column:
    """The first full date in a text, or ''."""
    return F.regexp_extract(c, DATE, 0)


def date_count(c: Column) -> Column:
    """How many full dates a text has."""
    return F.regexp_count(c, F.lit(DATE))


def split_issues(c: Column) -> Column:
    """[X11, X12] A status text as its issues; null for null. Built-in functions only.

    Sentences end at full stops and are marked first: ``dash`` begins with one
    (in its first 2 characters), ``dated`` is long, names a date and has an
    early dash (in its first 21). A fold over the marks keeps the issues so
    far, the last of them open, and the date in force: a dash opens an issue
    under that date, a dated sentence opens one and sets the date, any other
    goes on with the open one.
    """
    strip = lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")
    any_dash = "[-\u2013]"

    def mark(x: Column) -> Column:
        head = strip(x)
        long = (F.length(x) > 25) & F.left(head, F.lit(21)).rlike(any_dash)
        return F.struct(x.alias("said"), head.alias("head"), F.left(head, F.lit(2)).rlike(any_dash).alias("dash"), F.when(long, first_date(x)).otherwise("").alias("found"))

    def follow(state: Column, m: Column) -> Column:
        dated = m["found"] != ""
        opened = F.concat(F.when(m["dash"], F.array(F.concat(state["date"], F.lit(" "), m["said"]))).otherwise(none), F.when(dated, F.array(m["said"])).otherwise(none))
        size = F.size(state["issues"])
        longer = F.concat(F.slice(state["issues"], F.lit(1), size - 1), F.array(F.concat(F.element_at(state["issues"], -1), F.lit(". "), m["head"])))
        issues = F.when(F.size(opened) > 0, F.concat(state["issues"], opened)).when(m["said"] != "", longer).otherwise(state["issues"])
        return F.struct(issues.alias("issues"), F.when(dated, m["found"]).otherwise(state["date"]).alias("date"), F.when(dated, "date").when(m["dash"], "dash").otherwise("").alias("last"))

    def finish(state: Column) -> Column:
        size, last = F.size(state["issues"]), F.element_at(state["issues"], -1)
        before = F.transform(F.slice(state["issues"], F.lit(1), size - 1), lambda x: strip(F.concat(x, F.lit("."))))
        end = F.when(state["last"] == "date", F.concat(last, F.lit("."))).when(state["last"] == "dash", strip(F.concat(state["date"], F.lit(" "), last, F.lit(".")))).otherwise(strip(F.concat(last, F.lit("."))))
        return F.concat(before, F.array(end))

    none = F.array().cast("array<string>")
    sentences = F.split(c, r"\.", -1)
    start = F.struct(F.array(sentences[0]).alias("issues"), first_date(sentences[0]).alias("date"), F.lit("").alias("last"))
    marked = F.transform(F.slice(sentences, F.lit(2), F.greatest(F.size(sentences) - 1, F.lit(0))), mark)
    return F.when(c.isNotNull(), F.aggregate(marked, start, follow, finish))


def curate(dictionary: DataFrame, merged: Mapping[str, str], added: Mapping[str, Sequence[str]], removed: Mapping[str, Sequence[str]]) -> DataFrame:
    """[U5, X8] (label, phrase): labels renamed or merged, phrases added, phrases removed, each once."""
    spark = dictionary.sparkSession
    rename = F.create_map(*[F.lit(x) for pair in merged.items() for x in pair]) if merged else F.create_map().cast("map<string,string>")
    out = dictionary.select(F.coalesce(F.try_element_at(rename, F.col("label")), F.col("label")).alias("label"), "phrase")
    rows = lambda d: spark.createDataFrame([(k, p) for k, v in d.items() for p in v], "label string, phrase string")
    return out.union(rows(added)).join(rows(removed), ["label", "phrase"], "left_anti").distinct()


#: Words that one task trains on, and tasks at most.
TRAIN_WORDS, TRAIN_TASKS = 1_000_000, 256


def train_embeddings(df: DataFrame, words: str, size: int = 100, window: int = 10, min_count: int = 36, iterations: int = 20, seed: int = 1):
    """[N10] Spark's Word2Vec (hierarchical softmax).

    Tasks train side by side and their vectors are averaged after each
    iteration; their number goes by the number of words, not by the cluster.
    """
    from pyspark.ml.feature import Word2Vec

    n = df.agg(F.sum(F.when(F.size(words) > 0, F.size(words)))).first()[0] or 0
    tasks = min(TRAIN_TASKS, max(1, -(-n // TRAIN_WORDS)))
    return Word2Vec(vectorSize=size, windowSize=window, minCount=min_count, maxIter=iterations, seed=seed, numPartitions=tasks, inputCol=words, outputCol="vector").fit(df)


def most_similar(model, word: str, n: int) -> list[tuple[str, float]] | str:
    """[N11] The nearest words, or a message for a word that the model hasn't."""
    if not model.getVectors().where(F.col("word") == word).head(1):
        return f"word '{word}' not in vocabulary"
    return [(r.word, r.similarity) for r in model.findSynonyms(word, n).collect()]


def context_pairs(df: DataFrame, key: str, words: str, window: int) -> DataFrame:
    """[N13] (key, pos, word, context): words with those up to ``window`` places away."""
    every = F.posexplode(words).alias("pos", "word")
    near = F.explode(F.filter(F.transform(words, lambda w, i: F.struct(i.alias("i"), w.alias("w"))), lambda s: (F.abs(s["i"] - F.col("pos")) <= window) & (s["i"] != F.col("pos"))))
    return df.select(key, words, every).select(key, "pos", "word", near.alias("c")).select(key, "pos", "word", F.col("c.w").alias("context"))


def title_text(c: Column) -> Column:
    """A copied table title: line breaks and marks of continuation out, white space squeezed."""
    return squeeze(F.regexp_replace(F.regexp_replace(c, r"[\r\n]+", " "), r"(?i)\(?\bcont(?:inue)?'?d\b\.?\)?", ""))


def underscores(c: Column) -> Column:
    """Underscores as spaces; [F29] is the other way round."""
    return F.replace(c, F.lit("_"), F.lit(" "))


def tag_column(c: Column) -> Column:
    """[F29]"""
    return F.replace(c, F.lit(" "), F.lit("_"))


def iso_date(c: Column) -> Column:
    """[F31]"""
    return F.date_format(c, "yyyy-MM-dd")


def new_id() -> Column:
    """A random UUID; not reproducible, so write it once."""
    return F.uuid()


def contains_pattern(c: Column, pattern: str) -> Column:
    """[P13] Null is false."""
    return F.coalesce(c.rlike(pattern), F.lit(False))


def all_strings(df: DataFrame, strip: bool = False) -> DataFrame:
    """[P17, P18] Every column as text; ``strip``: without white space at both ends."""
    cell = lambda c: F.regexp_replace(F.col(c).cast("string"), r"^\s+|\s+$", "") if strip else F.col(c).cast("string")
    return df.select(*[cell(c).alias(c) for c in df.columns])


def set_where(df: DataFrame, column: str, rules: Sequence[tuple[Column, str]]) -> DataFrame:
    """[P19] Cells by the first rule that holds."""
    out = F.col(column)
    for where, value in reversed(list(rules)):
        out = F.when(where, F.lit(value)).otherwise(out)
    return df.withColumn(column, out)


def concat_corpora(*parts: DataFrame) -> DataFrame:
    """[U2]"""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def literal_table(spark, values: Mapping[str, Sequence[str]]) -> DataFrame:
    """[S25] (label, phrase) of a literal dictionary."""
    return spark.createDataFrame([(k, v) for k, vs in values.items() for v in vs], "label string, phrase string")


def blank_sub_labels(df: DataFrame, vec: str, sub: str, blanked: Sequence[str], allowed: Mapping[str, Sequence[str]]) -> DataFrame:
    """[X10] Sub-labels of some labels go blank; of others only the allowed pairs stay."""
    fits = F.lit(True)
    for label, subs in allowed.items():
        fits = fits & ((F.col(vec) != label) | F.col(sub).isin(list(subs)))
    return df.withColumn(sub, F.when(F.col(vec).isin(list(blanked)), F.lit("")).otherwise(F.col(sub))).where(F.coalesce(fits, F.lit(False)))


def save_model(model, path: str) -> None:
    """[N14] An embedding model as a folder; ``load_model`` reads it."""
    model.write().overwrite().save(path)


def load_model(path: str):
    """[N14]"""
    from pyspark.ml.feature import Word2VecModel

    return Word2VecModel.load(path)


def plane(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """[N15] Two principal components, columns x and y."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    df = vectors.withColumn("__v", array_to_vector(F.col(vector).cast("array<double>")))
    out = PCA(k=2, inputCol="__v", outputCol="__p").fit(df).transform(df).withColumn("__p", vector_to_array("__p"))
    return out.withColumn("x", F.col("__p")[0]).withColumn("y", F.col("__p")[1]).drop("__v", "__p")
