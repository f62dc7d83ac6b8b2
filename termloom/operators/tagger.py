"""A multi-label tagger: TF-IDF of one to three words, and naive Bayes, for one label after the other or for all at once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let


def fit_tagger(df: DataFrame, labels: list[str], features: int = 5000, smoothing: float = 0.1) -> DataFrame:
    """entry_id, tag, predicted, actual for each label; `df` has entry_id, text and tags."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import NaiveBayes
    from pyspark.ml.feature import IDF, CountVectorizer, NGram, RegexTokenizer, SQLTransformer, StopWordsRemover

    stages = [RegexTokenizer(inputCol="text", outputCol="raw", pattern=r"\W+"), StopWordsRemover(inputCol="raw", outputCol="g1", stopWords=["the", "of", "and"])]
    stages += [NGram(n=n, inputCol="g1", outputCol=f"g{n}") for n in (2, 3)]
    stages += [SQLTransformer(statement="SELECT *, concat(g1, g2, g3) AS grams FROM __THIS__"), CountVectorizer(inputCol="grams", outputCol="tf", vocabSize=features), IDF(inputCol="tf", outputCol="features")]
    ready = Pipeline(stages=stages).fit(df).transform(df).select("entry_id", "tags", "features")
    out = []
    for label in labels:
        rows = ready.withColumn("label", F.array_contains("tags", label).cast("double"))
        model = NaiveBayes(smoothing=smoothing, featuresCol="features", labelCol="label").fit(rows)
        out.append(model.transform(rows).select("entry_id", F.lit(label).alias("tag"), F.col("prediction").cast("int").alias("predicted"), F.col("label").cast("int").alias("actual")))
    return reduce(DataFrame.unionByName, out)


STOP_WORDS = ("the", "of", "and")


def grams(text: Column, most: int = 3) -> Column:
    """The terms of a text: its words without stop words, in runs of one to `most`."""
    words = F.filter(F.split(F.lower(text), r"\W+"), lambda t: (t != "") & ~t.isin(*STOP_WORDS))

    def of(w: Column) -> Column:
        return F.concat(*[F.transform(F.slice(w, 1, F.greatest(F.size(w) - (n - 1), F.lit(0))), run_of(w, n)) for n in range(1, most + 1)])

    return let(words, of)


def run_of(words: Column, n: int):
    return lambda _, i: F.array_join(F.slice(words, i + 1, n), " ")


def term_weights(docs: DataFrame, train: Column) -> DataFrame:
    """(entry_id, train, term, w): tf x log((m + 1) / (df + 1)), with m and df of the training part; terms unknown there are left out."""
    terms = docs.select("entry_id", train.alias("train"), F.explode(grams(F.col("text"))).alias("term")).groupBy("entry_id", "train", "term").agg(F.count(F.lit(1)).alias("tf"))
    df = terms.filter("train").groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    m = docs.filter(train).agg(F.count(F.lit(1)).alias("m"))
    idf = df.crossJoin(F.broadcast(m)).select("term", F.log((F.col("m") + 1) / (F.col("df") + 1)).alias("idf"))
    return terms.hint("merge").join(idf, "term").select("entry_id", "train", "term", (F.col("tf") * F.col("idf")).alias("w"))


def tag_all(docs: DataFrame, train: Column, smoothing: float = 0.1) -> DataFrame:
    """(entry_id, tag, score, predicted, actual) of every row outside the training part and every tag that occurs in it, in one pass.

    `docs` has entry_id, text and tags. All models are one table of sums by (tag, term): a term's weight without the tag is its total less that. With s the smoothing, V the
    number of terms, T the total weight and T(tag) the tag's, a row's log odds are, over its terms t with weight w,

        sum w log((P(tag, t) + s) / (T(t) - P(tag, t) + s)) + sum w log((T - T(tag) + s V) / (T(tag) + s V)) + log((n(tag) + s) / (n - n(tag) + s)).

    Terms that the tag never has add w log(s / (T(t) + s)), the same for all tags, so they are summed once per row, and only
    pairs of a term and a tag that occur together are joined. Tags are a short list. Tables with a row per entry are merged, never broadcast: files
    that compress well look small to the planner.
    """
    s = F.lit(smoothing)
    weights = term_weights(docs, train)
    known, asked = weights.filter("train"), weights.filter("not train")
    tags = docs.filter(train).select("entry_id", F.explode(F.array_distinct("tags")).alias("tag"))
    total = known.groupBy("term").agg(F.sum("w").alias("all"))
    pair = known.join(tags.hint("merge"), "entry_id").groupBy("tag", "term").agg(F.sum("w").alias("p"))
    of_tag = pair.groupBy("tag").agg(F.sum("p").alias("tp"))
    sizes = total.agg(F.count(F.lit(1)).alias("v"), F.sum("all").alias("t")).crossJoin(docs.filter(train).agg(F.count(F.lit(1)).alias("n")))
    # a tag whose rows hold no term still has a model
    counts = tags.groupBy("tag").agg(F.count(F.lit(1)).alias("nt")).join(of_tag, "tag", "left").crossJoin(F.broadcast(sizes)).withColumn("tp", F.coalesce("tp", F.lit(0.0)))
    models = counts.select(
        "tag", F.log((F.col("t") - F.col("tp") + s * F.col("v")) / (F.col("tp") + s * F.col("v"))).alias("per"), F.log((F.col("nt") + s) / (F.col("n") - F.col("nt") + s)).alias("prior"),
    )
    none = F.log(s / (F.col("all") + s))
    base = asked.hint("merge").join(total, "term").groupBy("entry_id").agg(F.sum(F.col("w") * none).alias("base"), F.sum("w").alias("sum"))
    gain = pair.join(total, "term").select("tag", "term", (F.log((F.col("p") + s) / (F.col("all") - F.col("p") + s)) - none).alias("gain"))
    hits = asked.hint("merge").join(gain, "term").groupBy("entry_id", "tag").agg(F.sum(F.col("w") * F.col("gain")).alias("own"))
    rows = docs.filter(~train).select("entry_id", "tags").crossJoin(F.broadcast(models)).join(base.hint("merge"), "entry_id", "left").join(hits.hint("merge"), ["entry_id", "tag"], "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    score = zero("base") + zero("own") + zero("sum") * F.col("per") + F.col("prior")
    return rows.select("entry_id", "tag", score.alias("score"), F.array_contains("tags", F.col("tag")).cast("int").alias("actual")).withColumn("predicted", (F.col("score") > 0).cast("int"))
