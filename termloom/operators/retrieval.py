"""Candidate retrieval: vectors, blocked joins and similarity."""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

MAX_BROADCAST_BYTES, BLOCK_BYTES = 16 << 20, 16 << 20
#: Queries and items whose scores a task holds at once.
QUERY_ROWS, SLICE_ROWS = 256, 4096


def dot(a: Column, b: Column) -> Column:
    product = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(product, F.lit(0.0), lambda s, x: s + x)


def mean_pool(tokens: Column) -> Column:
    """The mean of an array of vectors, place by place."""
    n = F.size(tokens)
    return F.transform(F.sequence(F.lit(0), F.size(F.element_at(tokens, 1)) - 1), lambda i: F.aggregate(tokens, F.lit(0.0), lambda s, t: s + F.get(t, i).cast("double")) / n)


def mean_by(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, vector): the mean of each key's vectors, by place, with partial sums before the shuffle."""
    places = df.select(key, F.posexplode(vector).alias("i", "x")).groupBy(key, "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return places.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("vector"))


def lookup_name(df: DataFrame, name: str, catalogue: DataFrame, by: str, out: str) -> DataFrame:
    """`df` with the first entry (the smallest id) whose `by` equals `name`; rows without one go."""
    first = catalogue.groupBy(F.col(by).alias(name)).agg(F.min("entry_id").alias(out))
    return df.join(first, name)


def cosine(a: Column, b: Column) -> Column:
    """0 for null vectors, zero norms and unequal lengths."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.coalesce(F.when((F.size(a) == F.size(b)) & (norm > 0), dot(a, b) / norm), F.lit(0.0))


def normalised(v: Column) -> Column:
    return F.element_at(F.transform(F.array(F.sqrt(dot(v, v))), lambda n: F.transform(v, lambda x: x.cast("double") / n)), 1)


def ensemble_vectors(df: DataFrame, first: str, second: str, out: str = "vector") -> DataFrame:
    """Rows with both vectors; concatenated, of unit length."""
    both = df.filter(F.col(first).isNotNull() & F.col(second).isNotNull())
    return both.withColumn(out, normalised(F.concat(first, second)))


def vector_bytes(vectors: DataFrame) -> int:
    """Rows times the longest vector, in bytes of doubles."""
    x = vectors.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vector")).alias("d")).first()
    return 8 * x["n"] * (x["d"] or 0)


def topk_vector_join(queries: DataFrame, catalogue: DataFrame, k: int = 15, max_broadcast: int | None = None, block_bytes: int = BLOCK_BYTES, but_itself: bool = False) -> DataFrame:
    """Exact top k by inner product: query_id, item_id, score, rank. Both sides have (id, vector).

    A catalogue of up to MAX_BROADCAST_BYTES counted bytes travels as one
    matrix. A larger one is dealt into blocks of about `block_bytes`, the queries into parts of as many; each part meets each
    block once by an equi-join on their numbers, a task multiplies two matrices, and only
    the k best of each (query, block) go on to the merge. `but_itself` leaves out the item with the query's id.
    """
    q = queries.select(F.col("id").alias("query_id"), F.col("vector").alias("q"))
    ties = Window.partitionBy("query_id").orderBy(F.desc("score"), "item_id")
    bound, size = MAX_BROADCAST_BYTES if max_broadcast is None else max_broadcast, vector_bytes(catalogue)
    schema, stack = "query_id long, item_id long, score double", lambda col: np.stack([np.asarray(v, np.float64) for v in col])
    if size <= bound:
        rows = catalogue.select("id", "vector").orderBy("id").toPandas()
        matrix = stack(rows["vector"]) if len(rows) else np.zeros((0, 1))
        shared = queries.sparkSession.sparkContext.broadcast((rows["id"].to_numpy(), matrix))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            ids, m = shared.value
            for batch in batches:
                if len(ids) and len(batch):
                    yield best_of(batch["query_id"].to_numpy(), stack(batch["q"]), ids, m, k, but_itself)

        return q.repartition("query_id").mapInPandas(run, schema).withColumn("rank", F.row_number().over(ties))
    blocks, parts = max(1, -(-size // block_bytes)), max(1, -(-vector_bytes(queries) // block_bytes))
    dealt = lambda name, n: F.pmod(F.xxhash64(name), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    visits = q.withColumn("part", dealt("query_id", parts)).withColumn("block", every(blocks))
    items = catalogue.select(F.col("id").alias("item_id"), F.col("vector").alias("v"), dealt("id", blocks).alias("block")).withColumn("part", every(parts))

    def merge(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "item_id": [], "score": []})
        ids, m = right["item_id"].to_numpy(), stack(right["v"])
        return best_of(left["query_id"].to_numpy(), stack(left["q"]), ids, m, k, but_itself)

    pairs = visits.groupBy("block", "part").cogroup(items.groupBy("block", "part")).applyInPandas(merge, schema)
    return pairs.withColumn("rank", F.row_number().over(ties)).filter(F.col("rank") <= k)


def best_of(query_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, matrix: np.ndarray, k: int, but_itself: bool = False, slice_rows: int = SLICE_ROWS) -> pd.DataFrame:
    """The k best of each query, by scores of twelve places; ties go to the smaller id.

    Queries and items meet in slices of `slice_rows` and the k best so far go on, so memory doesn't grow with either. After the first
    slice, only what reaches a query's k-th score is looked at.
    """
    found = [pd.DataFrame({"query_id": np.zeros(0, np.int64), "item_id": np.zeros(0, np.int64), "score": np.zeros(0)})]
    for at in range(0, len(q), QUERY_ROWS):
        part, mine = q[at : at + QUERY_ROWS], query_ids[at : at + QUERY_ROWS]
        who, what, score, least = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.full(len(part), -np.inf)
        for a in range(0, len(ids), slice_rows):
            scores, own = part @ matrix[a : a + slice_rows].T, ids[a : a + slice_rows]
            if but_itself:
                scores[mine[:, None] == own[None, :]] = -np.inf
            number = min(k, scores.shape[1])
            open_ = least == -np.inf
            low = least.copy()
            if open_.any():
                low[open_] = np.partition(scores[open_], scores.shape[1] - number, axis=1)[:, scores.shape[1] - number]
            i, j = np.nonzero(scores >= (low - 1e-11)[:, None])
            who, what, score = np.concatenate([who, i]), np.concatenate([what, own[j]]), np.concatenate([score, np.round(scores[i, j], 12)])
            order = np.lexsort((what, -score, who))
            who, what, score = who[order], what[order], score[order]
            first = np.searchsorted(who, np.arange(len(part)))
            kept = np.arange(len(who)) - first[who] < k
            who, what, score = who[kept], what[kept], score[kept]
            full = np.bincount(who, minlength=len(part)) == k
            least[full] = score[np.searchsorted(who, np.flatnonzero(full), "right") - 1]
        rows = np.isfinite(score) if but_itself else slice(None)
        found.append(pd.DataFrame({"query_id": mine[who[rows]], "item_id": what[rows], "score": score[rows]}))
    return pd.concat(found[1:] or found, ignore_index=True)


def topk_approximate_join(queries: DataFrame, catalogue: DataFrame, k: int = 15, lists: int = 64, probes: int = 32, max_train: int = 20_000, list_rows: int = 4096, but_itself: bool = False) -> DataFrame:
    """Approximate top k by inner product over unit vectors: query_id, item_id, score, rank.

    Every item goes to the list of its nearest centre; a query visits its `probes` nearest lists, by an equi-join
    on list and part (a list above `list_rows` items is split into parts), and items there are scored exactly. The centres are
    fitted by k-means on at most about `max_train` items, picked by hash. Vectors without structure need many probes:
    on random directions, 32 of 64 lists find nine of ten neighbours; clustered ones need few.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    total = catalogue.count()
    share = min(1.0, max_train / max(total, 1))
    sample = catalogue.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(share * (1 << 30))).select(array_to_vector(F.col("vector").cast("array<double>")).alias("features"))
    if sample.isEmpty():
        return topk_vector_join(queries, catalogue, k, but_itself=but_itself)
    centres = np.stack(KMeans(k=lists, seed=7, maxIter=10).fit(sample).clusterCenters())
    centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
    shared = queries.sparkSession.sparkContext.broadcast(centres)
    stack = lambda col: np.stack([np.asarray(v, np.float64) for v in col])

    @F.pandas_udf("array<int>")
    def nearest(vectors: pd.Series, number: pd.Series) -> pd.Series:
        order = np.argsort(-(stack(vectors) @ shared.value.T), axis=1, kind="stable")
        return pd.Series([row[:n].tolist() for row, n in zip(order, number, strict=True)])

    items = catalogue.select(F.col("id").alias("item_id"), F.col("vector").alias("v"), nearest("vector", F.lit(1))[0].alias("list"))
    sizes = {r["list"]: -(-r["count"] // list_rows) for r in items.groupBy("list").count().collect()}  # a row per list
    parts = F.create_map(*[F.lit(x) for kv in sizes.items() for x in kv])[F.col("list")]
    items = items.withColumn("part", F.pmod(F.xxhash64("item_id"), parts).cast("int"))
    asked = queries.select(F.col("id").alias("query_id"), F.col("vector").alias("q"), F.explode(nearest("vector", F.lit(probes))).alias("list"))
    asked = asked.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))

    def merge(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "item_id": [], "score": []})
        ids, m = right["item_id"].to_numpy(), stack(right["v"])
        return best_of(left["query_id"].to_numpy(), stack(left["q"]), ids, m, k, but_itself)

    pairs = asked.groupBy("list", "part").cogroup(items.groupBy("list", "part")).applyInPandas(merge, "query_id long, item_id long, score double")
    ties = Window.partitionBy("query_id").orderBy(F.desc("score"), "item_id")
    return pairs.withColumn("rank", F.row_number().over(ties)).filter(F.col("rank") <= k)


def hashed_embedding(texts: list[str], dim: int = 64) -> list[list[float]]:
    """The offline default model: hashed character trigrams of unit length."""
    out = []
    for t in texts:
        v = np.zeros(dim)
        padded = f"  {t.lower()} "
        for i in range(len(padded) - 2):
            h = 0
            for c in padded[i : i + 3]:
                h = (h * 1_000_003 + ord(c)) & 0xFFFFFFFF
            v[h % dim] += 1 if h >> 16 & 1 else -1
        out.append((v / max(np.linalg.norm(v), 1e-12)).tolist())
    return out


def embed(df: DataFrame, text: str = "text", fn=hashed_embedding, batch: int = 25) -> DataFrame:
    """`df` with `vector`: each distinct text is embedded once; a failed batch gives nulls."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            vectors: list = []
            texts = part["_text"].tolist()
            for at in range(0, len(texts), batch):
                try:
                    vectors += fn(texts[at : at + batch])
                except Exception:  # a model's failure leaves its rows without a vector
                    vectors += [None] * len(texts[at : at + batch])
            yield pd.DataFrame({"_text": part["_text"], "vector": vectors})

    distinct = df.select(F.col(text).alias("_text")).filter("_text is not null").distinct()
    made = distinct.mapInPandas(run, "_text string, vector array<double>")
    return df.join(made, F.col(text) == F.col("_text"), "left").drop("_text")


@F.pandas_udf(DoubleType())
def fuzzy_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Matching characters of two trimmed lower-case strings, 0 to 1."""
    pairs = zip(a.fillna("").str.strip().str.lower(), b.fillna("").str.strip().str.lower(), strict=True)
    return pd.Series([difflib.SequenceMatcher(None, x, y).ratio() for x, y in pairs], dtype="float64")


def edit_ratio(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longest)


def tokens(name: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(name), r"\s+"), lambda t: t != ""))


def prefix_ratio(a: Column, b: Column) -> Column:
    """Shorter over longer length where one name starts with the other, else 0."""
    starts = a.startswith(b) | b.startswith(a)
    return F.when(starts & (F.greatest(F.length(a), F.length(b)) > 0), F.least(F.length(a), F.length(b)) / F.greatest(F.length(a), F.length(b))).otherwise(0.0)


def plain_name(name: Column) -> Column:
    """Lower case, trimmed, without punctuation."""
    return F.regexp_replace(F.lower(F.trim(name)), r"(?U)[^\w\s]", "")


def fuzzy_match(names: DataFrame, catalogue: DataFrame, threshold: float = 0.6, sequence=fuzzy_ratio) -> DataFrame:
    """Pairs with 0.4 sequence + 0.4 Jaccard + 0.2 prefix ratio at or above `threshold`, which must be 0.6 or more.

    `names` has (id, name), `catalogue` (entry_id, entry). For CT and MRI names, an abdomen and an abdomen with pelvis
    are compared without the pelvis, and score 0.1 more. Equal names are matched once and joined back. Pairs without a
    common word are left out (all of them lie below 0.6). A pair in reach of the threshold has similar sets of words, or starts alike: the two
    joins of `similarity` find these, and only they are compared by `sequence`.
    """
    from .similarity import score_pairs

    if threshold < 0.6:
        raise ValueError("the threshold must be 0.6 or more")
    text = lambda df, c: df.select(F.col(c).alias("id"), plain_name(F.col(c)).alias("text")).filter("id is not null").distinct()
    kept = score_pairs(text(names, "name"), text(catalogue, "entry"), threshold, sequence)
    kept = kept.select(F.col("left_id").alias("name"), F.col("right_id").alias("entry"), "score")
    return names.join(kept, "name").join(catalogue.select("entry_id", "entry"), "entry").select("name", *[c for c in names.columns if c != "name"], "entry_id", "entry", "score")


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def minmax_by(df: DataFrame, query: str, score: str) -> DataFrame:
    """Scores of each query scaled to 0..1; logits (any |x| > 2) first go through the sigmoid; equal ones are 0.5."""
    w = Window.partitionBy(query)
    x = F.when(F.max(F.abs(F.col(score))).over(w) > 2, sigmoid(F.col(score))).otherwise(F.col(score))
    df = df.withColumn("_x", x)
    low, high = F.min("_x").over(w), F.max("_x").over(w)
    return df.withColumn("scaled", F.when(high == low, 0.5).otherwise((F.col("_x") - low) / (high - low))).drop("_x")


def rank_to_score(ranking: Column, place: Column, n: Column) -> Column:
    """1 - pos * 0.9 / (n - 1), at least 0.1; 0.3 for unranked; all 0 for an empty ranking; all 0.5 for none."""
    at = F.array_position(ranking, place) - 1
    return F.when(ranking.isNull(), 0.5).when(F.size(ranking) == 0, 0.0).when(at < 0, 0.3).otherwise(F.greatest(F.lit(0.1), 1 - at * 0.9 / F.greatest(n - 1, F.lit(1))))


def expand_variants(found: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Every catalogue row of each retrieved concept, once per input, at its best rank.

    An entry's position is the number of entries at better ranks of its input and its place within its concept, both counted before the two meet, so the expanded
    rows are neither shuffled nor sorted. Only concepts that share a rank of an input are ordered after they are expanded.
    """
    best = found.repartition("row_id").groupBy("row_id", "concept_id").agg(F.min("rank").alias("rank"))  # dealt by input once, for the windows too
    sizes = catalogue.groupBy("concept_id").agg(F.count(F.lit(1)).alias("_n"))
    upto, here = F.sum("_n").over(Window.partitionBy("row_id").orderBy("rank")), Window.partitionBy("row_id", "rank")
    ranks = best.join(sizes, "concept_id").select(*best.columns, (upto - F.sum("_n").over(here)).alias("_before"), (F.count(F.lit(1)).over(here) > 1).alias("_tied"))
    place = F.row_number().over(Window.partitionBy("concept_id").orderBy("entry_id"))
    joined = ranks.join(catalogue.withColumn("_place", place), "concept_id")
    columns = [*best.columns, *[c for c in catalogue.columns if c != "concept_id"]]
    at = lambda rows, place: rows.select(*columns, (F.col("_before") + place - 1).alias("cand_pos"))
    apart = F.row_number().over(Window.partitionBy("row_id", "rank").orderBy("entry_id"))
    return at(joined.filter(~F.col("_tied")), F.col("_place")).unionByName(at(joined.filter("_tied"), apart))


def attach_rerank(cands: DataFrame, scores: DataFrame, neutral: float = 0.5) -> DataFrame:
    """`cands` with `rerank`, by those of row_id and entry_id that `scores` has; missing scores are neutral. Scores of entries alone are best attached to the catalogue."""
    return cands.join(scores, [c for c in ("row_id", "entry_id") if c in scores.columns], "left").withColumn("rerank", F.coalesce("rerank", F.lit(neutral)))


def rerank(cands: DataFrame, fn, keys: tuple[str, ...] = ("row_id",)) -> DataFrame:
    """The plug point of a reranking model: fn(query, documents) -> scores, for each value of `keys`, on which the query and its documents depend."""
    found = cands.select(*keys, "entry_id", "cand_pos", "in_text", "cat_text")

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("cand_pos")
        return rows[[*keys, "entry_id"]].assign(rerank=[float(x) for x in fn(rows["in_text"].iloc[0], rows["cat_text"].tolist())])

    return found.groupBy(*keys).applyInPandas(run, found.select(*keys, "entry_id").schema.add("rerank", DoubleType()))


#: Entries of a term are dealt to so many salts, and the texts with it to one of them each.
SALTS = 8


def blocked_candidates(inputs: DataFrame, catalogue: DataFrame, k: int = 15, how: str = "inner") -> DataFrame:
    """Up to k catalogue entries per input that share an anatomy term, by token overlap; ties go to the smaller entry.

    The match runs over distinct (anatomy, text) pairs of both sides, so repeated names cost one search and are one find: of entries with equal names, only the
    k smallest can be among the k best. It joins numbers and token hashes alone; a pair counts at its first common term only, so nothing is
    made distinct afterwards, and each task keeps the k best of a text before the shuffle. The texts of a frequent term are dealt to
    `SALTS` tasks, each of which has its entries. With `how` "left", inputs without candidates stay, with null entries.
    """
    from .scoring import jaccard

    hashes = lambda c: F.transform(tokens(F.col(c)), lambda t: F.xxhash64(t))
    salt = F.pmod(F.xxhash64("in_text"), F.lit(SALTS)).cast("int")
    left = inputs.select("in_text", "in_anatomy").distinct().select("in_text", "in_anatomy", hashes("in_text").alias("a"), F.explode("in_anatomy").alias("t"), salt.alias("salt"))
    name = Window.partitionBy("cat_text", "cat_anatomy").orderBy("entry_id")
    entries = catalogue.select("entry_id", "cat_text", "cat_anatomy").withColumn("_r", F.row_number().over(name)).filter(F.col("_r") <= k)
    # a name goes by its smallest entry; `among` has the entries with that name
    entries = entries.withColumn("name", F.first("entry_id").over(name))
    among = entries.select("name", "entry_id")
    right = entries.filter("_r = 1").select("name", "cat_anatomy", hashes("cat_text").alias("b"), F.explode("cat_anatomy").alias("t"))
    pairs = left.join(right.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["t", "salt"])
    pairs = pairs.filter(F.col("t") == F.array_min(F.array_intersect("in_anatomy", "cat_anatomy")))
    pairs = pairs.select("in_text", "name", F.round(jaccard(F.col("a"), F.col("b")), 9).alias("overlap"))
    # at most k names can give the k best: of names with equal overlap, those whose smallest entry is smaller
    near = pairs.withColumn("_n", F.row_number().over(Window.partitionBy("in_text").orderBy(F.desc("overlap"), "name"))).filter(F.col("_n") <= k).drop("_n")
    w = Window.partitionBy("in_text").orderBy(F.desc("overlap"), "entry_id")
    top = near.join(among, "name").drop("name").withColumn("cand_pos", F.row_number().over(w) - 1).filter(F.col("cand_pos") < k)
    return inputs.join(top, "in_text", how).join(catalogue, "entry_id", how)
