"""Task evaluators on embeddings.

The formulas follow the usual textbook definitions (stated per function);
every evaluator reads hit tables or labelled vectors and aggregates with
built-in functions. Global orderings (pair-classification AP, rank
correlation) use :func:`global_cumulative`, which never places more than
one range partition in a task.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


HOT_SALTS = 16


# ------------------------------------------------------------ distributed running sums
def global_cumulative(df: DataFrame, order: Sequence[Column], value: str, out: str,
                      position: str | None = None) -> DataFrame:
    """Running sum of ``value`` (and 1-based position) along a total order.

    The frame is range-sorted (distributed; a hash of the row ends the order, so
    equal values spread over ranges), each row gets
    ``monotonically_increasing_id`` (partition index in the high bits, so
    ids grow with the global order) and is written once to the shared checkpoint
    folder: both uses below read the same ranges. Per-partition totals become
    offsets over one row per partition, and the running sum inside a partition
    is a window over that partition only.
    """
    from vecbench.session import cut_lineage
    s = df.orderBy(*order, F.xxhash64(*df.columns)).withColumn("_mid", F.monotonically_increasing_id())
    s = cut_lineage(s).withColumn("_pid", F.shiftright("_mid", 33))
    per = s.groupBy("_pid").agg(F.sum(value).alias("_ps"), F.count("*").alias("_pc"))
    w_off = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offs = per.select("_pid", F.coalesce(F.sum("_ps").over(w_off), F.lit(0)).alias("_so"),
                      F.coalesce(F.sum("_pc").over(w_off), F.lit(0)).alias("_co"))
    w_in = Window.partitionBy("_pid").orderBy("_mid").rowsBetween(Window.unboundedPreceding, 0)
    r = (s.withColumn("_rs", F.sum(value).over(w_in)).withColumn("_rc", F.count(F.lit(1)).over(w_in))
          .join(F.broadcast(offs), "_pid"))
    r = r.withColumn(out, F.col("_so") + F.col("_rs"))
    if position:
        r = r.withColumn(position, (F.col("_co") + F.col("_rc")).cast("bigint"))
    return r.drop("_mid", "_pid", "_rs", "_rc", "_so", "_co")


def average_ranks(df: DataFrame, col: str, out: str) -> DataFrame:
    """1-based ranks of ``col`` ascending, ties get the mean of their positions."""
    counts = df.groupBy(col).agg(F.count("*").alias("_n"))
    cum = global_cumulative(counts, [F.col(col).asc()], "_n", "_cum")
    ranks = cum.select(col, "_n", (F.col("_cum") - F.col("_n") + (F.col("_n") + 1) / 2.0).alias(out))
    # a value may hold a third of the rows: its rank goes to HOT_SALTS salted copies
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*df.columns, F.monotonically_increasing_id()), F.lit(HOT_SALTS)))
    copies = ranks.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(HOT_SALTS - 1).cast("bigint"))))
    return salted.join(copies.drop("_n"), [col, "_salt"]).drop("_salt")


# ------------------------------------------------------------ A19
def map_mrr(hits: DataFrame, info: DataFrame, k: int) -> DataFrame:
    """Per query AP@k = sum_{rank<=k, relevant} P@rank / min(n_rel, k)
    (0 when n_rel = 0) and RR@k = 1 / first relevant rank (0 when none)."""
    h = hits.where(F.col("rank") <= k)
    w = Window.partitionBy("query_row").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    h = h.withColumn("_cum", F.sum("rel").over(w))
    per = h.groupBy("query_row").agg(
        F.sum(F.when(F.col("rel") > 0, F.col("_cum") / F.col("rank")).otherwise(0.0)).alias("_ps"),
        F.min(F.when(F.col("rel") > 0, F.col("rank"))).alias("_first"))
    j = info.select("query_row", "n_rel").join(per, "query_row", "left")
    den = F.least(F.col("n_rel"), F.lit(k))
    return j.select("query_row",
                    F.when(den > 0, F.coalesce(F.col("_ps"), F.lit(0.0)) / den).otherwise(0.0).alias("ap"),
                    F.coalesce(F.lit(1.0) / F.col("_first"), F.lit(0.0)).alias("rr"))


# ------------------------------------------------------------ A20
def v_measure(df: DataFrame, truth: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    """Homogeneity h = 1 - H(C|K)/H(C), completeness c = 1 - H(K|C)/H(K),
    V = 2hc/(h+c) (natural logs; h = 1 when H(C) = 0, c = 1 when H(K) = 0), for every value of ``by``."""
    cont = df.groupBy(*by, truth, pred).agg(F.count("*").alias("n_ck"))
    ck = (cont.withColumn("n_c", F.sum("n_ck").over(Window.partitionBy(*by, truth)))
              .withColumn("n_k", F.sum("n_ck").over(Window.partitionBy(*by, pred))))
    # sum_c n_c log n_c = sum over cells of n_ck log n_c (same for k): one pass
    j = ck.groupBy(*by).agg(
        F.sum("n_ck").alias("n"),
        F.sum(F.col("n_ck") * F.log(F.col("n_ck") / F.col("n_k"))).alias("s_ck_k"),
        F.sum(F.col("n_ck") * F.log(F.col("n_ck") / F.col("n_c"))).alias("s_ck_c"),
        F.sum(F.col("n_ck") * F.log(F.col("n_c"))).alias("a_c"),
        F.sum(F.col("n_ck") * F.log(F.col("n_k"))).alias("a_k"))
    n = F.col("n")
    h_c = F.log(n) - F.col("a_c") / n           # H(C)
    h_k = F.log(n) - F.col("a_k") / n           # H(K)
    h_c_k = -F.col("s_ck_k") / n                # H(C|K)
    h_k_c = -F.col("s_ck_c") / n                # H(K|C)
    hom = F.when(h_c <= 0, 1.0).otherwise(1 - h_c_k / h_c)
    com = F.when(h_k <= 0, 1.0).otherwise(1 - h_k_c / h_k)
    return (j.select(*by, hom.alias("homogeneity"), com.alias("completeness"))
             .withColumn("v_measure", F.when(F.col("homogeneity") + F.col("completeness") > 0,
                                             2 * F.col("homogeneity") * F.col("completeness")
                                             / (F.col("homogeneity") + F.col("completeness")))
                         .otherwise(0.0)))


def _spread(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k-means++ start: each next centre is drawn with a chance by its squared distance from the nearest one so far."""
    c = [x[rng.integers(len(x))]]
    d = ((x - c[0]) ** 2).sum(axis=1)
    while len(c) < k and d.sum() > 0:
        c.append(x[rng.choice(len(x), p=d / d.sum())])
        d = np.minimum(d, ((x - c[-1]) ** 2).sum(axis=1))
    return np.array(c)


def lloyd(x: np.ndarray, k: int, seed: int, starts: int = 4, rounds: int = 50) -> np.ndarray:
    """Cluster of every row of ``x``: the best of ``starts`` runs of Lloyd's rounds from spread starts."""
    best, inertia = np.zeros(len(x), np.int64), np.inf
    for s in range(starts):
        c, last = _spread(x, min(k, len(x)), np.random.default_rng([seed, s])), None
        for _ in range(rounds):
            d = (c * c).sum(axis=1)[None, :] - 2 * (x @ c.T)
            near = d.argmin(axis=1)
            if last is not None and (near == last).all():
                break
            last = near
            used, inverse, count = np.unique(near, return_inverse=True, return_counts=True)
            total = np.zeros((len(used), x.shape[1]))
            np.add.at(total, inverse, x)
            c[used] = total / count[:, None]
        cost = float(d[np.arange(len(x)), near].sum())
        if cost < inertia - 1e-12:
            best, inertia = near, cost
    return best


def kmeans_batches(df: DataFrame, vector: str, label: str, *, row_id: str = "row_id", by: Sequence[str] = ("batch",), k: int | None = None,
                   seed: int = 42) -> DataFrame:
    """A20 on batches: one small k-means model a batch, all in one job; (*by, row_id, truth, cluster).

    ``by`` names a batch of bounded size (512 rows in the reference's protocol); it is clustered in one Arrow group. ``k`` defaults
    to the number of distinct labels of the batch. Rows are put in the order of ``row_id``, so the result does not depend on
    how they arrive. Rows with a null vector are left out.
    """
    import pyarrow as pa

    from vecbench.operators.blocks import _dense

    rows = df.where(F.col(vector).isNotNull()).select(*by, F.col(row_id).cast("bigint").alias("row_id"), F.col(label).cast("string").alias("truth"),
                                                      F.col(vector).cast("array<double>").alias("v"))
    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in by) + ", row_id bigint, truth string, cluster int"
    names = [*by, "row_id", "truth"]

    def run(batch: pa.Table) -> pa.Table:
        batch = batch.sort_by("row_id")
        x, _, _ = _dense(batch.column("v"))
        found = lloyd(x, k or len(batch.column("truth").unique()), seed)
        return batch.select(names).append_column("cluster", pa.array(found.astype(np.int32)))

    return rows.groupBy(*by).applyInArrow(run, schema)


def clustering_score(assigned: DataFrame, by: Sequence[str] = ("batch",), split: Sequence[str] = ()) -> DataFrame:
    """V-measure of every batch of ``kmeans_batches``, then mean and population deviation over the batches of a split."""
    per = v_measure(assigned, "truth", "cluster", [*split, *[c for c in by if c not in split]])
    return per.groupBy(*split).agg(F.avg("v_measure").alias("v_measure"), F.coalesce(F.stddev_pop("v_measure"), F.lit(0.0)).alias("v_measure_std"),
                                   F.count("*").alias("n_batches"))


def kmeans_assign(df: DataFrame, column: str, k: int, seed: int = 42, out: str = "cluster"):
    """A20 assignment step (and F8 training): ``pyspark.ml`` KMeans on an array column."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector
    v = df.withColumn("_v", array_to_vector(F.col(column)))
    model = KMeans(k=k, seed=seed, featuresCol="_v", predictionCol=out).fit(v)
    return model, model.transform(v).drop("_v")


def argmax_position(v: str | Column) -> Column:
    """1-based position of the largest element (a deterministic clustering rule)."""
    c = F.col(v) if isinstance(v, str) else v
    return F.array_position(c, F.array_max(c)).cast("int")


# ------------------------------------------------------------ A21 / A22 / A30
def knn_vote(hits: DataFrame, label: str = "item_key", k: int = 5) -> DataFrame:
    """Predicted label per query = most frequent label among its top-k
    neighbours; ties -> the smallest label."""
    h = hits.where(F.col("rank") <= k).groupBy("query_row", label).agg(F.count("*").alias("_n"))
    return h.groupBy("query_row").agg(
        F.min_by(label, F.struct(-F.col("_n"), F.col(label))).alias("predicted"))


def classification_report(pred: DataFrame, truth: str = "truth", predicted: str = "predicted") -> DataFrame:
    """Accuracy and macro-F1 (F1 per class averaged over classes seen in
    truth or prediction; F1 = 0 for a class with no true positives)."""
    t = pred.select(F.col(truth).alias("c"), F.lit(1).alias("support"), F.lit(0).alias("npred"),
                    (F.col(truth) == F.col(predicted)).cast("int").alias("tp"))
    p = pred.select(F.col(predicted).alias("c"), F.lit(0).alias("support"), F.lit(1).alias("npred"),
                    F.lit(0).alias("tp"))
    per = t.unionByName(p).groupBy("c").agg(F.sum("support").alias("support"),
                                            F.sum("npred").alias("npred"), F.sum("tp").alias("tp"))
    f1 = F.when(F.col("tp") > 0, 2 * F.col("tp") / (F.col("support") + F.col("npred"))).otherwise(0.0)
    return per.agg((F.sum("tp") / F.sum("support")).alias("accuracy"), F.avg(f1).alias("macro_f1"),
                   F.sum("support").alias("n"))


def binary_f1(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """A22 per label: precision, recall, F1 of a 0/1 prediction (0 when undefined)."""
    tp = F.sum(((F.col(truth) == 1) & (F.col(predicted) == 1)).cast("int"))
    fp = F.sum(((F.col(truth) == 0) & (F.col(predicted) == 1)).cast("int"))
    fn = F.sum(((F.col(truth) == 1) & (F.col(predicted) == 0)).cast("int"))
    g = df.agg(tp.alias("tp"), fp.alias("fp"), fn.alias("fn"))
    return g.select(
        F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") / (F.col("tp") + F.col("fp"))).otherwise(0.0).alias("precision"),
        F.when(F.col("tp") + F.col("fn") > 0, F.col("tp") / (F.col("tp") + F.col("fn"))).otherwise(0.0).alias("recall"),
        F.when(2 * F.col("tp") + F.col("fp") + F.col("fn") > 0,
               2 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn"))).otherwise(0.0).alias("f1"),
        (F.col("tp") + F.col("fn")).alias("support"))


def choice_accuracy(cands: DataFrame, group: str = "query_row", score: str = "score",
                    correct: str = "rel", tiebreak: str = "item_row") -> DataFrame:
    """Per group pick the best-scoring candidate (ties -> smallest id);
    accuracy = share of groups whose pick is correct."""
    pick = cands.groupBy(group).agg(F.min_by(correct, F.struct(-F.round(score, 9), F.col(tiebreak))).alias("_ok"))
    return pick.agg(F.avg(F.col("_ok").cast("double")).alias("accuracy"), F.count("*").alias("n_groups"))


# ------------------------------------------------------------ A23
def pair_average_precision(pairs: DataFrame, score: str = "score", label: str = "label",
                           tiebreak: Sequence[str] = ()) -> DataFrame:
    """Average precision of ranking pairs by score (descending): mean over
    positive pairs of (positives ranked at or above) / (its position)."""
    order = [F.round(score, 9).desc(), *[F.col(c).asc() for c in tiebreak]]
    cum = global_cumulative(pairs.withColumn("_y", F.col(label).cast("bigint")), order, "_y", "_tp", "_pos")
    return cum.agg(F.coalesce(F.avg(F.when(F.col("_y") == 1, F.col("_tp") / F.col("_pos"))), F.lit(0.0)).alias("ap"),
                   F.count("*").alias("n_pairs"), F.sum("_y").alias("n_positive"))


# ------------------------------------------------------------ A24 / A25
def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """Spearman = Pearson of average-tie ranks; Pearson of the raw values too."""
    rx = average_ranks(df, x, "_rx")
    rxy = average_ranks(rx, y, "_ry")
    return rxy.agg(F.corr("_rx", "_ry").alias("spearman"), F.corr(x, y).alias("pearson"),
                   F.count("*").alias("n_pairs"))


def grouped_spearman(df: DataFrame, group: str, x: str, y: str) -> DataFrame:
    """Spearman per group (groups are small candidate lists: windows per group); null where all values of a side are equal."""
    def ranks(col, out):
        w = Window.partitionBy(group).orderBy(col)
        wc = Window.partitionBy(group, col)
        return F.rank().over(w) + (F.count(F.lit(1)).over(wc) - 1) / 2.0
    r = df.withColumn("_rx", ranks(x, "_rx")).withColumn("_ry", ranks(y, "_ry"))
    # not F.corr, which divides by zero for a group of equal values: an error under ANSI
    g = r.groupBy(group).agg(F.covar_pop("_rx", "_ry").alias("_c"), (F.var_pop("_rx") * F.var_pop("_ry")).alias("_v"), F.count("*").alias("n"))
    return g.select(group, F.when(F.col("_v") > 0, F.try_divide("_c", F.sqrt("_v"))).alias("spearman"), "n")


# ------------------------------------------------------------ A26
def centroids(df: DataFrame, label: str, vector: str) -> DataFrame:
    """A26 prototypes: mean vector per label (a partial vector sum a task, no row a dimension)."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer
    v = df.select(label, array_to_vector(F.col(vector).cast("array<double>")).alias("_v"))
    return v.groupBy(label).agg(Summarizer.mean(F.col("_v")).alias("_m")).select(label, vector_to_array("_m").alias("centroid"))


def zero_shot(items: DataFrame, labels: DataFrame, encode_fn, *, template: str = "a photo of {label}", vector: str = "v", row_id: str = "row_id",
              label: str = "label") -> DataFrame:
    """The label whose prompted text vector is nearest (inner product) to an item's vector: row_id, predicted, score.

    ``labels`` holds the candidate labels (``label``); each is put into ``template`` and encoded by ``encode_fn`` (a frame with
    ``prompt`` -> the frame with ``v``), so no item teaches what it is scored by. Ties go to the label that sorts first; repeated and
    null labels are left out.
    """
    from vecbench.operators.search import topk_search

    head, _, tail = template.partition("{label}")
    named = labels.where(F.col(label).isNotNull()).select(F.col(label).cast("string").alias("label")).distinct()
    # candidate labels are few; numbered in their order so that ties are settled by it
    named = named.withColumn("row_id", F.row_number().over(Window.orderBy("label")).cast("bigint"))
    prompted = encode_fn(named.withColumn("prompt", F.concat(F.lit(head), "label", F.lit(tail))))
    best = topk_search(items.select(F.col(row_id).alias("row_id"), F.col(vector).alias("v")), prompted.select("row_id", "v"), 1, vector="v")
    return best.join(F.broadcast(prompted.select(F.col("row_id").alias("item_row"), "label")), "item_row") \
        .select(F.col("query_row").alias("row_id"), F.col("label").alias("predicted"), "score")


# ------------------------------------------------------------ A29
def regression_r2(df: DataFrame, vector: str, target: str, test: DataFrame | None = None) -> DataFrame:
    """Linear regression on the vector features of ``df``; R^2 on ``test`` (held-out rows; on the
    training rows without one)."""
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.regression import LinearRegression

    def features(x: DataFrame) -> DataFrame:
        return x.select(array_to_vector(F.col(vector)).alias("features"), F.col(target).cast("double").alias("label"))

    model = LinearRegression(regParam=0.0, maxIter=50).fit(features(df))
    pred = model.transform(features(df if test is None else test))
    # sum (y - mean)^2 = n * var_pop(y): one aggregate, no job of its own for the mean
    return pred.agg((1 - F.sum((F.col("label") - F.col("prediction")) ** 2)
                     / (F.count("*") * F.var_pop("label"))).alias("r2"), F.count("*").alias("n"))


def logistic_classification(train: DataFrame, test: DataFrame, vector: str, label: str, row_id: str = "row_id",
                            max_iter: int = 100) -> DataFrame:
    """Multinomial logistic regression fitted on ``train``; (row_id, truth, predicted) of ``test``.

    Labels are strings; a test label that training lacks is always missed.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import IndexToString, StringIndexer
    from pyspark.ml.functions import array_to_vector

    def features(x: DataFrame) -> DataFrame:
        return x.select(F.col(row_id).alias("row_id"), F.col(label).cast("string").alias("truth"),
                        array_to_vector(F.col(vector).cast("array<double>")).alias("features"))

    index = StringIndexer(inputCol="truth", outputCol="label", handleInvalid="keep").fit(features(train))
    model = LogisticRegression(maxIter=max_iter, family="multinomial").fit(index.transform(features(train)))
    named = IndexToString(inputCol="prediction", outputCol="predicted", labels=index.labels)
    return named.transform(model.transform(features(test))).select("row_id", "truth", "predicted")
