"""Attribution attacks: known documents in, a score for each unknown document and known author out.

``known`` has ``doc, author, vec``; ``unknown`` has ``doc, vec``. Models are ``d x d`` matrices and one vector for each author,
from sums that executors make in parts; applying a matrix is a map over Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..runtime import cut
from .blocks import author_scores


def class_means(known: DataFrame, normalise: bool = False) -> DataFrame:
    """``author, vec, n``: mean vector of each author, summed in parts."""
    v = V.unit("vec") if normalise else F.col("vec")
    each = known.select("author", F.posexplode(v).alias("i", "x"))
    m = each.groupBy("author", "i").agg(F.avg("x").alias("x"), F.count(F.lit(1)).alias("n"))
    return m.groupBy("author").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("vec"), F.max("n").alias("n"))


def standardise(known: DataFrame, *others: DataFrame) -> list[DataFrame]:
    """Each frame with ``vec`` z-scored by the known side's mean and population deviation of each dimension (0 counts as 1)."""
    each = known.select(F.posexplode("vec").alias("i", "x")).groupBy("i").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"))
    row = each.agg(F.array_sort(F.collect_list(F.struct("i", "m", "s"))).alias("_ms"))  # one row, as wide as the vectors

    def scaled(df: DataFrame) -> DataFrame:
        z = F.zip_with(F.col("vec").cast("array<double>"), F.col("_ms"), lambda x, p: (x - p["m"]) / F.when(p["s"] > 0, p["s"]).otherwise(1.0))
        return df.crossJoin(F.broadcast(row)).withColumn("vec", z).drop("_ms")

    return [scaled(df) for df in (known, *others)]


def scatter(df: DataFrame, group: str | None = None) -> tuple[np.ndarray, np.ndarray, int]:
    """Sum, sum of outer products and number of the vectors; each task adds up its own, the driver their d x d sums."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        s, xx, n = None, None, 0
        for f in frames:
            if len(f):
                x = np.stack(f["vec"].to_numpy()).astype(np.float64)
                s, xx, n = (x.sum(0), x.T @ x, len(x)) if s is None else (s + x.sum(0), xx + x.T @ x, n + len(x))
        if s is not None:
            yield pd.DataFrame({"s": [s.tolist()], "xx": [xx.ravel().tolist()], "n": [n]})

    parts = df.select("vec").mapInPandas(run, "s array<double>, xx array<double>, n bigint")
    tot = parts.select("n", F.posexplode(F.concat("s", "xx")).alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x"), F.sum("n").alias("n")).toPandas()
    if not len(tot):
        raise ValueError("no vectors")
    flat = tot.sort_values("i")["x"].to_numpy()
    d = int((-1 + (1 + 4 * len(flat)) ** 0.5) / 2 + 0.5)
    return flat[:d], flat[d:].reshape(d, d), int(tot["n"].iloc[0])


def within_covariance(known: DataFrame, shrinkage: float = 0.1) -> np.ndarray:
    """Pooled covariance within authors, shrunk to a multiple of the identity."""
    _, xx, n = scatter(known)
    _, mm, _ = scatter(class_means(known).withColumn("vec", F.transform("vec", lambda x: x * F.sqrt("n"))))
    c = (xx - mm) / max(n, 1)
    return (1 - shrinkage) * c + shrinkage * np.trace(c) / len(c) * np.eye(len(c))


def between_covariance(known: DataFrame) -> np.ndarray:
    s, _, n = scatter(known)
    _, mm, _ = scatter(class_means(known).withColumn("vec", F.transform("vec", lambda x: x * F.sqrt("n"))))
    return mm / n - np.outer(s / n, s / n)


def project(df: DataFrame, matrix: np.ndarray, centre: np.ndarray | None = None) -> DataFrame:
    """``df`` with ``vec`` times a matrix, in Arrow batches; the matrix is d x d and shared once with each executor."""
    shared = df.sparkSession.sparkContext.broadcast((matrix, np.zeros(len(matrix)) if centre is None else centre))

    @F.pandas_udf("array<double>")
    def apply(v: pd.Series) -> pd.Series:
        m, c = shared.value
        return pd.Series(list((np.stack(v.to_numpy()) - c) @ m)) if len(v) else pd.Series([], dtype=object)

    return df.withColumn("vec", apply("vec"))


def _centroid_scores(known: DataFrame, unknown: DataFrame) -> DataFrame:
    means = class_means(known, normalise=True)
    return author_scores(unknown.select(F.col("doc").alias("q"), "vec"), means.select(F.col("author").alias("g"), F.col("author").alias("label"), "vec"))


def nearest(known: DataFrame, unknown: DataFrame, linkage: str = "max", metric: str = "cosine") -> DataFrame:
    """Similarity to the author's nearest document, or the mean over its documents."""
    return author_scores(unknown.select(F.col("doc").alias("q"), "vec"), known.select(F.col("doc").alias("g"), F.col("author").alias("label"), "vec"), linkage, metric)


def centroid(known: DataFrame, unknown: DataFrame) -> DataFrame:
    """Cosine to the mean of the author's unit vectors."""
    return _centroid_scores(known, unknown)


def _inverse_root(c: np.ndarray) -> np.ndarray:
    w, v = np.linalg.eigh(c)
    return v @ np.diag(1 / np.sqrt(np.maximum(w, 1e-10))) @ v.T


def wccn(known: DataFrame, unknown: DataFrame, shrinkage: float = 0.2) -> DataFrame:
    """Centred and whitened by the covariance within authors, then by centroid."""
    s, _, n = scatter(known)
    m = _inverse_root(within_covariance(known, shrinkage))
    return _centroid_scores(project(known, m, s / n), project(unknown, m, s / n))


def lda_projection(known: DataFrame, components: int = 256, shrinkage: float = 0.1) -> tuple[np.ndarray, np.ndarray]:
    """Matrix and centre: whitened within authors, then the leading directions between authors."""
    s, _, n = scatter(known)
    m = _inverse_root(within_covariance(known, shrinkage))
    w, v = np.linalg.eigh(m @ between_covariance(known) @ m)
    return m @ v[:, np.argsort(-w)[:components]], s / n


def lda(known: DataFrame, unknown: DataFrame, components: int = 256, shrinkage: float = 0.1) -> DataFrame:
    m, c = lda_projection(known, components, shrinkage)
    return _centroid_scores(project(known, m, c), project(unknown, m, c))


def lda_wccn(known: DataFrame, unknown: DataFrame, components: int = 256) -> DataFrame:
    m, c = lda_projection(known, components)
    return wccn(project(known, m, c), project(unknown, m, c))


def plda(known: DataFrame, unknown: DataFrame, shrinkage: float = 0.1) -> DataFrame:
    """Log-likelihood ratio of one author against two, in the basis where both covariances are diagonal."""
    s, _, n = scatter(known)
    m = _inverse_root(within_covariance(known, shrinkage))
    w, v = np.linalg.eigh(m @ between_covariance(known) @ m)
    psi = np.maximum(w, 0)
    k, u = project(known, m @ v, s / n), project(unknown, m @ v, s / n)
    means = class_means(k)
    shared = known.sparkSession.sparkContext.broadcast(psi)

    # score(x, author) = log N(x; n psi / (n psi + 1) mean, psi / (n psi + 1) + 1) - log N(x; 0, psi + 1): three inner products
    @F.pandas_udf("array<double>")
    def author_side(v_: pd.Series, n_: pd.Series) -> pd.Series:
        p = shared.value
        x, c = np.stack(v_.to_numpy()), n_.to_numpy(float)[:, None]
        mu, var = c * p / (c * p + 1) * x, p / (c * p + 1) + 1
        const = -0.5 * (np.log(var) + mu * mu / var).sum(1, keepdims=True)
        return pd.Series(list(np.concatenate([-0.5 / var, mu / var, const, np.ones_like(const)], 1)))

    @F.pandas_udf("array<double>")
    def document_side(v_: pd.Series) -> pd.Series:
        p, x = shared.value, np.stack(v_.to_numpy())
        base = 0.5 * (np.log(p + 1) + x * x / (p + 1)).sum(1, keepdims=True)
        return pd.Series(list(np.concatenate([x * x, x, np.ones_like(base), base], 1)))

    g = means.select(F.col("author").alias("g"), F.col("author").alias("label"), author_side("vec", "n").alias("vec"))
    return author_scores(u.select(F.col("doc").alias("q"), document_side("vec").alias("vec")), g, metric="dot")


def ridge(known: DataFrame, unknown: DataFrame, penalty: float = 1.0) -> DataFrame:
    """One-versus-all regularised least squares: one Gram matrix, a right-hand side for each author."""
    s, xx, n = scatter(known)
    g = np.linalg.inv(xx + penalty * np.eye(len(xx)))
    sums = class_means(known).withColumn("vec", F.transform("vec", lambda x: x * F.col("n")))
    # targets are +1 and -1: the right-hand side is twice the author's sum less the total
    rhs = sums.withColumn("vec", F.zip_with("vec", F.array(*[F.lit(float(x)) for x in s]), lambda a, b: 2 * a - b))
    w = project(rhs, g)
    return author_scores(unknown.select(F.col("doc").alias("q"), "vec"), w.select(F.col("author").alias("g"), F.col("author").alias("label"), "vec"), metric="dot")


def _mllib(df: DataFrame) -> DataFrame:
    from pyspark.ml.functions import array_to_vector

    return df.withColumn("features", array_to_vector(F.col("vec").cast("array<double>")))


def logistic(known: DataFrame, unknown: DataFrame, c: float = 1.0, iterations: int = 50, most_dense: int = 2000) -> DataFrame:
    """Multinomial logistic regression with balanced weights; scores are logits. From ``most_dense`` authors on in steps of gradients."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import vector_to_array

    authors = known.groupBy("author").agg(F.count(F.lit(1)).alias("n")).orderBy("author")
    ids = authors.toPandas()  # the classes of a dense multinomial model, which holds a row for each on the driver anyway
    if len(ids) >= most_dense:
        return logistic_in_steps(known, unknown, c)
    index = F.create_map(*[F.lit(x) for i, a in enumerate(ids["author"]) for x in (a, float(i))])
    total, k = int(ids["n"].sum()), len(ids)
    train = _mllib(known).join(authors, "author").withColumn("label", index[F.col("author")]).withColumn("w", F.lit(total / k) / F.col("n"))
    model = LogisticRegression(family="multinomial", weightCol="w", regParam=1 / (c * total), maxIter=iterations, standardization=False).fit(train)
    raw = model.transform(_mllib(unknown)).select("doc", F.posexplode(vector_to_array("rawPrediction")).alias("i", "score"))
    back = F.create_map(*[F.lit(x) for i, a in enumerate(ids["author"].tolist()) for x in (i, a)])
    return raw.select(F.col("doc").alias("q"), back[F.col("i")].alias("label"), "score")


def logistic_in_steps(known: DataFrame, unknown: DataFrame, c: float = 1.0, steps: int = 40, rate: float = 0.1) -> DataFrame:
    """The same objective by Adam with a cosine rate, for any number of authors; scores are logits.

    A step sums the gradient over parts of the known side; the matrix of weights (authors times dimensions) is all that
    goes to and fro, and a part holds the logits of 256 documents at a time.
    """
    spark = known.sparkSession
    names = sorted(r.author for r in known.select("author").where(F.col("author").isNotNull()).distinct().collect())  # the model has a row for each
    at = {a: i for i, a in enumerate(names)}
    k, d = len(names), known.select(F.size("vec").alias("n")).first().n
    rows = cut(known.where(F.col("author").isNotNull()).select("author", "vec"))
    n = dict(rows.groupBy("author").count().collect())
    total = sum(n.values())
    weight = np.array([total / k / n[a] for a in names])
    w, m, v = np.zeros((k, d + 1)), np.zeros((k, d + 1)), np.zeros((k, d + 1))
    index = spark.sparkContext.broadcast((at, weight))
    for step in range(1, steps + 1):
        given = spark.sparkContext.broadcast(w)

        def part(frames):
            places, heavy = index.value
            now, g = given.value, np.zeros((k, d + 1))
            for f in frames:
                for i in range(0, len(f), 256):
                    x = np.stack(f["vec"].to_numpy()[i : i + 256]).astype(float)
                    x = np.concatenate([x, np.ones((len(x), 1))], 1)
                    y = np.array([places[a] for a in f["author"].to_numpy()[i : i + 256]])
                    z = x @ now.T
                    p = np.exp(z - z.max(1, keepdims=True))
                    p /= p.sum(1, keepdims=True)
                    p[np.arange(len(y)), y] -= 1
                    g += (p * heavy[y][:, None]).T @ x
            yield pd.DataFrame({"g": [g.tobytes()]})

        grad = sum(np.frombuffer(r.g).reshape(k, d + 1) for r in rows.mapInPandas(part, "g binary").toLocalIterator()) / total
        grad[:, :d] += w[:, :d] / (c * total)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        pace = rate * 0.5 * (1 + np.cos(np.pi * (step - 1) / steps))
        w = w - pace * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        given.unpersist()
    final = spark.sparkContext.broadcast(w)
    kinds = [unknown.schema["doc"].dataType.simpleString(), known.schema["author"].dataType.simpleString()]

    def score(frames):
        for f in frames:
            if len(f):
                x = np.stack(f["vec"].to_numpy()).astype(float)
                z = np.concatenate([x, np.ones((len(x), 1))], 1) @ final.value.T
                yield pd.DataFrame({"q": np.repeat(f["doc"].to_numpy(), k), "label": np.tile(np.array(names, object), len(f)), "score": z.ravel()})

    return unknown.select("doc", "vec").mapInPandas(score, f"q {kinds[0]}, label {kinds[1]}, score double")


def boosted_trees(known: DataFrame, unknown: DataFrame, rounds: int = 5, depth: int = 3) -> DataFrame:
    """One-versus-rest gradient-boosted trees, since MLlib's are binary; for few authors."""
    from pyspark.ml.classification import GBTClassifier

    return _one_vs_rest(known, unknown, lambda: GBTClassifier(maxIter=rounds, maxDepth=depth, seed=47))


def support_vectors(known: DataFrame, unknown: DataFrame, iterations: int = 30) -> DataFrame:
    """One-versus-rest linear support vector machines."""
    from pyspark.ml.classification import LinearSVC

    return _one_vs_rest(known, unknown, lambda: LinearSVC(maxIter=iterations, regParam=0.01))


def _one_vs_rest(known: DataFrame, unknown: DataFrame, make: Callable) -> DataFrame:
    from pyspark.ml.functions import vector_to_array

    train, test = _mllib(known).cache(), _mllib(unknown).cache()
    out = None
    for a in [r.author for r in known.select("author").distinct().orderBy("author").collect()]:  # one model for each author
        model = make().fit(train.withColumn("label", (F.col("author") == F.lit(a)).cast("double")))
        got = model.transform(test).select(F.col("doc").alias("q"), F.lit(a).alias("label"), F.get(vector_to_array("rawPrediction"), F.lit(1)).alias("score"))
        out = got if out is None else out.unionByName(got)
    return out


def verification(known: DataFrame, unknown: DataFrame, linkage: str = "mean", seed: int = 47, negatives: int = 1) -> DataFrame:
    """A same-author classifier on pairs of known documents; an author's score is the mean or best of its documents' pairs.

    Pairs within an author are drawn to its next documents in hash order, as many different-author pairs likewise: never all
    pairs of a group. Scoring is a query set against all known rows.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.sql.window import Window

    k = known.select("doc", "author", "vec")
    by = Window.partitionBy("author").orderBy(F.xxhash64("doc", F.lit(seed)))
    pos = k.withColumn("v2", F.lead("vec").over(by)).where(F.col("v2").isNotNull()).select("vec", "v2", F.lit(1.0).alias("label"))
    salted = Window.partitionBy(F.pmod(F.xxhash64("doc", F.lit(seed + 1)), F.lit(64))).orderBy(F.xxhash64("doc", F.lit(seed + 2)))
    neg = k.withColumn("v2", F.lead("vec").over(salted)).withColumn("a2", F.lead("author").over(salted)).where(F.col("a2") != F.col("author")).select("vec", "v2", F.lit(0.0).alias("label"))
    train = pos.unionByName(neg).withColumn("features", array_to_vector(V.pair_features("vec", "v2")))
    model = LogisticRegression(maxIter=50, regParam=1e-3).fit(train)
    w, b = np.array(model.coefficients), float(model.intercept)
    d = len(w) // 2
    shared = known.sparkSession.sparkContext.broadcast((w[:d], w[d:], b))

    def run(f: pd.DataFrame) -> pd.DataFrame:
        q, g = f[f["side"] == 0], f[f["side"] == 1]
        if not len(q) or not len(g):
            return pd.DataFrame({"q": [], "label": [], "top": [], "total": [], "n": []})
        wd, wp, b0 = shared.value
        x, y = np.stack(q["vec"].to_numpy()).astype(float), np.stack(g["vec"].to_numpy()).astype(float)
        z = (x * wp) @ y.T + b0
        for i in range(len(x)):
            z[i] += np.abs(x[i] - y) @ wd
        p = pd.DataFrame({"q": np.repeat(q["id"].to_numpy(), len(g)), "label": np.tile(g["label"].to_numpy(), len(q)), "p": (1 / (1 + np.exp(-z))).ravel()})
        return p.groupby(["q", "label"])["p"].agg(top="max", total="sum", n="count").reset_index()

    from .blocks import _cells

    kinds = [known.schema["doc"].dataType.simpleString(), known.schema["author"].dataType.simpleString()]
    cells = _cells(unknown.select(F.col("doc").alias("q"), "vec"), known.select(F.col("doc").alias("g"), F.col("author").alias("label"), "vec"), 1024)
    parts = cells.groupBy("i", "j").applyInPandas(run, f"q {kinds[0]}, label {kinds[1]}, top double, total double, n bigint")
    score = F.max("top") if linkage == "max" else F.sum("total") / F.sum("n")
    return parts.groupBy("q", "label").agg(score.alias("score"))


REGISTRY: dict[str, Callable[..., DataFrame]] = {
    "nearest_neighbor": nearest, "nearest_mean": lambda k, u: nearest(k, u, "mean"), "euclidean": lambda k, u: nearest(k, u, metric="euclidean"), "centroid": centroid,
    "wccn": wccn, "lda": lda, "lda_wccn": lda_wccn, "plda": plda, "rlsc": ridge, "logistic": logistic, "logistic_in_steps": logistic_in_steps, "svm": support_vectors, "gbt": boosted_trees, "cross_encoder": verification,
}


def attack(name: str) -> Callable[..., DataFrame]:
    """An attack by its name."""
    if name not in REGISTRY:
        raise KeyError(f"no attack {name!r}; there are {', '.join(sorted(REGISTRY))}")
    return REGISTRY[name]
