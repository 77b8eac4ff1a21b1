"""Exploring a corpus: projections and clusters of its vectors, and titles of clusters. rows: id, vector (array<float>), text if there are titles."""

from __future__ import annotations

import warnings
from collections.abc import Callable, Mapping

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, Normalizer, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows that a driver-side projection or clustering may have.
MOST_LOCAL = 200_000


def _ml(rows: DataFrame) -> DataFrame:
    return rows.withColumn("features", array_to_vector(F.col("vector").cast("array<double>")))


def pca(rows: DataFrame, dims: int = 2) -> DataFrame:
    """id, coords: centred vectors on their principal axes, padded with zeros beyond the vectors' dimensions. Of an axis' two
    directions the one whose largest loading is positive is taken."""
    data = _ml(rows.select("id", "vector"))
    first = data.first()
    if first is None:
        raise ValueError("there is nothing to project")
    width = len(first.vector)
    centred = StandardScaler(withMean=True, withStd=False, inputCol="features", outputCol="centred").fit(data).transform(data)
    model = PCA(k=min(dims, width), inputCol="centred", outputCol="projected").fit(centred)
    axes = model.pc.toArray()
    signs = np.sign(axes[np.abs(axes).argmax(0), np.arange(axes.shape[1])])
    signs[signs == 0] = 1
    coords = F.zip_with(vector_to_array("projected"), F.lit(signs.tolist()).cast("array<double>"), lambda a, b: a * b)
    padded = F.concat(coords, F.array_repeat(F.lit(0.0), dims - min(dims, width)))
    return model.transform(centred).select("id", padded.alias("coords"))


def _umap(rows: DataFrame, dims: int, neighbors: int, min_dist: float, seed: int) -> DataFrame:
    import umap

    local = rows.select("id", "vector").limit(MOST_LOCAL + 1).toPandas()
    if len(local) > MOST_LOCAL:
        raise ValueError(f"UMAP runs on the driver, for at most {MOST_LOCAL} rows")
    x = np.stack(local.vector.to_numpy()).astype(float)
    if x.shape[1] > 50:
        x = x - x.mean(0)
        u, s, _ = np.linalg.svd(x, full_matrices=False)
        x = (u * s)[:, :50]
    made = umap.UMAP(n_components=dims, n_neighbors=max(2, min(neighbors, len(x) - 1)), min_dist=min_dist, metric="cosine", random_state=seed).fit_transform(x)
    local["coords"] = [list(map(float, r)) for r in made]
    return rows.sparkSession.createDataFrame(local[["id", "coords"]])


def project(rows: DataFrame, dims: int = 2, method: str = "auto", n_neighbors: int = 15, min_dist: float = 0.1, random_state: int = 42) -> DataFrame:
    """id, coords. method: pca, umap (if the umap package is installed), or auto: UMAP for 5 rows or more where it is, else PCA with a warning."""
    n = rows.limit(5).count()
    if dims < 1 or n < 2:
        raise ValueError("a projection needs at least one dimension and two rows")
    if method not in ("auto", "pca", "umap"):
        raise ValueError(f"unknown method {method!r}")
    if method == "auto":
        try:
            import umap  # noqa: F401

            method = "umap" if n >= 5 else "pca"
        except ImportError:
            warnings.warn("umap is not installed: PCA is used", stacklevel=2)
            method = "pca"
    return pca(rows, dims) if method == "pca" else _umap(rows, dims, n_neighbors, min_dist, random_state)


def cluster(rows: DataFrame, method="kmeans", n_clusters=8, min_cluster_size=5, normalize=True, random_state=42, max_iter=100) -> DataFrame:
    """id, label. Vectors are brought to length 1 first, unless normalize is off."""
    data = _ml(rows.select("id", "vector"))
    if normalize:
        data = Normalizer(inputCol="features", outputCol="unit").transform(data)
    column = "unit" if normalize else "features"
    if method == "kmeans":
        n = data.limit(n_clusters).count()
        if not n:
            raise ValueError("there is nothing to cluster")
        k = max(1, min(n_clusters, n))
        if k == 1:  # the library wants two
            return data.select("id", F.lit(0).alias("label"))
        model = KMeans(k=k, seed=random_state, maxIter=max_iter, featuresCol=column, predictionCol="label").fit(data)
        return model.transform(data).select("id", "label")
    if method == "hdbscan":
        try:
            import hdbscan
        except ImportError as e:
            raise ImportError("method 'hdbscan' needs the hdbscan package") from e
        local = data.select("id", vector_to_array(column).alias("v")).limit(MOST_LOCAL + 1).toPandas()
        if len(local) > MOST_LOCAL:
            raise ValueError(f"HDBSCAN runs on the driver, for at most {MOST_LOCAL} rows")
        local["label"] = hdbscan.HDBSCAN(min_cluster_size=max(2, min_cluster_size)).fit_predict(np.stack(local.v.to_numpy())).astype(int)
        return rows.sparkSession.createDataFrame(local[["id", "label"]])
    raise ValueError(f"unknown method {method!r}")


def assign(rows: DataFrame, centres: DataFrame) -> DataFrame:
    """id, label: the nearest of few given centres (label, centre); of equally near ones the least label."""
    from ..functions.vector import square_distance

    far = F.round(square_distance(F.col("vector"), F.col("centre")), 9)
    return rows.crossJoin(F.broadcast(centres)).groupBy("id").agg(F.min(F.struct(far.alias("d"), "label")).alias("m")).select("id", "m.label")


def label_clusters(texts: DataFrame, titles: Callable[[list[str]], str], n_samples: int = 20) -> dict[int, str]:
    """Titles by label, from up to n_samples texts of each (those of least hashed id); noise (-1) has none. texts: id, text, label."""
    order = Window.partitionBy("label").orderBy(F.xxhash64("id"), "id")
    picked = texts.where("label >= 0").withColumn("k", F.row_number().over(order)).where(F.col("k") <= n_samples)
    found = picked.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "text"))), lambda x: x.text).alias("texts")).orderBy("label").collect()
    return {r.label: titles(list(r.texts)) for r in found}


def explore(rows: DataFrame, dims: int = 2, project_options: Mapping | None = None, cluster_options: Mapping | None = None, titles: Callable[[list[str]], str] | None = None) -> tuple[DataFrame, dict[int, str]]:
    """(id, coords, label; titles by label). The projection uses the vectors as they are, the clusters those of length 1."""
    if titles is not None and "text" not in rows.columns:
        raise ValueError("titles need texts")
    labels = cluster(rows, **dict(cluster_options or {}))
    both = project(rows, dims, **dict(project_options or {})).join(labels, "id")
    named = label_clusters(rows.select("id", "text").join(labels, "id"), titles) if titles is not None else {}
    return both, named
