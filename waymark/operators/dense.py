"""Vector operators: normalisation, exact cosine neighbours, search inside a dataset, caller-supplied embedding."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.operators import blocks

TRIPLE = ["embedding_provider", "embedding_model", "dimension"]
STAGE1_K = 25


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(vec: Column) -> Column:
    return F.sqrt(F.aggregate(vec, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def l2_normalise(vec: Column) -> Column:
    """Unit length; a zero vector stays zero."""
    length = F.greatest(norm(vec), F.lit(1e-9))
    return F.transform(vec, lambda x: x.cast("double") / length)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.greatest(norm(a), F.lit(1e-9)) * F.greatest(norm(b), F.lit(1e-9)))


def dense_knn(
    requests: DataFrame, vectors: DataFrame, k: int = STAGE1_K, scope: Sequence[str] = ("u_id", *TRIPLE), item_id: str = "row_uid",
    skip_self: bool = False, layout: str = "auto", block_rows: int = blocks.BLOCK_ROWS,
) -> DataFrame:
    """
    Exact cosine neighbours of each request among the vectors of its own scope.

    The scope (tenant and embedding triple, plus dataset or template where wanted) is an
    equality key, so vectors of other tenants or models are never compared, and a request
    without a tenant finds nothing. Result: scope, request_id, item, similarity, rank.
    """
    found = blocks.top_k_blocked(
        requests, vectors, blocks.cosine_scorer, k, list(scope), "request_id", item_id, "embedding",
        skip_self=skip_self, layout=layout, block_rows=block_rows,
    )
    return found.withColumnRenamed("score", "similarity")


def search_dataset(requests: DataFrame, vectors: DataFrame, k: int = STAGE1_K, scenario: str | None = None, category: str | None = None, **kw) -> DataFrame:
    """Neighbours inside one dataset; the scenario and category filters apply before the k best are taken."""
    from waymark.operators.scoping import equality_filters

    wanted = equality_filters(vectors, scenario_type=scenario, test_category=category)
    return dense_knn(requests, wanted, k, scope=("u_id", "dataset_id", *[c for c in TRIPLE if c in vectors.columns and c in requests.columns]), **kw)


def embed_column(df: DataFrame, text_col: str, embed: Callable[[Sequence[str]], Sequence[Sequence[float]]], batch_size: int = 64) -> DataFrame:
    """
    Add ``embedding`` by a caller-supplied function of a list of texts, in batches the provider
    accepts. A batch that comes back short, or with an empty vector, fails the job.
    """
    from pyspark.sql import types as T

    schema = T.StructType([*df.schema.fields, T.StructField("embedding", T.ArrayType(T.FloatType()))])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            vectors: list = []
            texts = frame[text_col].tolist()
            for start in range(0, len(texts), batch_size):
                batch = texts[start : start + batch_size]
                out = embed(batch)
                if len(out) != len(batch) or any(len(v) == 0 for v in out):
                    raise ValueError(f"embedder returned {len(out)} vectors for {len(batch)} texts")
                vectors.extend([list(map(float, v)) for v in out])
            yield frame.assign(embedding=vectors)

    return df.mapInPandas(run, schema)
