"""Dense text embeddings: which books to encode, encoding in batches, and pooling of token vectors."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import names as N

# Takes texts, returns token vectors of shape (texts, tokens, dim) and their 0/1 mask of shape (texts, tokens).
Encoder = Callable[[Sequence[str]], tuple[Any, Any]]

POOL_FLOOR = 1e-9


def books_to_encode(first_texts: DataFrame, cache: DataFrame) -> DataFrame:
    """Books, one text each, that the cache does not hold yet."""
    return first_texts.join(cache.select(N.BOOK), N.BOOK, "left_anti")


def encode_books(
    texts: DataFrame, make_encoder: Callable[[], Encoder], batch_size: int = N.ENCODER_BATCH, tasks: int | None = None
) -> DataFrame:
    """Embeddings `(book_id, embedding)` of one text per book.

    `make_encoder` runs once per task, so a task loads its model once; tokenising, and any limit a model sets on the
    number of tokens, belong to the encoder. `tasks` spreads costly encoding over more tasks than the texts' volume asks
    for.
    """
    if tasks:
        texts = texts.repartition(tasks, N.BOOK)
    book, text, vector, floor = N.BOOK, N.DESCRIPTION, N.EMBEDDING, POOL_FLOOR

    def encode(frames: Iterator) -> Iterator:
        import numpy as np
        import pandas as pd

        encoder = make_encoder()
        for frame in frames:
            for start in range(0, len(frame), batch_size):
                batch = frame.iloc[start : start + batch_size]
                hidden, mask = encoder(batch[text].tolist())
                mask = np.asarray(mask, dtype="float64")[:, :, None]
                weight = np.maximum(mask.sum(axis=1), floor)
                pooled = ((np.asarray(hidden, dtype="float64") * mask).sum(axis=1) / weight).astype("float32")
                yield pd.DataFrame({book: batch[book].to_numpy(), vector: list(pooled)})

    schema = T.StructType([texts.schema[book], T.StructField(vector, T.ArrayType(T.FloatType()))])
    return texts.select(book, text).mapInPandas(encode, schema)


def pool_tokens(tokens: DataFrame, doc: str, floor: float = POOL_FLOOR) -> DataFrame:
    """Masked mean over token vectors in long form `(doc, pos, mask, dim, value)`, as `(doc, dim, pooled)`."""
    weighted = F.sum(F.col("value") * F.col("mask"))
    weight = F.greatest(F.sum("mask").cast("double"), F.lit(floor))
    return tokens.groupBy(doc, "dim").agg((weighted / weight).alias("pooled"))
