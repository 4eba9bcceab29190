"""Dense vectors stored as arrays or as JSON lists."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, functions as F

#: Characters of a text that a model sees.
ENCODED = 800


def dot(a: Column, b: Column) -> Column:
    """Inner product in doubles; 0 where lengths differ."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.when(F.size(a) == F.size(b), F.aggregate(products, F.lit(0.0), lambda s, x: s + x)).otherwise(0.0)


def from_json(text: Column) -> Column:
    """The vector of a JSON list; null where it is malformed."""
    return F.from_json(text, "array<double>")


def to_json(vector: Column) -> Column:
    return F.to_json(vector)


def usable(vector: Column, dimensions: int) -> Column:
    """Whether a vector has the length, only finite numbers, and not only zeros."""
    whole = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vector) == dimensions) & whole & F.exists(vector, lambda x: x != 0), F.lit(False))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; 0 where lengths differ or one is zero."""
    size = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(size > 0, dot(a, b) / size).otherwise(0.0)


def encoder(load: Callable[[], Callable[[list[str]], list[list[float] | None]]]) -> Callable[[Column], Column]:
    """A column function that encodes texts with a model, a batch at a time.

    ``load`` is called once per Python worker and gives the model, a function
    from texts to vectors. Null and blank texts and failures of the model give
    null; texts are cut to ``ENCODED`` characters.
    """

    @F.pandas_udf("array<double>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for texts in batches:
            cut = [(t or "")[:ENCODED].strip() for t in texts]
            out: list = [None] * len(cut)
            real = [i for i, t in enumerate(cut) if t]
            try:
                for i, v in zip(real, model([cut[i] for i in real]) if real else [], strict=True):
                    out[i] = None if v is None else [float(x) for x in v]
            except Exception:  # a model that fails gives no vector, as a missing one
                pass
            yield pd.Series(out, dtype=object)

    return encode
