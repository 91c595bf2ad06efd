"""A deterministic embedder for tests and for tables without vectors: hashed token counts, normalised."""

from __future__ import annotations

import re
from hashlib import blake2b

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql.functions import pandas_udf

WORD = re.compile(r"[0-9a-z_@.\-]+|[一-鿿]{2}|[一-鿿]")


def embed(text: str | None, dim: int = 64) -> np.ndarray:
    """A unit vector, or zeros for a text without tokens."""
    v = np.zeros(dim)
    for w in WORD.findall((text or "").lower()):
        v[int.from_bytes(blake2b(w.encode(), digest_size=8).digest()) % dim] += 1
    length = np.linalg.norm(v)
    return v / length if length else v


def embedding(column: Column | str) -> Column:
    """The embedding of a text column, in Arrow batches. (The UDF is made here: a worker that imports this module cannot make one.)"""

    @pandas_udf("array<double>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(embed)

    return run(column)
