"""Vector functions: a local hashing embedder (X5 re-aimed) and cosine
similarity (X7), as JVM expressions.

The embedder stands in for the reference's remote embedding model: word
tokens (lower case, letters/digits) are hashed into ``dim`` buckets and
counted.  The hash is ``md5`` (first 32 bits) so any SQL engine can
reproduce the same vectors; vectors hold integer counts, so dot products
and norms are exact.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

DEFAULT_DIM = 256
TOKEN_SPLIT_JAVA = "[^\\p{L}\\p{N}]+"
TOKEN_SPLIT_RE2 = "[^\\p{L}\\p{N}]+"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def tokens(col) -> Column:
    parts = F.split(F.lower(F.coalesce(_c(col), F.lit(""))), TOKEN_SPLIT_JAVA)
    return F.array_remove(parts, "")


def token_buckets(col, dim: int = DEFAULT_DIM) -> Column:
    """Bucket id of every token: ``int(md5(token)[:8], 16) % dim``."""
    return F.transform(
        tokens(col),
        lambda t: F.pmod(F.conv(F.substring(F.md5(t), 1, 8), 16, 10).cast("long"),
                         F.lit(dim)).cast("int"))


def bucket_counts(buckets, dim: int = DEFAULT_DIM) -> Column:
    """Dense ``array<double>`` of counts per bucket (Arrow UDF, one numpy
    ``bincount`` per batch of rows)."""
    import numpy as np
    import pandas as pd

    @F.pandas_udf("array<double>")
    def _counts(col: pd.Series) -> pd.Series:
        rows = [np.asarray(b, np.int64) if b is not None else np.empty(0, np.int64) for b in col]
        row = np.repeat(np.arange(len(rows)), [len(b) for b in rows])
        flat = np.concatenate([*rows, np.empty(0, np.int64)])
        counts = np.bincount(row * dim + flat, minlength=len(rows) * dim).astype(np.float64)
        return pd.Series(list(counts.reshape(len(rows), dim)))

    return _counts(_c(buckets))


def token_counts(tokens_col, dim: int = DEFAULT_DIM) -> Column:
    """Dense ``array<double>`` of counts per bucket of a text's tokens.

    An Arrow UDF that hashes every distinct token of a batch of rows once; the
    same counts as of :func:`token_buckets`, which hashes each occurrence.
    """
    import hashlib

    import numpy as np
    import pyarrow as pa

    @F.arrow_udf("array<double>")
    def _counts(col: pa.Array) -> pa.Array:
        told = col.flatten().dictionary_encode()
        bucket = np.array([int(hashlib.md5(t.encode(), usedforsecurity=False).hexdigest()[:8], 16) % dim
                           for t in told.dictionary.to_pylist()], np.int64)
        row = np.repeat(np.arange(len(col)), col.value_lengths().fill_null(0).to_numpy())
        counts = np.bincount(row * dim + bucket[told.indices.to_numpy()], minlength=len(col) * dim)
        ends = np.arange(0, len(col) * dim + 1, dim, dtype=np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(counts.astype(np.float64)))

    return _counts(_c(tokens_col))


def hash_embedding(col, dim: int = DEFAULT_DIM) -> Column:
    """Dense ``array<double>`` of token counts per bucket."""
    return token_counts(tokens(col), dim)


def dot(a, b) -> Column:
    a, b = _c(a), _c(b)
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
                       F.lit(0.0), lambda acc, v: acc + v)


def norm(a) -> Column:
    a = _c(a)
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def cosine(a, b, norm_a=None, norm_b=None) -> Column:
    """Cosine similarity; empty, different length or zero norm -> 0.0.

    Precomputed norms can be passed so each side's norm is computed once.
    """
    a, b = _c(a), _c(b)
    na = _c(norm_a) if norm_a is not None else norm(a)
    nb = _c(norm_b) if norm_b is not None else norm(b)
    ok = (a.isNotNull() & b.isNotNull() & (F.size(a) > 0) & (F.size(b) > 0)
          & (F.size(a) == F.size(b)) & (na != 0) & (nb != 0))
    return F.when(ok, dot(a, b) / (na * nb)).otherwise(F.lit(0.0))
