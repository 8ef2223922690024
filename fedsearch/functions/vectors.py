"""Vector and feature column expressions (survey 2.C).

All are built-in higher-order functions, so they run in the JVM next to the
scan. Vectors are ``ARRAY<DOUBLE>`` once they leave the reader: products of two
float32 values are exact in double, so a dot product summed in position order
gives the same bits in Spark and in a SQL oracle.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def as_double_vec(v) -> Column:
    """``ARRAY<FLOAT>`` to ``ARRAY<DOUBLE>``."""
    return F.transform(_c(v), lambda x: x.cast("double"))


def dot(a, b) -> Column:
    """Sum of element products, accumulated left to right in double."""
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x * y),
                       F.lit(0.0).cast("double"), lambda acc, x: acc + x)


def l2_norm(v) -> Column:
    return F.sqrt(F.aggregate(F.transform(_c(v), lambda x: x * x),
                              F.lit(0.0).cast("double"), lambda acc, x: acc + x))


def l2_normalize(v) -> Column:
    """Unit length; a zero vector stays zero (no division by zero under ANSI)."""
    n = l2_norm(v)
    return F.when(n > 0, F.transform(_c(v), lambda x: x / n)).otherwise(_c(v))


def cosine(a, b) -> Column:
    """Cosine similarity; 0 when either side is the zero vector."""
    den = l2_norm(a) * l2_norm(b)
    return F.when(den > 0, dot(a, b) / den).otherwise(F.lit(0.0))


def score(a, b, score_fn: str = "dot") -> Column:
    if score_fn == "dot":
        return dot(a, b)
    if score_fn in ("cos", "cos_sim", "cosine"):
        return cosine(a, b)
    raise ValueError(f"unknown score function {score_fn!r}")


def pad_vector(v, width: int) -> Column:
    """Right-pad with zeros to ``width``; a longer vector is an error."""
    v = _c(v)
    return F.when(F.size(v) > width,
                  F.raise_error(F.concat(F.lit(f"vector wider than {width}: "),
                                         F.size(v).cast("string")))) \
        .otherwise(F.concat(v, F.array_repeat(F.lit(0.0).cast("double"),
                                              F.lit(width) - F.size(v))))


def one_hot(index, n: int) -> Column:
    """Row ``index`` of the n x n identity matrix, as doubles."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)),
                       lambda j: (j == _c(index)).cast("double"))


def route_features(qv, centroid, source_id=None, n_sources: int | None = None) -> Column:
    """``[query | centroid | one-hot(source)]``; without one-hot when no ``source_id``."""
    parts = [_c(qv), _c(centroid)]
    if source_id is not None:
        parts.append(one_hot(source_id, n_sources))
    return F.concat(*parts)


def feature_ablation(features, q_width: int, c_width: int, n_sources: int,
                     keep_centroid: bool, keep_source_id: bool) -> Column:
    """Keep the query part and, by flag, the centroid and one-hot parts."""
    f = _c(features)
    parts = [F.slice(f, 1, q_width)]
    if keep_centroid:
        parts.append(F.slice(f, q_width + 1, c_width))
    if keep_source_id:
        parts.append(F.slice(f, q_width + c_width + 1, n_sources))
    return F.concat(*parts)


def vec_sum(v) -> Column:
    return F.aggregate(_c(v), F.lit(0.0).cast("double"), lambda acc, x: acc + x)


def sigmoid(x) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-_c(x)))


def apply_scaler(features, mean, std) -> Column:
    """(x - mean) / std, element-wise; ``std`` already has zeros replaced by 1."""
    return F.zip_with(F.zip_with(_c(features), _c(mean), lambda x, m: x - m),
                      _c(std), lambda x, s: x / s)


def payload_bytes(*cols) -> Column:
    """Bytes of the JSON object a source would send back for these columns."""
    return F.octet_length(F.to_json(F.struct(*[_c(c) for c in cols])))
