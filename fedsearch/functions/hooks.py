"""Pluggable Python hooks (survey 2.M), all Arrow-batched.

Each hook is a pandas UDF or a ``mapInPandas`` function: Spark partitions and
ships the rows, numpy does the per-batch work. Model weights are small and
bounded (the router has ~0.4-2.1 M parameters), so they travel inside the
function closure, once per task.

  M1 encoder      ``hashed_bow_vectors`` - text -> unit vector in the JVM; offline default;
                  ``model_encoder`` - a model loaded once per worker
  M2 router       ``mlp_router_scores`` - inference of a 2-hidden-layer MLP
  M3 reranker     ``fedsearch.operators.rerank.RERANKERS``
  M4 tokenizer    whitespace (``fedsearch.functions.text``)
  M5 answerer     ``answer_with`` - any callable over a batch of prompts
  M6 pooling      ``fedsearch.operators.pooling``
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def model_encoder(load: Callable[[], Callable[[list[str]], np.ndarray]], batch_size: int = 256) -> Callable[[Column], Column]:
    """A loaded model as a column function: text -> vector (survey M1).

    ``load()`` runs once per Python worker and returns ``texts -> matrix``;
    batches of texts then go through the model it returned.
    """
    from pyspark.ml.functions import predict_batch_udf
    from pyspark.sql.types import ArrayType, DoubleType

    def make_predict_fn():
        model = load()
        return lambda texts: np.asarray(model(["" if t is None else str(t) for t in texts.ravel()]), dtype=np.float64)

    return predict_batch_udf(make_predict_fn, return_type=ArrayType(DoubleType()), batch_size=batch_size)


def encode_once_per_encoder(queries: DataFrame, sources: DataFrame, text: str,
                            encoders: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """(qid, encoder, qv): each query encoded once per *distinct* encoder in use,
    not once per source (survey 2.M M1, section 4 'common work sharing').

    ``sources`` is the dimension: its few encoder names decide on the driver
    which models run at all; one without a model is an error.
    """
    used = sorted(r.encoder for r in sources.select("encoder").distinct().collect())
    if missing := [e for e in used if e not in encoders]:
        raise ValueError(f"no model for {missing}")
    out = queries.select("qid", F.lit(None).cast("string").alias("encoder"), F.lit(None).cast("array<double>").alias("qv")).where("false")
    for name in used:
        out = out.unionByName(queries.select("qid", F.lit(name).alias("encoder"), encoders[name](F.col(text)).alias("qv")))
    return out


def mlp_router_scores(weights: dict[str, np.ndarray], eps: float = 1e-5) -> Callable[[Column], Column]:
    """Probability from a Linear-LayerNorm-ReLU x2 -> Linear network (inference:
    dropout is the identity). ``weights`` holds fc1/fc2/fc3 ``w``/``b`` and
    ln1/ln2 ``g``/``b`` as numpy arrays in (out, in) layout."""
    w = {k: np.asarray(v, dtype=np.float64) for k, v in weights.items()}

    def layer_norm(x, g, b):
        mu = x.mean(axis=1, keepdims=True)
        var = x.var(axis=1, keepdims=True)
        return (x - mu) / np.sqrt(var + eps) * g + b

    @F.pandas_udf("double")
    def score(features: pd.Series) -> pd.Series:
        x = np.stack(features.to_numpy()).astype(np.float64)
        h = np.maximum(layer_norm(x @ w["fc1.w"].T + w["fc1.b"], w["ln1.g"], w["ln1.b"]), 0)
        h = np.maximum(layer_norm(h @ w["fc2.w"].T + w["fc2.b"], w["ln2.g"], w["ln2.b"]), 0)
        logit = (h @ w["fc3.w"].T + w["fc3.b"]).ravel()
        return pd.Series(1.0 / (1.0 + np.exp(-logit)))

    return score


def answer_with(prompts: DataFrame, answer_batch: Callable[[list[str]], list[str]],
                prompt_col: str = "user", key: str = "qid") -> DataFrame:
    """Run an answerer over prompts in Arrow batches: (key, answer)."""
    def run(it):
        for pdf in it:
            yield pd.DataFrame({key: pdf[key], "answer": answer_batch(pdf[prompt_col].tolist())})
    key_type = dict(prompts.dtypes)[key]
    return prompts.select(key, prompt_col).mapInPandas(run, f"{key} {key_type}, answer string")


def hashed_bow_vectors(df: DataFrame, id_cols: list[str], text_col: str, width: int = 64) -> DataFrame:
    """(id columns, v ARRAY<DOUBLE>): signed hashed bag of words, L2-normalised, in the JVM.

    Tokens are exploded and hashed with MD5 (three hex digits the place, the fourth the sign); per-document sums are a
    grouped aggregate (map-side combined), so a long text is counted by the
    task that holds it and only ``width`` cells per document are shuffled.
    Documents without a token get the zero vector.
    """
    toks = df.select(*id_cols, F.explode(F.split(F.lower(F.col(text_col)), r"[^\p{L}\p{N}_]+")).alias("t")) \
        .where(F.length("t") > 0)
    toks = toks.withColumn("h", F.md5("t"))
    digit = [F.expr(f"instr('0123456789abcdef', substr(h, {i}, 1)) - 1") for i in range(1, 5)]
    cells = toks.select(*id_cols, ((digit[0] * 256 + digit[1] * 16 + digit[2]) % width).alias("b"),
                        F.when(digit[3] % 2 == 1, 1.0).otherwise(-1.0).alias("s")) \
        .groupBy(*id_cols, "b").agg(F.sum("s").alias("x"))
    packed = cells.groupBy(*id_cols).agg(
        F.map_from_entries(F.collect_list(F.struct("b", "x"))).alias("_m"),
        F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("_n"))
    dense = F.transform(F.sequence(F.lit(0), F.lit(width - 1)),
                        lambda i: F.coalesce(F.col("_m")[i], F.lit(0.0)))
    vec = F.when(F.col("_n") > 0, F.transform(dense, lambda x: x / F.col("_n"))).otherwise(dense)
    zero = F.array_repeat(F.lit(0.0), width)
    return df.select(*id_cols).join(packed.select(*id_cols, vec.alias("v")), id_cols, "left") \
        .select(*id_cols, F.coalesce(F.col("v"), zero).alias("v"))
