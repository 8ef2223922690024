"""Writers for run results (survey 2.B).

Logs are partitioned parquet appended per run (benchmark and routing become
partition columns instead of file names); CSV/JSON exports exist for tools
that expect the reference's files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fedsearch.session import open_filesystem, qualified


def write_question_log(df: DataFrame, path: str) -> None:
    """Append one row per question, partitioned by benchmark and routing (B1)."""
    df.write.mode("append").partitionBy("benchmark", "routing").parquet(path)


def write_source_log(df: DataFrame, path: str) -> None:
    """Append one row per (question, source) with duration and msg_size (B2)."""
    df.write.mode("append").partitionBy("benchmark", "routing").parquet(path)


def export_csv(df: DataFrame, path: str) -> None:
    """CSV with header and quoting; a timeout is written back as -1 (Q27)."""
    out = df
    if "status" in df.columns and "generate_time" in df.columns:
        out = df.withColumn("generate_time", F.when(F.col("status") == "timeout", F.lit(-1.0))
                            .otherwise(F.col("generate_time"))).drop("status")
    out.write.mode("overwrite").option("header", True).option("quoteAll", True).csv(path)


def write_answers(df: DataFrame, path: str) -> None:
    """JSON lines of question_id and answer; a resumed run adds to them."""
    df.select("question_id", "answer").write.mode("append").json(path)


def write_top_docs(ranked: DataFrame, path: str, doc_cols: list[str]) -> None:
    """JSON lines of question_id and its documents in rank order; a resumed run adds to them."""
    packed = ranked.groupBy("question_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", *doc_cols))).alias("docs"))
    packed.write.mode("append").json(path)


def write_predictions(pred: DataFrame, path: str) -> None:
    """question -> predicted sources, sorted."""
    out = pred.groupBy("query_id").agg(F.array_sort(F.collect_list("source")).alias("sources"))
    out.write.mode("overwrite").json(path)


def write_files(files: DataFrame, path: str) -> None:
    """One small file per row of ``files`` (``name, content`` as binary or string) in the shared folder ``path``.

    Each file goes to a name of its own attempt first and is moved into place
    whole, so a repeated task leaves complete files only.
    """
    folder_uri = qualified(files.sparkSession, path)

    def write(batches):
        import uuid

        import pyarrow as pa

        system, folder = open_filesystem(folder_uri)
        system.create_dir(folder, recursive=True)
        for b in batches:
            for name, content in zip(b.column("name").to_pylist(), b.column("content")):
                part = f"{folder}/_{uuid.uuid4().hex}"
                with system.open_output_stream(part, compression=None) as out:
                    out.write(content.as_buffer())
                system.move(part, f"{folder}/{name}")
            yield pa.RecordBatch.from_arrays([b.column("name")], names=["name"])

    (files.select("name", F.col("content").cast("binary").alias("content")).mapInArrow(write, "name string")
     .write.format("noop").mode("overwrite").save())


def write_query_vecs(vecs: DataFrame, path: str) -> None:
    """One ``<query_id>.npy`` per question (``query_id, vec``) in the shared folder ``path``."""
    def arrays(batches):
        import io

        import numpy as np
        import pyarrow as pa
        for b in batches:
            out = []
            for vec in b.column("vec"):
                buf = io.BytesIO()
                np.save(buf, vec.values.to_numpy(zero_copy_only=False).astype(np.float32))
                out.append(buf.getvalue())
            names = [f"{i}.npy" for i in b.column("query_id").to_pylist()]
            yield pa.record_batch({"name": pa.array(names, pa.string()), "content": pa.array(out, pa.binary())})

    write_files(vecs.select("query_id", "vec").mapInArrow(arrays, "name string, content binary"), path)


def write_once(df: DataFrame, path: str) -> None:
    """Persist a split or an order; refuses to overwrite an existing one."""
    df.write.mode("errorifexists").parquet(path)


def write_split_manifest(rows: DataFrame, path: str) -> str:
    """``bank, qid, split`` as one JSON object ``{bank: {split: [id, ...]}}``, an id a line, in the part files of a folder.

    Read in the order of their names the parts are the object's text, so a
    manifest of any size is written by many tasks. Returns ``path``.
    """
    from fedsearch.operators.positions import group_position
    p = group_position(rows, ["bank", "split"], [F.col("qid")], "_p")
    # one row per list
    lists = rows.groupBy("bank", "split").agg(F.count(F.lit(1)).alias("n"))
    banks = lists.groupBy("bank").agg(F.min("split").alias("_first"), F.max("split").alias("_last"))
    ends = banks.agg(F.min("bank").alias("a"), F.max("bank").alias("z"))
    p = (p.join(F.broadcast(banks), "bank").withColumn("_a", ends.select("a").scalar()).withColumn("_z", ends.select("z").scalar()))

    def text(c):
        one = F.to_json(F.array(c))
        return F.substring(one, F.lit(2), F.length(one) - 2)

    opens, closes = F.col("_p") == 1, F.col("_p") == F.col("group_size")
    opens_bank, closes_bank = opens & (F.col("split") == F.col("_first")), closes & (F.col("split") == F.col("_last"))
    none = F.lit("")
    value = F.concat(
        F.when(opens_bank & (F.col("bank") == F.col("_a")), "{").otherwise(none),
        F.when(opens_bank, F.concat(text(F.col("bank")), F.lit(": {"))).otherwise(none),
        F.when(opens, F.concat(text(F.col("split")), F.lit(": ["))).otherwise(none),
        text(F.col("qid").cast("string")), F.when(closes, "]").otherwise(none), F.when(closes_bank, "}").otherwise(none),
        F.when(closes_bank & (F.col("bank") == F.col("_z")), "}").otherwise(","))
    order = ["bank", "split", "_p"]
    (p.withColumn("value", value).repartitionByRange(*order).sortWithinPartitions(*order).select("value").write.text(path))
    return path


def upsert_metrics(old: DataFrame, new: DataFrame, key: str, path: str, order: str | None = None) -> DataFrame:
    """Replace rows of known keys, append the rest, write as a new version.

    Of several new rows of one key the last in ``order`` (a column of ``new``)
    stays; rows that tie there, or all if no order is given, are told apart by
    their own values, the greatest staying. A null key is a key of its own.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in new.columns])
    rank = F.struct(F.col(f"`{order}`").alias("_order"), row.alias("_row")) if order else F.struct(row.alias("_row"))
    last = (new.groupBy(F.col(f"`{key}`").alias("_key")).agg(F.max(rank).alias("_last"))  # combined before the shuffle
            .select("_last._row.*"))
    keys = new.select(F.col(f"`{key}`").alias("_key")).distinct()
    merged = (old.join(keys, old[key].eqNullSafe(keys["_key"]), "left_anti")
              .unionByName(last.select(*[F.col(f"`{c}`") for c in old.columns])))
    merged.write.mode("errorifexists").parquet(path)
    return merged
