"""Pluggable model calls run in batches on the executors.

The reference calls a remote model once per item. Here the caller passes a plain
Python function over a *list* of texts; it is called once per Arrow batch inside
``mapInPandas``, on the executors, and any failure gives the reference's
fallback for that batch (zero vector, importance 0.5, a fixed text).
Without a function the defaults need no network: feature hashing for vectors
(``pyspark.ml`` HashingTF + L2 Normalizer, JVM-side) and the fallbacks.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.ml.feature import HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, StringType, StructField, StructType

from glint.functions.scalar import DEFAULT_IMPORTANCE, iso, merge_metadata, parse_score, resolve_importance
from glint.functions.text import tokenize
from glint.operators.memory import importance_prompt


def _with_column(df: DataFrame, name: str, dtype) -> StructType:
    fields = [f for f in df.schema.fields if f.name != name]
    return StructType(fields + [StructField(name, dtype, True)])


def _one_by_one(fn: Callable[[list], list], items: list, check: Callable, default) -> tuple[list, list[bool]]:
    """(answers, failed) of ``fn`` over a batch. If the batch as a whole fails or an answer does not pass
    ``check``, the items are tried one by one, and only those that fail on their own get ``default``."""
    def tried(some: list) -> list:
        got = list(fn(some))
        if len(got) != len(some):
            raise ValueError("one answer per item expected")
        return [check(x) for x in got]

    try:
        return tried(items), [False] * len(items)
    except Exception:
        answers, failed = [], []
        for x in items:
            try:
                answers += tried([x])
                failed.append(False)
            except Exception:
                answers.append(default)
                failed.append(True)
        return answers, failed


def embed(df: DataFrame, text: str = "content", fn: Callable[[list[str]], list] | None = None,
          dim: int = 64, out: str = "embedding", failed: str | None = None, keep: str | None = None) -> DataFrame:
    """Add a vector column. ``fn(texts) -> vectors``; a text on which it fails gets a zero vector.
    ``failed`` names a boolean column that marks such rows. ``keep`` names a column whose vectors are kept: only rows
    without one reach the embedder, in the same pass."""
    if fn is None:
        tokens = F.coalesce(tokenize(text), F.array().cast("array<string>"))
        if keep:
            tokens = F.when(F.col(keep).isNull(), tokens).otherwise(F.array().cast("array<string>"))
        tok = df.withColumn("_tok", tokens)
        tf = HashingTF(inputCol="_tok", outputCol="_tf", numFeatures=dim).transform(tok)
        nv = Normalizer(inputCol="_tf", outputCol="_nv", p=2.0).transform(tf)
        vec = vector_to_array("_nv").cast("array<float>")
        vec = F.coalesce(F.col(keep).cast("array<float>"), vec) if keep else vec
        done = nv.withColumn(out, vec).drop("_tok", "_tf", "_nv")
        return done.withColumn(failed, F.lit(False)) if failed else done

    schema = _with_column(df, out, ArrayType(DoubleType()))
    if failed:
        schema = StructType([f for f in schema.fields if f.name != failed] + [StructField(failed, BooleanType(), True)])

    def vector(v) -> list[float]:
        v = list(map(float, v))
        if len(v) != dim:
            raise ValueError("embedding has the wrong length")
        return v

    def run(batches):
        for pdf in batches:
            vecs: list = [None] * len(pdf) if keep is None else [None if v is None else list(v) for v in pdf[keep]]
            todo = [i for i, v in enumerate(vecs) if v is None]
            made, bad = _one_by_one(fn, pdf[text].fillna("").iloc[todo].tolist(), vector, [0.0] * dim) if todo else ([], [])
            marks = [False] * len(pdf)
            for i, v, b in zip(todo, made, bad, strict=True):
                vecs[i], marks[i] = v, b
            pdf = pdf.assign(**{out: vecs} | ({failed: marks} if failed else {}))
            yield pdf[schema.names]
    return df.mapInPandas(run, schema).withColumn(out, F.col(out).cast("array<float>"))


def fill_embeddings(docs: DataFrame, fn=None, text: str = "content", vec: str = "embedding", dim: int = 64) -> DataFrame:
    """Keep stored vectors; compute the missing ones (J6 + U1), in one pass. Adds ``vector_source``."""
    marked = docs.withColumn("vector_source", F.when(F.col(vec).isNull(), "computed").otherwise("stored"))
    return embed(marked, text, fn, dim, vec, keep=vec)


def enrich(df: DataFrame, prompt: str, fn: Callable[[list[str]], list[str]] | None, out: str,
           default: str, failed: str | None = None, where: str | None = None) -> DataFrame:
    """Text-to-text per row in batches; without a function, and for each item on which it fails,
    the answer is ``default``. ``failed`` names a boolean column that marks such rows; ``where`` a boolean column:
    only rows where it is true are asked about, the others get NULL."""
    if fn is None:
        df = df.withColumn(out, F.when(F.col(where), F.lit(default)) if where else F.lit(default))
        return df.withColumn(failed, F.lit(True)) if failed else df
    schema = _with_column(df, out, StringType())
    if failed:
        schema = StructType([f for f in schema.fields if f.name != failed] + [StructField(failed, BooleanType(), True)])

    def run(batches):
        for pdf in batches:
            todo = range(len(pdf)) if where is None else [i for i, x in enumerate(pdf[where]) if x is True or x == True]  # noqa: E712
            prompts = pdf[prompt].fillna("").iloc[list(todo)].tolist()
            answers, bad = _one_by_one(fn, prompts, lambda a: default if a is None else str(a), default) if prompts else ([], [])
            full, marks = [None] * len(pdf), [False] * len(pdf)
            for i, a, b in zip(todo, answers, bad, strict=True):
                full[i], marks[i] = a, b
            pdf = pdf.assign(**{out: pd.Series(full, dtype=object, index=pdf.index)} | ({failed: marks} if failed else {}))
            yield pdf[schema.names]
    return df.mapInPandas(run, schema)


def score_importance(memories: DataFrame, fn: Callable[[list[str]], list[str]] | None = None) -> DataFrame:
    """U2 + V13: memories whose importance is the sentinel 1.0 get a model score,
    parsed and clamped (V12); no model or an unparsable answer gives 0.5. One pass: only those rows are asked about."""
    p = memories.withColumn("_ask", F.coalesce(F.col("importance") == 1.0, F.lit(False)))
    p = p.withColumn("_prompt", F.when(F.col("_ask"), importance_prompt(
        F.col("memory_type"), F.col("content"), F.col("context") if "context" in memories.columns else F.lit(None).cast("string"))))
    scored = enrich(p, "_prompt", fn, "_answer", str(DEFAULT_IMPORTANCE), where="_ask")
    return (scored.withColumn("importance", resolve_importance(F.col("importance"), parse_score(F.col("_answer"))))
            .drop("_prompt", "_answer", "_ask"))


def memory_id(memory_type, ts, content):
    """Stable id from type, time and content (the reference's wall-clock id can collide)."""
    return F.sha2(F.concat_ws("|", memory_type, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), content), 256)


def with_ids(df: DataFrame) -> DataFrame:
    """Memories with their stable ``id``; of rows of one batch with the same id (same type, time and text) one stays,
    that with the lowest importance."""
    m = df.withColumn("id", memory_id(F.col("memory_type"), F.col("timestamp"), F.col("content")))
    first = F.row_number().over(Window.partitionBy("id").orderBy(F.col("importance"), *[
        F.col(c) for c in ("context", "memory_id") if c in df.columns]))
    return m.withColumn("_n", first).filter(F.col("_n") == 1).drop("_n")


def prepare_memories(df: DataFrame, scorer=None, embedder=None, dim: int = 64) -> DataFrame:
    """S5 steps before writing: score the sentinel rows, embed, and merge the reserved metadata keys (computed keys
    win): importance, timestamp, and, where a memory has them, context and emotions as JSON (V16)."""
    m = embed(score_importance(df, scorer), "content", embedder, dim)
    reserved = F.create_map(F.lit("importance"), F.col("importance").cast("string"), F.lit("timestamp"), iso("timestamp"))
    if "context" in df.columns:
        reserved = F.map_concat(reserved, F.when(F.coalesce(F.col("context"), F.lit("")) != "", F.create_map(
            F.lit("context"), F.col("context"))).otherwise(F.create_map().cast("map<string,string>")))
    if "emotions" in df.columns:
        reserved = F.map_concat(reserved, F.when(F.size("emotions") > 0, F.create_map(
            F.lit("emotions"), F.to_json("emotions"))).otherwise(F.create_map().cast("map<string,string>")))
    own = F.coalesce(F.col("metadata"), F.create_map().cast("map<string,string>"))
    return m.withColumn("metadata", merge_metadata(own, reserved))


def stored_ids(spark, path: str, batch: DataFrame) -> DataFrame | None:
    """Ids in the table at ``path`` of the types and days that ``batch`` touches: the others are pruned before the
    scan. None when there is no table yet."""
    try:
        have = spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None
    days = batch.groupBy("memory_type").agg(F.min("day").alias("lo"), F.max("day").alias("hi"),
                                            F.max(F.col("day").isNull()).alias("none")).collect()     # a row per type
    touched = F.lit(False)
    for r in days:
        some = F.col("day").between(F.lit(r["lo"]), F.lit(r["hi"])) if r["lo"] is not None else F.lit(False)
        some = some | F.col("day").isNull() if r["none"] else some
        touched = touched | (F.col("memory_type").eqNullSafe(F.lit(r["memory_type"])) & some)
    return have.filter(touched).select("id")


def append_memories(df: DataFrame, path: str, scorer=None, embedder=None, dim: int = 64,
                    idempotent: bool = True) -> str:
    """Write prepared memories to the table at ``path``, in folders by type and day.

    With ``idempotent`` the ids already stored are skipped before any model is called (an anti join on the
    ids stored for the batch's types and days), so replaying a batch after a failure writes nothing twice.
    Returns ``path``; read the table from there.
    """
    df = df.withColumn("day", F.to_date("timestamp"))
    have = stored_ids(df.sparkSession, path, df) if idempotent else None       # types and days need no ids
    m = with_ids(df)
    if have is not None:
        m = m.join(have, "id", "left_anti")
    prepare_memories(m, scorer, embedder, dim).write.mode("append").partitionBy("memory_type", "day").parquet(path)
    return path
