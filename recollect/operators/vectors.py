"""The vector table beside the facts: what to encode, what to drop."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def source_text() -> Column:
    return F.concat_ws(" ", "subject", "predicate", "object")


def plan(facts: DataFrame, vectors: DataFrame, model: str, dim: int) -> DataFrame:
    """``uid, id, action`` for each fact or vector that needs one: encode (new, changed, other model or length) or drop (no such fact)."""
    wanted = facts.where(F.col("status").isin("active", "pending")).select("uid", "id", T.text_hash(source_text()).alias("hash"))
    held = vectors.select("uid", F.col("fact_id").alias("id"), "text_hash", "dim", F.col("model").alias("m"))
    rows = wanted.join(held, ["uid", "id"], "full")
    fresh = F.col("text_hash").eqNullSafe(F.col("hash")) & (F.col("dim") == dim) & (F.col("m") == model)
    action = F.when(F.col("hash").isNull(), "drop").when(~F.coalesce(fresh, F.lit(False)), "encode")
    return rows.select("uid", "id", action.alias("action")).where("action is not null")


def orphans(vectors: DataFrame, facts: DataFrame) -> DataFrame:
    return vectors.join(facts.select("uid", F.col("id").alias("fact_id")), ["uid", "fact_id"], "left_anti")


def encode(rows: DataFrame, encoder, model: str, batch: int = 32) -> DataFrame:
    """``uid, id, text`` to vectors by ``encoder(list of texts) -> list of vectors or None``; a batch that fails is left for the next run."""

    def run(parts):
        import pandas as pd

        for pdf in parts:
            for lo in range(0, len(pdf), batch):
                part = pdf.iloc[lo : lo + batch]
                found = encoder(part.text.tolist())
                if found is not None:
                    yield pd.DataFrame({"uid": part.uid.to_numpy(), "fact_id": part.id.to_numpy(), "dim": [len(v) for v in found], "vec": [list(map(float, v)) for v in found], "text": part.text.to_numpy()})

    out = rows.select("uid", "id", "text").mapInPandas(run, "uid string, fact_id string, dim int, vec array<float>, text string")
    return out.select("uid", "fact_id", "dim", "vec", T.text_hash(F.col("text")).alias("text_hash"), F.lit(model).alias("model"))


def reindex(facts: DataFrame, vectors: DataFrame, encoder, model: str, dim: int) -> DataFrame:
    """The vector table as it should be."""
    todo = plan(facts, vectors, model, dim)
    kept = vectors.join(todo.select("uid", F.col("id").alias("fact_id")), ["uid", "fact_id"], "left_anti")
    new = facts.join(todo.where("action = 'encode'"), ["uid", "id"], "left_semi").select("uid", "id", source_text().alias("text"))
    return kept.unionByName(encode(new, encoder, model).where(F.col("dim") == dim))


def mock_encode(facts: DataFrame, dim: int = 64) -> DataFrame:
    """Vectors by the built-in stand-in encoder, without Python."""
    text = source_text()
    return facts.select("uid", F.col("id").alias("fact_id"), F.lit(dim).alias("dim"), T.mock_embedding(text, dim).alias("vec"), T.text_hash(text).alias("text_hash"), F.lit("mock").alias("model"))


def stats(facts: DataFrame, vectors: DataFrame, model: str | None = None) -> DataFrame:
    """Facts, vectors, how many are missing, the greatest length, the models; with ``model`` whether vectors are of others."""
    f = facts.where(F.col("status").isin("active", "pending")).groupBy("uid").agg(F.count("*").alias("facts"))
    v = vectors.groupBy("uid").agg(F.count("*").alias("vectors"), F.max("dim").alias("dim"), F.array_sort(F.collect_set("model")).alias("models"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    rows = f.join(v, "uid", "full").withColumns({"facts": zero("facts"), "vectors": zero("vectors"), "dim": zero("dim")})
    rows = rows.withColumns({"stale": F.greatest(F.lit(0), F.col("facts") - F.col("vectors")), "models": F.coalesce("models", F.array().cast("array<string>"))})
    other = (F.col("vectors") > 0) & (F.col("models") != F.array(F.lit(model))) if model else F.lit(False)
    return rows.withColumn("model_mismatch", other)
