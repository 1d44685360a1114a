"""Feature-vector expressions over ``ARRAY<DOUBLE>``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowspark.functions.keys import col
from flowspark.schemas import FEATURES


def _from_map(features: Column, names: Sequence[str]) -> Column:
    """Map values in name order. A map already in that order (the usual case) is taken as it is."""
    wanted = F.array(*[F.lit(n) for n in names])
    return F.when(
        F.map_keys(features) == wanted, F.transform(F.map_values(features), lambda v: v.try_cast("double"))
    ).otherwise(F.transform(wanted, lambda n: F.try_element_at(features, n).try_cast("double")))


def _vector(df: DataFrame, names: Sequence[str], flat_ok: bool) -> Column:
    """The features as doubles (null where missing) from the nested form, else from flat columns."""
    flat = None
    if flat_ok:
        flat = F.array(
            *[(F.col(n) if n in df.columns else F.lit(None)).try_cast("double") for n in names]
        )
    nested = None
    if "features" in df.columns:
        kind = df.schema["features"].dataType
        if isinstance(kind, T.MapType):
            # bound once: the map may be an expression, not a scanned column
            nested = F.get(F.transform(F.array("features"), lambda m: _from_map(m, names)), F.lit(0))
        elif isinstance(kind, T.StructType):
            has = kind.fieldNames()
            nested = F.array(
                *[(F.col(f"features.{n}") if n in has else F.lit(None)).try_cast("double") for n in names]
            )
    if nested is not None and flat is not None:
        return F.when(F.col("features").isNotNull(), nested).otherwise(flat)
    if nested is not None:
        return nested
    return flat if flat is not None else F.array(*[F.lit(None).cast("double") for _ in names])


def strict_vector(df: DataFrame, names: Sequence[str] = FEATURES, flat_ok: bool = True) -> DataFrame:
    """Add ``vec``; rows lacking any feature, or with a non-numeric one, are dropped.

    The test sits inside a generator, so the vector is built once per row (a filter would be
    pushed below the projection and build it again).
    """
    whole = F.filter(F.array(_vector(df, names, flat_ok)), lambda v: ~F.exists(v, lambda x: x.isNull()))
    return df.select(*[c for c in df.columns if c != "vec"], F.explode(whole).alias("vec"))


def lenient_vector(df: DataFrame, names: Sequence[str] = FEATURES) -> DataFrame:
    """Add ``vec`` with 0 for missing or non-numeric features; a missing ``timestamp`` becomes now."""
    filled = F.transform(_vector(df, names, True), lambda v: F.coalesce(v, F.lit(0.0)))
    out = df.withColumn("vec", filled)
    if "timestamp" in df.columns:
        now = F.unix_micros(F.current_timestamp()) / 1e6
        out = out.withColumn(
            "timestamp", F.coalesce(F.nullif(F.col("timestamp").try_cast("double"), F.lit(0.0)), now)
        )
    return out


def select_features(vec: str | Column, names: Sequence[str]) -> Column:
    """Named elements in the requested order; unknown names are ignored."""
    value = col(vec)
    index = {n: i for i, n in enumerate(FEATURES)}
    return F.array(*[F.get(value, F.lit(index[n])) for n in names if n in index])


def zscore(vec: str | Column, means: Column, stds: Column) -> Column:
    """``(v - m) / s``, 0 where ``s`` is not positive. All three must have one length."""
    value = col(vec)
    pairs = F.arrays_zip(means.alias("m"), stds.alias("s"))
    scaled = F.zip_with(
        value,
        pairs,
        lambda v, p: F.when(p["s"] > 0, (v - p["m"]) / p["s"]).otherwise(F.lit(0.0)),
    )
    same = (F.size(value) == F.size(means)) & (F.size(means) == F.size(stds))
    return F.when(same, scaled).otherwise(
        F.raise_error(F.lit("zscore: vector, means and stds differ in length")).cast("array<double>")
    )


def zscore_sequence(seq: str | Column, means: Column, stds: Column) -> Column:
    """z-score of every vector of a sequence."""
    return F.transform(col(seq), lambda v: zscore(v, means, stds))


def labelled_vectors(df: DataFrame, label: str = "label", flat_ok: bool = False) -> DataFrame:
    """Rows with a complete vector and a label that reads as 0 or 1 (column ``y``)."""
    y = F.col(label).try_cast("int")
    return strict_vector(df.withColumn("y", y).filter(F.col("y").isin(0, 1)), flat_ok=flat_ok)


def vector_error(orig: Column, recon: Column) -> Column:
    """Mean squared difference of two equally long vectors."""
    total = F.aggregate(
        F.zip_with(orig, recon, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x
    )
    return total / F.size(orig)


def sequence_error(orig: Column, recon: Column) -> Column:
    """Mean squared difference over all elements of two windows of vectors."""
    return vector_error(F.flatten(orig), F.flatten(recon))


def literal_vector(values: Sequence[float]) -> Column:
    """A fixed, feature-sized parameter vector as an expression."""
    return F.array(*[F.lit(float(v)) for v in values])
