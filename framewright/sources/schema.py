"""Declared features as Spark schemas, and checks of rows against them."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Declared dtypes and their types here; unsigned ones are widened.
DTYPES = {
    "bool": T.BooleanType(), "int8": T.ByteType(), "int16": T.ShortType(), "int32": T.IntegerType(), "int64": T.LongType(),
    "uint8": T.ShortType(), "uint16": T.IntegerType(), "uint32": T.LongType(), "float16": T.FloatType(), "float32": T.FloatType(),
    "float64": T.DoubleType(), "string": T.StringType(), "binary": T.BinaryType(),
}

#: Columns that every frame table has.
DEFAULT_FEATURES = {
    "timestamp": ("float32", (1,)), "frame_index": ("int64", (1,)), "episode_index": ("int64", (1,)), "index": ("int64", (1,)),
    "task_index": ("int64", (1,)),
}

IMAGE = T.StructType([T.StructField("bytes", T.BinaryType()), T.StructField("path", T.StringType())])


def feature_type(dtype: str, shape: tuple[int, ...]) -> T.DataType | None:
    """The column's type; none for videos, which are not stored in the table.  Shapes go up to five dims."""
    if dtype == "video":
        return None
    if dtype == "image":
        return IMAGE
    if len(shape) > 5:
        raise ValueError(f"{len(shape)} dims are more than five")
    kind: T.DataType = DTYPES[dtype]
    if tuple(shape) == (1,):
        return kind
    for _ in shape:
        kind = T.ArrayType(kind)
    return kind


def table_schema(features: dict[str, dict[str, Any]]) -> T.StructType:
    """The frame table's schema from its declaration; names may not contain "/"."""
    bad = [n for n in features if "/" in n]
    if bad:
        raise ValueError(f"names with a slash: {bad}")
    declared = {n: (f["dtype"], tuple(f["shape"])) for n, f in features.items()} | DEFAULT_FEATURES
    kinds = {n: feature_type(*f) for n, f in declared.items()}
    return T.StructType([T.StructField(n, k) for n, k in kinds.items() if k is not None])


def names_of(features: dict[str, dict[str, Any]], *dtypes: str) -> list[str]:
    """Names of the features declared with one of the dtypes."""
    return [n for n, f in features.items() if f["dtype"] in dtypes]


def joint_features(joints: list[str], cameras: dict[str, tuple[int, int, int]], prefix: str = "observation") -> dict[str, dict[str, Any]]:
    """A declaration from a machine's joints and cameras."""
    out: dict[str, dict[str, Any]] = {}
    if joints:
        out[f"{prefix}.state"] = {"dtype": "float32", "shape": (len(joints),), "names": joints}
    out |= {f"{prefix}.images.{c}": {"dtype": "video", "shape": s, "names": ["height", "width", "channels"]} for c, s in cameras.items()}
    return out


def schema_faults(df: DataFrame, schema: T.StructType) -> list[str]:
    """What a table lacks, has too much, or has of another type."""
    have = {f.name: f.dataType for f in df.schema}
    want = {f.name: f.dataType for f in schema}
    return (
        [f"missing {n}" for n in want if n not in have]
        + [f"extra {n}" for n in have if n not in want]
        + [f"{n} is {have[n].simpleString()}, not {k.simpleString()}" for n, k in want.items() if n in have and have[n] != k]
    )


def width_faults(df: DataFrame, widths: dict[str, int], *keys: str) -> DataFrame:
    """keys, feature, width of the vectors whose width is not as declared."""
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("feature"), F.size(F.col(f"`{n}`")).alias("width"), F.lit(w).alias("w")) for n, w in widths.items()]))
    return df.select(*keys, each.alias("f")).filter("f.width <> f.w").select(*keys, "f.feature", "f.width")


def flatten(df: DataFrame, separator: str = "/") -> DataFrame:
    """Nested structs as columns whose names join the path."""

    def leaves(kind: T.StructType, path: list[str]):
        for f in kind:
            if isinstance(f.dataType, T.StructType):
                yield from leaves(f.dataType, [*path, f.name])
            else:
                yield [*path, f.name]

    quote = lambda path: ".".join(f"`{p}`" for p in path)
    return df.select(*[F.col(quote(p)).alias(separator.join(p)) for p in leaves(df.schema, [])])


def unflatten(df: DataFrame, separator: str = "/") -> DataFrame:
    """The reverse of ``flatten``."""
    tree: dict[str, Any] = {}
    for name in df.columns:
        node = tree
        *path, leaf = name.split(separator)
        for p in path:
            node = node.setdefault(p, {})
        node[leaf] = F.col(f"`{name}`")

    def build(node):
        return F.struct(*[build(v).alias(k) for k, v in node.items()]) if isinstance(node, dict) else node

    return df.select(*[build(v).alias(k) for k, v in tree.items()])
