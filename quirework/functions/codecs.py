"""Text and byte decoders that Spark's own functions lack, as Arrow-batched UDFs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import BinaryType, IntegerType, StringType, StructField, StructType

from quirework.functions.decoding import decode_bytes, entities_resolved, image_size, lz77_compress, lz77_decompress, percent_decoded


@pandas_udf(StringType())
def resolve_entities(s: pd.Series) -> pd.Series:
    return s.map(entities_resolved, na_action="ignore")


@pandas_udf(StringType())
def percent_decode(s: pd.Series) -> pd.Series:
    return s.map(percent_decoded, na_action="ignore")


@pandas_udf(StringType())
def decode_text(raw: pd.Series, declared: pd.Series) -> pd.Series:
    return pd.Series([decode_bytes(a, b) for a, b in zip(raw, declared, strict=True)], dtype="object")


@pandas_udf(StructType([StructField("width", IntegerType()), StructField("height", IntegerType())]))
def image_dimensions(raw: pd.Series) -> pd.DataFrame:
    sizes = [image_size(x) for x in raw]
    return pd.DataFrame({"width": pd.array([s[0] for s in sizes], "Int32"), "height": pd.array([s[1] for s in sizes], "Int32")})


@pandas_udf(BinaryType())
def palmdoc_decompress(raw: pd.Series) -> pd.Series:
    return raw.map(lambda x: lz77_decompress(bytes(x)), na_action="ignore")


@pandas_udf(BinaryType())
def palmdoc_compress(raw: pd.Series) -> pd.Series:
    return raw.map(lambda x: None if x is None else lz77_compress(bytes(x)))
