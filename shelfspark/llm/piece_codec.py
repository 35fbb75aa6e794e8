"""SentencePiece encoding and decoding (operator 8) with a distinct-chunk table.

Pieces of the model cannot cross the marker that stands for a blank, so a text is cut there, each distinct marked word is
segmented once and its ids are joined back by position. The table belongs to the task: a table for the whole corpus would
have to travel to every position of every word, which shuffles several times the input (see the README for figures).
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType

from .chunks import PieceCodec, slabs
from .common import column, fresh


def _mapped(df: DataFrame, source: str, out: str, kind, proto: bytes, work) -> DataFrame:
    """``df`` with column ``out`` made from column ``source`` by ``work(codec, values)``."""
    at = df.columns.index(source)
    arrow = pa.binary() if isinstance(kind, BinaryType) else pa.string()

    def kernel(batches):
        codec = PieceCodec(proto)
        for batch in batches:
            values = work(codec, batch.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, type=arrow)], names=[*batch.schema.names, out])

    return df.mapInArrow(kernel, df.withColumn(out, F.lit(None).cast(kind)).schema)


def _encode(codec: PieceCodec, texts: list) -> list:
    return [ids for part in slabs([t or "" for t in texts]) for ids in codec.encode(part)]


def _decode(codec: PieceCodec, ids: list) -> list:
    return [None if x is None else codec.decode([x])[0] for x in ids]


def read_model(path: str) -> bytes:
    """Content of the model file, read once on the driver and sent with the tasks."""
    with open(path, "rb") as f:
        return f.read()


def encode_pieces(df: DataFrame, text_col: str, proto: bytes, out: str = "ids") -> DataFrame:
    """``df`` with ``out``: begin id, the text's ids and end id as little-endian unsigned 32-bit integers.

    Null and empty texts give just the begin and the end id. Each row stands alone, so repeated rows and an empty table
    need no care; ``out`` must not be a column of ``df``.
    """
    if out.lower() in {c.lower() for c in df.columns}:
        raise ValueError(f"column {out} exists")
    return _mapped(df, text_col, out, BinaryType(), proto, _encode)


def decode_pieces(df: DataFrame, ids_col: str, proto: bytes, out: str = "decoded") -> DataFrame:
    """``df`` with ``out``: the text that the library decodes from ``ids_col``; null ids give null."""
    if out.lower() in {c.lower() for c in df.columns}:
        raise ValueError(f"column {out} exists")
    return _mapped(df, ids_col, out, StringType(), proto, _decode)


def encode_and_decode(df: DataFrame, text_col: str, proto: bytes, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Both in one pass over the rows."""
    at = df.columns.index(text_col)

    def kernel(batches):
        codec = PieceCodec(proto)
        for batch in batches:
            texts = batch.column(at)
            for start in range(0, max(1, len(texts)), 2000):
                part = batch.slice(start, 2000)
                found = _encode(codec, part.column(at).to_pylist())
                cols = [*part.columns, pa.array(found, type=pa.binary()), pa.array(_decode(codec, found), type=pa.string())]
                yield pa.RecordBatch.from_arrays(cols, names=[*part.schema.names, ids, decoded])

    schema = df.withColumn(ids, F.lit(None).cast("binary")).withColumn(decoded, F.lit(None).cast("string")).schema
    return df.mapInArrow(kernel, schema)


def piece_digests(df: DataFrame, proto: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row."""
    text, ids, decoded = fresh(df.select(column(df, id_col)), "text", "ids", "decoded")
    rows = df.select(column(df, id_col), column(df, text_col).cast("string").alias(text))
    out = encode_and_decode(rows, text, proto, ids, decoded)
    return out.select(
        column(out, id_col).alias("doc_id"), (F.octet_length(ids) / 4).cast("long").alias("n_tokens"),
        F.sha2(ids, 256).alias("ids_sha256"), F.sha2(decoded, 256).alias("decoded_sha256"))
