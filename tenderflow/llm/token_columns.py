"""Token ids in Parquet list columns: dictionary encoded ids, delta encoded numbers, small row groups and pages with page indexes.

The files hold doc_id, place, n_tokens and ids, in ascending order of doc_id over all files; place, a hash of the text, orders rows of one id. The ids of a 50,000 word vocabulary take a
dictionary per row group and 16 bits each or less; doc_id and n_tokens, which a dictionary would not shrink, are delta
encoded (format version 2). Row groups and pages are small and the page index is written, so a reader that wants some documents or only
the lengths reads those pages alone.

Nulls: a null text is empty, and an empty document is its end id alone. A null id sorts first. Repeated ids stay, each with
its own row, in the order of their texts' hash. Only id and text are read; other columns are left out. An empty table gives files without rows.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenderflow.llm.common import running_total, stored, table, work_dir
from tenderflow.llm.tokens import encoder, in_batches

END = 0
LAYOUT = {
    "parquet.writer.version": "PARQUET_2_0",
    "parquet.enable.dictionary": "true",
    "parquet.enable.dictionary#doc_id": "false",
    "parquet.enable.dictionary#place": "false",
    "parquet.enable.dictionary#n_tokens": "false",
    "parquet.block.size": str(16 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "20000",
    "compression": "zstd",
}


COLUMNS = "doc_id long, place long, n_tokens long, ids array<int>"


def encode_documents(docs: DataFrame, tokenizer: str, kind: str = "byte", end: int = END, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, place, n_tokens, ids) in ascending order of doc_id and place, by range partitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_encoder = encoder(tokenizer, kind, end)
        for batch in batches:
            keys, places = batch.column(0), batch.column(1)
            for part in in_batches(batch.column(2)):
                ids, sizes = own_encoder.encode(part.texts, end)
                at = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                own = pa.ListArray.from_arrays(pa.array(at), pa.array(ids))
                of = [c.slice(part.first, len(part.texts)) for c in (keys, places)]
                yield pa.RecordBatch.from_arrays([*of, pa.array(sizes), own], ["doc_id", "place", "n_tokens", "ids"])

    df = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text).alias("place"), F.col(text).alias("text"))
    ordered = df.repartitionByRange("doc_id", "place").sortWithinPartitions("doc_id", "place")
    return ordered.mapInArrow(run, COLUMNS)


def write_tokens(tokens: DataFrame, path: str) -> None:
    tokens.write.options(**LAYOUT).parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(COLUMNS).parquet(path)


def read_documents(spark: SparkSession, path: str, first: int, last: int, columns: tuple[str, ...] = ("doc_id", "n_tokens", "ids")) -> DataFrame:
    """Documents with ids from `first` to `last`, and of them some columns only.

    The range reaches the scan, which leaves out the files, row groups and pages whose bounds do not meet it; lengths are read without any ids.
    """
    return read_tokens(spark, path).where(F.col("doc_id").between(first, last)).select(*columns)


def checksums(tokens: DataFrame) -> DataFrame:
    """(doc_id, place, n_tokens, ids_crc32): read from the ids in the files, not from the n_tokens beside them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            ids, at = lists.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False), lists.offsets.to_numpy()
            crc = [zlib.crc32(ids[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.diff(at).astype(np.int64)), pa.array(crc, pa.int64())], ["doc_id", "place", "n_tokens", "ids_crc32"])

    return tokens.select("doc_id", "place", "ids").mapInArrow(run, "doc_id long, place long, n_tokens long, ids_crc32 long")


def op9_token_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = f"{work_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write_tokens(encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")), path)
    # Stored, since dealing out by ranges reads its input twice, and the ids should be read once.
    back = stored(checksums(read_tokens(spark, path)), "checksums")
    # In the order of the files.
    return running_total(back, ["doc_id", "place"], "n_tokens", "start").select("doc_id", "start", "n_tokens", "ids_crc32")
