"""Token files: documents as Parquet lists of ids, in order of their ids, for selective reads.

Each row is a document: its key, its number of tokens and the ids with the end id. Ids of up to some ten thousand
values pack well as dictionary codes; delta packing (``encoding="delta"``, the format's second version) is for
vocabularies too large for a dictionary page. Row groups and pages are kept small and have page indexes, so that a reader
takes the pages of a key range, or the counts without the ids.

Order: ascending key, null first, equal keys by text. Very long texts are one row whole. Null and empty texts hold the end id alone. An empty table
gives files without rows. Extra columns named in ``keep`` are written along; a clash with an output name is an error.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import cut, frugal, list_array, slices, temporary
from .bpe import byte_letters
from .pretoken import Memo, encode_texts

#: Rows of a file, where there are more of these than shuffle partitions.
RANGE_ROWS = 200_000
_loaded: dict[str, tuple] = {}


def _tokenizer(path: str) -> tuple:
    if path not in _loaded:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        whole = lambda texts: [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        letters = dict(enumerate(byte_letters()))
        merge = tokenizer.model.tokenize  # the library's merges of one piece, without the steps before and after
        ids = lambda pieces: [[t.id for t in merge(p.encode().decode("latin-1").translate(letters))] for p in pieces]
        specials = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        _loaded[path] = whole, Memo(ids, 1_200_000), specials
    return _loaded[path]


def encode_rows(texts: list[str | None], path: str) -> tuple[np.ndarray, np.ndarray]:
    """All ids one after another and the number of each text; a byte-level vocabulary with blanks before words.

    Each distinct piece goes through the library once; texts that hold a special token go through it whole.
    """
    encode, memo, specials = _tokenizer(path)
    texts = [t or "" for t in texts]
    odd = [k for k, t in enumerate(texts) if any(s in t for s in specials)]
    if not odd:
        return encode_texts(texts, memo, spaced=True)
    plain = list(texts)
    for k in odd:
        plain[k] = ""
    flat, counts = encode_texts(plain, memo, spaced=True)
    at = np.concatenate([[0], np.cumsum(counts)])
    whole = encode([texts[k] for k in odd])
    flat = np.insert(flat, np.repeat(at[odd], [len(w) for w in whole]), np.concatenate([np.array(w, np.int32) for w in whole]))
    counts[odd] = [len(w) for w in whole]
    return flat, counts


def tokenize(df: DataFrame, path: str, end_id: int, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows (key, kept columns, n_tokens, ids) of ``df``, ranged and sorted by key."""
    ranges = df.count() // RANGE_ROWS
    many = (ranges,) if ranges > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else ()
    rows = df.select(key, *keep, text).repartitionByRange(*many, key).sortWithinPartitions(key, text)
    schema = T.StructType([*df.select(key, *keep).schema.fields, T.StructField("n_tokens", T.IntegerType()), T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            flat, counts = encode_rows(batch.column(text).to_pylist(), path)
            flat = np.insert(flat, np.cumsum(counts), end_id)
            counts = counts + 1
            arrays = [batch.column(c) for c in (key, *keep)] + [pa.array(counts, pa.int32()), list_array(flat, counts, pa.int32())]
            yield pa.RecordBatch.from_arrays(arrays, [key, *keep, "n_tokens", "ids"])

    return rows.mapInArrow(frugal(run), schema)


def write_token_files(
    tokens: DataFrame, path: str, encoding: str = "dictionary", row_group_bytes: int = 32 << 20, page_bytes: int = 256 << 10, page_rows: int = 2_000
) -> None:
    """Write ranged token rows; part files are in order of the key."""
    if encoding not in ("dictionary", "delta"):
        raise ValueError(f"unknown encoding {encoding}")
    (
        tokens.write.option("compression", "zstd")
        .option("parquet.block.size", row_group_bytes)
        .option("parquet.page.size", page_bytes)
        .option("parquet.page.row.count.limit", page_rows)
        .option("parquet.enable.dictionary", str(encoding == "dictionary").lower())
        .option("parquet.dictionary.page.size", 1 << 20)
        .option("parquet.writer.version", "v1" if encoding == "dictionary" else "v2")
        .option("parquet.columnindex.truncate.length", 64)
        .parquet(path)
    )


def read_token_files(spark: SparkSession, path: str, columns: list[str] | None = None, where=None) -> DataFrame:
    """Token rows with their place (file, row); only the named columns and the pages that ``where`` needs are read."""
    rows = spark.read.parquet(path)
    if where is not None:
        rows = rows.filter(where)
    return rows.select(*(columns or rows.columns), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))


def starts(counts: DataFrame) -> DataFrame:
    """``counts`` (file, row, n_tokens and others) with ``start``, the tokens before each row in the order of the files.

    Sums run within each file; only one row a file is put in order over all of them.
    """
    within = Window.partitionBy("file").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    files = counts.groupBy("file").agg(F.sum("n_tokens").alias("in_file"))
    number = F.regexp_extract("file", r"part-(\d+)", 1).cast("bigint")  # names have five digits or more
    before = Window.orderBy(number, "file").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select("file", F.coalesce(F.sum("in_file").over(before), F.lit(0)).alias("before_file"))
    rows = counts.withColumn("before_row", F.coalesce(F.sum("n_tokens").over(within), F.lit(0)))
    return rows.join(files, "file").withColumn("start", F.col("before_file") + F.col("before_row")).drop("before_file", "before_row")


def checksums(tokens: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, file, row, n_tokens, ids_crc32): CRC-32 of the ids as little-endian unsigned 32-bit integers."""
    schema = T.StructType([*tokens.select(key, "file", "row").schema.fields, T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids")
            counts = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            raw = memoryview(np.ascontiguousarray(lists.flatten().to_numpy(zero_copy_only=False), "<u4")).cast("B")
            ends = 4 * np.concatenate([[0], np.cumsum(counts)])
            sums = [zlib.crc32(raw[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in (key, "file", "row")), pa.array(counts), pa.array(sums, pa.int64())], schema.fieldNames())

    return tokens.select(key, "file", "row", "ids").mapInArrow(frugal(run), schema)


def token_file_report(docs: DataFrame, path: str, end_id: int, key: str = "doc_id", text: str = "text", to: str | None = None) -> DataFrame:
    """Write the token files of ``docs`` and report each row as read back from them."""
    spark = docs.sparkSession
    to = to or temporary(spark, "tokens")
    write_token_files(tokenize(docs, path, end_id, key, text), to)
    return starts(cut(checksums(read_token_files(spark, to), key))).select(key, "start", "n_tokens", "ids_crc32")
