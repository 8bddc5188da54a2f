"""Token counts as a delta-maintained rollup by source, language and tokenizer version.

A batch of changes is turned into signed rows (an insert adds, a delete takes off, a
revision does both), summed per key and committed to a folder of its own. Totals are the
sum over committed batches, so a batch costs what it changes, not what is stored. A batch
id that is committed already changes nothing, so a batch can be run again after any failure.
"""

from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.llm.texts import pieces, split_words, text_array
from shelfmark.llm.token_files import encoder

KEY = ("source", "lang", "tokenizer_version")
WORDS = "words-1"
_COUNTS = "doc_id bigint, source string, lang string, tokenizer_version string, n_tokens bigint"


def count_tokens(docs: DataFrame, tokenizers: dict[str, str]) -> DataFrame:
    """One row per document and tokenizer version: doc_id, source, lang, tokenizer_version, n_tokens.

    ``tokenizers`` maps a version to a tokenizer file (see WordEncoder for which are fit); the
    version WORDS counts runs without white space and is always given. Null text counts as
    empty (0 tokens). Source and lang may be null. Other columns are not read.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text"):
            texts = text_array(piece.column("text"))
            same = [piece.column("doc_id").cast(pa.int64()), piece.column("source"), piece.column("lang")]
            found = {WORDS: split_words(texts)[0], **{v: encoder(path).encode(texts)[0] for v, path in tokenizers.items()}}
            for version, counts in found.items():
                yield pa.RecordBatch.from_arrays(
                    [*same, pa.array([version] * piece.num_rows), pa.array(counts, pa.int64())],
                    ["doc_id", "source", "lang", "tokenizer_version", "n_tokens"],
                )

    typed = [F.col("doc_id").cast("bigint"), *(F.col(c).cast("string") for c in ("text", "source", "lang"))]
    return docs.select(*(c.alias(n) for c, n in zip(typed, ("doc_id", "text", "source", "lang")))).mapInArrow(count, _COUNTS)


def inserted(rows: DataFrame) -> DataFrame:
    return rows.select(*KEY, F.lit(1).cast("bigint").alias("docs"), F.col("n_tokens").alias("tokens"))


def deleted(rows: DataFrame) -> DataFrame:
    return rows.select(*KEY, F.lit(-1).cast("bigint").alias("docs"), (-F.col("n_tokens")).alias("tokens"))


def revised(before: DataFrame, after: DataFrame) -> DataFrame:
    """What was counted before goes, what counts now comes; source, language and version may change with it."""
    return deleted(before).unionByName(inserted(after))


def _folder(store: str, batch: str) -> str:
    return f"{store}/batch={quote(batch, safe='')}"


def _marked(spark: SparkSession, pattern: str) -> list[str]:
    """The folders of a pattern whose writing has ended with a success mark."""
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{pattern}/_SUCCESS")
    found = mark.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(mark)
    return sorted(str(f.getPath().getParent().toString()) for f in found or ())


def _compacted(spark: SparkSession, store: str) -> tuple[str | None, set[str]]:
    """The latest compaction and the folder names of the batches in it: one short name per batch."""
    last = max(_marked(spark, f"{store}/compacted-*"), default=None)
    if last is None:
        return None, set()
    return last, {r[0] for r in spark.read.schema(_SUMS).parquet(last).filter("batch is not null").select("batch").collect()}


def _new_folders(spark: SparkSession, store: str, known: set[str]) -> list[str]:
    return [f for f in _marked(spark, f"{store}/batch=*") if f.rsplit("/", 1)[1] not in known]


def commit(store: str, batch: str, signed: DataFrame) -> bool:
    """Sum the signed rows of a batch into the store; False if the batch was committed before.

    A batch left half-written by a failure has no success mark, is in no total, and is written anew.
    One writer per batch id is assumed. Ids may hold any characters.
    """
    spark, folder = signed.sparkSession, _folder(store, batch)
    if _marked(spark, folder) or folder.rsplit("/", 1)[1] in _compacted(spark, store)[1]:
        return False
    summed = signed.groupBy(*KEY).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
    summed.filter("docs <> 0 or tokens <> 0").write.mode("overwrite").parquet(folder)
    return True


_SUMS = "source string, lang string, tokenizer_version string, docs bigint, tokens bigint, batch string"


def _sums(spark: SparkSession, store: str) -> tuple[DataFrame, set[str]]:
    """The rows of all committed batches, those of compacted ones as their sums, and the batches' folder names."""
    last, known = _compacted(spark, store)
    new = _new_folders(spark, store, known)
    rows = spark.read.schema(_SUMS).parquet(*([last] if last else []), *new) if last or new else spark.createDataFrame([], _SUMS)
    return rows, known | {f.rsplit("/", 1)[1] for f in new}


def _summed(rows: DataFrame) -> DataFrame:
    return rows.filter("docs is not null").groupBy(*KEY).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))


def compact(spark: SparkSession, store: str) -> None:
    """Write the sums of all batches committed so far, and which these are, in one commit.

    Totals then read this and later batches. What was compacted may be deleted afterwards.
    """
    rows, names = _sums(spark, store)
    number = len(_marked(spark, f"{store}/compacted-*"))
    listed = spark.createDataFrame([(n,) for n in sorted(names)], "batch string")
    both = _summed(rows).unionByName(listed, allowMissingColumns=True)
    both.write.mode("overwrite").parquet(f"{store}/compacted-{number:09d}")


def totals(spark: SparkSession, store: str) -> DataFrame:
    """Source, lang, tokenizer_version, n_docs and n_tokens of keys that hold documents or tokens.

    Null is a source or language of its own. A key with tokens and no documents, or with less
    than none, is shown: a delete took off what was not there.
    """
    summed = _summed(_sums(spark, store)[0])
    return summed.select(*KEY, F.col("docs").alias("n_docs"), F.col("tokens").alias("n_tokens")).filter("n_docs <> 0 or n_tokens <> 0")
