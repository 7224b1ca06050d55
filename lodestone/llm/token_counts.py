"""Token counts by the whole-token shortcut."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import tokens

#: Fixed value: texts with more tokens than this are over the limit.
LIMIT = 2048


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, ``n_bytes`` (UTF-8), ``n_tokens``, ``over_limit``.

    Vocabulary strings proved on the driver to be one token are counted
    without merging; they go to the workers as one broadcast whose size is
    that of the vocabulary.  No shuffle.  Null texts count as empty (0 bytes,
    0 tokens), null ids stay null, repeated rows give repeated results, other
    columns are not read, and an empty table gives an empty result.  Texts of
    any length are read whole.
    """
    spark = docs.sparkSession
    proved = spark.sparkContext.broadcast(tokens.whole_tokens(path))
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = narrow.schema["doc_id"].dataType.simpleString()

    sized = narrow.withColumn("text", F.coalesce("text", F.lit("")))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = None
        for batch in batches:
            counter = counter or tokens.TokenCounter(path, proved.value)
            n_bytes = pc.cast(pc.binary_length(batch.column(1)), pa.int64())
            n_tokens = pa.array(counter.batch(batch.column(1).to_pylist()), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), n_bytes, n_tokens], ["doc_id", "n_bytes", "n_tokens"])

    out = sized.mapInArrow(count, f"doc_id {kind}, n_bytes bigint, n_tokens bigint")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
