"""Token counts of a byte-level BPE by the whole-token shortcut.

A pre-token whose string encodes alone as one vocabulary entry costs one token,
whatever stands around it. The set of such strings is proved from the tokenizer
itself before any text is read; counting a text is then one regular-expression
split, set look-ups, and merges for the few pre-tokens that are left (see ``bpe.ByteCounter``).
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.llm.bpe import byte_counter


def count_tokens(
    docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 512
) -> DataFrame:
    """``id_col, n_bytes, n_tokens, over_limit`` for every row of ``docs``.

    ``tokenizer`` is the path of a byte-level BPE in the ``tokenizers`` format, present on every
    executor. No begin, end or added tokens, no truncation; special
    strings inside a text count as the library counts them by default. A null text
    counts as empty (0 bytes, 0 tokens); repeated rows are returned
    as often as they come; other columns are ignored; an empty table gives no rows.

    One narrow pass without a shuffle; a task holds one Arrow batch of texts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = byte_counter(tokenizer)
        for batch in batches:
            counts = [counter.count(t or "") for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("n_bytes"), pa.array(counts, pa.int64())],
                ["id", "n_bytes", "n_tokens"],
            )

    src = docs.select(
        F.col(id_col).alias("id"),
        F.col(text_col).alias("text"),
        F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"),
    )
    kind = src.schema["id"].dataType.simpleString()
    counted = src.mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long")
    return counted.select(
        F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )
