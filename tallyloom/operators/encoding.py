"""Inputs of fixed length for a text model, from a public tokenizer file whose path is a parameter."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

#: Tokens of a model input.
LENGTH = 64
#: Texts encoded at once.
ROWS = 1_000


def padded_ids(
    rows: DataFrame, tokenizer: str, id_col: str, text_col: str = "text", length: int = LENGTH, pad_id: int = 0, first_id: int | None = None, last_id: int | None = None
) -> DataFrame:
    """(id_col, input_ids, attention_mask) of each row: ids cut to ``length`` with the first and last id kept, then padded; null text is empty."""
    own = rows.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    fields = StructType.fromDDL("input_ids array<int>, attention_mask array<int>").fields
    head, tail = ([] if x is None else [x] for x in (first_id, last_id))
    room = length - len(head) - len(tail)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tokenizers import Tokenizer

        encode = Tokenizer.from_file(tokenizer).encode_batch
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                found = [[*head, *e.ids[:room], *tail] for e in encode([t or "" for t in batch.column("text").to_pylist()], add_special_tokens=False)]
                ids = [x + [pad_id] * (length - len(x)) for x in found]
                mask = [[1] * len(x) + [0] * (length - len(x)) for x in found]
                kind = pa.list_(pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(ids, kind), pa.array(mask, kind)], names=[id_col, "input_ids", "attention_mask"])

    return own.mapInArrow(run, StructType([StructField(id_col, own.schema["id"].dataType), *fields]))
