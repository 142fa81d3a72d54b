"""Add columns to a table by a function over packs of texts, in one narrow stage."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from linkloom.llm import text_arrays as ta
from linkloom.llm.text_stats import Texts


def annotate(docs: DataFrame, text_col: str, added: str, make: Callable[[Texts], Sequence],
             carry: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``carry``) plus the columns ``added`` (a DDL schema).

    ``make`` gets the texts of a pack ('' for null) and returns one array per added column.
    A column of ``docs`` named like an added one is replaced by it. Rows stay as they are:
    none is lost, repeated or moved.
    """
    new = T.StructType.fromDDL(added)
    carried = [c for c in (docs.columns if carry is None else carry) if c not in new.names]

    def run(batches):
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            data, offsets = ta.flat_bytes(texts)
            for i, j in ta.chunks(offsets, give_back=True):
                made = make(Texts(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i]))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(k)[i:j] for k in range(len(carried))] + [pa.array(x) for x in made],
                    names=[*carried, *new.names])

    schema = T.StructType([docs.schema[c] for c in carried] + [T.StructField(f.name, f.dataType) for f in new.fields])
    source = ta.small_batches(docs).select(*(docs[f"`{c}`"] for c in carried), docs[f"`{text_col}`"].cast("string").alias("__text"))
    return source.mapInArrow(run, schema)
