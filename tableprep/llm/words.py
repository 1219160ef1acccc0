"""Words of whole texts as bytes, run by run, for operators that look at one word after the other."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tableprep.llm.common import ranges

RUN_BYTES = 1 << 19  # a text's words are listed in runs of about so many bytes
BATCH_BYTES = 4 << 20
#: Lower-cases A-Z and blanks whatever is no digit, letter or byte of a character above 127.
BLANKS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def word_runs(text: bytes | None, size: int | None = None) -> Iterator[list[bytes]]:
    """The lower-cased words of a text in order, in lists of about ``size`` bytes; words are never cut."""
    size = size or RUN_BYTES
    blanked = (text or b"").translate(BLANKS)
    start = 0
    while start < len(blanked):
        stop = blanked.find(b" ", start + size)
        stop = len(blanked) if stop < 0 else stop
        words = blanked[start:stop].split()
        if words:
            yield words
        start = stop


def per_text(docs: DataFrame, keep: list[str], text: str, outputs: str, compute: Callable[[list[bytes | None]], list]) -> DataFrame:
    """The columns ``keep`` of every row and what ``compute`` makes of its text, which is not passed on."""
    schema = StructType([*docs.select(*[F.col(f"`{c}`") for c in keep]).schema, *StructType.fromDDL(outputs)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for batch in batches:
            texts = batch.column(len(keep)).cast(pa.binary())
            for i, j in ranges(pc.fill_null(pc.binary_length(texts), 0).to_pylist(), BATCH_BYTES):
                columns = [c.slice(i, j - i) for c in batch.columns[:-1]] + compute(texts.slice(i, j - i).to_pylist())
                kinds = [f.type for f in arrow]
                arrays = [c.cast(k) if isinstance(c, pa.Array) else pa.array(c, type=k) for c, k in zip(columns, kinds)]
                yield pa.RecordBatch.from_arrays(arrays, schema=arrow)

    return docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias("__text")).mapInArrow(run, schema)
