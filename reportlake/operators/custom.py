"""A user's own function per document."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

#: Rows that results of several documents are joined to before they are handed on.
ROWS = 10_000


def per_document(
    docs: DataFrame,
    fn: Callable[[object, str], pd.DataFrame],
    schema: str,
    key: str = "doc_id",
    value: str = "value",
) -> DataFrame:
    """Rows of ``fn(key, text)`` for every document, in Arrow batches.

    A document is one row, so nothing is grouped or shuffled.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found, rows = [], 0
            for doc_id, text in zip(batch[key], batch[value]):
                found.append(fn(doc_id, text))
                rows += len(found[-1])
                if rows >= ROWS:
                    yield pd.concat(found, ignore_index=True)
                    found, rows = [], 0
            if found:
                yield pd.concat(found, ignore_index=True)

    return docs.select(key, value).mapInPandas(run, schema)
