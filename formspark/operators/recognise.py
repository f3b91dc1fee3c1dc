"""Recognition behind a plug-in: everything downstream works on the text of cells."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame

#: regions of a cell that readers look at, as shares (left, top, right, bottom)
REGIONS = {
    "cell": (0.0, 0.0, 1.0, 1.0),
    "serial": (0.0, 0.0, 0.25, 0.20),
    "age_gender": (0.0, 0.75, 1.0, 1.0),
    "id": (0.45, 0.0, 1.0, 0.25),
}


class Recogniser(Protocol):
    """Reads a region of a cell with one strategy: its text and the confidences of its words."""

    def read(self, cell: bytes, region: tuple[float, float, float, float], strategy: str) -> tuple[str, list[float]]: ...


class PassThrough:
    """Takes the bytes of a cell for its text; for tests and for text that is recognised already."""

    def read(self, cell: bytes, region, strategy: str) -> tuple[str, list[float]]:
        return cell.decode("utf-8", "replace"), [100.0]


def readings(cells: DataFrame, make, region: str, strategies: list[str], keys: list[str], content: str = "content", good=None) -> DataFrame:
    """(keys, reader_ord, value, confidence) of each strategy in turn; after a good one the rest are not tried.

    make builds the recogniser in the worker.  The loop stands inside one Python stage, as Spark does
    not leave out a function whose condition is false.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        recogniser = make()
        for batch in batches:
            rows = []
            for row in batch.itertuples(index=False):
                *key, data = row
                for n, strategy in enumerate(strategies):
                    text, confidences = recogniser.read(bytes(data or b""), REGIONS[region], strategy)
                    positive = [c for c in confidences if c > 0]
                    rows.append((*key, n, text, sum(positive) / len(positive) if positive else 0.0))
                    if good is not None and good(text):
                        break
            yield pd.DataFrame(rows, columns=[*keys, "reader_ord", "value", "confidence"])

    kinds = ", ".join(f"`{k}` {cells.schema[k].dataType.simpleString()}" for k in keys)
    return cells.select(*keys, content).mapInPandas(run, f"{kinds}, reader_ord int, value string, confidence double")
