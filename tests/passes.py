"""Tables that count how many of their rows are read."""

from __future__ import annotations


def counted(df):
    """(df, accumulator of the rows that any job has read from it)."""
    rows = df.sparkSession.sparkContext.accumulator(0)

    def read(batches):
        for b in batches:
            rows.add(b.num_rows)
            yield b

    return df.mapInArrow(read, df.schema), rows
