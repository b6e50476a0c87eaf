"""Stateful streams of scans: what is known of a file begins anew when the file has changed."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "stem string, version string, scan long, n long, total double, resets long"
STATE = "version string, scan long, n long, total double, resets long"


def running_tallies(scans: DataFrame) -> DataFrame:
    """stem, version, scan, n, total, resets after each batch, of a stream of rows (stem, version, scan, value).

    version is the fingerprint of the file that a row was read from (its size, say), scan a number that rises
    from scan to scan. Rows of another version than the one held, from a later scan, drop what is held of the file and
    begin anew; rows of an earlier scan than the one held are late and count only if their version is the one held.
    A file whose versions alternate is rebuilt each time. One key a file; its state is five numbers. Null values
    count as 0, rows without a stem or version don't count.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        version, scan, n, total, resets = state.get if state.exists else (None, None, 0, 0.0, 0)
        for rows in batches:  # ordered within a batch; batches of one trigger come in any order
            for (at, own), part in rows.groupby(["scan", "version"], sort=True):
                if version is not None and own != version:
                    if at < scan:
                        continue
                    n, total, resets = 0, 0.0, resets + 1
                version, scan = own, at if scan is None else max(scan, at)
                n, total = n + len(part), total + float(part["value"].fillna(0).sum())
        if version is None:
            return
        state.update((str(version), int(scan), int(n), float(total), int(resets)))
        yield pd.DataFrame([(key[0], version, scan, n, total, resets)], columns=[x.split()[0] for x in OUT.split(", ")])

    rows = scans.where("stem is not null and version is not null").select("stem", F.col("version").cast("string").alias("version"), F.col("scan").cast("long").alias("scan"), F.col("value").cast("double").alias("value"))
    return rows.groupBy("stem").applyInPandasWithState(run, OUT, STATE, "update", GroupStateTimeout.NoTimeout)
