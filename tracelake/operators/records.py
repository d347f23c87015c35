"""Dead time along records of any length, cut into segments that are worked on apart."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def chain(hits: np.ndarray, dead: int) -> np.ndarray:
    """For each of ascending hits the last one that is accepted if it is itself."""
    follows = np.searchsorted(hits, hits + dead, "right")
    last = hits.copy()
    for i in range(len(hits) - 1, -1, -1):
        if follows[i] < len(hits):
            last[i] = last[follows[i]]
    return last


def accepted(hits: np.ndarray, dead: int, entry: int | None) -> np.ndarray:
    """Of ascending hits those that are accepted after the last one of earlier segments."""
    out, i = [], 0 if entry is None else int(np.searchsorted(hits, entry + dead, "right"))
    while i < len(hits):
        out.append(hits[i])
        i = int(np.searchsorted(hits, hits[i] + dead, "right"))
    return np.array(out, np.int64)


def dead_time(hits: DataFrame, key: str, position: str, dead: int, segment: int) -> DataFrame:
    """key, position: the accepted hits of each record; after one, `dead` positions are skipped.

    A segment of `segment` positions is a map from the last hit accepted before it to the last one accepted in it: a few
    steps, as chains of accepted hits soon run together.  The maps of a record, not its hits, are composed in order, and
    each segment then accepts its hits from its own entry.  Hits without a key or position take no part; several at
    one position are one."""
    rows = hits.where(F.col(key).isNotNull() & F.col(position).isNotNull()).select(key, F.col(position).cast("long").alias("at")).distinct()
    rows = rows.withColumn("segment", F.floor(F.col("at") / segment).cast("long"))
    kind = hits.schema[key].dataType.simpleString()

    def mapped(group: tuple, some: pd.DataFrame) -> pd.DataFrame:
        at = np.sort(some["at"].to_numpy())
        last = chain(at, dead)
        steps = np.append(last[1:] != last[:-1], True)  # up to which hit an entry's first one lies, and where it then ends
        return pd.DataFrame({key: [group[0]], "segment": [group[1]], "upto": [at[steps].tolist()], "ends": [last[steps].tolist()]})

    maps = rows.groupBy(key, "segment").applyInPandas(mapped, f"{key} {kind}, segment long, upto array<long>, ends array<long>")
    start = F.struct(F.lit(None).cast("long").alias("last"), F.array().cast("array<struct<segment:bigint,entry:bigint>>").alias("entries"))

    def through(a, s):
        """The entry of this segment, and what its map makes of it: the first step that lies beyond the dead time."""
        step = F.array_position(F.transform(s["upto"], lambda u: a["last"].isNull() | (u > a["last"] + dead)), F.lit(True)).cast("int")
        entries = F.concat(a["entries"], F.array(F.struct(s["segment"].alias("segment"), a["last"].alias("entry"))))
        return F.struct(F.when(step > 0, F.element_at(s["ends"], F.greatest(step, F.lit(1)))).otherwise(a["last"]).alias("last"), entries.alias("entries"))

    ordered = maps.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("segment", "upto", "ends"))).alias("maps"))
    entries = ordered.select(key, F.inline(F.aggregate("maps", start, through, lambda a: a["entries"])))

    def own(group: tuple, some: pd.DataFrame) -> pd.DataFrame:
        entry = some["entry"].iloc[0]
        out = accepted(np.sort(some["at"].to_numpy()), dead, None if pd.isna(entry) else int(entry))
        return pd.DataFrame({key: [group[0]] * len(out), position: out})

    return rows.join(entries, [key, "segment"]).groupBy(key, "segment").applyInPandas(own, f"{key} {kind}, {position} long")
