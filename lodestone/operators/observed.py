"""Counters that come with a result, in the same pass, and sources that fail alone.

``Dataset.observe`` counts rows as they go by, so the stages of a search and the rows of a source are counted by the job that
uses them, and nothing is read again to be counted.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

STATUSES = ("ok", "incomplete", "old", "no_link", "closed", "wall", "unreadable")
COUNTERS = "source string, rows long, " + ", ".join(f"{s} long" for s in STATUSES) + ", warning string"


def counted(frame: DataFrame, /, **counts: Column) -> tuple[DataFrame, Observation]:
    """The rows of a relation, and counters that are known once they have been used."""
    seen = Observation()
    return frame.observe(seen, *(c.alias(name) for name, c in counts.items())), seen


def fenced(frame: DataFrame) -> DataFrame:
    """The same rows, with a counter below which no filter is pushed and into which no expression is drawn: what made their columns runs once, and where it stands."""
    return frame.observe(f"fence-{uuid.uuid4().hex}", F.count(F.lit(1)).alias("rows"))


class Gathered:
    """Postings of several sources as one relation, with counters and a warning for each.

    A source is a function that gives a relation of postings (with source and status). One whose relation cannot even be planned
    (its bodies are not there, or not what they should be) is left out with a warning, and the others go on. Bodies that
    cannot be read are rows with a status.
    """

    def __init__(self, sources: dict[str, Callable[[], DataFrame]]) -> None:
        self.names, self.seen, self.failed, parts = list(sources), {}, {}, []
        for name, read in sources.items():
            try:
                rows = read()
                rows.schema  # noqa: B018  # plans it
            except (PySparkException, ValueError) as error:
                self.failed[name] = str(error).splitlines()[0][:200]
                continue
            rows, self.seen[name] = counted(rows, rows=F.count(F.lit(1)), **{s: F.count_if(F.coalesce(F.col("status") == s, F.lit(False))) for s in STATUSES})
            parts.append(rows)
        if not parts:
            raise ValueError("No source could be read: " + "; ".join(f"{k}: {v}" for k, v in self.failed.items()))
        self.rows = parts[0]
        for more in parts[1:]:
            self.rows = self.rows.unionByName(more, allowMissingColumns=True)

    def counters(self, spark: SparkSession) -> DataFrame:
        """source, rows, how many of each status, warning: after the rows have been used once."""
        out = []
        for name in self.names:
            if name in self.failed:
                out.append((name, 0, *(0 for _ in STATUSES), self.failed[name]))
                continue
            got = self.seen[name].get
            bad = got["rows"] - got["ok"]
            warning = None if not bad else "nothing could be used" if not got["ok"] else f"{bad} of {got['rows']} could not be used"
            out.append((name, got["rows"], *(got[s] for s in STATUSES), warning))
        return spark.createDataFrame(out, COUNTERS)
