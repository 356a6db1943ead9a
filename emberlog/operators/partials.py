"""Digest figures by finished day, which merge: a digest reads them and the rows of open days only.

A finished UTC day gives three tables, stored by day:

* ``counts``: its clusters in numbers, one narrow row each;
* ``texts``: key, source and masked text of the first row, and of the first row with text, of the same clusters, met
  only by the few that are shown;
* ``tallies``: one row per reporting severity.

Numbers merge by sum, least and greatest; the first row of a cluster is the least (time, id) over its days, and so is
its first row with text.  The days' order does not matter.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog import fixed_values as V
from emberlog.functions.text import sample_text
from emberlog.operators import digest
from emberlog.operators.audit import reporting_severity, window_counts
from emberlog.session import cut

KEY = ["k1", "k2"]


@dataclass
class Partials:
    """Clusters in numbers and in text, and tallies; of a day, or of any rows."""

    counts: DataFrame
    texts: DataFrame
    tallies: DataFrame

    def union(self, other: Partials) -> Partials:
        """Both together, not merged yet."""
        return Partials(*[a.unionByName(b) for a, b in zip(self.tables(), other.tables())])

    def tables(self) -> list[DataFrame]:
        return [self.counts, self.texts, self.tallies]


NAMES = ["counts", "texts", "tallies"]


def of_rows(audit: DataFrame, parts: list[str] = []) -> Partials:
    """Partials of audit rows, for each value of the ``parts`` columns."""
    counts = cut(digest.counted(digest.keyed_rows(audit, parts), [*KEY, *parts]))
    wanted = counts.select(*KEY, *parts, F.explode(F.array_compact(F.array_distinct(F.array("first_id", "sample_id")))).alias("id"))
    texts = digest.cluster_rows(audit.drop(*parts).join(wanted, "id")).select(
        *KEY, *parts, "id", *digest.CLUSTER_KEY, "log_file", digest.raw_source().alias("raw_source"),
        sample_text(F.coalesce("message", F.lit(""))).alias("sample"),
    )
    newest = F.max(F.when(reporting_severity().isin(V.COLLECTED_SEVERITIES), F.col("received_us"))).alias("newest_us")
    return Partials(counts, texts, window_counts(audit, parts, newest))


def merged_counts(counts: DataFrame) -> DataFrame:
    """One row per cluster over all partials, in numbers of fixed width."""
    grouped = counts.groupBy(*KEY).agg(
        F.sum("n").alias("n"), F.min("first_us").alias("first_us"), F.max("last_us").alias("last_us"),
        F.max("max_count").alias("max_count"), F.min("said_us").alias("said_us"),
    )
    # of the partials that share the least time, the least id: at most one partial per day and cluster comes here
    times = grouped.select(*KEY, F.col("first_us").alias("least_us"), F.col("said_us").alias("least_said_us"))
    ids = counts.join(times, KEY).groupBy(*KEY).agg(
        F.min(F.when(F.col("first_us") == F.col("least_us"), F.col("first_id"))).alias("first_id"),
        F.min(F.when(F.col("said_us") == F.col("least_said_us"), F.col("sample_id"))).alias("sample_id"),
    )
    return grouped.drop("said_us").join(ids, KEY)


def top(partials: Partials, limit: int = V.MAX_CLUSTERS) -> tuple[DataFrame, DataFrame]:
    """(all clusters in numbers, the largest ones ranked with their text)."""
    counts = cut(merged_counts(partials.counts))
    few = cut(digest.ranked(counts, limit))
    wanted = few.select(*KEY, "first_id", "sample_id", F.explode(F.array_compact(F.array_distinct(F.array("first_id", "sample_id")))).alias("id"))
    of = lambda which, c: F.max(F.when(F.col("id") == F.col(which), F.col(c))).alias(c)
    shown = partials.texts.join(F.broadcast(wanted), [*KEY, "id"]).groupBy(*KEY).agg(  # two rows for each of the few
        *[of("first_id", c) for c in (*digest.CLUSTER_KEY, "log_file", "raw_source")], of("sample_id", "sample"))
    return counts, few.join(shown, KEY).fillna("", ["sample"])


def merged_tallies(tallies: DataFrame) -> DataFrame:
    """One row per severity, as ``window_counts`` gives for all rows at once."""
    names = [c for c in tallies.columns if c not in ("severity", "newest_us")]
    return tallies.groupBy("severity").agg(*[F.sum(c).alias(c) for c in names], F.max("newest_us").alias("newest_us"))


def figures(partials: Partials) -> tuple[DataFrame, DataFrame, DataFrame]:
    """As ``digest.window_figures``, from partials."""
    return cut(merged_tallies(partials.tallies)), *top(partials)
