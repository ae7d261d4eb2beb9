"""courtside: league, schedule, play-by-play and catalogue analytics on Spark.

Every analysis is a function ``DataFrame(s) -> DataFrame`` built from
``pyspark.sql.functions`` expressions, joins, aggregates and windows, so
Catalyst plans it and it runs the same on ``local[8]`` and on a cluster.

Layout:
    functions/   column expressions (ordinals, safe ratios, text clocks, dates)
    operators/   reusable DataFrame operators (islands, ties-aware top-n,
                 null-aware ranks, chunked running sums, pivots)
    sources/     readers, snapshot refresh, page extraction, fixture views
    plans/       the named pipelines (players, teams, schedule, plays, catalogue)
    queries.py   name -> Spark callable and name -> DuckDB oracle SQL
"""

__all__ = ["session"]
