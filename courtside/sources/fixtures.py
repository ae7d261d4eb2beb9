"""Fixture views: the driver's parquet tables reshaped into league inputs.

The views are plain SQL that Spark 4.1 and DuckDB both accept, so the Spark
pipelines and the DuckDB oracle read the very same rows. The one join hint
(``/*+ MERGE(lineitem) */``: two fact tables are sort-merge joined instead of
broadcasting one on a file-size estimate) is a comment to DuckDB. In Spark they are
built with ``spark.sql`` over the base tables; in the oracle they become CTEs.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from courtside.operators.core import running_sum

BASE_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
               "events", "documents", "embeddings", "pages", "benchmark", "labels",
               "conversations")

# v_contracts pairs the 25 nations with the 10 digits: 250 rows whatever the data.
VIEWS: dict[str, str] = {
    "v_box_scores": """
WITH g AS (
  SELECT o_orderkey AS game_id, CAST(o_orderdate AS date) AS game_date, o_orderstatus,
         CAST(c_nationkey AS bigint) AS home_key,
         (c_nationkey + 1 + o_orderkey % 24) % 25 AS away_key
  FROM orders JOIN customer ON o_custkey = c_custkey),
l AS (
  SELECT /*+ MERGE(lineitem) */ game_id, game_date, o_orderstatus,
         CASE WHEN l_linenumber % 2 = 1 THEN home_key ELSE away_key END AS team_key,
         CASE WHEN l_linenumber % 2 = 1 THEN away_key ELSE home_key END AS opp_key,
         CASE WHEN l_linenumber % 2 = 1 THEN 'H' ELSE 'A' END AS location,
         CASE WHEN l_partkey % 10 = 9 AND game_date >= DATE '1999-01-01'
              THEN (CASE WHEN l_linenumber % 2 = 1 THEN home_key + 24 ELSE away_key + 24 END) % 25 * 10 + 9
              ELSE (CASE WHEN l_linenumber % 2 = 1 THEN home_key ELSE away_key END) * 10 + l_partkey % 10 END AS player_id,
         l_partkey, l_suppkey, l_linenumber, l_quantity
  FROM g JOIN lineitem ON l_orderkey = game_id),
p AS (
  SELECT game_id, game_date, o_orderstatus, team_key, opp_key, location,
         player_id,
         CAST(SUM(l_quantity) AS bigint) AS pts,
         CAST(SUM(FLOOR(l_quantity / 2) + 1) AS bigint) AS fga,
         CAST(SUM(l_linenumber) AS bigint) AS fta,
         CAST(SUM(l_suppkey % 4) AS bigint) AS stl,
         CAST(SUM(l_partkey % 3) AS bigint) AS blk,
         CAST(SUM(l_partkey % 11) AS bigint) AS trb,
         CAST(SUM(l_suppkey % 9) AS bigint) AS ast,
         CAST(SUM(l_linenumber % 4) AS bigint) AS tov,
         CAST(SUM(l_partkey % 4) AS bigint) AS fg3m,
         CAST(SUM(l_partkey % 4 + l_suppkey % 5) AS bigint) AS fg3a
  FROM l GROUP BY game_id, game_date, o_orderstatus, team_key, opp_key, location, player_id),
t AS (
  SELECT p.*, CAST(SUM(pts) OVER (PARTITION BY game_id, team_key) AS bigint) AS team_pts,
         CAST(SUM(pts) OVER (PARTITION BY game_id) AS bigint) AS game_pts FROM p)
SELECT game_id, game_date, team_key AS team, opp_key AS opponent, location, player_id,
       CASE WHEN o_orderstatus = 'P' THEN 'Playoffs' ELSE 'Regular Season' END AS season_type,
       CASE WHEN 2 * team_pts > game_pts OR (2 * team_pts = game_pts AND location = 'H') THEN 'W' ELSE 'L' END AS outcome,
       pts, fga, fta, stl, blk, trb, ast, tov, fg3m, fg3a,
       2 * team_pts - game_pts AS plus_minus
FROM t""",
    "v_contracts": """
SELECT team * 10 + n AS player_id, team,
       CASE WHEN (team * 7 + n * 11) % 13 = 0 THEN NULL
            ELSE '$' || CAST(1 + (team * 7 + n * 11) % 45 AS string) || ',500,000' END AS salary_text
FROM (SELECT CAST(n_nationkey AS bigint) AS team FROM nation) a
CROSS JOIN (SELECT CAST(l AS bigint) AS n FROM (SELECT DISTINCT p_partkey % 10 AS l FROM part) x) b""",
    "v_teams": """
SELECT CAST(n_nationkey AS bigint) AS team, n_name AS full_name, r_name AS conference FROM nation JOIN region ON n_regionkey = r_regionkey""",
    "v_injuries": """
SELECT c_custkey AS injury_id, CAST(c_nationkey AS bigint) AS team, c_mktsegment AS description FROM customer""",
    "v_over_under": """
SELECT CAST(n_nationkey AS bigint) AS team, CAST(20 + (n_nationkey * 7) % 33 + 0.5 AS double) AS over_under_wins FROM nation""",
    "v_schedule": """
SELECT o_orderkey AS game_id, o_orderdate AS game_ts, (c_nationkey + 1 + o_orderkey % 24) % 25 AS visitor,
       CAST(c_nationkey AS bigint) AS home,
       CAST(1 + o_orderkey % 12 AS string) || ':' || CASE WHEN o_orderkey % 2 = 0 THEN '00' ELSE '30' END || 'p' AS start_text
FROM orders JOIN customer ON o_custkey = c_custkey""",
    "v_odds": """
SELECT game_id, CAST(game_ts AS date) AS game_date, visitor AS team1, home AS team2,
       CAST((game_id % 23) - 11 AS string) || '.5' AS team1_spread, CAST(11 - (game_id % 23) AS string) || '.5' AS team2_spread,
       CAST(200 + game_id % 40 AS string) || '.5' AS pts_bet,
       CASE WHEN game_id % 7 = 0 THEN '-' WHEN game_id % 2 = 0 THEN '-' || CAST(110 + game_id % 90 AS string) ELSE '+' || CAST(105 + game_id % 90 AS string) END AS team1_moneyline,
       CASE WHEN game_id % 7 = 0 THEN '-' WHEN game_id % 2 = 0 THEN '+' || CAST(105 + game_id % 90 AS string) ELSE '-' || CAST(110 + game_id % 90 AS string) END AS team2_moneyline
FROM v_schedule""",
    "v_team_ratings": """
SELECT CAST(n_nationkey AS bigint) AS team,
       CASE WHEN n_nationkey % 2 = 0 THEN n_name || '*' ELSE n_name END AS team_text,
       CAST(100 + (n_nationkey * 7) % 19 AS string) AS ortg_text,
       CAST(100 + (n_nationkey * 5) % 17 AS string) AS drtg_text,
       CAST(20 + (n_nationkey * 3) % 30 AS string) AS w_text, CAST(52 - (n_nationkey * 3) % 30 AS string) AS l_text,
       CAST(96 + (n_nationkey * 11) % 9 AS string) || '.5' AS pace_text,
       CASE WHEN (n_nationkey * 7) % 19 >= (n_nationkey * 5) % 17 THEN '+' ELSE '' END
         || CAST((n_nationkey * 7) % 19 - (n_nationkey * 5) % 17 AS string) AS nrtg_text
FROM nation
UNION ALL SELECT CAST(NULL AS bigint), 'League Average', '109.1', '108.2', '36', '36', '99.2', '+0.9'""",
    "v_contract_sheet": """
SELECT CASE WHEN c_custkey % 97 = 0 THEN 'Player' WHEN c_custkey % 97 = 1 THEN 'J.J. Redick' WHEN c_custkey % 97 = 2 THEN 'Kevin Knox'
            WHEN c_custkey % 97 = 3 THEN 'Þórður Ægir Weiß' WHEN c_custkey % 97 = 4 THEN 'Nguyễn Thế Łukasz' WHEN c_custkey % 97 = 5 THEN 'Cœur Đỗ'
            ELSE 'Lukáš Dončić ' || CAST(c_custkey AS string) END AS name,
       CASE c_nationkey % 5 WHEN 0 THEN 'BRK' WHEN 1 THEN 'PHO' WHEN 2 THEN 'CHO' WHEN 3 THEN 'LAL' ELSE 'SEA' END AS team,
       CASE WHEN c_custkey % 97 = 0 THEN 'Salary' WHEN c_custkey % 7 = 0 THEN NULL
            ELSE '$' || CAST(1 + c_custkey % 45 AS string) || ',' || lpad(CAST(c_custkey % 1000 AS string), 3, '0') || ',500' END AS salary_text,
       CASE WHEN c_custkey % 3 = 0 THEN '' ELSE '$' || CAST(2 + c_custkey % 90 AS string) || ',250,000' END AS total_text
FROM customer""",
    "v_rating_pages": """
SELECT page_id, '<!-- <div><table id="ratings"><thead><tr><th rowspan="2">Rk</th><th rowspan="2">Team</th><th colspan="6">Ratings &amp; record</th></tr>'
       || '<tr><th>W</th><th>L</th><th>Pace</th><th>ORtg</th><th>DRtg</th><th>NRtg</th></tr></thead><tbody>'
       || '<tr><td rowspan=2>' || CAST(page_id AS string) || '<td><a href="/team">' || team_text || '</a></td><td>' || w_text || '</td><td>' || l_text
       || '</td><td> ' || pace_text || ' </td><td><b>' || ortg_text || '</b></td><td>' || drtg_text || '<table><tr><td>0</td></tr></table></td><td>'
       || nrtg_text || '</td></tr><tr><td>League Average</td><td>36</td><td>36</td><td>99.2</td><td>109.1</td><td>108.2</td><td>+0.9</td></tr>'
       || '</tbody></table></div> -->' || COALESCE(html, '') AS html
FROM pages JOIN v_team_ratings ON page_id % 25 = team""",
    "v_plays": """
SELECT user_id AS game_id, event_id, ts,
       CASE WHEN event_id % 2 = 0 THEN event_type END AS desc_home,
       CASE WHEN event_id % 2 = 1 THEN event_type END AS desc_visitor,
       CASE WHEN event_id % 2 = 0 THEN 1 + CAST(FLOOR(value) AS bigint) % 3 ELSE 0 END AS points_home,
       CASE WHEN event_id % 2 = 1 THEN 1 + CAST(FLOOR(value) AS bigint) % 3 ELSE 0 END AS points_away,
       CAST(user_id % 25 AS bigint) AS home_team, CAST((user_id + 1 + user_id % 24) % 25 AS bigint) AS visitor_team,
       1 + CAST(FLOOR((EXTRACT(DAY FROM ts) - 1) / 5) AS bigint) AS period,
       lpad(CAST(EXTRACT(MINUTE FROM ts) % 12 AS string), 2, '0') || ':' || lpad(CAST(CAST(FLOOR(EXTRACT(SECOND FROM ts)) AS bigint) AS string), 2, '0') AS clock
FROM events""",
    "v_foul_text": """
SELECT user_id AS game_id, event_id,
       CASE WHEN event_id % 2 = 0 THEN d END AS desc_home, CASE WHEN event_id % 2 = 1 THEN d END AS desc_visitor
FROM (SELECT user_id, event_id,
             'Player' || CAST(user_id AS string) || ' '
             || CASE event_type WHEN 'click' THEN 'PERSONAL TAKE.FOUL' WHEN 'view' THEN 'S.FOUL' WHEN 'error' THEN 'Offensive Foul Turnover'
                                WHEN 'signup' THEN 'Jr. L.B.FOUL' ELSE '3PT Jump Shot' END
             || ' (P' || CAST(event_id % 6 AS string) || '.T' || CAST(event_id % 5 AS string) || ') (Ref' || CAST(event_id % 30 AS string) || ')' AS d
      FROM events) x""",
    "v_tracks": """
SELECT p_brand AS artist, p_type AS album, p_name AS track, CAST(l_shipdate AS date) AS release_date,
       l_discount * 10 AS valence, l_tax * 12.5 AS energy
FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "v_artists": """
SELECT p_partkey AS artist_id, p_name AS artist_name, p_size AS popularity FROM part""",
}

# views that read other views
VIEW_DEPS = {"v_odds": ("v_schedule",), "v_rating_pages": ("v_team_ratings",)}

# views that sort, group and window a table's rows by one key, in one stage: the
# table is dealt by that key over as many tasks as its rows ask for
DEALT = {"v_box_scores": ("lineitem", "l_orderkey")}
TASK_ROWS = 1 << 18


def register_base_tables(spark: SparkSession, sf_dir: str, tables=BASE_TABLES) -> None:
    for t in tables:
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)


def view_tables(name: str) -> list[str]:
    """Base tables a view's text reads."""
    return [t for t in BASE_TABLES if re.search(rf"\b{t}\b", VIEWS[name])]


class Fixture:
    """Base tables of one scale-factor folder plus the league views over them.

    ``spark.sql`` resolves a view's text once, at call time, so each returned
    DataFrame keeps pointing at this folder's files even if another Fixture
    re-registers the table names later. Views are plans: nothing is kept, written
    or run until a query's result is asked for, but for the count of a table that
    is dealt by its size (``DEALT``).
    """

    _active: dict[tuple, str] = {}

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")
        self._views: dict[str, DataFrame] = {}
        self.made: dict[str, DataFrame] = {}  # frames that the queries of this fixture share

    def _activate(self, tables) -> None:
        # table names are session-wide; (re-)point the ones a view needs at this folder
        app = self.spark.sparkContext.applicationId
        todo = [t for t in tables if Fixture._active.get((app, t)) != self.sf_dir]
        register_base_tables(self.spark, self.sf_dir, todo)
        for t in todo:
            Fixture._active[(app, t)] = self.sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def view(self, name: str) -> DataFrame:
        if name not in self._views:
            self._activate(view_tables(name))
            for dep in VIEW_DEPS.get(name, ()):
                self.view(dep).createOrReplaceTempView(dep)
            if name in DEALT:
                self._deal(*DEALT[name])
            try:
                self._views[name] = self.spark.sql(VIEWS[name])
            finally:
                if name in DEALT:
                    register_base_tables(self.spark, self.sf_dir, DEALT[name][:1])
        return self._views[name]

    def _deal(self, table: str, key: str) -> None:
        """Let the name of a table stand for its rows dealt by ``key``, if they are
        more than ``TASK_ROWS`` for each shuffle partition: the other side of a join
        by that key follows, and a task's share doesn't grow with the table. Rows are
        counted from the files' footers."""
        rows = self.table(table)
        n = -(-rows.count() // TASK_ROWS)
        if n > int(self.spark.conf.get("spark.sql.shuffle.partitions")):
            rows.repartition(n, key).createOrReplaceTempView(table)

    @property
    def v_play_by_play(self) -> DataFrame:
        """The plays with their number in the game and the score after each,
        summed minute by minute."""
        sums = {"score_home": F.col("points_home"), "score_away": F.col("points_away"), "event_no": F.lit(1).cast("long")}
        return (running_sum(self.view("v_plays"), "game_id", ["ts", "event_id"], sums,
                            chunk=F.date_trunc("minute", "ts"), chunk_name="minute").drop("points_home", "points_away"))

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("v_") and name in VIEWS:
            return self.view(name)
        raise AttributeError(name)
