"""Schedule, odds and ratings pipelines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from courtside.functions.exprs import (
    date_from_weekday_text, lookup, number_text, ordinal, recode, record_text, start_minute,
)
from courtside.operators.core import filter_global_extreme, global_row_number, null_aware_rank
from courtside.plans.teams import team_dimension
from courtside.sources.pages import comment_blocks, page_table_records
from courtside.sources.results import written

# Team code -> logo asset path of the source dashboard.
TEAM_LOGOS = {
    "ATL": "logos/atl.png", "BOS": "logos/bos.png", "BKN": "logos/bkn1.png",
    "CHA": "logos/cha.png", "CHI": "logos/chi1.png", "CLE": "logos/cle.png",
    "DAL": "logos/dal1.png", "DEN": "logos/den2.png", "DET": "logos/det.png",
    "GSW": "logos/gsw1.png", "HOU": "logos/hou3.png", "IND": "logos/ind1.png",
    "LAC": "logos/lac1.png", "LAL": "logos/lal2.png", "MEM": "logos/mem1.png",
    "MIA": "logos/mia1.png", "MIL": "logos/mil1.png", "MIN": "logos/min.png",
    "NOP": "logos/nop.png", "NYK": "logos/nyk.png", "OKC": "logos/okc1.png",
    "ORL": "logos/orl1.png", "PHI": "logos/phi.png", "PHX": "logos/phx1.png",
    "POR": "logos/por1.png", "SAC": "logos/sac.png", "SAS": "logos/sas1.png",
    "TOR": "logos/tor1.png", "UTA": "logos/uta1.png", "WAS": "logos/was.png",
}


def team_logo_lookup(df: DataFrame, mapping=None, key: str = "team", name: str = "logo") -> DataFrame:
    """(P42b) attach an asset path by team code: a literal map for a dict, a
    left join for a mapping table (key, name)."""
    if mapping is None or isinstance(mapping, dict):
        return df.withColumn(name, lookup(key, mapping if mapping is not None else TEAM_LOGOS))
    return df.join(mapping.select(key, name), key, "left")


# ---------------------------------------------------------------- schedule

def normalise_schedule(schedule: DataFrame, as_of, date_text: str = "date_text",
                       start_text: str = "start_text", score_col: str | None = None) -> DataFrame:
    """(P04) date text ('Tue, Dec 22, 2020') -> date, weekday name, start
    text ('7:30p') -> minutes after midnight, 'Vs' where no score yet; games
    on/after ``as_of`` numbered in (date, start, id) order."""
    s = (schedule
         .withColumn("game_date", date_from_weekday_text(date_text))
         .withColumn("day_of_week", F.date_format("game_date", "EEEE"))
         .withColumn("start_minute", start_minute(start_text))
         .withColumn("vs", F.coalesce(F.col(score_col).cast("string"), F.lit("Vs")) if score_col
                     else F.lit("Vs"))
         .where(F.col("game_date") >= F.lit(as_of).cast("date")))
    # a schedule table can hold many leagues and seasons
    order = [F.col("game_date"), F.col("start_minute").asc_nulls_last(), F.col("game_id")]
    return global_row_number(s, order, "game_no").select(
        "game_no", "game_id", "game_date", "day_of_week", "start_minute", "visitor", "home", "vs")


# Headings of the source's schedule and rating tables.
SCHEDULE_HEADINGS = {"date_text": "Date", "game_id": "Game", "start_text": "Start (ET)", "visitor": "Visitor/Neutral", "home": "Home/Neutral"}
RATING_HEADINGS = {"team_text": "Team", "w_text": "W", "l_text": "L", "pace_text": "Pace", "ortg_text": "ORtg", "drtg_text": "DRtg", "nrtg_text": "NRtg"}


def schedule_from_pages(pages: DataFrame, as_of) -> DataFrame:
    """(P05) the schedule tables of stored pages, read by their headings and
    normalised (P04); a date that spans rows is each row's."""
    # written, as the numbering reads its rows twice and pages are read dearly
    rows = written(page_table_records(pages, SCHEDULE_HEADINGS), "schedule-rows")
    ids = {c: F.col(c).try_cast("long") for c in ("game_id", "visitor", "home")}
    return normalise_schedule(rows.withColumns(ids), as_of)


def schedule_pairs(schedule: DataFrame) -> DataFrame:
    """(P43) each game as two (team, opponent) rows: one explode, no join."""
    sides = F.array(F.struct(F.col("visitor").alias("team"), F.col("home").alias("opponent")),
                    F.struct(F.col("home").alias("team"), F.col("visitor").alias("opponent")))
    return (schedule.select("game_no", F.explode(sides).alias("p"))
            .select("game_no", "p.team", "p.opponent").where(F.col("team") != F.col("opponent")))


def future_opponent_bins(pairs: DataFrame, ranks: DataFrame, cuts=(10, 20)) -> DataFrame:
    """(P44) remaining opponents per team by the opponent's league rank: top,
    middle, bottom (unranked counts as bottom); each count ranked across teams."""
    opp = ranks.select(F.col("team").alias("opponent"), F.col("rank").alias("opp_rank"))
    b = (F.when(F.col("opp_rank") <= cuts[0], "top")
         .when((F.col("opp_rank") > cuts[0]) & (F.col("opp_rank") <= cuts[1]), "mid")
         .otherwise("bottom"))
    p = (pairs.join(opp, "opponent", "left").withColumn("bin", b)
         .groupBy("team").pivot("bin", ["top", "mid", "bottom"]).agg(F.count(F.lit(1))))
    for c in ("top", "mid", "bottom"):
        p = p.withColumn(c + "_rank", ordinal(null_aware_rank(c, ascending=False)))
    return p


def schedule_difficulty(pairs: DataFrame, ranks: DataFrame, bins: DataFrame) -> DataFrame:
    """(P45) mean remaining-opponent rank per team, differential to own rank,
    difficulty order (row number, ties by team) and easier/harder label."""
    opp = ranks.select(F.col("team").alias("opponent"), F.col("rank").alias("opp_rank"))
    own = ranks.select("team", "rank")
    g = (pairs.join(opp, "opponent", "left").groupBy("team")
         .agg(F.avg("opp_rank").alias("_avg"))
         .join(own, "team", "left")
         .withColumn("differential", F.round(F.col("_avg") - F.col("rank"), 1))
         .withColumn("avg_opp_rank", F.round("_avg", 1)))
    w = Window.orderBy(F.col("avg_opp_rank").asc_nulls_last(), "team")
    g = (g.withColumn("difficulty_rank", F.row_number().over(w).cast("long"))
         .withColumn("difficulty_text", ordinal("difficulty_rank"))
         .withColumn("rank_text", ordinal("rank"))
         .withColumn("label", F.when(F.col("differential") > 0, "Easier Schedule")
                     .otherwise("Harder Schedule"))
         .drop("_avg"))
    return g.join(bins, "team", "left")


def upcoming_schedule(schedule: DataFrame, ranks: DataFrame, odds: DataFrame, teams: DataFrame,
                      as_of) -> DataFrame:
    """(P42) remaining games with both teams' league ranks averaged and, for
    games on ``as_of`` with odds, each side labelled with its moneyline ('-' ->
    '+100') and the favoured side named (the lower line; even lines favour
    none). Odds are matched by game, one row each (the latest date's)."""
    names = team_dimension(teams)
    r = ranks.select("team", "rank")
    today = F.lit(as_of).cast("date")
    o = (odds.where(F.col("game_date") == today).groupBy("game_id")
         .agg(F.max(F.struct("team1_moneyline", "team2_moneyline")).alias("o")).select("game_id", "o.*"))
    s = (schedule
         .join(r.withColumnsRenamed({"team": "visitor", "rank": "r1"}), "visitor", "left")
         .join(r.withColumnsRenamed({"team": "home", "rank": "r2"}), "home", "left")
         .join(names.withColumnsRenamed({"team": "visitor", "full_name": "n1"}), "visitor", "left")
         .join(names.withColumnsRenamed({"team": "home", "full_name": "n2"}), "home", "left")
         .join(o, "game_id", "left"))

    def line(c):
        return F.when(F.col(c) == "-", F.lit("+100")).otherwise(F.col(c))

    def label(name, ml):
        return F.coalesce(F.concat(F.col(name), F.lit(" ("), line(ml), F.lit(")")), F.col(name))

    road, home = (line(c).try_cast("int") for c in ("team1_moneyline", "team2_moneyline"))
    favored = F.when(road < home, F.col("n1")).when(home < road, F.col("n2"))
    return s.select("game_id", "game_date", "day_of_week", "start_minute", label("n1", "team1_moneyline").alias("road_label"),
                    "vs", label("n2", "team2_moneyline").alias("home_label"),
                    ((F.col("r1") + F.col("r2")) / 2).alias("avg_rank"), favored.alias("favored"))


def next_gameday(upcoming: DataFrame) -> DataFrame:
    """(P46) games on the first upcoming date."""
    first = filter_global_extreme(upcoming, "game_date", "min")
    return first.groupBy("game_date", "day_of_week").agg(F.count(F.lit(1)).alias("games"))


def league_kpis(next_day: DataFrame, split: DataFrame, average: DataFrame) -> DataFrame:
    """(P46) one row: next game day, home/road split and league scoring."""
    return (next_day.crossJoin(split).crossJoin(average)
            .withColumn("full_date", F.date_format("game_date", "MMMM dd, yyyy"))
            .withColumn("games_text", F.concat(F.col("games").cast("string"), F.when(F.col("games") == 1, " Upcoming Game")
                                               .otherwise(" Upcoming Games | See Schedule")))
            .withColumn("record", record_text("home_wins", "road_wins", " - ")))


# ---------------------------------------------------------------- odds

# Team names that the odds source spells its own way.
ODDS_NAME_RECODES = {"Portland TrailBlazers": "Portland Trail Blazers"}


def enrich_odds(odds: DataFrame, logs: DataFrame, since, recodes: dict | None = None) -> DataFrame:
    """(P08) moneylines, spreads and the points bet with each side's points and
    outcome that day; ``recodes`` maps the odds' team names to the logs'.

    Points and outcome are aggregated to one row per (team, date) before the
    two joins, so a team with two games on a date cannot multiply rows; the
    outcome is null when those games disagree. Team 2's outcome is the
    opposite of team 1's."""
    day = (logs.where(F.col("game_date") >= F.lit(since).cast("date"))
           .groupBy("team", "game_date")
           .agg(F.sum("pts").alias("pts"),
                F.when(F.count_distinct("outcome") == 1, F.max("outcome")).alias("outcome")))
    t1 = day.withColumnsRenamed({"team": "team1", "pts": "team1_pts", "outcome": "team1_outcome"})
    t2 = day.select(F.col("team").alias("team2"), "game_date", F.col("pts").alias("team2_pts"))
    odds = odds.withColumns({c: recode(c, recodes or {}) for c in ("team1", "team2")})
    out = odds.join(t1, ["team1", "game_date"], "left").join(t2, ["team2", "game_date"], "left")
    opp = F.when(F.col("team1_outcome") == "W", "L").when(F.col("team1_outcome") == "L", "W")
    return out.select("game_id", "game_date", "team1", "team2", "team1_moneyline", "team2_moneyline",
                      "team1_spread", "team2_spread", "pts_bet", "team1_outcome", opp.alias("team2_outcome"), "team1_pts", "team2_pts",
                      (F.col("team1_pts") + F.col("team2_pts")).alias("total_pts"))


# ---------------------------------------------------------------- ratings

def ratings_from_pages(pages: DataFrame, teams: DataFrame) -> DataFrame:
    """(P06) ratings per page from the tables that pages hide in comments."""
    hidden = comment_blocks(pages)
    raw = page_table_records(hidden, RATING_HEADINGS, ids=("page_id", "pos"), html="body")
    return clean_team_ratings(raw, teams, keep=("page_id",))


def clean_team_ratings(raw: DataFrame, teams: DataFrame, drop_name: str = "League Average", keep=()) -> DataFrame:
    """(P06) rating text -> numbers ('*' off names, '+' off net rating), code
    by full-name join, league-average row dropped by its name; ``keep``: columns
    of ``raw`` that stay."""
    r = (raw.withColumn("full_name", F.regexp_replace("team_text", r"\*", ""))
         .where(F.col("full_name") != drop_name)
         .select(*keep, "full_name",
                 F.col("ortg_text").try_cast("double").alias("ortg"),
                 F.col("drtg_text").try_cast("double").alias("drtg"),
                 F.regexp_replace("nrtg_text", r"\+", "").try_cast("double").alias("nrtg"),
                 F.col("w_text").try_cast("int").alias("w"), F.col("l_text").try_cast("int").alias("l"),
                 F.col("pace_text").try_cast("double").alias("pace")))
    return r.join(team_dimension(teams), "full_name", "left").select(
        *keep, "team", "full_name", "w", "l", "pace", "ortg", "drtg", "nrtg")


def rating_ranks(ratings: DataFrame) -> DataFrame:
    """(P35) row-number ranks (net and offensive descending, defensive
    ascending, ties broken like successive stable sorts), ordinals and the
    league means used as chart centre lines."""
    n = F.row_number().over(Window.orderBy(F.col("nrtg").desc(), "team"))
    o = F.row_number().over(Window.orderBy(F.col("ortg").desc(), F.col("nrtg").desc(), "team"))
    d = F.row_number().over(Window.orderBy(F.col("drtg").asc(), F.col("ortg").desc(),
                                           F.col("nrtg").desc(), "team"))
    r = (ratings.withColumn("nrtg_rank", n.cast("long")).withColumn("ortg_rank", o.cast("long"))
         .withColumn("drtg_rank", d.cast("long")))
    means = ratings.agg(F.avg("ortg").alias("league_ortg"), F.avg("drtg").alias("league_drtg"))
    return (r.crossJoin(means)
            .withColumn("nrtg_text", ordinal("nrtg_rank"))
            .withColumn("ortg_text", ordinal("ortg_rank"))
            .withColumn("drtg_text", ordinal("drtg_rank"))
            .withColumn("rating_text", F.concat(*[x for label, c in (("Offensive", "ortg"), ("<br>Defensive", "drtg"), ("<br>Net", "nrtg"))
                                                  for x in (F.lit(f"{label} Rating: "), number_text(c), F.lit(" ("), F.col(c + "_text"), F.lit(")"))])))


def over_under_tracker(lines: DataFrame, record: DataFrame, teams: DataFrame, bins: DataFrame,
                       season_games: int = 72) -> DataFrame:
    """(P41) season win line vs current pace: expected win%, over/under,
    projected minus line, and the remaining-opponent bins."""
    out = (lines.join(record.select("team", "win_pct", "projected_wins"), "team", "left")
           .join(team_dimension(teams), "team", "left")
           .join(bins, "team", "left"))
    exp = F.round(F.col("over_under_wins") / season_games, 3)
    return out.select(
        "team", "full_name", "over_under_wins", exp.alias("expected_pct"), "win_pct",
        F.when(F.col("win_pct") >= exp, "Over").otherwise("Under").alias("verdict"),
        (F.col("projected_wins") - F.col("over_under_wins")).alias("wins_difference"),
        (F.lit(season_games) - F.col("over_under_wins")).alias("line_losses"),
        "top", "mid", "bottom", "top_rank", "mid_rank", "bottom_rank")
