"""Team pipelines: games played, records, streaks, standings, splits, margins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from courtside.functions.exprs import number_text, ordinal, percent_text, record_text, safe_ratio
from courtside.operators.core import (
    current_run_length, filter_global_extreme, measured, null_aware_rank, running_sum,
    share_of_total, with_opponent_totals,
)

REGULAR = "Regular Season"
GAME_KEYS = ["game_id", "game_date", "team", "opponent", "location", "outcome", "season_type"]
STATS = ["pts", "fga", "fta", "fg3m", "fg3a"]


# ---------------------------------------------------------------- dimensions

def team_dimension(teams: DataFrame, recodes: dict | None = None) -> DataFrame:
    """(P02) distinct (team, full_name); optional code recodes."""
    from courtside.functions.exprs import recode
    return (teams.select(recode("team", recodes or {}).alias("team"), "full_name").distinct())


def conferences(teams: DataFrame, recodes: dict | None = None) -> DataFrame:
    """(P02) team -> conference."""
    from courtside.functions.exprs import recode
    return teams.select(recode("team", recodes or {}).alias("team"), "conference").distinct()


def team_games(logs: DataFrame, stats=STATS) -> DataFrame:
    """One row per team per game with summed stats.

    This is the grain most team pipelines share. The box-score rows come
    hash-partitioned by game, so this aggregate and the per-game windows after
    it reuse that partitioning (no extra exchange)."""
    return logs.groupBy(*GAME_KEYS).agg(*[F.sum(s).alias(s) for s in stats])


def team_games_played(logs: DataFrame) -> DataFrame:
    """(P20) distinct (team, game, opponent, date) per team -> team_gp."""
    return (logs.select("team", "game_id", "opponent", "game_date").distinct()
            .groupBy("team").agg(F.count(F.lit(1)).alias("team_gp")))


def injury_counts(injuries: DataFrame) -> DataFrame:
    """(P21) active injuries per team."""
    return injuries.groupBy("team").agg(F.count(F.lit(1)).alias("active_injuries"))


def injuries_by_team(injuries: DataFrame, teams: DataFrame) -> DataFrame:
    """(P21) injury rows with the team's full name."""
    return injuries.join(team_dimension(teams), "team", "left")


# ---------------------------------------------------------------- records

def win_streak(logs: DataFrame) -> DataFrame:
    """(P25) current winning streak per team: games since the last non-win,
    ordered by (date, game id); 0 when the last game was lost."""
    games = logs.select("team", "game_id", "game_date", "outcome").distinct()
    return current_run_length(games, "team", [F.col("game_date"), F.col("game_id")],
                              F.col("outcome") == "W", "win_streak")


def team_record(logs: DataFrame, injuries: DataFrame, teams: DataFrame,
                season_games: int = 72) -> DataFrame:
    """(P26) regular-season wins/losses, injuries, streak, win% and projection."""
    games = (logs.where(F.col("season_type") == REGULAR)
             .select("team", "game_id", "outcome").distinct())
    wl = (games.groupBy("team").pivot("outcome", ["W", "L"]).agg(F.count(F.lit(1)))
          .withColumnsRenamed({"W": "wins", "L": "losses"}))
    rec = (wl.join(injury_counts(injuries), "team", "left")
           .fillna(0, ["wins", "losses", "active_injuries"])
           .join(win_streak(logs), "team", "left")
           .join(team_dimension(teams), "team", "left"))
    pct = safe_ratio(F.col("wins"), F.col("wins") + F.col("losses"))
    proj = F.round(F.col("win_pct") * season_games, 0)
    return (rec.withColumn("win_pct", pct)
            .withColumn("projected_wins", proj)
            .withColumn("projected_losses", F.lit(season_games) - F.col("projected_wins"))
            .select("team", "full_name", "wins", "losses", "active_injuries", "win_streak",
                    "win_pct", "projected_wins", "projected_losses"))


def last_n_record(logs: DataFrame, teams: DataFrame, n: int = 10) -> DataFrame:
    """(P27) W-L over each team's last n game dates, date ties kept (top_n).

    A game is kept when fewer than n of the team's games fall on a later date.
    Counting per (team, date) first bounds the window by the number of dates
    a team played on, not by its number of rows."""
    games = logs.select("team", "game_id", "game_date", "outcome").distinct()
    per_day = games.groupBy("team", "game_date").agg(
        F.count(F.lit(1)).alias("g"),
        F.count_if(F.col("outcome") == "W").alias("w"),
        F.count_if(F.col("outcome") == "L").alias("l"))
    later = (Window.partitionBy("team").orderBy(F.col("game_date").desc())
             .rowsBetween(Window.unboundedPreceding, -1))
    kept = (per_day.withColumn("later", F.coalesce(F.sum("g").over(later), F.lit(0)))
            .where(F.col("later") < n))
    out = kept.groupBy("team").agg(F.sum("w").alias("w"), F.sum("l").alias("l"))
    return (out.join(team_dimension(teams), "team", "left")
            .select("team", "full_name", record_text("w", "l").alias("last_n")))


def conference_standings(record: DataFrame, last_n: DataFrame, teams: DataFrame) -> DataFrame:
    """(P28) seed = competition rank of win% within the conference, all
    conferences in one pass; team-level rows, so the window is small."""
    seed = null_aware_rank("win_pct", partition=["conference"], ascending=False)
    return (record.join(conferences(teams), "team", "left")
            .withColumn("seed", seed)
            .join(last_n.select("team", "last_n"), "team", "left")
            .select("conference", "seed", "team", "full_name", "wins", "losses",
                    "win_streak", "active_injuries", "last_n"))


def seed_labels(standings: DataFrame) -> DataFrame:
    """(P29) '1st in <conference>'."""
    return standings.select("team", F.concat(ordinal("seed"), F.lit(" in "),
                                             F.col("conference")).alias("seed_label"))


def team_rank(record: DataFrame) -> DataFrame:
    """(P31) league rank by win% (row number, ties by team key)."""
    w = Window.orderBy(F.col("win_pct").desc_nulls_last(), F.col("team"))
    return record.select("team", "full_name", F.row_number().over(w).cast("long").alias("rank"))


# ---------------------------------------------------------------- margins

def team_points(logs: DataFrame) -> DataFrame:
    """Team-game rows with the opponent's points (O14)."""
    return with_opponent_totals(team_games(logs, ["pts"]), ["game_id", "game_date"], ["pts"])


def margin_of_victory(logs: DataFrame, chunk_running: bool = True) -> DataFrame:
    """(P30) margin per team-game and the running W-L record in date order.

    A margin of 0 is an 'L' that adds no loss (kept from the source). The
    running count is a two-level prefix sum chunked by day, so one team's
    whole history never sits in a single window task."""
    tp = team_points(logs).withColumn("margin", F.col("pts") - F.col("opp_pts"))
    tp = tp.withColumn("outcome", F.when(F.col("margin") > 0, "W").otherwise("L"))
    chunk = F.col("game_date") if chunk_running else None
    tp = running_sum(tp, "team", ["game_date", "game_id"],
                     {"run_w": (F.col("margin") > 0).cast("long"),
                      "run_l": (F.col("margin") < 0).cast("long")}, chunk=chunk)
    return tp.select("team", "game_id", "game_date", "opponent", "pts", "opp_pts", "margin",
                     "outcome", record_text("run_w", "run_l").alias("record"))


def game_type_distribution(margins: DataFrame) -> DataFrame:
    """(P32) winners' margins binned into clutch / 10-point / blowout games."""
    gt = (F.when(F.col("margin") <= 5, "Clutch Game")
          .when(F.col("margin") <= 10, "10 Pt Game")
          .otherwise("Blowout Game"))
    counts = (margins.where(F.col("margin") >= 1).groupBy(gt.alias("game_type"))
              .agg(F.count(F.lit(1)).alias("n")))
    expl = (F.when(F.col("game_type") == "Blowout Game", "more than 10 points")
            .when(F.col("game_type") == "Clutch Game", "5 points or less")
            .otherwise("between 6 - 10 points"))
    return (share_of_total(counts, "n", None, "share").withColumn("explanation", expl))


def league_scoring_average(logs: DataFrame, baseline: float = 111.8) -> DataFrame:
    """(P33) points per team-game -> mean per team -> mean of team means."""
    per_team = (team_games(logs.where(F.col("season_type") == REGULAR), ["pts"])
                .groupBy("team").agg(F.avg("pts").alias("avg_pts")))
    avg = per_team.agg(F.round(F.avg("avg_pts"), 1).alias("league_avg"))
    return avg.withColumn("pct_change",
                          F.round(F.col("league_avg") / F.lit(baseline) * 100 - 100, 2))


# ---------------------------------------------------------------- day views

def day_results(logs: DataFrame, day=None) -> DataFrame:
    """(P22) points per team-game on one day (default: the latest date)."""
    rows = (logs.where(F.col("game_date") == F.lit(day)) if day is not None
            else filter_global_extreme(logs, "game_date"))
    return (rows.groupBy("game_id", "team", "opponent", "location", "outcome", "game_date")
            .agg(F.sum("pts").alias("team_pts")))


def day_summary(results: DataFrame) -> DataFrame:
    """(P23) games on the day, home wins / road wins and their shares (text, 2 dp)."""
    home = results.where(F.col("location") == "H")
    n_home = F.count_if(F.col("outcome") == "W")
    n_road = F.count_if(F.col("outcome") == "L")
    tot = F.count(F.lit(1))

    def share(x):
        return F.format_string("%.2f", F.round(safe_ratio(x, tot), 2))

    s = home.agg(n_home.alias("home_wins"), n_road.alias("road_wins"),
                 share(n_home).alias("home_share"), share(n_road).alias("road_share"))
    g = results.agg((F.count(F.lit(1)) / 2).alias("games"), F.max("game_date").alias("game_date"))
    return g.crossJoin(s)


def home_road_split(logs: DataFrame) -> DataFrame:
    """(P24) season home wins vs road wins over distinct games, with shares."""
    home = logs.where(F.col("location") == "H").select("game_id", "outcome").distinct()
    s = home.agg(F.count_if(F.col("outcome") == "W").alias("home_wins"),
                 F.count_if(F.col("outcome") == "L").alias("road_wins"))
    tot = F.col("home_wins") + F.col("road_wins")
    return s.select("home_wins", "road_wins",
                    F.round(safe_ratio(F.col("home_wins"), tot) * 100, 1).alias("home_pct"),
                    F.round(safe_ratio(F.col("road_wins"), tot) * 100, 1).alias("road_pct"),
                    tot.alias("total_games"))


# ---------------------------------------------------------------- strength of schedule

def schedule_strength_so_far(logs: DataFrame, record: DataFrame) -> DataFrame:
    """(P37) own and opponent win% per team-game; mean opponent win% per team.

    The means come from games counted per (team, opponent), and what a game row
    gets is one row of (team, opponent): a table of team pairs, not of games."""
    games = logs.select("team", "game_id", "game_date", "outcome", "location", "opponent").distinct()
    pct = record.select("team", "win_pct")
    opp = pct.withColumnsRenamed({"team": "opponent", "win_pct": "opp_win_pct"})
    pairs = (games.groupBy("team", "opponent").agg(F.count(F.lit(1)).alias("n"))
             .join(opp, "opponent", "left").join(pct, "team", "left"))
    met = F.sum(F.when(F.col("opp_win_pct").isNotNull(), F.col("n")))
    avg = pairs.groupBy("team").agg(
        F.round(safe_ratio(F.sum(F.col("opp_win_pct") * F.col("n")), met), 3).alias("avg_opp_win_pct"))
    pairs = pairs.join(avg, "team", "left").drop("n")
    return (games.join(measured(pairs), ["team", "opponent"], "left")
            .select("team", "game_id", "opponent", "outcome", "location",
                    F.round("win_pct", 3).alias("win_pct"),
                    F.round("opp_win_pct", 3).alias("opp_win_pct"), "avg_opp_win_pct"))


def home_road_records(strength: DataFrame) -> DataFrame:
    """(P38) home and road W-L text per team (pivot on location_outcome)."""
    return strength.groupBy("team").agg(*_home_road())


def _record_of(won: Column, name: str) -> Column:
    """W-L text of the rows that satisfy a condition (O39-O41: a listed pivot
    is a conditional count per value)."""
    def n(outcome):
        return F.count_if(won & (F.col("outcome") == outcome))
    return record_text(n("W"), n("L")).alias(name)


def _home_road() -> list[Column]:
    return [_record_of(F.col("location") == "H", "home_record"), _record_of(F.col("location") == "A", "road_record")]


def record_vs_quality(strength: DataFrame, record: DataFrame, cut: float = 0.5) -> DataFrame:
    """(P39) records against opponents at/above vs below ``cut`` win%, shares,
    home/road records, mean opponent win%, own win%: one aggregate per team."""
    above = F.coalesce(F.col("opp_win_pct") >= cut, F.lit(False))
    decided = F.col("outcome").isin("W", "L")
    n = F.count_if(decided)
    p = strength.groupBy("team").agg(
        _record_of(above, "above_record"), _record_of(~above, "below_record"),
        F.round(safe_ratio(F.count_if(decided & above), n), 3).alias("share_above"),
        F.round(safe_ratio(F.count_if(decided & ~above), n), 3).alias("share_below"),
        *_home_road(), F.max("avg_opp_win_pct").alias("avg_opp_win_pct"))
    return p.join(record.select("team", "win_pct"), "team", "left")


# ---------------------------------------------------------------- boards

def last_night_team_board(logs: DataFrame, logos: DataFrame | None = None, day=None) -> DataFrame:
    """(P40) winners of the last day with points, 3P%, opponent values and
    colour codes against each team's season average and high, widest margin
    first; with ``logos`` (team, logo) both sides' logos."""
    tg = with_opponent_totals(team_games(logs, ["pts", "fg3m", "fg3a"]), ["game_id", "game_date"],
                              ["pts", "fg3m", "fg3a"])
    season = tg.groupBy("team").agg(
        F.round(F.avg("pts"), 1).alias("avg_ppg"), F.round(F.avg("opp_pts"), 1).alias("avg_opp_ppg"),
        F.max("pts").alias("max_pts"))
    rows = (tg.where(F.col("game_date") == F.lit(day)) if day is not None
            else filter_global_extreme(tg, "game_date"))
    rows = rows.join(measured(season), "team", "left")
    diff = F.col("pts") - F.col("avg_ppg")
    odiff = F.col("opp_pts") - F.col("avg_opp_ppg")
    pts_code = (F.when(F.col("pts") == F.col("max_pts"), 1).when(diff >= 10, 2)
                .when(diff <= -10, 3).otherwise(0))
    opp_code = F.when(odiff <= -10, 2).when(odiff >= 10, 3).otherwise(0)
    images = []
    if logos is not None:
        rows = (rows.join(logos.select("team", "logo"), "team", "left")
                .join(logos.select(F.col("team").alias("opponent"), F.col("logo").alias("opp_logo")), "opponent", "left"))
        images = ["logo", "opp_logo"]
    return (rows.where(F.col("pts") > F.col("opp_pts")).orderBy((F.col("opp_pts") - F.col("pts")), "team", "game_id")
            .select("team", "opponent", "location", *images,
                    F.when(F.col("location") == "H", "Vs.").otherwise("@").alias("venue"),
                    "pts", "opp_pts", (F.col("pts") - F.col("opp_pts")).alias("margin"),
                    F.round(safe_ratio("fg3m", "fg3a"), 3).alias("fg3_pct"),
                    F.round(safe_ratio("opp_fg3m", "opp_fg3a"), 3).alias("opp_fg3_pct"),
                    pts_code.alias("pts_code"), opp_code.alias("opp_pts_code")))


def opponent_shooting_ranks(logs: DataFrame) -> DataFrame:
    """(P36) opponents' shooting per team from the box scores, ranked (1 =
    lowest allowed) with ordinals."""
    tg = with_opponent_totals(team_games(logs, STATS), ["game_id", "game_date"], STATS)
    agg = tg.groupBy("team").agg(
        F.round(safe_ratio(F.sum("opp_fg3m"), F.sum("opp_fg3a")), 3).alias("opp_fg3_pct"),
        F.round(safe_ratio(F.sum("opp_pts"), F.lit(2) * (F.sum("opp_fga") + F.lit(0.44) * F.sum("opp_fta"))),
                3).alias("opp_ts"),
        F.round(F.avg("opp_fta"), 1).alias("opp_fta_per_game"))
    out = agg
    for c, r in (("opp_fg3_pct", "fg3_rank"), ("opp_ts", "ts_rank"), ("opp_fta_per_game", "fta_rank")):
        out = out.withColumn(r, null_aware_rank(c, ascending=True))
        out = out.withColumn(r + "_text", ordinal(r))
    return out.withColumn("rating_text", F.concat(
        F.lit("Opponent TS%: "), percent_text("opp_ts"), F.lit(" ("), F.col("ts_rank_text"), F.lit(")<br>Opponent 3P%: "),
        percent_text("opp_fg3_pct"), F.lit(" ("), F.col("fg3_rank_text"), F.lit(")<br>Opponent FTA/g: "),
        number_text("opp_fta_per_game"), F.lit(" ("), F.col("fta_rank_text"), F.lit(")")))


# ---------------------------------------------------------------- dormant analyses

def rest_day_outcomes(logs: DataFrame) -> DataFrame:
    """(P59) team-games by days of rest (days since the team's previous game
    minus one; null for the first game) and outcome, share within rest.

    The previous game date comes from a window over the team's distinct game
    dates (bounded by the calendar, not by the data); a second game on the
    same date follows the first with -1 days of rest."""
    games = logs.select("team", "game_id", "game_date", "outcome").distinct()
    dates = games.select("team", "game_date").distinct()
    dates = dates.withColumn("prev_date", F.lag("game_date").over(
        Window.partitionBy("team").orderBy("game_date")))
    firsts = games.groupBy("team", "game_date").agg(F.min("game_id").alias("first_id"))
    first_of_day = F.col("game_id") == F.col("first_id")
    g = (games.join(firsts, ["team", "game_date"]).join(dates, ["team", "game_date"], "left")
         .withColumn("days_rest", F.when(first_of_day, F.datediff("game_date", "prev_date") - 1)
                     .otherwise(F.lit(-1)).cast("long")))
    counts = g.groupBy("days_rest", "outcome").agg(F.count(F.lit(1)).alias("n"))
    return share_of_total(counts, "n", ["days_rest"], "share").withColumn(
        "share", F.round("share", 3))


def team_points_history(logs: DataFrame) -> DataFrame:
    """(P61) points per team-game."""
    return (logs.groupBy("team", "game_id", "outcome", "opponent").agg(F.sum("pts").alias("pts")))
