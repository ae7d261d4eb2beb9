"""Player pipelines: enrichment, shooting, value metric, contracts, scorers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from courtside.functions.exprs import (
    ascii_fold, last_word, money_text, money_to_double, recode, safe_ratio, thousands_text, true_shooting,
)
from courtside.operators.core import (
    band_percent_rank, filter_global_extreme, filter_group_extreme, global_row_number, top_n_with_ties,
)
from courtside.plans.teams import REGULAR, team_dimension, team_games_played

# Team code recodes and contract-name aliases of the source data.
TEAM_CODE_RECODES = {"BRK": "BKN", "PHO": "PHX", "CHO": "CHA"}
PLAYER_NAME_ALIASES = {
    "J.J. Redick": "JJ Redick",
    "T.J. Leaf": "TJ Leaf",
    "Marcus Morris": "Marcus Morris Sr.",
    "Danuel House": "Danuel House Jr.",
    "Robert Williams": "Robert Williams III",
    "Otto Porter": "Otto Porter Jr.",
    "Kevin Knox": "Kevin Knox II",
    "Lonnie Walker": "Lonnie Walker IV",
    "Sviatoslav Mykhailiuk": "Svi Mykhailiuk",
    "Harry Giles": "Harry Giles III",
    "Wesley Iwundu": "Wes Iwundu",
    "James Ennis": "James Ennis III",
}
# Salary bands (lower bound, label), highest first.
SALARY_BANDS = [
    (30_000_000, "$30+ M"),
    (25_000_000, "$25-30 M"),
    (20_000_000, "$20-25 M"),
    (15_000_000, "$15-20 M"),
    (10_000_000, "$10-15 M"),
    (5_000_000, "$5-10 M"),
]
BAND_FLOOR = "< $5 M"


# ---------------------------------------------------------------- contracts

def clean_contracts(raw: DataFrame, salary_col: str = "salary_text", name_col: str | None = None,
                    total_col: str | None = None, aliases: dict | None = None,
                    team_recodes: dict | None = None) -> DataFrame:
    """(P03) contract rows -> numeric salary; optional name folding/aliases,
    team-code recodes and total owed (empty -> 0); repeated header rows dropped."""
    df = raw
    if name_col:
        df = (df.where(F.col(name_col) != "Player")
              .withColumn(name_col, recode(ascii_fold(name_col), aliases if aliases is not None
                                           else PLAYER_NAME_ALIASES)))
    df = df.where(F.col(salary_col).isNull() | (F.col(salary_col) != "Salary"))
    df = df.withColumn("salary", money_to_double(salary_col))
    if total_col:
        df = df.withColumn("total_owed", F.when(F.col(total_col) == "", F.lit(0.0))
                           .otherwise(money_to_double(total_col)))
    if team_recodes:
        df = df.withColumn("team", recode("team", team_recodes))
    keep = [c for c in (name_col, "player_id", "team", "salary") if c and c in df.columns]
    if total_col:
        keep.append("total_owed")
    return df.select(*dict.fromkeys(keep)).distinct()


def player_salary(contracts: DataFrame) -> DataFrame:
    """One salary per player (max), so a player listed twice cannot fan out joins."""
    return contracts.groupBy("player_id").agg(F.max("salary").alias("salary"))


# ---------------------------------------------------------------- enrichment

def player_games_played(logs: DataFrame) -> DataFrame:
    """(P10) box-score rows per player."""
    return logs.groupBy("player_id").agg(F.count(F.lit(1)).alias("gp"))


def player_totals(logs: DataFrame) -> DataFrame:
    """Per-player season aggregates: games, true shooting, value metric, ppg."""
    value = (F.avg("pts") + F.lit(0.5) * F.avg("plus_minus") + F.lit(2.0) * F.avg(F.col("stl") + F.col("blk"))
             + F.lit(0.5) * F.avg("trb") - F.lit(1.5) * F.avg("tov") + F.lit(1.5) * F.avg("ast"))
    return logs.groupBy("player_id").agg(
        F.count(F.lit(1)).alias("gp"),
        F.round(true_shooting(F.sum("pts"), F.sum("fga"), F.sum("fta")), 3).alias("season_ts"),
        F.round(value, 1).alias("value"),
        F.round(F.avg("pts"), 1).alias("season_ppg"))


def enriched_game_log(logs: DataFrame, contracts: DataFrame, teams: DataFrame,
                      season_games: int = 72) -> DataFrame:
    """(P11) box-score rows with shooting, value metric, salary, games missed
    and the games-missed penalty on the value metric.

    All but the game's own figures are a (player, team)'s: season totals,
    salary, games missed and penalties are joined and computed on that grain,
    so the rows meet one join. Totals come from ``groupBy(player)`` (a hot player
    is combined map-side; AQE splits the skewed join partition)."""
    game_value = (F.col("pts") + F.lit(0.5) * F.col("plus_minus") + (F.lit(2) * F.col("stl") + F.col("blk"))
                  + F.lit(0.5) * F.col("trb") - F.col("tov") + F.col("ast"))
    pairs = (logs.select("player_id", "team").distinct()
             .join(player_totals(logs), "player_id", "left")
             .join(player_salary(contracts), "player_id", "left")
             .join(team_dimension(teams), "team", "left")
             .join(team_games_played(logs), "team", "left"))
    value, gp, team_gp = F.col("value"), F.col("gp"), F.col("team_gp")
    missed = team_gp - gp
    grace = F.lit(10) * F.round(team_gp / F.lit(season_games), 1)
    penalty = (F.when(missed == 0, F.lit(1.0))
               .when(missed <= grace, F.lit(1.0))
               .when((missed > grace) & (value >= 0), F.lit(1.0) - F.lit(0.03) * (missed - grace))
               .when((missed > grace) & (value < 0), F.lit(1.0) + F.lit(0.03) * (missed - grace)))
    adj = F.round(F.when(team_gp == gp, value)
                  .when(missed == grace, value)
                  .when(missed < grace, value)
                  .when(missed > grace, value * F.col("penalty_factor")), 1)
    ratio = safe_ratio(F.abs(F.col("_adj") - value), value)
    capped = F.round(F.when(ratio >= 0.3, value * F.lit(0.67)).when(ratio < 0.3, F.col("_adj")), 1)
    pairs = (pairs.withColumn("games_missed", missed)
             .withColumn("penalty_factor", penalty)
             .withColumn("pct_played", F.round(safe_ratio(gp, team_gp), 3))
             .withColumn("_adj", adj)
             .withColumn("value_adj", capped)
             .withColumn("value_penalty", value - F.col("value_adj"))
             .drop("_adj")
             .withColumnsRenamed({"player_id": "_player", "team": "_team"}))
    same = F.col("player_id").eqNullSafe(F.col("_player")) & F.col("team").eqNullSafe(F.col("_team"))
    return (logs.withColumn("game_ts", F.round(true_shooting("pts", "fga", "fta"), 3))
            .withColumn("game_value", game_value)
            .join(pairs, same, "left").drop("_player", "_team"))


def league_true_shooting(logs: DataFrame) -> DataFrame:
    """(P12) league true shooting, 3 dp."""
    return logs.agg(F.round(true_shooting(F.sum("pts"), F.sum("fga"), F.sum("fta")), 3).alias("league_ts"))


def player_latest_team(logs: DataFrame) -> DataFrame:
    """(P13) the team(s) of each player's last game date; same-date ties keep both."""
    last = logs.groupBy("player_id", "team").agg(F.max("game_date").alias("last_date"))
    return filter_group_extreme(last, "player_id", "last_date").select("player_id", "team")


def latest_slice(df: DataFrame, date_col: str = "game_date") -> DataFrame:
    """(P14) rows on the latest date."""
    return filter_global_extreme(df, date_col)


def most_recent_date(df: DataFrame, date_col: str = "game_date") -> DataFrame:
    """(P14) the latest date, one row."""
    return df.agg(F.max(date_col).alias(date_col))


def player_season_high(logs: DataFrame) -> DataFrame:
    """(P15) season high, mean points (1 dp) and season true shooting."""
    return logs.groupBy("player_id").agg(
        F.round(F.avg("pts"), 1).alias("avg_pts"), F.max("pts").alias("season_high"),
        F.round(true_shooting(F.sum("pts"), F.sum("fga"), F.sum("fta")), 3).alias("season_ts"))


def top_performers(enriched: DataFrame, n: int = 15, day=None) -> DataFrame:
    """(P16) top-n scorers of the day (ties at the cut kept) with colour codes
    against the player's season high / average and season true shooting."""
    rows = (enriched.where(F.col("game_date") == F.lit(day)) if day is not None
            else latest_slice(enriched))
    top = top_n_with_ties(rows.select("player_id", "team", "full_name", "game_id", "pts", "game_ts", "outcome",
                                      "salary"), n, "pts")
    top = top.join(player_season_high(enriched), "player_id", "left")
    # ties at the cut grow with the data
    top = global_row_number(top, [F.col("pts").desc(), F.col("player_id"), F.col("game_id")], "rank")
    diff = F.col("pts") - F.col("avg_pts")
    ts_diff = F.col("game_ts") - F.col("season_ts")
    pts_code = (F.when(F.col("pts") == F.col("season_high"), 1)
                .when((F.col("pts") != F.col("season_high")) & (diff >= 10), 2)
                .when(diff <= -10, 3).otherwise(0))
    ts_code = (F.when(ts_diff >= 0.25, 1).when((ts_diff < 0.25) & (ts_diff >= 0.15), 2)
               .when(F.col("game_ts") <= 0.40, 3).otherwise(0))
    return top.select("rank", "player_id", "team",
                      last_word("full_name").alias("team_label"), "pts",
                      "game_ts", "outcome", "salary", pts_code.alias("pts_code"), ts_code.alias("ts_code"))


# ---------------------------------------------------------------- scorers

def _not_excluded(exclude) -> F.Column:
    cond = F.lit(True)
    for player, team in exclude or ():
        cond = cond & ~((F.col("player_id") == F.lit(player)) & (F.col("team") == F.lit(team)))
    return cond


def efficient_scorers(enriched: DataFrame, record: DataFrame, min_ppg: float = 20,
                      exclude=(), top: int = 5, min_games: int = 0) -> DataFrame:
    """(P17) regular-season scorers averaging >= min_ppg, one row per player
    (figures of the latest regular-season game, team of the latest game of any
    kind), ranked by adjusted value metric. One pass over the log: the rows that
    count are conditions inside the aggregate."""
    counts = (F.col("season_type") == REGULAR) & _not_excluded(exclude)
    order = F.struct("game_date", "game_id")
    latest = F.max_by(F.when(counts, F.struct("season_ts", "value_adj", "gp")), F.when(counts, order)).alias("l")
    p = (enriched.groupBy("player_id")
         .agg(F.avg(F.when(counts, F.col("pts"))).alias("avg_pts"), F.max_by("team", order).alias("team"), latest)
         .select("player_id", "avg_pts", "team", "l.season_ts", "l.value_adj", "l.gp")
         .where((F.col("avg_pts") >= min_ppg) & (F.col("gp") >= min_games)))
    # the ranked players grow with the data
    p = global_row_number(p, [F.col("value_adj").desc_nulls_last(), F.col("player_id")], "rank")
    p = p.withColumn("top_flag", F.when(F.col("rank") <= top, F.lit(f"Top {top} MVP Candidate"))
                     .otherwise(F.lit("Other")))
    return (p.join(record.select("team", "wins", "losses"), "team", "left")
            .select("rank", "player_id", "team", "avg_pts", "season_ts", "value_adj", "gp",
                    "top_flag", "wins", "losses"))


def team_scorers(enriched: DataFrame, record: DataFrame, teams: DataFrame, flags: DataFrame,
                 min_games: int = 0) -> DataFrame:
    """(P18) every regular-season (player, team) with the player's season
    figures, the top-n flag (else 'Other'), team name and record."""
    reg = enriched.where(F.col("season_type") == REGULAR)
    pa = reg.groupBy("player_id").agg(
        F.avg("pts").alias("avg_pts"), F.max("season_ts").alias("season_ts"),
        F.max("value").alias("value"), F.max("gp").alias("gp")).where(F.col("gp") >= min_games)
    pairs = reg.select("player_id", "team").distinct()
    f = flags.where(F.col("top_flag") != "Other").select("player_id", "top_flag")
    return (pairs.join(pa, "player_id", "inner")
            .join(f, "player_id", "left")
            .withColumn("top_flag", F.coalesce("top_flag", F.lit("Other")))
            .join(team_dimension(teams), "team", "left")
            .join(record.select("team", "wins", "losses"), "team", "left")
            .select("player_id", "team", "full_name", "avg_pts", "season_ts", "value", "gp",
                    "top_flag", "wins", "losses"))


# ---------------------------------------------------------------- contract value

def salary_band(c="salary"):
    expr = None
    for bound, label in SALARY_BANDS:
        cond = F.col(c) >= bound
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr.otherwise(F.lit(BAND_FLOOR))


def contract_value(enriched: DataFrame, latest_team: DataFrame) -> DataFrame:
    """(P19) latest row per player, salary band, percent rank / mean / count /
    share of the adjusted value metric within the band, and a value class.
    A null salary falls in the lowest band (kept from the source). A player's
    figures are the season's and the team's: the distinct ones of the last day
    come from one aggregate over the log."""
    figures = enriched.groupBy("player_id", "game_date").agg(F.collect_set(F.struct("value_adj", "salary")).alias("f"))
    last = (figures.groupBy("player_id").agg(F.max_by("f", "game_date").alias("f"))
            .select("player_id", F.explode("f").alias("f")).select("player_id", "f.value_adj", "f.salary")
            .withColumn("band", salary_band()))
    ranked = band_percent_rank(last, "band", "value_adj", "_pr")
    # values carry one decimal: average them as exact integers (tenths) so the
    # result does not depend on the order partitions are summed in
    tenths = F.round(F.col("value_adj") * 10, 0)
    stats = last.groupBy("band").agg(F.round(F.avg(tenths) / 10, 4).alias("band_mean"),
                                     F.count(F.lit(1)).alias("band_count"))
    # at most one row per band: the league total is a window over those rows
    stats = stats.withColumn("band_share", F.round(
        F.col("band_count") / F.sum("band_count").over(Window.partitionBy()), 3))
    out = (ranked.join(stats, "band", "left")
           .withColumn("band_pct_rank", F.round("_pr", 3)))
    pct100 = F.col("band_pct_rank") * 100
    cls = (F.when((pct100 >= 60) & (F.col("salary") >= 25_000_000), "Superstars")
           .when(pct100 >= 90, "Great Value")
           .when((pct100 < 90) & (pct100 >= 20), "Normal")
           .otherwise("Bad Value"))
    return (out.withColumn("value_class", cls)
            .join(latest_team, "player_id", "left")
            .select("player_id", "team", "salary", "band", "band_pct_rank", "band_mean",
                    "band_count", "band_share", "value_class").distinct())


def contract_band_summary(value: DataFrame) -> DataFrame:
    """(P19b) one row per salary band."""
    return value.select("band", F.col("band_count").alias("count"), F.col("band_share").alias("share"),
                        F.col("band_mean").alias("mean_value")).distinct()


def contract_value_missing(contracts: DataFrame, gp: DataFrame, record: DataFrame) -> DataFrame:
    """(P34) contract value achieved vs missed per team (salary x games played
    against salary x the team's most games), with the league mean share."""
    c = contracts.join(gp, "player_id", "left").fillna(0, ["gp"])
    t = c.groupBy("team").agg(F.max("gp").alias("team_gp"), F.sum("salary").alias("_sal"),
                              F.sum(F.col("salary") * F.col("gp")).alias("achieved"))
    t = (t.withColumn("max_value", F.col("_sal") * F.col("team_gp"))
         .withColumn("missing", F.col("max_value") - F.col("achieved"))
         .withColumn("pct_achieved", F.round(safe_ratio("achieved", "max_value"), 3))
         .withColumn("pct_missing", F.round(safe_ratio("missing", "max_value"), 3)))
    # one row per team: the league mean is a window over those rows; the 3-dp
    # shares are summed as exact integers so the order of the sum cannot matter
    mean = F.avg(F.round(F.col("pct_missing") * 1000, 0)).over(Window.partitionBy()) / 1000
    return (t.withColumn("league_mean_pct", mean)
            .join(record.select("team", "wins", "losses", "win_pct"), "team", "left")
            .select("team", "team_gp", "max_value", "achieved", "missing", "pct_achieved",
                    "pct_missing", "league_mean_pct", "wins", "losses", "win_pct"))


def payroll_text(contracts: DataFrame) -> DataFrame:
    """per team: players, payroll and money still owed as text."""
    return contracts.groupBy("team").agg(
        thousands_text(F.count(F.lit(1))).alias("players"), money_text(F.sum("salary")).alias("payroll"), money_text(F.sum("total_owed")).alias("owed"))


def contract_value_missing_players(contracts: DataFrame, gp: DataFrame) -> DataFrame:
    """(P34) per player: value achieved (salary x games), value missed against
    the team's most games, and the share missed."""
    c = contracts.join(gp, "player_id", "left").fillna(0, ["gp"])
    most = c.groupBy("team").agg(F.max("gp").alias("team_gp"))
    achieved, full = F.col("salary") * F.col("gp"), F.col("salary") * F.col("team_gp")
    return (c.join(most, "team").select(
        "player_id", "team", "salary", "gp", "team_gp", achieved.alias("achieved"), (full - achieved).alias("missing"),
        F.round(safe_ratio(full - achieved, full), 3).alias("pct_missing")))


# ---------------------------------------------------------------- dormant analyses

def scoring_variance(logs: DataFrame) -> DataFrame:
    """(P60) per player: mean points (1 dp), variance about that rounded mean,
    standard deviation (2 dp) and coefficient of variation (3 dp).

    One aggregate: sum((x-a)^2)/n = (sum(x^2) - 2a*sum(x) + n*a^2)/n with the
    rounded mean a; integer sums are exact."""
    g = logs.groupBy("player_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("pts").alias("s1"),
        F.sum(F.col("pts") * F.col("pts")).alias("s2"))
    a = F.round(F.col("s1") / F.col("n"), 1)
    var = (F.col("s2") - F.lit(2.0) * F.col("avg_pts") * F.col("s1")
           + F.col("n") * F.col("avg_pts") * F.col("avg_pts")) / F.col("n")
    return (g.withColumn("avg_pts", a)
            .withColumn("variance", var)
            .withColumn("std_dev", F.round(F.sqrt(F.greatest(F.col("variance"), F.lit(0.0))), 2))
            .withColumn("cv", F.round(safe_ratio("std_dev", "avg_pts"), 3))
            .select("player_id", "avg_pts", "variance", "std_dev", "cv"))


def metric_adjustment_report(enriched: DataFrame) -> DataFrame:
    """(P62) distinct value metric, adjusted value, penalty and its ratio."""
    return enriched.select(
        "player_id", "team", "value", "value_adj", "value_penalty", "games_missed",
        F.round(safe_ratio(F.abs(F.col("value_penalty")), F.col("value")), 3).alias("penalty_ratio")).distinct()
