"""Registry of named queries: name -> Spark callable ``(spark, sf_dir) -> DataFrame``.

Every query reads the driver's tables of ``sf_dir`` through the fixture views
and runs one named pipeline over the whole of them. ``oracle_sql.ORACLE``
holds the DuckDB twin of each (absent only where SQL cannot express it).

Functions with a leading underscore are intermediates that several queries
read. Those that are costly (``_log``, ``_enriched``, ``_record``, ``_timeline``,
``_margins``, ``_team_scorers``) are stored under a fingerprint of their input files and
their plan (``sources.results``); the others are plans.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from courtside.plans import teams as T
from courtside.sources.fixtures import Fixture
from courtside.sources.results import stored_result

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


def fixture(spark: SparkSession, sf_dir: str) -> Fixture:
    return Fixture(spark, sf_dir)


GAMES = ("orders", "customer", "lineitem")
LEAGUE = ("nation", "region")


def _once(fx: Fixture, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """A frame that a query uses twice, made once."""
    if name not in fx.made:
        fx.made[name] = make()
    return fx.made[name]


def _kept(fx: Fixture, name: str, df: DataFrame, tables, partition_by=()) -> DataFrame:
    """``df`` stored as a result of base tables."""
    return stored_result(df, name, [f"{fx.sf_dir}/{t}.parquet" for t in tables], partition_by)


def _log(fx: Fixture) -> DataFrame:
    """The box scores: what nearly all team and player queries read."""
    return _once(fx, "log", lambda: _kept(fx, "box_scores", fx.v_box_scores, GAMES))


# ------------------------------------------------------------------ M1 teams

def _record(fx: Fixture) -> DataFrame:
    return _once(fx, "record", lambda: _kept(fx, "team_record", T.team_record(_log(fx), fx.v_injuries, fx.v_teams), GAMES + LEAGUE))


def _standings(fx: Fixture) -> DataFrame:
    return T.conference_standings(_record(fx), T.last_n_record(_log(fx), fx.v_teams),
                                  fx.v_teams).orderBy("conference", "seed", "team")


@query("team_dimension")
def q_team_dimension(spark, sf_dir):
    return T.team_dimension(fixture(spark, sf_dir).v_teams)


@query("conferences")
def q_conferences(spark, sf_dir):
    return T.conferences(fixture(spark, sf_dir).v_teams)


@query("team_games_played")
def q_team_games_played(spark, sf_dir):
    return T.team_games_played(_log(fixture(spark, sf_dir)))


@query("injury_counts")
def q_injury_counts(spark, sf_dir):
    return T.injury_counts(fixture(spark, sf_dir).v_injuries)


@query("injuries_by_team")
def q_injuries_by_team(spark, sf_dir):
    fx = fixture(spark, sf_dir)
    return T.injuries_by_team(fx.v_injuries, fx.v_teams)


@query("win_streak")
def q_win_streak(spark, sf_dir):
    return T.win_streak(_log(fixture(spark, sf_dir)))


@query("team_record")
def q_team_record(spark, sf_dir):
    return _record(fixture(spark, sf_dir))


@query("last_n_record")
def q_last_n_record(spark, sf_dir):
    fx = fixture(spark, sf_dir)
    return T.last_n_record(_log(fx), fx.v_teams)


@query("conference_standings")
def q_conference_standings(spark, sf_dir):
    return _standings(fixture(spark, sf_dir))


@query("seed_labels")
def q_seed_labels(spark, sf_dir):
    return T.seed_labels(_standings(fixture(spark, sf_dir)))


@query("team_rank")
def q_team_rank(spark, sf_dir):
    return T.team_rank(_record(fixture(spark, sf_dir)))


# ------------------------------------------------------------------ M2 players

from courtside.plans import players as P  # noqa: E402

SCORER_MIN_PPG = 29          # per-player averages run 23-32 on the fixtures
SCORER_EXCLUDE = ((9, 1),)   # one (player, team) pair left out, as the source does


def _contracts(fx: Fixture) -> DataFrame:
    return P.clean_contracts(fx.v_contracts)


def _enriched(fx: Fixture) -> DataFrame:
    return _once(fx, "enriched", lambda: _kept(
        fx, "enriched_game_log", P.enriched_game_log(_log(fx), _contracts(fx), fx.v_teams), GAMES + LEAGUE + ("part",)))


def _scorers(fx: Fixture) -> DataFrame:
    return P.efficient_scorers(_enriched(fx), _record(fx), min_ppg=SCORER_MIN_PPG,
                               exclude=SCORER_EXCLUDE)


def _contract_value(fx: Fixture) -> DataFrame:
    return P.contract_value(_enriched(fx), P.player_latest_team(_log(fx)))


@query("clean_contracts")
def q_clean_contracts(spark, sf_dir):
    return _contracts(fixture(spark, sf_dir))


@query("player_games_played")
def q_player_games_played(spark, sf_dir):
    return P.player_games_played(_log(fixture(spark, sf_dir)))


@query("enriched_game_log")
def q_enriched_game_log(spark, sf_dir):
    return _enriched(fixture(spark, sf_dir))


@query("league_true_shooting")
def q_league_true_shooting(spark, sf_dir):
    return P.league_true_shooting(_log(fixture(spark, sf_dir)))


@query("player_latest_team")
def q_player_latest_team(spark, sf_dir):
    return P.player_latest_team(_log(fixture(spark, sf_dir)))


@query("latest_slice")
def q_latest_slice(spark, sf_dir):
    return P.latest_slice(_log(fixture(spark, sf_dir)))


@query("most_recent_date")
def q_most_recent_date(spark, sf_dir):
    return P.most_recent_date(_log(fixture(spark, sf_dir)))


@query("player_season_high")
def q_player_season_high(spark, sf_dir):
    return P.player_season_high(_log(fixture(spark, sf_dir)))


@query("top_performers")
def q_top_performers(spark, sf_dir):
    return P.top_performers(_enriched(fixture(spark, sf_dir)), n=15)


@query("efficient_scorers")
def q_efficient_scorers(spark, sf_dir):
    return _scorers(fixture(spark, sf_dir))


def _team_scorers(fx: Fixture) -> DataFrame:
    """By team: a team's scorers are read from its own folder."""
    made = P.team_scorers(_enriched(fx), _record(fx), fx.v_teams, _scorers(fx))
    return _kept(fx, "team_scorers", made, GAMES + LEAGUE + ("part",), partition_by=["team"])


@query("team_scorers")
def q_team_scorers(spark, sf_dir):
    return _team_scorers(fixture(spark, sf_dir))


@query("contract_value")
def q_contract_value(spark, sf_dir):
    return _contract_value(fixture(spark, sf_dir))


@query("contract_band_summary")
def q_contract_band_summary(spark, sf_dir):
    return P.contract_band_summary(_contract_value(fixture(spark, sf_dir)))


@query("contract_value_missing")
def q_contract_value_missing(spark, sf_dir):
    fx = fixture(spark, sf_dir)
    return P.contract_value_missing(_contracts(fx), P.player_games_played(_log(fx)), _record(fx))


@query("scoring_variance")
def q_scoring_variance(spark, sf_dir):
    return P.scoring_variance(_log(fixture(spark, sf_dir)))


@query("metric_adjustment_report")
def q_metric_adjustment_report(spark, sf_dir):
    return P.metric_adjustment_report(_enriched(fixture(spark, sf_dir)))


# ------------------------------------------------------------------ M3 pairing and running

def _margins(fx: Fixture) -> DataFrame:
    """By team: a team's margins are read from its own folder."""
    return _kept(fx, "margins", T.margin_of_victory(_log(fx)), GAMES, partition_by=["team"])


def _strength(fx: Fixture) -> DataFrame:
    return T.schedule_strength_so_far(_log(fx), _record(fx))


@query("margin_of_victory")
def q_margin_of_victory(spark, sf_dir):
    return _margins(fixture(spark, sf_dir))


@query("game_type_distribution")
def q_game_type_distribution(spark, sf_dir):
    return T.game_type_distribution(_margins(fixture(spark, sf_dir)))


@query("home_road_split")
def q_home_road_split(spark, sf_dir):
    return T.home_road_split(_log(fixture(spark, sf_dir)))


@query("league_scoring_average")
def q_league_scoring_average(spark, sf_dir):
    return T.league_scoring_average(_log(fixture(spark, sf_dir)))


@query("day_results")
def q_day_results(spark, sf_dir):
    return T.day_results(_log(fixture(spark, sf_dir)))


@query("day_summary")
def q_day_summary(spark, sf_dir):
    return T.day_summary(T.day_results(_log(fixture(spark, sf_dir))))


@query("schedule_strength_so_far")
def q_schedule_strength_so_far(spark, sf_dir):
    return _strength(fixture(spark, sf_dir))


@query("home_road_records")
def q_home_road_records(spark, sf_dir):
    return T.home_road_records(_strength(fixture(spark, sf_dir)))


@query("record_vs_quality")
def q_record_vs_quality(spark, sf_dir):
    fx = fixture(spark, sf_dir)
    return T.record_vs_quality(_strength(fx), _record(fx))


def _logos(fx: Fixture) -> DataFrame:
    name = F.lower(F.regexp_replace("full_name", " ", "_"))
    return fx.v_teams.select("team", F.concat(F.lit("logos/"), name, F.lit(".png")).alias("logo"))


@query("last_night_team_board")
def q_last_night_team_board(spark, sf_dir):
    fx = fixture(spark, sf_dir)
    return T.last_night_team_board(_log(fx), _logos(fx))


@query("opponent_shooting_ranks")
def q_opponent_shooting_ranks(spark, sf_dir):
    return T.opponent_shooting_ranks(_log(fixture(spark, sf_dir)))


@query("rest_day_outcomes")
def q_rest_day_outcomes(spark, sf_dir):
    return T.rest_day_outcomes(_log(fixture(spark, sf_dir)))


@query("team_points_history")
def q_team_points_history(spark, sf_dir):
    return T.team_points_history(_log(fixture(spark, sf_dir)))


# ------------------------------------------------------------------ M4 schedule, odds, ratings

from pyspark.sql import functions as F  # noqa: E402

from courtside.plans import schedule as S  # noqa: E402
from courtside.sources import pages as PG  # noqa: E402

AS_OF = "2001-07-15"        # 'today' of the schedule fixtures (114 games left at sf0.01)
ODDS_SINCE = "2001-06-01"   # first date of the odds fixtures


def _schedule_text(fx: Fixture) -> DataFrame:
    """The schedule as the source stores it: weekday-prefixed date text."""
    return fx.v_schedule.withColumn("date_text", F.date_format("game_ts", "EEE, MMM d, yyyy"))


def _sched(fx: Fixture) -> DataFrame:
    return _once(fx, "schedule", lambda: S.normalise_schedule(_schedule_text(fx), AS_OF))


def _ranks(fx: Fixture) -> DataFrame:
    return T.team_rank(_record(fx))


def _bins(fx: Fixture) -> DataFrame:
    return S.future_opponent_bins(S.schedule_pairs(_sched(fx)), _ranks(fx))


def _upcoming(fx: Fixture) -> DataFrame:
    return S.upcoming_schedule(_sched(fx), _ranks(fx), fx.v_odds, fx.v_teams, AS_OF)


def _ratings(fx: Fixture) -> DataFrame:
    return S.clean_team_ratings(fx.v_team_ratings, fx.v_teams)


@query("normalise_schedule")
def q_normalise_schedule(spark, sf_dir):
    return _sched(fixture(spark, sf_dir))


@query("schedule_pairs")
def q_schedule_pairs(spark, sf_dir):
    return S.schedule_pairs(_sched(fixture(spark, sf_dir)))


@query("future_opponent_bins")
def q_future_opponent_bins(spark, sf_dir):
    return _bins(fixture(spark, sf_dir))


@query("schedule_difficulty")
def q_schedule_difficulty(spark, sf_dir):
    fx = fixture(spark, sf_dir)
    return S.schedule_difficulty(S.schedule_pairs(_sched(fx)), _ranks(fx), _bins(fx))


@query("upcoming_schedule")
def q_upcoming_schedule(spark, sf_dir):
    return _upcoming(fixture(spark, sf_dir))


@query("next_gameday")
def q_next_gameday(spark, sf_dir):
    return S.next_gameday(_upcoming(fixture(spark, sf_dir)))


@query("league_kpis")
def q_league_kpis(spark, sf_dir):
    fx = fixture(spark, sf_dir)
    return S.league_kpis(S.next_gameday(_upcoming(fx)), T.home_road_split(_log(fx)),
                         T.league_scoring_average(_log(fx)))


@query("over_under_tracker")
def q_over_under_tracker(spark, sf_dir):
    fx = fixture(spark, sf_dir)
    return S.over_under_tracker(fx.v_over_under, _record(fx), fx.v_teams, _bins(fx))


@query("enrich_odds")
def q_enrich_odds(spark, sf_dir):
    fx = fixture(spark, sf_dir)
    return S.enrich_odds(fx.v_odds, _log(fx), ODDS_SINCE)


@query("clean_team_ratings")
def q_clean_team_ratings(spark, sf_dir):
    return _ratings(fixture(spark, sf_dir))


@query("rating_ranks")
def q_rating_ranks(spark, sf_dir):
    return S.rating_ranks(_ratings(fixture(spark, sf_dir)))


@query("team_logo_lookup")
def q_team_logo_lookup(spark, sf_dir):
    fx = fixture(spark, sf_dir)
    return S.team_logo_lookup(T.team_dimension(fx.v_teams), _logos(fx))


@query("comment_blocks")
def q_comment_blocks(spark, sf_dir):
    return PG.comment_blocks(fixture(spark, sf_dir).table("pages"))


@query("extract_list_items")
def q_extract_list_items(spark, sf_dir):
    return PG.extract_list_items(fixture(spark, sf_dir).table("pages"))


# ------------------------------------------------------------------ M5 play by play

from courtside.plans import plays as PL  # noqa: E402


def _timeline(fx: Fixture) -> DataFrame:
    return _once(fx, "timeline", lambda: _kept(fx, "play_timeline", PL.play_timeline(fx.v_play_by_play), ("events",)))


def _runs(fx: Fixture) -> DataFrame:
    return PL.scoring_runs(_timeline(fx))


@query("play_timeline")
def q_play_timeline(spark, sf_dir):
    return _timeline(fixture(spark, sf_dir))


@query("scoring_runs")
def q_scoring_runs(spark, sf_dir):
    return _runs(fixture(spark, sf_dir))


@query("lead_state")
def q_lead_state(spark, sf_dir):
    fx = fixture(spark, sf_dir)
    names = fx.v_teams.select("team", "full_name")
    sides = fx.v_plays.select("game_id", "home_team", "visitor_team").distinct()
    titles = (sides.join(names.toDF("home_team", "h"), "home_team", "left").join(names.toDF("visitor_team", "a"), "visitor_team", "left")
              .select("game_id", F.concat("h", F.lit(" Vs. "), "a").alias("title")))
    colors = fx.v_teams.select("team", F.concat(F.lit("#"), F.lpad(F.hex(F.col("team") * 9677), 6, "0")).alias("color"))
    return PL.lead_state(_runs(fx), PL.final_outcomes(_timeline(fx)), titles, colors)


@query("game_axis")
def q_game_axis(spark, sf_dir):
    return PL.game_axis(_timeline(fixture(spark, sf_dir)))


@query("foul_calls")
def q_foul_calls(spark, sf_dir):
    return PL.foul_calls(fixture(spark, sf_dir).v_foul_text)


@query("game_titles")
def q_game_titles(spark, sf_dir):
    fx = fixture(spark, sf_dir)
    return PL.game_titles(_log(fx), fx.v_teams)


# ------------------------------------------------------------------ M6 catalogue, slices, snapshot

import datetime as dt  # noqa: E402
import hashlib  # noqa: E402
import uuid  # noqa: E402

from courtside.operators.core import filter_having, slice_by  # noqa: E402
from courtside.plans import catalogue as C  # noqa: E402
from courtside.session import checkpoint_root  # noqa: E402
from courtside.sources import snapshot as SN  # noqa: E402

STUDIO_PATTERN = "ECONOMY|PROMO"   # album types standing in for live / concert releases
ARTIST_TEXT = "blue"


def _studio(fx: Fixture) -> DataFrame:
    return C.studio_tracks(fx.v_tracks, STUDIO_PATTERN)


@query("studio_tracks")
def q_studio_tracks(spark, sf_dir):
    return _studio(fixture(spark, sf_dir))


@query("song_count")
def q_song_count(spark, sf_dir):
    return C.song_count(fixture(spark, sf_dir).v_tracks)


@query("album_count")
def q_album_count(spark, sf_dir):
    return C.album_count(fixture(spark, sf_dir).v_tracks)


@query("artist_statistics")
def q_artist_statistics(spark, sf_dir):
    return C.artist_statistics(_studio(fixture(spark, sf_dir)))


@query("album_timeline")
def q_album_timeline(spark, sf_dir):
    return C.album_timeline(fixture(spark, sf_dir).v_tracks)


@query("artist_search")
def q_artist_search(spark, sf_dir):
    fx = fixture(spark, sf_dir)
    url = [F.concat(F.lit(f"img/{size}/"), F.col("artist_id").cast("string")) for size in (640, 320)]
    both = F.array(*[F.struct(u.alias("url")) for u in url])
    images = F.when(F.col("artist_id") % 3 == 0, F.slice(both, 1, 1)).otherwise(both)
    return C.artist_search(fx.v_artists.withColumn("images", images), ARTIST_TEXT)


@query("mood_quadrants")
def q_mood_quadrants(spark, sf_dir):
    return C.mood_quadrants(fixture(spark, sf_dir).v_tracks)


@query("slice_team_margins")
def q_slice_team_margins(spark, sf_dir):
    return slice_by(_margins(fixture(spark, sf_dir)), "team", 7)


@query("slice_documents_contains")
def q_slice_documents_contains(spark, sf_dir):
    docs = fixture(spark, sf_dir).table("documents")
    return slice_by(docs, "text", "License", contains=True).select("doc_id", "lang", "source", "n_chars")


@query("slice_documents_not_contains")
def q_slice_documents_not_contains(spark, sf_dir):
    docs = fixture(spark, sf_dir).table("documents")
    return (slice_by(docs, "text", "License", contains=True, negate=True)
            .select("doc_id", "lang", "source", "n_chars"))


@query("slice_injuries_team")
def q_slice_injuries_team(spark, sf_dir):
    """Injuries lie by team: the join with the one named team prunes the rest."""
    fx = fixture(spark, sf_dir)
    injuries = _kept(fx, "injuries", fx.v_injuries, ("customer",), partition_by=["team"])
    return slice_by(T.injuries_by_team(injuries, fx.v_teams), "full_name", "NATION_11")


@query("refresh_snapshot")
def q_refresh_snapshot(spark, sf_dir):
    fx = fixture(spark, sf_dir)
    key = hashlib.sha1(fx.sf_dir.encode()).hexdigest()[:12]
    path = f"{checkpoint_root(spark)}/snapshots/injuries-{key}"
    return SN.refresh_snapshot(spark, lambda: fx.v_injuries, path, max_age_hours=8)


# the choices of the source's screens, each a slice of a pipeline
TEAM = 7


@query("slice_team_record")
def q_slice_team_record(spark, sf_dir):
    return slice_by(_record(fixture(spark, sf_dir)), "team", TEAM)


@query("slice_team_scorers")
def q_slice_team_scorers(spark, sf_dir):
    return slice_by(_team_scorers(fixture(spark, sf_dir)), "team", TEAM)


@query("slice_team_ratings")
def q_slice_team_ratings(spark, sf_dir):
    return slice_by(S.rating_ranks(_ratings(fixture(spark, sf_dir))), "team", TEAM)


@query("slice_team_opponent_shooting")
def q_slice_team_opponent_shooting(spark, sf_dir):
    return slice_by(T.opponent_shooting_ranks(_log(fixture(spark, sf_dir))), "team", TEAM)


@query("slice_game_title")
def q_slice_game_title(spark, sf_dir):
    fx = fixture(spark, sf_dir)
    return slice_by(PL.game_titles(_log(fx), fx.v_teams), "title", "NATION_7 Vs. NATION_9")


@query("contract_value_missing_players")
def q_contract_value_missing_players(spark, sf_dir):
    fx = fixture(spark, sf_dir)
    return P.contract_value_missing_players(_contracts(fx), P.player_games_played(_log(fx)))


def _contract_sheet(fx: Fixture) -> DataFrame:
    return P.clean_contracts(fx.v_contract_sheet, name_col="name", total_col="total_text", team_recodes=P.TEAM_CODE_RECODES)


@query("clean_contract_sheet")
def q_clean_contract_sheet(spark, sf_dir):
    """(P03) header rows, accents, name aliases, team codes, money text."""
    return _contract_sheet(fixture(spark, sf_dir))


@query("contract_team_logos")
def q_contract_team_logos(spark, sf_dir):
    """(P42b) the literal logo map over the sheet's team codes."""
    return S.team_logo_lookup(_contract_sheet(fixture(spark, sf_dir)).select("team").distinct())


@query("contracts_csv")
def q_contracts_csv(spark, sf_dir):
    """(O01, O02) the contract sheet written as CSV and read with its schema."""
    path = f"{checkpoint_root(spark)}/contracts-{uuid.uuid4().hex}"
    SN.write_table(fixture(spark, sf_dir).v_contract_sheet, path, fmt="csv")
    return SN.read_csv_table(spark, path, "name string, team string, salary_text string, total_text string")


@query("frequent_winners")
def q_frequent_winners(spark, sf_dir):
    """(O11) games of teams with more wins than losses: a condition on the group."""
    games = _log(fixture(spark, sf_dir)).select("team", "game_id", "outcome").distinct()
    sums = {"w": F.count_if(F.col("outcome") == "W"), "l": F.count_if(F.col("outcome") == "L")}
    return filter_having(games, "team", sums, F.col("w") > F.col("l"))


@query("team_scorers_min_games")
def q_team_scorers_min_games(spark, sf_dir):
    """(P20b) the scorer table with players under 5 games dropped first."""
    fx = fixture(spark, sf_dir)
    return P.team_scorers(_enriched(fx), _record(fx), fx.v_teams, _scorers(fx), min_games=5)


@query("page_ratings")
def q_page_ratings(spark, sf_dir):
    """(O04, P06) from stored pages to ratings, through the tables in their comments."""
    fx = fixture(spark, sf_dir)
    return S.ratings_from_pages(fx.v_rating_pages, fx.v_teams)


def _schedule_pages(fx: Fixture) -> DataFrame:
    """A page a day: the day's games in a table whose date spans their rows."""
    cells = [F.concat(F.lit("<td>"), x, F.lit("</td>")) for x in (
        F.col("game_id").cast("string"), F.col("start_text"), F.concat(F.lit("<a href='/t'>"), F.col("visitor").cast("string"), F.lit("</a>")),
        F.lit(""), F.col("home").cast("string"))]
    days = (_schedule_text(fx).groupBy("date_text", F.to_date("game_ts").alias("day"))
            .agg(F.sort_array(F.collect_list(F.struct("game_id", F.concat(*cells).alias("row")))).alias("games")))
    date = F.concat(F.lit("<th rowspan='"), F.size("games").cast("string"), F.lit("'>"), F.col("date_text"), F.lit("</th>"))
    rows = F.transform("games", lambda g, i: F.concat(F.lit("<tr>"), F.when(i == 0, date).otherwise(F.lit("")), g["row"], F.lit("</tr>\n")))
    head = F.lit("<TABLE class=t><tr><th>Date</th><th>Game</th><th>Start (ET)</th><th>Visitor/Neutral</th><th>PTS</th><th>Home/Neutral</th></tr>")
    return days.select(F.unix_date("day").alias("page_id"), F.concat(head, F.array_join(rows, ""), F.lit("</TABLE>")).alias("html"))


@query("page_schedule")
def q_page_schedule(spark, sf_dir):
    """(P05) from stored schedule pages to the numbered schedule."""
    return S.schedule_from_pages(_schedule_pages(fixture(spark, sf_dir)), AS_OF)


@query("payroll_text")
def q_payroll_text(spark, sf_dir):
    return P.payroll_text(_contract_sheet(fixture(spark, sf_dir)))


from courtside.operators import sketches as SK  # noqa: E402


@query("song_count_sketched")
def q_song_count_sketched(spark, sf_dir):
    """(O24) distinct songs per artist from stored sketches of each release day."""
    fx = fixture(spark, sf_dir)
    daily = SK.daily_sketches(fx.v_tracks, ["artist"], "release_date", "track")
    kept = _kept(fx, "song_sketches", daily, ("lineitem", "part"), partition_by=["year"])
    return SK.distinct_estimate(kept, ["artist"], "songs")


from courtside.sources import keyed as KE  # noqa: E402


@query("injury_changes")
def q_injury_changes(spark, sf_dir):
    """(O49) the injury list refreshed twice, the second time without the injuries
    of team 3, with those of team 5 described anew and those of team 7 added:
    what changed, from the stored delta."""
    injuries = fixture(spark, sf_dir).v_injuries
    path = f"{checkpoint_root(spark)}/keyed/injuries-{uuid.uuid4().hex}"
    day = dt.datetime(2021, 1, 1, tzinfo=dt.timezone.utc)
    KE.refresh_keyed(spark, injuries.where("team <> 7"), path, ["injury_id"], now=day)
    described = F.when(F.col("team") == 5, F.concat("description", F.lit(" (day to day)"))).otherwise(F.col("description"))
    KE.refresh_keyed(spark, injuries.where("team <> 3").withColumn("description", described), path, ["injury_id"], now=day + dt.timedelta(days=1))
    return KE.changes_since(spark, path, 1).drop("version")
