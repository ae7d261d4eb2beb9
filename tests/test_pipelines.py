"""Pipeline invariants (from the source's own definitions) on the sf0.001
fixtures, hand-written edge cases, plan-choice equivalence and determinism."""

import datetime as dt
import re

from pyspark.sql import functions as F

from courtside.plans import catalogue as C
from courtside.plans import players as P
from courtside.plans import plays as PL
from courtside.plans import schedule as S
from courtside.plans import teams as T
from tests.conftest import rows


def test_each_game_one_win_one_loss(fx):
    tg = T.team_games(fx.v_box_scores, ["pts"])
    per_game = tg.groupBy("game_id").agg(F.count_if(F.col("outcome") == "W").alias("w"),
                                         F.count_if(F.col("outcome") == "L").alias("l"))
    # a game known from one side has that side's result only
    sides = F.col("w") + F.col("l")
    assert per_game.where((sides == 2) & (F.col("w") != 1)).count() == 0
    assert per_game.where(~sides.isin(1, 2)).count() == 0
    assert per_game.where(sides == 1).count() > 0


def test_margins_sum_to_zero_and_records_add_up(fx):
    m = T.margin_of_victory(fx.v_box_scores)
    assert m.groupBy("game_id").agg(F.sum("margin").alias("s")).where(F.col("s") != 0).count() == 0
    last = m.groupBy("team").agg(F.max_by("record", F.struct("game_date", "game_id")).alias("r"),
                                 F.count_if(F.col("margin") > 0).alias("w"),
                                 F.count_if(F.col("margin") < 0).alias("l"))
    for r in last.collect():
        assert r["r"] == f"{r['w']}-{r['l']}"


def test_record_totals(fx):
    rec = T.team_record(fx.v_box_scores, fx.v_injuries, fx.v_teams)
    reg = (fx.v_box_scores.where(F.col("season_type") == T.REGULAR).select("team", "game_id").distinct()
           .groupBy("team").count())
    joined = rec.join(reg, "team")
    assert joined.where(F.col("wins") + F.col("losses") != F.col("count")).count() == 0
    streak_vs_games = rec.join(T.team_games_played(fx.v_box_scores), "team")
    assert streak_vs_games.where(F.col("win_streak") > F.col("team_gp")).count() == 0
    assert rec.where(F.col("projected_wins") + F.col("projected_losses") != 72).count() == 0


def test_shares_sum_to_one(fx):
    m = T.margin_of_victory(fx.v_box_scores)
    assert abs(T.game_type_distribution(m).agg(F.sum("share")).first()[0] - 1) < 1e-9
    cv = P.contract_value(P.enriched_game_log(fx.v_box_scores, P.clean_contracts(fx.v_contracts), fx.v_teams),
                          P.player_latest_team(fx.v_box_scores))
    s = P.contract_band_summary(cv).agg(F.sum("share")).first()[0]
    assert abs(s - 1) < 0.01


def test_contract_value_identity(fx):
    cvm = P.contract_value_missing(P.clean_contracts(fx.v_contracts), P.player_games_played(fx.v_box_scores),
                                   T.team_record(fx.v_box_scores, fx.v_injuries, fx.v_teams))
    bad = cvm.where(F.abs(F.col("achieved") + F.col("missing") - F.col("max_value")) > 1e-6)
    assert bad.count() == 0


def test_schedule_pairs_twice_games(fx):
    sched = fx.v_schedule.withColumn("date_text", F.date_format("game_ts", "EEE, MMM d, yyyy"))
    norm = S.normalise_schedule(sched, "2001-07-15")
    assert S.schedule_pairs(norm).count() == 2 * norm.count()
    nums = [r[0] for r in norm.select("game_no").collect()]
    assert sorted(nums) == list(range(1, len(nums) + 1))


def test_run_points_per_island(fx):
    runs = PL.scoring_runs(PL.play_timeline(fx.v_play_by_play))
    per = runs.groupBy("game_id", "run_id").agg(F.max("run_points").alias("m"),
                                                F.sum(F.abs("score_change")).alias("s"),
                                                F.max("run_pos").alias("p"), F.count(F.lit(1)).alias("n"))
    assert per.where((F.col("m") != F.col("s")) | (F.col("p") != F.col("n"))).count() == 0


def test_chunked_plans_equal_windowed(fx):
    plays = fx.v_play_by_play
    cols = ["game_id", "event_play", "score_change", "sign", "run_id", "run_pos", "run_points"]
    whole = PL.scoring_runs(PL.play_timeline(plays, chunk=F.lit(0)))
    for chunk in (F.date_trunc("day", "ts"), F.date_trunc("minute", "ts"), F.col("ts")):
        assert rows(PL.scoring_runs(PL.play_timeline(plays, chunk=chunk)), *cols) == rows(whole, *cols)
    m_plain = T.margin_of_victory(fx.v_box_scores, chunk_running=False)
    m_chunk = T.margin_of_victory(fx.v_box_scores, chunk_running=True)
    assert rows(m_plain) == rows(m_chunk)


def test_scoring_runs_by_hand(spark):
    """Random games against a plain scan, for chunks of one play up to all."""
    import random
    rng = random.Random(4)
    data = []
    for game in range(6):
        margin = 0
        for k in range(rng.choice([1, 2, 3, 60, 90])):
            margin += rng.choice([-3, -2, 0, 0, 1, 2, 3]) * (k % 20 < 12)
            data.append((game, 3 * k + game, margin))
    want = []
    for game in sorted({g for g, _, _ in data}):
        before = sign_before = None
        run = pos = points = 0
        for _, k, margin in sorted(d for d in data if d[0] == game):
            change = margin - (before or 0)
            sign = 1 if change > 0 else -1
            if sign_before is not None and sign != sign_before:
                run, pos, points = run + 1, 0, 0
            pos, points, before, sign_before = pos + 1, points + abs(change), margin, sign
            want.append((game, k, change, sign, run, pos, points))
    for size in (1, 2, 3, 7, 10 ** 6):
        df = spark.createDataFrame([(g, k, m, k // (3 * size)) for g, k, m in data], "game_id long, event_play long, margin long, minute long")
        got = PL.scoring_runs(df)
        assert rows(got, "game_id", "event_play", "score_change", "sign", "run_id", "run_pos", "run_points") == sorted(want, key=repr)


def test_scoring_runs_plan(fx):
    """Two window specs: over a chunk's rows and over a game's chunks. Rows are
    shuffled by chunk; what is shuffled by game is a row a chunk."""
    import re
    t = fx.spark.createDataFrame([(1, 1, 2, 0)], "game_id long, event_play long, margin long, minute long")
    plan = PL.scoring_runs(t)._jdf.queryExecution().executedPlan().toString()
    specs = {re.sub(r"#\d+L?", "", line.split("], [", 1)[1]) for line in plan.splitlines() if "Window [" in line}
    assert specs == {"game_id, minute], [event_play ASC NULLS FIRST]", "game_id], [minute ASC NULLS FIRST]"}
    moved = [re.sub(r"#\d+L?", "", x) for x in re.findall(r"Exchange hashpartitioning\(([^)]*), \d+\)", plan)]
    assert sorted(moved) == ["game_id", "game_id, minute", "game_id, minute", "game_id, minute"]


def test_deterministic_under_repartition(fx):
    logs = fx.v_box_scores
    shuffled = logs.repartition(7, F.rand(seed=3))
    for fn in (lambda x: T.margin_of_victory(x), lambda x: T.win_streak(x),
               lambda x: T.last_n_record(x, fx.v_teams)):
        assert rows(fn(logs)) == rows(fn(shuffled))
    plays = fx.v_play_by_play.repartition(5, F.rand(seed=5))
    assert rows(PL.scoring_runs(PL.play_timeline(plays))) == rows(
        PL.scoring_runs(PL.play_timeline(fx.v_play_by_play)))


def test_hand_written_edge_cases(spark):
    # two games on one date, a player with two salaries, zero attempts, ties
    logs = spark.createDataFrame([
        (1, dt.date(2021, 1, 1), 1, 2, "H", 11, "Regular Season", "W", 20, 0, 0, 1, 1, 1, 1, 1, 1, 1, 5),
        (1, dt.date(2021, 1, 1), 2, 1, "A", 21, "Regular Season", "L", 15, 10, 2, 0, 0, 2, 2, 2, 0, 1, -5),
        (2, dt.date(2021, 1, 1), 1, 3, "A", 11, "Regular Season", "L", 10, 8, 1, 0, 0, 2, 2, 2, 0, 1, -10),
        (2, dt.date(2021, 1, 1), 3, 1, "H", 31, "Regular Season", "W", 20, 9, 1, 0, 0, 2, 2, 2, 0, 1, 10),
    ], "game_id long, game_date date, team long, opponent long, location string, player_id long, "
       "season_type string, outcome string, pts long, fga long, fta long, stl long, blk long, trb long, "
       "ast long, tov long, fg3m long, fg3a long, plus_minus long")
    contracts = spark.createDataFrame([(11, 1, "$1,000,000"), (11, 1, "$2,000,000"), (21, 2, None)],
                                      "player_id long, team long, salary_text string")
    teams = spark.createDataFrame([(1, "One", "E"), (2, "Two", "E"), (3, "Three", "W")],
                                  "team long, full_name string, conference string")
    enr = P.enriched_game_log(logs, P.clean_contracts(contracts), teams)
    assert enr.count() == 4  # two salaries did not fan out
    assert enr.where((F.col("player_id") == 11)).select("salary").distinct().first()[0] == 2_000_000
    assert enr.where((F.col("player_id") == 11) & (F.col("game_id") == 1)).first()["game_ts"] is None
    last = T.last_n_record(logs, teams, n=1)  # both games share the last date: both kept
    assert rows(last.where(F.col("team") == 1), "last_n") == [("1-1",)]
    empty = logs.limit(0)
    assert T.team_record(empty, spark.createDataFrame([], "team long"), teams).count() == 0
    assert T.margin_of_victory(empty).count() == 0


def test_catalogue_and_search(spark):
    tracks = spark.createDataFrame([
        ("A", "Live In Paris", "t1", dt.date(2020, 1, 1), 0.9, 0.9),
        ("A", "Studio", "t1", dt.date(2019, 1, 1), 0.6, 0.4),
        ("A", "Studio", "t2", dt.date(2019, 1, 1), 0.2, 0.7),
        ("B", "Other", "t3", dt.date(2018, 1, 1), 0.1, 0.1)],
        "artist string, album string, track string, release_date date, valence double, energy double")
    studio = C.studio_tracks(tracks)
    assert studio.count() == 3
    stats = dict((r["artist"], (r["positivity"], r["songs"], r["albums"])) for r in
                 C.artist_statistics(studio).collect())
    assert stats == {"A": (40.0, 2, 1), "B": (10.0, 1, 1)}
    quads = rows(C.mood_quadrants(studio), "artist", "quadrant", "n")
    assert quads == [("A", "Aggressive / Fast Paced", 1), ("A", "Mellow / Peaceful", 1), ("B", "Sad / Slow", 1)]
    artists = spark.createDataFrame([(1, "Blue Band", 50), (2, "Blue Band", 70), (3, "blue", 70), (4, "Red", 90)],
                                    "artist_id long, artist_name string, popularity int")
    assert rows(C.artist_search(artists, "BLUE")) == [(2, "Blue Band", 70), (3, "blue", 70)]
    with_images = artists.withColumn("images", F.when(F.col("artist_id") != 3, F.array(F.struct(F.lit("u1").alias("url")), F.struct(F.lit("u2").alias("url")))))
    assert rows(C.artist_search(with_images, "BLUE")) == [(2, "Blue Band", 70, "u2"), (3, "blue", 70, None)]


def test_foul_text_parsing(spark):
    plays = spark.createDataFrame([
        (1, 1, "Smith PERSONAL TAKE.FOUL (P1.T2) (J.Doe)", None),
        (1, 2, None, "Jones S.FOUL (P2.T1) (A.Ref)"),
        (1, 3, "Brown Jr. L.B.FOUL (P1.T1) (B.Ref)", None),
        (1, 4, "Green Offensive Foul Turnover (P1.T3) (C.Ref)", None),
        (1, 5, "White FLAGRANT.FOUL.TYPE1 (P1.T1) (D.Ref)", None),
        (1, 6, "Black Jump Shot", None)],
        "game_id long, event_id long, desc_home string, desc_visitor string")
    got = rows(PL.foul_calls(plays), "event_id", "referee", "foul_type")
    assert got == [(1, "J.Doe", "PERSONAL.FOUL"), (2, "A.Ref", "S.FOUL"), (3, "B.Ref", "L.B.FOUL")]


def test_lead_state_labels(spark):
    runs = spark.createDataFrame([
        (1, "Home", 1, "11:30", 10, 8), (1, "Away", 5, "04:00", 100, 100), (1, "Away", 7, "01:30", 99, 101)],
        "game_id long, location string, period long, clock string, score_home long, score_away long")
    out = rows(PL.lead_state(runs), "period", "period_label", "state", "minutes", "game_axis")
    assert out == [(1, "1st", "Leading", 11.5, 47.5), (5, "1st OT", "Tied", 4.0, -1.0),
                   (7, "3rd OT", "Leading", 1.5, -13.5)]


def test_contract_cleaning_paths(spark):
    raw = spark.createDataFrame([
        ("Player", "Tm", "Salary", "Total"),
        ("Luka Dončić", "DAL", "$8,049,360", ""),
        ("J.J. Redick", "BRK", "$13,013,700", "$26,027,400"),
        ("Someone", "PHO", "junk", "$1,000")],
        "name string, team string, salary_text string, total_text string")
    out = rows(P.clean_contracts(raw, name_col="name", total_col="total_text",
                                 team_recodes=P.TEAM_CODE_RECODES))
    assert out == [("JJ Redick", "BKN", 13013700.0, 26027400.0), ("Luka Doncic", "DAL", 8049360.0, 0.0),
                   ("Someone", "PHX", None, 1000.0)]


def test_logo_lookup_and_lead_state_joins(spark):
    df = spark.createDataFrame([("LAL",), ("XYZ",)], "team string")
    assert rows(S.team_logo_lookup(df)) == [("LAL", "logos/lal2.png"), ("XYZ", None)]
    runs = spark.createDataFrame([(1, "LAL", "Home", 1, "10:00", 2, 0)],
                                 "game_id long, team string, location string, period long, clock string, "
                                 "score_home long, score_away long")
    outcomes = spark.createDataFrame([(1, "LAL", "W"), (1, "LAL", "W")], "game_id long, team string, outcome string")
    titles = spark.createDataFrame([(1, "A Vs. B")], "game_id long, title string")
    colors = spark.createDataFrame([("LAL", "#552583")], "team string, primary_color string")
    out = PL.lead_state(runs, outcomes, titles, colors)
    assert rows(out, "outcome", "title", "primary_color", "state") == [("W", "A Vs. B", "#552583", "Leading")]


def test_timeline_to_lead_state(spark):
    """A game by hand: scoring, an event without text, a tie in time, a lone play."""
    plays = spark.createDataFrame([
        (1, 1, "2020-01-01 10:00:01", "A scores", None, 2, 0), (1, 2, "2020-01-01 10:00:01", None, "B scores", 2, 3),
        (1, 3, "2020-01-01 10:05:00", "A scores", None, 4, 3), (1, 4, "2020-01-01 10:05:30", None, None, 4, 3),
        (1, 5, "2020-01-01 11:00:00", "A scores", None, 7, 3), (2, 6, "2020-01-01 10:00:00", None, "lone", 0, 0)],
        "game_id long, event_id long, ts string, desc_home string, desc_visitor string, score_home long, score_away long"
    ).selectExpr("*", "'H' as home_team", "'V' as visitor_team", "1L as period", "'10:30' as clock").withColumn("ts", F.to_timestamp("ts"))
    t = PL.play_timeline(plays)
    runs = PL.scoring_runs(t)
    assert rows(runs, "event_id", "team", "margin", "score_change", "sign", "run_id", "run_pos", "run_points") == [
        (1, "H", 2, 2, 1, 0, 1, 2), (2, "V", -1, -3, -1, 1, 1, 3), (3, "H", 1, 2, 1, 2, 1, 2), (5, "H", 4, 3, 1, 2, 2, 5), (6, "V", 0, 0, -1, 0, 1, 0)]
    out = PL.lead_state(runs, PL.final_outcomes(t))
    assert rows(out, "event_id", "state", "outcome") == [
        (1, "Leading", "W"), (2, "Leading", "L"), (3, "Leading", "W"), (5, "Leading", "W"), (6, "Tied", None)]


def test_upcoming_labels(spark):
    sched = spark.createDataFrame([(i, i, "2020-01-0%d" % d, "Wed", 60, 1, 2, "Vs") for i, d in ((1, 1), (2, 1), (3, 1), (4, 2))],
                                  "game_no long, game_id long, game_date string, day_of_week string, start_minute int, visitor long, home long, vs string"
                                  ).withColumn("game_date", F.to_date("game_date"))
    ranks = spark.createDataFrame([(1, 4), (2, 7)], "team long, rank long")
    teams = spark.createDataFrame([(1, "One"), (2, "Two")], "team long, full_name string")
    odds = spark.createDataFrame([(1, "-150", "+130"), (1, "-150", "+130"), (2, "-", "+105"), (4, "-110", "+100")],
                                 "game_id long, team1_moneyline string, team2_moneyline string").withColumn("game_date", F.to_date(F.lit("2020-01-01")))
    out = S.upcoming_schedule(sched, ranks, odds, teams, "2020-01-01")
    assert rows(out, "game_id", "road_label", "home_label", "favored", "avg_rank")[:3] == [
        (1, "One (-150)", "Two (+130)", "One", 5.5), (2, "One (+100)", "Two (+105)", "One", 5.5), (3, "One", "Two", None, 5.5)]
    assert rows(S.next_gameday(out), "games") == [(3,)]


def test_scorer_team_is_the_latest_of_any_season(spark):
    log = spark.createDataFrame([(1, 10, 1, "2020-01-01", "Regular Season", 30), (1, 11, 2, "2020-02-01", "Playoffs", 1)],
                                "player_id long, team long, game_id long, game_date string, season_type string, pts long"
                                ).selectExpr("*", "0.5 as season_ts", "1.0 as value_adj", "2L as gp")
    record = spark.createDataFrame([(11, 5, 6)], "team long, wins long, losses long")
    assert rows(P.efficient_scorers(log, record), "player_id", "team", "avg_pts", "wins", "rank") == [(1, 11, 30.0, 5, 1)]


def test_schedule_text_parsing_with_scores(spark):
    sched = spark.createDataFrame([
        (1, "Tue, Dec 22, 2020", "7:00p", 10, 11, None),
        (2, "Wed, Dec 23, 2020", "12:30p", 12, 13, None),
        (3, "Mon, Dec 21, 2020", "8:00p", 10, 12, 101)],
        "game_id long, date_text string, start_text string, visitor long, home long, visitor_pts long")
    out = rows(S.normalise_schedule(sched, "2020-12-22", score_col="visitor_pts"),
               "game_no", "game_id", "day_of_week", "start_minute", "vs")
    assert out == [(1, 1, "Tuesday", 1140, "Vs"), (2, 2, "Wednesday", 750, "Vs")]


def test_box_scores_are_dealt_by_their_number(spark, fx, monkeypatch):
    """A task's share of the box scores doesn't grow with the line items: both
    sides of their join are dealt over as many tasks as the rows ask for, the
    aggregate and windows stay on that dealing, and the rows are the same."""
    from courtside.sources import fixtures
    lines = fx.table("lineitem").count()
    monkeypatch.setattr(fixtures, "TASK_ROWS", 500)
    dealt = fixtures.Fixture(spark, fx.sf_dir)
    plan = dealt.v_box_scores._jdf.queryExecution().executedPlan().toString()
    n = -(-lines // 500)
    assert n > 4 and len(re.findall(rf"hashpartitioning\(\w+#\d+L?, {n}\)", plan)) == 2
    assert "hashpartitioning" not in plan.split("SortMergeJoin")[0]
    assert rows(dealt.v_box_scores) == rows(fx.v_box_scores)
    assert "Exchange" not in spark.table("lineitem")._jdf.queryExecution().executedPlan().toString()


# the queries whose tasks' memory grew with the line items (F3-F20 of round 3)
OF_BOX_SCORES = (
    "contract_band_summary", "contract_value", "contract_value_missing", "contract_value_missing_players", "day_results",
    "day_summary", "efficient_scorers", "enrich_odds", "enriched_game_log", "frequent_winners", "future_opponent_bins",
    "game_titles", "game_type_distribution", "home_road_records", "home_road_split", "last_n_record",
    "last_night_team_board", "latest_slice")


def test_queries_of_box_scores_store_the_dealt_rows(spark, fx, monkeypatch):
    """Each query's stored box scores are made on the dealing by game, with as many
    tasks as the line items ask for, whatever the shuffle partitions."""
    from courtside import queries as Q
    from courtside.sources import fixtures
    n, kept = -(-fx.table("lineitem").count() // 500), {}
    monkeypatch.setattr(fixtures, "TASK_ROWS", 500)
    monkeypatch.setattr(Q, "_kept", lambda fx, name, df, *args, **kwargs: kept.setdefault(name, df))
    for name in OF_BOX_SCORES:
        kept.clear()
        Q.QUERIES[name](spark, fx.sf_dir)
        plan = kept["box_scores"]._jdf.queryExecution().executedPlan().toString()
        assert len(re.findall(rf"hashpartitioning\(\w+#\d+L?, {n}\)", plan)) == 2, name
        assert "hashpartitioning" not in plan.split("SortMergeJoin")[0], name
