"""DuckDB oracle SQL for every registered query.

Each oracle is one self-contained statement over the base tables: the fixture
views and shared intermediates are CTE fragments, pulled in (with their
dependencies, in order) by ``compose``. Where the Spark side rounds with
``F.round`` (half-up on the double's decimal text), the oracle rounds the
same text through DECIMAL, which DuckDB rounds the same way.
"""

from __future__ import annotations

from courtside.sources.fixtures import VIEW_DEPS, VIEWS


def R(x: str, d: int) -> str:
    """Rounding as Spark's round(double, d) does it: half-up on the double's
    shortest decimal text (49.349999999999994 -> 49.3, 0.285 -> 0.29).
    Values too large for the decimal fall back to DuckDB's own round."""
    return (f"COALESCE(CAST(round(TRY_CAST(CAST(({x}) AS VARCHAR) AS DECIMAL(38,17)), {d}) AS DOUBLE), "
            f"round(({x}), {d}))")


def ORD(x: str) -> str:
    """Ordinal text: 1st 2nd 3rd 4th 11th 12th 13th 21st 111th."""
    return (f"CASE WHEN ({x}) IS NULL THEN NULL ELSE CAST(({x}) AS VARCHAR) || "
            f"CASE WHEN abs({x}) % 100 BETWEEN 11 AND 13 THEN 'th' "
            f"WHEN abs({x}) % 10 = 1 THEN 'st' WHEN abs({x}) % 10 = 2 THEN 'nd' "
            f"WHEN abs({x}) % 10 = 3 THEN 'rd' ELSE 'th' END END")


def NUM(x: str) -> str:
    """A double as text, whole numbers without their '.0'."""
    return f"CASE WHEN ({x}) = floor({x}) THEN CAST(CAST(({x}) AS BIGINT) AS VARCHAR) ELSE CAST(({x}) AS VARCHAR) END"


def DIV(a: str, b: str) -> str:
    """a / b, null when b is 0 (Spark try_divide)."""
    return f"(CASE WHEN ({b}) = 0 THEN NULL ELSE ({a}) / ({b}) END)"


REG = "season_type = 'Regular Season'"

# name -> (dependencies, SQL body). Fixture views are added below.
CTE: dict[str, tuple[tuple[str, ...], str]] = {}
for _name, _text in VIEWS.items():
    CTE[_name] = (VIEW_DEPS.get(_name, ()), _text)


def cte(name: str, deps: tuple[str, ...], body: str) -> None:
    CTE[name] = (deps, body)


def compose(body: str, *needs: str) -> str:
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for d in CTE[n][0]:
            visit(d)
        order.append(n)

    for n in needs:
        visit(n)
    if not order:
        return body
    parts = ",\n".join(f"{n} AS ({CTE[n][1]}\n)" for n in order)
    return f"WITH {parts}\n{body}"


# ------------------------------------------------------------------ shared CTEs

cte("v_play_by_play", ("v_plays",), """
SELECT game_id, event_id, ts, desc_home, desc_visitor, home_team, visitor_team, period, clock,
       CAST(SUM(points_home) OVER w AS BIGINT) AS score_home, CAST(SUM(points_away) OVER w AS BIGINT) AS score_away
FROM v_plays WINDOW w AS (PARTITION BY game_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)""")
cte("teams_dim", ("v_teams",), "SELECT DISTINCT team, full_name FROM v_teams")
cte("conf_dim", ("v_teams",), "SELECT DISTINCT team, conference FROM v_teams")
cte("team_gp", ("v_box_scores",), """
SELECT team, COUNT(*) AS team_gp
FROM (SELECT DISTINCT team, game_id, opponent, game_date FROM v_box_scores) d GROUP BY team""")
cte("inj_counts", ("v_injuries",), "SELECT team, COUNT(*) AS active_injuries FROM v_injuries GROUP BY team")
cte("streak", ("v_box_scores",), """
SELECT team, CAST(SUM(CASE WHEN l = 0 THEN 1 ELSE 0 END) AS BIGINT) AS win_streak
FROM (SELECT team, SUM(CASE WHEN outcome <> 'W' THEN 1 ELSE 0 END)
             OVER (PARTITION BY team ORDER BY game_date DESC, game_id DESC ROWS UNBOUNDED PRECEDING) AS l
      FROM (SELECT DISTINCT team, game_id, game_date, outcome FROM v_box_scores) g) r
GROUP BY team""")
cte("record", ("v_box_scores", "inj_counts", "streak", "teams_dim"), f"""
SELECT wl.team, tm.full_name, wl.wins, wl.losses, COALESCE(ic.active_injuries, 0) AS active_injuries,
       s.win_streak, {DIV('wl.wins', 'wl.wins + wl.losses')} AS win_pct,
       {R(DIV('wl.wins', 'wl.wins + wl.losses') + ' * 72', 0)} AS projected_wins,
       72 - {R(DIV('wl.wins', 'wl.wins + wl.losses') + ' * 72', 0)} AS projected_losses
FROM (SELECT team, CAST(SUM(CASE WHEN outcome = 'W' THEN 1 ELSE 0 END) AS BIGINT) AS wins,
             CAST(SUM(CASE WHEN outcome = 'L' THEN 1 ELSE 0 END) AS BIGINT) AS losses
      FROM (SELECT DISTINCT team, game_id, outcome FROM v_box_scores WHERE {REG}) g GROUP BY team) wl
LEFT JOIN inj_counts ic ON wl.team = ic.team
LEFT JOIN streak s ON wl.team = s.team
LEFT JOIN teams_dim tm ON wl.team = tm.team""")
cte("last_n", ("v_box_scores", "teams_dim"), """
SELECT r.team, tm.full_name,
       CAST(SUM(CASE WHEN outcome = 'W' THEN 1 ELSE 0 END) AS VARCHAR) || '-' ||
       CAST(SUM(CASE WHEN outcome = 'L' THEN 1 ELSE 0 END) AS VARCHAR) AS last_n
FROM (SELECT team, outcome, rank() OVER (PARTITION BY team ORDER BY game_date DESC) AS rk
      FROM (SELECT DISTINCT team, game_id, game_date, outcome FROM v_box_scores) g) r
LEFT JOIN teams_dim tm ON r.team = tm.team
WHERE rk <= 10 GROUP BY r.team, tm.full_name""")
cte("standings", ("record", "conf_dim", "last_n"), """
SELECT c.conference,
       CASE WHEN r.win_pct IS NOT NULL THEN
         rank() OVER (PARTITION BY c.conference, r.win_pct IS NULL ORDER BY r.win_pct DESC) END AS seed,
       r.team, r.full_name, r.wins, r.losses, r.win_streak, r.active_injuries, l.last_n
FROM record r LEFT JOIN conf_dim c ON r.team = c.team LEFT JOIN last_n l ON r.team = l.team""")
cte("team_rank", ("record",), """
SELECT team, full_name, row_number() OVER (ORDER BY win_pct DESC NULLS LAST, team) AS rank FROM record""")

ORACLE: dict[str, str] = {}


def oracle(name: str, body: str, *needs: str) -> None:
    ORACLE[name] = compose(body, *needs)


# ------------------------------------------------------------------ M1 teams

oracle("team_dimension", "SELECT team, full_name FROM teams_dim", "teams_dim")
oracle("conferences", "SELECT team, conference FROM conf_dim", "conf_dim")
oracle("team_games_played", "SELECT team, team_gp FROM team_gp", "team_gp")
oracle("injury_counts", "SELECT team, active_injuries FROM inj_counts", "inj_counts")
oracle("injuries_by_team", """
SELECT i.injury_id, i.team, i.description, t.full_name
FROM v_injuries i LEFT JOIN teams_dim t ON i.team = t.team""", "v_injuries", "teams_dim")
oracle("win_streak", "SELECT team, win_streak FROM streak", "streak")
oracle("team_record", "SELECT * FROM record", "record")
oracle("last_n_record", "SELECT team, full_name, last_n FROM last_n", "last_n")
oracle("conference_standings", "SELECT * FROM standings", "standings")
oracle("seed_labels", f"SELECT team, {ORD('seed')} || ' in ' || conference AS seed_label FROM standings",
       "standings")
oracle("team_rank", "SELECT * FROM team_rank", "team_rank")


# ------------------------------------------------------------------ M2 players

def BAND(c: str) -> str:
    return (f"CASE WHEN {c} >= 30000000 THEN '$30+ M' WHEN {c} >= 25000000 THEN '$25-30 M' "
            f"WHEN {c} >= 20000000 THEN '$20-25 M' WHEN {c} >= 15000000 THEN '$15-20 M' "
            f"WHEN {c} >= 10000000 THEN '$10-15 M' WHEN {c} >= 5000000 THEN '$5-10 M' ELSE '< $5 M' END")


TS = "2 * ({fga} + 0.44::DOUBLE * {fta})"
cte("contracts_clean", ("v_contracts",), """
SELECT DISTINCT player_id, team, TRY_CAST(regexp_replace(salary_text, '[$,\\s]', '', 'g') AS DOUBLE) AS salary
FROM v_contracts WHERE salary_text IS NULL OR salary_text <> 'Salary'""")
cte("salary", ("contracts_clean",), "SELECT player_id, max(salary) AS salary FROM contracts_clean GROUP BY player_id")
cte("player_gp", ("v_box_scores",), "SELECT player_id, COUNT(*) AS gp FROM v_box_scores GROUP BY player_id")
cte("ptot", ("v_box_scores",), f"""
SELECT player_id, COUNT(*) AS gp,
       {R(DIV('SUM(pts)', TS.format(fga='SUM(fga)', fta='SUM(fta)')), 3)} AS season_ts,
       {R('avg(pts) + 0.5::DOUBLE * avg(plus_minus) + 2.0::DOUBLE * avg(stl + blk) + 0.5::DOUBLE * avg(trb) - 1.5::DOUBLE * avg(tov) + 1.5::DOUBLE * avg(ast)', 1)} AS value,
       {R('avg(pts)', 1)} AS season_ppg
FROM v_box_scores GROUP BY player_id""")
cte("enr0", ("v_box_scores", "ptot", "salary", "teams_dim", "team_gp"), f"""
SELECT b.*, {R(DIV('b.pts', TS.format(fga='b.fga', fta='b.fta')), 3)} AS game_ts,
       p.gp, p.season_ts, p.value, p.season_ppg,
       b.pts + 0.5::DOUBLE * b.plus_minus + (2 * b.stl + b.blk) + 0.5::DOUBLE * b.trb - b.tov + b.ast AS game_value,
       s.salary, tm.full_name, tg.team_gp,
       tg.team_gp - p.gp AS games_missed,
       10 * {R('tg.team_gp / 72', 1)} AS grace
FROM v_box_scores b LEFT JOIN ptot p ON b.player_id = p.player_id
LEFT JOIN salary s ON b.player_id = s.player_id
LEFT JOIN teams_dim tm ON b.team = tm.team
LEFT JOIN team_gp tg ON b.team = tg.team""")
cte("enr1", ("enr0",), f"""
SELECT *, CASE WHEN games_missed = 0 THEN 1.0::DOUBLE WHEN games_missed <= grace THEN 1.0::DOUBLE
               WHEN games_missed > grace AND value >= 0 THEN 1.0::DOUBLE - 0.03::DOUBLE * (games_missed - grace)
               WHEN games_missed > grace AND value < 0 THEN 1.0::DOUBLE + 0.03::DOUBLE * (games_missed - grace) END AS penalty_factor,
       {R(DIV('gp', 'team_gp'), 3)} AS pct_played
FROM enr0""")
cte("enr2", ("enr1",), f"""
SELECT *, {R('CASE WHEN team_gp = gp THEN value WHEN games_missed = grace THEN value WHEN games_missed < grace THEN value WHEN games_missed > grace THEN value * penalty_factor END', 1)} AS adj
FROM enr1""")
cte("enriched", ("enr2",), f"""
SELECT * EXCLUDE (grace, adj, value_adj0), value_adj0 AS value_adj, value - value_adj0 AS value_penalty
FROM (SELECT *, {R(f"CASE WHEN {DIV('abs(adj - value)', 'value')} >= 0.3::DOUBLE THEN value * 0.67::DOUBLE WHEN {DIV('abs(adj - value)', 'value')} < 0.3::DOUBLE THEN adj END", 1)} AS value_adj0 FROM enr2) x""")
cte("latest_team", ("v_box_scores",), """
SELECT player_id, team FROM (
  SELECT player_id, team, max(game_date) AS d, max(max(game_date)) OVER (PARTITION BY player_id) AS md
  FROM v_box_scores GROUP BY player_id, team) x WHERE d = md""")
cte("season_high", ("v_box_scores",), f"""
SELECT player_id, {R('avg(pts)', 1)} AS avg_pts, max(pts) AS season_high,
       {R(DIV('SUM(pts)', TS.format(fga='SUM(fga)', fta='SUM(fta)')), 3)} AS season_ts
FROM v_box_scores GROUP BY player_id""")
cte("eff_scorers", ("enriched", "record"), f"""
SELECT row_number() OVER (ORDER BY p.value_adj DESC NULLS LAST, p.player_id) AS rank,
       p.player_id, p.team, p.avg_pts, p.season_ts, p.value_adj, p.gp,
       CASE WHEN row_number() OVER (ORDER BY p.value_adj DESC NULLS LAST, p.player_id) <= 5
            THEN 'Top 5 MVP Candidate' ELSE 'Other' END AS top_flag, r.wins, r.losses
FROM (SELECT * FROM (
        SELECT e.player_id, lt.team, season_ts, value_adj, gp, avg(pts) OVER (PARTITION BY e.player_id) AS avg_pts,
               row_number() OVER (PARTITION BY e.player_id ORDER BY game_date DESC, game_id DESC) AS rn
        FROM enriched e JOIN (SELECT player_id, arg_max(team, (game_date, game_id)) AS team FROM v_box_scores GROUP BY player_id) lt
          ON e.player_id = lt.player_id
        WHERE {REG} AND NOT (e.player_id = 9 AND e.team = 1)) y
      WHERE rn = 1 AND avg_pts >= 29 AND gp >= 0) p
LEFT JOIN record r ON p.team = r.team""")
cte("cv_last", ("enriched",), f"""
SELECT DISTINCT e.player_id, e.value_adj, e.salary, {BAND('e.salary')} AS band
FROM enriched e JOIN (SELECT player_id, max(game_date) AS md FROM enriched GROUP BY player_id) m
  ON e.player_id = m.player_id AND e.game_date = m.md""")
cte("cvalue", ("cv_last", "latest_team"), f"""
SELECT DISTINCT c.player_id, lt.team, c.salary, c.band, c.band_pct_rank, c.band_mean, c.band_count, c.band_share,
       CASE WHEN c.band_pct_rank * 100 >= 60 AND c.salary >= 25000000 THEN 'Superstars'
            WHEN c.band_pct_rank * 100 >= 90 THEN 'Great Value'
            WHEN c.band_pct_rank * 100 < 90 AND c.band_pct_rank * 100 >= 20 THEN 'Normal'
            ELSE 'Bad Value' END AS value_class
FROM (SELECT *,
        {R('CASE WHEN value_adj IS NOT NULL THEN percent_rank() OVER (PARTITION BY band, value_adj IS NULL ORDER BY value_adj) END', 3)} AS band_pct_rank,
        {R('avg(round(value_adj * 10, 0)) OVER (PARTITION BY band) / 10', 4)} AS band_mean,
        COUNT(*) OVER (PARTITION BY band) AS band_count,
        {R('COUNT(*) OVER (PARTITION BY band) / COUNT(*) OVER ()', 3)} AS band_share
      FROM cv_last) c
LEFT JOIN latest_team lt ON c.player_id = lt.player_id""")

oracle("clean_contracts", "SELECT * FROM contracts_clean", "contracts_clean")
oracle("player_games_played", "SELECT * FROM player_gp", "player_gp")
oracle("enriched_game_log", "SELECT * FROM enriched", "enriched")
oracle("league_true_shooting",
       f"SELECT {R(DIV('SUM(pts)', TS.format(fga='SUM(fga)', fta='SUM(fta)')), 3)} AS league_ts FROM v_box_scores",
       "v_box_scores")
oracle("player_latest_team", "SELECT * FROM latest_team", "latest_team")
oracle("latest_slice", "SELECT * FROM v_box_scores WHERE game_date = (SELECT max(game_date) FROM v_box_scores)",
       "v_box_scores")
oracle("most_recent_date", "SELECT max(game_date) AS game_date FROM v_box_scores", "v_box_scores")
oracle("player_season_high", "SELECT * FROM season_high", "season_high")
oracle("top_performers", """
SELECT row_number() OVER (ORDER BY t.pts DESC, t.player_id, t.game_id) AS rank, t.player_id, t.team,
       string_split(t.full_name, ' ')[-1] AS team_label, t.pts,
       t.game_ts, t.outcome, t.salary,
       CASE WHEN t.pts = h.season_high THEN 1 WHEN t.pts <> h.season_high AND t.pts - h.avg_pts >= 10 THEN 2
            WHEN t.pts - h.avg_pts <= -10 THEN 3 ELSE 0 END AS pts_code,
       CASE WHEN t.game_ts - h.season_ts >= 0.25::DOUBLE THEN 1
            WHEN t.game_ts - h.season_ts < 0.25::DOUBLE AND t.game_ts - h.season_ts >= 0.15::DOUBLE THEN 2
            WHEN t.game_ts <= 0.40::DOUBLE THEN 3 ELSE 0 END AS ts_code
FROM (SELECT *, rank() OVER (ORDER BY pts DESC) AS rk FROM enriched
      WHERE game_date = (SELECT max(game_date) FROM enriched)) t
LEFT JOIN season_high h ON t.player_id = h.player_id
WHERE t.rk <= 15""", "enriched", "season_high")
oracle("efficient_scorers", "SELECT * FROM eff_scorers", "eff_scorers")
oracle("team_scorers", f"""
SELECT pr.player_id, pr.team, tm.full_name, pa.avg_pts, pa.season_ts, pa.value, pa.gp,
       COALESCE(f.top_flag, 'Other') AS top_flag, r.wins, r.losses
FROM (SELECT DISTINCT player_id, team FROM enriched WHERE {REG}) pr
JOIN (SELECT player_id, avg(pts) AS avg_pts, max(season_ts) AS season_ts, max(value) AS value, max(gp) AS gp
      FROM enriched WHERE {REG} GROUP BY player_id HAVING max(gp) >= 0) pa ON pr.player_id = pa.player_id
LEFT JOIN (SELECT player_id, top_flag FROM eff_scorers WHERE top_flag <> 'Other') f ON pr.player_id = f.player_id
LEFT JOIN teams_dim tm ON pr.team = tm.team
LEFT JOIN record r ON pr.team = r.team""", "enriched", "eff_scorers", "teams_dim", "record")
oracle("team_scorers_min_games", f"""
SELECT pr.player_id, pr.team, tm.full_name, pa.avg_pts, pa.season_ts, pa.value, pa.gp,
       COALESCE(f.top_flag, 'Other') AS top_flag, r.wins, r.losses
FROM (SELECT DISTINCT player_id, team FROM enriched WHERE {REG}) pr
JOIN (SELECT player_id, avg(pts) AS avg_pts, max(season_ts) AS season_ts, max(value) AS value, max(gp) AS gp
      FROM enriched WHERE {REG} GROUP BY player_id HAVING max(gp) >= 5) pa ON pr.player_id = pa.player_id
LEFT JOIN (SELECT player_id, top_flag FROM eff_scorers WHERE top_flag <> 'Other') f ON pr.player_id = f.player_id
LEFT JOIN teams_dim tm ON pr.team = tm.team
LEFT JOIN record r ON pr.team = r.team""", "enriched", "eff_scorers", "teams_dim", "record")
oracle("contract_value", "SELECT * FROM cvalue", "cvalue")
oracle("contract_band_summary", """
SELECT DISTINCT band, band_count AS count, band_share AS share, band_mean AS mean_value FROM cvalue""", "cvalue")
cte("tv", ("contracts_clean", "player_gp"), f"""
SELECT team, team_gp, achieved, sal * team_gp AS max_value, sal * team_gp - achieved AS missing,
       {R(DIV('achieved', 'sal * team_gp'), 3)} AS pct_achieved,
       {R(DIV('sal * team_gp - achieved', 'sal * team_gp'), 3)} AS pct_missing
FROM (SELECT c.team, max(COALESCE(g.gp, 0)) AS team_gp, sum(c.salary) AS sal,
             sum(c.salary * COALESCE(g.gp, 0)) AS achieved
      FROM contracts_clean c LEFT JOIN player_gp g ON c.player_id = g.player_id GROUP BY c.team) x""")
oracle("contract_value_missing", """
SELECT t.team, t.team_gp, t.max_value, t.achieved, t.missing, t.pct_achieved, t.pct_missing,
       (SELECT avg(round(pct_missing * 1000, 0)) / 1000 FROM tv) AS league_mean_pct, r.wins, r.losses, r.win_pct
FROM tv t LEFT JOIN record r ON t.team = r.team""", "tv", "record")
oracle("scoring_variance", f"""
SELECT player_id, a AS avg_pts, v AS variance, {R('sqrt(greatest(v, 0))', 2)} AS std_dev,
       {R(DIV(R('sqrt(greatest(v, 0))', 2), 'a'), 3)} AS cv
FROM (SELECT *, (s2 - 2.0::DOUBLE * a * s1 + n * a * a) / n AS v
      FROM (SELECT player_id, COUNT(*) AS n, CAST(SUM(pts) AS BIGINT) AS s1, CAST(SUM(pts * pts) AS BIGINT) AS s2,
                   {R('SUM(pts) / COUNT(*)', 1)} AS a
            FROM v_box_scores GROUP BY player_id) g) x""", "v_box_scores")
oracle("metric_adjustment_report", f"""
SELECT DISTINCT player_id, team, value, value_adj, value_penalty, games_missed,
       {R(DIV('abs(value_penalty)', 'value'), 3)} AS penalty_ratio FROM enriched""", "enriched")


# ------------------------------------------------------------------ M3 pairing and running

cte("tgame", ("v_box_scores",), """
SELECT game_id, game_date, team, opponent, location, outcome, season_type,
       CAST(SUM(pts) AS BIGINT) AS pts, CAST(SUM(fga) AS BIGINT) AS fga, CAST(SUM(fta) AS BIGINT) AS fta,
       CAST(SUM(fg3m) AS BIGINT) AS fg3m, CAST(SUM(fg3a) AS BIGINT) AS fg3a
FROM v_box_scores GROUP BY game_id, game_date, team, opponent, location, outcome, season_type""")
cte("paired", ("tgame",), """
SELECT a.*, b.pts AS opp_pts, b.fga AS opp_fga, b.fta AS opp_fta, b.fg3m AS opp_fg3m, b.fg3a AS opp_fg3a
FROM tgame a JOIN tgame b ON a.game_id = b.game_id AND a.game_date = b.game_date AND a.team <> b.team""")
cte("mov", ("paired",), """
SELECT team, game_id, game_date, opponent, pts, opp_pts, pts - opp_pts AS margin,
       CASE WHEN pts - opp_pts > 0 THEN 'W' ELSE 'L' END AS outcome,
       CAST(SUM(CASE WHEN pts - opp_pts > 0 THEN 1 ELSE 0 END) OVER w AS VARCHAR) || '-' ||
       CAST(SUM(CASE WHEN pts - opp_pts < 0 THEN 1 ELSE 0 END) OVER w AS VARCHAR) AS record
FROM paired WINDOW w AS (PARTITION BY team ORDER BY game_date, game_id ROWS UNBOUNDED PRECEDING)""")
cte("hr_split", ("v_box_scores",), f"""
SELECT home_wins, road_wins, {R(DIV('home_wins', 'home_wins + road_wins') + ' * 100', 1)} AS home_pct,
       {R(DIV('road_wins', 'home_wins + road_wins') + ' * 100', 1)} AS road_pct, home_wins + road_wins AS total_games
FROM (SELECT CAST(SUM(CASE WHEN outcome = 'W' THEN 1 ELSE 0 END) AS BIGINT) AS home_wins,
             CAST(SUM(CASE WHEN outcome = 'L' THEN 1 ELSE 0 END) AS BIGINT) AS road_wins
      FROM (SELECT DISTINCT game_id, outcome FROM v_box_scores WHERE location = 'H') g) s""")
cte("league_avg", ("tgame",), f"""
SELECT {R('avg(avg_pts)', 1)} AS league_avg, {R(R('avg(avg_pts)', 1) + ' / 111.8::DOUBLE * 100 - 100', 2)} AS pct_change
FROM (SELECT team, avg(pts) AS avg_pts FROM tgame WHERE {REG} GROUP BY team) t""")
cte("strength", ("v_box_scores", "record"), f"""
SELECT g.team, g.game_id, g.opponent, g.outcome, g.location, {R('r.win_pct', 3)} AS win_pct,
       {R('o.win_pct', 3)} AS opp_win_pct, {R('avg(o.win_pct) OVER (PARTITION BY g.team)', 3)} AS avg_opp_win_pct
FROM (SELECT DISTINCT team, game_id, game_date, outcome, location, opponent FROM v_box_scores) g
LEFT JOIN record r ON g.team = r.team LEFT JOIN record o ON g.opponent = o.team""")
cte("hr_records", ("strength",), """
SELECT team,
  CAST(SUM(CASE WHEN location = 'H' AND outcome = 'W' THEN 1 ELSE 0 END) AS VARCHAR) || '-' ||
  CAST(SUM(CASE WHEN location = 'H' AND outcome = 'L' THEN 1 ELSE 0 END) AS VARCHAR) AS home_record,
  CAST(SUM(CASE WHEN location = 'A' AND outcome = 'W' THEN 1 ELSE 0 END) AS VARCHAR) || '-' ||
  CAST(SUM(CASE WHEN location = 'A' AND outcome = 'L' THEN 1 ELSE 0 END) AS VARCHAR) AS road_record
FROM strength GROUP BY team""")
cte("day_res", ("v_box_scores",), """
SELECT game_id, team, opponent, location, outcome, game_date, CAST(SUM(pts) AS BIGINT) AS team_pts
FROM v_box_scores WHERE game_date = (SELECT max(game_date) FROM v_box_scores)
GROUP BY game_id, team, opponent, location, outcome, game_date""")

oracle("margin_of_victory", "SELECT * FROM mov", "mov")
oracle("game_type_distribution", """
SELECT game_type, COUNT(*) AS n, COUNT(*) / SUM(COUNT(*)) OVER () AS share,
       CASE WHEN game_type = 'Blowout Game' THEN 'more than 10 points'
            WHEN game_type = 'Clutch Game' THEN '5 points or less' ELSE 'between 6 - 10 points' END AS explanation
FROM (SELECT CASE WHEN margin <= 5 THEN 'Clutch Game' WHEN margin <= 10 THEN '10 Pt Game' ELSE 'Blowout Game' END
             AS game_type FROM mov WHERE margin >= 1) x GROUP BY game_type""", "mov")
oracle("home_road_split", "SELECT * FROM hr_split", "hr_split")
oracle("league_scoring_average", "SELECT * FROM league_avg", "league_avg")
oracle("day_results", "SELECT * FROM day_res", "day_res")
oracle("day_summary", f"""
SELECT g.games, g.game_date, s.home_wins, s.road_wins,
       printf('%.2f', {R(DIV('s.home_wins', 's.n'), 2)}) AS home_share,
       printf('%.2f', {R(DIV('s.road_wins', 's.n'), 2)}) AS road_share
FROM (SELECT COUNT(*) / 2 AS games, max(game_date) AS game_date FROM day_res) g,
     (SELECT CAST(SUM(CASE WHEN outcome = 'W' THEN 1 ELSE 0 END) AS BIGINT) AS home_wins,
             CAST(SUM(CASE WHEN outcome = 'L' THEN 1 ELSE 0 END) AS BIGINT) AS road_wins, COUNT(*) AS n
      FROM day_res WHERE location = 'H') s""", "day_res")
oracle("schedule_strength_so_far", "SELECT * FROM strength", "strength")
oracle("home_road_records", "SELECT * FROM hr_records", "hr_records")
oracle("record_vs_quality", f"""
SELECT q.team, CAST(aw AS VARCHAR) || '-' || CAST(al AS VARCHAR) AS above_record,
       CAST(bw AS VARCHAR) || '-' || CAST(bl AS VARCHAR) AS below_record,
       {R(DIV('aw + al', 'aw + al + bw + bl'), 3)} AS share_above,
       {R(DIV('bw + bl', 'aw + al + bw + bl'), 3)} AS share_below,
       h.home_record, h.road_record, a.avg_opp_win_pct, r.win_pct
FROM (SELECT team,
        CAST(SUM(CASE WHEN opp_win_pct >= 0.5::DOUBLE AND outcome = 'W' THEN 1 ELSE 0 END) AS BIGINT) AS aw,
        CAST(SUM(CASE WHEN opp_win_pct >= 0.5::DOUBLE AND outcome = 'L' THEN 1 ELSE 0 END) AS BIGINT) AS al,
        CAST(SUM(CASE WHEN NOT COALESCE(opp_win_pct >= 0.5::DOUBLE, FALSE) AND outcome = 'W' THEN 1 ELSE 0 END) AS BIGINT) AS bw,
        CAST(SUM(CASE WHEN NOT COALESCE(opp_win_pct >= 0.5::DOUBLE, FALSE) AND outcome = 'L' THEN 1 ELSE 0 END) AS BIGINT) AS bl
      FROM strength GROUP BY team) q
LEFT JOIN hr_records h ON q.team = h.team
LEFT JOIN (SELECT team, max(avg_opp_win_pct) AS avg_opp_win_pct FROM strength GROUP BY team) a ON q.team = a.team
LEFT JOIN record r ON q.team = r.team""", "strength", "hr_records", "record")
oracle("last_night_team_board", f"""
SELECT p.team, p.opponent, p.location, CASE WHEN p.location = 'H' THEN 'Vs.' ELSE '@' END AS venue,
       p.pts, p.opp_pts, p.pts - p.opp_pts AS margin,
       {R(DIV('p.fg3m', 'p.fg3a'), 3)} AS fg3_pct, {R(DIV('p.opp_fg3m', 'p.opp_fg3a'), 3)} AS opp_fg3_pct,
       CASE WHEN p.pts = s.max_pts THEN 1 WHEN p.pts - s.avg_ppg >= 10 THEN 2
            WHEN p.pts - s.avg_ppg <= -10 THEN 3 ELSE 0 END AS pts_code,
       CASE WHEN p.opp_pts - s.avg_opp_ppg <= -10 THEN 2 WHEN p.opp_pts - s.avg_opp_ppg >= 10 THEN 3 ELSE 0 END AS opp_pts_code,
       'logos/' || lower(replace(h.full_name, ' ', '_')) || '.png' AS logo, 'logos/' || lower(replace(a.full_name, ' ', '_')) || '.png' AS opp_logo
FROM paired p LEFT JOIN v_teams h ON h.team = p.team LEFT JOIN v_teams a ON a.team = p.opponent JOIN (SELECT team, {R('avg(pts)', 1)} AS avg_ppg, {R('avg(opp_pts)', 1)} AS avg_opp_ppg,
                           max(pts) AS max_pts FROM paired GROUP BY team) s ON p.team = s.team
WHERE p.game_date = (SELECT max(game_date) FROM paired) AND p.pts > p.opp_pts""", "paired", "v_teams")
oracle("opponent_shooting_ranks", f"""
SELECT *, {ORD('fg3_rank')} AS fg3_rank_text, {ORD('ts_rank')} AS ts_rank_text, {ORD('fta_rank')} AS fta_rank_text,
       'Opponent TS%: ' || {NUM(R('opp_ts * 100', 1))} || '% (' || {ORD('ts_rank')} || ')<br>Opponent 3P%: ' || {NUM(R('opp_fg3_pct * 100', 1))}
       || '% (' || {ORD('fg3_rank')} || ')<br>Opponent FTA/g: ' || {NUM('opp_fta_per_game')} || ' (' || {ORD('fta_rank')} || ')' AS rating_text
FROM (SELECT *,
        CASE WHEN opp_fg3_pct IS NOT NULL THEN rank() OVER (PARTITION BY opp_fg3_pct IS NULL ORDER BY opp_fg3_pct) END AS fg3_rank,
        CASE WHEN opp_ts IS NOT NULL THEN rank() OVER (PARTITION BY opp_ts IS NULL ORDER BY opp_ts) END AS ts_rank,
        CASE WHEN opp_fta_per_game IS NOT NULL THEN rank() OVER (PARTITION BY opp_fta_per_game IS NULL ORDER BY opp_fta_per_game) END AS fta_rank
      FROM (SELECT team, {R(DIV('SUM(opp_fg3m)', 'SUM(opp_fg3a)'), 3)} AS opp_fg3_pct,
                   {R(DIV('SUM(opp_pts)', TS.format(fga='SUM(opp_fga)', fta='SUM(opp_fta)')), 3)} AS opp_ts,
                   {R('avg(opp_fta)', 1)} AS opp_fta_per_game
            FROM paired GROUP BY team) a) b""", "paired")
oracle("rest_day_outcomes", f"""
SELECT days_rest, outcome, COUNT(*) AS n, {R('COUNT(*) / SUM(COUNT(*)) OVER (PARTITION BY days_rest)', 3)} AS share
FROM (SELECT outcome, date_diff('day', lag(game_date) OVER (PARTITION BY team ORDER BY game_date, game_id), game_date) - 1 AS days_rest
      FROM (SELECT DISTINCT team, game_id, game_date, outcome FROM v_box_scores) g) x
GROUP BY days_rest, outcome""", "v_box_scores")
oracle("team_points_history", """
SELECT team, game_id, outcome, opponent, CAST(SUM(pts) AS BIGINT) AS pts FROM v_box_scores
GROUP BY team, game_id, outcome, opponent""", "v_box_scores")


# ------------------------------------------------------------------ M4 schedule, odds, ratings

AS_OF = "DATE '2001-07-15'"
ODDS_SINCE = "DATE '2001-06-01'"
cte("sched", ("v_schedule",), f"""
SELECT row_number() OVER (ORDER BY game_date, start_minute NULLS LAST, game_id) AS game_no,
       game_id, game_date, dayname(game_date) AS day_of_week, start_minute, visitor, home, 'Vs' AS vs
FROM (SELECT game_id, CAST(game_ts AS DATE) AS game_date, visitor, home,
             (CAST(split_part(start_text, ':', 1) AS INTEGER) % 12) * 60
             + CASE WHEN start_text LIKE '%p' THEN 720 ELSE 0 END
             + CAST(regexp_extract(start_text, ':([0-9]+)', 1) AS INTEGER) AS start_minute
      FROM v_schedule) s
WHERE game_date >= {AS_OF}""")
cte("pairs", ("sched",), """
SELECT game_no, team, opponent FROM (
  SELECT game_no, visitor AS team, home AS opponent FROM sched
  UNION ALL SELECT game_no, home AS team, visitor AS opponent FROM sched) p WHERE team <> opponent""")
cte("fbins", ("pairs", "team_rank"), f"""
SELECT *, {ORD("CASE WHEN top IS NOT NULL THEN rank() OVER (PARTITION BY top IS NULL ORDER BY top DESC) END")} AS top_rank,
          {ORD("CASE WHEN mid IS NOT NULL THEN rank() OVER (PARTITION BY mid IS NULL ORDER BY mid DESC) END")} AS mid_rank,
          {ORD("CASE WHEN bottom IS NOT NULL THEN rank() OVER (PARTITION BY bottom IS NULL ORDER BY bottom DESC) END")} AS bottom_rank
FROM (SELECT team, NULLIF(COUNT(CASE WHEN bin = 'top' THEN 1 END), 0) AS top,
             NULLIF(COUNT(CASE WHEN bin = 'mid' THEN 1 END), 0) AS mid,
             NULLIF(COUNT(CASE WHEN bin = 'bottom' THEN 1 END), 0) AS bottom
      FROM (SELECT p.team, CASE WHEN r.rank <= 10 THEN 'top' WHEN r.rank > 10 AND r.rank <= 20 THEN 'mid'
                                ELSE 'bottom' END AS bin
            FROM pairs p LEFT JOIN team_rank r ON p.opponent = r.team) x GROUP BY team) c""")
cte("difficulty", ("pairs", "team_rank", "fbins"), f"""
SELECT g.team, g.rank, g.avg_opp_rank, g.differential, g.difficulty_rank, {ORD('g.difficulty_rank')} AS difficulty_text,
       {ORD('g.rank')} AS rank_text,
       CASE WHEN g.differential > 0 THEN 'Easier Schedule' ELSE 'Harder Schedule' END AS label,
       b.top, b.mid, b.bottom, b.top_rank, b.mid_rank, b.bottom_rank
FROM (SELECT a.team, r.rank, {R('a.a - r.rank', 1)} AS differential, {R('a.a', 1)} AS avg_opp_rank,
             row_number() OVER (ORDER BY {R('a.a', 1)} NULLS LAST, a.team) AS difficulty_rank
      FROM (SELECT p.team, avg(o.rank) AS a FROM pairs p LEFT JOIN team_rank o ON p.opponent = o.team GROUP BY p.team) a
      LEFT JOIN team_rank r ON a.team = r.team) g
LEFT JOIN fbins b ON g.team = b.team""")
cte("upcoming", ("sched", "team_rank", "teams_dim", "v_odds"), f"""
SELECT s.game_id, s.game_date, s.day_of_week, s.start_minute,
       CASE WHEN o.game_id IS NULL THEN n1.full_name ELSE n1.full_name || ' (' || replace(o.ml1, '#', '+100') || ')' END AS road_label,
       s.vs,
       CASE WHEN o.game_id IS NULL THEN n2.full_name ELSE n2.full_name || ' (' || replace(o.ml2, '#', '+100') || ')' END AS home_label,
       (r1.rank + r2.rank) / 2 AS avg_rank,
       CASE sign(CAST(replace(o.ml1, '#', '100') AS INT) - CAST(replace(o.ml2, '#', '100') AS INT))
            WHEN -1 THEN n1.full_name WHEN 1 THEN n2.full_name END AS favored
FROM sched s LEFT JOIN team_rank r1 ON s.visitor = r1.team LEFT JOIN team_rank r2 ON s.home = r2.team
LEFT JOIN teams_dim n1 ON s.visitor = n1.team LEFT JOIN teams_dim n2 ON s.home = n2.team
LEFT JOIN (SELECT game_id, CASE WHEN length(team1_moneyline) = 1 THEN '#' ELSE team1_moneyline END AS ml1,
                  CASE WHEN length(team2_moneyline) = 1 THEN '#' ELSE team2_moneyline END AS ml2
           FROM v_odds WHERE game_date = {AS_OF}) o ON o.game_id = s.game_id""")
cte("next_day", ("upcoming",), """
SELECT game_date, day_of_week, COUNT(*) AS games FROM upcoming
WHERE game_date = (SELECT min(game_date) FROM upcoming) GROUP BY game_date, day_of_week""")
cte("ratings", ("v_team_ratings", "teams_dim"), """
SELECT tm.team, r.full_name, r.ortg, r.drtg, r.nrtg, r.w, r.l, r.pace
FROM (SELECT replace(team_text, '*', '') AS full_name, TRY_CAST(ortg_text AS DOUBLE) AS ortg,
             TRY_CAST(drtg_text AS DOUBLE) AS drtg,
             TRY_CAST(w_text AS INTEGER) AS w, TRY_CAST(l_text AS INTEGER) AS l, TRY_CAST(pace_text AS DOUBLE) AS pace, TRY_CAST(replace(nrtg_text, '+', '') AS DOUBLE) AS nrtg
      FROM v_team_ratings) r LEFT JOIN teams_dim tm ON r.full_name = tm.full_name
WHERE r.full_name <> 'League Average'""")

oracle("normalise_schedule", "SELECT * FROM sched", "sched")
oracle("schedule_pairs", "SELECT * FROM pairs", "pairs")
oracle("future_opponent_bins", "SELECT * FROM fbins", "fbins")
oracle("schedule_difficulty", "SELECT * FROM difficulty", "difficulty")
oracle("upcoming_schedule", "SELECT * FROM upcoming", "upcoming")
oracle("next_gameday", "SELECT * FROM next_day", "next_day")
oracle("league_kpis", """
SELECT n.game_date, n.day_of_week, n.games, s.home_wins, s.road_wins, s.home_pct, s.road_pct, s.total_games,
       a.league_avg, a.pct_change, strftime(n.game_date, '%B %d, %Y') AS full_date,
       n.games || CASE WHEN n.games = 1 THEN ' Upcoming Game' ELSE ' Upcoming Games | See Schedule' END AS games_text,
       CAST(s.home_wins AS VARCHAR) || ' - ' || CAST(s.road_wins AS VARCHAR) AS record
FROM next_day n, hr_split s, league_avg a""", "next_day", "hr_split", "league_avg")
oracle("over_under_tracker", f"""
SELECT l.team, tm.full_name, l.over_under_wins, {R('l.over_under_wins / 72', 3)} AS expected_pct, r.win_pct,
       CASE WHEN r.win_pct >= {R('l.over_under_wins / 72', 3)} THEN 'Over' ELSE 'Under' END AS verdict,
       r.projected_wins - l.over_under_wins AS wins_difference, 72 - l.over_under_wins AS line_losses,
       b.top, b.mid, b.bottom, b.top_rank, b.mid_rank, b.bottom_rank
FROM v_over_under l LEFT JOIN record r ON l.team = r.team LEFT JOIN teams_dim tm ON l.team = tm.team
LEFT JOIN fbins b ON l.team = b.team""", "v_over_under", "record", "teams_dim", "fbins")
cte("oday", ("v_box_scores",), f"""
SELECT team, game_date, CAST(SUM(pts) AS BIGINT) AS pts,
       CASE WHEN COUNT(DISTINCT outcome) = 1 THEN max(outcome) END AS outcome
FROM v_box_scores WHERE game_date >= {ODDS_SINCE} GROUP BY team, game_date""")
oracle("enrich_odds", f"""
SELECT o.game_id, o.game_date, o.team1, o.team2, o.team1_moneyline, o.team2_moneyline, o.team1_spread, o.team2_spread, o.pts_bet,
       d1.outcome AS team1_outcome,
       CASE WHEN d1.outcome = 'W' THEN 'L' WHEN d1.outcome = 'L' THEN 'W' END AS team2_outcome,
       d1.pts AS team1_pts, d2.pts AS team2_pts, d1.pts + d2.pts AS total_pts
FROM v_odds o
LEFT JOIN oday d1 ON o.team1 = d1.team AND o.game_date = d1.game_date
LEFT JOIN oday d2 ON o.team2 = d2.team AND o.game_date = d2.game_date""", "v_odds", "oday")
oracle("clean_team_ratings", "SELECT * FROM ratings", "ratings")
oracle("rating_ranks", f"""
SELECT *, {ORD('nrtg_rank')} AS nrtg_text, {ORD('ortg_rank')} AS ortg_text, {ORD('drtg_rank')} AS drtg_text,
       'Offensive Rating: ' || {NUM('ortg')} || ' (' || {ORD('ortg_rank')} || ')<br>Defensive Rating: ' || {NUM('drtg')} || ' ('
       || {ORD('drtg_rank')} || ')<br>Net Rating: ' || {NUM('nrtg')} || ' (' || {ORD('nrtg_rank')} || ')' AS rating_text
FROM (SELECT *, row_number() OVER (ORDER BY nrtg DESC, team) AS nrtg_rank,
             row_number() OVER (ORDER BY ortg DESC, nrtg DESC, team) AS ortg_rank,
             row_number() OVER (ORDER BY drtg, ortg DESC, nrtg DESC, team) AS drtg_rank,
             avg(ortg) OVER () AS league_ortg, avg(drtg) OVER () AS league_drtg
      FROM ratings) r""", "ratings")
oracle("comment_blocks", """
SELECT page_id, CAST(generate_subscripts(arr, 1) - 1 AS BIGINT) AS pos, unnest(arr) AS body
FROM (SELECT page_id, list_transform(list_filter(string_split(replace(html, '-->', '<!--' || chr(1)), '<!--')[2:], lambda x: x[1] <> chr(1)), lambda x: x) AS arr FROM pages) p""")
oracle("extract_list_items", """
SELECT * FROM (
  SELECT page_id, CAST(generate_subscripts(arr, 1) - 1 AS BIGINT) AS pos, trim(regexp_replace(unnest(arr), '<[^>]*>', '', 'g')) AS item
  FROM (SELECT page_id, list_transform(string_split(html, '<li>')[2:], lambda x: string_split(x, '</li>')[1]) AS arr FROM pages) p) x
WHERE NOT regexp_matches(item, 'G-League')""")
oracle("team_logo_lookup", """
SELECT t.team, t.full_name, 'logos/' || lower(replace(v.full_name, ' ', '_')) || '.png' AS logo
FROM teams_dim t LEFT JOIN v_teams v ON t.team = v.team""", "teams_dim", "v_teams")


# ------------------------------------------------------------------ M5 play by play

cte("timeline", ("v_play_by_play",), """
SELECT game_id, event_play, event_id, location, team, play, period, clock, score_home, score_away,
       score_home - score_away AS margin, date_trunc('minute', ts) AS minute
FROM (SELECT *, row_number() OVER (PARTITION BY game_id ORDER BY ts, event_id, side_idx) AS event_play
      FROM (SELECT game_id, event_id, ts, period, clock, score_home, score_away, 0 AS side_idx,
                   'Home' AS location, home_team AS team, desc_home AS play FROM v_play_by_play
            UNION ALL
            SELECT game_id, event_id, ts, period, clock, score_home, score_away, 1 AS side_idx,
                   'Away' AS location, visitor_team AS team, desc_visitor AS play FROM v_play_by_play) u) n
WHERE play IS NOT NULL AND score_home IS NOT NULL AND score_away IS NOT NULL""")
cte("runs", ("timeline",), """
SELECT game_id, event_play, event_id, location, team, play, period, clock, score_home, score_away, margin, minute,
       score_change, sign, run_id,
       row_number() OVER (PARTITION BY game_id, run_id ORDER BY event_play) AS run_pos,
       CAST(SUM(abs(score_change)) OVER (PARTITION BY game_id, run_id ORDER BY event_play ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run_points
FROM (SELECT *, CAST(SUM(flag) OVER (PARTITION BY game_id ORDER BY event_play ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run_id
      FROM (SELECT *, CASE WHEN sign <> COALESCE(lag(sign) OVER (PARTITION BY game_id ORDER BY event_play), sign)
                           THEN 1 ELSE 0 END AS flag
            FROM (SELECT *, CASE WHEN score_change > 0 THEN 1 ELSE -1 END AS sign
                  FROM (SELECT *, margin - COALESCE(lag(margin) OVER (PARTITION BY game_id ORDER BY event_play), 0)
                                  AS score_change FROM timeline) a) b) c) d""")
MIN = f"{R('TRY_CAST(split_part(clock, chr(58), 1) AS DOUBLE) + TRY_CAST(split_part(clock, chr(58), 2) AS DOUBLE) / 60.0::DOUBLE', 3)}"
oracle("play_timeline", "SELECT * FROM timeline", "timeline")
oracle("scoring_runs", "SELECT * FROM runs", "runs")
oracle("lead_state", f"""
SELECT x.*, CASE WHEN period <= 4 THEN (5 - period) * 12 - (12 - minutes) ELSE -5 * (period - 4) + minutes END AS game_axis,
       CASE sign(f.final * CASE WHEN location = 'Home' THEN 1 ELSE -1 END) WHEN 1 THEN 'W' WHEN -1 THEN 'L' END AS outcome,
       h.full_name || ' Vs. ' || a.full_name AS title, printf('#%06X', x.team * 9677) AS color
FROM (SELECT *, CASE WHEN period > 4 THEN {ORD('period - 4')} || ' OT' ELSE {ORD('period')} END AS period_label,
             CASE WHEN location = 'Home' AND score_home > score_away THEN 'Leading'
                  WHEN location = 'Home' AND score_home < score_away THEN 'Trailing'
                  WHEN location = 'Away' AND score_home > score_away THEN 'Trailing'
                  WHEN location = 'Away' AND score_home < score_away THEN 'Leading' ELSE 'Tied' END AS state,
             {MIN} AS minutes
      FROM runs) x
JOIN (SELECT game_id, arg_max(margin, event_play) AS final FROM timeline GROUP BY game_id) f ON f.game_id = x.game_id
JOIN (SELECT DISTINCT game_id, home_team, visitor_team FROM v_plays) s ON s.game_id = x.game_id
LEFT JOIN teams_dim h ON h.team = s.home_team LEFT JOIN teams_dim a ON a.team = s.visitor_team""", "runs", "timeline", "v_plays", "teams_dim")
oracle("foul_calls", """
SELECT game_id, event_id, regexp_replace(parts[3], '.$', '') AS referee,
       regexp_replace(upper(concat_ws('', g, h)), 'PERSONALTAKE', 'PERSONAL') AS foul_type
FROM (SELECT *, regexp_replace(regexp_replace(regexp_replace(regexp_replace(words[2], 'Jr.', ''), 'Sr.', ''), 'III', ''), 'Hill', '') AS g,
             regexp_replace(words[3], 'Offensive', 'OFFENSIVECHARGE') AS h
      FROM (SELECT *, string_split(parts[1], ' ') AS words
            FROM (SELECT game_id, event_id, string_split_regex(value, '\\(') AS parts
                  FROM (SELECT game_id, event_id, desc_home AS value FROM v_foul_text
                        UNION ALL SELECT game_id, event_id, desc_visitor AS value FROM v_foul_text) u
                  WHERE value IS NOT NULL AND regexp_matches(value, '(?i)foul')
                    AND NOT contains(value, 'Turnover') AND NOT contains(value, 'FLAGRANT')) a) b) c""",
       "v_foul_text")
oracle("game_titles", """
SELECT game_id, max(CASE WHEN location = 'H' THEN full_name END) || ' Vs. ' ||
                max(CASE WHEN location = 'A' THEN full_name END) AS title
FROM (SELECT DISTINCT b.game_id, b.location, b.team, t.full_name
      FROM v_box_scores b LEFT JOIN teams_dim t ON b.team = t.team) x GROUP BY game_id""",
       "v_box_scores", "teams_dim")


# ------------------------------------------------------------------ M6 catalogue, slices, snapshot

STUDIO = "NOT regexp_matches(album, 'ECONOMY|PROMO')"
oracle("studio_tracks", f"SELECT * FROM v_tracks WHERE {STUDIO}", "v_tracks")
oracle("song_count", "SELECT artist, COUNT(DISTINCT track) AS songs FROM v_tracks GROUP BY artist", "v_tracks")
oracle("album_count", "SELECT artist, COUNT(DISTINCT album) AS albums FROM v_tracks GROUP BY artist", "v_tracks")
oracle("artist_statistics", f"""
SELECT artist, {R('avg(CAST(valence * 100 AS DECIMAL(18,6)))', 1)} AS positivity,
       {R('avg(CAST(energy * 100 AS DECIMAL(18,6)))', 1)} AS energy,
       COUNT(DISTINCT track) AS songs, COUNT(DISTINCT album) AS albums
FROM v_tracks WHERE {STUDIO} GROUP BY artist""", "v_tracks")
oracle("album_timeline", "SELECT DISTINCT artist, album, release_date FROM v_tracks", "v_tracks")
oracle("artist_search", """
SELECT artist_id, artist_name, popularity, CASE WHEN artist_id % 3 <> 0 THEN 'img/320/' || artist_id END AS image FROM (
  SELECT *, row_number() OVER (PARTITION BY artist_name ORDER BY popularity DESC, artist_id) AS rn
  FROM v_artists WHERE contains(lower(artist_name), 'blue')) x WHERE rn = 1""", "v_artists")
oracle("mood_quadrants", """
SELECT artist, album, quadrant, COUNT(*) AS n, COUNT(*) / SUM(COUNT(*)) OVER (PARTITION BY artist, album) AS share
FROM (SELECT artist, album,
             CASE WHEN valence >= 0.5::DOUBLE AND energy >= 0.5::DOUBLE THEN 'Happy / Upbeat'
                  WHEN valence >= 0.5::DOUBLE AND energy < 0.5::DOUBLE THEN 'Mellow / Peaceful'
                  WHEN valence < 0.5::DOUBLE AND energy < 0.5::DOUBLE THEN 'Sad / Slow'
                  WHEN valence < 0.5::DOUBLE AND energy >= 0.5::DOUBLE THEN 'Aggressive / Fast Paced' END AS quadrant
      FROM v_tracks) x GROUP BY artist, album, quadrant""", "v_tracks")
oracle("slice_team_margins", "SELECT * FROM mov WHERE team = 7", "mov")
oracle("slice_documents_contains",
       "SELECT doc_id, lang, source, n_chars FROM documents WHERE contains(text, 'License')")
oracle("slice_documents_not_contains",
       "SELECT doc_id, lang, source, n_chars FROM documents WHERE NOT contains(text, 'License')")
oracle("slice_injuries_team", """
SELECT i.injury_id, i.team, i.description, t.full_name
FROM v_injuries i LEFT JOIN teams_dim t ON i.team = t.team WHERE t.full_name = 'NATION_11'""",
       "v_injuries", "teams_dim")
oracle("refresh_snapshot", "SELECT * FROM v_injuries", "v_injuries")
oracle("game_axis", f"""
SELECT game_id, last_period,
       CASE WHEN last_period > 4 THEN {ORD('last_period - 4')} || ' OT' ELSE {ORD('last_period')} END AS last_period_label,
       [48, 36, 24, 12, 0]::BIGINT[] || CASE WHEN last_period > 4
            THEN list_transform(range(1, last_period - 3), lambda k: k * -5) ELSE []::BIGINT[] END AS axis_breaks,
       ['1st Quarter', '2nd Quarter', '3rd Quarter', '4th Quarter', 'End 4th'] || CASE WHEN last_period > 4
            THEN list_transform(range(1, last_period - 3), lambda k: {ORD('k')} || ' OT') ELSE []::VARCHAR[] END AS axis_labels
FROM (SELECT game_id, max(period) AS last_period FROM timeline GROUP BY game_id) x""", "timeline")

oracle("slice_team_record", "SELECT * FROM record WHERE team = 7", "record")
ORACLE["slice_team_scorers"] = f"SELECT * FROM ({ORACLE['team_scorers']}) q WHERE team = 7"
ORACLE["slice_team_ratings"] = f"SELECT * FROM ({ORACLE['rating_ranks']}) q WHERE team = 7"
ORACLE["slice_team_opponent_shooting"] = f"SELECT * FROM ({ORACLE['opponent_shooting_ranks']}) q WHERE team = 7"
ORACLE["slice_game_title"] = f"SELECT * FROM ({ORACLE['game_titles']}) q WHERE title = 'NATION_7 Vs. NATION_9'"
oracle("contract_value_missing_players", f"""
SELECT player_id, team, salary, gp, team_gp, salary * gp AS achieved, salary * team_gp - salary * gp AS missing,
       {R(DIV('salary * team_gp - salary * gp', 'salary * team_gp'), 3)} AS pct_missing
FROM (SELECT c.player_id, c.team, c.salary, COALESCE(g.gp, 0) AS gp, max(COALESCE(g.gp, 0)) OVER (PARTITION BY c.team) AS team_gp
      FROM contracts_clean c LEFT JOIN player_gp g ON c.player_id = g.player_id) x""", "contracts_clean", "player_gp")
cte("sheet", ("v_contract_sheet",), """
SELECT DISTINCT CASE name WHEN 'J.J. Redick' THEN 'JJ Redick' WHEN 'Kevin Knox' THEN 'Kevin Knox II'
                          ELSE strip_accents(replace(replace(replace(replace(replace(replace(replace(replace(name,
                               'Þ', 'TH'), 'ð', 'd'), 'Æ', 'AE'), 'ß', 'ss'), 'Ł', 'L'), 'œ', 'oe'), 'Đ', 'D'), 'ø', 'o')) END AS name,
       CASE team WHEN 'BRK' THEN 'BKN' WHEN 'PHO' THEN 'PHX' WHEN 'CHO' THEN 'CHA' ELSE team END AS team,
       CAST(replace(replace(salary_text, '$', ''), ',', '') AS DOUBLE) AS salary,
       COALESCE(TRY_CAST(replace(replace(total_text, '$', ''), ',', '') AS DOUBLE), 0) AS total_owed
FROM v_contract_sheet WHERE name <> 'Player' """)
oracle("clean_contract_sheet", "SELECT * FROM sheet", "sheet")
oracle("contract_team_logos", """
SELECT DISTINCT team, CASE team WHEN 'BKN' THEN 'logos/bkn1.png' WHEN 'PHX' THEN 'logos/phx1.png' WHEN 'CHA' THEN 'logos/cha.png'
                                WHEN 'LAL' THEN 'logos/lal2.png' END AS logo FROM sheet""", "sheet")
oracle("contracts_csv", "SELECT name, team, salary_text, NULLIF(total_text, '') AS total_text FROM v_contract_sheet", "v_contract_sheet")
oracle("frequent_winners", """
SELECT team, game_id, outcome FROM (
  SELECT *, SUM(CASE outcome WHEN 'W' THEN 1 WHEN 'L' THEN -1 ELSE 0 END) OVER (PARTITION BY team) AS net
  FROM (SELECT DISTINCT team, game_id, outcome FROM v_box_scores) g) x WHERE net > 0""", "v_box_scores")

oracle("page_ratings", """
SELECT page_id, team, full_name, w, l, pace, ortg, drtg, nrtg FROM ratings JOIN pages ON page_id % 25 = team""", "ratings")
ORACLE["page_schedule"] = ORACLE["normalise_schedule"]
oracle("payroll_text", """
SELECT team, format('{:,}', count(*)) AS players, '$' || format('{:,}', CAST(sum(salary) AS bigint)) AS payroll,
       '$' || format('{:,}', CAST(sum(total_owed) AS bigint)) AS owed FROM sheet GROUP BY team""", "sheet")
ORACLE["song_count_sketched"] = ORACLE["song_count"]
oracle("injury_changes", """
SELECT CASE team WHEN 3 THEN 'delete' WHEN 5 THEN 'change' ELSE 'insert' END AS change, injury_id, team,
       CASE team WHEN 5 THEN description || ' (day to day)' ELSE description END AS description
FROM v_injuries WHERE team IN (3, 5, 7)""", "v_injuries")
