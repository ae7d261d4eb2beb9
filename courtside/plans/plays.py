"""Play-by-play pipelines: timeline, scoring runs, lead state, foul calls, titles.

Order inside a game is explicit: (ts, event_id) for raw events, then the
event number. A game's rows may be arbitrarily many, so every ordered step runs
per (game, minute), and whatever a minute needs from those before it (previous
margin, previous sign, running totals, the run that is still open) comes from one
small row per minute: a segmented scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from courtside.functions.exprs import clock_minutes, ordinal, replace_first
from courtside.operators.core import running_sum, separate, unite, unpivot


def play_timeline(plays: DataFrame, chunk: Column | None = None) -> DataFrame:
    """(P48) one row per (event, side) with a description: home and visitor
    text unpivoted, events numbered per game in (ts, event_id, home-first)
    order before rows without text or score are dropped; margin = home - away.
    ``team`` is the acting side's. ``chunk`` is a coarse order-preserving key of
    ``ts`` (default: the minute). Plays that carry their number (``event_no``)
    and their chunk (``minute``) already are not numbered again."""
    if chunk is not None or not {"event_no", "minute"} <= set(plays.columns):
        chunk = chunk if chunk is not None else F.date_trunc("minute", "ts")
        plays = running_sum(plays.drop("event_no", "minute"), "game_id", ["ts", "event_id"], {"event_no": F.lit(1).cast("long")},
                            chunk=chunk, chunk_name="minute")

    def side(location, team, desc, second):
        return F.struct((F.col("event_no") * 2 - 1 + second).alias("event_play"), F.lit(location).alias("location"),
                        F.col(team).alias("team"), F.col(desc).alias("play"))

    # an explode keeps the rows where they are, by game and minute
    sides = F.explode(F.array(side("Home", "home_team", "desc_home", 0), side("Away", "visitor_team", "desc_visitor", 1)))
    return (plays.withColumn("__s", sides).withColumn("margin", F.col("score_home") - F.col("score_away"))
            .where(F.col("__s.play").isNotNull() & F.col("margin").isNotNull())
            .select("game_id", "__s.event_play", "event_id", "__s.location", "__s.team", "__s.play", "period", "clock",
                    "score_home", "score_away", "margin", "minute"))


def scoring_runs(timeline: DataFrame, chunk: str = "minute") -> DataFrame:
    """(P49) score change vs the previous play (0 before the first), its sign
    (a change of 0 counts as -1), runs of equal sign (island id), position in
    the run and points accumulated in the run.

    A segmented scan over (game, ``chunk``), a column that grows with the event
    number. Each chunk is scanned by itself as far as it can be: all but the
    change of its first row and whether its second row turns hang on nothing
    before it. It hands on one row: its size, first and last margin, second and
    last sign, turns, points, and where its last run starts. These rows are
    scanned over the game and joined back, which fills in the rest. Rows are
    shuffled by chunk only (whole, and for their chunk's row the order and the
    margin alone); the other exchanges carry a row a chunk."""
    key = ["game_id", chunk]
    w = Window.partitionBy(*key).orderBy("event_play")
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    change, sign, k = F.col("__change"), F.col("__sign"), F.col("__k")

    def sign_of(x):
        return F.when(x > 0, 1).otherwise(-1)

    t = timeline.withColumns({"__k": F.row_number().over(w).cast("long"), "__change": F.col("margin") - F.lag("margin").over(w)})
    t = t.withColumn("__sign", F.when(change.isNotNull(), sign_of(change)))
    t = t.withColumn("__turn", F.coalesce(sign != F.lag("__sign").over(w), F.lit(False)))
    t = t.withColumns({"__turns": F.count_if("__turn").over(upto), "__points": F.coalesce(F.sum(F.abs(change)).over(upto), F.lit(0)),
                       "__start": F.max(F.when(F.col("__turn"), k)).over(upto)})
    t = t.withColumn("__before", F.max(F.when(F.col("__turn"), F.col("__points") - F.abs(change))).over(upto))
    ends = t.groupBy(*key).agg(
        F.max("__k").alias("n"), F.min_by("margin", "__k").alias("m1"), F.max(F.when(k == 2, sign)).alias("s2"),
        F.max_by("margin", "__k").alias("m"), F.max_by("__sign", "__k").alias("s"), F.max("__turns").alias("turns"),
        F.max("__points").alias("points"), F.max("__start").alias("start"), F.max("__before").alias("before"))

    over = Window.partitionBy("game_id").orderBy(chunk)
    earlier = over.rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("c1", F.col("m1") - F.coalesce(F.lag("m").over(over), F.lit(0)))
    ends = ends.withColumns({"s1": sign_of(F.col("c1")), "a1": F.abs("c1")})
    ends = ends.withColumn("prev", F.lag(F.coalesce("s", "s1")).over(over))
    # does the first row turn, the second, and does the first open a run?
    ends = ends.withColumns({"f1": F.coalesce(F.col("s1") != F.col("prev"), F.lit(False)), "f2": F.coalesce(F.col("s2") != F.col("s1"), F.lit(False))})
    ends = ends.withColumn("opens", F.col("f1") | F.col("prev").isNull())

    def total(x):
        return F.coalesce(F.sum(x).over(earlier), F.lit(0))

    ends = ends.withColumns({"k_off": total("n"), "p_off": total(F.col("a1") + F.col("points")),
                             "run_off": total(F.col("f1").cast("long") + F.col("f2").cast("long") + F.col("turns"))})
    p1 = F.col("p_off") + F.col("a1")

    def run_start(start, second):  # of the run that a row is in, if it starts in the row's chunk: its first play's number
        return F.coalesce(F.col("k_off") + start, F.when(second, F.col("k_off") + 2), F.when(F.col("opens"), F.col("k_off") + 1))

    def points_before(before, second):  # and the points before it
        return F.coalesce(p1 + before, F.when(second, p1), F.when(F.col("opens"), F.col("p_off")))

    ends = ends.withColumns({"open_k": F.max(run_start(F.col("start"), F.col("f2"))).over(earlier),
                             "open_p": F.max(points_before(F.col("before"), F.col("f2"))).over(earlier)})
    ends = ends.select(*key, F.struct("c1", "s1", "f1", "f2", "opens", "k_off", "p_off", "a1", "run_off", "open_k", "open_p").alias("__e"))

    j = t.join(ends, key).select("*", "__e.*")
    second = F.col("f2") & (k > 1)
    return j.select(
        *[F.col(f"`{c}`") for c in timeline.columns], F.coalesce(change, "c1").alias("score_change"), F.coalesce(sign, "s1").alias("sign"),
        (F.col("run_off") + F.col("f1").cast("long") + second.cast("long") + F.col("__turns")).alias("run_id"),
        (F.col("k_off") + k - F.coalesce(run_start(F.col("__start"), second), "open_k") + 1).alias("run_pos"),
        (p1 + F.col("__points") - F.coalesce(points_before(F.col("__before"), second), "open_p")).alias("run_points"))


def final_outcomes(timeline: DataFrame) -> DataFrame:
    """Outcome per game and acting team, from the score of the game's last play."""
    last = timeline.groupBy("game_id").agg(F.max_by("margin", "event_play").alias("__final"))
    won = F.when(F.col("location") == "Home", F.col("__final")).otherwise(-F.col("__final"))
    return (timeline.select("game_id", "team", "location").distinct().join(last, "game_id")
            .select("game_id", "team", F.when(won > 0, "W").when(won < 0, "L").alias("outcome")).distinct())


def period_label(period) -> Column:
    """1st..4th, then '1st OT', '2nd OT', ... for any number of overtimes."""
    p = F.col(period) if isinstance(period, str) else period
    return F.when(p > 4, F.concat(ordinal(p - 4), F.lit(" OT"))).otherwise(ordinal(p))


def lead_state(runs: DataFrame, outcomes: DataFrame | None = None, titles: DataFrame | None = None,
               colors: DataFrame | None = None) -> DataFrame:
    """(P50) period label, leading/trailing/tied from the acting side's view,
    clock in minutes and a game axis counting down 48 -> 0 over regulation
    and on by 5 per overtime (OT k spans -5k .. -5k+5). Optional joins: the
    side's outcome (game_id, team), the game title, team colours."""
    p = F.col("period")
    minutes = clock_minutes("clock")
    home, away = F.col("score_home"), F.col("score_away")
    state = (F.when((F.col("location") == "Home") & (home > away), "Leading")
             .when((F.col("location") == "Home") & (home < away), "Trailing")
             .when((F.col("location") == "Away") & (home > away), "Trailing")
             .when((F.col("location") == "Away") & (home < away), "Leading")
             .otherwise("Tied"))
    axis = (F.when(p <= 4, (F.lit(5) - p) * 12 - (F.lit(12) - F.col("minutes")))
            .otherwise(F.lit(-5) * (p - 4) + F.col("minutes")))
    out = (runs.withColumn("period_label", period_label(p))
           .withColumn("state", state)
           .withColumn("minutes", minutes)
           .withColumn("game_axis", axis))
    if outcomes is not None:
        out = out.join(outcomes.select("game_id", "team", "outcome").distinct(), ["game_id", "team"], "left")
    if titles is not None:
        out = out.join(titles, "game_id", "left")
    if colors is not None:
        out = out.join(colors, "team", "left")
    return out


def foul_calls(plays: DataFrame) -> DataFrame:
    """(P07) fouls from play text: case-blind 'foul', not turnovers or
    flagrants; referee = third '('-piece without its ')'; foul type = second
    and third words with name suffixes removed, upper case."""
    long = unpivot(plays, ["game_id", "event_id"], ["desc_home", "desc_visitor"], "side", "value")
    v = F.col("value")
    f = long.where(v.isNotNull() & v.rlike("(?i)foul") & ~v.contains("Turnover") & ~v.contains("FLAGRANT"))
    f = separate(f, "value", ["__head", None, "__referee"], r"\(")
    f = separate(f, "__head", [None, "__second", "__third"], " ")
    g = F.col("__second")
    for pat in ("Jr.", "Sr.", "III", "Hill"):
        g = replace_first(g, pat, "")
    h = replace_first("__third", "Offensive", "OFFENSIVECHARGE")
    f = unite(f.withColumns({"__second": g, "__third": h}), "__foul", ["__second", "__third"])
    foul = replace_first(F.upper("__foul"), "PERSONALTAKE", "PERSONAL")
    referee = F.regexp_replace("__referee", ".$", "")
    return f.select("game_id", "event_id", referee.alias("referee"), foul.alias("foul_type"))


def game_titles(logs: DataFrame, teams: DataFrame, day=None) -> DataFrame:
    """(P47) 'Home Vs. Away' full-name title per game."""
    rows = logs.where(F.col("game_date") == F.lit(day)) if day is not None else logs
    names = teams.select("team", "full_name").distinct()
    sides = rows.select("game_id", "location", "team").distinct().join(names, "team", "left")
    p = sides.groupBy("game_id").pivot("location", ["H", "A"]).agg(F.max("full_name"))
    return p.select("game_id", F.concat(F.col("H"), F.lit(" Vs. "), F.col("A")).alias("title"))


# Axis breaks and labels of the regulation part of the game chart.
REGULATION_BREAKS = [48, 36, 24, 12, 0]
REGULATION_LABELS = ["1st Quarter", "2nd Quarter", "3rd Quarter", "4th Quarter", "End 4th"]


def game_axis(timeline: DataFrame) -> DataFrame:
    """(P50, O38) per game: the last period played, its label, and the chart
    axis breaks / labels (regulation, then -5 and '<k> OT' per overtime).
    One aggregate per game (periods only grow, so the last is the max)."""
    last = timeline.groupBy("game_id").agg(F.max("period").alias("last_period"))
    ots = F.when(F.col("last_period") > 4, F.sequence(F.lit(1), F.col("last_period") - 4)) \
        .otherwise(F.array().cast("array<bigint>"))
    breaks = F.concat(F.array(*[F.lit(b).cast("bigint") for b in REGULATION_BREAKS]),
                      F.transform(ots, lambda k: k * -5))
    labels = F.concat(F.array(*[F.lit(x) for x in REGULATION_LABELS]),
                      F.transform(ots, lambda k: F.concat(ordinal(k), F.lit(" OT"))))
    return last.select("game_id", "last_period", period_label("last_period").alias("last_period_label"),
                       breaks.alias("axis_breaks"), labels.alias("axis_labels"))
