"""Music-catalogue pipelines, computed for every artist at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courtside.operators.core import first_per_key, share_of_total

# Album-name fragments that mark non-studio releases.
NON_STUDIO = ["Live In", "Concert", "Live", "Commentary", "Instrumentals"]
NON_STUDIO_PATTERN = "|".join(NON_STUDIO)


def studio_tracks(tracks: DataFrame, pattern: str = NON_STUDIO_PATTERN, album: str = "album") -> DataFrame:
    """(P51) drop tracks whose album name matches ``pattern`` (regex)."""
    return tracks.where(~F.col(album).rlike(pattern))


def song_count(tracks: DataFrame) -> DataFrame:
    """(P52) distinct track names per artist."""
    return tracks.groupBy("artist").agg(F.count_distinct("track").alias("songs"))


def album_count(tracks: DataFrame) -> DataFrame:
    """(P52) distinct albums per artist."""
    return tracks.groupBy("artist").agg(F.count_distinct("album").alias("albums"))


def artist_statistics(tracks: DataFrame) -> DataFrame:
    """(P53) per artist: mean positivity (valence x 100) and energy x 100,
    1 dp, with song and album counts. Rows fold into (artist, album, track)
    first, so the distinct counts run over tracks and not over copies of every
    row; sums are decimals, so their order does not matter."""
    def total(c):
        return F.sum((F.col(c) * 100).cast("decimal(18,6)"))

    tracks = tracks.groupBy("artist", "album", "track").agg(
        total("valence").alias("v"), F.count("valence").alias("nv"), total("energy").alias("e"), F.count("energy").alias("ne"))

    def mean(s, n):
        return F.round(F.try_divide(F.sum(s), F.sum(n).cast("decimal(20,0)")), 1).cast("double")

    return tracks.groupBy("artist").agg(
        mean("v", "nv").alias("positivity"), mean("e", "ne").alias("energy"),
        F.count_distinct("track").alias("songs"), F.count_distinct("album").alias("albums"))


def album_timeline(tracks: DataFrame) -> DataFrame:
    """(P54) distinct (artist, album, release date), in date order per artist."""
    return tracks.select("artist", "album", "release_date").distinct().orderBy("artist", "release_date", "album")


def artist_search(artists: DataFrame, text: str) -> DataFrame:
    """(P55) artists whose name contains ``text`` (case-blind), one row per
    name: the most popular (ties: lowest id), most popular first, with the
    second of its images (null when there are fewer). Artists without a column
    of images are found without an image."""
    hits = artists.where(F.lower("artist_name").contains(text.lower()))
    images = ["images"] if "images" in artists.columns else []
    best = first_per_key(hits.select("artist_name", "artist_id", "popularity", *images), "artist_name",
                         [F.col("popularity"), -F.col("artist_id")])
    return best.select("artist_id", "artist_name", "popularity", *[F.get(c, F.lit(1))["url"].alias("image") for c in images]
                       ).orderBy(F.col("popularity").desc(), "artist_id")


def mood_quadrants(tracks: DataFrame, cut: float = 0.5) -> DataFrame:
    """(P56) tracks per (artist, album) in the four valence/energy quadrants,
    with the share of the album's tracks."""
    hi_v, hi_e = F.col("valence") >= cut, F.col("energy") >= cut
    quad = (F.when(hi_v & hi_e, "Happy / Upbeat")
            .when(hi_v & ~hi_e, "Mellow / Peaceful")
            .when(~hi_v & ~hi_e, "Sad / Slow")
            .when(~hi_v & hi_e, "Aggressive / Fast Paced"))
    counts = (tracks.groupBy("artist", "album", quad.alias("quadrant"))
              .agg(F.count(F.lit(1)).alias("n")))
    return share_of_total(counts, "n", ["artist", "album"], "share")
