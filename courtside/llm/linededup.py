"""Operator 1: line dedup by a deletion-neighbourhood join, DataFrame functions only.

A line goes when an earlier line (by document id, then line number) equals it
or is one edit away: a character inserted, dropped or replaced, which for lines
of ``MIN_CHARS`` characters or more is a similarity of 0.8 and up.

1. Equal lines fold into one class with its earliest place: an aggregate, so a
   line that many documents share costs a row a task.
2. Two lines one edit apart agree in their first or second half. A class is
   called a candidate if it meets another of fitting length there; all the
   others can have no neighbour, and emit nothing. The half that may differ is
   then cut into ``PIECES``, and a candidate goes on only in a piece such that it
   agrees with another in all but that piece; the same once more with the piece.
   This loses no pair: an edit lies in one piece. Copies of one family that
   differ by more than an edit, which a whole half lets through, end here.
3. Every candidate emits all its variants with one character deleted from the
   piece that may differ, and itself, as hashed keys. A key is made of the hash
   of what stands before and after a block of characters and of the block's
   variant, so a line of n characters costs about n ** 1.5, not n ** 2.
4. Equal variants are joined and the edit distance is verified on the texts.
   Two lines of one length are a replacement apart if they are equal after a
   deletion at one position; lines of n and n + 1 characters are one edit apart
   if a deletion makes the longer the shorter. Each bucket links its members to
   its earliest one (all are neighbours of it), or the undeleted line to its
   earliest deletion and back: one edge a member, never all pairs. A bucket
   holds one line for each character that its open position can take.

Lines are the texts split at ``\\n``. A line without a word is structure, not
content: it always stays. A null text has no lines and stays null; an empty one
is a blank line. A null document id comes first. Rows that repeat an id are told
apart by their text; rows equal in both are one document and fare alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from courtside.llm.common import stored, text_key, unused

MIN_CHARS = 5   # of the longer of two lines one edit apart
PIECES = 4      # into which the text that may differ is cut, twice
PIECE = 3       # characters of a piece at least
BLOCK = 64      # characters at least
_WORD = r"[^\x20\x09-\x0D]"


def _key(doc_id: Column, text: Column) -> Column:
    """128 bits that stand for a document."""
    return F.struct(*text_key(doc_id, text))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, dk (which document), text."""
    doc_id, text = F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`").cast("string")
    return docs.select(doc_id.alias("doc_id"), _key(doc_id, text).alias("dk"), text.alias("text"))


def _lines(docs: DataFrame) -> DataFrame:
    """doc_id, dk, line_no, line of every line with a word."""
    return (docs.select("doc_id", "dk", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
            .where(F.col("line").rlike(_WORD)))


def line_classes(docs: DataFrame) -> DataFrame:
    """One row per distinct line: k1, k2, place (doc_id, dk, line_no), n (its
    characters), and the keys of its halves: as one of n characters (same_head,
    same_tail) and as one of n - 1 (less_head, less_tail)."""
    half = "xxhash64('{0}', {1}, {2}(line, cast({1} as int) div 2))"
    rows = _lines(docs).selectExpr(
        "struct(doc_id, dk, line_no) as place", "xxhash64(line) as k1", "xxhash64('line', line) as k2", "line",
        "char_length(line) as n").selectExpr(
        "place", "k1", "k2", "n", *[f"{half.format(side, long, fn)} as {name}" for name, side, long, fn in (
            ("same_head", "head", "n", "left"), ("same_tail", "tail", "n", "right"),
            ("less_head", "head", "(n - 1)", "left"), ("less_tail", "tail", "(n - 1)", "right"))])
    first = [F.first(c).alias(c) for c in ("n", "same_head", "same_tail", "less_head", "less_tail")]
    return rows.groupBy("k1", "k2").agg(F.min("place").alias("place"), *first)


def candidates(classes: DataFrame) -> DataFrame:
    """k1, role, side, key of the classes that meet another in a half. role
    ``same`` is a line under its own length, ``less`` under one character less;
    pairs are same-same (a replacement) or same-less (an insertion)."""
    emitted = classes.where(f"n >= {MIN_CHARS - 1}").selectExpr(
        "k1", f"""explode(filter(array(struct('same' as role, 'head' as side, same_head as key),
                                       struct('same' as role, 'tail' as side, same_tail as key),
                                       struct('less' as role, 'head' as side, less_head as key),
                                       struct('less' as role, 'tail' as side, less_tail as key)),
                                 x -> n >= {MIN_CHARS} or x.role = 'same')) as e""").select("k1", "e.*")
    # a line may meet only itself, as n - 1 and as n, never under one key: lengths differ
    return emitted.join(_met(emitted), "key").where("twins or mixed").drop("twins", "mixed")


def _met(emitted: DataFrame) -> DataFrame:
    """The keys that two lines of one length share (twins), or two whose lengths
    differ by one (mixed)."""
    return (emitted.groupBy("key").agg(F.count_if(F.col("role") == "same").alias("same"), F.count("role").alias("all"))
            .where("same >= 1 and all >= 2").select("key", (F.col("same") >= 2).alias("twins"), (F.col("all") > F.col("same")).alias("mixed")))


def _parts(found: DataFrame, wide: str) -> DataFrame:
    """The open text of each row (rest; span: its length in the shorter line) cut
    into parts of ``wide`` characters: part, around (the key of all else), left
    (the part's span). A line under its length less one has one character more."""
    return (found.withColumn("w", F.expr(wide))
            .withColumn("part", F.explode(F.expr("sequence(0, greatest(0, cast(ceil(span / w) as int) - 1))")))
            .withColumn("piece", F.expr("substring(rest, part * w + 1, if(role = 'same', w, w + 1))"))
            .withColumn("around", F.expr("xxhash64(key, part, left(rest, part * w), right(rest, greatest(0, span - (part + 1) * w)))"))
            .withColumn("left", F.expr("least(w, span - part * w)")))


def narrowed(found: DataFrame) -> DataFrame:
    """The candidates (columns role, side, key, line, n) in the pieces where they
    agree with another in all else: key, rest, span, twins, mixed, now the piece's."""
    # rest: the half that may differ
    rest = ("case when side = 'head' then substring(line, (m div 2) + 1) else left(line, n - (m div 2)) end")
    opened = (found.withColumn("m", F.expr("if(role = 'same', n, n - 1)")).withColumn("rest", F.expr(rest))
              .withColumn("span", F.expr("m - (m div 2)")))
    for _ in range(2):
        cut = _parts(opened, f"greatest({PIECE}, cast(ceil(span / {PIECES}) as int))").select(
            "k1", "k2", "place", "n", "role", F.col("around").alias("key"), F.col("piece").alias("rest"), F.col("left").alias("span"))
        cut = stored(cut, "line-pieces")
        opened = cut.join(_met(cut), "key").where("twins or mixed")
    return opened


def _variants(pieces: DataFrame) -> DataFrame:
    """k1, k2, place, role (twin, long, short), v: all variant keys of the
    candidates in their open pieces."""
    cut = _parts(pieces, f"greatest({BLOCK}, cast(ceil(sqrt(span)) as int))")
    keep = ["k1", "k2", "place"]
    gone = "concat(left(piece, i), substring(piece, i + 2))"
    each = cut.where("char_length(piece) > 0").withColumn("i", F.explode(F.expr("sequence(0, char_length(piece) - 1)")))
    twin = (each.where(f"role = 'same' and twins and n >= {MIN_CHARS}")
            .selectExpr(*keep, "'twin' as role", f"xxhash64(around, 'twin', i, {gone}) as v"))
    long = each.where("role = 'less'").selectExpr(*keep, "'long' as role", f"xxhash64(around, 'edit', {gone}) as v")
    short = cut.where("role = 'same' and mixed").selectExpr(*keep, "'short' as role", "xxhash64(around, 'edit', piece) as v")
    return twin.union(long).union(short)


def near_lines(classes: DataFrame, docs: DataFrame) -> DataFrame:
    """k1, k2 of the classes of which an earlier class is one edit away."""
    found = stored(candidates(classes), "line-candidates")
    who = classes.join(found.select("k1").distinct(), "k1", "left_semi").select("k1", "k2", "place", "n")
    text = (docs.join(who.select(F.col("place.dk").alias("dk")).distinct(), "dk", "left_semi"))
    spot = who.select("k1", "k2", "n", "place", F.col("place.dk").alias("dk"), F.col("place.line_no").alias("at"))
    lines = stored(spot.join(_lines(text), (spot["dk"] == text["dk"]), "inner").where("at = line_no")
                   .select("k1", "k2", "place", "n", "line").dropDuplicates(["k1", "k2"]), "line-texts")
    v = _variants(narrowed(lines.join(found, "k1")))
    me = F.struct("place", "k1", "k2")
    bucket = Window.partitionBy("v")
    first = F.when(F.col("role") == "twin", F.min(F.when(F.col("role") == "twin", me)).over(bucket)).when(
        F.col("role") == "long", F.min(F.when(F.col("role") == "short", me)).over(bucket)).otherwise(
        F.min(F.when(F.col("role") == "long", me)).over(bucket))
    pairs = (v.withColumn("first", first).where("first.place < place")
             .select("k1", "k2", F.col("first.k1").alias("f1"), F.col("first.k2").alias("f2")).distinct())
    other = lines.select(F.col("k1").alias("f1"), F.col("k2").alias("f2"), F.col("line").alias("earlier"))
    return (pairs.join(lines.select("k1", "k2", "line"), ["k1", "k2"]).join(other, ["f1", "f2"])
            .where(F.levenshtein("line", "earlier", 1) >= 0).select("k1", "k2").distinct())


def line_verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document row: doc_id, dk, n_lines, n_kept, kept_lines (their
    numbers, from 0, ascending)."""
    d = _keyed(docs, id_col, text_col)
    classes = stored(line_classes(d), "line-classes")
    kept = classes.join(near_lines(classes, d), ["k1", "k2"], "left_anti").select("place.dk", "place.line_no")
    kept = kept.groupBy("dk").agg(F.collect_list("line_no").alias("firsts"))  # of one document
    numbers = F.transform(F.split("text", "\n"), lambda x, i: F.when(~x.rlike(_WORD), i))
    blanks = F.filter(numbers, lambda i: i.isNotNull())
    base = d.select("doc_id", "dk", F.coalesce(F.size(F.split("text", "\n")), F.lit(0)).alias("n_lines"), blanks.alias("blanks"))
    none = F.array().cast("array<int>")
    out = base.join(kept, "dk", "left").select(
        "doc_id", "dk", F.when(F.col("n_lines") < 0, 0).otherwise(F.col("n_lines")).cast("long").alias("n_lines"),
        F.array_sort(F.concat(F.coalesce("firsts", none), F.coalesce("blanks", none))).alias("kept_lines"))
    return out.select("doc_id", "dk", "n_lines", F.size("kept_lines").cast("long").alias("n_kept"), "kept_lines")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, with the lines that go taken out."""
    names = docs.columns
    dk, lines = unused(names, "__dk"), unused(names, "__kept")
    verdicts = line_verdicts(docs, id_col, text_col).dropDuplicates(["dk"]).select(F.col("dk").alias(dk), F.col("kept_lines").alias(lines))
    text = F.col(f"`{text_col}`").cast("string")
    own = docs.withColumn(dk, _key(F.col(f"`{id_col}`").cast("long"), text)).join(verdicts, dk)
    left = F.array_join(F.transform(lines, lambda i: F.get(F.split(text, "\n"), i)), "\n")
    return own.select(*[F.when(text.isNotNull(), left).alias(c) if c == text_col else F.col(f"`{c}`") for c in names])
