"""Mixing sources to target weights by capped water-filling, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, written

# The seeded order within a source is cut into 2 ** PIECE_BITS pieces, and the piece where the rest ends into as many
# again, before any row is looked at singly.
PIECE_BITS = 12


def word_count(text: Column) -> Column:
    """Number of runs of characters other than ASCII white space; null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def place(seed: int, key: Column, text: Column) -> Column:
    """Place in the seeded order: the first 60 bits of an MD5 of seed, id and text."""
    whole = F.concat_ws("|", F.lit(str(seed)), F.coalesce(key.cast("string"), F.lit("")), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(whole.cast("binary")), 1, 15), 16, 10).cast("long")


def targets(sources: DataFrame, weights: tuple[float, ...], max_epochs: float) -> DataFrame:
    """Water-filling over (source, source_size): adds weight, cap and target.

    Sources in code-point order, null last, take the weights in turn. With the sources sorted by
    cap/weight, those below the water level stand at their caps and the rest share what remains by
    weight; that closed form is where repeated clamping and redistribution ends. One row per source
    goes through a single window.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    by_level = Window.orderBy("level", F.col("source").isNull(), F.col("source"))
    every = Window.partitionBy()
    s = sources.withColumn("rank", F.row_number().over(by_name) - 1)
    s = s.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int")))
    s = s.withColumn("cap", F.col("source_size") * F.lit(float(max_epochs)))
    s = s.withColumn("level", F.col("cap") / F.col("weight"))
    upto = by_level.rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("total", F.sum("source_size").over(every).cast("double"))
    s = s.withColumn("left", F.col("total") - F.coalesce(F.sum("cap").over(upto), F.lit(0.0)))
    s = s.withColumn("open", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(upto), F.lit(0.0)))
    s = s.withColumn("water", F.when(F.col("left") > 0, F.col("left") / F.col("open")).otherwise(F.lit(0.0)))
    # The first source whose level is above the water fixes the water for itself and all after it.
    s = s.withColumn("final", F.min(F.when(F.col("water") <= F.col("level"), F.struct("level", "water"))).over(every)["water"])
    return s.withColumn("target", F.least("cap", F.coalesce(F.col("weight") * F.col("final"), F.col("cap")))).select("source", "source_size", "weight", "cap", "target")


def mix_sources(
    docs: DataFrame,
    *,
    weights: tuple[float, ...] = (5, 2, 1),
    max_epochs: float = 3,
    seed: int = 17,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """Decide how many words of each document a mix of the sources takes.

    docs: any columns; id_col, text_col and source_col are read. A document's size is its number of
    words. Sources share the total size by weight, none above max_epochs times its own size (targets).
    A source is taken floor(target / size) whole times; the remaining words are taken from its
    documents in a seeded order until they are used up, so that the taken words of a source differ
    from its target by rounding only and a single document is cut.

    Returns all columns of docs and mix_size, mix_source_size (long), mix_target (double), mix_taken
    (long) (clashing names are replaced). Null text: size 0, taken 0. A null source is a source of its
    own. Repeated rows share what is left at the cut evenly. Empty input gives an empty result.

    The order is a seeded hash of id and text. Sums over 4096 ranges of it per source find the range
    where the rest ends, sums over 4096 parts of that range the part; only the rows of that part, one of 16 million,
    are ordered singly, so a hot source neither meets in one task nor is sorted. Texts are not shuffled: they are
    joined to a row per source and to the few rows at the cuts.
    """
    mine = fresh(docs)
    outputs = ["mix_size", "mix_source_size", "mix_target", "mix_taken"]
    cols = [F.col(f"`{c}`") for c in docs.columns if c not in outputs]
    keyed = docs.select(
        *cols,
        F.col(f"`{source_col}`").cast("string").alias(f"{mine}source"),
        word_count(F.col(f"`{text_col}`")).alias(f"{mine}n"),
        place(seed, F.col(f"`{id_col}`"), F.col(f"`{text_col}`")).alias(f"{mine}h"),
    )
    narrow = written(keyed.select(*[F.col(f"{mine}{c}").alias(c) for c in ("source", "n", "h")]), "mix-sizes")
    narrow = narrow.withColumn("piece", F.shiftright("h", 60 - PIECE_BITS)).withColumn("part", F.shiftright("h", 60 - 2 * PIECE_BITS))
    pieces = written(narrow.groupBy("source", "piece").agg(F.sum("n").alias("words")), "mix-pieces")
    plan = targets(pieces.groupBy("source").agg(F.sum("words").alias("source_size")), weights, max_epochs)
    plan = plan.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
    plan = written(plan.withColumn("rest", F.greatest(F.floor(F.col("target") - F.col("whole") * F.col("source_size")).cast("long"), F.lit(0))), "mix-plan")
    piece = _upto(pieces.withColumnRenamed("piece", "at"), plan.select("source", "rest"))
    n = plan.count()  # sources, of which the tables below have a row each
    piece = written(piece, "mix-piece", n)
    inside = _same_source(narrow.where("n > 0"), piece.where("cut is not null").select("source", "cut", "left"), F.col("piece") == F.col("cut"))
    parts = inside.groupBy("source", F.col("part").alias("at")).agg(F.sum("n").alias("words"), F.first("left").alias("rest"))
    part = written(_upto(parts.drop("rest"), piece.where("cut is not null").select("source", F.col("left").alias("rest"))), "mix-part", n)
    # Rows of the last part only, equal ones together.
    rows = _same_source(narrow.where("n > 0"), part.where("cut is not null").select("source", "cut", "left"), F.col("part") == F.col("cut"))
    rows = rows.groupBy("source", "h", "n", "left").agg(F.count("*").alias("copies"))
    order = Window.partitionBy("source").orderBy("h", "n").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("left", F.col("left") - F.coalesce(F.sum(F.col("n") * F.col("copies")).over(order), F.lit(0)))
    extra = F.greatest(F.lit(0), F.least(F.col("n"), F.floor(F.col("left") / F.col("copies")).cast("long")))
    singles = written(rows.select(*[F.col(c).alias(f"{mine}c_{c}") for c in ("source", "h")], extra.alias(f"{mine}extra")), "mix-cut")
    # All parts before `upto` are taken: those of the pieces before the cut one, and of that one those before the cut part.
    first = F.col("done") * (1 << PIECE_BITS)
    ends = _same_source(plan, piece.select("source", first.alias("first")), how="left")
    ends = _same_source(ends, part.select("source", F.col("done").alias("later")), how="left")
    ends = ends.withColumn("upto", F.greatest(F.coalesce("first", F.lit(0)), F.coalesce("later", F.lit(0))))
    ends = written(ends.select(*[F.col(c).alias(f"{mine}p_{c}") for c in ("source", "source_size", "target", "whole", "upto")]), "mix-ends", n)
    out = keyed.join(ends, F.col(f"{mine}source").eqNullSafe(F.col(f"{mine}p_source")), "left")
    at_cut = F.col(f"{mine}source").eqNullSafe(F.col(f"{mine}c_source")) & (F.col(f"{mine}h") == F.col(f"{mine}c_h"))
    out = out.join(singles, at_cut, "left")
    n = F.col(f"{mine}n")
    more = F.when(F.shiftright(f"{mine}h", 60 - 2 * PIECE_BITS) < F.col(f"{mine}p_upto"), n).otherwise(F.coalesce(f"{mine}extra", F.lit(0)))
    taken = F.col(f"{mine}p_whole") * n + more
    return out.select(*cols, n.alias("mix_size"), F.col(f"{mine}p_source_size").alias("mix_source_size"), F.col(f"{mine}p_target").alias("mix_target"), taken.cast("long").alias("mix_taken"))


def _same_source(rows: DataFrame, by: DataFrame, more: Column | None = None, how: str = "inner") -> DataFrame:
    """rows with the columns of a table of one row per source, null being a source too."""
    by = by.withColumnRenamed("source", "own_source")
    same = F.col("source").eqNullSafe(F.col("own_source"))
    return rows.join(by, same if more is None else same & more, how).drop("own_source")


def _upto(sums: DataFrame, rest: DataFrame) -> DataFrame:
    """Per source: done, the first place (at) that isn't wholly taken when `rest` words are taken in order; cut, that place
    if a part of it is taken, and left, how many words of it."""
    before = Window.partitionBy("source").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    s = sums.where("words > 0").withColumn("before", F.coalesce(F.sum("words").over(before), F.lit(0)))
    s = _same_source(s, rest)
    part = (F.col("before") < F.col("rest")) & (F.col("rest") < F.col("before") + F.col("words"))
    whole = F.col("before") + F.col("words") <= F.col("rest")
    return s.groupBy("source").agg(
        F.max(F.when(whole, F.col("at") + 1)).alias("done"),
        F.max(F.when(part, F.col("at"))).alias("cut"),
        F.max(F.when(part, F.col("rest") - F.col("before"))).alias("left"),
    )


def repeated(mixed: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of a mix: each document once per whole repetition, and a cut copy (its first words) for the rest.

    Returns the columns of the mixed table without the mix_ columns; documents with mix_taken 0 go.
    """
    own = fresh(mixed)
    kept = [c for c in mixed.columns if c not in ("mix_size", "mix_source_size", "mix_target", "mix_taken")]
    whole = F.when(F.col("mix_size") > 0, F.floor(F.col("mix_taken") / F.col("mix_size"))).otherwise(F.lit(0)).cast("int")
    part = F.when(F.col("mix_size") > 0, F.col("mix_taken") % F.col("mix_size")).otherwise(F.lit(0)).cast("int")
    copies = F.when(whole + F.signum(part) > 0, F.sequence(F.lit(1), (whole + F.signum(part)).cast("int"))).otherwise(F.array().cast("array<int>"))
    rows = mixed.select("*", whole.alias(f"{own}whole"), part.alias(f"{own}part")).select("*", F.explode(copies).alias(f"{own}copy"))
    text = F.col(f"`{text_col}`")
    cut = F.concat_ws(" ", F.slice(F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != ""), 1, F.greatest(F.col(f"{own}part"), F.lit(1))))
    new = F.when(F.col(f"{own}copy") <= F.col(f"{own}whole"), text).otherwise(cut)
    return rows.select(*[new.alias(c) if c == text_col else F.col(f"`{c}`") for c in kept])
