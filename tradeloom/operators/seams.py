"""Text search over pieces that count as one joined text, without joining them.

The pieces of a key, in order and with a blank between neighbours, form a text that may be
longer than any task should hold. What occurs in it either lies inside one piece, or
begins in one and runs over the blanks behind it. So each piece gets the beginnings of the few
that follow, no longer than the longest text searched for; together with its own end they
make up every place where a seam can be crossed. Neighbours meet by their numbers, so the
pieces of a hot key spread over all tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tradeloom.operators.ranking import number_rows


def seams(pieces: DataFrame, key: str, position: str, text: str, *, longest: int, blanks: int) -> DataFrame:
    """``key`` and ``text``: for each piece the text around the seam behind it.

    Every part of the joined text that begins in a piece, crosses a seam, and has at most
    ``longest`` characters, ``blanks`` of them blanks, lies in one of these texts; and each of them is
    a part of the joined text. ``position`` orders the pieces of a key and is unique there.
    """
    numbered = number_rows(pieces.select(key, position, text), [key], position)
    end = F.expr(f"right({text}, {longest - 1})")
    sent = numbered.select(
        key, "number", F.explode(F.sequence(F.lit(0), F.lit(blanks))).alias("back"),
        end.alias("end"), F.left(F.col(text), F.lit(longest)).alias("beginning"),
    ).select(
        key, (F.col("number") - F.col("back")).alias("number"), "back",
        F.when(F.col("back") == 0, F.col("end")).otherwise(F.col("beginning")).alias("part"),
    )
    met = sent.groupBy(key, "number").agg(
        F.array_sort(F.collect_list(F.struct("back", "part"))).alias("parts"),
        F.max(F.when(F.col("back") == 0, F.length("part"))).alias("own"),
    )
    joined = F.array_join(F.transform("parts", lambda p: p.part), " ")
    # Numbers before a key's first piece have no end of their own.
    return met.where("own IS NOT NULL").select(key, F.left(joined, F.col("own") + longest - 1).alias(text))
