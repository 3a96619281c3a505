"""Unique slugs within a scope, for whole collections at once.

The first holder (by id) keeps the base, later ones get ``-2``, ``-3`` ...  Generated slugs may meet other
documents' bases; such losers move to their next number until nothing collides, as assigning one by one in id
order would find it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.slugs import MAX_SLUG, limit_length
from .lineage import settled

MAX_ROUNDS, MAX_NUMBER = 50, 999


def numbered_slug(base: Column, number: Column, max_length: int = MAX_SLUG) -> Column:
    """``base`` for number 1, else base and ``-number``, the base cut to make room."""
    suffix = F.concat(F.lit("-"), number.cast("string"))
    room = F.lit(max_length) - F.length(suffix)
    return F.when(number <= 1, limit_length(base, max_length)).otherwise(F.concat(limit_length(base, room), suffix))


def unique_slugs(rows: DataFrame, scope: list[str], base: str = "base", id: str = "id", max_length: int = MAX_SLUG, rounds: int = MAX_ROUNDS) -> DataFrame:
    """``rows`` with ``slug``.  Beyond number 999 the suffix is six letters of the id's hash; a document that loses
    with it hashes its id with the next number, so that ids whose hashes meet part.

    Ranking needs one shuffle on (scope, base).  A round settles all documents that hold their slug alone or
    have the smallest id on it; the others try their next number."""
    rank = F.row_number().over(Window.partitionBy(*scope, base).orderBy(id))

    def slug_of(number: Column) -> Column:
        # the rank itself counts as no try; concat_ws leaves a null out, so the first hash is that of the id alone
        tries = F.when(F.col("_tries") > 0, F.col("_tries").cast("string"))
        hashed = F.concat(limit_length(F.col(base), max_length - 7), F.lit("-"), F.substring(F.sha2(F.concat_ws("#", F.col(id).cast("string"), tries), 256), 1, 6))
        return F.when(number > MAX_NUMBER, hashed).otherwise(numbered_slug(F.col(base), number, max_length))

    out = rows.withColumn("_n", rank).withColumn("_tries", F.lit(0)).withColumn("slug", slug_of(F.col("_n")))
    contest = Window.partitionBy(*scope, "slug").orderBy(F.col("_n") > 1, id)
    for _ in range(rounds):
        judged = out.withColumn("_lost", F.row_number().over(contest) > 1)
        if judged.where("_lost").isEmpty():
            break
        number = F.when(F.col("_lost"), F.col("_n") + 1).otherwise(F.col("_n"))
        tries = F.when(F.col("_lost") & (F.col("_n") > MAX_NUMBER), F.col("_tries") + 1).otherwise(F.col("_tries"))
        out = settled(judged.withColumn("_tries", tries).withColumn("_n", number).withColumn("slug", slug_of(F.col("_n"))).drop("_lost"))
    else:
        raise RuntimeError(f"slugs did not settle in {rounds} rounds")
    return out.drop("_n", "_tries")
