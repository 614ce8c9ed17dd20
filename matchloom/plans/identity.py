"""Which accounts are one player's."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchloom.operators.identity import clusters
from matchloom.sources.facts import player_match
from matchloom.sources.scratch import shared_folder

from .registry import query


def accounts(spark, sf_dir) -> DataFrame:
    """account, game, place, name, with further accounts that Spark derives from each player's games: nearly all of them (q), all (t),
    two thirds (r), all under another name (s), all at another place (u)."""
    pm = player_match(spark, sf_dir).groupBy("uid", "game_id").agg(F.min("placement").alias("place"))
    g, u = F.col("game_id"), F.col("uid")
    account = lambda kind, name="n", by=0: F.struct(F.concat(F.lit(kind), u).alias("account"), F.concat(F.lit(name), u).alias("name"), (F.col("place") + by).alias("place"))
    derived = F.array(
        account("p"), F.when((u % 3 == 0) & (g % 97 != 0), account("q")), F.when(u % 11 == 0, account("t")), F.when((u % 5 == 0) & (g % 3 != 0), account("r")),
        F.when(u % 7 == 0, account("s", "m")), F.when(u % 13 == 0, account("u", "n", 1)),
    )
    return pm.select(g.alias("game"), F.explode(derived).alias("x")).where("x is not null").select("x.account", "game", "x.place", "x.name")


@query(None)
def identity_clusters(spark, sf_dir):
    """Every account with its owner and how that was settled. Tested against all pairs of a small table."""
    return clusters(accounts(spark, sf_dir), shared_folder(spark))
