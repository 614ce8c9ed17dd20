"""Identity clusters: accounts that stand for one player because nearly all of their games are the same.

Accounts with the very same games are joined through a digest of their list, so copies make no pairs. Between different
lists, candidates come from a prefix filter: an account's games are put in order from the least to the most crowded, and
two lists that share enough games must share one among the first few of each; crowded games are hardly ever among these.
Candidates are then counted exactly. Links are joined into components by passing on the least account, round by round,
each round a written table. A pair that shares enough games but contradicts itself (another name, or another place in a
shared game) is no link, and a component that holds such a pair has no owner.

Rows without account or game have no part; repeated rows count once. An empty table gives no rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .counted import numbered


def required(n: Column) -> Column:
    """Games that a list of n must share with another: all of up to 15, else 99 %, half at least."""
    half = F.when(n <= 100, F.greatest(F.lit(7), F.floor(n * F.lit(0.5)))).otherwise(F.greatest(F.lit(50), F.floor(n * F.lit(0.5))))
    return F.when(n <= 15, n).otherwise(F.greatest(half, F.floor(n * F.lit(0.99)))).cast("long")


def slack(n: Column) -> Column:
    """By how many games two such lists may differ in length."""
    return F.when(n <= 20, F.lit(2)).otherwise(F.greatest(F.lit(10), F.floor(n * F.lit(0.05)))).cast("long")


def _written(df: DataFrame, folder: str, name: str) -> DataFrame:
    df.write.parquet(f"{folder}/{name}")
    return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/{name}")


def lists(games: DataFrame, folder: str) -> DataFrame:
    """account, name, n, rep: games of each account, and the least account with the very same name and places in games."""
    mark = F.xxhash64("game", "place")
    a = games.groupBy("account").agg(
        F.first("name", ignorenulls=True).alias("name"), F.count(F.lit(1)).alias("n"), F.sum(mark.cast("decimal(38,0)")).alias("h1"), F.sum(F.xxhash64(mark, F.lit(7)).cast("decimal(38,0)")).alias("h2")
    )
    key = ["n", "h1", "h2"]
    reps = a.groupBy("name", *key).agg(F.min("account").alias("rep")).withColumnRenamed("name", "rep_name")
    return _written(a.join(reps, key).where(F.col("name").eqNullSafe(F.col("rep_name"))).select("account", "name", "n", "rep"), folder, "lists")


def pairs(games: DataFrame, reps: DataFrame, folder: str) -> DataFrame:
    """a, b, shared, clashes: different lists of like length that share enough games, and in how many of them they are at different places."""
    own = games.join(reps.select("account", "n"), "account").select("account", "game", "place", "n")
    crowd = own.groupBy("game").agg(F.count(F.lit(1)).alias("crowd"))
    numbers = numbered(own.join(crowd, "game").select("account", "game", "n", "crowd"), ["account"], ["crowd", "game"], folder)
    first = _written(numbers.where(F.col("number") <= F.col("n") - required(F.col("n")) + 1).select("account", "game", "n"), folder, "first")
    a, b = first.alias("a"), first.alias("b")
    like = F.abs(F.col("a.n") - F.col("b.n")) <= slack(F.greatest(F.col("a.n"), F.col("b.n")))
    found = a.join(b, (F.col("a.game") == F.col("b.game")) & (F.col("a.account") < F.col("b.account")) & like)
    candidates = _written(found.select(F.col("a.account").alias("a"), F.col("b.account").alias("b"), F.greatest("a.n", "b.n").alias("n")).distinct(), folder, "candidates")
    left = candidates.join(own.select(F.col("account").alias("a"), "game", F.col("place").alias("pa")), "a")
    both = left.join(own.select(F.col("account").alias("b"), "game", F.col("place").alias("pb")), ["b", "game"])
    counts = both.groupBy("a", "b", "n").agg(F.count(F.lit(1)).alias("shared"), F.count_if(~F.col("pa").eqNullSafe(F.col("pb"))).alias("clashes"))
    return counts.where(F.col("shared") >= required(F.col("n"))).drop("n")


def components(links: DataFrame, folder: str) -> DataFrame:
    """node, root: the least node of each node's component. Each round a node takes the least root among its neighbours', and then its root's root."""
    both = _written(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), folder, "links")
    roots = _written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.min("a")).alias("root")), folder, "roots0")
    for i in range(1, 1000):
        near = both.join(roots.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        step = roots.join(near, "node").select("node", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        jump = roots.select(F.col("node").alias("root"), F.col("root").alias("above"))
        new = _written(step.join(jump, "root", "left").select("node", "old", F.least("root", F.coalesce("above", "root")).alias("root")), folder, f"roots{i}")
        roots = new.select("node", "root")
        if new.where("old <> root").isEmpty():
            return roots
    raise RuntimeError("components did not settle")


def clusters(rows: DataFrame, folder: str) -> DataFrame:
    """account, owner, status of every account; rows: account, game, place, name.

    status: alone, canonical, alias, conflict (its component holds a contradiction) or tied (the two best lists of the
    component have as many games and are not the same, so that none is the owner's)."""
    games = _written(rows.where("account is not null and game is not null").groupBy("account", "game").agg(F.min("place").alias("place"), F.min("name").alias("name")), folder, "games")
    known = lists(games, folder)
    reps = _written(known.where("account = rep").select("account", "name", "n"), folder, "reps")
    near = pairs(games, reps, folder).join(reps.select(F.col("account").alias("a"), F.col("name").alias("na")), "a").join(reps.select(F.col("account").alias("b"), F.col("name").alias("nb")), "b")
    near = _written(near.select("a", "b", ((F.col("clashes") > 0) | ~F.col("na").eqNullSafe(F.col("nb"))).alias("apart")), folder, "near")
    roots = components(near.where("not apart"), folder)
    of = reps.join(roots.withColumnRenamed("node", "account"), "account", "left").select("account", "n", F.coalesce("root", "account").alias("root"))
    apart = near.where("apart").join(of.select(F.col("account").alias("a"), F.col("root").alias("ra")), "a").join(of.select(F.col("account").alias("b"), F.col("root").alias("rb")), "b")
    broken = apart.where("ra = rb").select(F.col("ra").alias("root")).distinct().withColumn("broken", F.lit(True))
    # The two longest lists of a component settle its owner; sums of counts keep it a plain aggregate.
    best = of.groupBy("root").agg(F.max("n").alias("most"), F.count(F.lit(1)).alias("lists"))
    top = of.join(best, "root").where("n = most").groupBy("root").agg(F.min("account").alias("owner"), F.count(F.lit(1)).alias("best"))
    verdict = best.join(top, "root").join(broken, "root", "left").select("root", "lists", "owner", "best", F.coalesce("broken", F.lit(False)).alias("broken"))
    all_of = known.join(of.select(F.col("account").alias("rep"), "root"), "rep").join(verdict, "root")
    members = known.groupBy("rep").agg(F.count(F.lit(1)).alias("copies"))
    x = all_of.join(members, "rep")
    alone = (F.col("lists") == 1) & (F.col("copies") == 1)
    status = F.when(F.col("broken"), "conflict").when(F.col("best") > 1, "tied").when(alone, "alone").when(F.col("account") == F.col("owner"), "canonical").otherwise("alias")
    return x.select("account", F.when(~F.col("broken") & (F.col("best") == 1), F.col("owner")).alias("owner"), status.alias("status"))
