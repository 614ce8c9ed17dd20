"""Play styles: a player's measures ranked among all players, six axes of them, role fit, and the radar against players of the same tier."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchloom.functions.core import js_round
from matchloom.functions.fixed import AXIS_MEASURES, AXIS_NAMES, LEAST_STYLE, STYLE_WEIGHTS
from matchloom.operators.counted import counted, midrank, numbered, quantile, ranked, with_ranks
from matchloom.sources.facts import PM, player_match
from matchloom.sources.scratch import shared_folder, written

from .registry import query

R4 = "floor(({0}) * 10000 + 0.5) / 10000"
AXES, STYLES = list(AXIS_MEASURES), list(STYLE_WEIGHTS)
#: Each axis' measures as (name, weight, whether more is better).
PARTS = {a: [(m.lstrip("-"), w, m[0] != "-") for m, w in x.items()] for a, x in AXIS_MEASURES.items()}
MEASURES = sorted({m for x in PARTS.values() for m, *_ in x} - {"animals"} | {"monster_damage", "animal_kills"})
ORDER = ["played_at", "game_id", "slot", "part_id", "source_id"]


def _total(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, parts)


def style_matches(spark, sf_dir) -> DataFrame:
    """Matches with credits, vision, damage to monsters and animals, each missing in some, and the style's role of the character, if known.

    Quotients are whole millionths, so that sums do not depend on their order."""
    c = F.col
    kda = F.floor((c("kills") + c("assists")) * 1_000_000 / F.greatest(c("deaths"), F.lit(1)))
    return player_match(spark, sf_dir).select(
        "uid", *ORDER, "placement", "kills", "assists", "deaths", "damage", "duration", "tier", kda.alias("kda"),
        F.when(c("source_id") % 5 != 0, c("part_id") * 7 % 5000).alias("credit"), F.when(c("source_id") % 13 != 0, c("part_id") % 40).alias("seen"),
        F.when(c("uid") % 3 != 0, c("part_id") % 900).alias("monster"), ((c("part_id") + c("source_id")) % 30).alias("animals"),
        F.when(c("team_kills") > 0, F.floor((c("kills") + c("assists")) * 1_000_000 / c("team_kills"))).alias("share"), (c("character_num") % 8).alias("style"),
    )


def style_games(spark, sf_dir) -> DataFrame:
    """What style_players needs of each player's matches in a game: sums, and their places in order. Where matches are dealt out by game nothing is shuffled."""
    c = F.col
    total = lambda v: F.sum(v).alias(f"t_{v}")
    quick = F.floor(c("credit") * 1_000_000 / F.when(c("duration") > 0, c("duration")))
    last = F.struct("slot", "part_id", "source_id")
    x = style_matches(spark, sf_dir).withColumns({"quick": quick, "exact": c("damage").cast("decimal(14,2)"), "place2": c("placement") * c("placement"), "kda2": c("kda") * c("kda")})
    return x.groupBy("uid", "played_at", "game_id").agg(
        F.count(F.lit(1)).alias("n"), F.max_by("tier", last).alias("tier"), F.transform(F.array_sort(F.collect_list(F.struct("slot", "part_id", "source_id", "placement"))), lambda m: m["placement"]).alias("places"),
        *(F.count_if(c("style") == i).alias(f"s{i}") for i in range(len(STYLES))), *map(total, SUMS), *(F.count(v).alias(f"c_{v}") for v in COUNTS),
        *(F.count_if(cond).alias(k) for k, cond in {"top3": c("placement") <= 3, "top2": c("placement") <= 2, "bottom": c("placement") >= 7, "wins": c("placement") == 1}.items()),
    )


SUMS = ["placement", "place2", "deaths", "kills", "assists", "duration", "exact", "credit", "quick", "monster", "animals", "seen", "share", "kda", "kda2"]
COUNTS = ["placement", "deaths", "kills", "assists", "duration", "exact", "credit", "quick", "monster", "animals", "seen", "share", "kda"]


def style_players(spark, sf_dir) -> DataFrame:
    """A row for each player: matches, tier of the last one, matches by style, and MEASURES to four digits (null: none).

    Players are written, as what follows reads them more than once, and so are games; of these only what puts them in order is numbered, to find the game in which a player's newer half
    begins and how many of its matches belong to the older one."""
    c = F.col
    games = written(style_games(spark, sf_dir), "style_games")
    order = ["played_at", "game_id"]
    x = numbered(games.select("uid", *order, "n"), ["uid"], order, shared_folder(spark), "upto", weight="n")
    older = c("total") - F.ceil(c("total") / 2)
    turn = x.where((c("upto") > older) & (c("upto") - c("n") <= older)).select(c("uid").alias("_uid"), *(c(o).alias(f"_{o}") for o in order), (older - c("upto") + c("n")).cast("int").alias("_k"))
    here, there = F.struct(*order), F.struct(*(f"_{o}" for o in order))
    k = F.when(here < there, c("n")).when(here == there, c("_k")).otherwise(0).cast("int")
    x = games.join(turn, c("uid").eqNullSafe(c("_uid"))).withColumn("k", k)
    first = F.slice("places", 1, F.greatest("k", F.lit(1)))
    part = lambda whole, some: F.when(c("k") == c("n"), c(whole)).when(c("k") == 0, F.lit(0)).otherwise(some)
    x = x.withColumns({
        "old_n": part("c_placement", F.size(F.filter(first, lambda p: p.isNotNull()))),
        "old_places": part("t_placement", F.aggregate(first, F.lit(0).cast("long"), lambda a, p: a + F.coalesce(p.cast("long"), F.lit(0).cast("long")))),
    }).drop("places")
    g = x.groupBy("uid").agg(
        F.sum("n").alias("n"), F.max_by("tier", F.struct(*order)).alias("tier"), F.sum("old_n").alias("old_n"), F.sum("old_places").alias("old_places"),
        *(F.sum(v).alias(v) for v in [*(f"s{i}" for i in range(len(STYLES))), *(f"t_{v}" for v in SUMS), *(f"c_{v}" for v in COUNTS), "top3", "top2", "bottom", "wins"]),
    )
    mean = lambda v: c(f"t_{v}") / c(f"c_{v}")
    spread = lambda v, square: F.sqrt((c(f"c_{v}") * c(f"t_{square}") - c(f"t_{v}") * c(f"t_{v}")).cast("double"))
    late = F.try_divide("old_places", "old_n") - F.try_divide(c("t_placement") - c("old_places"), c("c_placement") - c("old_n"))
    measures = {
        "place": mean("placement"), "deaths": mean("deaths"), "kills": mean("kills"), "assists": mean("assists"), "seconds": mean("duration"), "damage": c("t_exact").cast("double") / c("c_exact"),
        "items": mean("credit"), "credit_rate": mean("quick") / 1_000_000, "monster_damage": mean("monster"), "animal_kills": mean("animals"), "vision": mean("seen"), "involvement": mean("share") / 1_000_000,
        "place_sd": spread("placement", "place2") / c("c_placement"), "kda_cv": F.when(c("t_kda") > 0, spread("kda", "kda2") / c("t_kda")).otherwise(0.0), "half_gap": F.coalesce(F.abs(late), F.lit(0.0)),
        **{k: c(k) * 100 / c("n") for k in ("top3", "top2", "bottom", "wins")}, "late": late,
    }
    return written(g.select("uid", "n", "tier", *(f"s{i}" for i in range(len(STYLES))), *(js_round(measures[m], 4).alias(m) for m in MEASURES)), "style_players")


def style_axes(players: DataFrame) -> DataFrame:
    """players with at least LEAST_STYLE matches and their axes: weighted mid-ranks of the measures among all of them, weights shared anew where some are missing.

    Ranks run over the distinct values of a measure."""
    p = players.where(F.col("n") >= LEAST_STYLE)
    values = p.select("uid", F.explode(F.array(*(F.struct(F.lit(i).alias("measure"), F.col(m).alias("v")) for i, m in enumerate(MEASURES)))).alias("m")).select("uid", "m.*")
    r = with_ranks(values, ["measure"], "v").withColumn("rank", midrank(F.col("before"), F.col("n"), F.col("total")))
    # Dealt out by player before they are put side by side, so that a row that travels holds one rank.
    r = r.select("uid", "measure", "rank").repartition("uid").groupBy("uid").agg(*(F.max(F.when(F.col("measure") == i, F.col("rank"))).alias(f"r_{m}") for i, m in enumerate(MEASURES)))
    r = r.withColumn("r_animals", F.coalesce("r_monster_damage", "r_animal_kills"))
    axes = {}
    for a, parts in PARTS.items():
        rank = {m: F.col(f"r_{m}") if more else 100 - F.col(f"r_{m}") for m, _, more in parts}
        there = _total([F.when(F.col(f"r_{m}").isNotNull(), w).otherwise(0) for m, w, _ in parts])
        axes[a] = F.when(there > 0, _total([F.coalesce(rank[m] * w, F.lit(0.0)) for m, w, _ in parts]) / there)
    return written(p.select("uid", "n", "tier", *(f"s{i}" for i in range(len(STYLES)))).join(r.select("uid", *(x.alias(a) for a, x in axes.items())), "uid"), "style_axes")


def _weighted(weights: list) -> Column:
    """The weighted mean of the axes that there are."""
    there = _total([F.when(F.col(a).isNotNull(), w).otherwise(0) for a, w in zip(AXES, weights)])
    return F.when(there > 0, _total([F.coalesce(F.col(a) * w, F.lit(0.0)) for a, w in zip(AXES, weights)]) / there)


# The same in SQL.


def _sql_mean(values: list[tuple[str, str]]) -> str:
    """values: pairs of a nullable SQL value and its weight."""
    there = " + ".join(f"CASE WHEN {v} IS NOT NULL THEN {w} ELSE 0 END" for v, w in values)
    return f"CASE WHEN {there} > 0 THEN ({' + '.join(f'coalesce(({v}) * {w}, 0.0::DOUBLE)' for v, w in values)}) / ({there}) END"


BASE = {
    "place": "sum(placement) / count(*)", "deaths": "sum(deaths) / count(*)", "kills": "sum(kills) / count(*)", "assists": "sum(assists) / count(*)", "seconds": "sum(duration) / count(*)",
    "damage": "CAST(sum(CAST(damage AS DECIMAL(14, 2))) AS DOUBLE) / count(damage)", "items": "sum(credit) / count(credit)", "credit_rate": "sum(floor(credit * 1000000 / duration)) / count(credit) / 1000000",
    "monster_damage": "sum(monster) / count(monster)", "animal_kills": "sum(animals) / count(*)", "vision": "sum(seen) / count(seen)", "involvement": "sum(share) / count(share) / 1000000",
    "top3": "count(*) FILTER (placement <= 3) * 100 / count(*)", "top2": "count(*) FILTER (placement <= 2) * 100 / count(*)", "bottom": "count(*) FILTER (placement >= 7) * 100 / count(*)", "wins": "count(*) FILTER (placement = 1) * 100 / count(*)",
    "place_sd": "sqrt(CAST(count(*) * sum(placement * placement) - sum(placement) * sum(placement) AS DOUBLE)) / count(*)", "kda_cv": "CASE WHEN sum(kda) > 0 THEN sqrt(CAST(count(*) * sum(kda * kda) - sum(kda) * sum(kda) AS DOUBLE)) / sum(kda) ELSE 0 END",
    "late": "sum(placement) FILTER (i <= t - ceil(t / 2.0)) / count(*) FILTER (i <= t - ceil(t / 2.0)) - sum(placement) FILTER (i > t - ceil(t / 2.0)) / count(*) FILTER (i > t - ceil(t / 2.0))",
}
BASE["half_gap"] = f"coalesce(abs({BASE['late']}), 0)"
STYLE_SQL = f"""{PM}, x AS (SELECT *, CAST(floor((kills + assists) * 1000000 / CAST(greatest(deaths, 1) AS DOUBLE)) AS BIGINT) kda, CASE WHEN source_id % 5 <> 0 THEN part_id * 7 % 5000 END credit, CASE WHEN source_id % 13 <> 0 THEN part_id % 40 END seen,
 CASE WHEN uid % 3 <> 0 THEN part_id % 900 END monster, (part_id + source_id) % 30 animals, CASE WHEN team_kills > 0 THEN CAST(floor((kills + assists) * 1000000 / CAST(team_kills AS DOUBLE)) AS BIGINT) END AS share, character_num % 8 style,
 row_number() OVER (PARTITION BY uid ORDER BY {", ".join(ORDER)}) i, count(*) OVER (PARTITION BY uid) t FROM pm),
pl AS (SELECT uid, count(*) n, arg_max(tier, i) tier, {", ".join(f"count(*) FILTER (style = {i}) s{i}" for i in range(len(STYLES)))}, {", ".join(f"{R4.format(BASE[m])} m_{m}" for m in MEASURES)} FROM x GROUP BY 1),
po AS (SELECT * FROM pl WHERE n >= {LEAST_STYLE}),
{", ".join(f"q_{m} AS (SELECT uid, 100.0::DOUBLE * (rank() OVER (ORDER BY m_{m}) - 1 + CAST(count(*) OVER (PARTITION BY m_{m}) AS DOUBLE) / 2) / count(*) OVER () r FROM po WHERE m_{m} IS NOT NULL)" for m in MEASURES)},
rk AS (SELECT uid, po.n, tier, {", ".join(f"s{i}" for i in range(len(STYLES)))}, {", ".join(f"q_{m}.r r_{m}" for m in MEASURES)}, coalesce(q_monster_damage.r, q_animal_kills.r) r_animals FROM po {" ".join(f"LEFT JOIN q_{m} USING (uid)" for m in MEASURES)}),
ax AS (SELECT uid, n, tier, {", ".join(f"s{i}" for i in range(len(STYLES)))}, {", ".join(f"{_sql_mean([(f'r_{m}' if more else f'100 - r_{m}', str(w)) for m, w, more in p])} {a}" for a, p in PARTS.items())} FROM rk)"""


LONG_SQL = " UNION ALL ".join(f"SELECT uid, tier, '{a}' axis, {R4.format(a)} score FROM ax WHERE {a} IS NOT NULL" for a in AXES)


@query(f"WITH {STYLE_SQL}, l AS ({LONG_SQL}), c AS (SELECT tier, axis, {R4.format('median(score)')} cohort_median FROM l GROUP BY 1, 2) SELECT uid, tier, axis, score, cohort_median FROM l JOIN c USING (tier, axis)")
def radar_axes(spark, sf_dir):
    """Each axis of a player beside the median of the players of the same tier."""
    a = style_axes(style_players(spark, sf_dir))
    points = F.explode(F.array(*(F.struct(F.lit(x).alias("axis"), js_round(F.col(x), 4).alias("score")) for x in AXES))).alias("p")
    l = a.select("uid", "tier", points).select("uid", "tier", "p.*").where("score is not null")
    keys = ["tier", "axis"]
    middle = ranked(counted(l, keys, "score"), keys, "score").groupBy(*keys).agg(js_round(quantile("score", 0.5), 4).alias("cohort_median"))
    return l.join(middle, keys).select("uid", "tier", "axis", "score", "cohort_median")


def _sql_list(entries: list[str]) -> str:
    return f"list_sort([x FOR x IN [{', '.join(entries)}] IF x.v IS NOT NULL], 'DESC')"


BLEND_SQL = [f"CASE WHEN {' + '.join(f's{i}' for i in range(len(STYLES)))} = 0 THEN {sum(w[j] for w in STYLE_WEIGHTS.values())} ELSE {' + '.join(f's{i} * {w[j]}' for i, w in enumerate(STYLE_WEIGHTS.values()))} END" for j in range(len(AXES))]
AXIS_LIST = _sql_list([f"{{'v': {R4.format(a)}, 'o': {-i}, 'name': '{AXIS_NAMES[a]}'}}" for i, a in enumerate(AXES)])
FIT_LIST = _sql_list([f"{{'v': {R4.format(_sql_mean(list(zip(AXES, map(str, w)))))}, 's': s{i}, 'o': {-i}, 'name': '{r}'}}" for i, (r, w) in enumerate(STYLE_WEIGHTS.items())])


@query(f"""WITH {STYLE_SQL}, f AS (SELECT uid, n, {FIT_LIST} fits, {AXIS_LIST} scores, floor({_sql_mean([(a, f"({b})") for a, b in zip(AXES, BLEND_SQL)])} + 0.5) overall FROM ax)
SELECT pl.uid, pl.n matches, CASE WHEN fits IS NULL THEN 'insufficient' ELSE 'ok' END status, fits[1].name primary_role, fits[1].v primary_fit, fits[2].name secondary_role, fits[2].v secondary_fit, overall,
 CASE WHEN len(scores) > 0 THEN array_to_string([x.name || CASE WHEN x.v >= 70 THEN ' 우수' ELSE ' 양호' END FOR x IN scores[1:2]], ',') END strengths, CASE WHEN len(scores) > 0 THEN array_to_string([x.name || CASE WHEN x.v < 45 THEN ' 불안정' ELSE ' 보완 필요' END FOR x IN list_reverse(scores)[1:2]], ',') END improvements
FROM pl LEFT JOIN f USING (uid)""")
def play_styles(spark, sf_dir):
    """The report of each player: the two roles that fit best (ties: more matches in it, then order), the overall score by the roles played, and what is strong and weak.

    Fits and axes are compared to four digits. Under LEAST_STYLE matches the report says insufficient."""
    players = style_players(spark, sf_dir)
    c = F.col
    known = _total([c(f"s{i}") for i in range(len(STYLES))])
    blend = [F.when(known == 0, sum(w[j] for w in STYLE_WEIGHTS.values())).otherwise(_total([c(f"s{i}") * w[j] for i, w in enumerate(STYLE_WEIGHTS.values())])) for j in range(len(AXES))]
    fits = F.array(*(F.struct(js_round(_weighted(list(w)), 4).alias("v"), c(f"s{i}").alias("s"), F.lit(-i).alias("o"), F.lit(r).alias("name")) for i, (r, w) in enumerate(STYLE_WEIGHTS.items())))
    scores = F.array(*(F.struct(js_round(c(a), 4).alias("v"), F.lit(-i).alias("o"), F.lit(AXIS_NAMES[a]).alias("name")) for i, a in enumerate(AXES)))
    best = lambda x: F.sort_array(F.filter(x, lambda e: e["v"].isNotNull()), asc=False)
    a = style_axes(players).select("uid", best(fits).alias("fits"), best(scores).alias("scores"), F.floor(_weighted(blend) + F.lit(0.5)).cast("double").alias("overall"))
    names = lambda x, bound, high, low: F.when(F.size(x) > 0, F.array_join(F.transform(F.slice(x, 1, 2), lambda e: F.concat(e["name"], F.when(e["v"] >= bound, high).otherwise(low))), ","))
    fit = lambda i, k: F.get(c("fits"), F.lit(i))[k]
    return players.select("uid", c("n").alias("matches")).join(a, "uid", "left").select(
        "uid", "matches", F.when(c("fits").isNull(), "insufficient").otherwise("ok").alias("status"), fit(0, "name").alias("primary_role"), fit(0, "v").alias("primary_fit"), fit(1, "name").alias("secondary_role"),
        fit(1, "v").alias("secondary_fit"), "overall", names(c("scores"), 70, " 우수", " 양호").alias("strengths"), names(F.reverse("scores"), 45, " 보완 필요", " 불안정").alias("improvements"),
    )
