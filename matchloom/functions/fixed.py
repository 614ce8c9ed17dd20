"""Fixed values of match grading: cut tables, ladders, weights and thresholds that results depend on, and columns over them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.

FINE_GRADES = [
    (95.0, "S+"), (88.0, "S"), (84.0, "S-"), (80.0, "A+"), (76.0, "A"), (72.0, "A-"), (68.0, "B+"), (62.0, "B"), (56.0, "B-"),
    (50.0, "C+"), (44.0, "C"), (38.0, "C-"), (32.0, "D+"), (24.0, "D"),
]
SHADOW_GRADES = [
    (99.0, "S+"), (95.0, "S"), (90.0, "S-"), (82.0, "A+"), (72.0, "A"), (60.0, "A-"), (48.0, "B+"), (36.0, "B"), (26.0, "B-"),
    (18.0, "C+"), (12.0, "C"), (7.0, "C-"), (4.0, "D+"), (2.0, "D"),
]
#: The grade below the last cut of either table.
LOWEST = "D-"
PERCENTILE_GRADES = [(90.0, "S"), (75.0, "A"), (50.0, "B"), (25.0, "C")]
PERCENTILE_POINTS = (0.01, 0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95, 0.99)

#: Users of a cohort: below the first none, then terciles, deciles, full percentiles, and high confidence.
COHORT_USERS = [(300.0, "high-confidence"), (100.0, "full-percent"), (50.0, "decile"), (30.0, "tercile-only")]
LEAST_COHORT = 30
LEAST_BASELINE = 30
SAMPLE_STATUS = [(20.0, "benchmarkEligible"), (10.0, "provisional")]
CONFIDENCE = [(40.0, "high"), (20.0, "medium"), (10.0, "low"), (5.0, "provisional")]

#: Lower rank-point bounds of divisions 4 to 1 (or of a tier without divisions), from which season on, and the mithril bound.
LOW_TIERS = {
    "Iron": (0, 150, 300, 450), "Bronze": (600, 800, 1000, 1200), "Silver": (1400, 1650, 1900, 2150),
    "Gold": (2400, 2700, 3000, 3300), "Platinum": (3600, 3950, 4300, 4650), "Diamond": (5000, 5350, 5700, 6050),
}
LADDERS = {
    1: (
        {
            "Bronze": (1000, 1250, 1500, 1750), "Silver": (2000, 2250, 2500, 2750), "Gold": (3000, 3250, 3500, 3750), "Platinum": (4000, 4250, 4500, 4750),
            "Diamond": (5000, 5250, 5500, 5750),
        },
        6000,
    ),
    3: (
        {
            "Bronze": (800, 1000, 1200, 1400), "Silver": (1600, 1850, 2100, 2350), "Gold": (2600, 2850, 3100, 3350), "Platinum": (3600, 3900, 4200, 4500),
            "Diamond": (4800, 5150, 5500, 5850),
        },
        6200,
    ),
    4: (
        {
            "Bronze": (800, 1000, 1200, 1400), "Silver": (1600, 1850, 2100, 2350), "Gold": (2600, 2900, 3200, 3500), "Platinum": (3800, 4150, 4500, 4850),
            "Diamond": (5200, 5600, 6000, 6400),
        },
        6800,
    ),
    5: (LOW_TIERS | {"Meteorite": (6400,)}, 6800),
    6: (LOW_TIERS | {"Meteorite": (6400,)}, 7000),
    7: (LOW_TIERS | {"Meteorite": (6400,)}, 7100),
    9: (LOW_TIERS | {"Meteorite": (6400,)}, 7200),
    10: (LOW_TIERS | {"Meteorite": (6400, 6650, 6900, 7150)}, 7400),
    11: (LOW_TIERS | {"Meteorite": (6400, 6700, 7000, 7300)}, 7600),
}
#: From which season on: least rank points and first rank of a demigod, last rank of a demigod and of an eternity.
LEADERBOARDS = {
    1: (6200, 201, 700, 200), 3: (6400, 201, 700, 200), 4: (7000, 201, 700, 200), 5: (7500, 201, 700, 200), 6: (7700, 301, 1000, 300), 7: (7800, 301, 1000, 300),
    9: (7900, 301, 1000, 300), 10: (0, 1, 1000, 300), 11: (8300, 1, 1000, 300),
}
#: Grading's keys of the tiers, lowest first, with the current season's lower bounds.
TIER_KEYS = ("iron", "bronze", "silver", "gold", "platinum", "diamond_plus", "meteorite_plus", "mithril_plus")
TIERS = [(7600.0, "mithril_plus"), (6400.0, "meteorite_plus"), (5000.0, "diamond_plus"), (3600.0, "platinum"), (2400.0, "gold"), (1400.0, "silver"), (600.0, "bronze")]
BANDS = {
    "iron": "iron_bronze", "bronze": "iron_bronze", "silver": "silver_gold", "gold": "silver_gold", "platinum": "platinum",
    "diamond_plus": "diamond", "meteorite_plus": "meteorite", "mithril_plus": "mithril",
}
ADJACENT_BANDS = {
    "iron_bronze": ("iron_bronze", "silver_gold"), "silver_gold": ("iron_bronze", "silver_gold", "platinum"), "platinum": ("silver_gold", "platinum", "diamond"),
    "diamond": ("platinum", "diamond", "meteorite"), "meteorite": ("diamond", "meteorite", "mithril"), "mithril": ("meteorite", "mithril"),
}

ROLES = ("평타 딜러", "스증 딜러", "암살자", "평타 브루저", "스증 브루저", "탱커", "서포터")
METRICS = ("damage", "combat", "survival", "vision", "monster")
#: Weights of METRICS by role.
ROLE_WEIGHTS = {
    "평타 딜러": (32, 24, 10, 18, 16), "스증 딜러": (36, 25, 10, 18, 11), "암살자": (30, 32, 10, 18, 10), "평타 브루저": (27, 28, 15, 17, 13),
    "스증 브루저": (30, 29, 15, 17, 9), "탱커": (12, 35, 20, 30, 3), "서포터": (7, 38, 20, 33, 2),
}
PLACEMENT_POINTS = {1: 6.0, 2: 4.0, 3: 2.0, 4: 1.0, 5: -1.0, 6: -2.0, 7: -4.0, 8: -6.0}
EXCELLENCE_POINTS = {1: 2.0, 2: 1.5, 3: 1.0}
DURATION_MIDPOINTS = {"<15": 750.0, "15-20": 1050.0, "20-25": 1350.0, "25-30": 1650.0, "30+": 1950.0}
#: Damage by minute, all roles together.
DAMAGE_CURVE = [(10.0, 0.518732), (15.0, 0.807183), (20.0, 1.079121), (25.0, 1.328282)]
GLOBAL_PRIOR = 64.0065
ROLE_PRIORS = {
    "평타 딜러": 63.3829, "스증 딜러": 64.4096, "암살자": 67.6605, "평타 브루저": 65.1303, "스증 브루저": 63.5631, "탱커": 63.7992, "서포터": 63.6047,
}
#: Weights of a combination with fewer samples than the bound; more weigh 1. Two roles count half as much again.
COMBO_WEIGHTS = [(30, 1000.0), (100, 200.0), (300, 50.0)]
COMBO_ROLES, COMBO_FACTOR = ("탱커", "서포터"), 1.5

#: Bootstrap and train/validation: replicates, seed, bounds of a stable baseline.
BOOTSTRAP_ITERATIONS, BOOTSTRAP_SEED = 500, 391108
BASELINE_CV, ANCHOR_CV, ANCHOR_RATE, ANCHOR_GAP, RANGE_RATIO, LEAST_MEAN = 0.15, 0.2, 0.95, 1e-6, 10.0, 1.0
BASELINE_DRIFT, P90_DRIFT, LEAST_VALIDATION, TRAIN_SHARE = 0.25, 0.3, 30, 0.7
#: Readiness by samples, and for measures that are mostly zero by positive samples too.
READINESS = [(300.0, "ready"), (100.0, "provisional"), (30.0, "experimental")]
POSITIVE_READINESS = [(100.0, "ready"), (30.0, "provisional"), (10.0, "experimental")]
#: Offset and factor of the 32-bit string hash, and the holdout's share.
HASH_OFFSET, HASH_FACTOR, HOLDOUT = 2166136261, 16777619, 5
#: Minutes of a curve's points, and its least match length in seconds.
CURVE_MINUTES, LEAST_SECONDS = (0, 5, 10, 15, 20, 25, 30), 480

#: A metric's gain over the own tier that counts as the best where no higher tier is ahead, by this share of it at least.
RELATIVE_GAINS = {
    "win_rate": 0.3, "top3_rate": 0.2, "placement": 0.15, "kills": 0.3, "assists": 0.2, "team_kills": 0.15, "damage": 0.25, "deaths": 0.2, "vision": 0.25, "monster": 0.2,
}
ELITE_GAP = 0.2
#: Tiers that anchor a metric, in the order in which they are tried.
ELITE_TIER = "in1000"
ELITE_TIERS = ("in1000", "mithril_plus", "meteorite_plus", "diamond_plus", "platinum_plus", "platinum", "gold", "silver", "bronze", "iron")
P4_POINTS = {1: 4.0, 2: 3.0, 3: 2.0, 4: 0.5, 5: -0.5, 6: -2.0, 7: -3.0, 8: -4.0}

#: Keys of raw match JSON that are never looked into, lower-cased.
HIDDEN_KEYS = ("nickname", "usernum", "userid", "uid", "apikey", "x-api-key", "authorization", "token", "accesstoken", "refreshtoken")
#: Parts of a path that make it a role metric.
FIELD_KEYWORDS = (
    "heal", "healing", "healed", "recovery", "recover", "restore", "shield", "barrier", "absorb", "protect", "damageTaken", "damageReceived", "damageReceive",
    "receivedDamage", "damageReduce", "damageMitigation", "damageFrom", "damageTo", "fromPlayer", "fromMonster", "toPlayer", "toMonster", "tank", "cc", "crowd",
    "stun", "slow", "root", "snare", "taunt", "knock", "airborne", "silence", "bind", "assist", "teamKill", "vision", "view",
)
#: Patterns on the lower-cased path; the capital in damageTaken never matches, which is kept.
FIELD_CATEGORIES = {
    "heal": ("heal|healing|healed|recovery|recover|restore",),
    "shield": ("shield|barrier|absorb|protect",),
    "tank": ("damageTaken|damagereceived|damagereceive|receiveddamage|damagereduce|damagemitigation|damagefrom|tank",),
    "cc": ("cc|crowd|stun|slow|root|snare|taunt|knock|airborne|silence|bind",),
    "supportVision": ("assist|teamkill|vision|view",),
}
#: Patterns that must all match, or must not where a minus stands before.
FIELD_MEANINGS = {
    "selfHeal": ("self|own|playerheal|healtoplayer|healself|selfrecovery",),
    "allyHeal": ("ally|team|other|friend|party|teammate|healtoother|healothers|supportheal",),
    "totalHeal": ("total|all|sum|overall", "heal|recovery|restore"),
    "foodHeal": ("food|consumable|item|potion|meal|vf|vfcredit|gainvf",),
    "skillHeal": ("skill|ability|spell|active|passive|ultimate|tactical",),
    "shieldGrant": ("shield|barrier|protect", "-absorb|mitig|reduce|from"),
    "shieldAbsorb": ("absorb|mitig|block|negat", "shield|barrier|protect|damage"),
    "playerDamageTaken": ("fromplayer|playerdamage|damageto", "from|receive|taken"),
    "monsterDamageTaken": ("monster|animal|mob|pve|wild", "damage|from|receive|taken"),
    "totalDamageTaken": ("total|all|sum|overall", "damage|taken|receive"),
    "damageReduced": ("reduce|mitig|decrease|prevent",),
    "preDeathDamage": ("beforedeath|predeath|predmg|last",),
    "survivalTime": ("surviv|lifetime|liveduration|playtime|duration|timealive",),
}

# End of fixed values.


def chosen(key: Column, values: dict, other: Column | None = None) -> Column:
    """The value of a small fixed table at a key."""
    out = reduce(lambda acc, kv: acc.when(key == F.lit(kv[0]), F.lit(kv[1])), list(values.items())[1:], F.when(key == F.lit(next(iter(values))), F.lit(next(iter(values.values())))))
    return out if other is None else out.otherwise(other)


def by_season(season: Column, tables: dict[int, Column]) -> Column:
    """The column of the latest season that is not after the row's; before the first, that of the first."""
    starts = sorted(tables, reverse=True)
    out = F.when(season >= starts[0], tables[starts[0]])
    for s in starts[1:-1]:
        out = out.when(season >= s, tables[s])
    return out.otherwise(tables[starts[-1]])


def ladder_tier(rp: Column, season: Column, rank: Column) -> Column:
    """struct(tier, division, leaderboard) by a season's ladder; the leaderboard's tiers need a rank among the season's players."""

    def one(start: int) -> Column:
        tiers, mithril = LADDERS[start]
        least, first, demigod, eternity = LEADERBOARDS[start]
        label = lambda name, division, board: F.struct(F.lit(name).alias("tier"), F.lit(division).cast("int").alias("division"), F.lit(board).alias("leaderboard"))
        steps = sorted(((low, name, 4 - i if len(lows) > 1 else None) for name, lows in tiers.items() for i, low in enumerate(lows)), reverse=True)
        ranked = rank.isNotNull() & (rank > 0) & (rp >= mithril)
        reach = rp >= F.lit(least)
        # Where the board goes by points they bound both of its tiers, else none.
        out = F.when(rp.isNull() | (rp <= 0), label("Unranked", None, False))
        out = out.when(ranked & reach & (rank <= eternity), label("Eternity", None, True)).when(ranked & reach & rank.between(first, demigod), label("Demigod", None, True))
        out = out.when(rp >= mithril, label("Mithril", None, False))
        for low, name, division in steps:
            out = out.when(rp >= low, label(name, division, False))
        return out.otherwise(label("Unranked", None, False))

    return by_season(season, {s: one(s) for s in LADDERS})

#: Play styles: weights of measures in an axis (a minus: less is better), of axes in a role, and names of axes.
AXIS_MEASURES = {
    "survival": {"-place": 35, "top3": 30, "-deaths": 20, "-bottom": 15},
    "combat": {"damage": 40, "kills": 35, "assists": 25},
    "macro": {"credit_rate": 30, "animals": 30, "seconds": 25, "items": 15},
    "support": {"vision": 75, "involvement": 25},
    "finish": {"wins": 35, "top2": 30, "-place": 20, "late": 15},
    "consistency": {"-place_sd": 40, "-half_gap": 30, "-kda_cv": 30},
}
AXIS_NAMES = {"survival": "생존", "combat": "교전", "macro": "운영", "support": "지원", "finish": "마무리", "consistency": "일관성"}
STYLE_WEIGHTS = {
    "basicAttackDealer": (15, 30, 20, 5, 20, 10), "skillAmpDealer": (15, 30, 20, 5, 20, 10), "bruiser": (25, 25, 20, 10, 10, 10),
    "support": (20, 10, 10, 40, 10, 10), "tank": (30, 10, 15, 30, 5, 10), "assassin": (10, 35, 15, 5, 25, 10),
}
LEAST_STYLE = 3

#: Shadow grades by outcome: points of places 1 to 8 for each candidate, and the gates of role and outcome scores.
OUTCOME_POINTS = {"A": (6.0, 4.5, 3.0, 1.0, -1.0, -3.0, -4.5, -6.0), "B": (8.0, 6.0, 4.0, 1.5, -1.5, -4.0, -6.0, -8.0), "C": (10.0, 7.5, 5.0, 2.0, -2.0, -5.0, -7.5, -10.0)}
S_ROLE_GATE, S_PLUS_ROLE_GATE, S_PLUS_OUTCOME_GATE = 84.0, 96.0, 88.0
OVERALL_GRADES = [(88.0, "S"), (72.0, "A"), (56.0, "B"), (38.0, "C")]
