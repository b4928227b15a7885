"""Building the gazetteer's tiers from label tables: fold, best rank a key, floors, subtractions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkveil.functions.fold import fold_column
from inkveil.functions.lexicon import KEY_PARTICLES, stop_words


@dataclass(frozen=True)
class Floors:
    """Least links by tier; most bearers of a surname (below the cap for short forms, at or above it dropped elsewhere)."""

    full: int = 10
    derived: int = 100
    short: int = 100
    place: int = 30
    place_single: int = 150
    title: int = 10
    settlement: int = 30
    short_bearers: int = 25_000
    demonym_bearers: int = 10_000
    settlement_bearers: int = 10_000
    given_births: int = 1_800


def best(labels: DataFrame) -> DataFrame:
    """``(key, links)``: folded keys with the most links of any label."""
    return labels.select(fold_column(F.col("label")).alias("key"), "links").filter((F.length("key") > 0) & (F.col("links") > 0)).groupBy("key").agg(F.max("links").alias("links"))


def short_forms(key: Column) -> Column:
    """The last word of a name of two or more, and the tails of two and three that a particle leads."""
    words, n = F.split(key, " "), F.size(F.split(key, " "))
    led = lambda k: (n >= k) & F.element_at(words, -k).isin(sorted(KEY_PARTICLES))
    tail = lambda k: F.array_join(F.slice(words, F.lit(-k), F.lit(k)), " ")
    many = n >= 2
    forms = F.array(F.when(many, tail(1)), F.when(many & F.when(n >= 2, led(2)), F.when(n >= 2, tail(2))), F.when(n >= 3, F.when(led(3), tail(3))))
    return F.filter(forms, lambda f: f.isNotNull())


def derived(key: Column) -> Column:
    """First and last of exactly three words without particles; null otherwise."""
    words = F.split(key, " ")
    plain = ~F.exists(words, lambda w: w.isin(sorted(KEY_PARTICLES)))
    return F.when((F.size(words) == 3) & plain, F.concat_ws(" ", F.get(words, 0), F.get(words, 2)))


def labels(entities: DataFrame, classes: DataFrame, subclasses: DataFrame, roots: set[str], least: int = 1, without: set[str] = frozenset(), depth: int = 20) -> DataFrame:
    """``(label, links)`` of the entities in a class below ``roots`` with ``least`` links or more, and in none below ``without``.

    ``entities(id, label, links)``, ``classes(id, class)``, ``subclasses(class, parent)``. The class tree is small; it is
    walked downwards until nothing is added, at most ``depth`` steps. Labels repeat as often as entities have them.
    """

    def below(tops: set[str]) -> DataFrame:
        spark = entities.sparkSession
        found = front = sorted(tops)
        for _ in range(depth):
            front = sorted({r["class"] for r in subclasses.filter(F.col("parent").isin(front)).select("class").distinct().collect()} - set(found)) if front else []
            if not front:
                break
            found = sorted({*found, *front})
        return spark.createDataFrame([(c,) for c in found], "class string")

    wanted = classes.join(below(roots), "class").select("id").distinct()
    out = entities.filter((F.col("links") >= least) & F.col("label").isNotNull()).join(wanted, "id", "left_semi")
    if without:
        out = out.join(classes.join(below(without), "class").select("id").distinct(), "id", "left_anti")
    return out.select("label", "links")


def build(
    humans: DataFrame, places: DataFrame, titles: DataFrame, demonyms: DataFrame, settlements: DataFrame, census: DataFrame, births: DataFrame, floors: Floors = Floors(),
) -> DataFrame:
    """``(tier, key)``. Labels are ``(label, links)``, ``census(name, bearers)``, ``births(name, births)``.

    The order matters: given names come before demonyms and settlements, places before settlements.
    """
    people = best(humans)
    full = people.filter(F.col("key").contains(" ")).select("key")
    full = full.unionByName(people.filter(F.col("links") >= floors.derived).select(derived(F.col("key")).alias("key")).filter("key is not null")).distinct()
    bearers = census.select(F.col("name").alias("key"), "bearers")

    def rare(keys: DataFrame, cap: int) -> DataFrame:
        return keys.join(bearers, "key", "left").filter(F.coalesce("bearers", F.lit(0)) < cap).select("key")

    short = rare(people.filter(F.col("links") >= floors.short).select(F.explode(short_forms(F.col("key"))).alias("key")).distinct(), floors.short_bearers)
    floor = F.when(F.col("key").contains(" "), floors.place).otherwise(floors.place_single)
    place = best(places).filter(F.col("links") >= floor).select("key")
    given = births.filter((F.col("births") >= floors.given_births) & (F.length("name") >= 2) & ~F.col("name").rlike("[-']")).select(F.col("name").alias("key")).distinct()
    ordinary = F.forall(F.split("key", " "), lambda w: w.isin(sorted(stop_words())))
    title = best(titles).filter((F.col("links") >= floors.title) & F.col("key").contains(" ") & ~ordinary).select("key")
    named = lambda labels, least: best(labels).filter(F.col("links") >= least).select("key").join(given, "key", "left_anti")
    demonym = rare(named(demonyms, 1), floors.demonym_bearers)
    settlement = rare(named(settlements, floors.settlement), floors.settlement_bearers).join(place, "key", "left_anti")
    out = None
    for tier, keys in (("full", full), ("short", short), ("place", place), ("given", given), ("title", title), ("demonym", demonym), ("settlement", settlement)):
        rows = keys.select(F.lit(tier).alias("tier"), "key")
        out = rows if out is None else out.unionByName(rows)
    return out
