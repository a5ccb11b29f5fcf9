"""Stratified block queries over the catalogue, exclusion, availability, categories."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from starloom.functions.scalar import true
from starloom.operators.rules import c
from starloom.sources.scratch import stored

#: Shares of the categories in a balanced catalogue, the largest first (fixed values).
SHARES = {"kg_enanas": 0.30, "af_sp": 0.20, "kg_gigantes": 0.16, "b_calientes": 0.12, "m_frias": 0.12, "halo": 0.10}


def floor() -> Column:
    """The quality that every block asks for."""
    return (c("parallax_over_error") > 5) & (c("flux_over_error") > 50) & c("teff_gspphot").isNotNull() & c("logg_gspphot").isNotNull() & c("ruwe").isNotNull()


@dataclass(frozen=True)
class Block:
    name: str
    where: Column
    order: tuple
    most: int


def blocks(active_sign: int = -1, scale: float = 1.0, hot_width: float = 1.0, cool_width: float = 1.0) -> list[Block]:
    """The blocks in their order of priority.

    active_sign: sign of the width that means emission in cool stars; the widths: how large one has to be.
    """
    t, g, mh, e, ruwe = c("teff_gspphot"), c("logg_gspphot"), c("mh_gspphot"), c("ebpminrp_gspphot"), c("ruwe")
    ew, valid = c("ew_espels_halpha"), c("ew_espels_halpha_flag") == 0
    by = c("source_id")
    n = lambda k: max(1, int(k * scale))
    active = ew < -cool_width if active_sign < 0 else ew > cool_width
    return [
        Block("main_sequence", floor() & (g >= 4.0) & (ruwe < 1.4) & (e < 0.3) & t.between(3000, 40000), (by.asc(),), n(1500)),
        Block("giants", floor() & (g > 0) & (g < 4.0) & (ruwe < 1.4) & t.between(3500, 8000), (by.asc(),), n(800)),
        Block("emission_hot", (t > 7500) & ew.isNotNull() & (ew > hot_width) & valid, (ew.desc(), by.asc()), n(250)),
        Block("high_ruwe", floor() & (ruwe > 1.4) & t.between(4000, 8000), (ruwe.desc(), by.asc()), n(250)),
        Block("metal_poor", floor() & (mh < -1) & (c("phot_g_mean_mag") < 16) & (ruwe < 1.4), (by.asc(),), n(250)),
        Block("active_cool", (t < 4000) & active & valid, (t.asc(), by.asc()), n(250)),
        Block("extinction", floor() & (e > 0.5) & (F.abs(c("b")) > 5) & (ruwe < 1.4) & t.between(4000, 15000), (e.desc(), by.asc()), n(500)),
    ]


def top(df: DataFrame, where: Column, order: tuple, most: int) -> DataFrame:
    """The first ``most`` rows of a condition in a total order; no full sort is needed."""
    return df.where(where).orderBy(*order).limit(most)


def ranged(df: DataFrame, value: Column, ranges: list[tuple[str, float, float, int]], where: Column) -> DataFrame:
    """The first rows of each half-open range in one pass: (label, from, below, most)."""
    label, most = F.lit(None).cast("string"), F.lit(None).cast("int")
    for name, low, high, n in ranges:
        inside = (value >= low) & (value < high)
        label, most = F.when(inside, name).otherwise(label), F.when(inside, n).otherwise(most)
    df = df.where(where).withColumns({"bloque": label, "__most": most}).where(c("bloque").isNotNull())
    rank = F.row_number().over(Window.partitionBy("bloque").orderBy("source_id"))
    return df.withColumn("__n", rank).where((c("__n") <= c("__most")) & (c("__n") <= max(r[3] for r in ranges))).drop("__n", "__most")


def combined(df: DataFrame, parts: list[Block]) -> DataFrame:
    """All blocks by name, each tagged; a star of several blocks stays in the first."""
    out = None
    for k, block in enumerate(parts):
        own = top(df, block.where, block.order, block.most).withColumns({"bloque": F.lit(block.name), "block_no": F.lit(k)})
        out = own if out is None else out.unionByName(own, allowMissingColumns=True)
    first = Window.partitionBy("source_id").orderBy("block_no")
    return out.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")


def excluding(df: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows whose source_id isn't among ``ids``, however many there are."""
    return df.join(ids.select("source_id").distinct(), "source_id", "left_anti")


def among(df: DataFrame, ids: DataFrame) -> DataFrame:
    return df.join(ids.select("source_id").distinct(), "source_id", "left_semi")


def available(df: DataFrame, bprp: bool = False, rvs: bool = False, most: int | None = None) -> DataFrame:
    """Stars with the spectra asked for; the limit comes after."""
    if bprp:
        df = df.where("has_xp")
    if rvs:
        df = df.where("has_rvs")
    return df if most is None else df.orderBy("source_id").limit(most)


def base_conditions(e: DataFrame) -> DataFrame:
    need = ["parallax", "teff_gspphot", "logg_gspphot", "mh_gspphot", "phot_g_mean_mag"]
    return e.where(c("has_rvs") & c("has_xp")).dropna(subset=need)


def category_filters() -> dict[str, Column]:
    """Who may be taken for a category; the edges overlap, other than those of ``category``."""
    t, g, m = c("teff_gspphot"), c("logg_gspphot"), c("mh_gspphot")
    return {
        "kg_enanas": t.between(4000, 6500) & (g >= 3.5) & (m >= -1.0),
        "af_sp": t.between(6500, 10000) & (g >= 3.5),
        "kg_gigantes": t.between(4000, 6500) & (g < 3.5) & (m >= -1.0),
        "b_calientes": t > 10000,
        "m_frias": t < 4000,
        "halo": m < -1.0,
    }


def category() -> Column:
    """The one label of a star; otro where none fits."""
    t, g, m = c("teff_gspphot"), c("logg_gspphot"), c("mh_gspphot")
    return (
        F.when(m < -1.0, "halo").when(t < 4000, "m_frias").when((t >= 4000) & (t < 6500) & (g < 3.5), "kg_gigantes")
        .when((t >= 4000) & (t < 6500) & (g >= 3.5), "kg_enanas").when((t >= 6500) & (t < 10000) & (g >= 3.5), "af_sp")
        .when(t >= 10000, "b_calientes").otherwise("otro")
    )


def targets(total: int) -> dict[str, int]:
    """A total shared out by SHARES, rounded down; the largest category takes what is left."""
    found = {name: int(total * share) for name, share in SHARES.items()}
    found[max(SHARES, key=SHARES.get)] += total - sum(found.values())
    return found


def balanced(df: DataFrame, total: int, request: float = 1.2) -> DataFrame:
    """A catalogue by category: one category after the other takes its brightest stars that no earlier one has
    taken, up to its target out of ``request`` times as many.

    A category looks at no more than the targets before it and its own request, so one scan ranks the names of the stars of
    all categories, another takes the rows of these few, and only they are gone through in turn.
    """
    goal, filters, before, most = targets(total), category_filters(), 0, []
    for name, n in goal.items():
        most.append(F.struct(F.lit(name).alias("chosen"), F.lit(before + int(n * request)).alias("most"), true(filters[name]).alias("fits")))
        before += n
    able = base_conditions(df)
    ranked = lambda rows: rows.withColumn("__n", F.row_number().over(Window.partitionBy("__c.chosen").orderBy("phot_g_mean_mag", "source_id")))
    each = F.explode(F.filter(F.array(*most), lambda x: x["fits"]))
    # first only names and brightness, with a limit that ranks are cut at before they are shuffled; whole rows of the few stars that remain
    names = ranked(able.select("source_id", "phot_g_mean_mag", each.alias("__c"))).where(c("__n") <= before + int(max(goal.values()) * request)).where(c("__n") <= c("__c.most"))
    names = stored(names.select("source_id").distinct(), "balanced-names")
    offered = ranked(able.join(names, "source_id", "left_semi").withColumn("__c", each)).where(c("__n") <= c("__c.most"))
    offered = stored(offered.withColumn("chosen", c("__c.chosen")).drop("__c", "__n"), "balanced")
    taken = None
    for name, n in goal.items():
        own = offered.where(c("chosen") == name)
        if taken is not None:
            own = own.join(F.broadcast(taken.select("source_id")), "source_id", "left_anti")
        own = own.orderBy("phot_g_mean_mag", "source_id").limit(int(n * request)).orderBy("phot_g_mean_mag", "source_id").limit(n).select(*offered.columns)
        taken = stored(own if taken is None else taken.unionByName(own), "balanced")
    return taken
