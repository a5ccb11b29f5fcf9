"""Anchors, spectral classes and confidence rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starloom.functions.scalar import present, true
from starloom.operators.rules import c

#: Lower temperature of each spectral letter, in falling order.
LETTERS = {"O": 30000.0, "B": 10000.0, "A": 7500.0, "F": 6000.0, "G": 5200.0, "K": 3700.0, "M": None}
TEFF_EDGES, TEFF_NEAR = [30000.0, 10000.0, 7500.0, 6000.0, 5200.0, 3700.0], 200.0
LOGG_EDGES, LOGG_NEAR = [1.5, 2.5, 3.5, 3.9], 0.2
CHEMISTRY_EDGES, CHEMISTRY_NEAR = [-0.2, -1.0], 0.1
#: Population names of the first anchors, and how they are shown later.
POPULATIONS = {"Disco Fino": "Thin Disk", "Disco Grueso": "Thick Disk", "Halo": "Halo"}
#: From, below and label of the subtype bins of each letter; A ends at 9800.
SUBTYPES = {
    "O": [(60000, 1e9, "0-1"), (45000, 60000, "2-3"), (35000, 45000, "4-6"), (30000, 35000, "7-9")],
    "B": [(25000, 30000, "0-1"), (18000, 25000, "2-3"), (13000, 18000, "4-6"), (10000, 13000, "7-9")],
    "A": [(9000, 9800, "0-1"), (8400, 9000, "2-3"), (7900, 8400, "4-6"), (7500, 7900, "7-9")],
    "F": [(7200, 7500, "0-1"), (6900, 7200, "2-3"), (6500, 6900, "4-5"), (6200, 6500, "6-7"), (6000, 6200, "8-9")],
    "G": [(5800, 6000, "0-1"), (5600, 5800, "2-3"), (5450, 5600, "4-5"), (5300, 5450, "6-7"), (5200, 5300, "8-9")],
    "K": [(5000, 5200, "0-1"), (4700, 5000, "2-3"), (4300, 4700, "4-5"), (4000, 4300, "6-7"), (3700, 4000, "8-9")],
    "M": [(3400, 3700, "0-1"), (3100, 3400, "2-3"), (2800, 3100, "4-5"), (0, 2800, "6-9")],
}
#: Cool and hot end of each letter.
ENDS = {"O": (30000, 100000), "B": (10000, 30000), "A": (7500, 10000), "F": (6000, 7500), "G": (5200, 6000), "K": (3700, 5200), "M": (2400, 3700)}


def letter(teff: Column, b_from: float = 10000.0) -> Column:
    """Spectral letter of a temperature; b_from: where B begins."""
    found = F.when(teff >= LETTERS["O"], "O").when(teff >= b_from, "B")
    for name in "AFGK":
        found = found.when(teff >= LETTERS[name], name)
    return found.when(teff.isNotNull(), "M")


def bin_right_closed(teff: Column) -> Column:
    """(0, 3700] M, ... (10000, 100000] OB; NULL outside."""
    found = F.when((teff <= 0) | (teff > 100000), None)
    for top, name in ((3700, "M"), (5200, "K"), (6000, "G"), (7500, "F"), (10000, "A")):
        found = found.when(teff <= top, name)
    return found.when(teff.isNotNull(), "OB")


def near(value: Column, edges: list[float], by: float) -> Column:
    found = F.lit(False)
    for edge in edges:
        found = found | (F.abs(value - F.lit(edge)) <= F.lit(by))
    return true(found)


def with_population(df: DataFrame) -> DataFrame:
    """chemistry_value, chemistry_source, population_group, decision_rule from the physical columns."""
    spectroscopic = true(c("fe_h") != 0)
    df = df.withColumn("chemistry_value", F.when(spectroscopic, c("fe_h")).otherwise(c("metallicity")))
    fast = true(c("is_high_velocity") & c("is_reliable_parallax") & c("v_tan").isNotNull())
    chem, alpha = c("chemistry_value"), c("alpha_fe")
    enhanced = true((alpha >= 0.2) & (chem >= -1.0) & (chem < -0.2))
    population = F.when(fast, "Halo").when(enhanced, "Disco Grueso").when(chem < -1.0, "Halo").when(chem < -0.2, "Disco Grueso").otherwise("Disco Fino")
    source = F.when(fast, "kinematics_override").when(spectroscopic, "fe_h").otherwise("metallicity_fallback")
    rule = (
        F.when(fast, "is_high_velocity=True")
        .when(enhanced, F.format_string("alpha_fe=%.2f>=0.2 AND chemistry=%.3f in [-1.0,-0.2)", alpha, chem))
        .when(chem < -1.0, F.format_string("chemistry=%.3f < -1.0", chem))
        .when(chem < -0.2, F.format_string("chemistry=%.3f in [-1.0,-0.2)", chem))
        .otherwise(F.format_string("chemistry=%.3f >= -0.2", chem))
    )
    return df.withColumns({"population_group": population, "chemistry_source": source, "decision_rule": rule})


def anchored(df: DataFrame) -> DataFrame:
    """Anchor columns over a judged catalogue; defaults 5000 K, metallicity 0, quality 1."""
    df = df.withColumns({
        "teff_k": F.coalesce("teff_k", F.lit(5000)), "metallicity": F.coalesce("mh_gspphot", F.lit(0.0)), "fe_h": c("fem_gspspec"),
        "alpha_fe": c("alphafe_gspspec"), "logg": c("logg_gspphot"), "quality_score": F.coalesce("quality_score", F.lit(1.0)),
    })
    df = with_population(df).withColumn("mk_letter", letter(c("teff_k")))
    return df.withColumns({
        "near_teff_boundary": near(c("teff_k").cast("double"), TEFF_EDGES, TEFF_NEAR),
        "near_logg_boundary": near(c("logg"), LOGG_EDGES, LOGG_NEAR),
        "near_chemistry_boundary": near(c("chemistry_value"), CHEMISTRY_EDGES, CHEMISTRY_NEAR),
    })


def hot_correction(df: DataFrame) -> DataFrame:
    """B of 9700 to 10100 K with logg from 3.8 on becomes A; the flag tells of a change."""
    change = true((c("teff_k") >= 9700) & (c("teff_k") < 10100) & (c("mk_letter") == "B") & (c("logg") >= 3.8))
    return df.withColumns({"mk_before": c("mk_letter"), "ab_boundary_logg_corrected": change, "mk_letter": F.when(change, "A").otherwise(c("mk_letter"))})


def translated(df: DataFrame) -> DataFrame:
    """Names of populations for readers; unknown ones stay."""
    out = c("population_group")
    for name, shown in POPULATIONS.items():
        out = F.when(c("population_group") == name, shown).otherwise(out)
    return df.withColumns({"population_before": c("population_group"), "population_group": out})


def corrected(df: DataFrame, version: str = "7") -> DataFrame:
    """Correction, translation, version stamp, and audit columns."""
    df = translated(hot_correction(df)).withColumn("anchor_version", F.lit(version))
    return df.withColumn("was_translated", c("population_before") != c("population_group"))


def _bin(mk: Column, teff: Column) -> Column:
    """The row of SUBTYPES that holds a letter's temperature; NULL in the gaps. The inputs are named once, however many bins there are."""
    rows = [F.struct(F.lit(name).alias("mk"), F.lit(float(low)).alias("low"), F.lit(float(high)).alias("high"), F.lit(label).alias("label")) for name, bins in SUBTYPES.items() for low, high, label in bins]
    inside = F.transform(F.array(F.struct(mk.alias("mk"), teff.cast("double").alias("t"))), lambda s: F.get(F.filter(F.array(*rows), lambda x: (x["mk"] == s["mk"]) & (x["low"] <= s["t"]) & (s["t"] < x["high"])), F.lit(0)))
    return F.get(inside, F.lit(0))


def subtype(mk: Column, teff: Column) -> Column:
    """Subtype bin of a letter's temperature; NULL in the gaps."""
    return _bin(mk, teff)["label"]


def subtype_midpoint(mk: Column, teff: Column) -> Column:
    found = _bin(mk, teff)
    return (found["low"] + found["high"]) / 2


def interpolated(mk: Column, digits: Column) -> Column:
    """Temperature at a mean subtype digit 0 to 9 of a letter: the hot end at 0, the cool end at 9."""
    found = F.lit(None).cast("double")
    for name, (low, high) in ENDS.items():
        found = F.when(mk == name, high - digits / 9.0 * (high - low)).otherwise(found)
    return found


def luminosity(logg: Column, last: float = 4.0) -> Column:
    return F.when(logg < 1.5, "I").when(logg < 2.5, "II").when(logg < 3.5, "III").when(logg < last, "IV").when(logg.isNotNull(), "V")


def magnitude_agrees(cls: Column, mag: Column) -> Column:
    """Whether the absolute magnitude fits the luminosity class; NULL without either."""
    return F.when(cls.isin("I", "II"), mag < 0).when(cls == "III", (mag >= 0) & (mag < 3)).when(cls == "IV", (mag >= 3) & (mag < 4.5)).when(cls == "V", mag >= 4.5)


def ceiling(quality: Column, binary: Column) -> Column:
    top = F.when(quality >= 0.8, 1.0).when(quality >= 0.5, 0.85).when(quality >= 0.1, 0.6).otherwise(0.3)
    return top - F.when(binary, 0.15).otherwise(0.0)


def deductions(agrees: Column) -> Column:
    """Sum of what lowers the confidence in an anchor."""
    parts = [
        (c("near_teff_boundary"), 0.10), (c("near_logg_boundary"), 0.10), (true(~agrees), 0.05), (c("abs_mag").isNull(), 0.05),
        (c("chemistry_source") == "metallicity_fallback", 0.10), (c("near_chemistry_boundary"), 0.20), (c("alpha_fe").isNull(), 0.05), (c("quality_score") < 0.5, 0.05),
    ]
    total = F.lit(0.0)
    for when, by in parts:
        total = total + F.when(when, by).otherwise(0.0)
    return total


def confidence(df: DataFrame) -> DataFrame:
    """luminosity_class, confidence by ceiling and deductions, and by the shorter later rule."""
    df = df.withColumn("luminosity_class", luminosity(c("logg")))
    agrees = magnitude_agrees(c("luminosity_class"), c("abs_mag"))
    df = df.withColumns({"magnitude_agrees": agrees, "confidence": F.greatest(F.lit(0.0), ceiling(c("quality_score"), c("is_binary_candidate")) - deductions(agrees))})
    late = F.when(c("is_binary_candidate"), F.greatest(F.lit(0.0), c("quality_score") - 0.10)).otherwise(c("quality_score"))
    late = late * F.when(c("near_teff_boundary"), 0.9).otherwise(1.0)
    return df.withColumn("spectral_confidence", late).withColumn("luminosity_confidence", c("spectral_confidence") * F.when(c("near_logg_boundary"), 0.9).otherwise(1.0))


#: The sentence for each flag, with the column whose value it takes.
FEATURES = {
    "is_binary_candidate": ("ruwe", "Binary candidate flagged by RUWE=%.2f; physical parameters (Teff, logg, chemistry) may reflect flux contamination from an unresolved companion, and the spectral classification should be treated with corresponding caution."),
    "has_emission": ("ew_espels_halpha", "H-alpha emission detected (EW=%.2f Å, ESP-ELS); consistent with chromospheric activity, a Be-type disk, or an active stellar phenomenon."),
    "is_metal_poor": ("chemistry_value", "Metal-poor star ([Fe/H]≈%.2f dex); the sub-solar chemistry is consistent with membership in an old stellar population."),
    "is_high_velocity": ("v_tan", "High tangential velocity (v_tan=%.2f km/s); this kinematic outlier strongly supports Halo membership regardless of photometric metallicity."),
}


def features(df: DataFrame) -> DataFrame:
    """notable_features: a sentence for each set flag, or "None identified."."""
    found = present(*[F.when(c(flag), F.format_string(text, F.coalesce(c(value), F.lit(0.0)))) for flag, (value, text) in FEATURES.items()])
    return df.withColumn("notable_features", F.when(F.size(found) == 0, "None identified.").otherwise(F.concat_ws(" ", found)))


def warnings(df: DataFrame) -> DataFrame:
    """warnings: what a corpus row lacks."""
    needed = ["abs_mag", "teff_k", "metallicity", "logg", "v_tan"]
    parts = [F.when(c(n).isNull(), f"{n} is missing") for n in needed]
    return df.withColumn("warnings", present(*parts, F.when(c("quality_score") == 0, "quality is zero")))
