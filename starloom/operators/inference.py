"""Prompts, a pluggable generator, parsing, validation, and retries."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starloom.functions.scalar import fixed, json_body, present
from starloom.operators.rules import c
from starloom.schemas import SCHEMAS

#: What a result may say.
LETTERS, CLASSES, POPULATIONS = ["O", "B", "A", "F", "G", "K", "M"], ["I", "II", "III", "IV", "V"], ["Halo", "Thick Disk", "Thin Disk"]


def full_prompt(df: DataFrame, context: str = "context") -> DataFrame:
    """prompt: the anchor, the measurements and the retrieved context as text."""
    boundary = F.concat_ws(" ", present(F.when(c("near_teff_boundary"), "Temperature is near a class boundary."), F.when(c("near_logg_boundary"), "Surface gravity is near a class boundary."), F.when(c("near_chemistry_boundary"), "Chemistry is near a population boundary.")))
    letter = F.when(c("ab_boundary_logg_corrected"), F.format_string("Letter: %s (corrected from B by surface gravity)", "mk_letter")).when(c("near_teff_boundary"), F.format_string("Letter: %s (near a boundary)", "mk_letter")).otherwise(F.format_string("Letter: %s", "mk_letter"))
    lines = F.concat_ws("\n", F.format_string("Source: %d", "source_id"), letter, F.format_string("Population: %s", "population_group"), F.format_string("Teff: %d K", "teff_k"), F.concat(F.lit("log g: "), fixed(c("logg"))), F.concat(F.lit("Chemistry: "), fixed(c("chemistry_value"))), F.concat(F.lit("v_tan: "), fixed(c("v_tan"), "%.1f")), F.concat(F.lit("Features: "), c("notable_features")), F.nullif(boundary, F.lit("")), F.nullif(F.coalesce(c(context), F.lit("")), F.lit("")))
    return df.withColumn("prompt", lines)


def reduced_prompt(df: DataFrame) -> DataFrame:
    """reduced: a short JSON form for a second try; tokens: about a quarter of its characters."""
    text = F.to_json(F.struct("source_id", "mk_letter", "population_group", "teff_k", "logg", "quality_score"))
    return df.withColumn("reduced", text).withColumn("tokens", F.floor(F.length("reduced") / 4))


def rule_generator(rows: pd.DataFrame) -> list[str]:
    """Answers from the rules alone: a deterministic stand-in for a language model."""
    out = []
    for r in rows.itertuples():
        out.append("```json\n" + json.dumps({
            "source_id": str(r.source_id),
            "classification": {"spectral_type": r.mk_letter, "sub_type_range": r.sub_type_range, "luminosity_class": r.luminosity_class, "population_group": r.population_group},
            "confidence_scores": {"spectral_type_confidence": r.spectral_confidence, "luminosity_confidence": r.luminosity_confidence, "population_confidence": r.confidence},
            "stellar_description": {"physical_profile": f"A star of class {r.mk_letter} at {r.teff_k} K.", "population_context": f"Belongs to the {r.population_group}.", "notable_features": r.notable_features},
            "technical_reasoning": r.decision_rule,
        }) + "\n```")
    return out


def generated(df: DataFrame, generate: Callable[[pd.DataFrame], list[str]] = rule_generator, tries: int = 3) -> DataFrame:
    """source_id, raw, attempts, error. A batch goes to the generator whole; answers without JSON are asked for again, and
    a row that never gets one has the end of its last answer as its error.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = pd.DataFrame({"source_id": rows["source_id"], "raw": None, "attempts": 0, "error": None}, index=rows.index)
            todo = rows
            for attempt in range(1, tries + 1):
                if not len(todo):
                    break
                try:
                    answers = generate(todo)
                except Exception as error:  # the generator is user code; its failure belongs to its rows
                    answers = [f"error: {error}"] * len(todo)
                good = [bool(a) and "{" in a and "}" in a for a in answers]
                out.loc[todo.index, "attempts"] = attempt
                for i, a, ok in zip(todo.index, answers, good):
                    out.at[i, "raw" if ok else "error"] = a if ok else (a or "")[-500:]
                    if ok:
                        out.at[i, "error"] = None
                todo = todo[[not g for g in good]]
            yield out

    return df.mapInPandas(run, "source_id bigint, raw string, attempts int, error string")


def parsed(df: DataFrame, raw: str = "raw") -> DataFrame:
    """result: the JSON body of an answer; NULL where it doesn't parse."""
    return df.withColumn("result", F.from_json(json_body(F.col(raw)), SCHEMAS["result"], {"mode": "PERMISSIVE"}))


def validated(df: DataFrame) -> DataFrame:
    """errors: what is wrong with a result; is_valid: nothing is."""
    cl, co, de = "result.classification", "result.confidence_scores", "result.stellar_description"
    bad = lambda name, options: F.when(~F.coalesce(c(name).isin(options), F.lit(False)), f"{name.rsplit('.')[-1]} is invalid")
    checks = [F.when(c("result").isNull(), "no result")]
    checks += [bad(f"{cl}.spectral_type", LETTERS), bad(f"{cl}.luminosity_class", CLASSES), bad(f"{cl}.population_group", POPULATIONS)]
    for name in ("spectral_type_confidence", "luminosity_confidence", "population_confidence"):
        checks.append(F.when(~F.coalesce(c(f"{co}.{name}").between(0.0, 1.0), F.lit(False)), f"{name} is out of range"))
    for name in ("physical_profile", "population_context", "notable_features"):
        checks.append(F.when(F.coalesce(c(f"{de}.{name}"), F.lit("")) == "", f"{name} is empty"))
    checks.append(F.when(~F.coalesce(c("result.source_id") == c("source_id").cast("string"), F.lit(False)), "source_id differs"))
    return df.withColumn("errors", present(*checks)).withColumn("is_valid", F.size("errors") == 0)


def resumed(df: DataFrame, done: DataFrame, key: str = "source_id") -> DataFrame:
    """Rows that no earlier batch holds."""
    return df.join(done.select(key).distinct(), key, "left_anti")
