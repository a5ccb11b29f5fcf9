"""Schemas of the files the engine reads."""

from __future__ import annotations

#: DDL of each source; ids are whole numbers throughout.
SCHEMAS = {
    "catalogue": "source_id bigint, ra double, dec double, parallax double, parallax_error double, pmra double, pmdec double, ruwe double, phot_g_mean_mag double, ebpminrp_gspphot double, teff_gspphot double, logg_gspphot double, mh_gspphot double, alphafe_gspspec double, fem_gspspec double, ew_espels_halpha double, ew_espels_halpha_flag int, radial_velocity_error double, rv_nb_transits double, nss_solution_type string, has_rvs_spectrum boolean, has_bprp_spectrum boolean",
    "bprp": "source_id bigint, flux array<double>",
    "rvs": "source_id bigint, wavelength array<double>, flux array<float>, flux_error array<float>",
    "ground_truth": "source_id bigint, main_id string, sp_type string, teff double, logg double, feh double, n_measurements int",
    "neighbourhood": "dr3_source_id bigint, dr2_source_id bigint, angular_distance double",
    "result": "source_id string, prompt_version string, classification struct<spectral_type: string, sub_type_range: string, luminosity_class: string, population_group: string>, confidence_scores struct<spectral_type_confidence: double, luminosity_confidence: double, population_confidence: double>, stellar_description struct<physical_profile: string, population_context: string, notable_features: string>, technical_reasoning string, rag_top_chunk string",
    "reference": "source_id bigint, main_id string, category string, reference_description struct<physical_profile: string, population_context: string, notable_features: string>",
}
#: Columns of a fixed-width table of published parameters: name -> (from, to), 0-based, the end exclusive.
FIXED_WIDTH = {"name": (0, 34), "ra": (34, 49), "dec": (50, 65), "teff": (139, 145), "e_teff": (145, 152), "logg": (152, 158), "feh": (165, 172), "bibcode": (203, 223)}
#: Inclusive bounds beyond which a published parameter counts as missing.
BOUNDS = {"teff": (2000.0, 100000.0), "logg": (-2.0, 7.5), "feh": (-5.5, 2.5)}
