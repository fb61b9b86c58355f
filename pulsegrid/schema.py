"""Canonical tables. All times are BIGINT nanoseconds; intervals are half-open."""

from __future__ import annotations

TABLES = {
    "samples": "measure_id long, device_id long, time_n long, value double, write_seq long",
    "intervals": "measure_id long, device_id long, start_n long, end_n long",
    "measures": "measure_id long, tag string, name string, freq_nhz long, period_ns long, unit string, code string, unit_label string, unit_code string, source_id long",
    "devices": "device_id long, tag string, name string, manufacturer string, model string, type string, bed_id long, source_id long",
    "patients": "patient_id long, mrn string, gender string, dob long, first_name string, middle_name string, last_name string, first_seen long, last_updated long, source_id long, weight double, height double",
    "patient_history": "id long, patient_id long, field string, value double, units string, time_n long",
    "device_patient": "id long, device_id long, patient_id long, start_n long, end_n long",
    "device_encounter": "id long, device_id long, encounter_id long, start_n long, end_n long",
    "encounters": "id long, patient_id long, bed_id long, start_n long, end_n long, source_id long, visit_number string, last_updated long",
    "sources": "source_id long, name string, description string",
    "institutions": "institution_id long, name string",
    "units": "unit_id long, institution_id long, name string, type string",
    "beds": "bed_id long, unit_id long, name string",
    "label_sets": "label_set_id long, name string, parent_id long",
    "label_sources": "label_source_id long, name string, description string",
    "labels": "label_id long, label_set_id long, device_id long, measure_id long, label_source_id long, start_n long, end_n long",
    "settings": "name string, value string",
}
#: Columns that identify a row of a dimension; inserts with a known identity are ignored.
IDENTITY = {
    "measures": ("tag", "freq_nhz", "unit"),
    "devices": ("tag",),
    "patients": ("mrn",),
    "sources": ("name",),
    "institutions": ("name",),
    "units": ("institution_id", "name"),
    "beds": ("unit_id", "name"),
    "label_sets": ("name",),
    "label_sources": ("name",),
    "settings": ("name",),
}
KEYS = {t: c.split()[0] for t, c in TABLES.items() if t not in ("samples", "intervals", "settings")}
