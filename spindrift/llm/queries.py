"""Queries of the training-data operators and, where SQL can say it, their SQL."""

from __future__ import annotations

from . import components, encoding, leakage, mixture, names, near_records, plain_form, subjects, survivor

QUERIES = {
    "p1_found": plain_form.found,
    "p1_plain": plain_form.plain,
    "p2_found": components.found,
    "p3_found": encoding.found,
    "p3_restored": encoding.restored,
    "p4_found": names.found,
    "p4_entities": names.entities,
    "p5_found": near_records.found,
    "p6_found": survivor.found,
    "p6_records": survivor.records,
    "p7_found": leakage.found,
    "p7_leaks": leakage.leaks,
    "p8_mix": mixture.drawn,
    "p8_shares": mixture.report,
    "p9_found": subjects.found,
    "p9_composition": subjects.composition,
}

#: The others (encoding chains, name comparison, NFKC, tokenizers, label spreading) are tested against brute force.
SQL = {"p2_found": components.SQL, "p5_found": near_records.SQL, "p6_found": survivor.SQL}
