"""Every query of the library on the driver tables, with its SQL.

Driver tables hold no proteins: texts are cleaned to the 20 amino letters, embeddings' first dimensions serve as
coordinates, and events and lineitem stand in for scores. Whole tables and whole texts are read.
"""
from strandframe.plans import contacts, evidence, motif, profiles, relational, structure


def queries() -> dict:
    return {**motif.QUERIES, **relational.QUERIES, **structure.QUERIES, **evidence.QUERIES, **contacts.QUERIES, **profiles.QUERIES}


def oracle_sql() -> dict:
    return {**motif.SQL, **relational.SQL, **structure.SQL, **evidence.sql(structure.SQL["half_spheres"], structure.SQL["secondary_structure"]), **contacts.SQL, **profiles.SQL}
