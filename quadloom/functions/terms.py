"""RDF terms: URIs, slugs, hashes and the guess whether an object is an entity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quadloom.plans.ontology import DATA_NS, SCHEMA_NS


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_uri(c: Column | str) -> Column:
    """By its scheme alone."""
    return _col(c).rlike("^(http://|https://|urn:)")


def slugify(c: Column | str) -> Column:
    """Lower case; runs of anything but a-z and 0-9 become one underscore, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(_col(c))), "[^a-z0-9]+", "_"), "^_|_$", "")


def to_entity_uri(c: Column | str, ns: str = DATA_NS) -> Column:
    return F.when(is_uri(c), _col(c)).otherwise(F.concat(F.lit(ns), slugify(c)))


def to_predicate_uri(c: Column | str) -> Column:
    return to_entity_uri(c, SCHEMA_NS)


def term_text(value: Column | str, is_iri: Column) -> Column:
    """The term in N-Triples."""
    escaped = _col(value)
    for find, put in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r")):
        escaped = F.replace(escaped, F.lit(find), F.lit(put))
    return F.when(is_iri, F.concat(F.lit("<"), _col(value), F.lit(">"))).otherwise(F.concat(F.lit('"'), escaped, F.lit('"')))


def triple_hash(s: Column | str, p: Column | str, o: Column | str, o_is_iri: Column | None = None) -> Column:
    """SHA-256 of the triple in N-Triples, without the final dot."""
    iri = is_uri(o) if o_is_iri is None else o_is_iri
    return F.sha2(F.concat(F.lit("<"), _col(s), F.lit("> <"), _col(p), F.lit("> "), term_text(o, iri)), 256)


def is_object_entity(o: Column | str, hint: Column | None = None) -> Column:
    """The hint (`entity` or not) where there is one, else whether the object looks like a slug of at most 60 characters."""
    guess = (F.length(_col(o)) <= 60) & _col(o).rlike("^[a-z][a-z0-9_]*$")
    return guess if hint is None else F.when(hint.isNotNull(), hint == "entity").otherwise(guess)


def normalised_object(o: Column | str, hint: Column | None = None) -> Column:
    """An entity's URI, or the literal as it is."""
    return F.when(is_uri(o), _col(o)).when(is_object_entity(o, hint), to_entity_uri(o)).otherwise(_col(o))


def sanitised(c: Column | str) -> Column:
    """Without quotes, backslashes, line breaks and angle brackets."""
    return F.regexp_replace(_col(c), '["\\\\\n\r<>]', "")


def short_type(c: Column | str) -> Column:
    return F.regexp_replace(_col(c), "^" + SCHEMA_NS.replace(".", "\\."), "")


def trust_tier(graph: Column | str) -> Column:
    return F.when(_col(graph) == "asserted", "verified").when(_col(graph) == "federated", "federated").otherwise("extracted")


def target_graph(extractor: Column | str) -> Column:
    return F.when(_col(extractor) == "api", "asserted").otherwise("extracted")


def display_label(uri: Column | str) -> Column:
    return F.element_at(F.split(F.url_decode(_col(uri)), "/"), -1)


def validity_text(ts: Column | str, is_date: Column) -> Column:
    """A date or a date with time, as text."""
    return F.when(is_date, F.date_format(_col(ts), "yyyy-MM-dd")).otherwise(F.date_format(_col(ts), "yyyy-MM-dd'T'HH:mm:ss"))


def iso_date(c: Column | str) -> Column:
    """The date or time of an ISO 8601 text, null for any other text."""
    return F.when(_col(c).rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})?)?$"), F.try_to_timestamp(_col(c)))


def section_header(*levels: Column | str) -> Column:
    """Headings from the first level down, without the empty ones."""
    return F.array_join(F.filter(F.array(*map(_col, levels)), lambda h: h.isNotNull() & (h != "")), " > ")
