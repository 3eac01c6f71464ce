"""The ontology as tables: predicates with their weights and relations to one another."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Predicate | domain | materiality | opposite | inverse | transitive | synonyms
PREDICATES = """
causes | base | 0.5 | inhibits | - | - | leads_to results_in triggers induces produces
increases | base | 0.5 | decreases | - | - | boosts enhances elevates raises improves upregulates amplifies stimulates
decreases | base | 0.5 | increases | - | - | reduces lowers diminishes suppresses downregulates attenuates
inhibits | base | 0.5 | causes | - | - | blocks prevents
activates | base | 0.5 | - | - | - | promotes enables
is_a | base | 0.5 | - | - | yes | type_of instance_of kind_of
part_of | base | 0.5 | - | - | yes | component_of belongs_to member_of
located_in | base | 0.5 | - | - | yes | based_in situated_in
created_by | base | 0.5 | - | - | - | authored_by made_by built_by developed_by
depends_on | base | 0.5 | - | - | yes | requires needs
related_to | base | 0.3 | - | - | - | connected_to linked_to
contains | base | 0.5 | - | part_of | - | includes has comprises
precedes | base | 0.5 | follows | - | - | before prior_to
follows | base | 0.5 | precedes | - | - | after subsequent_to
has_property | base | 0.5 | - | - | - | -
used_for | base | 0.5 | - | - | - | -
produced_by | base | 0.5 | - | - | - | -
associated_with | base | 0.3 | - | - | - | -
treats | health | 0.8 | - | - | - | remedies alleviates addresses helps_treat
has_side_effect | health | 0.7 | - | - | - | adverse_effect causes_side_effect side_effect_of
recommended_dose | health | 0.6 | - | - | - | dosage suggested_intake optimal_dose daily_dose
contraindicated_with | health | 0.8 | - | - | - | interacts_negatively_with unsafe_with should_not_combine
affects_biomarker | health | 0.7 | - | - | - | modulates influences_level_of changes_biomarker
improves_condition | health | 0.7 | worsens_condition | - | - | helps_with beneficial_for alleviates_symptoms
worsens_condition | health | 0.7 | improves_condition | - | - | aggravates exacerbates makes_worse
has_mechanism | health | 0.5 | - | - | - | works_by mechanism_of_action acts_via
metabolized_by | health | 0.5 | - | - | - | processed_by broken_down_by cleared_by
absorbs_with | health | 0.5 | - | - | - | enhanced_by bioavailable_with better_absorbed_with
depletes | health | 0.6 | - | - | - | reduces_levels_of lowers_stores_of drains
synergizes_with | health | 0.6 | - | - | - | works_well_with potentiates amplifies_effect_of
has_half_life | health | 0.4 | - | - | - | duration active_for elimination_half_life
evidence_level | health | 0.5 | - | - | - | evidence_quality study_quality strength_of_evidence
bioavailable_as | health | 0.5 | - | - | - | absorbed_as active_form converted_to
cites | research | 0.5 | - | - | - | references builds_on refers_to
contradicts_finding | research | 0.8 | - | - | - | disagrees_with refutes challenges
replicates | research | 0.7 | - | - | - | confirms validates reproduces
extends | research | 0.6 | - | - | - | builds_upon expands generalizes
funded_by | research | 0.4 | - | - | - | supported_by sponsored_by grant_from
authored_by | research | 0.5 | - | - | - | written_by lead_author first_author
published_in | research | 0.4 | - | - | - | appears_in journal venue
has_sample_size | research | 0.5 | - | - | - | participants n_equals study_size
uses_methodology | research | 0.5 | - | - | - | method study_design approach
finds | research | 0.7 | - | - | - | concludes shows demonstrates reports
implements | technology | 0.6 | - | - | - | provides supports_feature offers
integrates_with | technology | 0.6 | - | - | - | connects_to works_with interfaces_with
replaces | technology | 0.7 | - | - | - | supersedes deprecates succeeds
requires | technology | 0.6 | - | - | yes | needs prerequisite
compatible_with | technology | 0.5 | incompatible_with | - | - | supports works_on runs_with
incompatible_with | technology | 0.7 | compatible_with | - | - | breaks_with conflicts_with not_supported_on
performs_better_than | technology | 0.5 | - | - | - | faster_than outperforms more_efficient_than
maintained_by | technology | 0.4 | - | - | - | developed_by owned_by created_by_org
licensed_as | technology | 0.4 | - | - | - | license open_source license_type
written_in | technology | 0.5 | - | - | - | built_with language programming_language
deployed_on | technology | 0.5 | - | - | - | runs_on hosted_on infrastructure
alternative_to | technology | 0.5 | - | - | - | similar_to competitor_of comparable_to
"""

# Opposites and inverses declared beside the domains, and single-valued predicates.
MORE_OPPOSITES = (("increases", "decreases"), ("activates", "inhibits"), ("precedes", "follows"))
FUNCTIONAL = ("amount", "currency")

TYPE, LABEL, SINGLE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type", "http://www.w3.org/2000/01/rdf-schema#label", "http://www.w3.org/2002/07/owl#FunctionalProperty"

SCHEMA_NS = "http://knowledge.local/schema/"
DATA_NS = "http://knowledge.local/data/"
#: The materiality of a predicate that the ontology doesn't name.
DEFAULT_MATERIALITY = 0.5


def _rows() -> list[dict]:
    names = ("predicate", "domain", "materiality", "opposite", "inverse", "transitive", "synonyms")
    rows = [dict(zip(names, map(str.strip, line.split("|")), strict=True)) for line in PREDICATES.strip().splitlines()]
    return [r | {k: None if r[k] == "-" else r[k] for k in ("opposite", "inverse", "synonyms")} for r in rows]


def uri(name: str) -> str:
    return SCHEMA_NS + name


def predicates(spark: SparkSession) -> DataFrame:
    """predicate (URI), label, domain, materiality, transitive."""
    rows = [(uri(r["predicate"]), r["predicate"].replace("_", " "), r["domain"], float(r["materiality"]), r["transitive"] == "yes") for r in _rows()]
    return spark.createDataFrame(rows, "predicate string, label string, domain string, materiality double, transitive boolean")


def synonyms(spark: SparkSession) -> DataFrame:
    """synonym (slug) and predicate; a predicate's own label beats synonyms, then the first in the alphabet wins."""
    rows = [(r["predicate"], uri(r["predicate"]), 0) for r in _rows()]
    rows += [(s, uri(r["predicate"]), 1) for r in _rows() for s in (r["synonyms"] or "").split()]
    best: dict[str, tuple] = {}
    for slug, predicate, place in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        best.setdefault(slug, (slug, predicate))
    return spark.createDataFrame(sorted(best.values()), "synonym string, predicate string")


def opposites(spark: SparkSession) -> DataFrame:
    """p1, p2: declared opposites, each in both directions."""
    pairs = {(r["predicate"], r["opposite"]) for r in _rows() if r["opposite"]} | set(MORE_OPPOSITES)
    both = sorted({(uri(a), uri(b)) for a, b in pairs} | {(uri(b), uri(a)) for a, b in pairs})
    return spark.createDataFrame(both, "p1 string, p2 string")


def inverses(spark: SparkSession) -> DataFrame:
    """predicate and inverse, in both directions."""
    pairs = {(r["predicate"], r["inverse"]) for r in _rows() if r["inverse"]}
    both = sorted({(uri(a), uri(b)) for a, b in pairs} | {(uri(b), uri(a)) for a, b in pairs})
    return spark.createDataFrame(both, "predicate string, inverse string")


def transitive(spark: SparkSession) -> DataFrame:
    return predicates(spark).where("transitive").select("predicate")


def functional(spark: SparkSession, extra: tuple[str, ...] = ()) -> DataFrame:
    """Single-valued predicates, with those that the caller declares."""
    return spark.createDataFrame([(uri(x),) for x in (*FUNCTIONAL, *extra)], "predicate string")


def by_domain(spark: SparkSession, domain: str) -> DataFrame:
    return predicates(spark).where(F.col("domain") == domain).orderBy("predicate")


def registry(spark: SparkSession) -> DataFrame:
    """Each predicate with its sorted synonyms."""
    names = synonyms(spark).groupBy("predicate").agg(F.sort_array(F.collect_set("synonym")).alias("synonyms"))
    return predicates(spark).join(names, "predicate", "left")


# Vocabularies of one's own, from triples


def _pairs(triples: DataFrame, predicate: str, a: str, b: str) -> DataFrame:
    one = triples.where(F.col("p") == uri(predicate)).select(F.col("s").alias(a), F.col("o").alias(b))
    return one.union(one.select(F.col(b), F.col(a))).distinct()


@dataclass
class Vocabulary:
    """The ontology's tables from triples (s, p, o), with the columns of the functions above."""

    predicates: DataFrame
    synonyms: DataFrame
    opposites: DataFrame
    inverses: DataFrame
    functional: DataFrame

    @property
    def transitive(self) -> DataFrame:
        return self.predicates.where("transitive").select("predicate")


def vocabulary(triples: DataFrame, default: float = DEFAULT_MATERIALITY) -> Vocabulary:
    """The vocabulary that an ontology graph holds: a predicate has a label and a domain (of several the first in the alphabet), and a weight or the default.

    Of a synonym that several predicates have, one that is a label wins, then the first predicate in the alphabet."""
    own = triples.where(F.col("s").isNotNull()).select("s", "p", "o").distinct()
    one = lambda p, name: own.where(F.col("p") == p).groupBy(F.col("s").alias("predicate")).agg(F.min("o").alias(name))
    known = own.where((F.col("p") == TYPE) & (F.col("o") == uri("Predicate"))).select(F.col("s").alias("predicate")).distinct()
    out = known.join(one(LABEL, "label"), "predicate").join(one(uri("domain"), "domain"), "predicate")
    weight = F.coalesce(F.expr("try_cast(weight as double)"), F.lit(default)).alias("materiality")
    out = out.join(one(uri("materialityWeight"), "weight"), "predicate", "left").join(one(uri("transitivePredicate"), "flag"), "predicate", "left")
    out = out.select("predicate", "label", "domain", weight, (F.coalesce("flag", F.lit("")) == "true").alias("transitive"))
    slug = lambda c: F.replace(F.trim(F.lower(c)), F.lit(" "), F.lit("_")).alias("synonym")
    names = out.select(slug("label"), "predicate", F.lit(0).alias("place")).union(own.where(F.col("p") == uri("synonym")).join(out, own.s == out.predicate).select(slug("o"), "predicate", F.lit(1)))
    names = names.groupBy("synonym").agg(F.min(F.struct("place", "predicate")).alias("x")).select("synonym", "x.predicate")
    single = own.where((F.col("p") == TYPE) & (F.col("o") == SINGLE)).select(F.col("s").alias("predicate")).distinct()
    return Vocabulary(out, names, _pairs(own, "oppositePredicate", "p1", "p2"), _pairs(own, "inversePredicate", "predicate", "inverse"), single)


def bootstrap(found: DataFrame, held: DataFrame) -> DataFrame:
    """The triples (s, p, o, o_kind) of vocabulary files that the ontology graph (s, p, o) lacks, as quads of it; loading files again gives none.

    Triples of every file are taken, so a file dropped in later adds what it declares; single-valued predicates of the ontology are declared in any case."""
    spark = found.sparkSession
    fixed = spark.createDataFrame([(uri(x), TYPE, SINGLE, "iri") for x in FUNCTIONAL], "s string, p string, o string, o_kind string")
    new = found.where(F.col("s").isNotNull()).select("s", "p", "o", "o_kind").union(fixed).distinct()
    return new.join(held.select("s", "p", "o"), ["s", "p", "o"], "left_anti").select(F.lit("ontology").alias("graph"), "s", "p", "o", "o_kind")
