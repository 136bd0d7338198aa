"""Entity-detail analysis: gaps, errors, associations, suggestions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from graphloom.operators.detail import Templates, attribute_gaps, entity_attributes, rule_errors, suggestions
from graphloom.operators.mentions import stored_mentions
from graphloom.operators.pairs import pair_associations, triangles
from graphloom.session import stored


@dataclass(frozen=True)
class DetailAnalysis:
    attributes: DataFrame
    gaps: DataFrame
    errors: DataFrame
    associations: DataFrame
    triangles: DataFrame
    suggestions: DataFrame


def analyze_details(
    entities: DataFrame,
    edges: DataFrame,
    docs: DataFrame,
    templates: Templates = Templates(),
    threshold: float = 0.3,
    compat: bool = False,
    **rules,
) -> DetailAnalysis:
    """All detail tables for entities(doc_id, seq, name, type), edges(doc_id, rid, source, relation, target) and documents."""
    mentions = stored_mentions(entities, docs)
    attributes = stored(entity_attributes(mentions, edges))
    gaps = attribute_gaps(entities, attributes, templates)
    errors = rule_errors(entities, attributes, **rules)
    pairs = pair_associations(mentions, edges, threshold, compat)
    return DetailAnalysis(attributes, gaps, errors, pairs, triangles(edges), suggestions(gaps, errors, pairs))
