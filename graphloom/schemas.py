"""Schemas of the tables the operators read and write."""

from pyspark.sql import types as T

_s, _l, _d = T.StringType(), T.LongType(), T.DoubleType()


def _struct(*fields):
    return T.StructType([T.StructField(n, t) for n, t in fields])


DOCUMENTS = _struct(("doc_id", _l), ("text", _s))
RESPONSES = _struct(("doc_id", _l), ("kind", _s), ("response", _s))
FACTS = _struct(("subject", _s), ("relation", _s), ("object", _s))
CONFLICT_RULES = _struct(
    ("rule_id", T.IntegerType()), ("subject", _s), ("wrong_object", _s), ("predicate", _s), ("conflict_type", _s), ("message", _s)
)
TRIPLES = _struct(("doc_id", _l), ("seq", _l), ("head", _s), ("relation", _s), ("tail", _s), ("confidence", _d))
ENTITIES = _struct(("doc_id", _l), ("seq", _l), ("name", _s), ("type", _s))

_attrs = T.MapType(_s, _s)
GRAPH_JSON = _struct(
    ("entities", T.ArrayType(_struct(("name", _s), ("type", _s), ("attributes", _attrs), ("relations", T.ArrayType(_s))))),
    ("relations", T.ArrayType(_struct(("name", _s), ("source", _s), ("target", _s), ("type", _s), ("attributes", _attrs)))),
)
