"""Whole-graph analysis in four modules: long tables of findings and recommendations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from graphloom import rules as R
from graphloom.functions import text as tx
from graphloom.operators import causal, components, graph, keywords, ordering, reach
from graphloom.session import stored

VERB, KEYWORD, CAUSAL, LOGIC = (m for m, _ in R.MODULE_CONFIDENCE)


def _finding(df: DataFrame, module: str, kind: Column | str, severity: str, entity, other=None, score=None, text=None) -> DataFrame:
    null = F.lit(None)
    return df.select(
        F.lit(module).alias("module"),
        (F.lit(kind) if isinstance(kind, str) else kind).alias("type"),
        F.lit(severity).alias("severity"),
        entity.cast("string").alias("entity"),
        (null if other is None else other).cast("string").alias("other"),
        (null if score is None else score).cast("double").alias("value"),
        (null if text is None else text).cast("string").alias("description"),
    )


def _say(fmt: str, *cols) -> Column:
    return F.format_string(fmt, *cols)


class GlobalAnalysis:
    """Findings and recommendations for entities(eid, name, type, attributes) and edges(rid, name, source, target).

    The edge list is collapsed to one edge per (source, target) first; every
    module reads those two tables and the bags of tokens, which are written once,
    when they are first asked for. Properties are lazy tables, except that the
    iterative ones run their rounds when asked for.
    """

    def __init__(self, entities: DataFrame, edges: DataFrame, tokenizer=tx.tokens, min_similarity: float = 0.3,
                 causal_limit: int = 10, gap_limit: int = 5):
        self._given, self._given_edges = entities, edges
        self.tokenizer, self.min_similarity = tokenizer, min_similarity
        self.causal_limit, self.gap_limit = causal_limit, gap_limit
        self._cache: dict = {}

    @property
    def entities(self) -> DataFrame:
        return self._once("entities", lambda: stored(self._given))

    @property
    def edges(self) -> DataFrame:
        return self._once("edges", lambda: stored(graph.collapse_directed(self._given_edges)))

    @property
    def bags(self) -> DataFrame:
        return self._once("bags", lambda: stored(keywords.entity_tokens(self.entities, self.tokenizer)))

    def _once(self, key, make):
        if key not in self._cache:
            self._cache[key] = make()
        return self._cache[key]

    # --- shared inputs of findings and recommendations
    def missing_causal(self) -> DataFrame:
        return self._once(
            "causal", lambda: causal.missing_causal_edges(self.entities, self.edges, self.causal_limit, tokenizer=self.tokenizer)
        )

    def transitive(self) -> DataFrame:
        return self._once("gaps", lambda: reach.transitive_gaps(self.entities, self.edges, self.gap_limit))

    # --- modules
    def verb_findings(self) -> DataFrame:
        missing = _finding(
            keywords.missing_verbs(self.bags), VERB, "missing_verb", "medium", F.col("name"),
            text=_say("实体 %s 缺少动词/谓语描述", F.col("name")),
        )
        steps = _finding(
            graph.process_nodes(self.entities, self.edges), VERB, "process_node", "low", F.col("name"),
            text=_say("%s 可能是流程中的处理节点", F.col("name")),
        )
        return missing.unionByName(steps)

    def keyword_findings(self) -> DataFrame:
        top = keywords.top_keywords(keywords.keyword_counts(self.bags))
        return _finding(top, KEYWORD, "high_frequency_keywords", "info", F.col("token"), score=F.col("n"), text=F.lit("高频关键词统计"))

    def causal_findings(self) -> DataFrame:
        s, t = F.col("source"), F.col("target")
        existing = _finding(
            causal.causal_relations(self.edges), CAUSAL, "existing_causal_relation", "info", s, t, text=_say("发现因果关系: %s -> %s", s, t)
        )
        roles = _finding(
            graph.hierarchy_roles(self.entities, self.edges), CAUSAL, F.col("role"), "info", F.col("name"), F.col("level"),
            text=F.concat(
                "name",
                F.when(F.col("role") == "root_node", " 可能是根节点或起始点")
                .when(F.col("role") == "leaf_node", " 可能是叶节点或终点")
                .otherwise(" 可能是中间节点"),
            ),
        )
        missing = _finding(
            self.missing_causal(), CAUSAL, "missing_causal_relation", "medium", s, t, F.col("score"),
            F.lit("基于关键词分析推断的潜在因果关系"),
        )
        return existing.unionByName(roles).unionByName(missing)

    def logic_findings(self) -> DataFrame:
        """Categories, their missing pairs as counts, cycles, order and transitive gaps."""
        groups = graph.category_gap_counts(self.entities, self.edges)
        category = _finding(
            groups, LOGIC, "category_group", "info", F.col("type"), score=F.col("members"),
            text=_say("发现%s类别下的%d个实体", F.col("type"), F.col("members")),
        )
        missing = _finding(
            groups.filter("missing_pairs > 0"), LOGIC, "missing_category_relation", "medium", F.col("type"), score=F.col("missing_pairs")
        )
        cycles = _finding(
            components.strongly_connected_components(self.edges), LOGIC, "circular_dependency", "high", F.col("component"),
            F.col("node"), F.col("size"), F.lit("发现循环依赖"),
        )
        order = ordering.dependency_order(self.edges, self.entities)
        cyclic = F.col("finding") == "no_topological_order"
        ordered = _finding(
            order, LOGIC, F.col("finding"), "info", F.col("node"), score=F.col("position"),
            text=F.when(cyclic, "图中存在环路，无法进行拓扑排序").otherwise("实体依赖顺序分析"),
        ).withColumn("severity", F.when(F.col("type") == "no_topological_order", "warning").otherwise("info"))
        gaps = _finding(
            self.transitive(), LOGIC, "missing_direct_relation", "low", F.col("source"), F.col("target"), F.col("path_length"),
            F.array_join("intermediate_nodes", ","),
        )
        return reduce(DataFrame.unionByName, [category, missing, cycles, ordered, gaps])

    def findings(self) -> DataFrame:
        return reduce(
            DataFrame.unionByName,
            [self.verb_findings(), self.keyword_findings(), self.causal_findings(), self.logic_findings()],
        )

    def recommendations(self) -> DataFrame:
        """add_verb, similar_entity_relation, add_causal_relation and add_logical_relation rows."""
        lacking = keywords.missing_verbs(self.bags).select("name")
        verbs = keywords.inferred_verbs(self.entities, self.edges).join(lacking, "name", "left_semi")
        unique, _ = keywords.profiles(self.bags)
        alike = keywords.similar_profiles(unique, self.entities.count(), self.min_similarity)
        s, t = F.col("source"), F.col("target")
        parts = [
            _finding(verbs, VERB, "add_verb", "", F.col("name"), F.col("verb"), text=F.lit("基于关系推断的动词")),
            _finding(alike, KEYWORD, "similar_entity_relation", "", F.col("profile1"), F.col("profile2"), F.col("score"),
                     F.array_join("common_keywords", ",")),
            _finding(self.missing_causal(), CAUSAL, "add_causal_relation", "", s, t, F.col("score")),
            _finding(self.transitive(), LOGIC, "add_logical_relation", "", s, t, F.col("confidence"), F.lit("logical_dependency")),
        ]
        return reduce(DataFrame.unionByName, parts).drop("severity")

    def modules(self) -> DataFrame:
        return self._given.sparkSession.createDataFrame(list(R.MODULE_CONFIDENCE), "module string, confidence double")
