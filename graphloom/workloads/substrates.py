"""Inputs for the registered queries, derived from the given tables by SQL both engines read.

``{orders}`` and the like stand for tables. Every derivation covers whole tables.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F

from graphloom.session import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spark_rows(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    names = set(re.findall(r"\{(\w+)\}", sql))
    return spread(spark.sql(sql, **{n: table(spark, sf_dir, n) for n in names}))


def plain(sql: str) -> str:
    """The same SQL over tables that are registered by name."""
    return re.sub(r"\{(\w+)\}", r"\1", sql)


def _pick(words: str, index: str) -> str:
    n = words.count(",") + 1
    return f"split_part('{words}', ',', CAST(({index}) % {n} + 1 AS INT))"


# One Chinese text per order; every twelfth order gets the same kind of sentence.
ZH_DOCS = f"""
SELECT doc_id, person, company, city, country, CASE kind
  WHEN 0 THEN city || '是' || country || '城市。'
  WHEN 1 THEN country || city
  WHEN 2 THEN city || '在' || country || ' ' || country || city || '，' || city || '位于' || country || '。'
  WHEN 3 THEN person || '担任' || company || '公司的经理，' || company || '公司位于' || city || '市。'
  WHEN 4 THEN person || '在' || city || '大学工作，' || city || '大学成立于' || CAST(1900 + doc_id % 150 AS STRING) || '年。'
  WHEN 5 THEN 'HELLO  WORLD ' || CAST(doc_id AS STRING)
  WHEN 6 THEN 'hello world'
  WHEN 7 THEN '哈哈哈哈'
  WHEN 8 THEN '　 '
  WHEN 9 THEN person || '是' || company || '公司的CEO，年龄' || CAST(20 + doc_id % 50 AS STRING) || '岁，来自' || city
  WHEN 10 THEN '巴黎 德国 北京 日本 ' || city
  ELSE company || '科技集团总部在' || city || '市，拥有' || CAST(doc_id AS STRING) || '员工，' || person || '工作于' || company || '公司。'
END AS text
FROM (SELECT o_orderkey AS doc_id, CAST(o_orderkey % 12 AS INT) AS kind,
  {_pick('张,王,李,赵,刘,陈', 'o_custkey')} || {_pick('伟,芳,娜,敏,静,强,磊', 'o_custkey')} AS person,
  {_pick('阿里,腾讯,华为,百度,京东', 'o_custkey + o_orderkey')} AS company,
  {_pick('巴黎,北京,东京,伦敦,纽约,柏林', 'o_custkey')} AS city,
  {_pick('法国,中国,日本,英国,美国,德国', 'o_orderkey + o_custkey')} AS country
  FROM {{orders}}) z
"""

# Extractor responses of several lines per line item, with malformed ones among them.
_S, _P = "'S' || CAST(l_suppkey AS STRING)", "'P' || CAST(l_partkey AS STRING)"
RESPONSES = f"""
SELECT l_orderkey AS doc_id, l_partkey * 100000 + l_suppkey * 10 + l_linenumber AS part,
  {_S} || '|Organization' || chr(10) || 'noise' || chr(10) || ' ' || {_P} || ' | Product ' || chr(10) || '|Other' || chr(10)
    || {_S} || CASE WHEN l_returnflag = 'R' THEN '|Other' ELSE '|Organization' END AS entity_response,
  '1. (' || {_S} || ', supplies, ' || {_P} || ')' || chr(10) || '（' || {_S} || '，x，y）' || chr(10) || '(a,b)' || chr(10)
    || '(' || {_P} || ', ,' || l_linestatus || ')' || chr(10)
    || '(' || {_P} || ',' || l_returnflag || ',O' || CAST(l_orderkey AS STRING) || ',' || l_linestatus || ')' || chr(10)
    || '(' || {_S} || ',supplies,' || {_P} || ')' AS triple_response
FROM {{lineitem}}
"""

# One triple per line item; the confidence runs over 0..1.
TRIPLES = f"""
SELECT l_orderkey AS doc_id, l_partkey * 100000 + l_suppkey * 10 + l_linenumber AS seq, {_S} AS head,
  CASE l_returnflag WHEN 'R' THEN 'returned' WHEN 'A' THEN 'accepted' ELSE 'new' END || '_' || l_linestatus AS relation,
  {_P} AS tail, l_discount * 10 AS confidence
FROM {{lineitem}}
"""

# Documents that carry their responses: the orders' texts.
ANSWERED = f"""
SELECT doc_id, text,
  person || '|Person' || chr(10) || company || '公司 | Organization' || chr(10) || city || '|Location' || chr(10) || person || '|Person' AS entity_response,
  '(' || person || ',工作于,' || company || '公司)' || chr(10) || '(' || company || '公司, 位于, ' || city || ')' || chr(10) || 'none' || chr(10)
    || '(' || person || ',认识,' || country || ')' || chr(10) || '(' || person || ',工作于,' || company || '公司)' AS triple_response
FROM ({ZH_DOCS}) d
"""

# Entities and edges inside the orders' texts: several rows of one read of each text.
_ENTITIES = (("0", "person", "'Person'"), ("1", "company || '公司'", "'Organization'"), ("2", "city", "'Location'"), ("3", "country", "'Location'"),
             ("4", "city || '大学'", "'Organization'"), ("5", "'CEO'", "'Other'"))
_EDGES = (("0", "person", "'工作于'", "company || '公司'", 1), ("1", "person", "'担任'", "'CEO'", 2), ("2", "company || '公司'", "'位于'", "city", 3),
          ("3", "person", "'就职于'", "city || '大学'", 5), ("4", "company || '公司'", "'雇佣'", "person", 7), ("5", "city", "'属于'", "country", 1),
          ("6", "person", "'来自'", "city", 1))


def _several(names: tuple[str, ...], rows: tuple) -> tuple[str, str]:
    """Rows (doc_id, names..., every) of each text, as Spark SQL and as DuckDB SQL."""
    spark = ", ".join("named_struct(" + ", ".join(f"'{n}', {v}" for n, v in zip(names, row)) + ")" for row in rows)
    duck = ", ".join("{" + ", ".join(f"'{n}': {v}" for n, v in zip(names, row)) + "}" for row in rows)
    return (
        f"SELECT doc_id, r.* FROM (SELECT doc_id, explode(array({spark})) AS r FROM ({ZH_DOCS}) d) s",
        f"SELECT doc_id, unnest(r) FROM (SELECT doc_id, unnest([{duck}]) AS r FROM ({plain(ZH_DOCS)}) d) s",
    )


DOC_ENTITIES, DOC_ENTITIES_DUCK = _several(("seq", "name", "type"), _ENTITIES)
_ALL_EDGES = _several(("rid", "source", "relation", "target", "every"), _EDGES)
DOC_EDGES, DOC_EDGES_DUCK = (f"SELECT doc_id, rid, source, relation, target FROM ({rows}) e WHERE doc_id % every = 0" for rows in _ALL_EDGES)

# Star schema as a graph: order -> customer -> nation -> region, supplier -> nation. Acyclic; nations are hubs.
STAR_ENTITIES = """
SELECT CAST(r_regionkey AS BIGINT) * 8 AS eid, 'R' || CAST(r_regionkey AS STRING) AS name, 'region' AS type, '区域 ' || r_name AS descr FROM {region}
UNION ALL SELECT CAST(n_nationkey AS BIGINT) * 8 + 1, 'N' || CAST(n_nationkey AS STRING), 'nation', '影响贸易 ' || n_name FROM {nation}
UNION ALL SELECT s_suppkey * 8 + 2, 'S' || CAST(s_suppkey AS STRING), 'supplier', '生成产品 ' || s_name FROM {supplier}
UNION ALL SELECT c_custkey * 8 + 3, 'C' || CAST(c_custkey AS STRING), 'customer', '客户 ' || c_mktsegment FROM {customer}
UNION ALL SELECT o_orderkey * 8 + 4, 'O' || CAST(o_orderkey AS STRING), 'order', CASE o_orderstatus WHEN 'F' THEN '完成 ' ELSE '订单 ' END || o_orderpriority FROM {orders}
"""
STAR_EDGES = """
SELECT CAST(n_nationkey AS BIGINT) * 8 + 1 AS rid, '属于' AS name, 'N' || CAST(n_nationkey AS STRING) AS source, 'R' || CAST(n_regionkey AS STRING) AS target FROM {nation}
UNION ALL SELECT s_suppkey * 8 + 2, '存在于', 'S' || CAST(s_suppkey AS STRING), 'N' || CAST(s_nationkey AS STRING) FROM {supplier}
UNION ALL SELECT c_custkey * 8 + 3, '影响到', 'C' || CAST(c_custkey AS STRING), 'N' || CAST(c_nationkey AS STRING) FROM {customer}
UNION ALL SELECT o_orderkey * 8 + 4, CASE o_orderstatus WHEN 'F' THEN '因为产生' WHEN 'P' THEN '处理并完成' ELSE '待定' END,
  'O' || CAST(o_orderkey AS STRING), 'C' || CAST(o_custkey AS STRING) FROM {orders}
"""

# Trade inside one ISO week: supplier -> shelf of 20 parts, turned round for returned goods. Cyclic.
TRADE_EDGES = """
SELECT l_orderkey * 8 + l_linenumber AS rid, name, CASE WHEN l_returnflag = 'R' THEN p ELSE s END AS source, CASE WHEN l_returnflag = 'R' THEN s ELSE p END AS target
FROM (SELECT l_orderkey, l_linenumber, l_returnflag, l_linestatus AS name, 'S' || CAST(l_suppkey AS STRING) || w AS s, 'P' || CAST(CAST(floor(l_partkey / 20) AS BIGINT) AS STRING) || w AS p
  FROM (SELECT l_orderkey, l_linenumber, l_returnflag, l_linestatus, l_suppkey, l_partkey,
    '@' || CAST(extract(YEAR FROM l_shipdate) AS STRING) || 'w' || CAST(extract(WEEK FROM l_shipdate) AS STRING) AS w FROM {lineitem}) t) u
"""

# Nations and customers with causal words in some descriptions; edges from a nation to its customers.
MARKET_ENTITIES = """
SELECT CAST(n_nationkey AS BIGINT) AS eid, 'N' || CAST(n_nationkey AS STRING) AS name, 'nation' AS type,
  CASE n_nationkey % 3 WHEN 0 THEN '贸易' || n_name WHEN 1 THEN '由于贸易' || n_name ELSE '因为需求导致增长' || n_name END AS descr FROM {nation}
UNION ALL SELECT c_custkey + 1000, 'C' || CAST(c_custkey AS STRING), c_mktsegment,
  CASE c_mktsegment WHEN 'AUTOMOBILE' THEN '由于需求促使生产' WHEN 'BUILDING' THEN '因为城市扩张' WHEN 'FURNITURE' THEN '家具订单' WHEN 'HOUSEHOLD' THEN '家庭消费产生订单' ELSE '机器设备' END FROM {customer}
"""
MARKET_EDGES = """
SELECT c_custkey AS rid, '包含' AS name, 'N' || CAST(c_nationkey AS STRING) AS source, 'C' || CAST(c_custkey AS STRING) AS target FROM {customer}
UNION ALL SELECT c_custkey + 1000000000000, '引起', 'C' || CAST(c_custkey AS STRING), 'C' || CAST(CAST(floor(c_custkey / 2) AS BIGINT) AS STRING) FROM {customer} WHERE c_custkey > 0
"""


def described(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """Entities with their description as an attribute map."""
    return spark_rows(spark, sf_dir, sql).withColumn("attributes", F.create_map(F.lit("描述"), F.col("descr"))).drop("descr")


# DuckDB text of the default tokenizer
def tokens_sql(text: str) -> str:
    return (
        f"list_concat(regexp_extract_all({text}, '[A-Za-z0-9À-ÿ]+'), list_filter(list_transform(range(1, length({text})), "
        f"lambda i: substr({text}, i, 2)), lambda s: regexp_full_match(s, '[一-龥]{{2}}')))"
    )
