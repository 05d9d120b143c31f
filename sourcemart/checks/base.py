"""Registry, and the SQL twins of the model frames as named common table expressions."""

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from sourcemart.model import Tables
from sourcemart.session import prepare


@dataclass
class Check:
    run: Callable
    sql: str | None


REGISTRY: dict[str, Check] = {}


def check(key: str, sql: str | None = None):
    """Registers ``fn(tables) -> DataFrame`` under a key of the operator inventory."""
    def add(fn: Callable[[Tables], DataFrame]):
        if key in REGISTRY:
            raise ValueError(f"{key} registered twice")
        REGISTRY[key] = Check(lambda spark, folder: fn(Tables(prepare(spark), folder)), sql)
        return fn
    return add


CENTS = "floor(({0}) * cast(100 AS DOUBLE) + cast(0.5 AS DOUBLE)) / cast(100 AS DOUBLE)"
MODEL = {
    "sources": """SELECT o_orderkey AS doc_id, o_custkey AS series, cast(o_orderdate AS DATE) AS issued_on,
        CASE o_orderstatus WHEN 'O' THEN 'active' WHEN 'F' THEN 'superseded' WHEN 'P' THEN 'withdrawn' END AS state,
        CASE o_orderpriority WHEN '1-URGENT' THEN 'partial' WHEN '5-LOW' THEN 'pending' ELSE 'ready' END AS import_status
        FROM orders""",
    "items": f"""SELECT p_partkey AS id, p_name AS name, 'M-' || p_size AS model, p_brand AS brand,
        p_type || '/' || split_part(p_name, ' ', 2) AS category, p_size AS size, p_type,
        '容量：' || p_size || 'ml' || chr(10) || '材质：' || p_type AS features,
        {CENTS.format('p_retailprice')} AS list_price,
        lower(p_type || '/' || split_part(p_name, ' ', 2)) AS category_norm, lower(p_brand) AS brand_norm,
        lower(p_name || ' M-' || p_size) AS name_norm,
        lower(p_name || ' M-' || p_size || ' 容量:' || p_size || 'ml 材质:' || p_type || ' ' || p_type || '/'
              || split_part(p_name, ' ', 2) || ' ' || p_brand) AS all_norm
        FROM part""",
    "obs": f"""SELECT sha256(concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, strftime(l_shipdate, '%Y-%m-%d'))) AS id,
        l_orderkey AS doc_id, cast(l_linenumber AS BIGINT) AS record_key, l_suppkey AS supplier, l_partkey AS group_id,
        CASE l_returnflag WHEN 'A' THEN 'agent_price' WHEN 'N' THEN 'retail_price' WHEN 'R' THEN 'reference_price_b' END AS field,
        l_linestatus AS label,
        CASE WHEN l_discount <> cast(0.10 AS DOUBLE) THEN {CENTS.format('l_extendedprice / l_quantity')} END AS amount,
        l_linestatus = 'F' AS has_image, name, model, brand, category, features, list_price, category_norm, brand_norm, name_norm, all_norm
        FROM lineitem JOIN items ON items.id = l_partkey""",
    "tags": """SELECT user_id AS id, event_type AS kind, json_extract_string(props, '$.k') AS value,
        max(CASE WHEN event_id % 2 = 0 THEN 'source' ELSE 'inferred' END) AS origin
        FROM events GROUP BY 1, 2, 3""",
    "facts": """SELECT doc_id AS id, 'category' AS field, 'reviewed/q' || quality AS value, cast(NULL AS DOUBLE) AS number,
        cast(NULL AS VARCHAR) AS unit, 'inferred' AS origin FROM labels
        UNION ALL SELECT doc_id, 'attr.capacity', cast(quality AS VARCHAR), quality * cast(1000 AS DOUBLE), 'ml', 'source' FROM labels
        UNION ALL SELECT doc_id, 'attr.material', CASE WHEN toxic = 1 THEN 'lead' ELSE 'steel' END, NULL, NULL, 'source' FROM labels""",
    "heads": """SELECT series, max(issued_on) AS newest, count(*) FILTER (WHERE issued_on IS NULL) AS undated,
        arg_max(n, issued_on) AS at_newest
        FROM (SELECT series, issued_on, count(*) AS n FROM sources WHERE state = 'active' GROUP BY 1, 2) GROUP BY series""",
    "latest": """SELECT s.* FROM sources s WHERE s.state = 'active' AND s.import_status = 'ready' AND s.series IS NOT NULL
        AND s.issued_on IS NOT NULL AND NOT EXISTS (SELECT 1 FROM sources o WHERE o.series = s.series AND o.state = 'active'
        AND o.doc_id <> s.doc_id AND (o.issued_on IS NULL OR o.issued_on >= s.issued_on))""",
    "tasks": """SELECT user_id AS task, event_id AS seq, CASE event_type WHEN 'signup' THEN 'turn_started' WHEN 'view' THEN 'question'
        WHEN 'click' THEN 'answered' WHEN 'purchase' THEN 'turn_ended' WHEN 'error' THEN 'error' END AS kind,
        json_extract_string(props, '$.k') AS request, value FROM events""",
    "doclines": """SELECT doc_id AS doc, generate_subscripts(l, 1) AS n, unnest(l) AS text
        FROM (SELECT doc_id, string_split_regex(text, '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c\\x1d\\x1e\\x{85}\\x{2028}\\x{2029}]') AS l FROM documents)""",
}
NEEDS = {"obs": ["items"], "heads": ["sources"], "latest": ["sources"]}


def sql(body: str, *names: str) -> str:
    """``body`` after the named model expressions and what these need."""
    wanted: list[str] = []

    def add(name):
        for need in NEEDS.get(name, []):
            add(need)
        if name not in wanted:
            wanted.append(name)

    for name in names:
        add(name)
    ctes = ",\n".join(f"{name} AS ({MODEL[name]})" for name in wanted)
    return f"WITH {ctes}\n{body}" if ctes else body
