"""Identifier, source, join, set and dedup queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from crossgrid.functions import hashing as H, ids, metrics as M
from crossgrid.operators import ranking as R
from crossgrid.plans import fixtures as X
from crossgrid.plans.registry import query, r
from crossgrid.session import rounded, scratch_path
from crossgrid.sources import readers, sinks
from crossgrid.sources.keyed_table import KeyedTable


@query("scan_required_cols", """
    SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer""")
def scan_required_cols(t):
    """CSV scan with an explicit schema and a check of the required columns."""
    path = scratch_path(t.spark, "customer-csv")
    t.customer.write.option("header", True).csv(path)
    schema = "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING"
    return readers.read_csv(t.spark, path, schema, ["c_custkey", "c_acctbal"])


_PATHS_SQL = """
    SELECT l_orderkey, l_linenumber,
           '/preds/' || CASE l_returnflag WHEN 'A' THEN 'az' WHEN 'N' THEN 'oh' ELSE 'pa' END
           || '/q' || quarter(l_shipdate) || '_' || year(l_shipdate) || '/epoch' || l_partkey || '_valset_'
           || CASE l_returnflag WHEN 'A' THEN 'az' WHEN 'N' THEN 'oh' ELSE 'pa' END || '_' || year(l_shipdate)
           || '_q' || l_linenumber || '_s2_allbands_'
           || CASE l_linestatus WHEN 'O' THEN 'wealth_index' ELSE 'gas_heat_pct' END || '_preds.csv' AS path
    FROM lineitem"""


def _paths(t):
    state = F.when(F.col("l_returnflag") == "A", "az").when(F.col("l_returnflag") == "N", "oh").otherwise("pa")
    variable = F.when(F.col("l_linestatus") == "O", "wealth_index").otherwise("gas_heat_pct")
    return t.lineitem.select(
        "l_orderkey", "l_linenumber",
        ids.pred_path(state, F.year("l_shipdate"), F.quarter("l_shipdate"), F.col("l_partkey"),
                      F.year("l_shipdate"), F.col("l_linenumber"), variable).alias("path"),
    )


_PATTERN = ids.PRED_PATH_PATTERN.replace("'", "''")


@query("path_parse", f"""
    SELECT l_orderkey, l_linenumber, nullif(x[1], '') AS state, try_cast(x[2] AS INTEGER) AS model_quarter,
           try_cast(x[3] AS INTEGER) AS model_year, try_cast(x[4] AS INTEGER) AS epoch,
           try_cast(x[6] AS INTEGER) AS eval_year, try_cast(x[7] AS INTEGER) AS eval_quarter, nullif(x[8], '') AS variable
    FROM (SELECT l_orderkey, l_linenumber,
                 [{", ".join(f"regexp_extract(path, '{_PATTERN}', {i})" for i in range(1, 9))}] AS x
          FROM ({_PATHS_SQL}))""")
def path_parse(t):
    """State, model period, epoch, evaluation period and variable of a prediction path."""
    return _paths(t).select("l_orderkey", "l_linenumber",
                            *[c.alias(n) for n, c in ids.parse_pred_path("path").items()])


@query("path_template", _PATHS_SQL)
def path_template(t):
    """Prediction paths formatted from their fields."""
    return _paths(t)


@query("single_match_filter", """
    SELECT c_nationkey, c_custkey % 100 AS slot, min(c_mktsegment) AS c_mktsegment FROM customer
    GROUP BY 1, 2 HAVING count(*) = 1""")
def single_match_filter(t):
    """Keys that match exactly one file; zero or several matches are left out."""
    files = t.customer.withColumn("slot", F.col("c_custkey") % 100)
    unique, _ = readers.single_match(files, ["c_nationkey", "slot"], "c_mktsegment")
    return unique


@query("single_match_rejects", """
    SELECT c_nationkey, c_custkey % 100 AS slot, count(*) AS n_files,
           string_agg(DISTINCT c_mktsegment, ',' ORDER BY c_mktsegment) AS variables FROM customer
    GROUP BY 1, 2 HAVING count(*) > 1""")
def single_match_rejects(t):
    """Ambiguous keys with the variables found."""
    files = t.customer.withColumn("slot", F.col("c_custkey") % 100)
    _, rejects = readers.single_match(files, ["c_nationkey", "slot"], "c_mktsegment")
    return rejects.withColumn("variables", F.array_join("variables", ","))


@query("manifest_missing", f"""
    WITH req AS (SELECT y::INTEGER AS year, c[1]::INTEGER AS train_quarter, c[2]::INTEGER AS eval_quarter
                 FROM (SELECT unnest(range(1995, 2003)) AS y),
                      (SELECT unnest([[1,1],[1,2],[1,3],[1,4],[2,2],[3,3],[4,4],[3,1]]) AS c))
    SELECT * FROM req WHERE NOT EXISTS (
        SELECT 1 FROM (SELECT DISTINCT year(l_shipdate) AS y, quarter(l_shipdate) AS q,
                              quarter(o_orderdate) AS k FROM lineitem JOIN orders ON o_orderkey = l_orderkey)
        WHERE y = year AND k = train_quarter AND q = eval_quarter)""")
def manifest_missing(t):
    """Required (year, train quarter, eval quarter) cells that no file covers."""
    have = t.lineitem.join(t.orders, F.col("o_orderkey") == F.col("l_orderkey")).select(
        F.year("l_shipdate").alias("year"), F.quarter("o_orderdate").alias("train_quarter"),
        F.quarter("l_shipdate").alias("eval_quarter"))
    need = readers.required_cells(t.spark, list(range(1995, 2003)))
    return readers.missing_cells(need, have, ["year", "train_quarter", "eval_quarter"])


@query("json_keys_intersect", f"""
    SELECT '/chips/' || lpad(o_orderkey::VARCHAR, 11, '0') || '.tif' AS path,
           {r("sum(l_extendedprice)", 2)} AS label, {r("any_value(o_totalprice)", 2)} AS lon
    FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey""")
def json_keys_intersect(t):
    """Two JSON maps (path -> label, path -> coordinates), exploded and joined on their keys."""
    path = F.concat(F.lit("/chips/"), F.lpad(F.col("k").cast("string"), 11, "0"), F.lit(".tif"))
    ys = t.lineitem.groupBy(F.col("l_orderkey").alias("k")).agg(F.sum("l_extendedprice").alias("v"))
    ys = ys.select(F.to_json(F.create_map(path, "v")).alias("doc"))
    xy = t.orders.select(F.col("o_orderkey").alias("k"), "o_totalprice").select(
        F.to_json(F.create_map(path, F.array("o_totalprice", F.lit(0.0)))).alias("doc"))
    labels = readers.json_map_entries(ys, "doc", "double", "path", "label")
    points = readers.json_map_entries(xy, "doc", "array<double>", "path", "xy")
    return labels.join(points, "path").select(
        "path", rounded("label", 2).alias("label"), rounded(F.col("xy")[0], 2).alias("lon"))


@query("json_props", """
    SELECT event_id, user_id, event_type, try_cast(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events""")
def json_props(t):
    """One field of a JSON document, cast tolerantly."""
    return t.events.select("event_id", "user_id", "event_type",
                           ids.safe_double(F.get_json_object("props", "$.k")).alias("k"))


_TARGETS = ["c_acctbal", "c_nationkey", "c_mktsegment", "c_name"]


@query("label_targets", """
    SELECT target, count(v) AS n_written, count(*) - count(v) AS n_dropped
    FROM (SELECT target, try_cast(raw AS DOUBLE) AS v
          FROM (UNPIVOT (SELECT c_custkey, c_acctbal::VARCHAR AS c_acctbal, c_nationkey::VARCHAR AS c_nationkey,
                                c_mktsegment, right(c_name, 3) AS c_name FROM customer)
                ON c_acctbal, c_nationkey, c_mktsegment, c_name INTO NAME target VALUE raw))
    GROUP BY target""")
def label_targets(t):
    """One partition per label target; values that are no number are dropped and counted."""
    df = t.customer.withColumn("c_name", F.right("c_name", F.lit(3)))
    labels = sinks.label_rows(df, "c_custkey", _TARGETS)
    return sinks.label_counts(labels)


@query("label_targets_written", f"""
    SELECT target, c_custkey, {r("v", 4)} AS value
    FROM (SELECT target, c_custkey, try_cast(raw AS DOUBLE) AS v
          FROM (UNPIVOT (SELECT c_custkey, c_acctbal::VARCHAR AS c_acctbal, c_nationkey::VARCHAR AS c_nationkey,
                                c_mktsegment, right(c_name, 3) AS c_name FROM customer)
                ON c_acctbal, c_nationkey, c_mktsegment, c_name INTO NAME target VALUE raw))
    WHERE v IS NOT NULL""")
def label_targets_written(t):
    """The same labels written to a table partitioned by target and read back."""
    df = t.customer.withColumn("c_name", F.right("c_name", F.lit(3)))
    path = scratch_path(t.spark, "labels")
    sinks.write_label_targets(sinks.label_rows(df, "c_custkey", _TARGETS), path)
    schema = "c_custkey BIGINT, value DOUBLE, target STRING"
    return t.spark.read.schema(schema).parquet(path).select(
        "target", "c_custkey", rounded("value", 4).alias("value"))


@query("organised_layout", f"""
    SELECT state, year AS model_year, quarter AS model_quarter, count(*) AS n, {r("avg(pred)", 2)} AS mean_pred
    FROM ({X.PRED_SQL}) GROUP BY ALL""")
def organised_layout(t):
    """Predictions collected into one table partitioned by state and model period."""
    p = X.predictions(t).select("state", F.col("year").alias("model_year"),
                                F.col("quarter").alias("model_quarter"), "pred")
    path = scratch_path(t.spark, "preds")
    keys = ["state", "model_year", "model_quarter"]
    sinks.write_predictions(p.repartition(*keys, F.hash("pred") % 4), path)
    back = t.spark.read.schema("pred DOUBLE, state STRING, model_year INT, model_quarter INT").parquet(path)
    return back.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), rounded(F.avg("pred"), 2).alias("mean_pred"))


@query("resume_todo", """
    SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)""")
def resume_todo(t):
    """Wanted keys that no result exists for yet."""
    return sinks.todo_keys(t.customer.select("c_custkey"),
                           t.orders.filter("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"])


@query("resume_batches", f"""
    SELECT (o_orderkey % 4 + 1)::INTEGER AS delivery, o_orderpriority, count(*) AS n, {r("sum(o_totalprice)", 2)} AS total FROM orders GROUP BY 1, 2""")
def resume_batches(t):
    """Four deliveries, each with the rows of the one before again, into a table with a key index: a row counts where it came first."""
    table = KeyedTable(t.spark, scratch_path(t.spark, "keyed"), ["o_orderkey"])
    for k in range(4):
        rows = t.orders.filter((F.col("o_orderkey") % 4).isin(k, k - 1)).select("o_orderkey", "o_orderpriority", "o_totalprice")
        table.append(rows.withColumn("delivery", F.lit(k + 1)))
    return table.read().groupBy("delivery", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"), rounded(F.sum("o_totalprice"), 2).alias("total"))


@query("expected_minus_have", """
    SELECT p_brand, p_type FROM (SELECT DISTINCT p_brand FROM part), (SELECT DISTINCT p_type FROM part)
    EXCEPT SELECT p_brand, p_type FROM part WHERE p_size <= 10""")
def expected_minus_have(t):
    """Expected combinations that a partial result lacks."""
    units = t.part.agg(F.collect_set("p_brand").alias("b"), F.collect_set("p_type").alias("k"))
    expected = units.select(F.explode("b").alias("p_brand"), "k").select("p_brand", F.explode("k").alias("p_type"))
    return expected.subtract(t.part.filter("p_size <= 10").select("p_brand", "p_type"))


@query("national_union", """
    SELECT c_custkey AS id, c_nationkey AS nation, c_mktsegment AS segment FROM customer
    UNION ALL SELECT s_suppkey, s_nationkey, NULL FROM supplier""")
def national_union(t):
    """Parts with different columns as one table."""
    a = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("nation"),
                          F.col("c_mktsegment").alias("segment"))
    b = t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("nation"))
    return sinks.union_parts([a, b])


@query("class_counts_map", """
    SELECT p_size, string_agg(k || '=' || n, ',' ORDER BY k) AS entries
    FROM (SELECT p_size, p_type AS k, count(*) AS n FROM part GROUP BY 1, 2) GROUP BY p_size""")
def class_counts_map(t):
    """Per key a map class -> count (shown as sorted entries)."""
    counts = t.part.groupBy("p_size", F.col("p_type").alias("class")).agg(F.count(F.lit(1)).alias("n"))
    entries = F.transform(F.array_sort(F.map_entries("counts")),
                          lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return sinks.class_maps(counts, "p_size").select("p_size", F.array_join(entries, ",").alias("entries"))


@query("class_maps_written", """SELECT p_size, p_type AS class, count(*) AS n FROM part GROUP BY 1, 2""")
def class_maps_written(t):
    """The class counts of every key written as JSON maps and read back."""
    counts = t.part.groupBy("p_size", F.col("p_type").alias("class")).agg(F.count(F.lit(1)).alias("n"))
    path = scratch_path(t.spark, "class-maps")
    sinks.write_class_maps(counts, "p_size", path)
    back = t.spark.read.schema("p_size INT, counts MAP<STRING, BIGINT>").json(path)
    return back.select(F.col("p_size").cast(counts.schema["p_size"].dataType).alias("p_size"), F.explode("counts").alias("class", "n"))


@query("keyed_value_load", """
    SELECT id, value FROM (
        SELECT *, row_number() OVER (PARTITION BY id ORDER BY o_orderkey) AS k FROM (
            SELECT lpad(o_custkey::VARCHAR, 11, '0') AS id, o_orderkey,
                   CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_totalprice END AS value FROM orders)
        WHERE value IS NOT NULL) WHERE k = 1""")
def keyed_value_load(t):
    """Text columns to (id, value): ids normalised, unusable rows dropped, first row kept."""
    raw = t.orders.select(
        F.concat(F.lit(" "), F.col("o_custkey").cast("string"), F.lit(".0")).alias("id"),
        F.when(F.col("o_orderstatus") == "P", "n/a").otherwise(F.col("o_totalprice").cast("string")).alias("value"),
        "o_orderkey")
    return readers.keyed_values(raw, "id", "value", [F.col("o_orderkey")])


@query("settings_missing", """
    SELECT c_custkey, missing FROM (
        SELECT c_custkey, concat_ws(',', CASE WHEN min(o_totalprice) FILTER (WHERE o_orderstatus = 'P') IS NULL THEN 'pending' END,
                                    CASE WHEN min(o_totalprice) FILTER (WHERE o_orderpriority = '1-URGENT') IS NULL THEN 'urgent' END) AS missing
        FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey) WHERE missing <> ''""")
def settings_missing(t):
    """Entities whose required settings are NULL, with the list of the missing ones."""
    joined = t.customer.join(t.orders, F.col("o_custkey") == F.col("c_custkey"), "left")
    settings = joined.groupBy("c_custkey").agg(
        F.min(F.when(F.col("o_orderstatus") == "P", F.col("o_totalprice"))).alias("pending"),
        F.min(F.when(F.col("o_orderpriority") == "1-URGENT", F.col("o_totalprice"))).alias("urgent"))
    return readers.missing_settings(settings, "c_custkey", ["pending", "urgent"]).withColumn(
        "missing", F.array_join("missing", ","))


# --- scalar functions ------------------------------------------------------------------

_RAW_SQL = """
    SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN '-666666666' WHEN '2-HIGH' THEN 'n/a'
                       WHEN '3-MEDIUM' THEN '-1' ELSE o_totalprice::VARCHAR END AS raw FROM orders"""


def _raw(t):
    p = F.col("o_orderpriority")
    return t.orders.select("o_orderkey", F.when(p == "1-URGENT", "-666666666").when(p == "2-HIGH", "n/a")
                           .when(p == "3-MEDIUM", "-1").otherwise(F.col("o_totalprice").cast("string")).alias("raw"))


@query("sentinel_null", f"""
    SELECT o_orderkey, CASE WHEN v NOT IN (-666666666, -999999999, -555555555, -1) THEN v END AS value
    FROM (SELECT o_orderkey, try_cast(raw AS DOUBLE) AS v FROM ({_RAW_SQL}))""")
def sentinel_null(t):
    """Sentinel codes to NULL."""
    return _raw(t).select("o_orderkey", ids.sentinel_to_null("raw").alias("value"))


@query("safe_cast", f"SELECT o_orderkey, try_cast(raw AS DOUBLE) AS value FROM ({_RAW_SQL})")
def safe_cast(t):
    """Text to double; text that is no number becomes NULL."""
    return _raw(t).select("o_orderkey", ids.safe_double("raw").alias("value"))


@query("normalize_id", """
    SELECT o_orderkey, CASE WHEN d <> '' THEN CASE WHEN length(d) < 11 THEN lpad(d, 11, '0') ELSE d END END AS id
    FROM (SELECT o_orderkey, regexp_replace(regexp_replace(trim(raw), '\\.0$', ''), '[^0-9]', '', 'g') AS d
          FROM (SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN ' ' || o_orderkey || '.0 ' WHEN 'F' THEN 'none'
                       ELSE o_orderkey || '-' || repeat('7', 9) || o_custkey END AS raw FROM orders))""")
def normalize_id(t):
    """Ids with blanks, a trailing .0, no digits, or more than 11 digits."""
    k, c, s = F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string"), F.col("o_orderstatus")
    raw = (F.when(s == "O", F.concat(F.lit(" "), k, F.lit(".0 "))).when(s == "F", "none")
           .otherwise(F.concat(k, F.lit("-777777777"), c)))
    return t.orders.select("o_orderkey", ids.normalize_id(raw).alias("id"))


@query("item_key", """
    SELECT page_id, regexp_extract(url, '([^/]+?)(\\.[^./]*)?$', 1) AS item FROM pages""")
def item_key(t):
    """Base name of a path without its extension."""
    return t.pages.select("page_id", ids.item_key("url").alias("item"))


@query("snake_case", """
    SELECT p_partkey, lower(regexp_replace(regexp_replace(p_name || ' (' || p_brand || ')', '[^0-9A-Za-z]+', '_', 'g'), '^_+|_+$', '', 'g')) AS name
    FROM part""")
def snake_case(t):
    return t.part.select("p_partkey", ids.snake_case(
        F.concat("p_name", F.lit(" ("), "p_brand", F.lit(")"))).alias("name"))


@query("composite_key", """
    SELECT c_custkey, lpad(c_nationkey::VARCHAR, 2, '0') || lpad(c_custkey::VARCHAR, 9, '0') AS id
    FROM customer WHERE lpad(c_nationkey::VARCHAR, 2, '0') = '04'""")
def composite_key(t):
    """State and tract parts joined to one id; state filter on the padded prefix."""
    state = F.lpad(F.col("c_nationkey").cast("string"), 2, "0")
    tract = F.lpad(F.col("c_custkey").cast("string"), 9, "0")
    return t.customer.filter(state == "04").select("c_custkey", ids.composite_id(state, tract).alias("id"))


@query("period_parse", """
    WITH raw AS (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN '' || (year(o_orderdate) + 8)
                        ELSE (year(o_orderdate) + 8) || '-' || (year(o_orderdate) + CASE o_orderstatus WHEN 'O' THEN 12 ELSE 13 END) END AS p FROM orders),
    s AS (SELECT o_orderkey, p, try_cast(regexp_extract(p, '^(\\d{4})-(\\d{4})$', 1) AS INTEGER) AS a,
                 try_cast(regexp_extract(p, '^(\\d{4})-(\\d{4})$', 2) AS INTEGER) AS b FROM raw),
    k AS (SELECT *, CASE WHEN a IS NULL OR b IS NULL THEN 'format' WHEN b - a <> 4 THEN 'span' WHEN a < 2005 THEN 'too_early' END AS reason FROM s)
    SELECT o_orderkey, p AS period, CASE WHEN reason IS NULL THEN b END AS vintage, reason FROM k""")
def period_parse(t):
    """Five-year periods: the vintage of a valid one, the reason for an invalid one."""
    y = F.year("o_orderdate") + 8
    period = F.when(F.col("o_orderstatus") == "F", y.cast("string")).otherwise(F.concat(
        y.cast("string"), F.lit("-"),
        (y + F.when(F.col("o_orderstatus") == "O", 4).otherwise(5)).cast("string")))
    parsed = ids.parse_period("period")
    return t.orders.select("o_orderkey", period.alias("period")).select(
        "o_orderkey", "period", parsed["vintage"].alias("vintage"), parsed["reason"].alias("reason"))


@query("quarter_labels", """
    SELECT o_orderkey, 'Q' || quarter(o_orderdate) || ' ' || year(o_orderdate) AS label,
           year(o_orderdate)::INTEGER AS year, quarter(o_orderdate)::INTEGER AS quarter FROM orders""")
def quarter_labels(t):
    """``YYYYQN`` tokens (either case) parsed, and the display label."""
    q = F.when(F.col("o_orderstatus") == "F", "q").otherwise("Q")
    token = F.concat(F.year("o_orderdate").cast("string"), q, F.quarter("o_orderdate").cast("string"))
    year, quarter = ids.parse_quarter_token(token)
    return t.orders.select("o_orderkey", ids.quarter_label(quarter, year).alias("label"),
                           year.alias("year"), quarter.alias("quarter"))


@query("quarter_bounds", """
    SELECT DISTINCT year(o_orderdate)::INTEGER AS year, quarter(o_orderdate)::INTEGER AS quarter,
           date_trunc('quarter', o_orderdate)::DATE::VARCHAR AS first_day,
           (date_trunc('quarter', o_orderdate) + INTERVAL 3 MONTH - INTERVAL 1 DAY)::DATE::VARCHAR AS last_day FROM orders""")
def quarter_bounds(t):
    units = t.orders.select(F.year("o_orderdate").alias("year"), F.quarter("o_orderdate").alias("quarter")).distinct()
    first, last = ids.quarter_bounds("year", "quarter")
    return units.select("year", "quarter", first.cast("string").alias("first_day"), last.cast("string").alias("last_day"))


_LAYER_SQL = """
    SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity <= 40 THEN 'features.' || (l_orderkey % 9) || '.' || l_linenumber || '.weight'
           WHEN l_quantity <= 45 THEN 'norm.weight' ELSE 'head.bias' END AS key FROM lineitem"""


@query("layer_group", f"""
    SELECT l_orderkey, l_linenumber, CASE WHEN b = 0 THEN 'patch_embed' WHEN b IS NOT NULL THEN 'stage' || (b // 2 + 1)
           WHEN starts_with(key, 'norm.') THEN 'final_norm' ELSE 'other' END AS layer
    FROM (SELECT *, try_cast(regexp_extract(key, '^features\\.(\\d+)\\.', 1) AS INTEGER) AS b FROM ({_LAYER_SQL}))""")
def layer_group(t):
    """Layer group of a dotted parameter name."""
    q = F.col("l_quantity")
    key = (F.when(q <= 40, F.concat(F.lit("features."), (F.col("l_orderkey") % 9).cast("string"), F.lit("."),
                                    F.col("l_linenumber").cast("string"), F.lit(".weight")))
           .when(q <= 45, "norm.weight").otherwise("head.bias"))
    return t.lineitem.select("l_orderkey", "l_linenumber", ids.layer_group(key).alias("layer"))


@query("pairs_directed", """
    WITH p AS (SELECT o_orderkey, year(o_orderdate)::INTEGER AS ry, quarter(o_orderdate)::INTEGER AS rq,
                      (year(o_orderdate) + 1)::INTEGER AS dy, (o_custkey % 4 + 1)::INTEGER AS dq FROM orders)
    SELECT o_orderkey, ry AS recipient_year, rq AS recipient_quarter, dy AS donor_year, dq AS donor_quarter FROM p
    UNION ALL SELECT o_orderkey, dy, dq, ry, rq FROM p""")
def pairs_directed(t):
    """``ry:rq:dy:dq`` texts parsed to both directed pairs."""
    text = F.concat_ws(":", F.year("o_orderdate").cast("string"), F.quarter("o_orderdate").cast("string"),
                       (F.year("o_orderdate") + 1).cast("string"), (F.col("o_custkey") % 4 + 1).cast("string"))
    return t.orders.select("o_orderkey", F.explode(ids.directed_pairs(text)).alias("p")).select("o_orderkey", "p.*")


@query("recovery_fraction", f"""
    SELECT tract, {r("CASE WHEN donor > base THEN (mid - base) / (donor - base) END")} AS recovery_fraction
    FROM (SELECT o_custkey AS tract, avg(o_totalprice) FILTER (WHERE o_orderstatus = 'F') AS base,
                 avg(o_totalprice) FILTER (WHERE o_orderstatus = 'P') AS mid,
                 avg(o_totalprice) FILTER (WHERE o_orderstatus = 'O') AS donor FROM orders GROUP BY 1)""")
def recovery_fraction(t):
    """Share of the donor's advantage that the intervention recovers."""
    def avg_of(s):
        return F.avg(F.when(F.col("o_orderstatus") == s, F.col("o_totalprice")))

    g = t.orders.groupBy(F.col("o_custkey").alias("tract")).agg(
        avg_of("F").alias("base"), avg_of("P").alias("mid"), avg_of("O").alias("donor"))
    return g.select("tract", rounded(M.recovery("base", "mid", "donor")).alias("recovery_fraction"))


# --- joins, sets, dedup ----------------------------------------------------------------

@query("left_join_supp", """
    SELECT c_custkey, c_acctbal, n FROM customer LEFT JOIN
        (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1) ON o_custkey = c_custkey""")
def left_join_supp(t):
    """Core rows with supplemental values where they exist."""
    supp = t.orders.filter("o_orderpriority = '1-URGENT'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.count(F.lit(1)).alias("n"))
    return t.customer.select("c_custkey", "c_acctbal").join(supp, "c_custkey", "left")


@query("semi_join_index", """
    SELECT n_name, count(*) AS total, count(*) FILTER (WHERE hit) AS matched
    FROM (SELECT n_name, c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000) AS hit
          FROM customer JOIN nation ON n_nationkey = c_nationkey) GROUP BY n_name""")
def semi_join_index(t):
    """Membership filter against an index table, with matched and total counts."""
    index = t.orders.filter("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    named = t.customer.join(t.nation, F.col("n_nationkey") == F.col("c_nationkey")).select("c_custkey", "n_name")
    matched = named.join(index, "c_custkey", "left_semi").groupBy("n_name").agg(F.count(F.lit(1)).alias("matched"))
    return named.groupBy("n_name").agg(F.count(F.lit(1)).alias("total")).join(matched, "n_name", "left").select(
        "n_name", "total", F.coalesce("matched", F.lit(0).cast("long")).alias("matched"))


@query("coverage_left", """
    SELECT count(*) AS n_tracts, count(o_custkey) AS n_with_value FROM customer
    LEFT JOIN (SELECT DISTINCT o_custkey FROM orders) ON o_custkey = c_custkey""")
def coverage_left(t):
    """Left join that keeps unmatched keys, and how many have a value."""
    have = t.orders.select(F.col("o_custkey").alias("k")).distinct()
    return t.customer.join(have, F.col("k") == F.col("c_custkey"), "left").agg(
        F.count(F.lit(1)).alias("n_tracts"), F.count("k").alias("n_with_value"))


@query("unmatched_anti", """
    SELECT d.doc_id, d.lang FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)""")
def unmatched_anti(t):
    """Items without a label row."""
    return t.documents.select("doc_id", "lang").join(t.labels.select("doc_id"), "doc_id", "left_anti")


@query("matched_inner", """
    SELECT d.doc_id, d.lang, l.quality FROM documents d JOIN labels l USING (doc_id)""")
def matched_inner(t):
    """Items with their label."""
    return t.documents.select("doc_id", "lang").join(t.labels.select("doc_id", "quality"), "doc_id")


@query("transfer_penalty", f"""
    WITH e AS (SELECT o_custkey AS tract, year(o_orderdate)::INTEGER AS year,
                      avg(abs(o_totalprice - 250000)) FILTER (WHERE o_orderstatus = 'F') AS matched,
                      avg(abs(o_totalprice - 250000)) FILTER (WHERE o_orderstatus = 'O') AS transfer
               FROM orders GROUP BY 1, 2)
    SELECT tract, year, {r("transfer")} AS error_transfer, {r("matched")} AS error_matched,
           {r("transfer - matched")} AS penalty FROM e WHERE matched IS NOT NULL AND transfer IS NOT NULL""")
def transfer_penalty(t):
    """Transferred minus matched error per (tract, year): one pass instead of a self-join."""
    err = F.abs(F.col("o_totalprice") - 250000)
    wide = t.orders.groupBy(F.col("o_custkey").alias("tract"), F.year("o_orderdate").alias("year")).agg(
        F.avg(F.when(F.col("o_orderstatus") == "O", err)).alias("x"),
        F.avg(F.when(F.col("o_orderstatus") == "F", err)).alias("m"))
    return wide.filter("x is not null and m is not null").select(
        "tract", "year", rounded("x").alias("error_transfer"), rounded("m").alias("error_matched"),
        rounded(F.col("x") - F.col("m")).alias("penalty"))


@query("corr_after_join", f"""
    WITH j AS (SELECT c_acctbal AS a, s.total AS b FROM customer JOIN
               (SELECT o_custkey, sum(o_totalprice) AS total FROM orders GROUP BY 1) s ON o_custkey = c_custkey),
    g AS (SELECT count(*) AS n, covar_pop(a, b) / nullif(sqrt(var_pop(a) * var_pop(b)), 0) AS rr FROM j)
    SELECT n, {r("rr")} AS pearson_r, {r("rr * sqrt(n - 2) / sqrt(1 - rr * rr)")} AS t FROM g""")
def corr_after_join(t):
    """Pearson r of two joined measures with its t statistic."""
    total = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sum("o_totalprice").alias("total"))
    g = t.customer.select("c_custkey", "c_acctbal").join(total, "c_custkey").agg(
        F.count(F.lit(1)).alias("n"), M.pearson("c_acctbal", "total").alias("rr"))
    return g.select("n", rounded("rr").alias("pearson_r"), rounded(M.pearson_t("rr", "n")).alias("t"))


@query("corr_p_value", f"""
    WITH RECURSIVE j AS (SELECT c_acctbal AS a, s.total AS b FROM customer JOIN
               (SELECT o_custkey, sum(o_totalprice) AS total FROM orders GROUP BY 1) s ON o_custkey = c_custkey),
    g AS (SELECT count(*) AS n, covar_pop(a, b) / nullif(sqrt(var_pop(a) * var_pop(b)), 0) AS rr FROM j),
    h AS (SELECT n, rr, rr * sqrt(n - 2) / sqrt(1 - rr * rr) AS t, n - 2 AS dof, (n - 2) % 2 AS odd FROM g),
    v AS (SELECT *, atan(abs(t) / sqrt(dof)) AS a FROM h),
    series(k, term, total) AS (
        SELECT 0, 1.0::DOUBLE, 1.0::DOUBLE
        UNION ALL
        SELECT k + 1, term * f, total + term * f FROM (
            SELECT k, term, total, (2.0::DOUBLE * k + 1 + odd) / (2.0::DOUBLE * k + 2 + odd) * cos(a) * cos(a) AS f FROM series, v WHERE k < (dof - 2 - odd) / 2)),
    z AS (SELECT max_by(total, k) AS total FROM series)
    SELECT n, {r("rr", 9)} AS rr, {r("t", 8)} AS t,
           {r("1 - CASE WHEN odd = 1 THEN 2 / pi() * (a + sin(a) * cos(a) * total) ELSE sin(a) * total END", 8)} AS p_value FROM v, z""")
def corr_p_value(t):
    """The same correlation with its two-sided p-value."""
    total = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sum("o_totalprice").alias("total"))
    g = t.customer.select("c_custkey", "c_acctbal").join(total, "c_custkey").agg(
        F.count(F.lit(1)).alias("n"), M.pearson("c_acctbal", "total").alias("rr"))
    out = g.withColumn("t", M.pearson_t("rr", "n"))
    return out.select("n", rounded("rr", 9).alias("rr"), rounded("t", 8).alias("t"), rounded(M.t_p_value("t", (F.col("n") - 2).cast("double")), 8).alias("p_value"))


_SPLIT = "('0x' || substr(sha256('1337:' || {k}), 1, 16))::UBIGINT::DOUBLE / 18446744073709551616.0::DOUBLE"


@query("heldout_semi", f"""
    SELECT l_orderkey, l_linenumber FROM lineitem
    WHERE year(l_shipdate) = 1999 AND {_SPLIT.format(k="lpad(l_orderkey::VARCHAR, 11, '0')")} >= 0.9""")
def heldout_semi(t):
    """Rows of one evaluation year whose key is in the held-out part of the split."""
    items = t.orders.select(F.lpad(F.col("o_orderkey").cast("string"), 11, "0").alias("k"), "o_orderkey")
    held = items.filter(H.split_bucket("k") == "test").select(F.col("o_orderkey").alias("l_orderkey"))
    in_year = F.col("l_shipdate").between("1999-01-01", "1999-12-31 23:59:59.999999")  # a range reaches the scan, year() does not
    rows = t.lineitem.filter(in_year).select("l_orderkey", "l_linenumber")
    return rows.join(held, "l_orderkey", "left_semi")


@query("stable_split", f"""
    SELECT c_custkey, CASE WHEN u < 0.8 THEN 'train' WHEN u < 0.9 THEN 'val' ELSE 'test' END AS split, {r("u", 9)} AS u
    FROM (SELECT c_custkey, {_SPLIT.format(k="c_custkey")} AS u FROM customer)""")
def stable_split(t):
    """Hash split of every key; the same key always lands in the same part."""
    return t.customer.select("c_custkey", H.split_bucket("c_custkey").alias("split"),
                             rounded(H.stable_unit_interval("c_custkey"), 9).alias("u"))


@query("key_intersect", """
    SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'""")
def key_intersect(t):
    """Keys that both sources hold."""
    k = F.col("o_custkey").alias("k")
    return t.orders.filter("o_orderstatus = 'F'").select(k).intersect(t.orders.filter("o_orderstatus = 'P'").select(k))


@query("unit_union", """
    SELECT year(l_shipdate)::INTEGER AS year, quarter(l_shipdate)::INTEGER AS quarter FROM lineitem
    UNION SELECT year(o_orderdate)::INTEGER, quarter(o_orderdate)::INTEGER FROM orders""")
def unit_union(t):
    """Units that occur on either side."""
    a = t.lineitem.select(F.year("l_shipdate").alias("year"), F.quarter("l_shipdate").alias("quarter")).distinct()
    b = t.orders.select(F.year("o_orderdate").alias("year"), F.quarter("o_orderdate").alias("quarter")).distinct()
    return a.union(b).distinct()


@query("dedup_priority", """
    SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (
        PARTITION BY o_custkey ORDER BY o_orderpriority, o_orderdate, o_orderkey) AS k FROM orders) WHERE k = 1""")
def dedup_priority(t):
    """First row per key by source priority."""
    df = t.orders.select("o_custkey", "o_orderkey", "o_totalprice", "o_orderpriority", "o_orderdate")
    out = R.first_per_key(df, ["o_custkey"], [F.col(c) for c in ("o_orderpriority", "o_orderdate", "o_orderkey")])
    return out.select("o_custkey", "o_orderkey", "o_totalprice")


@query("dedup_last", """
    SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (
        PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1""")
def dedup_last(t):
    """Last row per key wins."""
    df = t.events.select("user_id", "event_type", "event_id", "value", "ts")
    return R.last_per_key(df, ["user_id", "event_type"], [F.col("ts"), F.col("event_id")]).drop("ts")


@query("latest_version", """
    WITH v AS (SELECT DISTINCT l_suppkey, l_linenumber::INTEGER AS v FROM lineitem),
    m AS (SELECT l_suppkey, max(v) AS latest FROM v GROUP BY 1),
    g AS (SELECT l_suppkey, min(c)::INTEGER AS next_free FROM (
              SELECT m.l_suppkey, unnest(range(1, latest + 2)) AS c FROM m) x
          WHERE NOT EXISTS (SELECT 1 FROM v WHERE v.l_suppkey = x.l_suppkey AND v.v = x.c) GROUP BY 1)
    SELECT l_suppkey, latest, '/exp/v' || latest AS latest_name, next_free FROM m JOIN g USING (l_suppkey)""")
def latest_version(t):
    """Numeric latest version per experiment, and the lowest free number."""
    names = t.lineitem.select(
        "l_suppkey", F.concat(F.lit("/exp/v"), F.col("l_linenumber").cast("string")).alias("name"))
    return R.latest_version(names, ["l_suppkey"], "name", r"/v(\d+)$")


@query("root_prefix", """
    WITH n AS (SELECT 'part' || CASE WHEN p_size > 1 THEN '_' || p_type ELSE '' END AS name FROM part),
    m AS (SELECT arg_min(name, (length(name), name)) AS root FROM n)
    SELECT CASE WHEN bool_and(ok) THEN any_value(root) END AS root, bool_and(ok) AS consistent, count(*) AS n_names
    FROM (SELECT root, name = root OR starts_with(name, root || '_') AS ok FROM n, m)""")
def root_prefix(t):
    """The shortest name that every other one extends."""
    name = F.concat(F.lit("part"), F.when(F.col("p_size") > 1, F.concat(F.lit("_"), "p_type")).otherwise(""))
    return R.shortest_root(t.part.select(name.alias("name")), "name")


@query("sample_per_group", """
    SELECT l_returnflag, l_orderkey, l_linenumber, l_partkey, l_suppkey FROM (SELECT *, row_number() OVER (
        PARTITION BY l_returnflag ORDER BY md5('7:' || l_orderkey || ':' || l_linenumber || ':' || l_partkey || ':' || l_suppkey)) AS k
        FROM lineitem) WHERE k <= 50""")
def sample_per_group(t):
    """At most 50 rows per group in hash order."""
    df = t.lineitem.select("l_returnflag", *X.LINE_KEY, H.hash_order(F.lit(7), *X.LINE_KEY).alias("_h"))
    return R.sample_per_group(df, ["l_returnflag"], "_h", 50).drop("_h")
