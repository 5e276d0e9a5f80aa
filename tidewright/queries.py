"""Registered queries of the conversion engine, each through its operator, with the SQL that gives the same rows."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.types import LField, scalar
from .operators.analytical import diff_schemas, latest_registry, upsert
from .operators.convert import sanitize
from .operators.events import wide_to_events, write_hive
from .operators.writers import write_csv, write_jsonl, write_parquet
from .plans import registry as reg
from .plans.pipeline import assign_windows
from .session import scratch
from .sources.files import beside, manifest_frame, publish

ETL = ("schema_registry", "schema_drifts", "source_file", "ingestion_timestamp")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _data(result) -> DataFrame:
    return result.dataframe.drop(*ETL)


def _lines(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])).alias("value"))


def names_lower_alpha_lineitem(spark, sf_dir):
    return _data(sanitize(spark, _table(spark, sf_dir, "lineitem")))


def names_lower_snake_customer(spark, sf_dir):
    c = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("Cust Key#"), F.col("c_name").alias("  Name--Full "), F.col("c_acctbal").alias("1st.Balance"))
    return _data(sanitize(spark, c, field_name_policy="lower_snake"))


def names_collision(spark, sf_dir):
    o = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("User-ID"), F.col("o_custkey").alias("user id"), "o_totalprice")
    return _data(sanitize(spark, o))


def infer_events_props(spark, sf_dir):
    e = _table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", F.from_json("props", "k long").alias("props"))
    out = _data(sanitize(spark, _lines(e), input_format="jsonl"))
    return out.select("eventid", "userid", "eventtype", "value", F.col("props.k").alias("k"))


def parse_text_orders(spark, sf_dir):
    o = _table(spark, sf_dir, "orders")
    text = o.select(*[F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(c) if c == "o_orderdate" else F.col(c).cast("string").alias(c) for c in o.columns])
    return _data(sanitize(spark, _lines(text), input_format="jsonl", parse_integers=True, parse_floats=True, parse_iso_timestamps=True))


def parse_text_columns(spark, sf_dir):
    """The column twins: a typed contract takes text columns apart without Python."""
    o = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("key"), F.format_number("o_totalprice", 2).alias("price"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))
    contract = reg.merge([LField("day", scalar("date32")), LField("key", scalar("int64")), LField("price", scalar("float64"))]).registry
    return _data(sanitize(spark, o, schema_registry=contract, schema_mode="strict", parse_integers=True, parse_floats=True, parse_iso_dates=True))


def parse_float_grouped(spark, sf_dir):
    t = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.format_number("l_extendedprice", 2).alias("price"))
    return _data(sanitize(spark, _lines(t), input_format="jsonl", parse_floats=True))


def bool_tokens_status(spark, sf_dir):
    t = _table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    return _data(sanitize(spark, _lines(t), input_format="jsonl", true_tokens=("f",), false_tokens=("O", "P")))


def int_float_promote(spark, sf_dir):
    key = F.col("o_orderkey")
    t = _table(spark, sf_dir, "orders").select(F.format_string('{"k":%d,"v":%s}', key, F.when(key % 2 == 0, key.cast("string")).otherwise(F.concat(key.cast("string"), F.lit(".5")))).alias("value"))
    return _data(sanitize(spark, t, input_format="jsonl"))


def mixed_to_string(spark, sf_dir):
    key = F.col("c_custkey")
    t = _table(spark, sf_dir, "customer").select(F.format_string('{"k":%d,"v":%s}', key, F.when(key % 2 == 0, key.cast("string")).otherwise(F.to_json(F.struct("c_name")).substr(F.lit(11), F.length("c_name") + 2))).alias("value"))
    return _data(sanitize(spark, t, input_format="jsonl"))


def empty_to_null(spark, sf_dir):
    key = F.col("p_partkey")
    t = _table(spark, sf_dir, "part").select(F.format_string('{"k":%d,"l":%s,"s":%s,"never":[]}', key, F.when(key % 2 == 0, "[]").otherwise(F.format_string("[%d]", key)), F.when(key % 3 == 0, "{}").otherwise(F.format_string('{"a":%d}', key))).alias("value"))
    return _data(sanitize(spark, t, input_format="jsonl")).select("k", F.col("l")[0].alias("l0"), F.col("s.a").alias("a"), F.col("l").isNull().alias("lnull"), F.col("s").isNull().alias("snull"))


def list_wrap(spark, sf_dir):
    key = F.col("c_custkey")
    t = _table(spark, sf_dir, "customer").select(F.format_string('{"k":%d,"v":%s}', key, F.when(key % 2 == 0, F.format_string("[%d,1]", key)).otherwise(key.cast("string"))).alias("value"))
    return _data(sanitize(spark, t, input_format="jsonl")).select("k", F.array_join(F.col("v").cast("array<string>"), "|").alias("v"))


def struct_default_key(spark, sf_dir):
    key = F.col("c_custkey")
    t = _table(spark, sf_dir, "customer").select(F.format_string('{"k":%d,"v":%s}', key, F.when(key % 2 == 0, F.format_string('{"n":%d}', key)).otherwise(key.cast("string"))).alias("value"))
    return _data(sanitize(spark, t, input_format="jsonl")).select("k", F.col("v.n").alias("n"), F.col("v.default_key").alias("d"))


def depth_flatten(spark, sf_dir):
    n, r = _table(spark, sf_dir, "nation"), _table(spark, sf_dir, "region")
    t = n.join(r, n.n_regionkey == r.r_regionkey).select("n_nationkey", F.struct("n_name", F.struct("r_name").alias("region")).alias("place"))
    return _data(sanitize(spark, _lines(t), input_format="jsonl", parquet_max_depth=1))


def _amounts(spark, sf_dir) -> DataFrame:
    key = F.col("o_orderkey")
    return _table(spark, sf_dir, "orders").select(F.format_string('{"k":%d,"amount":%s}', key, F.when(key % 2 == 0, key.cast("string")).otherwise(F.format_string('"x%d"', key))).alias("value"))


def variant_route_amount(spark, sf_dir):
    before = reg.merge([LField("amount", scalar("int64")), LField("k", scalar("int64"))]).registry
    return _data(sanitize(spark, _amounts(spark, sf_dir), input_format="jsonl", schema_registry=before, field_name_policy="lower_snake"))


def _contract():
    return reg.merge([LField("amount", scalar("int64")), LField("k", scalar("int64"))]).registry


def emit_null_row(spark, sf_dir):
    return _data(sanitize(spark, _amounts(spark, sf_dir), input_format="jsonl", schema_registry=_contract(), schema_mode="strict"))


def skip_row(spark, sf_dir):
    return _data(sanitize(spark, _amounts(spark, sf_dir), input_format="jsonl", schema_registry=_contract(), schema_mode="strict", on_error="skip_row"))


def publish_csv(df: DataFrame, path: str) -> None:
    """One CSV file of a DataFrame, without generated columns."""
    folder = beside(path)
    df.coalesce(1).write.option("header", True).csv(folder)
    publish(df.sparkSession, folder, path)


def write_parquet_file(df: DataFrame, path: str) -> None:
    folder = beside(path)
    df.coalesce(1).write.parquet(folder)
    publish(df.sparkSession, folder, path)


def csv_union_headers(spark, sf_dir):
    s = _table(spark, sf_dir, "supplier")
    folder = scratch(spark, "csv-union")
    for name, columns in (("a", ["s_suppkey", "s_name"]), ("b", ["s_name", "s_suppkey"]), ("c", ["s_suppkey", "s_acctbal"])):
        publish_csv(s.select(*columns), f"{folder}/{name}.csv")
    out = sanitize(spark, folder, input_format="csv", input_mode="directory", csv_header_mode="union", field_name_policy="preserve", parse_integers=True, parse_floats=True)
    return out.dataframe.select("s_suppkey", "s_name", "s_acctbal", F.regexp_extract("source_file", r"([^/]+)$", 1).alias("file"))


def etl_columns(spark, sf_dir):
    out = sanitize(spark, _lines(_table(spark, sf_dir, "nation")), input_format="jsonl").dataframe
    return out.agg(F.count("*").alias("n"), F.count("schema_registry").alias("registries"), F.count("schema_drifts").alias("drifts"), F.count_distinct("ingestion_timestamp").alias("stamps"))


def hive_partition_counts(spark, sf_dir):
    """Orders written by day and counted as they are read back."""
    written = write_hive(_table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), scratch(spark, "hive"), "o_orderdate")
    return written.groupBy("year", "month", "day").agg(F.count("*").alias("n"))


def utc_window_assign(spark, sf_dir):
    e = assign_windows(_table(spark, sf_dir, "events"), "ts", dt.date(1990, 1, 1), dt.date(2100, 12, 31))
    return e.groupBy("window_start", "window_end").agg(F.count("*").alias("n"), F.max("value").alias("most"))


def latest_registry_of_events(spark, sf_dir):
    e = _table(spark, sf_dir, "events").select(F.format_string('{"schema_generation":%d,"event":%d}', F.col("user_id"), F.col("event_id")).alias("schema_registry"), F.date_trunc("day", "ts").alias("ingestion_timestamp"), F.col("event_id").alias("part"))
    return latest_registry(e, ("part",))


def sidecar_merge(spark, sf_dir):
    c = _table(spark, sf_dir, "customer")
    old = c.select("c_custkey", "c_name", F.col("c_mktsegment").alias("state"))
    new = c.select((2 * F.col("c_custkey")).alias("c_custkey"), "c_name", F.lit("new").alias("state"))
    return upsert(old, new, "c_custkey")


def schema_diff(spark, sf_dir):
    d = diff_schemas(_table(spark, sf_dir, "supplier").withColumnRenamed("s_suppkey", "key").schema, _table(spark, sf_dir, "supplier").withColumn("s_nationkey", F.col("s_nationkey").cast("long")).schema)
    rows = [("added", p) for p in d.added_paths] + [("removed", p) for p in d.removed_paths] + [("changed", p) for p in d.changed_paths]
    return spark.createDataFrame(rows, "change string, path string")


def registry_drifts(spark, sf_dir):
    """Drift events of an incompatible batch, as rows."""
    c = _table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    first = sanitize(spark, c, field_name_policy="lower_snake")
    again = sanitize(spark, c.select(F.col("c_custkey").cast("string").alias("c_custkey"), "c_acctbal", F.lit(True).alias("active")), field_name_policy="lower_snake", schema_registry=first.schema_registry)
    return spark.createDataFrame([(d["source_path"], d["output_name"], d["drift_type"], d["new_schema"]) for d in again.schema_drifts], "source_path string, output_name string, drift_type string, new_schema string")


def wide_events(spark, sf_dir):
    t = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_quantity") > 25, F.col("l_returnflag")).alias("1/flag"), F.col("l_linestatus").alias("2/status"))
    return wide_to_events(t, drop_null=True).select("l_orderkey", "l_linenumber", F.size("event").alias("n"), F.array_join(F.transform("event", lambda e: F.concat_ws(":", e["event_id"].cast("string"), e["event_text"], e["payload"])), ",").alias("events"))


def xml_rows(spark, sf_dir):
    o = _table(spark, sf_dir, "orders")
    one = F.format_string('<order id="%d"><status>%s</status><note>a &amp; b</note><key> %d </key></order>', F.col("o_orderkey"), F.col("o_orderstatus"), F.col("o_custkey"))
    t = o.groupBy(F.pmod("o_orderkey", F.lit(16)).alias("g")).agg(F.concat(F.lit("<orders>"), F.array_join(F.sort_array(F.collect_list(one)), ""), F.lit("</orders>")).alias("value")).select("value")
    return _data(sanitize(spark, t, input_format="xml", xml_row_tag="order", parse_integers=True))


def parquet_typing(spark, sf_dir):
    p = _table(spark, sf_dir, "part").select("p_partkey", F.col("p_retailprice").cast("decimal(12,2)").alias("price"), F.col("p_name").cast("binary").alias("raw"), F.col("p_size").cast("smallint").alias("size"), F.lit(None).alias("nothing"))
    return _data(sanitize(spark, p))


def _round_trip(spark, sf_dir, write, suffix: str, **given):
    c = _table(spark, sf_dir, "customer")
    path = f"{scratch(spark, 'round-trip')}/customer.{suffix}"
    write(sanitize(spark, c.select("c_custkey", F.concat(F.lit('a "q", '), "c_name").alias("c_name"), "c_acctbal"), field_name_policy="preserve"), path)
    return _data(sanitize(spark, spark.read.parquet(path).drop(*ETL) if suffix == "parquet" else path, field_name_policy="preserve", **given)) if suffix == "parquet" else sanitize(spark, _without_etl(spark, path, suffix), field_name_policy="preserve", **given).dataframe.select("c_acctbal", "c_custkey", "c_name")


def _without_etl(spark, path: str, suffix: str) -> str:
    """The generated columns of an earlier conversion are reserved names; give them others to read the file again."""
    out = path.replace(f".{suffix}", f"_again.{suffix}")
    df = spark.read.text(path)
    for name in ETL:
        df = df.select(F.replace(F.col("value"), F.lit(name), F.lit("old_" + name.split("_")[-1] + "_" + name.split("_")[0])).alias("value"))
    folder = beside(out)
    df.coalesce(1).write.text(folder)
    publish(spark, folder, out)
    return out


def jsonl_roundtrip(spark, sf_dir):
    return _round_trip(spark, sf_dir, write_jsonl, "jsonl", input_format="jsonl")


def csv_roundtrip(spark, sf_dir):
    return _round_trip(spark, sf_dir, write_csv, "csv", input_format="csv", parse_integers=True, parse_floats=True)


def parquet_roundtrip(spark, sf_dir):
    return _round_trip(spark, sf_dir, write_parquet, "parquet")


def manifest_order(spark, sf_dir):
    """Pages as objects: identities are unique, in order of uri and generation."""
    return manifest_frame(_table(spark, sf_dir, "pages"), "url", "page_id")


def parquet_mixed_registry(spark, sf_dir):
    """A folder of Parquet files with two schemas: all rows, and the registry and drifts of one batch."""
    s = _table(spark, sf_dir, "supplier")
    folder = scratch(spark, "mixed")
    write_parquet_file(s.filter("s_suppkey % 3 = 0").select("s_suppkey", "s_name"), f"{folder}/a.parquet")
    write_parquet_file(s.filter("s_suppkey % 3 <> 0").select("s_suppkey", "s_acctbal"), f"{folder}/b.parquet")
    r = sanitize(spark, folder, input_format="parquet", input_mode="directory", field_name_policy="preserve")
    drifts = ",".join(sorted(f"{d['drift_type']}:{d['output_name']}" for d in r.schema_drifts))
    return _data(r).select("s_suppkey", "s_name", "s_acctbal", F.lit(r.schema_registry["schema_generation"]).cast("long").alias("generation"), F.lit(drifts).alias("drifts"))


_AMOUNT = "CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey END"

SQL = {
    "names_lower_alpha_lineitem": "SELECT l_discount AS ldiscount, l_extendedprice AS lextendedprice, CAST(l_linenumber AS BIGINT) AS llinenumber, l_linestatus AS llinestatus, l_orderkey AS lorderkey, l_partkey AS lpartkey, l_quantity AS lquantity, l_returnflag AS lreturnflag, l_shipdate AS lshipdate, l_suppkey AS lsuppkey, l_tax AS ltax FROM lineitem",
    "names_lower_snake_customer": "SELECT c_custkey AS cust_key, c_name AS name_full, c_acctbal AS field_1st_balance FROM customer",
    "names_collision": "SELECT o_orderkey AS useridorojrd, o_custkey AS useridrpvqmr, o_totalprice AS ototalprice FROM orders",
    "infer_events_props": "SELECT event_id AS eventid, user_id AS userid, event_type AS eventtype, value, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events",
    "parse_text_orders": "SELECT o_custkey AS ocustkey, o_orderdate AS oorderdate, o_orderkey AS oorderkey, o_orderpriority AS oorderpriority, o_orderstatus AS oorderstatus, o_totalprice AS ototalprice FROM orders",
    "parse_text_columns": "SELECT o_orderkey AS key, round(o_totalprice, 2) AS price, CAST(o_orderdate AS DATE) AS day FROM orders",
    "parse_float_grouped": "SELECT l_orderkey AS lorderkey, CAST(l_linenumber AS BIGINT) AS llinenumber, round(l_extendedprice, 2) AS price FROM lineitem",
    "bool_tokens_status": "SELECT o_orderkey AS oorderkey, o_orderstatus = 'F' AS oorderstatus FROM orders",
    "int_float_promote": "SELECT o_orderkey AS k, CAST(o_orderkey AS DOUBLE) + CASE WHEN o_orderkey % 2 = 0 THEN 0 ELSE 0.5 END AS v FROM orders",
    "mixed_to_string": "SELECT c_custkey AS k, CASE WHEN c_custkey % 2 = 0 THEN CAST(c_custkey AS VARCHAR) ELSE c_name END AS v FROM customer",
    "empty_to_null": "SELECT p_partkey AS k, CASE WHEN p_partkey % 2 = 1 THEN p_partkey END AS l0, CASE WHEN p_partkey % 3 <> 0 THEN p_partkey END AS a, p_partkey % 2 = 0 AS lnull, p_partkey % 3 = 0 AS snull FROM part",
    "list_wrap": "SELECT c_custkey AS k, CAST(c_custkey AS VARCHAR) || CASE WHEN c_custkey % 2 = 0 THEN '|1' ELSE '' END AS v FROM customer",
    "struct_default_key": "SELECT c_custkey AS k, CASE WHEN c_custkey % 2 = 0 THEN c_custkey END AS n, CASE WHEN c_custkey % 2 = 1 THEN c_custkey END AS d FROM customer",
    "depth_flatten": """SELECT CAST(n_nationkey AS BIGINT) AS nnationkey, '{"n_name":"' || n_name || '","region":{"r_name":"' || r_name || '"}}' AS placeflattened FROM nation JOIN region ON n_regionkey = r_regionkey""",
    "variant_route_amount": f"SELECT {_AMOUNT} AS amount, CASE WHEN o_orderkey % 2 = 1 THEN 'x' || CAST(o_orderkey AS VARCHAR) ELSE CAST(NULL AS VARCHAR) END AS amount_v2_string, o_orderkey AS k FROM orders",
    "emit_null_row": f"SELECT {_AMOUNT} AS amount, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey END AS k FROM orders",
    "skip_row": "SELECT o_orderkey AS amount, o_orderkey AS k FROM orders WHERE o_orderkey % 2 = 0",
    "csv_union_headers": "SELECT s_suppkey, s_name, CAST(NULL AS DOUBLE) AS s_acctbal, 'a.csv' AS file FROM supplier UNION ALL SELECT s_suppkey, s_name, NULL, 'b.csv' FROM supplier UNION ALL SELECT s_suppkey, NULL, s_acctbal, 'c.csv' FROM supplier",
    "etl_columns": "SELECT count(*) AS n, CAST(1 AS BIGINT) AS registries, CAST(1 AS BIGINT) AS drifts, CAST(1 AS BIGINT) AS stamps FROM nation",
    "hive_partition_counts": "SELECT CAST(year(o_orderdate) AS INTEGER) AS year, CAST(month(o_orderdate) AS INTEGER) AS month, CAST(day(o_orderdate) AS INTEGER) AS day, count(*) AS n FROM orders GROUP BY ALL",
    "utc_window_assign": "SELECT date_trunc('day', ts) AS window_start, date_trunc('day', ts) + INTERVAL 1 DAY AS window_end, count(*) AS n, max(value) AS most FROM events GROUP BY 1, 2",
    "latest_registry_of_events": """SELECT '{"schema_generation":' || user_id || ',"event":' || event_id || '}' AS schema_registry FROM events ORDER BY date_trunc('day', ts) DESC, user_id DESC, event_id DESC LIMIT 1""",
    "sidecar_merge": "SELECT 2 * c_custkey AS c_custkey, c_name, 'new' AS state FROM customer UNION ALL SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE c_custkey NOT IN (SELECT 2 * c_custkey FROM customer)",
    "schema_diff": "SELECT * FROM (VALUES ('added', 's_suppkey'), ('removed', 'key'), ('changed', 's_nationkey')) AS t(change, path)",
    "registry_drifts": "SELECT * FROM (VALUES ('active', 'active', 'newly_added', 'bool'), ('c_custkey', 'c_custkey_v2_string', 'new_version_generated', 'string')) AS t(source_path, output_name, drift_type, new_schema)",
    "wide_events": "SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity > 25 THEN 2 ELSE 1 END AS n, CASE WHEN l_quantity > 25 THEN '1:flag:' || l_returnflag || ',' ELSE '' END || '2:status:' || l_linestatus AS events FROM lineitem",
    "xml_rows": "SELECT o_orderkey AS id, o_orderstatus AS status, 'a & b' AS note, o_custkey AS key FROM orders",
    "parquet_typing": "SELECT p_partkey AS ppartkey, CAST(CAST(p_retailprice AS DECIMAL(12,2)) AS VARCHAR) AS price, base64(encode(p_name)) AS raw, CAST(p_size AS BIGINT) AS size FROM part",
    "jsonl_roundtrip": "SELECT c_acctbal, c_custkey, 'a \"q\", ' || c_name AS c_name FROM customer",
    "csv_roundtrip": "SELECT c_acctbal, c_custkey, 'a \"q\", ' || c_name AS c_name FROM customer",
    "parquet_roundtrip": "SELECT c_acctbal, c_custkey, 'a \"q\", ' || c_name AS c_name FROM customer",
    "parquet_mixed_registry": "SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN s_name END AS s_name, CASE WHEN s_suppkey % 3 <> 0 THEN s_acctbal END AS s_acctbal, CAST(2 AS BIGINT) AS generation, 'newly_added:s_acctbal,newly_added:s_name,newly_added:s_suppkey' AS drifts FROM supplier",
    "manifest_order": "SELECT url, page_id FROM pages GROUP BY url, page_id HAVING count(*) = 1",
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: globals()[name] for name in SQL}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as JSON Lines: inferred, registered, materialised, with generated columns."""
    e = _table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", F.from_json("props", "k long").alias("props"))
    return sanitize(spark, _lines(e), input_format="jsonl").dataframe
