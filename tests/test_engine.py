"""Conversions end to end: readers, policies, routing, invariance under partitioning, writers, pipelines, streaming."""

import datetime as dt
import decimal
import json
import os

import pytest
from pyspark.errors import PythonException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewright.errors import IntegrityError, InvalidArgumentError, ResourceError
from tidewright.functions import columns as col
from tidewright.functions.scalars import Parsers
from tidewright.functions.types import LField, list_of, scalar, struct
from tidewright.operators import analytical, events
from tidewright.operators.convert import sanitize
from tidewright.operators.writers import iter_batches, to_csv, to_duckdb, to_jsonl, to_pandas, to_parquet, to_pyarrow
from tidewright.options import Options
from tidewright.plans import bigquery as bq
from tidewright.plans import registry as reg
from tidewright.plans.pipeline import HivePartitions, ParquetPipeline, warm_up_registry
from tidewright.sources import discover, list_objects, publish_file_atomic, readers
from tidewright.streaming import convert_stream

ETL = ("schema_registry", "schema_drifts", "source_file", "ingestion_timestamp")


def rows(result):
    return [r.asDict(recursive=True) for r in result.ordered().drop(*ETL).collect()]


def write(folder, **files):
    for name, text in files.items():
        path = folder / name.replace("__", ".")
        path.write_bytes(text if isinstance(text, bytes) else text.encode())
    return str(folder)


def test_names_depths_and_nesting(spark):
    r = sanitize(spark, [{"User-ID": 1, "Full Name": "Ana", "nested-Obj": {"Bad.Key": 2, "UPPER": 3}, "user id": 4}])
    assert rows(r) == [{"fullname": "Ana", "nestedobj": {"badkey": 2, "upper": 3}, "useridorojrd": 1, "useridrpvqmr": 4}]
    r = sanitize(spark, [{"a": {"b": {"c": 1}}}] * 2, parquet_max_depth=1)
    assert rows(r) == [{"aflattened": '{"b":{"c":1}}'}] * 2
    assert [str(f.type) for f in sanitize(spark, [{"value": [{"a": 1}]}], arrow_max_depth=2).fields] == ["list<item: struct<a: int64>>"]
    assert rows(sanitize(spark, [{"v": [[1, 2], [3]]}, {"v": [[4]]}])) == [{"v": ["[1,2]", "[3]"]}, {"v": ["[4]"]}]
    assert rows(sanitize(spark, [{"v": [{"a": 1}]}, {"v": [{"a": "x"}]}, {"v": []}])) == [{"v": [{"a": "1"}]}, {"v": [{"a": "x"}]}, {"v": None}]


def test_order_of_scalars_and_containers(spark):
    assert rows(sanitize(spark, [{"a": "x"}, {"a": [1]}])) == [{"a": None}, {"a": [1]}]
    assert rows(sanitize(spark, [{"a": [1]}, {"a": "x"}])) == [{"a": ["1"]}, {"a": ["x"]}]
    assert rows(sanitize(spark, [{"a": 5}, {"a": {"b": 1}}, {"a": 7}])) == [{"a": {"b": None, "default_key": v}} if v else {"a": {"b": 1, "default_key": None}} for v in (5, None, 7)]


def test_policies(spark):
    source = [{"id": 1, "user": {"id": 1}}, {"id": 2, "user": {"id": "oops"}}, {"id": 3, "user": {"id": 3}}]
    contract = reg.merge([LField("id", scalar("int64")), LField("user", struct([LField("id", scalar("int64"))]))]).registry
    how = dict(schema_registry=contract, schema_mode="strict")
    assert [r["id"] for r in rows(sanitize(spark, source, on_error="skip_row", **how))] == [1, 3]
    assert rows(sanitize(spark, source, **how))[1] == {"id": None, "user": None}
    with pytest.raises(Exception, match="expected an integer"):
        rows(sanitize(spark, source, on_error="stop", **how))
    with pytest.raises(Exception, match="contract lacks"):
        rows(sanitize(spark, [{"id": 1, "more": 2}], on_error="skip_row", **how))


def test_variants_take_what_fits(spark):
    contract = reg.merge([LField("value", scalar("utf8")), LField("value_v2_integer", scalar("int64")), LField("value_v3_boolean", scalar("bool"))]).registry
    got = rows(sanitize(spark, [{"value": x} for x in ("text", 7, True, " 7 ")], schema_registry=contract, schema_mode="strict", field_name_policy="lower_snake", parse_integers=True))
    assert [[k for k, v in r.items() if v is not None] for r in got] == [["value"], ["value_v2_integer"], ["value_v3_boolean"], ["value_v2_integer"]]
    lists = reg.merge([LField("s", struct([LField("a", scalar("int64"))])), LField("s_v2_struct_array", list_of(struct([LField("a", scalar("int64"))])))]).registry
    got = rows(sanitize(spark, [{"s": {"a": 1}}, {"s": [{"a": 2}]}], schema_registry=lists, schema_mode="strict", field_name_policy="lower_snake"))
    assert [r["s_v2_struct_array"] for r in got] == [[{"a": 1}], [{"a": 2}]] and all(r["s"] is None for r in got)


def test_jsonl_errors_duplicates_and_provenance(spark, tmp_path):
    path = os.path.join(write(tmp_path, a__jsonl='{"a":1,"a":2}\n{broken\n\n5\n'), "a.jsonl")
    r = sanitize(spark, path, input_format="jsonl")
    assert rows(r) == [{"a": 1, "default_key": None}, {"a": None, "default_key": None}, {"a": None, "default_key": 5}]
    full = r.ordered().collect()
    assert full[0].schema_registry and not full[1].schema_registry and full[0].source_file.endswith("a.jsonl") and full[1].source_file is None
    assert json.loads(full[0].schema_drifts)[0]["drift_type"] == "newly_added"
    assert len({x.ingestion_timestamp for x in full}) == 1
    assert len(rows(sanitize(spark, path, input_format="jsonl", on_error="skip_row"))) == 2
    with pytest.raises(InvalidArgumentError):
        sanitize(spark, path, input_format="csv")
    with pytest.raises(InvalidArgumentError):
        sanitize(spark, path)
    with pytest.raises(Exception, match="generated column"):
        sanitize(spark, [{"source_file": "x"}])


def test_documents_arrays_xml_and_encodings(spark, tmp_path):
    folder = write(tmp_path, a__json='{"x":1}', b__json='[{"x":2},{"x":3}]', c__xml="<r><o><k>1</k></o><o><k>2</k></o></r>", d__csv="k;v\n1;ä\n".encode("utf-16"))
    assert rows(sanitize(spark, folder, input_format="json", input_mode="directory")) == [{"x": 1}, {"x": 2}, {"x": 3}]
    assert rows(sanitize(spark, f"{folder}/b.json", input_format="json_array")) == [{"x": 2}, {"x": 3}]
    with pytest.raises(Exception, match="no JSON array"):
        rows(sanitize(spark, f"{folder}/a.json", input_format="json_array"))
    assert rows(sanitize(spark, f"{folder}/c.xml", input_format="xml", xml_row_tag="o", parse_integers=True)) == [{"k": 1}, {"k": 2}]
    assert rows(sanitize(spark, f"{folder}/d.csv", input_format="csv", csv_delimiter=";", input_text_encoding="utf-16")) == [{"k": "1", "v": "ä"}]


@pytest.mark.parametrize("size", [1, 7, 64, 1 << 20])
def test_xml_documents_go_to_workers_in_pieces(spark, tmp_path, monkeypatch, size):
    monkeypatch.setattr(readers, "PIECE", size)
    docs = ["<r><o><k>1</k><t>ä😀</t></o>\n<p/><o><k>2</k></o></r>", "<r/>", "\ufeff<r><o><k>3</k><t>&lt;é</t></o></r>"]
    want = [{"k": 1, "t": "ä😀"}, {"k": 2, "t": None}, {"k": 3, "t": "<é"}]
    frame = spark.createDataFrame([(d,) for d in docs], "value string").coalesce(1)
    got = readers.open_lines(frame, Options.of(input_format="xml")).units.collect()
    assert max(len(r["unit"]) for r in got) <= size and [r["last"] for r in got].count(True) == 3
    assert b"".join(r["unit"] for r in got).decode() == "".join(docs)
    how = dict(input_format="xml", xml_row_tag="o", parse_integers=True)
    assert rows(sanitize(spark, frame, **how)) == want
    for encoding in ("utf-8", "utf-16"):
        folder = tmp_path / encoding
        folder.mkdir()
        write(folder, **{f"{n}__xml": d.encode(encoding) for n, d in zip("abc", docs)})
        assert rows(sanitize(spark, str(folder), input_mode="directory", input_text_encoding=encoding, **how)) == want
    with pytest.raises(PythonException, match="IntegrityError"):  # also of rows before the fault nothing is given
        sanitize(spark, spark.createDataFrame([("<r><o>1</o><o>2</o>",), ("",)], "value string"), **how)


def test_csv_exact_and_union(spark, tmp_path):
    (tmp_path / "e").mkdir()
    (tmp_path / "u").mkdir()
    write(tmp_path / "e", a__csv='id,name,\n1,"multi\nline",x\n2,,,more\n')
    assert rows(sanitize(spark, str(tmp_path / "e/a.csv"), input_format="csv", parse_integers=True, field_name_policy="preserve")) == [{"2": "x", "3": None, "id": 1, "name": "multi\nline"}, {"2": None, "3": "more", "id": 2, "name": None}]
    folder = write(tmp_path / "u", a__csv="id,name\n1,a\n", b__csv="name,id\nb,2\n", c__csv="id\n3\n", d__csv="id,name,extra,none\n4,d,x,\n")
    r = sanitize(spark, folder, input_format="csv", input_mode="directory", csv_header_mode="union", field_name_policy="preserve")
    assert [(x["id"], x["name"], x["extra"], x["none"]) for x in rows(r)] == [("1", "a", None, None), ("2", "b", None, None), ("3", None, None, None), ("4", "d", "x", None)]
    with pytest.raises(IntegrityError):
        sanitize(spark, folder, input_format="csv", input_mode="directory")
    write(tmp_path / "e", b__csv="a,a\n1,2\n", c__csv="A b,a-b\n1,2\n")
    for bad in ("b.csv", "c.csv"):
        with pytest.raises(IntegrityError):
            sanitize(spark, str(tmp_path / "e" / bad), input_format="csv")
    headless = rows(sanitize(spark, str(tmp_path / "u/a.csv"), input_format="csv", csv_has_header=False, field_name_policy="preserve"))
    assert headless == [{"0": "id", "1": "name"}, {"0": "1", "1": "a"}]


def test_same_result_for_every_partitioning(spark):
    source = [{"k": i, "v": [1, "x", [2], {"b": 1}, [{"b": "y"}], None, {"b": [1]}][i * 7 % 7 if i % 3 else i % 7]} for i in range(60)]
    lines = [json.dumps(x) for x in source]
    seen = set()
    for n in (1, 2, 8):
        frame = spark.createDataFrame(spark.sparkContext.parallelize([(x,) for x in lines], n), "value string")
        r = sanitize(spark, frame, input_format="jsonl", detected_at="2020-01-01T00:00:00Z")
        seen.add((r.schema_registry_json, r.schema_drifts_json, json.dumps(rows(r), default=str)))
    assert len(seen) == 1


def test_typed_frames(spark, tmp_path):
    schema = "i int, f float, d decimal(10,2), b binary, m map<string,int>, t timestamp_ntz, day date, s struct<`A b`:int>, n void"
    df = spark.createDataFrame([(1, 0.5, decimal.Decimal("1.50"), b"ab", {"x": 1}, dt.datetime(2024, 1, 2), dt.date(2024, 1, 2), (5,), None)], schema)
    got = rows(sanitize(spark, df))[0]
    assert got == {"b": "YWI=", "d": "1.50", "day": dt.date(2024, 1, 2), "f": 0.5, "i": 1, "m": [{"key": "x", "value": 1}], "s": {"ab": 5}, "t": dt.datetime(2024, 1, 2)}
    df.drop("n").write.parquet(str(tmp_path / "p.parquet"))
    r = sanitize(spark, str(tmp_path / "p.parquet"), input_format="parquet")
    assert rows(r)[0] == got and r.ordered().first().schema_registry
    contract = reg.merge([LField("d", scalar("float64")), LField("i", scalar("utf8"))], field_name_policy="lower_snake").registry
    text = spark.createDataFrame([("1.5", 1), ("x", 2)], "d string, i int")
    assert rows(sanitize(spark, text, schema_registry=contract, schema_mode="strict", parse_floats=True, field_name_policy="lower_snake")) == [{"d": 1.5, "i": "1"}, {"d": None, "i": None}]


def test_parquet_that_spark_refuses(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    stamps = pa.array([-1_500, 1_704_164_645_123_456_789], pa.timestamp("ns"))
    pq.write_table(pa.table({"t": pa.array([3_723_004, None], pa.time32("ms")), "n": stamps, "u": pa.array([1, 2**64 - 1], pa.uint64())}), tmp_path / "x.parquet")
    got = rows(sanitize(spark, str(tmp_path / "x.parquet"), input_format="parquet"))
    assert [(r["t"], r["n"]) for r in got] == [("01:02:03.004", dt.datetime(1969, 12, 31, 23, 59, 59, 999999)), (None, dt.datetime(2024, 1, 2, 3, 4, 5, 123456))]
    assert [r["u"] for r in got] == ["1", str(2**64 - 1)]


def test_column_twins_agree(spark):
    texts = ["", " ", "1", "-1", "+1", " 7 ", "1.0", "1,234.5", "1,23", ".5", "5.", "1e3", "9223372036854775808", "yes", "NO ", "2024-01-02", "2024-02-30", "23:59:59", "24:00:00", "2024-01-02T03:04:05", "2024-01-02 03:04:05.123456789Z", "1969-12-31T23:59:59.9999995", "2024-01-02T03:04:05+01:30", "1600-01-01T00:00:00", "2024-01-02T03:04:05+25:00", "x\n", "1\n"]
    o = Options.of(parse_integers=True, parse_floats=True, parse_iso_dates=True, parse_iso_times=True, parse_iso_timestamps=True, true_tokens=("Yes",), false_tokens=("no",))
    p = Parsers(o)
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    s = F.col("s")
    got = df.select("s", col.parse_bool(s, o).alias("b"), col.parse_int64(s, o).alias("i"), col.parse_float64(s, o).alias("f"), F.unix_date(col.parse_date32(s, o)).alias("d"), col.parse_time32(s, o).alias("t"), F.unix_micros(col.parse_timestamp(s, o).cast("timestamp")).alias("ts"), col.kind_mask(s, o).alias("k")).collect()
    from tidewright.functions.scalars import BITS

    for r in got:
        assert (r.b, r.i, r.f, r.d, r.t, r.ts) == (p.bool(r.s), p.int64(r.s), p.float64(r.s), p.date32(r.s), p.time32(r.s), p.timestamp(r.s)), r.s
        assert r.k == BITS[p.kind_of(r.s)], r.s


def test_writers(spark, tmp_path):
    source = [{"a": 'x "y", z', "f": 0.1, "n": None, "l": [1, None]}, {"a": None, "f": 2, "l": []}]
    to_jsonl(spark, source, str(tmp_path / "o.jsonl"))
    first = json.loads((tmp_path / "o.jsonl").read_text().splitlines()[0])
    assert (first["a"], first["l"], first["schema_registry"] is None) == ('x "y", z', [1, None], False)
    assert '"f":0.10000000000000001' in (tmp_path / "o.jsonl").read_text()
    to_csv(spark, source, str(tmp_path / "o.csv"))
    lines = (tmp_path / "o.csv").read_text().splitlines()
    assert lines[0] == "a,f,l,schema_registry,schema_drifts,source_file,ingestion_timestamp"
    assert lines[1].startswith('"x ""y"", z",0.10000000000000001,"[1,null]","{""') and lines[2].startswith(",2,,,,,")
    to_parquet(spark, [{"t": "03:04:05"}], str(tmp_path / "o.parquet"), parse_iso_times=True)
    assert spark.read.parquet(str(tmp_path / "o.parquet")).first().t == "03:04:05"
    assert sorted(p.name for p in tmp_path.iterdir()) == ["o.csv", "o.jsonl", "o.parquet"]
    to_parquet(spark, source, str(tmp_path / "many"), parallel=True, parquet_compression="snappy")
    assert spark.read.parquet(str(tmp_path / "many")).count() == 2
    assert to_pyarrow(spark, source).num_rows == 2 and list(to_pandas(spark, source)["f"]) == [0.1, 2.0]
    assert to_duckdb(spark, source).filter("f > 1").fetchall()[0][1] == 2.0
    assert [b.num_rows for b in iter_batches(spark, source, batch_rows=1)] == [1, 1]


def test_pipeline_carries_the_registry(spark, tmp_path):
    for d, text in ((1, '{"a":1}\n'), (2, '{"a":"x","b":2}\n')):
        folder = tmp_path / f"in/year=2024/month=01/date=2024-01-0{d}"
        folder.mkdir(parents=True)
        (folder / f"in_2024010{d}.jsonl").write_text(text)
    pipe = ParquetPipeline(spark, str(tmp_path / "in"), str(tmp_path / "out"), HivePartitions(dt.date(2024, 1, 1), dt.date(2024, 1, 3)), {"input_format": "jsonl", "field_name_policy": "lower_snake"})
    seen = []
    run = pipe.run(after_partition=seen.append)
    assert [r.drift_count for r in run.partitions] == [1, 2] and len(run.missing) == 1 and len(seen) == 2
    out = spark.read.parquet(run.partitions[1].plan.output_uri).first()
    assert (out.a, out.a_v2_string, out.b) == (None, "x", 2)
    warm = warm_up_registry(spark, [p.source for p in pipe.plan()[:2]], input_format="jsonl", field_name_policy="lower_snake")
    assert warm["canonical_schema"] == run.schema_registry["canonical_schema"]


def test_stream_carries_the_registry(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    seen = []
    go = lambda: convert_stream(spark, str(folder), str(tmp_path / "out"), str(tmp_path / "ck"), on_batch=lambda n, r: seen.append((n, r.schema_registry["schema_generation"])), field_name_policy="lower_snake").awaitTermination()
    (folder / "a.jsonl").write_text('{"a":1}\n')
    go()
    (folder / "b.jsonl").write_text('{"a":"x"}\n')
    go()
    assert seen == [(0, 2), (1, 3)]
    assert sorted(spark.read.parquet(str(tmp_path / "out/batch=1")).columns)[:2] == ["a", "a_v2_string"]


def test_files(spark, tmp_path):
    write(tmp_path, b__csv="x\n1\n", a__csv="x\n2\n", c__txt="")
    assert [f.uri.rsplit("/", 1)[1] for f in list_objects(spark, str(tmp_path), ["csv"])] == ["a.csv", "b.csv"]
    m = discover(spark, str(tmp_path), ["csv"], (dt.datetime(2000, 1, 1, tzinfo=dt.timezone.utc), dt.datetime(2100, 1, 1, tzinfo=dt.timezone.utc)))
    assert [r["x"] for r in rows(sanitize(spark, m, input_format="csv"))] == ["2", "1"]
    assert publish_file_atomic(spark, str(tmp_path / "a.csv"), str(tmp_path / "z.csv")) == 4
    with pytest.raises(FileNotFoundError):
        sanitize(spark, str(tmp_path / "none.csv"), input_format="csv")


def test_analytical_helpers(spark):
    df = spark.createDataFrame([(1, "a", [1]), (2, "b", None)], "k int, s string, l array<int>")
    assert analytical.project_ingress_scalar_schema(df.schema).names == ["k", "s"]
    d = analytical.diff_schemas(df.schema, T.StructType([T.StructField("k", T.LongType()), T.StructField("x", T.StringType())]))
    assert (d.added_paths, d.removed_paths, d.changed_paths) == (("x",), ("l", "l[]", "s"), ("k",))
    assert analytical.validate_analytical_result(df, df.schema).row_count == 2
    with pytest.raises(ValueError):
        analytical.validate_analytical_result(df, df.drop("k").schema)
    want = T.StructType([T.StructField("k", T.LongType()), T.StructField("s", T.StringType()), T.StructField("l", T.ArrayType(T.LongType())), T.StructField("schema_registry", T.StringType())])
    out = analytical.finalize_analytical_output(df, want).dataframe
    assert out.schema.names == want.names and out.filter("schema_registry is null").count() == 0
    up = analytical.upsert(df, spark.createDataFrame([(2, None, [5]), (3, "c", None)], df.schema), "k")
    assert sorted((r.k, r.s) for r in up.collect()) == [(1, "a"), (2, None), (3, "c")]


def test_events_and_hive(spark, tmp_path):
    df = spark.createDataFrame([(1, "x", None), (2, None, 5)], "k int, `10/b` string, `2/a` int")
    assert [[(e.event_id, e.event_text, e.payload) for e in r.event] for r in events.wide_to_events(df, drop_null=True).orderBy("k").collect()] == [[(10, "b", "x")], [(2, "a", "5")]]
    assert events.event_columns(["10/b", "k", " 3 /b", "-2/a/b", "x/y", "/z", "4/"]) == [(10, "b", "10/b"), (3, "b", " 3 /b"), (-2, "a/b", "-2/a/b")]
    assert [e.payload for e in events.wide_to_events(df).orderBy("k").first().event] == ["x", None]
    t = spark.createDataFrame([(dt.datetime(2024, 1, 2, 3),)], "ts timestamp_ntz")
    assert events.write_hive(t, str(tmp_path / "h"), "ts").first().day == 2
    with pytest.raises(IntegrityError):
        events.write_hive(spark.createDataFrame([(None,)], "ts timestamp_ntz"), str(tmp_path / "i"), "ts")


def test_sql_text():
    schema = T.StructType([T.StructField("b", T.LongType()), T.StructField("a", T.ArrayType(T.StructType([T.StructField("x", T.DecimalType(10, 2))]))), T.StructField("day", T.DateType()), T.StructField("source_file", T.StringType())])
    ref = bq.TableRef.parse("p.d.t")
    ddl, skipped = bq.external_table_ddl(ref, schema, bq.ExternalTable(("gs://b/*",), "gs://b", (("day", "DATE"),)), alphabetical=True)
    assert skipped == ["day"] and "`a` ARRAY<STRUCT<`x` NUMERIC(10, 2)>>,\n    `b` INT64,\n    `source_file` STRING" in ddl and "uris = ['gs://b/*']" in ddl
    columns = (("year", "INT64"), ("day", "DATE"))
    key = bq.partition_key("gs://b/year=2024/day=2024-01-02/f.parquet", columns)
    assert key == "year=2024/day=2024-01-02" and bq.partition_filter(key, columns) == "`year` = 2024 AND `day` = DATE '2024-01-02'"
    assert bq.partition_filter("year=x", columns) is None and bq.partition_key("gs://b/f", columns) is None
    assert "ORDER BY SAFE_CAST(`ingestion_timestamp` AS TIMESTAMP) DESC" in bq.latest_registry_query(ref, columns, key)
    assert "it''s" in bq.sidecar_upsert(ref, ref, "it's") and bq.sidecar_lookup(ref, ref).endswith("LIMIT 1")
    with pytest.raises(ValueError):
        bq.identifier("a`b")


def test_source_patterns_and_connections():
    assert bq.covered("gs://b/x/y.parquet", ("gs://b/*.parquet",)) and not bq.covered("gs://c/y", ("gs://b/*", "gs://c"))
    import sqlite3

    assert bq.first_cell(sqlite3.connect(":memory:"), "select 5") == 5


def test_cancellation(spark):
    from tidewright import CancelledError, operation_cancellation, process_operation_diagnostics

    with pytest.raises(CancelledError), operation_cancellation(spark, timeout_seconds=1.5):
        spark.range(8, numPartitions=2).select(F.udf(lambda x: __import__("time").sleep(8), "string")("id")).collect()
    assert process_operation_diagnostics()["cancellations"] >= 1
    with operation_cancellation(spark) as token:
        assert spark.range(3).count() == 3 and not token.cancelled


def test_depth_beyond_what_arrow_carries(spark):
    def nested(depth: int):
        return spark.createDataFrame([('{"k":' * depth + "1" + "}" * depth,)], "value string")

    how = dict(input_format="jsonl", arrow_max_depth=512, parquet_max_depth=512)
    assert len(sanitize(spark, nested(60), **how).dataframe.collect()) == 1
    with pytest.raises(ResourceError):
        sanitize(spark, nested(400), **how)


def test_publication_replaces(spark, tmp_path):
    for text in ("old", "newer"):
        (tmp_path / "a.csv").write_text(text)
        assert publish_file_atomic(spark, str(tmp_path / "a.csv"), str(tmp_path / "z.csv")) == len(text)
    assert (tmp_path / "z.csv").read_text() == "newer" and sorted(p.name for p in tmp_path.iterdir()) == ["a.csv", "z.csv"]
