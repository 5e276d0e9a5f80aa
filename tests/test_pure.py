"""Names, types, scalar parsers, registries: no session needed."""

import datetime as dt
import json
import random
import tracemalloc

import pyarrow as pa
import pytest
from hypothesis import given
from hypothesis import strategies as st

from tidewright.errors import IntegrityError, InvalidArgumentError, ResourceError
from tidewright.functions import names
from tidewright.functions.scalars import Parsers, compact, resolve, text_of
from tidewright.functions.types import LField, from_json, list_of, scalar, struct, to_json
from tidewright.options import CsvOptions, Options, ParsingOptions, SanitizeOptions
from tidewright.plans import registry as reg
from tidewright.plans.evidence import Evidence, distinct_trees, fields_of, packed, unpacked
from tidewright.plans.pipeline import HiveRangeConfig, UtcWindow, assign_files, build_hive_range_plan, build_utc_daily_windows, check_windows, compact_uri, cpu_share, format_duration, render
from tidewright.sources.files import RemoteFile, SourceManifest
from tidewright.sources.parse import BadRow, Csv, json_row, json_value, xml_rows


@pytest.mark.parametrize(("name", "policy", "out"), [
    ("User-ID", "lower_alpha", "userid"), ("User-ID", "lower_snake", "user_id"), ("__a--b__", "lower_snake", "a_b"), ("1st", "lower_snake", "field_1st"),
    ("123", "lower_alpha", "field"), ("", "lower_snake", "field"), ("añb", "lower_snake", "a_b"), ("Ünï", "lower_alpha", "n"), ("X y", "preserve", "X y"), ("default_key", "lower_alpha", "defaultkey"),
])
def test_clean(name, policy, out):
    assert names.clean(name, policy) == out
    assert names.clean("default_key", policy, "default_key") == "default_key"


def test_collisions_get_suffixes_of_their_own():
    assert names.clean_siblings(["user id", "User-ID", "x"], "lower_alpha") == ["useridrpvqmr", "useridorojrd", "x"]
    assert names.clean_siblings(["User-ID 2", "user_id_2"], "lower_snake") == ["user_id_2cwygmp", "user_id_2tifcvc"]


@pytest.mark.parametrize(("name", "out"), [("amount_v2_string", ("amount", 2, "string")), ("a_v1_string", None), ("a_v2", None), ("_v2_string", None), ("s_v3_struct_array", ("s", 3, "struct_array")), ("a_v2_x_value", None), ("a_v2_S", None)])
def test_versions(name, out):
    v = names.version_of(name)
    assert (v and (v.base, v.number, v.semantic)) == out


def parsers(**how):
    return Parsers(Options.of(**how))


@pytest.mark.parametrize(("text", "out"), [("12", 12), ("-5", -5), ("+5", None), (" 7 ", 7), ("1.0", None), ("9223372036854775808", None), ("", None), ("007", 7)])
def test_integers(text, out):
    assert parsers(parse_integers=True).int64(text) == out


@pytest.mark.parametrize(("text", "out"), [("1,234.56", 1234.56), ("12.5e2", 1250.0), (".5", 0.5), ("5.", 5.0), ("12,34.56", None), ("1,23", None), ("1.234,56", None), ("1,234,56", None), ("+1.5", 1.5), ("1e999", None), ("e5", None), ("nan", None)])
def test_floats(text, out):
    assert parsers(parse_floats=True).float64(text) == out


def test_european_floats():
    p = parsers(parse_floats=True, parse_float_decimal_separator=",", parse_float_thousands_separator=".")
    assert p.float64("1.234,56") == 1234.56 and p.float64("1,234.56") is None


def micros(*a):
    return int((dt.datetime(*a) - dt.datetime(1970, 1, 1)).total_seconds() * 1_000_000)


def test_timestamps():
    p = parsers(parse_iso_timestamps=True)
    assert p.timestamp("2024-01-02T03:04:05") == micros(2024, 1, 2, 3, 4, 5)
    assert p.timestamp("2024-01-02 03:04:05.123456789Z") == micros(2024, 1, 2, 3, 4, 5) + 123456
    assert p.timestamp("2024-01-02T03:04:05+01:30") == micros(2024, 1, 2, 1, 34, 5)
    assert p.timestamp("1969-12-31T23:59:59.9999995") == 0  # toward zero
    assert p.timestamp("2024-02-30T00:00:00") is None and p.timestamp("1600-01-01T00:00:00") is None
    c = parsers(custom_timestamp_patterns=[r"(\d{4})/(\d\d)/(\d\d) (\d\d):(\d\d):(\d\d)(?:\.(\d+))?([+-]\d{4})?"])
    assert c.timestamp("2024/01/02 03:04:05.5+0130") == micros(2024, 1, 2, 1, 34, 5) + 500000
    assert parsers(custom_time_patterns=[r"(\d\d)\|(\d\d)\|(\d\d)"]).time32("03|04|05") == 3 * 3600 + 4 * 60 + 5


def test_kinds_and_text():
    p = parsers(parse_integers=True, parse_floats=True, true_tokens=("Yes",), false_tokens=("no",), parse_iso_dates=True)
    assert [p.kind_of(x) for x in ("YES", "3", "3.5", "2024-01-01", "x", 1, 1.5, True, 1 << 70)] == ["bool", "int64", "float64", "date32", "utf8", "int64", "float64", "bool", "float64"]
    assert resolve(2 | 4) == "float64" and resolve(2 | 8) == "utf8" and resolve(0) == "utf8" and resolve(16) == "timestamp"
    assert text_of(0.1) == "0.10000000000000001" and text_of(True) == "true" and text_of({"b": [1, None, "x\n"], "a": 2.5}) == '{"b":[1,null,"x\\n"],"a":2.5}'
    assert compact(float("inf")) == "null"


def test_options_are_checked():
    for bad in ({"input_format": "auto"}, {"nonsense": 1}, {"timestamp_precision": "TIMESTAMP_NANOS"}, {"csv_delimiter": ",,"}, {"true_tokens": ["a"], "false_tokens": ["A"]}, {"parse_float_decimal_separator": ","}, {"custom_date_patterns": ["(a)"]}, {"arrow_max_depth": 513}, {"memory_limit_bytes": 0}):
        with pytest.raises(InvalidArgumentError):
            Options.of(**bad)
    flat = SanitizeOptions(csv=CsvOptions(delimiter=";"), parsing=ParsingOptions(integers=True, date_patterns=("(.)(.)(.)",))).flat()
    o = Options.of(**flat)
    assert o.csv_delimiter == ";" and o.parse_integers and o.custom_date_patterns == ("(.)(.)(.)",)


I, D, S, B = (scalar(k) for k in ("int64", "float64", "utf8", "bool"))


def merged(before, after, **how):
    first = reg.merge([LField(n, t) for n, t in before], field_name_policy="lower_snake").registry if before else None
    return reg.merge([LField(n, t) for n, t in after], first, detected_at="2020-01-01T00:00:00Z", **how)


def test_promotions_and_versions():
    m = merged([("a", I)], [("a", D)])
    assert [str(f.type) for f in m.fields] == ["double"] and m.drifts[0].drift_type == "type_promoted"
    assert not merged([("a", D)], [("a", I)]).drifts
    m = merged([("a", I)], [("a", S)])
    assert [f.name for f in m.fields] == ["a", "a_v2_string"]
    assert m.drifts[0].drift_type == "new_version_generated" and m.drifts[0].previous_schema == "int64"
    again = reg.merge([LField("a", S)], m.registry)
    assert not again.drifts and again.registry["schema_generation"] == m.registry["schema_generation"]
    m3 = reg.merge([LField("a", B)], m.registry)
    assert [f.name for f in m3.fields] == ["a", "a_v2_string", "a_v3_boolean"]


def test_nested_merges():
    st_ = struct([LField("x", I)])
    m = merged([("d", st_)], [("d", S)])
    assert m.drifts[0].source_path == "d.default_key" and m.drifts[0].drift_type == "newly_added"
    assert not merged([("d", list_of(st_))], [("d", st_)]).drifts
    m = merged([("d", st_)], [("d", list_of(st_))])
    assert [f.name for f in m.fields] == ["d", "d_v2_struct_array"] and len(m.drifts) == 1
    m = merged([("d", list_of(st_))], [("d", list_of(struct([LField("x", S)])))])
    assert m.drifts[0].source_path == "d[].x" and m.drifts[0].output_name == "x_v2_string"
    current = {v["output_name"]: v["is_most_compatible_current_version"] for v in merged([("d", st_)], [("d", list_of(st_))]).registry["variants"]["d"]["versions"]}
    assert current == {"d": False, "d_v2_struct_array": True}


def test_generations_and_strict_mode():
    assert merged([], [("a", I)]).registry["schema_generation"] == 2
    assert reg.new_schema_registry()["schema_generation"] == 1
    with pytest.raises(InvalidArgumentError):
        merged([], [("a", I)], schema_mode="strict")
    with pytest.raises(IntegrityError):
        merged([("a", I)], [("b", I)], schema_mode="strict")
    assert merged([("a", I)], [("a", I)], schema_mode="strict").registry["schema_generation"] == 2


def test_numeric_families_collapse():
    out = reg.normalised([LField("v", I), LField("v_v2_float", D), LField("v_v3_string", S)])
    assert [(f.name, str(f.type)) for f in out] == [("v", "double"), ("v_v3_string", "string")]


def test_arrow_registry_round_trip():
    schema = pa.schema([("a", pa.int64()), ("l", pa.list_(pa.struct([("x", pa.float64())])))])
    assert reg.arrow_schema_from_schema_registry(json.dumps(reg.schema_registry_from_arrow_schema(schema))) == schema
    with pytest.raises(ValueError):
        reg.arrow_schema_from_schema_registry(reg.new_schema_registry())


leaf = st.one_of(st.none(), st.booleans(), st.integers(-3, 3), st.sampled_from(["x", "1", "1.5"]), st.floats(0, 2))
value = st.recursive(leaf, lambda v: st.one_of(st.lists(v, max_size=3), st.dictionaries(st.sampled_from("abc"), v, max_size=3)), max_leaves=6)


@given(st.lists(st.dictionaries(st.sampled_from("pq"), value, max_size=2), max_size=8), st.lists(st.integers(0, 8), max_size=3))
def test_evidence_is_the_same_for_every_cut(rows, cuts):
    o = Options.of(parse_integers=True)
    p = Parsers(o)
    whole = Evidence(o)
    for r in rows:
        whole.add(fields_of(r, p, o))
    bounds = [0, *sorted(min(c, len(rows)) for c in cuts), len(rows)]
    parts = Evidence(o)
    for a, b in zip(bounds, bounds[1:]):
        for _, k, t in distinct_trees(rows[a:b], p, o):
            parts.add([(k, t)])
    assert {f.name: f.type for f in whole.fields()} == {f.name: f.type for f in parts.fields()}


@given(st.recursive(st.sampled_from([I, D, S, B]), lambda t: st.one_of(t.map(list_of), st.lists(t, min_size=1, max_size=3).map(lambda ts: struct(LField(f"f{i}", x) for i, x in enumerate(ts)))), max_leaves=5))
def test_types_survive_json(t):
    assert from_json(to_json(t)) == t


def test_csv_dialect():
    csv = Csv(",", None)
    assert list(csv.records('a, b ,"c ""q"" , d"\r\n\r\n1,,\n')) == [["a", "b", 'c "q" , d'], ["1", "", ""]]
    assert list(csv.records('"x\ny",2')) == [["x\ny", "2"]]
    assert list(Csv(";", "\\").records('"a\\"b";2')) == [['a"b', "2"]]
    for bad in ('a"b,c', '"a"b,c', '"open'):
        with pytest.raises(IntegrityError):
            list(csv.records(bad))


def test_json_and_xml():
    assert json_row('{"a":1,"a":2}', "k") == {"a": 1} and json_row('{"a":[],"a":2}', "k") == {"a": 2} and json_row("5", "k") == {"k": 5}
    for bad in ('{"a":NaN}', "{", '{"a":1} x'):
        with pytest.raises(BadRow):
            json_row(bad, "k")
    doc = '<r><o id="1"><a>x</a><a> y </a><b/>tail</o><o>z</o><p/></r>'
    assert list(xml_rows(doc, "o")) == [{"@id": "1", "a": ["x", "y"], "b": None, "#text": "tail"}, {"#text": "z"}]
    assert next(xml_rows(doc, None))["o"][1] == "z"
    for bad in ('<!DOCTYPE r [<!ENTITY e "x">]><r>&e;</r>', "<r>", "<r>&x;</r>"):
        with pytest.raises(IntegrityError):
            list(xml_rows(bad, None))


def test_xml_rows_are_given_on_as_they_end():
    row = '<o id="1"><a>x</a></o>between<p><q>no row</q></p>'
    assert next(xml_rows(f"<r>{row * 5_000}<bad", "o")) == {"@id": "1", "a": "x"}  # the end is not reached
    read = []

    def pieces():
        yield "<r>"
        for i in range(20_000):
            read.append(i)
            yield row
        yield "</r>"

    rows = xml_rows(pieces(), "o")
    next(rows)
    assert len(read) == 1
    tracemalloc.start()
    try:
        assert sum(1 for _ in rows) == 19_999
        assert tracemalloc.get_traced_memory()[1] < 3_000_000
    finally:
        tracemalloc.stop()
    with pytest.raises(IntegrityError):
        list(xml_rows(["<r><o>", "</o>"], "o"))


def test_pipelines_plan():
    windows = build_utc_daily_windows(dt.date(2024, 1, 1), dt.date(2024, 1, 3))
    files = [RemoteFile(f"s/{i}", "1", 1, dt.datetime(2024, 1, d, tzinfo=dt.timezone.utc)) for i, d in enumerate((3, 1, 1))]
    assert {w.logical_date.day: [f.uri for f in fs] for w, fs in assign_files(files, windows).items()} == {1: ["s/1", "s/2"], 3: ["s/0"]}
    with pytest.raises(InvalidArgumentError):
        check_windows([*windows, UtcWindow(dt.datetime(2024, 1, 1, 5, tzinfo=dt.timezone.utc), dt.datetime(2024, 1, 1, 6, tzinfo=dt.timezone.utc))])
    with pytest.raises(InvalidArgumentError):  # no time zone
        UtcWindow(dt.datetime(2024, 1, 1, 5), dt.datetime(2024, 1, 1, 6))
    with pytest.raises(InvalidArgumentError):  # a sibling, not a child
        SourceManifest("gs://b/data", (RemoteFile("gs://b/data2/x", "1"),))
    assert len(SourceManifest("gs://b/data", (RemoteFile("gs://b/data/x", "1"), RemoteFile("gs://b/data", "1"))).files) == 2
    assert (format_duration(4.25), format_duration(-1), format_duration(7205)) == ("4.2s", "0.0s", "2h 0m 5s")
    assert compact_uri("a" * 50 + "b" * 100, 33) == "a" * 10 + "..." + "b" * 20 and compact_uri("a") == "a"
    plans = build_hive_range_plan(HiveRangeConfig(source_prefix="in/x", output_prefix="out/x", start_date=dt.date(2024, 1, 1), end_date=dt.date(2024, 1, 2), input_format="jsonl"))
    assert [p.source for p in plans] == [f"in/x/year=2024/month=01/date=2024-01-0{d}/x_2024010{d}.jsonl" for d in (1, 2)]
    assert render("a/{yyyymmdd}/{hour}.csv", dt.date(2024, 1, 2), 3) == "a/20240102/03.csv"
    assert render("a/year=2023/month=05/date=2023-05-06/f_20230506.csv", dt.date(2024, 1, 2)) == "a/year=2024/month=01/date=2024-01-02/f_20240102.csv"
    with pytest.raises(InvalidArgumentError):
        build_hive_range_plan(HiveRangeConfig(source_uri="a/{date}", output_uri="b/{year}", start_date=dt.date(2024, 1, 1), end_date=dt.date(2024, 1, 2)))
    with pytest.raises(InvalidArgumentError):
        SourceManifest("s/", (RemoteFile("s/1", "1"), RemoteFile("s/1", "1")))
    assert [f.uri for f in SourceManifest("s/", (RemoteFile("s/2", "1"), RemoteFile("s/1", "1"))).files] == ["s/1", "s/2"]
    assert format_duration(61) == "1m 1s" and cpu_share(10, 25) == (100.0, 0.0) and len(compact_uri("x" * 200)) == 96


def test_big_random_evidence_ignores_repeats():
    o = Options.of()
    p, r = Parsers(o), random.Random(3)
    rows = [{"a": r.choice([1, "x", [1], {"b": 1}, [{"b": "y"}], None])} for _ in range(500)]
    whole = Evidence(o)
    for row in rows:
        whole.add(fields_of(row, p, o))
    sent = list(distinct_trees(rows, p, o))
    assert len(sent) < 30
    again = Evidence(o)
    for _, k, t in sent:
        again.add([(k, t)])
    assert whole.fields() == again.fields()


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    from tidewright import session

    conf = SimpleNamespace(get=lambda k, d=None: told.get(k, d))
    told = {}
    spark = lambda master: SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master, applicationId="app"))
    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            session.shared_dir(spark(master))
    told["spark.checkpoint.dir"] = "s3a://b/c/"
    assert session.shared_dir(spark("yarn")) == "s3a://b/c"


def test_kind_trees_travel_as_data():
    trees = [4, ("L", (4, ("S", (("L", 2), ("S", ("L", (1, 2))))))), ("S", (("a\ud800\"", ("S", (("b", 1),))), ("2", 8)))]
    assert [unpacked(packed(t)) for t in trees] == trees
    deep = 1
    for i in range(5_000):
        deep = ("L", (deep,)) if i % 2 else ("S", (("k", deep),))
    text = packed(deep)
    assert packed(unpacked(text)) == text


def test_json_depth():
    assert json_value("[" * 512 + "]" * 512) and json_value(json.dumps(["[" * 2000, '\\"[' * 600]))
    with pytest.raises(ResourceError):
        json_value("[" * 513 + "]" * 513)
    with pytest.raises(ResourceError):
        json_value('{"a":' * 513 + "1" + "}" * 513)


def test_sources_of_one_batch_merge_once():
    a, b = [LField("a", scalar("int64")), LField("b", scalar("utf8"))], [LField("a", scalar("float64")), LField("c", scalar("bool"))]
    fields = reg.combined([a, b])
    assert [(f.name, f.type.kind) for f in fields] == [("a", "float64"), ("b", "utf8"), ("c", "bool")]
    out = reg.merge(fields)
    assert out.registry["schema_generation"] == 2 and sorted(d.output_name for d in out.drifts) == ["a", "b", "c"]
