"""The operators on the training-data problems of the core: brute force, edge cases."""

import json
import random
import re
from datetime import UTC, datetime, timedelta
from zoneinfo import ZoneInfo, available_timezones

import numpy as np
import pyarrow as pa
import pytest
from compare import duck
from pyspark.sql import functions as F

from opstrata.functions.json_nodes import Tokens, nodes
from opstrata.functions.timestamps import to_utc_micros
from opstrata.functions.zones import ABBREVIATIONS, check, local_to_utc, transitions, version
from opstrata.operators import delivery, features, instants, nested
from opstrata.plans import problems


# ---- nested records
def never(x):
    raise ValueError(x)


def read(s):
    try:
        v = json.loads(s, parse_constant=never)
        while isinstance(v, str):
            v = json.loads(v, parse_constant=never)
        return v
    except (ValueError, TypeError):
        return 0


def walk(v, path=""):
    if isinstance(v, dict):
        for k, x in v.items():
            yield from walk(x, (path + "." if path else "") + k)
    elif isinstance(v, list):
        for i, x in enumerate(v):
            if isinstance(x, dict):
                yield f"{path}[{i}]"
            yield from walk(x, f"{path}[{i}]")


def test_p2_found_is_brute_force(spark, sf):
    con = duck(sf)
    want = {(t, r, p) for t, i, c in problems.NESTED for r, s in con.execute(f"select {i}, {c} from {t}").fetchall() for p in walk(read(s))}
    got = [tuple(r) for r in problems.QUERIES["p2_found"](spark, sf).collect()]
    assert len(got) == len(set(got)) and set(got) == want


ODD = ["", "  ", "[]", "{}", "[{}]", '"[{}]"', "01", "[{},]", '{"a":[{}],}', "nul", "[1 2]", "[{}]x", "[{}][{}]", '{"a" [{}]}', ":", "{:1}", "\\", '"\\', '[{"\\u00e9":[{}]}]', '[{"\\u00g9":[{}]}]', '[{"a":"\\', "NaN", '["\x01"]', '{"a.b":[[{}],{"":[{}]}]}']


def test_tokens_know_readable_texts():
    rng = random.Random(3)
    docs = ['{"a":[{"b":1.5e3,"c":"x\\"y"},[{"d":null}]],"e":{"f":[true,{}]}}', '[{"k\\\\":"\\u0041"}, {"m":[[],[{}]]}]']
    texts = list(ODD)
    for _ in range(3000):
        x = list(rng.choice(docs))
        for _ in range(rng.choice([1, 2])):
            x[rng.randrange(len(x))] = rng.choice(["", *'{}[]:,"\\ 01.e-tn\n'])
        texts.append("".join(x))

    def twice(s):
        pairs = []
        try:
            json.loads(s, object_pairs_hook=lambda p: pairs.append(len(dict(p)) < len(p)))
        except ValueError:
            return False
        return any(pairs)

    texts = [s for s in texts if not twice(s)]

    def ok(s):
        try:
            json.loads(s, parse_constant=never)
            return True
        except ValueError:
            return False

    assert list(Tokens(pa.array(texts)).ok) == [ok(s) for s in texts]
    out = nodes(pa.array(texts), "array_objects")
    assert set(zip(out["row"].to_pylist(), out["path"].to_pylist(), strict=True)) == {(i, p) for i, s in enumerate(texts) for p in walk(read(s))}


def test_flatten_links_children_to_parents(spark):
    text = '{"a":[{"b":"x\\n","c":{"d":[1,{"e":null}]}}]}'
    df = spark.createDataFrame([(1, text, "clash"), (1, json.dumps(text), "clash"), (2, None, None), (3, "", None), (None, "[{}]", None)], "id long, t string, path string")
    got = {(r.record_id, r.path, r.parent_path, r.ordinal) for r in nested.flatten_json(df, "id", "t").collect()}
    assert got == {(1, "", None, None), (1, "a[0]", "a", 0), (1, "a[0].c", "a[0]", None), (1, "a[0].c.d[1]", "a[0].c.d", 1), (None, "[0]", "", 0)}
    values = {(r.path, r.kind, r.value) for r in nested.flatten_json(df, "id", "t", "values", ("path", "kind", "value")).collect()}
    assert values == {("a[0].b", "string", "x\n"), ("a[0].c.d[0]", "literal", "1"), ("a[0].c.d[1].e", "literal", "null")}
    assert nested.flatten_json(df.limit(0), "id", "t").count() == 0


@pytest.mark.parametrize("wraps", [1, 8, 9, 16])
def test_documents_in_strings_in_strings(wraps):
    text = '[{"a":[{}]}]'
    for _ in range(wraps):
        text = json.dumps(text)
    out = nodes(pa.array(["{}", text, None, "[{}]"]), "array_objects")
    assert sorted(zip(out["row"].to_pylist(), out["path"].to_pylist(), strict=True)) == [(1, "[0]"), (1, "[0].a[0]"), (3, "[0]")]


def test_deep_documents():
    n = 3000
    out = nodes(pa.array(['[{"a":' * n + "1" + "}]" * n]), "array_objects")
    assert out.num_rows == n and max(out["path"].to_pylist(), key=len) == "[0]" + ".a[0]" * (n - 1)


def test_half_surrogates_keep_names_apart():
    out = nodes(pa.array(['{"a\\ud800":[{}],"a?":[{}]}']), "array_objects")
    assert sorted(out["path"].to_pylist()) == ["a?[0]", "a\\ud800[0]"]


def test_long_texts_go_through_the_kernels_in_slices(monkeypatch):
    monkeypatch.setattr(nested, "KERNEL_BYTES", 10)
    assert list(nested._slices(pa.array(["x" * 4, "y" * 4, None, "z" * 50, "", "w"]))) == [(0, 3), (3, 4), (4, 6)]


# ---- deliveries
def test_seen_ranges_accept_each_number_once():
    rng = np.random.default_rng(1)
    ranges, seen = delivery.SeenRanges(), set()
    for _ in range(50):
        batch = rng.integers(0, 300, rng.integers(0, 40))
        fresh = ranges.accept(batch)
        for x, f in zip(batch.tolist(), fresh, strict=True):
            assert f == (x not in seen)
            seen.add(x)
        assert {n for a, b in zip(ranges.low, ranges.high, strict=True) for n in range(a, b + 1)} == seen
        assert (ranges.low[1:] > ranges.high[:-1] + 1).all()


def test_surplus_edge_cases(spark):
    rows = [
        (1, "msg_0001f", "s", 5), (2, " MSG_0001F\n", "s", 9), (3, "msg_0001f", "s", None), (4, "msg_1f", "s", 1), (5, "msg_0001f", "t", 1),
        (6, "abc-ff", "s", None), (7, "ABC-ff ", "s", None), (8, None, "s", 1), (9, None, "s", 2), (10, "msg_0001f", None, 1), (11, "msg_0001f", None, 1),
        (12, "", "s", 1), (13, " ", "s", 1), (14, "msg_0002f", "s", 3), (15, "msg_0002f", "s", 3),
    ]
    df = spark.createDataFrame(rows, "delivery_id long, message_id string, session_id string, total long").withColumn("number", F.lit("clash"))
    got = delivery.surplus_deliveries(df, total=F.col("total"))
    assert sorted(r.delivery_id for r in got.collect()) == [1, 3, 7, 8, 11, 13, 15]
    assert delivery.kept_deliveries(df, total=F.col("total")).count() == 8
    assert delivery.surplus_deliveries(df.limit(0), total=F.col("total")).count() == 0


def test_hot_message_and_hot_producer(spark):
    df = spark.range(20000).select(F.col("id").alias("delivery_id"), F.format_string("msg_%06df", F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") + 1000000)).alias("message_id"), F.lit("s").alias("session_id"), (F.col("id") % 5).alias("t"))
    got = {r.delivery_id for r in delivery.surplus_deliveries(df.repartition(7), total=F.col("t")).collect()}
    assert got == {i for i in range(0, 20000, 3)} - {9}


# ---- features
def test_features_wide_and_back(spark, monkeypatch):
    monkeypatch.setattr(features, "BLOCK", 4)
    rows = [(i, f"s{i % 3}", i, f"Tool_{i % 11}", i - 3, i % 2) for i in range(60)] + [(5, "s2", 5, "tool 5", 2, 1), (90, None, 1, "x", 1, 1), (91, "s1", 1, None, 1, 1)]
    df = spark.createDataFrame(rows, "id long, session_id string, sequence_number int, tool_name string, duration_ms int, exit_code int").withColumn("type", F.lit(0))
    long = features.long_table(df)
    types = features.type_list(long)
    assert types.count() == 11 and types.agg(F.max("block")).first()[0] == 2
    back = features.unpivot_blocks(features.wide_blocks(long, types), types, "failures")
    assert sorted(map(tuple, back.collect())) == sorted((r.entity, r.type, r.failures) for r in long.collect())
    wide = features.feature_table(long, ["tool5", "none"]).orderBy("entity").collect()
    assert [r.entity for r in wide] == ["s0", "s1", "s2"] and wide[2]["tool5_n"] == 2 and wide[0]["none_n"] == 0 and wide[0]["none_recency"] is None
    assert wide[2]["tool5_recency"] == 59 - 38 and sum(r.n_all for r in wide) == 60
    with pytest.raises(ValueError):
        features.feature_table(long, [str(i) for i in range(features.MOST_TYPES + 1)])
    assert features.long_table(df.limit(0)).count() == 0


# ---- instants
FORMS = "%Y-%m-%dT%H:%M:%S|%Y-%m-%d %H:%M:%S.%f|%Y-%m-%dT%H:%M:%S.%f|%Y-%m-%d %H:%M:%S|%Y/%m/%d %H:%M:%S|%d.%m.%Y %H:%M:%S|%m/%d/%Y %I:%M:%S %p|%Y-%m-%d|%Y-%m-%d %H:%M:%S,%f|%a, %d %b %Y %H:%M:%S|%Y%m%dT%H%M%S".split("|")


def by_hand(text, zone):
    """Another way to the instant: tries formats one by one and leaves zones to the standard library."""
    if text is None:
        return None
    t, tz = text.strip(), None
    if re.fullmatch(r"\d{10}(\.\d+)?|\d{13}|\d{16}", t):
        whole, _, frac = t.partition(".")
        return int(whole) * 10 ** (16 - len(whole)) + int((frac + "000000")[:6])
    if m := re.search(r"\[(.+)\]$", t):
        tz, t = ZoneInfo(m[1]), t[: m.start()]
    if m := re.search(r"(?<=\d) ?([+-])(\d\d):?(\d\d)$", t):
        if ":" in t or "T" in t:
            tz, t = timedelta(minutes=int(m[1] + "1") * (60 * int(m[2]) + int(m[3]))), t[: m.start()]
    elif m := re.search(r" ?(Z|[A-Z]{3,4})$", t):
        if m[1] not in ("AM", "PM") and m[1] in ABBREVIATIONS:
            tz, t = timedelta(minutes=ABBREVIATIONS[m[1]]), t[: m.start()]
    t = re.sub(r"(\d[.,]\d{6})\d+$", r"\1", t)
    for f in FORMS:
        try:
            d = datetime.strptime(t, f)
        except ValueError:
            continue
        tz = tz if tz is not None else ZoneInfo(zone) if zone else None
        if tz is None:
            return None
        d = d.replace(tzinfo=UTC) - tz if isinstance(tz, timedelta) else d.replace(tzinfo=tz).astimezone(UTC)
        return (d - datetime(1970, 1, 1, tzinfo=UTC)) // timedelta(microseconds=1)
    return None


def test_p6_against_the_standard_library(spark, sf):
    con = duck(sf)
    for t, i, c in problems.TIMES:
        want = {}
        for r, text, zone in con.execute(f'select {i}, "{c}", zone_name from {t} left join agent_hosts using (host_id)').fetchall():
            if (u := by_hand(text, zone)) is not None:
                want[r] = u
        got = {r.record_id: r.utc_micros for r in problems.QUERIES["p6_instants"](spark, sf).filter(F.col("source_table") == t).collect()}
        assert got == want


@pytest.mark.parametrize(
    ("text", "zone", "want"),
    [
        ("2024-10-27 02:30:00", "Europe/Berlin", "2024-10-27T00:30:00"), ("2024-03-31T02:30:00", "Europe/Berlin", "2024-03-31T01:30:00"), ("2024-03-31", "Europe/Berlin", "2024-03-30T23:00:00"),
        ("2024-07-01T00:00:00+02:00[Asia/Tokyo]", "UTC", "2024-06-30T22:00:00"), ("2024-07-01 00:00:00 CET", "UTC", "2024-06-30T23:00:00"), ("03/04/2025 12:05:00 AM", "UTC", "2025-03-04T00:05:00"),
        ("03.04.2025 12:05:00", "UTC", "2025-04-03T12:05:00"), ("2024-02-30T00:00:00Z", "UTC", None), ("2024-01-01T24:00:00Z", "UTC", None), ("2024-01-01T00:00:00[No/Where]", "UTC", None),
        ("2024-01-01T00:00:00", None, None), ("2024-01-01T00:00:00Z", None, "2024-01-01T00:00:00"), ("", "UTC", None), (None, "UTC", None), ("soon", "UTC", None), ("12345678901", "UTC", None),
        ("2130-07-01 00:00:00", "Europe/Paris", "2130-06-30T22:00:00"), ("2950-01-01 00:00:00", "Australia/Sydney", "2949-12-31T13:00:00"), ("2024-01-01T00:00:00+99:99", "UTC", None), ("2024-01-01T00:00:00+24:00", "UTC", None), ("2024-01-01T00:00:00-23:59", "UTC", "2024-01-01T23:59:00"),
        (" 1700000000 ", None, "2023-11-14T22:13:20"), ("2024-01-01T00:00:00.1234569Z", "UTC", "2024-01-01T00:00:00.123456"), ("13:00", "UTC", None), ("é024-01-01", "UTC", None), ("x" * 100000, "UTC", None),
    ],
)
def test_instants(text, zone, want):
    got = to_utc_micros(pa.array([text], pa.string()), pa.array([zone], pa.string()))[0].as_py()
    assert (None if got is None else (datetime(1970, 1, 1) + timedelta(microseconds=got)).isoformat()) == want


def test_transition_tables_agree_with_zoneinfo():
    rng = np.random.default_rng(2)
    for zone in sorted(available_timezones()):
        base = transitions(zone)[0]
        local = np.concatenate([rng.integers(-62_000_000_000, 253_300_000_000, 60), *[base[:700:3] + d for d in (-3601, -1, 0, 1, 1800)], *[base[-30:] + d for d in (-3601, 0, 1800)]])
        want = [int((datetime(1970, 1, 1) + timedelta(seconds=int(s))).replace(tzinfo=ZoneInfo(zone)).timestamp()) for s in local]
        assert local_to_utc(local, zone)[0].tolist() == want, zone
    assert version() and transitions("No/Where") is None and transitions("../etc/passwd") is None
    with pytest.raises(RuntimeError):
        check("1970a")


def test_normalise_edge_cases(spark):
    df = spark.createDataFrame([(1, "2024-01-01T00:00:00", "h"), (1, "2024-01-01T00:00:00", "h"), (2, None, "h"), (3, "2024-01-01", "gone"), (4, "1700000000", None)], "id long, t string, host_id string").withColumn("zone_name", F.lit("x"))
    hosts = spark.createDataFrame([("h", "Asia/Tokyo"), ("h", "Asia/Tokyo"), (None, "UTC")], "host_id string, zone_name string")
    got = sorted(map(tuple, instants.normalise(df, hosts, "id", "t").collect()))
    assert got == [(1, 1704034800000000), (4, 1700000000000000)]
    assert instants.normalise(df.limit(0), hosts.limit(0), "id", "t").count() == 0


def test_seen_ranges_between_batches(spark):
    from opstrata.operators import ranges

    rng = random.Random(9)
    seen, table_ = set(), None
    for _ in range(3):
        batch = [(rng.choice("ab"), rng.randrange(200)) for _ in range(60)] + [(None, 1), ("a", None)]
        df = spark.createDataFrame(batch, "producer string, number long").withColumn("low", F.lit("clash")).drop("low")
        if table_ is not None:
            new = {tuple(r) for r in ranges.uncovered(df, table_, 64).collect() if None not in tuple(r)}
            assert new == {b for b in batch if None not in b and b not in seen}
        here = ranges.seen_ranges(df, 64)
        table_ = here if table_ is None else ranges.merge_ranges(table_, here)
        table_ = spark.createDataFrame(table_.collect(), table_.schema)
        seen |= {b for b in batch if None not in b}
        rows = table_.collect()
        assert {(r.producer, n) for r in rows for n in range(r.low, r.high + 1)} == seen
        assert all(not (a.producer == b.producer and a.block == b.block and a.low <= b.low <= a.high + 1) for a in rows for b in rows if a is not b)
