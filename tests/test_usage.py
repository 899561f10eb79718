"""Usage queries on small cases with known results."""

import json

import pytest
from pyspark.sql import functions as F

from sample_values import at
from meterframe.functions.predicates import Condition, Group, all_of, any_of, from_dict, to_column
from meterframe.operators import paging, series, stats
from meterframe.operators.breakdown import aggregate_range, breakdown, dimension_values, share_of_max
from meterframe.operators.buckets import buckets, group_fields, ordered
from meterframe.operators.scan import scan
from meterframe.session import materialize
from meterframe.sources.sinks import plain_number, write_bucket_csv, write_event_csv

DAY, NEXT = "2026-06-08T00:00:00Z", "2026-06-09T00:00:00Z"


def event(time, quantity, metadata=None, **more):
    return {
        "event_time": at(f"2026-06-08 {time}"),
        "quantity": float(quantity),
        "metadata": json.dumps(metadata or {}),
        **more,
    }


def values(df, *columns):
    return [tuple(row[c] for c in columns) for row in df.collect()]


def test_grouped_buckets(make):
    usage = make.usage(
        event("10:00", 2, {"region": "us-east-1", "plan": "free"}),
        event("11:00", 3, {"region": "us-east-1", "plan": "pro"}),
        event("12:00", 5, {"region": "us-east-1", "plan": "free"}),
    )
    rows = ordered(buckets(usage, "api_calls", DAY, NEXT, group_by="region,plan"))
    assert values(rows, "region", "plan", "quantity") == [("us-east-1", "free", 7.0), ("us-east-1", "pro", 3.0)]


def test_buckets_across_subjects(make):
    usage = make.usage(
        event("10:00", 2), event("11:00", 3), event("10:00", 2, subject="org_456"), event("11:00", 3, subject="org_456")
    )
    assert values(buckets(usage, "api_calls", DAY, NEXT), "subject", "quantity") == [("", 10.0)]
    assert values(buckets(usage, "api_calls", DAY, NEXT, subject="org_123"), "subject", "quantity") == [("org_123", 5.0)]
    by_subject = ordered(buckets(usage, "api_calls", DAY, NEXT, group_by=["subject"]))
    assert values(by_subject, "subject", "quantity") == [("org_123", 5.0), ("org_456", 5.0)]


def test_missing_group_is_nil(make):
    usage = make.usage(event("10:00", 2, {"region": None}), event("11:00", 3, {"region": "eu"}), event("12:00", 4))
    rows = buckets(usage, "api_calls", DAY, NEXT, group_by="region")
    assert sorted(values(rows, "region", "quantity")) == [("<nil>", 6.0), ("eu", 3.0)]
    assert values(breakdown(usage, "api_calls", "region", DAY, NEXT), "value", "quantity") == [("eu", 3.0)]


@pytest.mark.parametrize(
    "aggregation, expected",
    [
        ("first", [7.0, 4.0]),
        ("last", [12.0, 4.0]),
        ("rate", [2 / 86400, 1 / 86400]),
        ("avg", [9.5, 4.0]),
        ("min", [7.0, 4.0]),
        ("max", [12.0, 4.0]),
        ("sum", [19.0, 4.0]),
        ("count", [2.0, 1.0]),
    ],
)
def test_aggregations(make, aggregation, expected):
    usage = make.usage(
        event("11:00", 12, {"endpoint": "/orders"}),
        event("09:00", 7, {"endpoint": "/orders"}),
        event("10:00", 4, {"endpoint": "/users"}),
    )
    rows = ordered(buckets(usage, "api_calls", DAY, NEXT, "day", aggregation, group_by="endpoint"))
    assert values(rows, "endpoint", "quantity") == list(zip(["/orders", "/users"], expected))


def test_rate_uses_the_real_month_length(make):
    usage = make.usage(event("11:00", 12), event("12:00", 1))
    rows = buckets(usage, "api_calls", "2026-06-01T00:00:00Z", "2026-07-01T00:00:00Z", "month", "rate")
    assert values(rows, "quantity") == [(2 / (30 * 86400),)]


def test_first_and_last_ties_go_by_id(make):
    usage = make.usage(event("10:00", 5, id="b"), event("10:00", 6, id="a"), event("10:00", 7, id="c"))
    assert values(buckets(usage, "api_calls", DAY, NEXT, aggregation="first"), "quantity") == [(6.0,)]
    assert values(buckets(usage, "api_calls", DAY, NEXT, aggregation="last"), "quantity") == [(7.0,)]


def test_breakdown(make):
    usage = make.usage(
        event("10:00", 2, {"endpoint": "/orders"}),
        event("11:00", 3, {"endpoint": "/users"}),
        event("12:00", 7, {"endpoint": "/orders"}, subject="org_456"),
    )
    rows = breakdown(usage, "api_calls", "subject", DAY, NEXT, limit=10)
    assert values(rows, "value", "quantity", "usage_events") == [("org_456", 7.0, 1), ("org_123", 5.0, 2)]
    rows = breakdown(usage, "api_calls", "metadata.endpoint", DAY, NEXT, limit=10)
    assert values(rows, "value", "quantity", "usage_events") == [("/orders", 9.0, 2), ("/users", 3.0, 1)]
    shares = {r["value"]: r["share"] for r in share_of_max(rows).collect()}
    assert shares["/orders"] == 100.0 and shares["/users"] == pytest.approx(100 / 3)


def test_dimension_values(make):
    usage = make.usage(
        event("10:00", 1, {"region": "us-east-1"}),
        event("11:00", 1, {"region": "us-east-1"}),
        event("12:00", 1, {"region": "us-west-2"}),
        event("12:00", 1, {"region": "us-central-1"}, subject="org_456"),
    )
    rows = dimension_values(usage, "api_calls", "region", subject="org_123", limit=10)
    assert values(rows, "value", "usage_events") == [("us-east-1", 2), ("us-west-2", 1)]
    with pytest.raises(ValueError):
        dimension_values(usage, "api_calls", "subject")


def test_empty_aggregate_is_zero(make):
    row = aggregate_range(make.usage(event("10:00", 2)), "other", DAY, NEXT, "avg").first()
    assert (row["quantity"], row["usage_events"]) == (0.0, 0)


def test_range_is_half_open_and_tenant_scoped(make):
    usage = make.usage(
        event("00:00", 1),
        {**event("00:00", 2), "event_time": at("2026-06-09 00:00")},
        event("05:00", 4, workspace_id="other"),
    )
    row = aggregate_range(usage, "api_calls", DAY, NEXT, workspace="ws").first()
    assert row["quantity"] == 1.0
    assert scan(usage, "ws", allowed_meters=("*",)).count() == 2
    assert scan(usage, "ws", allowed_meters=("storage",)).count() == 0
    with pytest.raises(ValueError):
        scan(usage, "")


def test_bad_queries_are_rejected(make):
    usage = make.usage(event("10:00", 2))
    with pytest.raises(ValueError):
        buckets(usage, "api_calls", NEXT, DAY)
    with pytest.raises(ValueError):
        buckets(usage, "api_calls", DAY, NEXT, group_by="unknown", declared_fields=["region"])
    with pytest.raises(ValueError):
        buckets(usage, "api_calls", DAY, NEXT, group_by="x'] or")
    assert group_fields(" metadata.region, region ,subject") == ["region", "subject"]


# --- filters ---------------------------------------------------------------------


@pytest.fixture
def flow(make):
    return make.usage(
        event("09:00", 2, {"endpoint": "/orders", "retry": True}),
        event("10:00", 3, {"endpoint": "/users", "retry": False}),
        event("11:00", 5, {"endpoint": "/admin", "retry": True}),
    )


def endpoints(usage, tree):
    rows = usage.filter(to_column(tree)).orderBy(F.desc("event_time"), F.desc("id"))
    return [json.loads(r["metadata"])["endpoint"] for r in rows.collect()]


def test_filter_flow(flow):
    assert endpoints(flow, Condition("metadata.endpoint", "neq", "/users")) == ["/admin", "/orders"]
    assert endpoints(flow, Condition("metadata.endpoint", "in", ["/orders", "/users"])) == ["/users", "/orders"]
    assert endpoints(flow, Condition("metadata.endpoint", "exists")) == ["/admin", "/users", "/orders"]
    assert endpoints(flow, Condition("metadata.retry", "eq", True)) == ["/admin", "/orders"]
    assert endpoints(flow, Condition("timestamp", "gte", "2026-06-08T10:00:00Z")) == ["/admin", "/users"]
    assert endpoints(flow, Condition("quantity", "in", [2, 5])) == ["/admin", "/orders"]


@pytest.fixture
def nested(make):
    return make.usage(
        event("10:00", 2, {"endpoint": "/orders", "service": {"tier": "gold"}, "status_code": 200, "nullable": None}),
        event("10:00", 7, {"endpoint": "/orders", "service": {"tier": "gold"}, "status_code": 500, "a%b": "x"}),
        event("11:00", 3, {"endpoint": "/users", "service": {"tier": "silver"}, "region-name": "us"}),
        event("12:00", 5, {"endpoint": "/admin", "region-name": "eu-west", "status_code": 404}),
    )


def test_filter_nested_null_and_hyphen(nested):
    assert endpoints(nested, Condition("metadata.endpoint", "contains", "ord")) == ["/orders", "/orders"]
    assert endpoints(nested, Condition("metadata.status_code", "gte", 400)) == ["/admin", "/orders"]
    assert endpoints(nested, Condition("metadata.nullable", "exists")) == ["/orders"]
    either = any_of(Condition("metadata.service.tier", "eq", "silver"), Condition("metadata.region-name", "eq", "eu-west"))
    assert endpoints(nested, either) == ["/admin", "/users"]
    assert endpoints(nested, all_of(either, Condition("quantity", "gt", 4))) == ["/admin"]
    assert endpoints(nested, Condition("metadata.service.tier", "neq", "gold")) == ["/users"]


def test_equality_is_type_strict(make):
    usage = make.usage(event("10:00", 1, {"endpoint": "text", "s": "200"}), event("11:00", 1, {"endpoint": "number", "s": 200}))
    assert endpoints(usage, Condition("metadata.s", "eq", 200)) == ["number"]
    assert endpoints(usage, Condition("metadata.s", "eq", "200")) == ["text"]
    assert scan(usage, metadata={"s": "200"}).count() == 2


def test_contains_is_literal(make):
    usage = make.usage(event("10:00", 1, {"endpoint": "50%_off"}), event("11:00", 1, {"endpoint": "50 off"}))
    assert endpoints(usage, Condition("metadata.endpoint", "contains", "0%_")) == ["50%_off"]


def test_filter_from_dictionary_and_bad_filters(nested):
    tree = from_dict(
        {
            "type": "group",
            "op": "and",
            "rules": [
                {"type": "condition", "field": "metadata.endpoint", "op": "eq", "value": "/orders"},
                {"type": "condition", "field": "quantity", "op": "gt", "value": 2},
            ],
        }
    )
    assert endpoints(nested, tree) == ["/orders"]
    for bad in (lambda: Group("and", ()), lambda: Condition("subject", "like", "x"), lambda: Condition("subject", "in", [])):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(ValueError):
        to_column(Condition("metadata.a'b", "eq", "x"))
    with pytest.raises(ValueError):
        to_column(Condition("unknown", "eq", "x"))


# --- pages ------------------------------------------------------------------------


def test_pages_visit_every_row_once_despite_equal_times(nested):
    pages = list(paging.walk(nested, paging.EVENT_ORDER, 2))
    assert [len(rows) for rows, _ in pages] == [2, 2]
    ids = [row["id"] for rows, _ in pages for row in rows]
    assert ids == ["e003", "e002", "e001", "e000"]
    assert pages[-1][1] is None


def test_subject_pages_have_mixed_directions(make):
    usage = make.usage(*[event("10:00" if s < "c" else "11:00", 1, subject=s) for s in "abcd"])
    pages = list(paging.walk(stats.subject_stats(usage), paging.SUBJECT_ORDER, 1))
    assert [rows[0]["subject"] for rows, _ in pages] == ["c", "d", "a", "b"]


def test_subject_stats(make):
    usage = make.usage(event("10:00", 1), event("11:00", 1), event("12:00", 1, meter_name="storage"))
    row = stats.subject_stats(usage).first()
    assert (row["usage_events"], row["meters"], row["last_event_at"]) == (3, 2, at("2026-06-08 12:00"))


# --- series and CSV -----------------------------------------------------------------


def test_series_gap_fill_and_running_sum(make):
    usage = make.usage(
        event("01:00", 2, {"service": {"tier": "gold"}}),
        event("02:00", 3, {"service": {"tier": "silver"}}),
        event("03:00", 4, {"service": {"tier": "gold"}}),
    )
    hourly = buckets(usage, "api_calls", DAY, NEXT, "hour", group_by="service.tier")
    filled = series.gap_fill(series.with_series(hourly, "service.tier"))
    rows = sorted(values(series.cumulative(filled), "series", "bucket_start", "quantity"))
    assert [(s, q) for s, _, q in rows] == [
        ("Service Tier: gold", 2.0),
        ("Service Tier: gold", 2.0),
        ("Service Tier: gold", 6.0),
        ("Service Tier: silver", 0.0),
        ("Service Tier: silver", 3.0),
        ("Service Tier: silver", 3.0),
    ]


def test_number_text(spark):
    numbers = [9.0, 2.5, 0.1, 1e-6, 1.5e15, 123456789012.25, 1e17, -3.0, 1e-12]
    df = spark.createDataFrame([(n,) for n in numbers], "n double")
    got = [r[0] for r in df.select(plain_number(F.col("n"))).collect()]
    assert got == ["9", "2.5", "0.1", "0.000001", "1500000000000000", "123456789012.25", "100000000000000000", "-3", "0.000000000001"]


def read_parts(path):
    lines = []
    for part in sorted(path.glob("part-*.csv")):
        lines += part.read_text().splitlines()
    return [line for i, line in enumerate(lines) if i == 0 or line != lines[0]]


def test_bucket_csv(make, tmp_path):
    usage = make.usage(
        event("10:00", 2, {"region": "us-east-1", "plan": "free"}),
        event("11:00", 7, {"region": "us-east-1", "plan": "free"}),
        event("11:00", 3, {"region": "us-east-1", "plan": "pro"}),
        event("12:00", 5, {"region": "us-west-2", "plan": "free"}),
    )
    group = ["subject", "region", "plan"]
    rows = buckets(usage, "api_calls", DAY, NEXT, group_by=group)
    write_bucket_csv(rows, str(tmp_path / "out"), "api_calls", "day", "sum", "call", group)
    assert read_parts(tmp_path / "out") == [
        "bucket_start,subject,meter,bucket_size,aggregation,unit,quantity,region,plan",
        "2026-06-08T00:00:00Z,org_123,api_calls,day,sum,call,9,us-east-1,free",
        "2026-06-08T00:00:00Z,org_123,api_calls,day,sum,call,3,us-east-1,pro",
        "2026-06-08T00:00:00Z,org_123,api_calls,day,sum,call,5,us-west-2,free",
    ]


def test_event_csv(make, tmp_path):
    usage = make.usage(event("10:00", 2.5, {"note": 'say "hi", ok'}, idempotency_key="k1"), event("11:00", 3))
    write_event_csv(usage, str(tmp_path / "out"))
    assert read_parts(tmp_path / "out") == [
        "timestamp,received_at,subject,meter,quantity,metadata,id,idempotency_key",
        "2026-06-08T11:00:00Z,2026-06-08T11:00:00Z,org_123,api_calls,3,{},e001,",
        '2026-06-08T10:00:00Z,2026-06-08T10:00:00Z,org_123,api_calls,2.5,"{""note"":""say \\""hi\\"", ok""}",e000,k1',
    ]


def test_typed_conditions_share_one_parse(make, capsys):
    row = {"event_time": at("2026-06-08"), "metadata": '{"a": {"b": 3}, "c": "x", "n": null}'}
    usage = materialize(make.usage(row), "usage")
    tree = all_of(
        Condition("subject", "eq", "org_123"),
        Condition("metadata.a.b", "gte", 2),
        any_of(Condition("metadata.c", "in", ["x", "y"]), Condition("metadata.n", "exists")),
        Condition("metadata.c", "neq", "z"),
    )
    rows = usage.filter(to_column(tree))
    assert rows.count() == 1
    rows.explain("formatted")
    filters = [line for line in capsys.readouterr().out.splitlines() if line.startswith("Condition")]
    assert sum(line.count("parseJson") for line in filters) == 1
    # The test without types stands before the parse.
    assert filters[0].index("subject") < filters[0].index("parseJson")
