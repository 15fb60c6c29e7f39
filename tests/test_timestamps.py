import itertools
import random
from datetime import datetime, timezone

import pytest

from qirtas.operators import timestamps as S

CASES = [
    ("2025-07-29 11:55:30", None, "2025-07-29T08:55:30Z"),
    (" 2026-08-25 03:44:04 ", "Asia/Dubai", "2026-08-24T23:44:04Z"),
    ("Fri, 25 Apr 2025 01:02:29 +0300", "America/New_York", "2025-04-24T22:02:29Z"),
    ("٠٨/٠٤/٢٠٢٤ ١٥:١٤", "Africa/Cairo", "2024-04-08T13:14:00Z"),
    ("01/20/2026 15:38:24", "Asia/Dubai", "2026-01-20T11:38:24Z"),
    ("20250304T132630Z", None, "2025-03-04T13:26:30Z"),
    ("20-05-2026 17:50:32 EEST", None, "2026-05-20T14:50:32Z"),
    ("21 Oct 2026 21:23 UTC+3", None, "2026-10-21T18:23:00Z"),
    ("19 Apr 2025 07:17 UTC-4", None, "2025-04-19T11:17:00Z"),
    ("٢١ ديسمبر ٢٠٢٥ ٧:٤٣ م", None, "2025-12-21T17:43:00Z"),
    ("1761101516416", None, "2025-10-22T02:51:56Z"),
    ("1711984698", None, "2024-04-01T15:18:18Z"),
    ("2026/01/28 | 10:16", "Nowhere/Land", "2026-01-28T08:16:00Z"),
    ("30-OCT 2026", None, "2026-10-30"),
    ("5 سبتمبر 2026", None, "2026-09-05"),
    ("Jun 24, 2026 1:29 p.m.", "Asia/Riyadh", "2026-06-24T10:29:00Z"),
    ("28/9/26 12:15 a.m.", "Asia/Riyadh", "2026-09-27T21:15:00Z"),
    ("2026-10-29 23:50+0200", None, "2026-10-29T21:50:00Z"),
    ("26/10/2025 02:30", "Europe/Berlin", "2025-10-26T00:30:00Z"),  # twice: the first
    ("30/03/2025 02:30", "Europe/Berlin", "2025-03-30T01:30:00Z"),  # skipped: moves forward
    ("2025-01-02T03:04:05.999999+00:00", None, "2025-01-02T03:04:05Z"),
]
NONE = [None, "", "   ", "N/A", "31 Jun 2026", "2025-13-40", "30/02/2025 10:15", "10:15 PM", "today", "أمس", "0000-00-00", "12/12/2025 25:00", "x" * 100_000, "9" * 40]


@pytest.mark.parametrize("value,tz,normal", CASES)
def test_first_choice(value, tz, normal):
    best = min(S.interpretations(value, tz), key=lambda i: i[3])
    at = datetime.fromtimestamp(best[1], timezone.utc)
    assert at.strftime("%Y-%m-%dT%H:%M:%SZ" if best[2] else "%Y-%m-%d") == normal


@pytest.mark.parametrize("value", NONE)
def test_no_day(value):
    assert S.interpretations(value, None) == []


def test_every_interpretation():
    found = S.interpretations("03/04/05", None)
    assert [S.FORMATS[f] for f, *_ in found] == ["dmy", "mdy", "ymd2"]
    assert len(S.interpretations("26/10/2025 02:30", "Europe/Berlin")) == 2


def test_table(spark):
    data = [(f"r{k:03}", "c", v, t, "x", 1) for k, (v, t, _) in enumerate(CASES)] + [(f"n{k}", None, v, None, None, None) for k, v in enumerate(NONE)]
    schema = "id string, source string, value string, tz string, VALUE string, k0 int"
    df = spark.createDataFrame(data + data[:3], schema)
    got = S.normalised(df, "value", "tz", ["source"], ["id"], ["id"], rows_each=5)
    assert got.columns == ["id", "value", "normal"]
    want = {(f"r{k:03}", v, n) for k, (v, _, n) in enumerate(CASES)}
    got = [tuple(r) for r in got.collect()]
    assert set(got) == want and len(got) == len(CASES) + 3
    assert S.normalised(df.limit(0), "value", "tz", ["source"], ["id"], ["id"]).count() == 0


def brute(records):
    """The cheapest choice by trying all."""
    best = None
    for pick in itertools.product(*[range(len(r)) for r in records]):
        chosen = [r[p] for r, p in zip(records, pick)]
        cost = sum(c[3] for c in chosen) + sum((a[0] != b[0]) * S.SWITCH_COST + (b[1] < a[1]) * S.BACKWARD_COST for a, b in zip(chosen, chosen[1:]))
        if best is None or cost < best - 1e-9:
            best = cost
    return best


@pytest.mark.parametrize("parts", [1, 3, 7])
def test_context_decides_without_the_rule_and_partitions_do_not_matter(spark, parts):
    rnd = random.Random(3)
    values = [f"{rnd.randint(1, 14):02}/{rnd.randint(1, 12):02}/2025" for _ in range(9)]
    data = [(s, k, v) for s in ("a", "b", "c") for k, v in enumerate(values if s != "b" else values[::-1])]
    df = spark.createDataFrame(data, "source string, no int, value string").selectExpr("*", "cast(null as string) as tz")
    got = S.normalised(df, "value", "tz", ["source"], ["no"], ["source", "no"], rule_cost=0.0, rows_each=max(1, 27 // parts))
    out = {(r["source"], r["no"]): r["normal"] for r in got.collect()}
    for s in "abc":
        records = [S.interpretations(v, None, 0.0) for src, _, v in data if src == s]
        chosen = []
        for (_, k, v), states in zip([d for d in data if d[0] == s], records):
            chosen.append([x for x in states if datetime.fromtimestamp(x[1], timezone.utc).strftime("%Y-%m-%d") == out[s, k]])
        assert brute(chosen) == pytest.approx(brute(records))


def test_long_values():
    for value, want in (("1" * 200_000, 0), (" " * 100_000 + "2024-01-02" + " " * 100_000, 1), ("2024-" * 50_000, 0), ("2024-01-02T10:11:12." + "1" * 100_000, 1)):
        assert len(S.interpretations(value, None)) == want
