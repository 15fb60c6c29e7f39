"""Timestamps in mixed formats and zones: one unambiguous UTC time, or a calendar day where no time was written.

Every valid interpretation of a value is generated as an array of (format, instant or day, prior cost). Which one holds is
chosen by Viterbi over the records of each source in their order: a switch of format and a jump back in time cost. The
chain of a source may be of any length: it is cut into range partitions, each partition first reports the cheapest costs
between the interpretations of its first and last records, these are joined on the driver (a few numbers a partition), and
each partition then retraces its own part between fixed ends. The result is that of one Viterbi over the whole source.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone, tzinfo
from functools import lru_cache
from zoneinfo import ZoneInfo, ZoneInfoNotFoundError

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from qirtas.runtime import checkpointed, only, partitions_for

# --- Fixed values -----------------------------------------------------------------------------------------------------
MONTHS = {
    1: ["jan", "january", "يناير", "كانون الثاني", "janvier", "januar", "enero"],
    2: ["feb", "february", "فبراير", "شباط", "février", "februar", "febrero"],
    3: ["mar", "march", "مارس", "آذار", "mars", "märz", "marzo"],
    4: ["apr", "april", "أبريل", "ابريل", "إبريل", "نيسان", "avril", "abril"],
    5: ["may", "مايو", "أيار", "ايار", "mai", "mayo"],
    6: ["jun", "june", "يونيو", "يونيه", "حزيران", "juin", "juni", "junio"],
    7: ["jul", "july", "يوليو", "يوليه", "تموز", "juillet", "juli", "julio"],
    8: ["aug", "august", "أغسطس", "اغسطس", "آب", "août", "agosto"],
    9: ["sep", "sept", "september", "سبتمبر", "أيلول", "ايلول", "septembre", "septiembre"],
    10: ["oct", "october", "أكتوبر", "اكتوبر", "تشرين الأول", "octobre", "oktober", "octubre"],
    11: ["nov", "november", "نوفمبر", "تشرين الثاني", "novembre", "noviembre"],
    12: ["dec", "december", "ديسمبر", "كانون الأول", "décembre", "dezember", "diciembre"],
}
#: Zone abbreviations that mean one offset wherever they are used in the domain.
ZONES = {
    "z": "+00:00", "utc": "+00:00", "gmt": "+00:00", "wet": "+00:00", "west": "+01:00", "bst": "+01:00",
    "cet": "+01:00", "cest": "+02:00", "eet": "+02:00", "eest": "+03:00", "msk": "+03:00", "trt": "+03:00",
    "gst": "+04:00", "est": "-05:00", "edt": "-04:00", "cst": "-06:00", "cdt": "-05:00",
    "mst": "-07:00", "mdt": "-06:00", "pst": "-08:00", "pdt": "-07:00",
}
AM, PM = ["am", "a.m.", "a.m", "ص", "صباحا", "صباحاً"], ["pm", "p.m.", "p.m", "م", "مساء", "مساءً"]
FORMATS = ["ymd", "compact", "dmy", "mdy", "ymd2", "d_mon_y", "mon_d_y", "unix_s", "unix_ms"]
DEFAULT_ZONE = "Africa/Cairo"
# ----------------------------------------------------------------------------------------------------------------------

#: Cost of an interpretation that the written-order rule disfavours. Far above what any run of context costs can reach, the
#: rule always decides; set it to 0 and context decides.
RULE_COST = 1e9
SWITCH_COST = 1.0
BACKWARD_COST = 0.5

_HALF = "|".join(re.escape(m) for m in sorted(AM + PM, key=len, reverse=True))
_TIME = rf"(?P<h>\d{{1,2}}):(?P<mi>\d{{2}})(?::(?P<s>\d{{2}})(?:[.,]\d+)?)?(?:\s*(?P<half>{_HALF}))?"
_ZONE = r"\(?(?P<zone>(?:utc|gmt)?[+-]\d{1,2}(?::?\d{2})?|" + "|".join(sorted(ZONES, key=len, reverse=True)) + r")?\)?"
_TAIL = rf"(?:(?:t|\s*[-|,،]\s*|\s+at\s+|\s+){_TIME})?\s*{_ZONE}$"
_MONTH = {name: n for n, names in MONTHS.items() for name in names}
_MON = "(?P<mon>" + "|".join(sorted(map(re.escape, _MONTH), key=len, reverse=True)) + r")\.?"
_WEEKDAY = r"(?:[a-z\u0621-\u064a]+[,،]?\s+)?"
_YMD = re.compile(rf"(?P<y>\d{{4}})[-/.](?P<m>\d{{1,2}})[-/.](?P<d>\d{{1,2}}){_TAIL}")
_COMPACT = re.compile(rf"(?P<y>\d{{4}})(?P<m>\d{{2}})(?P<d>\d{{2}})t(?P<h>\d{{2}})(?P<mi>\d{{2}})(?P<s>\d{{2}})?(?:[.,]\d+)?{_ZONE}$")
_NUMERIC = re.compile(rf"(?P<a>\d{{1,2}})[-/.](?P<b>\d{{1,2}})[-/.](?P<c>\d{{4}}|\d{{2}}){_TAIL}")
_D_MON_Y = re.compile(rf"{_WEEKDAY}(?P<d>\d{{1,2}})[\s\-/.]*{_MON}[\s\-/.,،]*(?P<y>\d{{4}}|\d{{2}}){_TAIL}")
_MON_D_Y = re.compile(rf"{_WEEKDAY}{_MON}[\s\-/.]*(?P<d>\d{{1,2}})[\s\-/.,،]+(?P<y>\d{{4}}|\d{{2}}){_TAIL}")
_NUMBER = re.compile(r"\d{1,15}$")
_DIGITS = str.maketrans("٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹", "01234567890123456789")
_INVISIBLE = re.compile("[\u00ad\u061c\u200b-\u200f\u202a-\u202e\u2060-\u2069\ufeff]")
_EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)


def plain_stamp(value: str) -> str:
    """The value in lower case with ASCII digits, single ordinary spaces and nothing invisible."""
    return " ".join(_INVISIBLE.sub("", value).translate(_DIGITS).lower().split())


@lru_cache(maxsize=4096)
def zone_named(name: str | None) -> tzinfo:
    """The zone of a name; of none, or of one that does not exist, the default zone."""
    try:
        return ZoneInfo((name or "").strip() or DEFAULT_ZONE)
    except (ZoneInfoNotFoundError, ValueError, OSError):
        return ZoneInfo(DEFAULT_ZONE)


def _written_zone(text: str | None) -> tzinfo | None:
    if not text:
        return None
    m = re.search(r"([+-])(\d{1,2}?):?(\d{2})?$", text)
    if not m:
        m = re.fullmatch(r"([+-])(\d{2}):(\d{2})", ZONES[text])
    minutes = int(m[2]) * 60 + int(m[3] or 0)
    return timezone(timedelta(minutes=-minutes if m[1] == "-" else minutes)) if minutes < 24 * 60 else None


def _year(text: str) -> int:
    return int(text) + 2000 if len(text) == 2 else int(text)


def _seconds(at: datetime) -> int:
    return (at - _EPOCH) // timedelta(seconds=1)


Interpretation = tuple[int, int, bool, float]


def interpretations(value: str | None, tz: str | None, rule_cost: float = RULE_COST) -> list[Interpretation]:
    """Every valid interpretation of a value as (format, UTC seconds, whether a time is written, cost).

    Of a value without a time the seconds are midnight of the day as written. Wall time that occurs twice gives both
    instants, the second at rule_cost; skipped wall time moves forward by what was skipped. A day or a time that does not
    exist gives no interpretation. Null, blank and text without a date give an empty list. Values may be of any length.
    """
    if not value:
        return []
    text = plain_stamp(value)
    out: list[Interpretation] = []

    def add(fmt: str, y: int, m: int, d: int, part: dict, cost: float) -> None:
        h = part.get("h")
        try:
            day = datetime(y, m, d)
            if h is None:
                out.append((FORMATS.index(fmt), _seconds(day.replace(tzinfo=timezone.utc)), False, cost))
                return
            hour, half = int(h), part.get("half")
            hour = 0 if half in AM and hour == 12 else hour + 12 if half in PM and hour < 12 else hour
            wall = day.replace(hour=hour, minute=int(part["mi"]), second=int(part["s"] or 0))
            zone = _written_zone(part["zone"])
            first = _seconds(wall.replace(tzinfo=zone or zone_named(tz)))
            out.append((FORMATS.index(fmt), first, True, cost))
            if zone is None:
                second = wall.replace(tzinfo=zone_named(tz), fold=1)
                if (s := _seconds(second.astimezone(timezone.utc))) > first:
                    out.append((FORMATS.index(fmt), s, True, cost + rule_cost))
        except (ValueError, OverflowError):
            return

    if m := _YMD.match(text):
        add("ymd", int(m["y"]), int(m["m"]), int(m["d"]), m.groupdict(), 0.0)
    elif m := _COMPACT.match(text):
        add("compact", int(m["y"]), int(m["m"]), int(m["d"]), m.groupdict(), 0.0)
    elif m := _NUMERIC.match(text):
        a, b = int(m["a"]), int(m["b"])
        add("dmy", _year(m["c"]), b, a, m.groupdict(), 0.0)
        add("mdy", _year(m["c"]), a, b, m.groupdict(), 0.0 if b > 12 else rule_cost)
        if len(m["c"]) == 2 and len(m["a"]) == 2:
            add("ymd2", 2000 + a, b, int(m["c"]), m.groupdict(), 2 * rule_cost)
    elif m := _D_MON_Y.match(text):
        add("d_mon_y", _year(m["y"]), _MONTH[m["mon"]], int(m["d"]), m.groupdict(), 0.0)
    elif m := _MON_D_Y.match(text):
        add("mon_d_y", _year(m["y"]), _MONTH[m["mon"]], int(m["d"]), m.groupdict(), 0.0)
    elif _NUMBER.match(text):
        n = int(text)
        milli = n >= 100_000_000_000
        for fmt, s, cost in (("unix_s", n, rule_cost * milli), ("unix_ms", n // 1000, rule_cost * (not milli))):
            if s <= 253402300799:  # the end of the year 9999
                out.append((FORMATS.index(fmt), s, True, cost))
    return out


def _interpreted(rule_cost: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            known: dict[tuple, list[Interpretation]] = {}
            found = []
            for pair in zip(b["_value"], b["_tz"]):
                if pair not in known:
                    known[pair] = interpretations(*pair, rule_cost)
                found.append(known[pair])
            keep = [bool(f) for f in found]
            found = [f for f in found if f]
            out = b.loc[keep].drop(columns="_tz")
            for k, name in enumerate(("_fmt", "_at", "_timed", "_cost")):
                out[name] = [[i[k] for i in f] for f in found]
            yield out

    return run


# --- choice -----------------------------------------------------------------------------------------------------------
State = tuple[int, int]


def _steps(before: list[list[float]], last: list[State], states: list[State], priors: list[float]) -> tuple[list[list[float]], list[list[int]]]:
    """One step of Viterbi for every entry state at once; ties go to the earlier interpretation."""
    costs, back = [], []
    for row in before:
        c, b = [], []
        for (f, t), prior in zip(states, priors):
            best, at = None, 0
            for k, (pf, pt) in enumerate(last):
                v = row[k] + (SWITCH_COST if f != pf else 0.0) + (BACKWARD_COST if t < pt else 0.0)
                if best is None or v < best:
                    best, at = v, k
            c.append(best + prior)
            b.append(at)
        costs.append(c)
        back.append(b)
    return costs, back


def _records(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
    """source, the columns to pass on, interpretations as (format, instant), their costs."""
    for b in batches:
        kept = [b[c] for c in b.columns if c not in ("_source", "_fmt", "_cost")]
        for source, fmts, ats, costs, *row in zip(b["_source"], b["_fmt"], b["_at"], b["_cost"], *kept):
            yield source, row, [(int(f), int(a)) for f, a in zip(fmts, ats)], [float(c) for c in costs]


def _summaries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For the first and the last source of a partition: the costs from each first to each last interpretation."""
    chains: list[dict] = []
    for source, _, states, priors in _records(batches):
        if not chains or chains[-1]["source"] != source:
            if len(chains) > 1:
                chains.pop()  # a source that lies wholly inside
            k = len(states)
            chains.append({"source": source, "first": states, "last": states, "costs": [[priors[i] if i == j else float("inf") for j in range(k)] for i in range(k)]})
        else:
            c = chains[-1]
            c["costs"], _ = _steps(c["costs"], c["last"], states, priors)
            c["last"] = states
    out = pd.DataFrame([{"part": TaskContext.get().partitionId(), "place": n, **{k: c[k] if k == "source" else json.dumps(c[k]) for k in ("source", "first", "last", "costs")}} for n, c in enumerate(chains)], columns=["part", "place", "source", "first", "last", "costs"])
    if len(out):
        yield out


def _ends(rows: list) -> dict[tuple[int, int], tuple[int, int]]:
    """(partition, place) -> index of the interpretation of the first and the last record, from the summaries in order."""
    chain: list[dict] = []
    ends: dict[tuple[int, int], tuple[int, int]] = {}

    def close() -> None:
        if not chain:
            return
        # forward over segments: the state is the interpretation of a segment's last record
        cost, trace = None, []
        for seg in chain:
            first, last, m = seg["first"], seg["last"], seg["costs"]
            if cost is None:
                enter = [0.0] * len(first)
                came = [0] * len(first)
            else:
                enter, came = [], []
                for f, t in first:
                    options = [cost[k] + (SWITCH_COST if f != pf else 0.0) + (BACKWARD_COST if t < pt else 0.0) for k, (pf, pt) in enumerate(prev)]
                    came.append(min(range(len(options)), key=options.__getitem__))
                    enter.append(options[came[-1]])
            new, via = [], []
            for j in range(len(last)):
                options = [enter[i] + m[i][j] for i in range(len(first))]
                via.append(min(range(len(options)), key=options.__getitem__))
                new.append(options[via[-1]])
            trace.append((via, came))
            cost, prev = new, last
        j = min(range(len(cost)), key=cost.__getitem__)
        for seg, (via, came) in zip(reversed(chain), reversed(trace)):
            i = via[j]
            ends[seg["part"], seg["place"]] = (i, j)
            j = came[i]
        chain.clear()

    for r in sorted(rows, key=lambda r: (r["part"], r["place"])):
        seg = {"part": r["part"], "place": r["place"], "source": r["source"], "first": json.loads(r["first"]), "last": json.loads(r["last"]), "costs": json.loads(r["costs"])}
        if chain and chain[-1]["source"] != seg["source"]:
            close()
        chain.append(seg)
    close()
    return ends


def _chosen(ends: dict):
    """Retrace each source of a partition; the ends of the first and last one are given."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = TaskContext.get().partitionId()
        rows: list[list] = []
        picks: list[int] = []
        names: list[str] = []
        back: list[list[int]] = []
        own: list[list] = []
        state: dict = {"source": object(), "seen": 0}

        def close(place: int | None) -> None:
            if not own:
                return
            j = ends[part, place][1] if place is not None else min(range(len(state["cost"])), key=state["cost"].__getitem__)
            chosen = [j]
            for b in reversed(back):
                j = b[j]
                chosen.append(j)
            rows.extend(own)
            picks.extend(reversed(chosen))
            own.clear()
            back.clear()

        def out() -> pd.DataFrame:
            got = pd.DataFrame([[*row[:-2], row[-2][k], row[-1][k]] for row, k in zip(rows, picks)], columns=names)
            rows.clear()
            picks.clear()
            return got

        def named(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                names[:] = [c for c in b.columns if c not in ("_source", "_fmt", "_cost")]
                yield b

        for source, row, states, priors in _records(named(batches)):
            if source != state["source"]:
                close(0 if state["seen"] == 1 else None)
                state["seen"] += 1
                if state["seen"] == 1:
                    i = ends[part, 0][0]
                    cost = [p if k == i else float("inf") for k, p in enumerate(priors)]
                else:
                    cost = list(priors)
                state |= {"source": source, "last": states, "cost": cost}
            else:
                c, b = _steps([state["cost"]], state["last"], states, priors)
                back.append(b[0])
                state |= {"last": states, "cost": c[0]}
            own.append(row)
            if len(rows) > 50_000:
                yield out()
        # the last source of the partition is place 1 of the summaries, or 0 where it is the only one
        close((0 if state["seen"] == 1 else 1) if state["seen"] else None)
        if rows:
            yield out()

    return run


def normalised(values: DataFrame, value: str, tz: str, source: list[str], order: list[str], key: list[str], rule_cost: float = RULE_COST, rows_each: int = 100_000) -> DataFrame:
    """key, value and `normal` of each value that states an existing calendar day.

    normal is YYYY-MM-DDTHH:MM:SSZ in UTC, or YYYY-MM-DD where no time was written. source and order: columns that give
    the record order over which interpretations are chosen; key: columns that identify a value. Rows whose value is null or
    states no day are not in the result. Repeated rows give repeated results.
    """
    spark = values.sparkSession
    values = only(values, *dict.fromkeys([value, tz, *source, *order, *key]))
    keys = [F.col(k).alias(f"k{i}") for i, k in enumerate(key)]
    read = values.where(F.col(value).isNotNull()).select(F.to_json(F.struct(*source)).alias("_source"), F.struct(*order, *key).alias("_order"), *keys, F.col(value).alias("_value"), F.col(tz).alias("_tz"))
    parts = partitions_for(spark, values.count(), rows_each)
    ordered = read.repartitionByRange(parts, "_source", "_order").sortWithinPartitions("_source", "_order").drop("_order")
    arrays = [T.StructField(n, T.ArrayType(t)) for n, t in (("_fmt", T.IntegerType()), ("_at", T.LongType()), ("_timed", T.BooleanType()), ("_cost", T.DoubleType()))]
    schema = T.StructType([*[f for f in ordered.schema if f.name != "_tz"], *arrays])
    states = checkpointed(ordered.mapInPandas(_interpreted(rule_cost), schema)).select("_source", *[f"k{i}" for i in range(len(key))], "_value", "_fmt", "_cost", "_at", "_timed")
    summary = states.select("_source", "_fmt", "_cost", "_at").mapInPandas(_summaries, "part int, place int, source string, first string, last string, costs string").collect()
    schema = T.StructType([*[f for f in states.schema if f.name not in ("_source", "_fmt", "_cost", "_at", "_timed")], T.StructField("_at", T.LongType()), T.StructField("_timed", T.BooleanType())])
    best = states.mapInPandas(_chosen(_ends([r.asDict() for r in summary])), schema)
    normal = F.date_format(F.timestamp_seconds("_at"), "yyyy-MM-dd")
    normal = F.when(F.col("_timed"), F.date_format(F.timestamp_seconds("_at"), "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise(normal)
    return best.select(*[F.col(f"k{i}").alias(k) for i, k in enumerate(key)], F.col("_value").alias(value), normal.alias("normal"))
