"""Mixed timestamp spellings to UTC instants.

A value is tokenised into a mask of character classes (digits become ``9``, letters
``a``, everything else stays), the few distinct masks of a batch are each resolved to a
parser once per worker, and all values of one mask are converted together on a
two-dimensional byte array: a mask fixes the position of every field, so parsing is
slicing. Times without zone go through transition tables of their IANA zone; the
tables are read once a session, on the driver, from the JVM's zone rules, carry that
rule set's version and are bounded by the number of IANA zones.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.text import SPACES, fold

INVALID = "invalid"
_DAY = 86_400_000_000
_NAT = np.iinfo(np.int64).min
#: Years that have a canonical spelling.
FIRST_YEAR, LAST_YEAR = 1, 9999
_FIRST, _LAST = -62_135_596_800_000_000, 253_402_300_799_999_999
#: Microseconds of the 400 years after which the calendar, and with it a zone's yearly rules, repeat.
_CYCLE = 146_097 * _DAY

#: English month and day names.
MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")
DAYS = ("Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun")
#: Usual meaning of zone abbreviations, in minutes east of UTC.
ABBREVIATIONS = {
    "UTC": 0, "GMT": 0, "Z": 0, "UT": 0, "WET": 0, "WEST": 60, "BST": 60, "CET": 60, "CEST": 120, "MEZ": 60, "MESZ": 120,
    "EET": 120, "EEST": 180, "MSK": 180, "IST": 330, "JST": 540, "KST": 540, "AWST": 480, "ACST": 570, "ACDT": 630,
    "AEST": 600, "AEDT": 660, "NZST": 720, "NZDT": 780, "EST": -300, "EDT": -240, "CST": -360, "CDT": -300,
    "MST": -420, "MDT": -360, "PST": -480, "PDT": -420, "AKST": -540, "AKDT": -480, "HST": -600, "COT": -300, "BRT": -180,
}


@dataclass(frozen=True)
class ZoneTables:
    """Local-time switch points of zones: ``bounds[z][i]`` is the local time (µs
    since 1970) from which ``offsets[z][i + 1]`` (µs) holds instead of
    ``offsets[z][i]``. The switch point is the transition plus the larger of both
    offsets: a local time that occurs twice gets the earlier instant, a skipped
    one the offset before the change. ``ends[z]``: where a zone switches every year for
    ever, the local time after which the table's last 400 years repeat (else the greatest)."""

    version: str
    bounds: dict[str, np.ndarray]
    offsets: dict[str, np.ndarray]
    ends: dict[str, int]

    def offset(self, zone: str, local: np.ndarray) -> np.ndarray:
        """Offset of local times; unknown zones are UTC."""
        if zone not in self.bounds:
            return np.zeros(len(local), np.int64)
        past = np.maximum(local, self.ends[zone]) - self.ends[zone]
        local = local - -(-past // _CYCLE) * _CYCLE
        return self.offsets[zone][np.searchsorted(self.bounds[zone], local, side="right")]


_TRANSITION = re.compile(r"Transition\[\w+ at (-?\d+)-(\d\d)-(\d\d)T(\d\d):(\d\d)(?::(\d\d))?\S*? to (Z|[-+][\d:]+)\]")
_STARTS = re.compile(r"at \S*?(Z|[-+]\d\d:\d\d(?::\d\d)?) to")
_TABLES: dict[tuple[str, str], tuple[np.ndarray, np.ndarray, int]] = {}


def _seconds(offset: str) -> int:
    if offset == "Z":
        return 0
    h, m, s = [int(x) for x in offset[1:].split(":")] + [0] * (2 - offset.count(":"))
    return (-1 if offset[0] == "-" else 1) * (h * 3600 + m * 60 + s)


def _days(year: int, month: int, day: int) -> int:
    """Days since 1970 of a date of the calendar, also beyond the year 9999."""
    y = year - (month <= 2)
    of_year = (153 * ((month + 9) % 12) + 2) // 5 + day - 1
    return y * 365 + y // 4 - y // 100 + y // 400 + of_year - 719_468


def _zone_table(rules, epoch) -> tuple[np.ndarray, np.ndarray, int]:
    """Switch points, offsets and end of the table of one zone's rules (driver side)."""
    switches: list[tuple[int, int, int]] = []  # local time before the change, offsets before and after, in seconds
    listed = str(rules.getTransitions().toString())
    year = 1970
    for m, before in zip(_TRANSITION.finditer(listed), _STARTS.finditer(listed), strict=True):
        year = int(m[1])
        at = _days(year, int(m[2]), int(m[3])) * 86_400 + int(m[4]) * 3600 + int(m[5]) * 60 + int(m[6] or 0)
        switches.append((at, _seconds(before[1]), _seconds(m[7])))
    yearly = []
    for r in rules.getTransitionRules():
        dow, kind = r.getDayOfWeek(), str(r.getTimeDefinition())
        time = 86_400 if r.isMidnightEndOfDay() else r.getLocalTime().toSecondOfDay()
        before, after = r.getOffsetBefore().getTotalSeconds(), r.getOffsetAfter().getTotalSeconds()
        shift = before if kind == "UTC" else before - r.getStandardOffset().getTotalSeconds() if kind == "STANDARD" else 0
        yearly.append((r.getMonth().getValue(), r.getDayOfMonthIndicator(), None if dow is None else dow.getValue(), time + shift, before, after))
    end = np.iinfo(np.int64).max
    if yearly:
        first = year + 1
        for y in range(first, first + 401):
            of_year = []
            for month, day, dow, time, before, after in yearly:
                date = _days(y, month, day) if day > 0 else _days(y + month // 12, month % 12 + 1, 1) + day
                if dow is not None:  # on or after a day of the month, or on or before its end
                    today = (date + 3) % 7 + 1
                    date += (dow - today) % 7 if day > 0 else -((today - dow) % 7)
                of_year.append((date * 86_400 + time, before, after))
            switches += sorted(of_year)
        end = _days(first + 401, 1, 1) * 86_400_000_000
    if not switches:
        return np.zeros(0, np.int64), np.array([rules.getOffset(epoch).getTotalSeconds()], np.int64) * 1_000_000, end
    bounds = [at + max(0, after - before) for at, before, after in switches]
    offsets = [switches[0][1], *(after for _, _, after in switches)]
    return np.array(bounds, np.int64) * 1_000_000, np.array(offsets, np.int64) * 1_000_000, end


def zone_tables(spark: SparkSession, names: list[str]) -> ZoneTables:
    """Transition tables of IANA zones, from the JVM's rules (driver side, one table for
    each zone and version of the rules, kept for the process; unknown names are left out
    and count as UTC)."""
    jvm = spark._jvm
    zone_id = jvm.java.time.ZoneId
    known = set(zone_id.getAvailableZoneIds())
    version = str(jvm.java.time.zone.ZoneRulesProvider.getVersions("UTC").lastEntry().getKey())
    chosen = sorted(set(names) & known)
    for name in chosen:
        if (version, name) not in _TABLES:
            _TABLES[version, name] = _zone_table(zone_id.of(name).getRules(), jvm.java.time.Instant.EPOCH)
    return ZoneTables(version, *({n: _TABLES[version, n][i] for n in chosen} for i in range(3)))


# Parsers ---------------------------------------------------------------------

_Y, _M2, _D2, _T6 = r"(?P<Y>9999)", r"(?P<m>99)", r"(?P<d>99)", r"(?P<H>99):(?P<M>99):(?P<S>99)"
_FRACTION, _OFFSET = r"(?:[.,](?P<f>9+))?", r"(?P<z>[+-]99:?99|a)"
#: Shapes as patterns over masks; what the letters say (T, Z, month, day, AM/PM, zone) is checked with the values.
SHAPES = tuple(
    re.compile(p + r"\Z")
    for p in (
        rf"{_Y}-{_M2}-{_D2}(?:(?P<t>a)| )(?P<H>99):(?P<M>99)(?::(?P<S>99){_FRACTION})? ?{_OFFSET}?",
        rf"{_Y}{_M2}{_D2}(?P<t>a)(?P<H>99)(?P<M>99)(?P<S>99){_FRACTION}{_OFFSET}?",
        rf"{_Y}/{_M2}/{_D2} {_T6}{_FRACTION}(?: (?P<a>a{{1,4}}))?",
        rf"{_D2}\.{_M2}\.{_Y} (?P<H>99):(?P<M>99)(?::(?P<S>99){_FRACTION})?",
        rf"(?:(?P<w>aaa), )?(?P<d>99?) (?P<b>aaa) {_Y} {_T6} (?:(?P<z>[+-]99:?99)|(?P<a>a{{1,4}}))",
        rf"(?P<b>aaa) (?P<d>99?), {_Y} (?P<H>99?):(?P<M>99)(?::(?P<S>99))? (?P<p>aa)",
    )
)
_EPOCH = {10: 1_000_000, 13: 1_000, 16: 1}
_CANONICAL = re.compile(r"9999-99-99a99:99:99(?:\.9+)?a\Z")
_MASK_CACHE: dict[str, tuple | None] = {}


def _parser(mask: str) -> tuple | None:
    """Kind and field spans of a mask, found once for each mask."""
    if mask not in _MASK_CACHE:
        if len(_MASK_CACHE) > 20_000:
            _MASK_CACHE.clear()
        found = None
        if len(mask) in _EPOCH and set(mask) == {"9"}:
            found = ("epoch", _EPOCH[len(mask)], False)
        else:
            for shape in SHAPES:
                if m := shape.match(mask):
                    found = ("fields", {k: m.span(k) for k, v in m.groupdict().items() if v is not None}, bool(_CANONICAL.match(mask)))
                    break
        _MASK_CACHE[mask] = found
    return _MASK_CACHE[mask]


def masked(text: pa.Array) -> pa.Array:
    """Masks of stripped texts; texts with other characters than ASCII have the mask ``?``."""
    plain = pc.if_else(pc.string_is_ascii(text), text, "?")
    return pc.replace_substring_regex(pc.replace_substring_regex(plain, "[0-9]", "9"), "[A-Za-z]", "a")


def _number(chars: np.ndarray, span: tuple[int, int]) -> np.ndarray:
    out = np.zeros(len(chars), np.int64)
    for i in range(*span):
        out = out * 10 + (chars[:, i].astype(np.int64) - 48)
    return out


def _words(chars: np.ndarray, span: tuple[int, int], table: dict[str, int], missing: int, upper: bool) -> np.ndarray:
    width = span[1] - span[0]
    words = np.ascontiguousarray(chars[:, span[0] : span[1]]).view(f"S{width}").ravel()
    seen, back = np.unique(words, return_inverse=True)
    text = [w.decode("ascii") for w in seen]
    return np.array([table.get(t.upper() if upper else t, missing) for t in text], np.int64)[back]


_MONTH_NO = {m: i + 1 for i, m in enumerate(MONTHS)}
_DAY_NO = {d: i for i, d in enumerate(DAYS)}
_MISSING = 1 << 40


def _parse(chars: np.ndarray, spec: dict[str, tuple[int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Local microseconds, offset in µs (``_MISSING``: no zone), and validity."""
    n = len(chars)
    year, day = _number(chars, spec["Y"]), _number(chars, spec["d"])
    month = _number(chars, spec["m"]) if "m" in spec else _words(chars, spec["b"], _MONTH_NO, 0, False)
    hour, minute = _number(chars, spec["H"]), _number(chars, spec["M"])
    second = _number(chars, spec["S"]) if "S" in spec else np.zeros(n, np.int64)
    ok = (year >= FIRST_YEAR) & (year <= LAST_YEAR) & (month >= 1) & (month <= 12) & (day >= 1) & (minute < 60) & (second < 60)
    if "p" in spec:
        noon = _words(chars, spec["p"], {"AM": 0, "PM": 12}, 0, True)
        ok &= (hour >= 1) & (hour <= 12)
        hour = hour % 12 + noon
    ok &= hour < 24
    months = (np.where(ok, year, 1970) - 1970) * 12 + np.where(ok, month, 1) - 1
    first = months.astype("datetime64[M]").astype("datetime64[D]").astype(np.int64)
    length = (months + 1).astype("datetime64[M]").astype("datetime64[D]").astype(np.int64) - first
    ok &= day <= length
    local = (first + day - 1) * _DAY + ((hour * 60 + minute) * 60 + second) * 1_000_000
    if "f" in spec:
        a, b = spec["f"]
        b = min(b, a + 6)
        local = local + _number(chars, (a, b)) * 10 ** (6 - (b - a))
    if "t" in spec:
        ok &= (chars[:, spec["t"][0]] | 32) == ord("t")
    if "w" in spec:
        ok &= _words(chars, spec["w"], _DAY_NO, -1, False) >= 0
    offset = np.full(n, _MISSING, np.int64)
    if "z" in spec:
        a, b = spec["z"]
        if b - a == 1:
            offset[:] = 0
            ok &= (chars[:, a] | 32) == ord("z")
        else:
            hours, minutes = _number(chars, (a + 1, a + 3)), _number(chars, (b - 2, b))
            ok &= (hours <= 18) & (minutes < 60)
            offset = np.where(chars[:, a] == 45, -1, 1) * (hours * 60 + minutes) * 60_000_000
    elif "a" in spec:
        minutes = _words(chars, spec["a"], ABBREVIATIONS, _MISSING, True)
        ok &= minutes != _MISSING
        offset = np.where(minutes != _MISSING, minutes * 60_000_000, 0)
    return local, offset, ok


def to_utc(values: pa.Array, zones: pa.Array, tables: ZoneTables) -> tuple[np.ndarray, np.ndarray]:
    """UTC microseconds of each value (the minimum of int64: none) and whether it
    is a real time already in the canonical spelling. ``zones`` gives the IANA
    name for times without zone; null and unknown names count as UTC. Null and
    blank values have no instant."""
    n = len(values)
    out, canonical = np.full(n, _NAT, np.int64), np.zeros(n, bool)
    if n == 0:
        return out, canonical
    raw = pc.fill_null(values, "")
    text = pc.utf8_trim(raw, SPACES)
    masks = masked(text).dictionary_encode()
    codes = masks.indices.to_numpy(zero_copy_only=False)
    order = np.argsort(codes, kind="stable")
    starts = np.searchsorted(codes[order], np.arange(len(masks.dictionary) + 1))
    untouched = pc.equal(raw, text).to_numpy(zero_copy_only=False)
    local_rows, local_times = [], []
    for code, mask in enumerate(masks.dictionary.to_pylist()):
        rows = order[starts[code] : starts[code + 1]]
        if not mask or (parser := _parser(mask)) is None:
            continue
        width = len(mask)
        joined = "".join(text.take(pa.array(rows)).to_pylist()).encode("ascii")
        chars = np.frombuffer(joined, np.uint8).reshape(len(rows), width)
        kind, spec, plain = parser
        if kind == "epoch":
            out[rows] = _number(chars, (0, width)) * spec
            continue
        local, offset, ok = _parse(chars, spec)
        zoned = offset != _MISSING
        out[rows[ok & zoned]] = (local - offset)[ok & zoned]
        local_rows.append(rows[ok & ~zoned])
        local_times.append(local[ok & ~zoned])
        if plain:
            canonical[rows] = ok & untouched[rows] & (chars[:, 10] == ord("T")) & (chars[:, -1] == ord("Z"))
    if local_rows:
        rows, times = np.concatenate(local_rows), np.concatenate(local_times)
        named = pc.fill_null(zones, "").take(pa.array(rows)).dictionary_encode()
        which = named.indices.to_numpy(zero_copy_only=False)
        for code, name in enumerate(named.dictionary.to_pylist()):
            hit = which == code
            out[rows[hit]] = times[hit] - tables.offset(name, times[hit])
    out[(out < _FIRST) | (out > _LAST)] = _NAT  # a zone's offset can lead beyond the years that have a spelling
    return out, canonical & (out != _NAT)


def spell(micros: np.ndarray) -> pa.Array:
    """``YYYY-MM-DDThh:mm:ss.ffffffZ``, or ``invalid`` where there is no instant."""
    stamps = pa.array(np.where(micros == _NAT, 0, micros), pa.timestamp("us"))
    text = pc.binary_join_element_wise(pc.strftime(stamps, format="%Y-%m-%dT%H:%M:%S"), "Z", "")
    return pc.if_else(pa.array(micros == _NAT), INVALID, text)


def normalised(
    df: DataFrame, value: str, owner: str, owners: DataFrame, keep: list[str], tables: ZoneTables | None = None, cases_only: bool = False, keep_blank: bool = False
) -> DataFrame:
    """``df`` as ``keep`` columns plus ``utc`` (text), ``instant`` (timestamp, null
    if none) and ``canonical`` of the string column ``value``.

    ``owners`` has ``owner_key`` (folded) and ``time_zone``; one row for each key.
    Null and blank values give no row, with ``keep_blank`` one without instant. ``cases_only`` leaves out values that are
    real times in canonical spelling. Column names that clash with the added
    ones must be renamed by the caller.
    """
    spark = df.sparkSession
    if tables is None:
        iana = sorted(spark._jvm.java.time.ZoneId.getAvailableZoneIds())  # some 600 names: the most that the next line can fetch
        tables = zone_tables(spark, [r[0] for r in owners.filter(F.col("time_zone").isin(iana)).select("time_zone").distinct().collect()])
    rows = df.select(*[F.col(c).alias(f"k_{c}") for c in keep], F.col(value).alias("v"), fold(F.col(owner)).alias("o"))
    if not keep_blank:
        rows = rows.filter(F.col("v").isNotNull() & (F.btrim("v", F.lit(SPACES)) != ""))
    joined = rows.join(owners.select("owner_key", "time_zone"), F.col("o") == F.col("owner_key"), "left").drop("o", "owner_key")
    fields = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    shared = tables

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            micros, plain = to_utc(batch.column("v"), batch.column("time_zone"), shared)
            if cases_only:
                hit = pa.array(~plain)
                batch, micros, plain = batch.filter(hit), micros[~plain], plain[~plain]
            instant = pa.array(np.where(micros == _NAT, 0, micros), pa.timestamp("us", "UTC"), mask=micros == _NAT)
            columns = [batch.column(f"k_{c}") for c in keep]
            yield pa.RecordBatch.from_arrays([*columns, spell(micros), instant, pa.array(plain)], names=[*keep, "utc", "instant", "canonical"])

    return joined.mapInArrow(convert, f"{fields}, utc string, instant timestamp, canonical boolean")


def mask_report(df: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """``keys, mask, has_parser, n``: how often each mask occurs among the non-blank values,
    and whether a parser reads it (masks without one are 'invalid' as a whole)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            masks = masked(pc.utf8_trim(batch.column("v"), SPACES))
            seen = masks.dictionary_encode()
            known = pa.array([_parser(m) is not None for m in seen.dictionary.to_pylist()], pa.bool_())
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), masks, known.take(seen.indices)], names=[*keys, "mask", "has_parser"])

    rows = df.select(*keys, F.col(value).alias("v")).filter(F.btrim("v", F.lit(SPACES)) != "")
    fields = "".join(f"`{k}` {df.schema[k].dataType.simpleString()}, " for k in keys)
    return rows.mapInArrow(run, f"{fields}mask string, has_parser boolean").groupBy(*keys, "mask", "has_parser").agg(F.count(F.lit(1)).alias("n"))


def zones_used(spark: SparkSession, owners: DataFrame) -> DataFrame:
    """``time_zone, version, changes``: the zones of ``owners`` by the version of the rules
    they are converted with and the switches their tables hold; null where unknown (read as UTC)."""
    names = [r[0] for r in owners.select("time_zone").distinct().orderBy("time_zone").limit(2000).collect()]
    tables = zone_tables(spark, names)
    rows = [(n, tables.version if n in tables.bounds else None, len(tables.bounds[n]) if n in tables.bounds else None) for n in names]
    return spark.createDataFrame(rows, "time_zone string, version string, changes int")


def zone_owners(zones: DataFrame, kind: str) -> DataFrame:
    """One zone for each owner of a kind, owners in the form they are compared in;
    of an owner listed twice the least zone name holds."""
    listed = zones.filter((F.col("owner_kind") == kind) & F.col("owner_id").isNotNull() & F.col("time_zone").isNotNull())
    return listed.groupBy(fold(F.col("owner_id")).alias("owner_key")).agg(F.min("time_zone").alias("time_zone"))
