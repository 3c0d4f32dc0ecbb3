"""Members of JSON objects that drift between files: one table, and a log of changes.

Every line is read once. Each file's header schema (which drifting members it
carries, under which name and with which JSON types) is an aggregate of counters
and type bits, combined on the map side, so a file of any size leaves a map task
as a few small rows. The headers are folded through a promotion lattice to
the types of the consistent table, and put in order within their project to log
what differs from the file before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.session import written

#: Members that do not drift: the token counts that ``total`` sums, with it.
STABLE = ("input", "input_cache_creation", "output", "output_reasoning_tokens")
TOTAL = "total"
#: The two quantities that drift, by the name they have in the consistent table.
COUNTED, UNCOUNTED = "input_cached_tokens", "unmapped_fixture_category"

#: The member that holds the quantities, and the members beside it that every line should carry, with their types where none does.
USAGE = "usage_details"
USUAL = {"id": "string", "project_id": "string", "type": "string", "start_time": "string", "total_cost": "decimal(20,8)"}

#: JSON types as bits; the order is that of the promotion lattice.
TYPES = ("integer", "decimal", "boolean", "string", "array", "object")
_BIT = {t: 1 << i for i, t in enumerate(TYPES)}
_NUMERIC = _BIT["integer"] | _BIT["decimal"]


def promoted(bits: int, digits: int = 0, scale: int = 0) -> str:
    """SQL type that holds all JSON types of a bit set without loss: the lattice is
    integer < decimal < string and boolean < string; arrays and objects are held
    as their JSON text. ``digits``, ``scale``: the most digits before and after the
    point; decimals that no decimal(38) holds are held as text."""
    if bits and bits & ~_BIT["integer"] == 0:
        return "bigint"
    if bits and bits & ~_NUMERIC == 0 and digits + scale <= 38:
        return f"decimal(38,{max(scale, min(6, 38 - digits))})"
    if bits == _BIT["boolean"]:
        return "boolean"
    return "string"


def _type_bit(value: Column) -> Column:
    """Bit of a variant's JSON type; 0 for null."""
    kind = F.coalesce(F.schema_of_variant(value), F.lit("VOID"))
    bit = lambda k: (
        F.when(k == "VOID", 0).when(k == "BIGINT", _BIT["integer"]).when(k.startswith("DECIMAL") | k.isin("DOUBLE", "FLOAT"), _BIT["decimal"])
        .when(k == "STRING", _BIT["string"]).when(k == "BOOLEAN", _BIT["boolean"]).when(k.startswith("ARRAY"), _BIT["array"]).otherwise(_BIT["object"])
    )
    return F.get(F.transform(F.array(kind), bit), F.lit(0))  # the lambda makes Spark work the type out once


def _plain_number(text: Column) -> Column:
    """The one number in a value's JSON text, also inside an array or object."""
    return F.try_to_number(F.regexp_extract(text, r"-?\d+(?:\.\d+)?", 0), F.lit("S" + "9" * 20 + "D" + "9" * 9))


def parsed_lines(lines: DataFrame) -> DataFrame:
    """Lines with ``object`` (variant of ``raw_line``; null if it is no JSON
    object) and ``usage`` (map of the ``usage_details`` members to variants)."""
    obj = F.try_parse_json("raw_line")
    return lines.select("file_key", "line_no", obj.alias("object")).withColumn("usage", F.try_variant_get("object", "$.usage_details", "map<string,variant>"))


def _residual() -> Column:
    """What the stable token members leave of ``total``."""
    residual = F.try_variant_get(F.col("usage")[TOTAL], "$", "bigint")
    for name in STABLE:
        residual = residual - F.coalesce(F.try_variant_get(F.col("usage")[name], "$", "bigint"), F.lit(0))
    return residual


def _entries(members: Column, inside: bool, text) -> Column:
    return F.transform(F.map_entries(members), lambda e: F.struct(F.lit(inside).alias("inside"), e["key"].alias("member"), _type_bit(e["value"]).alias("bit"), text(e["value"]).alias("text")))


_KIND = "array<struct<inside:boolean,member:string,bit:int,text:string>>"


def _evidence() -> list[Column]:
    """What tells the quantity of a member: where it has a value and what is left of ``total`` there."""
    held, left = F.col("bit") > 0, F.col("residual") > 0
    number = F.when(held & left & ~F.col("member").isin(*STABLE, TOTAL), _plain_number(F.col("text")))  # looked at only where it tells something
    return [
        F.bit_or("bit").cast("int").alias("types"), F.count_if(held).alias("held"), F.count_if(held & left).alias("held_left"), F.count_if(held & ~left).alias("held_none"),
        F.count_if(held & left & (number == F.col("residual"))).alias("matches"), F.count_if(held & left & (number != F.col("residual"))).alias("differs"),
    ]


def drifting_counters(lines: DataFrame) -> DataFrame:
    """Counters of each file's drifting members, and of its lines (null ``member``), from one
    reading of the lines; a file is a few small rows, summed within map tasks."""
    drifting = F.map_filter("usage", lambda k, _: ~k.isin(*STABLE, TOTAL))
    line = F.array(F.struct(F.lit(True).alias("inside"), F.lit(None).cast("string").alias("member"), F.lit(1).alias("bit"), F.lit(None).cast("string").alias("text")))
    parsed = parsed_lines(lines).filter(F.size("usage") > 0)
    rows = parsed.select("file_key", _residual().alias("residual"), F.explode(F.concat(line.cast(_KIND), _entries(drifting, True, F.to_json).cast(_KIND))).alias("m"))
    return rows.select("file_key", "residual", "m.*").groupBy("file_key", "member").agg(*_evidence())


def quantities(counters: DataFrame) -> DataFrame:
    """Header schema of each file out of its counters: ``file_key, quantity, member, types`` (bits).

    ``total`` counts the cached tokens and not the category: a member that has a
    value where nothing is left of ``total``, or none where something is, is not
    the counted quantity; of two members left, the one whose numbers are what is
    left of ``total`` is. A file of which nothing tells them apart takes the
    quantity from the reading of that name in most other files. Members beyond two
    have no quantity (null); the category is the one of them with most values.
    """
    lines_left = counters.filter("member is null").select(F.col("file_key").alias("key"), F.col("held_left").alias("lines_left"))
    c = counters.filter("member is not null").join(lines_left, F.col("file_key") == F.col("key"))
    against = F.col("held_none") + (F.col("lines_left") - F.col("held_left"))
    votes = (
        F.when((against > 0) & (F.col("matches") == 0), UNCOUNTED)
        .when((F.col("matches") > 0) & (F.col("differs") == 0) & (against == 0), COUNTED)
        .when(against > F.col("matches"), UNCOUNTED)
        .when(F.col("matches") > F.col("differs"), COUNTED)
        .when(F.col("differs") > 0, UNCOUNTED)
        .when(F.col("held_left") > 0, COUNTED)
    )
    voted = c.withColumn("vote", votes).select("file_key", "member", "types", "vote", "held", F.col("matches").alias("score"))
    usual = voted.filter("vote is not null").groupBy("member").agg(F.mode("vote", True).alias("usual"))
    read = voted.join(usual, "member", "left").withColumn("vote", F.coalesce("vote", "usual", F.lit(UNCOUNTED)))
    # Of the few members of a file that fit the counted quantity the best one is it; of two that fit neither, the better one.
    order = F.struct(F.when(F.col("vote") == COUNTED, 0).otherwise(1).alias("v"), (-F.col("score")).alias("s"), "member", "types", "held")
    all_ = read.groupBy("file_key").agg(F.array_sort(F.collect_list(order)).alias("all"))
    first = F.col("all")[0]
    counted = F.when((first["v"] == 0) | (F.size("all") > 1), first["member"])
    rest = F.array_sort(F.transform(F.filter("all", lambda e: ~e["member"].eqNullSafe(F.col("counted"))), lambda e: F.struct((-e["held"]).alias("h"), e["member"].alias("member"))))
    split = all_.withColumn("counted", counted).withColumn("uncounted", F.get(rest, F.lit(0))["member"])
    each = split.select("file_key", "counted", "uncounted", F.explode("all").alias("e")).select("file_key", "counted", "uncounted", "e.member", "e.types")
    named = F.when(F.col("member") == F.col("counted"), COUNTED).when(F.col("member") == F.col("uncounted"), UNCOUNTED)
    return each.select("file_key", named.alias("quantity"), "member", "types")


def file_headers(lines: DataFrame) -> DataFrame:
    """:func:`quantities` of the lines, read once; the counters are kept as a small table."""
    return quantities(written(drifting_counters(lines)))


def wide_headers(lines: DataFrame, files: DataFrame) -> DataFrame:
    """One row for each file with the header of both quantities (null: not carried) and of
    further members (a map of their types)."""
    h = file_headers(lines)
    one = lambda q: F.max(F.when(F.col("quantity") == q, F.struct("member", "types")))
    more = F.collect_list(F.when(F.col("quantity").isNull(), F.struct("member", "types")))
    wide = h.groupBy("file_key").agg(one(COUNTED).alias("c"), one(UNCOUNTED).alias("u"), F.map_from_entries(F.array_sort(more)).alias("x"))
    return files.select("project_id", "file_key", "window_start").join(wide, "file_key", "left")


def with_previous(df: DataFrame, key: str, order: list[str], value: Column, bucket: Column) -> DataFrame:
    """``df`` with ``previous``: ``value`` of the row before in ``key`` by ``order``.

    In two steps, so that a key with a large share of the rows is no single task:
    within (key, bucket), then for the first row of each bucket from the last rows
    of the buckets before, of which there are as many as a key has buckets.
    ``bucket`` must not decrease along ``order``. Null keys are one key.
    """
    rows = df.withColumn("b", bucket).withColumn("v", value)
    inner = Window.partitionBy(key, "b").orderBy(*order)
    rows = rows.withColumn("n", F.row_number().over(inner)).withColumn("p", F.lag("v").over(inner))
    last = rows.groupBy(key, "b").agg(F.max_by("v", F.struct(*order)).alias("last"))
    outer = Window.partitionBy(key).orderBy("b")
    last = last.select(F.col(key).alias("key2"), F.col("b").alias("b2"), F.lag("last").over(outer).alias("before"), F.lag(F.lit(1)).over(outer).isNotNull().alias("has"))
    joined = rows.join(last, rows[key].eqNullSafe(last.key2) & rows.b.eqNullSafe(last.b2), "left")
    first = F.col("n") == 1
    return joined.withColumn("previous", F.when(first, F.col("before")).otherwise(F.col("p"))).withColumn("is_first", first & ~F.col("has")).drop("b", "v", "n", "p", "key2", "b2", "before", "has")


def changes(lines: DataFrame, files: DataFrame) -> DataFrame:
    """The ordered log: ``project_id, file_key, member, change`` of each file that
    differs from the one before it in its project.

    A file that lists no line has the header of no member. Files with a null
    ``window_start`` come first, ties go by ``file_key``. A file repeated in
    ``files`` counts once. Members beyond the two quantities are compared by name. An empty table gives no row.
    """
    wide = wide_headers(lines, files.dropDuplicates(["project_id", "file_key"]))
    linked = with_previous(wide, "project_id", ["window_start", "file_key"], F.struct("c", "u", "x"), F.coalesce(F.date_trunc("month", "window_start"), F.lit("0001-01-01").cast("timestamp")))
    found = []
    for q in ("c", "u"):
        now, old = F.col(q), F.col(f"previous.{q}")
        entry = lambda member, change: F.struct(member.alias("member"), F.lit(change).alias("change"))
        both = now.isNotNull() & old.isNotNull()
        found += [
            F.when(now.isNotNull() & old.isNull(), entry(F.col(f"{q}.member"), "added")),
            F.when(now.isNull() & old.isNotNull(), entry(F.col(f"previous.{q}.member"), "removed")),
            F.when(both & (F.col(f"{q}.member") != F.col(f"previous.{q}.member")), entry(F.col(f"{q}.member"), "renamed")),
            F.when(both & (F.col(f"{q}.types") != F.col(f"previous.{q}.types")), entry(F.col(f"{q}.member"), "type_changed")),
        ]
    none = F.expr("map_from_arrays(array_repeat('', 0), array_repeat(0, 0))")
    now, old = F.coalesce("x", none), F.coalesce("previous.x", none)
    entries = lambda keys, change: F.transform(keys, lambda k: F.struct(k.alias("member"), F.lit(change).alias("change")))
    kept = F.array_intersect(F.map_keys(now), F.map_keys(old))
    more = F.concat(
        entries(F.array_except(F.map_keys(now), F.map_keys(old)), "added"), entries(F.array_except(F.map_keys(old), F.map_keys(now)), "removed"),
        entries(F.filter(kept, lambda k: now[k] != old[k]), "type_changed"),
    )
    return (
        linked.filter(~F.col("is_first"))
        .select("project_id", "file_key", F.explode(F.concat(F.array_compact(F.array(*found)), more)).alias("x"))
        .select("project_id", "file_key", "x.member", "x.change")
    )


def _member_lines(lines: DataFrame) -> DataFrame:
    """Lines with the maps ``top`` and ``usage`` of their members to variants, which hold
    numbers of up to 38 digits without exponent exactly, others in double precision."""
    kind = "map<string,variant>"
    p = lines.select("file_key", "line_no", F.try_variant_get(F.try_parse_json("raw_line"), "$", kind).alias("top"))
    return p.withColumn("usage", F.try_variant_get(F.col("top")[USAGE], "$", kind))


def _text(value: Column) -> Column:
    return F.try_variant_get(value, "$", "string")


def _number_size(text: Column) -> tuple[Column, Column]:
    """Digits of a JSON number before and after its point, without an exponent."""
    part = lambda k: F.regexp_extract(text, r"^-?(\d+)(?:\.(\d*?)0*)?(?:[eE]([-+]?\d+))?$", k)
    power = F.coalesce(part(3).try_cast("int"), F.when(part(3) != "", 1_000_000).otherwise(0))
    return F.greatest(F.length(part(1)) + power, F.lit(1)), F.greatest(F.length(part(2)) - power, F.lit(0))


def member_counters(lines: DataFrame) -> DataFrame:
    """As :func:`drifting_counters`, over all members of the lines and of ``usage_details``
    (``inside``), with the most digits of their numbers before and after the point."""
    none = F.expr(f"cast(array() as {_KIND})")
    line = F.array(F.struct(F.lit(None).cast("boolean").alias("inside"), F.lit(None).cast("string").alias("member"), F.lit(1).alias("bit"), F.lit(None).cast("string").alias("text")))
    line = F.when(F.size("usage") > 0, line.cast(_KIND)).otherwise(none)
    m = _member_lines(lines).filter("top is not null")
    m = m.select("file_key", F.col("usage").isNotNull().alias("split"), _residual().alias("residual"), F.explode(F.concat(line, _entries(F.col("top"), False, _text).cast(_KIND), F.coalesce(_entries(F.col("usage"), True, _text).cast(_KIND), none))).alias("m"))
    m = m.select("file_key", "split", "residual", "m.*").filter(F.col("member").isNull() | F.col("inside") | (F.col("member") != USAGE) | ~F.col("split") & (F.col("bit") > 0))
    digits, scale = _number_size(F.col("text"))
    whole = F.col("bit") == _BIT["integer"]  # no point and no exponent: its digits are its length
    size = F.when(whole, F.greatest(F.length("text") - F.col("text").startswith("-").cast("int"), F.lit(1))).when(F.col("bit") == _BIT["decimal"], digits)
    after = F.when(F.col("bit") == _BIT["decimal"], scale)
    most = lambda v: F.coalesce(F.max(v), F.lit(0))
    return m.groupBy("file_key", "inside", "member").agg(*_evidence(), most(size).alias("digits"), most(after).alias("scale"))


def union_schema(counters: DataFrame, headers: DataFrame) -> dict[tuple[bool, str | None, str | None], str]:
    """SQL type of each column: by whether the member is one of ``usage_details``, its
    quantity (null: none) and its name (null for a quantity), over the headers of all files."""
    named = headers.filter("quantity is not null").select("file_key", F.lit(True).alias("inside"), "member", "quantity")
    joined = counters.filter("member is not null").join(named, ["file_key", "inside", "member"], "left").withColumn("member", F.when(F.col("quantity").isNull(), F.col("member")))
    rows = joined.groupBy("inside", "quantity", "member").agg(F.bit_or("types"), F.max("digits"), F.max("scale")).collect()  # one row for each column of the table
    return {(r[0], r[1], r[2]): promoted(*r[3:]) if r[3] else "" for r in rows}


def consistent_table(lines: DataFrame) -> DataFrame:
    """All lines in one schema: every member of the lines and of ``usage_details`` that
    any file carries, both drifting quantities under one name each, all in the
    promoted type of all files.

    The members of :data:`USUAL` come first, whether carried or not, then others by
    name; a name that is taken (case apart) gets a ``_``. A line that is no JSON
    object has nulls in all members. Values are text where files differ in a way no
    number holds, arrays and objects are held as JSON text; ``usage_details`` itself
    is a column only if some line holds something else than an object there.
    """
    counters = written(member_counters(lines))
    drifting = counters.filter(F.col("member").isNull() | F.col("inside") & ~F.col("member").isin(*STABLE, TOTAL))
    headers = written(quantities(drifting))
    types = union_schema(counters, headers)
    names = headers.groupBy("file_key").pivot("quantity", [COUNTED, UNCOUNTED]).agg(F.max("member"))
    names = names.select("file_key", F.col(COUNTED).alias("counted_name"), F.col(UNCOUNTED).alias("uncounted_name"))
    p = _member_lines(lines).join(names, "file_key", "left")
    known = [(False, None, name) for name in USUAL] + [(True, None, name) for name in (*STABLE, TOTAL)] + [(True, COUNTED, None), (True, UNCOUNTED, None)]
    usual = USUAL | dict.fromkeys((*STABLE, TOTAL), "bigint")
    taken = {"file_key", "line_no"}
    columns = []
    for key in known + sorted(types.keys() - set(known), key=lambda k: (k[0], k[2])):
        inside, quantity, member = key
        if quantity:
            value = F.col("usage")[F.col("counted_name" if quantity == COUNTED else "uncounted_name")]
        elif inside:
            drifts = F.coalesce(F.col("counted_name") == member, F.lit(False)) | F.coalesce(F.col("uncounted_name") == member, F.lit(False))
            value = F.when(~drifts, F.col("usage")[member])
        else:
            value = F.when(F.col("usage").isNull() | F.lit(member != USAGE), F.col("top")[member])
        name = quantity or member
        while name.casefold() in taken:
            name += "_"
        taken.add(name.casefold())
        columns.append(_text(value).try_cast(types.get(key) or usual.get(member, "string")).alias(name))
    return p.select("file_key", "line_no", *columns)
