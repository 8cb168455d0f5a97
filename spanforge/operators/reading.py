"""Reading windows, their extension, and bounded views for a scorer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanforge.functions import text as T

UNIT = "struct<unit_no:int,start_at:int,end_at:int>"


def windows(units: DataFrame, focus: DataFrame, key: str, capacity: int, reach: int = 1) -> DataFrame:
    """Window around each focus unit (UD2, H16): the whole group is required, then units within ``reach`` groups by nearness.

    ``units``: key, unit_no, group_no, start_at, end_at; ``focus``: focus_id, key, focus_no. A unit that does not
    fit is skipped and later ones are still tried. Statuses: ``oversized_unit`` (the group alone is too
    long, nothing is taken), ``partial_parent``, ``complete_window``; a focus without a unit gives ``unknown_focus``.
    """
    u = units.select(key, "unit_no", "group_no", "start_at", "end_at")
    at = focus.join(u.select(key, F.col("unit_no").alias("focus_no"), F.col("group_no").alias("focus_group")), [key, "focus_no"], "left")
    near = at.where("focus_group is not null").withColumn("group_no", F.explode(F.sequence(F.col("focus_group") - reach, F.col("focus_group") + reach))).join(u, [key, "group_no"])
    size = F.col("end_at") - F.col("start_at")
    item = F.struct((F.col("group_no") != F.col("focus_group")).cast("int").alias("rest"), F.abs(F.col("unit_no") - F.col("focus_no")).alias("far"), "unit_no", "start_at", "end_at", size.alias("size"))
    got = near.groupBy("focus_id", key, "focus_no").agg(F.array_sort(F.collect_list(item)).alias("items"))
    required = F.filter("items", lambda x: x["rest"] == 0)
    needed = F.aggregate(required, F.lit(0), lambda a, x: a + x["size"])

    def fill(a: Column, x: Column) -> Column:
        fits = a["used"] + x["size"] <= capacity
        return F.when(fits, F.struct((a["used"] + x["size"]).alias("used"), F.array_append(a["units"], x["unit_no"]).alias("units"))).otherwise(a)

    start = F.struct(needed.alias("used"), F.transform(required, lambda x: x["unit_no"]).alias("units"))
    filled = F.aggregate(F.filter("items", lambda x: x["rest"] == 1), start, fill)
    got = got.withColumn("filled", F.when(needed <= capacity, filled))
    taken = F.coalesce(F.array_sort("filled.units"), F.expr("cast(array() as array<int>)"))
    left = F.array_sort(F.array_except(F.transform("items", lambda x: x["unit_no"]), taken))
    status = F.when(F.col("filled").isNull(), "oversized_unit").when(F.size(left) > 0, "partial_parent").otherwise("complete_window")
    done = got.select("focus_id", key, "focus_no", taken.alias("units"), left.alias("omitted"), F.coalesce("filled.used", F.lit(0)).alias("used"), status.alias("status"))
    none = F.expr("cast(array() as array<int>)")
    lost = at.where("focus_group is null").select("focus_id", key, "focus_no", none.alias("units"), none.alias("omitted"), F.lit(0).alias("used"), F.lit("unknown_focus").alias("status"))
    return done.unionByName(lost)


def cursors(source: Column, version: Column, offsets: Column) -> Column:
    """Version-bound continuation cursors as canonical JSON."""
    return F.transform(offsets, lambda o: F.concat(F.lit('{"offset": '), o.cast("string"), F.lit(', "source_id": "'), source, F.lit('", "version": {"hash": "'), version, F.lit('"}}')))


def check_cursor(cursor: Column, source: Column, version: Column) -> Column:
    """Offset of a cursor; an error if it is of another source or version."""
    c = F.from_json(cursor, "offset int, source_id string, version struct<hash:string>")
    return F.when((c["source_id"] == source) & (c["version"]["hash"] == version), c["offset"]).otherwise(F.raise_error(F.lit("continuation of another source or version")))


def extended(taken: DataFrame, dense: DataFrame, capacity: int, key: str = "focus_id") -> DataFrame:
    """Adds dense spans that no taken span contains (UD5, JN6); over the capacity is an error."""
    spans = taken.select(key, "start_at", "end_at").distinct()
    new = dense.join(spans.withColumnRenamed("start_at", "s").withColumnRenamed("end_at", "e"), (dense[key] == spans[key]) & (F.col("s") <= dense["start_at"]) & (dense["end_at"] <= F.col("e")), "left_anti")
    every = spans.unionByName(new.select(key, "start_at", "end_at").distinct())
    out = every.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("start_at", "end_at"))).alias("spans"), F.sum(F.col("end_at") - F.col("start_at")).alias("used"))
    return out.withColumn("spans", F.when(F.col("used") <= capacity, F.col("spans")).otherwise(F.raise_error(F.lit("extended reading exceeds its capacity"))))


def view_units(passages: Column, focus: Column) -> Column:
    """Sentences of a view's passages, table passages whole: ``(text, focal, required)``.

    ``passages``: array of structs with ``text``, ``start_at``, ``kind`` and ``required``.
    """

    def parts(p: Column) -> Column:
        whole = F.array(F.struct(F.lit(0).alias("start"), F.length(p["text"]).alias("end")))
        spans = F.when(p["kind"] == "table", whole).otherwise(T.sentences(p["text"]))

        def unit(s: Column) -> Column:
            focal = (p["start_at"] + s["start"] <= focus) & (focus < p["start_at"] + s["end"])
            return F.struct(F.substr(p["text"], s["start"] + 1, s["end"] - s["start"]).alias("text"), focal.alias("focal"), p["required"].alias("required"))

        return F.transform(spans, unit)

    return F.flatten(F.transform(passages, parts))


def bounded_views(query: Column, identity: Column, whole: Column, units: Column, limit: int) -> Column:
    """At most two views of whole units around the focal one (UD4), by code points of query and view together.

    The whole text under its identity if it fits. Else the focal unit, its neighbours and what is
    required, then others by nearness while they fit: once the later of two at one distance first,
    once the earlier. None if what must be there does not fit, or no unit is focal.
    """
    n = F.size(units)
    places = F.sequence(F.lit(0), n - 1)
    centre = F.array_position(F.transform(units, lambda u: u["focal"]), F.lit(True)).cast("int") - 1
    cost = lambda i: F.length(F.get(units, i)["text"]) + 1
    must = F.filter(places, lambda i: (F.abs(i - centre) <= 1) | F.get(units, i)["required"])
    head = F.length(query) + F.length(identity)
    start = F.aggregate(must, head, lambda a, i: a + cost(i))
    joined = lambda chosen: F.concat(identity, F.lit("\n"), F.array_join(F.transform(F.array_sort(chosen), lambda i: F.get(units, i)["text"]), "\n"))

    def view(direction: int) -> Column:
        rest = F.array_sort(F.transform(F.array_except(places, must), lambda i: F.struct(F.abs(i - centre).alias("far"), (i * direction).alias("side"))))

        def fill(a: Column, x: Column) -> Column:
            i = x["side"] * direction
            used = a["used"] + cost(i)
            return F.when(used <= limit, F.struct(used.alias("used"), F.array_append(a["chosen"], i).alias("chosen"))).otherwise(a)

        return joined(F.aggregate(rest, F.struct(start.alias("used"), must.alias("chosen")), fill, lambda a: a["chosen"]))

    full = F.concat(identity, F.lit("\n"), whole)
    none = F.expr("cast(array() as array<string>)")
    several = F.when((n == 0) | (centre < 0), none).when(start > limit, none).otherwise(F.array_distinct(F.array(view(-1), view(1))))
    return F.when(F.length(query) + F.length(full) <= limit, F.array(full)).otherwise(several)
