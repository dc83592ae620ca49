"""Placement records: overhangs, placement to a fixpoint, scaffolds with gaps, AGP, joint scaffolds of two maps, drawings as tables."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..scratch import cut
from ..session import ship_package
from . import fixpoint
from .ranges import islands, ranged

TOLERANCE = 12  # standard deviations


def _tokens(string: Column) -> Column:
    return F.filter(F.split(F.replace(string, F.lit(";"), F.lit(" ; ")), r"\s+"), lambda x: x != "")


def _frags_before(string: Column, last: bool) -> Column:
    """Fragments before the first, or the last, ``;`` of an alignment string."""
    t = _tokens(string)
    at = F.size(t) - F.array_position(F.reverse(t), ";") if last else F.array_position(t, ";") - 1
    return F.size(F.filter(F.slice(t, 1, F.greatest(at, F.lit(0)).cast("int")), lambda x: x != ";"))


def merged_sites(sites: Column, least: int = 700) -> Column:
    """Sites at least ``least`` bp from the one listed before them; the first one always."""
    return F.filter(sites, lambda x, i: (i == 0) | (x - F.get(sites, i - 1) >= least))


def with_ends(records: DataFrame, least: int = 700) -> DataFrame:
    """Records with c_start and c_end (query bp outside the outermost matched sites) and o_first and o_last (reference sites there)."""
    kept = merged_sites(F.col("sites"), least)
    turned = F.when(F.col("forward"), kept).otherwise(F.transform(F.reverse(kept), lambda x: F.col("size") - x))
    rows = records.withColumn("_s", turned)
    first_c, last_c = _frags_before(F.col("contig_string"), False), _frags_before(F.col("contig_string"), True)
    return rows.withColumns({
        "c_start": F.get("_s", first_c - 1), "c_end": F.col("size") - F.get("_s", last_c - 1),
        "o_first": F.col("op_start") + _frags_before(F.col("optical_string"), False), "o_last": F.col("op_start") + _frags_before(F.col("optical_string"), True),
    }).drop("_s")


def _sums_at(places: DataFrame, optical: DataFrame, sums: dict[str, Column]) -> DataFrame:
    """(map_id, place and ``sums``) of the ``places`` (map_id, place) that are fragments of ``optical`` or one past a map's end: ``sums`` over the map's fragments before each, written.

    Places stand among the fragments in one running sum for each map, so fragments are shuffled once and only what was asked for is joined afterwards.
    """
    asked = places.select("map_id", F.col("place").cast("bigint").alias("place")).filter(F.col("place").isNotNull()).distinct()
    values = optical.select("map_id", F.col("place").cast("bigint").alias("place"), F.lit(1).alias("own"), *[v.alias(c) for c, v in sums.items()])
    rows = values.unionByName(asked.withColumn("own", F.lit(0)), allowMissingColumns=True)
    w = Window.partitionBy("map_id").orderBy("place", "own")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    last, next_ = F.max(F.when(F.col("own") == 1, F.col("place"))).over(before), F.min(F.when(F.col("own") == 1, F.col("place"))).over(w.rowsBetween(1, 1))
    summed = rows.select("map_id", "place", "own", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c) for c in sums], last.alias("last_"), next_.alias("next_"))
    return cut(summed.filter((F.col("own") == 0) & ((F.col("last_") == F.col("place") - 1) | (F.col("next_") == F.col("place")))).drop("own", "last_", "next_"), "sums")


def _places(rows: DataFrame, *columns: str | Column) -> DataFrame:
    return rows.select("map_id", F.explode(F.array(*columns)).alias("place"))


def _spans(places: DataFrame, optical: DataFrame) -> DataFrame:
    """:func:`_sums_at` of sizes, squared deviations and separators."""
    return _sums_at(places, optical, {"before": F.col("size"), "var_before": F.col("sd") * F.col("sd"), "zeros_before": (F.col("sd") == 0).cast("int")})


def overhangs(records: DataFrame, optical: DataFrame) -> DataFrame:
    """Records (map_id, ...) with start_hang and end_hang: query bp that stick out beyond the reference span next to the matched sites, 12 deviations allowed, at least 0.

    ``optical`` has map_id, place, size and sd.  Spans come from prefix sums, so no span is walked.
    """
    rows = with_ends(records)
    sums = _spans(_places(rows, F.col("op_start") + 1, "o_first", "o_last", "op_end"), optical)

    def at(df: DataFrame, place: Column, name: str) -> DataFrame:
        s = sums.select(F.col("map_id").alias("_m"), F.col("place").alias("_p"), F.col("before").alias(f"b_{name}"), F.col("var_before").alias(f"v_{name}"))
        return df.join(s, (df["map_id"] == F.col("_m")) & (place == F.col("_p")), "left").drop("_m", "_p")

    for place, name in ((F.col("op_start") + 1, "s0"), (F.col("o_first"), "s1"), (F.col("o_last"), "e0"), (F.col("op_end"), "e1")):
        rows = at(rows, place, name)

    def hang(own: str, a: str, b: str) -> Column:
        span, var = F.greatest(F.lit(0.0), F.col(f"b_{b}") - F.col(f"b_{a}")), F.greatest(F.lit(0.0), F.col(f"v_{b}") - F.col(f"v_{a}"))
        return F.greatest(F.lit(0), (F.col(own) - (span + TOLERANCE * F.sqrt(var))).cast("int"))

    out = rows.withColumns({"start_hang": hang("c_start", "s0", "s1"), "end_hang": hang("c_end", "e0", "e1")})
    return out.drop(*[f"{x}_{y}" for x in "bv" for y in ("s0", "s1", "e0", "e1")])


def place_to_fixpoint(candidates: DataFrame, optical: DataFrame, fixed: DataFrame | None = None) -> DataFrame:
    """``candidates`` (map_id, record, contig_id, op_start, op_end) with status ``placed``, ``conflict`` or ``rest``.

    In turns: candidates that meet an occupied fragment, or stick out into one that is too short, go; the first query with exactly one candidate left is placed and occupies
    its fragments.  ``fixed`` ones are placed before.  What sticks out is worked out anew as fragments become shorter, from the columns of :func:`with_ends` (c_start, c_end, o_first, o_last); without
    these, it is start_hang and end_hang throughout.  See :mod:`fixpoint`.
    """

    def shaped(rows: DataFrame, is_fixed: bool) -> DataFrame:
        if "o_first" not in rows.columns:
            rows = rows.withColumns({"c_start": F.col("start_hang"), "c_end": F.col("end_hang"), "o_first": F.col("op_start") + 1, "o_last": F.col("op_end")})
        ends = [F.col(c).cast("double" if c[0] == "c" else "int").alias(c) for c in ("c_start", "c_end", "o_first", "o_last")]
        return rows.select("map_id", F.col("record").cast("bigint").alias("record"), "contig_id", "op_start", "op_end", *ends, F.lit(is_fixed).alias("fixed"))

    rows = shaped(candidates, False)
    return fixpoint.settled(rows if fixed is None else rows.unionByName(shaped(fixed, True)), optical)


def scaffolds(records: DataFrame, optical: DataFrame) -> DataFrame:
    """Per placed query: scaffold (number on its map), order, contig_id, orientation, size, gap and gap_sd to the next one, type.

    The gap is the reference span between the outermost matched sites less the overhangs, at least 1; a separator (a deviation of 0) in it ends the scaffold.
    """
    w = Window.partitionBy("map_id").orderBy("op_start", "record")
    ended = with_ends(records)
    # A query's last site is where the next one's span begins.
    sums = _spans(_places(ended, "o_first", "o_last"), optical)
    rows = ended.withColumns({"prev_last": F.lag("o_last").over(w), "prev_end": F.lag("c_end").over(w), "seq": F.row_number().over(w)})
    for place, name in (("prev_last", "a"), ("o_first", "b")):
        s = sums.select(F.col("map_id").alias("_m"), F.col("place").alias("_p"), *[F.col(c).alias(f"{c}_{name}") for c in ("before", "var_before", "zeros_before")])
        rows = rows.join(s, (rows["map_id"] == F.col("_m")) & (rows[place] == F.col("_p")), "left").drop("_m", "_p")
    diff = lambda c: F.greatest(F.lit(0), F.col(f"{c}_b") - F.col(f"{c}_a"))
    breaks = F.col("prev_last").isNull() | (diff("zeros_before") > 0)
    gap = F.greatest(F.lit(1), (diff("before") - F.col("prev_end") - F.col("c_start")).cast("int"))
    rows = rows.withColumns({"breaks": breaks, "gap_in": F.when(~breaks, gap), "sd_in": F.when(~breaks, F.sqrt(diff("var_before")).cast("int"))})
    rows = rows.withColumn("scaffold", F.sum(F.col("breaks").cast("int")).over(w) - 1)
    v = Window.partitionBy("map_id", "scaffold").orderBy("seq")
    return rows.select(
        "map_id", "scaffold", F.row_number().over(v).alias("order"), "contig_id", F.when(F.col("forward"), "BE").otherwise("EB").alias("orientation"), "size",
        F.coalesce(F.lead("gap_in").over(v), F.lit(0)).alias("gap"), F.coalesce(F.lead("sd_in").over(v), F.lit(0)).alias("gap_sd"), "type",
    )


def scaffold_lines(rows: DataFrame) -> DataFrame:
    """(map_id, scaffold, value): a header ``>scaffN queries bases span`` and a line for each query."""
    line = F.concat_ws(" ", "contig_id", "orientation", F.col("size").cast("string"), F.col("gap").cast("string"), F.col("gap_sd").cast("string"), F.coalesce("type", F.lit("")))
    each = rows.groupBy("map_id", "scaffold").agg(F.count("*").alias("n"), F.sum("size").alias("bases"), F.sum("gap").alias("gaps"), F.sort_array(F.collect_list(F.struct("order", line.alias("line")))).alias("s"))
    header = F.concat(F.lit(">scaff"), F.col("scaffold").cast("string"), F.lit(" "), F.concat_ws(" ", F.col("n").cast("string"), F.col("bases").cast("string"), (F.col("bases") + F.col("gaps")).cast("string")))
    return each.select("map_id", "scaffold", F.concat_ws("\n", header, F.array_join("s.line", "\n")).alias("value"))


def agp(rows: DataFrame, group: str = "scaffold") -> DataFrame:
    """AGP rows of scaffolds (``group``, order, contig_id, orientation, size, gap): object, begin, end, part, type W or N, and their fields.

    A gap row follows each query with a gap above 0; positions run from 1 by a window sum.
    """
    item = F.array(
        F.struct(F.lit("W").alias("kind"), F.col("size").cast("bigint").alias("span")),
        F.struct(F.lit("N").alias("kind"), F.col("gap").cast("bigint").alias("span")),
    )
    parts = rows.select(group, "order", "contig_id", "orientation", F.posexplode(item).alias("k", "x")).filter((F.col("k") == 0) | (F.col("x.span") > 0))
    w = Window.partitionBy(group).orderBy("order", "k")
    end = F.sum("x.span").over(w.rowsBetween(Window.unboundedPreceding, 0))
    is_w = F.col("x.kind") == "W"
    return parts.select(
        F.col(group).alias("object"), (end - F.col("x.span") + 1).alias("object_begin"), end.alias("object_end"), F.row_number().over(w).alias("part_number"), F.col("x.kind").alias("component_type"),
        F.when(is_w, F.col("contig_id")).otherwise(F.col("x.span").cast("string")).alias("component"), F.when(is_w, F.lit("1")).otherwise("fragment").alias("component_begin"),
        F.when(is_w, F.col("x.span").cast("string")).otherwise("No").alias("component_end"), F.when(is_w, F.when(F.col("orientation") == "BE", "+").otherwise("-")).otherwise("").alias("orientation"),
    )


def anchored(records: DataFrame, optical: DataFrame, anchor: str | DataFrame, least: int = 800) -> DataFrame:
    """Per record of each circular map that has ``anchor``: contig_id, size, dir (BE or EB, as the anchor sees it), loc and sd from the anchor.

    ``anchor`` is a query's id, or a table of them (contig_id): then the rows of every anchor, and a column anchor.
    Going round the map in the anchor's direction, a query's location is the span from the anchor's last matched site to its own first one, less both overhangs; the
    anchor's own is minus its size.  Spans are prefix sums modulo the map's length.
    """
    rows = with_ends(records, least)
    n = cut(optical.groupBy("map_id").agg(F.count("*").alias("n_opt"), F.sum("size").alias("whole"), F.sum(250 + F.col("size") * F.col("size") * 0.0004).alias("whole_var")), "map-sums")
    asked = _places(rows.join(n, "map_id"), F.pmod("o_first", "n_opt"), F.pmod("o_last", "n_opt"))
    sums = _sums_at(asked, optical, {"b": F.col("size"), "v": 250 + F.col("size") * F.col("size") * 0.0004})
    many = not isinstance(anchor, str)
    a = rows.join(anchor.select("contig_id").distinct(), "contig_id", "left_semi") if many else rows.filter(F.col("contig_id") == anchor)
    a = a.select("map_id", F.col("contig_id").alias("anchor"), F.when(F.col("forward"), 1).otherwise(-1).alias("way"), F.col("record").alias("a_record"), F.col("o_first").alias("a_first"), F.col("o_last").alias("a_last"), F.col("c_start").alias("a_start"), F.col("c_end").alias("a_end"))
    rows = rows.join(a, "map_id").join(n, "map_id")
    up = F.col("way") > 0
    # Fragments from .. to - 1 are crossed going up; going down the same span lies between the query's last and the anchor's first site.
    begin, end = F.when(up, F.col("a_last")).otherwise(F.col("o_last")), F.when(up, F.col("o_first")).otherwise(F.col("a_first"))
    rows = rows.withColumns({"from_": F.pmod(begin, F.col("n_opt")), "to_": F.pmod(end, F.col("n_opt"))})
    for place, name in (("from_", "0"), ("to_", "1")):
        s = sums.select(F.col("map_id").alias("_m"), F.col("place").alias("_p"), F.col("b").alias(f"b{name}"), F.col("v").alias(f"v{name}"))
        rows = rows.join(s, (rows["map_id"] == F.col("_m")) & (rows[place] == F.col("_p")), "left").drop("_m", "_p")
    round_ = F.col("to_") < F.col("from_")
    span = F.col("b1") - F.col("b0") + F.when(round_, F.col("whole")).otherwise(0)
    var = F.col("v1") - F.col("v0") + F.when(round_, F.col("whole_var")).otherwise(0)
    own, other = F.when(up, F.col("c_start")).otherwise(F.col("c_end")), F.when(up, F.col("a_end")).otherwise(F.col("a_start"))
    is_anchor = F.col("record") == F.col("a_record")
    same = F.when(F.col("forward"), 1).otherwise(-1) * F.col("way") == 1
    return rows.select(
        *["anchor"] * many, "map_id", "contig_id", "size", F.when(same, "BE").otherwise("EB").alias("dir"), F.when(is_anchor, -F.col("size")).otherwise(F.greatest(F.lit(0), span - own - other)).cast("double").alias("loc"),
        F.when(is_anchor, 0.0).otherwise(F.sqrt(F.greatest(F.lit(0.0), var))).alias("sd"),
    )


def merge_maps(one: DataFrame, two: DataFrame, tolerance: float = TOLERANCE, by: tuple[str, ...] = ()) -> DataFrame:
    """Full outer merge of two maps' locations (contig_id, dir, loc, sd): outcome ``one``, ``two``, ``both``, ``direction`` or ``location``; the last two have no loc.

    Where both place a query in the same direction and no further apart than ``tolerance`` times the sum of deviations, the second map's values hold.
    ``by`` names further columns of both that a query is merged within, such as the anchor.
    """
    key = [*by, "contig_id"]
    a = one.select(*key, *[F.col(c).alias(f"{c}1") for c in ("dir", "loc", "sd")])
    b = two.select(*key, *[F.col(c).alias(f"{c}2") for c in ("dir", "loc", "sd")])
    rows = a.join(b, key, "full_outer")
    near = F.abs(F.col("loc1") - F.col("loc2")) <= tolerance * (F.col("sd1") + F.col("sd2"))
    outcome = F.when(F.col("loc2").isNull(), "one").when(F.col("loc1").isNull(), "two").when(F.col("dir1") != F.col("dir2"), "direction").when(near, "both").otherwise("location")
    kept = outcome.isin("one", "two", "both")
    return rows.withColumn("outcome", outcome).select(*key, F.when(kept, F.coalesce("dir2", "dir1")).alias("dir"), F.when(kept, F.coalesce("loc2", "loc1")).alias("loc"), F.when(kept, F.coalesce("sd2", "sd1")).alias("sd"), "outcome", near.alias("near"))


def resolve_ambiguous(rest1: DataFrame, rest2: DataFrame, merged: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """(contig_id, dir, loc, sd) of queries without a location so far whose open placements agree on both maps: same direction, locations within tolerance.

    An equi-join on query and direction with the distance as residual; of several agreeing pairs the one with the least locations counts.
    """
    open_ = merged.filter(F.col("loc").isNotNull()).select("contig_id")
    a = rest1.join(open_, "contig_id", "left_anti").select("contig_id", "dir", F.col("loc").alias("loc1"), F.col("sd").alias("sd1"))
    b = rest2.select("contig_id", "dir", F.col("loc").alias("loc2"), F.col("sd").alias("sd2"))
    pairs = a.join(b, ["contig_id", "dir"]).filter(F.abs(F.col("loc1") - F.col("loc2")) <= tolerance * (F.col("sd1") + F.col("sd2")))
    best = pairs.groupBy("contig_id").agg(F.min(F.struct("loc1", "loc2", "dir", "sd2")).alias("m"))
    return best.select("contig_id", F.col("m.dir").alias("dir"), F.col("m.loc2").alias("loc"), F.col("m.sd2").alias("sd"))


def emit_ordered(placed: DataFrame, tolerance: float = TOLERANCE, by: str = "scaffold") -> DataFrame:
    """(by, order, contig_id, orientation, size, gap): queries in order of location; one that begins inside the last kept one is skipped unless it reaches beyond
    its end and its begin may, within tolerance, lie there.  Gaps are 1 at least, the last is 0.  ``placed``: by, contig_id, dir, loc, sd, size."""
    ship_package(placed.sparkSession)
    rows = placed.select(by, "contig_id", "dir", F.col("loc").cast("double").alias("loc"), F.col("sd").cast("double").alias("sd"), F.col("size").cast("double").alias("size"))
    # A query that begins behind all ends before it is kept whatever was kept there, so the scan may start anew with it.
    rows = islands(rows, [by], F.col("loc"), F.col("loc") + F.col("size"), [F.col("contig_id")]).withColumnRenamed("island", "run")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, end, sd = None, 0.0, 0.0
        for batch in batches:
            good = []
            for group, loc, own, size, number in zip(*(batch.column(c).to_pylist() for c in (by, "loc", "sd", "size", "run")), strict=True):
                # All of a query's values are compared with those of the one kept last.
                keep = (group, number) != run or loc >= end or (loc + size > end and loc + tolerance * (own + sd) > end)
                good.append(keep)
                if keep:
                    run, end, sd = (group, number), loc + size, own
            yield batch.filter(pa.array(good, pa.bool_()))

    rows = rows.repartition(by, "run").sortWithinPartitions(by, "run", "loc", "contig_id").mapInArrow(scan, rows.schema)
    kept = ranged(rows, [by], [F.col("loc"), F.col("contig_id")], "kept").running("order", "sum", F.lit(1), inclusive=True).plain()
    rows = ranged(kept, [by], [F.col("order").desc()], "kept").running("after", "min", F.col("loc")).plain()
    gap = F.when(F.col("after").isNull(), 0.0).otherwise(F.greatest(F.lit(1.0), F.col("after") - F.col("loc") - F.col("size")))
    rows = rows.withColumn("order", F.col("order").cast("int"))
    return rows.select(by, "order", "contig_id", F.col("dir").alias("orientation"), F.col("size").cast("int").alias("size"), gap.cast("int").alias("gap"))


def anchors(one: DataFrame, two: DataFrame) -> DataFrame:
    """Queries placed on both maps (contig_id, size), largest first when sorted by size."""
    return one.select("contig_id", "size").distinct().join(two.select("contig_id").distinct(), "contig_id", "left_semi")


def try_anchors(records1: DataFrame, optical1: DataFrame, records2: DataFrame, optical2: DataFrame, tried: DataFrame | None = None, tolerance: float = TOLERANCE) -> DataFrame:
    """One row for each anchor (of all queries that both maps place, or those of ``tried``): contigs, bases, direction and location mismatches.

    All anchors are one plan, with the anchor as a column of each step.
    """
    tried = anchors(records1, records2).select("contig_id") if tried is None else tried
    merged = cut(merge_maps(anchored(records1, optical1, tried), anchored(records2, optical2, tried), tolerance, ("anchor",)), "anchors")
    sizes = records1.select("contig_id", "size").union(records2.select("contig_id", "size")).groupBy("contig_id").agg(F.max("size").alias("size"))
    rows = merged.filter(F.col("loc").isNotNull()).join(sizes, "contig_id")
    kept = emit_ordered(rows, tolerance, by="anchor")
    count = kept.groupBy("anchor").agg(F.count("*").alias("contigs"), F.sum("size").alias("bases"))
    bad = merged.groupBy("anchor").agg(F.count_if(F.col("outcome") == "direction").alias("direction_mismatch"), F.count_if((F.col("outcome") == "location") | ((F.col("outcome") == "direction") & ~F.col("near"))).alias("location_mismatch"))
    return bad.join(count, "anchor", "left").select("anchor", F.coalesce("contigs", F.lit(0)).alias("contigs"), F.coalesce("bases", F.lit(0)).alias("bases"), "direction_mismatch", "location_mismatch")


def placed_records(records: DataFrame, optical: DataFrame) -> DataFrame:
    """Records (contig_id unique or not) of each map with status: unambiguous ones are MATCH, those placed in turns FILTER, the others conflict or rest.

    Queries with one record on a map are placed first and occupy its fragments; the others are worked off to a fixpoint.
    """
    once = cut(records.withColumn("_n", F.count("*").over(Window.partitionBy("map_id", "contig_id"))), "records")
    single, several = once.filter("_n = 1").drop("_n"), once.filter("_n > 1").drop("_n")
    status = place_to_fixpoint(with_ends(several), optical, with_ends(single)).select("map_id", "record", "status")
    later = several.drop("type").join(status, ["map_id", "record"]).withColumn("type", F.when(F.col("status") == "placed", "FILTER").otherwise(F.col("status"))).drop("status")
    return single.drop("type").withColumn("type", F.lit("MATCH")).unionByName(later)


def legacy_chain(records: DataFrame, optical: DataFrame) -> dict[str, DataFrame]:
    """From placement records to scaffolds, their text, AGP rows and a summary of the run."""
    every = cut(placed_records(records, optical), "placed-records")
    placed = every.filter(F.col("type").isin("MATCH", "FILTER"))
    rows = cut(scaffolds(placed, optical), "scaffolds")
    named = rows.withColumn("object", F.concat_ws("_", "map_id", F.concat(F.lit("scaff"), "scaffold")))
    return {"records": every, "scaffolds": rows, "lines": scaffold_lines(rows), "agp": agp(named, "object"), "summary": run_summary(placed, optical)}


def tagged(matched: DataFrame, filtered: DataFrame, scheduled: DataFrame | None = None) -> DataFrame:
    """One table of placements with their ``type``: MATCH, FILTER or SCHEDULE."""
    out = matched.withColumn("type", F.lit("MATCH")).unionByName(filtered.withColumn("type", F.lit("FILTER")))
    return out if scheduled is None else out.unionByName(scheduled.withColumn("type", F.lit("SCHEDULE")))


def run_summary(placed: DataFrame, optical: DataFrame) -> DataFrame:
    """One row: placed by matching, filtering and scheduling, Mbp placed and its ratio to the map (separators left out)."""
    size = optical.filter(F.col("sd") != 0).agg(F.coalesce(F.sum("size"), F.lit(0.0)).alias("map_size")).withColumn("k", F.lit(1))
    n = lambda t: F.count_if(F.col("type") == t)
    each = placed.agg(n("MATCH").alias("matched"), n("FILTER").alias("filtered"), n("SCHEDULE").alias("scheduled"), (F.coalesce(F.sum("size"), F.lit(0)) / 1e6).alias("mbp")).withColumn("k", F.lit(1))
    return each.join(size, "k").select("matched", "filtered", "scheduled", "mbp", F.when(F.col("map_size") > 0, F.col("mbp") * 1e6 / F.col("map_size")).alias("ratio"))


def figure_layout(placed: DataFrame, optical: DataFrame, row_bp: int = 1_000_000, scale: float = 0.01) -> DataFrame:
    """(map_id, kind, label, page_row, x0, x1, y): boxes of map fragments and placed queries, in rows of ``row_bp`` bp.  Drawing them is left to other tools."""
    w = Window.partitionBy("map_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    at = optical.withColumn("bp", F.coalesce(F.sum("size").over(w), F.lit(0.0)))
    row = lambda c: F.floor(c / row_bp)
    box = lambda kind, label, a, b, lift: ["map_id", F.lit(kind).alias("kind"), label.cast("string").alias("label"), row(a).alias("page_row"), (F.pmod(a, F.lit(row_bp)) * scale).alias("x0"), ((F.pmod(a, F.lit(row_bp)) + b - a) * scale).alias("x1"), (row(a) * 3 + lift).cast("double").alias("y")]
    frags = at.select(*box("fragment", F.col("place"), F.col("bp"), F.col("bp") + F.col("size"), 0))
    starts = at.select(F.col("map_id").alias("_m"), F.col("place").alias("_p"), "bp")
    shown = placed.join(starts, (placed["map_id"] == F.col("_m")) & (placed["op_start"] == F.col("_p"))).drop("_m", "_p")
    return frags.unionByName(shown.select(*box("contig", F.col("contig_id"), F.col("bp"), F.col("bp") + F.col("size"), 1)))
