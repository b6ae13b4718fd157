"""Census responses flattened to tidy tables.

A response names its dimensions and carries a flat list of observations; an observation's
position alone says which option of each dimension it belongs to (last dimension fastest).  The
position is turned into option indices by arithmetic, right after the list is exploded, so the
cube is never enumerated and nothing is shuffled afterwards.

Input: ``responses(dataset_id, geo_level, batch_no, json)``, one row per request batch.
Output rows: ``dataset_id, geo_level, pos, shape, cells, value_index, observation`` where ``cells``
is an array of (dim, label, code).  ``wide`` turns the cells into two columns per dimension.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tallyscope.operators.positions import running_offset
from tallyscope.session import pin

# Alternative key names, in order of preference.
DIMENSION_NAME_KEYS = ("dimension_name", "name", "id")
OPTION_LIST_KEYS = ("options", "items", "values")
LABEL_KEYS = ("label", "name", "value")
CODE_KEYS = ("id", "code")
GROUP = ("dataset_id", "geo_level")

_RESPONSE = "dimensions array<string>, observations array<string>, headers array<map<string,string>>, dimension_metadata array<string>"


def dataset_type(dataset_id: Column) -> Column:
    return F.when(dataset_id.startswith("TS"), "TS").when(dataset_id.startswith("RM"), "RM").otherwise("OTHER")


# --- parsing ---------------------------------------------------------------------------------


def _first_present(json: Column, keys: Sequence[str]) -> Column:
    """Value of the first key the object has, even when that value is null."""
    present = F.json_object_keys(json)
    out = F
    for key in keys:
        out = out.when(F.array_contains(present, key), F.get_json_object(json, f"$.{key}"))
    return out


def option_cell(option: Column, label_keys: Sequence[str], code_keys: Sequence[str]) -> Column:
    """(label, code) of an option given as raw JSON: an object, or plain text used for both."""
    is_object = option.startswith("{")
    return F.struct(
        F.coalesce(F.when(is_object, _first_present(option, label_keys)).otherwise(option), F.lit("")).alias("label"),
        F.coalesce(F.when(is_object, _first_present(option, code_keys)).otherwise(option), F.lit("")).alias("code"),
    )


def _dimension(raw: Column, name_keys, list_keys, cell_of) -> Column:
    options = F.from_json(_first_present(raw, list_keys), "array<string>")
    return F.struct(
        _first_present(raw, name_keys).alias("name"),
        F.transform(F.coalesce(options, F.array().cast("array<string>")), cell_of).alias("options"),
    )


def _dimensions(raw: Column, name_keys, list_keys, cell_of) -> Column:
    return F.transform(raw, lambda one: _dimension(one, name_keys, list_keys, cell_of))


def parse_dimensions(raw: Column, metadata: Column, kind: Column) -> Column:
    """Ordered ``array<struct<name, options array<struct<label, code, plain_label, plain_code>>>>``.

    Topic summaries accept alternative key names and fall back to ``dimension_metadata``; matrix
    data sets use ``dimension_name`` and ``options`` only.  Matrix cells keep a second reading that
    knows only ``label`` and ``id``, used while the cube is complete.
    """

    def cell(option: Column) -> Column:
        full = option_cell(option, LABEL_KEYS, CODE_KEYS)
        short = option_cell(option, LABEL_KEYS[:1], CODE_KEYS[:1])
        return F.struct(
            full["label"].alias("label"),
            full["code"].alias("code"),
            short["label"].alias("plain_label"),
            short["code"].alias("plain_code"),
        )

    topic = F.filter(
        _dimensions(raw, DIMENSION_NAME_KEYS, OPTION_LIST_KEYS, cell), lambda d: F.coalesce(d["name"], F.lit("")) != ""
    )
    fallback = F.filter(_dimensions(metadata, ("name",), ("values",), cell), lambda d: d["name"].isNotNull())
    matrix = F.filter(_dimensions(raw, ("dimension_name",), ("options",), cell), lambda d: d["name"].isNotNull())
    topic_or_fallback = F.when(F.coalesce(F.size(topic), F.lit(0)) > 0, topic).otherwise(fallback)
    found = F.when(kind == "RM", matrix).otherwise(topic_or_fallback)
    return F.when(F.size(found) > 0, found)


def parse_responses(responses: DataFrame) -> DataFrame:
    """Typed responses: ``dims`` (null when the response has none) and ``observations``."""
    kind = dataset_type(F.col("dataset_id"))
    doc = responses.withColumn("_doc", F.from_json("json", _RESPONSE))
    return doc.select(
        *GROUP,
        "batch_no",
        kind.alias("kind"),
        parse_dimensions(F.col("_doc.dimensions"), F.col("_doc.dimension_metadata"), kind).alias("dims"),
        F.col("_doc.observations").alias("observations"),
        F.when(kind != "RM", F.col("_doc.headers")).alias("headers"),
    )


def dimensions_table(responses: DataFrame) -> DataFrame:
    """One row per dimension option: position, name, label and code."""
    dims = parse_responses(responses).select(*GROUP, "batch_no", "kind", F.posexplode("dims").alias("dim_no", "dim"))
    options = dims.select(
        *GROUP, "batch_no", "kind", F.col("dim_no").cast("bigint").alias("dim_no"), F.col("dim.name").alias("dim"),
        F.posexplode_outer("dim.options").alias("option_no", "option"),
    )
    return options.select(
        *GROUP, "batch_no", "kind", "dim_no", "dim", F.col("option_no").cast("bigint").alias("option_no"),
        F.col("option.label").alias("label"), F.col("option.code").alias("code"),
    )


def observations(responses: DataFrame) -> DataFrame:
    """Observations with their position inside the response; empty lists give no rows."""
    lists = responses.select(
        *GROUP, "batch_no", F.from_json("json", "observations array<string>")["observations"].alias("_list")
    )
    return lists.select(*GROUP, "batch_no", F.posexplode("_list").alias("pos", "observation")).withColumn(
        "pos", F.col("pos").cast("bigint")
    )


# --- batches ---------------------------------------------------------------------------------


def batch_heads(responses: DataFrame) -> DataFrame:
    """One small row per batch: how many observations, which dimensions and headers.

    Pinned, because offsets, totals and layouts all come from it: the documents are parsed once
    here and once more for the observations themselves.
    """
    parsed = parse_responses(responses)
    size = F.greatest(F.coalesce(F.size("observations"), F.lit(0)), F.lit(0)).cast("bigint")
    return pin(parsed.select(*GROUP, "batch_no", "kind", "dims", "headers", size.alias("n")))


def _same(left: str, right: str, keys: Sequence[str]) -> Column:
    """Null-safe equality of the keys of two aliased tables."""
    out = F.lit(True)
    for key in keys:
        out = out & F.col(f"{left}.{key}").eqNullSafe(F.col(f"{right}.{key}"))
    return out


def batch_offsets(heads: DataFrame) -> DataFrame:
    """Start position ``offset`` and size ``n`` of every batch that has observations, in batch order; a
    null number comes first.

    A batch number that occurs twice in a data set and level is an error: it cannot be told which of
    the two responses counts."""
    key = [*GROUP, "batch_no"]
    name = F.concat_ws(" / ", *[F.coalesce(F.col(k).cast("string"), F.lit("(null)")) for k in key])
    repeated = F.raise_error(F.concat(F.lit("repeated batch: "), name)).cast("bigint")
    single = heads.filter("n > 0").groupBy(*key).agg(F.sum("n").alias("_n"), F.count(F.lit(1)).alias("_times"))
    sized = single.select(*key, F.when(F.col("_times") > 1, repeated).otherwise(F.col("_n")).alias("n"))
    return running_offset(sized, "n", "batch_no", GROUP)


def combined_groups(heads: DataFrame) -> DataFrame:
    """One row per data set and level: total size, and dimensions and headers of the first batch
    that has any (a null batch number comes first).  Failed batches (no document) count as empty."""
    has_dims, has_headers = F.col("dims").isNotNull(), F.col("headers").isNotNull()
    return heads.groupBy(*GROUP, "kind").agg(
        F.sum("n").alias("n_total"),
        F.min_by("dims", F.when(has_dims, F.struct("batch_no"))).alias("dims"),
        F.min_by("headers", F.when(has_headers, F.struct("batch_no"))).alias("headers"),
    )


def _lists(responses: DataFrame) -> DataFrame:
    doc = F.from_json("json", "observations array<string>")
    return responses.select(*GROUP, "batch_no", doc["observations"].alias("observations"))


def combine_batches(responses: DataFrame) -> DataFrame:
    """Observations of all batches with their position in the combined list, in batch order."""
    offsets = batch_offsets(batch_heads(responses)).alias("o")
    placed = _lists(responses).alias("l").join(offsets, _same("l", "o", [*GROUP, "batch_no"]))
    listed = placed.select(*[f"l.{k}" for k in GROUP], "offset", F.posexplode("observations").alias("_i", "observation"))
    return listed.select(*GROUP, (F.col("offset") + F.col("_i")).alias("pos"), "observation")


def combined_headers(responses: DataFrame) -> DataFrame:
    """Totals, dimension names and headers of the combined response."""
    return combined_groups(batch_heads(responses)).select(
        *GROUP, "n_total", F.transform("dims", lambda d: d["name"]).alias("dims"),
        F.to_json("headers").alias("headers"),
    )


# --- flattening ------------------------------------------------------------------------------


def _count(dim: Column) -> Column:
    return F.greatest(F.size(dim["options"]), F.lit(1)).cast("bigint")


def _product(dims: Column) -> Column:
    return F.aggregate(dims, F.lit(1).cast("bigint"), lambda acc, d: acc * _count(d))


def _axes(dims: Column, plain: Column) -> Column:
    """Dimensions made ready for lookup: ``cells`` (one per option, blank if there is none), ``n``
    of them, and the ``stride``, the number of positions an option spans (last dimension: 1)."""

    def cells(d: Column) -> Column:
        named = F.transform(
            d["options"],
            lambda o: F.struct(
                d["name"].alias("dim"),
                F.when(plain, o["plain_label"]).otherwise(o["label"]).alias("label"),
                F.when(plain, o["plain_code"]).otherwise(o["code"]).alias("code"),
            ),
        )
        blank = F.struct(d["name"].alias("dim"), F.lit("").alias("label"), F.lit("").alias("code"))
        return F.when(F.size(d["options"]) > 0, named).otherwise(F.array(blank))

    return F.transform(
        dims,
        lambda d, i: F.struct(
            cells(d).alias("cells"),
            _count(d).alias("n"),
            _product(F.slice(dims, i + 2, F.size(dims))).alias("stride"),
        ),
    )


def layouts(groups: DataFrame, areas: DataFrame | None = None) -> DataFrame:
    """How each group's positions are to be read.

    ``areas(geo_level, area_no, area_code)`` lists the areas of a level, numbered from 0.  Shapes:
    ``cube`` (every cell named), ``by_area`` (more observations than named cells: the first
    dimension is counted out as areas), ``area_values``, ``rows``, and for data without dimensions
    ``values`` (topic summaries) or ``none`` (matrix).
    """
    if areas is not None:
        counted = areas.groupBy("geo_level").agg(F.count(F.lit(1)).alias("level_areas"))
        groups = groups.join(counted, "geo_level", "left")
    else:
        groups = groups.withColumn("level_areas", F.lit(None).cast("bigint"))
    dims, total, level_areas = F.col("dims"), F.col("n_total"), F.coalesce("level_areas", F.lit(0))
    rest = F.slice(dims, 2, F.greatest(F.size(dims) - 1, F.lit(0)))
    categories = F.filter(rest, lambda d: F.size(d["options"]) > 0)
    usable = (F.size(categories) > 0) & (
        F.when(F.col("kind") == "RM", F.size(dims) >= 2).otherwise(F.size(dims) == 2)
    )
    shape = (
        F.when(dims.isNull() & (F.col("kind") == "RM"), "none")
        .when(dims.isNull(), "values")
        .when(total <= _product(dims), "cube")
        .when(usable, "by_area")
        .when(level_areas > 0, "area_values")
        .otherwise("rows")
    )
    laid = groups.withColumns({"shape": shape, "_categories": categories, "_level_areas": level_areas})
    by_area, area_values = F.col("shape") == "by_area", F.col("shape") == "area_values"
    laid = laid.withColumns(
        {
            "first_dim": F.get("dims", F.lit(0))["name"],
            "axes": F.when(F.col("shape") == "cube", _axes(dims, F.col("kind") == "RM")).when(
                by_area, _axes(F.col("_categories"), F.lit(False))
            ),
            # null where an area would get no value at all
            "per_area": F.when(by_area, _product(F.col("_categories"))).when(
                area_values, F.expr("nullif(n_total div nullif(_level_areas, 0), 0)")
            ),
        }
    )
    whole_areas = F.when(by_area, F.expr("n_total div per_area * per_area")).when(
        area_values, F.coalesce(F.col("_level_areas") * F.col("per_area"), F.lit(0))
    )
    return laid.select(
        *GROUP, "kind", "shape", "first_dim", "axes", "per_area", F.coalesce(whole_areas, total).alias("keep")
    )


def _areas_met(start: Column, stop: Column) -> Column:
    """Numbers of the areas whose values lie between two positions."""
    size = F.col("per_area")
    return F.sequence(F.call_function("div", start, size), F.call_function("div", stop - 1, size))


def _area_codes(batches: DataFrame, areas: DataFrame) -> DataFrame:
    """``_codes`` of the areas that a batch meets, in order: null where the level's list has no such area.

    Only (batch, area number) rows meet the list, which may be of any size; neither observations nor
    dimensions go through that join.  A batch meets at most as many areas as it has observations."""
    key = [*GROUP, "batch_no"]
    met = batches.filter("per_area IS NOT NULL").select(*key, F.explode(_areas_met(F.col("offset"), F.least(F.col("offset") + F.col("n"), "keep"))).alias("area_no"))
    named = met.join(areas.select("geo_level", "area_no", "area_code"), ["geo_level", "area_no"], "left")
    listed = F.sort_array(F.collect_list(F.struct("area_no", "area_code")))
    return named.groupBy(*key).agg(F.transform(listed, lambda a: a["area_code"]).alias("_codes"))


def _pieces() -> Column:
    """A batch cut at area borders, or whole: array of (area_no, area_code, start, part)."""
    start, values = F.col("offset"), F.col("observations")
    stop = F.least(start + F.size(values), F.col("keep"))

    def piece(area: Column, code: Column, low: Column, high: Column) -> Column:
        part = F.slice(values, (low - start + 1).cast("int"), (high - low).cast("int"))
        return F.struct(area.cast("bigint").alias("area_no"), code.alias("area_code"), low.alias("start"), part.alias("part"))

    size = F.col("per_area")
    cut = F.transform(
        _areas_met(start, stop),
        lambda a, i: piece(a, F.get("_codes", i), F.greatest(a * size, start), F.least((a + 1) * size, stop)),
    )
    whole = piece(F.lit(None), F.lit(None).cast("string"), start, stop)
    return F.when(size.isNotNull(), cut).otherwise(F.array(whole))


def _area_cells() -> Column:
    """The made-up cell of an unnamed area (the real code where the level's list has one), or none."""
    number = F.col("area_no") + 1
    cell = F.struct(
        F.when(F.col("shape") == "by_area", F.col("first_dim")).otherwise(F.col("geo_level")).alias("dim"),
        F.concat(F.lit("Area "), number.cast("string")).alias("label"),
        F.coalesce("area_code", F.format_string("AREA%06d", number)).alias("code"),
    )
    none = F.array().cast("array<struct<dim:string,label:string,code:string>>")
    return F.when(F.col("area_no").isNotNull(), F.array(cell)).otherwise(none)


def flatten(responses: DataFrame, areas: DataFrame | None = None) -> DataFrame:
    """All observations as rows with their cells; see the module text for the columns.

    ``areas`` meets one row per batch and area, so the list of areas may be of any size, and the
    documents are joined once, to one row per batch.  Whatever does not depend on the single observation is settled before the lists
    are exploded; what remains per row is an index into each axis, in generated code.
    """
    heads = batch_heads(responses)
    most = heads.agg(F.max(F.size("dims"))).first()[0] or 0  # how many columns the lookup needs
    laid = layouts(combined_groups(heads), areas).filter(F.col("shape") != "none").alias("g")
    # joined by batch; whether the plan is sent to every executor is left to Spark's size check
    offsets = batch_offsets(heads)
    key = [*GROUP, "batch_no"]
    plan = offsets.alias("o").join(laid, _same("o", "g", GROUP)).filter(F.col("offset") < F.col("keep"))
    plan = plan.select("o.*", *[c for c in laid.columns if c not in GROUP]).alias("p")
    if areas is not None:
        codes = _area_codes(plan.select(*key, "offset", "n", "per_area", "keep"), areas).alias("c")
        plan = plan.join(codes, _same("p", "c", key), "left").select("p.*", "_codes").alias("p")
    else:
        plan = plan.withColumn("_codes", F.array().cast("array<string>")).alias("p")
    pieces = (
        _lists(responses)
        .alias("l")
        .join(plan, _same("l", "p", key))
        .select(*[f"l.{k}" for k in GROUP], "shape", "first_dim", "axes", "per_area", F.inline(_pieces()))
    )

    within = F.col("start") - F.coalesce(F.col("area_no") * F.col("per_area"), F.lit(0))
    axes = range(max(most, 1))
    ready = pieces.select(
        *GROUP,
        "shape",
        "start",
        "part",
        within.alias("_base"),
        F.when(F.col("shape").isin("area_values", "rows"), within).alias("_index"),
        _area_cells().alias("_area"),
        F.coalesce(F.size("axes"), F.lit(0)).alias("_axes"),
        *[F.get("axes", F.lit(i))[field].alias(f"_{field}{i}") for i in axes for field in ("cells", "n", "stride")],
    )
    place = F.col("_base") + F.col("_i")
    looked_up = [
        F.get(f"_cells{i}", (F.call_function("div", place, F.col(f"_stride{i}")) % F.col(f"_n{i}")).cast("int"))
        for i in axes
    ]
    cells = F.concat("_area", F.slice(F.array(*looked_up), F.lit(1), F.greatest("_axes", F.lit(0))))
    return ready.select("*", F.posexplode("part").alias("_i", "observation")).select(
        *GROUP,
        "shape",
        (F.col("start") + F.col("_i")).alias("pos"),
        cells.alias("cells"),
        (F.col("_index") + F.col("_i")).alias("value_index"),
        "observation",
    )


def cell_names(responses: DataFrame, areas: DataFrame | None = None) -> list[str]:
    """Names that the cells of ``flatten(responses, areas)`` have, for ``wide``: read from one row per
    group, so no observation is looked at.  Bounded by the names of dimensions and levels."""
    laid = layouts(combined_groups(batch_heads(responses)), areas).filter((F.col("shape") != "none") & (F.col("keep") > 0))
    area = F.when(F.col("shape") == "by_area", F.col("first_dim")).when(F.col("shape") == "area_values", F.col("geo_level"))
    counted_out = F.when(F.col("shape").isin("by_area", "area_values"), F.array(area)).otherwise(F.array().cast("array<string>"))
    of_axes = F.transform("axes", lambda axis: F.get(axis["cells"], F.lit(0))["dim"])
    names = F.concat(counted_out, F.coalesce(of_axes, F.array().cast("array<string>")))
    return [row["dim"] for row in laid.select(F.explode(names).alias("dim")).distinct().orderBy("dim").collect()]


def wide(flat: DataFrame, dims: Sequence[str]) -> DataFrame:
    """Two columns per dimension (label and code), then the observation; blanks where absent."""

    def of(dim: str, field: str) -> Column:
        found = F.get(F.filter("cells", lambda c: c["dim"] == dim), F.lit(0))
        return F.coalesce(found[field], F.lit(""))

    columns = [
        column
        for dim in dims
        for column in (of(dim, "label").alias(dim), of(dim, "code").alias(f"{dim}_code"))
    ]
    return flat.select(*GROUP, "pos", *columns, "observation")


def zip_columns(responses: DataFrame) -> DataFrame:
    """Topic summaries without dimensions that carry ready columns: zipped to the shortest list.

    Missing codes are blank; ``observation`` defaults to the response's observations.
    """
    fields = ("ctry", "ctry_code", "religion_tb", "religion_tb_code", "observation", "observations")
    doc = responses.withColumn("_doc", F.from_json("json", ", ".join(f"{f} array<string>" for f in fields)))
    lists = doc.select(
        *GROUP,
        *[F.col(f"_doc.{f}").alias(f) for f in fields[:4]],
        F.coalesce("_doc.observation", "_doc.observations").alias("observation"),
    ).filter(F.col("ctry").isNotNull() & F.col("religion_tb").isNotNull() & F.col("observation").isNotNull())
    shortest = F.least(F.size("ctry"), F.size("religion_tb"), F.size("observation"))
    rows = F.filter(
        F.transform(
            "observation",
            lambda value, i: F.struct(
                i.cast("bigint").alias("pos"),
                *[F.coalesce(F.get(F.col(f), i), F.lit("")).alias(f) for f in fields[:4]],
                value.alias("observation"),
            ),
        ),
        lambda row: row["pos"] < shortest,
    )
    return lists.select(*GROUP, F.inline(rows))
