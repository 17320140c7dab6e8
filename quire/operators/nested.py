"""Flattening, re-nesting and profiling of nested records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType

from quire.functions.nested import first_element, nested_transform_join, transform_join
from quire.operators.windows import global_index
from quire.runtime import discard, durable


def explode_array(df: DataFrame, col: str, alias: str) -> DataFrame:
    return df.withColumn(alias, F.explode(col))


def explode_outer_keep(df: DataFrame, col: str, alias: str) -> DataFrame:
    """One row per element; a row with a null or empty array is kept once with a null element."""
    return df.withColumn(alias, F.explode_outer(col))


def explode_multi_level(df: DataFrame, path: list[str], carry: list[str]) -> DataFrame:
    """Explode arrays inside arrays: ``path`` names the array field of each level, ``carry`` the kept columns.

    Each level becomes a struct column ``_1``, ``_2`` ...; all steps are narrow.
    """
    out = df.select(*carry, F.explode(path[0]).alias("_1"))
    for level, field in enumerate(path[1:], start=2):
        out = out.select(*carry, *[f"_{i}" for i in range(1, level)],
                         F.explode(F.col(f"_{level - 1}")[field]).alias(f"_{level}"))
    return out


def explode_cross(df: DataFrame, cols: dict[str, str], carry: list[str]) -> DataFrame:
    """Two or more arrays of one row exploded together: every combination within the row."""
    out = df.select(*carry, *cols)
    for col, alias in cols.items():
        out = out.withColumn(alias, F.explode(col))
    return out.select(*carry, *cols.values())


def posexplode_index(df: DataFrame, col: str, pos: str, alias: str, carry: list[str] | None = None) -> DataFrame:
    keep = carry if carry is not None else [c for c in df.columns if c != col]
    return df.select(*keep, F.posexplode(col).alias(pos, alias))


def struct_star(df: DataFrame, col: str, prefix: str = "") -> DataFrame:
    """Promote the fields of a struct, drop the struct."""
    fields = df.schema[col].dataType.fieldNames()
    rest = [c for c in df.columns if c != col]
    return df.select(*rest, *[F.col(col)[f].alias(prefix + f) for f in fields])


def nested_path_project(df: DataFrame, paths: dict[str, str]) -> DataFrame:
    """Nested fields picked by dotted path; Spark prunes the scan to those fields."""
    return df.select(*[F.col(p).alias(out) for out, p in paths.items()])


def concat_text_columns(df: DataFrame, cols: list[str], out: str) -> DataFrame:
    return df.withColumn(out, F.concat_ws(" ", *[F.col(c).cast("string") for c in cols]))


def works_text_flattened(works: DataFrame) -> DataFrame:
    """One text row per record: id, six plain fields and nine joined lists.

    Missing lists become '', missing plain fields stay null. A contributor without a name
    disappears; one without a role is a 'contributor'.
    """
    def contributor(c: Column) -> Column:
        role = F.coalesce(first_element(c["roles"], "label"), F.lit("contributor"))
        return F.concat(c["agent"]["label"], F.lit(" ("), role, F.lit(")"))

    return works.select(
        "id", "title", "description", "physicalDescription", "lettering", "referenceNumber", "edition",
        transform_join("contributors", fn=contributor).alias("contributor_names"),
        transform_join("alternativeTitles").alias("alternative_titles"),
        transform_join("subjects", "label").alias("subject_labels"),
        transform_join("genres", "label").alias("genre_labels"),
        transform_join("languages", "label").alias("language_labels"),
        transform_join("production", "label").alias("production_info"),
        nested_transform_join("notes", "contents").alias("note_contents"),
        F.coalesce(F.col("workType.label"), F.lit("")).alias("work_type"),
        transform_join("availabilities", "label").alias("availability_labels"))


def from_json_array(df: DataFrame, col: str, schema, pred=None, out: str = "element") -> DataFrame:
    """Parse a JSON array string, explode it, keep the elements where ``pred`` holds."""
    parsed = F.from_json(col, schema)
    return df.withColumn(out, F.explode(parsed if pred is None else F.filter(parsed, pred)))


def nested_first_resource_ids(df: DataFrame, col: str, out: str = "image_ids", canvases: str = "canvases",
                              images: str = "images", resource: str = "resource", id_field: str = "@id") -> DataFrame:
    """Ids of the first image of every canvas of the first sequence, blanks skipped."""
    pages = first_element(col, canvases)
    ids = F.transform(pages, lambda c: F.get(c[images], F.lit(0))[resource][id_field])
    kept = F.filter(ids, lambda x: x.isNotNull() & (x != ""))
    return df.withColumn(out, F.coalesce(kept, F.array().cast("array<string>")))


def _is_scalar(t: DataType) -> bool:
    return not isinstance(t, (ArrayType, StructType))


def _scalars(col: Column, t: DataType, name: str) -> list[Column]:
    if _is_scalar(t):
        return [col.alias(name)]
    if isinstance(t, StructType):
        return [c for f in t.fields for c in _scalars(col[f.name], f.dataType, f"{name}_{f.name}" if name else f.name)]
    return []


def child_table(df: DataFrame, path: str, parent_key: str = "id") -> DataFrame:
    """The child table at a nested path: parent key, position per array level, scalar columns.

    Walks the schema along ``path`` and explodes every array it meets; structs on the way or in
    the element are flattened with underscored names. Other arrays of the element are child
    tables of their own and left out.
    """
    out = df.select(F.col(parent_key).alias("parent_key"), F.col(path.split(".")[0]).alias("_x"))
    t: DataType = df.schema[path.split(".")[0]].dataType
    names = path.split(".")
    positions: list[str] = []

    def unroll(out: DataFrame, t: DataType) -> tuple[DataFrame, DataType]:
        while isinstance(t, ArrayType):
            positions.append(f"pos{len(positions)}")
            out = out.select("parent_key", *positions[:-1], F.posexplode("_x").alias(positions[-1], "_x"))
            t = t.elementType
        return out, t

    out, t = unroll(out, t)
    for name in names[1:]:
        t = t[name].dataType
        out, t = unroll(out.select("parent_key", *positions, F.col("_x")[name].alias("_x")), t)
    value = F.col("_x")
    cols = [value.alias(names[-1])] if _is_scalar(t) else _scalars(value, t, "")
    return out.select("parent_key", *positions, *cols)


def child_paths(schema: StructType) -> list[str]:
    """Every nested path that holds an array: the child tables a record type has."""
    found = []

    def walk(t: DataType, path: str) -> None:
        if isinstance(t, ArrayType):
            found.append(path)
            while isinstance(t, ArrayType):
                t = t.elementType
        if isinstance(t, StructType):
            for f in t.fields:
                walk(f.dataType, f"{path}.{f.name}" if path else f.name)

    walk(schema, "")
    return found


def partof_edges(df: DataFrame, max_depth: int, id: str = "id", col: str = "partOf") -> DataFrame:
    """(child, parent, depth) edges of a ``partOf`` chain unrolled to a fixed depth; all steps are narrow."""
    def links(child: Column, parents: Column, depth: int, t: ArrayType) -> Column:
        mine = F.transform(parents, lambda p: F.struct(
            child.alias("child"), p["id"].alias("parent"), F.lit(depth).alias("depth")))
        deeper = t.elementType
        if depth >= max_depth or col not in deeper.fieldNames():
            return mine
        below = F.flatten(F.transform(parents, lambda p: F.coalesce(
            links(p["id"], p[col], depth + 1, deeper[col].dataType),
            F.array().cast("array<struct<child:string,parent:string,depth:int>>"))))
        return F.concat(mine, below)

    return df.select(F.explode(links(F.col(id), F.col(col), 1, df.schema[col].dataType)).alias("e")).select("e.*")


def partof_closure(edges: DataFrame, child: str = "child", parent: str = "parent") -> DataFrame:
    """(child, ancestor, depth): every ancestor over any number of steps, with the fewest of them, from flat parent edges.

    Paths are doubled: a round joins the paths so far with themselves, so the rounds grow with the logarithm of the longest
    chain. A record in a loop is its own ancestor. Edges with a null end are left out, repeated ones count once. Each round
    is written, and the one before deleted.
    """
    paths = durable(edges.select(F.col(child).alias("child"), F.col(parent).alias("ancestor")).where("child is not null and ancestor is not null")
                    .distinct().withColumn("depth", F.lit(1).cast("long")), "closure")
    state = paths.agg(F.count("*"), F.sum("depth")).first()
    while True:
        further = paths.alias("a").join(paths.alias("b"), F.col("a.ancestor") == F.col("b.child")) \
            .select("a.child", "b.ancestor", (F.col("a.depth") + F.col("b.depth")).alias("depth"))
        longer = durable(paths.unionByName(further).groupBy("child", "ancestor").agg(F.min("depth").alias("depth")), "closure")
        discard(paths)
        now = longer.agg(F.count("*"), F.sum("depth")).first()
        if now == state:
            return longer
        paths, state = longer, now


def nest_children(df: DataFrame, keys: list[str], fields: list[str], order_by: list[str], out: str = "children",
                  max_items: int = 100_000, descending: bool = False) -> DataFrame:
    """Rebuild ``array<struct>`` per key from flat rows, sorted by ``order_by`` (all of them falling with ``descending``).

    The rows of a key are cut into pages of ``max_items`` in that order, numbered by ``part_no`` from 0, so no array is
    larger and together they hold every child. Keys of more than one page are ranked by a distributed sort, so that
    no task holds one of them; the others are grouped in one pass.
    """
    fields_ = F.struct(*order_by, *[f for f in fields if f not in order_by])

    def packed(rows: DataFrame) -> DataFrame:
        grouped = rows.groupBy(*keys, "part_no").agg(F.sort_array(F.collect_list(fields_), asc=not descending).alias("_a"))
        return grouped.select(*keys, "part_no", F.transform("_a", lambda x: F.struct(*[x[f].alias(f) for f in fields])).alias(out))

    large = durable(df.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > max_items).select(*keys), "large-keys")
    if large.isEmpty():
        return packed(df.withColumn("part_no", F.lit(0)))
    same = lambda a, b: [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys]
    ranked = global_index(df.alias("d").join(large.alias("l"), same("d", "l"), "left_semi"), [*keys, *[F.desc(o) if descending else F.asc(o) for o in order_by]], "_ix")
    starts = ranked.groupBy(*keys).agg(F.min("_ix").alias("_from"))
    paged = (ranked.alias("d").join(starts.alias("s"), same("d", "s")).select("d.*", "_from")
             .withColumn("part_no", F.expr(f"cast((_ix - _from) div {int(max_items)} as int)")).drop("_ix", "_from"))
    rest = df.alias("d").join(large.alias("l"), same("d", "l"), "left_anti").withColumn("part_no", F.lit(0))
    return packed(rest).unionByName(packed(paged))


def row_to_json_doc(df: DataFrame, out: str = "doc") -> DataFrame:
    return df.select(F.to_json(F.struct("*")).alias(out))


def schema_profile(df: DataFrame) -> DataFrame:
    """One row per nested path: type, rows, non-null values, largest array size.

    All paths are measured in one aggregation pass; the result has one row per path of the schema.
    """
    measures: list[tuple[str, str, Column, Column]] = []

    def walk(values: Column | None, direct: Column | None, t: DataType, path: str) -> None:
        """``direct`` is a plain column outside arrays, ``values`` an array of all values inside them."""
        if values is None:
            present = F.count_if(direct.isNotNull())
            largest = F.max(F.size(direct)) if isinstance(t, ArrayType) else F.lit(None).cast("int")
        else:
            present = F.sum(F.coalesce(F.size(F.filter(values, lambda x: x.isNotNull())), F.lit(0)))
            largest = (F.max(F.array_max(F.transform(values, F.size))) if isinstance(t, ArrayType)
                       else F.lit(None).cast("int"))
        measures.append((path, t.simpleString(), present, largest))
        if isinstance(t, StructType):
            for f in t.fields:
                name = f.name
                walk(None if values is None else F.transform(values, lambda x: x[name]),
                     None if direct is None else direct[name], f.dataType, f"{path}.{name}")
        elif isinstance(t, ArrayType):
            inner = direct if values is None else F.flatten(F.filter(values, lambda x: x.isNotNull()))
            if isinstance(t.elementType, (StructType, ArrayType)):
                _walk_element(inner, t.elementType, path)

    def _walk_element(values: Column, t: DataType, path: str) -> None:
        if isinstance(t, StructType):
            for f in t.fields:
                name = f.name
                walk(F.transform(values, lambda x: x[name]), None, f.dataType, f"{path}.{name}")
        else:
            walk(values, None, t, path + "[]")

    for f in df.schema.fields:
        walk(None, F.col(f.name), f.dataType, f.name)
    stats = df.agg(F.count("*").alias("n"), *[
        F.struct(F.coalesce(p, F.lit(0)).cast("long").alias("non_null"), m.cast("long").alias("max_size")).alias(f"m{i}")
        for i, (_, _, p, m) in enumerate(measures)])
    rows = F.array(*[F.struct(F.lit(path).alias("path"), F.lit(kind).alias("type"), F.col("n").alias("n_rows"),
                              F.col(f"m{i}.non_null").alias("non_null"), F.col(f"m{i}.max_size").alias("max_size"))
                     for i, (path, kind, _, _) in enumerate(measures)])
    return stats.select(F.explode(rows).alias("r")).select("r.*")


def drop_rename_cols(df: DataFrame, drop: list[str] = (), rename: dict[str, str] | None = None,
                     literals: dict[str, object] | None = None) -> DataFrame:
    out = df.drop(*drop).withColumnsRenamed(rename or {})
    return reduce(lambda d, kv: d.withColumn(kv[0], F.lit(kv[1])), (literals or {}).items(), out)
