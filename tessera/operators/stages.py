"""Pipeline stages: each turns a DataFrame into another. Nothing here runs a job, except where a stage's text says so."""

from __future__ import annotations

from collections.abc import Callable
from typing import TYPE_CHECKING, Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.expressions import compile_expression, truth, typed
from tessera.functions.scope import Scope, Unsupported, quoted
from tessera.operators.collation import Collation
from tessera.operators.predicates import Compiler

if TYPE_CHECKING:
    from tessera.plans.pipeline import Context

Stage = Callable[[DataFrame, Any, "Context"], DataFrame]
STAGES: dict[str, Stage] = {}


def stage(*names: str):
    def register(f: Stage) -> Stage:
        for name in names:
            STAGES[name] = f
        return f

    return register


@stage("$match")
def match(df: DataFrame, spec: dict, ctx: Context) -> DataFrame:
    compiler = Compiler(Scope(df.schema), ctx.collation, ctx.text_fields)
    out = df.where(compiler.query(spec))
    return out.orderBy(*near_order(out, compiler.order)) if compiler.order else out


def near_order(df: DataFrame, distances: list[Column]) -> list[Column]:
    """The order of near queries: rows as far away as each other follow their _id, else all columns that can be sorted by, so that a limit keeps the same rows in every run."""
    fields = [f for f in df.schema.fields if _sortable(f.dataType, True)]
    fields = [f for f in fields if f.name == "_id"] or fields
    ties = [variant_key(F.col(quoted(f.name))) if isinstance(f.dataType, T.VariantType) else F.col(quoted(f.name)) for f in fields]
    return [*distances, *(c.asc_nulls_first() for c in ties)]


def _sortable(kind: T.DataType, top: bool = False) -> bool:
    """Whether a column of the type can be sorted by; a variant only by its key."""
    if isinstance(kind, T.ArrayType):
        return _sortable(kind.elementType)
    if isinstance(kind, T.StructType):
        return all(_sortable(f.dataType) for f in kind.fields)
    return not isinstance(kind, T.MapType) and (top or not isinstance(kind, T.VariantType))


def _tree(spec: dict) -> dict:
    """Dotted names as nested documents."""
    out: dict = {}
    for name, value in spec.items():
        at = out
        *heads, last = name.split(".")
        for head in heads:
            at = at.setdefault(head, {})
        at[last] = _tree(value) if isinstance(value, dict) and not any(k.startswith("$") for k in value) and value else value
    return out


def _included(value: Any) -> bool:
    return isinstance(value, bool | int | float) and bool(value)


def _excluded(value: Any) -> bool:
    return isinstance(value, bool | int | float) and not value


def _without(column: Column, kind: T.DataType, tree: dict) -> Column | None:
    """A nested column without the fields that the tree excludes."""
    if isinstance(kind, T.ArrayType):
        return F.transform(column, lambda x: _without(x, kind.elementType, tree))
    if not isinstance(kind, T.StructType):
        return column
    kept = []
    for f in kind.fields:
        below = tree.get(f.name, 1)
        if _excluded(below):
            continue
        x = column.getField(f.name)
        kept.append((_without(x, f.dataType, below) if isinstance(below, dict) else x).alias(f.name))
    return F.when(column.isNotNull(), F.struct(*kept)) if kept else F.lit(None)


def _only(column: Column, kind: T.DataType, tree: dict, scope: Scope) -> Column:
    """A nested column of the fields that the tree includes or computes."""
    if isinstance(kind, T.ArrayType):
        return F.transform(column, lambda x: _only(x, kind.elementType, tree, scope))
    names = kind.names if isinstance(kind, T.StructType) else []
    kept = []
    for name, value in tree.items():
        if _included(value):
            if name in names:
                kept.append(column.getField(name).alias(name))
        elif isinstance(value, dict) and not any(k.startswith("$") for k in value):
            if name in names:
                kept.append(_only(column.getField(name), kind[name].dataType, value, scope).alias(name))
            else:
                kept.append(compile_expression(value, scope).alias(name))
        else:
            kept.append(compile_expression(value, scope).alias(name))
    built = F.struct(*kept) if kept else F.lit(None)
    return F.when(column.isNotNull(), built) if names else built


@stage("$project")
def project(df: DataFrame, spec: dict, ctx: Context) -> DataFrame:
    scope, tree = Scope(df.schema), _tree(spec)
    plain = {k: v for k, v in tree.items() if k != "_id" or not _excluded(v)}

    def excludes(value: Any) -> bool:
        return _excluded(value) or isinstance(value, dict) and bool(value) and not any(k.startswith("$") for k in value) and all(map(excludes, value.values()))

    if all(map(excludes, plain.values())) and not any(map(_included, tree.values())):
        out = []
        for f in df.schema.fields:
            below = tree.get(f.name, 1)
            if _excluded(below):
                continue
            column = F.col(quoted(f.name))
            out.append((_without(column, f.dataType, below) if isinstance(below, dict) else column).alias(f.name))
        return df.select(*out)
    out = [] if "_id" not in df.columns or "_id" in tree else [F.col("_id")]
    for name, value in plain.items():
        if _included(value):
            if name in df.columns:
                out.append(F.col(quoted(name)))
        elif isinstance(value, dict) and not any(k.startswith("$") for k in value) and name in df.columns:
            out.append(_only(F.col(quoted(name)), df.schema[name].dataType, value, scope).alias(name))
        elif isinstance(value, dict) and "$slice" in value and not isinstance(value["$slice"], list):
            out.append(compile_expression({"$slice": ["$" + name, value["$slice"]]}, scope).alias(name))
        else:
            out.append(compile_expression(value, scope).alias(name))
    return df.select(*out)


@stage("$addFields", "$set")
def add_fields(df: DataFrame, spec: dict, ctx: Context) -> DataFrame:
    scope, columns = Scope(df.schema), {}
    for name, value in spec.items():
        head, *rest = name.split(".") if name not in df.columns else [name]
        base = columns.get(head, F.col(quoted(head)) if head in df.columns else None)
        columns[head] = put(base, df.schema[head].dataType if head in df.columns else None, rest, compile_expression(value, scope))
    return df.withColumns(columns)


def put(base: Column | None, kind: T.DataType | None, path: list[str], value: Column) -> Column:
    """A column with the value at a path below it; documents on the way are made where there are none."""
    if not path:
        return value
    if base is not None and isinstance(kind, T.ArrayType):
        return F.transform(base, lambda x: put(x, kind.elementType, path, value))
    if base is not None and isinstance(kind, T.StructType):
        name, *rest = path
        inner = put(base.getField(name) if name in kind.names else None, kind[name].dataType if name in kind.names else None, rest, value)
        fields = [(inner if f.name == name else base.getField(f.name)).alias(f.name) for f in kind.fields]
        return F.struct(*fields, *([] if name in kind.names else [inner.alias(name)]))
    return F.struct(put(None, None, path[1:], value).alias(path[0]))


@stage("$unset")
def unset(df: DataFrame, spec: Any, ctx: Context) -> DataFrame:
    return project(df, dict.fromkeys(spec if isinstance(spec, list) else [spec], 0), ctx)


@stage("$replaceWith")
def replace_with(df: DataFrame, spec: Any, ctx: Context) -> DataFrame:
    return df.select(compile_expression(spec, Scope(df.schema)).alias("_root")).select("_root.*")


@stage("$replaceRoot")
def replace_root(df: DataFrame, spec: dict, ctx: Context) -> DataFrame:
    """An extension: the older spelling of $replaceWith."""
    return replace_with(df, spec["newRoot"], ctx)


@stage("$unwind")
def unwind(df: DataFrame, spec: Any, ctx: Context) -> DataFrame:
    """A row for each element. By default rows without elements go; a value that is no array is its own only element."""
    options = {"path": spec} if isinstance(spec, str) else spec
    name = options["path"].removeprefix("$")
    column, kind = Scope(df.schema).path(name)
    array = column if isinstance(kind, T.ArrayType) else F.when(column.isNotNull(), F.array(column))
    keep, index = options.get("preserveNullAndEmptyArrays", False), options.get("includeArrayIndex")
    rest = [c for c in df.columns if c not in (name, index)]
    if "." in name:
        flat = df.select("*", (F.explode_outer if keep else F.explode)(array).alias("_element"))
        return add_fields(flat, {name: F.col("_element")}, ctx).drop("_element")
    if index:
        out = df.select(*map(quoted, rest), (F.posexplode_outer if keep else F.posexplode)(array).alias(index, name))
        return out.withColumn(index, F.col(quoted(index)).cast("long"))
    return df.select(*map(quoted, rest), (F.explode_outer if keep else F.explode)(array).alias(name)).select(*map(quoted, df.columns))


def accumulator(spec: dict, scope: Scope) -> Column:
    """One accumulator of a group. Besides $sum and $count these are extensions."""
    (name, value), *more = spec.items()
    if more:
        raise ValueError("an accumulator has one operator")
    if name == "$count":
        return F.count(F.lit(1))
    column, kind = typed(value, scope)
    if name == "$sum":
        if isinstance(kind, T.DataType) and not isinstance(kind, T.NumericType):
            return F.count(F.lit(None))  # what is no number adds nothing
        return F.coalesce(F.sum(column), F.lit(0))
    simple = {"$avg": F.avg, "$min": F.min, "$max": F.max, "$first": F.first, "$last": F.last, "$push": F.collect_list, "$addToSet": F.collect_set, "$stdDevPop": F.stddev_pop, "$stdDevSamp": F.stddev_samp}
    if name not in simple:
        raise Unsupported(f"accumulator {name}")
    return simple[name](column)


@stage("$group")
def group(df: DataFrame, spec: dict, ctx: Context) -> DataFrame:
    """A row for each key, null included; no key is one group, and none for no rows."""
    scope = Scope(df.schema)
    values = [accumulator(v, scope).alias(k) for k, v in spec.items() if k != "_id"]
    if spec["_id"] is None:
        out = df.agg(F.count(F.lit(1)).alias("_rows"), *values).where("_rows > 0")
        return out.select(F.lit(None).alias("_id"), *(F.col(quoted(k)) for k in spec if k != "_id"))
    key, kind = typed(spec["_id"], scope)
    if isinstance(spec["_id"], dict) and not any(k.startswith("$") for k in spec["_id"]):  # plain columns group in generated code
        names = {f"_k{i}": k for i, k in enumerate(spec["_id"])}
        keyed = df.groupBy(*(compile_expression(spec["_id"][k], scope).alias(n) for n, k in names.items())).agg(*values)
        return keyed.select(F.struct(*(F.col(n).alias(k) for n, k in names.items())).alias("_id"), *(F.col(quoted(k)) for k in spec if k != "_id"))
    if isinstance(kind, T.VariantType):
        first = F.first(key).alias("_id")
        return df.groupBy(variant_key(key).alias("_k")).agg(first, *values).drop("_k")
    if ctx.collation and isinstance(kind, T.StringType):
        out = df.groupBy(ctx.collation.key(key).alias("_k")).agg(F.min(key).alias("_id"), *values)
        return out.drop("_k")
    if not values:
        return df.select(key.alias("_id")).distinct()
    return df.groupBy(key.alias("_id")).agg(*values)


def variant_key(column: Column) -> Column:
    """What a variant groups and sorts by: the rank of its type, then its number or text."""
    schema = F.schema_of_variant(column)
    rank = F.when(schema == "VOID", 1).when(schema.startswith("BIGINT") | schema.startswith("D"), 2).when(schema == "STRING", 3).when(schema.startswith("OBJECT"), 4).when(schema.startswith("ARRAY"), 5).when(schema == "BOOLEAN", 8).otherwise(9)
    number = F.when(rank == 2, F.try_variant_get(column, "$", "double"))
    text = F.when(rank > 2, F.coalesce(F.try_variant_get(column, "$", "string"), F.to_json(column)))
    return F.struct(rank.alias("rank"), number.alias("number"), text.alias("text"))


def order_of(df: DataFrame, spec: dict, collation: Collation | None) -> list[Column]:
    """Ascending or descending columns; null is lowest."""
    scope, out = Scope(df.schema), []
    for path, way in spec.items():
        if path == "$natural":
            from tessera.plans.cursor import natural_place

            column = natural_place(df)
        else:
            column, kind = scope.path(path)
            if isinstance(kind, T.ArrayType):  # convention: an array sorts by its least or greatest element
                column = F.array_min(column) if way > 0 else F.array_max(column)
            elif isinstance(kind, T.VariantType):
                column = variant_key(column)
            elif collation and isinstance(kind, T.StringType):
                column = collation.key(column)
        out.append(column.asc_nulls_first() if way > 0 else column.desc_nulls_last())
    return out


@stage("$sort")
def sort(df: DataFrame, spec: dict, ctx: Context) -> DataFrame:
    return df.orderBy(*order_of(df, spec, ctx.collation))


@stage("$limit")
def limit(df: DataFrame, spec: int, ctx: Context) -> DataFrame:
    return df.limit(abs(int(spec))) if spec else df


@stage("$skip")
def skip(df: DataFrame, spec: int, ctx: Context) -> DataFrame:
    return df.offset(int(spec))


@stage("$count")
def count(df: DataFrame, spec: str, ctx: Context) -> DataFrame:
    """One row with the number of rows; none for no rows."""
    return df.agg(F.count(F.lit(1)).alias(spec)).where(F.col(quoted(spec)) > 0)


@stage("$sortByCount")
def sort_by_count(df: DataFrame, spec: Any, ctx: Context) -> DataFrame:
    return group(df, {"_id": spec, "count": {"$sum": 1}}, ctx).orderBy(F.desc("count"))


def used_below(name: str, stages: list[dict]) -> set[str] | None:
    """The fields of documents in ``name`` that the stages up to the first projection read; None where they may read all.

    Gathering only these keeps a lookup's shuffle and its arrays small; the optimizer does not look into gathered documents.
    """
    used: set[str] = set()

    def names(value: Any) -> bool:
        """Note the fields that a value names; False if it names the whole."""
        if isinstance(value, str):
            if value.startswith("$$ROOT") or value.startswith("$$CURRENT") or value == "$" + name:
                return False
            if value.startswith(f"${name}."):
                used.add(value.split(".")[1])
            return True
        if isinstance(value, dict):
            if list(value) == ["$size"] and value["$size"] == "$" + name:
                return True
            return all(k != name and names(v) and (not k.startswith(name + ".") or used.add(k.split(".")[1]) is None) for k, v in value.items())
        return all(map(names, value)) if isinstance(value, list) else True

    for document in stages:
        (kind, spec), = document.items()
        if kind == "$project" and name not in spec and any(_included(v) or not _excluded(v) for v in spec.values()):
            return used if names(spec) else None
        if kind == "$unwind":
            path = spec if isinstance(spec, str) else spec["path"]
            if path != "$" + name and not names(path):
                return None
        elif kind not in ("$match", "$addFields", "$set", "$sort", "$limit", "$skip") or not names(spec):
            return None
    return None


@stage("$lookup")
def lookup(df: DataFrame, spec: dict, ctx: Context) -> DataFrame:
    """Matches of another collection as an array, empty where there are none.

    The other side is gathered by key before the join, so the join is on equal keys and adds no rows; Spark chooses its kind
    from sizes at run time. Null joins null (convention).
    """
    if "pipeline" in spec or "let" in spec:
        return _lookup_pipeline(df, spec, ctx)
    other = ctx.collection(spec["from"])
    foreign, _ = Scope(other.schema).path(spec["foreignField"])
    local, local_kind = Scope(df.schema).path(spec["localField"])
    used = used_below(spec["as"], ctx.following)
    columns = [c for c in other.columns if used is None or c in used] or other.columns[:1]
    gathered = other.groupBy(foreign.alias("_key")).agg(F.collect_list(F.struct(*(F.col(quoted(c)) for c in columns))).alias("_found"))
    empty = F.array().cast(gathered.schema["_found"].dataType)
    name = spec["as"]
    rest = [F.col(quoted(c)) for c in df.columns if c != name]
    if isinstance(local_kind, T.ArrayType):
        numbered = df.withColumn("_row", F.monotonically_increasing_id())
        pairs = numbered.select("_row", F.explode(F.array_distinct(local)).alias("_key")).join(gathered, "_key")
        found = pairs.groupBy("_row").agg(F.flatten(F.collect_list("_found")).alias("_found"))
        joined = numbered.join(found, "_row", "left")
    else:
        joined = df.withColumn("_local", local).join(gathered, F.col("_local").eqNullSafe(F.col("_key")), "left")
    return joined.select(*rest, F.coalesce("_found", empty).alias(name))


def _variables(value: Any) -> set[str]:
    """The variables that an expression names."""
    if isinstance(value, str):
        return {value[2:].split(".")[0]} if value.startswith("$$") else set()
    parts = value.values() if isinstance(value, dict) else value if isinstance(value, list) else ()
    return set().union(*map(_variables, parts))


def _conjuncts(value: Any) -> list:
    if isinstance(value, dict) and list(value) == ["$and"]:
        return [c for part in value["$and"] for c in _conjuncts(part)]
    return [value]


def _per_key(other: DataFrame, keys: list[str], pipeline: list[dict], ctx: Context) -> DataFrame:
    """Stages that hold for each key by itself, with ``_place``, the order of a key's rows."""
    from pyspark.sql import Window as W

    placed = False
    for document in pipeline:
        (name, value), = document.items()
        if name in ("$match", "$addFields", "$set", "$unset", "$unwind"):
            other = STAGES[name](other, value, ctx)
        elif name == "$project":
            out = project(other, value, ctx)
            kept = [k for k in [*keys, *(["_place"] if placed else [])] if k not in out.columns]
            other = project(other, {**value, **dict.fromkeys(kept, 1)}, ctx) if kept else out
        elif name in ("$sort", "$limit"):
            order = order_of(other, value, ctx.collation) if name == "$sort" else [F.col("_place")] if placed else [F.lit(0)]
            other = other.withColumn("_place", F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
            other, placed = (other if name == "$sort" else other.where(F.col("_place") <= int(value))), True
        elif name == "$count":
            other = other.groupBy(*keys).agg(F.count(F.lit(1)).alias(value))
            placed = False
        elif name == "$group" and value["_id"] is None:
            scope = Scope(other.schema)
            other = other.groupBy(*keys).agg(*(accumulator(v, scope).alias(k) for k, v in value.items() if k != "_id"))
            placed = False
        else:
            raise Unsupported(f"{name} in the pipeline of a $lookup")
    return other if placed else other.withColumn("_place", F.lit(0))


def _lookup_pipeline(df: DataFrame, spec: dict, ctx: Context) -> DataFrame:
    """A lookup whose matches go through stages. Conditions ``$eq`` of a field and a variable, and the two fields if given, make an equi-join;
    other conditions with variables are tested on the joined rows. Without any equality only pipelines that leave a stated number of rows
    run, once for all documents. Stages behind the first match don't see variables.
    """
    other, stages = ctx.collection(spec["from"]), list(spec.get("pipeline", []))
    let, scope = spec.get("let", {}), Scope(df.schema)
    local = {f"_let_{k}": compile_expression(v, scope) for k, v in let.items()}
    pairs: list[tuple[Column, Column]] = []
    if "localField" in spec:
        pairs.append((scope.path(spec["localField"])[0], Scope(other.schema).path(spec["foreignField"])[0]))
    residual: list[Any] = []
    if stages and "$match" in stages[0] and "$expr" in stages[0]["$match"]:
        rest = {k: v for k, v in stages[0]["$match"].items() if k != "$expr"}
        for part in _conjuncts(stages[0]["$match"]["$expr"]):
            used = _variables(part) & set(let)
            sides = part.get("$eq") if isinstance(part, dict) else None
            by_side = [_variables(x) & set(let) for x in sides] if isinstance(sides, list) else []
            if not used:
                rest.setdefault("$and", []).append({"$expr": part})
            elif len(by_side) == 2 and not all(by_side) and not any(isinstance(x, dict) for x in sides):
                mine, theirs = (sides[0], sides[1]) if by_side[0] else (sides[1], sides[0])
                bound = scope
                for k, v in let.items():
                    bound = bound.bind(k, *typed(v, scope))
                pairs.append((compile_expression(mine, bound), compile_expression(theirs, Scope(other.schema))))
            else:
                residual.append(part)
        stages[0] = {"$match": rest} if rest else {"$match": {}}
    if any(_variables(s) & set(let) for s in stages):
        raise Unsupported("variables of a $lookup behind its first match")
    name = spec["as"]
    if not pairs:
        bounded = stages and (next(iter(stages[-1])) in ("$limit", "$count") or stages[-1].get("$group", {"_id": 0})["_id"] is None)
        if residual or not bounded:
            raise Unsupported("a $lookup without an equality whose pipeline may leave any number of rows")
        found = ctx.run(other, stages)
        gathered = found.agg(F.collect_list(F.struct(*(F.col(quoted(c)) for c in found.columns))).alias("_found"))
        return df.drop(name).crossJoin(gathered).withColumnRenamed("_found", name)  # one row
    keys = [f"_key{i}" for i in range(len(pairs))]
    theirs = other.withColumns({k: b for k, (_, b) in zip(keys, pairs, strict=True)})
    mine = df.withColumns({"_row": F.monotonically_increasing_id(), **{f"_mine{i}": a for i, (a, _) in enumerate(pairs)}, **local})
    same = [F.col(f"_mine{i}").eqNullSafe(F.col(k)) for i, k in enumerate(keys)]
    per = keys
    if residual:
        asked = mine.select("_row", *local, *(f"_mine{i}" for i in range(len(pairs))))
        theirs = asked.join(theirs, same)
        inner = Scope(other.schema)
        for k in let:
            inner = inner.bind(k, F.col(f"_let_{k}"), mine.schema[f"_let_{k}"].dataType)
        for part in residual:
            theirs = theirs.where(truth(compile_expression(part, inner)))
        theirs, per = theirs.select("_row", *(F.col(quoted(c)) for c in other.columns)), ["_row"]
    shown = _per_key(theirs, per, stages, ctx)
    columns = [c for c in shown.columns if c not in (*per, "_place")]
    gathered = shown.groupBy(*per).agg(F.sort_array(F.collect_list(F.struct("_place", F.struct(*(F.col(quoted(c)) for c in columns)).alias("_doc")))).alias("_found"))
    gathered = gathered.withColumn("_found", F.col("_found._doc"))
    joined = mine.join(gathered, "_row" if residual else same, "left")
    empty = F.array().cast(gathered.schema["_found"].dataType)
    return joined.select(*(F.col(quoted(c)) for c in df.columns if c != name), F.coalesce("_found", empty).alias(name))


@stage("$unionWith")
def union_with(df: DataFrame, spec: Any, ctx: Context) -> DataFrame:
    options = {"coll": spec} if isinstance(spec, str) else spec
    other = ctx.collection(options["coll"])
    if options.get("pipeline"):
        other = ctx.run(other, options["pipeline"])
    return df.unionByName(other, allowMissingColumns=True)


@stage("$sample")
def sample(df: DataFrame, spec: dict, ctx: Context) -> DataFrame:
    """So many random rows, exactly: a top-k by a random number, so no sort of everything."""
    return df.orderBy(F.rand(spec.get("seed"))).limit(int(spec["size"]))


def literal_rows(spark, documents: list[dict]) -> DataFrame:
    """An inline collection; documents with different fields are widened to all of them."""
    from tessera.sources.documents import frame_of

    return frame_of(spark, documents)

