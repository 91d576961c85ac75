"""Records checked and compared by walking a schema: no field is listed by hand.

``violations`` compiles a nested schema (types, required and unknown keys, enums, patterns, bounds, lists) into one
projection over structs and arrays. ``flat`` turns a struct into comparable columns by dotted name, and ``changed`` names
the fields in which two versions of a record differ.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The kinds that a schema may state, and the Spark types that hold them.
KINDS: dict[str, tuple[type, ...]] = {
    "string": (T.StringType,),
    "integer": (T.ByteType, T.ShortType, T.IntegerType, T.LongType),
    "number": (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType),
    "boolean": (T.BooleanType,),
    "array": (T.ArrayType,),
    "object": (T.StructType, T.MapType),
}
#: Keywords that ``violations`` knows; any other is an error, so that no rule is passed over.
KEYWORDS = {"type", "enum", "pattern", "minLength", "maxLength", "minimum", "maximum", "items", "minItems", "maxItems", "uniqueItems", "required", "properties", "additionalProperties", "description"}
_BROKEN = "array<struct<path:string,message:string>>"


def _kinds(schema: dict) -> list[str]:
    kind = schema.get("type", [])
    return [kind] if isinstance(kind, str) else list(kind)


def _hit(broken: Column, path: Column, message: str) -> Column:
    """A violation where ``broken`` is true; null where it is false or null."""
    return F.when(broken, F.struct(path.alias("path"), F.lit(message).alias("message")))


def _join(path: Column, name: Column) -> Column:
    return F.when(path == "", name).otherwise(F.concat(path, F.lit("."), name))


def _scalar(value: Column, schema: dict, path: Column) -> Iterator[Column]:
    if "enum" in schema:
        allowed = [v for v in schema["enum"] if v is not None]
        yield _hit(~value.isin(*allowed), path, f"isn't one of {', '.join(map(str, allowed))}")
    if "pattern" in schema:
        yield _hit(~value.rlike(schema["pattern"]), path, f"doesn't match {schema['pattern']}")
    for word, low in (("minLength", True), ("maxLength", False)):
        if word in schema:
            size = F.length(value)
            yield _hit(size < schema[word] if low else size > schema[word], path, f"has {'fewer' if low else 'more'} than {schema[word]} characters")
    for word, low in (("minimum", True), ("maximum", False)):
        if word in schema:
            yield _hit(value < F.lit(schema[word]) if low else value > F.lit(schema[word]), path, f"is {'less' if low else 'more'} than {schema[word]}")


def _array(value: Column, kind: T.ArrayType, schema: dict, path: Column) -> tuple[list[Column], list[Column]]:
    """Violations of the list itself, and arrays of those of its items."""
    own, size = [], F.size(value)
    if "minItems" in schema:
        own.append(_hit(size < schema["minItems"], path, f"has fewer than {schema['minItems']} items"))
    if "maxItems" in schema:
        own.append(_hit(size > schema["maxItems"], path, f"has more than {schema['maxItems']} items"))
    if schema.get("uniqueItems"):
        own.append(_hit(F.size(F.array_distinct(value)) < size, path, "holds an item twice"))
    if "items" not in schema:
        return own, []
    each = F.transform(value, lambda x, i: _walk(x, kind.elementType, schema["items"], _join(path, i.cast("string")), True))
    return own, [F.flatten(each)]


def _object(value: Column, kind: T.DataType, schema: dict, path: Column) -> tuple[list[Column], list[Column]]:
    known, closed = schema.get("properties", {}), schema.get("additionalProperties") is False
    if isinstance(kind, T.MapType):
        extra = F.filter(F.map_keys(value), lambda k: ~k.isin(*known) if known else F.lit(True))
        return [], [F.transform(extra, lambda k: F.struct(_join(path, k).alias("path"), F.lit("is an unknown key").alias("message")))] if closed else []
    own, inner = [], []
    for name in schema.get("required", []):
        if name not in kind.names and "null" not in _kinds(known.get(name, {})):
            own.append(_hit(F.lit(True), _join(path, F.lit(name)), "is missing"))
    for field in kind.fields:
        at, part = _join(path, F.lit(field.name)), value.getField(field.name)
        if field.name in known:
            inner.append(_walk(part, field.dataType, known[field.name], at, field.name in schema.get("required", [])))
        elif closed:
            own.append(_hit(part.isNotNull(), at, "is an unknown key"))
    return own, inner


def _walk(value: Column, kind: T.DataType, schema: dict, path: Column, required: bool) -> Column:
    """An array of all violations of a value and what it holds."""
    strange = set(schema) - KEYWORDS
    if strange:
        raise ValueError(f"keywords that aren't known: {', '.join(sorted(strange))}")
    kinds = _kinds(schema)
    nullable = "null" in kinds or None in schema.get("enum", [])
    own, inner = [], []
    if required and not nullable:
        own.append(_hit(value.isNull(), path, "is missing"))
    wanted = [k for k in kinds if k != "null"]
    if wanted and not any(isinstance(kind, KINDS[k]) for k in wanted):
        whole = isinstance(kind, (T.FloatType, T.DoubleType, T.DecimalType)) and "integer" in wanted
        own.append(_hit(value % 1 != 0 if whole else value.isNotNull(), path, f"isn't of type {' or '.join(wanted)}"))
        if not whole:
            return F.array_compact(F.array(*own))
    own += _scalar(value, schema, path)
    if isinstance(kind, T.ArrayType):
        more, inner = _array(value, kind, schema, path)
        own += more
    elif isinstance(kind, (T.StructType, T.MapType)):
        more, inner = _object(value, kind, schema, path)
        # What a missing object holds isn't missing once more.
        own += [F.when(value.isNotNull(), c) for c in more]
        inner = [F.when(value.isNotNull(), c) for c in inner]
    first = F.array_compact(F.array(*own)) if own else F.array()
    return F.concat(first.cast(_BROKEN), *(F.coalesce(c, F.array().cast(_BROKEN)) for c in inner))


def violations(df: DataFrame, key: str, schema: dict, record: str | None = None) -> DataFrame:
    """key, path, message, text of every violation of ``schema`` by the rows of ``df``, or by their struct ``record``.

    One projection, whatever the schema's size. Paths are dotted, list items by their place. A null counts as missing, as
    structs don't tell the two apart: a required key may only be null where its type allows it. ``text`` is
    ``key: path - message``.
    """
    value = F.struct(*df.columns) if record is None else F.col(record)
    kind = T.StructType(df.schema.fields) if record is None else df.schema[record].dataType
    found = df.select(F.col(key).alias(key.split(".")[-1]), F.explode(_walk(value, kind, schema, F.lit(""), True)).alias("v"))
    name = key.split(".")[-1]
    text = F.concat(F.coalesce(F.col(name).cast("string"), F.lit("?")), F.lit(": "), F.when(F.col("path") == "", "(root)").otherwise(F.col("path")), F.lit(" - "), F.col("message"))
    return found.select(name, "v.path", "v.message").withColumn("text", text)


#: Keys that a comparison leaves out at any depth, and lists of which an empty one is no statement.
IDENTITY = ("provenance", "id", "org_id", "coords")
OPTIONAL = ("stated_places",)


def _plain(value: Column, kind: T.DataType, empty_is_null: bool) -> Column:
    """A value that compares: lists as sorted texts, maps as sorted entries."""
    if isinstance(kind, T.ArrayType):
        text = (lambda x: F.to_json(x)) if isinstance(kind.elementType, (T.StructType, T.MapType, T.ArrayType)) else (lambda x: x.cast("string"))
        out = F.array_sort(F.transform(value, lambda x: F.coalesce(text(x), F.lit("null"))))
        return F.when(F.size(out) > 0, out) if empty_is_null else out
    if isinstance(kind, T.MapType):
        return F.array_sort(F.transform(F.map_entries(value), F.to_json))
    return value


def flat(value: Column, kind: T.StructType, skip: tuple[str, ...] = IDENTITY, optional: tuple[str, ...] = OPTIONAL, prefix: str = "") -> dict[str, tuple[Column, T.DataType]]:
    """Dotted name -> (comparable value, type) of all that a struct holds, by walking its type.

    Keys named in ``skip`` are left out at any depth. Lists compare as multisets of texts; an empty list equals a missing one
    only for the dotted names in ``optional``. A missing struct is one whose fields are all missing.
    """
    out = {}
    for field in kind.fields:
        if field.name in skip:
            continue
        name, part = prefix + field.name, value.getField(field.name)
        if isinstance(field.dataType, T.StructType):
            out |= flat(part, field.dataType, skip, optional, f"{name}.")
        else:
            out[name] = (_plain(part, field.dataType, name in optional), field.dataType)
    return out


def _differ(a: tuple[Column, T.DataType] | None, b: tuple[Column, T.DataType] | None) -> Column:
    if a is None or b is None:
        return (a or b)[0].isNotNull()
    (x, p), (y, q) = a, b
    numbers = isinstance(p, T.NumericType) and isinstance(q, T.NumericType)
    nested = (T.ArrayType, T.MapType)
    if isinstance(p, nested) != isinstance(q, nested):
        # A list never equals a value that isn't one; both may be missing.
        return x.isNotNull() | y.isNotNull()
    if not isinstance(p, nested) and p != q and not numbers:
        x, y = x.cast("string"), y.cast("string")
    return ~x.eqNullSafe(y)


def changed(old: Column, old_kind: T.StructType, new: Column, new_kind: T.StructType, skip: tuple[str, ...] = IDENTITY, optional: tuple[str, ...] = OPTIONAL) -> Column:
    """The sorted dotted names of fields in which two records differ; a field that only one schema has counts as missing
    from the other. Null where either record is."""
    a, b = flat(old, old_kind, skip, optional), flat(new, new_kind, skip, optional)
    hits = [F.when(_differ(a.get(name), b.get(name)), F.lit(name)) for name in sorted({*a, *b})]
    names = F.array_compact(F.array(*hits)) if hits else F.array().cast("array<string>")
    return F.when(old.isNotNull() & new.isNotNull(), names)


def compared(old: DataFrame, new: DataFrame, key: str, **how: tuple[str, ...]) -> DataFrame:
    """key, kind (pair, added or gone) and the changed fields of two snapshots of any nested schemas; all fields that an added
    record states count as changed, and ``status`` of one that is gone."""
    a = old.select(F.col(key).alias("_key"), F.struct(*(c for c in old.columns if c != key)).alias("_old"))
    b = new.select(F.col(key).alias("_key"), F.struct(*(c for c in new.columns if c != key)).alias("_new"))
    both = a.join(b, "_key", "full_outer")
    o, n = F.col("_old"), F.col("_new")
    fields = sorted(flat(n, b.schema["_new"].dataType, **how))
    names = F.when(o.isNull(), F.array(*map(F.lit, fields))).when(n.isNull(), F.array(F.lit("status"))).otherwise(changed(o, a.schema["_old"].dataType, n, b.schema["_new"].dataType, **how))
    return both.select(F.col("_key").alias(key), F.when(o.isNull(), "added").when(n.isNull(), "gone").otherwise("pair").alias("kind"), names.alias("changed"))
