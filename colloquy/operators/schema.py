"""Checks of JSON against schemas, generated on the driver as expressions over VARIANT.

A schema is what the functions below make: object, array, scalar types, enumerations and
alternatives. A check is one expression a document: no row is multiplied, nothing leaves the JVM.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

PROBLEM = "struct<path:string,problem:string,found:string>"


@dataclass(frozen=True)
class Schema:
    """kinds: any of null, boolean, integer, number, string, array, object. options: alternatives, one of which must hold."""

    kinds: tuple[str, ...] = ()
    values: tuple[str, ...] = ()
    fields: dict[str, Schema] = field(default_factory=dict)
    closed: bool = False
    items: Schema | None = None
    options: tuple[Schema, ...] = ()


def of(*kinds: str) -> Schema:
    return Schema(kinds)


def one_of(*values: str) -> Schema:
    return Schema(("string",), values=values)


def listed(items: Schema) -> Schema:
    return Schema(("array",), items=items)


def record(**fields: Schema) -> Schema:
    """An object that has these fields, all of them and no others."""
    return Schema(("object",), fields=fields, closed=True)


TEXT, WHOLE = of("string"), of("integer")
# Fixed values of the four replies and the action list (VAL04).
STATUSES = ("decided", "pending", "parked")
SCAN = record(
    replacements=listed(record(find=TEXT, replace=TEXT, note=TEXT)),
    speakers=listed(record(label=TEXT, guess=TEXT, confidence=one_of("high", "low"), why=TEXT)),
    questions=listed(record(type=one_of("speaker", "term", "unclear", "conflict", "undecided"), key=TEXT, question=TEXT, options=listed(TEXT), best_guess=TEXT, evidence_turns=listed(WHOLE))),
)
EVIDENCE = record(
    topics=listed(record(topic_id=TEXT, label=TEXT, turns=listed(WHOLE), status=one_of(*STATUSES), status_turn=of("integer", "null"), speakers=listed(TEXT))),
    points=listed(record(turn=WHOLE, speaker=TEXT, gist=TEXT, topic_id=TEXT)),
    numbers=listed(record(turn=WHOLE, literal=TEXT, means=TEXT)),
    actions=listed(record(turn=WHOLE, what=TEXT, owner=TEXT, due=TEXT)),
    unclear=listed(record(turn=WHOLE, why=TEXT)),
)
SECTION = record(heading=TEXT, discussion=listed(record(turn=WHOLE, point=TEXT)), status=one_of(*STATUSES), basis=TEXT, quote_turns=listed(WHOLE))
OVERVIEW = record(highlights=listed(TEXT))
ACTION_ITEMS = record(
    meeting=of("object"),
    decisions=listed(record(decision=TEXT, basis=TEXT)),
    actions=listed(record(item=TEXT, responsible=TEXT, deadline=TEXT, status=TEXT)),
    risks=listed(record(risk=TEXT, source=TEXT)),
    numbers=listed(TEXT),
)


def kind(value: Column) -> Column:
    """The kind of a VARIANT; null only for SQL null."""
    t = F.schema_of_variant(value)
    starts = lambda *names: F.regexp_like(t, F.lit("^(" + "|".join(names) + ")"))
    return (
        F.when(F.is_variant_null(value), "null").when(starts("STRING"), "string").when(starts("OBJECT"), "object").when(starts("ARRAY"), "array").when(starts("BOOLEAN"), "boolean")
        .when(starts("BIGINT", "INT", "SMALLINT", "TINYINT") | F.regexp_like(t, F.lit(r"^DECIMAL\([0-9]+,0\)$")), "integer").when(value.isNotNull(), "number")
    )


def _some(*rows: Column) -> Column:
    return F.array(*rows).cast(f"array<{PROBLEM}>")


def _problem(path: Column, problem: str, found: Column) -> Column:
    return F.struct(path.alias("path"), F.lit(problem).alias("problem"), found.cast("string").alias("found"))


def _bound(value: Column, use) -> Column:
    """use(value), value being computed once: a lambda variable holds it, so nested checks don't repeat its expression."""
    return F.get(F.transform(F.array(value), lambda v: use(v)), F.lit(0))


def _walk(value: Column, schema: Schema, path: Column) -> Column:
    """The problems of a VARIANT below a path; an absent value (SQL null) has none."""
    return _bound(F.struct(value.alias("value"), kind(value).alias("kind"), path.alias("path")), lambda at: _check(at["value"], at["kind"], schema, at["path"]))


def _check(value: Column, own: Column, schema: Schema, path: Column) -> Column:
    nothing = F.array().cast(f"array<{PROBLEM}>")
    if schema.options:
        fails = [F.size(_walk(value, o, path)) > 0 for o in schema.options]
        return F.when(F.forall(F.array(*fails), lambda x: x), _some(_problem(path, "alternatives", own))).otherwise(nothing)
    found = []
    if schema.values:
        text = F.try_variant_get(value, "$", "string")
        found.append(F.when((own == "string") & ~text.isin(*schema.values), _some(_problem(path, "value", text))))
    if schema.fields:
        names = F.array(*map(F.lit, schema.fields))
        at = lambda k: F.concat(path, F.lit("."), k)

        def inside(held: Column) -> Column:
            keys = F.map_keys(held)
            parts = [F.transform(F.array_except(names, keys), lambda k: _problem(at(k), "missing", F.lit(None))).cast(f"array<{PROBLEM}>")]
            if schema.closed:
                parts.append(F.transform(F.array_except(keys, names), lambda k: _problem(at(k), "extra", F.lit(None))).cast(f"array<{PROBLEM}>"))
            return F.concat(*parts, *(_walk(F.try_element_at(held, F.lit(k)), s, at(F.lit(k))) for k, s in schema.fields.items()))

        found.append(F.when(own == "object", _bound(F.try_variant_get(value, "$", "map<string,variant>"), inside)))
    if schema.items:
        rows = F.try_variant_get(value, "$", "array<variant>")
        inner = F.transform(rows, lambda v, i: _walk(v, schema.items, F.concat(path, F.lit("["), i.cast("string"), F.lit("]"))))
        found.append(F.when(own == "array", F.flatten(inner)))
    parts = [F.coalesce(f.cast(f"array<{PROBLEM}>"), nothing) for f in found]
    whole = F.concat(*parts) if len(parts) > 1 else parts[0] if parts else nothing
    if not schema.kinds:
        return whole
    return F.when(value.isNull(), nothing).when(~own.isin(*schema.kinds), _some(_problem(path, "kind", own))).otherwise(whole)


def problems(document: Column, schema: Schema) -> Column:
    """VAL01: every (path, problem, found) of a JSON text; text that is no JSON has the problem json. Null stays null.

    problem is kind, value, missing, extra, alternatives or json.
    """
    broken = _some(_problem(F.lit("$"), "json", F.lit(None)))
    return F.when(document.isNotNull(), _bound(F.try_parse_json(document), lambda v: F.when(v.isNull(), broken).otherwise(_walk(v, schema, F.lit("$")))))


def report(findings: Column, most: int = 12) -> Column:
    """VAL03: of an array of findings (severity, ...) the counts by severity, the first ones, and how many are left out."""
    errors = F.size(F.filter(findings, lambda f: f["severity"] == "error"))
    return F.struct(errors.alias("errors"), (F.size(findings) - errors).alias("warnings"), F.slice(findings, 1, most).alias("first"), F.greatest(F.size(findings) - most, F.lit(0)).alias("others"))
