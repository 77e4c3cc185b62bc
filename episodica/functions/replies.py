"""Free-text replies of models: the JSON in them, names of stages, prompts and data URLs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from episodica.functions.arrays import let

#: Names that replies use for stages, and the stages themselves.
SYNONYMS = {"lift": "transport", "move": "transport", "moving": "transport", "carry": "transport", "open": "release", "finish": "done", "complete": "done"}
STAGES = ("reach", "grasp", "transport", "place", "release", "adjust", "done", "global")


def is_json(text: Column) -> Column:
    """Is the whole text one JSON value? Spark's own parser takes what begins with one, whatever follows.

    A second value, or an end of what is put around the text, spoils either the list or the object.
    """
    listed = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))), "$", "array<variant>")
    keyed = F.try_variant_get(F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit(',"s":1}'))), "$.s", "int")
    # What begins like no JSON is not parsed, nor a second time what has failed: each failure is an exception.
    begins = text.rlike(r'^\s*[\[{"0-9tfn-]')
    return F.coalesce(F.when(begins, F.when(F.size(listed) == 1, keyed == 1)), F.lit(False))


def json_in(text: Column) -> Column:
    """The JSON object in a reply, without code fences, from the first brace to the last; `{}` where there is none."""
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), r"```(?:json)?", "")
    found = F.regexp_extract(bare, r"(?s)\{.*\}", 0)
    return F.when(is_json(found), found).otherwise("{}")


def json_value(text: Column, lists: bool = False) -> Column:
    """The JSON of a reply: all of it without the fence around it, else from the first brace to the last, else with lists
    from the first bracket to the last; whichever is JSON first, or null."""
    return json_values(text)["any"] if lists else _bare(text, _object)


def json_values(text: Column) -> Column:
    """struct(object, any): json_value without and with lists, for those who need both; a reply is parsed once for them."""

    def both(b: Column) -> Column:
        return let(_object(b), lambda x: F.struct(x.alias("object"), F.coalesce(x, _part(b, r"(?s)\[.*\]")).alias("any")))

    return _bare(text, both)


def _bare(text: Column, body: Callable[[Column], Column]) -> Column:
    bare = F.trim(F.regexp_replace(F.regexp_replace(F.trim(F.coalesce(text, F.lit(""))), r"^```(?:json)?", ""), r"```$", ""))
    return let(F.regexp_replace(bare, r"^\s+|\s+$", ""), body)


def _part(b: Column, pattern: str) -> Column:
    """What the pattern finds, if that is JSON and not all of b, which has been tried before."""
    return let(F.regexp_extract(b, pattern, 0), lambda x: F.when((x != b) & is_json(x), x))


def _object(b: Column) -> Column:
    return F.coalesce(F.when(is_json(b), b), _part(b, r"(?s)\{.*\}"))


def stage_name(raw: Column) -> Column:
    low = F.lower(F.trim(F.coalesce(raw, F.lit(""))))
    table = F.create_map(*(F.lit(x) for pair in SYNONYMS.items() for x in pair))
    named = F.coalesce(table[low], low)
    return F.when(named.isin(*STAGES), named).otherwise("adjust")


def data_url(jpeg: Column) -> Column:
    return F.concat(F.lit("data:image/jpeg;base64,"), F.regexp_replace(F.base64(jpeg), r"\r?\n", ""))


def shaped(found: Column) -> Column:
    """Of a reply's JSON the object that holds stages: an object is itself, a list of one object with stages is that one, of
    other lists the objects are the stages. Null for what is neither, or a list that holds anything else."""

    def listed(x: Column, whole: Column) -> Column:
        objects = F.forall(F.try_variant_get(whole, "$", "array<variant>"), lambda item: F.schema_of_variant(item).startswith("OBJECT"))
        one = F.try_variant_get(whole, "$[0].stages", "variant").isNotNull() & F.try_variant_get(whole, "$[1]", "variant").isNull()
        inner = F.to_json(F.try_variant_get(whole, "$[0]", "variant"))
        return F.when(objects, F.when(one, inner).otherwise(F.concat(F.lit('{"stages":'), x, F.lit("}"))))

    kind = lambda whole: F.schema_of_variant(whole)
    return let(found, lambda x: let(F.try_parse_json(x), lambda whole: F.when(kind(whole).startswith("OBJECT"), x).when(kind(whole).startswith("ARRAY"), listed(x, whole))))


def whole_number(found: Column) -> tuple[Column, Column]:
    """(number, bad) of a variant as a time: numbers are cut to whole ones, texts may hold a whole number, all else is bad.

    A field that is not there is no number and not bad.
    """
    kind = F.schema_of_variant(found)
    text = F.trim(F.try_variant_get(found, "$", "string"))
    real = F.when(kind.rlike("^(DECIMAL|DOUBLE|FLOAT)"), F.try_variant_get(found, "$", "double").cast("long"))
    number = F.when(kind == "BIGINT", F.try_variant_get(found, "$", "long")).when(kind == "STRING", F.when(text.rlike(r"^[+-]?[0-9]+$"), text.try_cast("long"))).otherwise(real)
    return number, found.isNotNull() & number.isNull()


def selected(found: Column, state: Column) -> Column:
    """The frame that a reply chose: a number or a text that holds one, halves to even; else the state's frame."""
    said = F.try_variant_get(F.try_parse_json(found), "$.selected_frame", "string")
    return F.coalesce(F.bround(said.try_cast("double"), 0).cast("long"), state)
