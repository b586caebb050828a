"""Lines of routes.dat: the valid ones as typed routes, every other one with its reason.

Quoting is checked on the line cut at its double quotes: the pieces at even
places lie outside quotes.  Such a piece must be empty (an escaped quote) or
be bounded by the commas of the neighbouring fields.  This needs no regular
expression over the line, so lines of any length are handled in constant stack.

``src`` and ``dst`` are cast once per distinct value: the distinct values of a
column form a dictionary of typed values and reasons, which is joined back to
the lines.  The dictionary is broadcast if a count shows it to be small,
otherwise it is joined by value with hot values salted.

Defined results: a null line and an empty line have too few fields
(``columns``); repeated lines are judged each for itself; an empty table gives
two empty tables; other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from horograph.runtime import hot_keys, is_small, materialize, skew_join

FIELDS = ("airline", "airline_id", "src_iata", "src", "dst_iata", "dst", "codeshare", "stops", "equipment")
CHECKED = ("src", "dst")

# A comma inside quotes is written as the escape below while the line is split.
_ESC, _ESC_SELF, _ESC_COMMA = "\x01", "\x01a", "\x01b"


def _broken_quoting(pieces: Column) -> Column:
    n = F.size(pieces)
    outside = F.filter(
        F.transform(pieces, lambda s, i: F.struct(s.alias("s"), i.alias("i"))),
        lambda p: (p["i"] % 2 == 0)
        & (p["s"] != "")
        & (((p["i"] > 0) & ~p["s"].startswith(",")) | ((p["i"] < n - 1) & ~p["s"].endswith(","))),
    )
    return (n % 2 == 0) | (F.size(outside) > 0)


def _fields(line: Column, pieces: Column) -> Column:
    hidden = F.array_join(
        F.transform(
            pieces,
            lambda s, i: F.when(i % 2 == 1, F.replace(F.replace(s, F.lit(_ESC), F.lit(_ESC_SELF)), F.lit(","), F.lit(_ESC_COMMA))).otherwise(
                F.replace(s, F.lit(_ESC), F.lit(_ESC_SELF))
            ),
        ),
        '"',
    )

    def plain(f: Column) -> Column:
        bare = F.when(f.startswith('"'), F.replace(F.substr(f, F.lit(2), F.length(f) - 2), F.lit('""'), F.lit('"'))).otherwise(f)
        return F.replace(F.replace(bare, F.lit(_ESC_COMMA), F.lit(",")), F.lit(_ESC_SELF), F.lit(_ESC))

    return F.when(line.contains('"'), F.transform(F.split(hidden, ","), plain)).otherwise(F.split(line, ","))


def split_lines(df: DataFrame, id_col: str = "line_id", line_col: str = "raw_line", n_fields: int = len(FIELDS)) -> DataFrame:
    """(id, fields, structure): ``structure`` is ``quoting``, ``columns`` or null; ``fields`` is null where it is not."""
    line = F.regexp_replace(F.coalesce(F.col(line_col), F.lit("")), r"\r\z", "")
    cut = df.select(F.col(id_col).alias("id"), line.alias("line")).withColumn("pieces", F.split("line", '"'))
    quoting = F.col("line").contains('"') & _broken_quoting(F.col("pieces"))
    fields = cut.select("id", F.when(~quoting, _fields(F.col("line"), F.col("pieces"))).alias("fields"))
    structure = F.when(F.col("fields").isNull(), "quoting").when(F.size("fields") != n_fields, "columns")
    return fields.select("id", structure.alias("structure"), F.when(F.size("fields") == n_fields, F.col("fields")).alias("fields"))


def value_dictionary(lines: DataFrame) -> DataFrame:
    """Each distinct value of a checked column, cast once: (field, value, n, typed, fault)."""
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.trim(F.col("fields")[FIELDS.index(c)]).alias("value")) for c in CHECKED]))
    distinct = lines.where(F.col("structure").isNull()).select(cells.alias("c")).groupBy("c.field", "c.value").agg(F.count(F.lit(1)).alias("n"))
    digits = F.col("value").rlike(r"\A[0-9]{1,6}\z")
    typed = F.when(digits, F.col("value").cast("bigint"))
    fault = (
        F.when(F.col("value") == r"\N", F.lit(None))
        .when(F.col("value") == "", "blank")
        .when(F.col("value").rlike(r"\A[0-9]{7,}\z"), "more than six digits")
        .when(~digits, "not digits")
        .when(typed <= 0, "not above zero")
    )
    return distinct.select("field", "value", "n", typed.alias("typed"), fault.alias("fault"))


def _number(text: Column, kind: str) -> Column:
    """A whole number, null for any other text."""
    t = F.trim(text)
    return F.when(t.rlike(r"\A[+-]?[0-9]{1,18}\z"), t.cast("bigint").try_cast(kind))


def parse_routes(df: DataFrame, id_col: str = "line_id", line_col: str = "raw_line") -> tuple[DataFrame, DataFrame]:
    """(routes, rejected): typed routes, and ``(line_id, reason, detail)`` for every line that fails.

    ``untyped`` of a route names the fields whose text is no number where one is
    usual; such a line is valid, and the field is null.
    """
    lines = split_lines(df, id_col, line_col)
    dictionary = materialize(value_dictionary(lines))
    small = is_small(dictionary, text="value")
    sound = F.col("structure").isNull()
    out = lines
    for c in CHECKED:
        own = dictionary.where(F.col("field") == c).select(F.col("value").alias(f"{c}_value"), F.col("typed").alias(f"{c}_typed"), F.col("fault").alias(f"{c}_fault"))
        # a broken line has no value; a key of its own keeps such lines from meeting in one task
        out = out.withColumn(f"{c}_value", F.when(sound, F.trim(F.col("fields")[FIELDS.index(c)])).otherwise(F.concat(F.lit("\x00"), F.col("id").cast("string"))))
        if small:
            out = out.join(F.broadcast(own), f"{c}_value", "left")
        else:
            out = skew_join(out, own, [f"{c}_value"], "left", hot=hot_keys(out, [f"{c}_value"]))
    faults = F.concat_ws("; ", *[F.when(F.col(f"{c}_fault").isNotNull(), F.concat(F.lit(f"{c}: "), F.col(f"{c}_fault"))) for c in CHECKED])
    judged = out.withColumn("detail", F.when(sound, faults))
    text = {f: F.col("fields")[i] for i, f in enumerate(FIELDS)}
    null = lambda c: F.when(c != r"\N", c)
    numbers = {"airline_id": _number(text["airline_id"], "bigint"), "stops": _number(text["stops"], "int")}
    untyped = F.array_compact(F.array(*[F.when(null(text[f]).isNotNull() & n.isNull(), F.lit(f)) for f, n in numbers.items()]))
    routes = judged.where(F.col("detail") == "").select(
        F.col("id").alias("line_id"),
        null(text["airline"]).alias("airline"),
        numbers["airline_id"].alias("airline_id"),
        null(text["src_iata"]).alias("src_iata"),
        F.col("src_typed").alias("src"),
        null(text["dst_iata"]).alias("dst_iata"),
        F.col("dst_typed").alias("dst"),
        null(text["codeshare"]).alias("codeshare"),
        numbers["stops"].alias("stops"),
        null(text["equipment"]).alias("equipment"),
        untyped.alias("untyped"),
    )
    failed = judged.where(~sound | (F.col("detail") != ""))
    return routes, failed.select(F.col("id").alias("line_id"), F.when(sound, "value").otherwise(F.col("structure")).alias("reason"), "detail")


__all__ = ["FIELDS", "parse_routes", "split_lines", "value_dictionary"]
