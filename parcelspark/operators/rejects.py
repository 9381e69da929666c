"""Rows that cannot be loaded, parted from those that can, with the reasons (problem 3)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A number: optional minus, ASCII digits, optional point and digits, optional exponent.
NUMBER = r"^-?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?\z"
#: Stand-ins while a quoted field is cut at its commas; MARK itself is doubled up first, so any text survives.
MARK, OWN, COMMA = "\u0001", "\u0001a", "\u0001b"


def bare_line(line: Column) -> Column:
    """The line without one carriage return at its end."""
    return F.when(line.endswith("\r"), line.substr(F.lit(1), F.length(line) - 1)).otherwise(line)


def split_fields(bare: Column, pieces: Column) -> tuple[Column, Column]:
    """(fields, broken) of a record whose fields are separated by commas; pieces: bare, split at its double quotes.

    A field holds no double quote, or starts and ends with one and has each inner one twice;
    fields come out with their quotes. broken is true where the quoting is not of that form.
    Every other piece is inside of quotes, the commas there are content. Both are plain
    expressions, linear in the length of the line (nothing of the whole line within a lambda).
    """
    outer = F.filter(pieces, lambda p, i: (i % 2 == 0) & (i > 0))
    between = F.slice(outer, F.lit(1), F.greatest(F.size(outer) - 1, F.lit(0)))
    first_piece, last_piece = F.element_at(pieces, 1), F.element_at(pieces, -1)
    good = (F.size(pieces) % 2 == 1) & ((first_piece == "") | first_piece.endswith(",")) & ((last_piece == "") | last_piece.startswith(",")) & F.forall(between, lambda p: (p == "") | (p.startswith(",") & p.endswith(",")))
    safe = F.transform(pieces, lambda p, i: F.when(i % 2 == 1, F.replace(F.replace(p, F.lit(MARK), F.lit(OWN)), F.lit(","), F.lit(COMMA))).otherwise(F.replace(p, F.lit(MARK), F.lit(OWN))))
    back = lambda f: F.replace(F.replace(f, F.lit(COMMA), F.lit(",")), F.lit(OWN), F.lit(MARK))
    quoted = F.size(pieces) > 1
    fields = F.when(quoted, F.transform(F.split(F.array_join(safe, '"'), ",", -1), back)).otherwise(F.split(bare, ",", -1))
    return fields, quoted & ~good


def content(field: Column) -> Column:
    """What a field holds: without its outer quotes, inner ones once."""
    inside = F.replace(field.substr(F.lit(2), F.length(field) - 2), F.lit('""'), F.lit('"'))
    return F.when(field.startswith('"'), inside).otherwise(field)


def parse_records(df: DataFrame, line: str, names: list[str]) -> DataFrame:
    """Add `f`, a struct of nullable text columns by name, and `_shape`, the reason why a line has none (else null).

    Reasons: "null line", "broken quoting", "wrong number of fields".
    """
    fields, broken = split_fields(F.col("_bare"), F.col("_pieces"))
    df = df.withColumn("_bare", bare_line(F.col(line))).withColumn("_pieces", F.split("_bare", '"', -1))
    df = df.withColumn("_fields", fields).withColumn("_broken", broken)
    shape = F.when(F.col(line).isNull(), "null line").when(F.col("_broken"), "broken quoting").when(F.size("_fields") != len(names), "wrong number of fields")
    df = df.withColumn("_shape", shape)
    return df.withColumn("f", F.when(F.col("_shape").isNull(), F.struct(*[content(F.col("_fields")[i]).alias(n) for i, n in enumerate(names)]))).drop("_bare", "_pieces", "_fields", "_broken")


def number_rule(name: str, limit: float) -> tuple[str, Column]:
    """(reason, is wrong) for an optional number of at most limit in absolute value."""
    text = F.col(f"f.{name}")
    plain = F.trim(text)
    fits = plain.rlike(NUMBER) & F.coalesce(F.abs(plain.try_cast("double")) <= limit, F.lit(False))
    return f"{name} is not a number up to {limit:g}", ~((text == "") | fits)


def with_errors(parsed: DataFrame, rules: list[tuple[str, Column]]) -> DataFrame:
    """Add `errors`, the array of the reasons that hold; empty if the row can be loaded.

    A rule is a reason and a column that is true where the row is wrong (null counts as
    wrong). Rules are judged only on lines of the right shape.
    """
    marks = [F.when(F.col("_shape").isNull() & F.coalesce(wrong, F.lit(True)), F.lit(reason)) for reason, wrong in rules]
    return parsed.withColumn("errors", F.array_compact(F.array(F.col("_shape"), *marks))).drop("_shape")


def load_incidents(raw: DataFrame, codes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(loaded, rejected) of incident lines: raw_id, batch_file, line_no, line.

    codes: ucr_general of the codes that may occur, a small fixed table; the join leaves the
    choice of a broadcast to Spark's own size check. loaded has typed columns (an empty number is
    null); rejected has raw_id, batch_file, line_no, line and errors. Every row of raw is in
    exactly one of the two, repeated rows as often as they occur; a null line is rejected; an
    empty codes table rejects all lines.
    """
    names = ["dc_key", "dc_dist", "psa", "dispatch_date", "dispatch_time", "ucr_general", "text_general_code", "point_x", "point_y"]
    known = codes.where(F.col("ucr_general").isNotNull()).select(F.col("ucr_general").cast("string").alias("_code")).distinct()
    parsed = parse_records(raw.select("raw_id", "batch_file", "line_no", "line"), "line", names)
    parsed = parsed.join(known, F.trim(F.col("f.ucr_general")) == F.col("_code"), "left")
    judged = with_errors(parsed, [("ucr_general is not a known code", F.col("_code").isNull()), number_rule("point_x", 180), number_rule("point_y", 90)]).drop("_code")
    number = lambda n: F.trim(F.col(f"f.{n}")).try_cast("double").alias(n)
    text = lambda n: F.col(f"f.{n}").alias(n)
    loaded = judged.where(F.size("errors") == 0).select("raw_id", F.trim(F.col("f.dc_key")).try_cast("bigint").alias("dc_key"), text("dc_dist"), text("psa"), text("dispatch_date"), text("dispatch_time"), F.trim(F.col("f.ucr_general")).try_cast("int").alias("ucr_general"), text("text_general_code"), number("point_x"), number("point_y"))
    rejected = judged.where(F.size("errors") > 0).select("raw_id", "batch_file", "line_no", "line", "errors")
    return loaded, rejected
