"""Joins whose strategy follows from a measured size, not from a hope."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

#: Rows and bytes up to which the small side of a join is sent to every executor.
BROADCAST_ROWS, BROADCAST_BYTES = 500_000, 32 << 20
#: Bytes that a row and a number take at least in a broadcast relation.
ROW_BYTES, NUMBER_BYTES = 32, 8


def measured(df: DataFrame) -> tuple[int, int]:
    """(rows, bytes about) of a frame, counted in one pass."""
    size = F.lit(ROW_BYTES + NUMBER_BYTES * len(df.columns))
    for field in df.schema:
        if isinstance(field.dataType, (T.StringType, T.BinaryType)):
            size = size + F.coalesce(F.octet_length(field.name), F.lit(0))
        elif isinstance(field.dataType, T.ArrayType) and isinstance(field.dataType.elementType, T.NumericType):
            size = size + F.coalesce(F.size(field.name) * NUMBER_BYTES, F.lit(0))
        elif isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
            size = size + F.coalesce(F.octet_length(F.to_json(F.struct(field.name))), F.lit(0))
    row = df.agg(F.count("*").alias("n"), F.coalesce(F.sum(size), F.lit(0)).alias("b")).first()
    return row["n"], row["b"]


def sized_join(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    how: str = "inner",
    *,
    broadcast_rows: int = BROADCAST_ROWS,
    broadcast_bytes: int = BROADCAST_BYTES,
    salts: int = 16,
    right_rows: int | None = None,
) -> DataFrame:
    """Join ``left`` with ``right``, unique or nearly so by ``keys``.

    ``right`` is measured (pass ``right_rows`` if its rows are numbers and their
    count is known; it should be written or cheap). At most ``broadcast_rows`` rows
    and ``broadcast_bytes`` bytes: broadcast. Beyond: a shuffle join in
    which every key of the left side is spread over ``salts`` partitions and the
    right side is repeated once per salt, so a key with a third of all rows is
    met by many tasks; Spark may not broadcast it after all. ``how`` may be inner, left, left_semi or left_anti.
    """
    rows, size = measured(right) if right_rows is None else (right_rows, right_rows * (ROW_BYTES + NUMBER_BYTES * len(right.columns)))
    if rows <= broadcast_rows and size <= broadcast_bytes:
        return left.join(F.broadcast(right), keys, how)
    salted = left.withColumn("_salt", _salt_of(left, keys, salts))
    repeated = right.withColumn("_salt", F.explode(F.array(*[F.lit(i) for i in range(salts)])))
    # Spark estimates the repeated side by its files, without the repetition, and would send it through the driver if those are small
    repeated = repeated.hint("merge")
    return salted.join(repeated, [*keys, "_salt"], how).drop("_salt")


def _salt_of(left: DataFrame, keys: list[str], salts: int) -> Column:
    """A salt from columns other than the keys: the same row gets the same salt if a task runs again."""
    others = [c for c, t in left.dtypes if c not in keys and not t.startswith(("map", "variant"))]
    basis = F.xxhash64(*others) if others else F.monotonically_increasing_id()
    return F.pmod(basis, F.lit(salts)).cast("int")
