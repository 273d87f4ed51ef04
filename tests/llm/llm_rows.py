"""Rows with the awkward cases every operator has to take."""

from pyspark.sql import types as T

DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
    T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
    T.StructField("n_chars", T.LongType()),
    # Names that operators use for columns of their own.
    T.StructField("shard", T.StringType()), T.StructField("w", T.StringType()),
    T.StructField("class_id", T.StringType()), T.StructField("carry", T.StringType()),
    T.StructField("size", T.StringType()), T.StructField("piece", T.StringType())])

CLASH = ("x", "y", "z", "c", "s", "p")


def documents(spark, rows):
    """Rows (doc_id, text[, source]) as a documents table with extra columns."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "src1",
             None if r[1] is None else len(r[1]), *CLASH) for r in rows]
    return spark.createDataFrame(full, DOCS)


LONG = " ".join(f"word{i % 977} and{i % 31}" for i in range(30_000))
PROSE = ("the quick brown fox of the old town is in a hurry and it runs to the river that "
         "flows from the hills on to the sea for all we know as it was by then at last")
AWKWARD = [
    (1, PROSE), (2, PROSE), (2, PROSE), (3, None), (4, ""), (5, " \n\t "), (None, PROSE + " x"),
    (6, LONG), (7, "one"), (8, "éÉİ ΣΑΣ 中文 \U0001F600 <|endoftext|>x \x1c!\x00 é"),
    (9, "a a a a a a"), (10, "x\n\nx\n \nx"), (None, None)]
