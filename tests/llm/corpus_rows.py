"""Rows that the tests of the corpus operators share."""

from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

#: Documents with nulls, empty and blank texts, repeated rows, copies, a long text, and extra columns whose names
#: clash with what operators compute.
LONG = "\n".join(" ".join(f"w{(i * 7 + j) % 997}x{i}" for j in range(40)) for i in range(500))
COPY = "\n".join(" ".join(f"c{i}d{j}" for j in range(30)) for i in range(6))
ODD = [
    (1, COPY, 1), (2, COPY, 2), (2, COPY, 2), (3, None, 3), (3, None, 3), (4, "", 4), (5, " \n\t ", 5),
    (None, COPY, 6), (None, None, 7), (None, "", 8), (6, LONG, 9), (7, LONG + "\nanother end", 10), (8, "one", 11),
    (9, "one two\nthree four", 12), (9, "other text under the same id", 13), (10, "é ü 漢字 😀\r\n\x0b tab", 14),
]
CLASHING = ["id", "mark", "key", "kept", "score", "removed", "chunk", "code", "fp", "label", "row", "lines"]


def documents(spark, rows):
    """Documents (doc_id, text) with clashing extra columns."""
    schema = StructType([StructField("doc_id", LongType()), StructField("text", StringType()),
                         *[StructField(c, IntegerType()) for c in CLASHING]])
    return spark.createDataFrame([(r[0], r[1], *[i] * len(CLASHING)) for i, r in enumerate(rows)], schema)
