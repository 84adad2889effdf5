"""Scalar functions: builders of columns where Spark has the parts, plain Python for the rest."""


def column(f):
    """Mark a function that takes and returns columns."""
    f.builds_column = True
    return f


def python(returns: str, of_text: bool = False):
    """Mark a function of plain values that runs as a pandas UDF, with the type that it returns.

    of_text: it is given one text, and runs as an Arrow UDF, which holds fewer texts at a time.
    """

    def mark(f):
        f.returns, f.of_text = returns, of_text
        return f

    return mark


def udf_of(f, strict: bool = False):
    """The pandas UDF of a marked function; null for values on which it raises, which ``records.rejected`` counts.

    strict: let the job fail instead.
    """
    from pyspark.sql import SparkSession
    from pyspark.sql import types as T

    from rillflow.operators.mapping import _of_text, _pandas
    from rillflow.records import Rejects

    spark = SparkSession.getActiveSession()
    count = Rejects.of(spark) if spark else None

    def one(*values):
        try:
            return f(*values)
        except Exception:
            if strict:
                raise
            if count is not None:
                count.add(1)
            return None

    return (_of_text if getattr(f, "of_text", False) else _pandas)(one, T._parse_datatype_string(f.returns))
