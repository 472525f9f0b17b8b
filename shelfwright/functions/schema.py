"""Types from their short form without a session, so that functions can be defined before one exists."""

from __future__ import annotations

import re

from pyspark.sql import types as T

_PLAIN = {"string": T.StringType, "int": T.IntegerType, "long": T.LongType, "bigint": T.LongType, "boolean": T.BooleanType, "double": T.DoubleType, "binary": T.BinaryType, "timestamp": T.TimestampType}


def ddl(text: str) -> T.DataType:
    """``int``, ``array<string>``, or ``name type, name type``."""
    s = text.strip()
    if s in _PLAIN:
        return _PLAIN[s]()
    if m := re.fullmatch(r"array<(.*)>", s):
        return T.ArrayType(ddl(m[1]))
    return T.StructType([T.StructField(name, ddl(kind)) for name, kind in (x.strip().split(" ", 1) for x in s.split(","))])
