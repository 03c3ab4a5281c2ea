"""Hive-style partition paths: value text, escaping, globs, column types.

Everything here is driver-side string work proportional to the *spec* (the
number of listed values), never to the data.
"""

from __future__ import annotations

import re
from typing import Any, Iterable

from pyspark.sql import types as T

from ..spec import DatasetSpec, PartitionKey

# The characters Spark percent-escapes in partition directory
# names (in addition to the control characters U+0001..U+001F and U+007F).
# The escaped form is "%" followed by two upper-case hex digits.
HIVE_ESCAPED_CHARS = '"#%\'*/:=?[\\]^{'

# Fixed value: the directory text Spark and Hive use for a NULL value.
HIVE_NULL = "__HIVE_DEFAULT_PARTITION__"

# Characters with a meaning in a Hadoop glob that survive Hive escaping.
_GLOB_SPECIAL = "},"


def hive_escape(text: str) -> str:
    out = []
    for ch in text:
        code = ord(ch)
        if ch in HIVE_ESCAPED_CHARS or 0x01 <= code <= 0x1F or code == 0x7F:
            out.append("%%%02X" % code)
        else:
            out.append(ch)
    return "".join(out)


def hive_unescape(text: str) -> str:
    return re.sub(r"%([0-9A-Fa-f]{2})", lambda m: chr(int(m.group(1), 16)), text)


def glob_escape(text: str) -> str:
    return "".join("\\" + ch if ch in _GLOB_SPECIAL else ch for ch in text)


def directory_texts(value: Any) -> list[str]:
    """Directory spellings (escaped, as on storage) for one listed value.

    A boolean may have been written as ``true`` by Spark or ``True`` by a
    plain ``str()``; both spellings are looked for."""
    if value is None:
        return [HIVE_NULL]
    if isinstance(value, bool):
        return ["true", "True"] if value else ["false", "False"]
    if isinstance(value, float):
        return [hive_escape(repr(value))]
    return [hive_escape(str(value))]


def canonical_text(value: Any) -> str:
    """One canonical escaped spelling per value (used to match listings)."""
    return directory_texts(value)[0]


def column_type(part: PartitionKey) -> T.DataType:
    """Spark type of a listed partition column.

    A declared type wins.  Otherwise the Python values decide: all booleans
    -> boolean; all ints -> int, or bigint when one does not fit 32 bits;
    ints and floats -> double; anything mixed with text -> string.  NULLs do
    not vote; a key whose values are all NULL is a string column."""
    if part.type:
        return _ddl_type(part.type)
    kinds = set()
    big = False
    for v in part.values:
        if v is None:
            continue
        if isinstance(v, bool):
            kinds.add("bool")
        elif isinstance(v, int):
            kinds.add("int")
            big = big or not (-(2**31) <= v < 2**31)
        elif isinstance(v, float):
            kinds.add("float")
        else:
            kinds.add("str")
    if kinds == {"bool"}:
        return T.BooleanType()
    if kinds == {"int"}:
        return T.LongType() if big else T.IntegerType()
    if kinds and kinds <= {"int", "float"}:
        return T.DoubleType()
    return T.StringType()


def _ddl_type(name: str) -> T.DataType:
    return {
        "string": T.StringType(), "int": T.IntegerType(), "integer": T.IntegerType(),
        "bigint": T.LongType(), "long": T.LongType(), "smallint": T.ShortType(),
        "tinyint": T.ByteType(), "double": T.DoubleType(), "float": T.FloatType(),
        "boolean": T.BooleanType(), "date": T.DateType(),
        "timestamp": T.TimestampType(), "timestamp_ntz": T.TimestampNTZType(),
    }[name.lower()]


def level_pattern(part: PartitionKey, values: Iterable[Any]) -> str:
    """Glob for one directory level: ``k=a`` or ``{k=a,k=b}``; duplicates are
    listed once (multiplicity is applied after the scan)."""
    key = glob_escape(hive_escape(part.key))
    alts = list({f"{key}={glob_escape(t)}": None for v in values for t in directory_texts(v)})
    return alts[0] if len(alts) == 1 else "{" + ",".join(alts) + "}"


def leaf_globs(ds: DatasetSpec) -> list[str]:
    """Globs covering exactly the listed leaves of ``ds``: one per distinct
    first-level value, ``base/k1=a/{k2=x,k2=y}/...``.

    Brace alternatives per level are the Cartesian product of the deeper
    levels.  The first level is written out literally: a literal component
    is not matched by listing its parent, so the base folder - often the
    widest one, e.g. years of daily folders - is never listed; only the
    listed folders are.  Spark expands the globs concurrently, and all of
    them still feed a single scan."""
    base = ds.base_path
    if not ds.partitions:
        return [base]
    first, rest = ds.partitions[0], ds.partitions[1:]
    tail = "/".join(level_pattern(p, _unique(p.values)) for p in rest)
    globs = []
    for v in _unique(first.values):
        head = level_pattern(first, [v])
        globs.append("/".join(x for x in (base, head, tail) if x))
    return globs


def brace_glob(ds: DatasetSpec) -> str:
    """One glob for all listed leaves, alternatives at every level: it matches
    whatever exists, at the price of listing the base folder."""
    return "/".join([ds.base_path, *(level_pattern(p, p.values) for p in ds.partitions)])


def leaf_path(ds: DatasetSpec, combo: tuple[Any, ...]) -> str:
    parts = [f"{hive_escape(p.key)}={canonical_text(v)}" for p, v in zip(ds.partitions, combo)]
    return "/".join([ds.base_path, *parts])


def _unique(values: Iterable[Any]) -> list[Any]:
    out: list[Any] = []
    seen: set[tuple[str, Any]] = set()
    for v in values:
        marker = (type(v).__name__, v)
        if marker not in seen:
            seen.add(marker)
            out.append(v)
    return out
