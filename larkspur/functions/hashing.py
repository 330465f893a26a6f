"""Hashes, fingerprints and deterministic draws, as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed value: letters and digits of generated codes.
ALPHABET = "ABCDEFGHJKLMNPQRSTUVWXYZ23456789"


def stable_hash(c) -> Column:
    """SHA-256 of a string's UTF-8 bytes, in hex."""
    return F.sha2(c, 256)


def seed_of(*parts) -> Column:
    """An unsigned 64-bit seed of parts, as DECIMAL(20, 0): the first 8 bytes of their hash."""
    return F.conv(F.substring(F.sha2(F.concat_ws("\x1f", *parts), 256), 1, 16), 16, 10).cast("decimal(20,0)")


def draw(n, *parts) -> Column:
    """A number below n from 60 bits of the hash of parts; the same in any engine with SHA-256."""
    return F.pmod(F.conv(F.substring(F.sha2(F.concat_ws(":", *parts), 256), 1, 15), 16, 10).cast("bigint"), n)


def json_text(c: Column) -> Column:
    """A string as JSON: quoted and escaped."""
    j = F.to_json(F.array(c))
    return F.substring(j, F.lit(2), F.length(j) - 2)


def fingerprint(c: Column) -> Column:
    """SHA-256 of the canonical JSON of a string; null stays null."""
    return F.when(c.isNotNull(), F.sha2(json_text(c), 256))


def canonical_json(c: Column, kind: T.DataType) -> Column:
    """A value as canonical JSON: names in order, nothing between tokens, UTF-8 as it is.  kind: its type.

    Structs have all their fields, nulls as null; the names of maps are texts.  Fractions are written as they read shortest, and those of 10^7 and more or under 10^-3, for which writers differ, are an
    error; so are types that JSON lacks.
    """
    if isinstance(kind, T.StringType):
        out = json_text(c)
    elif isinstance(kind, (T.IntegralType, T.BooleanType)):
        out = c.cast("string")
    elif isinstance(kind, T.FractionalType) and not isinstance(kind, T.DecimalType):
        plain = (c == 0) | ((F.abs(c) >= 1e-3) & (F.abs(c) < 1e7))
        out = F.when(plain, c.cast("double").cast("string")).otherwise(F.raise_error(F.concat(F.lit("no canonical form: "), c.cast("string"))))
    elif isinstance(kind, T.StructType):
        parts = [F.concat(json_text(F.lit(f.name)), F.lit(":"), canonical_json(c[f.name], f.dataType)) for f in sorted(kind.fields, key=lambda f: f.name)]
        out = F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))
    elif isinstance(kind, T.ArrayType):
        out = F.concat(F.lit("["), F.array_join(F.transform(c, lambda x: canonical_json(x, kind.elementType)), ","), F.lit("]"))
    elif isinstance(kind, T.MapType) and isinstance(kind.keyType, T.StringType):
        entries = F.array_sort(F.map_entries(c), lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0))
        out = F.concat(F.lit("{"), F.array_join(F.transform(entries, lambda e: F.concat(json_text(e["key"]), F.lit(":"), canonical_json(e["value"], kind.valueType))), ","), F.lit("}"))
    else:
        raise TypeError(f"no canonical JSON of {kind.simpleString()}")
    return F.when(c.isNull(), F.lit("null")).otherwise(out)


def record_fingerprint(df: DataFrame, columns: list[str]) -> Column:
    """SHA-256 of the canonical JSON of some columns of a frame as one object."""
    kind = T.StructType([df.schema[k] for k in columns])
    return F.sha2(canonical_json(F.struct(*columns), kind), 256)


def random_code(prefix: str, width: int, *parts) -> Column:
    letters = [F.substring(F.lit(ALPHABET), (draw(F.lit(len(ALPHABET)), *parts, F.lit(str(k))) + 1).cast("int"), F.lit(1)) for k in range(width)]
    return F.concat(F.lit(prefix + "-"), *letters)


def is_safe_label(c: Column) -> Column:
    return c.rlike(r"^[A-Za-z0-9_.:/+\-]{1,128}\z")


def safe_context(columns, always_hashed=()) -> list[Column]:
    """Each column as itself where its value is harmless, with <name>_sha256 where it is not."""
    out = []
    for name in columns:
        c = F.col(name)
        safe = is_safe_label(c) if name not in always_hashed else F.lit(False)
        if name not in always_hashed:
            out.append(F.when(safe, c).alias(name))
        out.append(F.when(~safe, fingerprint(c)).alias(f"{name}_sha256"))
    return out


#: Patterns of credentials, which a release refuses, and of machine paths that no rewrite has taken.
SECRETS = (r"(?i)(?:password|密码)\s*[:：=]", r"BEGIN (?:RSA |OPENSSH )?PRIVATE KEY")
ABSOLUTE = r"(?<![A-Za-z0-9_])/(?:root|home)/[^\s\"'{}]+"


def release_rewrites(project: str, runtime: str, homes: str, name: str, run: str) -> list[tuple[str, str]]:
    """Ordered (pattern, replacement) of machine paths: the project's folder, its runs under the runtime's folder, its checkouts in homes
    (a folder that ends in a slash), models, and the runtime's folder itself.  `name` is the folder of a checkout, `run` that of the runs."""
    q = re.escape
    return [(q(f"{project}/"), ""), (q(f"{runtime}/{run}/"), ""), (q(homes) + r"[^/]+/(?:[^/]+/)*" + q(name) + "/", ""), (q(f"{runtime}/models/"), "models/"), (q(runtime) + r"(?=/|\s|[\"'{}]|$)", "runtime")]


def sanitize(c: Column, rewrites: list[tuple[str, str]]) -> tuple[Column, Column, Column]:
    """Rewritten text (null if refused), number of rewrites, and whether it is refused: for a credential before or a machine path after."""
    count, text = F.lit(0), c
    for pattern, new in rewrites:
        count = count + F.regexp_count(text, F.lit(pattern))
        text = F.regexp_replace(text, F.lit(pattern), F.lit(new))
    refused = text.rlike(ABSOLUTE)
    for pattern in SECRETS:
        refused = refused | c.rlike(pattern)
    return F.when(~refused, text), count, refused
