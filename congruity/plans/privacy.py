"""What may leave as evidence: raw values of private columns never do.

A result names its columns k0.. and source_value, while a specification calls private
columns by their own names, so both are walked: the columns of a result with all the
fields inside structs, arrays and maps, and the rows that are about a private column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import col
from ..spec import ReconSpec, SpecError, require


def keyed_digest(c: Column, t: T.DataType, key: bytes) -> Column:
    """HMAC-SHA-256 of a value as text; null stays null. Equal values stay equal, and
    without the key nobody can try out which value it was."""
    require(len(key) >= 16, "a key has 16 bytes or more")
    padded = key.ljust(64, b"\0") if len(key) <= 64 else None
    require(padded, "a key has 64 bytes at most")
    inner, outer = (bytes(b ^ x for b in padded) for x in (0x36, 0x5C))
    text = (c.cast("string") if isinstance(t, T.AtomicType) else F.to_json(c)).cast("binary")
    return F.sha2(F.concat(F.lit(outer), F.unhex(F.sha2(F.concat(F.lit(inner), text), 256))), 256)


def walk(c: Column, t: T.DataType, private: frozenset[str], key: bytes | None, path: str) -> tuple[Column, bool]:
    """``c`` with every private field inside it as a digest, and whether there was one."""
    if isinstance(t, T.StructType):
        parts, any_found = [], False
        for f in t.fields:
            inner = c.getField(f.name)
            if f.name.lower() in private:
                part, found = digested(inner, f.dataType, key, f"{path}.{f.name}"), True
            else:
                part, found = walk(inner, f.dataType, private, key, f"{path}.{f.name}")
            parts.append(part.alias(f.name))
            any_found |= found
        return (F.when(c.isNotNull(), F.struct(*parts)), True) if any_found else (c, False)
    if isinstance(t, T.ArrayType):
        if not walk(F.lit(None).cast(t.elementType), t.elementType, private, key, path)[1]:
            return c, False
        return F.transform(c, lambda x: walk(x, t.elementType, private, key, f"{path}[]")[0]), True
    if isinstance(t, T.MapType):
        if walk(F.lit(None).cast(t.keyType), t.keyType, private, key, path)[1]:
            raise SpecError(f"the keys of the map {path} hold private fields")
        inside = walk(F.lit(None).cast(t.valueType), t.valueType, private, key, path)[1]
        if not isinstance(t.keyType, T.StringType):
            return (F.transform_values(c, lambda k, v: walk(v, t.valueType, private, key, f"{path}[]")[0]), True) if inside else (c, False)

        def entry(k: Column, v: Column) -> Column:
            kept = walk(v, t.valueType, private, key, f"{path}[]")[0]
            kept = kept.cast("string") if isinstance(t.valueType, T.AtomicType) else F.to_json(kept)
            return F.when(F.lower(k).isin(*sorted(private)), digested(v, t.valueType, key, path)).otherwise(kept)

        return F.transform_values(c, entry), True  # which entries there are, only the data tell
    return c, False


def digested(c: Column, t: T.DataType, key: bytes | None, path: str) -> Column:
    require(key is not None, f"{path} is private: give a key, or leave it out")
    return keyed_digest(c, t, key)


def guarded(df: DataFrame, spec: ReconSpec | None, private: tuple[str, ...], key: bytes | None = None) -> DataFrame:
    """``df`` as it may be written: values of ``private`` columns, at any depth and under
    any of the names that results give them, are keyed digests. Without a key such a
    result is refused. Names count without regard to case. Entries of a map count by their
    keys, and maps with keys of text get values of text (JSON of nested ones)."""
    names = {p.lower() for p in private}
    if not names:
        return df
    pairs = [] if spec is None else [*spec.keys, *((m.source, m.target) for m in spec.mappings)]
    for s, t in pairs:  # both names of a pair are private if one is
        if {s.lower(), t.lower()} & names:
            names |= {s.lower(), t.lower()}
    if spec is not None:
        names |= {f"k{i}" for i, pair in enumerate(spec.keys) if {x.lower() for x in pair} & names}
        if spec.groups:
            names |= {f"g{i}" for i, m in enumerate(spec.groups.grouping) if {m.source.lower(), m.target.lower()} & names}
    private_names = frozenset(names)
    by_row = {"source_column", "source_value", "target_value"} <= set(df.columns)
    about = F.lower(F.col("source_column")).isin(*sorted(names)) | F.lower(F.col("target_column")).isin(*sorted(names)) if by_row and "target_column" in df.columns else F.lower(F.col("source_column")).isin(*sorted(names)) if by_row else None
    out = []
    for f in df.schema.fields:
        c = col(f.name)
        if f.name.lower() in private_names:
            c = digested(c, f.dataType, key, f.name)
        elif by_row and f.name in ("source_value", "target_value"):
            c = F.when(about, digested(c, f.dataType, key, f.name)).otherwise(c)
        elif by_row and f.name == "difference":
            c = F.when(about, F.lit(None)).otherwise(c)
        else:
            c, _ = walk(c, f.dataType, private_names, key, f.name)
        out.append(c.alias(f.name))
    return df.select(*out)
