"""Bottom-up hashing of nested records: texts, arrays, maps and structs of any depth, as Catalyst expressions.

Leaves are normalised texts. Arrays and the fields of structs are nodes without order: a node's digest is the hash of its children's sorted
digests. Empty leaves and nodes are left out. `structure` writes the normalised tree out, so that equal digests can be confirmed. Every
value stands once in an expression, as Catalyst would work it out anew for each place it stands in.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType

Leaf = Callable[[Column], Column]
#: Digests and structures of empty leaves and nodes.
_NO_DIGEST = tuple(hashlib.md5(x).hexdigest() for x in (b"", b"["))
_NO_STRUCTURE = ("", "\x1e\x1c")


def _grow(value: Column, kind: DataType, named: bool, leaf: Leaf, node: Leaf, none: tuple[str, ...]) -> Column:
    def child(v: Column, k: DataType) -> Column:
        return _grow(v, k, named, leaf, node, none)

    def tagged(name: Column, x: Column) -> Column:
        return node(F.array(F.concat(F.hex(name.cast("binary")), F.lit("\x1d"), x))) if named else x

    if isinstance(kind, ArrayType):
        children = F.filter(F.coalesce(F.transform(value, lambda x: child(x, kind.elementType)), F.array().cast("array<string>")), lambda x: ~x.isin(*none))
    elif isinstance(kind, MapType):
        entries = F.transform(F.map_entries(value), lambda e: F.struct(e["key"].cast("string").alias("k"), child(e["value"], kind.valueType).alias("v")))
        full = F.filter(F.coalesce(entries, F.array().cast("array<struct<k:string,v:string>>")), lambda e: ~e["v"].isin(*none))
        children = F.transform(full, lambda e: tagged(e["k"], e["v"]))
    elif isinstance(kind, StructType):
        entries = F.array(*[F.struct(F.lit(f.name).alias("k"), child(value[f.name], f.dataType).alias("v")) for f in kind.fields])
        children = F.transform(F.filter(entries, lambda e: ~e["v"].isin(*none)), lambda e: tagged(e["k"], e["v"]))
    else:
        return leaf(F.coalesce(value.cast("string"), F.lit("")))
    return node(F.sort_array(children))


def digest(value: Column, kind: DataType, leaf: Leaf, named: bool = True) -> Column:
    """The record's root digest, never NULL. Without `named`, fields of structs have no names, so the same value may stand under any of them."""
    hashed = _grow(value, kind, named, lambda v: F.md5(leaf(v).cast("binary")), lambda c: F.md5(F.concat(F.lit("["), F.concat_ws("", c)).cast("binary")), _NO_DIGEST)
    return F.coalesce(F.unhex(hashed), F.lit(b""))


def structure(value: Column, kind: DataType, leaf: Leaf, named: bool = True) -> Column:
    """The normalised record as a text, never NULL: equal for equal trees only, as leaves hold no control characters."""
    return _grow(value, kind, named, leaf, lambda c: F.concat(F.lit("\x1e"), F.concat_ws("\x1f", c), F.lit("\x1c")), _NO_STRUCTURE)
