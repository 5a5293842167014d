"""The node struct: a document is an array of these in document order."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import types as T

ATTRIBUTE = T.StructType([T.StructField("k", T.StringType()), T.StructField("v", T.StringType()), T.StructField("b", T.BooleanType())])

#: Structure: where a node stands. pre counts in document order, a subtree is [pre, last]; parent is -1 for the document.
#: Element positions count from 0 from either end, type positions from 1; prev is the element before among siblings.
INTS = ("pre", "post", "last", "parent", "depth", "sib", "el_idx", "el_idx_last", "n_siblings", "type_idx", "type_idx_last", "n_same_type", "prev", "n_content", "form_owner")
STRINGS = ("kind", "name", "norm", "id_attr", "content", "text", "own_text", "data")
#: Fields that cost time and are null unless asked for.
OPTIONAL = ("text", "own_text", "data", "has_text", "anc")

NODE = T.StructType(
    [T.StructField(x, T.IntegerType()) for x in INTS]
    + [T.StructField(x, T.StringType()) for x in STRINGS]
    + [
        T.StructField("attrs", T.ArrayType(ATTRIBUTE)),
        T.StructField("attr_map", T.MapType(T.StringType(), T.StringType())),
        T.StructField("classes", T.ArrayType(T.StringType())),
        T.StructField("classes_lc", T.ArrayType(T.StringType())),
        T.StructField("anc", T.ArrayType(T.IntegerType())),
        T.StructField("has_text", T.BooleanType()),
    ]
)
DOM = T.ArrayType(NODE)

PA_ATTRIBUTE = pa.struct([("k", pa.string()), ("v", pa.string()), ("b", pa.bool_())])
PA_NODE = pa.struct(
    [(x, pa.int32()) for x in INTS]
    + [(x, pa.string()) for x in STRINGS]
    + [("attrs", pa.list_(PA_ATTRIBUTE)), ("attr_map", pa.map_(pa.string(), pa.string())), ("classes", pa.list_(pa.string())), ("classes_lc", pa.list_(pa.string())), ("anc", pa.list_(pa.int32())), ("has_text", pa.bool_())]
)
