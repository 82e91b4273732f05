"""Schemas of the library's tables; never inferred."""

from pyspark.sql.types import ArrayType, BinaryType, BooleanType, IntegerType, LongType, StringType, StructField, StructType

#: Kinds of symbols, visibilities, kinds of references.
KINDS = ("Class", "Trait", "Object", "Enum", "EnumCase", "Method", "Constructor", "Val", "Var", "Given", "TypeAlias", "TypeParam", "Package", "PackageObject")
VISIBILITIES = ("Public", "Protected", "Private", "PackagePrivate")
REFERENCE_KINDS = ("Call", "Override", "Extends", "TypeUse", "Import", "Read")


def _struct(**fields) -> StructType:
    return StructType([StructField(name, kind) for name, kind in fields.items()])


SYMBOL_ID = _struct(pkg=ArrayType(StringType()), owners=ArrayType(StringType()), name=StringType(), is_term=BooleanType(), disambig=StringType())
LOCATION = _struct(uri=StringType(), start_line=IntegerType(), start_col=IntegerType(), end_line=IntegerType(), end_col=IntegerType())
#: Tagged union: ``_kind`` says which of the other fields are set.
ORIGIN = _struct(_kind=StringType(), build_target=StringType(), container=StringType(), source_file=StringType())
SYMBOL = _struct(
    sym=StringType(), id=SYMBOL_ID, name=StringType(), kind=StringType(), visibility=StringType(), owner=StringType(), location=LOCATION, origin=ORIGIN,
    parents=ArrayType(StringType()), type_signature=StringType(),
)
REFERENCE = _struct(sym=StringType(), location=LOCATION, kind=StringType())
ENTRY = _struct(container=StringType(), entry=StringType(), entry_index=LongType(), size=LongType(), bytes=BinaryType())
#: One class, method or field of a class file before the column rules.
MEMBER = _struct(
    container=StringType(), entry=StringType(), level=StringType(), internal_name=StringType(), inner_outer=StringType(), inner_simple=StringType(), anonymous=BooleanType(),
    name=StringType(), flags=IntegerType(), class_flags=IntegerType(), super_name=StringType(), interfaces=ArrayType(StringType()), signature=StringType(), ordinal=IntegerType(),
)
