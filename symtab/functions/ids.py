"""Symbol ids: construction, parsing, rendering, and the rules that classify symbols."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Access flags of class files.
PRIVATE, PROTECTED, FINAL, BRIDGE, INTERFACE, SYNTHETIC, ENUM = 0x2, 0x4, 0x10, 0x40, 0x200, 0x1000, 0x4000
#: Fixed value: overload marks in SemanticDB symbols.
OVERLOAD = r"\(\+?\d*\)"
#: SemanticDB kinds in order of priority, and what they become.
SEMANTICDB_KINDS = (("CLASS", "Class"), ("TRAIT", "Trait"), ("INTERFACE", "Trait"), ("OBJECT", "Object"), ("PACKAGE_OBJECT", "Object"), ("METHOD", "Method"), ("MACRO", "Method"),
                    ("CONSTRUCTOR", "Constructor"), ("TYPE", "TypeAlias"), ("TYPE_PARAMETER", "TypeParam"), ("PACKAGE", "Package"))


def strip_dollar(c: Column) -> Column:
    """Without one trailing ``$``."""
    return F.regexp_replace(c, r"\$$", "")


def _id(pkg: Column, owners: Column, name: Column, is_term: Column) -> Column:
    return F.struct(pkg.alias("pkg"), owners.alias("owners"), name.alias("name"), is_term.alias("is_term"), F.lit(None).cast("string").alias("disambig"))


def symbol_id(pkg: Column, owners: Column, name: Column, is_type: Column) -> Column:
    """Id of a symbol; one trailing ``$`` is dropped from every part. ``disambig`` is null: overloads share an id."""
    return _id(F.transform(pkg, strip_dollar), F.transform(owners, strip_dollar), strip_dollar(name), ~is_type)


def _segments(c: Column) -> Column:
    """Parts of a dotted or slashed path; none for the empty string."""
    return F.when(c == "", F.array().cast("array<string>")).otherwise(F.split(c, r"[/.]"))


def _parted(internal: Column) -> tuple[Column, Column]:
    """(package segments, last segment) of an internal class name."""
    parts = _segments(internal)
    return F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), F.coalesce(F.try_element_at(parts, F.lit(-1)), F.lit(""))


def parse_jvm_name(internal: Column, member: Column, inner_outer: Column, inner_simple: Column) -> Column:
    """Id of a class or of a member of it, from the internal name and, for nested classes, the inner-class record.

    A record gives owner and simple name; without one, ``$`` inside the name stays. A trailing ``$`` without a member means
    the object, a term; a member is a term of the class; else a type.
    """
    pkg, last = _parted(internal)
    dollar = last.endswith("$")
    bare = strip_dollar(last)
    _, outer_last = _parted(inner_outer)
    nested = inner_outer.isNotNull()
    name = F.when(nested, F.coalesce(inner_simple, bare)).otherwise(bare)
    owners = F.when(nested, F.array(strip_dollar(outer_last))).otherwise(F.array().cast("array<string>"))
    return F.when(member.isNotNull(), _id(pkg, F.concat(owners, F.array(name)), member, F.lit(True))).otherwise(_id(pkg, owners, name, dollar))


def parse_semanticdb_symbol(s: Column) -> Column:
    """Id from a SemanticDB symbol: ``/`` splits packages, ``.`` and ``#`` owners; a trailing ``#`` is a type, else a term; no token: a nameless type."""
    cleaned = F.regexp_replace(s, OVERLOAD, "")
    pkg = F.regexp_extract(cleaned, r"^(.*)/[^/]*$", 1)
    part = F.regexp_extract(cleaned, r"([^/]*)$", 1)
    tokens = F.filter(F.split(part, "[.#]"), lambda t: t != "")
    n = F.size(tokens)
    none = n == 0
    return _id(
        F.when(pkg == "", F.array().cast("array<string>")).otherwise(F.split(pkg, "/")),
        F.slice(tokens, 1, F.greatest(n - 1, F.lit(0))),
        F.when(none, F.lit("")).otherwise(F.get(tokens, n - 1)),
        ~none & ~part.endswith("#"),
    )


def render_symbol_id(id_: Column) -> Column:
    """Dotted text; a term ends with its disambiguator in parentheses."""
    base = F.array_join(F.concat(id_["pkg"], id_["owners"], F.array(id_["name"])), ".")
    return F.when(id_["is_term"], F.concat(base, F.lit("("), F.coalesce(id_["disambig"], F.lit("")), F.lit(")"))).otherwise(base)


def name_key(name: Column) -> Column:
    """Key of every lookup by name."""
    return F.lower(name)


def initials_key(name: Column) -> Column:
    """Lower-cased initials of a name that starts in upper case: the first letter and each capital next to a small letter; else empty."""
    found = F.regexp_extract_all(name, F.lit(r"(^\p{Lu}|(?<=\p{Ll})\p{Lu}|\p{Lu}(?=\p{Ll}))"), F.lit(0))
    return F.when(name.rlike(r"^\p{Lu}"), F.lower(F.array_join(found, ""))).otherwise(F.lit(""))


def is_initials_query(q: Column) -> Column:
    """Two capitals or more and nothing else: such a query searches initials only."""
    return q.rlike(r"^\p{Lu}{2,}$")


def _has(flags: Column, bit: int) -> Column:
    return flags.bitwiseAND(F.lit(bit)) != 0


def access_visibility(flags: Column, rule: str = "bytecode") -> Column:
    """``bytecode``: access bits, package-private reads as Public. ``java`` and ``flags``: an array of flag names; java knows PackagePrivate."""
    if rule == "bytecode":
        return F.when(_has(flags, PRIVATE), "Private").when(_has(flags, PROTECTED), "Protected").otherwise("Public")
    named = F.when(F.array_contains(flags, "Private") | F.array_contains(flags, "PrivateLocal"), "Private").when(F.array_contains(flags, "Protected"), "Protected")
    if rule == "java":
        named = named.when(F.array_contains(flags, "Package"), "PackagePrivate")
    return named.otherwise("Public")


def classify_kind(flags: Column, name: Column, rule: str) -> Column:
    """Kind by producer: class, field or method of a class file (access bits), or class, val, def or type of a compiler (flag names)."""
    if rule == "class":
        simple = F.element_at(F.split(name, "/"), -1)
        module = simple.endswith("$") & ~simple.endswith("$$")
        return F.when(_has(flags, ENUM), "Enum").when(_has(flags, INTERFACE), "Trait").when(module, "Object").otherwise("Class")
    if rule == "field":
        return F.when(_has(flags, ENUM), "EnumCase").when(_has(flags, FINAL), "Val").otherwise("Var")
    if rule == "method":
        return F.when(name == "<init>", "Constructor").otherwise("Method")
    has = lambda flag: F.array_contains(flags, flag)
    if rule == "named_class":
        return F.when(has("Trait"), "Trait").when(has("Enum") & has("Case"), "EnumCase").when(has("Module"), "Object").when(has("Enum"), "Enum").otherwise("Class")
    if rule == "named_val":
        return F.when(has("Given"), "Given").when(has("Enum") & has("Case"), "EnumCase").when(has("Mutable"), "Var").otherwise("Val")
    if rule == "named_def":
        return F.when(name == "<init>", "Constructor").when(has("Given"), "Given").otherwise("Method")
    if rule == "named_type":
        return F.when(has("Param"), "TypeParam").otherwise("TypeAlias")
    raise ValueError(f"unknown rule {rule!r}")


def keep_symbol(flags: Column, name: Column, level: str) -> Column:
    """Whether a symbol is one that its author wrote. Levels: class, method, field (access bits), named (flag names)."""
    if level == "class":
        simple = F.element_at(F.split(name, "/"), -1)
        return ~(_has(flags, SYNTHETIC) | simple.contains("$anon") | (simple == "package") | simple.startswith("$"))
    if level == "method":
        return ~(_has(flags, SYNTHETIC) | _has(flags, BRIDGE) | (name == "<clinit>") | name.contains("$default$") | name.startswith("$"))
    if level == "field":
        return ~_has(flags, SYNTHETIC)
    if level == "named":
        marked = F.array_contains(flags, "Synthetic") | F.array_contains(flags, "Artifact") | F.array_contains(flags, "Param") | F.array_contains(flags, "ModuleVal")
        return ~(marked | name.contains("$anon") | name.contains("$evidence") | name.startswith("$"))
    raise ValueError(f"unknown level {level!r}")


def parent_ids(super_name: Column, interfaces: Column) -> Column:
    """Rendered ids of the super class (unless it is the root object type) and the interfaces, in order."""
    none = F.lit(None).cast("string")
    names = F.filter(F.concat(F.array(super_name), F.coalesce(interfaces, F.array().cast("array<string>"))), lambda x: x.isNotNull() & (x != "java/lang/Object"))
    return F.transform(names, lambda x: render_symbol_id(parse_jvm_name(x, none, none, none)))


def semanticdb_kind(kind: Column) -> Column:
    """Kind from a SemanticDB kind; Val for all others."""
    out = F.when(kind == SEMANTICDB_KINDS[0][0], SEMANTICDB_KINDS[0][1])
    for theirs, ours in SEMANTICDB_KINDS[1:]:
        out = out.when(kind == theirs, ours)
    return out.otherwise("Val")


def simple_name(symbol: Column) -> Column:
    """Last non-empty token of a SemanticDB symbol, or all of it."""
    tokens = F.filter(F.split(F.regexp_replace(symbol, OVERLOAD, ""), "[/#.]"), lambda t: t != "")
    return F.coalesce(F.get(tokens, F.size(tokens) - 1), symbol)
