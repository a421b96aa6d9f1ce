"""The rule layer: a rule turns the nodes that a pattern matches into edits; a transform is the union of its rules."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.operators.patterns import Bits, label_bits, matched_groups, matches, parsed
from weftline.operators.tree import Pattern
from weftline.streaming.fixpoint import Registry, Transform

# The registered transforms and their priorities.
PRIORITIES = {
    "find-features": 99,
    "modify-functions": 26,
    "instantiate-template": 15,
    "replace-lambda": 10,
    "replace-decltype": 8,
    "gen-constructors-assignment": 5,
    "multiple-transforms": 4,
    "replace-rvalue": 2,
    "remove-auto-delegation": 1,
}
FINDER = "find-features"

# What each rule matches, in the language of ``patterns``. Capitals are kinds of nodes and their superkinds, other labels are properties that a parser gives
# a node: of its type (decltype_type, rvalue_type, alias_type: the type has such a part), of its default argument, underlying or destination type (def_, under_, dest_), or of itself.
_LIVE = "!above(FunctionTemplate & unspecialized) & !above(ClassTemplate & unspecialized)"
_MOVED = "(below(Method & move_assign & used) | below(Constructor & move & used))"
_IMPLICIT_MOVE = "Record & below(Constructor & move & used & implicit & !deleted)"
_TRAILING = "trailing_return & dependent_return"
_COPYABLE = "child(Constructor & copy & public & !deleted)"
_MOVEABLE = "child(Method & move_assign & public & user_provided & !deleted)"
_RVALUE_DECLARATOR = "Declarator & rvalue_subtype & !Function & !ParmVar & !(Var & rvalue_itself) & !implicit & !above(Function & implicit)"
_DECLTYPE_STMT = f"Expr & {_LIVE} & ((decltype_type & !Call) | (SizeOf & arg_decltype) | (ExplicitCast & dest_decltype))"
_DECLTYPE_DECL = f"Declarator & !above(Typedef) & !(ParmVar & above(Var)) & {_LIVE} & !((Function | FunctionTemplate) & !decltype_itself) & decltype_type"
_DECLTYPE_ARG = f"Declarator & !above(Typedef) & {_LIVE} & decltype_argument"
_DECLTYPE_TYPEDEF = f"Typedef & {_LIVE} & under_decltype"
_DECLTYPE_DEFAULT = "TypeParm & def_decltype"
_ANY_DECLTYPE_DECL = f"({_DECLTYPE_DECL}) | ({_DECLTYPE_ARG}) | ({_DECLTYPE_TYPEDEF}) | ({_DECLTYPE_DEFAULT})"
RULES: dict[str, dict[str, str]] = {
    "gen-constructors-assignment": {
        "default_constructors": f"Record & below(Constructor & default & implicit & !deleted) & {_MOVED}",
        "copy_constructors": f"Record & below(Constructor & copy & implicit & !deleted) & {_MOVED}",
        "move_constructors": _IMPLICIT_MOVE,
        "move_assignment": f"Record & (below(Method & move_assign & used & implicit & !deleted) | (({_MOVED} | ({_IMPLICIT_MOVE})) & !below(Method & move_assign & user_provided)))",
        "copy_assignment": "Record & (below(Method & copy_assign & used & implicit & !deleted) | ((below(Method & move_assign & used) | below(Method & move & used) | "
        f"({_IMPLICIT_MOVE})) & !below(Method & copy_assign & user_provided)))",
    },
    "remove-attributes": {"attributes": "Decl & attribute"},
    "instantiate-template": {
        "template_functions": f"FunctionTemplate & !unspecialized & !({_TRAILING}) & main_file & (below(Var & dependent & below(AutoType)) | below(Var & dependent & decltype_type) | "
        f"below({_DECLTYPE_STMT}) | below({_ANY_DECLTYPE_DECL}) | forwarding) & !variadic",
        "template_classes": f"ClassTemplate & !unspecialized & main_file & (below(Function & {_TRAILING}) | below(Var & dependent & below(AutoType)) | "
        f"below(Function & below(Declarator & decltype_type)) | below(Declarator & (decltype_type | decltype_argument | below(Declarator & decltype_type))) | below({_DECLTYPE_STMT}) | "
        f"below(({_ANY_DECLTYPE_DECL}) & !(TypeParm & !def_dependent))) & !variadic",
    },
    "modify-functions": {
        "auto_declarations": f"FunctionTemplate & {_TRAILING}",
        "auto_specializations": "Function & trailing_return & ref(FunctionTemplate & dependent_return) & declaration_only",
        "auto_calls": "Call & ref(Function & specialization & trailing_return & ref(FunctionTemplate & dependent_return))",
        "variadic_counts": "FunctionTemplate & variadic & below(Call & ref(Function | (FunctionTemplate & !variadic)))",
        "variadic_calls": "Call & ref(Function & ref(FunctionTemplate & variadic))",
        "variadic_final_calls": "FunctionTemplate & variadic & below(Call & ref(Function | (FunctionTemplate & !variadic)))",
        "variadic_templates": "FunctionTemplate & variadic",
    },
    "multiple-transforms": {
        "single_auto": f"DeclStmt & !parent(ForRange) & {_LIVE} & !instantiated & child(Var & !implicit) & single & below(AutoType)",
        "multiple_auto": f"DeclStmt & {_LIVE} & !instantiated & !single & child(Var & !implicit) & below(AutoType)",
        "global_auto": f"Var & {_LIVE} & !instantiated & !above(DeclStmt) & below(AutoType)",
        "suffix_types": f"Function & !above(FunctionTemplate & {_TRAILING}) & !(specialization & ref(FunctionTemplate & {_TRAILING})) & !instantiated & trailing_return",
        "alias_in_typedef": "Typedef & !instantiated & alias_type",
        "alias": "TypeAlias & !parent(TypeAliasTemplate) & !instantiated",
        "alias_variables": "Value & !above(Typedef) & !above(TypeAlias) & ((Field & !instantiated) | NonTypeParm | (Var & !instantiated & !(ParmVar & above(ParmVar | TypeParm | NonTypeParm)))) & alias_type",
        "alias_templates": "TypeAliasTemplate & !instantiated",
        "alias_returns": "Function & !instantiated & alias_return",
        "alias_arguments": "TypeParm & !instantiated & def_any & alias_type",
        "alias_expressions": "Expr & alias_type & !instantiated & !(New & above(New)) & (ExplicitCast | Temporary | Unresolved | New | SizeOf)",
        "alias_class_specializations": "ClassSpecialization & explicit & alias_type",
        "alias_function_specializations": "Function & explicit & alias_type",
        "alias_method_names": "Method & !instantiated & out_of_line & alias_scope",
        "range_loops": "ForRange & main_file & !instantiated",
        "constructor_initializers": "Constructor & user_provided & in_class_init",
        "record_initializers_without_constructor": "Record & !instantiated & !declared_constructor & in_class_init",
        "record_initializers": "Record & !instantiated & in_class_init",
    },
    "remove-auto-delegation": {
        "delegating_constructors": f"Constructor & {_LIVE} & user_provided & delegating",
        "auto_functions": "Function & !implicit & !explicit & !instantiated & !parent(FunctionTemplate) & !above(ClassTemplate & below(AutoType)) & main_file & (trailing_return | below(AutoType))",
        "auto_templates": "FunctionTemplate & main_file & !implicit & !above(ClassTemplate & below(AutoType)) & (trailing_return | below(AutoType))",
        "auto_classes": "ClassTemplate & main_file & below(AutoType)",
    },
    "replace-decltype": {
        "declarations": _DECLTYPE_DECL,
        "statements": _DECLTYPE_STMT,
        "template_arguments": _DECLTYPE_ARG,
        "typedefs": _DECLTYPE_TYPEDEF,
        "default_arguments": _DECLTYPE_DEFAULT,
    },
    "replace-lambda": {"lambdas": "Lambda & !instantiated", "lambdas_with_this": "Lambda & !instantiated & below(This)", "nested_lambdas": "Lambda & !instantiated & above(Lambda)"},
    "replace-rvalue": {
        "functions": "Function & (rvalue_parameter | rvalue_return) & !implicit",
        "moves": "Call & one_argument & move_callee & !parent(ImplicitCast)",
        "copy_assignments": f"Method & copy_assign & !implicit & parent(Record & {_COPYABLE} & {_MOVEABLE})",
        "copyable_and_moveable": f"Record & {_COPYABLE} & {_MOVEABLE}",
        "not_copyable_and_moveable": f"Record & (!{_COPYABLE} | child(Constructor & copy & deleted)) & {_MOVEABLE}",
        "copyable_and_not_moveable": f"Record & {_COPYABLE} & (!child(Method & move_assign & public & user_provided) | child(Method & move_assign & deleted))",
        "returned_values": "Return & below(ImplicitCast & xvalue) & declared_move & nontrivial",
        "temporaries": "Temporary & above(Materialize & xvalue) & ((declared_move & nontrivial) | !record_type) & !above(Return)",
        "casts": "ExplicitCast & dest_rvalue & !above(Decl & implicit)",
        "move_initializations": "Construct & ref(Constructor & move & user_provided) & (parent(Var) | parent(WithCleanups & parent(Var)))",
        "variables": "Var & !ParmVar & !implicit & rvalue_itself",
        "xvalue_casts": "ImplicitCast & child(Expr & xvalue) & !above(Decl & implicit)",
        "default_arguments": "TypeParm & def_rvalue",
        "typedefs": "Typedef & under_rvalue",
        "declarators": _RVALUE_DECLARATOR,
        "constructions": "Construct & rvalue_subtype",
        "specialization_arguments": "ClassSpecialization & rvalue_argument",
        "references": f"DeclRef & ref({_RVALUE_DECLARATOR})",
    },
}


def rule_matches(nodes: DataFrame, transforms: list[str] | None = None, bits: Bits = label_bits) -> DataFrame:
    """(id, transform, rule) of nodes (id, parent, ref, labels) that a rule of the transforms, by default of all, matches. All rules are evaluated together; ``bits`` as for ``matches``."""
    names = list(RULES) if transforms is None else transforms
    found = matches(nodes, {f"{t}/{r}": p for t in names for r, p in RULES[t].items()}, bits=bits)
    at = F.split("pattern", "/")
    return found.select("id", at[0].alias("transform"), at[1].alias("rule"))


def feature_queue(nodes: DataFrame, transforms: list[str] | None = None, bits: Bits = label_bits) -> DataFrame:
    """(transform, path): which transforms each file needs, of nodes with a column ``file``."""
    names = list(RULES) if transforms is None else transforms
    return matched_groups(nodes, {t: ("or", *map(parsed, RULES[t].values())) for t in names}, "file", bits).select(F.col("pattern").alias("transform"), F.col("file").alias("path"))


@dataclass
class Rule:
    """A pattern over nodes (id, parent, kind, name, file, start, end) and the text that takes a matched node's place.

    Without a text the rule only finds.
    """

    name: str
    pattern: Pattern
    text: Callable[[], Column] | None = None

    def matches(self, nodes: DataFrame) -> DataFrame:
        """The matched nodes."""
        return nodes.join(self.pattern(nodes), "id", "left_semi")

    def edits(self, nodes: DataFrame) -> DataFrame:
        """(file, start, end, text, rule) of each match."""
        new = F.lit(None).cast("string") if self.text is None else self.text()
        return self.matches(nodes).select("file", "start", "end", new.alias("text"), F.lit(self.name).alias("rule")).where(F.col("text").isNotNull())


def transform_edits(rules: list[Rule], nodes: DataFrame) -> DataFrame:
    """The distinct edits of all rules of a transform over one node table."""
    return reduce(DataFrame.unionByName, [r.edits(nodes) for r in rules]).distinct()


def find_features(rules: dict[str, list[Rule]], nodes: DataFrame) -> DataFrame:
    """(transform, path): which transforms each file needs, as some rule of theirs matches in it."""
    parts = [r.matches(nodes).select(F.lit(name).alias("transform"), F.col("file").alias("path")) for name, own in sorted(rules.items()) for r in own]
    return reduce(DataFrame.unionByName, parts).distinct()


def registry_of(rules: dict[str, list[Rule]], nodes: DataFrame) -> Registry:
    """Transforms for the fixpoint driver: the finder queues what it finds; each other runs its rules on its queued files.

    The node table is that of one parse and edits don't change it, so no transform asks for its files again.
    """
    registry = Registry()

    def among(queue: DataFrame) -> DataFrame:
        return nodes.join(queue.select(F.col("path").alias("file")), "file", "left_semi")

    def nothing(queue: DataFrame) -> DataFrame:
        return queue.select(F.lit("").alias("transform"), "path").where(F.lit(False))

    none = transform_edits([r for own in rules.values() for r in own], nodes.limit(0))
    registry.add(Transform(FINDER, PRIORITIES[FINDER], lambda q: (none, find_features(rules, among(q)))))
    for name, own in rules.items():
        registry.add(Transform(name, PRIORITIES.get(name, 10), lambda q, own=own: (transform_edits(own, among(q)), nothing(q))))
    return registry
