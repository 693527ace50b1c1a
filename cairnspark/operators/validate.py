"""Rule-based validators as joins over facts (``sources.facts``).

Every rule is a function from a ``Case`` to issue rows (unit, code, severity,
file_path, symbol, message). ``validated`` runs the rules of a block,
``report`` folds issues to one row per block and the verdict.
"""

from __future__ import annotations

import builtins
import sys
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import reduce
from threading import Lock

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tables import stored
from ..functions.text import type_name, types_fit
from . import dataflow
from .decisions import any_of
from .usage import verdict

ISSUE = "unit string, code string, severity string, file_path string, symbol string, message string"
# Fixtures that the test runner brings itself.
BUILTIN_FIXTURES = (
    "cache", "capfd", "capfdbinary", "caplog", "capsys", "capsysbinary", "doctest_namespace", "monkeypatch", "pytestconfig", "record_property",
    "record_testsuite_property", "record_xml_attribute", "recwarn", "request", "testdir", "pytester", "tmp_path", "tmp_path_factory", "tmpdir", "tmpdir_factory",
)
# Words of a request that what exists stays.
PRESERVE = ("сохран", "не менять", "не изменять", "preserve", "keep", "do not change")
BUILTINS = tuple(n for n in dir(builtins))
STDLIB = tuple(sorted(sys.stdlib_module_names))


@dataclass
class Case:
    """What rules read. ``request``: unit, operation, target (short name),
    parent (class of a method target or null), qualname, text, changed
    (array of files), target_file. ``before``, ``after`` and ``tests``: facts
    of the two versions and of the generated test. ``project``: (module,
    name) of all that project modules define; ``fields``: (type, field, note,
    required) of known classes; ``members``: (type, member)."""

    request: DataFrame
    before: DataFrame
    after: DataFrame
    tests: DataFrame
    project: DataFrame
    fields: DataFrame
    members: DataFrame
    _types: DataFrame | None = None
    _once: Lock = field(default_factory=Lock)

    def variable_types(self) -> DataFrame:
        """``dataflow.variable_types`` of the new version, worked out once for
        all rules that ask."""
        with self._once:
            if self._types is None:
                self._types = dataflow.variable_types(self.after)
            return self._types


#: Rules that are planned together. One plan of all rules has hundreds of
#: stages, and each that ends has the whole plan looked at again.
TOGETHER = 6
#: Groups of rules that are planned and run at once; planning is what takes time.
AT_ONCE = 8

Rule = Callable[[Case], DataFrame]
RULES: dict[str, tuple[str, str, Rule]] = {}


def rule(code: str, block: str, severity: str = "error"):
    def keep(f: Rule) -> Rule:
        RULES[code] = (block, severity, f)
        return f

    return keep


def of(facts: DataFrame, *kinds: str) -> DataFrame:
    return facts.where(F.col("fact").isin(*kinds))


def found(rows: DataFrame, symbol: str | Column, message: Column | None = None) -> DataFrame:
    s = F.col(symbol) if isinstance(symbol, str) else symbol
    path = F.col("file_path") if "file_path" in rows.columns else F.lit(None).cast("string")
    return rows.select("unit", path.alias("file_path"), s.cast("string").alias("symbol"), (message if message is not None else F.lit("")).alias("message")).distinct()


def missing(wanted: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    return wanted.join(known.select(*keys).distinct(), keys, "left_anti")


def units_without(request: DataFrame, rows: DataFrame) -> DataFrame:
    return request.join(rows.select("unit").distinct(), "unit", "left_anti")


def tops(facts: DataFrame) -> DataFrame:
    return of(facts, "definition").select("unit", "file_path", "name", "detail", "items")


def new_tops(c: Case) -> DataFrame:
    return missing(tops(c.after), tops(c.before), ["unit", "name"])


def replacing(c: Case) -> DataFrame:
    return c.request.where("operation = 'replace_symbol'")


def inserting(c: Case) -> DataFrame:
    return c.request.where("operation = 'insert_after_symbol'")


def with_request(facts: DataFrame, request: DataFrame) -> DataFrame:
    return facts.join(request, "unit")


# --- the patched file -------------------------------------------------------


@rule("patch_ast_parse_failed", "production")
def _(c):
    return found(of(c.before, "parse_error").unionByName(of(c.after, "parse_error")), "file_path", F.col("detail"))


@rule("target_file_not_changed", "production")
def _(c):
    return found(c.request.where(~F.coalesce(F.array_contains("changed", F.col("target_file")), F.lit(False))).withColumn("file_path", F.col("target_file")), "qualname")


@rule("target_symbol_missing_after_replace", "production")
def _(c):
    have = of(c.after, "definition").select("unit", F.col("name").alias("target"), F.lit("").alias("owner_")).unionByName(of(c.after, "method").select("unit", F.col("name").alias("target"), F.col("owner").alias("owner_")))
    wanted = replacing(c).withColumn("owner_", F.coalesce("parent", F.lit("")))
    return found(missing(wanted, have, ["unit", "target", "owner_"]), "qualname")


@rule("target_method_moved_to_module_level", "production")
def _(c):
    hit = with_request(tops(c.after), replacing(c).where("parent is not null")).where("name = target")
    return found(hit, "qualname")


@rule("method_anchor_missing_after_insert", "production")
def _(c):
    asked = inserting(c).where("parent is not null")
    was = of(c.before, "method").select("unit", F.col("name").alias("target"), F.col("owner").alias("parent"))
    now = of(c.after, "method").select("unit", F.col("name").alias("target"), F.col("owner").alias("parent"))
    return found(missing(asked.join(was, ["unit", "target", "parent"], "left_semi"), now, ["unit", "target", "parent"]), "qualname")


@rule("generated_method_missing_after_insert", "production")
def _(c):
    new = missing(of(c.after, "method"), of(c.before, "method"), ["unit", "owner", "name"]).select("unit", F.col("owner").alias("parent"))
    return found(missing(inserting(c).where("parent is not null"), new, ["unit", "parent"]), "qualname")


@rule("generated_symbol_scope_mismatch", "production")
def _(c):
    return found(with_request(new_tops(c).where("detail = 'function'"), inserting(c).where("parent is not null")), "name")


@rule("anchor_symbol_missing_after_insert", "production")
def _(c):
    return found(missing(inserting(c).where("parent is null"), tops(c.after).withColumnRenamed("name", "target"), ["unit", "target"]), "qualname")


@rule("no_new_top_level_symbol", "production")
def _(c):
    return found(units_without(inserting(c).where("parent is null"), new_tops(c)), "qualname")


def asks(*parts: str) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(F.lower(F.coalesce("text", F.lit(""))), F.lit(p)) for p in parts])


@rule("constraint_one_new_function_failed", "production")
def _(c):
    count = new_tops(c).where("detail = 'function'").groupBy("unit").agg(F.count("*").alias("_n"))
    return found(c.request.where(asks("one new function", "одну новую функцию")).join(count, "unit", "left").where("coalesce(_n, 0) <> 1"), "qualname")


@rule("existing_functions_removed", "production")
def _(c):
    gone = missing(tops(c.before).where("detail = 'function'"), tops(c.after), ["unit", "name"])
    return found(with_request(gone, c.request.where(asks("do not change existing functions", "не менять существующие функции"))), "name")


@rule("expected_dataclass_not_found", "production")
def _(c):
    return found(units_without(c.request.where(asks("only a dataclass", "только dataclass")), new_tops(c).where("detail = 'class'")), "qualname")


@rule("new_class_without_dataclass", "production")
def _(c):
    plain = new_tops(c).where("detail = 'class'").where(~F.exists(F.coalesce("items", F.array().cast("array<string>")), lambda d: d.endswith("dataclass")))
    return found(with_request(plain, c.request.where(asks("dataclass"))), "name")


@rule("duplicate_symbol_definition", "production")
def _(c):
    each = of(c.after, "definition", "method").groupBy("unit", "file_path", "owner", "name").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("line")).alias("lines"))
    return found(each.where("n > 1"), F.concat_ws(".", F.nullif("owner", F.lit("")), "name"), F.concat_ws(",", F.transform("lines", lambda x: x.cast("string"))))


@rule("missing_docstring_after_replace", "production")
def _(c):
    name = F.concat_ws(".", "parent", "target")
    doc = lambda f, flag: of(f, "docstring").select("unit", F.col("name").alias("_q"), F.col("detail").alias(flag))
    rows = replacing(c).withColumn("_q", name).join(doc(c.before, "_old"), ["unit", "_q"]).join(doc(c.after, "_new"), ["unit", "_q"])
    return found(rows.where("_old <> '' and _new = ''"), "qualname")


@rule("class_replacement_missing_existing_member", "production")
def _(c):
    asked = replacing(c).where("parent is null").select("unit", F.col("target").alias("owner"))
    was = of(c.before, "method").join(asked, ["unit", "owner"]).where("not startswith(name, '_') or name = '__init__'")
    return found(missing(was, of(c.after, "method"), ["unit", "owner", "name"]), F.concat_ws(".", "owner", "name"))


@rule("unknown_annotation_name", "production")
def _(c):
    known = of(c.after, "bind").select("unit", "name")
    return found(missing(of(c.after, "annotation").where(~F.col("name").isin(*BUILTINS)), known, ["unit", "name"]), "name")


@rule("unknown_runtime_name", "production")
def _(c):
    loads = of(c.after, "load").where(~F.col("name").isin(*BUILTINS, "self", "cls") & ~F.col("name").rlike("^__.*__$"))
    return found(missing(loads, of(c.after, "bind"), ["unit", "name"]), "name")


def own_members(facts: DataFrame) -> DataFrame:
    return of(facts, "known_attribute", "method", "field").select("unit", "owner", "name").distinct()


@rule("unknown_self_attribute", "production")
def _(c):
    return found(missing(of(c.after, "self_read"), own_members(c.after).unionByName(of(c.after, "self_call").select("unit", "owner", "name")), ["unit", "owner", "name"]), F.concat_ws(".", "owner", "name"))


@rule("unknown_self_attribute_assignment", "production")
def _(c):
    return found(missing(of(c.after, "self_write"), own_members(c.after), ["unit", "owner", "name"]), F.concat_ws(".", "owner", "name"))


@rule("unknown_self_method", "production")
def _(c):
    calls = of(c.after, "self_call").where(~F.col("name").rlike("^__.*__$"))
    return found(missing(calls, own_members(c.after), ["unit", "owner", "name"]), F.concat_ws(".", "owner", "name"))


def signed_calls(c: Case) -> DataFrame:
    """Calls of own methods with the method's signature; open ones aside."""
    sign = of(c.after, "signature").select("unit", "owner", "name", F.filter(F.split("detail", ","), lambda x: x != "").alias("required"), F.col("items").alias("allowed"))
    closed = missing(sign, of(c.after, "open_signature"), ["unit", "owner", "name"])
    return of(c.after, "self_call").where("detail <> 'star'").join(closed, ["unit", "owner", "name"])


@rule("self_method_call_missing_required_args", "production")
def _(c):
    rows = signed_calls(c).withColumn("_left", F.array_except(F.slice("required", F.col("n") + 1, F.greatest(F.size("required") - F.col("n"), F.lit(0))), F.coalesce("items", F.array().cast("array<string>"))))
    return found(rows.where(F.size("_left") > 0), F.concat_ws(".", "owner", "name"), F.array_join("_left", ","))


@rule("self_method_call_unknown_keyword_arg", "production")
def _(c):
    rows = signed_calls(c).withColumn("_odd", F.array_except("items", "allowed"))
    return found(rows.where(F.size("_odd") > 0), F.concat_ws(".", "owner", "name"), F.array_join("_odd", ","))


@rule("self_method_call_missing_required_keyword_only_args", "production")
def _(c):
    need = of(c.after, "method_keywords").select("unit", "owner", "name", F.col("items").alias("_need"))
    rows = of(c.after, "self_call").where("detail <> 'star'").join(need, ["unit", "owner", "name"]).withColumn("_left", F.array_except("_need", F.coalesce("items", F.array().cast("array<string>"))))
    return found(rows.where(F.size("_left") > 0), F.concat_ws(".", "owner", "name"), F.array_join("_left", ","))


def constructions(facts: DataFrame) -> DataFrame:
    return of(facts, "call").where("detail <> 'star'").withColumn("type", F.element_at(F.split("name", r"\."), -1))


def field_sets(c: Case) -> DataFrame:
    return c.fields.groupBy("type").agg(F.collect_set("field").alias("_all"), F.count_if("required").alias("_n"))


@rule("unknown_model_constructor_keyword", "production")
def _(c):
    rows = constructions(c.after).join(field_sets(c), "type").withColumn("_odd", F.array_except("items", "_all"))
    return found(rows.where(F.size("_odd") > 0), "type", F.array_join("_odd", ","))


@rule("dict_return_uses_dunder_dict", "production")
def _(c):
    return found(of(c.after, "dunder_dict_return").where(F.lower("detail").rlike(r"^(typing\.)?(dict|mapping)")), "name")


@rule("preserved_dict_key_removed", "production")
def _(c):
    asked = c.request.where(asks("preserve", "сохранить")).select("unit", "text")
    gone = missing(of(c.before, "dict_key"), of(c.after, "dict_key"), ["unit", "owner", "name"]).join(asked, "unit")
    return found(gone, F.concat_ws(".", F.nullif("owner", F.lit("")), "name"))


@rule("possible_existing_method_contract_lost", "production", "warning")
def _(c):
    return found(missing(of(c.before, "exception"), of(c.after, "exception"), ["unit", "owner", "name"]), F.concat_ws(":", "owner", "name"))


@rule("unused_import_change", "production", "warning")
def _(c):
    added = missing(of(c.after, "import", "import_from"), of(c.before, "import", "import_from"), ["unit", "name"])
    bound = added.withColumn("name", F.when(F.col("fact") == "import", F.col("detail")).otherwise(F.col("name")))
    return found(missing(bound, of(c.after, "load", "annotation"), ["unit", "name"]), "name")


@rule("unresolved_import_change_module", "production")
def _(c):
    added = missing(of(c.after, "import_from").where("n = 0"), of(c.before, "import_from"), ["unit", "detail"])
    root = F.element_at(F.split("detail", r"\."), 1)
    roots = c.project.select(F.element_at(F.split("module", r"\."), 1).alias("_root")).distinct()
    return found(added.withColumn("_root", root).where(~F.col("_root").isin(*STDLIB)).join(roots, "_root", "left_anti"), "detail")


@rule("unresolved_import_change_name", "production")
def _(c):
    added = missing(of(c.after, "import_from").where("n = 0 and name <> '*'"), of(c.before, "import_from"), ["unit", "detail", "name"]).withColumn("module", F.col("detail"))
    there = added.join(c.project.select("module").distinct(), "module", "left_semi")
    return found(missing(there, c.project, ["module", "name"]), F.concat_ws(".", "module", "name"))


@rule("unknown_model_attribute", "production")
def _(c):
    reads = of(c.after, "attribute_read").where("not startswith(name, '_')").withColumn("_var", F.col("detail")).join(instances(c.after), ["unit", "owner", "_var"])
    known = c.fields.select("type", F.col("field").alias("name")).unionByName(c.members.select("type", F.col("member").alias("name")))
    return found(missing(reads.join(c.fields.select("type").distinct(), "type", "left_semi"), known, ["type", "name"]), F.concat_ws(".", "type", "name"))


@rule("unknown_injected_dependency_method", "production")
def _(c):
    calls = of(c.after, "call").withColumn("_p", F.split("name", r"\.")).where((F.size("_p") == 3) & (F.element_at("_p", 1) == "self"))
    calls = calls.select("unit", "file_path", F.element_at(F.split("owner", r"\."), 1).alias("_class"), F.element_at("_p", 2).alias("_attr"), F.element_at("_p", 3).alias("member"))
    types = of(c.after, "attribute_type").select("unit", F.col("owner").alias("_class"), F.col("name").alias("_attr"), F.col("detail").alias("type"))
    owned = calls.join(types, ["unit", "_class", "_attr"]).join(c.members.select("type").distinct(), "type", "left_semi")
    return found(missing(owned, c.members, ["type", "member"]), F.concat_ws(".", "type", "member"))


@rule("required_contract_not_used", "production")
def _(c):
    if "contracts" not in c.request.columns:
        return found(c.request.limit(0), "qualname")
    asked = c.request.select("unit", F.explode("contracts").alias("_full")).withColumn("_u", F.element_at(F.split("_full", r"\."), -1))
    return found(missing(asked, used_names(c.after), ["unit", "_u"]), "_full")


@rule("contract_method_called_on_class_instead_of_instance", "production")
def _(c):
    return found(class_calls(c.after, c), F.concat_ws(".", "type", "member"))


def function_calls(c: Case) -> DataFrame:
    """Calls of functions of the patched module with their signatures."""
    own = of(c.after, "function_signature").select("unit", "name", F.filter(F.split("detail", ","), lambda x: x != "").alias("required"), F.col("items").alias("allowed"))
    closed = missing(own, of(c.after, "open_signature").where("owner = ''"), ["unit", "name"])
    return of(c.after, "call").where("detail = ''").join(closed, ["unit", "name"])


@rule("contract_call_missing_required_positional_args", "production")
def _(c):
    rows = function_calls(c).withColumn("_left", F.array_except(F.slice("required", F.col("n") + 1, F.greatest(F.size("required") - F.col("n"), F.lit(0))), "items"))
    return found(rows.where(F.size("_left") > 0), "name", F.array_join("_left", ","))


@rule("contract_call_missing_required_keyword_only_args", "production")
def _(c):
    need = of(c.after, "required_keywords").select("unit", "name", F.col("items").alias("_need"))
    rows = function_calls(c).join(need, ["unit", "name"]).withColumn("_left", F.array_except("_need", "items"))
    return found(rows.where(F.size("_left") > 0), "name", F.array_join("_left", ","))


@rule("duplicated_import_change_with_local_import", "production", "warning")
def _(c):
    added = missing(of(c.after, "import_from").where("owner = ''"), of(c.before, "import_from"), ["unit", "name"])
    return found(added.join(of(c.after, "local_import").select("unit", "name").distinct(), ["unit", "name"], "left_semi"), "name")


def class_calls(facts: DataFrame, c: Case) -> DataFrame:
    """Calls of a known type's method on the type itself."""
    rows = of(facts, "call").withColumn("_p", F.split("name", r"\.")).where(F.size("_p") >= 2).withColumn("type", F.element_at("_p", -2)).withColumn("member", F.element_at("_p", -1))
    free = of(facts, "method").where(F.exists("items", lambda d: d.isin("staticmethod", "classmethod"))).select(F.col("owner").alias("type"), F.col("name").alias("member")).distinct()
    return rows.join(c.members, ["type", "member"], "left_semi").join(free, ["type", "member"], "left_anti")


# --- the artefact of a replacement ------------------------------------------


@rule("replace_symbol_artifact_must_contain_single_symbol", "artifact")
def _(c):
    count = tops(c.after).groupBy("unit").agg(F.count("*").alias("_n"))
    return found(replacing(c).join(count, "unit", "left").where("coalesce(_n, 0) <> 1"), "qualname")


@rule("replace_symbol_artifact_target_name_mismatch", "artifact")
def _(c):
    one = tops(c.after).groupBy("unit").agg(F.count("*").alias("_n"), F.min("name").alias("_name")).where("_n = 1")
    return found(replacing(c).join(one, "unit").where("_name <> target"), "_name")


@rule("replace_symbol_artifact_contains_nested_symbol", "artifact")
def _(c):
    return found(with_request(of(c.after, "nested_definition"), replacing(c)), F.concat_ws(".", "owner", "name"))


@rule("code_artifact_missing_code", "artifact")
def _(c):
    return found(c.request.join(c.after.select("unit").distinct(), "unit", "left_anti"), "qualname")


@rule("code_artifact_ast_parse_failed", "artifact")
def _(c):
    return found(of(c.after, "parse_error"), "file_path", F.col("detail"))


@rule("code_artifact_unexpected_operation", "artifact")
def _(c):
    if "expected_operation" not in c.request.columns:
        return found(c.request.limit(0), "qualname")
    return found(c.request.where("expected_operation <> operation"), "operation")


@rule("code_artifact_unexpected_target", "artifact")
def _(c):
    if "expected_qualname" not in c.request.columns:
        return found(c.request.limit(0), "qualname")
    return found(c.request.where("expected_qualname <> qualname"), "qualname")


# --- the generated test -----------------------------------------------------


@rule("generated_test_file_missing", "generated_test")
def _(c):
    if "test_file" not in c.request.columns:
        return found(c.request.limit(0), "qualname")
    return found(c.request.where("test_file is not null").join(c.tests.select("unit").distinct(), "unit", "left_anti"), "test_file")


@rule("generated_test_calls_project_instance_method_on_class", "generated_test")
def _(c):
    rows = class_calls(c.tests, c).join(replacing(c).select("unit", F.col("parent").alias("type"), F.col("target").alias("member")), ["unit", "type", "member"], "left_anti")
    return found(rows, F.concat_ws(".", "type", "member"))


@rule("generated_test_constructor_argument_type_mismatch", "generated_test")
def _(c):
    paths = c.fields.where(F.element_at(F.split(F.regexp_replace("note", r"\[.*$", ""), r"\."), -1).isin("Path", "PurePath"))
    rows = of(c.tests, "string_keyword").select("unit", "file_path", F.col("detail").alias("type"), F.col("name").alias("field"))
    return found(rows.join(paths.select("type", "field").distinct(), ["type", "field"], "left_semi"), F.concat_ws(".", "type", "field"))


@rule("generated_test_ast_parse_failed", "generated_test")
def _(c):
    return found(of(c.tests, "parse_error"), "file_path", F.col("detail"))


@rule("generated_test_has_no_test_functions", "generated_test")
def _(c):
    return found(c.request.join(c.tests.select("unit").distinct(), "unit", "left_semi").join(of(c.tests, "definition", "method").where("startswith(name, 'test_')").select("unit"), "unit", "left_anti"), "qualname")


@rule("generated_test_has_no_assertions", "generated_test")
def _(c):
    return found(c.request.join(c.tests.select("unit").distinct(), "unit", "left_semi").join(of(c.tests, "assertion", "raises").select("unit"), "unit", "left_anti"), "qualname")


@rule("generated_test_only_trivial_asserts", "generated_test")
def _(c):
    kinds = of(c.tests, "assertion", "raises").groupBy("unit").agg(F.bool_and((F.col("fact") == "assertion") & (F.col("name") == "trivial")).alias("_t"))
    return found(c.request.join(kinds.where("_t"), "unit"), "qualname")


@rule("generated_test_uses_unresolved_name", "generated_test")
def _(c):
    loads = of(c.tests, "load").where(~F.col("name").isin(*BUILTINS) & ~F.col("name").rlike("^__.*__$"))
    return found(missing(loads, of(c.tests, "bind"), ["unit", "name"]), "name")


@rule("generated_test_imports_pytest_mock", "generated_test")
def _(c):
    module = F.when(F.col("fact") == "import", F.col("name")).otherwise(F.col("detail"))
    return found(of(c.tests, "import", "import_from").withColumn("_m", module).where("_m = 'pytest_mock' or startswith(_m, 'pytest_mock.')"), "_m")


@rule("generated_test_uses_mocker_fixture", "generated_test")
def _(c):
    return found(of(c.tests, "fixture_use", "load").where("name = 'mocker'"), "name")


@rule("generated_test_uses_unapproved_external_pytest_fixture", "generated_test")
def _(c):
    local = of(c.tests, "definition").where(F.exists("items", lambda d: d.endswith("fixture"))).select("unit", "name")
    return found(missing(of(c.tests, "fixture_use").where(~F.col("name").isin(*BUILTIN_FIXTURES)), local, ["unit", "name"]), "name")


@rule("generated_test_import_points_to_missing_module", "generated_test")
def _(c):
    roots = c.project.select(F.element_at(F.split("module", r"\."), 1).alias("_root")).distinct()
    imports = of(c.tests, "import_from").withColumn("module", F.col("detail")).withColumn("_root", F.element_at(F.split("detail", r"\."), 1))
    return found(missing(imports.join(roots, "_root", "left_semi"), c.project, ["module"]), "module")


@rule("generated_test_imports_missing_project_name", "generated_test")
def _(c):
    imports = of(c.tests, "import_from").where("name <> '*'").withColumn("module", F.col("detail")).join(c.project.select("module").distinct(), "module", "left_semi")
    return found(missing(imports, c.project, ["module", "name"]), F.concat_ws(".", "module", "name"))


@rule("generated_test_patch_target_missing_project_attribute", "generated_test")
def _(c):
    rows = of(c.tests, "patch_target").withColumn("_p", F.split("name", r"\.")).where(F.size("_p") > 1)
    each = rows.withColumn("_n", F.explode(F.sequence(F.lit(1), F.size("_p") - 1)))
    each = each.withColumn("module", F.array_join(F.slice("_p", F.lit(1), F.col("_n")), ".")).join(c.project.select("module").distinct(), "module", "left_semi")
    longest = each.groupBy("unit", "file_path", "name", "_p").agg(F.max("_n").alias("_n"))
    wanted = longest.select("unit", "file_path", F.col("name").alias("_full"), F.array_join(F.slice("_p", F.lit(1), F.col("_n")), ".").alias("module"), F.element_at("_p", F.col("_n") + 1).alias("name"))
    return found(missing(wanted, c.project, ["module", "name"]), "_full")


@rule("generated_test_uses_project_class_new", "generated_test")
def _(c):
    rows = of(c.tests, "call").where("endswith(name, '.__new__')").withColumn("type", F.element_at(F.split("name", r"\."), -2))
    return found(rows.join(c.members.select("type").distinct(), "type", "left_semi"), "type")


@rule("generated_test_uses_unknown_constructor_keyword", "generated_test")
def _(c):
    rows = constructions(c.tests).join(field_sets(c), "type").withColumn("_odd", F.array_except("items", "_all"))
    return found(rows.where(F.size("_odd") > 0), "type", F.array_join("_odd", ","))


@rule("generated_test_missing_required_constructor_argument", "generated_test")
def _(c):
    need = c.fields.where("required").groupBy("type").agg(F.collect_set("field").alias("_need"))
    rows = constructions(c.tests).join(need, "type").withColumn("_left", F.array_except("_need", "items"))
    return found(rows.where(F.size("_left") > F.col("n")), "type", F.array_join(F.array_sort("_left"), ","))


def instances(facts: DataFrame) -> DataFrame:
    return of(facts, "instance").select("unit", "owner", F.col("name").alias("_var"), F.element_at(F.split("detail", r"\."), -1).alias("type"))


@rule("generated_test_calls_unknown_project_method", "generated_test")
def _(c):
    calls = of(c.tests, "call").withColumn("_p", F.split("name", r"\.")).where(F.size("_p") == 2).withColumn("_var", F.element_at("_p", 1)).withColumn("member", F.element_at("_p", 2))
    owned = calls.join(instances(c.tests), ["unit", "owner", "_var"]).join(c.members.select("type").distinct(), "type", "left_semi")
    return found(missing(owned, c.members, ["type", "member"]), F.concat_ws(".", "type", "member"))


@rule("generated_test_assigns_project_model_field_after_construction", "generated_test")
def _(c):
    rows = of(c.tests, "attribute_write").withColumn("_var", F.col("detail")).join(instances(c.tests), ["unit", "owner", "_var"]).withColumn("field", F.col("name"))
    return found(rows.join(c.fields.select("type", "field").distinct(), ["type", "field"], "left_semi"), F.concat_ws(".", "type", "field"))


@rule("generated_test_assigns_unknown_project_attribute", "generated_test")
def _(c):
    rows = of(c.tests, "attribute_write").withColumn("_var", F.col("detail")).join(instances(c.tests), ["unit", "owner", "_var"]).withColumn("member", F.col("name"))
    known = c.members.select("type", "member").unionByName(c.fields.select("type", F.col("field").alias("member")))
    return found(missing(rows.join(c.members.select("type").distinct(), "type", "left_semi"), known, ["type", "member"]), F.concat_ws(".", "type", "member"))


@rule("generated_test_instantiates_target_parent_class", "generated_test")
def _(c):
    return found(with_request(constructions(c.tests), replacing(c).where("parent is not null")).where("type = parent"), "parent")


@rule("generated_test_unnecessary_parent_instance_for_selfless_target", "generated_test")
def _(c):
    free = of(c.after, "selfless").select("unit", F.col("owner").alias("parent"), F.col("name").alias("target"))
    rows = with_request(constructions(c.tests), replacing(c).where("parent is not null").join(free, ["unit", "parent", "target"], "left_semi"))
    return found(rows.where("type = parent"), "parent")


def used_names(facts: DataFrame) -> DataFrame:
    called = of(facts, "call").select("unit", F.element_at(F.split("name", r"\."), -1).alias("_u"))
    return called.unionByName(of(facts, "assertion").select("unit", F.explode("items").alias("_u"))).distinct()


def mentioned(facts: DataFrame) -> DataFrame:
    every = of(facts, "load", "import_from", "call", "fixture_use").select("unit", F.explode(F.split("name", r"\.")).alias("_u"))
    return every.distinct()


def target_names(c: Case) -> DataFrame:
    return replacing(c).select("unit", F.when(F.col("target") == "__init__", F.col("parent")).otherwise(F.col("target")).alias("_u"), "qualname")


def tested(c: Case) -> DataFrame:
    return c.tests.select("unit").distinct()


@rule("generated_test_does_not_reference_target_name", "generated_test")
def _(c):
    return found(missing(target_names(c).join(tested(c), "unit"), mentioned(c.tests), ["unit", "_u"]), "_u")


@rule("generated_test_imports_target_but_does_not_use_it", "generated_test")
def _(c):
    imported = of(c.tests, "import_from").select("unit", F.col("name").alias("_u"))
    return found(missing(target_names(c).join(imported, ["unit", "_u"], "left_semi"), used_names(c.tests), ["unit", "_u"]), "_u")


@rule("generated_test_does_not_use_target_symbol", "generated_test")
def _(c):
    return found(missing(target_names(c).join(tested(c), "unit"), used_names(c.tests), ["unit", "_u"]), "_u")


def new_names(c: Case) -> DataFrame:
    return new_tops(c).select("unit", F.col("name").alias("_u")).join(inserting(c).select("unit"), "unit").join(tested(c), "unit")


@rule("generated_test_does_not_reference_new_symbol_name", "generated_test")
def _(c):
    hit = new_names(c).join(mentioned(c.tests), ["unit", "_u"], "left_semi")
    return found(inserting(c).join(new_names(c).select("unit").distinct(), "unit", "left_semi").join(hit.select("unit").distinct(), "unit", "left_anti"), "qualname")


@rule("generated_test_does_not_use_new_symbol", "generated_test")
def _(c):
    hit = new_names(c).join(used_names(c.tests), ["unit", "_u"], "left_semi")
    return found(inserting(c).join(new_names(c).select("unit").distinct(), "unit", "left_semi").join(hit.select("unit").distinct(), "unit", "left_anti"), "qualname")


# --- relevance of the generated test ------------------------------------------


def test_texts(c: Case) -> DataFrame:
    """The tests' texts that parse, with their request."""
    return with_request(of(c.tests, "text").select("unit", F.col("detail").alias("_text")), c.request)


def in_text(name: Column) -> Column:
    return F.contains("_text", F.lower(name))


def own_names(c: Case) -> DataFrame:
    """(unit, _u): the target's names, a constructor's class among them."""
    names = F.array_compact(F.array(F.col("target"), F.when(F.col("target") == "__init__", F.col("parent"))))
    return c.request.select("unit", F.explode(names).alias("_u"))


def added_names(c: Case) -> DataFrame:
    new = new_tops(c).select("unit", F.col("name").alias("_u")).join(inserting(c).select("unit", "target"), "unit")
    return new.where("_u <> target").drop("target")


@rule("generated_test_ast_parse_failed_for_relevance", "generated_test_relevance")
def _(c):
    return found(of(c.tests, "parse_error"), "file_path", F.col("detail"))


@rule("generated_test_not_relevant", "generated_test_relevance")
def _(c):
    texts = test_texts(c)
    named = texts.join(own_names(c).unionByName(added_names(c)), "unit").where(in_text(F.col("_u")))
    return found(texts.join(named.select("unit").distinct(), "unit", "left_anti"), "qualname")


@rule("generated_test_does_not_reference_new_symbol", "generated_test_relevance")
def _(c):
    texts, new = test_texts(c), added_names(c)
    named = texts.join(new, "unit").where(in_text(F.col("_u")))
    return found(texts.join(new.select("unit").distinct(), "unit", "left_semi").join(named.select("unit").distinct(), "unit", "left_anti"), "qualname")


@rule("generated_test_does_not_reference_target_symbol", "generated_test_relevance")
def _(c):
    texts = test_texts(c).where("operation <> 'insert_after_symbol'")
    named = texts.join(own_names(c), "unit").where(in_text(F.col("_u")))
    return found(texts.join(named.select("unit").distinct(), "unit", "left_anti"), "target")


# --- types, values and contracts ----------------------------------------------

# Types that a visible value may have.
PATH_LIKE = ("Path", "PurePath", "PurePosixPath", "PureWindowsPath", "PathLike")
NUMBERS = ("int", "float", "Decimal", "complex", "Fraction")
PLAIN = ("str", "int", "float", "bool", "bytes", "Any", "object", "")
CONCRETE = ("str", "int", "float", "bool", "bytes", "list", "dict", "set", "tuple", "Path", "datetime")
DICT_LIKE = ("dict", "Mapping", "MutableMapping", "TypedDict", "defaultdict", "OrderedDict", "Any", "object", "")


def empty(c: Case) -> DataFrame:
    return found(c.request.limit(0), "qualname")


def dependency_types(c: Case) -> DataFrame:
    """(unit, owner, dep, type) of the dependencies that constructors keep."""
    return of(c.after, "attribute_type").select("unit", "owner", F.col("name").alias("dep"), F.col("detail").alias("type")).distinct()


def visible_type(c: Column) -> Column:
    """A note's bare type; blank where it may be None or several types."""
    open_ = F.contains(c, F.lit("None")) | F.contains(c, F.lit("Optional")) | F.contains(c, F.lit("|")) | F.contains(c, F.lit("Union"))
    return F.when(open_, "").otherwise(type_name(c))


@rule("unknown_injected_dependency_attribute", "production")
def _(c):
    known = c.fields.select("type", F.col("field").alias("member")).unionByName(c.members).distinct()
    reads = of(c.after, "dependency_read").select("unit", "file_path", "owner", F.col("name").alias("dep"), F.col("detail").alias("member"))
    typed = reads.join(dependency_types(c), ["unit", "owner", "dep"]).join(known.select("type").distinct(), "type", "left_semi")
    calls = of(c.after, "call").select("unit", F.col("name").alias("_c")).distinct()
    typed = typed.withColumn("_c", F.concat(F.lit("self."), "dep", F.lit("."), "member")).join(calls, ["unit", "_c"], "left_anti")  # calls have a rule of their own
    wrong = found(typed.join(known, ["type", "member"], "left_anti"), F.concat_ws(".", "type", "member"))
    attributes = of(c.after, "known_attribute", "method").select("unit", "owner", "name").distinct()
    private = missing(of(c.after, "self_read").where("startswith(name, '_') and not startswith(name, '__')"), attributes, ["unit", "owner", "name"])
    public = dependency_types(c).select("unit", "owner", F.concat(F.lit("_"), "dep").alias("name"))
    return wrong.unionByName(found(private.join(public, ["unit", "owner", "name"], "left_semi"), F.concat_ws(".", "owner", "name")))


@rule("incompatible_operator_for_visible_type", "production")
def _(c):
    rows = of(c.after, "division").select("unit", "file_path", "owner", F.col("name").alias("dep"), F.col("detail").alias("field")).join(dependency_types(c), ["unit", "owner", "dep"])
    typed = rows.join(c.fields.select("type", "field", visible_type(F.col("note")).alias("_t")).distinct(), ["type", "field"])
    return found(typed.where((F.col("_t") != "") & ~F.col("_t").isin(*PATH_LIKE, *NUMBERS)), F.concat_ws(".", "type", "field"), F.col("_t"))


def fitting(expected: Column, actual: Column) -> Column:
    """Equal or unknown types, whole numbers as floats and truth values as
    whole numbers."""
    return types_fit(expected, actual) | ((expected == "float") & (actual == "int")) | ((expected == "int") & (actual == "bool"))


def misfits(c: Case, uses: DataFrame, expected: DataFrame, on: list[str], keys: list[str]) -> DataFrame:
    """Values through variables (keys, owner, value) none of whose types fits
    the ``expected`` (on, _t): with ``_t`` and ``_a``, the types it has. A
    value with a type that is not known is left alone."""
    types = c.variable_types().withColumnRenamed("name", "value")
    rows = uses.join(expected.where(F.col("_t").isin(*CONCRETE)), on).join(types, ["unit", "file_path", "owner", "value"])
    wrong = (F.col("type") != dataflow.UNKNOWN) & ~fitting(F.col("_t"), F.col("type"))
    each = rows.groupBy(*keys, "value", "_t").agg(F.bool_and(wrong).alias("_wrong"), F.array_join(F.array_sort(F.collect_set("type")), " or ").alias("_a"))
    return each.where("_wrong").drop("_wrong", "value")


@rule("model_constructor_field_type_mismatch", "production")
def _(c):
    fields = c.fields.select("type", "field", visible_type(F.col("note")).alias("_t")).distinct()
    values = of(c.after, "value_type").select("unit", "file_path", F.col("detail").alias("type"), F.col("name").alias("field"), F.col("items")[0].alias("_a"))
    typed = values.join(fields, ["type", "field"]).where(F.col("_t").isin(*CONCRETE) & ~fitting(F.col("_t"), F.col("_a")))
    uses = of(c.after, "value_flow").select("unit", "file_path", "owner", F.col("detail").alias("type_"), F.col("name").alias("field"), F.col("items")[0].alias("value"))
    through = misfits(c, uses, fields.withColumnRenamed("type", "type_"), ["type_", "field"], ["unit", "file_path", "type_", "field"]).withColumnRenamed("type_", "type")
    rows = typed.select("unit", "file_path", "type", "field", "_a", "_t").unionByName(through.select("unit", "file_path", "type", "field", "_a", "_t"))
    return found(rows, F.concat_ws(".", "type", "field"), F.concat_ws(" for ", "_a", "_t"))


@rule("model_constructor_default_field_overridden_with_none", "production")
def _(c):
    values = of(c.after, "none_value").select("unit", "file_path", F.col("detail").alias("type"), F.col("name").alias("field"))
    typed = values.join(c.fields.where(~F.col("required")).select("type", "field", visible_type(F.col("note")).alias("_t")).distinct(), ["type", "field"])
    return found(typed.where(~F.col("_t").isin(*PLAIN)), F.concat_ws(".", "type", "field"), F.col("_t"))


@rule("unresolved_remove_import_change", "production")
def _(c):
    if "removed_imports" not in c.request.columns:
        return empty(c)
    lines = c.request.select("unit", "qualname", F.explode(F.coalesce("removed_imports", F.array().cast("array<string>"))).alias("_l"))
    module, names = F.regexp_extract("_l", r"^\s*from\s+(\S+)\s+import\s", 1), F.regexp_extract("_l", r"import\s+(.+)$", 1)
    each = lines.select("unit", "qualname", "_l", module.alias("_m"), F.explode(F.transform(F.split(names, ","), lambda x: F.trim(F.regexp_replace(x, r"\s+as\s+.*$", "")))).alias("_x"))
    have = of(c.before, "import").select("unit", F.lit("").alias("_m"), F.col("name").alias("_x")).unionByName(of(c.before, "import_from").select("unit", F.concat(F.expr("repeat('.', coalesce(n, 0))"), "detail").alias("_m"), F.col("name").alias("_x")))
    return found(missing(each, have, ["unit", "_m", "_x"]), "qualname", F.col("_l"))


def contract_names(c: Case) -> DataFrame:
    """(unit, name): functions that the request names as contracts."""
    if "contracts" not in c.request.columns:
        return c.request.limit(0).select("unit", F.lit("").alias("name"))
    return c.request.select("unit", F.explode(F.coalesce("contracts", F.array().cast("array<string>"))).alias("_c")).select("unit", F.element_at(F.split("_c", r"\."), -1).alias("name")).distinct()


@rule("contract_call_argument_type_mismatch", "production")
def _(c):
    notes = of(c.after, "argument_types").unionByName(of(c.before, "argument_types")).where("owner = ''").select("unit", "name", F.posexplode("items").alias("n", "_note")).distinct()
    notes = notes.withColumn("_t", visible_type(F.col("_note"))).drop("_note")
    given = of(c.after, "argument_type").select("unit", "file_path", "name", "n", F.col("detail").alias("_a"))
    rows = given.join(notes, ["unit", "name", "n"]).where(F.col("_t").isin(*CONCRETE) & ~fitting(F.col("_t"), F.col("_a")))
    uses = of(c.after, "argument_flow").select("unit", "file_path", "owner", "name", "n", F.col("detail").alias("value"))
    through = misfits(c, uses.withColumnRenamed("name", "called"), notes.withColumnRenamed("name", "called"), ["unit", "called", "n"], ["unit", "file_path", "called", "n"]).withColumnRenamed("called", "name")
    rows = rows.select("unit", "file_path", "name", "_a", "_t").unionByName(through.select("unit", "file_path", "name", "_a", "_t"))
    return found(rows, "name", F.concat_ws(" for ", "_a", "_t"))


@rule("contract_call_uses_unrequested_literal_arg", "production")
def _(c):
    given = of(c.after, "literal_argument").select("unit", "file_path", "name", F.col("detail").alias("_l")).join(contract_names(c), ["unit", "name"], "left_semi")
    rows = given.join(c.request.select("unit", F.lower(F.coalesce("text", F.lit(""))).alias("_q")), "unit").where((F.col("_l") != "") & ~F.contains("_q", F.lower("_l")))
    return found(rows, "name", F.col("_l"))


@rule("dict_return_annotation_returns_contract_object", "production")
def _(c):
    known = of(c.after, "returns").unionByName(of(c.before, "returns")).where("owner = '' and detail <> ''").select("unit", "name", visible_type(F.col("detail")).alias("_t")).distinct()
    calls = of(c.after, "returned_call").where(F.contains(F.lower("detail"), F.lit("dict"))).select("unit", "file_path", "name", "owner")
    return found(calls.join(known, ["unit", "name"]).where(~F.col("_t").isin(*DICT_LIKE)), "owner", F.concat_ws(" of ", "_t", "name"))


@rule("unknown_contract_result_attribute", "production")
def _(c):
    known = c.fields.select("type", F.col("field").alias("member")).unionByName(c.members).distinct()
    results = of(c.after, "returns").unionByName(of(c.before, "returns")).where("owner = '' and detail <> ''").select("unit", F.col("name").alias("_f"), visible_type(F.col("detail")).alias("type")).distinct()
    values = of(c.after, "instance").select("unit", "owner", F.col("name").alias("_v"), F.element_at(F.split("detail", r"\."), -1).alias("_f")).join(results, ["unit", "_f"])
    reads = of(c.after, "attribute_read").select("unit", "file_path", "owner", F.col("detail").alias("_v"), F.col("name").alias("member")).join(values, ["unit", "owner", "_v"])
    visible = reads.join(known.select("type").distinct(), "type", "left_semi")
    return found(visible.join(known, ["type", "member"], "left_anti"), F.concat_ws(".", "type", "member"))


@rule("preserved_assignment_used_before_assignment", "production")
def _(c):
    asked = replacing(c).where(any_of(F.col("text"), PRESERVE)).select("unit", F.col("target").alias("owner"), "qualname")
    first = lambda facts, kind, how: of(facts, kind).join(asked, ["unit", "owner"]).groupBy("unit", "owner", "qualname", "name").agg(how("line").alias(f"_{kind}"))
    keys = ["unit", "owner", "qualname", "name"]
    old = first(c.before, "assigned_value", F.min).join(first(c.before, "used_value", F.max), keys).where("_used_value > _assigned_value").select(*keys)
    new = first(c.after, "assigned_value", F.min).join(first(c.after, "used_value", F.min), keys).where("_used_value < _assigned_value")
    return found(new.join(old, keys, "left_semi"), "qualname", F.col("name"))


@rule("replace_symbol_artifact_contains_extra_symbol_text", "artifact")
def _(c):
    if "code" not in c.request.columns:
        return empty(c)
    lines = F.filter(F.transform(F.split(F.coalesce("code", F.lit("")), "\n"), lambda x: F.trim(x)), lambda x: x.rlike(r"^(async def|def|class) "))
    names = F.transform(lines, lambda x: F.regexp_extract(x, r"^(?:async def|def|class) ([^(:]*)", 1))
    return found(replacing(c).withColumn("_n", names).where(F.size("_n") > 1), "qualname", F.array_join("_n", ", "))


def validated(case: Case, blocks: tuple[str, ...] = ("production", "generated_test", "generated_test_relevance"), codes: list[str] | None = None) -> DataFrame:
    """Issues of the named blocks' rules (or of ``codes``), with the block.
    More rules than ``TOGETHER`` are worked out in groups, each written to the
    shared folder."""
    chosen = [code for code, (block, _, _) in RULES.items() if ((code in codes) if codes is not None else (block in blocks))]

    def issues(some: list[str]) -> DataFrame:
        rows = [(code, *RULES[code]) for code in some]
        parts = [f(case).select("unit", F.lit(code).alias("code"), F.lit(severity).alias("severity"), "file_path", "symbol", "message", F.lit(block).alias("block")) for code, block, severity, f in rows]
        return reduce(DataFrame.unionByName, parts)

    if len(chosen) <= TOGETHER:
        return issues(chosen) if chosen else None
    groups = [chosen[at : at + TOGETHER] for at in range(0, len(chosen), TOGETHER)]
    with ThreadPoolExecutor(AT_ONCE) as pool:
        return reduce(DataFrame.unionByName, pool.map(lambda g: stored(issues(g), "issues"), groups))


def report(issues: DataFrame, units: DataFrame, blocks: tuple[str, ...] = ("production", "generated_test")) -> DataFrame:
    """Per unit the verdict and its counts of errors and warnings; a block
    fails on any error. Relevance counts as the generated test's."""
    issues = issues.withColumn("block", F.regexp_replace("block", "^generated_test_relevance$", "generated_test"))
    every = units.select("unit").distinct().crossJoin(units.sparkSession.createDataFrame([(b,) for b in blocks], "block string"))
    errors = issues.where("severity = 'error'").groupBy("unit", "block").agg(F.count("*").alias("errors"))
    folded = every.join(errors, ["unit", "block"], "left").withColumn("ok", F.col("errors").isNull())
    counts = issues.groupBy("unit").agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"))
    return verdict(folded, ["unit"]).join(counts, "unit", "left").na.fill(0, ["errors", "warnings"])


def content_key(files: Column, *asked: Column) -> Column:
    """The SHA-256 of all that the issues of a unit hang on, its name aside:
    its ``files`` (an array of (file_path, source), in any order) and what is
    ``asked`` of it. Units of one key have the same issues, so one of them has
    to be judged: rules join by unit, and what they know of other units
    (classes, fields, members) are sets, which copies leave as they are."""
    return F.sha2(F.to_json(F.struct(F.array_sort(files).alias("files"), *asked)), 256)


def case_of(request: DataFrame, facts: DataFrame, project: DataFrame) -> Case:
    """A case from facts whose files are named before/…, after/… and
    tests/…; classes of the patched versions count as known. The facts are
    written once, as every rule reads them, and so are the classes' few
    fields and members, for which all facts would be gone through again."""
    # in the order of their kinds: a rule then reads the pages of its own kinds alone
    facts = stored(facts.sortWithinPartitions("fact", "file_path"), "facts")
    part = lambda p: facts.where(F.col("file_path").startswith(p))
    own = facts.where(~F.col("file_path").startswith("tests/"))
    fields = of(own, "field").select(F.col("owner").alias("type"), F.col("name").alias("field"), F.col("detail").alias("note"), (F.col("n") == 1).alias("required")).distinct()
    members = of(own, "method", "known_attribute").select(F.col("owner").alias("type"), F.col("name").alias("member")).distinct()
    fields, members = stored(fields, "fields"), stored(members, "members")
    return Case(request, part("before/"), part("after/"), part("tests/"), project, fields, members)


def structural(facts: DataFrame) -> DataFrame:
    """Review of changed files: files that do not parse or compile, symbols
    defined twice, and one row of information where there is neither."""
    broken = of(facts, "parse_error").select("unit", F.lit("ast_parse").alias("code"), F.lit("error").alias("severity"), "file_path", F.col("detail").alias("message"))
    twice = of(facts, "definition", "method").groupBy("unit", "file_path", "owner", "name").count().where("count > 1")
    twice = twice.select("unit", F.lit("duplicate_symbol_definition").alias("code"), F.lit("error").alias("severity"), "file_path", F.concat_ws(".", F.nullif("owner", F.lit("")), "name").alias("message"))
    compiled = of(facts, "compile_error").select("unit", F.lit("compileall").alias("code"), F.lit("error").alias("severity"), "file_path", F.col("detail").alias("message"))
    issues = broken.unionByName(twice).unionByName(compiled)
    clean = facts.select("unit").distinct().join(issues.select("unit").distinct(), "unit", "left_anti")
    return issues.unionByName(clean.select("unit", F.lit("structural_review").alias("code"), F.lit("info").alias("severity"), F.lit(None).cast("string").alias("file_path"), F.lit("no issues").alias("message")))


def repair_issues(repairs: DataFrame) -> DataFrame:
    """Issues of repairs (unit, applied, error, failed_blocks, diff): the
    application raised, was not usable, still fails, or changed nothing."""
    code = (
        F.when(F.col("error").isNotNull(), "repair_candidate_apply_failed")
        .when(~F.coalesce("applied", F.lit(False)), "repair_not_applied")
        .when(F.trim(F.coalesce("diff", F.lit(""))) == "", "repair_intent")
        .when(F.col("failed_blocks") > 0, "repair_candidate_rejected")
    )
    return repairs.withColumn("code", code).where("code is not null").select("unit", "code", F.lit("error").alias("severity"), F.coalesce("error", F.lit("")).alias("message"))
