"""The validators over a table: every part is a unit whose sources hold a
defect wherever a column of the part says so, and the SQL counts the parts of
each defect without looking at any source."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.tables import stored
from ..operators import validate
from ..sources import facts
from .registry import query

#: Where a unit has a defect: a condition on the part, in SQL of both engines.
DEFECTS = {
    "missing_docstring_after_replace": "p_size % 2 = 0",
    "unknown_self_method": "p_size % 3 = 0",
    "unknown_self_attribute": "p_partkey % 5 = 0",
    "unknown_self_attribute_assignment": "p_partkey % 7 = 1",
    "unknown_runtime_name": "p_brand like '%3'",
    "self_method_call_missing_required_args": "p_size % 4 = 1",
    "self_method_call_unknown_keyword_arg": "p_partkey % 6 = 2",
    "self_method_call_missing_required_keyword_only_args": "p_retailprice > 950",
    "duplicate_symbol_definition": "p_type = 'SMALL'",
    "unknown_annotation_name": "p_partkey % 11 = 3",
    "model_constructor_field_type_mismatch": "p_size > 25",
    "unknown_model_constructor_keyword": "p_partkey % 3 = 1",
    "unknown_model_attribute": "p_partkey % 8 = 5",
    "contract_call_missing_required_positional_args": "p_size % 7 = 0",
    "contract_call_argument_type_mismatch": "p_partkey % 9 = 4",
    "unknown_injected_dependency_attribute": "p_size % 10 = 3",
    "unknown_injected_dependency_method": "p_size % 10 = 6",
    "unused_import_change": "p_partkey % 4 = 3",
    "duplicated_import_change_with_local_import": "p_partkey % 12 = 7",
    "generated_test_uses_mocker_fixture": "p_size % 6 = 4",
    "generated_test_only_trivial_asserts": "p_partkey % 10 = 9",
    "generated_test_imports_pytest_mock": "p_size % 9 = 5",
    "generated_test_import_points_to_missing_module": "p_partkey % 13 = 6",
    "generated_test_imports_missing_project_name": "p_partkey % 14 = 8",
}
#: Parts whose sources one task writes and hashes, about: tens of microseconds each.
PARTS_A_TASK = 100_000
BEFORE = 'class A:\n    def run(self, a, b=1):\n        """Doc."""\n        return a\n\n\ndef f():\n    pass\n'


def _files():
    """A part's sources (file_path, source): a file before and after, and its test."""
    has = {code: F.expr(rule) for code, rule in DEFECTS.items()}
    piece = lambda code, yes, no="": F.when(has[code], yes).otherwise(no)
    after = F.concat(
        F.lit("from dataclasses import dataclass\nfrom os import path\n"),
        piece("unused_import_change", "import json\n"),
        F.lit("\n\n@dataclass\nclass M:\n    n: int\n    s: str = ''\n\n\nclass D:\n    def __init__(self):\n        self.known = 1\n\n    def do(self):\n        return self.known\n\n\n"),
        F.lit("class A:\n    def __init__(self, d: D):\n        self.d = d\n\n    def other(self, *, key):\n        return key\n\n    def run(self, a, b=1):\n"),
        piece("missing_docstring_after_replace", "", '        """Doc."""\n'),
        piece("unknown_self_method", "        self.ghost()\n"),
        piece("unknown_self_attribute", "        print(self.nowhere)\n"),
        piece("unknown_self_attribute_assignment", "        self.fresh = a\n"),
        piece("unknown_runtime_name", "        print(undefined_name)\n"),
        piece("self_method_call_missing_required_args", "        self.run()\n"),
        piece("self_method_call_unknown_keyword_arg", "        self.run(a, zz=2)\n"),
        piece("self_method_call_missing_required_keyword_only_args", "        self.other()\n"),
        piece("unknown_injected_dependency_attribute", "        print(self.d.gone)\n"),
        piece("unknown_injected_dependency_method", "        self.d.lost()\n"),
        F.lit("        return path.join(a, str(b))\n\n\ndef f():\n    pass\n\n\ndef g(x: int):\n    return x\n\n\ndef text():\n    return 'x'\n\n\n"),
        piece("duplicate_symbol_definition", "def f():\n    pass\n\n\n"),
        piece("unknown_annotation_name", "def noted(x: Unheard):\n    return x\n\n\n"),
        F.lit("def use():\n"),
        piece("duplicated_import_change_with_local_import", "    from os import path\n"),
        F.lit("    m = M(n=1)\n"),
        piece("model_constructor_field_type_mismatch", "    t = text()\n    M(n=t)\n"),
        piece("unknown_model_constructor_keyword", "    M(n=1, zz=2)\n"),
        piece("unknown_model_attribute", "    print(m.zzz)\n"),
        piece("contract_call_missing_required_positional_args", "    g()\n"),
        piece("contract_call_argument_type_mismatch", "    word = 'w'\n    g(word)\n"),
        F.lit("    return m.n\n"),
    )
    test = F.concat(
        F.lit("from shop.storage import Store\n"),
        piece("generated_test_imports_pytest_mock", "import pytest_mock\n"),
        piece("generated_test_import_points_to_missing_module", "from shop.missing import Thing\n"),
        piece("generated_test_imports_missing_project_name", "from shop.storage import nothing\n"),
        F.lit("\n\ndef test_run("),
        piece("generated_test_uses_mocker_fixture", "mocker"),
        F.lit("):\n    s = Store()\n"),
        piece("generated_test_only_trivial_asserts", "    assert True\n", "    assert s.run\n"),
    )
    return F.array(*[F.struct(F.lit(p).alias("file_path"), s.alias("source")) for p, s in (("before/a.py", F.lit(BEFORE)), ("after/a.py", after), ("tests/t.py", test))])


_cases = ", ".join(f"case when {rule} then '{code}' end" for code, rule in DEFECTS.items())


@query(
    f"""select code, count(*) as units, min(p_partkey) as first_unit, max(p_partkey) as last_unit from (select p_partkey, unnest([{_cases}]) as code from part)
    where code is not null group by code"""
)
def rule_counts(t):
    """Units of each issue code, by the rules over facts of their sources.
    Every part's sources are written and hashed; of parts whose sources are
    equal one is judged, and its issues are those of all of them."""
    parts = facts.spread(t("part"), "p_partkey", a_task=PARTS_A_TASK)
    key = validate.content_key(_files()).alias("unit")
    units = parts.select("p_partkey", key).groupBy("unit").agg(F.count("*").alias("units"), F.min("p_partkey").alias("first_unit"), F.max("p_partkey").alias("last_unit"))
    units = stored(units, "units")
    some = units.select("first_unit").distinct()
    # a key that several parts have brings more than one of a kind
    cases = t("part").join(some, F.col("p_partkey").eqNullSafe(F.col("first_unit")), "left_semi").select(key, _files().alias("files")).dropDuplicates(["unit"])
    cases = stored(cases, "cases")
    sources = cases.select("unit", F.explode("files").alias("f")).select("unit", "f.file_path", "f.source")
    request = cases.select(
        "unit", F.lit("replace_symbol").alias("operation"), F.lit("run").alias("target"), F.lit("A").alias("parent"), F.lit("m.A.run").alias("qualname"), F.lit("change").alias("text"),
        F.array(F.lit("a.py")).alias("changed"), F.lit("a.py").alias("target_file"), F.array(F.lit("m.g")).alias("contracts"),
    )
    project = t.spark.createDataFrame([("shop.storage", "Store"), ("os", "path")], "module string, name string")
    issues = validate.validated(validate.case_of(request, facts.facts(sources), project), codes=list(DEFECTS))
    each = issues.select("code", "unit").distinct().join(units, "unit")
    return each.groupBy("code").agg(F.sum("units").alias("units"), F.min("first_unit").alias("first_unit"), F.max("last_unit").alias("last_unit"))
