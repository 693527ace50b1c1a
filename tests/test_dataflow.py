"""Types through variables against a walker of one program at a time."""

from __future__ import annotations

import random

from cairnspark.operators import dataflow, validate
from cairnspark.sources import facts

UNITS = "unit string, file_path string, source string"
REQUEST = "unit string, operation string, target string, parent string, qualname string, text string, changed array<string>, target_file string"


def walked(rows):
    """The same types by going over one program's flows until nothing new comes."""
    flows = [(r["owner"], r["name"], r["detail"], r["items"][0]) for r in rows if r["fact"] == "flow"]
    what = {r["name"]: r["detail"] for r in rows if r["fact"] == "definition"}
    notes = {r["name"]: r["detail"] for r in rows if r["fact"] == "returns" and r["owner"] == ""}
    derived = {r["name"] for r in rows if r["fact"] == "derived"}
    plain = {"int": "int", "str": "str", "": "?"}
    types: dict = {(o, n): set() for o, n, _, _ in flows}
    changed = True
    while changed:
        changed = False
        for owner, name, kind, x in flows:
            if kind == "type":
                new = {x}
            elif kind == "note":
                new = {plain[x]}
            elif kind == "name":
                at = (owner, x) if (owner, x) in types else ("", x)
                new = types.get(at, {"?"})
            elif what.get(x) == "class":
                new = {"?" if x in derived else x}
            elif what.get(x) == "function":
                new = {plain[notes[x]]} if notes[x] else types.get((x, "return"), set())
            else:
                new = {"?"}
            if not new <= types[owner, name]:
                types[owner, name] |= new
                changed = True
    return {(o, n, t) for (o, n), all_ in types.items() for t in all_}


def program(r):
    """Functions that call each other and assign variables in branches."""
    names, values = ["a", "b", "c"], ["1", "'s'", "[]", "a", "b", "c", "G", "f0()", "f1(a)", "f2()", "K()", "D()", "len(a)", "a.b", "1 if a else b", "a or 's'", "None"]
    out = ["G = " + r.choice(["1", "'g'", "K()", "G"]), "class K:\n    pass", "class D(K):\n    pass"]
    for i in range(3):
        body = [f"def f{i}(a{r.choice(['', ': int', ': str'])}){r.choice(['', '', ' -> int'])}:"]
        for _ in range(r.randint(0, 4)):
            line = f"{r.choice(names)} = {r.choice(values)}"
            body += [f"    if a:\n        {line}\n    else:\n        {r.choice(names)} = {r.choice(values)}" if r.random() < 0.4 else f"    {line}"]
        body += [f"    for {r.choice(names)} in a:\n        pass"] if r.random() < 0.2 else []
        body += [f"    return {r.choice(values)}"] if r.random() < 0.8 else ["    pass"]
        out.append("\n".join(body))
    return "\n\n\n".join(out) + "\n"


def test_as_the_walker(spark):
    r = random.Random(3)
    sources = [(f"u{i}", "after/a.py", program(r)) for i in range(60)]
    rows = facts.facts(spark.createDataFrame(sources, UNITS)).cache()
    got: dict = {}
    for x in dataflow.variable_types(rows).collect():
        got.setdefault(x["unit"], set()).add((x["owner"], x["name"], x["type"]))
    by_unit: dict = {}
    for x in rows.collect():
        by_unit.setdefault(x["unit"], []).append(x)
    for unit, own in by_unit.items():
        assert got.get(unit, set()) == walked(own), dict((u, s) for u, _, s in sources)[unit]


def test_rules_through_variables(spark):
    """A call's result, reassignment in branches, chains, and values that are
    not known."""
    source = (
        "from dataclasses import dataclass\n\n\n@dataclass\nclass M:\n    n: int\n    s: str = ''\n\n\nclass Text(str):\n    pass\n\n\nclass Other:\n    pass\n\n\n"
        "def f():\n    return 'x'\n\n\ndef g() -> int:\n    return 1\n\n\ndef h():\n    return f()\n\n\ndef take(n: int, s: str = ''):\n    return n\n\n\n"
        "def use(p, q: str, flag):\n    x = f()\n    M(n=x)\n    y = h()\n    M(n=y, s=y)\n    if flag:\n        z = 'a'\n    else:\n        z = []\n    M(n=z)\n    if flag:\n        w = 1\n    else:\n        w = 'b'\n    M(n=w)\n"
        "    M(n=p)\n    M(n=q)\n    M(n=g())\n    t = Text()\n    M(n=1, s=t)\n    o = Other()\n    M(n=1, s=o)\n    take(x)\n    take(g(), q)\n    take(w, [])\n    for k in flag:\n        take(k)\n    v = g()\n    take(1, s=v)\n    take(1 if flag else 's')\n    take('a' if flag else 's')\n"
    )
    request = spark.createDataFrame([("u", "replace_symbol", "use", None, "m.use", "", ["a.py"], "a.py")], REQUEST)
    case = validate.case_of(request, facts.facts(spark.createDataFrame([("u", "after/a.py", source)], UNITS)), spark.createDataFrame([], "module string, name string"))
    codes = ["model_constructor_field_type_mismatch", "contract_call_argument_type_mismatch"]
    got = {(r["code"], r["symbol"], r["message"]) for r in validate.validated(case, codes=codes).collect()}
    assert got == {
        (codes[0], "M.n", "str for int"), (codes[0], "M.n", "list or str for int"), (codes[0], "M.s", "Other for str"),
        (codes[1], "take", "str for int"), (codes[1], "take", "list for str"),
    }
