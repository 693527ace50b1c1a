"""Types of variables by a fixpoint over flow facts.

A flow says that a variable of a scope takes the type of a literal, a note, a
call's result or another variable; branches and later assignments are flows
beside each other. Types are carried along flows, and out of functions
without a note by what they return, until a round brings nothing new; each
round joins only what the last one brought. ``?`` stands for what is not
known, and is carried like any type, so a variable's types are either all
there are or hold a ``?``. An instance of a class with bases may pass for any
of them and is not known.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tables import stored
from ..functions.text import type_name

UNKNOWN = "?"
SCOPE = ["unit", "file_path", "owner", "name"]


def _noted(c):
    """A note's bare type; unknown where it may be None or several types."""
    open_ = F.contains(c, F.lit("None")) | F.contains(c, F.lit("Optional")) | F.contains(c, F.lit("|")) | F.contains(c, F.lit("Union"))
    return F.when(open_ | (F.trim(c) == ""), UNKNOWN).otherwise(type_name(c))


def edges_and_types(facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(from_owner, from_name → scope) and the types that flows give at once."""
    flows = facts.where("fact = 'flow'").select(*SCOPE, F.col("detail").alias("kind"), F.col("items")[0].alias("what")).distinct()
    flows = stored(flows, "flows")
    files = ["unit", "file_path"]
    derived = facts.where("fact = 'derived'").select(*files, F.col("name").alias("what"), F.lit(True).alias("_derived")).distinct()
    ours = facts.where("fact = 'definition'").select(*files, F.col("name").alias("what"), F.col("detail").alias("_is")).distinct()
    notes = facts.where("fact = 'returns' and owner = ''").select(*files, F.col("name").alias("what"), F.col("detail").alias("_note")).distinct()
    given = flows.where("kind = 'type'").select(*SCOPE, F.col("what").alias("type"))
    given = given.unionByName(flows.where("kind = 'note'").select(*SCOPE, _noted(F.col("what")).alias("type")))
    calls = flows.where("kind = 'call'").join(ours, [*files, "what"], "left").join(notes, [*files, "what"], "left").join(derived, [*files, "what"], "left")
    plain = (F.col("_is") == "function") & (F.coalesce("_note", F.lit("")) == "")
    of_call = F.when((F.col("_is") == "class") & F.col("_derived").isNull(), F.col("what")).when((F.col("_is") == "function") & (F.coalesce("_note", F.lit("")) != ""), _noted(F.col("_note"))).otherwise(UNKNOWN)
    given = given.unionByName(calls.where(~F.coalesce(plain, F.lit(False))).select(*SCOPE, of_call.alias("type")))
    known = flows.select(*files, F.col("owner").alias("from_owner"), F.col("name").alias("from_name")).distinct()
    returned = calls.where(plain).select(*SCOPE, F.col("what").alias("from_owner"), F.lit("return").alias("from_name"))
    names = flows.where("kind = 'name'").select(*SCOPE, F.col("owner").alias("from_owner"), F.col("what").alias("from_name"))
    # a name that its scope does not bind is the module's
    own = names.join(known, [*files, "from_owner", "from_name"], "left_semi")
    outer = names.join(known, [*files, "from_owner", "from_name"], "left_anti").withColumn("from_owner", F.lit(""))
    module = outer.join(known, [*files, "from_owner", "from_name"], "left_semi")
    nowhere = outer.join(known, [*files, "from_owner", "from_name"], "left_anti").select(*SCOPE, F.lit(UNKNOWN).alias("type"))
    columns = [*SCOPE, "from_owner", "from_name"]
    edges = own.select(*columns).unionByName(module.select(*columns)).unionByName(returned.select(*columns)).distinct()
    return stored(edges, "flow_edges"), given.unionByName(nowhere).distinct()


def variable_types(facts: DataFrame) -> DataFrame:
    """(unit, file_path, owner, name, type) of all variables with flows."""
    edges, given = edges_and_types(facts)
    known = fresh = stored(given, "types")
    while not fresh.isEmpty():
        moved = fresh.select("unit", "file_path", F.col("owner").alias("from_owner"), F.col("name").alias("from_name"), "type")
        new = edges.join(moved, ["unit", "file_path", "from_owner", "from_name"]).select(*SCOPE, "type").distinct()
        fresh = stored(new.join(known, [*SCOPE, "type"], "left_anti"), "fresh_types")
        known = stored(known.unionByName(fresh), "types")
    return known
