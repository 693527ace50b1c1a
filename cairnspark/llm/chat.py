"""Chat formatting by multi-party perspective rotation.

Every participant of a conversation is the assistant once: the whole dialogue
is rendered with that speaker's turns as the assistant's, the others' as those
of named users, and a mask of the assistant's words. All in DataFrame
functions.

A conversation of more than ``part_turns`` turns is written in several rows,
which put together are its rendering: ``start`` is a row's place in the whole
and the mask counts from the head of the conversation. So no row and no group
grows with the length of a conversation. Turns are numbered by a range
partitioning: a long conversation, or one turn number with many rows, is
spread over tasks, each numbers its own stretch, and only the stretches' sizes
meet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import running, stored

PART_TURNS = 256
_FIRST = "-9223372036854775808"


def speaker_name(c: str) -> Column:
    """A speaker's name for a user turn: other signs than letters, digits,
    full stop and hyphen as ``_`` hex ``_``, so no two speakers share one."""
    return F.expr(f"array_join(transform(regexp_extract_all({c}, '(?s).', 0), x -> if(x rlike '^[A-Za-z0-9.-]$', x, concat('_', hex(x), '_'))), '')")


def rotated(conversations: DataFrame, part_turns: int = PART_TURNS) -> DataFrame:
    """One row per conversation, participant and ``part_turns`` turns: conv_id,
    part, perspective, n_turns, n_masked, start, rendered and mask (start:end
    in code points of the whole rendering, end exclusive, of each assistant
    turn with its end marker).

    A participant is any role but ``system``, which stays a system turn; a
    null role is the participant ``unknown``. Turns stand in the order of
    (turn, role, text), null turn numbers first; exact repeats of a row count
    once; null texts are empty and very long ones whole. A null conv_id is a
    conversation of its own. Marker text inside a turn is broken up.
    Conversations of system turns alone have no participant and no row, nor
    has an empty table. Other columns are not read.
    """
    turns = conversations.select(
        F.col("conv_id"),
        F.coalesce(F.col("turn").cast("long"), F.lit(int(_FIRST))).alias("t"),
        F.coalesce("role", F.lit("unknown")).alias("speaker"),
        F.coalesce("text", F.lit("")).alias("text"),
    ).distinct()
    kind = conversations.schema["conv_id"].dataType
    turns = turns.select(F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("c"), F.col("conv_id").isNull().alias("none"), "t", "speaker", "text")
    turns = running(turns.withColumn("one", F.lit(1)), ["c", "none"], ["t", "speaker", "text"], "one", "nth")
    turns = stored(turns.withColumn("part", F.expr(f"nth div {part_turns}")), "numbered")
    # speakers meet parts, not turns: the first join's rows are few
    people = turns.where("speaker <> 'system'").select("c", "none", F.col("speaker").alias("perspective")).distinct()
    views = turns.select("c", "none", "part").distinct().join(people, ["c", "none"])
    each = turns.join(views, ["c", "none", "part"])
    each = each.withColumn("mine", F.expr("speaker = perspective and speaker <> 'system'")).withColumn("name", speaker_name("speaker"))
    each = each.withColumn(
        "segment",
        F.expr(
            "concat('<|im_start|>', case when speaker = 'system' then 'system' when mine then 'assistant' else concat('user name=', name) end, "
            "'\\n', replace(text, '<|', '< |'), '<|im_end|>\\n')"
        ),
    )
    key = ["c", "none", "part", "perspective"]
    placed = each.withColumn("at", F.expr(f"coalesce(sum(length(segment)) over (partition by {', '.join(key)} order by nth rows between unbounded preceding and 1 preceding), 0)"))
    rows = placed.groupBy(*key).agg(
        F.expr("array_sort(collect_list(struct(nth, segment, mine, at)))").alias("all"), F.count("*").alias("n_turns"), F.expr("count_if(mine)").alias("n_masked"), F.sum(F.length("segment")).alias("size")
    )
    rows = rows.select(*key, "n_turns", "n_masked", "size", F.expr("array_join(transform(all, x -> x.segment), '')").alias("rendered"), F.expr("transform(filter(all, x -> x.mine), x -> struct(x.at, length(x.segment) as n))").alias("own"))
    rows = stored(rows, "parts")
    starts = rows.select(*key, F.expr("coalesce(sum(size) over (partition by c, none, perspective order by part rows between unbounded preceding and 1 preceding), 0)").alias("start"))
    head = len("<|im_start|>assistant\n")
    return rows.join(starts, key).select(
        F.when(~F.col("none"), F.col("c")).cast(kind).alias("conv_id"),
        "part",
        "perspective",
        "n_turns",
        "n_masked",
        "start",
        "rendered",
        F.expr(f"array_join(transform(own, x -> concat(start + x.at + {head}, ':', start + x.at + x.n - 1)), ',')").alias("mask"),
    )


SQL = r"""
with turns as (
  select *, ((row_number() over (partition by conv_id order by t, speaker, text) - 1) // 256)::bigint as part from (
    select distinct conv_id, coalesce(turn, -9223372036854775808) as t, coalesce(role, 'unknown') as speaker, coalesce(text, '') as text from conversations)),
people as (select distinct conv_id as c, speaker as perspective from turns where speaker <> 'system'),
each_turn as (
  select conv_id, t, part, speaker, text, perspective, speaker = perspective as mine,
         '<|im_start|>' || case when speaker = 'system' then 'system' when speaker = perspective then 'assistant'
           else 'user name=' || array_to_string(list_transform(regexp_extract_all(speaker, '(?s).'), lambda x: case when regexp_matches(x, '^[A-Za-z0-9.-]$') then x else '_' || hex(x) || '_' end), '') end
           || chr(10) || replace(text, '<|', '< |') || '<|im_end|>' || chr(10) as segment
  from turns join people on conv_id is not distinct from c),
placed as (
  select *, coalesce(sum(length(segment)) over (partition by conv_id, perspective order by t, speaker, text rows between unbounded preceding and 1 preceding), 0)::bigint as pos
  from each_turn)
select conv_id, part, perspective, count(*) as n_turns, count(*) filter (mine) as n_masked, min(pos) as start, string_agg(segment, '' order by t, speaker, text) as rendered,
       coalesce(string_agg((pos + 22) || ':' || (pos + length(segment) - 1), ',' order by t, speaker, text) filter (mine), '') as mask
from placed group by conv_id, part, perspective
"""
