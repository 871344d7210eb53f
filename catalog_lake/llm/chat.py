"""Chat formatting of preference pairs.

A pair is two conversations, chosen and rejected. Their longest common prefix of turns (same role, same
text) is rendered once as the prompt; what follows in each is rendered as its completion, with a mask:
the spans of the completion that carry loss, which are the bodies of assistant turns and their end marks.

One aggregation by pair brings a pair's turns together; a pair is as large as its two conversations,
whatever other pairs there are, so a turn that very many conversations share is no hot key. Column
expressions only. Defined cases: NULL roles and texts are empty; a row with a NULL conv_id is a conversation of
its own, so that rows without ids are never gathered; turns
are ordered by turn (NULL first), then role and text; turns that repeat one number, and repeated rows, are
all kept; identical conversations have empty completions and empty masks; a conversation without turns has
an empty prompt and completion; texts of any length are rendered whole; an empty table gives an empty
result; other columns of the input are not touched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Marks of the template.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def one_turn(role: Column, text: Column) -> Column:
    return F.struct(F.col("turn"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))


def turns(role: Column, text: Column) -> Column:
    """An aggregate: the turns of a group as an ordered array of (turn, role, text)."""
    return F.sort_array(F.collect_list(one_turn(role, text)))


def list_turns(conversations: DataFrame, column: str) -> DataFrame:
    """conv_id and its turns; rows without an id stay where they are, each by itself."""
    said = F.col("role"), F.col("text")
    known = conversations.filter("conv_id is not null").groupBy("conv_id").agg(turns(*said).alias(column))
    return known.unionByName(conversations.filter("conv_id is null").select("conv_id", F.array(one_turn(*said)).alias(column)))


def common_turns(a: str, b: str) -> Column:
    """Length of the longest common prefix of two arrays of turns."""
    same = f"{a}[int(i)].role = {b}[int(i)].role and {a}[int(i)].text = {b}[int(i)].text"
    least = f"least(size({a}), size({b}))"
    return F.expr(f"coalesce(array_min(filter(transform(sequence(0, {least}), i -> if(i < {least} and coalesce({same.replace('[int(i)]', '[i]')}, false), null, i)), i -> i is not null)), 0)")


def rendered(array: str) -> str:
    """SQL that renders an array of turns."""
    return f"array_join(transform({array}, t -> concat('{OPEN}', t.role, '\n', t.text, '{CLOSE}')), '')".replace("\n'", "\\n'")


def masked(array: str) -> str:
    """SQL for the assistant spans (begin-end, code points, end exclusive) of a rendered array of turns."""
    head, tail = len(OPEN) + 1, len(CLOSE)
    step = (
        f"aggregate({array}, named_struct('at', 0, 'spans', cast(array() as array<string>)), (a, t) -> named_struct("
        f"'at', a.at + {head} + length(t.role) + length(t.text) + {tail},"
        f"'spans', if(t.role = 'assistant', array_append(a.spans, concat(a.at + {head} + length(t.role), '-', a.at + {head} + length(t.role) + length(t.text) + {tail - 1})), a.spans)), a -> a.spans)"
    )
    return f"array_join({step}, ',')"


def format_pairs(pairs: DataFrame, key: str) -> DataFrame:
    """key, n_prompt_turns, prompt, chosen, chosen_mask, rejected, rejected_mask of (key, chosen_turns, rejected_turns)."""
    cut = pairs.withColumn("n_prompt_turns", common_turns("chosen_turns", "rejected_turns").cast("bigint"))
    for side in ("chosen", "rejected"):
        cut = cut.withColumn(f"__{side}", F.expr(f"slice({side}_turns, int(n_prompt_turns) + 1, size({side}_turns))"))
    cut = cut.withColumn("__prompt", F.expr("slice(chosen_turns, 1, int(n_prompt_turns))"))
    return cut.select(
        key,
        "n_prompt_turns",
        F.expr(rendered("__prompt")).alias("prompt"),
        *(F.expr(f(f"__{side}")).alias(side + end) for side in ("chosen", "rejected") for f, end in ((rendered, ""), (masked, "_mask"))),
    )


#: Conversation ids are reduced by the first and spread by the second when a branch is chosen.
REDUCE, SPREAD = 1_000_003, 7919


def pair_with_repeats(conversations: DataFrame) -> DataFrame:
    """One pair per conversation: chosen is the whole conversation; rejected branches off at one of its assistant turns.

    The branch is chosen by conv_id, so that prompts end anywhere in a conversation. There, rejected has
    the assistant turn before instead, or nothing at the first; the later turns follow on both sides.
    Conversations without an assistant turn are paired with themselves: all prompt, empty completions.
    """
    listed = list_turns(conversations, "chosen_turns")
    places = "filter(transform(chosen_turns, (t, i) -> if(t.role = 'assistant', i, null)), i -> i is not null)"
    listed = listed.withColumn("__places", F.expr(places))
    listed = listed.withColumn("__k", F.expr(f"pmod(pmod(coalesce(conv_id, 0L), {REDUCE}L) * {SPREAD}L, nullif(size(__places), 0))").cast("int"))
    listed = listed.withColumn("__at", F.expr("get(__places, __k)")).withColumn("__other", F.expr("coalesce(get(chosen_turns, get(__places, __k - 1)).text, '')"))
    swapped = F.expr("transform(chosen_turns, (t, i) -> if(i <=> __at, named_struct('turn', t.turn, 'role', t.role, 'text', __other), t))")
    return listed.select("conv_id", "chosen_turns", swapped.alias("rejected_turns"))


def _oracle_side(name: str, column: str) -> str:
    """Rows (conv_id, body, mask) of one side's completion, as DuckDB SQL."""
    head, tail = len(OPEN) + 1, len(CLOSE)
    return f"""{name} as (select conv_id, string_agg(piece, '' order by pos) as body,
    coalesce(string_agg(case when role = 'assistant' then (begins + {head} + length(role)) || '-' || (begins + {head} + length(role) + length({column}) + {tail - 1}) end, ',' order by pos), '') as mask
  from (select *, coalesce(sum(length(piece)) over (partition by conv_id order by pos rows between unbounded preceding and 1 preceding), 0)::bigint as begins
    from (select *, '{OPEN}' || role || chr(10) || {column} || '<|im_end|>' || chr(10) as piece from cut where pos >= first_difference)) group by conv_id)"""


#: DuckDB SQL for the query over conversations: turns are compared by position; rows without an id, below, are one turn each.
ORACLE = f"""
with t as (select conv_id, coalesce(role, '') as role, coalesce(text, '') as text,
  row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as pos from conversations where conv_id is not null),
a as (select *, sum((role = 'assistant')::int) over (partition by conv_id order by pos) as k, sum((role = 'assistant')::int) over (partition by conv_id) as n,
  last_value(case when role = 'assistant' then text end ignore nulls) over (partition by conv_id order by pos rows between unbounded preceding and 1 preceding) as before from t),
r as (select conv_id, pos, role, text, case when role = 'assistant' and k - 1 = ((coalesce(conv_id, 0) % {REDUCE} + {REDUCE}) % {REDUCE} * {SPREAD}) % n then coalesce(before, '') else text end as other from a),
cut as (select *, coalesce(min(case when text <> other then pos end) over (partition by conv_id), 9223372036854775807) as first_difference from r),
{_oracle_side("chosen", "text")},
{_oracle_side("rejected", "other")},
prompts as (select conv_id, count(*) filter (where pos < first_difference) as n,
  coalesce(string_agg('{OPEN}' || role || chr(10) || text || '<|im_end|>' || chr(10), '' order by pos) filter (where pos < first_difference), '') as prompt from cut group by conv_id)
select p.conv_id, cast(p.n as bigint) as n_prompt_turns, p.prompt, coalesce(c.body, '') as chosen, coalesce(c.mask, '') as chosen_mask, coalesce(r.body, '') as rejected, coalesce(r.mask, '') as rejected_mask
from prompts as p left join chosen as c on c.conv_id = p.conv_id left join rejected as r on r.conv_id = p.conv_id
union all
select null, case when differs then 0 else 1 end, case when differs then '' else piece end, case when differs then piece else '' end, case when differs then begins || '-' || (begins + length(text) + {len(CLOSE) - 1}) else '' end,
  case when differs then '{OPEN}' || role || chr(10) || '<|im_end|>' || chr(10) else '' end, case when differs then begins || '-' || (begins + {len(CLOSE) - 1}) else '' end
from (select role, text, role = 'assistant' and text <> '' as differs, '{OPEN}' || role || chr(10) || text || '<|im_end|>' || chr(10) as piece, {len(OPEN) + 1} + length(role) as begins
  from (select coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is null))"""
