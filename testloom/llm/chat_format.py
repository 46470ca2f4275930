"""Chat formatting by multi-party perspective rotation.

For every participant of a conversation the whole dialogue is rendered once with that
speaker as `assistant`; everyone else is a `user` with a name, and the loss mask covers
what the assistant says. `system` turns set the scene: they are rendered as such in
every perspective and are nobody's perspective.

A turn is rendered as

    <|assistant|>            or  <|user name=ROLE|>  or  <|system|>
    TEXT
    <|end|>

each line ended by a line feed. In TEXT a `<|` becomes `<\\|` (and `<\\|`
becomes `<\\\\|`, and so on). In ROLE `|` becomes `\\p`, a line feed `\\n` and a backslash
`\\\\`, so a name is one line without `|>`. Markers can't be forged and rendering can be undone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Turn numbers of one rendered part: a longer dialogue goes on in further parts.
PART_TURNS = 256


def escaped(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"<(\\*)\|", r"<\\$1|")


def escaped_role(c: Column) -> Column:
    for char, code in (("\\", "\\\\"), ("|", "\\p"), ("\n", "\\n")):
        c = F.replace(c, F.lit(char), F.lit(code))
    return c


def perspectives(conversations: DataFrame, part_turns: int | None = PART_TURNS) -> DataFrame:
    """One row per conversation, participant and part: conv_id, speaker, part, n_turns, n_chars, n_masked, rendered, mask.

    mask: `start-end` character ranges (from 0, end excluded) of the assistant's text and
    end marker, comma-joined. Parts hold `part_turns` consecutive turn numbers; a null
    turn counts as number -1. Turns of one number go by role and text; rows that agree in
    all four columns are one utterance. Null text is an empty utterance; a null or empty
    role is `unknown`; a null conv_id is a conversation of its own. With part_turns None every
    dialogue is one part, whatever its length. Conversations of system
    turns only have no participant and give no row. Extra columns are ignored.

    Participants are gathered by a partial aggregation, parts have bounded turn numbers,
    so a conversation with a third of all turns spreads over as many tasks as it has parts.
    """
    role = F.coalesce(F.nullif(F.col("role"), F.lit("")), F.lit("unknown"))
    turns = conversations.select("conv_id", F.coalesce(F.col("turn").cast("long"), F.lit(-1)).alias("turn"), role.alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    parts = (
        turns.withColumn("part", F.floor(F.col("turn") / part_turns) if part_turns else F.lit(0).cast("long"))
        .groupBy("conv_id", "part")
        .agg(F.array_sort(F.collect_set(F.struct("turn", "role", "text"))).alias("turns"))
    )
    speakers = turns.where("role != 'system'").select(F.col("conv_id").alias("s_conv"), F.col("role").alias("speaker")).distinct()
    rows = parts.join(speakers, parts.conv_id.eqNullSafe(speakers.s_conv)).drop("s_conv")

    def header(t: Column) -> Column:
        return F.when(t["role"] == F.col("speaker"), F.lit("<|assistant|>\n")).when(t["role"] == "system", F.lit("<|system|>\n")).otherwise(F.concat(F.lit("<|user name="), escaped_role(t["role"]), F.lit("|>\n")))

    rendered = F.transform("turns", lambda t: F.struct(header(t).alias("head"), F.concat(escaped(t["text"]), F.lit("\n<|end|>\n")).alias("body"), (t["role"] == F.col("speaker")).alias("own")))
    rows = rows.select("conv_id", "speaker", "part", F.size("turns").cast("long").alias("n_turns"), rendered.alias("r"))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans"), F.lit(0).alias("masked"))

    def step(acc: Column, t: Column) -> Column:
        start, size = acc["at"] + F.char_length(t["head"]), F.char_length(t["body"])
        span = F.array(F.concat(start.cast("string"), F.lit("-"), (start + size).cast("string")))
        return F.struct((start + size).alias("at"), F.when(t["own"], F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"), (acc["masked"] + F.when(t["own"], size).otherwise(0)).alias("masked"))

    rows = rows.withColumn("m", F.aggregate("r", zero, step))
    text = F.array_join(F.transform("r", lambda t: F.concat(t["head"], t["body"])), "")
    return rows.select("conv_id", "speaker", "part", "n_turns", F.col("m.at").cast("long").alias("n_chars"), F.col("m.masked").cast("long").alias("n_masked"), text.alias("rendered"), F.array_join("m.spans", ",").alias("mask"))


ORACLE_SQL = r"""
with t as (select distinct conv_id, coalesce(cast(turn as bigint), -1) as turn, coalesce(nullif(role, ''), 'unknown') as role, coalesce(text, '') as text from conversations),
s as (select distinct conv_id, role as speaker from t where role <> 'system'),
r as (select t.conv_id, s.speaker, cast(floor(turn / 256.0) as bigint) as part, turn, role, text, role = s.speaker as own,
  case when role = s.speaker then '<|assistant|>' || chr(10) when role = 'system' then '<|system|>' || chr(10)
    else '<|user name=' || replace(replace(replace(role, '\', '\\'), '|', '\p'), chr(10), '\n') || '|>' || chr(10) end as head,
  regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g') || chr(10) || '<|end|>' || chr(10) as body
  from t join s on t.conv_id is not distinct from s.conv_id),
o as (select *, sum(length(head) + length(body)) over (partition by conv_id, speaker, part order by turn, role, text rows unbounded preceding) as upto from r)
select conv_id, speaker, part, count(*) as n_turns, cast(sum(length(head) + length(body)) as bigint) as n_chars,
  cast(sum(case when own then length(body) else 0 end) as bigint) as n_masked,
  string_agg(head || body, '' order by turn, role, text) as rendered,
  coalesce(string_agg(case when own then cast(upto - length(body) as varchar) || '-' || cast(upto as varchar) end, ',' order by turn, role, text), '') as mask
from o group by conv_id, speaker, part
"""
