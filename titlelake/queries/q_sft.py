"""SFT preparation, formatting and prediction collection (L9-L11, W7, O2,
U3, F11, J6, P13-P19)."""

from __future__ import annotations

from pyspark.sql import functions as F

from titlelake import fixtures as fx
from titlelake.catalog import register
from titlelake.functions import records as rc
from titlelake.plans import sft
from titlelake.queries.q_functions import strip_sql


def _records(spark, sf):
    return fx.videos(spark, sf).withColumn("row_index", F.col("doc_id"))


def _prep(spark, sf, stratify=False):
    return sft.prepare(_records(spark, sf), sft.SplitConfig(test_size=0.1, seed=42, stratify_source=stratify))


def _sq(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def ex_sql(stratify: bool) -> str:
    st = "source" if stratify else "''"
    return fx.duckdb_ctes("videos") + f""",
r0 as (select doc_id as row_index, video_id, title, description,
         {strip_sql("case when full_transcript is not null and full_transcript <> '' then full_transcript end")} as t,
         {strip_sql('description')} as d from videos),
r1 as (select coalesce(nullif({strip_sql('video_id')}, ''), 'row_' || cast(row_index as varchar)) as id,
         case when t <> '' then 'transcript' when d <> '' then 'description' else '' end as source,
         case when t <> '' then t when d <> '' then d else '' end as source_text,
         {strip_sql('title')} as title, row_index from r0),
ex as (select * from (select *, row_number() over (partition by id order by row_index) as rn from r1
         where length(title) between 10 and 100 and ((source = 'transcript' and length(source_text) between 200 and 50000)
           or (source = 'description' and length(source_text) between 40 and 20000))) x where rn = 1),
rk as (select *, count(*) over (partition by {st}) as n,
         row_number() over (partition by {st} order by sha1('42:' || id)) as rank from ex),
sp as (select *, rank <= case when n <= 1 then 1
         else least(greatest(cast(round_even(n * cast(0.1 as double), 0) as bigint), 1), n - 1) end as is_test from rk)
"""


@register("L9_prepare_sft", ex_sql(False) + """
select id, source, title, length(source_text) as text_len, is_test,
  case when is_test then sha1('42:test:' || id) else sha1('42:train:' || id) end as order_key from sp""")
def q_l9(spark, sf):
    data, _, _ = _prep(spark, sf)
    return data.select("id", "source", "title", F.length("source_text").cast("bigint").alias("text_len"), "is_test", "order_key")


@register("W7_split_stratified", ex_sql(True) + """
select source, is_test, count(*) as rows from sp group by source, is_test""")
def q_w7(spark, sf):
    data, _, _ = _prep(spark, sf, stratify=True)
    return data.groupBy("source", "is_test").agg(F.count(F.lit(1)).alias("rows"))


@register("U3_train_test_disjoint", ex_sql(False) + """
select (select count(*) from sp where not is_test) as train, (select count(*) from sp where is_test) as test,
  (select count(*) from sp where is_test and id in (select id from sp where not is_test)) as overlap""")
def q_u3(spark, sf):
    _, tr, te = _prep(spark, sf)
    ov = tr.select("id").intersect(te.select("id"))
    one = lambda d, n: d.agg(F.count(F.lit(1)).alias(n)).withColumn("__k", F.lit(1))
    return (one(tr, "train").join(F.broadcast(one(te, "test")), "__k")
            .join(F.broadcast(one(ov, "overlap")), "__k").drop("__k"))


def _user_sql(src: str, text: str) -> str:
    label = f"(case when {src} = 'transcript' then 'Transcript' else 'Description' end)"
    return (f"'Based on the following video ' || lower({label}) || ', generate an accurate and compelling YouTube title.'"
            f" || chr(10) || chr(10) || {label} || ':' || chr(10) || {text} || chr(10) || chr(10) || 'Generate the YouTube title:'")


def _turn(role: str, content: str) -> str:
    return f"'{role.upper()}:' || chr(10) || {content} || chr(10)"


@register("L10_training_text", ex_sql(False) + f"""
select sha1('42:train:' || id) as pos, id,
  {_turn('system', _sq(rc.SYSTEM_PROMPT_TRAIN))} || chr(10) ||
  {_turn('user', _user_sql("lower(" + strip_sql('source') + ")", "source_text"))} || chr(10) ||
  {_turn('assistant', 'title')} as text
from sp where not is_test""")
def q_l10(spark, sf):
    data, tr, _ = _prep(spark, sf)
    return sft.training_text(data, tr)


@register("L10_chat_rows", ex_sql(False) + f"""
select id, source, 3 as turns,
  {_turn('system', _sq(rc.SYSTEM_PROMPT_TRAIN))} || chr(10) ||
  {_turn('user', _user_sql('source', "source_text"))} || chr(10) ||
  {_turn('assistant', 'title')} as text
from sp""")
def q_l10_chat(spark, sf):
    """The message form of every example, rendered to text for comparison."""
    data, _, _ = _prep(spark, sf)
    rows = sft.chat_rows(data)
    return rows.select("id", "source", F.size("messages").alias("turns"), rc.messages_to_text("messages").alias("text"))


@register("L10_inference_prompts", ex_sql(False) + f"""
select sha1('42:test:' || id) as pos, id, lower({strip_sql('source')}) as source,
  {_turn('system', _sq(rc.SYSTEM_PROMPT_INFER))} || chr(10) ||
  {_turn('user', _user_sql("lower(" + strip_sql('source') + ")", "source_text"))} || chr(10) || 'ASSISTANT:' || chr(10)
  as prompt, {strip_sql('title')} as reference
from sp where is_test""")
def q_l10i(spark, sf):
    data, _, te = _prep(spark, sf)
    return sft.inference_prompts(data, te)


@register("L11_collect_predictions", ex_sql(False) + f""",
g as ({fx.duckdb_ctes('generations').split('generations as (', 1)[1].rsplit(')', 1)[0]})
select sp.id, lower({strip_sql('sp.source')}) as source, {strip_sql('sp.title')} as reference,
  regexp_replace(regexp_replace({strip_sql(f"string_split_regex({strip_sql('g.raw_output')}, '[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x85\\x{{2028}}\\x{{2029}}]')[1]")},
  '^"+|"+\\z', '', 'g'), '^''+|''+\\z', '', 'g') as prediction
from sp join g on sp.id = g.id""")
def q_l11(spark, sf):
    data, _, _ = _prep(spark, sf)
    return sft.collect_predictions(fx.generations(spark, sf), data)


@register("P16_P19_conversations", """
with m as (select conv_id, list(struct_pack(role := role, content := text) order by turn) as msgs
           from conversations group by conv_id)
select conv_id,
  array_to_string(list_transform(msgs, lambda x: upper(coalesce(x.role, 'user')) || ':' || chr(10) ||
    coalesce(x.content, '') || chr(10)), chr(10)) as text,
  array_to_string(list_concat(list_transform(list_filter(msgs, lambda x: lower(coalesce(x.role, '')) <> 'assistant'),
    lambda x: upper(coalesce(x.role, 'user')) || ':' || chr(10) || coalesce(x.content, '') || chr(10)),
    ['ASSISTANT:' || chr(10)]), chr(10)) as prompt,
  coalesce(""" + strip_sql("list_filter(msgs, lambda x: x.role = 'assistant')[-1].content") + """, '') as reference
from m""")
def q_p16(spark, sf):
    c = fx.base(spark, sf, "conversations")
    msgs = (c.groupBy("conv_id")
            .agg(F.sort_array(F.collect_list(F.struct("turn", F.col("role"), F.col("text").alias("content"))))
                 .alias("m"))
            .select("conv_id", F.transform("m", lambda x: F.struct(x["role"].alias("role"),
                                                                   x["content"].alias("content"))).alias("msgs")))
    return msgs.select("conv_id", rc.messages_to_text("msgs").alias("text"),
                       rc.generation_prompt("msgs").alias("prompt"), rc.extract_reference("msgs").alias("reference"))
